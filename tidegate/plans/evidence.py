"""What the real tables and the query log say about a fleet's changes: scans of data, and reads that stop working.

Scripts are taken as wholes, statement by statement (``operators.scripts``). Both ask once for each distinct check, or
state that a read sees, however many scripts come to it, and join the answers back to the scripts. The distinct ones come
to the driver: they are of the size of the catalogue and of what its reviewers write, not of the tables or the log.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from contextlib import suppress
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidegate.functions import exprs as X
from tidegate.operators import answers as AN
from tidegate.operators import corpus as C
from tidegate.operators import findings as FI
from tidegate.operators import footers as FO
from tidegate.operators import preflight as P
from tidegate.operators import replay as RE
from tidegate.operators import rules as R
from tidegate.operators import scripts as S
from tidegate.session import materialize

#: expressions of one scan; more are counted in further scans
AT_ONCE = 200
SCANNED = "script_id long, check string, kind string, violations long"
BROKEN = "script_id long, query_id string, services array<string>, is_view boolean"
DRIFT = "script_id long, query_id string, services array<string>, removed array<string>"
NARROWED = "script_id long, object string, severity string, offending_rows long"
BOUNDED = "script_id long, object string, bounded boolean"


@dataclass
class Evidence:
    """Measured facts about scripts, each None where nothing was measured."""

    data: DataFrame | None = None
    narrowed: DataFrame | None = None
    bounded: DataFrame | None = None
    broken: DataFrame | None = None
    drift: DataFrame | None = None
    unresolved: DataFrame | None = None
    #: checks that footers settled or narrowed down
    footed: int | None = None
    #: analyses that a replay took
    resolutions: int | None = None

    def __or__(self, other: Evidence) -> Evidence:
        return replace(self, **{k: v for k, v in vars(other).items() if v is not None})

    def findings(self, owners: DataFrame | None = None) -> list[DataFrame]:
        """Findings of all that was measured. ``owners`` (script_id, owner): breakage outside of the owner's service needs coordination."""
        pairs = ((self.data, R.data_failures), (self.narrowed, R.narrowing), (self.broken, R.broken_queries), (self.drift, R.star_drift))
        every = [rule(df) for df, rule in pairs if df is not None]
        if owners is not None and every:
            every.append(R.uncoordinated(FI.cross_service(reduce(DataFrame.unionByName, every), owners)))
        return every

    def gaps(self) -> list[DataFrame]:
        return [rule(df) for df, rule in ((self.bounded, R.bounded_scan), (self.unresolved, R.unresolved_relation)) if df is not None]


# ---- scans ---------------------------------------------------------------------------------------------------------
def declared(df: DataFrame, col: str) -> str:
    """The declared type of a column, in the words of change scripts."""
    names = {"string": "text", "double": "double precision", "float": "real", "int": "integer", "date": "date"}
    kind = dict(df.dtypes)[col]
    return names.get(kind, kind.replace("decimal", "numeric"))


class Scanned:
    """A table with the steps that scripts' statements make of its columns. A step that can't be analysed, another dialect's, is left out with all that rest on it."""

    def __init__(self, df: DataFrame, steps: dict[str, list]):
        self.df, left = df, dict(steps)
        RE.quiet()
        while left:
            # steps are named by what they are made of, so none rests on itself
            ready = {n: made for n, made in left.items() if not any(other in text for other in left for text in made[1:] if text)}
            left = {n: made for n, made in left.items() if n not in ready}
            good = {}
            for name, made in ready.items():
                with suppress(AnalysisException, KeyError):
                    one = F.expr(self._sql(*made))
                    self.df.select(one.alias(name)).schema  # analysed only
                    good[name] = one
            if good:
                self.df = self.df.withColumns(good)
        self.types, self.known = dict(self.df.dtypes), {}

    def _sql(self, kind: str, *texts: str | None) -> str:
        if kind == "set":
            where, value, ref = texts
            return f"CASE WHEN ({where}) THEN try_cast(({value}) AS {dict(self.df.dtypes)[ref]}) ELSE `{ref}` END"
        if kind == "left":
            return f"NOT coalesce(({texts[0]}), false)"
        return texts[0]

    def alive(self, spec: dict) -> Column:
        return reduce(Column.__and__, map(F.col, spec["alive"]), F.lit(True))

    def has(self, spec: dict) -> bool:
        return all(c in self.types for c in [*spec["refs"], *spec["alive"]])

    def breaks(self, kind: str, spec: dict) -> Column | None:
        """Whether a row, if it is alive, breaks a check, or takes part in a unique key; None where it can't be asked."""
        key = (kind, *spec["refs"], spec["text"])
        if not self.has(spec):
            return None
        if key not in self.known:
            self.known[key] = self._breaks(kind, spec)
        return self.known[key]

    def _breaks(self, kind: str, spec: dict) -> Column | None:
        if kind == "unique":
            return reduce(Column.__and__, (F.col(c).isNotNull() for c in spec["refs"]))
        if kind == "not_null":
            return F.col(spec["refs"][0]).isNull()
        if kind == "narrow":
            col, new = F.col(spec["refs"][0]), spec["text"]
            number = isinstance(self.df.schema[spec["refs"][0]].dataType, NumericType)
            return X.offends(col if number else col.cast("string"), new, not number) | P.outside(col, new, number)
        try:
            found = ~F.expr(spec["text"])
            self.df.agg(F.count_if(found)).schema  # analysed only: a predicate of another dialect isn't asked
            return found
        except AnalysisException:
            return None

    def together(self, seen: DataFrame, asked: list[tuple]) -> list[int]:
        """Rows that break each of ``asked`` (kind, name, spec), or that a unique key rejects: each column's state and each delete is asked once of a row, however many checks rest on it."""
        conditions, needs = {}, []
        for kind, _, spec in asked:
            own = json.dumps([kind, spec["refs"], spec["text"]])
            conditions |= {a: F.col(a) for a in spec["alive"]} | {own: self.breaks(kind, spec)}
            needs.append([*spec["alive"], own])
        counts = P.count_among(seen, conditions, needs, AT_ONCE) if asked else []
        keys = [i for i, (kind, *_) in enumerate(asked) if kind == "unique"]
        for i, n in zip(keys, P.distinct_among(seen, [(asked[i][2]["refs"], asked[i][2]["alive"]) for i in keys]), strict=True):
            counts[i] -= n
        return counts

    def apart(self, seen: DataFrame, asked: list[tuple]) -> list[tuple]:
        """As ``together`` for those of ``asked`` that no row makes fail, each with its number: every check by itself, so that rows which a script has deleted aren't asked."""
        counts = [x for x in asked if x[0] != "unique"]
        some = []
        for at in range(0, len(counts), AT_ONCE):
            some += _answers(counts[at : at + AT_ONCE], lambda part: seen.agg(*(F.count_if(self.alive(s) & self.breaks(k, s)).alias(f"c{i}") for i, (k, _, s) in enumerate(part))).first())
        keys = [(text, [F.when(self.alive(s), F.col(c)) for c in s["refs"]]) for k, text, s in asked if k == "unique"]
        rows = _answers(keys, lambda part: _in_order(part, P.rejected_by_keys(seen, dict(part))))
        return [((k, text), n) for (k, text, _), n in some] + [(("unique", text), n) for (text, _), n in rows]


#: what a row can make an expression fail with
FAILS = (ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, SparkRuntimeException)


def _answers(some: list, ask: Callable[[list], Sequence[int]]) -> list[tuple]:
    """(item, number) for each of ``some`` that ``ask`` can answer, all at once; where a row makes an expression fail (a division by zero, a cast), the halves are asked apart, so that only the failing ones are left out."""
    if not some:
        return []
    try:
        return list(zip(some, ask(some), strict=True))
    except FAILS:
        half = len(some) // 2
        return _answers(some[:half], ask) + _answers(some[half:], ask) if half else []


def _in_order(some: list[tuple], found: DataFrame) -> list[int]:
    told = {r["key"]: r["violations"] for r in found.collect()}  # a number for each key
    return [told[text] for text, _ in some]


def scan_tables(ops: DataFrame, tables: dict[str, DataFrame], samples: dict[str, str] | None = None, files: dict[str, str] | None = None) -> Evidence:
    """Data failures, narrowing and bounded scans of the scripts' checks, each on the rows as its script has left them by then.

    ``ops``: change events, or these in order (``scripts.ordered``).

    One scan of each table for most checks, whose cost follows the columns, updates and deletes that they rest on and not
    their number; one more, with one exchange, for all its unique keys; and one exchange for all foreign keys. ``samples`` (table to predicate): where given, only these rows are scanned, and a clean scan is
    bounded if the table has others. A clean scan after an INSERT is bounded too, since no scan saw the new rows, and so
    is a check that can't be asked (``scripts.row_checks``), or that a row makes fail: nothing was seen. ``files`` (table to the path of the
    Parquet files that it reads whole): where given, footers settle checks on rows as they are (``footed`` counts them),
    and integer ranges that they leave open are asked of the row groups in doubt only.
    """
    spark, samples, files, footed = ops.sparkSession, samples or {}, files or {}, 0
    wanted = materialize(S.row_checks(ops if "events" in ops.columns else S.ordered(ops), {t: dict(df.dtypes) for t, df in tables.items()}))
    asked = [(r["kind"], r["spec"], json.loads(r["spec"])) for r in wanted.where("spec is not null").select("kind", "spec").distinct().collect()]
    steps: dict[str, dict[str, list]] = {t: {} for t in tables}
    for _, _, spec in asked:
        for own in filter(None, (spec, spec["parent"])):
            steps[own["base"]] |= {name: made for name, *made in own["steps"]}
    used = {own["base"] for _, _, spec in asked for own in (spec, spec["parent"]) if own}
    scanned = {t: Scanned(tables[t], steps[t]) for t in used}
    narrow = [(spec_text, declared(scanned[s["base"]].df, s["refs"][0]), s["text"]) for k, spec_text, s in asked if k == "narrow" and scanned[s["base"]].has(s)]
    wide = _wider(spark, narrow)
    found, foreign = [], []
    for name in sorted(used):
        own = [x for x in asked if x[2]["base"] == name and not (x[0] == "narrow" and x[1] in wide)]
        table, sampled = scanned[name], name in samples
        seen = table.df.where(samples.get(name, "true"))
        partly = sampled and seen.count() < tables[name].count()
        plain = [(k, text, s) for k, text, s in own if k in ("not_null", "narrow") and not s["steps"] and name in files and not sampled]
        facts = FO.column_facts(spark, files[name], sorted({s["refs"][0] for *_, s in plain})) if plain else {}
        for k, text, s in plain:
            if (fact := facts.get(s["refs"][0])) is None:
                continue
            if k == "not_null":
                n = fact.nulls
            elif FO.fits(fact, s["text"]):
                n = 0
            elif fact.kind in FO.WHOLE and s["text"].strip().lower() in P.RANGES:
                n = FO.outside_rows(tables[name], s["refs"][0], s["text"]).first()[0]
            else:
                continue
            footed += 1
            own.remove((k, text, s))
            found.append((k, text, n, False))
        every = [(k, text, s) for k, text, s in own if k != "foreign" and table.breaks(k, s) is not None]
        try:
            rows = [((k, text), n) for (k, text, _), n in zip(every, table.together(seen, every), strict=True)]
        except FAILS:
            rows = table.apart(seen, every)
        found += [(k, text, n, partly) for (k, text), n in rows]
        foreign += [(text, s) for k, text, s in own if k == "foreign" and table.has(s) and scanned[s["parent"]["base"]].has(s["parent"])]
    side = lambda s: (scanned[s["base"]].df, [F.when(scanned[s["base"]].alive(s), F.col(c)) for c in s["refs"]], [scanned[s["base"]].types[c] for c in s["refs"]])
    rows = _answers([(text, (side(s), side(s["parent"]))) for text, s in foreign], lambda some: _in_order(some, P.orphans_by_keys(dict(some))))
    found += [("foreign", text, n, False) for (text, _), n in rows]
    found = spark.createDataFrame(found, "kind string, spec string, violations long, partly boolean")
    kept = wanted.join(spark.createDataFrame([(x,) for x in wide], "spec string").withColumn("kind", F.lit("narrow")), ["kind", "spec"], "left_anti")
    met = materialize(kept.join(found, ["kind", "spec"], "left").withColumn("part", F.col("violations").isNull() | F.col("part") | F.col("partly")))
    target = F.concat_ws(".", "tbl", F.when(F.col("kind") == "narrow", F.split("arg", ":")[0]).otherwise(F.col("arg")))
    named = met.withColumn("object", F.when(F.col("kind").isin("unique", "foreign"), F.concat(F.col("tbl"), F.lit("("), F.col("arg"), F.lit(")"))).otherwise(target))
    known, narrowed = named.where("violations is not null"), F.col("kind") == "narrow"
    return Evidence(
        data=known.where(~narrowed).select("script_id", F.col("object").alias("check"), "kind", "violations").distinct(),
        narrowed=known.where(narrowed).select("script_id", "object", P.narrowing_severity(F.col("violations")).alias("severity"), F.col("violations").alias("offending_rows")).distinct(),
        bounded=named.where((F.coalesce("violations", F.lit(0)) == 0) & F.col("part")).select("script_id", "object", F.lit(True).alias("bounded")).distinct(),
        footed=footed,
    )


def _wider(spark: SparkSession, changes: list[tuple[str, str, str]]) -> set[str]:
    """Those changes (name, old, new) whose new type holds every value of the old one."""
    df = spark.createDataFrame(changes, "name string, old string, new string")
    return {r["name"] for r in df.where(~X.is_narrowing(F.col("old"), F.col("new"))).collect()} if changes else set()


# ---- replay --------------------------------------------------------------------------------------------------------
def replay_changes(ops: DataFrame, log: DataFrame, tables: dict[str, DataFrame], views: dict[str, str] | None = None) -> Evidence:
    """Reads and views that stop working, or lose columns, when each script has run as a whole.

    Each read shape of ``log`` (query_id, service, criticality, sql) and each view is resolved before the change and on
    the shapes that a script leaves; no rows are read. Scripts that leave what a read can see alike share a resolution,
    so ``resolutions`` counts distinct states and not scripts. A broken view that the log reads is left to the reads
    that break with it. query_id is the least of a shape's; services are all that send it. Relations that a script
    changes and nobody knows are ``unresolved``.
    """
    spark, views = ops.sparkSession, views or {}
    catalogue = {t: dict(df.dtypes) for t, df in tables.items()} | views
    held = materialize(RE.read_shapes(log, F.min("query_id").cast("string").alias("least"), F.array_sort(F.collect_set("service")).alias("services")))
    shapes = [(str(r["query_id"]), r["sql"]) for r in held.collect()]  # what applications hold, not what they send
    reads = dict(RE.with_views(shapes, views))
    events = ops if "events" in ops.columns else materialize(S.ordered(ops))
    states, first = S.read_states(events, list(reads.items()), catalogue)
    states = materialize(states)
    asked = [tuple(r) for r in states.select("query_id", "state").distinct().collect()]
    told = RE.outcomes(spark, [(reads[i], first[i]) for i in reads] + [(reads[i], state) for i, state in asked])
    before, rows = dict(zip(reads, told, strict=False)), []
    for (ident, state), (error, columns) in zip(asked, told[len(reads) :], strict=True):
        was_error, was = before[ident]
        if was_error is None and (error or (gone := [c for c in was if c not in columns])):
            rows.append((ident, state, error is not None, [] if error else gone))
    hit = materialize(spark.createDataFrame(rows, "query_id string, state string, broken boolean, removed array<string>"))  # a list from the driver has no size, and the fleet's states would pass for the smaller side
    sent = held.select(F.col("least").alias("query_id"), "services")
    met = states.join(hit, ["query_id", "state"]).join(sent, "query_id", "left")
    met = met.select("script_id", "query_id", "broken", F.array_sort("removed").alias("removed"), F.coalesce("services", F.array(F.lit("database"))).alias("services"), F.col("query_id").startswith(RE.VIEW).alias("is_view"))
    words = C.forms(log).select(F.explode(X.identifiers(F.col("sql"))).alias("token")).distinct()
    named = [r["token"] for r in words.where(F.col("token").isin(*views)).collect()] if views else []
    met = met.where(~F.col("is_view") | ~F.col("query_id").isin(*[RE.VIEW + v for v in named])).withColumn("query_id", F.regexp_replace("query_id", f"^{RE.VIEW}", ""))
    met = materialize(met)
    return Evidence(
        broken=met.where("broken").select("script_id", "query_id", "services", "is_view"), drift=met.where("not broken and not is_view").select("script_id", "query_id", "services", "removed"),
        unresolved=S.unresolved(events, catalogue), resolutions=len(told),
    )


def measure(ops: DataFrame, log: DataFrame, tables: dict[str, DataFrame], views: dict[str, str] | None = None, samples: dict[str, str] | None = None, files: dict[str, str] | None = None) -> Evidence:
    """Everything that tables and log can say about the change events ``ops``, which are put in order once."""
    events = materialize(S.ordered(ops))
    return scan_tables(events, tables, samples, files) | replay_changes(events, log, tables, views)


# ---- rows of reads -------------------------------------------------------------------------------------------------
@dataclass
class Drift:
    """Reads whose number of rows a script changes; both tables are written."""

    #: (script_id, query_id, service, before, after)
    rows: DataFrame
    #: (script_id, shape) of reads that can't be counted: on rows that nobody knows, or no longer resolved
    uncounted: DataFrame
    #: (form, state) pairs that were counted
    counted: int


def _left_by(state: list, tables: dict[str, DataFrame], views: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, str]] | None:
    """Tables and views as a state leaves them; None where their rows can't be known."""
    tables, views = dict(tables), dict(views)
    first = dict(tables)
    for name, left in state:
        tables.pop(name, None)
        views.pop(name, None)  # what is made anew comes last
        if left is None:
            return None
        if "view" in left:
            views[name] = left["view"]
            continue
        made = Scanned(first[left["base"]], {n: m for n, *m in left["steps"]})
        if not made.has({"refs": [], "alive": left["alive"]}):
            return None
        tables[name] = made.df.where(made.alive(left)).select(*(F.col(ref).alias(c) for c, ref in left["columns"].items() if ref in made.types))
    return tables, views


def count_drift(ops: DataFrame, log: DataFrame, tables: dict[str, DataFrame], views: dict[str, str] | None = None) -> Drift:
    """Reads of ``log`` (query_id, service, sql) that give another number of rows once a script has run as a whole.

    Informational: no finding and no gap comes of it. A read counts with the literals that it was sent with; reads of one
    form are counted together where Catalyst can (``operators.answers``), and only those that reach, over views too,
    relations whose rows a script changes. Scripts that leave these alike share a count. Updates, defaults, deletes,
    renames and views are followed; reads that reach new tables, inserted rows or columns set from other tables are
    ``uncounted``.
    """
    spark, views = ops.sparkSession, views or {}
    catalogue = {t: dict(df.dtypes) for t, df in tables.items()} | views
    reads = materialize(AN.with_literals(log.select("query_id", "service", "sql")))
    forms = {str(i): f for i, f in enumerate(AN.forms(reads))}
    states = materialize(S.row_states(materialize(S.ordered(ops)), [(i, sql) for i, (_, _, sql) in forms.items()], catalogue))
    asked: dict[str, list[str]] = {}
    for r in states.select("query_id", "state").distinct().collect():
        asked.setdefault(r["state"], []).append(r["query_id"])
    world, before, some = AN.World(spark, tables, views), {}, {}
    for form in sorted({f for own in asked.values() for f in own}):
        shape, kinds, sql = forms[form]
        some[form] = materialize(AN.of_form(reads, shape, kinds))
        found = AN.count_reads(world, some[form], sql, kinds)
        if found is not None:
            before[form] = materialize(found)
    drift, lost, counted = [], [], 0
    for state, own in sorted(asked.items()):
        left, differ = _left_by(json.loads(state), tables, views), []
        after = AN.World(spark, *left) if left else None
        for form in sorted(set(own) & before.keys()):
            _, kinds, sql = forms[form]
            found = AN.count_reads(after, some[form], sql, kinds) if after else None
            if found is None:
                lost.append((form, state))
                continue
            counted += 1
            pair = before[form].withColumnRenamed("n", "before").join(found.withColumnRenamed("n", "after"), "lits")
            differ.append(pair.where("before <> after").select(F.lit(form).alias("form"), F.lit(state).alias("state"), "lits", "before", "after"))
        if differ:
            drift.append(materialize(reduce(DataFrame.unionByName, differ)))  # each state's plan by itself
    known = spark.createDataFrame([(f, s, list(k)) for f, (s, k, _) in forms.items()], "form string, shape string, kinds array<string>")
    by_script = states.withColumnRenamed("query_id", "form")
    every = reduce(DataFrame.unionByName, drift) if drift else spark.createDataFrame([], "form string, state string, lits array<string>, before long, after long")
    met = reads.join(known, AN.FORM).join(every, ["form", "lits"]).join(by_script, ["form", "state"])
    unknown = spark.createDataFrame(lost, "form string, state string").join(by_script, ["form", "state"]).join(known, "form")
    return Drift(materialize(met.select("script_id", "query_id", "service", "before", "after")), materialize(unknown.select("script_id", "shape").distinct()), counted)
