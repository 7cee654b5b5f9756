"""What change scripts do as wholes: the shapes they leave, and what each of their checks asks of the rows at its place.

A script's events are one row, in order; scripts are dealt over tasks, and each is folded over the catalogue by a small
loop. What comes out is keyed by content and not by script: a read with the part of a script's last shapes that it can
see (``read_states``), or with the rows that it leaves there (``row_states``), and a check with the updates and deletes
before it that it depends on (``row_checks``). Scripts that begin alike, or differ in what a read or a check can't see, so
share one row of either kind.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import ship

EVENT = ["idx", "part", "kind", "sql", "tbl", "col", "new_name", "new_type", "columns"]
STATES = "script_id long, query_id string, state string"
CHECKS = "script_id long, tbl string, kind string, arg string, spec string, part boolean"
#: characters of an event that is kept once it has been read
KEPT = 1000
UNRESOLVED = "script_id long, seq long, object string"
#: lexical items in which no name is replaced, and words with what qualifies them
TOKEN = re.compile(r"""('(?:[^']|'')*')|(")?([A-Za-z_][\w$]*)(?(2)")(\s*\()?|(\d[\w.]*)|.""", re.S)
#: kinds of table constraints, by the words that a line of CREATE TABLE may begin with instead of a column's name
LINES = ("constraint", "primary", "unique", "foreign", "check", "exclude", "like")


def words_of(sql: str) -> set[str]:
    return set(re.findall("[a-z_][a-z_0-9]*", sql.lower()))


def split_top(text: str, at: str = ",") -> list[str]:
    """``text`` cut at a mark that stands outside of brackets and quotes."""
    out, depth, now = [], 0, ""
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|.", text, re.S):
        depth += (m[0] in "([") - (m[0] in ")]")
        if m[0] == at and depth <= 0:
            out.append(now)
            now = ""
        else:
            now += m[0]
    return [*out, now]


def ordered(ops: DataFrame) -> DataFrame:
    """(script_id, events): the change events of each script in order, as JSON. ``part`` orders the events of one statement.

    Rows are dealt by script first: a list gathered before the exchange saves nothing, and takes the memory of all that
    its task reads.
    """
    o = ops if "part" in ops.columns else ops.withColumn("part", F.lit(0))
    one = F.struct(F.col("idx").cast("long").alias("idx"), F.col("part").cast("int").alias("part"), F.to_json(F.struct(*EVENT[2:])).alias("event"))
    return o.select("script_id", one.alias("_e")).repartition("script_id").groupBy("script_id").agg(F.array_sort(F.collect_list("_e")).alias("events"))


class Names:
    """Names of the catalogue. A schema's name before a known one is passed over."""

    def __init__(self, known):
        self.known = set(known)

    def bare(self, name: str | None, now) -> str | None:
        if name is None or name in now:
            return name
        last = name.rsplit(".", 1)[-1]
        return last if last in now or last in self.known else name


@lru_cache(1 << 14)
def _event(text: str) -> dict:
    return dict.fromkeys(EVENT) | json.loads(text)


def _map_events(events: DataFrame, each, schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows that ``each`` gives for a script's id and events. Events that a task has met before, in whatever script, aren't read again."""
    ship(events.sparkSession)

    def run(batches):
        for t in batches:
            columns = (t.column(k).to_pylist() for k in range(3))
            rows = [r for i, places, texts in zip(*columns, strict=True) for r in each(i, [{**(_event if len(e) <= KEPT else _event.__wrapped__)(e), "idx": p} for p, e in zip(places, texts, strict=True)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return events.select(F.col("script_id").cast("long"), F.col("events.idx"), F.col("events.event")).mapInArrow(run, schema)


# ---- shapes --------------------------------------------------------------------------------------------------------
def declared_columns(sql: str) -> dict[str, str] | None:
    """Names of a CREATE TABLE's columns, all of type string here; None where the text has no list of them."""
    m = re.search(r"\((.*)\)", sql, re.S)
    if not m or re.search(r"(?i)\bas\s+(select|with)\b", sql[: m.start()]):
        return None
    heads = [x.split()[0].strip('"').lower() for x in split_top(m[1]) if x.split()]
    return {h: "string" for h in heads if h not in LINES}


def view_text(sql: str) -> str | None:
    m = re.match(r'(?is)\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+(?:if\s+not\s+exists\s+)?\S+\s+as\s+(.*)$', sql)
    return m[1].rstrip().rstrip(";") if m else None


def shapes_after(events: list[dict], before: dict, names: Names) -> tuple[dict, list[tuple[int, str]]]:
    """The catalogue after a script, and (index, name) of relations that an event names and that aren't there by then.

    A shape is a dict of columns (name to type), or a view's text. CREATE TABLE of a name that is there puts a new
    table in its place, unless it says IF NOT EXISTS; a table of unknown columns has none.
    """
    now, lost = dict(before), []
    for e in events:
        kind, sql = e["kind"], e["sql"]
        tbl, new = names.bare(e["tbl"], now), names.bare(e["new_name"], now)
        maybe = re.search(r"(?i)\bif\s+exists\b", sql)
        if kind == "create_table":
            if tbl and not (tbl in now and re.search(r"(?i)\bif\s+not\s+exists\b", sql)):
                columns = declared_columns(sql)
                now[tbl] = columns or {}
                if columns is None:
                    lost.append((e["idx"], tbl))
            continue
        if kind == "create_view":
            text = view_text(sql)
            if new and text:
                now[new] = text
            continue
        if kind == "drop_view":
            if now.pop(new, None) is None and new and not maybe:
                lost.append((e["idx"], new))
            continue
        if tbl is None:
            continue
        shape = now.get(tbl)
        if shape is None:
            if not maybe:
                lost.append((e["idx"], tbl))
        elif kind == "drop_table":
            del now[tbl]
        elif kind == "rename_table":
            now[e["new_name"].rsplit(".", 1)[-1]] = now.pop(tbl)
        elif isinstance(shape, dict) and e["col"]:
            if kind == "add_column":
                now[tbl] = {e["col"]: "string"} | shape
            elif kind == "drop_column":
                now[tbl] = {c: t for c, t in shape.items() if c != e["col"]}
            elif kind == "rename_column":
                now[tbl] = {(e["new_name"] if c == e["col"] else c): t for c, t in shape.items()}
    return now, lost


def _reach(words: set[str], shapes: dict, seen: dict[str, set[str]]) -> tuple[list[str], set[str]]:
    """Relations that ``words`` name, over views too, each after those it reads; and all words of these texts."""
    out, every = [], set(words)

    def visit(name, path):
        if name in out or name in path:
            return
        if isinstance(shapes[name], str):
            own = seen.setdefault(shapes[name], words_of(shapes[name]))
            every.update(own)
            for other in sorted(own & shapes.keys()):
                visit(other, path | {name})
        out.append(name)

    for name in sorted(words & shapes.keys()):
        visit(name, frozenset())
    return out, every


#: counting rows doesn't depend on what columns there are
STAR = re.compile(r"(?i)\bcount\s*\(\s*\*\s*\)")


def visible(sql: str, shapes: dict, usual: set[str], seen: dict[str, set[str]]) -> str:
    """The part of ``shapes`` that a read can see: the relations it reaches, views with their texts, tables with the columns that its texts name.

    Where a text takes all columns, those of ``usual`` (the catalogue's) stay too: columns that a script adds change a
    read only if it names them.
    """
    names, words = _reach(seen.setdefault(sql, words_of(sql)), shapes, seen)
    texts = [sql, *(shapes[n] for n in names if isinstance(shapes[n], str))]
    whole = usual if any("*" in STAR.sub("", t) for t in texts) or "natural" in words else set()
    keep = lambda c: c.lower() in words or c in whole
    return json.dumps([[n, s if isinstance(s, str) else [[c, t] for c, t in s.items() if keep(c)]] for n in names for s in [shapes[n]]])


def read_states(events: DataFrame, reads: list[tuple[str, str]], catalogue: dict) -> tuple[DataFrame, dict[str, str]]:
    """(script_id, query_id, state) of each read (id, sql) that a script's last shapes change in what it sees, and each read's state before.

    ``catalogue``: shapes by name. Both it and ``reads`` are of the size of what applications hold, and go to every task.
    """
    usual, seen = {c for s in catalogue.values() if isinstance(s, dict) for c in s}, {}
    first = {i: visible(sql, catalogue, usual, seen) for i, sql in reads}
    readers: dict[str, list[int]] = {}
    for k, (_, sql) in enumerate(reads):
        for name in _reach(words_of(sql), catalogue, seen)[0]:
            readers.setdefault(name, []).append(k)
    names = Names(catalogue)
    arrow = pa.schema([("script_id", pa.int64()), ("query_id", pa.string()), ("state", pa.string())])

    def each(script, rows):
        after, _ = shapes_after(rows, catalogue, names)
        changed = {n for n in catalogue if after.get(n) != catalogue[n]}
        memo: dict[str, set[str]] = {}
        for k in sorted({k for n in changed for k in readers.get(n, ())}):
            ident, sql = reads[k]
            state = visible(sql, after, usual, memo)
            if state != first[ident]:
                yield script, ident, state

    return _map_events(events, each, STATES, arrow), first


def unresolved(events: DataFrame, catalogue: dict) -> DataFrame:
    """(script_id, seq, object): relations that a script changes and that neither the catalogue nor the script knows by then."""
    names = Names(catalogue)
    arrow = pa.schema([("script_id", pa.int64()), ("seq", pa.int64()), ("object", pa.string())])
    return _map_events(events, lambda script, rows: ((script, i, n) for i, n in shapes_after(rows, catalogue, names)[1]), UNRESOLVED, arrow)


# ---- rows ----------------------------------------------------------------------------------------------------------
@dataclass
class Rows:
    """A table's rows at one place in a script: where each column's value is found, and which rows are left."""

    base: str
    #: the base's columns, some of which may have gone
    columns: set[str]
    #: column to a column of the base or a step; None where it can't be known
    at: dict[str, str | None]
    #: step to how it is made: (kind, texts, steps and columns that it reads)
    steps: dict[str, list] = field(default_factory=dict)
    #: steps that are all true for rows not deleted, in order of their names: deletes that come in another order, or again, leave the same
    alive: list[str] = field(default_factory=list)
    #: why no check can be asked any more
    lost: bool = False
    #: rows were inserted that no scan sees
    grown: bool = False

    def step(self, *made) -> str:
        name = "_" + sha1(json.dumps(made).encode()).hexdigest()[:16]
        self.steps[name] = list(made)
        return name

    def text(self, sql: str, *names: str) -> str | None:
        """An expression with this table's columns, alone or after one of its ``names``, replaced by where they are found; None if one is unknown or missing, or the text asks other tables."""
        out, known = [], True
        cleaned = re.sub(r"(?i)(?<![\w.$\"])(?:" + "|".join(map(re.escape, (self.base, *names))) + r")\.", "", sql)
        for m in TOKEN.finditer(cleaned):
            name = (m[3] or "").lower()
            if not m[3] or (m[4] and name not in self.at):
                out.append(m[0])
            elif name in self.at:
                known &= self.at[name] is not None
                out.append(f"`{self.at[name]}`" + (m[4] or ""))
            elif name in self.columns or name == "select":
                return None
            else:
                out.append(m[0])
        return "".join(out) if known else None


def _where(sql: str) -> tuple[str, str | None]:
    """A statement before its WHERE, and the predicate."""
    parts = re.split(r"(?i)\bwhere\b", sql, maxsplit=1)
    return parts[0], re.split(r"(?i)\breturning\b", parts[1])[0].strip().rstrip(";") if len(parts) > 1 else None


def _update(r: Rows, e: dict) -> None:
    head, predicate = _where(e["sql"])
    names = re.search(r"(?i)\bupdate\s+(?:only\s+)?(\S+)\s+(?:as\s+)?(\w+)\s+set\b", head)
    names = [e["tbl"], *(names.groups() if names else ())]
    body = re.split(r"(?i)\bset\b", head, maxsplit=1)[-1]
    foreign = re.search(r"(?i)\bfrom\b", body)
    where = "true" if predicate is None else r.text(predicate, *names)
    new = {}
    for part in split_top(body):
        col, _, value = part.partition("=")
        col = col.strip().strip('"').lower()
        if col in r.at:
            value = r.text(value.strip().rstrip(";"), *names)
            ref = r.at[col]
            if foreign or where is None or value is None or ref is None:
                new[col] = None
            elif not _again(r, ref, where, value):
                new[col] = r.step("set", where, value, ref)
    r.at.update(new)


def _without(r: Rows, predicate: str) -> list[str]:
    """The rows that are left without those of a predicate."""
    return sorted({*r.alive, r.step("left", predicate)})


def _again(r: Rows, ref: str, where: str, value: str) -> bool:
    """Whether an update is the one that made ``ref``, once more: with a constant value, and all else that it reads unchanged, it changes nothing."""
    kind, *made = r.steps.get(ref, [None])
    if kind != "set" or "(" in value + where or "`" in value:
        return False
    return made[:2] == [where.replace(f"`{ref}`", f"`{made[2]}`"), value]


def _delete(r: Rows, e: dict) -> None:
    head, predicate = _where(e["sql"])
    where = "true" if predicate is None else r.text(predicate, e["tbl"], *re.findall(r"(?i)\bfrom\s+(?:only\s+)?\S+\s+(?:as\s+)?(\w+)\s*$", head))
    if where is None or re.search(r"(?i)\busing\b", head):
        r.lost = True
    else:
        r.alive = _without(r, where)


#: kinds of events that can demand something of the rows
DEMANDING = ("set_not_null", "alter_type", "create_index", "add_constraint")


def _demands(e: dict) -> list[tuple[str, str, list[str], str]]:
    """(kind, label, columns, text) of what an event demands of the rows: not_null, unique, check, narrow or foreign."""
    kind, sql, columns = e["kind"], e["sql"], e["columns"] or []
    if kind == "set_not_null":
        return [("not_null", e["col"], [e["col"]], "")]
    if kind == "alter_type" and e["new_type"]:
        return [("narrow", f"{e['col']}:{e['new_type']}", [e["col"]], e["new_type"])]
    if kind not in ("create_index", "add_constraint") or (kind == "add_constraint" and re.search(r"(?i)not\s+valid", sql)):
        return []
    if kind == "add_constraint" and (m := re.search(r"(?is)\bforeign\s+key\s*\([^)]*\)\s*references\s+\"?([\w$.]+)\"?\s*(?:\(([^)]*)\))?", sql)):
        there = [c.strip().strip('"').lower() for c in (m[2] or "").split(",") if c.strip()]
        return [("foreign", f"{','.join(columns)}>{m[1].lower()}({','.join(there)})", columns, json.dumps([m[1].lower(), there]))]
    primary = kind == "add_constraint" and re.search(r"(?i)\bprimary\s+key\b", sql)
    if columns and (primary or re.search(r"(?i)\bunique\b", sql)):
        out = [("unique", ",".join(columns), columns, "")]
        return out + [("not_null", c, [c], "") for c in columns] if primary else out
    if kind == "add_constraint" and (m := re.search(r"(?is)\bcheck\s*\((.*)\)", sql)):
        return [("check", m[1].strip(), [], m[1].strip())]
    return []


def _needed(r: Rows, *ends: str | None) -> list:
    """The steps that ``ends`` rest on, in order of their names: what rests on the same steps has the same text."""
    need, queue = set(), [e for e in ends if e]
    while queue:
        text = queue.pop()
        for name in r.steps:
            if name not in need and name in text:
                need.add(name)
                queue += [x for x in r.steps[name][1:] if x]
    return [[n, *r.steps[n]] for n in sorted(need)]


def _tables_at_first(catalogue: dict) -> dict[str, Rows]:
    return {t: Rows(t, {c.lower() for c in s}, {c.lower(): c for c in s}) for t, s in catalogue.items() if isinstance(s, dict)}


def _afresh(first: dict[str, Rows]) -> dict[str, Rows]:
    """The tables before a script, for it to change."""
    return {t: Rows(t, r.columns, dict(r.at)) for t, r in first.items()}


def _walk(events: list[dict], now: dict[str, Rows], names: Names):
    """(event, table's name, new) of each event, before ``now`` takes it in. new: the script has made the table itself, so it has no rows."""
    made: set[str] = set()
    for e in events:
        kind, tbl = e["kind"], names.bare(e["tbl"], now)
        if kind == "create_table" and tbl and not (tbl in now and re.search(r"(?i)\bif\s+not\s+exists\b", e["sql"])):
            now.pop(tbl, None)
            made.add(tbl)
        r = now.get(tbl)
        yield e, tbl, tbl in made and r is None
        if r is None:
            continue
        if kind == "dml_update":
            _update(r, e)
        elif kind == "dml_delete":
            _delete(r, e)
        elif kind == "dml_insert":
            r.grown = True
        elif kind == "drop_table":
            del now[tbl]
        elif kind == "rename_table":
            now[e["new_name"].rsplit(".", 1)[-1]] = now.pop(tbl)
        elif kind == "drop_column":
            r.at.pop(e["col"], None)
        elif kind == "rename_column" and e["col"] in r.at:
            r.at[e["new_name"]] = r.at.pop(e["col"])
        elif kind == "add_column" and e["col"] not in r.at:
            m = re.search(r"(?is)\bdefault\s+(.+?)\s*(?:\b(?:not\s+null|unique|check|references|primary\s+key)\b.*)?$", e["sql"])
            value = r.text(m[1]) if m else "CAST(NULL AS STRING)"
            r.at[e["col"]] = None if value is None else r.step("new", value)


def checks_of(script: int, events: list[dict], first: dict[str, Rows], names: Names):
    """(script_id, tbl, kind, arg, spec, part) of each demand of a script. spec: JSON of table, steps, live rows and columns; null where it can't be asked."""
    now = _afresh(first)
    last = max((i for i, e in enumerate(events) if e["kind"] in DEMANDING), default=-1)  # what comes after is of no account
    for e, tbl, new in _walk(events[: last + 1], now, names):
        r = now.get(tbl)
        for want, label, columns, text in _demands(e):
            if new:
                continue
            spec = None
            if r is not None and not r.lost:
                refs = [r.at.get(c) for c in columns]
                body = r.text(text) if want == "check" else text
                other = None
                if want == "foreign":
                    parent, there = json.loads(text)
                    p = now.get(names.bare(parent, now))
                    at = [p.at.get(c) for c in there] if p and not p.lost else [None]
                    other = None if None in at or len(at) != len(columns) else {"base": p.base, "steps": _needed(p, *at, *p.alive), "alive": p.alive, "refs": at}
                alive, predicate = r.alive, _where(e["sql"])[1] if e["kind"] == "create_index" else None
                if predicate is not None:  # an index on some rows only
                    only = r.text(predicate)
                    body, alive = (None, None) if only is None else (body, _without(r, f"NOT coalesce(({only}), false)"))
                if None not in refs and body is not None and (want != "foreign" or other):
                    spec = json.dumps({"base": r.base, "steps": _needed(r, *refs, body, *alive), "alive": alive, "refs": refs, "text": body if want in ("check", "narrow") else "", "parent": other})
            yield script, tbl or e["tbl"], want, label, spec, bool(r and r.grown)


def _left(r: Rows | None, name: str) -> dict | None | bool:
    """What a script leaves of a table's rows: true if nothing that a read could count changed, null if they can't be known, or steps, live rows and columns."""
    if r is None or r.lost or r.grown:
        return None
    if r.base == name and not r.alive and all(ref == c or c not in r.columns for c, ref in ((c.lower(), ref and ref.lower()) for c, ref in r.at.items())):
        return True
    known = {c: ref for c, ref in r.at.items() if ref is not None}
    return {"base": r.base, "steps": _needed(r, *known.values(), *r.alive), "alive": r.alive, "columns": known}


def row_states(events: DataFrame, reads: list[tuple[str, str]], catalogue: dict) -> DataFrame:
    """(script_id, query_id, state) of each read (id, sql) that reaches relations, over views too, whose rows a script changes.

    state, as JSON: these relations in the order in which they can be made, each a name with a view's text, or with what
    is left of a table's rows; null where that can't be known (a new table, inserted rows, a statement that reads other
    tables). Scripts that leave what a read reaches alike share a state. A relation that is gone is in none: its reads
    break.
    """
    names, first, arrow = Names(catalogue), _tables_at_first(catalogue), pa.schema([("script_id", pa.int64()), ("query_id", pa.string()), ("state", pa.string())])

    def each(script, rows):
        now, (after, _) = _afresh(first), shapes_after(rows, catalogue, names)
        for _ in _walk(rows, now, names):
            pass
        left = {n: (s != catalogue.get(n) and {"view": s}) or True if isinstance(s, str) else _left(now.get(n), n) for n, s in after.items()}
        changed, seen = {n for n, x in left.items() if x is not True}, {}
        for ident, sql in reads if changed else ():
            reached = _reach(seen.setdefault(sql, words_of(sql)), after, seen)[0]
            if state := [[n, left[n]] for n in reached if n in changed]:
                yield script, ident, json.dumps(state)

    return _map_events(events, each, STATES, arrow)


def row_checks(events: DataFrame, catalogue: dict) -> DataFrame:
    """(script_id, tbl, kind, arg, spec, part), distinct: what each change event demands of the rows as its script has left them by then.

    kind: not_null (arg: the column), unique (columns joined by a comma), check (the predicate), narrow (column and new
    type, divided by a colon) or foreign (columns, `>`, parent). A primary key is unique and not null. spec, as JSON,
    has the table, the steps that updates, defaults and deletes before the check make of its columns, and where the
    columns are found; null where the check can't be asked: no such table or column by then, or a statement before it
    that reads other tables. part: rows were inserted before, which no scan sees.
    """
    names, first = Names(catalogue), _tables_at_first(catalogue)
    arrow = pa.schema([("script_id", pa.int64()), ("tbl", pa.string()), ("kind", pa.string()), ("arg", pa.string()), ("spec", pa.string()), ("part", pa.bool_())])
    return _map_events(events, lambda script, rows: checks_of(script, rows, first, names), CHECKS, arrow).where("tbl is not null").distinct()
