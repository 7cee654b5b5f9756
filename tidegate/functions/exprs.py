"""Column expressions over statements, types, severities and log text. All run in the JVM; none is a UDF.

Every function takes and gives Columns. A null input gives null unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import vocab as V

CLAUSE = r"where|join|on|order\s+by|group\s+by|having"


def _list(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs for x in p))


# ---- statements ----------------------------------------------------------------------------------------------------
def identifiers(sql: Column) -> Column:
    """Sorted distinct lower-case bare words: an over-approximation of what a statement names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(sql), F.lit(r"[a-z_][a-z_0-9]*"), F.lit(0))))


def norm_sql(sql: Column) -> Column:
    return F.trim(F.regexp_replace(sql, r"\s+", " "))


def ident(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), '^"+|"+$', ""))


def uses_select_star(sql: Column) -> Column:
    return sql.rlike(r"(?i)select\s+\*")


def filter_columns(sql: Column) -> Column:
    """Sorted words used to look up, join, sort or group: from a clause's keyword to the next clause, last dotted part, without SQL words."""
    parts = F.split(sql, rf"(?i)\b(?:{CLAUSE})\b")
    ends = lambda p: F.split(p, r"(?i)\b(?:limit|returning|union)\b")[0]
    words = F.flatten(F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: F.split(F.lower(ends(p)), r"[^a-z0-9_$.]+")))
    last = F.transform(words, lambda w: F.element_at(F.split(w, r"\."), -1))
    return F.array_sort(F.array_except(F.filter(last, lambda w: w.rlike("^[a-z_]")), _list(V.SQL_WORDS)))


def clause_excerpt(sql: Column, cols: Column) -> Column:
    """At most 120 characters from a clause's keyword through the first of ``cols`` found within 80, or the statement's head."""
    tidy = lambda s: F.substring(norm_sql(s), 1, 120)
    hits = F.transform(cols, lambda c: F.regexp_substr(sql, F.concat(F.lit(rf"(?is)\b(?:{CLAUSE})\b[^;]{{0,80}}?\b"), c, F.lit(r"\b"))))
    return F.coalesce(F.try_element_at(F.transform(F.filter(hits, lambda h: h.isNotNull()), tidy), F.lit(1)), tidy(sql))


def marks_apart(sql: Column) -> Column:
    """Lower-case words and marks of a statement, in order."""
    return F.regexp_extract_all(F.lower(sql), F.lit(r'[a-z0-9_$."]+|[^\sa-z0-9_$."]'), F.lit(0))


#: words that stand between a statement's head and what it names, and change neither
ASIDE = r"\b(?:if\s+(?:not\s+)?exists|or\s+replace|only)\b"


def statement_words(sql: Column) -> Column:
    """``marks_apart`` without the words that stand aside."""
    return marks_apart(F.regexp_replace(sql, "(?i)" + ASIDE, " "))


def _phrase(words: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _next(words: Column, word: str) -> Column:
    """What follows the first ``word``; null without one."""
    at = F.array_position(words, F.lit(word))
    return F.when(at > 0, F.get(words, at.cast("int")))


# what an ALTER TABLE's action begins with, once the table and a column's name are out of the way
_ACTIONS = {
    "add column": "add_column", "drop column": "drop_column", "rename to": "rename_table", "add check": "add_constraint", "add unique": "add_constraint", "add foreign": "add_constraint", "add primary": "add_constraint",
    "drop constraint": "drop_constraint", "validate constraint": "validate_constraint",
}
_COLUMN_ACTIONS = {"type": "alter_type", "set data": "alter_type", "set not": "set_not_null", "drop not": "drop_not_null", "set default": "set_default", "drop default": "drop_default"}
_HEADS = {
    "drop index": "drop_index", "drop view": "drop_view", "drop table": "drop_table", "create table": "create_table", "delete from": "dml_delete", "insert into": "dml_insert",
    "vacuum full": "maintenance_rewrite", "refresh materialized": "maintenance_rewrite", "start transaction": "transaction_control",
}
_FIRST = {"cluster": "maintenance_rewrite", "reindex": "maintenance_rewrite"} | dict.fromkeys(("begin", "commit", "rollback", "end", "set", "lock"), "transaction_control")
_CONSTRAINTS = ("check", "unique", "foreign", "primary")
KINDS = sorted({*_ACTIONS.values(), *_COLUMN_ACTIONS.values(), *_HEADS.values(), *_FIRST.values(), "rename_column", "unknown_alter_column", "unknown_alter", "create_index", "create_view", "dml_update", "procedural_block", "unsupported"})


def is_procedural(code: Column) -> Column:
    """Whether a statement runs a body: an anonymous block, or a function's or procedure's definition."""
    w = statement_words(code)
    return F.coalesce((F.get(w, F.lit(0)) == "do") | _phrase(w, 1, 2).isin("create function", "create procedure"), F.lit(False))


def statement_kind(sql: Column) -> Column:
    """One of 27 kinds. An ALTER TABLE is classed by its first action; split others off before."""
    w = statement_words(sql)
    word = lambda i: F.get(w, F.lit(i))
    action, table = _phrase(w, 4, 2), _phrase(w, 1, 2)
    on_column = F.coalesce(_map(_COLUMN_ACTIONS.items())[_phrase(w, 7, 2)], _map(_COLUMN_ACTIONS.items())[word(6)], F.lit("unknown_alter_column"))
    altered = (
        F.when(action == "alter column", on_column)
        .when((action == "rename column") & (word(6) == "to"), "rename_column")
        .when((action == "add constraint") & word(6).isin(*_CONSTRAINTS), "add_constraint")
        .otherwise(F.coalesce(_map(_ACTIONS.items())[action], F.lit("unknown_alter")))
    )
    index = F.filter(w, lambda x: ~x.isin("unique", "concurrently"))
    out = F.when((table == "alter table") & word(3).isNotNull(), altered).when((_phrase(index, 1, 2) == "create index") & (F.get(index, F.lit(3)) == "on") & F.array_contains(w, "("), "create_index")
    out = out.when((table == "create view") & (word(3) == "as"), "create_view").when((word(0) == "update") & ((word(2) == "set") | (word(3) == "set") | ((word(2) == "as") & (word(4) == "set"))), "dml_update").when(is_procedural(sql) & sql.contains("$"), "procedural_block")
    return out.when(sql.isNotNull(), F.coalesce(_map(_HEADS.items())[table], _map(_FIRST.items())[word(0)], F.lit("unsupported")))


def leading_keyword(sql: Column) -> Column:
    return F.lower(F.regexp_extract(sql, r"^\s*([A-Za-z]+)", 1))


def is_ddl_or_dml(sql: Column) -> Column:
    return leading_keyword(sql).isin(*V.DDL_OR_DML)


def _acts(sql: Column, verbs: dict[str, list[str]]) -> Column:
    """Whether one of ``verbs`` stands in ``sql`` before something that it acts on, as whole words."""
    spaced = lambda x: x.replace(" ", r"\s+")
    each = (verb + (rf"\s+(?:{'|'.join(map(spaced, objects))})" if objects else "") for verb, objects in verbs.items())
    return sql.rlike(rf"(?i)\b(?:{'|'.join(each)})\b")


def is_destructive(sql: Column) -> Column:
    return _acts(sql, V.DESTRUCTIVE_VERBS)


def changes_inside(text: Column) -> Column:
    """Whether a statement of a procedural body (literals blanked) changes schema, data or rights."""
    return _acts(text, V.BODY_VERBS) | text.rlike(r"(?i)\bupdate\s+\S+\s+set\b")


def assigned_columns(sql: Column) -> Column:
    """Columns that an UPDATE's SET assigns, in order."""
    body = F.split(F.get(F.split(sql, r"(?i)\bset\b", 2), F.lit(1)), r"(?i)\bwhere\b")[0]
    sides = F.filter(F.split(body, ","), lambda p: F.contains(p, F.lit("=")))
    named = F.transform(sides, lambda p: ident(F.split(p, "=")[0]))
    return F.coalesce(F.filter(named, lambda c: c.rlike(r"^[a-z_][\w$]*$")), F.when(sql.isNotNull(), F.array().cast("array<string>")))


def nulls_erased(sql: Column, cols: Column) -> Column:
    """Those of ``cols`` that the statement tests for null."""
    return F.filter(cols, lambda c: F.regexp_like(sql, F.concat(F.lit(r"(?i)\b"), c, F.lit(r"\s+is\s+null\b"))))


def relation_hint(sql: Column) -> Column:
    """First word after on, table, from, into, view or only that isn't a stop word; null if none. A word that follows one of these introduces no other."""
    w = F.filter(marks_apart(F.regexp_replace(sql, r"(?i)\bif\s+exists\b", " ")), lambda x: x != '"')
    w = F.transform(w, lambda x: F.split(F.regexp_replace(x, '"', ""), r"\.")[0])
    opens = lambda i: F.coalesce(F.get(w, i).isin("on", "table", "from", "into", "view", "only"), F.lit(False))
    after = F.filter(w, lambda x, i: (i > 0) & opens(i - 1) & ~((i > 1) & opens(i - 2)) & x.rlike("^[a-z_]") & ~x.isin(*V.HINT_WORDS))
    return F.get(after, F.lit(0))


def is_concurrent(sql: Column) -> Column:
    return sql.rlike(r"(?i)\bindex\s+concurrently\b")


def is_batched(sql: Column) -> Column:
    """Whether a statement bounds the rows it takes: by a limit, a row address, a range of ids or a subquery."""
    text = F.concat(F.lit(" "), F.array_join(marks_apart(sql), " "), F.lit(" "))
    key = F.regexp_replace(text, r"[a-z0-9_$\"]+\.", "")
    return F.contains(text, F.lit(" limit ")) | F.contains(key, F.lit(" ctid ")) | F.contains(key, F.lit(" id > ")) | F.contains(key, F.lit(" id between ")) | F.contains(text, F.lit(" in ( select "))


def bucket(kind: Column) -> Column:
    found = _map((k, b) for b, kinds in V.BUCKETS.items() for k in kinds)
    return F.coalesce(found[kind], F.lit("UNCLASSIFIED"))


# ---- types ---------------------------------------------------------------------------------------------------------
def type_root(t: Column) -> Column:
    return F.lower(F.trim(F.split(t, r"\(")[0]))


def _type_arg(t: Column, n: int) -> Column:
    inner = F.regexp_extract(t, r"\((.*)\)", 1)
    arg = F.trim(F.try_element_at(F.split(inner, ","), F.lit(n)))
    return F.when(arg.rlike("^[0-9]+$"), arg.try_cast("int"))


def type_len(t: Column) -> Column:
    return _type_arg(t, 1)


def numeric_limit(t: Column) -> Column:
    """The first magnitude that numeric(p, s) can't hold; null for other types."""
    p, s = _type_arg(t, 1), F.coalesce(_type_arg(t, 2), F.lit(0))
    return F.when(type_root(t).isin("numeric", "decimal") & p.isNotNull(), F.pow(F.lit(10.0), F.greatest(F.lit(0), p - s)))


def is_narrowing(old: Column, new: Column) -> Column:
    pair = F.concat_ws(">", type_root(old), type_root(new)).isin(*(f"{a}>{b}" for a, b in V.NARROWING))
    return pair | F.coalesce(type_len(new).isNotNull() & (type_len(old).isNull() | (type_len(new) < type_len(old))), F.lit(False))


def offends(value: Column, new: str, is_text: bool) -> Column:
    """Whether a value won't fit type ``new``: too large, else too long, else fractional for an integer. Null never offends."""
    t = F.lit(new)
    if is_text:
        bad = numeric_limit(t).isNull() & (F.length(value) > type_len(t))
    else:
        v = value.cast("double")
        bad = F.when(numeric_limit(t).isNotNull() & (F.abs(v) >= numeric_limit(t)), True).otherwise(type_root(t).isin("integer", "int", "bigint", "smallint") & (v != F.floor(v)))
    return F.coalesce(bad, F.lit(False))


def spark_type(t: Column) -> Column:
    """Spark's name for a declared type; an unknown one is a string."""
    plain = _map((name, k) for k, names in V.TYPES.items() for name in names.split())
    wide = _map(V.WIDE_TYPES.items())
    return F.when(t.rlike(r"\[\]\s*$"), "array<string>").otherwise(F.coalesce(wide[type_root(t)], plain[type_root(t)], F.lit("string")))


# ---- severities and sizes ------------------------------------------------------------------------------------------
def size_class(rows: Column) -> Column:
    return F.when(rows >= 5_000_000, "very large").when(rows >= 100_000, "large").when(rows >= 10_000, "medium").otherwise("small")


def severity_rank(severity: Column) -> Column:
    """1 (low) to 4 (blocker); 0 for anything else."""
    return F.coalesce(F.array_position(_list(V.SEVERITIES), severity), F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.try_element_at(_list(V.SEVERITIES), rank.cast("int"))


def bump(severity: Column, steps: Column) -> Column:
    return severity_name(F.least(F.lit(4), severity_rank(severity) + F.greatest(F.lit(0), steps)))


def weight(criticality: Column) -> Column:
    return F.coalesce(_map(V.CRITICALITY.items())[criticality], F.lit(2))


def family(code: Column) -> Column:
    return F.coalesce(_map((c, f) for f, codes in V.FAMILIES.items() for c in codes)[code], code)


# ---- model calls and reviews ---------------------------------------------------------------------------------------
def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def price(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    return F.coalesce((tokens_in * rate_in + tokens_out * rate_out) / 1e6, F.lit(0.0))


def prompt_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def reviewer_minutes(unevidenced: Column, verified: Column, gates: Column, blocking: Column, findings: Column, read=None, verify=None, plan=None, gate=None) -> Column:
    c = {k: F.lit(v) for k, v in V.MINUTES.items()} | {k: v for k, v in (("read", read), ("verify", verify), ("plan", plan), ("gate", gate)) if v is not None}
    return c["read"] + unevidenced * c["verify"] + F.when(verified, gates * c["gate"]).when(blocking | (findings > 0), c["plan"]).otherwise(F.lit(0))


# ---- guarded text --------------------------------------------------------------------------------------------------
def sanitise(text: Column, limit: int = V.MAX_SENTENCE) -> Column:
    """One printable line of at most ``limit`` characters; null gives the empty text."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), V.CONTROL, " "), r"\s+", " ")), 1, limit)


def guard_reasons(text: Column, verdict: Column) -> Column:
    """Sorted reasons why a sentence must not stand above a verdict; empty means it may."""
    s = sanitise(text, 1_000_000)
    other = F.exists(_list(V.VERDICTS), lambda v: (v != verdict) & F.regexp_like(s, F.concat(F.lit(r"\b"), v, F.lit(r"\b"))))
    found = F.array(
        F.when(F.length(s) > V.MAX_SENTENCE, "too long"), F.when(s.rlike(V.INJECTION), "injection"), F.when(other, "names another verdict"),
        F.when((verdict != "SAFE") & s.rlike(V.CLEAN_CLAIM), "claims clean"), F.when((verdict == "SAFE_WITH_PLAN") & s.rlike(V.AS_WRITTEN), "claims as written"),
    )
    return F.when(s == "", F.array(F.lit("empty"))).otherwise(F.array_sort(F.array_compact(found)))


def headline(verdict: Column, blockers: Column, highs: Column, gaps: Column, broken: Column) -> Column:
    """A sentence made of counts alone."""
    head = F.when(verdict == "BLOCK", "Do not ship this as written.").when(verdict == "SAFE_WITH_PLAN", "Shippable, but only as the staged plan below.").when(verdict == "SAFE", "No blocking hazards found.").otherwise(F.concat(F.lit("Verdict: "), verdict, F.lit(".")))
    say = lambda n, tail: F.when(n > 0, F.concat(n.cast("string"), F.lit(tail)))
    return F.concat_ws(" ", head, say(gaps, " coverage gap(s) need a named sign-off."), say(broken, " statement(s) fail after the change."), F.concat(blockers.cast("string"), F.lit(" blocker, "), highs.cast("string"), F.lit(" high.")))


def choose_headline(mode: Column, text: Column, verdict: Column, line: Column) -> Column:
    """Struct (source, headline, note): whose sentence stands on top in mode off, pattern or structural, and where the model's goes."""
    bad = F.size(guard_reasons(text, verdict)) > 0
    model = (mode == "off") | ((mode == "pattern") & ~bad)
    said = F.when(mode == "off", F.coalesce(text, F.lit(""))).otherwise(sanitise(text))
    return F.struct(F.when(model, "model").otherwise("tool").alias("source"), F.when(model, said).otherwise(line).alias("headline"), F.when((mode == "structural") & ~bad, sanitise(text)).otherwise("").alias("note"))


# ---- logs ----------------------------------------------------------------------------------------------------------
def _clock_row(text: Column) -> Column:
    _, head, to = V.CLOCK_ROW
    found = lambda x: F.regexp_extract(x, head, 0)
    line = lambda x: F.when(x.rlike(head), F.concat(found(x), F.regexp_replace(F.substr(x, F.length(found(x)) + 1), "[0-9.]+", to))).otherwise(x)
    return F.when(text.rlike("(?m)" + head), F.array_join(F.transform(F.split(text, "\n"), line), "\n")).otherwise(text)


def blur_clock(text: Column) -> Column:
    for _, pattern, to in V.CLOCK:
        text = F.regexp_replace(text, pattern, to)
    return _clock_row(text)


def clock_fields(text: Column) -> Column:
    """Names of the wall-clock fields that are masked, in order; each is looked for after those before it are masked."""
    found = []
    for name, pattern, to in V.CLOCK:
        found.append(F.when(text.rlike(pattern), name))
        text = F.regexp_replace(text, pattern, to)
    return F.array_compact(F.array(*found, F.when(text.rlike("(?m)" + V.CLOCK_ROW[1]), V.CLOCK_ROW[0])))


def secret_hits(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line, label) for every line that has the shape of a secret. Lines count from 1."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line", "_s"))
    labels = F.array_compact(F.array(*(F.when(F.col("_s").rlike(p), name) for name, p in V.SECRETS)))
    return lines.select(*keys, (F.col("line") + 1).alias("line"), F.explode(labels).alias("label"))


def truncate_payload(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
