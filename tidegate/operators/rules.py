"""Change-event rules and coverage-gap rules: filters and joins that give findings and gaps.

An op is a row (script_id, idx, kind, tbl, col, new_name, sql, index_name, columns). Table sizes (tbl, rows) are one
row a table. Findings have FINDING's columns; seq is the statement's index, rules that look at whole scripts use -1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.functions import vocab as V
from tidegate.operators.findings import first_gap
from tidegate.session import by_key

LARGE, MEDIUM, HUGE = 100_000, 10_000, 5_000_000


def _none() -> Column:
    return F.array().cast("array<string>")


def finding(df: DataFrame, code: Column | str, severity: Column | str, objects: Column, services: Column | None = None, evidence: Column | None = None, source: str = "static") -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("script_id", F.col("idx").cast("long").alias("seq"), (F.lit(code) if isinstance(code, str) else code).alias("code"), sev.alias("severity"), F.array_compact(objects).alias("objects"), (services if services is not None else _none()).alias("services"), (evidence if evidence is not None else F.array(F.substring(X.norm_sql(F.col("sql")), 1, 120))).alias("evidence"), F.lit(source).alias("source"))


def _object() -> Column:
    return F.array(F.when(F.col("col").isNotNull() & F.col("tbl").isNotNull(), F.concat_ws(".", "tbl", "col")).otherwise(F.coalesce("tbl", "index_name", "new_name")))


def _by_size(small: str = "medium", large: str = "high", huge: str | None = None) -> Column:
    rows = F.coalesce("rows", F.lit(0))
    out = F.when(rows >= HUGE, huge) if huge else F
    return out.when(rows >= LARGE, large).otherwise(small)


def sized(ops: DataFrame, stats: DataFrame) -> DataFrame:
    return ops.join(stats, "tbl", "left")


def _rules() -> dict[str, tuple[Column, Column]]:
    """Rules that one change event and its table's size decide: code, when it holds, and how severe it is."""
    kind, sql, rows = F.col("kind"), F.col("sql"), F.coalesce("rows", F.lit(0))
    bare = (kind == "add_column") & sql.rlike(r"(?i)not\s+null") & ~sql.rlike(r"(?i)\bdefault\b")
    return {
        "DESTRUCTIVE_NO_EXPAND_CONTRACT": (kind.isin(*V.DESTRUCTIVE), F.lit("high")),
        "INDEX_LOCK_NO_CONCURRENT": ((kind == "create_index") & ~X.is_concurrent(sql), _by_size(huge="blocker")),
        "CONSTRAINT_VALIDATION_LOCK": ((kind == "add_constraint") & sql.rlike(r"(?i)\b(check|foreign\s+key)\b") & ~sql.rlike(r"(?i)not\s+valid"), _by_size()),
        "TABLE_REWRITE_LOCK": (kind.isin("maintenance_rewrite", "alter_type"), _by_size()),
        "UNBATCHED_BACKFILL": ((kind == "dml_update") & ~X.is_batched(sql) & (rows >= MEDIUM), _by_size()),
        "NOT_NULL_NO_DEFAULT": ((kind == "set_not_null") | bare, F.when(kind == "set_not_null", "high").otherwise("blocker")),
    }


def _one(code: str, ops: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    holds, severity = _rules()[code]
    o = ops.withColumn("rows", F.lit(None).cast("long")) if stats is None else sized(ops, stats)
    return finding(o.where(holds), code, severity, _object())


def destructive(ops: DataFrame) -> DataFrame:
    return _one("DESTRUCTIVE_NO_EXPAND_CONTRACT", ops)


def index_lock(ops: DataFrame, stats: DataFrame) -> DataFrame:
    return _one("INDEX_LOCK_NO_CONCURRENT", ops, stats)


def constraint_lock(ops: DataFrame, stats: DataFrame) -> DataFrame:
    return _one("CONSTRAINT_VALIDATION_LOCK", ops, stats)


def rewrite_lock(ops: DataFrame, stats: DataFrame) -> DataFrame:
    return _one("TABLE_REWRITE_LOCK", ops, stats)


def unbatched(ops: DataFrame, stats: DataFrame) -> DataFrame:
    return _one("UNBATCHED_BACKFILL", ops, stats)


def not_null(ops: DataFrame) -> DataFrame:
    return _one("NOT_NULL_NO_DEFAULT", ops)


def access_path(ops: DataFrame, stats: DataFrame, indexes: DataFrame, users: DataFrame, replaced: DataFrame) -> DataFrame:
    """Dropped indexes: an unknown one is medium; one with users and no replacement is priced by rows, and a blocker only with a critical or high user.

    ``indexes`` (name, tbl, columns), ``users`` (name, service, criticality); ``replaced`` (name), or (script_id, name).
    """
    d = ops.where("kind = 'drop_index'").drop("tbl", "columns")
    within = [c for c in replaced.columns if c == "script_id"]
    use = users.groupBy("name").agg(F.array_sort(F.collect_set("service")).alias("users"), F.max(X.weight(F.col("criticality"))).alias("top"))
    known = d.join(indexes.select(F.col("name").alias("index_name"), "tbl", "columns"), "index_name", "left").join(use.withColumnRenamed("name", "index_name"), "index_name", "left")
    known = known.join(replaced.select(*within, F.col("name").alias("index_name"), F.lit(True).alias("again")).distinct(), [*within, "index_name"], "left").join(stats, "tbl", "left")
    hit = known.where(F.col("tbl").isNull() | (F.col("users").isNotNull() & F.col("again").isNull()))
    rows = F.coalesce("rows", F.lit(0))
    severity = F.when(F.col("tbl").isNull(), "medium").when((rows >= HUGE) & (F.col("top") >= 3), "blocker").when(rows >= LARGE, "high").otherwise("medium")
    objects = F.when(F.col("tbl").isNull(), F.array("index_name")).otherwise(F.transform("columns", lambda c: F.concat_ws(".", "tbl", c)))
    return finding(hit, "ACCESS_PATH_REMOVED", severity, objects, F.coalesce("users", _none()))


def open_transaction(ops: DataFrame) -> DataFrame:
    """``ops`` with in_tx: a transaction was opened by a statement before this one and not closed. A script is one window."""
    w = Window.partitionBy("script_id").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    begins = (F.col("kind") == "transaction_control") & F.col("sql").rlike(r"(?i)^\s*(begin|start transaction)")
    ends = (F.col("kind") == "transaction_control") & F.col("sql").rlike(r"(?i)^\s*(commit|rollback|end)\b")
    return ops.withColumn("in_tx", F.coalesce(F.last(F.when(begins, True).when(ends, False), ignorenulls=True).over(w), F.lit(False)))


def _in_transaction() -> Column:
    return F.col("kind").isin("create_index", "drop_index") & X.is_concurrent(F.col("sql")) & F.col("in_tx")


def concurrent_in_transaction(ops: DataFrame) -> DataFrame:
    return finding(open_transaction(ops).where(_in_transaction()), "CONCURRENT_DDL_IN_TRANSACTION", "blocker", _object())


def procedural(bodies: DataFrame) -> DataFrame:
    """DDL inside procedural bodies (script_id, idx, sql, body_ddl, body_destructive)."""
    return finding(bodies.where("body_ddl"), "PROCEDURAL_DDL_UNREVIEWED", F.when(F.col("body_destructive"), "blocker").otherwise("high"), F.array(F.concat(F.lit("statement "), F.col("idx").cast("string"))))


def constraint_removed(ops: DataFrame, constraints: DataFrame) -> DataFrame:
    """Dropped constraints, with their text as evidence (or `not found`). ``constraints`` (index_name, text)."""
    o = ops.where("kind = 'drop_constraint'").join(constraints, "index_name", "left")
    return finding(o, "INTEGRITY_CONSTRAINT_REMOVED", "high", F.array(F.coalesce("index_name", "tbl")), evidence=F.array(F.coalesce("text", F.lit("not found"))))


def unparsed(statements: DataFrame) -> DataFrame:
    """Scripts whose text can't be read whole (script_id, idx, sql, unterminated, destructive)."""
    return finding(statements.where("unterminated or destructive"), "MIGRATION_TEXT_UNPARSED", "blocker", F.array(F.concat(F.lit("statement "), F.col("idx").cast("string"))))


def suppress_unparsed(findings: DataFrame) -> DataFrame:
    """Where a script's text is unparsed, that is its only finding."""
    return keep_unparsed(findings.where("code <> 'MIGRATION_TEXT_UNPARSED'"), findings.where("code = 'MIGRATION_TEXT_UNPARSED'"))


def keep_unparsed(rest: DataFrame, bad: DataFrame) -> DataFrame:
    """As ``suppress_unparsed``, where findings of unparsed text (``bad``) come apart from the rest, which is then made once."""
    return rest.join(bad.select("script_id").distinct(), "script_id", "left_anti").unionByName(bad)


def missing_rollback(scripts: DataFrame) -> DataFrame:
    s = scripts.where(F.trim(F.coalesce("rollback_sql", F.lit(""))) == "").select("script_id", F.lit(-1).alias("idx"), F.lit("").alias("sql"))
    return finding(s, "MISSING_ROLLBACK", "medium", F.array(F.lit("rollback")))


def uncoordinated(services: DataFrame) -> DataFrame:
    """Scripts whose consumer breakage hits other services (script_id, services)."""
    s = services.withColumns({"idx": F.lit(-1), "sql": F.lit("")})
    return finding(s, "CROSS_SERVICE_UNCOORDINATED", "high", F.col("services"), F.col("services"))


def broken_queries(broken: DataFrame) -> DataFrame:
    """(script_id, query_id, services, is_view) that worked before a change and fail after it."""
    b = broken.withColumns({"idx": F.lit(-1), "sql": F.lit("")})
    code = F.when(F.col("is_view"), "VIEW_BREAKAGE").otherwise("BREAKING_QUERY")
    return finding(b, code, "blocker", F.array(F.col("query_id").cast("string")), F.col("services"), source="replay")


def star_drift(drift: DataFrame) -> DataFrame:
    """(script_id, query_id, services, removed): a column set that lost a column; a purely larger one is no finding."""
    d = drift.where(F.size("removed") > 0).withColumns({"idx": F.lit(-1), "sql": F.lit("")})
    return finding(d, "SELECT_STAR_DRIFT", "high", F.array(F.col("query_id").cast("string")), F.col("services"), F.col("removed"), "replay")


def data_failures(counts: DataFrame) -> DataFrame:
    """(script_id, check, kind unique|not_null|check, violations) with violations."""
    c = counts.where("violations > 0").withColumns({"idx": F.lit(-1), "sql": F.concat_ws(" ", "check", F.col("violations").cast("string"))})
    code = F.when(F.col("kind") == "unique", "UNIQUE_VIOLATION_EXISTING_DATA").when(F.col("kind") == "not_null", "NOT_NULL_NO_DEFAULT").otherwise("INTEGRITY_CONSTRAINT_REMOVED")
    return finding(c, code, "blocker", F.array("check"), source="replay")


def narrowing(found: DataFrame) -> DataFrame:
    """(script_id, object, severity, offending_rows) from a narrowing check."""
    f = found.withColumns({"idx": F.lit(-1), "sql": F.concat(F.col("offending_rows").cast("string"), F.lit(" rows"))})
    return finding(f, "TYPE_NARROWING_DATA_LOSS", F.col("severity"), F.array("object"), source="replay")


def apply_rules(ops: DataFrame, stats: DataFrame) -> DataFrame:
    """Findings of the rules that need only change events and table sizes: one pass over the events, one join, one window."""
    every = _rules() | {"CONCURRENT_DDL_IN_TRANSACTION": (_in_transaction(), F.lit("blocker"))}
    hits = F.array_compact(F.array(*(F.when(holds, F.struct(F.lit(code).alias("code"), severity.alias("severity"))) for code, (holds, severity) in every.items())))
    o = sized(open_transaction(ops), stats).withColumn("hit", F.explode(hits))
    return finding(o, F.col("hit.code"), F.col("hit.severity"), _object())


# ---- coverage gaps -------------------------------------------------------------------------------------------------
GAP = "script_id long, seq long, kind string, object string, inferred boolean, irreversible boolean"


def gap(df: DataFrame, kind: Column | str, obj: Column, inferred: Column | None = None, irreversible: Column | bool = False) -> DataFrame:
    lasting = F.lit(irreversible) if isinstance(irreversible, bool) else irreversible
    return df.select("script_id", F.col("idx").cast("long").alias("seq"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), obj.alias("object"), (inferred if inferred is not None else F.lit(False)).alias("inferred"), lasting.alias("irreversible"))


def _gap_struct(kind: str, obj: Column, inferred: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), obj.alias("object"), (inferred if inferred is not None else F.lit(False)).alias("inferred"))


def _unmodelled() -> Column:
    hint = F.coalesce("tbl", X.relation_hint(F.col("sql")), F.lit("unknown"))
    return F.when(F.col("kind").isin(*V.UNMODELLED), _gap_struct("unmodelled_statement", hint, F.col("tbl").isNull() & X.relation_hint(F.col("sql")).isNotNull()))


def _unruled(kind: str = "unruled_statement") -> Column:
    named = F.concat_ws(":", F.coalesce("tbl", X.relation_hint(F.col("sql")), F.lit("statement")), "kind")
    return F.when(X.bucket(F.col("kind")).isin("RESIDUAL", "UNCLASSIFIED"), _gap_struct(kind, named))


def _each(ops: DataFrame, found: Column) -> DataFrame:
    g = ops.withColumn("_g", found).where("_g is not null")
    return gap(g, F.col("_g.kind"), F.col("_g.object"), F.col("_g.inferred"))


def statement_gaps(ops: DataFrame) -> DataFrame:
    """Gaps that a change event's own kind opens (unmodelled, unruled), in one pass over the events."""
    g = ops.withColumn("_g", F.explode(F.array_compact(F.array(_unmodelled(), _unruled()))))
    return gap(g, F.col("_g.kind"), F.col("_g.object"), F.col("_g.inferred"))


def unmodelled(ops: DataFrame) -> DataFrame:
    return _each(ops, _unmodelled())


def mutated(ops: DataFrame) -> DataFrame:
    """(script_id, idx, tbl, col): what updates and deletes rewrite, a column for each that an update assigns; null where none is named."""
    o = ops.where(F.col("kind").isin("dml_update", "dml_delete"))
    cols = F.when(F.col("kind") == "dml_update", X.assigned_columns(F.col("sql"))).otherwise(F.array().cast("array<string>"))
    return o.select("script_id", "idx", "tbl", F.explode_outer(cols).alias("col"))


def in_place_mutation(ops: DataFrame, erased: DataFrame) -> DataFrame:
    """What updates and deletes rewrite, but for columns whose erased nulls are a gap of their own (``erased``: script_id, tbl, col)."""
    o = mutated(ops).join(erased.select("script_id", "tbl", "col").distinct(), ["script_id", "tbl", "col"], "left_anti")
    return gap(o, "in_place_data_mutation", F.concat_ws(".", F.coalesce("tbl", F.lit("unknown")), "col"))


def erased_nulls(ops: DataFrame) -> DataFrame:
    """(script_id, tbl, col), distinct: columns whose nulls an update tests for and overwrites, in a script that also sets them NOT NULL."""
    seal = ops.where("kind = 'set_not_null'").select("script_id", "tbl", "col")
    fill = ops.where("kind = 'dml_update'").select("script_id", "tbl", F.explode(X.nulls_erased(F.col("sql"), X.assigned_columns(F.col("sql")))).alias("col"))
    return fill.join(by_key(seal), ["script_id", "tbl", "col"]).distinct()


def value_class_erased(erased: DataFrame) -> DataFrame:
    return gap(erased.withColumn("idx", F.lit(-1)), "value_class_erased", F.concat_ws(".", "tbl", "col"), irreversible=True)


def bounded_scan(scans: DataFrame) -> DataFrame:
    """(script_id, object, bounded): scans that found nothing in less than the whole table, or couldn't be made."""
    return gap(scans.where("bounded").withColumn("idx", F.lit(-1)), "fixture_bounded_value_scan", F.col("object"), irreversible=True)


def unresolved_relation(lost: DataFrame) -> DataFrame:
    """(script_id, seq, object): relations that a script changes and nobody knows: neither scanned nor replayed."""
    return gap(lost.withColumnRenamed("seq", "idx"), "unresolved_relation", F.col("object"))


def uncovered(columns: DataFrame) -> DataFrame:
    """(script_id, idx, tbl, col) that no statement of the log names."""
    return gap(columns, "uncovered_object", F.concat_ws(".", "tbl", "col"))


def unused_path(unused: DataFrame) -> DataFrame:
    """(script_id, idx, tbl, columns): dropped indexes that no statement of the log looks up by, and nothing replaces."""
    return gap(unused, "unused_access_path", F.concat(F.coalesce("tbl", F.lit("unknown")), F.lit("("), F.array_join("columns", ", "), F.lit(")")))


def unattributed(statements: DataFrame) -> DataFrame:
    """Census rows (script_id, idx, sql, unterminated, claimed, procedural, body_destructive) that nothing accounts for.

    A statement that is neither claimed nor plainly destructive is a gap; one that is destructive is a finding instead.
    """
    lost = ~F.col("claimed") & ~X.is_destructive(F.col("sql"))
    bad = F.when(F.col("unterminated"), "unreviewable_text").when(lost, "unattributed_statement").when(F.col("procedural"), "procedural_body")
    g = statements.withColumn("k", bad).where("k is not null")
    place = F.concat(F.lit("statement "), F.col("idx").cast("string"))
    hint = F.when(F.col("k") == "unattributed_statement", X.relation_hint(F.col("sql")))
    return gap(g, F.col("k"), F.coalesce(hint, place), hint.isNotNull(), F.coalesce(F.col("body_destructive"), F.lit(False)) & (F.col("k") == "procedural_body"))


def unruled(ops: DataFrame, kind: str = "unruled_statement") -> DataFrame:
    return _each(ops, _unruled(kind))


def gap_ledger(*gaps: DataFrame) -> DataFrame:
    """All gaps, the first of each (script, kind, object)."""
    return first_gap(reduce(DataFrame.unionByName, gaps))
