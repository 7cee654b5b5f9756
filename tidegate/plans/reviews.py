"""Queries for rules, gaps, findings, verdicts, plans and replay."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.functions import vocab as V
from tidegate.operators import census as CE
from tidegate.operators import corpus as C
from tidegate.operators import findings as FI
from tidegate.operators import replay as RE
from tidegate.operators import rules as R
from tidegate.operators import runs as RU
from tidegate.plans import audit as A
from tidegate.plans import bindings as B
from tidegate.plans import evidence as EV
from tidegate.plans import review as RV
from tidegate.plans.registry import query
from tidegate.session import materialize, table
from tidegate.operators.events import change_events
from tidegate.streaming.learning import record_learning

_O = f"{B.OPS} o LEFT JOIN {B.STATS} st USING (tbl)"
_OBJ = "CASE WHEN col IS NOT NULL AND tbl IS NOT NULL THEN tbl || '.' || col ELSE coalesce(tbl, index_name, new_name) END"
_EV = "substr(trim(regexp_replace(sql, '\\s+', ' ', 'g')), 1, 120)"
_SIZED = "CASE WHEN coalesce(rows, 0) >= 100000 THEN 'high' ELSE 'medium' END"


def _finding(code: str, severity: str, where: str, obj: str = _OBJ, services: str = "''", ev: str = _EV, source: str = "static", frm: str = _O, seq: str = "idx") -> str:
    return f"SELECT script_id, CAST({seq} AS BIGINT) AS seq, '{code}' AS code, {severity} AS severity, coalesce({obj}, '') AS objects, {services} AS services, {ev} AS evidence, '{source}' AS source FROM {frm} WHERE {where}"


def _ops(spark, d):
    return B.ops(spark, d)


def _stats(spark, d):
    return B.rows(spark, d, B.STATS)


_R1 = _finding("DESTRUCTIVE_NO_EXPAND_CONTRACT", "'high'", "kind IN ('drop_column', 'drop_table', 'rename_column', 'rename_table')")
_R2 = _finding("INDEX_LOCK_NO_CONCURRENT", "CASE WHEN coalesce(rows, 0) >= 5000000 THEN 'blocker' WHEN coalesce(rows, 0) >= 100000 THEN 'high' ELSE 'medium' END", "sql LIKE 'CREATE INDEX%' AND sql NOT LIKE '%CONCURRENTLY%'")
_R3 = _finding("CONSTRAINT_VALIDATION_LOCK", _SIZED, "kind = 'add_constraint' AND sql NOT LIKE '%NOT VALID'")
_R4 = _finding("TABLE_REWRITE_LOCK", _SIZED, "kind IN ('maintenance_rewrite', 'alter_type')")
_R5 = _finding("UNBATCHED_BACKFILL", _SIZED, "kind = 'dml_update' AND sql NOT LIKE '%BETWEEN%' AND rows >= 10000")
_R6 = _finding("NOT_NULL_NO_DEFAULT", "CASE WHEN kind = 'set_not_null' THEN 'high' ELSE 'blocker' END", "kind = 'set_not_null' OR (kind = 'add_column' AND sql NOT LIKE '%DEFAULT%')")
_TX = f"""(SELECT *, coalesce(last_value(CASE WHEN sql = 'BEGIN' THEN true WHEN sql = 'COMMIT' THEN false END IGNORE NULLS) OVER (PARTITION BY script_id ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_tx FROM {B.OPS} o)"""
_R8 = _finding("CONCURRENT_DDL_IN_TRANSACTION", "'blocker'", "in_tx AND sql LIKE '%INDEX CONCURRENTLY%'", frm=f"{_TX} x")


@query(_R1)
def r1_destructive(spark, d):
    return R.destructive(_ops(spark, d))


@query(_R2)
def r2_index_lock(spark, d):
    return R.index_lock(_ops(spark, d), _stats(spark, d))


@query(_R3)
def r3_constraint_lock(spark, d):
    return R.constraint_lock(_ops(spark, d), _stats(spark, d))


@query(_R4)
def r4_rewrite_lock(spark, d):
    return R.rewrite_lock(_ops(spark, d), _stats(spark, d))


@query(_R5)
def r5_unbatched(spark, d):
    return R.unbatched(_ops(spark, d), _stats(spark, d))


@query(_R6)
def r6_not_null(spark, d):
    return R.not_null(_ops(spark, d))


_KNOWN = "(SELECT DISTINCT c || '_idx' AS name, t AS tbl, c FROM " + B.OPS + " o WHERE c NOT IN ('p_size', 's_name'))"
_USE = f"(SELECT k.name, list_sort(list_distinct(list(service))) AS users, max(CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END) AS top FROM {B.LOG} q JOIN {_KNOWN} k ON (k.c = 'o_custkey' AND sql LIKE 'SELECT * FROM orders%') OR (k.c IN ('c_custkey', 'c_name') AND sql LIKE 'SELECT c_name%') OR (k.c IN ('o_custkey') AND sql LIKE 'SELECT o_orderstatus%' AND k.tbl = 'orders') OR (k.c = 'c_custkey' AND sql LIKE 'SELECT o_orderstatus%') OR (k.c = 'l_shipdate' AND sql LIKE 'SELECT l.%') GROUP BY k.name)"


def _catalogue(spark, d):
    """Indexes that exist, of most columns."""
    return _ops(spark, d).select(F.concat("c", F.lit("_idx")).alias("name"), F.col("t").alias("tbl"), F.array("c").alias("columns")).distinct().where("columns[0] not in ('p_size', 's_name')")


@query(f"""SELECT script_id, idx AS seq, 'ACCESS_PATH_REMOVED' AS code, CASE WHEN k.tbl IS NULL THEN 'medium' WHEN coalesce(rows, 0) >= 5000000 AND top >= 3 THEN 'blocker' WHEN coalesce(rows, 0) >= 100000 THEN 'high' ELSE 'medium' END AS severity, coalesce(k.tbl || '.' || k.c, index_name) AS objects, coalesce(array_to_string(users, ','), '') AS services, {_EV} AS evidence, 'static' AS source
FROM (SELECT * EXCLUDE (tbl) FROM {B.OPS} o WHERE kind = 'drop_index') o LEFT JOIN {_KNOWN} k ON k.name = o.index_name LEFT JOIN {_USE} u ON u.name = o.index_name LEFT JOIN {B.STATS} st ON st.tbl = k.tbl
WHERE k.tbl IS NULL OR (users IS NOT NULL AND NOT (k.c = 'o_orderdate'))""")
def r7_access_path(spark, d):
    known = _catalogue(spark, d)
    users = C.access_path_users(B.rows(spark, d, B.LOG), known)
    replaced = C.replaced_indexes(known, spark.createDataFrame([("n_idx", "orders", ["o_orderdate", "o_custkey"])], "name string, tbl string, columns array<string>"))
    return R.access_path(_ops(spark, d), _stats(spark, d), known, users, replaced)


@query(_R8)
def r8_concurrent_in_transaction(spark, d):
    return R.concurrent_in_transaction(_ops(spark, d))


@query(f"SELECT script_id, idx, in_tx FROM {_TX} x")
def w1_open_transaction(spark, d):
    return R.open_transaction(_ops(spark, d)).select("script_id", "idx", "in_tx")


@query(_finding("INTEGRITY_CONSTRAINT_REMOVED", "'high'", "kind = 'drop_constraint'", obj="index_name", ev="CASE WHEN c = 'p_size' THEN 'p_size > 0' ELSE 'not found' END"))
def r10_constraint_removed(spark, d):
    return R.constraint_removed(_ops(spark, d), spark.createDataFrame([("p_size_chk", "p_size > 0")], "index_name string, text string"))


_SCRIPTS = f"(SELECT script_id, string_agg(sql, '; ' ORDER BY idx) AS text FROM {B.OPS} o GROUP BY script_id)"


def _scripts(spark, d):
    """Scripts as text: the statements of a script in order. A script is as long as its customer has orders."""
    o = _ops(spark, d).select("script_id", "idx", "sql").repartition("script_id").groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("idx", "sql"))).alias("s"))
    return o.select("script_id", F.array_join(F.transform("s", lambda x: x["sql"]), "; ").alias("text"))


@query(f"SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY idx) - 1 AS INTEGER) AS idx, sql, kind = 'procedural_block' AS body_ddl FROM {B.OPS} o")
def j_census_split_scripts(spark, d):
    return CE.split_scripts(_scripts(spark, d)).select("script_id", "idx", "sql", "body_ddl")


@query(f"SELECT script_id, CAST(count(*) + 2 * count(*) FILTER (kind = 'procedural_block') AS INTEGER) AS naive, CAST(count(*) AS INTEGER) AS real, 0 AS lost, CAST(2 * count(*) FILTER (kind = 'procedural_block') AS INTEGER) AS phantom FROM {B.OPS} o GROUP BY script_id".replace("+ 2 *", "+").replace("CAST(2 * count(*)", "CAST(count(*)"))
def o_splitloss_splitter_loss(spark, d):
    s = _scripts(spark, d)
    return CE.splitter_loss(s, CE.split_scripts(s))


@query(f"SELECT script_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS INTEGER) AS chars, CAST(0 AS INTEGER) AS shortfall FROM {_SCRIPTS} s")
def g17_conservation(spark, d):
    return CE.conservation(CE.split_scripts(_scripts(spark, d))).select("script_id", "chars", "shortfall")


#: comments that stand before two thirds of the statements
_REMARKS = ["-- a note; with 'marks'\n", "/* old: DROP TABLE x; /* nested */ */ ", ""]


def _remarked(spark, d):
    """The same scripts with comments before their statements."""
    remark = F.element_at(F.array(*map(F.lit, _REMARKS)), (F.col("idx") % 3 + 1).cast("int"))
    o = _ops(spark, d).select("script_id", "idx", F.concat(remark, F.col("sql")).alias("sql")).repartition("script_id").groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("idx", "sql"))).alias("s"))
    return o.select("script_id", F.array_join(F.transform("s", lambda x: x["sql"]), ";\n").alias("text"))


_LOOSE = f"(SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY idx) - 1 AS INTEGER) AS idx, sql, kind FROM {B.OPS} o)"


_BROKEN_UP = "replace(replace(sql, 'BEGIN DROP', 'BEGIN' || chr(10) || 'DROP'), ' ADD ', chr(10) || 'ADD ')"
_NOTED = f"(SELECT idx, CASE idx % 3 WHEN 0 THEN '/* a; note' || chr(10) || '/* within */ it''s;' || chr(10) || '*/ ' WHEN 1 THEN '-- it''s; so' || chr(10) ELSE '' END || {_BROKEN_UP} || ';' AS text FROM {B.OPS} o)"


@query(f"SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS idx, sql AS code, kind = 'procedural_block' AS body_ddl FROM {B.OPS} o")
def j_census_large_script(spark, d):
    """All statements as one script, in chunks of a line each, so that comments and bodies lie open over chunks' ends."""
    lines = B.rows(spark, d, _NOTED).select("idx", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    chunks = lines.select(F.lit(0).alias("script_id"), (F.col("idx") * 16 + F.col("line")).alias("chunk"), F.concat("text", F.lit("\n")).alias("text"))
    return CE.split_chunks(chunks).select("idx", X.norm_sql(F.col("code")).alias("code"), "body_ddl")


@query(_finding("PROCEDURAL_DDL_UNREVIEWED", "'blocker'", "kind = 'procedural_block'", obj="'statement ' || CAST(idx AS VARCHAR)", frm=f"{_LOOSE} l"))
def r9_procedural(spark, d):
    return R.procedural(CE.split_scripts(_scripts(spark, d)))


@query(f"SELECT script_id, CAST(count(*) AS BIGINT) AS seq, 'MIGRATION_TEXT_UNPARSED' AS code, 'blocker' AS severity FROM {B.OPS} o WHERE script_id % 3 = 0 GROUP BY script_id UNION ALL SELECT script_id, idx, 'MIGRATION_TEXT_UNPARSED', 'blocker' FROM {_LOOSE} l WHERE kind = 'drop_table'")
def r11_unparsed(spark, d):
    """A third of the scripts have an open quote at their end; change events of dropped tables are held back, so that no event claims them."""
    s = _scripts(spark, d).withColumn("text", F.concat("text", F.when(F.col("script_id") % 3 == 0, "; SELECT 'left open").otherwise("")))
    statements = materialize(CE.split_scripts(s))
    claimed = change_events(statements).where("kind not in ('drop_table', 'unsupported')")
    return R.unparsed(RV.claims(statements, claimed)).select("script_id", "seq", "code", "severity")


@query("SELECT DISTINCT o_custkey AS script_id, CAST(-1 AS BIGINT) AS seq, 'MISSING_ROLLBACK' AS code, 'medium' AS severity, 'rollback' AS objects, '' AS services, '' AS evidence, 'static' AS source FROM orders GROUP BY o_custkey HAVING count(*) % 3 = 0")
def r12_missing_rollback(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("script_id")).agg(F.when(F.count(F.lit(1)) % 3 == 0, " ").otherwise("DROP TABLE x").alias("rollback_sql"))
    return R.missing_rollback(s)


_F = B.FINDINGS
_CROSS = f"""(SELECT script_id, string_agg(service, ',' ORDER BY service) AS services FROM (SELECT DISTINCT script_id, service FROM {_F} f WHERE code IN ('BREAKING_QUERY', 'SELECT_STAR_DRIFT', 'VIEW_BREAKAGE') AND service <> '5-LOW') GROUP BY script_id)"""


def _findings(spark, d):
    f = B.rows(spark, d, _F)
    return f.select("script_id", "seq", "code", "severity", F.array("obj").alias("objects"), F.array("service").alias("services"), F.array("ev").alias("evidence"), "source")


def _incidents(spark, d):
    return B.rows(spark, d, B.INCIDENTS).select("id", "hazard_code", F.array("obj").alias("tables"), F.array("service").alias("services"), F.col("severity_bump").cast("int").alias("severity_bump"))


def _cross(spark, d):
    return FI.cross_service(_findings(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("script_id"), F.lit("5-LOW").alias("owner")).distinct())


@query(f"SELECT script_id, services FROM {_CROSS} c")
def j13_cross_service(spark, d):
    return _cross(spark, d)


@query(_finding("CROSS_SERVICE_UNCOORDINATED", "'high'", "true", obj="services", services="services", ev="''", frm=f"{_CROSS} c", seq="-1"))
def r13_uncoordinated(spark, d):
    return R.uncoordinated(_cross(spark, d))


def _tables(spark, d):
    """The catalogue: tables whose changes the scripts are about. Names of parts are missing where they have an `a`."""
    found = {t: table(spark, d, t) for t in ("customer", "orders", "lineitem", "part", "supplier")}
    found["part"] = found["part"].withColumn("p_name", F.when(~F.col("p_name").contains("a"), F.col("p_name")))
    return found


#: a view of the catalogue that the log doesn't read
_VIEWS = {"orders_view": "SELECT o_orderkey, o_custkey FROM orders"}


def _log_outcomes(spark, d, log, tables):
    shapes = RE.read_shapes(log)
    texts = [(str(r["query_id"]), r["sql"]) for r in shapes.select("query_id", "sql").collect()]  # one for each statement that an application holds
    found = RE.replay(spark, texts, tables, False)
    return RE.log_outcomes(log, found.join(shapes.select("shape", F.col("query_id").cast("string").alias("query_id")), "query_id"))


@query(f"""SELECT query_id, CASE WHEN sql LIKE 'SELECT c_name%' THEN CASE WHEN service = 'click-svc' THEN 'added' ELSE 'broken' END WHEN service = 'click-svc' THEN 'added' WHEN sql LIKE 'SELECT l.%' THEN 'fixed' ELSE 'same' END AS state FROM {B.LOG} q WHERE sql LIKE 'SELECT%'""")
def j12_outcome_diff(spark, d):
    """The log's reads before a change (one service not yet there, a column not yet named as reads want it) and after it."""
    t, log = _tables(spark, d), B.rows(spark, d, B.LOG)
    pre = _log_outcomes(spark, d, log.where("service <> 'click-svc'"), t | {"lineitem": t["lineitem"].withColumnRenamed("l_shipdate", "shipped")})
    post = _log_outcomes(spark, d, log, t | {"customer": t["customer"].withColumnRenamed("c_acctbal", "balance")})
    return FI.outcome_diff(pre, post)


#: what the log's reads need, by the text they begin with: a table and its columns
_NEEDS = [("SELECT * FROM orders%", "orders", "o_custkey"), ("SELECT c_name%", "customer", "c_custkey"), ("SELECT c_name%", "customer", "c_name"), ("SELECT o_orderstatus%", "orders", "o_custkey"), ("SELECT o_orderstatus%", "customer", "c_custkey"), ("SELECT l.%", "lineitem", "l_partkey"), ("SELECT l.%", "lineitem", "l_shipdate")]
_NEED = "(" + " UNION ALL ".join(f"SELECT '{p}' AS p, '{t}' AS t, '{c}' AS c" for p, t, c in _NEEDS) + ")"
_SENT = f"(SELECT p, CAST(min(query_id) AS VARCHAR) AS query_id, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM {B.LOG} q JOIN (SELECT DISTINCT p FROM {_NEED} n) n ON sql LIKE p GROUP BY p)"
#: kinds after which a table's name stands for nothing, or for another table
_RESET = "('drop_table', 'rename_table', 'create_table')"
_GONE = f"(kind IN ('drop_column', 'rename_column') AND o.c = n.c) OR kind IN {_RESET}"
#: of scripts that change orders or its view: the last event of either, and whether the view's column goes
_ORDERS = f"""(SELECT script_id, arg_max(kind, idx) FILTER (kind IN ('create_view', 'drop_view')) AS v, arg_max(kind, idx) FILTER (kind IN {_RESET}) AS r, bool_or(kind IN ('drop_column', 'rename_column') AND c = 'o_custkey') AS gone FROM {B.OPS} o WHERE t = 'orders' GROUP BY script_id)"""
_BROKEN = f"""(SELECT DISTINCT o.script_id, query_id, services, false AS is_view FROM {B.OPS} o JOIN {_NEED} n ON o.t = n.t AND ({_GONE}) JOIN {_SENT} s ON s.p = n.p
UNION ALL SELECT script_id, 'orders_view', 'database', true FROM {_ORDERS} w WHERE v = 'drop_view' OR (v IS NULL AND (r IS NOT NULL OR gone)) OR (v = 'create_view' AND r IN ('drop_table', 'rename_table')))"""
_DRIFT = f"(SELECT DISTINCT script_id, query_id, services FROM {B.OPS} o, {_SENT} s WHERE p = 'SELECT * FROM orders%' AND kind IN ('drop_column', 'rename_column') AND c = 'o_orderdate' AND script_id NOT IN (SELECT script_id FROM {B.OPS} z WHERE t = 'orders' AND ((kind IN ('drop_column', 'rename_column') AND c = 'o_custkey') OR kind IN {_RESET})))"
_R14 = _finding("BREAKING_QUERY", "'blocker'", "NOT is_view", obj="query_id", services="services", ev="''", source="replay", frm=f"{_BROKEN} b", seq="-1") + " UNION ALL " + _finding("VIEW_BREAKAGE", "'blocker'", "is_view", obj="query_id", services="services", ev="''", source="replay", frm=f"{_BROKEN} b", seq="-1")
_R15 = _finding("SELECT_STAR_DRIFT", "'high'", "true", obj="query_id", services="services", ev="'o_orderdate'", source="replay", frm=f"{_DRIFT} b", seq="-1")


def _replayed(spark, d):
    return EV.replay_changes(_ops(spark, d), B.rows(spark, d, B.LOG), _tables(spark, d), _VIEWS)


@query(_R14)
def r14_broken_queries(spark, d):
    return R.broken_queries(_replayed(spark, d).broken)


@query(_R15)
def r15_star_drift(spark, d):
    return R.star_drift(_replayed(spark, d).drift)


@query(f"SELECT script_id, new_name AS name FROM {B.OPS} o WHERE kind = 'drop_view' AND new_name NOT IN ('orders_view', 'part_view')")
def j14_fold_view_breakage(spark, d):
    log = B.rows(spark, d, B.LOG).withColumn("sql", F.concat("sql", F.lit(" /* orders_view part_view */")))
    return FI.fold_view_breakage(_ops(spark, d).where("kind = 'drop_view'").select("script_id", F.col("new_name").alias("name")), C.token_index(log))


_COLUMNS = [("customer", "c_custkey"), ("customer", "c_name"), ("orders", "o_custkey"), ("orders", "o_orderdate"), ("lineitem", "l_partkey"), ("lineitem", "l_shipdate"), ("part", "p_name"), ("part", "p_size"), ("supplier", "s_name"), ("supplier", "s_nationkey")]
_VALUE = lambda c: "CASE WHEN p_name NOT LIKE '%a%' THEN p_name END" if c == "p_name" else c
_TEXTUAL = ("c_name", "o_orderdate", "l_shipdate", "p_name", "s_name")
#: of each column: nulls, rows that a unique key rejects (as they are, with nulls filled, without rows whose p_name is null), values too long for eight characters
_FACTS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(*) FILTER (v IS NULL) AS nulls, count(v) - count(DISTINCT v) AS again, count(*) - count(DISTINCT coalesce(CAST(v AS VARCHAR), '0')) AS filled, count(v) FILTER (named) - count(DISTINCT v) FILTER (named) AS left_, {'count(*) FILTER (length(CAST(v AS VARCHAR)) > 8)' if c in _TEXTUAL else '0'} AS long FROM (SELECT {_VALUE(c)} AS v, {_VALUE('p_name') + ' IS NOT NULL' if t == 'part' else 'true'} AS named FROM {t})" for t, c in _COLUMNS) + ")"
_BEFORE_T, _BEFORE_C = ("OVER (PARTITION BY script_id, t{} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)".format(x) for x in ("", ", c"))
#: events with what their script did before to the table and the column: whether the column is gone, no longer known (an update by a column that no table has, or of a timestamp by a number), or filled
_PAST = f"""(SELECT *, coalesce(bool_or(kind IN ('drop_column', 'rename_column')) {_BEFORE_C}, false) AS gone, coalesce(bool_or(kind = 'dml_update' AND (sql LIKE '%BETWEEN%' OR c IN ('o_orderdate', 'l_shipdate'))) {_BEFORE_C}, false) AS odd, coalesce(bool_or(kind = 'dml_update' AND sql LIKE '%IS NULL') {_BEFORE_C}, false) AS filled_ FROM {B.OPS} o)"""
#: checks with what is left to ask: nothing (lost), or n violating rows; more: rows were inserted that no scan sees
_ASKED = f"""(SELECT p.script_id, p.kind, p.t, p.c, lost, more, long, CASE kind WHEN 'set_not_null' THEN 'NOT_NULL_NO_DEFAULT' WHEN 'create_index' THEN 'UNIQUE_VIOLATION_EXISTING_DATA' ELSE 'INTEGRITY_CONSTRAINT_REMOVED' END AS code,
  CASE kind WHEN 'create_index' THEN p.t || '(' || p.c || ')' WHEN 'add_constraint' THEN p.t || '.coalesce(' || p.c || ', nullif(' || p.c || ', ' || p.c || ')) IS NOT NULL' ELSE p.t || '.' || p.c END AS obj,
  CASE kind WHEN 'alter_type' THEN long WHEN 'create_index' THEN CASE WHEN p.c = 'p_name' AND filled_ AND NOT thinned THEN filled WHEN p.t = 'part' AND thinned THEN left_ ELSE again END ELSE CASE WHEN filled_ OR thinned THEN 0 ELSE nulls END END AS n
FROM (SELECT *, coalesce(bool_or(kind IN {_RESET}) {_BEFORE_T}, false) OR gone OR odd OR coalesce(bool_or(kind = 'dml_delete' AND (gone OR odd)) {_BEFORE_T}, false) AS lost, coalesce(bool_or(kind = 'create_table') {_BEFORE_T}, false) AS anew,
    coalesce(bool_or(kind = 'dml_insert') {_BEFORE_T}, false) AS more, coalesce(bool_or(kind = 'dml_delete' AND c = 'p_name' AND NOT filled_) {_BEFORE_T}, false) AS thinned FROM {_PAST} z) p JOIN {_FACTS} f ON f.t = p.t AND f.c = p.c
WHERE NOT anew AND (kind IN ('set_not_null', 'alter_type') OR sql LIKE 'CREATE UNIQUE%' OR sql LIKE '%CHECK (%'))"""
_FAILED = f"(SELECT DISTINCT script_id, code, obj, n FROM {_ASKED} a WHERE NOT lost AND kind <> 'alter_type')"
_R16 = f"SELECT script_id, CAST(-1 AS BIGINT) AS seq, code, 'blocker' AS severity, obj AS objects, '' AS services, obj || ' ' || CAST(n AS VARCHAR) AS evidence, 'replay' AS source FROM {_FAILED} x WHERE n > 0"
_R17 = f"SELECT DISTINCT script_id, CAST(-1 AS BIGINT) AS seq, 'TYPE_NARROWING_DATA_LOSS' AS code, CASE WHEN n > 0 THEN 'blocker' ELSE 'medium' END AS severity, obj AS objects, '' AS services, CAST(n AS VARCHAR) || ' rows' AS evidence, 'replay' AS source FROM {_ASKED} a WHERE kind = 'alter_type' AND NOT lost"


@query(_R16)
def r16_data_failures(spark, d):
    return R.data_failures(EV.scan_tables(_ops(spark, d), _tables(spark, d)).data)


@query(_R17)
def r17_narrowing(spark, d):
    return R.narrowing(EV.scan_tables(_ops(spark, d), _tables(spark, d)).narrowed)


#: scripts about keys and ranges, one of eight for each order: a statement before, and the change
_KEYED = [
    ("", "ALTER TABLE lineitem ADD PRIMARY KEY (l_orderkey, l_linenumber)"), ("DELETE FROM customer WHERE c_nationkey = 3", "ALTER TABLE orders ADD CONSTRAINT f FOREIGN KEY (o_custkey) REFERENCES customer (c_custkey)"),
    ("", "ALTER TABLE orders ADD CONSTRAINT f FOREIGN KEY (o_custkey) REFERENCES customer (c_custkey)"), ("UPDATE orders SET o_orderkey = o_orderkey * 5000000000", "ALTER TABLE orders ALTER COLUMN o_orderkey TYPE integer"),
    ("", "ALTER TABLE orders ALTER COLUMN o_orderkey TYPE integer"), ("UPDATE part SET p_name = 'x' WHERE p_name IS NULL AND p_size > 25", "ALTER TABLE part ADD PRIMARY KEY (p_name)"),
    ("DELETE FROM orders WHERE o_orderkey IN (SELECT 1)", "ALTER TABLE orders ADD UNIQUE (o_custkey)"), ("DELETE FROM lineitem WHERE l_linenumber > 1", "CREATE UNIQUE INDEX u ON public.lineitem (l_orderkey, l_linenumber)"),
]
_N = "CASE WHEN p_name NOT LIKE '%a%' THEN p_name WHEN p_size > 25 THEN 'x' END"
#: check, kind and violations of each of them; none where it can't be asked
_KEY_FACTS = f"""(SELECT 0 AS k, 'lineitem(l_orderkey,l_linenumber)' AS "check", 'unique' AS kind, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS violations FROM lineitem UNION ALL SELECT 0, 'lineitem.l_orderkey', 'not_null', 0 UNION ALL SELECT 0, 'lineitem.l_linenumber', 'not_null', 0
UNION ALL SELECT 1, 'orders(o_custkey>customer(c_custkey))', 'foreign', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) UNION ALL SELECT 2, 'orders(o_custkey>customer(c_custkey))', 'foreign', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 3, 'orders.o_orderkey', 'narrow', count(*) FILTER (o_orderkey * 5000000000 > 2147483647) FROM orders UNION ALL SELECT 4, 'orders.o_orderkey', 'narrow', count(*) FILTER (o_orderkey > 2147483647) FROM orders
UNION ALL SELECT 5, 'part(p_name)', 'unique', count({_N}) - count(DISTINCT {_N}) FROM part UNION ALL SELECT 5, 'part.p_name', 'not_null', count(*) FILTER ({_N} IS NULL) FROM part UNION ALL SELECT 6, 'orders(o_custkey)', 'bounded', NULL
UNION ALL SELECT 7, 'lineitem(l_orderkey,l_linenumber)', 'unique', count(*) - count(DISTINCT l_orderkey) FROM lineitem WHERE l_linenumber = 1)"""


@query(f"SELECT o_orderkey AS script_id, \"check\", kind, violations FROM orders JOIN {_KEY_FACTS} f ON k = o_orderkey % 8")
def r16_keys_and_ranges(spark, d):
    """Primary, foreign and unique keys and integer ranges, each on the rows that the statement before leaves."""
    texts = F.array(*(F.lit(f"{a}; {b}" if a else b) for a, b in _KEYED))
    scripts = table(spark, d, "orders").select(F.col("o_orderkey").alias("script_id"), F.get(texts, (F.col("o_orderkey") % 8).cast("int")).alias("text"))
    first, members = CE.by_text(scripts)
    e = EV.scan_tables(change_events(CE.split_scripts(first)), _tables(spark, d))
    narrow = e.narrowed.select("script_id", F.col("object").alias("check"), F.lit("narrow").alias("kind"), F.col("offending_rows").alias("violations"))
    bounded = e.bounded.select("script_id", F.col("object").alias("check"), F.lit("bounded").alias("kind"), F.lit(None).cast("long").alias("violations"))
    return CE.for_members(e.data.unionByName(narrow).unionByName(bounded), members)


#: scripts that put another shape behind a name, one of six for each customer
_BEHIND = [
    "CREATE OR REPLACE VIEW open_orders AS SELECT o_orderkey FROM orders", "DROP VIEW open_orders; CREATE VIEW open_orders AS SELECT o_orderkey, o_custkey AS buyer FROM orders", "ALTER TABLE orders RENAME TO orders_old; CREATE VIEW orders AS SELECT o_orderkey, o_custkey AS who, o_orderstatus FROM orders_old",
    "ALTER TABLE orders RENAME TO orders_old; CREATE VIEW orders AS SELECT * FROM orders_old", "DROP TABLE supplier, orders", "ALTER TABLE orders DROP COLUMN o_custkey; ALTER TABLE orders ADD COLUMN o_custkey bigint",
]
_BEHIND_LOG = "(SELECT event_id AS query_id, event_type || '-svc' AS service, 'high' AS criticality, CASE WHEN event_id % 3 = 0 THEN 'SELECT who FROM open_orders WHERE o_orderkey = ' || CAST(user_id AS STRING) WHEN event_id % 3 = 1 THEN 'SELECT o_custkey FROM orders LIMIT ' || CAST(user_id AS STRING) ELSE 'SELECT * FROM open_orders' END AS sql FROM events)"
_HIT = [(0, 0, 'broken', ''), (0, 2, 'drift', 'who'), (1, 0, 'broken', ''), (1, 2, 'drift', 'who'), (2, 0, 'broken', ''), (2, 1, 'broken', ''), (2, 2, 'broken', ''), (4, 0, 'broken', ''), (4, 1, 'broken', ''), (4, 2, 'broken', '')]


@query(f"SELECT c_custkey AS script_id, query_id, state, removed FROM customer JOIN (VALUES {', '.join(map(str, _HIT))}) h(k, m, state, removed) ON k = c_custkey % 6 JOIN (SELECT event_id % 3 AS m, CAST(min(event_id) AS VARCHAR) AS query_id FROM events GROUP BY 1) q USING (m)")
def r14_redefined_names(spark, d):
    """Reads on what whole scripts leave behind a name: narrower views, views in a renamed table's place, and what is taken away and given back."""
    texts = F.array(*map(F.lit, _BEHIND))
    scripts = table(spark, d, "customer").select(F.col("c_custkey").alias("script_id"), F.get(texts, (F.col("c_custkey") % 6).cast("int")).alias("text"))
    first, members = CE.by_text(scripts)
    e = EV.replay_changes(change_events(CE.split_scripts(first)), B.rows(spark, d, _BEHIND_LOG), _tables(spark, d), OPEN_ORDERS)
    found = e.broken.where("not is_view").select("script_id", "query_id", F.lit("broken").alias("state"), F.lit("").alias("removed")).unionByName(e.drift.select("script_id", "query_id", F.lit("drift").alias("state"), F.array_join("removed", ",").alias("removed")))
    return CE.for_members(found, members)


# ---- findings ------------------------------------------------------------------------------------------------------
_RANK = "list_position(['low','medium','high','blocker'], severity)"


@query(f"""SELECT script_id, min(seq) AS seq, code, arg_max(severity, {_RANK} * 1000000000000 - seq) AS severity, obj AS objects, string_agg(DISTINCT service, ',' ORDER BY service) AS services, string_agg(DISTINCT ev, ',' ORDER BY ev) AS evidence,
CASE WHEN bool_or(source = 'replay') AND arg_max(source, {_RANK} * 1000000000000 - seq) <> 'replay' THEN 'replay+static' ELSE arg_max(source, {_RANK} * 1000000000000 - seq) END AS source FROM {_F} f GROUP BY script_id, code, obj""")
def g2_merge_findings(spark, d):
    return FI.merge_findings(_findings(spark, d))


@query(f"SELECT script_id, code, severity, seq FROM {_F} f")
def l1_ranked(spark, d):
    return FI.ranked(_findings(spark, d)).select("script_id", "code", "severity", "seq")


_RECALL = f"""(SELECT f.script_id, f.seq, f.code, f.severity, i.id AS incident_id, CASE WHEN f.obj = i.obj THEN 'table' WHEN f.service = i.service THEN 'service' ELSE 'pattern' END AS match, i.severity_bump AS bump,
row_number() OVER (PARTITION BY f.script_id, f.seq ORDER BY CASE WHEN f.obj = i.obj THEN 0 WHEN f.service = i.service THEN 1 ELSE 2 END, i.severity_bump DESC, i.id) AS rank FROM {_F} f JOIN {B.INCIDENTS} i ON f.code = i.hazard_code)"""


@query(f"SELECT script_id, seq, code, incident_id, match, bump, rank FROM {_RECALL} r")
def j10_recall(spark, d):
    return FI.recall(_findings(spark, d), _incidents(spark, d))


@query(f"""SELECT f.script_id, f.seq, f.code, ['low','medium','high','blocker'][least(4, list_position(['low','medium','high','blocker'], f.severity) + coalesce(b, 0))] AS severity, coalesce(near, "first", '') AS memory_refs
FROM {_F} f LEFT JOIN (SELECT script_id, seq, max(bump) FILTER (match <> 'pattern') AS b, string_agg(incident_id, ',' ORDER BY incident_id) FILTER (match <> 'pattern') AS near, min(incident_id) FILTER (rank = 1) AS "first" FROM {_RECALL} r GROUP BY script_id, seq) r ON f.script_id = r.script_id AND f.seq = r.seq""")
def j11_escalate(spark, d):
    return FI.escalate(_findings(spark, d), _incidents(spark, d)).select("script_id", "seq", "code", "severity", "memory_refs")


@query(f"SELECT script_id, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'blocker') AS blocker FROM {_F} f GROUP BY script_id")
def g3_severity_counts(spark, d):
    return FI.severity_counts(_findings(spark, d))


_VERDICT = f"(SELECT script_id, CASE max({_RANK}) WHEN 4 THEN 'BLOCK' WHEN 3 THEN 'SAFE_WITH_PLAN' ELSE 'SAFE' END AS verdict FROM {_F} f GROUP BY script_id)"


@query(f"SELECT script_id, verdict FROM {_VERDICT} v")
def g4_verdict(spark, d):
    return FI.verdict(_findings(spark, d))


@query(f"SELECT script_id, CASE WHEN coalesce(gaps, 0) > 0 AND verdict <> 'BLOCK' THEN 'NEEDS_COVERAGE_SIGNOFF' ELSE verdict END AS verdict, coalesce(gaps, 0) AS gaps FROM {_VERDICT} v LEFT JOIN (SELECT script_id, count(*) AS gaps FROM {B.GAPS} g GROUP BY script_id) USING (script_id)")
def g5_cap_verdict(spark, d):
    return FI.cap_verdict(FI.verdict(_findings(spark, d)), B.rows(spark, d, B.GAPS))


@query(f"SELECT script_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, coalesce(string_agg(DISTINCT object, ',' ORDER BY object) FILTER (irreversible), '') AS irreversible FROM {B.GAPS} g GROUP BY script_id")
def g6_gap_summary(spark, d):
    return FI.gap_summary(B.rows(spark, d, B.GAPS))


@query(f"SELECT script_id, code, ['low','medium','high','blocker'][max({_RANK})] AS severity FROM {_F} f GROUP BY script_id, code")
def w2_highest_per_code(spark, d):
    return FI.highest_per_code(_findings(spark, d))


@query(f"SELECT script_id, kind, object, min(seq) AS seq FROM {B.GAPS} g GROUP BY script_id, kind, object")
def w3_first_gap(spark, d):
    return FI.first_gap(B.rows(spark, d, B.GAPS)).select("script_id", "kind", "object", "seq")


@query(f"SELECT script_id, seq, CASE WHEN irreversible THEN 'IRREVERSIBLE - ' ELSE '' END || kind || ': ' || object AS gate FROM {B.GAPS} g")
def d1_signoff_gates(spark, d):
    return FI.signoff_gates(B.rows(spark, d, B.GAPS))


@query(f"SELECT script_id, idx, bool_or(kind = 'set_not_null') OVER (PARTITION BY script_id, tbl, col) AS sealed FROM {B.OPS} o WHERE col IS NOT NULL")
def w5_later_not_null(spark, d):
    w = Window.partitionBy("script_id", "tbl", "col")
    return _ops(spark, d).where("col is not null").select("script_id", "idx", F.max(F.col("kind") == "set_not_null").over(w).alias("sealed"))


_PROBLEMS = f"(SELECT script_id, 'broken ' || query_id AS problem FROM {_BROKEN} b UNION ALL SELECT script_id, 'lost o_orderdate' FROM {_DRIFT} e UNION ALL SELECT script_id, obj FROM {_FAILED} x WHERE n > 0)"


@query(f"SELECT s.script_id, coalesce(n, 0) AS problems, coalesce(few, '') AS \"first\", n IS NULL AS verified FROM (SELECT DISTINCT o_custkey AS script_id FROM orders) s LEFT JOIN (SELECT script_id, count(*) AS n, array_to_string(list_sort(list(problem))[:3], ',') AS few FROM {_PROBLEMS} p GROUP BY script_id) USING (script_id)")
def l5_verification(spark, d):
    e = EV.measure(_ops(spark, d), B.rows(spark, d, B.LOG), _tables(spark, d), _VIEWS)
    say = lambda df, problem: df.select("script_id", problem.alias("problem"))
    scripts = table(spark, d, "orders").select(F.col("o_custkey").alias("script_id"))
    return FI.verification(scripts, say(e.broken, F.concat(F.lit("broken "), "query_id")), say(e.drift.where(F.size("removed") > 0), F.concat(F.lit("lost "), F.array_join("removed", ","))), say(e.data.where("violations > 0"), F.col("check")))


@query(f"SELECT DISTINCT code AS hazard_code, obj AS tables FROM {_F} f WHERE severity = 'blocker' AND NOT EXISTS (SELECT 1 FROM {B.INCIDENTS} i WHERE i.hazard_code = f.code AND i.obj = f.obj)")
def o_learn_record_learning(spark, d):
    return record_learning(_findings(spark, d), _incidents(spark, d)).select("hazard_code", "tables")


# ---- gaps ----------------------------------------------------------------------------------------------------------
def _gap(kind: str, obj: str, where: str, frm: str = f"{B.OPS} o", seq: str = "idx", inferred: str = "false", irreversible: str = "false") -> str:
    return f"SELECT script_id, CAST({seq} AS BIGINT) AS seq, '{kind}' AS kind, {obj} AS object, {inferred} AS inferred, {irreversible} AS irreversible FROM {frm} WHERE {where}"


_K1 = _gap("unmodelled_statement", "coalesce(tbl, 'unknown')", "kind IN ('unsupported', 'unknown_alter', 'unknown_alter_column', 'maintenance_rewrite')")
_ERASED = f"(SELECT DISTINCT a.script_id, a.tbl, a.c AS col FROM {B.OPS} a JOIN {B.OPS} b ON a.script_id = b.script_id AND a.tbl = b.tbl AND b.col = a.c AND b.kind = 'set_not_null' WHERE a.kind = 'dml_update' AND a.sql LIKE '%IS NULL')"
_K2 = _gap("in_place_data_mutation", "CASE WHEN kind = 'dml_update' THEN tbl || '.' || c ELSE tbl END", f"kind = 'dml_delete' OR (kind = 'dml_update' AND NOT EXISTS (SELECT 1 FROM {_ERASED} e WHERE e.script_id = o.script_id AND e.tbl = o.tbl AND e.col = o.c))")
_K3 = _gap("value_class_erased", "tbl || '.' || col", "true", f"{_ERASED} e", "-1", irreversible="true")
_K8 = _gap("unruled_statement", "tbl || ':' || kind", "kind IN ('set_default', 'drop_default', 'drop_not_null', 'dml_insert', 'validate_constraint')")


def _erased(spark, d):
    return R.erased_nulls(_ops(spark, d))


@query(_K1)
def k1_unmodelled(spark, d):
    return R.unmodelled(_ops(spark, d))


@query(_K2)
def k2_in_place_mutation(spark, d):
    return R.in_place_mutation(_ops(spark, d), _erased(spark, d))


@query(_K3)
def k3_value_class_erased(spark, d):
    return R.value_class_erased(_erased(spark, d))


_SAMPLES = {"lineitem": "l_orderkey % 1000 = 1", "orders": "o_orderkey % 100 = 1", "part": "p_partkey % 100 = 1", "customer": "c_custkey < 0"}
_SEEN = "(" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {'count(*) FILTER (length(CAST(v AS VARCHAR)) > 8 AND seen)' if c in _TEXTUAL else '0'} AS long, count(*) FILTER (seen) < count(*) AS part FROM (SELECT {_VALUE(c)} AS v, {_SAMPLES.get(t, 'true')} AS seen FROM {t})" for t, c in _COLUMNS) + ")"


@query(f"SELECT DISTINCT o.script_id, CAST(-1 AS BIGINT) AS seq, 'fixture_bounded_value_scan' AS kind, o.t || '.' || o.c AS object, false AS inferred, true AS irreversible FROM {B.OPS} o JOIN {_SEEN} f ON f.t = o.t AND f.c = o.c WHERE kind = 'alter_type' AND long = 0 AND part")
def k4_bounded_scan(spark, d):
    """Type changes judged on samples of the tables: the gap is where the sample is clean and the table has more rows."""
    return R.bounded_scan(EV.scan_tables(_ops(spark, d).where("kind = 'alter_type'"), _tables(spark, d), _SAMPLES).bounded)


_WORDS = f"(SELECT DISTINCT unnest(regexp_extract_all(lower(sql), '[a-z_][a-z_0-9]*')) AS token FROM {B.LOG} q)"
_K5 = _gap("uncovered_object", "tbl || '.' || col", f"kind IN ({', '.join(map(repr, V.TOUCHING))}) AND col IS NOT NULL AND col NOT IN (SELECT token FROM {_WORDS} w)")


@query(_K5)
def k5_uncovered(spark, d):
    return R.uncovered(C.uncovered_objects(_ops(spark, d), B.rows(spark, d, B.LOG)))


_K6 = _gap("unused_access_path", "CASE WHEN c IN ('p_size', 's_name') THEN 'unknown(' || index_name || ')' ELSE t || '(' || c || ')' END", f"kind = 'drop_index' AND (c IN ('p_size', 's_name') OR (c IN ('p_name', 's_nationkey', 'o_orderdate', 'l_partkey') AND NOT EXISTS (SELECT 1 FROM {B.OPS} z WHERE z.script_id = o.script_id AND z.kind = 'create_index' AND z.t = o.t AND z.c = o.c)))")


@query(_K6)
def k6_unused_path(spark, d):
    return R.unused_path(RV.unused_drops(RV.access_paths(_ops(spark, d), B.rows(spark, d, B.LOG), _catalogue(spark, d))))


@query(f"SELECT script_id, CAST(idx AS BIGINT) AS seq, CASE WHEN kind = 'unsupported' THEN 'unattributed_statement' ELSE 'procedural_body' END AS kind, 'statement ' || CAST(idx AS VARCHAR) AS object, kind = 'procedural_block' AS irreversible FROM {_LOOSE} l WHERE kind IN ('unsupported', 'procedural_block')")
def k7_unattributed(spark, d):
    """Change events of statements that have no model are held back, so that no event claims them."""
    statements = materialize(CE.split_scripts(_scripts(spark, d)))
    claimed = RV.claims(statements, change_events(statements).where("kind <> 'unsupported'"))
    return R.unattributed(claimed).select("script_id", "seq", "kind", "object", "irreversible")


@query(_K8)
def k8_unruled(spark, d):
    return R.unruled(_ops(spark, d))


@query(f"SELECT script_id, kind, object, min(seq) AS seq FROM ({' UNION ALL '.join((_K1, _K2, _K3, _K5, _K8))}) g GROUP BY script_id, kind, object")
def k_gap_ledger(spark, d):
    o, e = _ops(spark, d), _erased(spark, d)
    every = (R.statement_gaps(o), R.in_place_mutation(o, e), R.value_class_erased(e), R.uncovered(C.uncovered_objects(o, B.rows(spark, d, B.LOG))))
    return R.gap_ledger(*every).select("script_id", "kind", "object", "seq")


# ---- plans ---------------------------------------------------------------------------------------------------------
_STEPS = f"(SELECT script_id, CASE idx % 3 WHEN 0 THEN 'phase1' WHEN 1 THEN 'phase2' ELSE 'rollback' END AS phase, idx AS seq, kind, sql, t AS object FROM {B.OPS} o)"
_GATES = f"(SELECT script_id, 'Confirm ' || upper(t) || ' is unused' AS text FROM {B.OPS} o WHERE idx % 4 = 0)"
_CODE = f"(SELECT script_id, 'start reading ' || t AS text FROM {B.OPS} o WHERE idx % 2 = 0)"
_GATED = f"EXISTS (SELECT 1 FROM {_GATES} g WHERE g.script_id = s.script_id AND contains(lower(g.text), s.object))"
_J15 = f"SELECT script_id, seq, object FROM {_STEPS} s WHERE phase = 'phase2' AND kind IN ('drop_column', 'drop_table', 'rename_column', 'rename_table') AND NOT {_GATED}"
_J16 = f"SELECT script_id, seq, object FROM {_STEPS} s WHERE phase = 'rollback' AND kind IN ('drop_column', 'drop_table') AND EXISTS (SELECT 1 FROM {_CODE} c WHERE c.script_id = s.script_id AND contains(c.text, s.object)) AND NOT {_GATED}"


@query(_J15)
def j15_ungated_steps(spark, d):
    return A.ungated_steps(B.rows(spark, d, _STEPS), B.rows(spark, d, _GATES))


@query(_J16)
def j16_rollback_conflicts(spark, d):
    return A.rollback_conflicts(*(B.rows(spark, d, x) for x in (_STEPS, _CODE, _GATES)))


@query(f"SELECT script_id, 'UNGATED_STEP' AS code, seq, object FROM ({_J15}) a UNION ALL SELECT script_id, 'ROLLBACK_CONFLICT', seq, object FROM ({_J16}) b")
def d2_plan_findings(spark, d):
    return A.plan_findings(*(B.rows(spark, d, x) for x in (_STEPS, _CODE, _GATES)))


_K9 = _gap("unruled_generated_statement", "tbl || ':' || kind", "kind IN ('set_default', 'drop_default', 'drop_not_null', 'dml_insert', 'validate_constraint')")


@query(f"{_K9} AND tbl IS NOT NULL UNION ALL SELECT script_id, seq, 'audit_gate_text_only', object, false, false FROM {_STEPS} s WHERE phase = 'phase2' AND kind IN ('drop_column', 'drop_table', 'rename_column', 'rename_table') AND {_GATED}")
def k9_plan_gaps(spark, d):
    return A.plan_gaps(B.rows(spark, d, _STEPS), B.rows(spark, d, _GATES))


# ---- replay --------------------------------------------------------------------------------------------------------
READS = [
    ("q0", "SELECT * FROM customer WHERE c_custkey = 7"), ("q1", "SELECT c_name, c_acctbal FROM customer WHERE c_nationkey IN (1, 2, 3)"), ("q2", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    ("q3", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 20"), ("q4", "SELECT c_mktsegment, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"), ("q5", "SELECT x FROM nowhere"),
    ("q6", "SELECT x.c_name FROM customer x WHERE x.c_nationkey = 4 -- by alias"), ("q7", "SELECT o.o_orderkey, c.c_name FROM orders o, customer AS c WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = 5;"),
    ("q8", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_name FROM big, customer WHERE o_custkey = c_custkey AND t > 500000"), ("q9", "SELECT who, '{orders}' AS note FROM open_orders WHERE o_orderkey > 100"),
    ("q10", "SELECT (SELECT max(c_custkey) FROM customer) AS top, o.* FROM (SELECT * FROM orders) o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 6)"), ("q11", "DROP TABLE customer"),
]
OPEN_ORDERS = {"open_orders": "SELECT o_orderkey, o_custkey AS who FROM orders WHERE o_orderstatus = 'O'"}


def _shapes(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return {"customer": c, "orders": o}, {"customer": c.withColumnRenamed("c_acctbal", "balance"), "orders": o.where("o_orderstatus <> 'P'").drop("o_orderpriority")}


_BEFORE = """SELECT 'q0' AS query_id, count(*) AS n FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'q1', count(*) FROM customer WHERE c_nationkey IN (1, 2, 3) UNION ALL SELECT 'q2', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'q3', least(20, count(*)) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'q4', count(DISTINCT c_mktsegment) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'q6', count(*) FROM customer WHERE c_nationkey = 4
UNION ALL SELECT 'q7', count(*) FROM orders, customer WHERE o_custkey = c_custkey AND c_nationkey = 5 UNION ALL SELECT 'q8', count(*) FROM (SELECT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey HAVING sum(o_totalprice) > 500000)
UNION ALL SELECT 'q9', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 100 UNION ALL SELECT 'q10', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 6 UNION ALL SELECT '__view__open_orders', count(*) FROM orders WHERE o_orderstatus = 'O'"""


@query(f"SELECT query_id, true AS ok, '' AS error, n AS rows FROM ({_BEFORE}) b UNION ALL SELECT 'q5', false, 'TABLE_OR_VIEW_NOT_FOUND', 0 UNION ALL SELECT 'q11', false, 'PARSE_SYNTAX_ERROR', 0")
def o_replay(spark, d):
    return RE.replay(spark, READS, _shapes(spark, d)[0], views=OPEN_ORDERS).select("query_id", "ok", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("rows", F.lit(0)).alias("rows"))


@query(f"SELECT query_id, sql NOT LIKE 'SELECT c_name%' AS ok FROM {B.LOG} q WHERE sql LIKE 'SELECT%'")
def o_replay_log(spark, d):
    """Every read of the log on the new shapes: one analysis for each shape of statement, joined back on Spark."""
    return _log_outcomes(spark, d, B.rows(spark, d, B.LOG), _tables(spark, d) | _shapes(spark, d)[1])


@query("SELECT * FROM (SELECT 'q0' AS query_id, 'c_acctbal' AS removed, 'balance' AS added, false AS reordered UNION ALL SELECT 'q10', 'o_orderpriority', '', false) x")
def o_diff_column_drift(spark, d):
    a, b = _shapes(spark, d)
    return RE.column_drift(RE.replay(spark, READS, a, False, OPEN_ORDERS), RE.replay(spark, READS, b, False, OPEN_ORDERS))


@query(f"SELECT query_id, 'o_orderpriority' AS removed, 'priority' AS added FROM {B.LOG} q WHERE sql LIKE 'SELECT * FROM orders%'")
def o_diff_log_drift(spark, d):
    """Columns that every read of the log loses and gains: one analysis for each shape of statement on either side, joined back on Spark."""
    log, t = B.rows(spark, d, B.LOG), _tables(spark, d)
    shapes = RE.read_shapes(log)
    texts = [(str(r["query_id"]), r["sql"]) for r in shapes.select("query_id", "sql").collect()]
    drift = RE.column_drift(RE.replay(spark, texts, t, False), RE.replay(spark, texts, t | {"orders": t["orders"].withColumnRenamed("o_orderpriority", "priority")}, False))
    return RE.log_drift(log, drift.join(shapes.select("shape", F.col("query_id").cast("string").alias("query_id")), "query_id"))


_AFTER = "UNION ALL ".join(x for x in re.sub(r"(?i)\bfrom orders\b", "FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') orders", _BEFORE).split("UNION ALL ") if "'q1'" not in x and "'q3'" not in x)


@query(f"SELECT query_id, b.n AS before, a.n AS after FROM ({_BEFORE}) b JOIN ({_AFTER}) a USING (query_id) WHERE a.n <> b.n")
def o_diff_rowcount_drift(spark, d):
    a, b = _shapes(spark, d)
    return RE.rowcount_drift(RE.replay(spark, READS, a, views=OPEN_ORDERS), RE.replay(spark, READS, b, views=OPEN_ORDERS))


_LOOKUPS = """(SELECT event_id AS query_id, event_type || '-svc' AS service, user_id,
  CASE event_id % 4
    WHEN 0 THEN 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ' || CAST(user_id AS STRING)
    WHEN 1 THEN 'SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey = ' || CAST(user_id AS STRING) || ' AND o_orderstatus = ''F'''
    WHEN 2 THEN 'SELECT o_orderkey FROM open_orders WHERE who = ' || CAST(user_id AS STRING) || ' LIMIT 3'
    ELSE 'SELECT p_name FROM part WHERE p_partkey = ' || CAST(user_id AS STRING) END AS sql
  FROM events)"""
_ROW_CHANGES = [
    "DELETE FROM orders WHERE o_orderstatus = 'P'", "UPDATE orders SET o_orderstatus = 'F' WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
    "CREATE OR REPLACE VIEW open_orders AS SELECT o_orderkey, o_custkey AS who FROM orders", "ALTER TABLE customer ADD COLUMN z int; DELETE FROM customer WHERE c_acctbal < 0", "-- the same\nDELETE FROM orders WHERE o_orderstatus = 'P'",
]
_OWN = """(SELECT c_custkey, max(c_acctbal) AS bal, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS u
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"""
#: script, form, rows before and after
_COUNTS = [(0, 0, "n", "n - p"), (4, 0, "n", "n - p"), (1, 1, "f", "f + u"), (3, 1, "f", "CASE WHEN bal < 0 THEN 0 ELSE f END"), (1, 2, "least(3, o)", "least(3, o - u)"), (2, 2, "least(3, o)", "least(3, n)")]


@query(" UNION ALL ".join(f"SELECT {s} AS script_id, query_id, service, {a} AS before, {b} AS after FROM {_LOOKUPS} q JOIN {_OWN} c ON user_id = c_custkey WHERE query_id % 4 = {k} AND {a} <> {b}" for s, k, a, b in _COUNTS))
def o_diff_answer_counts(spark, d):
    """Every read of a log whose number of rows a script changes, with its own literals: an aggregation and a join for each form of reads and each state of the tables."""
    scripts = spark.createDataFrame(list(enumerate(_ROW_CHANGES)), "script_id long, text string")
    log = B.rows(spark, d, _LOOKUPS).select("query_id", "service", "sql")
    return EV.count_drift(change_events(CE.split_scripts(scripts)), log, _tables(spark, d), OPEN_ORDERS).rows


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS only_before, 0 AS only_after FROM orders")
def o_answer_drift(spark, d):
    o = table(spark, d, "orders")
    return RE.answer_drift(o, o.where("o_orderstatus <> 'P'"))


_CHANGED = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 1000 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 1000 <> 9 UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5000 = 11 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3000 = 5)"


@query("SELECT CASE WHEN k = 11 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN k = 11 THEN 0 ELSE 1 END AS before, CASE k WHEN 7 THEN 1 WHEN 9 THEN 0 WHEN 11 THEN 1 ELSE 2 END AS after FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 7 WHEN o_orderkey % 1000 = 9 THEN 9 WHEN o_orderkey % 5000 = 11 THEN 11 WHEN o_orderkey % 3000 = 5 THEN 5 END AS k FROM orders) WHERE k IS NOT NULL")
def o_answer_rows(spark, d):
    """Which keys' rows differ between two answers: changed, taken away, added, and repeated."""
    before = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return RE.answer_rows(before, B.rows(spark, d, _CHANGED), "o_orderkey", cells=256, few=200)


# ---- set operations ------------------------------------------------------------------------------------------------
@query(f"SELECT seq, CASE WHEN code <> family THEN code ELSE '' END AS removed, CASE WHEN code <> family THEN family ELSE '' END AS added FROM (SELECT seq, code, CASE WHEN severity = 'low' THEN code ELSE obj END AS family FROM {_F} f) x")
def u2_column_sets(spark, d):
    f = B.rows(spark, d, _F).select("seq", F.array("code").alias("a"), F.array(F.when(F.col("severity") == "low", F.col("code")).otherwise(F.col("obj"))).alias("b"))
    return f.select("seq", F.array_except("a", "b").alias("removed"), F.array_except("b", "a").alias("added"))


@query(f"SELECT DISTINCT script_id, code FROM {_F} f WHERE severity = 'high' INTERSECT SELECT DISTINCT script_id, code FROM {_F} f WHERE source = 'replay'")
def u3_code_sets(spark, d):
    f = B.rows(spark, d, _F)
    return f.where("severity = 'high'").select("script_id", "code").intersect(f.where("source = 'replay'").select("script_id", "code"))


@query(f"SELECT DISTINCT sql FROM {B.LOG} q WHERE sql LIKE 'SELECT *%' UNION SELECT 'SELECT * FROM ' || new_name FROM {B.OPS} o WHERE kind = 'create_view'")
def u4_corpus_and_views(spark, d):
    probes = _ops(spark, d).where("kind = 'create_view'").select(F.concat(F.lit("SELECT * FROM "), "new_name").alias("sql"))
    return B.rows(spark, d, B.LOG).where("sql like 'SELECT *%'").select("sql").union(probes).distinct()


_ODD = f"CASE WHEN sql LIKE 'UPDATE%' THEN 'dml_update' WHEN sql LIKE 'INSERT%' THEN 'dml_insert' ELSE 'unsupported ' || service END"


@query(f"SELECT DISTINCT {_ODD} AS kind, 'unclassified' AS side FROM {B.LOG} q WHERE sql LIKE 'SELECT%' UNION ALL SELECT kind, 'unseen' FROM (SELECT unnest([{', '.join(repr(k) for ks in V.BUCKETS.values() for k in ks)}]) AS kind) a WHERE kind NOT IN ('dml_update', 'dml_insert')")
def u5_exhaustiveness(spark, d):
    """Kinds of the log's statements, reads of each service under a name of their own, against the kinds that have a bucket."""
    kind = X.statement_kind(F.col("sql"))
    seen = B.rows(spark, d, B.LOG).select(F.when(kind == "unsupported", F.concat_ws(" ", kind, F.col("service"))).otherwise(kind).alias("kind"))
    return RU.exhaustiveness(seen, spark.createDataFrame([(k,) for ks in V.BUCKETS.values() for k in ks], "kind string"))


_PATH = "CAST(user_id AS STRING) || '/' || CAST(event_id % 50 AS STRING) AS path"


@query(f"SELECT {_PATH} FROM events WHERE event_type = 'click' EXCEPT SELECT {_PATH} FROM events WHERE event_type = 'error'".replace("AS STRING", "AS VARCHAR"))
def u6_only_in_one(spark, d):
    of = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).selectExpr(_PATH).distinct()
    return of("click").exceptAll(of("error"))


# ---- whole reviews -------------------------------------------------------------------------------------------------
@query(f"SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY idx) - 1 AS INTEGER) AS idx, kind, coalesce(tbl, '') AS tbl, coalesce(CASE WHEN kind = 'add_column' THEN c || '_new' ELSE col END, '') AS col, coalesce(new_name, '') AS new_name, coalesce(index_name, '') AS index_name FROM {B.OPS} o")
def p10_change_events(spark, d):
    o = change_events(CE.split_scripts(_scripts(spark, d)))
    return o.select("script_id", "idx", "kind", *(F.coalesce(c, F.lit("")).alias(c) for c in ("tbl", "col", "new_name", "index_name")))


_R7 = f"""SELECT o.script_id, idx AS seq, 'ACCESS_PATH_REMOVED' AS code, CASE WHEN k.tbl IS NULL THEN 'medium' WHEN coalesce(rows, 0) >= 5000000 AND top >= 3 THEN 'blocker' WHEN coalesce(rows, 0) >= 100000 THEN 'high' ELSE 'medium' END AS severity, coalesce(k.tbl || '.' || k.c, index_name) AS objects, '' AS services, '' AS evidence, 'static' AS source
FROM (SELECT * EXCLUDE (tbl) FROM {B.OPS} o WHERE kind = 'drop_index') o LEFT JOIN {_KNOWN} k ON k.name = o.index_name LEFT JOIN {_USE} u ON u.name = o.index_name LEFT JOIN {B.STATS} st ON st.tbl = k.tbl
WHERE k.tbl IS NULL OR (users IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {B.OPS} z WHERE z.script_id = o.script_id AND z.kind = 'create_index' AND z.t = o.t AND z.c = o.c))"""
_R9 = _finding("PROCEDURAL_DDL_UNREVIEWED", "'blocker'", "kind = 'procedural_block'", obj="CAST(idx AS VARCHAR)", frm=f"{B.OPS} o")
_R10 = _finding("INTEGRITY_CONSTRAINT_REMOVED", "'high'", "kind = 'drop_constraint'", obj="index_name", frm=f"{B.OPS} o")
_R12 = f"SELECT script_id, 0 AS seq, 'MISSING_ROLLBACK' AS code, 'medium' AS severity, 'rollback' AS objects, '' AS services, '' AS evidence, 'static' AS source FROM {_SCRIPTS} s WHERE script_id % 3 = 0"
_R6T = _R6.replace(_OBJ, "tbl || '.' || CASE WHEN kind = 'add_column' THEN c || '_new' ELSE col END")  # as the text names it
_STATIC = " UNION ALL ".join((_R1, _R2, _R3, _R4, _R5, _R6T, _R7, _R8, _R9, _R10, _R12))
_LOST = f"(SELECT script_id, string_agg(DISTINCT s, ',' ORDER BY s) AS services FROM (SELECT script_id, unnest(string_split(services, ',')) AS s FROM (SELECT script_id, services FROM {_BROKEN} b UNION ALL SELECT script_id, services FROM {_DRIFT} e)) WHERE s NOT IN ('click-svc', 'database') GROUP BY script_id)"
_R13 = _finding("CROSS_SERVICE_UNCOORDINATED", "'high'", "true", obj="services", services="services", ev="''", frm=f"{_LOST} c", seq="-1")
_FULL = " UNION ALL ".join((_STATIC, _R14, _R15, _R16, _R17, _R13))
_BOUND = _gap("fixture_bounded_value_scan", "obj", "lost OR (n = 0 AND more)", f"{_ASKED} a", "-1", irreversible="true")
_LAST = lambda kinds: f"last_value(CASE WHEN kind IN ({kinds}) THEN kind END IGNORE NULLS) {_BEFORE_T}"
_UNKNOWN = _gap("unresolved_relation", "CASE WHEN kind = 'drop_view' THEN new_name ELSE tbl END", "(tbl IS NOT NULL AND kind <> 'create_table' AND r IN ('drop_table', 'rename_table')) OR (kind = 'drop_view' AND (v = 'drop_view' OR (v IS NULL AND t <> 'orders')))", f"(SELECT *, {_LAST(_RESET[1:-1])} AS r, {_LAST(repr('create_view') + ', ' + repr('drop_view'))} AS v FROM {B.OPS} z) o")
_BODY = _gap("procedural_body", "CAST(idx AS VARCHAR)", "kind = 'procedural_block'")
_GAPS = " UNION ALL ".join((_K1, _K2, _K3, _K5, _K6, _K8, _BODY))


def _verdicts(findings: str, gaps: str) -> str:
    merged = f"(SELECT script_id, code, objects, max({_RANK}) AS r FROM ({findings}) u GROUP BY ALL)"
    counts = f"(SELECT script_id, max(r) AS top, count(*) FILTER (r = 4) AS blockers, count(*) FILTER (r = 3) AS highs FROM {merged} a GROUP BY script_id)"
    ledger = f"(SELECT script_id, count(*) AS gaps FROM (SELECT DISTINCT script_id, kind, object FROM ({gaps}) g) GROUP BY script_id)"
    return f"""SELECT s.script_id, CASE WHEN coalesce(top, 0) = 4 THEN 'BLOCK' WHEN coalesce(gaps, 0) > 0 THEN 'NEEDS_COVERAGE_SIGNOFF' WHEN top = 3 THEN 'SAFE_WITH_PLAN' ELSE 'SAFE' END AS verdict, coalesce(blockers, 0) AS blockers, coalesce(highs, 0) AS highs, coalesce(gaps, 0) AS gaps
FROM {_SCRIPTS} s LEFT JOIN {counts} f USING (script_id) LEFT JOIN {ledger} l USING (script_id)"""


def _with_rollback(scripts):
    return scripts.withColumn("rollback_sql", F.when(F.col("script_id") % 3 > 0, "undo"))


@query(_verdicts(_STATIC, _GAPS))
def review_fleet(spark, d):
    """Scripts as text against sizes, log and indexes: all rules that need no scan and no replay."""
    return RV.review(_with_rollback(_scripts(spark, d)), _stats(spark, d), B.rows(spark, d, B.LOG), _catalogue(spark, d)).drop("headline")


def _full(spark, d):
    """Scripts with comments, what they and the change events are, and everything that tables and log say about them."""
    scripts, log = _with_rollback(_remarked(spark, d)), B.rows(spark, d, B.LOG)
    read = RV.read_scripts(scripts)
    return scripts, log, read, EV.measure(read[1], log, _tables(spark, d), _VIEWS), scripts.select("script_id", F.lit("click-svc").alias("owner"))


@query(_verdicts(_FULL, f"{_GAPS} UNION ALL {_BOUND} UNION ALL {_UNKNOWN}"))
def review_full(spark, d):
    """All rules, with scans of the tables and a replay of the log; comments in the scripts change nothing."""
    scripts, log, read, evidence, owners = _full(spark, d)
    return RV.review(scripts, _stats(spark, d), log, _catalogue(spark, d), evidence=evidence, owners=owners, read=read).drop("headline")


_BLAST = f"""(SELECT script_id, sum(w) AS blast FROM (SELECT DISTINCT t.script_id, q.query_id, w FROM (SELECT query_id, CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END AS w, unnest(list_distinct(regexp_extract_all(lower(sql), '[a-z_][a-z_0-9]*'))) AS token FROM {B.LOG} q) q
  JOIN (SELECT DISTINCT script_id, unnest(list_concat([tbl, CASE WHEN kind = 'add_column' THEN c || '_new' ELSE col END, new_name], coalesce(string_split(CASE WHEN kind = 'dml_insert' THEN c WHEN sql LIKE '%FOREIGN KEY%' THEN c ELSE cols END, ','), []))) AS token FROM {B.OPS} o) t ON t.token = q.token) GROUP BY script_id)"""


@query(f"""SELECT v.script_id, CASE WHEN v.verdict <> 'BLOCK' AND d.n > 0 THEN 'NEEDS_COVERAGE_SIGNOFF' ELSE v.verdict END AS verdict, gaps, coalesce(d.n, 0) AS defects, CAST(coalesce(blast, 0) AS BIGINT) AS blast FROM ({_verdicts(_STATIC, _GAPS)}) v
LEFT JOIN (SELECT script_id, count(*) AS n FROM ({_J15} UNION ALL {_J16}) p GROUP BY script_id) d ON d.script_id = v.script_id LEFT JOIN {_BLAST} b ON b.script_id = v.script_id""")
def review_packet(spark, d):
    """Reviews of scripts as text with the audits of their plans, which cap verdicts once more, and the weight of who depends on them."""
    plans = (B.rows(spark, d, x) for x in (_STEPS, _CODE, _GATES))
    return RV.packet(_with_rollback(_scripts(spark, d)), _stats(spark, d), B.rows(spark, d, B.LOG), *plans, _catalogue(spark, d)).verdicts.select("script_id", "verdict", "gaps", "defects", "blast")


@query(f"SELECT code, severity, count(*) AS n FROM (SELECT script_id, code, objects, ['low', 'medium', 'high', 'blocker'][max({_RANK})] AS severity FROM ({_FULL}) u GROUP BY script_id, code, objects) v GROUP BY code, severity")
def u1_apply_rules(spark, d):
    """The union of all rules' findings, merged, counted by code and severity."""
    scripts, log, read, evidence, owners = _full(spark, d)
    found = RV.review_findings(scripts, *read, _stats(spark, d), log, _catalogue(spark, d), evidence=evidence, owners=owners)
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))
