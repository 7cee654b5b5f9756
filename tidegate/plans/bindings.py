"""How the given tables stand in for query logs, change events and findings: SQL that Spark and DuckDB read alike.

Text is derived row by row from the tables, so every binding grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import table

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations benchmark".split()


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a binding, with the names of given tables bound to the files in ``sf_dir``."""
    used = set()

    def name(m: re.Match) -> str:
        used.add(m[2].lower())
        return f"{m[1]} {{{m[2].lower()}}}"

    parts = sql.replace("{", "{{").replace("}", "}}").split("'")
    parts[::2] = [re.sub(rf"(?i)\b(from|join)\s+({'|'.join(TABLES)})\b", name, x) for x in parts[::2]]  # literals stay as they are
    return spark.sql("'".join(parts), **{t: table(spark, sf_dir, t) for t in sorted(used)})


def rows(spark: SparkSession, sf_dir: str, binding: str) -> DataFrame:
    return bind(spark, sf_dir, f"SELECT * FROM {binding} q")


LOG = """(SELECT event_id AS query_id, event_type || '-svc' AS service,
  CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'other' END AS criticality,
  CASE event_id % 6
    WHEN 0 THEN 'SELECT * FROM orders WHERE o_custkey = ' || CAST(user_id AS STRING)
    WHEN 1 THEN 'SELECT c_name, c_acctbal FROM customer  WHERE c_custkey = ' || CAST(user_id AS STRING) || ' ORDER BY c_name'
    WHEN 2 THEN 'SELECT o_orderstatus, count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = ''a'' GROUP BY o_orderstatus HAVING count(*) > ' || CAST(user_id AS STRING)
    WHEN 3 THEN 'UPDATE part SET p_size = ' || CAST(user_id AS STRING) || ', p_name = null WHERE p_size IS NULL AND p_brand = ''b'''
    WHEN 4 THEN 'INSERT INTO lineitem (l_orderkey, l_partkey) VALUES (1, ' || CAST(user_id AS STRING) || ')'
    ELSE 'SELECT l.l_partkey FROM lineitem l WHERE l.l_shipdate IN (''x'') LIMIT ' || CAST(user_id AS STRING) END AS sql
  FROM events)"""

#: kind, text, and which of table, column, new name and other name the change event carries
TEMPLATES = [
    ("add_column", "ALTER TABLE {t} ADD COLUMN {c}_new integer NOT NULL", "tc"), ("add_column", "ALTER TABLE {t} ADD COLUMN {c}_new text NOT NULL DEFAULT ''x''", "tc"),
    ("drop_column", "ALTER TABLE {t} DROP COLUMN {c}", "tc"), ("rename_column", "ALTER TABLE {t} RENAME COLUMN {c} TO {c}_v2", "tcn"), ("rename_table", "ALTER TABLE {t} RENAME TO {t}_v2", "tm"),
    ("alter_type", "ALTER TABLE {t} ALTER COLUMN {c} TYPE varchar(8)", "tc"), ("set_not_null", "ALTER TABLE {t} ALTER COLUMN {c} SET NOT NULL", "tc"), ("drop_not_null", "ALTER TABLE {t} ALTER COLUMN {c} DROP NOT NULL", "tc"),
    ("set_default", "ALTER TABLE {t} ALTER COLUMN {c} SET DEFAULT 0", "tc"), ("drop_default", "ALTER TABLE {t} ALTER COLUMN {c} DROP DEFAULT", "tc"), ("unknown_alter_column", "ALTER TABLE {t} ALTER COLUMN {c} SET STATISTICS 500", "tc"),
    ("add_constraint", "ALTER TABLE {t} ADD CONSTRAINT {c}_chk CHECK (coalesce({c}, nullif({c}, {c})) IS NOT NULL)", "tx"), ("add_constraint", "ALTER TABLE {t} ADD CONSTRAINT {c}_fk FOREIGN KEY ({c}) REFERENCES region NOT VALID", "ty"),
    ("drop_constraint", "ALTER TABLE {t} DROP CONSTRAINT {c}_chk", "tx"), ("validate_constraint", "ALTER TABLE {t} VALIDATE CONSTRAINT {c}_fk", "ty"), ("unknown_alter", "ALTER TABLE {t} OWNER TO admin", "t"),
    ("create_index", "CREATE INDEX {c}_idx ON {t} ({c})", "ti"), ("create_index", "CREATE INDEX CONCURRENTLY {c}_big ON {t} ({c}, id)", "tj"), ("drop_index", "DROP INDEX {c}_idx", "i"), ("create_view", "CREATE OR REPLACE VIEW {t}_view AS SELECT * FROM {t}", "v"), ("drop_view", "DROP VIEW {t}_view", "v"),
    ("drop_table", "DROP TABLE {t}", "t"), ("create_table", "CREATE TABLE {t} (id int)", "t"), ("dml_update", "UPDATE {t} SET {c} = 0 WHERE {c} IS NULL", "t"), ("dml_delete", "DELETE FROM {t} WHERE {c} IS NULL", "t"), ("dml_insert", "INSERT INTO {t} ({c}) VALUES (1)", "t"),
    ("procedural_block", "DO $$ BEGIN DROP TABLE {t}; END $$", ""), ("maintenance_rewrite", "VACUUM FULL {t}", "t"), ("unsupported", "COMMENT ON TABLE {t} IS ''x''", ""), ("transaction_control", "BEGIN", ""), ("transaction_control", "COMMIT", ""),
    ("dml_update", "UPDATE {t} SET {c} = 0 WHERE id BETWEEN 1 AND 9", "t"), ("create_index", "CREATE UNIQUE INDEX CONCURRENTLY {c}_uq ON {t} ({c})", "tq"),
]


def _template(kind: str, text: str, has: str) -> tuple:
    """A change event with {t} and {c} for its table and column: kind, text, table, column, new name, other name, an index's columns."""
    pick = lambda d: next((v for h, v in d.items() if h in has), None)
    names = {"x": "{c}_chk", "y": "{c}_fk", "i": "{c}_idx", "j": "{c}_big", "q": "{c}_uq"}
    column = "{c}_new" if kind == "add_column" else "{c}"
    listed = {"i": "{c}", "j": "{c},id", "q": "{c}"} if kind == "create_index" else {}
    return kind, text, pick({"t": "{t}"}), column if "c" in has else None, pick({"n": "{c}_v2", "m": "{t}_v2", "v": "{t}_view"}), pick(names), pick(listed)


def _ops() -> str:
    """The templates as rows, joined to orders by number: each order is a statement of its customer's script."""
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    values = ", ".join(f"({k}, {', '.join(map(quoted, _template(*x)))})" for k, x in enumerate(TEMPLATES))
    fill = lambda c: f"replace(replace({c}_, '{{t}}', t), '{{c}}', c) AS {c}"
    return f"""(SELECT script_id, idx, kind, {', '.join(map(fill, ("sql", "tbl", "col", "new_name", "index_name", "cols")))}, t, c
  FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN CASE b WHEN 0 THEN 'c_custkey' ELSE 'c_name' END WHEN 1 THEN CASE b WHEN 0 THEN 'o_custkey' ELSE 'o_orderdate' END WHEN 2 THEN CASE b WHEN 0 THEN 'l_partkey' ELSE 'l_shipdate' END
      WHEN 3 THEN CASE b WHEN 0 THEN 'p_name' ELSE 'p_size' END ELSE CASE b WHEN 0 THEN 's_name' ELSE 's_nationkey' END END AS c
    FROM (SELECT o_custkey AS script_id, o_orderkey AS idx, o_orderkey, o_orderkey % 2 AS b, (o_orderkey * 7 + o_custkey * 3 + CAST(floor(o_orderkey / 32) AS BIGINT)) % {len(TEMPLATES)} AS k,
      CASE o_orderkey % 5 WHEN 0 THEN 'customer' WHEN 1 THEN 'orders' WHEN 2 THEN 'lineitem' WHEN 3 THEN 'part' ELSE 'supplier' END AS t FROM orders) z0) z1
  JOIN (VALUES {values}) AS tpl(n, kind, sql_, tbl_, col_, new_name_, index_name_, cols_) ON k = n)"""


OPS = _ops()


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events with an index's columns and a new type, as ``change_events`` gives them, and t and c: the table and column they are about."""
    o = rows(spark, sf_dir, OPS)
    return o.withColumns({"columns": F.coalesce(F.split("cols", ","), F.array().cast("array<string>")), "new_type": F.when(F.col("kind") == "alter_type", "varchar(8)")}).drop("cols")


#: sizes as measured
STATS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS rows FROM {t}" for t in ("customer", "orders", "lineitem", "part", "supplier")) + ")"

CODES = ["BREAKING_QUERY", "SELECT_STAR_DRIFT", "INDEX_LOCK_NO_CONCURRENT", "NOT_NULL_NO_DEFAULT", "MISSING_ROLLBACK", "ACCESS_PATH_REMOVED", "PROCEDURAL_DDL_UNREVIEWED"]


def _case(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


SEVERITY = ["low", "medium", "high", "blocker"]
FINDINGS = f"""(SELECT o_custkey AS script_id, o_orderkey AS seq, {_case("(o_orderkey * 3 + o_custkey) % 7", CODES)} AS code, {_case("o_orderkey % 4", SEVERITY)} AS severity,
  {_case("o_orderkey % 3", ["customer", "orders", "part"])} AS obj, o_orderpriority AS service, 'e' || CAST(o_orderkey % 11 AS STRING) AS ev, CASE WHEN o_orderkey % 3 = 0 THEN 'replay' ELSE 'static' END AS source FROM orders)"""
INCIDENTS = f"""(SELECT 'inc' || CAST(n_nationkey AS STRING) AS id, {_case("n_nationkey % 7", CODES)} AS hazard_code, {_case("n_nationkey % 4", ["customer", "orders", "lineitem", "supplier"])} AS obj,
  {_case("n_nationkey % 5", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])} AS service, n_nationkey % 3 AS severity_bump FROM nation)"""
GAPS = f"""(SELECT o_custkey AS script_id, o_orderkey AS seq, {_case("o_orderkey % 3", ["unmodelled_statement", "in_place_data_mutation", "value_class_erased"])} AS kind,
  {_case("o_custkey % 4", ["customer", "orders", "part", "lineitem"])} AS object, o_orderkey % 3 = 2 AS irreversible FROM orders WHERE o_orderstatus = 'O')"""
TRUTH = f"""(SELECT doc_id AS case_id, CASE WHEN quality = 0 THEN 'BREAKING_QUERY' ELSE 'MISSING_ROLLBACK' END AS code, CASE WHEN toxic = 1 THEN 'blocker' ELSE 'medium' END AS severity FROM labels
  UNION ALL SELECT doc_id, 'NOT_NULL_NO_DEFAULT', 'high' FROM labels WHERE toxic = 1)"""
CASES = """(SELECT doc_id AS case_id, 'arm' || CAST(a AS STRING) AS arm, toxic = 1 AS blocking,
  CASE WHEN (doc_id + a) % 3 = 0 THEN 'BLOCK' WHEN (doc_id + a) % 3 = 1 THEN 'SAFE_WITH_PLAN' ELSE 'SAFE' END AS verdict, (doc_id + a) % 2 = 0 AS plan_verified, (doc_id + a) % 4 AS human_gates
  FROM labels, (SELECT 0 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) z)"""
PREDICTED = f"""(SELECT doc_id AS case_id, 'arm' || CAST(a AS STRING) AS arm, {_case("(doc_id + i * 3 + a) % 4", ["BREAKING_QUERY", "VIEW_BREAKAGE", "MISSING_ROLLBACK", "NOT_NULL_NO_DEFAULT"])} AS code, {_case("(doc_id + i + a) % 4", SEVERITY)} AS severity, (doc_id + i) % 3 <> 0 AS evidenced
  FROM labels, (SELECT 0 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) z, (SELECT 0 AS i UNION ALL SELECT 1) y WHERE (doc_id + a + i) % 5 <> 0)"""
TRACE = """(SELECT conv_id AS run, turn AS seq, role AS kind, text, CAST(turn * 10 + conv_id % 7 AS DOUBLE) AS t_ms, CAST(length(text) % 13 AS DOUBLE) AS ms FROM conversations)"""
CALLS = """(SELECT conv_id * 1000 + turn AS call_id, conv_id % 5 AS run, CASE WHEN conv_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, text AS key, length(text) AS tokens_in, length(text) % 17 AS tokens_out, CAST(turn AS DOUBLE) / 4 AS cost FROM conversations)"""
RUNS = """(SELECT doc_id AS case_id, 'p' || CAST(doc_id % 3 AS STRING) AS provider, CASE WHEN toxic = 1 THEN 'off' ELSE 'structural' END AS mode, CASE WHEN quality = 0 THEN 'BLOCK' ELSE 'SAFE' END AS verdict, doc_id % 7 AS gaps, doc_id % 11 = 0 AS crashed, doc_id % 5 = 0 AS surface_changed, doc_id % 4 = 0 AS model_written, doc_id % 9 = 0 AS misleading, doc_id % 6 = 0 AS flagged FROM labels)"""
