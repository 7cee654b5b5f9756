"""Queries for sources, pre-flight checks and changes applied to tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.operators import findings as FI
from tidegate.operators import footers as FO
from tidegate.operators import migrate as M
from tidegate.operators import preflight as P
from tidegate.operators import rules as R
from tidegate.plans import bindings as B
from tidegate.plans.registry import query
from tidegate.session import shared_dir, table
from tidegate.sources import io


@query("""SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS rejected, (SELECT string_agg(key, ',' ORDER BY key) FROM (SELECT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 ORDER BY key LIMIT 5)) AS samples
FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def a1_check_unique(spark, d):
    return P.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT 'quality_not_null' AS "check", count(*) FILTER (quality IS NULL) AS violations FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'toxic_not_null', count(*) FILTER (toxic IS NULL) FROM documents LEFT JOIN labels USING (doc_id)""")
def a2_check_not_null(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return P.check_not_null(joined, ["quality", "toxic"])


@query("""SELECT 'small' AS "check", count(*) FILTER (NOT (l_quantity < 40)) AS violations FROM lineitem UNION ALL SELECT 'cheap', count(*) FILTER (NOT (nullif(l_extendedprice, 0) < 90000)) FROM lineitem""")
def a3_check_predicate(spark, d):
    return P.check_predicate(table(spark, d, "lineitem"), {"small": "l_quantity < 40", "cheap": "nullif(l_extendedprice, 0) < 90000"})


@query("SELECT count(*) AS rows, count(*) AS without_value, CASE WHEN count(*) > 0 THEN 'blocker' END AS severity FROM orders")
def a4_check_new_column(spark, d):
    return P.check_new_column(table(spark, d, "orders"), True, None)


_WIDE = "l_extendedprice IS NOT NULL AND abs(l_extendedprice) >= 100000"


@query(f"""SELECT count(*) AS rows_checked, count(*) FILTER ({_WIDE}) AS offending_rows, true AS narrowing, CASE WHEN count(*) FILTER ({_WIDE}) > 0 THEN 'blocker' ELSE 'medium' END AS severity,
(SELECT coalesce(string_agg(v, ',' ORDER BY v), '') FROM (SELECT CAST(l_extendedprice AS VARCHAR) AS v FROM lineitem WHERE {_WIDE} ORDER BY l_extendedprice DESC, v LIMIT 5)) AS samples FROM lineitem""")
def a5_check_narrowing(spark, d):
    return P.check_narrowing(table(spark, d, "lineitem"), "l_extendedprice", "numeric(12,2)", "numeric(7,2)")


_FITS = {"l_extendedprice": ("numeric(7,2)", "abs(l_extendedprice) >= 100000"), "l_tax": ("integer", "l_tax <> floor(l_tax)"), "l_quantity": ("numeric(12,2)", "abs(l_quantity) >= 10000000000"), "l_discount": ("numeric(1)", "abs(l_discount) >= 10")}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "check", count(*) FILTER ({bad}) AS violations, CASE WHEN count(*) FILTER ({bad}) > 0 THEN 'blocker' ELSE 'medium' END AS severity FROM lineitem""" for c, (_, bad) in _FITS.items()))
def a6_narrowing_severity(spark, d):
    found = P.preflight(table(spark, d, "lineitem"), {c: F.count_if(X.offends(F.col(c), new, False)) for c, (new, _) in _FITS.items()})
    return found.withColumn("severity", P.narrowing_severity(F.col("violations")))


@query(f"""SELECT count(*) FILTER (l_orderkey % 1000 = 1) AS sample_rows, count(*) FILTER (l_orderkey % 1000 = 1 AND {_WIDE}) AS sample_offending, count(*) AS table_rows, count(*) FILTER ({_WIDE}) AS table_offending,
count(*) FILTER (l_orderkey % 1000 = 1 AND {_WIDE}) = 0 AND count(*) FILTER (l_orderkey % 1000 = 1) < count(*) AS bounded FROM lineitem""")
def a7_sample_vs_full(spark, d):
    return P.sample_vs_full(table(spark, d, "lineitem"), F.col("l_orderkey") % 1000 == 1, "l_extendedprice", "numeric(7,2)")


@query(f"""SELECT 'l_comment_like' AS "check", count(*) FILTER (nullif(l_returnflag, 'N') IS NULL) AS violations FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (NOT (l_discount <= 0.05)) FROM lineitem
UNION ALL SELECT 'fits', count(*) FILTER ({_WIDE}) FROM lineitem UNION ALL SELECT 'whole', count(*) FILTER (l_tax <> floor(l_tax)) FROM lineitem""")
def a8_preflight(spark, d):
    li = table(spark, d, "lineitem")
    return P.preflight(li, {"l_comment_like": F.count_if(F.nullif(F.col("l_returnflag"), F.lit("N")).isNull()), "discount": P.violation("l_discount <= 0.05"), "fits": F.count_if(X.offends(F.col("l_extendedprice"), "numeric(7,2)", False)), "whole": F.count_if(X.offends(F.col("l_tax"), "integer", False))})


@query(f"""SELECT DISTINCT a.script_id, a.tbl, a.c AS col, CASE a.c WHEN 'p_name' THEN (SELECT count(*) FILTER (p_name LIKE '%a%') FROM part) ELSE 0 END AS null_rows, true AS irreversible
FROM (SELECT * FROM {B.OPS} o WHERE kind = 'dml_update' AND tbl = 'part' AND sql LIKE '%IS NULL') a JOIN (SELECT * FROM {B.OPS} o WHERE kind = 'set_not_null') b ON a.script_id = b.script_id AND a.tbl = b.tbl AND a.c = b.col""")
def a9_null_erasure(spark, d):
    part = table(spark, d, "part").withColumn("p_name", F.when(~F.col("p_name").contains("a"), F.col("p_name")))
    return P.null_erasure(part, "part", B.ops(spark, d))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS touched, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') / greatest(count(*), 1) AS share FROM orders")
def a10_mutation_reach(spark, d):
    return P.mutation_reach(table(spark, d, "orders"), "o_orderstatus = 'F'")


@query(f"SELECT query_id, 'lineitem' AS tbl, col FROM {B.LOG} q, (SELECT 'l_suppkey' AS col UNION ALL SELECT 'l_quantity') c WHERE sql LIKE 'INSERT%'")
def a11_inserts_missing_required(spark, d):
    columns = spark.createDataFrame([("lineitem", "l_orderkey", True), ("lineitem", "l_suppkey", True), ("lineitem", "l_quantity", True), ("lineitem", "l_tax", False)], "tbl string, col string, required boolean")
    return P.inserts_missing_required(B.rows(spark, d, B.LOG), columns)


@query("""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS orphans, count(*) AS keys FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey)""")
def o_fk_check_foreign_key(spark, d):
    return P.check_foreign_key(table(spark, d, "lineitem"), table(spark, d, "part").where("p_size > 10"), "l_partkey", "p_partkey")


@query("SELECT count(*) FILTER (l_orderkey NOT BETWEEN -32768 AND 32767) AS outside FROM lineitem")
def o_range_check_int_range(spark, d):
    return P.check_int_range(table(spark, d, "lineitem"), "l_orderkey", "smallint")


# ---- sources -------------------------------------------------------------------------------------------------------
def _cases(spark, d):
    """Case documents made of orders: a case for each customer, with a corpus and row estimates."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("service"), F.lit("low").alias("criticality"), F.lit("").alias("label"), F.concat(F.lit("SELECT "), F.col("o_orderkey").cast("string")).alias("sql"))).alias("queries"), F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")), F.col("o_orderkey")))).alias("row_estimates"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS case_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS service, 'low' AS criticality, '' AS label, 'SELECT ' || CAST(o_orderkey AS VARCHAR) AS sql FROM orders")
def s2_explode_corpus(spark, d):
    return io.explode_corpus(_cases(spark, d))


@query("SELECT CAST(o_custkey AS VARCHAR) AS case_id, 't' || CAST(o_orderkey AS VARCHAR) AS tbl, o_orderkey AS rows FROM orders")
def s3_explode_stats(spark, d):
    return io.explode_stats(_cases(spark, d))


def _folder(spark):
    return f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS queries, count(*) AS estimates FROM orders GROUP BY o_custkey")
def s1_read_cases(spark, d):
    """Cases are written as documents of JSON and read again; the format reads one document a line too."""
    path = _folder(spark)
    _cases(spark, d).write.json(path)
    return io.read_cases(spark, path, False).select("id", F.size("queries").cast("long").alias("queries"), F.size("row_estimates").cast("long").alias("estimates"))


@query(f"SELECT id, hazard_code, obj AS tables, service AS services, CAST(severity_bump AS INTEGER) AS severity_bump FROM {B.INCIDENTS} i")
def s4_read_incidents(spark, d):
    """Incidents as lines of JSON, with a comment and a blank line after each."""
    path, i = _folder(spark), B.rows(spark, d, B.INCIDENTS)
    line = F.to_json(F.struct("id", "hazard_code", F.array("obj").alias("tables"), F.array("service").alias("services"), F.col("severity_bump").cast("int").alias("severity_bump")))
    i.select(F.explode(F.array(line, F.lit("// a note"), F.lit(""))).alias("value")).write.text(path)
    return io.read_incidents(spark, path).select("id", "hazard_code", "tables", "services", "severity_bump")


@query("SELECT o_orderpriority AS case_id, o_orderkey AS seq, o_orderstatus AS code FROM orders")
def s5_write_findings(spark, d):
    path, o = _folder(spark), table(spark, d, "orders")
    io.write_findings(o.select(F.col("o_orderpriority").alias("case_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("code")), path)
    return spark.read.schema("case_id string, seq long, code string").json(f"{path}/cases")


@query("SELECT o_orderkey AS path, sha256(o_orderpriority || '|' || o_orderstatus || chr(10)) AS sha256 FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderstatus, o_orderpriority)")
def s7_file_manifest(spark, d):
    """A file for each status and priority, named after its least order, and the manifest of the tree."""
    path, o = _folder(spark), table(spark, d, "orders")
    few = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.min("o_orderkey").alias("k")).select("k", F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("value"))
    few.repartition("k").write.partitionBy("k").text(path)
    return io.file_manifest(spark, path).select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("long").alias("path"), "sha256")


@query("SELECT 'orders' AS tbl, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents")
def s8_measured_stats(spark, d):
    return io.measured_stats({t: table(spark, d, t) for t in ("orders", "lineitem", "documents")})


# ---- changes -------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey AS customer, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderpriority, 'new' AS channel FROM orders")
def m1_migrate(spark, d):
    o = table(spark, d, "orders").drop("o_orderdate")
    return M.migrate(o, [{"kind": "rename_column", "col": "o_custkey", "new_name": "customer"}, {"kind": "drop_column", "col": "o_orderstatus"}, {"kind": "alter_type", "col": "o_totalprice", "new_type": "decimal(12,2)"}, {"kind": "add_column", "col": "channel", "type": "string", "default": "new"}])


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 ELSE p_size END AS p_size FROM part")
def m2_backfill(spark, d):
    return M.backfill(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "0", "p_size < 10")


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE NOT coalesce(nullif(p_size, 7) > 25, false) UNION ALL SELECT p_partkey + 1000000, p_size, NULL FROM part WHERE p_size = 1")
def m3_delete_insert(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return M.insert_rows(M.delete_rows(p, "nullif(p_size, 7) > 25"), p.where("p_size = 1").select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), "p_size"))


@query("""SELECT batch, min(k) AS min_key, max(k) AS max_key, count(*) AS n FROM (SELECT l_orderkey AS k, (row_number() OVER (ORDER BY l_orderkey) - 1) // 5000 AS batch FROM lineitem WHERE l_quantity > 10) GROUP BY batch""")
def m4_backfill_batches(spark, d):
    return M.backfill_batches(table(spark, d, "lineitem"), "l_orderkey", 5_000, "l_quantity > 10")


@query("SELECT count(*) FILTER (p_brand IS NOT NULL AND try_cast(p_brand AS INTEGER) IS NULL) AS failed, count(*) FILTER (try_cast(p_brand AS INTEGER) IS NOT NULL AND CAST(try_cast(p_brand AS INTEGER) AS VARCHAR) <> p_brand) AS changed FROM part")
def m5_expand_column(spark, d):
    return M.expansion_loss(M.expand_column(table(spark, d, "part"), "p_brand", "p_brand_no", "int"), "p_brand", "p_brand_no")


@query(f"""SELECT script_id, idx, col || '_chk' AS name, 'constraint' AS object_kind, CASE WHEN kind = 'drop_column' THEN 'dropped' ELSE 'renamed' END AS effect FROM {B.OPS} o WHERE kind IN ('drop_column', 'rename_column') AND col IN ('p_size', 'o_custkey')""")
def m6_dependent_objects(spark, d):
    objects = spark.createDataFrame([("part", "p_size_chk", "constraint", ["p_size", "p_brand"]), ("orders", "o_custkey_chk", "constraint", ["o_custkey"])], "tbl string, name string, object_kind string, columns array<string>")
    return M.dependent_objects(objects, B.rows(spark, d, B.OPS))


_FOOTED = ("l_orderkey", "l_quantity", "l_linenumber", "l_returnflag")


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS rows, count(*) - count({c}) AS nulls, {f'CAST(min({c}) AS DOUBLE)' if c != 'l_returnflag' else 'NULL'} AS lo, {f'CAST(max({c}) AS DOUBLE)' if c != 'l_returnflag' else 'NULL'} AS hi FROM lineitem" for c in _FOOTED))
def a8_footer_facts(spark, d):
    """Counts, nulls and bounds from footers: no page of lineitem is read."""
    return FO.fact_rows(spark, FO.column_facts(spark, f"{d}/lineitem.parquet", list(_FOOTED)))


# ---- the first slice: uniqueness, its finding and the verdict -----------------------------------------------------
def unique_verdict(spark, d):
    """Would a unique key on (l_orderkey, l_linenumber) ship?"""
    found = a1_check_unique(spark, d).select(F.lit(1).cast("long").alias("script_id"), F.lit("lineitem(l_orderkey, l_linenumber)").alias("check"), F.lit("unique").alias("kind"), F.col("rejected").alias("violations"))
    return FI.verdict(R.data_failures(found))


query("""SELECT 1::BIGINT AS script_id, CASE WHEN count(*) > 0 THEN 'BLOCK' ELSE 'SAFE' END AS verdict FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")(unique_verdict)
