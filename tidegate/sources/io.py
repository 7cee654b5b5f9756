"""Sources and sinks: case documents, incidents, findings, traces, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = """id string, title string, owner_service string, scenario string, schema_sql string, row_estimates map<string,bigint>,
queries array<struct<id: string, service: string, criticality: string, label: string, sql: string>>, seed map<string,string>,
migration_sql string, rollback_sql string,
ground_truth struct<blocking: boolean, hazards: array<struct<code: string, severity: string, note: string>>, notes: string>"""
INCIDENT = "id string, hazard_code string, tables array<string>, services array<string>, severity_bump int, summary string, date string"
TRACE = "seq long, t_ms double, kind string, agent string, goal string, output string, tool string, result string, ms double, text string, attempt int, reason string, name string, state string, model string, tokens_in long, tokens_out long, cost_usd double"


def read_cases(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """A folder of JSON case documents, one a file or one a line, sorted by file name."""
    return spark.read.schema(CASE).json(path, multiLine=one_a_file).withColumn("_file", F.col("_metadata.file_name")).orderBy("_file").drop("_file")


def explode_corpus(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("id").alias("case_id"), F.inline_outer("queries"))


def explode_stats(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("id").alias("case_id"), F.explode("row_estimates").alias("tbl", "rows"))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines and lines that begin with // are skipped; a missing path is an empty table."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], INCIDENT)
    good = lines.where(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    return good.select(F.from_json("value", INCIDENT).alias("x")).select("x.*")


def write_incidents(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_findings(df: DataFrame, path: str, aggregate: DataFrame | None = None) -> None:
    """A folder of JSON for each case, and the aggregate beside them."""
    df.write.mode("overwrite").partitionBy("case_id").json(f"{path}/cases")
    if aggregate is not None:
        aggregate.write.mode("overwrite").json(f"{path}/aggregate")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path).where("kind <> 'run_start'")


def write_trace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def measured_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, rows): a count of each table; parquet answers it from footers."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tbl"), "rows") for name, df in tables.items()))
