"""Facts about columns from Parquet footers alone, and which checks they settle.

Row counts, null counts and least and largest values stand in the footers of a table's files. Spark's own pushed-down
aggregates read them in parallel, without a page of data. What they can't settle is left to a scan whose filter Spark
pushes down, so that only row groups that may hold an offending value are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.preflight import RANGES

WHOLE = ("tinyint", "smallint", "int", "bigint")
ORDERED = (*WHOLE, "float", "double", "date")


@dataclass(frozen=True)
class Fact:
    kind: str
    rows: int
    nulls: int
    #: None for types whose footers have no exact bounds, and for a column of nulls
    lo: float | int | None = None
    hi: float | int | None = None


def pushed(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """One row of counts and bounds over the Parquet files at ``path``, whose aggregates reach the footers; and the columns (name, type) that it is about."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")  # footers are asked by the newer reader
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(path)
    kinds = [(c, k) for c, k in df.dtypes if (columns is None or c in columns) and not k.startswith(("array", "map", "struct"))]
    bounds = [f(c).alias(f"{name}_{i}") for i, (c, k) in enumerate(kinds) if k in ORDERED for name, f in (("lo", F.min), ("hi", F.max))]
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"n_{i}") for i, (c, _) in enumerate(kinds)), *bounds), kinds


def column_facts(spark: SparkSession, path: str, columns: list[str] | None = None) -> dict[str, Fact]:
    """A fact for each column of plain type: one row comes to the driver, whatever the table's size."""
    one, kinds = pushed(spark, path, columns)
    r = one.first().asDict()
    return {c: Fact(k, r["rows"], r["rows"] - r[f"n_{i}"], r.get(f"lo_{i}"), r.get(f"hi_{i}")) for i, (c, k) in enumerate(kinds)}


def fact_rows(spark: SparkSession, facts: dict[str, Fact]) -> DataFrame:
    """(col, rows, nulls, lo, hi); bounds of numbers only."""
    number = lambda f, v: float(v) if v is not None and f.kind != "date" else None
    return spark.createDataFrame([(c, f.rows, f.nulls, number(f, f.lo), number(f, f.hi)) for c, f in facts.items()], "col string, rows long, nulls long, lo double, hi double")


def fits(fact: Fact, new: str) -> bool:
    """Whether the bounds prove that every value is one of the integer type ``new``, or below the limit of numeric(p, s)."""
    if fact.nulls == fact.rows:
        return True
    if fact.lo is None or fact.kind == "date" or fact.lo != fact.lo or fact.hi != fact.hi:
        return False
    root, _, inner = new.lower().partition("(")
    root = root.strip()
    if root in RANGES:
        return fact.kind in WHOLE and -RANGES[root] <= fact.lo and fact.hi < RANGES[root]
    if root in ("numeric", "decimal") and inner:
        p, _, s = inner.rstrip(") ").partition(",")
        return max(abs(fact.lo), abs(fact.hi)) < 10.0 ** max(0, int(p) - int(s or 0))
    return False


def outside_rows(df: DataFrame, col: str, new: str) -> DataFrame:
    """(violations): values beyond the integer type ``new``, by a plain comparison that reaches the scan: row groups within the range aren't read."""
    m = RANGES[new.strip().lower()]
    return df.where((F.col(col) < F.lit(-m)) | (F.col(col) > F.lit(m - 1))).agg(F.count(F.lit(1)).alias("violations"))
