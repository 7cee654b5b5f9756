"""How many rows the reads of a log give, for all their literals at once.

A log sends few texts with ever new literals. Reads are taken by form (``forms``): a text, with a column in each
literal's place, is a lateral subquery that counts, the distinct literals of the form are the rows beside it, and Catalyst
makes of it one aggregation of the tables by what is compared with literals, and one join. A form that Catalyst could only
answer row by row with each literal (ranges), whose literals can't be columns (dates, places in GROUP BY), or that has
nodes other than those of ``TOGETHER``, is counted text by text, ``AT_ONCE`` texts to a job: a scan for each, as if sent.

Texts come to the driver by form, and those that are counted one by one; literals, reads and counts stay on Spark.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import replay as RE
from tidegate.session import _nodes

FORM = ["shape", "kinds"]
COUNTED = "lits array<string>, n long"
#: texts that one job counts one by one
AT_ONCE = 20
#: nodes of an analysed plan under which a literal may become a column of another relation
TOGETHER = {"Project", "Filter", "Join", "SubqueryAlias", "View", "Sort", "Aggregate", "Distinct", "WithCTE", "CTERelationDef", "CTERelationRef", "LogicalRDD", "LocalRelation", "LogicalRelation"}
#: physical joins that meet every row with every literal
ROW_BY_ROW = {"BroadcastNestedLoopJoinExec", "CartesianProductExec"}
LAST_LIMIT = re.compile(r"(?is)\s+limit\s+(\d+)\s*;?\s*$")
ASKED = "__asked"


def _kind(lit: Column) -> Column:
    """The type of a literal's column; null where its value isn't what stands between the quotes."""
    digits = F.length(F.substring_index(lit, ".", -1))
    number = F.when(~lit.contains("."), F.when(F.length(lit) <= 18, "BIGINT").otherwise("DECIMAL(38,0)")).when(F.length(lit) <= 38, F.concat(F.lit("DECIMAL("), F.length(lit) - 1, F.lit(","), digits, F.lit(")")))
    return F.when(lit.startswith("'"), F.when(~lit.contains("\\"), "STRING")).otherwise(number)


def with_literals(log: DataFrame) -> DataFrame:
    """The reads of ``log`` with shape, lits (their literals as written) and kinds (the literals' types, null for one that can't be a column)."""
    reads = log.where(RE.is_read(F.col("sql"))).withColumn("lits", F.regexp_extract_all("sql", F.lit(RE.LITERAL), F.lit(0)))
    return reads.withColumns({"shape": RE.shape_of(F.col("sql")), "kinds": F.transform("lits", _kind)})


def forms(reads: DataFrame) -> list[tuple[str, tuple, str]]:
    """(shape, kinds, least text) of each form, in order: as many as applications hold statements."""
    found = reads.groupBy(*FORM).agg(F.min("sql").alias("sql")).collect()
    return sorted(((r["shape"], tuple(r["kinds"]), r["sql"]) for r in found), key=str)


class World:
    """Relations that reads are counted on: tables, and views in an order in which they can be made."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], views: dict[str, str]):
        self.spark, self.bound = spark, {f"t{i}": df for i, df in enumerate(tables.values())}
        self.own, errors = RE.shape_session(spark, tables, views)
        names = [f"{name} AS (SELECT * FROM {{{key}}})" for name, key in zip(tables, self.bound, strict=True)]
        names += [f"{name} AS {RE._inner(RE._plain(sql))}" for name, sql in views.items() if name not in errors]
        self.head = f"WITH {', '.join(names)} " if names else ""

    def nodes(self, sql: str) -> set[str] | None:
        """Nodes of a read's analysed plan; None where it doesn't resolve."""
        RE.quiet()
        try:
            return set(_nodes(self.own.sql(f"SELECT * FROM {RE._inner(sql)} AS q")._jdf.queryExecution().analyzed()))
        except PySparkException:
            return None

    def _sql(self, text: str, **more: DataFrame) -> DataFrame:
        return self.spark.sql(self.head + text, **self.bound, **more)

    def together(self, sql: str, kinds: tuple, lits: DataFrame) -> DataFrame | None:
        """(lits, n) for the distinct ``lits`` of a form, in one plan; None where that can't be."""
        places = [m.span() for m in re.finditer(RE.LITERAL, sql, re.ASCII)]
        found = self.nodes(LAST_LIMIT.sub("", sql))
        if None in kinds or len(places) != len(kinds) or found is None or not found <= TOGETHER:
            return None
        last = LAST_LIMIT.search(sql)
        text, at = "", 0
        for i, (a, b) in enumerate(places):
            text, at = f"{text}{RE._plain(sql[at:a])}{ASKED}.l{i}", b
        text += RE._plain(sql[at:])
        if last:
            text = re.sub(rf"(?is)\s+limit\s+{ASKED}\.l\d+\s*;?\s*$", "", text)
        if re.search(rf"(?is)\bgroup\s+by\b(?:(?!\bhaving\b|\border\b|\)).)*{ASKED}\.", text):
            return None  # a place in the list of columns, not a value
        value = lambda i, kind: F.replace(F.expr(f"substring(lits[{i}], 2, length(lits[{i}]) - 2)"), F.lit("''"), F.lit("'")) if kind == "STRING" else F.col("lits")[i].cast(kind)
        rows = lits.select("lits", *(value(i, k).alias(f"l{i}") for i, k in enumerate(kinds)))
        n = f"least(q.n, {ASKED}.l{len(kinds) - 1})" if last else "q.n"
        try:
            out = self._sql(f"SELECT {ASKED}.lits, {n} AS n FROM {{asked}} AS {ASKED}, LATERAL (SELECT count(*) AS n FROM {RE._inner(text)} AS r) AS q", asked=rows)
            plan = set(_nodes(out._jdf.queryExecution().sparkPlan()))
        except PySparkException:
            return None
        return None if plan & ROW_BY_ROW else out

    def each(self, reads: DataFrame) -> DataFrame:
        """(lits, n) for the distinct ``reads`` (lits, sql) of a form, text by text. One that fails on a row isn't counted."""
        texts, out = [tuple(r) for r in reads.select("lits", "sql").collect()], []

        def ask(some: list) -> None:
            every = " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n FROM {RE._inner(RE._plain(sql))} AS q" for k, (_, sql) in enumerate(some))
            try:
                out.extend((some[r["k"]][0], r["n"]) for r in self._sql(every).collect())
            except PySparkException:
                half = len(some) // 2
                for part in (some[:half], some[half:]) if half else ():
                    ask(part)

        for at in range(0, len(texts), AT_ONCE):
            ask(texts[at : at + AT_ONCE])
        return self.spark.createDataFrame(out, COUNTED)


def of_form(reads: DataFrame, shape: str, kinds: tuple) -> DataFrame:
    """(lits, sql) of a form's reads: each row of literals once, with the least text."""
    same = F.array(*(F.lit(k).cast("string") for k in kinds)) if kinds else F.array().cast("array<string>")
    return reads.where((F.col("shape") == shape) & F.col("kinds").eqNullSafe(same)).groupBy("lits").agg(F.min("sql").alias("sql"))


def count_reads(world: World, some: DataFrame, sql: str, kinds: tuple) -> DataFrame | None:
    """(lits, n): rows that each of the reads ``some`` (lits, sql) of one form gives; None if the form doesn't resolve."""
    if world.nodes(sql) is None:
        return None
    found = world.together(sql, kinds, some.select("lits"))
    return found if found is not None else world.each(some)
