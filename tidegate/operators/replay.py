"""Running read queries on a table's old and new shapes, and comparing what they give.

Query texts are never edited. Whether a text still runs, and with which columns, is asked of a session of its own, in
which each table is an empty view of its shape and each view is what its text says. Rows are counted in the caller's
session, with the same names bound by a WITH clause in front of the text.

Texts are read to the driver, so a log is replayed by its distinct shapes (``read_shapes``): their number is that of the
statements that applications hold, not of those that they send.
"""

from __future__ import annotations

import json
import logging
import re
import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "query_id string, ok boolean, error string, columns array<string>, rows long"
#: a string or a number in a text
LITERAL = r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b"
#: of the id under which a view itself is read
VIEW = "__view__"
LOG = PySparkLogger.getLogger("SQLQueryContextLogger")  # by its own class: a plain logger of that name makes every error fail


def quiet() -> None:
    """Errors of analysis aren't logged from now on: where texts of others are tried, an error is an answer."""
    LOG.setLevel(logging.CRITICAL)


def _inner(sql: str) -> str:
    """As a subquery, which only a read can be. Texts may end in a semicolon or a comment."""
    return f"(\n{sql.rstrip().rstrip(';')}\n)"


def _error(e: PySparkException) -> str:
    return (e.getCondition() or type(e).__name__).split(".")[0]


def shape_session(spark: SparkSession, tables: dict[str, DataFrame], views: dict[str, str]) -> tuple[SparkSession, dict[str, str]]:
    """A session that knows the shapes alone, and the errors of the views that don't resolve, which it lacks."""
    own, errors = spark.newSession(), {}
    for name, df in tables.items():
        own.createDataFrame([], df.schema).createOrReplaceTempView(name)
    for name, sql in views.items():
        if error := add_view(own, name, sql):
            errors[name] = error
    return own, errors


def add_view(own: SparkSession, name: str, sql: str) -> str | None:
    """The error that keeps a view from being, if any."""
    try:
        own.sql(f"SELECT * FROM {_inner(sql)} AS v").createOrReplaceTempView(name)
    except PySparkException as e:
        return _error(e)
    return None


def resolve(own: SparkSession, queries: list[tuple[str, str]], errors: dict[str, str]) -> list[tuple[str, str | None, list[str] | None]]:
    """(id, error, columns) of each (id, sql) in a session of shapes: analysis alone, nothing runs."""
    out = []
    quiet()
    for ident, sql in queries:
        try:
            out.append((ident, None, own.sql(f"SELECT * FROM {_inner(sql)} AS q").columns))
        except PySparkException as e:
            out.append((ident, errors.get(ident.removeprefix(VIEW)) or _error(e), None))
    return out


def _bound(state: str, left_out: set[str] = frozenset()) -> list[tuple[str, str]]:
    """The relations of a state (see ``scripts.visible``), each a name and a WITH item of its shape alone."""
    out = []
    for name, shape in json.loads(state):
        if name not in left_out:
            columns = ", ".join(f"CAST(NULL AS {t}) AS `{c}`" for c, t in shape) if not isinstance(shape, str) else ""
            out.append((name, f"`{name}` AS " + (_inner(shape) if isinstance(shape, str) else f"(SELECT {columns or 'NULL AS `__none`'})")))
    return out


def outcomes(spark: SparkSession, asked: list[tuple[str, str]], threads: int = 8) -> list[tuple[str | None, list[str] | None]]:
    """(error, columns) of each (read, state): analysis alone, nothing runs.

    Reads are analysed side by side, in sessions that know no relation but those of the state. A view that doesn't
    resolve isn't there.
    """
    quiet()
    here = threading.local()

    def tell(sql: str) -> tuple[str | None, list[str] | None]:
        if not hasattr(here, "own"):
            here.own = spark.newSession()
        try:
            return None, here.own.sql(sql).columns
        except PySparkException as e:
            return _error(e), None

    def text(items: list[tuple[str, str]], read: str) -> str:
        head = f"WITH {', '.join(x for _, x in items)} " if items else ""
        return f"{head}SELECT * FROM {_inner(read)} AS q"

    def one(pair: tuple[str, str]) -> tuple[str | None, list[str] | None]:
        read, state = pair
        bad: set[str] = set()
        for name, shape in json.loads(state):
            if isinstance(shape, str):
                items = _bound(state, bad)
                upto = [n for n, _ in items].index(name) + 1
                if tell(text(items[:upto], f"SELECT * FROM `{name}`"))[0]:
                    bad.add(name)
        return tell(text(_bound(state, bad), read))

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, asked))


def with_views(queries: list[tuple[str, str]], views: dict[str, str]) -> list[tuple[str, str]]:
    return [*queries, *((VIEW + v, f"SELECT * FROM {v}") for v in views)]


def replay(spark: SparkSession, queries: list[tuple[str, str]], tables: dict[str, DataFrame], count: bool = True, views: dict[str, str] | None = None) -> DataFrame:
    """(query_id, ok, error, columns, rows): the outcome of each (id, sql) over ``tables`` and ``views`` (name to text).

    Each view is a query of its own too, with ``VIEW`` before its name. A statement that doesn't resolve gives its error
    class, at no cost; others are counted by a distributed job, unless ``count`` is false. A statement that isn't a read
    gives a syntax error and isn't run.
    """
    views = views or {}
    own, errors = shape_session(spark, tables, views)
    bound = {f"t{i}": df for i, df in enumerate(tables.values())}
    names = [f"{name} AS (SELECT * FROM {{{key}}})" for name, key in zip(tables, bound, strict=True)]
    names += [f"{name} AS {_inner(_plain(sql))}" for name, sql in views.items() if name not in errors]
    every, out = with_views(queries, views), []
    for (ident, error, columns), (_, sql) in zip(resolve(own, every, errors), every, strict=True):
        rows = None
        if count and not error:
            try:
                rows = spark.sql(f"WITH {', '.join(names)} SELECT * FROM {_inner(_plain(sql))} AS q", **bound).count()
            except PySparkException as e:
                error, columns = _error(e), None
        out.append((ident, not error, error, columns, rows))
    return spark.createDataFrame(out, OUTCOME)


def _plain(sql: str) -> str:
    """Braces of a text stand for themselves where names are bound."""
    return re.sub(r"([{}])", r"\1\1", sql)


def is_read(sql: Column) -> Column:
    return sql.rlike(r"(?i)^\s*(select|with)\b")


def shape_of(sql: Column) -> Column:
    """A statement with its literals blanked and its white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(sql, LITERAL, "?"), r"\s+", " "))


def read_shapes(log: DataFrame, *more: Column) -> DataFrame:
    """(shape, query_id, sql): the reads of a log by shape, each with the least query id and that query's text; ``more``: further aggregates of the log's columns."""
    reads = log.where(is_read(F.col("sql"))).withColumn("shape", shape_of(F.col("sql")))
    return reads.groupBy("shape").agg(F.min(F.struct("query_id", "sql")).alias("x"), *more).select("*", "x.query_id", "x.sql").drop("x")


def log_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(query_id, ok): the outcome of every read of ``log``, from outcomes by shape (shape, ok)."""
    reads = log.where(is_read(F.col("sql"))).select("query_id", shape_of(F.col("sql")).alias("shape"))
    return reads.join(outcomes.select("shape", "ok"), "shape").select("query_id", "ok")


def log_drift(log: DataFrame, drift: DataFrame) -> DataFrame:
    """(query_id, removed, added) of every read of ``log``, from drift by shape (shape, removed, added)."""
    reads = log.where(is_read(F.col("sql"))).select("query_id", shape_of(F.col("sql")).alias("shape"))
    return reads.join(drift.select("shape", "removed", "added"), "shape").select("query_id", "removed", "added")


def column_drift(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, removed, added, reordered) where the ordered column lists differ."""
    j = pre.where("ok").select("query_id", F.col("columns").alias("a")).join(post.where("ok").select("query_id", F.col("columns").alias("b")), "query_id")
    a, b = F.col("a"), F.col("b")
    return j.where(a != b).select("query_id", F.array_except(a, b).alias("removed"), F.array_except(b, a).alias("added"), (F.array_sort(a) == F.array_sort(b)).alias("reordered"))


def rowcount_drift(pre: DataFrame, post: DataFrame) -> DataFrame:
    j = pre.where("ok").select("query_id", F.col("rows").alias("before")).join(post.where("ok").select("query_id", F.col("rows").alias("after")), "query_id")
    return j.where("before <> after")


def answer_drift(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(only_before, only_after): rows, with repeats, that one answer has and the other lacks. Columns must be the same."""
    keys = F.xxhash64(*sorted(pre.columns))
    one = pre.groupBy(keys.alias("h")).agg(F.count(F.lit(1)).alias("n")).unionByName(post.groupBy(keys.alias("h")).agg((-F.count(F.lit(1))).alias("n")))
    d = one.groupBy("h").agg(F.sum("n").alias("n"))
    return d.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("only_before"), F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).alias("only_after"))


def _differing(pre: DataFrame, post: DataFrame, by: Column, row: Column) -> DataFrame:
    """(by, before, after): numbers of rows of each value of ``by`` whose rows, as multisets of hashes, differ."""
    total = lambda df: df.groupBy(by.alias("by")).agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(20,0)")).alias("s"))
    a, b = (total(df).select(F.col("by").alias(f"{x}_by"), F.col("n").alias(f"{x}_n"), F.col("s").alias(f"{x}_s")) for df, x in ((pre, "a"), (post, "b")))
    j = a.join(b, F.col("a_by").eqNullSafe(F.col("b_by")), "full_outer").where(~(F.col("a_n").eqNullSafe(F.col("b_n")) & F.col("a_s").eqNullSafe(F.col("b_s"))))
    return j.select(F.coalesce("a_by", "b_by").alias("by"), F.coalesce("a_n", F.lit(0)).alias("before"), F.coalesce("b_n", F.lit(0)).alias("after"))


def differing_ranges(pre: DataFrame, post: DataFrame, key: str, cells: int = 1024, few: int = 100_000) -> list[tuple[int, int]]:
    """Ranges of an integer ``key`` outside of which both answers have the same rows.

    Fingerprints of equal ranges are compared, then of finer ones inside those that differ, until these hold ``few``
    rows or can't be divided. Each round is one aggregation on either side, of ``cells`` rows at most, over the ranges
    left: where files are sorted by key, the comparison on it keeps the rest from being read.
    """
    row = F.xxhash64(*sorted(pre.columns))
    ends = pre.select(key).unionByName(post.select(key)).agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        return []
    ranges, width = [(ends[0], ends[1])], None
    while True:
        size = sum(b - a + 1 for a, b in ranges)
        last, width = width, max(1, -(-size // cells))
        if last is not None and width >= last:
            return ranges
        inside, cell = F.lit(False), F.lit(None).cast("long")
        for a, b in ranges:
            within = F.col(key).between(a, b)
            inside, cell = inside | within, F.when(within, F.floor((F.col(key) - a) / F.lit(width)) * width + a).otherwise(cell)
        found = sorted(_differing(pre.where(inside), post.where(inside), cell, row).collect())
        ranges, rows = [], sum(max(r["before"], r["after"]) for r in found)
        for a, b in ((r["by"], r["by"] + width - 1) for r in found):
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        if width == 1 or rows <= few:
            return ranges


def answer_rows(pre: DataFrame, post: DataFrame, key: str, cells: int = 1024, few: int = 100_000) -> DataFrame:
    """(key, before, after): keys whose rows differ between two answers of the same columns, and how many rows each has.

    ``key`` is an integer; it may repeat and be null. Only ranges of it that differ are read for this, and rows with a
    null key.
    """
    ranges = differing_ranges(pre, post, key, cells, few)
    some = F.col(key).isNull()
    for a, b in ranges:
        some |= F.col(key).between(a, b)
    return _differing(pre.where(some), post.where(some), F.col(key), F.xxhash64(*sorted(pre.columns))).withColumnRenamed("by", key)
