"""Checks of real tables before a change: which rows would break a new rule. Each is one scan with partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.session import materialize


def check_unique(df: DataFrame, keys: list[str], samples: int = 5) -> DataFrame:
    """(groups, rejected, samples): key groups that break uniqueness, rows that would be rejected, the least such keys.

    A key with a null never collides. Counts are per key after map-side combining, so a hot key is one row per task.
    """
    k = df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    k = k.select(F.concat_ws("|", *keys).alias("key"), "n")
    top = k.orderBy("key").limit(samples).agg(F.array_sort(F.collect_list("key")).alias("samples"))
    return k.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rejected")).crossJoin(F.broadcast(top))


def rejected(df: DataFrame, keys: list[str]) -> DataFrame:
    """(violations): rows that a unique key over ``keys`` would reject; a key with a null never collides."""
    n = df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def _hashes(values: list[Column]) -> list[Column]:
    """Two independent hashes of a key, 128 bits together; null where a part is null."""
    full = reduce(Column.__and__, (v.isNotNull() for v in values))
    return [F.when(full, F.xxhash64(*values)).alias("h"), F.when(full, F.xxhash64(F.lit("g"), *values)).alias("g")]


def rejected_by_keys(df: DataFrame, keys: dict[str, list[Column]]) -> DataFrame:
    """(key, violations): rows that each of many unique keys would reject, from one scan and one exchange.

    A row is sent once for each key, as a number and a hash of 128 bits, after equal ones are counted on the map side:
    a hot key is a row for each task. A key with a null never collides.
    """
    each = F.array(*(F.struct(F.lit(i).alias("k"), *_hashes(values)) for i, values in enumerate(keys.values())))
    n = df.select(F.inline(each)).where("h is not null").groupBy("k", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    return _by_key(df.sparkSession, list(keys), n.groupBy("k").agg(F.sum(F.col("n") - 1).alias("violations")))


#: conditions told by the bits of one number
BITS = 60


def _bits(conditions: list[Column]) -> list[Column]:
    """Which of ``conditions`` hold, as the bits of numbers."""
    return [reduce(Column.bitwiseOR, (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(conditions[at : at + BITS]))) for at in range(0, len(conditions), BITS)]


def _bit(name: str, i: int) -> Column:
    return F.col(f"{name}{i // BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("long")) != 0


def count_among(df: DataFrame, conditions: dict[str, Column], asked: list[list[str]], at_once: int = 200) -> list[int]:
    """Rows in which all of the named conditions hold, for each of ``asked``.

    Rows are first counted by which conditions hold, in one scan, so that a row is asked each condition once and not
    each combination of them; what is asked is then added up over the few rows that this gives.
    """
    names = {name: i for i, name in enumerate(conditions)}
    rows = materialize(df.groupBy(*(b.alias(f"b{i}") for i, b in enumerate(_bits(list(conditions.values()))))).agg(F.count(F.lit(1)).alias("n")))
    out: list[int] = []
    for at in range(0, len(asked), at_once):
        every = (reduce(Column.__and__, (_bit("b", names[x]) for x in some)) for some in asked[at : at + at_once])
        out += rows.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(every))).first()
    return out


def distinct_among(df: DataFrame, asked: list[tuple[list[str], list[str]]]) -> list[int]:
    """Distinct keys without a null among the rows in which conditions hold, for each of ``asked`` (a key's columns, boolean columns).

    One scan and one exchange: a row is sent once for each different key, as a number and a hash of 128 bits, with the
    conditions that hold as bits; equal ones are combined on the map side.
    """
    keys: dict[tuple, list[int]] = {}
    for i, (columns, _) in enumerate(asked):
        keys.setdefault(tuple(columns), []).append(i)
    width = -(-max(map(len, keys.values()), default=0) // BITS)
    each = []
    for k, (columns, own) in enumerate(keys.items()):
        bits = _bits([reduce(Column.__and__, map(F.col, asked[i][1]), F.lit(True)) for i in own])
        bits += [F.lit(0).cast("long")] * (width - len(bits))
        each.append(F.struct(F.lit(k).alias("k"), *_hashes([F.col(c) for c in columns]), *(b.alias(f"b{i}") for i, b in enumerate(bits))))
    if not each:
        return []
    names = [f"b{i}" for i in range(width)]
    values = df.select(F.inline(F.array(*each))).where("h is not null").groupBy("k", "h", "g").agg(*(F.bit_or(b).alias(b) for b in names))
    alike = values.groupBy("k", *names).agg(F.count(F.lit(1)).alias("n"))
    most = max(map(len, keys.values()))
    told = {r["k"]: r for r in alike.groupBy("k").agg(*(F.sum(F.when(_bit("b", i), F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(most))).collect()}
    out = [0] * len(asked)
    for k, own in enumerate(keys.values()):
        for i, at in enumerate(own):
            out[at] = told[k][f"c{i}"] if k in told else 0
    return out


def _by_key(spark: SparkSession, keys: list[str], found: DataFrame) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(keys)), "k int, key string")
    return names.join(found, "k", "left").select("key", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def orphans_by_keys(keys: dict[str, tuple[tuple[DataFrame, list[Column], list[str]], tuple[DataFrame, list[Column], list[str]]]]) -> DataFrame:
    """(key, violations): rows without a parent, for each of many foreign keys, in one exchange.

    keys: of child and parent each the table, the key's columns and their types. Both sides are sent as the key's number
    and a hash of 128 bits, equal ones combined on the map side. A key with a null needs no parent.
    """
    whole = ("tinyint", "smallint", "int", "bigint")

    def side(k: int, df: DataFrame, values: list[Column], kinds: list[str], others: list[str], child: bool) -> DataFrame:
        alike = [v if a == b else v.cast("bigint") if a in whole and b in whole else v.cast("string") for v, a, b in zip(values, kinds, others, strict=True)]
        return df.select(F.lit(k).alias("k"), *_hashes(alike), F.lit(int(child)).alias("n"), F.lit(not child).alias("there"))

    parts = [side(k, df, values, kinds, others, child) for k, (a, b) in enumerate(keys.values()) for (df, values, kinds), others, child in ((a, b[2], True), (b, a[2], False))]
    met = reduce(DataFrame.unionByName, parts).where("h is not null").groupBy("k", "h", "g").agg(F.sum("n").alias("n"), F.bool_or("there").alias("there"))
    spark = next(iter(keys.values()))[0][0].sparkSession
    return _by_key(spark, list(keys), met.where("not there").groupBy("k").agg(F.sum("n").alias("violations")))


def null_counts(cols: list[str]) -> dict[str, Column]:
    return {f"{c}_not_null": F.count_if(F.col(c).isNull()) for c in cols}


def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """(check, violations): null rows of each column, in one scan."""
    return preflight(df, null_counts(cols))


def violation(predicate: str) -> Column:
    """Rows that a CHECK refuses: where it is false. Null passes."""
    return F.count_if(~F.expr(predicate))


def check_predicate(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    return preflight(df, {name: violation(p) for name, p in checks.items()})


def check_new_column(df: DataFrame, not_null: bool, default) -> DataFrame:
    """(rows, without_value, severity) of a column added to ``df``: every row lacks a value if it has no default."""
    lacks = F.count(F.lit(1)) if not_null and default is None else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), lacks.alias("without_value")).withColumn("severity", F.when(F.col("without_value") > 0, "blocker"))


def check_narrowing(df: DataFrame, col: str, old: str, new: str, samples: int = 5) -> DataFrame:
    """(rows_checked, offending_rows, narrowing, severity, samples) for a change of type; rows with null count as checked."""
    bad = X.offends(F.col(col), new, dict(df.dtypes)[col] == "string")
    top = df.where(bad).select(F.col(col).cast("string").alias("v"), col).orderBy(F.col(col).desc(), "v").limit(samples).agg(F.array_sort(F.collect_list("v")).alias("samples"))
    out = df.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(bad).alias("offending_rows")).crossJoin(F.broadcast(top))
    return out.withColumn("narrowing", X.is_narrowing(F.lit(old), F.lit(new))).withColumn("severity", narrowing_severity(F.col("offending_rows")))


def narrowing_severity(offending: Column) -> Column:
    return F.when(offending > 0, "blocker").otherwise("medium")


def sample_vs_full(df: DataFrame, in_sample: Column, col: str, new: str) -> DataFrame:
    """Offenders in a sample and in the table, in one scan; bounded: the sample is clean and smaller than the table."""
    bad = X.offends(F.col(col), new, dict(df.dtypes)[col] == "string")
    out = df.agg(F.count_if(in_sample).alias("sample_rows"), F.count_if(in_sample & bad).alias("sample_offending"), F.count(F.lit(1)).alias("table_rows"), F.count_if(bad).alias("table_offending"))
    return out.withColumn("bounded", (F.col("sample_offending") == 0) & (F.col("sample_rows") < F.col("table_rows")))


def preflight(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations) for any number of counting expressions over ``df``, in one scan."""
    one = df.agg(*(c.alias(f"c{i}") for i, c in enumerate(checks.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("violations")) for i, name in enumerate(checks)))
    return one.select(F.inline(pairs))


def null_erasure(df: DataFrame, table: str, ops: DataFrame) -> DataFrame:
    """(script_id, tbl, col, null_rows, irreversible): nulls that a backfill erases where the script also sets NOT NULL.

    ``ops`` (script_id, kind, tbl, col, sql). The order of the two statements in the script is of no account.
    """
    own = ops.where(F.col("tbl") == table)
    fill = own.where("kind = 'dml_update'").select("script_id", "tbl", F.explode(X.nulls_erased(F.col("sql"), X.assigned_columns(F.col("sql")))).alias("col")).distinct()
    sealed = own.where("kind = 'set_not_null'").select("script_id", "tbl", "col").distinct()
    counts = preflight(df, {c: F.count_if(F.col(c).isNull()) for c in df.columns}).withColumnsRenamed({"check": "col", "violations": "null_rows"})
    return fill.join(sealed, ["script_id", "tbl", "col"]).join(F.broadcast(counts), "col").select("script_id", "tbl", "col", "null_rows", F.lit(True).alias("irreversible"))


def mutation_reach(df: DataFrame, predicate: str) -> DataFrame:
    """(touched, rows, share) of an UPDATE's or DELETE's predicate."""
    hit = F.count_if(F.coalesce(F.expr(predicate), F.lit(False)))
    return df.agg(hit.alias("touched"), F.count(F.lit(1)).alias("rows")).withColumn("share", F.col("touched") / F.greatest("rows", F.lit(1)))


def inserts_missing_required(inserts: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, tbl, col): required columns that an INSERT's column list leaves out.

    ``inserts`` (query_id, sql); ``columns`` (tbl, col, required). A statement without a column list gives all columns.
    """
    head = r'(?is)^\s*insert\s+into\s+"?([\w$.]+)"?\s*\(([^)]*)\)'
    i = inserts.select("query_id", F.lower(F.regexp_extract("sql", head, 1)).alias("tbl"), F.transform(F.split(F.lower(F.regexp_extract("sql", head, 2)), ","), F.trim).alias("given")).where("tbl <> ''")
    return i.join(columns.where("required").select("tbl", "col"), "tbl").where(~F.array_contains("given", F.col("col"))).select("query_id", "tbl", "col")


def check_foreign_key(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """(orphans, keys): child rows with a non-null key that has no parent, and their distinct keys."""
    lone = child.select(F.col(key).alias("k")).dropna().groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return lone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"), F.count(F.lit(1)).alias("keys"))


#: bounds of the integer types
RANGES = {"smallint": 1 << 15, "int": 1 << 31, "integer": 1 << 31, "bigint": 1 << 63}


def outside(value: Column, new: str, is_number: bool) -> Column:
    """Whether a value lies beyond the integer type ``new``; false for other types, texts and null."""
    m = RANGES.get(new.strip().lower())
    if m is None or not is_number:
        return F.lit(False)
    v = value.cast("double")
    return F.coalesce((v < float(-m)) | (v >= float(m)), F.lit(False))


def check_int_range(df: DataFrame, col: str, new: str) -> DataFrame:
    """(outside): values beyond the new integer type; null is inside."""
    m = RANGES[new]
    v = F.col(col).cast("decimal(38,0)")
    return df.agg(F.count_if((v < F.lit(-m).cast("decimal(38,0)")) | (v > F.lit(m - 1).cast("decimal(38,0)"))).alias("outside"))
