"""Session helpers shared by the whole package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCOPES: list[list[str]] = []
#: bytes of an Arrow batch on its way to a Python worker: ten thousand long texts are too many for small executors
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def get_spark(app: str = "tidegate", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir. Only a local session gets a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidegate-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidegate-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and the copy outlives lost executors.

    It stays until ``discard``, ``clean_shared`` or the end of the ``scratch`` around it, which passes over what is kept.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing if it isn't such a copy. No other plan may still need it."""
    if path := getattr(df, "written_to", None):
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession):
    """Copies that are written inside are deleted at the end. What is made of them must be written, and kept, by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_shared(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote for this application. For use when results that read it are done with."""
    _delete(spark, _scratch(spark))


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose rows are as many as a fleet's scripts or statements: dealt by key, and not broadcast.

    Spark takes a scan for as large as its file, in which columns of few values take next to nothing: millions of rows
    would pass for small ones, and be gathered by the driver. Nor does a plan that is adapted on its way take a broadcast
    back once it is known how many there are.
    """
    return df.hint("merge")


#: nodes of a logical plan after which partitions are only known once stages have run
_DEALT = {"Join", "Aggregate", "Window", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Sort", "Distinct", "Deduplicate", "GlobalLimit", "Except", "Intersect", "FlatMapGroupsInArrow", "FlatMapGroupsInPandas", "FlatMapCoGroupsInArrow", "FlatMapCoGroupsInPandas"}


def _nodes(plan):
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node.getClass().getSimpleName()
        todo += [node.children().apply(i) for i in range(node.children().size())]


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` itself, unless it is a plain scan with fewer partitions than there are cores: then dealt over all of them, for work that is bound by CPU.

    A plan that shuffles is left alone: its partitions are only known once its stages have run.
    """
    if _DEALT & set(_nodes(df._jdf.queryExecution().optimizedPlan())):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, and bound the session's Arrow batches where it sets no bound."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(), "tidegate_src.zip")
    Path(path).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(os.path.realpath(path))
    _SHIPPED.add(app)
