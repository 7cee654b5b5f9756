"""Learning incidents from findings, in batch or as a stream's foreachBatch body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegate.operators.findings import new_blockers
from tidegate.sources.io import read_incidents, write_incidents


def record_learning(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Incident rows for blockers whose code and tables are new. Ids are `learned:` and a hash of code and tables."""
    new = new_blockers(findings, known)
    key = F.substring(F.sha2(F.concat_ws("\x1f", "hazard_code", F.array_join("tables", ",")), 256), 1, 16)
    return new.select(F.concat(F.lit("learned:"), key).alias("id"), "hazard_code", "tables", F.array().cast("array<string>").alias("services"), F.lit(1).alias("severity_bump"), F.lit("learned from a blocker").alias("summary"), F.lit(None).cast("string").alias("date"))


def learn_stream(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream of findings teaches to the incidents at ``path``. A batch that is run again adds nothing."""

    def learn(batch: DataFrame, _: int) -> None:
        write_incidents(record_learning(batch, read_incidents(batch.sparkSession, path)), path)

    return findings.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
