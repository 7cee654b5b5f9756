"""Audits of generated plans: steps without a gate, rollbacks that take away what code uses.

A step is (script_id, phase, seq, kind, sql, object); code steps and gates are (script_id, text).
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import vocab as V
from tidegate.operators import rules as R
from tidegate.session import by_key, ship


def plan_steps(plans: DataFrame) -> DataFrame:
    """One row for each statement of a plan (script_id, phase1_sql, phase2_sql, rollback_sql arrays)."""
    one = lambda c, name: plans.select("script_id", F.lit(name).alias("phase"), F.posexplode(c).alias("seq", "sql"))
    return one("phase1_sql", "phase1").unionByName(one("phase2_sql", "phase2")).unionByName(one("rollback_sql", "rollback"))


def named_in(texts: DataFrame, objects: DataFrame) -> DataFrame:
    """(script_id, object), distinct: those of all ``objects`` (object) that a script's texts (script_id, text) contain, whatever the case.

    Texts are searched once for all names together, by an automaton of the fleet's distinct object names, which are of
    the catalogue's size. So a script with many steps and many gates costs what its texts' length is, and not a pair of
    each.
    """
    names = [r["o"] for r in objects.select(F.lower("object").alias("o")).where("o is not null").distinct().collect()]
    ship(texts.sparkSession)

    def search(batches):
        found = ahocorasick.Automaton()
        for n in names:
            if n:
                found.add_word(n, n)
        found.make_automaton()
        for t in batches:
            hits = {(i, n) for i, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True) if text is not None for n in ([x for _, x in found.iter(text)] if len(found) else []) + [""] * ("" in names)}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hits], pa.int64()), pa.array([n for _, n in hits], pa.string())], ["script_id", "object"])

    return texts.select(F.col("script_id").cast("long"), F.lower("text").alias("text")).mapInArrow(search, "script_id long, object string").distinct()


def _named(steps: DataFrame, texts: DataFrame, how: str) -> DataFrame:
    """Steps whose object a text of the same script names."""
    hits = named_in(texts, steps).select("script_id", F.col("object").alias("_o"))
    return steps.withColumn("_o", F.lower("object")).join(by_key(hits), ["script_id", "_o"], how).drop("_o")


def ungated_steps(steps: DataFrame, gates: DataFrame) -> DataFrame:
    """Destructive steps of phase 2 that no gate names."""
    return _named(steps.where((F.col("phase") == "phase2") & F.col("kind").isin(*V.DESTRUCTIVE)), gates, "left_anti").select("script_id", "seq", "object")


def text_gated_steps(steps: DataFrame, gates: DataFrame) -> DataFrame:
    """Destructive steps of phase 2 that a gate names: trusted by its text only."""
    return _named(steps.where((F.col("phase") == "phase2") & F.col("kind").isin(*V.DESTRUCTIVE)), gates, "left_semi").select("script_id", "seq", "object")


def rollback_conflicts(steps: DataFrame, code_steps: DataFrame, gates: DataFrame) -> DataFrame:
    """Rollback steps that remove what a code step starts to use, unless a gate names it."""
    used = _named(steps.where((F.col("phase") == "rollback") & F.col("kind").isin("drop_column", "drop_table")), code_steps, "left_semi")
    return _named(used, gates, "left_anti").select("script_id", "seq", "object")


def plan_findings(steps: DataFrame, code_steps: DataFrame, gates: DataFrame) -> DataFrame:
    """(script_id, code, seq, object), sorted by script, code and step."""
    a = ungated_steps(steps, gates).withColumn("code", F.lit("UNGATED_STEP"))
    b = rollback_conflicts(steps, code_steps, gates).withColumn("code", F.lit("ROLLBACK_CONFLICT"))
    return a.unionByName(b).select("script_id", "code", "seq", "object").orderBy("script_id", "code", "seq")


def plan_gaps(steps: DataFrame, gates: DataFrame) -> DataFrame:
    """Gaps of plans: statements of a kind that nothing inspects, and steps that count as gated because a gate's text names their object."""
    unruled = R.unruled(steps.withColumnsRenamed({"seq": "idx", "object": "tbl"}), "unruled_generated_statement")
    return unruled.unionByName(R.gap(text_gated_steps(steps, gates).withColumnRenamed("seq", "idx"), "audit_gate_text_only", F.col("object")))
