"""A review of a fleet of change scripts as one plan: text to events, findings, incidents, verdict, gaps, cap."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.operators import census as CE
from tidegate.operators import corpus as C
from tidegate.operators import findings as FI
from tidegate.operators import rules as R
from tidegate.operators.events import events_by_text
from tidegate.plans import audit as A
from tidegate.plans.evidence import Evidence
from tidegate.session import by_key, materialize
from tidegate.streaming.learning import record_learning

INDEX = "name string, tbl string, columns array<string>"
INCIDENT = "id string, hazard_code string, tables array<string>, services array<string>, severity_bump int"


def read_scripts(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements and change events of ``scripts`` (script_id, text), scanned once and written: every rule reads them."""
    statements = materialize(CE.split_scripts(scripts))
    return statements, materialize(events_by_text(statements))


def claims(statements: DataFrame, ops: DataFrame) -> DataFrame:
    """``statements`` with claimed: whether a change event accounts for it, and destructive: no event does and its code takes something away."""
    own = ops.select("script_id", "idx").distinct().withColumn("_c", F.lit(True))
    out = statements.join(by_key(own), ["script_id", "idx"], "left").withColumn("claimed", F.col("_c").isNotNull())
    return out.withColumns({"destructive": ~F.col("claimed") & X.is_destructive(F.col("code")), "sql": F.col("code")}).drop("_c")


def dropped_indexes(ops: DataFrame, indexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexes that scripts drop (script_id, idx, name, tbl, columns; the last two null if unknown), and those that the same script replaces (script_id, name)."""
    drops = ops.where("kind = 'drop_index'").select("script_id", "idx", F.col("index_name").alias("name")).join(indexes, "name", "left")
    creates = ops.where("kind = 'create_index'").select("script_id", "tbl", F.col("index_name").alias("name"), "columns")
    return drops, C.replaced_indexes(drops.select("script_id", "name", "tbl", "columns"), creates).select("script_id", "name").distinct()


@dataclass
class Paths:
    """What scripts' dropped indexes mean to a log, found once and written: rules and gaps both ask."""

    #: (script_id, idx, name, tbl, columns)
    drops: DataFrame
    #: (script_id, name) that the same script replaces
    replaced: DataFrame
    #: (name, service, criticality), distinct, of statements that look up by a dropped index
    users: DataFrame


def access_paths(ops: DataFrame, log: DataFrame, indexes: DataFrame) -> Paths:
    drops, replaced = dropped_indexes(ops, indexes)
    drops = materialize(drops)
    used = materialize(indexes.join(drops.select("name").distinct(), "name", "left_semi"))
    return Paths(drops, replaced, materialize(C.access_path_users(C.forms(log), used).select("name", "service", "criticality").distinct()))


def unused_drops(paths: Paths) -> DataFrame:
    """(script_id, idx, tbl, columns) of dropped indexes that nothing replaces and no statement looks up by; an unknown index's name stands for its columns."""
    left = paths.drops.join(paths.replaced, ["script_id", "name"], "left_anti").join(paths.users.select("name").distinct(), "name", "left_anti")
    return left.select("script_id", "idx", "tbl", F.coalesce("columns", F.array("name")).alias("columns"))


def _paths(ops: DataFrame, log: DataFrame, indexes: DataFrame | None) -> tuple[DataFrame, Paths]:
    known = materialize(indexes) if indexes is not None else ops.sparkSession.createDataFrame([], INDEX)  # a catalogue, read by several rules
    return known, access_paths(ops, log, known)


def review_findings(
    scripts: DataFrame, statements: DataFrame, ops: DataFrame, stats: DataFrame, log: DataFrame, indexes: DataFrame | None = None,
    incidents: DataFrame | None = None, constraints: DataFrame | None = None, evidence: Evidence | None = None, owners: DataFrame | None = None, paths: Paths | None = None,
) -> DataFrame:
    """Merged findings of ``scripts`` (script_id, text, rollback_sql) by all rules, with past incidents counted in."""
    texts = constraints if constraints is not None else scripts.sparkSession.createDataFrame([], "index_name string, text string")
    known, paths = (indexes, paths) if paths else _paths(ops, log, indexes)
    every = [
        R.apply_rules(ops, stats), R.access_path(ops, stats, known, paths.users, paths.replaced), R.constraint_removed(ops, texts),
        R.procedural(statements), *(evidence or Evidence()).findings(owners),
    ]
    own = R.keep_unparsed(reduce(DataFrame.unionByName, every), R.unparsed(claims(statements, ops)))
    found = FI.merge_findings(own.unionByName(R.missing_rollback(scripts)))
    return FI.escalate(found, incidents) if incidents is not None else found


def review_gaps(statements: DataFrame, ops: DataFrame, log: DataFrame, indexes: DataFrame | None = None, evidence: Evidence | None = None, paths: Paths | None = None) -> DataFrame:
    """Gap ledger of scripts against the statements of a query log.

    A dropped index that isn't in ``indexes`` is a gap: neither its users nor its replacement could be looked for.
    """
    paths = paths or _paths(ops, log, indexes)[1]
    erased = R.erased_nulls(ops)
    every = [R.statement_gaps(ops), R.in_place_mutation(ops, erased), R.value_class_erased(erased), R.uncovered(C.uncovered_objects(ops, log)), R.unused_path(unused_drops(paths)), R.unattributed(claims(statements, ops))]
    return R.gap_ledger(*every, *(evidence or Evidence()).gaps())


def verdicts(scripts: DataFrame, found: DataFrame, gaps: DataFrame, defects: DataFrame | None = None) -> DataFrame:
    """(script_id, verdict, blockers, highs, gaps, broken, defects) for every script.

    A gap caps a verdict short of BLOCK, and so does a defect of the script's plan (``defects``: script_id, one row each).
    """
    counts = found.groupBy("script_id").agg(F.max(X.severity_rank(F.col("severity"))).alias("top"), F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "high").alias("highs"), F.count_if(F.col("code") == "BREAKING_QUERY").alias("broken"))
    own = scripts.select("script_id").join(by_key(counts), "script_id", "left").fillna(0)
    own = own.withColumn("verdict", F.when(F.col("top") == 4, "BLOCK").when(F.col("top") == 3, "SAFE_WITH_PLAN").otherwise("SAFE"))
    out = FI.cap_verdict(own, gaps).drop("top")
    if defects is None:
        return out.withColumn("defects", F.lit(0).cast("long"))
    return FI.cap_verdict(out.withColumnRenamed("gaps", "_g"), defects).withColumnsRenamed({"gaps": "defects", "_g": "gaps"})


def review(
    scripts: DataFrame, stats: DataFrame, log: DataFrame, indexes: DataFrame | None = None, incidents: DataFrame | None = None,
    constraints: DataFrame | None = None, evidence: Evidence | None = None, owners: DataFrame | None = None, read: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(script_id, verdict, blockers, highs, gaps, headline) for every script.

    ``scripts`` (script_id, text, rollback_sql), ``stats`` (tbl, rows), ``log`` (query_id, service, criticality, sql),
    ``indexes`` (name, tbl, columns): the catalogue's; ``constraints`` (index_name, text); ``owners`` (script_id, owner).
    ``evidence``: what scans and replays found. ``read``: statements and change events, where another reader made them;
    a statement that no event claims is then a finding if it is destructive, and a gap if not.
    """
    statements, ops = read or read_scripts(scripts)
    known, paths = _paths(ops, log, indexes)
    found = review_findings(scripts, statements, ops, stats, log, known, incidents, constraints, evidence, owners, paths)
    out = verdicts(scripts, found, review_gaps(statements, ops, log, known, evidence, paths))
    line = X.headline(F.col("verdict"), F.col("blockers"), F.col("highs"), F.col("gaps"), F.col("broken"))
    return out.select("script_id", "verdict", "blockers", "highs", "gaps", line.alias("headline"))


@dataclass
class Packet:
    """All that a review gives, keyed by script or, for dependents, by change."""

    #: (script_id, verdict, blockers, highs, gaps, defects, blast, headline)
    verdicts: DataFrame
    findings: DataFrame
    gaps: DataFrame
    #: (script_id, change): the changes of every script
    members: DataFrame
    #: (change, query_id, service, criticality, matched, select_star): statements that name what a change touches
    dependents: DataFrame
    #: (script_id, code, seq, object) of the generated plans
    plan_findings: DataFrame
    #: gaps of the generated plans; they don't cap
    plan_gaps: DataFrame
    #: incidents that the blockers teach
    learned: DataFrame


def packet(
    scripts: DataFrame, stats: DataFrame, log: DataFrame, steps: DataFrame, code_steps: DataFrame, gates: DataFrame, indexes: DataFrame | None = None, incidents: DataFrame | None = None,
    constraints: DataFrame | None = None, evidence: Evidence | None = None, owners: DataFrame | None = None, read: tuple[DataFrame, DataFrame] | None = None,
) -> Packet:
    """A review with the audit of each script's plan, who depends on its changes, and what it teaches.

    As ``review``; ``steps`` (script_id, phase, seq, kind, sql, object), ``code_steps`` and ``gates`` (script_id, text)
    are the plans. A defect of a plan is no finding about the change: it caps the verdict once more. Findings and gaps
    are written, since several parts read them.
    """
    statements, ops = read or read_scripts(scripts)
    known, paths = _paths(ops, log, indexes)
    found = materialize(review_findings(scripts, statements, ops, stats, log, known, incidents, constraints, evidence, owners, paths))
    gaps = materialize(review_gaps(statements, ops, log, known, evidence, paths))
    defects = materialize(A.plan_findings(steps, code_steps, gates))
    members, touched = C.change_members(ops), C.touched_objects(ops)
    past = incidents if incidents is not None else scripts.sparkSession.createDataFrame([], INCIDENT)
    out = verdicts(scripts, found, gaps, defects).join(by_key(C.blast_scores(log, touched).withColumnRenamed("score", "blast")), "script_id", "left")
    line = X.headline(F.col("verdict"), F.col("blockers"), F.col("highs"), F.col("gaps"), F.col("broken"))
    own = out.select("script_id", "verdict", "blockers", "highs", "gaps", "defects", F.coalesce("blast", F.lit(0)).alias("blast"), line.alias("headline"))
    return Packet(own, found, gaps, members, C.dependents(log, C.touched_by_change(members), "change"), defects, A.plan_gaps(steps, gates), record_learning(found, past))
