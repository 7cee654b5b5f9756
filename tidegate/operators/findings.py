"""Findings: merge, incidents, escalation, verdicts and gaps. A finding is a row of FINDING; seq gives the order of ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.functions import vocab as V
from tidegate.session import by_key

FINDING = "script_id long, seq long, code string, severity string, objects array<string>, services array<string>, evidence array<string>, source string"


def merge_findings(findings: DataFrame) -> DataFrame:
    """One row for each (script, code, set of objects): the highest severity (the earliest of equals), all evidence and services."""
    f = findings.withColumn("objects", F.array_sort(F.array_distinct("objects")))
    order = F.struct(X.severity_rank(F.col("severity")), -F.col("seq"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    out = f.groupBy("script_id", "code", "objects").agg(F.max_by("severity", order).alias("severity"), F.min("seq").alias("seq"), union("services"), union("evidence"), F.max_by("source", order).alias("top"), F.bool_or(F.col("source") == "replay").alias("replayed"))
    return out.withColumn("source", F.when(F.col("replayed") & (F.col("top") != "replay"), "replay+static").otherwise(F.col("top"))).select("script_id", "seq", "code", "severity", "objects", "services", "evidence", "source")


def ranked(findings: DataFrame) -> DataFrame:
    """Blockers first, then by code."""
    return findings.orderBy("script_id", X.severity_rank(F.col("severity")).desc(), "code", "seq")


def recall(findings: DataFrame, incidents: DataFrame) -> DataFrame:
    """(script_id, code, incident_id, match, bump, rank): past incidents with a finding's code.

    ``incidents`` (id, hazard_code, tables, services, severity_bump). A shared table ranks before a shared service, that
    before the code alone; then by bump, highest first, and by id.
    """
    f = findings.select("script_id", "seq", "code", "objects", F.col("services").alias("own"))
    i = incidents.select(F.col("id").alias("incident_id"), F.col("hazard_code").alias("code"), "tables", "services", F.col("severity_bump").alias("bump"))
    met = f.join(i, "code").withColumn("match", F.when(F.arrays_overlap("objects", "tables"), "table").when(F.arrays_overlap("own", "services"), "service").otherwise("pattern"))
    level = F.when(F.col("match") == "table", 0).when(F.col("match") == "service", 1).otherwise(2)
    w = Window.partitionBy("script_id", "seq").orderBy(level, F.col("bump").desc(), "incident_id")
    return met.withColumn("rank", F.row_number().over(w)).select("script_id", "seq", "code", "incident_id", "match", "bump", "rank")


def escalate(findings: DataFrame, incidents: DataFrame) -> DataFrame:
    """Findings with severity raised by the largest bump of table and service matches, and the incidents cited. Never lowers."""
    r = recall(findings, incidents)
    close = F.col("match") != "pattern"
    cited = r.groupBy("script_id", "seq").agg(F.max(F.when(close, F.col("bump"))).alias("bump"), F.array_sort(F.collect_list(F.when(close, F.col("incident_id")))).alias("near"), F.min(F.when(F.col("rank") == 1, F.col("incident_id"))).alias("first"))
    out = findings.join(cited, ["script_id", "seq"], "left")
    refs = F.when(F.size("near") > 0, F.col("near")).when(F.col("first").isNotNull(), F.array("first")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"severity": X.bump(F.col("severity"), F.coalesce("bump", F.lit(0))), "memory_refs": refs}).drop("bump", "near", "first")


def outcome_diff(pre: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, state): broken (worked before, fails or is absent after), fixed, added, same. Both (query_id, ok)."""
    a, b = pre.select("query_id", F.col("ok").alias("was")), post.select("query_id", F.col("ok").alias("now"))
    state = F.when(F.col("was") & ~F.coalesce("now", F.lit(False)), "broken").when(F.col("was").isNull(), "added").when(~F.col("was") & F.col("now"), "fixed").otherwise("same")
    return a.join(b, "query_id", "full_outer").select("query_id", state.alias("state"))


def cross_service(findings: DataFrame, owners: DataFrame) -> DataFrame:
    """(script_id, services): services hit by consumer breakage that are neither the owner nor `database`."""
    hit = findings.where(F.col("code").isin("BREAKING_QUERY", "SELECT_STAR_DRIFT", "VIEW_BREAKAGE")).select("script_id", F.explode("services").alias("service"))
    return hit.join(by_key(owners), "script_id").where("service <> owner and service <> 'database'").groupBy("script_id").agg(F.array_sort(F.collect_set("service")).alias("services"))


def fold_view_breakage(broken_views: DataFrame, log_tokens: DataFrame) -> DataFrame:
    """Broken views (script_id, name) that no statement of the log names."""
    return broken_views.join(log_tokens.select(F.col("token").alias("name")).distinct(), "name", "left_anti").select("script_id", "name")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("script_id").pivot("severity", V.SEVERITIES).count().fillna(0)


def verdict(findings: DataFrame) -> DataFrame:
    """(script_id, verdict): any blocker blocks; any high needs the plan; else safe."""
    top = F.max(X.severity_rank(F.col("severity")))
    return findings.groupBy("script_id").agg(top.alias("r")).select("script_id", F.when(F.col("r") == 4, "BLOCK").when(F.col("r") == 3, "SAFE_WITH_PLAN").otherwise("SAFE").alias("verdict"))


def cap_verdict(verdicts: DataFrame, gaps: DataFrame) -> DataFrame:
    """A verdict short of BLOCK needs a sign-off where its script has a gap."""
    n = gaps.groupBy("script_id").agg(F.count(F.lit(1)).alias("gaps"))
    out = verdicts.join(by_key(n), "script_id", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    return out.withColumn("verdict", F.when((F.col("gaps") > 0) & (F.col("verdict") != "BLOCK"), "NEEDS_COVERAGE_SIGNOFF").otherwise(F.col("verdict")))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """(script_id, kinds, irreversible): sorted distinct gap kinds, and objects whose gap can't be undone."""
    return gaps.groupBy("script_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set(F.when(F.col("irreversible"), F.col("object")))).alias("irreversible"))


def first_gap(gaps: DataFrame) -> DataFrame:
    """One gap for each (script, kind, object): the first by seq."""
    w = Window.partitionBy("script_id", "kind", "object").orderBy("seq")
    return gaps.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def signoff_gates(gaps: DataFrame) -> DataFrame:
    return gaps.select("script_id", "seq", F.concat(F.when(F.col("irreversible"), "IRREVERSIBLE - ").otherwise(""), F.col("kind"), F.lit(": "), F.col("object")).alias("gate"))


def highest_per_code(findings: DataFrame) -> DataFrame:
    """(script_id, code, severity): the highest severity of each code."""
    return findings.groupBy("script_id", "code").agg(X.severity_name(F.max(X.severity_rank(F.col("severity")))).alias("severity"))


def verification(scripts: DataFrame, broken: DataFrame, drift: DataFrame, data_errors: DataFrame) -> DataFrame:
    """(script_id, problems, verified, first) for each of ``scripts`` (script_id): a script without problems is verified.

    Problems are of three kinds, each (script_id, problem); first: the first three, for a retry.
    """
    every = broken.unionByName(drift).unionByName(data_errors)
    order = Window.partitionBy("script_id").orderBy("problem")
    few = every.withColumn("_n", F.row_number().over(order)).where("_n <= 3").groupBy("script_id").agg(F.array_sort(F.collect_list("problem")).alias("first"))
    n = every.groupBy("script_id").agg(F.count("problem").alias("problems"))
    out = scripts.select("script_id").distinct().join(n, "script_id", "left").join(few, "script_id", "left")
    return out.select("script_id", F.coalesce("problems", F.lit(0)).alias("problems"), F.col("problems").isNull().alias("verified"), F.coalesce("first", F.array().cast("array<string>")).alias("first"))


def new_blockers(findings: DataFrame, known: DataFrame) -> DataFrame:
    """(hazard_code, tables): blockers whose code and tables no incident has yet."""
    new = findings.where("severity = 'blocker'").select(F.col("code").alias("hazard_code"), F.array_sort(F.array_distinct("objects")).alias("tables")).distinct()
    return new.join(known.select("hazard_code", F.array_sort(F.array_distinct("tables")).alias("tables")), ["hazard_code", "tables"], "left_anti")
