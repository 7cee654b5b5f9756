"""Scoring findings against labelled truth: confusion sets, precision and recall, ablations, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.functions import vocab as V


def _codes(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    pairs = F.struct("code", X.severity_rank(F.col("severity")).alias("r"))
    best = df.where("code is not null").select(*keys, pairs.alias("p"), F.coalesce("evidenced", F.lit(False)).alias("evidenced"))
    return best.groupBy(*keys).agg(F.array_sort(F.collect_set("p.code")).alias(f"{name}_codes"), F.collect_set("p").alias(f"{name}_pairs"), F.count(F.lit(1)).alias(f"{name}_n"), F.count_if("evidenced").alias(f"{name}_evidenced"))


def _best(pairs: Column) -> Column:
    """code>rank with the highest rank of each code."""
    top = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["code"] == p["code"]) & (q["r"] > p["r"])))
    return F.transform(top, lambda p: F.concat_ws(">", p["code"], p["r"].cast("string")))


def score_cases(cases: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each (arm, case): tp, fp, fn codes, the same by family, severity matches, flags and counts.

    ``cases`` (case_id, arm, blocking, verdict, plan_verified, human_gates); ``truth`` (case_id, code, severity);
    ``predicted`` (case_id, arm, code, severity, evidenced). Cases without findings on either side are kept.
    """
    t = _codes(truth.withColumn("evidenced", F.lit(False)), ["case_id"], "gt")
    p = _codes(predicted, ["case_id", "arm"], "pred")
    none = F.array().cast("array<string>")
    s = cases.join(t, "case_id", "left").join(p, ["case_id", "arm"], "left")
    s = s.withColumns({c: F.coalesce(c, none) for c in ("gt_codes", "pred_codes")} | {c: F.coalesce(c, F.lit(0)) for c in ("pred_n", "pred_evidenced")})
    fam = lambda c: F.array_distinct(F.transform(c, X.family))
    both, less = (lambda a, b: F.array_sort(F.array_intersect(a, b))), (lambda a, b: F.array_sort(F.array_except(a, b)))
    g, q = F.col("gt_codes"), F.col("pred_codes")
    matches = F.array_sort(F.transform(F.array_intersect(_best(F.coalesce("gt_pairs", F.array())), _best(F.coalesce("pred_pairs", F.array()))), lambda x: F.split(x, ">")[0]))
    out = s.withColumns({"tp": both(g, q), "fp": less(q, g), "fn": less(g, q), "fam_tp": both(fam(g), fam(q)), "fam_fp": less(fam(q), fam(g)), "fam_fn": less(fam(g), fam(q)), "severity_matches": matches})
    out = out.withColumns({"unsafe_approval": F.col("blocking") & F.col("verdict").isin(*V.APPROVE_SET), "clean_on_blocking": F.col("blocking") & F.col("verdict").isin(*V.CLEAN_SET), "false_alarm": ~F.col("blocking") & (F.size("gt_codes") == 0) & (F.size("pred_codes") > 0)})
    out = out.withColumn("minutes", X.reviewer_minutes(F.col("pred_n") - F.col("pred_evidenced"), F.col("plan_verified"), F.col("human_gates"), F.col("blocking"), F.size("pred_codes")))
    return out.select("case_id", "arm", "blocking", "verdict", "plan_verified", "human_gates", "gt_codes", "pred_codes", "tp", "fp", "fn", "fam_tp", "fam_fp", "fam_fn", "severity_matches", "unsafe_approval", "clean_on_blocking", "false_alarm", F.col("pred_n").alias("findings"), F.col("pred_evidenced").alias("evidenced"), "minutes")


def ratio(a: Column, b: Column) -> Column:
    """a / b; 1 where b is 0."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 (strict and by family), severity agreement and flags for each arm."""
    n = lambda c: F.sum(F.size(c)).alias(c)
    a = scores.groupBy("arm").agg(F.count(F.lit(1)).alias("cases"), *(n(c) for c in ("tp", "fp", "fn", "fam_tp", "fam_fp", "fam_fn", "severity_matches")), *(F.count_if(c).alias(c) for c in ("unsafe_approval", "clean_on_blocking", "false_alarm")), F.sum("findings").alias("findings"), F.sum("evidenced").alias("evidenced"), F.avg("minutes").alias("minutes"))
    for pre in ("", "fam_"):
        tp, fp, fn = (F.col(pre + c) for c in ("tp", "fp", "fn"))
        a = a.withColumns({f"{pre}precision": ratio(tp, tp + fp), f"{pre}recall": ratio(tp, tp + fn)})
        p, r = F.col(f"{pre}precision"), F.col(f"{pre}recall")
        a = a.withColumn(f"{pre}f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))
    return a.withColumn("severity_agreement", ratio(F.col("severity_matches"), F.col("tp")))


def recall_excluding(scores: DataFrame, codes: list[str]) -> DataFrame:
    """(arm, recall) with some codes out of the labels."""
    out = F.array(*(F.lit(c) for c in codes))
    size = lambda c: F.sum(F.size(F.array_except(c, out)))
    return scores.groupBy("arm").agg(size("tp").alias("_t"), size("fn").alias("_n")).select("arm", ratio(F.col("_t"), F.col("_t") + F.col("_n")).alias("recall"))


def component_cost(totals: DataFrame, full: str) -> DataFrame:
    """(arm, metric, delta): what an arm without a component loses against the full one; + means the component earns its place."""
    signs = {"recall": -1, "precision": -1, "severity_agreement": -1, "unsafe_approval": 1, "minutes": 1}
    base = totals.where(F.col("arm") == full).select(*(F.col(c).alias(f"b_{c}") for c in signs))
    both = totals.where(F.col("arm") != full).crossJoin(F.broadcast(base))  # one row
    return both.select("arm", F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), (s * (F.col(c) - F.col(f"b_{c}"))).cast("double").alias("delta")) for c, s in signs.items()))))


def sensitivity_band(scores: DataFrame, constants: DataFrame, candidate: str) -> DataFrame:
    """Mean minutes of the candidate and of the best other arm under each set of minute constants.

    ``constants`` (name, read, verify, plan, gate) is a handful of rows, broadcast: each score meets each set.
    """
    m = scores.crossJoin(F.broadcast(constants)).withColumn("m", X.reviewer_minutes(F.col("findings") - F.col("evidenced"), F.col("plan_verified"), F.col("human_gates"), F.col("blocking"), F.size("pred_codes"), F.col("read"), F.col("verify"), F.col("plan"), F.col("gate")))
    per = m.groupBy("name", "arm").agg(F.avg("m").alias("m")).groupBy("name").agg(F.min(F.when(F.col("arm") != candidate, F.col("m"))).alias("baseline"), F.max(F.when(F.col("arm") == candidate, F.col("m"))).alias("candidate"))
    out = per.withColumn("reduction", (F.col("baseline") - F.col("candidate")) / F.col("baseline"))
    return out.withColumns({"reverses": F.col("reduction") <= 0, "collapses": F.col("reduction") < 0.1})


def minutes_selfcheck(scores: DataFrame, stored: str) -> DataFrame:
    """Rows whose stored minutes differ from those recomputed."""
    again = X.reviewer_minutes(F.col("findings") - F.col("evidenced"), F.col("plan_verified"), F.col("human_gates"), F.col("blocking"), F.size("pred_codes"))
    return scores.select("case_id", "arm", F.col(stored).cast("double").alias("stored"), again.cast("double").alias("recomputed")).where("abs(stored - recomputed) > 1e-9")


def claims_audit(metrics: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim, comparator, expected, actual, ok). ``metrics`` (metric, actual); ``claims`` (claim, metric, comparator, expected). A missing metric fails."""
    j = claims.join(metrics, "metric", "left")
    a, e, c = F.col("actual"), F.col("expected"), F.col("comparator")
    ok = F.when(c == "==", F.abs(a - e) < 1e-9).when(c == ">=", a >= e).when(c == "<=", a <= e).when(c == "<", a < e).when(c == ">", a > e)
    return j.select("claim", "comparator", "expected", "actual", F.coalesce(ok, F.lit(False)).alias("ok"))


def arm_parity(scores: DataFrame, base: str, other: str) -> DataFrame:
    """(case_id, moved): cases where verdict, tp, fp, fn or declared gaps of two arms differ, with the names of what moved.

    gaps: a column of ``scores`` with the number of declared gaps; it is compared where it is there.
    """
    cols = ["verdict", "tp", "fp", "fn", *(c for c in scores.columns if c == "gaps")]
    a = scores.where(F.col("arm") == base).select("case_id", *cols)
    b = scores.where(F.col("arm") == other).select("case_id", *(F.col(c).alias(f"o_{c}") for c in cols))
    moved = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"o_{c}")), c) for c in cols)))
    return a.join(b, "case_id").select("case_id", moved.alias("moved")).where(F.size("moved") > 0)
