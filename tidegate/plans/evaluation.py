"""Queries for labelled evaluation and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import vocab as V
from tidegate.operators import evaluate as E
from tidegate.operators import runs as R
from tidegate.plans import bindings as B
from tidegate.plans.registry import query
from tidegate.session import table

_FAM = lambda c: "CASE " + " ".join(f"WHEN {c} IN ({', '.join(repr(x) for x in cs)}) THEN '{f}'" for f, cs in V.FAMILIES.items()) + f" ELSE {c} END"
_RANK = "list_position(['low','medium','high','blocker'], severity)"
_S = f"""(SELECT c.case_id, c.arm, blocking, verdict, plan_verified, human_gates, coalesce(g, []) AS g, coalesce(p, []) AS p, coalesce(gs, []) AS gs, coalesce(ps, []) AS ps, coalesce(n, 0) AS findings, coalesce(e, 0) AS evidenced,
  list_distinct(list_transform(coalesce(g, []), lambda x: {_FAM('x')})) AS gf, list_distinct(list_transform(coalesce(p, []), lambda x: {_FAM('x')})) AS pf
FROM {B.CASES} c LEFT JOIN (SELECT case_id, list_sort(list(DISTINCT code)) AS g, list(s) AS gs FROM (SELECT case_id, code, code || '>' || CAST(max({_RANK}) AS VARCHAR) AS s FROM {B.TRUTH} t GROUP BY case_id, code) GROUP BY case_id) t USING (case_id)
LEFT JOIN (SELECT case_id, arm, list_sort(list(code)) AS p, list(s) AS ps, sum(n) AS n, sum(e) AS e FROM (SELECT case_id, arm, code, code || '>' || CAST(max({_RANK}) AS VARCHAR) AS s, count(*) AS n, count(*) FILTER (evidenced) AS e FROM {B.PREDICTED} p GROUP BY case_id, arm, code) GROUP BY case_id, arm) p USING (case_id, arm))"""
_both = lambda a, b: f"list_sort(list_filter({a}, lambda x: list_contains({b}, x)))"
_less = lambda a, b: f"list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
_MIN = "5 + (findings - evidenced) * 4 + CASE WHEN plan_verified THEN human_gates * 3 WHEN blocking OR len(p) > 0 THEN 20 ELSE 0 END"
_SCORES = f"""(SELECT case_id, arm, blocking, verdict, plan_verified, human_gates, g, p, findings, evidenced, {_both('g', 'p')} AS tp, {_less('p', 'g')} AS fp, {_less('g', 'p')} AS fn, {_both('gf', 'pf')} AS fam_tp, {_less('pf', 'gf')} AS fam_fp, {_less('gf', 'pf')} AS fam_fn, {_both('gs', 'ps')} AS sm,
  blocking AND verdict IN ('APPROVE', 'SAFE') AS unsafe_approval, blocking AND verdict IN ('APPROVE', 'SAFE', 'SAFE_WITH_PLAN') AS clean_on_blocking, NOT blocking AND len(g) = 0 AND len(p) > 0 AS false_alarm, {_MIN} AS minutes FROM {_S} s)"""


def _scores(spark, d):
    return E.score_cases(*(B.rows(spark, d, x) for x in (B.CASES, B.TRUTH, B.PREDICTED)))


_J = lambda c: f"array_to_string({c}, ',') AS {c}"


@query(f"""SELECT case_id, arm, blocking, verdict, plan_verified, human_gates, array_to_string(g, ',') AS gt_codes, array_to_string(p, ',') AS pred_codes, {', '.join(_J(c) for c in ('tp', 'fp', 'fn', 'fam_tp', 'fam_fp', 'fam_fn'))},
array_to_string(list_transform(sm, lambda x: split_part(x, '>', 1)), ',') AS severity_matches, unsafe_approval, clean_on_blocking, false_alarm, findings, evidenced, minutes FROM {_SCORES} q""")
def g7_score_cases(spark, d):
    return _scores(spark, d)


_RATIO = lambda a, b: f"CASE WHEN {b} = 0 THEN 1.0 ELSE {a} / ({b}) END"
_SUMS = f"""(SELECT arm, count(*) AS cases, {', '.join(f'CAST(sum(len({c})) AS BIGINT) AS {c}' for c in ('tp', 'fp', 'fn', 'fam_tp', 'fam_fp', 'fam_fn'))}, CAST(sum(len(sm)) AS BIGINT) AS severity_matches, count(*) FILTER (unsafe_approval) AS unsafe_approval, count(*) FILTER (clean_on_blocking) AS clean_on_blocking,
 count(*) FILTER (false_alarm) AS false_alarm, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(evidenced) AS BIGINT) AS evidenced, avg(minutes) AS minutes FROM {_SCORES} q GROUP BY arm)"""
_TOTALS = f"""(SELECT *, {_RATIO('severity_matches', 'tp')} AS severity_agreement, {_RATIO('tp', 'tp + fp')} AS "precision", {_RATIO('tp', 'tp + fn')} AS recall, {_RATIO('fam_tp', 'fam_tp + fam_fp')} AS fam_precision, {_RATIO('fam_tp', 'fam_tp + fam_fn')} AS fam_recall FROM {_SUMS} q)"""
_F1 = lambda p, r: f"CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END"


@query(f"""SELECT *, {_F1('"precision"', 'recall')} AS f1, {_F1('fam_precision', 'fam_recall')} AS fam_f1 FROM {_TOTALS} t""")
def g8_aggregate_scores(spark, d):
    return E.aggregate_scores(_scores(spark, d))


_OUT = "['MISSING_ROLLBACK']"


@query(f"SELECT arm, {_RATIO('t', 't + n')} AS recall FROM (SELECT arm, sum(len({_less('tp', _OUT)})) AS t, sum(len({_less('fn', _OUT)})) AS n FROM {_SCORES} q GROUP BY arm) x")
def g9_recall_excluding(spark, d):
    return E.recall_excluding(_scores(spark, d), ["MISSING_ROLLBACK"])


@query(" UNION ALL ".join(f"""SELECT a.arm, '{m}' AS metric, CAST({s} * (a."{m}" - b."{m}") AS DOUBLE) AS delta FROM {_TOTALS} a, {_TOTALS} b WHERE a.arm <> 'arm0' AND b.arm = 'arm0'""" for m, s in (("recall", -1), ("precision", -1), ("severity_agreement", -1), ("unsafe_approval", 1), ("minutes", 1))))
def g10_component_cost(spark, d):
    return E.component_cost(E.aggregate_scores(_scores(spark, d)), "arm0")


_CONST = "(SELECT 'mid' AS name, 5 AS rd, 4 AS vf, 20 AS pl, 3 AS gt UNION ALL SELECT 'heavy gates', 5, 1, 5, 30 UNION ALL SELECT 'light', 2, 2, 10, 1)"


@query(f"""SELECT name, min(m) FILTER (arm <> 'arm0') AS baseline, max(m) FILTER (arm = 'arm0') AS candidate, (min(m) FILTER (arm <> 'arm0') - max(m) FILTER (arm = 'arm0')) / min(m) FILTER (arm <> 'arm0') AS reduction,
(min(m) FILTER (arm <> 'arm0') - max(m) FILTER (arm = 'arm0')) / min(m) FILTER (arm <> 'arm0') <= 0 AS reverses, (min(m) FILTER (arm <> 'arm0') - max(m) FILTER (arm = 'arm0')) / min(m) FILTER (arm <> 'arm0') < 0.1 AS collapses
FROM (SELECT name, arm, avg(rd + (findings - evidenced) * vf + CASE WHEN plan_verified THEN human_gates * gt WHEN blocking OR len(p) > 0 THEN pl ELSE 0 END) AS m FROM {_SCORES} q, {_CONST} c GROUP BY name, arm) x GROUP BY name""")
def g11_sensitivity_band(spark, d):
    c = spark.createDataFrame([("mid", 5, 4, 20, 3), ("heavy gates", 5, 1, 5, 30), ("light", 2, 2, 10, 1)], "name string, read int, verify int, plan int, gate int")
    return E.sensitivity_band(_scores(spark, d), c, "arm0")


@query(f"SELECT case_id, arm, CAST(minutes + case_id % 2 AS DOUBLE) AS stored, CAST(minutes AS DOUBLE) AS recomputed FROM {_SCORES} q WHERE case_id % 2 = 1")
def g12_minutes_selfcheck(spark, d):
    return E.minutes_selfcheck(_scores(spark, d).withColumn("kept", F.col("minutes") + F.col("case_id") % 2), "kept")


@query(f"""SELECT * FROM (SELECT 'recall holds' AS claim, '>=' AS comparator, 0.1::DOUBLE AS expected, recall AS actual, recall >= 0.1 AS ok FROM {_TOTALS} t WHERE arm = 'arm1' UNION ALL SELECT 'no approvals', '==', 0.0, unsafe_approval, unsafe_approval = 0 FROM {_TOTALS} t WHERE arm = 'arm1' UNION ALL SELECT 'unknown', '<', 1.0, NULL, false FROM {_TOTALS} t WHERE arm = 'arm1')""")
def g18_claims_audit(spark, d):
    t = E.aggregate_scores(_scores(spark, d)).where("arm = 'arm1'")
    metrics = t.select(F.inline(F.array(F.struct(F.lit("recall").alias("metric"), F.col("recall").alias("actual")), F.struct(F.lit("unsafe").alias("metric"), F.col("unsafe_approval").cast("double").alias("actual")))))
    claims = spark.createDataFrame([("recall holds", "recall", ">=", 0.1), ("no approvals", "unsafe", "==", 0.0), ("unknown", "nothing", "<", 1.0)], "claim string, metric string, comparator string, expected double")
    return E.claims_audit(metrics, claims)


_MOVED = ", ".join(f"CASE WHEN a.{c} <> b.{c} THEN '{c}' END" for c in ("verdict", "tp", "fp", "fn", "human_gates")).replace("'human_gates'", "'gaps'")


@query(f"SELECT * FROM (SELECT case_id, array_to_string(list_filter([{_MOVED}], lambda x: x IS NOT NULL), ',') AS moved FROM {_SCORES} a JOIN {_SCORES} b USING (case_id) WHERE a.arm = 'arm0' AND b.arm = 'arm1') x WHERE moved <> ''")
def j20_arm_parity(spark, d):
    return E.arm_parity(_scores(spark, d).withColumn("gaps", F.col("human_gates")), "arm0", "arm1")


# ---- run logs ------------------------------------------------------------------------------------------------------
_M1, _M2 = "(SELECT CAST(doc_id AS STRING) AS path, lang || source AS sha256 FROM documents WHERE doc_id % 7 <> 0)", "(SELECT CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE lang || source END AS sha256 FROM documents WHERE doc_id % 5 <> 0)"


@query(f"SELECT * FROM (SELECT path, CASE WHEN a.sha256 IS NULL THEN 'added' WHEN b.sha256 IS NULL THEN 'removed' WHEN a.sha256 <> b.sha256 THEN 'changed' END AS state FROM {_M1} a FULL JOIN {_M2} b USING (path)) x WHERE state IS NOT NULL")
def j17_manifest_drift(spark, d):
    return R.manifest_drift(B.rows(spark, d, _M1), B.rows(spark, d, _M2))


_TREE = "CAST(user_id % 7 AS STRING) || '/' || CAST(user_id AS STRING) || '/' || event_type || '/' || CAST(event_id AS STRING) AS path"
_T1, _T2 = f"(SELECT {_TREE}, CAST(value AS STRING) AS sha256 FROM events WHERE event_id % 4000 <> 9)", f"(SELECT {_TREE}, CASE WHEN event_id % 5000 = 3 THEN 'x' ELSE CAST(value AS STRING) END AS sha256 FROM events WHERE event_id % 3000 <> 5)"


@query(f"SELECT {_TREE}, CASE WHEN event_id % 4000 = 9 THEN 'added' WHEN event_id % 3000 = 5 THEN 'removed' ELSE 'changed' END AS state FROM events WHERE (event_id % 4000 = 9 AND event_id % 3000 <> 5) OR (event_id % 4000 <> 9 AND (event_id % 3000 = 5 OR event_id % 5000 = 3))")
def j17_drift_by_folder(spark, d):
    """Two trees of four levels that differ in few files: digests of folders are compared, level by level, before files are."""
    return R.manifest_drift_by_folder(B.rows(spark, d, _T1), B.rows(spark, d, _T2))


_D1, _D2 = "(SELECT event_id AS id, 'took ' || CAST(user_id AS STRING) || ' ms ' || event_type AS text FROM events WHERE event_id % 9 <> 0)", "(SELECT event_id AS id, 'took ' || CAST(CASE WHEN event_id % 2 = 0 THEN user_id ELSE 7 END AS STRING) || ' ms ' || CASE WHEN event_id % 5 = 0 THEN 'z' ELSE event_type END AS text FROM events)"


@query(f"SELECT id, CASE WHEN a.text IS NULL OR b.text IS NULL THEN 'missing' WHEN a.text = b.text THEN 'identical' WHEN regexp_replace(a.text, '\\d+ ms', 'x') = regexp_replace(b.text, '\\d+ ms', 'x') THEN 'clock-only' ELSE 'real' END AS state FROM {_D1} a FULL JOIN {_D2} b USING (id)")
def j18_run_drift(spark, d):
    return R.run_drift(B.rows(spark, d, _D1), B.rows(spark, d, _D2))


@query("SELECT count(*) AS n, max(abs(x - y)) AS worst_abs, max(abs(x - y) / nullif(greatest(abs(x), abs(y)), 0)) AS worst_rel FROM (SELECT event_id, value AS x, value * (1 + (event_id % 3) / 100.0) AS y FROM events)")
def j19_clock_delta(spark, d):
    e = table(spark, d, "events")
    return R.clock_delta(e.select(F.col("event_id").alias("id"), F.col("value").alias("v")), e.select(F.col("event_id").alias("id"), (F.col("value") * (1 + F.col("event_id") % 3 / 100.0)).alias("v")))


@query(f"SELECT provider, mode, case_id, array_to_string(list_filter([CASE WHEN verdict <> 'SAFE' THEN 'verdict' END, CASE WHEN gaps <> case_id % 2 THEN 'gaps' END], lambda x: x IS NOT NULL), ',') AS changed FROM {B.RUNS} r WHERE verdict <> 'SAFE' OR gaps <> case_id % 2")
def j21_surface_changes(spark, d):
    runs = B.rows(spark, d, B.RUNS)
    return R.surface_changes(runs, runs.select("case_id", F.lit("SAFE").alias("verdict"), (F.col("case_id") % 2).alias("gaps")).distinct(), ["verdict", "gaps"])


@query(f"SELECT provider, mode, count(*) AS runs, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in ('crashed', 'surface_changed', 'model_written', 'misleading', 'flagged'))} FROM {B.RUNS} r GROUP BY provider, mode")
def g13_invariance_matrix(spark, d):
    return R.invariance_matrix(B.rows(spark, d, B.RUNS))


_CACHE = f"(SELECT key, max('r' || key) AS response FROM {B.CALLS} c WHERE call_id % 2 = 0 GROUP BY key)"


@query(f"SELECT call_id, response IS NOT NULL AS hit, response, CASE WHEN response IS NOT NULL THEN 0.0 ELSE cost END AS cost FROM {B.CALLS} c LEFT JOIN {_CACHE} k USING (key)")
def j22_cached_calls(spark, d):
    return R.cached_calls(B.rows(spark, d, B.CALLS), B.rows(spark, d, _CACHE))


@query(f"SELECT run, model, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, sum(cost) AS cost FROM {B.CALLS} c GROUP BY run, model")
def g14_cost_rollup(spark, d):
    return R.cost_rollup(B.rows(spark, d, B.CALLS), "run", "model")


#: a conversation's turns as the events of two agents
_STEPS = f"(SELECT run, ms, 'agent' || CAST(seq % 2 AS STRING) AS agent, CASE WHEN length(text) % 5 = 0 THEN 'retry' WHEN length(text) % 7 = 0 THEN 'human_checkpoint' WHEN kind = 'assistant' THEN 'tool_call' ELSE kind END AS kind FROM {B.TRACE} t)"
_SUMMED = "count(*) AS events, count(*) FILTER (kind = 'user') AS n_user, sum(ms) AS ms, count(*) FILTER (kind = 'tool_call') AS tool_calls, coalesce(sum(ms) FILTER (kind = 'tool_call'), 0) AS tool_ms, count(*) FILTER (kind = 'retry') AS retries, count(*) FILTER (kind = 'human_checkpoint') AS checkpoints"


@query(f"SELECT run, {_SUMMED} FROM {_STEPS} s GROUP BY run")
def g15_trace_summary(spark, d):
    return R.trace_summary(B.rows(spark, d, _STEPS), ["user"])


@query(f"SELECT run, agent, {_SUMMED} FROM {_STEPS} s GROUP BY run, agent")
def g15_trace_summary_by_agent(spark, d):
    return R.trace_summary(B.rows(spark, d, _STEPS), ["user"], "agent")


@query(f"SELECT run, seq, last_value(CASE WHEN kind = 'user' THEN 'u' || CAST(seq AS VARCHAR) END IGNORE NULLS) OVER w AS agent, row_number() OVER w AS n, t_ms - lag(t_ms) OVER w AS gap FROM {B.TRACE} t WINDOW w AS (PARTITION BY run ORDER BY seq)")
def w6_agent_sections(spark, d):
    t = B.rows(spark, d, B.TRACE).select("run", "seq", "kind", "t_ms")
    return R.agent_sections(t, F.col("kind") == "user", F.concat(F.lit("u"), F.col("seq").cast("string"))).select("run", "seq", "agent", "n", "gap")


@query(f"SELECT * FROM (SELECT run, seq AS attempt, kind, lag(seq) OVER w AS previous, lag(kind) OVER w AS last_kind FROM {B.TRACE} t WINDOW w AS (PARTITION BY run ORDER BY seq)) x WHERE previous IS NOT NULL")
def w7_previous_attempt(spark, d):
    return R.previous_attempt(B.rows(spark, d, B.TRACE).select("run", F.col("seq").alias("attempt"), "kind"), "kind")


@query(f"SELECT run, count(*) AS events, CAST(sum(seq) AS BIGINT) AS seqs FROM {B.TRACE} t GROUP BY run")
def s6_trace(spark, d):
    t = B.rows(spark, d, B.TRACE)
    return t.where("kind <> 'run_start'").groupBy("run").agg(F.count(F.lit(1)).alias("events"), F.sum("seq").alias("seqs"))


@query(f"SELECT bucket, kind, count(*) AS n FROM (SELECT kind, CASE {' '.join(f'WHEN kind IN ({chr(44).join(repr(k) for k in ks)}) THEN {b!r}' for b, ks in V.BUCKETS.items())} ELSE 'UNCLASSIFIED' END AS bucket FROM {B.OPS} o) x GROUP BY ROLLUP (bucket, kind)")
def g16_kind_inventory(spark, d):
    return R.kind_inventory(B.rows(spark, d, B.OPS).select("kind"))


_ASKED = f"(SELECT run AS case_id, seq AS pos, CASE seq % 4 WHEN 0 THEN 'Ship it?' WHEN 1 THEN 'Who owns ' || kind || '?' ELSE text END AS question FROM {B.TRACE} t)"
_CLEANED = r"substr(trim(regexp_replace(regexp_replace(coalesce(question, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), 1, 220)"
_KEPT = f"(SELECT case_id, question, min(pos) AS pos FROM (SELECT case_id, pos, {_CLEANED} AS question FROM {_ASKED} a) x WHERE question <> '' AND NOT regexp_matches(question, '{V.INJECTION}') AND NOT regexp_matches(question, '{V.CLEAN_CLAIM}') GROUP BY case_id, question)"


@query(f"""SELECT case_id, n, question FROM (SELECT case_id, question, row_number() OVER (PARTITION BY case_id ORDER BY pos, question) AS n FROM (SELECT * FROM {_KEPT} k UNION ALL SELECT DISTINCT run, 'What is the accepted risk for ' || kind || '?', 0 FROM {B.TRACE} t WHERE run NOT IN (SELECT case_id FROM {_KEPT} k)) y) z WHERE n <= 8""")
def l4_kept_questions(spark, d):
    t = B.rows(spark, d, B.TRACE)
    return R.kept_questions(B.rows(spark, d, _ASKED), t.select(F.col("run").alias("case_id"), F.lit("BLOCK").alias("verdict")).distinct(), t.select(F.col("run").alias("case_id"), F.col("kind").alias("code")))
