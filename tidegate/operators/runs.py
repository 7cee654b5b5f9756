"""Run logs: drift between runs, manifests, cost and trace summaries, decision surfaces, cached calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.functions import vocab as V
from tidegate.session import materialize


def manifest_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): added, removed or changed files. Both (path, sha256)."""
    j = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", state.alias("state")).where("state is not null")


def folder_digests(manifest: DataFrame) -> DataFrame:
    """(depth, folder, parent, files, digest) of every folder above the files of a manifest (path, sha256), the root '' at depth 0.

    A digest is two sums of hashes of all files below, so it adds up on the map side; it is stored beside a manifest and
    compared in its place.
    """
    parts = F.split("path", "/")
    upto = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    each = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), upto(k).alias("folder"), upto(F.greatest(k - 1, F.lit(0))).alias("parent")))
    rows = manifest.select(F.inline(each), *(F.xxhash64(F.lit(x), "path", "sha256").cast("decimal(20,0)").alias(x) for x in "ab"))
    return rows.groupBy("depth", "folder", "parent").agg(F.count(F.lit(1)).alias("files"), F.concat_ws(":", F.sum("a"), F.sum("b")).alias("digest"))


def differing_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """(depth, folder) whose digests differ or that only one side has; both as ``folder_digests``. Level by level: below equal folders nothing is compared, so what moves follows the changes and the depth."""
    deepest = max(x.agg(F.max("depth")).first()[0] or 0 for x in (old, new))
    found, above = [], None
    for depth in range(deepest + 1):
        sides = [x.where(F.col("depth") == depth) for x in (old, new)]
        if above is not None:
            sides = [x.join(above, "parent", "left_semi") for x in sides]
        a, b = (x.select("folder", F.concat_ws("/", "files", "digest").alias(name)) for x, name in zip(sides, "ab", strict=True))
        now = materialize(a.join(b, "folder", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit(depth).alias("depth"), "folder"))
        if now.isEmpty():
            break
        found.append(now)
        above = now.select(F.col("folder").alias("parent"))
    return reduce(DataFrame.unionByName, found, old.select("depth", "folder").limit(0))


def files_in(manifest: DataFrame, folders: DataFrame) -> DataFrame:
    """Files that lie right in one of ``folders`` (depth, folder)."""
    parts = F.split("path", "/")
    own = manifest.withColumns({"depth": F.size(parts) - 1, "folder": F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")})
    return own.join(folders, ["depth", "folder"], "left_semi").drop("depth", "folder")


def manifest_drift_by_folder(old: DataFrame, new: DataFrame) -> DataFrame:
    """As ``manifest_drift``, for trees that differ in few places: only files of folders whose digests differ are compared."""
    folders = materialize(differing_folders(*(materialize(folder_digests(x)) for x in (old, new))))
    return manifest_drift(files_in(old, folders), files_in(new, folders))


def run_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, state): identical, clock-only, real or missing. Both (id, text); texts are compared as they are, then with clocks masked."""
    j = a.select("id", F.col("text").alias("x")).join(b.select("id", F.col("text").alias("y")), "id", "full_outer")
    x, y = F.col("x"), F.col("y")
    return j.select("id", F.when(x.isNull() | y.isNull(), "missing").when(x == y, "identical").when(X.blur_clock(x) == X.blur_clock(y), "clock-only").otherwise("real").alias("state"))


def clock_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, worst_abs, worst_rel) over paired numbers. Both (id, v); pairs of zeros have no relative difference."""
    j = a.select("id", F.col("v").alias("x")).join(b.select("id", F.col("v").alias("y")), "id")
    d, scale = F.abs(F.col("x") - F.col("y")), F.greatest(F.abs("x"), F.abs("y"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("worst_abs"), F.max(F.when(scale > 0, d / scale)).alias("worst_rel"))


def surface_changes(runs: DataFrame, reference: DataFrame, fields: list[str]) -> DataFrame:
    """(provider, mode, case_id, changed): runs whose decision fields differ from the reference run of their case."""
    ref = reference.select("case_id", *(F.col(f).alias(f"r_{f}") for f in fields))
    changed = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"r_{f}")), f) for f in fields)))
    return runs.join(ref, "case_id").select("provider", "mode", "case_id", changed.alias("changed")).where(F.size("changed") > 0)


def invariance_matrix(runs: DataFrame) -> DataFrame:
    """Counts for each (provider, mode) of crashed runs, changed surfaces, model-written and misleading headlines, flagged texts."""
    flags = ("crashed", "surface_changed", "model_written", "misleading", "flagged")
    return runs.groupBy("provider", "mode").agg(F.count(F.lit(1)).alias("runs"), *(F.count_if(f).alias(f) for f in flags))


def cached_calls(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """(call_id, hit, response, cost): known prompts are served at no cost. ``calls`` (call_id, key, cost); ``cache`` (key, response)."""
    j = calls.join(cache, "key", "left")
    return j.select("call_id", F.col("response").isNotNull().alias("hit"), "response", F.when(F.col("response").isNotNull(), F.lit(0.0)).otherwise(F.col("cost")).alias("cost"))


def cost_rollup(calls: DataFrame, *by: str) -> DataFrame:
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))


def trace_summary(trace: DataFrame, kinds: list[str], *by: str) -> DataFrame:
    """For each run, or each run and what ``by`` names (its agent): events by kind, tool calls with their milliseconds, retries and checkpoints.

    ``trace`` (run, kind, ms, …): tool calls, retries and checkpoints are events of those kinds.
    """
    of = lambda k: F.col("kind") == k
    counts = (F.count_if(of(k)).alias(f"n_{k}") for k in kinds)
    special = (F.count_if(of("tool_call")).alias("tool_calls"), F.coalesce(F.sum(F.when(of("tool_call"), F.col("ms"))), F.lit(0.0)).alias("tool_ms"), F.count_if(of("retry")).alias("retries"), F.count_if(of("human_checkpoint")).alias("checkpoints"))
    return trace.groupBy("run", *by).agg(F.count(F.lit(1)).alias("events"), *counts, F.sum("ms").alias("ms"), *special)


def agent_sections(trace: DataFrame, starts: Column, agent: Column) -> DataFrame:
    """``trace`` (run, seq, t_ms, …) with its agent carried forward, a number in its run and the gap to the event before."""
    w = Window.partitionBy("run").orderBy("seq")
    return trace.withColumns({"agent": F.last(F.when(starts, agent), ignorenulls=True).over(w), "n": F.row_number().over(w), "gap": F.col("t_ms") - F.lag("t_ms").over(w)})


def previous_attempt(attempts: DataFrame, *fields: str) -> DataFrame:
    """Attempts (run, attempt, …) after the first, with what their predecessor had."""
    w = Window.partitionBy("run").orderBy("attempt")
    return attempts.withColumns({"previous": F.lag("attempt").over(w)} | {f"last_{f}": F.lag(f).over(w) for f in fields}).where("previous is not null")


def kind_inventory(ops: DataFrame) -> DataFrame:
    """(bucket, kind, n) with subtotals: a null kind is a bucket's total, a null bucket the whole."""
    return ops.select(X.bucket(F.col("kind")).alias("bucket"), "kind").rollup("bucket", "kind").agg(F.count(F.lit(1)).alias("n"))


def exhaustiveness(seen: DataFrame, classified: DataFrame) -> DataFrame:
    """(kind, side): kinds that only one side has. Both (kind)."""
    side = lambda a, b, name: a.select("kind").distinct().exceptAll(b.select("kind").distinct()).withColumn("side", F.lit(name))
    return side(seen, classified, "unclassified").unionByName(side(classified, seen, "unseen"))


def kept_questions(asked: DataFrame, verdicts: DataFrame, codes: DataFrame) -> DataFrame:
    """(case_id, n, question): at most 8 guarded questions of each case, in order; one for each code where none is left.

    ``asked`` (case_id, pos, question), ``verdicts`` (case_id, verdict), ``codes`` (case_id, code).
    """
    q = asked.join(verdicts, "case_id").withColumn("question", X.sanitise(F.col("question"), V.MAX_QUESTION))
    bad = (F.col("question") == "") | F.col("question").rlike(V.INJECTION) | ((F.col("verdict") != "SAFE") & F.col("question").rlike(V.CLEAN_CLAIM))
    kept = q.where(~bad).groupBy("case_id", "question").agg(F.min("pos").alias("pos"))
    spare = codes.distinct().join(kept.select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.concat(F.lit("What is the accepted risk for "), F.col("code"), F.lit("?")).alias("question"), F.lit(0).alias("pos"))
    w = Window.partitionBy("case_id").orderBy("pos", "question")
    return kept.unionByName(spare.select("case_id", "question", F.col("pos").cast(dict(kept.dtypes)["pos"]))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= V.MAX_QUESTIONS).select("case_id", "n", "question")
