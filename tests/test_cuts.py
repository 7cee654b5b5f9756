"""Work that follows what differs, and not the size of what is alike: footers, folder digests, ranges of answers, views through views, gate texts."""

import random

from pyspark.sql import functions as F

from tests.conftest import SF
from tidegate.operators import corpus as C
from tidegate.operators import footers as FO
from tidegate.operators import replay as RE
from tidegate.operators import runs as RU
from tidegate.operators.census import read_chunks, run_from, split_chunks, split_scripts
from tidegate.operators.events import change_events
from tidegate.plans import audit as A
from tidegate.plans import evidence as EV


def metric(df, name):
    """Sum of a metric over the nodes of an executed plan."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        found = node.metrics().get(name)
        out += found.get().value() if found.isDefined() else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_footers_are_read_and_no_page(spark):
    one, kinds = FO.pushed(spark, f"{SF}/lineitem.parquet")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and len(kinds) == 11
    facts = FO.column_facts(spark, f"{SF}/lineitem.parquet")
    want = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.count(F.lit(1)), F.min("l_orderkey"), F.max("l_orderkey")).first()
    assert (facts["l_orderkey"].rows, facts["l_orderkey"].lo, facts["l_orderkey"].hi) == tuple(want) and facts["l_shipdate"].lo is None


def test_footers_settle_checks(spark, tmp_path):
    """Clean and bad columns: the same evidence with and without footers; a range in doubt is asked of few row groups."""
    path = str(tmp_path / "t")
    df = spark.range(0, 200_000, 1, 4).select(F.col("id"), F.when(F.col("id") == 150_000, F.lit(5_000_000_000)).otherwise(F.col("id")).alias("big"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("holes"), (F.col("id") / 4).alias("share"), F.col("id").cast("string").alias("word"))
    df.write.option("parquet.block.size", 1 << 16).parquet(path)
    t = spark.read.parquet(path)
    texts = ["ALTER TABLE t ALTER COLUMN id SET NOT NULL", "ALTER TABLE t ALTER COLUMN holes SET NOT NULL", "ALTER TABLE t ALTER COLUMN id TYPE integer", "ALTER TABLE t ALTER COLUMN big TYPE integer", "ALTER TABLE t ALTER COLUMN share TYPE integer", "ALTER TABLE t ALTER COLUMN share TYPE numeric(7,2)", "ALTER TABLE t ALTER COLUMN word TYPE varchar(5)", "ALTER TABLE t ALTER COLUMN id TYPE smallint", "UPDATE t SET holes = 1 WHERE holes IS NULL; ALTER TABLE t ALTER COLUMN holes SET NOT NULL"]
    ops = change_events(split_scripts(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string")))
    a, b = EV.scan_tables(ops, {"t": t}), EV.scan_tables(ops, {"t": t}, files={"t": path})
    for name in ("data", "narrowed", "bounded"):
        assert sorted(map(str, getattr(a, name).collect())) == sorted(map(str, getattr(b, name).collect()))
    assert a.footed == 0 and b.footed == 6
    got = {r["script_id"]: r["offending_rows"] for r in b.narrowed.collect()}
    assert got[2] == 0 and got[3] == 1 and got[7] == 200_000 - (1 << 15)
    few = FO.outside_rows(t, "big", "integer")
    assert few.first()[0] == 1 and "GreaterThan(big" in few._jdf.queryExecution().executedPlan().toString()
    read = t.where(F.col("big") > F.lit((1 << 31) - 1))
    read.collect()
    assert 0 < metric(read, "numOutputRows") < 100_000  # of 200,000: row groups within the range aren't read


def test_views_through_views(spark):
    """A chain of twelve, a shared diamond, and two views that name each other."""
    views = [("v0", "SELECT a FROM base")] + [(f"v{k}", f"SELECT a FROM v{k - 1}") for k in range(1, 12)] + [("left_", "SELECT a FROM v1"), ("right_", "SELECT a FROM v1"), ("top", "SELECT 1 FROM left_ JOIN right_ USING (a)"), ("x", "SELECT 1 FROM y"), ("y", "SELECT 1 FROM x, v3")]
    touched = spark.createDataFrame([(1, "base"), (2, "v9"), (3, "right_"), (4, "x"), (5, "nothing")], "script_id long, token string")
    got = {}
    for r in C.dependent_views_through(spark.createDataFrame(views, "name string, sql string"), touched).collect():
        got.setdefault(r["script_id"], set()).add(r["name"])
    assert got == {1: {v for v, _ in views}, 2: {"v10", "v11"}, 3: {"top"}, 4: {"x", "y"}}


def test_trees_that_differ_in_few_paths(spark):
    """Ten changed paths of 40,000 in five levels: the folders that differ and the files compared are few, the result that of comparing all."""
    path = F.concat_ws("/", *((F.col("id") / F.lit(float(k))).cast("int").cast("string") for k in (8_000, 800, 80, 8)), F.col("id").cast("string"))
    old = spark.range(40_000).select(path.alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    odd = [3, 4_000, 4_001, 17_777, 20_000, 31_313, 39_999]
    new = spark.range(40_000).where("id not in (9000, 25000)").select(path.alias("path"), F.when(F.col("id").isin(odd), "x").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("sha256")).unionByName(spark.createDataFrame([("0/new/file", "y")], "path string, sha256 string"))
    want = sorted(map(str, RU.manifest_drift(old, new).collect()))
    assert len(want) == 10 and sorted(map(str, RU.manifest_drift_by_folder(old, new).collect())) == want
    folders = RU.differing_folders(RU.folder_digests(old), RU.folder_digests(new))
    assert folders.count() <= 10 * 5 and RU.files_in(old, folders).count() <= 10 * 9
    assert RU.manifest_drift_by_folder(old, old).collect() == [] and RU.manifest_drift_by_folder(old, old.limit(0)).count() == 40_000


def test_rows_of_answers(spark):
    """Changed, missing, added and repeated keys, null keys, and equal rows in another order; only ranges that differ are left to compare."""
    pre = spark.range(0, 300_000, 1, 8).select(F.col("id").alias("k"), (F.col("id") % 97).alias("v")).unionByName(spark.createDataFrame([(None, 1), (None, 2)], "k long, v long"))
    post = pre.where("k is null or k <> 7").withColumn("v", F.when(F.col("k") == 299_999, 5).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(123_456, 123_456 % 97), (-4, 0), (None, 2)], "k long, v long")).repartition(3)
    want = {(7, 1, 0), (299_999, 1, 1), (123_456, 1, 2), (-4, 0, 1), (None, 2, 3)}
    assert {tuple(r) for r in RE.answer_rows(pre, post, "k", cells=64, few=50).collect()} == want
    assert {tuple(r) for r in RE.answer_rows(pre, post, "k").collect()} == want
    ranges = RE.differing_ranges(pre, post, "k", cells=64, few=50)
    assert sum(b - a + 1 for a, b in ranges) < 300_000 / 64
    assert RE.answer_rows(pre, pre, "k").collect() == [] and RE.differing_ranges(pre.limit(0), pre.limit(0), "k") == []


def test_gate_texts_are_searched_once(spark):
    """Names in texts, by the automaton, are those that each pair's comparison finds."""
    rng = random.Random(2)
    names = ["orders", "orders_old", "Customer.c_name", "a", "part", None]
    steps = [(rng.randint(0, 9), "phase2", i, "drop_table", "", rng.choice(names)) for i in range(120)]
    texts = [(rng.randint(0, 9), rng.choice(["Confirm ORDERS_OLD is idle", "nothing", "customer.c_name and PARTS", None, "", "preorders"])) for _ in range(25)]
    got = {r["seq"] for r in A.ungated_steps(spark.createDataFrame(steps, "script_id long, phase string, seq long, kind string, sql string, object string"), spark.createDataFrame(texts, "script_id long, text string")).collect()}
    named = lambda i, o: o is not None and any(j == i and t is not None and o.lower() in t.lower() for j, t in texts)
    assert got == {n for i, _, n, _, _, o in steps if not named(i, o)}


def test_a_script_of_many_steps_and_gates_is_linear(spark):
    steps = spark.range(10_000).select(F.lit(1).cast("long").alias("script_id"), F.lit("phase2").alias("phase"), F.col("id").alias("seq"), F.lit("drop_table").alias("kind"), F.lit("").alias("sql"), F.concat(F.lit("t"), F.col("id"), F.lit("_")).alias("object"))
    gates = spark.range(10_000).select(F.lit(1).cast("long").alias("script_id"), F.concat(F.lit("ask about t"), F.col("id") * 2, F.lit("_")).alias("text"))
    left = A.ungated_steps(steps, gates)
    assert left.count() == 5_000
    assert "NestedLoop" not in left._jdf.queryExecution().executedPlan().toString()


# ---- scripts in chunks ---------------------------------------------------------------------------------------------
BITS = ["SELECT 1", ";", "\n", "'a;b", "'", "''", '"q;', '"', "/* c;", "*/", "-- x; y", "$$ b;", "$$", "$t$", "x, y", "(", ")", "DROP TABLE z", " ", "DO $$ DROP TABLE z; $$", "\n;\n"]


def chunked_rows(texts, rng):
    """Chunks of whole lines, of random numbers of lines."""
    out = []
    for i, t in enumerate(texts):
        lines, c = t.splitlines(keepends=True), 0
        while lines:
            n = rng.randint(1, 3)
            out.append((i, c * 7, "".join(lines[:n])))
            lines, c = lines[n:], c + 1
    return out


def test_chunks_give_what_whole_scripts_give(spark):
    """Random scripts with open quotes, nested comments and bodies over chunks' ends: every column is that of the scan of the whole text."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts = [t.replace("\r", "") for t in texts] + ["a;\nb;\n/* 1\n/* 2\n*/\n;\n*/ c\n;", "DO $x$\nDROP TABLE t;\n$x$;\nSELECT 1", "'\n;\n''\n;'\n;x", "\n\n-- only;\n"]
    want = split_scripts(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string"))
    got = split_chunks(spark.createDataFrame(chunked_rows(texts, rng), "script_id long, chunk long, text string").repartition(7))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_states_of_chunks():
    assert run_from("a; 'b\n", "n") == ("'", [2]) and run_from("c'; d\n", "'") == ("n", [3]) and run_from("/* /* x */\n", "n") == ("/1", [])
    assert run_from("*/ y */ z;\n", "/2") == ("n", [10]) and run_from("b $f$ c\n", "n") == ("$f$", []) and run_from("x; $f$; y\n", "$f$") == ("n", [7])


def test_a_large_file_in_many_tasks(spark, tmp_path):
    """A file of many splits, with bodies over several lines, read in chunks: the statements of the whole."""
    body = "DO $body$ BEGIN\n  -- it's;\n  DROP TABLE t;\nEND $body$;\n/* a;\n b; */ ALTER TABLE t\n  DROP COLUMN c;\n"
    path = tmp_path / "big.sql"
    path.write_text(body * 20_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        chunks = read_chunks(spark, str(path), lines=1_500)
        assert chunks.rdd.getNumPartitions() >= 8
        got = split_chunks(chunks).select("idx", "code", "body_destructive").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["idx"] for r in got) == list(range(40_000))
    assert {(r["idx"] % 2, r["body_destructive"]) for r in got} == {(0, True), (1, False)}
    assert {" ".join(r["code"].split()) for r in got if r["idx"] % 2} == {"ALTER TABLE t DROP COLUMN c"}
