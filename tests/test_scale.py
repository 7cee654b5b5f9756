"""Steps whose work, or whose largest task, once grew faster than the input."""

import random

from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_cuts import BITS, chunked_rows, metric
from tidegate.operators import census as CE
from tidegate.operators import corpus as C
from tidegate.operators import findings as FI
from tidegate.operators import preflight as P
from tidegate.operators import rules as R
from tidegate.operators import scripts as SC
from tidegate.operators.events import change_events, events_by_text
from tidegate.plans import audit as A
from tidegate.plans import evidence as EV
from tidegate.plans import review as RV
from tidegate.plans import reviews as RS
from tidegate.plans import statements as ST


# ---- one script in many runs of chunks -----------------------------------------------------------------------------
def test_scripts_over_many_runs(spark, monkeypatch):
    """Runs of some four hundred characters: quotes, comments and bodies lie open over runs' ends, and runs hold several scripts."""
    monkeypatch.setattr(CE, "RUN", 400)
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))).replace("\r", "") for _ in range(40)]
    texts += ["SELECT 1;\n" * 80 + "/* a;\n" + "b;\n" * 300 + "*/ c;\n" + "DO $x$\n" + "DROP TABLE t;\n" * 60 + "$x$; SELECT '\n" + "it;\n" * 200]
    want = CE.split_scripts(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string"))
    chunks = spark.createDataFrame(chunked_rows(texts, rng), "script_id long, chunk long, text string").repartition(7)
    runs = CE._runs(chunks)
    states = CE.run_states(runs)
    assert len(states) > 5 and {"n", "/1", "$x$", "'"} <= set(states.values())
    got = CE.split_chunks(chunks)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "windowspecdefinition(script_id#" in plan and "chunk" not in plan  # windows go over runs, and no group is a script


# ---- what depends on what ------------------------------------------------------------------------------------------
def test_views_are_met_from_what_is_touched(spark, monkeypatch):
    """Views that the result lacks are in no round: of 400 views over each other, one token has two above it."""
    views = [(f"v{k}", "SELECT a FROM base" if k == 1 else f"SELECT a.x FROM v{k // 2} a, v{max(1, k // 3)} b") for k in range(1, 401)]
    written, keep = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: written.append(keep(df)) or written[-1])
    touched = spark.createDataFrame([(1, "v150"), (2, "v150"), (2, "nothing")], "script_id long, token string")
    got = sorted(map(tuple, C.dependent_views_through(spark.createDataFrame(views, "name string, sql string"), touched).collect()))
    assert got == [(i, f"v{k}") for i in (1, 2) for k in (300, 301)]
    assert sum(df.count() for df in written[2:]) == 2


def test_dependents_shuffle_sets_of_words(spark):
    """Ten thousand statements of two forms: two sets of words are matched, whatever the number of statements."""
    log = spark.range(10_000).select(F.col("id").alias("query_id"), F.lit("s").alias("service"), F.lit("high").alias("criticality"), F.concat(F.when(F.col("id") % 2 == 0, "SELECT * FROM orders WHERE b = ").otherwise("SELECT a FROM part LIMIT "), F.col("id").cast("string")).alias("sql"))
    touched = spark.createDataFrame([("a,b", "a"), ("a,b", "b"), ("orders", "orders"), ("none", "none")], "change string, token string")
    found = C.dependents(log, touched, "change")
    got = sorted((r["change"], r["query_id"], ",".join(r["matched"]), r["select_star"]) for r in found.collect())
    assert got == sorted([("a,b", i, "ab"[i % 2 == 0], i % 2 == 0) for i in range(10_000)] + [("orders", i, "orders", True) for i in range(0, 10_000, 2)])
    assert metric(found, "shuffleRecordsWritten") < 1_000


# ---- scripts are dealt before they are gathered --------------------------------------------------------------------
def test_events_are_dealt_by_script_before_they_are_gathered(spark):
    """No task gathers lists of all that it has read: nothing is aggregated before the exchange."""
    plan = SC.ordered(ST._ops(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_list") < plan.index("Exchange") and "collect_list" not in plan[plan.index("Exchange") :]
    plan = RS._scripts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan[plan.index("Exchange") :]


def test_scripts_of_one_file_are_split_by_all_cores(spark, tmp_path):
    spark.range(1_000).select(F.col("id").alias("script_id"), F.lit("SELECT 1; SELECT 2").alias("text")).coalesce(1).write.parquet(str(tmp_path / "s"))
    found = CE.split_scripts(spark.read.parquet(str(tmp_path / "s")))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and found.count() == 2_000


# ---- scripts and statements that are alike ---------------------------------------------------------------------------
def test_scripts_of_a_text_are_read_once(spark, monkeypatch):
    """As many scripts are scanned as there are texts, and every script gets what is found about its text."""
    asked, keep = [], EV.scan_tables
    monkeypatch.setattr(EV, "scan_tables", lambda ops, *more: asked.append(ops.select("script_id").distinct().count()) or keep(ops, *more))
    found = RS.r16_keys_and_ranges(spark, SF)
    assert asked == [8] and found.select("script_id").distinct().count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    scripts = spark.createDataFrame([(1, "a; b"), (2, "c"), (3, "a; b"), (4, None), (5, "a; b")], "script_id int, text string")
    first, members = CE.by_text(scripts)
    got = CE.for_members(CE.split_scripts(first).select("script_id", "sql"), members)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (2, "c"), (3, "a"), (3, "b"), (5, "a"), (5, "b")]


def test_segments_are_what_the_scanner_finds():
    """A script's statements, each scanned by itself, are those of one scan of the whole text."""
    rng = random.Random(8)
    for text in ["".join(rng.choice([*BITS, "/", "-", "$1$", "''", ";"]) for _ in range(rng.randint(0, 40))) for _ in range(3_000)]:
        whole, comment = CE.scan(text)
        parts = [(a, b, *CE._read(text[a:b])) for a, b in CE.segments(text)]
        assert [(a, b, *x[:5]) for a, b, x, _ in parts if x] == [(s.start, s.stop, text[s.start : s.stop].rstrip(";").strip(), ",".join(s.clauses).strip(), [c.strip() for c in s.clauses], s.solid, s.left_open) for s in whole]
        assert sum(n for *_, n in parts) == sum(s.solid for s in whole) + comment


# ---- checks that are alike -----------------------------------------------------------------------------------------
def test_deletes_in_any_order_and_updates_again_are_one_check(spark):
    """What leaves the same rows shares one check; an update that another stands between, or that reads its own column, doesn't."""
    t = spark.createDataFrame([(1, None, 3), (None, 2, None), (None, 0, 5), (4, 4, 4)], "a int, b int, c int")
    seal = "ALTER TABLE t ALTER COLUMN c SET NOT NULL"
    a, b, fill, up = "DELETE FROM t WHERE a IS NULL", "DELETE FROM t WHERE b IS NULL", "UPDATE t SET c = 0 WHERE c IS NULL", "UPDATE t SET c = c + 1 WHERE a = 4"
    texts = [[a, b], [b, a], [a, b, a], [fill], [fill, fill], [fill, fill, fill], [up], [up, up], [], [b], ["UPDATE t SET c = NULL WHERE a = 4", fill], [fill, "UPDATE t SET c = NULL WHERE a = 4", fill], [fill, "UPDATE t SET c = NULL WHERE a = 4"]]
    ops = change_events(CE.split_scripts(spark.createDataFrame([(i, "; ".join([*x, seal])) for i, x in enumerate(texts)], "script_id long, text string")))
    wanted = {r["script_id"]: r["spec"] for r in SC.row_checks(SC.ordered(ops), {"t": dict(t.dtypes)}).collect()}
    assert wanted[0] == wanted[1] == wanted[2] and wanted[3] == wanted[4] == wanted[5] and len(set(wanted.values())) == len(texts) - 4
    got = {r["script_id"]: r["violations"] for r in EV.scan_tables(ops, {"t": t}).data.collect()}
    assert got == {i: {8: 1, 9: 1, 12: 1, 6: 1, 7: 1}.get(i, 0) for i in range(len(texts))}


def test_work_follows_what_checks_rest_on_and_not_their_number(spark, monkeypatch):
    """Sixteen sets of deletes before three checks: a row is asked each delete and column once, and sent once for the key."""
    t = spark.createDataFrame([(i % 7 or None, i % 3 or None, i % 5 or None, i % 2 or None, i // 2) for i in range(40)], "a int, b int, c int, d int, k int")
    gone = [[f"DELETE FROM t WHERE {c} IS NULL" for i, c in enumerate("abcd") if n >> i & 1] for n in range(16)]
    texts = ["; ".join([*x, "CREATE UNIQUE INDEX u ON t (k)", "ALTER TABLE t ALTER COLUMN a SET NOT NULL", "ALTER TABLE t ADD CONSTRAINT z CHECK (k < 9)"]) for x in gone]
    ops = change_events(CE.split_scripts(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string")))
    asked, sent, count, hashes = [], [], P.count_among, P._hashes
    monkeypatch.setattr(P, "count_among", lambda df, conditions, needs, *more: asked.append((len(conditions), len(needs))) or count(df, conditions, needs, *more))
    monkeypatch.setattr(P, "_hashes", lambda values: sent.append(len(values)) or hashes(values))
    got = {(r["script_id"], r["kind"]): r["violations"] for r in EV.scan_tables(ops, {"t": t}).data.collect()}
    assert asked == [(7, 48)] and sent == [1]
    rows = t.collect()
    for n in range(16):
        left = [r for r in rows if all(r[c] is not None for i, c in enumerate("abcd") if n >> i & 1)]
        want = {"unique": len(left) - len({r["k"] for r in left}), "not_null": sum(r["a"] is None for r in left), "check": sum(r["k"] >= 9 for r in left)}
        assert {k: got[n, k] for k in want} == want


def test_checks_that_only_deleted_rows_make_fail(spark):
    """A division that the rows left can make is asked, though the deleted ones can't; where one of these is left, that check alone is open."""
    t = spark.createDataFrame([(1, 0), (6, 2), (None, 3), (1, 1)], "a int, b int")
    check = "ALTER TABLE t ADD CONSTRAINT z CHECK (a / b > 2)"
    texts = [f"DELETE FROM t WHERE b = 0; {check}", check, "CREATE UNIQUE INDEX u ON t (a)", "ALTER TABLE t ALTER COLUMN a SET NOT NULL"]
    ops = change_events(CE.split_scripts(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string")))
    e = EV.scan_tables(ops, {"t": t})
    assert {r["script_id"]: r["violations"] for r in e.data.collect()} == {0: 1, 2: 1, 3: 1} and [r["script_id"] for r in e.bounded.collect()] == [1]


def test_statements_are_taken_apart_once_for_each_text(spark):
    texts = ["ALTER TABLE t DROP COLUMN a, ADD COLUMN b int; DROP TABLE x, y", "DROP TABLE x, y; BEGIN", "/* c */ DROP TABLE x, y", "UPDATE t SET a = 'x,y' WHERE b IN (1, 2)"]
    s = CE.split_scripts(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string"))
    want, got = change_events(s), events_by_text(s)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_statements_that_differ_in_numbers_are_one_form(spark):
    """Users of an index are those of the whole log, found among its forms; numbers inside of words are no numbers."""
    log = spark.createDataFrame([(i, f"s{i % 2}", "high", f"SELECT a1 FROM t WHERE k = {i} AND note = 'v{i % 3} 9'") for i in range(300)] + [(300, "s0", "low", "SELECT 1 FROM t WHERE a1=3.5")], "query_id long, service string, criticality string, sql string")
    paths = spark.createDataFrame([("i", "t", ["k"]), ("j", "t", ["a1"])], "name string, tbl string, columns array<string>")
    users = lambda df: sorted(map(tuple, C.access_path_users(df, paths).select("name", "service", "criticality").distinct().collect()))
    words = lambda df: sorted(r[0] for r in C.token_index(df).select("token").distinct().collect())
    few = C.forms(log)
    assert few.count() == 7 and users(few) == users(log) and words(few) == words(log)


def test_events_are_put_in_order_once(spark, monkeypatch):
    """Scans and replay share the ordered events of the scripts."""
    ops = change_events(CE.split_scripts(spark.createDataFrame([(1, "ALTER TABLE t ALTER COLUMN a SET NOT NULL; ALTER TABLE t DROP COLUMN a")], "script_id long, text string")))
    log = spark.createDataFrame([(8, "s", "high", "SELECT a FROM t WHERE a = 1"), (7, "r", "high", "SELECT a FROM t WHERE a = 2")], "query_id long, service string, criticality string, sql string")
    calls, keep = [], SC.ordered
    monkeypatch.setattr(SC, "ordered", lambda df: calls.append(1) or keep(df))
    e = EV.measure(ops, log, {"t": spark.createDataFrame([(None,), (1,)], "a int")})
    assert calls == [1] and [tuple(r) for r in e.data.collect()] == [(1, "t.a", "not_null", 1)] and [(r["query_id"], r["services"]) for r in e.broken.collect()] == [("7", ["r", "s"])]


# ---- what is of the fleet's size doesn't go through the driver --------------------------------------------------------
def stored(spark, rows, schema, folder):
    """Rows in a file, which Spark takes for as small as it is."""
    spark.createDataFrame(rows, schema).write.parquet(str(folder))
    return spark.read.schema(schema).parquet(str(folder))


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def broadcast_rows(df):
    """Rows that the joins of an executed plan broadcast."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.getClass().getSimpleName() == "BroadcastExchangeExec":
            out += node.metrics().get("numOutputRows").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_claims_are_dealt_by_statement(spark, tmp_path):
    """Events are as many as statements, however small their file: they are no broadcast."""
    statements = stored(spark, [(1, 0, "DROP TABLE a"), (1, 1, "SELECT 1"), (2, 0, "DROP TABLE b")], "script_id long, idx int, code string", tmp_path / "s")
    ops = stored(spark, [(1, 0, 0), (1, 0, 1)], "script_id long, idx int, part int", tmp_path / "o")
    found = RV.claims(statements, ops)
    assert broadcasts(statements.join(ops.distinct(), ["script_id", "idx"], "left")) == 1 and broadcasts(found) == 0
    assert sorted((r["script_id"], r["idx"], r["claimed"], r["destructive"]) for r in found.collect()) == [(1, 0, True, False), (1, 1, False, False), (2, 0, False, True)]


def test_rules_that_join_events_with_events_deal_them(spark, tmp_path):
    rows = [(1, 0, "set_not_null", "t", "a", "ALTER TABLE t ALTER COLUMN a SET NOT NULL", None, []), (1, 1, "dml_update", "t", None, "UPDATE t SET a = 0 WHERE a IS NULL", None, []), (1, 2, "drop_index", None, None, "DROP INDEX i", "i", []), (1, 3, "create_index", "t", None, "CREATE INDEX j ON t (a, b)", "j", ["a", "b"])]
    ops = stored(spark, rows, "script_id long, idx int, kind string, tbl string, col string, sql string, index_name string, columns array<string>", tmp_path / "o")
    erased = R.erased_nulls(ops)
    drops = ops.where("kind = 'drop_index'").select("script_id", F.col("index_name").alias("name"), F.lit("t").alias("tbl"), F.array(F.lit("a")).alias("columns"))
    replaced = C.replaced_indexes(drops, ops.where("kind = 'create_index'").select("script_id", "tbl", F.col("index_name").alias("name"), "columns"))
    assert broadcasts(erased) == 0 and broadcasts(replaced) == 0
    assert list(map(tuple, erased.collect())) == [(1, "t", "a")] and list(map(tuple, replaced.collect())) == [(1, "i", "j")]


def test_verdicts_deal_what_there_is_for_each_script(spark, tmp_path):
    found = stored(spark, [(1, "BREAKING_QUERY", "blocker"), (2, "X", "high")], "script_id long, code string, severity string", tmp_path / "f")
    gaps, defects = (stored(spark, [(i,)], "script_id long", tmp_path / n) for i, n in ((2, "g"), (3, "d")))
    out = RV.verdicts(stored(spark, [(1,), (2,), (3,)], "script_id long", tmp_path / "s"), found, gaps, defects)
    assert broadcasts(out) == 0
    assert sorted((r["script_id"], r["verdict"], r["broken"]) for r in out.collect()) == [(1, "BLOCK", 1), (2, "NEEDS_COVERAGE_SIGNOFF", 0), (3, "NEEDS_COVERAGE_SIGNOFF", 0)]


def test_audits_deal_the_names_that_texts_have(spark, tmp_path):
    steps = stored(spark, [(1, "phase2", 0, "drop_table", "t"), (1, "phase2", 1, "drop_table", "other")], "script_id long, phase string, seq int, kind string, object string", tmp_path / "s")
    found = A.ungated_steps(steps, stored(spark, [(1, "Confirm T is unused")], "script_id long, text string", tmp_path / "g"))
    assert broadcasts(found) == 0 and list(map(tuple, found.collect())) == [(1, 1, "other")]


def test_blast_scores_broadcast_neither_log_nor_fleet(spark, tmp_path):
    """Two thousand statements of two forms and a thousand scripts: what the joins broadcast is the names and the sets of names."""
    spark.range(2_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("criticality"), F.concat(F.when(F.col("id") % 2 == 0, "SELECT * FROM orders WHERE b = ").otherwise("SELECT a FROM part LIMIT "), F.col("id").cast("string")).alias("sql")).write.parquet(str(tmp_path / "l"))
    spark.range(1_000).select(F.col("id").alias("script_id"), F.when(F.col("id") % 2 == 0, "orders").otherwise("a").alias("token")).write.parquet(str(tmp_path / "t"))
    found = C.blast_scores(spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "t")))
    assert {(r["script_id"] % 2, r["score"]) for r in found.collect()} == {(0, 3_000), (1, 1_000)} and found.count() == 1_000
    assert 0 < broadcast_rows(found) <= 10


def test_breakage_meets_owners_by_script(spark, tmp_path):
    found = stored(spark, [(1, "BREAKING_QUERY", ["a", "b"]), (2, "X", ["c"])], "script_id long, code string, services array<string>", tmp_path / "f")
    hit = FI.cross_service(found, stored(spark, [(1, "a"), (2, "a")], "script_id long, owner string", tmp_path / "o"))
    assert broadcasts(hit) == 0 and list(map(tuple, hit.collect())) == [(1, ["b"])]


def test_replay_broadcasts_outcomes_and_not_the_fleet(spark, monkeypatch):
    """A thousand scripts leave a read the same state: its outcome, found once, is the side that joins take for the smaller."""
    met, keep = [], EV.materialize
    monkeypatch.setattr(EV, "materialize", lambda df: met.append(df) or keep(df))
    t = spark.createDataFrame([(1, 2)], "a int, b int")
    ops = change_events(CE.split_scripts(spark.range(1_000).select(F.col("id").alias("script_id"), F.lit("ALTER TABLE t DROP COLUMN a").alias("text"))))
    log = spark.createDataFrame([(7, "s", "high", "SELECT a FROM t")], "query_id long, service string, criticality string, sql string")
    found = EV.replay_changes(ops, log, {"t": t})
    assert found.broken.count() == 1_000
    (plan,) = (df._jdf.queryExecution().executedPlan().toString() for df in met if "is_view" in df.columns)
    assert "Inner, BuildRight" in plan and "Inner, BuildLeft" not in plan
