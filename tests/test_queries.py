"""Every registered query with SQL gives the same rows as DuckDB does from that SQL, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tidegate.operators import corpus as C
from tidegate.plans import statements as S
from tidegate.plans.registry import QUERIES, SQL


def plain(v):
    if v is None:
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_script_gets_its_dependents(spark):
    """Members and dependents of changes give every script's dependents and score, whatever it changes."""
    ops, log = S._ops(spark, SF), S._log(spark, SF)
    touched = C.touched_objects(ops)
    each = C.dependents(log, touched)
    want = {(r["script_id"], r["query_id"]) for r in each.select("script_id", "query_id").collect()}
    few = {r["change"] for r in QUERIES["j2_change_dependents"](spark, SF).select("change").distinct().collect()}
    members = [tuple(r) for r in QUERIES["j2_change_members"](spark, SF).select("script_id", "change").collect()]
    by_change = {}
    for r in QUERIES["j2_change_dependents"](spark, SF).select("change", "query_id").collect():
        by_change.setdefault(r["change"], set()).add(r["query_id"])
    assert {(s, q) for s, c in members for q in by_change.get(c, ())} == want and few <= {c for _, c in members}
    assert sorted(map(tuple, QUERIES["g1_blast_scores"](spark, SF).collect())) == sorted(map(tuple, C.blast_score(each).collect()))


def test_top_users_are_limited_before_the_shuffle(spark):
    """No list of an index's users is built: each partition keeps its first few."""
    plan = QUERIES["l2_top_users"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_list" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
