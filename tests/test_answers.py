"""How many rows the reads of a log give before scripts and after them: together and one by one, against a run of each text by another engine."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegate.operators import answers as AN
from tidegate.operators.census import split_scripts
from tidegate.operators.events import change_events
from tidegate.plans import evidence as EV

VIEWS = {"open_loans": "SELECT id, reader_id FROM loans WHERE state = 'open'"}
EQUAL = [
    *(f"SELECT * FROM loans WHERE reader_id = {k}" for k in range(9)), *(f"SELECT id FROM open_loans WHERE {k} = reader_id" for k in (1, 3)),
    *(f"SELECT id FROM loans l WHERE l.state = '{s}' AND reader_id = {k} ORDER BY id LIMIT {m};" for s in ("open", "it''s", "shut", "{x}") for k in (1, 2) for m in (3, 500)),
    *(f"SELECT name, count(*) FROM readers x JOIN loans l ON x.id = l.reader_id WHERE x.id = {k} GROUP BY name" for k in (1, 4)), *(f"SELECT count(*) FROM loans WHERE reader_id = {k}" for k in (1, 70)),
    *(f"SELECT DISTINCT state FROM loans WHERE reader_id = {k} AND fee = {f}" for k in (1, 2) for f in ("0.5", "7.25")), *(f"SELECT id FROM loans WHERE fee = {f}" for f in ("0.50", "3", "24.75")),
]
SINGLY = [
    *(f"SELECT id FROM loans WHERE fee > {f}" for f in ("0.5", "20", "22.25")), "SELECT state, count(*) FROM loans GROUP BY 1", "SELECT state FROM loans GROUP BY state HAVING count(*) > 90",
    "SELECT name FROM readers WHERE id IN (SELECT reader_id FROM loans WHERE state = 'open') AND name = 'r1'", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM loans WHERE reader_id = 2) x WHERE r < 7",
    "SELECT id FROM (SELECT id FROM loans WHERE reader_id = 2 ORDER BY id LIMIT 4) x", "SELECT id FROM loans WHERE reader_id IN (1, 2) UNION SELECT id FROM readers WHERE id = 3", "SELECT id FROM loans WHERE DATE '2020-01-01' = day",
]
ODD = ["SELECT id FROM nowhere WHERE x = 1", "DELETE FROM loans WHERE id = 1", "", None]
HOT = [EQUAL[1]] * 9
#: scripts, and whether what they leave of the rows is known
SCRIPTS = [
    ("DELETE FROM loans WHERE reader_id = 1", True), ("UPDATE loans SET state = 'shut' WHERE state = 'open' AND reader_id = 2; DELETE FROM loans WHERE fee > 20", True),
    ("DELETE FROM loans WHERE fee > 20; UPDATE loans SET reader_id = reader_id + 1", True), ("ALTER TABLE readers ADD COLUMN z int; CREATE INDEX i ON loans (fee)", True), ("-- again\nDELETE FROM loans WHERE reader_id = 1", True),
    ("DELETE FROM loans WHERE fee > 20; CREATE OR REPLACE VIEW open_loans AS SELECT id, reader_id FROM loans WHERE reader_id <> 3", True), ("DELETE FROM loans l USING readers r WHERE r.id = l.reader_id", False), ("INSERT INTO readers (id) VALUES (9)", False),
]


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(3)
    loans = [(i, r.choice([*range(6), None]), r.choice(["open", "shut", "it's", "{x}", None]), r.randrange(100) / 4, None) for i in range(300)]
    tables = {"loans": spark.createDataFrame(loans, "id long, reader_id int, state string, fee double, day date"), "readers": spark.createDataFrame([(i, f"r{i}") for i in range(8)], "id long, name string")}
    texts = [*EQUAL, *SINGLY, *ODD, *HOT]
    return tables, texts, spark.createDataFrame([(i, "desk", t) for i, t in enumerate(texts)], "query_id long, service string, sql string")


def run(tables, texts, script=""):
    """Rows that each text gives, by another engine, once ``script`` has run there."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register("given", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
    for name, sql in VIEWS.items():
        con.execute(f"CREATE VIEW {name} AS {sql}")
    con.execute(script or "SELECT 1")
    return {i: len(con.execute(t).fetchall()) for i, t in enumerate(texts) if t and t not in ODD}


def drift_of(spark, world, texts, log=None):
    scripts = spark.createDataFrame(list(enumerate(texts)), "script_id long, text string")
    return EV.count_drift(change_events(split_scripts(scripts)), world[2] if log is None else log, world[0], VIEWS)


def test_drift_of_scripts_is_that_of_every_text(spark, world):
    tables, texts, _ = world
    drift = drift_of(spark, world, [t for t, _ in SCRIPTS])
    before, want = run(tables, texts), set()
    for i in (i for i, (_, known) in enumerate(SCRIPTS) if known):
        after = run(tables, texts, SCRIPTS[i][0])
        want |= {(i, q, "desk", n, after[q]) for q, n in before.items() if after[q] != n}
    got = [tuple(r) for r in drift.rows.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    lost = {(r["script_id"], r["shape"]) for r in drift.uncounted.collect()}
    assert {i for i, _ in lost} == {i for i, (_, known) in enumerate(SCRIPTS) if not known}
    assert (7, "SELECT * FROM loans WHERE reader_id = ?") not in lost and (6, "SELECT id FROM open_loans WHERE ? = reader_id") in lost


def test_scripts_that_leave_the_same_share_their_counts(spark, world):
    some = world[2].where(F.col("query_id") < 11)  # two forms
    one, two = (drift_of(spark, world, texts, some) for texts in ([SCRIPTS[0][0]], [SCRIPTS[0][0], SCRIPTS[4][0]]))
    assert one.counted == two.counted == 2 and two.rows.count() == 2 * one.rows.count() > 0


def test_forms_with_equal_literals_are_counted_together(spark, world):
    tables, _, log = world
    reads, w = AN.with_literals(log.where("sql is not null")), AN.World(spark, tables, VIEWS)
    for shape, kinds, sql in AN.forms(reads):
        some = AN.of_form(reads, shape, kinds)
        found = w.together(sql, kinds, some.select("lits")) if w.nodes(sql) is not None else None
        assert (found is not None) == (sql in EQUAL), sql
        if found is not None:  # every row of literals once, as one by one
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, w.each(some).collect()))


def test_nothing_asked(spark, world):
    tables, _, log = world
    scripts = spark.createDataFrame([(0, "DELETE FROM loans"), (1, ""), (2, None)], "script_id long, text string")
    ops = change_events(split_scripts(scripts))
    for o, g, t in ((ops, log.limit(0), tables), (ops, log, {})):
        drift = EV.count_drift(o, g, t)
        assert drift.rows.count() == 0 and drift.rows.columns == ["script_id", "query_id", "service", "before", "after"]
