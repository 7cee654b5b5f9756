"""Query-log analytics: which statements and services depend on what a change touches.

The log is tokenised once into an inverted index; what is touched is joined on tokens. The touched side is small beside
a log; Spark broadcasts it when its measured size allows, and sorts and merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.functions import vocab as V
from tidegate.session import by_key, materialize


def token_index(log: DataFrame) -> DataFrame:
    """(token, query_id), distinct: the words of every statement of ``log`` (query_id, service, criticality, sql)."""
    return log.select(F.explode(X.identifiers(F.col("sql"))).alias("token"), "query_id")


def forms(log: DataFrame) -> DataFrame:
    """Statements of ``log`` that differ in more than numbers, each once for a service and criticality, under the least query_id.

    A number that stands alone is no word and no part of one, so words, tables and looked-up columns stay the same.
    """
    plain = F.regexp_replace("sql", r"(?<![\w$.\P{ASCII}])\d+(?![\w$.\P{ASCII}])", "0")
    return log.groupBy("service", "criticality", plain.alias("sql")).agg(F.min("query_id").alias("query_id"))


def distinct_changes(ops: DataFrame) -> DataFrame:
    """One row for each distinct change (kind, tbl, col, new_name), under the least script that makes it.

    Scripts of a fleet repeat changes; what depends on a change is found once, and its scripts share the rows.
    """
    return ops.groupBy("kind", "tbl", "col", "new_name").agg(F.min("script_id").alias("script_id"))


def named_objects(ops: DataFrame) -> Column:
    """Tables, columns and new names that a change event names, and the columns of an index where ``ops`` has them."""
    named = F.array_compact(F.array(F.lower("tbl"), F.lower("col"), F.lower("new_name")))
    return F.concat(named, F.coalesce(F.transform("columns", F.lower), F.array().cast("array<string>"))) if "columns" in ops.columns else named


def touched_objects(ops: DataFrame) -> DataFrame:
    """(script_id, token), distinct: everything that change events name."""
    return ops.select("script_id", F.explode(named_objects(ops)).alias("token")).distinct()


def change_members(ops: DataFrame) -> DataFrame:
    """(script_id, change), distinct: the changes of every script, each as the sorted distinct names that it touches."""
    names = F.array_sort(F.array_distinct(named_objects(ops)))
    return ops.select("script_id", names.alias("change")).where(F.size("change") > 0).distinct()


def touched_by_change(members: DataFrame) -> DataFrame:
    """(change, token): the names of each distinct change. Their number is the schema's, not the fleet's."""
    return members.select("change").distinct().select("change", F.explode("change").alias("token"))


def dependents(log: DataFrame, touched: DataFrame, key: str = "script_id") -> DataFrame:
    """(key, query_id, service, criticality, matched, select_star): statements that name anything touched, by bare name.

    Keyed by `change`, these and ``change_members`` give each script's dependents without a row for each script and statement.
    Statements of the same words are matched as one, so what is shuffled are sets of words; Spark broadcasts the matches
    to the log if their measured size allows.
    """
    own = log.select("query_id", "service", "criticality", X.uses_select_star(F.col("sql")).alias("select_star"), X.identifiers(F.col("sql")).alias("_words"))
    words = own.select("_words").distinct()
    met = words.select("_words", F.explode("_words").alias("token")).join(touched.select(key, "token").distinct(), "token")
    met = met.groupBy(key, "_words").agg(F.array_sort(F.collect_set("token")).alias("matched"))
    return own.join(met, "_words").select(key, "query_id", "service", "criticality", "matched", "select_star")


def dependent_views(views: DataFrame, touched: DataFrame) -> DataFrame:
    """(script_id, name): views whose text names anything touched."""
    tokens = views.select("name", F.explode(X.identifiers(F.col("sql"))).alias("token"))
    return tokens.join(touched, "token").select("script_id", "name").distinct()


def view_reach(views: DataFrame) -> DataFrame:
    """(name, token): every word that a view's text has, or that of a view it names, through any number of views.

    Rounds of joins: what was new in one round is led on through the texts of the views that it names. As many rounds as
    the longest chain of views has members; chains that go in a circle end too.
    """
    own = materialize(views.select("name", F.explode(X.identifiers(F.col("sql"))).alias("token")).distinct())
    every = new = own
    while True:
        led = new.join(own.select(F.col("name").alias("token"), F.col("token").alias("_next")), "token").select("name", F.col("_next").alias("token")).distinct()
        new = materialize(led.join(every, ["name", "token"], "left_anti"))
        if new.isEmpty():
            return every
        every = every.unionByName(new)


def dependent_views_through(views: DataFrame, touched: DataFrame) -> DataFrame:
    """(script_id, name): views whose text, or that of a view below them, names anything touched.

    Rounds of joins from what is touched upwards, so that only views are met which the result holds, and not every
    word that each view reaches. As many rounds as the longest chain has members; chains that go in a circle end too.
    """
    own = materialize(views.select("name", F.explode(X.identifiers(F.col("sql"))).alias("token")).distinct())
    start = materialize(touched.select("script_id", "token").distinct())
    every = new = _named_by(own, start.select(F.col("token").alias("start")).distinct().select("start", F.col("start").alias("token")))
    while not new.isEmpty():
        led = _named_by(own, new.select("start", F.col("name").alias("token")), every)
        every, new = every.unionByName(led), led
    return every.withColumnRenamed("start", "token").join(start, "token").select("script_id", "name").distinct()


def _named_by(own: DataFrame, new: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(start, name), distinct and written: views whose text names a token of ``new`` (start, token), without those in ``every``."""
    led = new.join(own, "token").select("start", "name").distinct()
    return materialize(led.join(every, ["start", "name"], "left_anti") if every is not None else led)


def access_path_users(log: DataFrame, indexes: DataFrame) -> DataFrame:
    """(name, query_id, service, criticality, used, excerpt): statements that name an index's table and look up by its columns.

    A statement's words are first cut to the tables that have an index (one row, as large as the catalogue), so a row is
    made for each such table that it names and not for each word, and only these are read for their clauses. Spark
    broadcasts that row if its measured size allows.
    """
    tables = indexes.agg(F.collect_set("tbl").alias("_tables"))
    probe = log.select("query_id", "service", "criticality", "sql").join(tables).withColumn("tbl", F.explode(F.array_intersect(X.identifiers(F.col("sql")), "_tables"))).drop("_tables")
    probe = probe.withColumn("filters", X.filter_columns(F.col("sql")))
    met = probe.join(indexes, "tbl").withColumn("used", F.array_sort(F.array_intersect("filters", "columns"))).where(F.size("used") > 0)
    return met.select("name", "query_id", "service", "criticality", "used", X.clause_excerpt(F.col("sql"), F.col("used")).alias("excerpt"))


def unused_indexes(log: DataFrame, indexes: DataFrame) -> DataFrame:
    return indexes.join(access_path_users(log, indexes).select("name").distinct(), "name", "left_anti").select("name", "tbl")


def uncovered_columns(touched: DataFrame, log: DataFrame) -> DataFrame:
    """(script_id, token): what is touched and no statement names."""
    return touched.join(token_index(log).select("token").distinct(), "token", "left_anti").select("script_id", "token")


def uncovered_objects(ops: DataFrame, log: DataFrame) -> DataFrame:
    """(script_id, idx, tbl, col): existing columns that a change touches and no statement names."""
    touched = ops.where(F.col("kind").isin(*V.TOUCHING) & F.col("col").isNotNull()).select("script_id", "idx", "tbl", "col", F.lower("col").alias("token"))
    return touched.join(token_index(log).select("token").distinct(), "token", "left_anti").select("script_id", "idx", "tbl", "col")


def replaced_indexes(drops: DataFrame, creates: DataFrame) -> DataFrame:
    """(name, by): a dropped index whose columns lead a created one's on the same table.

    Both (name, tbl, columns); where both have script_id, within the script, which then comes first in the result.
    """
    within = ["script_id"] if "script_id" in drops.columns and "script_id" in creates.columns else []
    c = creates.select(*within, "tbl", F.col("name").alias("by"), F.col("columns").alias("have"))
    return drops.join(by_key(c) if within else c, [*within, "tbl"]).where(F.slice("have", F.lit(1), F.size("columns")) == F.col("columns")).select(*within, "name", "by")


def unaccounted_statements(scanned: DataFrame, ops: DataFrame) -> DataFrame:
    """(script_id, idx, destructive): statements in the text that no change event claims."""
    return scanned.join(ops.select("script_id", "idx").distinct(), ["script_id", "idx"], "left_anti").select("script_id", "idx", X.is_destructive(F.col("sql")).alias("destructive"))


def blast_score(found: DataFrame) -> DataFrame:
    """(script_id, score): weights of dependent statements."""
    return found.groupBy("script_id").agg(F.sum(X.weight(F.col("criticality"))).alias("score"))


def blast_scores(log: DataFrame, touched: DataFrame) -> DataFrame:
    """(script_id, score) of every script with dependents: as ``blast_score`` of ``dependents``, without the product of scripts and statements.

    Statements of the same words count as one, with the sum of their weights, and so do those that name the same touched
    things. Both are written, as are the touched names, so that joins know how few they are: by their estimates, the log
    and the fleet's touched things may pass for the smaller side.
    """
    words = materialize(log.where("query_id is not null").groupBy(X.identifiers(F.col("sql")).alias("_words")).agg(F.sum(X.weight(F.col("criticality"))).alias("w")))
    names = materialize(touched.select("token").distinct())
    named = words.select("_words", "w", F.explode("_words").alias("token")).join(names, "token").groupBy("_words", "w").agg(F.array_sort(F.collect_set("token")).alias("matched"))
    alike = materialize(named.groupBy("matched").agg(F.sum("w").alias("w")))
    met = alike.select("matched", "w", F.explode("matched").alias("token")).join(touched, "token").select("script_id", "matched", "w").distinct()
    return met.groupBy("script_id").agg(F.sum("w").alias("score"))


def top_users(users: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` users of each index: heaviest first, then by id."""
    first = Window.partitionBy("name").orderBy(X.weight(F.col("criticality")).desc(), "query_id")
    return users.select("name", "query_id", "criticality").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).select("name", "rank", "query_id")
