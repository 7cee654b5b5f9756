"""Change events from statements: one row for each statement, or for each action of an ALTER TABLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import exprs as X
from tidegate.session import materialize

#: words of maintenance commands that are no relation
_UPKEEP = "cluster vacuum full reindex table index schema database refresh materialized view concurrently verbose analyze ( )".split()
_NAMELESS = ("drop_index", "create_view", "drop_view", "procedural_block", "transaction_control", "unsupported")


def _name(word: Column) -> Column:
    return F.regexp_replace(word, '"', "")


def change_events(statements: DataFrame) -> DataFrame:
    """(script_id, idx, part, kind, sql, tbl, col, new_name, new_type, index_name, columns) of ``statements`` (script_id, idx, code, clauses).

    What the text doesn't name is null. sql is the code with white space collapsed, for an ALTER TABLE with the action
    alone: its actions are the clauses, which the census cuts at commas outside brackets and quotes. Kinds are those of
    ``statement_kind``. A DROP of several names is an event for each. part: the event's place in its statement. columns:
    of a created index, of an inserted row, of a unique, primary or foreign key.
    """
    s = statements.select("script_id", "idx", X.norm_sql(F.col("code")).alias("code"), F.transform("clauses", X.norm_sql).alias("clauses"))
    altered = F.array_join(F.slice(X.statement_words(F.col("code")), 1, 2), " ") == "alter table"
    # the head of an ALTER TABLE ends with the table's name: the third word, those that stand aside not counted
    head = F.regexp_extract("code", rf"(?i)^(?:(?:{X.ASIDE}|\S+)\s+?){{2}}(?:\s*{X.ASIDE}\s+)*\S+", 0)
    listed = F.regexp_extract("code", r"(?i)^drop\s+(?:table|view|index)\b(?:\s+concurrently\b)?(?:\s+if\s+exists\b)?", 0)
    others = lambda before: F.transform(F.slice("clauses", F.lit(2), F.greatest(F.lit(0), F.size("clauses") - 1)), lambda c: F.concat(before, F.lit(" "), c))
    actions = F.when(altered, F.concat(F.slice("clauses", 1, 1), others(head))).when(listed != "", F.concat(F.slice("clauses", 1, 1), others(listed))).otherwise(F.array("code"))
    one = s.select("script_id", "idx", F.posexplode(actions).alias("part", "sql")).withColumn("kind", X.statement_kind(F.col("sql")))
    one = one.withColumns({"_w": X.statement_words(F.col("sql"))}).withColumn("_i", F.filter("_w", lambda x: ~x.isin("unique", "concurrently")))
    kind, w, i = F.col("kind"), F.col("_w"), F.col("_i")
    word = lambda c, n: F.get(c, F.lit(n))
    after = lambda c, x: F.when(F.array_position(c, x) > 0, F.get(c, F.array_position(c, x).cast("int")))
    table = (
        F.when(kind == "create_index", word(i, 4)).when(kind == "dml_update", word(w, 1))
        .when(kind == "maintenance_rewrite", F.get(F.filter(w, lambda x: ~x.isin(*_UPKEEP)), F.lit(0)))
        .when(~kind.isin(*_NAMELESS), word(w, 2))
    )
    listed = F.transform(F.split(F.regexp_extract("sql", r"\(([^)]*)\)", 1), ","), X.ident)
    on_column = (F.array_join(F.slice(w, 1, 2), " ") == "alter table") & (word(w, 4) == "column")
    keyed = kind.isin("create_index", "dml_insert") | ((kind == "add_constraint") & F.exists(w, lambda x: x.isin("unique", "foreign", "primary")))
    return one.select(
        "script_id", "idx", "part", "kind", "sql",
        _name(table).alias("tbl"),
        F.when(on_column, _name(word(w, 5))).alias("col"),
        _name(F.when(kind.isin("rename_column", "rename_table"), F.element_at(w, -1)).when(kind.isin("create_view", "drop_view"), word(w, 2))).alias("new_name"),
        F.when(kind == "alter_type", F.trim(F.regexp_extract("sql", r"(?i)\btype\s+(.+?)(?:\s+using\b.*)?$", 1))).alias("new_type"),
        _name(F.when(kind.isin("create_index", "drop_index"), word(i, 2)).when(kind.isin("add_constraint", "drop_constraint", "validate_constraint"), after(w, "constraint"))).alias("index_name"),
        F.when(keyed, listed).otherwise(F.array().cast("array<string>")).alias("columns"),
    )


def events_by_text(statements: DataFrame) -> DataFrame:
    """As ``change_events``, with each distinct code taken apart once; statements of a fleet are often the same. Both are read twice, so ``statements`` should be written."""
    texts = materialize(statements.select("code", "clauses").distinct().withColumn("_t", F.monotonically_increasing_id()))
    each = change_events(texts.select(F.col("_t").alias("script_id"), F.lit(0).alias("idx"), "code", "clauses")).drop("idx").withColumnRenamed("script_id", "_t")
    each = materialize(texts.join(each, "_t").drop("_t"))
    own = statements.select("script_id", "idx", "code", "clauses").alias("s").join(each.alias("e"), (F.col("s.code") == F.col("e.code")) & (F.col("s.clauses") == F.col("e.clauses")))
    return own.select("s.script_id", "s.idx", *(f"e.{c}" for c in each.columns if c not in ("code", "clauses")))
