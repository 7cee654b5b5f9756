"""URL filters as a temporal list join, with DataFrame functions only.

List entries are dated: from its time on an entry switches a pattern on or off in a list. They become validity
intervals, and every capture is evaluated against the entries that are active at its fetch time. Patterns are hosts
(with all hosts below them) or a host with leading path segments; so a URL's possible patterns are few and all known,
and a match is an equi-join. The as-of part is an equi-join too: intervals are cut at the bounds of time slots whose
width is set for each pattern by its number of intervals, so a capture meets a bounded number of intervals on
average, however often a pattern was switched. A slot with many captures is dealt over as many parts as their number asks
for, each with a copy of that slot's intervals (``SPLIT``), so no pattern fills one task; and since a slot holds a bounded
number of intervals, copies are linear in captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
#: intervals of one pattern for each of its time slots, about
PER_SLOT = 8
DAY = 86_400
#: captures of one pattern's slot for each of its parts, about
SPLIT = 2_000
#: copies of each pattern's row for the join that tells captures its width, and of a hot slot's for its parts
SALTS = 16


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; empty where there is none."""
    place = F.regexp_extract(url, SCHEME + r"([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, SCHEME + r"[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")


def url_patterns(url: Column, labels: Column, depth: Column) -> Column:
    """Patterns that can match a URL: its host's endings of up to ``labels`` labels, and the host with up to ``depth`` leading path segments."""
    host, segments = url_host(url), path_segments(url)
    parts = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), labels)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(segments), depth)), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/")))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(host, F.lit("")) == "", none).otherwise(F.array_distinct(F.concat(F.when(labels > 0, ends).otherwise(none), F.when((F.size(segments) > 0) & (depth > 0), heads).otherwise(none))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, effect, pattern, valid_from, valid_to) while a pattern is on; valid_to is null for the present state.

    ``entries`` (list, effect, pattern, at long seconds, active boolean). Entries with a null anywhere are left out. Of
    entries of one list and pattern at one time, any that switches off prevails. The next entry is found within a day,
    and for a day's last entry from the first entries of days, so no window holds more than one day of a pattern.
    """
    key = ["list", "effect", "pattern"]
    e = entries.select(*key, F.col("at").cast("long"), "active").dropna().groupBy(*key, "at").agg(F.bool_and("active").alias("active"))
    e = e.withColumn("day", F.floor(F.col("at") / DAY))
    first = e.groupBy(*key, "day").agg(F.min("at").alias("first"))
    first = first.withColumn("later", F.lead("first").over(Window.partitionBy(*key).orderBy("day"))).drop("first")
    e = e.withColumn("next", F.lead("at").over(Window.partitionBy(*key, "day").orderBy("at"))).join(first, [*key, "day"])
    return e.where("active").select(*key, F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"))


def dealt(named: DataFrame, spans: DataFrame, lo: int, hi: int) -> tuple[DataFrame, DataFrame]:
    """Captures (with pattern, _id, _url and _at) and copies of intervals (list, effect, pattern, valid_from, valid_to within ``lo`` to ``hi``), both with the slot and part in which they meet."""
    # a width for each pattern: so many slots that each holds about PER_SLOT intervals
    width = spans.groupBy("pattern").agg(F.ceil(F.lit(float(hi - lo + 1)) / F.ceil(F.count(F.lit(1)) / F.lit(PER_SLOT))).cast("long").alias("width"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = width.join(named.select("pattern").distinct(), "pattern").withColumn("salt", salts)
    slot = lambda at: F.floor((F.col(at) - lo) / F.col("width"))
    cut = spans.withColumn("salt", F.pmod(F.xxhash64("list", "effect", "valid_from"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"]).drop("salt")
    cut = cut.withColumn("slot", F.explode(F.sequence(slot("valid_from"), F.floor((F.col("valid_to") - 1 - lo) / F.col("width")))))
    mark = F.xxhash64("_id", "_url", "_at")
    found = named.withColumn("salt", F.pmod(mark, F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"]).withColumn("slot", slot("_at"))
    # slots with more captures than a part takes: few, since their number times SPLIT is at most that of captures
    hot = found.groupBy("pattern", "slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("pattern", "slot", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    found = found.join(hot.withColumn("salt", salts), ["pattern", "slot", "salt"], "left").withColumn("part", F.pmod(F.shiftrightunsigned(mark, 8), F.coalesce("parts", F.lit(1))).cast("int"))
    slots = cut.join(hot, ["pattern", "slot"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return found, slots


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id_col, url_col, time_col, n_block, n_allow, blocked, matched) for every row of ``captures``.

    A capture is blocked if a `block` entry is active at its time (seconds) and no `allow` entry is. matched: the active
    entries as sorted 'list pattern' strings, joined by a comma. An entry is active from its own time on, up to but
    without the time of the next entry for the same list and pattern. Null or malformed URLs and null times match
    nothing. Rows are told apart by (id, url, time): repeated rows come back as often as they are given, and null ids
    are kept. Empty tables give no rows, or rows without matches. Other columns aren't read.
    """
    spans = validity_intervals(entries)
    sizes = entries.agg(F.coalesce(F.max(F.when(~F.col("pattern").contains("/"), F.size(F.split("pattern", r"\.")))), F.lit(0)).alias("labels"), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("depth")).first()
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).cast("long").alias("_at"))
    ends = rows.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    spans = spans.withColumns({"valid_from": F.greatest("valid_from", F.lit(lo)), "valid_to": F.least(F.coalesce("valid_to", F.lit(hi + 1)), F.lit(hi + 1))}).where("valid_from < valid_to")
    named = rows.distinct().where("_at is not null").withColumn("pattern", F.explode(url_patterns(F.col("_url"), F.lit(sizes["labels"]), F.lit(sizes["depth"]))))
    found, slots = dealt(named, spans, lo, hi)
    met = found.join(slots.select("pattern", "slot", "part", "list", "effect", "valid_from", "valid_to"), ["pattern", "slot", "part"]).where("_at >= valid_from and _at < valid_to")
    count = lambda effect: F.count(F.when(F.col("effect") == effect, 1))
    hits = met.groupBy(F.col("_id").alias("k_id"), F.col("_url").alias("k_url"), F.col("_at").alias("k_at")).agg(count("block").alias("b"), count("allow").alias("a"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "list", "pattern"))), ",").alias("m"))
    out = rows.join(hits, F.expr("_id <=> k_id and _url <=> k_url and _at <=> k_at"), "left")
    out = out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_at").alias(time_col), F.coalesce("b", F.lit(0)).cast("long").alias("n_block"), F.coalesce("a", F.lit(0)).cast("long").alias("n_allow"), F.coalesce("m", F.lit("")).alias("matched"))
    return out.withColumn("blocked", (F.col("n_block") > 0) & (F.col("n_allow") == 0))
