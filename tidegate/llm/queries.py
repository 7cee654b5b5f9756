"""Registered queries over the whole given tables, one for each operator of this subpackage, and SQL for some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, importance, language_id, merkle, oracle, quality, sentencepiece_codec, sharding, suffix_dedup, token_counts, url_filters
from tidegate.llm.embedding_dedup import near_duplicates
from tidegate.llm.folds import fold
from tidegate.llm.jaccard_join import jaccard_components
from tidegate.llm.lm_scoring import lm_scores
from tidegate.session import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
YEAR = 366 * 86_400
START = 1_704_067_200


def captures_and_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each page as a capture at a time set by its id, and as an entry of three dated lists.

    The lists: hosts and second-level domains that are blocked, and hosts with a first path segment that are allowed.
    """
    host = url_filters.url_host(F.col("url"))
    when = lambda a: (F.lit(START) + F.pmod(F.col("page_id") * a, F.lit(YEAR))).cast("long")
    captures = pages.select("page_id", "url", when(7_919_993).alias("fetched_at"))

    def entry(name: str, effect: str, pattern: Column, a: int, active: Column) -> DataFrame:
        return pages.select(F.lit(name).alias("list"), F.lit(effect).alias("effect"), pattern.alias("pattern"), when(a).alias("at"), active.alias("active"))

    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    head = F.concat(host, F.lit("/"), F.element_at(url_filters.path_segments(F.col("url")), 1))
    entries = entry("hosts", "block", host, 15_485_863, F.pmod(F.col("page_id"), F.lit(3)) != 0)
    entries = entries.unionByName(entry("domains", "block", domain, 32_452_843, F.pmod(F.col("page_id"), F.lit(7)) == 0))
    return captures, entries.unionByName(entry("paths", "allow", head, 49_979_687, F.pmod(F.col("page_id"), F.lit(2)) == 0))


def _first(df: DataFrame, *names: str) -> DataFrame:
    """The columns that the query's contract names, then the others."""
    return df.select(*names, *(c for c in df.columns if c not in names))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(*captures_and_entries(table(spark, sf_dir, "pages")))


OP1_SQL = f"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
             split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/', 2) AS head FROM pages),
c AS (SELECT *, {START} + page_id * 7919993 % {YEAR} AS fetched_at FROM p),
e AS (SELECT lst, effect, pattern, since, bool_and(active) AS active FROM (
    SELECT 'hosts' AS lst, 'block' AS effect, host AS pattern, {START} + page_id * 15485863 % {YEAR} AS since, page_id % 3 <> 0 AS active FROM p
    UNION ALL SELECT 'domains', 'block', array_to_string(string_split(host, '.')[-2:], '.'), {START} + page_id * 32452843 % {YEAR}, page_id % 7 = 0 FROM p
    UNION ALL SELECT 'paths', 'allow', host || '/' || head, {START} + page_id * 49979687 % {YEAR}, page_id % 2 = 0 FROM p WHERE head <> '') GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY lst, effect, pattern ORDER BY since) AS til FROM e),
m AS (SELECT page_id, count(*) FILTER (effect = 'block') AS b, count(*) FILTER (effect = 'allow') AS a, string_agg(lst || ' ' || pattern, ',' ORDER BY lst || ' ' || pattern) AS matched
    FROM c JOIN v ON active AND fetched_at >= since AND (til IS NULL OR fetched_at < til)
      AND (pattern = host OR ends_with(host, '.' || pattern) OR (head <> '' AND pattern = host || '/' || head)) GROUP BY page_id)
SELECT page_id, url, fetched_at, coalesce(b, 0) AS n_block, coalesce(a, 0) AS n_allow, coalesce(matched, '') AS matched, coalesce(b > 0 AND a = 0, false) AS blocked FROM c LEFT JOIN m USING (page_id)"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    found = quality.scores(docs, weights).withColumns({"held_out": fold("doc_id", 4) == 2, "predicted": (F.col("score") >= 0.7).cast("int")})
    return _first(found, "doc_id", "held_out", "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, fold("doc_id", 5) != 0, "doc_id", "text", "lang")
    return _first(language_id.predict(docs, model).withColumn("held_out", fold("doc_id", 5) == 0), "doc_id", "held_out", "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.vocabulary(TOKENIZER))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM i),
o AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
h AS (SELECT o.doc_id, o.k, o.n, i.item FROM o JOIN i ON o.n = i.n AND o.win = i.win),
x AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS hex FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(hex, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.pieces_of(TOKENIZER))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, pct=90)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return _first(found.withColumn("held_out", fold("doc_id", 7) == 2), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))[0]


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_url_filters, op2_quality_classifier, op3_language_id, op4_token_counts, op5_suffix_array_dedup, op6_benchmark_decontamination, op7_sentencepiece, op8_ngram_jaccard_join, op9_lm_scoring, op10_embedding_near_dedup, op11_merkle_manifest, op12_sharding, op13_importance_resampling)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op6_benchmark_decontamination": OP6_SQL, "op11_merkle_manifest": oracle.merkle(), "op13_importance_resampling": oracle.resampling()}
