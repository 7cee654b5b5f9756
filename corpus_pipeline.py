"""The training-text pipeline: each stage takes (spark, docs, sf_dir) and gives a DataFrame that the next one reads.

All stages but the last give the columns of ``docs``; the last gives the pieces of every text that is left, with the
language that the first has found for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, jaccard_join, language_id, sentencepiece_codec, suffix_dedup
from tidegate.llm.folds import fold
from tidegate.llm.queries import TOKENIZER
from tidegate.session import discard, materialize, scratch, table

#: score from which a prediction replaces another language
SURE = 0.999


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key that tells rows apart by id and text, since ids may be null or repeated, and the key's name."""
    key = _free(docs, "_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no letter go, and only these; the others get the predicted language where theirs is null or wrong.

    A language counts as wrong if the model knows it and gives another a score of ``SURE`` or more; one that the model
    never learned stays. With no learned language, null becomes `und`. The keys of what gets another language are
    written first: their size is then known, and Spark broadcasts them if they are small, so the texts themselves
    needn't be shuffled.
    """
    rows, key = _keyed(docs.where(F.col("text").rlike(r"\p{L}")))
    lang, score = _free(docs, "_lang"), _free(docs, "_score")
    model = language_id.learn(docs, fold("doc_id", 5) != 0, "doc_id", "text", "lang")
    said, sure = F.col(lang), F.col("lang").isin(model.langs) & (F.col(score) >= SURE)
    other = F.col("lang").isNull() | (sure & (said != F.col("lang")))
    found = language_id.predict(rows, model, key).groupBy(key).agg(F.min("lang_pred").alias(lang), F.min("score").alias(score))
    new = materialize(found.join(rows.select(key, "lang").distinct(), key).where(other).select(key, lang, score).distinct())
    return rows.join(new, key, "left").withColumn("lang", F.when(said.isNotNull() & other, said).otherwise(F.col("lang"))).select(*docs.columns)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, whatever ids repeat or are null: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a repeated string of 200 bytes go, with the rest of characters that are cut. Documents of which nothing is left go."""
    rows, key = _keyed(docs)
    text = _free(docs, "_text")
    kept = suffix_dedup.remove_repeats(rows, key, whole_chars=True).where(F.size("starts") > 0)
    kept = kept.groupBy(key).agg(F.min(F.col("kept").cast("string")).alias(text))
    cut = F.col(text).isNotNull()
    out = rows.join(kept, key, "left").where(~cut | (F.trim(text) != ""))
    return out.withColumns({"text": F.coalesce(text, "text"), "n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words of a benchmark item occurs go."""
    rows, key = _keyed(docs)
    return decontaminate.clean(rows, table(spark, sf_dir, "benchmark"), key).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document with its language, checked by decoding."""
    found = sentencepiece_codec.encode(docs, sentencepiece_codec.pieces_of(TOKENIZER), keep=["lang"])
    return found.select("doc_id", "lang", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", jaccard),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", remove_benchmark),
    ("SentencePiece encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):  # what a stage writes on its way goes when its result is written
            done = materialize(stage(spark, docs, sf_dir), keep=True)
        discard(docs)
        docs = done
    return docs
