from pyspark.sql import functions as F

import corpus_pipeline


def test_the_language_that_is_found_goes_with_the_pieces(spark):
    """What the first stage says of a text is in the pipeline's result: rows keep their own language, null ones too."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, f"una casa {i}", None if i % 3 == 0 else f"l{i % 3}", "s", 1) for i in range(300)], schema)
    got = corpus_pipeline.encode(spark, docs, "")
    assert got.columns == ["doc_id", "lang", "n_pieces", "ids", "round_trip"]
    assert {r["doc_id"]: r["lang"] for r in got.select("doc_id", "lang").collect()} == {i: None if i % 3 == 0 else f"l{i % 3}" for i in range(300)}
    assert got.where(~F.col("round_trip") | (F.col("n_pieces") < 1)).count() == 0
