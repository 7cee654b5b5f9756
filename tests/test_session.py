from tidegate.session import clean_shared, materialize, shared_dir, spread_out


def test_materialize_and_clean(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5 and df.columns == ["id"]
    clean_shared(spark)
    assert shared_dir(spark) == shared_dir(spark)
    assert materialize(spark.range(3).where("id > 9")).collect() == []


def test_spread_out(spark):
    few, many, dealt = spark.range(0, 10, 1, 1), spark.range(0, 100, 1, 64), spark.range(10).repartition(1)
    assert spread_out(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread_out(many) is many and spread_out(dealt) is dealt
    named = few.withColumnRenamed("id", "SortKeyJoinAggregate")  # a column's name is no plan
    assert spread_out(named) is not named and spread_out(few.distinct()).rdd.getNumPartitions() > 0
