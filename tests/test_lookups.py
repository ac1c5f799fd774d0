"""Joins and firsts under skew, against plain joins."""

from pyspark.sql import functions as F

from attrloom.operators import lookups as lk


def skewed(spark):
    return spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("row"),
                                    F.create_map(F.lit("m"), F.lit(1)).alias("extra"))


def test_heavy_split_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(lk, "HEAVY_KEYS", 3)
    big = skewed(spark)
    side = big.filter("k < 400").groupBy("k").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    plain = sorted((r["k"], r["row"], r["low"]) for r in big.join(side, "k", "left").collect())
    for joined in (lk.join_heavy_split(big, side, ["k"], "n"), lk.join_per_key(big, side, ["k"], "n")):
        assert joined.columns == ["k", "row", "extra", "low"]
        assert sorted((r["k"], r["row"], r["low"]) for r in joined.collect()) == plain


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lk, "BROADCAST_ROWS", 10)
    big = skewed(spark)
    side = big.groupBy("k").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    joined = lk.join_per_key(big, side, ["k"], "n")
    assert joined.filter("low is null").count() == 0 and joined.count() == 3000
    assert "_heavy" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert not lk.fits_broadcast(side) and lk.fits_broadcast(side.limit(3))
    assert not lk.fits_broadcast(side.limit(3), max_bytes=5)


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, "A", 3), (1, "a", 1), (1, "b", 2)], "d int, s string, pos int")
    got = lk.first_per_key(df, [F.col("d"), F.lower("s")], "pos")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "b", 2)]
