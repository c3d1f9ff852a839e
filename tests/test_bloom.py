"""Incremental dedup through a Bloom filter: exact results, no lost match, and few rows to the exact join."""

from pyspark.sql import functions as F

from stridekit.operators import bloom
from stridekit.operators import corpus as C


def test_anti_join_is_exact_on_both_sides_of_the_size_check(spark):
    old = spark.range(0, 3000, 3).select((F.col("id") * 7919).cast("string").alias("k")).unionByName(spark.createDataFrame([(None,), ("",)], "k string"))
    new = spark.range(5000).select("id", (F.col("id") * 7919).cast("string").alias("k"), F.lit("x").alias("_maybe_not")).unionByName(
        spark.createDataFrame([(-1, None, "y"), (-2, "", "y"), (-3, "a", "z"), (-3, "a", "z")], "id long, k string, _maybe_not string"))
    want = sorted([i for i in range(5000) if i % 3 or i >= 3000] + [-1, -3, -3])
    for words in (bloom.MAX_WORDS, 1):
        got = bloom.anti_join(new, old.distinct(), "k", words)
        assert sorted(r["id"] for r in got.collect()) == want and set(got.columns) == set(new.columns)
    assert bloom.anti_join(new, old.limit(0), "k").count() == new.count() and bloom.anti_join(new.limit(0), old, "k").count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    words = 1 << (20_000 * bloom.BITS_A_KEY // 64).bit_length()
    table = bloom.bit_words(keys, "k", words).checkpoint()
    both = spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("k"))
    got = bloom.with_possible_match(both, "k", table, words, "m").groupBy((F.col("id") < 20_000).alias("old"), "m").count().collect()
    n = {(r["old"], r["m"]): r["count"] for r in got}
    assert n.get((True, False), 0) == 0 and n[True, True] == 20_000 and n.get((False, True), 0) < 800


def test_incremental_dedup_keeps_columns(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, t string")
    got = C.incremental_dedup(new, spark.createDataFrame([("A",), (None,)], "u string"), F.col("t"), F.lower("u"))
    assert got.columns == ["id", "t"] and sorted(r["id"] for r in got.collect()) == [2, 3]
