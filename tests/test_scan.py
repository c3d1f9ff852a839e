"""Running sum / max / lag from the range-partitioned scan equal window results,
with one key holding most rows and several Arrow batches per partition."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridekit.functions.scan import first_rows, row_numbers, running_aggregates


def test_running_aggregates_hot_key(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    random.seed(7)
    rows = [(0 if random.random() < 0.45 else random.randint(1, 40), i,
             random.randint(0, 9) if random.random() > 0.05 else None, random.choice(["a", "b", None])) for i in range(15000)]
    df = spark.createDataFrame(rows, "k int, o long, v int, s string")
    r = running_aggregates(df, ["k"], ["o"], {"rs": ("v", "sum"), "rm": ("v", "max"), "lg": ("s", "lag")},
                           num_partitions=12)
    w = W.partitionBy("k").orderBy("o")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    ref = df.select("k", "o", F.coalesce(F.sum("v").over(run), F.lit(0)).alias("rs2"), F.max("v").over(run).alias("rm2"),
                    F.lag("s").over(w).alias("lg2"))
    j = r.join(ref, ["k", "o"])
    assert j.count() == 15000
    bad = j.where(~F.col("rs").eqNullSafe(F.col("rs2")) | ~F.col("rm").eqNullSafe(F.col("rm2")) | ~F.col("lg").eqNullSafe(F.col("lg2")))
    assert bad.count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_row_numbers_global(spark):
    df = spark.range(5000).withColumn("h", F.md5(F.col("id").cast("string")))
    r = row_numbers(df, [], ["h", "id"], "rn", num_partitions=7)
    ref = df.select("id", F.row_number().over(W.orderBy("h", "id")).alias("rn2"))
    assert r.join(ref, "id").where("rn <> rn2").count() == 0


def test_integers_stay_exact_beyond_doubles(spark):
    big = 2**53
    df = spark.createDataFrame([(0, i, big + i) for i in range(300)], "k int, o long, v long")
    got = running_aggregates(df, ["k"], ["o"], {"s": ("v", "sum"), "m": ("v", "max")}, num_partitions=9).orderBy("o").collect()
    total = 0
    for i, r in enumerate(got):
        total += big + i
        assert (r["s"], r["m"]) == (total, big + i)


def test_null_keys_and_empty_input(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(50)] + [(1, i, 2) for i in range(50)], "k int, o long, v int")
    got = running_aggregates(df, ["k"], ["o"], {"s": ("v", "sum")}, num_partitions=6).groupBy("k").agg(F.max("s").alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {None: 50, 1: 100}
    assert running_aggregates(df.limit(0), ["k"], ["o"], {"s": ("v", "sum")}).count() == 0


def test_first_rows_prunes_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), "id")
    got = first_rows(df, ["k"], ["id"], 4)
    assert got.count() == 12
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
