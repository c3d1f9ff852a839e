"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two aggregations (combined before the shuffle, so a hub with a
third of all links is no hot task) and two joins (whose skewed side Spark may
split). The links of a round are checkpointed; only one count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


LINKS_A_TASK = 20_000


def fewer(df: DataFrame, rows_a_task: int = LINKS_A_TASK) -> DataFrame:
    """A checkpointed ``df`` in as many partitions as its rows need: each shuffle's files and tasks follow from them."""
    return df.coalesce(max(1, -(-df.count() // rows_a_task)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node that has a link; root: the smallest node of its component.

    ``edges`` is counted and read again: pass a checkpoint. Every step's partitions follow from that count,
    and its joins sort and merge: a broadcast would be one more job over all partitions of a shuffle.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    parts = max(1, -(-edges.count() // LINKS_A_TASK))
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").coalesce(parts)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts).checkpoint()
        # done when all links are stars: no node has two targets, and no target has one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
            e.select(F.col("v").alias("x"), F.lit(0).alias("s"), F.lit(1).alias("t"))
        )
        odd = ends.groupBy("x").agg(F.sum("s").alias("s"), F.max("t").alias("t")).where("s > 1 OR (s > 0 AND t > 0)").coalesce(parts)
        if not odd.count():
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().coalesce(parts)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).checkpoint()
