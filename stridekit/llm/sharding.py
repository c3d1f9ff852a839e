"""Rendezvous (highest-random-weight) sharding over weighted shards, as column expressions only.

A key goes to the shard with the largest ``weight / -ln(u)``, ``u`` being a
uniform hash of (key, shard) in (0, 1). The choice depends on the key and the
shards alone: adding a shard moves rows only into it, and its expected share
is its weight over all weights. Rows with equal keys share a shard.

Edge cases: a null key is a key of its own (all such rows share a shard); a
null text counts as empty (0 bytes, crc32 0); repeated rows share a shard and
get slots of their own; an empty table gives no rows. Extra columns of the
input are not carried into the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir
from .textblocks import fresh, without

_UNIT = float(1 << 52)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (0 to len(weights) - 1) that wins the rendezvous for a key."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    shards = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(weights)])
    digest = F.xxhash64(text)

    def score(s: Column) -> Column:
        # two rounds of the hash: the first digests the key, the second meets the shard
        u = (F.shiftrightunsigned(F.xxhash64(digest, s["i"]), 12).cast("double") + 0.5) / _UNIT
        return F.struct((s["w"] / -F.log(u)).alias("score"), (-s["i"]).alias("i"))

    return (-F.array_max(F.transform(shards, score))["i"]).cast("int")


def with_slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number each shard's rows from 0 without gaps, never ordering a whole shard in one task.

    The rows are checkpointed with the number of the partition they are in; rows
    are numbered inside (shard, partition) and shifted by the count of the shard's
    earlier partitions. The largest sort is one shard's rows of one partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = without(df, slot)
    part, row, at, of, before = (fresh(df, f"_{c}") for c in ("part", "row", "at", "of", "before"))
    kept = df.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()}).checkpoint()
    counts = kept.groupBy(F.col(shard).alias(of), F.col(part).alias(at)).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(of, at, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(shard, part).orderBy(row)
    numbered = kept.withColumn(slot, F.row_number().over(inside) - 1).join(offsets, F.col(shard).eqNullSafe(F.col(of)) & (F.col(part) == F.col(at)))
    return numbered.withColumn(slot, F.col(slot) + F.col(before)).drop(part, row, at, of, before)


def shard_documents(docs: DataFrame, weights: list[float], grown_weight: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    ``grown_shard``: the shard when one more shard of ``grown_weight`` (default: the last weight) is added.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [*weights, grown_weight or weights[-1]]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), more).alias("grown_shard"),
    )
    cols = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return with_slots(rows).withColumn("slot", F.col("slot").cast("long")).select(*cols)
