"""A Bloom filter as a table of bit words, for anti-joins with many keys.

Every key sets ``HASHES`` bits of a table of 64-bit words: a group-by of the word with ``bit_or``, combined in each
task before the shuffle. The table is broadcast within a checked size, and rows whose bits are not
all set have no match: they stay where they are. Only the others are shuffled to the exact anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

HASHES = 3
BITS_A_KEY = 16  # about one row in 200 without a match passes
MAX_WORDS = 1 << 20  # 16 MB; more keys than that takes (4 million) go to a plain join


def _places(key: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64 * words)) for i in range(HASHES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def bit_words(keys: DataFrame, key: str, words: int) -> DataFrame:
    """word, bits of the filter of all values of ``key``; words without a set bit are left out."""
    places = keys.select(F.explode(F.array(*_places(F.col(key), words))).alias("place"))
    return places.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(_bit(F.col("place"))).alias("bits"))


def with_possible_match(df: DataFrame, key: str, table: DataFrame, words: int, out: str) -> DataFrame:
    """``df`` with ``out``: false where no key of the filter equals the row's."""
    table = F.broadcast(table)
    hit = F.lit(True)
    for i, place in enumerate(_places(F.col(key), words)):
        one = table.select(F.col("word").alias(f"_w{i}"), F.col("bits").alias(f"_b{i}"))
        df = df.withColumn(f"_p{i}", place).join(one, F.floor(F.col(f"_p{i}") / 64) == F.col(f"_w{i}"), "left")
        hit = hit & (F.coalesce(F.col(f"_b{i}"), F.lit(0)).bitwiseAND(_bit(F.col(f"_p{i}"))) != 0)
    return df.withColumn(out, hit).drop(*[f"_{x}{i}" for x in "pwb" for i in range(HASHES)])


def anti_join(new: DataFrame, old_keys: DataFrame, key: str, max_words: int = MAX_WORDS) -> DataFrame:
    """Rows of ``new`` whose ``key`` is not among ``old_keys`` (one column ``key``); a null key has no match."""
    ensure_checkpoint_dir(new.sparkSession)
    n = old_keys.count()
    words = 1 << max(4, (n * BITS_A_KEY // 64).bit_length())
    if words > max_words:
        return new.join(old_keys, key, "left_anti")
    marked = with_possible_match(new, key, bit_words(old_keys, key, words).checkpoint(), words, "_maybe")
    exact = marked.where("_maybe").join(old_keys, key, "left_anti")
    return marked.where("NOT _maybe").unionByName(exact).drop("_maybe")
