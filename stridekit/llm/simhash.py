"""SimHash document fingerprints and the search of all fingerprints within a Hamming radius.

Terms are a text's words and word pairs (64-bit hashes). A term
weighs ``(1 + ln tf)`` times its kind's weight; each bit of its ``BITS``-bit hash
votes with that weight, and the fingerprint holds the votes' signs. Two
fingerprints' likeness is the share of equal bits.

Search: a fingerprint is cut into radius + 1 blocks; table t holds the
fingerprints with block t moved to the front. Two within the radius share a
whole block, so a table's rows with an equal front are all the candidates, and
the distance decides. Equal fingerprints are one row with their number, so
copies never pair.

Neighbours: documents are ordered by falling doc_id without one big sort task:
quantiles of the ids cut them into buckets, a window looks ahead inside each, and
the first document of every bucket is also handed to the bucket before it.

Edge cases: a null text counts as empty; texts without words have the zero
fingerprint (all such are alike); a single document is its own next one; rows
with one doc_id follow each other by their text's hash; null ids come last; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .textblocks import NON_SPACE, blocks, bounded_batches, fresh, grams, mix, text_buffer, without, words

BITS = 256
WEIGHTS = (0.3, 1.0)  # of single words and of pairs
BUCKET_ROWS = 2000
MAX_BUCKETS = 20_000  # a bucket is a unit of sorting; beyond this they grow
RADIUS = 3


def fingerprints(col: pa.Array, bits: int = BITS) -> np.ndarray:
    """One row of ``bits // 8`` bytes for each text."""
    buf, offs = text_buffer(col)
    out = np.zeros((len(offs) - 1, bits // 8), np.uint8)
    salts = [np.uint64(int(x)) for x in mix(np.arange(1, bits // 64 + 1, dtype=np.uint64))]
    for i0, i1 in blocks(offs, 1 << 20):
        h, bounds = words(buf[offs[i0] : offs[i1]], offs[i0 : i1 + 1] - offs[i0], NON_SPACE)
        for i in range(i1 - i0):
            w = h[bounds[i] : bounds[i + 1]]
            if not len(w):
                continue
            ones, all_weight = np.zeros(bits, np.float32), 0.0
            for k, weight in enumerate(WEIGHTS, 1):
                terms, tf = np.unique(grams(w, k), return_counts=True)
                votes = (weight * (1 + np.log(tf))).astype(np.float32)
                all_weight += float(votes.sum(dtype=float))
                for a in range(0, len(terms), 1 << 12):
                    t = terms[a : a + (1 << 12)]
                    wide = np.stack([mix(t ^ s) for s in salts], axis=1).view(np.uint8)
                    ones += votes[a : a + (1 << 12)] @ np.unpackbits(wide, axis=1).astype(np.float32)
            out[i0 + i] = np.packbits(2 * ones > all_weight)  # votes for a bit against those not for it
    return out


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", bits: int = BITS, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the lower-case hex fingerprint of column ``text`` added (it replaces one of its name), and without ``drop``."""
    bounded_batches(df.sparkSession)
    names = [c for c in df.columns if c not in drop and c.lower() != name.lower()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hexes = [r.tobytes().hex() for r in fingerprints(batch.column(text), bits)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hexes, pa.string())], names=[*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)
    return df.mapInArrow(scan, f"{fields}, `{name}` string")


def _distance(a, b, bits: int):
    """Differing bits of two hex fingerprints."""
    total = None
    for k in range(0, bits // 4, 8):
        part = F.bit_count(F.conv(F.substring(a, k + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, k + 1, 8), 16, 10).cast("long")))
        total = part if total is None else total + part
    return total


def within_radius(rows: DataFrame, radius: int = RADIUS, bits: int = BITS, name: str = "fingerprint") -> DataFrame:
    """a, b (a < b), distance, rows_a, rows_b of all pairs of distinct fingerprints within ``radius`` bits."""
    size = bits // 4
    cuts = [round(t * size / (radius + 1)) for t in range(radius + 2)]
    distinct = rows.groupBy(F.col(name).alias("f")).agg(F.count("*").alias("m"))
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.substring("f", cuts[t] + 1, cuts[t + 1] - cuts[t]).alias("front")) for t in range(radius + 1)]))
    tables = distinct.select("f", "m", table.alias("x")).select("f", "m", "x.t", "x.front")
    left = tables.select("t", "front", F.col("f").alias("a"), F.col("m").alias("rows_a"))
    right = tables.select("t", "front", F.col("f").alias("b"), F.col("m").alias("rows_b"))
    near = left.join(right, ["t", "front"]).where("a < b").withColumn("distance", _distance(F.col("a"), F.col("b"), bits)).where(F.col("distance") <= radius)
    # a pair that shares several blocks counts in the first of them only
    earlier = F.lit(False)
    for t in range(radius):
        same = F.substring("a", cuts[t] + 1, cuts[t + 1] - cuts[t]) == F.substring("b", cuts[t] + 1, cuts[t + 1] - cuts[t])
        earlier = earlier | ((F.col("t") > t) & same)
    return near.where(~earlier).select("a", "b", "distance", "rows_a", "rows_b")


def _bucketed(df: DataFrame, cuts: list[float], buckets: int) -> DataFrame:
    """``_bucket``: the place of the negated id among the cuts; rows without an id follow, by ranges of their text's hash."""
    nameless = F.lit(len(cuts) + 1.0) + F.floor((F.col("_h").cast("double") + 2.0**63) / 2.0**64 * buckets)
    if not cuts:
        return df.withColumn("_bucket", F.when(F.col("doc_id").isNull(), nameless).otherwise(0.0).cast("int"))
    split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_falling", outputCol="_place", handleInvalid="keep")
    placed = split.transform(df.withColumn("_falling", -F.col("doc_id").cast("double")))
    return placed.withColumn("_bucket", F.coalesce("_place", nameless).cast("int")).drop("_falling", "_place")


def with_next(docs: DataFrame, derive, ahead: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``derive(docs)`` with ``next_<column>`` for each column in ``ahead``: those of the next document in the order of falling doc_id (after the last: the first).

    ``derive`` adds columns row by row; it runs once over the documents and the handed-over heads together.
    """
    rows = docs.withColumn("_h", F.xxhash64("text"))
    ids = rows.select("doc_id", "_h")
    buckets = min(max(1, -(-ids.count() // bucket_rows)), MAX_BUCKETS)
    cuts = sorted({-float(q) for q in ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    rows, ids = _bucketed(rows, cuts, buckets), _bucketed(ids, cuts, buckets)
    # the first document of each bucket (one row a bucket) is also the one behind the last of the bucket before it
    falling = F.struct((-F.coalesce(F.col("doc_id"), F.lit(0))).alias("f"), "_h", "doc_id")
    heads = ids.groupBy("_bucket").agg(F.min(falling).alias("x")).select("_bucket", "x.doc_id", "x._h").orderBy("_bucket").collect()
    before = [(heads[i - 1]["_bucket"], h["doc_id"], h["_h"]) for i, h in enumerate(heads)]
    first = F.broadcast(docs.sparkSession.createDataFrame(before, "_to int, _id long, _fh long"))
    ghosts = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_fh")))  # of repeated rows any one serves
    ghosts = ghosts.withColumn("_bucket", F.col("_to")).drop("_to", "_id", "_fh").withColumn("_ghost", F.lit(1))
    both = derive(rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts))
    window = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "_h")
    led = both.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in ahead])
    return led.where("_ghost = 0").drop("_h", "_bucket", "_ghost")


def fingerprint_digest(docs: DataFrame, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text ends, instead of its last third (floor of a third of its code
    points), with as many first code points of the next document's text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_next(docs.select("doc_id", text.alias("text")), lambda df: with_fingerprint(df, bits=bits), ["text", "fingerprint"], bucket_rows)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", bits, drop=("edited",))
    like = lambda c: F.lit(1.0) - _distance(F.col("fingerprint"), F.col(c), bits) / F.lit(float(bits))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"),
    )


def with_near_counts(rows: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """``rows`` with ``n_near``: the other rows whose fingerprint lies within the radius (copies included)."""
    ensure_checkpoint_dir(rows.sparkSession)
    rows = without(rows, "n_near").checkpoint()
    near = within_radius(rows, radius, bits)
    ends = near.select(F.col("a").alias("f"), F.col("rows_b").alias("m")).unionByName(near.select(F.col("b").alias("f"), F.col("rows_a").alias("m")))
    own = rows.groupBy(F.col("fingerprint").alias("f")).agg((F.count("*") - 1).alias("m"))
    f = fresh(rows, "_f")
    total = own.unionByName(ends).groupBy(F.col("f").alias(f)).agg(F.sum("m").alias("n_near"))
    return rows.join(total, F.col("fingerprint") == F.col(f)).drop(f)
