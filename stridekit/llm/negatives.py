"""Hard-negative mining with exact integer scores by subset-sum tables (Four Russians).

Vectors become integers, floor(scale * x). A candidate is kept as packed bit-plane
bytes: its two's-complement digits, one byte for each group of eight dimensions and
each binary digit. For a block of anchors a table holds, for each group, the sums of
the anchors' components over all 256 subsets of the eight dimensions. A score is then
a shift-and-add over the planes, highest first: double what is there, add the table
rows that the candidate's bytes name. The scores are the full exact inner products.

Two passes over the candidates, which stay distributed, for each block of anchors
(a broadcast of at most ``ANCHORS_A_PASS`` anchors; more anchors make more passes):
the first finds every anchor's best rows of its own label, its positives; the second,
for each (anchor, positive), the best rows of other labels whose score lies in the
positive's window. A task keeps the best rows of each anchor, and Spark ranks what
the tasks found. Scores of all pairs are computed, none is kept beyond a tile.

Edge cases: rows with a null label, a null vector, or a null or non-finite component
take no part. Components are held to +-isqrt((2^63 - 1) / (100 * dimensions)), so that no
score or window overflows (2^25 and more for any vector of up to 64 dimensions); shorter vectors count
as padded with zeros, and an empty one scores 0. A null id is last among ties and is no
anchor (the largest 64-bit integer stands for it). Repeated rows are rows of their own:
a copy of an anchor can be its positive. An anchor without rows of its label, or
without rows in a window, gives no rows; so does an empty table. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

ANCHORS_A_PASS = 65_536
ROWS_A_TASK = 65_536
_GROUP = 8
_GROUPS_AT_ONCE = 16
_ANCHORS_AT_ONCE = 256
_TILE = 512
_CHUNK = 8_192
_NO_ID = np.iinfo(np.int64).max

_PACKED = "id long, label long, anchor boolean, groups int, width int, planes binary"
_BEST = "anchor_row long, slot int, anchor_id long, positive_id long, positive_score long, id long, score long"
_SCHEMA = pa.schema([("anchor_row", pa.int64()), ("slot", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()),
                     ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


# ------------------------------------------------------------------ bit planes

def quantise(x: np.ndarray, scale: float, dims: int) -> np.ndarray:
    """floor(scale * x) as integers within the range that ``dims`` dimensions allow."""
    limit = math.isqrt((2**63 - 1) // (100 * max(dims, 1)))
    with np.errstate(over="ignore"):  # a product beyond the doubles is held to the limit as well
        return np.clip(np.floor(x * scale), -limit, limit).astype(np.int64)


def pack(v: np.ndarray) -> np.ndarray:
    """Two's-complement digits of integer rows: bytes by (row, plane, group of eight dimensions)."""
    n, dims = v.shape
    groups = -(-dims // _GROUP)
    width = max(int(v.max(initial=0)).bit_length(), int(-v.min(initial=0) - 1).bit_length() if v.min(initial=0) < 0 else 0) + 1
    padded = np.zeros((n, groups * _GROUP), np.int64)
    padded[:, :dims] = v
    planes = (padded[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")


def unpack(planes: np.ndarray) -> np.ndarray:
    """The integers of packed rows."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    width = bits.shape[1]
    weights = np.left_shift(np.int64(1), np.arange(width, dtype=np.int64))
    weights[-1] = -weights[-1]
    return np.einsum("npd,p->nd", bits, weights)


def _joined(rows: pa.Table) -> np.ndarray:
    """Packed rows as one array by (plane, group, row), sign-extended to the widest row."""
    width, groups = (rows.column(c).to_numpy() for c in ("width", "groups"))
    out = np.zeros((int(width.max(initial=1)), int(groups.max(initial=0)), len(width)), np.uint8)
    kinds = np.unique(np.stack([width, groups], 1), axis=0)
    for w, g in kinds[kinds[:, 1] > 0]:
        at = np.flatnonzero((width == w) & (groups == g))
        data = rows.column("planes").take(pa.array(at)).combine_chunks()
        blob = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in data])
        block = blob.reshape(len(at), w, g).transpose(1, 2, 0)
        out[:w, :g, at] = block
        out[w:, :g, at] = block[-1:]
    return out


def subset_sums(v: np.ndarray, kind: type) -> np.ndarray:
    """Sums over all subsets of each group of eight dimensions, by (group, subset byte, row of v)."""
    parts = v.reshape(len(v), -1, _GROUP).transpose(1, 2, 0).astype(kind)
    table = np.zeros((parts.shape[0], 1 << _GROUP, len(v)), kind)
    for bit in range(_GROUP):
        half = 1 << bit
        table[:, half : 2 * half] = table[:, :half] + parts[:, bit, None]
    return table


def scores(planes: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Exact inner products of packed candidates (plane, group, row) and integer anchor rows, in tiles of candidates.

    Yields (first candidate, matrix by candidate and anchor)."""
    width, groups, n = planes.shape
    groups = min(groups, v.shape[1] // _GROUP)  # beyond either vector's end there are zeros
    most = np.abs(v).sum(axis=1).max(initial=0)
    kind = np.int32 if int(most) << width < 2**31 else np.int64
    cuts = range(0, groups, _GROUPS_AT_ONCE)
    tables = subset_sums(v[:, : groups * _GROUP], kind) if len(cuts) == 1 else None
    for at in range(0, n, _TILE):
        tile = planes[:, :, at : at + _TILE]
        total = np.zeros((tile.shape[2], len(v)), kind)
        found = np.empty_like(total)
        for cut in cuts:
            some = range(cut, min(cut + _GROUPS_AT_ONCE, groups))
            table = tables if tables is not None else subset_sums(v[:, cut * _GROUP : some.stop * _GROUP], kind)
            part = np.zeros_like(total)
            for plane in range(width - 1, -1, -1):
                part += part
                for g in some:
                    np.take(table[g - cut], tile[plane, g], axis=0, out=found, mode="clip")
                    if plane == width - 1:
                        part -= found
                    else:
                        part += found
            total += part
        yield at, total


# ----------------------------------------------------------------- best rows

class _Best:
    """The best ``n`` rows (highest score, then smallest id) of each of some places."""

    def __init__(self, places: int, n: int):
        self.n = n
        self.place = self.score = self.id = np.zeros(0, np.int64)
        self.cut = np.full(places, np.iinfo(np.int64).min)  # score and id of the last row of full places
        self.cut_id = np.full(places, _NO_ID)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.cut[place]) | ((score == self.cut[place]) & (ids < self.cut_id[place]))
        if not better.any():
            return
        place, score, ids = (np.concatenate([old, new[better]]) for old, new in ((self.place, place), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
        kept = rank < self.n
        self.place, self.score, self.id = place[kept], score[kept], ids[kept]
        last = rank == self.n - 1
        self.cut[place[last]], self.cut_id[place[last]] = score[last], ids[last]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _numbers(col) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(_NO_ID).to_numpy()


def _positives(batches, block: dict, n: int):
    """Of a task's rows, the best of each anchor's own label."""
    by_label = block["label"]  # sorted
    best: dict[int, _Best] = {}
    for rows in _chunks(batches):
        rows = rows.sort_by("label")
        label, ids, row, planes = _numbers(rows.column("label")), _numbers(rows.column("id")), _numbers(rows.column("row")), _joined(rows)
        for x in np.intersect1d(label, by_label):
            lo, hi = (int(np.searchsorted(label, x, side=side)) for side in ("left", "right"))
            first, end = (int(np.searchsorted(by_label, x, side=side)) for side in ("left", "right"))
            for a in range(first, end, _ANCHORS_AT_ONCE):
                z = min(a + _ANCHORS_AT_ONCE, end)
                keep = best.setdefault(a, _Best(z - a, n))
                for at, s in scores(planes[:, :, lo:hi], block["v"][a:z]):
                    here = slice(lo + at, lo + at + len(s))
                    c, k = np.nonzero((s >= keep.cut[None, :]) & (row[here, None] != block["row"][None, a:z]))
                    keep.add(k, s[c, k].astype(np.int64), ids[here][c])
    for a, keep in best.items():
        at = a + keep.place
        yield _rows(block, at, np.zeros(len(at), np.int32), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), keep)


def _negatives(batches, block: dict, n: int, low: int, high: int):
    """Of a task's rows, the best of other labels in each positive's window."""
    per = block["p_score"].shape[1]
    held = {a: _Best(min(_ANCHORS_AT_ONCE, len(block["row"]) - a) * per, n) for a in range(0, len(block["row"]), _ANCHORS_AT_ONCE)}
    for rows in _chunks(batches):
        label, ids, planes = _numbers(rows.column("label")), _numbers(rows.column("id")), _joined(rows)
        for a, keep in held.items():
            z = min(a + _ANCHORS_AT_ONCE, len(block["row"]))
            # in integers: low * p <= 100 * s <= high * p, for the positives that there are
            floor, top = -(-low * block["p_score"][a:z] // 100), high * block["p_score"][a:z] // 100
            floor = np.where(block["p_there"][a:z], floor, _NO_ID)
            top = np.where(block["p_there"][a:z], top, -_NO_ID)
            for at, s in scores(planes, block["v"][a:z]):
                least = np.maximum(floor, keep.cut.reshape(z - a, per)).min(axis=1)
                c, k = np.nonzero((s >= least[None, :]) & (s <= top.max(axis=1)[None, :]))
                other = label[at + c] != block["label"][a + k]
                c, k = c[other], k[other]
                score = s[c, k].astype(np.int64)
                for j in range(per):
                    within = (score >= floor[k, j]) & (score <= top[k, j])
                    keep.add(k[within] * per + j, score[within], ids[at + c[within]])
    for a, keep in held.items():
        at, j = a + keep.place // per, keep.place % per
        yield _rows(block, at, j.astype(np.int32), block["p_id"][at, j], block["p_score"][at, j], keep)


def _rows(block, at, slot, positive, positive_score, keep: _Best) -> pa.RecordBatch:
    def ids(x):
        return pa.array(x, pa.int64(), mask=x == _NO_ID)

    cols = [pa.array(block["row"][at]), pa.array(slot), ids(block["id"][at]), ids(positive), pa.array(positive_score), ids(keep.id), pa.array(keep.score)]
    return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


# ------------------------------------------------------------------------ Spark

def packed(df: DataFrame, scale: float) -> DataFrame:
    """id, label, anchor, groups, width, planes of the rows of (id, label, anchor, vector) that take part."""

    def rows(batches):
        for b in batches:
            ids, labels, anchors, vectors = b.columns
            vectors = vectors.cast(pa.large_list(pa.float64()))
            there = pc.and_(labels.is_valid(), vectors.is_valid()).to_numpy(zero_copy_only=False)
            size = np.where(there, pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), -1)
            for dims in np.unique(size[size >= 0]):
                at = np.flatnonzero(size == dims)
                for i in range(0, len(at), max(1, (1 << 20) // max(int(dims), 1))):
                    some = at[i : i + max(1, (1 << 20) // max(int(dims), 1))]
                    x = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), int(dims))
                    fit = np.isfinite(x).all(axis=1)  # a null component reads as NaN
                    some, planes = some[fit], pack(quantise(x[fit], scale, int(dims)))
                    _, width, groups = planes.shape
                    shape = [pa.array(np.full(len(some), k, np.int32)) for k in (groups, width)]
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pa.array(some)) for c in (ids, labels, anchors)), *shape, pa.array([p.tobytes() for p in planes], pa.binary())],
                        names=["id", "label", "anchor", "groups", "width", "planes"],
                    )

    return df.mapInArrow(rows, _PACKED)


def _block(rows: pa.Table) -> dict:
    """Arrays of a block of anchors, by label."""
    rows = rows.sort_by([("label", "ascending"), ("row", "ascending")])
    planes = _joined(rows)
    v = unpack(planes.transpose(2, 0, 1)) if planes.shape[1] else np.zeros((rows.num_rows, 0), np.int64)
    return {"row": _numbers(rows.column("row")), "id": _numbers(rows.column("id")), "label": _numbers(rows.column("label")), "v": v}


def _ranked(found: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of what the tasks found for each (anchor, slot); Spark prunes to ``n`` in each task."""
    best = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    anchors_a_pass: int = ANCHORS_A_PASS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: which rows are anchors; labels and ids are integers. An anchor's positives
    are its best ``positives`` other rows of its label; its negatives for each are the best
    ``negatives`` rows of other labels whose score is between ``window`` percent of the positive's.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.coalesce(anchor, F.lit(False)), F.col(vector_col))
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    # dealt evenly and numbered once; every pass reads them again
    kept = packed(rows, scale).repartition(parts).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    anchors = kept.where("anchor")
    blocks = max(1, -(-anchors.count() // anchors_a_pass))
    number = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = [_mined(kept, anchors.where(number == b), positives, negatives, *window) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _mined(kept: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of one block of anchors, a bounded table."""
    spark = kept.sparkSession
    block = _block(anchors.select("row", "id", "label", "groups", "width", "planes").toArrow())
    sent = spark.sparkContext.broadcast(block)
    columns = kept.select("id", "label", "row", "groups", "width", "planes")
    best = _ranked(columns.mapInArrow(lambda b: _positives(b, sent.value, positives), _BEST), positives)
    best = best.select("anchor_row", "rank", "id", "score").toArrow()  # at most ``positives`` a row of the block
    sent.unpersist()

    order = np.argsort(block["row"])
    at = order[np.searchsorted(block["row"], _numbers(best.column("anchor_row")), sorter=order)]
    rank = _numbers(best.column("rank")) - 1
    shape = (len(block["row"]), positives)
    block |= {"p_id": np.full(shape, _NO_ID), "p_score": np.zeros(shape, np.int64), "p_there": np.zeros(shape, bool)}
    block["p_id"][at, rank], block["p_score"][at, rank], block["p_there"][at, rank] = _numbers(best.column("id")), _numbers(best.column("score")), True
    whole = spark.sparkContext.broadcast(block)
    found = columns.mapInArrow(lambda b: _negatives(b, whole.value, negatives, low, high), _BEST)
    return _ranked(found, negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
