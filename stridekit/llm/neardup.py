"""Near-duplicate classes by a MinHash LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of distinct word shingles (hashed to 64 bits), a
   128-bit digest of the set, a signature of ``TREES x DEPTH`` min-hashes and a
   128-bit sketch (one bit of each of the first 128 min-hashes).
2. Texts with equal sets form one node, so groups of copies cost one row.
3. LSH forest: each tree orders all nodes by its own sequence of min-hashes (a
   range shuffle and a sort; a dense region is split like any other, since the
   node id is part of the order). Candidates are a node's ``WINDOW`` predecessors
   with a common prefix of at least ``MIN_DEPTH``: where few nodes share the
   prefix these are all of them, in dense regions they are those with the longest
   common prefix, so the depth adapts to the region. Partition edges are seamed.
4. A candidate goes on if its sketches agree like sets of that similarity could
   (4.75 standard deviations of room) and its set sizes allow the threshold.
5. Candidates are confirmed on the full sets: first each node's nearest
   neighbours, then those of the rest whose ends are still in different
   components. Components come from alternating star rounds.
6. The window alone would be a cap on a text's partners. So the members of every
   region (nodes with one prefix of ``MIN_DEPTH`` in one tree) that is longer than
   the window, and not yet all in one component, are compared with each other,
   in cells of two blocks of at most ``REGION_BLOCK`` members and about ``REGION_BYTES``
   of sets. A cell holds its members' sets: pairs of different components that 256 more
   min-hashes allow (4.75 standard deviations of room again) are confirmed there, each in the
   first tree that has them together, and components that a link joins are one from then on.
   So a cell returns fewer links than it has members; pairs are never rows.

Two sets of similarity s meet in a tree of depth d with chance s^d. At 0.75
and depth 2 all 24 trees miss with chance 2e-9, at depth 4 with 1e-4.
Hashes of 64 bits stand for shingles.

Edge cases: null, empty and wordless texts have the empty set and are linked
with nothing; fewer than five words are one shingle; rows with one doc_id are
rows of their own, linked like others; a null doc_id takes part, but never
names a class that has another (its class is null if all ids are null); an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .components import connected_components, fewer
from .textblocks import NON_SPACE, blocks, bounded_batches, find, fresh, grams, mix, settled, text_buffer, words

SHINGLE = 5
THRESHOLD_PERCENT = 75
TREES = 24
DEPTH = 8
MIN_DEPTH = 2
WINDOW = 8
SKETCH_BITS = 128
NEAREST = 1
REGION_BLOCK = 2000
REGION_BYTES = 8 << 20
REGION_HASHES = 256  # one byte of each travels
MAX_BROADCAST_NODES = 500_000


def _functions(n: int) -> np.ndarray:
    """n odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(col: pa.Array, k: int = SHINGLE) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, by blocks of texts."""
    buf, offs = text_buffer(col)
    for i0, i1 in blocks(offs, 1 << 20):
        h, bounds = words(buf[offs[i0] : offs[i1]], offs[i0 : i1 + 1] - offs[i0], NON_SPACE)
        out = []
        for i in range(i1 - i0):
            w = h[bounds[i] : bounds[i + 1]]
            out.append(np.unique(grams(w, min(k, len(w)))) if len(w) else np.zeros(0, np.uint64))
        yield out


def _digest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums of each set."""
    sizes = np.array([len(s) for s in sets])
    g = np.zeros((2, len(sets)), np.uint64)
    if full := np.flatnonzero(sizes).tolist():
        x = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        g[0, full] = np.add.reduceat(mix(x), starts)
        g[1, full] = np.add.reduceat(mix(x ^ np.uint64(0xD6E8FEB86659FD93)), starts)
    return g[0], g[1]


def _signatures(sets: list[np.ndarray], mult: np.ndarray) -> np.ndarray:
    """Min-hash values (64 bits), one row a set (zeros for the empty set)."""
    sig = np.zeros((len(sets), len(mult)), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for j, m in enumerate(mult):
            sig[full, j] = np.minimum.reduceat(x * m, starts)
    return sig


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n, g1, g2 (set digest), labels (the forest keys of all trees), s1, s2 (sketch) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _functions(TREES * DEPTH)
        weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            at, ids = 0, batch.column("doc_id")
            for sets in shingle_sets(batch.column("text"), shingle):
                sig = mix(_signatures(sets, mult))
                labels = _forest_keys(sig)
                bits = sig[:, :SKETCH_BITS] & np.uint64(1)
                g1, g2 = _digest(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(g1.view(np.int64)),
                        pa.array(g2.view(np.int64)),
                        pa.array([r.tobytes() for r in labels], pa.binary()),
                        pa.array((bits[:, :64] * weight).sum(axis=1, dtype=np.uint64).view(np.int64)),
                        pa.array((bits[:, 64:] * weight).sum(axis=1, dtype=np.uint64).view(np.int64)),
                    ],
                    names=["doc_id", "n", "g1", "g2", "labels", "s1", "s2"],
                )
                at += len(sets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(settled(scan), f"doc_id {kind}, n long, g1 long, g2 long, labels binary, s1 long, s2 long")


def _forest_keys(sig: np.ndarray) -> np.ndarray:
    """Three 64-bit columns for each text and tree: the prefix of MIN_DEPTH values, then the deeper values in order, 21 bits each."""
    lab = (sig >> np.uint64(32)).reshape(len(sig), TREES, DEPTH)
    tree = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mix((lab[:, :, 0] << np.uint64(32) | lab[:, :, 1]) ^ mix(tree)[None, :])
    lab = lab >> np.uint64(11)
    deep = [lab[:, :, d] << np.uint64(42) | lab[:, :, d + 1] << np.uint64(21) | lab[:, :, d + 2] for d in (2, 5)]
    return np.stack([key, *deep], axis=2)


_ROW = ["key", "r1", "r2", "nid", "n", "s1", "s2"]


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node and tree."""
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        keys = np.frombuffer(b"".join(batch.column("labels").to_pylist()), np.int64).reshape(m * TREES, 3)
        same = [np.repeat(batch.column(c).to_numpy(), TREES) for c in ("nid", "n", "s1", "s2")]
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, c]) for c in range(3)] + [pa.array(x) for x in same], names=_ROW)


def _least_agreement(percent: int) -> int:
    """Sketch bits that sets of the threshold's similarity agree on, less 4.75 standard deviations."""
    p = (1 + percent / 100) / 2
    return int(SKETCH_BITS * p - 4.75 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def _neighbours(rows: np.ndarray, new: int, percent: int, part: np.ndarray | None = None) -> np.ndarray:
    """Candidate pairs (smaller id, larger id, gap) of sorted ``rows`` whose later end is at ``new`` or behind."""
    key, nid, n, s1, s2 = (rows[:, c] for c in (0, 3, 4, 5, 6))
    most, out = SKETCH_BITS - _least_agreement(percent), []
    for gap in range(1, min(WINDOW, len(rows) - 1) + 1):
        j = np.arange(max(new, gap), len(rows))
        j = j[key[j] == key[j - gap]]
        if not len(j):
            break
        i = j - gap
        differ = np.bitwise_count((s1[i] ^ s1[j]).view(np.uint64)).astype(int) + np.bitwise_count((s2[i] ^ s2[j]).view(np.uint64))
        lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (differ <= most) & (100 * lo >= percent * hi) & (nid[i] != nid[j])
        if part is not None:
            ok &= part[i] != part[j]
        i, j = i[ok], j[ok]
        out.append(np.stack([np.minimum(nid[i], nid[j]), np.maximum(nid[i], nid[j]), np.full(len(i), gap)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


_SCAN = "a long, b long, gap long, part int, pos long, last boolean, row array<long>, key long, nid long, n long"


class _Runs:
    """key, nid, n of a sorted partition's rows in runs of one key that are longer than the window or reach the partition's edge."""

    def __init__(self):
        self.held, self.key, self.sent = np.zeros((0, 3), np.int64), None, True

    def add(self, rows: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.held, rows])
        starts = np.concatenate([[0], np.flatnonzero(np.diff(x[:, 0])) + 1])
        sizes = np.diff(np.concatenate([starts, [len(x)]]))
        go = sizes > WINDOW + 1
        go[0] |= self.sent and (self.key is None or x[0, 0] == self.key)
        self.key, self.sent = x[-1, 0], bool(go[-1])
        self.held = x[len(x) if self.sent else starts[-1] :]
        return x[np.repeat(go, sizes)]


def _scan(percent: int):
    """Pairs within a sorted partition, its first and last WINDOW rows for the seams, and the members of its runs that the window does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail = np.zeros((0, len(_ROW)), np.int64)
        first, seen, runs = tail, 0, _Runs()

        def members(x: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(x), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*none, *(pa.array(x[:, c]) for c in range(3))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in _ROW], axis=1)
            if len(first) < WINDOW:
                first = np.concatenate([first, rows[: WINDOW - len(first)]])
            seen += len(rows)
            if len(x := runs.add(rows[:, [0, 3, 4]])):
                yield members(x)
            rows = np.concatenate([tail, rows])
            pairs = _neighbours(rows, len(tail), percent)
            tail = rows[-WINDOW:]
            if len(pairs):
                m = len(pairs)
                none = [pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, c]) for c in range(3)] + none, names=names)
        if len(runs.held):
            yield members(runs.held)
        small = seen <= 2 * WINDOW  # all its rows are in `first` and `tail`
        edge = [(k, False, r) for k, r in enumerate(first)] + [(seen - len(tail) + k, True, r) for k, r in enumerate(tail)]
        if edge:
            m = len(edge)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(m, pa.int64())] * 3, pa.array([part] * m, pa.int32()), pa.array([e[0] for e in edge], pa.int64()),
                 pa.array([None if small else e[1] for e in edge], pa.bool_()), pa.array([e[2].tolist() for e in edge], pa.list_(pa.int64())), *[pa.nulls(m, pa.int64())] * 3],
                names=names,
            )

    names = [c.split()[0] for c in _SCAN.split(", ")]
    return run


def _seams(edge: DataFrame, percent: int) -> DataFrame:
    """Pairs across partitions. Seam k: the end of the k-th large partition, all small ones behind it, the start of the next large one."""
    parts = edge.groupBy("part").agg(F.max(F.col("last").isNotNull().cast("int")).alias("large"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    order = parts.withColumn("k", F.coalesce(F.sum("large").over(before), F.lit(0)))  # one row for each partition
    rows = edge.join(order, "part").withColumn("seam", F.col("k") + F.when(F.col("last"), 1).otherwise(0))
    rows = rows.dropDuplicates(["part", "pos", "seam"])

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "pos"])
        x = np.array(pdf["row"].tolist(), dtype=np.int64).reshape(len(pdf), len(_ROW))
        return pd.DataFrame(_neighbours(x, 0, percent, pdf["part"].to_numpy()), columns=["a", "b", "gap"])

    return rows.select("seam", "part", "pos", "row").groupBy("seam").applyInPandas(pair, "a long, b long, gap long")


def candidates(nodes: DataFrame, percent: int = THRESHOLD_PERCENT) -> tuple[DataFrame, DataFrame]:
    """a, b, gap (distance in the nearest order) of the window's candidate pairs; key, nid, m, size (of all its sets) of the members of each region of m > WINDOW + 1 nodes."""
    rows = nodes.select("nid", "n", "labels", "s1", "s2").mapInArrow(
        settled(_forest_rows), "key long, r1 long, r2 long, nid long, n long, s1 long, s2 long"
    )
    order = ["key", "r1", "r2", "nid"]
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(settled(_scan(percent)), _SCAN).checkpoint()
    pairs = found.where("a IS NOT NULL").select("a", "b", "gap").unionByName(_seams(found.where("part IS NOT NULL"), percent))
    members = found.where("nid IS NOT NULL").select("key", "nid", "n")
    dense = members.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("size")).where(F.col("m") > WINDOW + 1)
    return pairs.groupBy("a", "b").agg(F.min("gap").alias("gap")), members.drop("n").join(dense, "key")


def _sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """nid, items (sorted distinct shingle hashes) of the nodes in ``ids``."""
    wanted = nodes.join(ids, "nid", "left_semi").select("nid", "g1", "g2", F.col("doc").alias("doc_id")).checkpoint()
    named = wanted.where("doc_id IS NOT NULL")
    if named.count() <= MAX_BROADCAST_NODES:  # four numbers a row; else the texts are shuffled to them
        named = F.broadcast(named)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column("text"), shingle):
                g1, g2 = (g.view(np.int64) for g in _digest(sets))
                # of several rows with one doc_id, those whose set is the node's
                k1, k2 = (batch.column(c).slice(at, len(sets)).to_numpy() for c in ("g1", "g2"))
                ok = np.flatnonzero((g1 == k1) & (g2 == k2)).tolist()
                offs = np.concatenate([[0], np.cumsum([len(sets[i]) for i in ok])]).astype(np.int32)
                flat = np.concatenate([sets[i] for i in ok]).view(np.int64) if ok else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("nid").slice(at, len(sets)).take(pa.array(ok, pa.int64())), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                    names=["nid", "items"],
                )
                at += len(sets)

    def all_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in shingle_sets(batch.column("text"), shingle):
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                g1, g2 = _digest(sets)
                items = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(g1.view(np.int64)), pa.array(g2.view(np.int64)), items], names=["g1", "g2", "items"])

    texts = docs.join(named, "doc_id").select("nid", "g1", "g2", "text")
    found = texts.mapInArrow(settled(scan), "nid long, items array<long>")
    # rows without an id are found by their set's digest
    others = docs.where("doc_id IS NULL").select("text").mapInArrow(settled(all_sets), "g1 long, g2 long, items array<long>")
    others = others.join(wanted.where("doc_id IS NULL").select("nid", "g1", "g2"), ["g1", "g2"]).select("nid", "items")
    return found.unionByName(others).dropDuplicates(["nid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("nid").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("nid").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nid, items, print (a byte of each of REGION_HASHES min-hashes), keys (the node's region in each tree) of sets with their forest labels."""
    mult = _functions(TREES * DEPTH + REGION_HASHES)[TREES * DEPTH :]
    for batch in batches:
        flat, offs = batch.column("items").flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(batch.column("items").value_lengths().to_numpy())])
        for i0, i1 in blocks(offs, 1 << 20):
            sets = [flat[offs[i] : offs[i + 1]] for i in range(i0, i1)]
            sig = (mix(_signatures(sets, mult)) >> np.uint64(56)).astype(np.uint8)
            keys = np.frombuffer(b"".join(batch.column("labels").slice(i0, i1 - i0).to_pylist()), np.int64).reshape(i1 - i0, TREES, 3)[:, :, 0].astype(np.int32)  # the low half: they only tell which tree comes first
            some = [batch.column(c).slice(i0, i1 - i0) for c in ("nid", "items")]
            yield pa.RecordBatch.from_arrays(
                [*some, pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary())], names=["nid", "items", "print", "keys"]
            )


def _cell(percent: int):
    """Links that join components within a cell: pairs of its two blocks (or within one) that the prints allow, confirmed on the full sets."""
    p = percent / 100 + (1 - percent / 100) / 256
    least = int(REGION_HASHES * p - 4.75 * (REGION_HASHES * p * (1 - p)) ** 0.5)

    def run(cell: pa.Table) -> pa.Table:
        nid, part, block, i = (cell.column(c).to_numpy() for c in ("nid", "root", "block", "i"))
        part = np.unique(part, return_inverse=True)[1]  # components, joined as links are found
        sig = np.frombuffer(b"".join(cell.column("print").to_pylist()), np.uint8).reshape(len(nid), REGION_HASHES)
        keys = np.frombuffer(b"".join(cell.column("keys").to_pylist()), np.int32).reshape(len(nid), TREES)
        tree = int(np.argmax(keys[0] == np.array(cell.column("key")[0].as_py()).astype(np.int32)))
        items = cell.column("items").combine_chunks()
        flat, n = items.flatten().to_numpy().view(np.uint64), items.value_lengths().to_numpy().astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(n)])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block != i)
        within = cell.column("k")[0].as_py() == i[0]
        right = left if within else right
        cols, links = np.ascontiguousarray(sig[right].T), []
        for at in range(0, len(left) if len(right) else 0, 128):
            rows = left[at : at + 128]
            alike = np.zeros((len(rows), len(right)), np.uint16)
            for c in range(REGION_HASHES):
                alike += sig[rows, c][:, None] == cols[c]
            ok = (alike >= least) & (part[rows][:, None] != part[right])
            ok &= 100 * np.minimum(n[rows][:, None], n[right]) >= percent * np.maximum(n[rows][:, None], n[right])
            for r in np.flatnonzero(ok.any(axis=1)):
                a, b = rows[r], right[ok[r]]
                b = b[(part[b] != part[a]) & ((b > a) if within else True)]
                b = b[~(keys[b, :tree] == keys[a, :tree]).any(axis=1)]  # met in an earlier tree
                x = flat[offs[a] : offs[a + 1]]
                for b0, b1 in blocks(np.concatenate([[0], np.cumsum(n[b])]), 1 << 20):
                    some = b[b0:b1]
                    _, hit = find(x, np.concatenate([flat[offs[j] : offs[j + 1]] for j in some]))
                    both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(n[some])[:-1]]))
                    for j in some[100 * both >= percent * (len(x) + n[some] - both)]:
                        if part[j] != part[a]:
                            part[part == part[j]] = part[a]
                            links.append((nid[a], nid[j]))
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _region_links(docs: DataFrame, nodes: DataFrame, members: DataFrame, links: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``links`` and those within the dense regions (``members``: key, nid, m, size) that they do not imply."""
    comp = connected_components(links).withColumnRenamed("node", "nid")
    rows = members.join(comp, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    apart = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rows = fewer(rows.join(apart, "key").checkpoint())
    if not rows.take(1):
        return links
    sets = _sets(docs, nodes, rows.select("nid").distinct(), shingle)  # of these regions only
    held = sets.join(nodes.select("nid", "labels"), "nid").mapInArrow(settled(_prints), "nid long, items array<long>, print binary, keys binary").checkpoint()
    count = F.greatest(F.ceil(F.col("m") / REGION_BLOCK), F.ceil(8 * F.col("size") / REGION_BYTES)).cast("long")
    rows = rows.select("key", "nid", "root", count.alias("count"), F.pmod(F.xxhash64("nid", "key"), count).alias("block"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).join(held, "nid")
    cells = rows.select("key", F.least("block", "j").alias("i"), F.greatest("block", "j").alias("k"), "nid", "root", "block", "items", "print", "keys")
    found = cells.groupBy("key", "i", "k").applyInArrow(_cell(percent), "a long, b long").distinct()
    return links.unionByName(fewer(found.checkpoint()))


def _classes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures; g1, g2, n, doc (smallest doc_id) of every node, its class's smallest doc_id, and whether it is the class's node with that."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    base = signatures(docs, shingle).checkpoint()
    nodes = (
        base.where("n > 0").groupBy("g1", "g2", "n")
        .agg(F.min("doc_id").alias("doc"), F.first("labels").alias("labels"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
        .withColumn("nid", F.xxhash64("g1", "g2", "n"))
        .checkpoint()
    )
    pairs, members = candidates(nodes, percent)
    pairs, members = fewer(pairs.checkpoint()), fewer(members.checkpoint())
    ends = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    sets = _sets(docs, nodes, ends, shingle).checkpoint()
    links = fewer(_confirmed(pairs.where(F.col("gap") <= NEAREST), sets, percent).checkpoint())
    comp = connected_components(links)
    root = lambda end: comp.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    rest = pairs.where(F.col("gap") > NEAREST).join(root("a"), "a", "left").join(root("b"), "b", "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = links.unionByName(fewer(_confirmed(rest, sets, percent).checkpoint()))  # read several times
    links = _region_links(docs, nodes, members, links, shingle, percent)
    comp = connected_components(links)
    linked = nodes.select("nid", "g1", "g2", "n", "doc").join(comp.withColumnRenamed("node", "nid"), "nid")
    least = linked.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "nid")).alias("low"))
    linked = linked.join(least, "root").select("nid", F.col("low.doc").alias("low"), (F.col("low.nid") == F.col("nid")).alias("first"), F.lit(True).alias("linked"))
    named = nodes.select("nid", "g1", "g2", "n", "doc").join(linked, "nid", "left")
    low = F.when(F.col("linked"), F.col("low")).otherwise(F.col("doc"))
    return base, named.select("g1", "g2", "n", "doc", low.alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    base, classes = _classes(docs, shingle, percent)
    named = classes.select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), F.col("n").alias("kn"), F.col("component_id").alias("root"))
    out = base.select("doc_id", "n", "g1", "g2").join(named, (F.col("g1") == F.col("k1")) & (F.col("g2") == F.col("k2")) & (F.col("n") == F.col("kn")), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row of each near-duplicate class, and all rows with an empty set: the row of the class's smallest doc_id (one without a doc_id only if the class has no other).

    Rows are told apart by doc_id and set digest; of rows that are alike in both, one stays.
    """
    _, classes = _classes(docs, shingle, percent)
    g1, g2, n, none, name, hit = key = [fresh(docs, f"_{c}") for c in ("g1", "g2", "n", "none", "name", "hit")]
    columns = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column("text"), shingle):
                part = batch.slice(at, len(sets))
                digests = [pa.array(g.view(np.int64)) for g in _digest(sets)]
                yield pa.RecordBatch.from_arrays([*part.columns, *digests, pa.array([len(x) for x in sets], pa.int64())], names=[*columns, g1, g2, n])
                at += len(sets)

    fields = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in (g1, g2, n))])
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    rows = docs.mapInArrow(settled(scan), fields).withColumns({none: F.col("doc_id").isNull(), name: F.coalesce("doc_id", zero)})
    # a row with an empty set is alike to no other
    rows = rows.withColumn(g2, F.when(F.col(n) == 0, F.monotonically_increasing_id()).otherwise(F.col(g2))).dropDuplicates(key[:5])
    kept = classes.where("first").select(
        F.col("g1").alias(g1), F.col("g2").alias(g2), F.col("n").alias(n), F.col("doc").isNull().alias(none), F.coalesce("doc", zero).alias(name), F.lit(True).alias(hit)
    )
    return rows.join(kept, key[:5], "left").where((F.col(n) == 0) | F.col(hit)).select(*columns)
