"""Prefix trie of conversations by sorted matrices of turn ids.

Turns are numbered by 128 bits of hash of (role, text); texts travel no further. A
conversation is cut into segments of at most ``WIDTH`` turns. A segment knows the key of all
turns before it (a sum of 128-bit hashes of (turn, depth)), so the
segments of one key are rows of one subtree and a conversation of any length is many bounded rows.
Segments are range-sharded by (key, turn ids, conv_id): equal sequences stand together
and a hot one is cut by conv_id.

In a shard, turn ids become ranks in a matrix padded with 0, ``np.lexsort`` orders the
rows, and OR-accumulated column change masks mark where the nodes of every depth start;
``reduceat`` over those starts gives each node's aggregates. A node that spans shards
appears once in each, and a group-by of the node's key recombines what is additive.

Two such passes run. The first finds every node's number of members and its smallest
member, its owner. A conversation owns a suffix of its path, from depth o on. Everything
about subtrees is then a sum over members, so no walk over the tree is needed:
leaves (whether a member owns a leaf), children (members with o = depth + 1, and the
owner if it goes on), and saved tokens: with W the words of a member and Q those of its
nodes, the sum of W - Q over members with o > depth, less (members - 1) times the words before the node.

The digest of a node's enders is made where they are all in one shard. Enders that
go on in a neighbour shard become pieces of text, which one task for each node streams in order
through the hash: memory is one piece, whatever the number of members.

Edge cases: turns are ordered by turn (null first), then by the hash of (role, text);
repeated rows are turns of their own. A null role or text is empty. Rows without a
conv_id belong to no conversation and take no part. ``c - c % 20`` and the like are up to the caller
(``rebuilt``). An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import row_numbers, running_aggregates
from ..session import ensure_checkpoint_dir
from .textblocks import bounded_batches
from .textblocks import mix as mixed

WIDTH = 32
ROWS_A_SHARD = 50_000
IDS_A_PIECE = 4_096
_WORD = r"[^\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANES = ("ah", "al", "bh", "bl")  # the halves of the key's two 64-bit sums: their totals stay within a long


# ------------------------------------------------------------------ in a shard

def _lists(rows: pa.Table, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths and matrices (padded with 0) of list columns of equal lengths."""
    out, size = [], None
    for name in names:
        col = rows.column(name).combine_chunks()
        flat = col.flatten().to_numpy().astype(np.int64)
        size = np.diff(col.offsets.to_numpy())
        m = np.zeros((len(size), int(size.max(initial=0))), np.int64)
        m[np.arange(m.shape[1])[None, :] < size[:, None]] = flat
        out.append(m)
    return size, out


def turn_hashes(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of (turn, depth); a path's key is their sum over its turns, modulo 2^64."""
    at = depth.astype(np.uint64) * _STEP
    return mixed(a.view(np.uint64) + at), mixed(b.view(np.uint64) ^ mixed(at + np.uint64(1)))


class Shard:
    """The sorted rows of one shard, the keys along every row, and where the nodes of every depth start."""

    def __init__(self, rows: pa.Table):
        size, (a, b, w) = _lists(rows, "a", "b", "w")
        conv, level = rows.column("conv_id").to_numpy(), rows.column("level").to_numpy()
        ka, kb = rows.column("ka").to_numpy(), rows.column("kb").to_numpy()
        there = np.arange(a.shape[1])[None, :] < size[:, None]
        # ranks in the order of the range partitions; 0 is the padding
        pairs = np.stack([a[there], b[there]], 1)
        m = np.zeros(a.shape, np.int64)
        m[there] = np.unique(pairs, axis=0, return_inverse=True)[1].reshape(-1) + 1 if len(pairs) else 0
        order = np.lexsort((conv, *m.T[::-1], kb, ka))
        self.order, self.size, self.conv, self.level = order, size[order], conv[order], level[order]
        self.m, self.w = m[order], w[order]
        self.width = m.shape[1]
        start = self.level[:, None] * WIDTH + np.arange(self.width)[None, :]
        ha, hb = turn_hashes(a[order], b[order], start)
        ha, hb = np.where(there[order], ha, 0).astype(np.uint64), np.where(there[order], hb, 0).astype(np.uint64)
        first = [k[order].view(np.uint64)[:, None] for k in (ka, kb)]
        self.ka, self.kb = (np.cumsum(np.concatenate([f, h], 1), axis=1, dtype=np.uint64).view(np.int64) for f, h in zip(first, (ha, hb)))
        self.before = rows.column("before").to_numpy()[order][:, None] + np.cumsum(np.concatenate([np.zeros((len(order), 1), np.int64), self.w], 1), axis=1)
        new = np.ones(len(order), bool)
        new[1:] = (self.ka[1:, 0] != self.ka[:-1, 0]) | (self.kb[1:, 0] != self.kb[:-1, 0])
        self.starts = [new]
        for j in range(self.width):
            change = np.ones(len(order), bool)
            change[1:] = self.m[1:, j] != self.m[:-1, j]
            self.starts.append(self.starts[-1] | change)

    def depths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(turns into the segment, rows that go that far, where among them its nodes start); at 0 the root, from first segments."""
        for j in range(self.width + 1):
            rows = np.flatnonzero(self.size >= j if j else self.level == 0)
            if len(rows):
                starts = np.flatnonzero(self.starts[j][rows])
                yield j, rows, starts if len(starts) and starts[0] == 0 else np.r_[0, starts]

    def ends(self) -> Iterator[tuple[int, int, bool]]:
        """Runs [first, past the last) of rows that end at one node, and whether the run touches an end of the shard."""
        n = len(self.size)
        at = np.flatnonzero(self.size < WIDTH)  # a full segment goes on in the next one
        if not len(at):
            return
        own = np.array([self.starts[s][i] for i, s in zip(at, self.size[at])])  # the first row of its node
        # rows that end at a node are the first of it, in order of conv_id
        same = np.zeros(len(at), bool)
        same[1:] = (np.diff(at) == 1) & ~own[1:] & (np.diff(self.size[at]) == 0)
        first = np.flatnonzero(~same)
        for k, z in zip(first, np.r_[first[1:], len(at)]):
            yield int(at[k]), int(at[z - 1]) + 1, at[k] == 0 or at[z - 1] == n - 1


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _owners(batches):
    """Node key, depth, words of the last text, members, enders and smallest member, for every node of a shard."""
    rows = _table(batches)
    if rows is None:
        return
    s = Shard(rows)
    for j, at, starts in s.depths():
        top = at[starts]
        n = np.diff(np.r_[starts, len(at)])
        ends = np.add.reduceat((s.size[at] == j).astype(np.int64) if j < WIDTH else np.zeros(len(at), np.int64), starts)
        yield pa.RecordBatch.from_pydict({
            "ka": s.ka[top, j], "kb": s.kb[top, j], "depth": s.level[top] * WIDTH + j, "words": s.w[top, j - 1] if j else np.zeros(len(top), np.int64),
            "n": n, "ends": ends, "owner": np.minimum.reduceat(s.conv[at], starts),
        })
    # a full segment's node has its enders in the next, empty segment
    at = np.flatnonzero((s.size == 0) & (s.level > 0))
    if len(at):
        new = np.flatnonzero(s.starts[0][at])
        new = new if len(new) and new[0] == 0 else np.r_[0, new]
        top, none = at[new], np.zeros(len(new), np.int64)
        yield pa.RecordBatch.from_pydict({
            "ka": s.ka[top, 0], "kb": s.kb[top, 0], "depth": s.level[top] * WIDTH, "words": none, "n": none,
            "ends": np.diff(np.r_[new, len(at)]), "owner": np.minimum.reduceat(s.conv[at], new),
        })


_OWNERS = "ka long, kb long, depth long, words long, n long, ends long, owner long"
_NODES = ("ka long, kb long, depth long, pa long, pb long, n long, owner long, before long, extra long, leaves long, children long, "
          "ends string, piece_at long, piece string")
_NODE_SCHEMA = pa.schema([(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in _NODES.split(", ")])


def _nodes(batches):
    """The additive aggregates of every node of a shard, and digests or pieces of the enders."""
    rows = _table(batches)
    if rows is None:
        return
    s = Shard(rows)
    o, extra, leaf, turns = (rows.column(c).to_numpy()[s.order] for c in ("o", "extra", "leaf", "turns"))

    def batch(**cols):
        n = len(cols["ka"])
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _NODE_SCHEMA], schema=_NODE_SCHEMA)

    for j, at, starts in s.depths():
        top = at[starts]
        depth = s.level[at] * WIDTH + j
        total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
        cols = {"ka": s.ka[top, j], "kb": s.kb[top, j], "depth": depth[starts], "n": np.diff(np.r_[starts, len(at)]), "owner": np.minimum.reduceat(s.conv[at], starts)}
        cols |= {"before": s.before[top, j - 1] if j else np.zeros(len(top), np.int64)}
        cols |= {"extra": total(np.where(o[at] > depth, extra[at], 0)), "leaves": total(leaf[at])}
        # a child is owned by the owner itself, if it goes on, or by a member that owns nothing above
        cols |= {"children": total((o[at] == depth + 1) | ((o[at] <= depth) & (turns[at] > depth)))}
        if j:
            cols |= {"pa": s.ka[top, j - 1], "pb": s.kb[top, j - 1]}
        yield batch(**cols)
    keys, digests, pieces, firsts = [], [], [], []
    for lo, hi, cut in s.ends():
        for k in range(lo, hi, IDS_A_PIECE if cut else hi - lo):
            text = ",".join(map(str, s.conv[k : min(hi, k + IDS_A_PIECE) if cut else hi].tolist()))
            keys.append((lo, int(s.size[lo])))
            digests.append(None if cut else hashlib.sha256(text.encode()).hexdigest())
            pieces.append(text if cut else None)
            firsts.append(int(s.conv[k]) if cut else None)
    if keys:
        r, j = np.array(keys).T
        yield batch(ka=s.ka[r, j], kb=s.kb[r, j], ends=digests, piece_at=firsts, piece=pieces)


def _streamed(batches):
    """Digests of pieces that arrive by node and in order: one hash state at a time."""
    node, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"ka": [node[0]], "kb": [node[1]], "ends": [state.hexdigest()]})

    for b in batches:
        for ka, kb, piece in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "piece"))):
            if (ka, kb) != node:
                if node is not None:
                    yield done()
                node, state = (ka, kb), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if node is not None:
        yield done()


# ------------------------------------------------------------------------ Spark

def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place from 0), a, b (hash of role and text), w (words): texts are left behind."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("w"),
    )
    placed = row_numbers(rows, ["conv_id"], ["turn", "a", "b"], "p")
    return placed.select("conv_id", (F.col("p") - 1).cast("long").alias("p"), "a", "b", "w")


def rebuilt(placed: DataFrame, of: Callable[[Column], Column], head: Callable[[Column], Column], most: int) -> DataFrame:
    """Every conversation with its first ``head(id)`` turns (at most ``most``) replaced by those of conversation ``of(id)``.

    Columns as ``turns``, with one row of null turns for every conversation (p = 0, a null).
    """
    conv, turn = F.col("conv_id"), F.struct("p", "a", "b", "w")
    heads = placed.where((F.col("p") < most) & (conv == of(conv))).groupBy(F.col("conv_id").alias("of")).agg(F.sort_array(F.collect_list(turn)).alias("heads"))
    convs = placed.where("p = 0").select("conv_id", of(conv).alias("of"), head(conv).cast("int").alias("h")).join(heads, "of", "left")
    convs = convs.select("conv_id", "h", F.slice(F.coalesce("heads", F.array().cast("array<struct<p:bigint,a:bigint,b:bigint,w:bigint>>")), F.lit(1), F.col("h")).alias("heads")).checkpoint()
    own = placed.where(F.col("p") >= head(conv))
    # a shorter head moves the conversation's own turns forward
    moved = convs.select(F.col("conv_id").alias("_c"), (F.col("h") - F.size("heads")).cast("long").alias("back")).where("back > 0")
    own = own.join(moved, F.col("conv_id") == F.col("_c"), "left").select("conv_id", (F.col("p") - F.coalesce("back", F.lit(0))).alias("p"), "a", "b", "w")
    taken = convs.select("conv_id", F.explode("heads").alias("t")).select("conv_id", "t.*")
    every = convs.select("conv_id", F.lit(0).cast("long").alias("p"), *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "w")])
    return own.unionByName(taken).unionByName(every)


def whole(placed: DataFrame) -> DataFrame:
    """The conversations as they are, in the form of ``rebuilt``."""
    every = placed.where("p = 0").select("conv_id", "p", *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "w")])
    return placed.unionByName(every)


def _segments(rows: DataFrame) -> DataFrame:
    """conv_id, level, a, b, w (lists in order), ka, kb, before (key and words of all turns before), checkpointed.

    A segment that is full is followed by another, if only an empty one: a conversation ends in its one segment that is not full.
    """
    level, real = F.floor(F.col("p") / WIDTH), F.col("a").isNotNull()
    mark = F.struct((level + 1).alias("level"), F.lit(None).cast("struct<p:bigint,a:bigint,b:bigint,w:bigint>").alias("t"))
    here = F.struct(level.alias("level"), F.when(real, F.struct("p", "a", "b", "w")).alias("t"))
    both = F.when(real & ((F.col("p") + 1) % WIDTH == 0), F.array(here, mark)).otherwise(F.array(here))
    dealt = rows.select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.level", "x.t")
    held = dealt.groupBy("conv_id", "level").agg(F.sort_array(F.collect_list("t")).alias("t"))  # collect_list skips the marks
    cut = held.select("conv_id", "level", *[F.col(f"t.{c}").alias(c) for c in ("a", "b", "w")]).checkpoint()

    long = cut.where((F.size("a") == WIDTH) | (F.col("level") > 0))
    fields = "conv_id long, level long, a array<long>, b array<long>, w array<long>, " + ", ".join(f"{x} long" for x in (*_LANES, "words"))

    def lanes(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            size, (a, b, w) = _lists(t, "a", "b", "w")
            start = t.column("level").to_numpy()[:, None] * WIDTH + np.arange(a.shape[1])[None, :]
            there = np.arange(a.shape[1])[None, :] < size[:, None]
            sums = [np.where(there, h, 0).astype(np.uint64).sum(axis=1, dtype=np.uint64) for h in turn_hashes(a, b, start)]
            halves = [half.astype(np.int64) for x in sums for half in (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, halves), pa.array(w.sum(axis=1))], names=[*batch.schema.names, *_LANES, "words"])

    summed = running_aggregates(long.mapInArrow(lanes, fields), ["conv_id"], ["level"], {f"s_{x}": (x, "sum") for x in (*_LANES, "words")})
    sums = [F.col(f"s_{x}") - F.col(x) for x in (*_LANES, "words")]  # without the segment itself

    def key(high: Column, low: Column) -> Column:
        # (high * 2^32 + low) modulo 2^64, from shifts and sums that stay within a long
        carry = F.shiftrightunsigned(low, 32)
        return F.shiftleft(high + carry, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))

    later = summed.select("conv_id", "level", "a", "b", "w", key(*sums[:2]).alias("ka"), key(*sums[2:4]).alias("kb"), sums[4].alias("before"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("ka", "kb", "before")]
    return cut.where((F.size("a") < WIDTH) & (F.col("level") == 0)).select("*", *zero).unionByName(later).checkpoint()


def _sharded(segments: DataFrame, n: int) -> DataFrame:
    """Dealt by the order of (key, turns, conv_id); a hot sequence is cut by conv_id."""
    pairs = F.zip_with("a", "b", lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return segments.repartitionByRange(n, "ka", "kb", pairs, "conv_id")


def trie(rows: DataFrame) -> DataFrame:
    """One row a node of the trie of ``rebuilt`` or ``whole`` rows: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    bounded_batches(spark)
    segments = _segments(rows)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-segments.count() // ROWS_A_SHARD))
    seen = _sharded(segments, shards).mapInArrow(_owners, _OWNERS)
    nodes = seen.groupBy("ka", "kb").agg(F.max("depth").alias("depth"), F.max("words").alias("words"), F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("owner").alias("owner"))
    none = F.lit(0).cast("long")
    owned = nodes.select(F.col("owner").alias("conv_id"), "words", none.alias("all_words"), none.alias("turns"), F.col("depth").alias("o"), (F.col("ends") == F.col("n")).cast("long").alias("leaf"))
    every = segments.select("conv_id", none.alias("words"), F.aggregate("w", none, lambda x, y: x + y).alias("all_words"), F.size("a").cast("long").alias("turns"),
                            F.lit(None).cast("long").alias("o"), none.alias("leaf"))
    never = F.lit((1 << 62)).cast("long")  # a conversation that owns no node: another with a smaller id has all its turns
    about = owned.unionByName(every).groupBy(F.col("conv_id").alias("of")).agg(
        (F.sum("all_words") - F.sum("words")).alias("extra"), F.sum("turns").alias("turns"), F.coalesce(F.min("o"), never).alias("o"), F.max("leaf").alias("leaf")
    )
    known = segments.join(about, F.col("conv_id") == F.col("of")).drop("of")
    parts = _sharded(known, shards).mapInArrow(_nodes, _NODES).checkpoint()
    pieces = parts.where("piece IS NOT NULL").select("ka", "kb", "piece_at", "piece")
    digests = pieces.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "piece_at").mapInArrow(_streamed, "ka long, kb long, ends string")
    empty = hashlib.sha256(b"").hexdigest()
    joined = parts.drop("piece", "piece_at").unionByName(digests, allowMissingColumns=True).groupBy("ka", "kb").agg(
        *[F.max(c).alias(c) for c in ("depth", "pa", "pb", "before")], *[F.sum(c).alias(c) for c in ("n", "extra", "leaves", "children")],
        F.min("owner").alias("conv_id"), F.coalesce(F.max("ends"), F.lit(empty)).alias("ends_sha256"),
    ).checkpoint()
    parents = joined.select(F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    return joined.join(parents, (F.col("pa") == F.col("qa")) & (F.col("pb") == F.col("qb")), "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("extra") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"), "ends_sha256",
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, each beginning with up to three turns of conversation ``c - c % 20`` (crc32 of the id modulo 4)."""
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % 4
    return trie(rebuilt(turns(conversations), lambda c: c - c % 20, head, 3))
