"""Language-model scoring with a weighted backoff automaton.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one
end. Every count covers all training documents; a 64-bit hash stands for a word or an n-gram.

Model: words have the add-one estimate ``(c+1) / (N+V+1)``. Every bigram and trigram of the
training texts is kept (a caller may ask for those of at least ``gram_share`` of the tokens);
a kept n-gram has ``(c-D)/c(history) + backoff(history) * P(lower order)``, and what its history
has left is the history's backoff weight, so all probabilities of a history sum to one.

Automaton: states are the empty history, the words (and the start of a text) and the kept
bigrams; arcs are the kept n-grams; every state has a failure arc to the next shorter history
that carries its backoff weight.

Its counts are nowhere whole. Texts are coded once, in blocks of some ``_BLOCK`` tokens; each block
sends its different n-grams to buckets by hash, which add up all blocks' counts and answer
every block for its own n-grams (``tally``). Trigrams go first, then bigrams with what is left
of them as histories, then words. The first block that has an n-gram speaks for it, so
each counts once for its history. With the answers a block has the states and arcs that its texts can
reach, and takes all positions through them together. Blocks and buckets are bounded; their number
grows with the texts.

Edge cases: a null text counts as empty and has one token, the end; without
training rows N and V are 0 and every token has probability 1; repeated rows are
counted and scored row by row; a null doc_id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import NON_SPACE, blocks, bounded_batches, fresh, give_back, mix, settled, text_buffer, with_crc, without, words

WORD_SHARE = 0.0
GRAM_SHARE = 0.0
DISCOUNT = 0.75
_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_TRIPLE = np.uint64(0xA0761D6478BD642F)
_BYTES = 1 << 21  # of texts that are cut into tokens together
_BLOCK = 4_000_000  # tokens of a block
_BUCKET = 1 << 20  # tokens a bucket
_STEP = 1 << 19  # tokens that walk together
_BLOCKS = "block long, learn binary, sizes binary, words binary, order binary, codes binary"
_ASKED = "level int, bucket long, block long, keys binary, k binary, kinds binary, mass binary"
_ANSWERS = "level int, bucket long, block long, count binary, kinds binary, mass binary, different long"


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start, words and end of every text in one array, and the places of the starts (and the length)."""
    h, bounds = words(buf, offs, NON_SPACE)
    n = len(offs) - 1
    begin = bounds + 2 * np.arange(n + 1)
    out = np.empty(len(h) + 2 * n, np.uint64)
    inner = np.ones(len(out), bool)
    inner[begin[:-1]] = False
    inner[begin[1:] - 1] = False
    out[inner] = h
    out[begin[:-1]] = _START
    out[begin[1:] - 1] = _END
    return out, begin


def _token_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = text_buffer(batch.column("text"))
    for i0, i1 in blocks(offs, _BYTES):
        yield i0, i1, *_tokens(buf[offs[i0] : offs[i1]], offs[i0 : i1 + 1] - offs[i0])


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes: all lowest bytes, then all next ones, as far as any number has them.

    Each of these runs is compressed by itself, if that helps: random low bytes would spoil the code of the high ones.
    """
    x = np.ascontiguousarray(x).astype(np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    out = [len(x).to_bytes(8, "little") + bytes([width])]
    for i in range(width if len(x) else 0):
        raw = x.view(np.uint8)[i::8].tobytes()
        less = pa.compress(raw, codec="zstd", asbytes=True)
        less = less if len(less) < len(raw) else raw
        out += [len(less).to_bytes(4, "little"), less]
    return b"".join(out)


def _unpack(b: bytes) -> np.ndarray:
    n, width, at = int.from_bytes(b[:8], "little"), b[8], 9
    out = np.zeros((n, 8), np.uint8)
    for i in range(width if n else 0):
        end = at + 4 + int.from_bytes(b[at : at + 4], "little")
        raw = b[at + 4 : end]
        out[:, i] = np.frombuffer(raw if len(raw) == n else pa.decompress(raw, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
        at = end
    return out.view(np.uint64).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as the first and the differences."""
    return int(keys[0]).to_bytes(8, "little") + _pack(np.diff(keys))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(b[:8], np.uint64), _unpack(b[8:])]), dtype=np.uint64)


def coded(docs: DataFrame, learn, names: list[str] | None) -> DataFrame:
    """Blocks of whole texts as word codes; ``learn``: column, whether a text counts; ``names``: columns that come along (None: not to be scored)."""
    fields = [] if names is None else [docs.schema[c] for c in names]
    kind = ", ".join(["_: boolean", *(f"_{i}: {f.dataType.simpleString()}" for i, f in enumerate(fields))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list = []

        def flush():
            tokens = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            learned = pa.concat_arrays([h[2] for h in held])
            known, code, times = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small codes, which pack well
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            block = (part << 32) + n
            row = [
                pa.array([block if names is not None else -1 - block]), *(pa.array([x], pa.binary()) for x in (
                    _pack(learned.to_numpy(zero_copy_only=False)), _pack(sizes), _pack_keys(known), _pack(order), _pack(rank[code]))),
            ]
            columns = ["block", "learn", "sizes", "words", "order", "codes"]
            if names is not None:
                struct = pa.StructArray.from_arrays([learned, *(pa.concat_arrays([h[3][i] for h in held]) for i in range(len(names)))], ["_", *(f"_{i}" for i in range(len(names)))])
                row.append(pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), struct))
                columns.append("rows")
            held.clear()
            return pa.RecordBatch.from_arrays(row, names=columns)

        for batch in batches:
            for i0, i1, tokens, begin in _token_blocks(batch):
                held.append((tokens, np.diff(begin), batch.column(1).slice(i0, i1 - i0), [batch.column(2 + i).slice(i0, i1 - i0) for i in range(len(fields))]))
                if sum(len(h[0]) for h in held) >= _BLOCK:
                    yield flush()
                    n += 1
        if held:
            yield flush()

    bounded_batches(docs.sparkSession)
    rows = docs.select("text", learn.alias(fresh(docs, "_learn")), *(names or []))
    return rows.mapInArrow(settled(scan), _BLOCKS + ("" if names is None else f", rows array<struct<{kind}>>"))


def n_tokens(docs: DataFrame, learn) -> tuple[int, int]:
    """The tokens of all texts, and of those that count."""
    n = (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")
    return tuple(docs.select(n.alias("n"), learn.alias("l")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("l"), F.col("n"))), F.lit(0))).first())


class Block:
    """A block's words, bigrams and trigrams (ascending hashes), and for every position which one ends there (-1: none)."""

    def __init__(self, learn: bytes, sizes: bytes, known: bytes, order: bytes, codes: bytes):
        self.sizes = _unpack(sizes).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        words_, code = _unpack_keys(known), _unpack(order).astype(np.int32)[_unpack(codes).view(np.int64)]
        t = words_[code]
        self.real = t != _START
        self.keys, self.at = {1: words_}, {1: code}
        self.learn = np.repeat(_unpack(learn) > 0, self.sizes)
        pair = np.flatnonzero(self.real)  # every text has a start, so a pair ends at each other token
        self.keys[2], self.at[2] = self._kinds(pair, mix(t[pair - 1] * _PAIR + t[pair]))
        triple = pair[self.real[pair - 1]]
        del pair
        self.keys[3], self.at[3] = self._kinds(triple, mix(self.keys[2][self.at[2][triple - 1]] * _TRIPLE + t[triple]))

    def _kinds(self, places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        at = np.full(len(self.real), -1, np.int32)
        at[places[order]] = np.cumsum(new, dtype=np.int32) - 1
        return keys[new], at

    def counts(self, level: int) -> np.ndarray:
        at = self.at[level]
        return np.bincount(at[self.learn & (at >= 0)], minlength=len(self.keys[level]))

    def history(self, level: int) -> np.ndarray:
        """For each n-gram of ``level`` the n-gram before its last word."""
        at, out = self.at[level], np.zeros(len(self.keys[level]), np.int64)
        places = np.flatnonzero(at >= 0)
        out[at[places]] = self.at[level - 1][places - 1]
        return out

    def asked(self, level: int, block: int, buckets: int, kinds: np.ndarray, mass: np.ndarray) -> pa.Table:
        keys, k = self.keys[level], self.counts(level)
        width = (1 << 64) // buckets + 1
        cuts = np.searchsorted(keys, np.array([b * width for b in range(1, buckets)], np.uint64))
        cuts = np.concatenate([[0], cuts, [len(keys)]])
        some = np.flatnonzero(np.diff(cuts))
        cut = lambda x, f: pa.array([f(x[cuts[b] : cuts[b + 1]]) for b in some], pa.binary())
        return pa.table({
            "level": pa.array([level] * len(some), pa.int32()), "bucket": pa.array(some, pa.int64()), "block": pa.array([block] * len(some), pa.int64()),
            "keys": cut(keys, _pack_keys), "k": cut(k, _pack), "kinds": cut(kinds, _pack), "mass": cut(mass, _pack),
        })


def _block(rows: pa.Table) -> tuple[int, Block]:
    (row,) = rows.select(["block", "learn", "sizes", "words", "order", "codes"]).to_pylist()
    return row["block"], Block(row["learn"], row["sizes"], row["words"], row["order"], row["codes"])


def _answered(answers: pa.Table, level: int, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Count, whether this block speaks for it, different followers and their counts of each of a block's n-grams."""
    rows = sorted(answers.filter(pc.equal(answers["level"], level)).to_pylist(), key=lambda r: r["bucket"])
    count, kinds, mass = (np.concatenate([np.zeros(0, np.int64), *(_unpack(r[c]).view(np.int64) for r in rows)]) for c in ("count", "kinds", "mass"))
    if len(count) != len(b.keys[level]):
        raise RuntimeError("a block was read again with other texts: checkpoint the documents before scoring")
    return count >> 1, (count & 1).astype(bool), kinds, mass


def _grouped(f):
    """``f`` of a group, that gives back its memory."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            return f(rows)
        finally:
            give_back()

    return run


def _cogrouped(f):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        try:
            return f(rows, answers)
        finally:
            give_back()

    return run


def tally(asked: DataFrame) -> DataFrame:
    """Per bucket the sums over all blocks, and for each block those of its own n-grams."""

    def add(rows: pa.Table) -> pa.Table:
        lists = rows.to_pylist()
        keys = [_unpack_keys(r["keys"]) for r in lists]
        ends = np.cumsum([len(x) for x in keys])
        kinds_, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = lambda c: np.bincount(back, weights=np.concatenate([_unpack(r[c]) for r in lists]), minlength=len(kinds_)).astype(np.int64)
        k = total("k")
        count = 2 * k[back]
        count[first] += 1
        cut = lambda x: pa.array([_pack(x[b - len(y) : b]) for b, y in zip(ends, keys, strict=True)], pa.binary())
        return pa.table({
            "level": rows["level"], "bucket": rows["bucket"], "block": rows["block"],
            "count": cut(count), "kinds": cut(total("kinds")[back]), "mass": cut(total("mass")[back]),
            "different": pa.array([int((k > 0).sum())] + [0] * (len(lists) - 1), pa.int64()),
        })

    return asked.groupBy("bucket").applyInArrow(_grouped(add), _ANSWERS)


@dataclass
class Automaton:
    """The states and arcs that a block's texts can reach, by the block's numbers of its words, bigrams and trigrams."""

    n: int  # training tokens
    v: int  # distinct training tokens
    least: float  # count of a kept n-gram
    discount: float

    def word_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + self.v + 1.0))

    def left(self, count: np.ndarray, kinds: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """What the kept followers leave of a kept history: the weight of its failure arc."""
        rest = 1.0 - (mass - self.discount * kinds) / np.maximum(count, 1)
        return np.where(count >= self.least, np.maximum(rest, 1e-12), 1.0)

    def walk(self, b: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token: whether it is known, its word's log10 probability, and the log10 weights on its way."""
        c1, _, kinds, mass = _answered(answers, 1, b)
        left1 = self.left(c1, kinds, mass)
        c2, _, kinds, mass = _answered(answers, 2, b)
        left2 = self.left(c2, kinds, mass)
        c3 = _answered(answers, 3, b)[0]
        del kinds, mass
        word, total = np.zeros(len(b.real)), np.zeros(len(b.real))
        for i in range(0, len(b.real), _STEP):
            places = i + np.flatnonzero(b.real[i : i + _STEP])
            w, h, p = b.at[1][places], b.at[1][places - 1], b.at[2][places]
            word[places] = self.word_log(c1[w])
            low = left1[h] * 10 ** word[places]
            prob = np.where(c2[p] >= self.least, (c2[p] - self.discount) / np.maximum(c1[h], 1) + low, low)
            long = np.flatnonzero(b.real[places - 1])  # those with a bigram as their history
            arc, h = c3[b.at[3][places[long]]], b.at[2][places[long] - 1]
            low = left2[h] * prob[long]
            prob[long] = np.where(arc >= self.least, (arc - self.discount) / np.maximum(c2[h], 1) + low, low)
            total[places] = np.log10(prob)
        return b.real & (c1[b.at[1]] > 0), word, total


@dataclass
class Settings:
    gram_share: float
    discount: float
    tokens: int  # of the training texts


def train(docs: DataFrame, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE, discount: float = DISCOUNT) -> tuple[Settings, DataFrame]:
    """What ``score`` needs of the texts of ``docs``: the settings, and the texts in blocks.

    ``word_share`` is of no effect any more: no words are sent along, all are looked up.
    """
    return Settings(gram_share, discount, n_tokens(docs, F.lit(True))[1]), coded(docs, F.lit(True), None)


def score(docs: DataFrame, model: Settings, learned: DataFrame) -> DataFrame:
    """``docs`` without text, with n_tokens, n_known, train_tokens, base_score and score (columns of those names are replaced)."""
    docs = without(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [c for c in docs.columns if c != "text"]
    texts = coded(docs, F.lit(False), names)
    size = model.tokens + n_tokens(docs, F.lit(False))[0]
    return _scored(texts.unionByName(learned, allowMissingColumns=True), [docs.schema[c] for c in names], model, size)


def _scored(texts: DataFrame, fields: list, model: Settings, size: int) -> DataFrame:
    """The rows and scores of the texts of some blocks; ``size``: tokens of all blocks.

    One plan: Spark shuffles the blocks once, and reads that again wherever they meet answers
    (so all steps have to take the same columns of them). The answers go to their blocks once as well,
    for the next shorter n-grams and for the scores.
    """
    n, buckets = model.tokens, size // _BUCKET + 1
    least = max(model.gram_share * n, 1)
    texts = texts.repartition("block")

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, b = _block(pa.Table.from_batches([batch.slice(i, 1)]))
                none = np.zeros(len(b.keys[3]), np.int64)
                yield from b.asked(3, block, buckets, none, none).to_batches()
                del b, none
                give_back()

    def shorter(level: int):
        def ask(rows: pa.Table, answers: pa.Table) -> pa.Table:
            block, b = _block(rows)
            count, speaks, _, _ = _answered(answers, level + 1, b)
            kept = speaks & (count >= least)
            history = b.history(level + 1)[kept]
            size = len(b.keys[level])
            return b.asked(level, block, buckets, np.bincount(history, minlength=size), np.bincount(history, weights=count[kept], minlength=size).astype(np.int64))

        return ask

    def with_answers(rows: DataFrame, answers: DataFrame):
        return rows.groupBy("block").cogroup(answers.groupBy("block"))

    three = tally(texts.mapInArrow(settled(triples), _ASKED)).repartition("block")
    two = tally(with_answers(texts, three).applyInArrow(_cogrouped(shorter(2)), _ASKED)).repartition("block")
    one = tally(with_answers(texts, two).applyInArrow(_cogrouped(shorter(1)), _ASKED)).repartition("block")
    v = one.agg(F.coalesce(F.sum("different"), F.lit(0)).alias("v"))
    names = [f.name for f in fields]

    def follow(rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, b = _block(rows)
        v = rows["v"][0].as_py() - (n > 0)  # the start of a text is a history, not a token
        automaton = Automaton(n, v, least, model.discount)
        known, word, total = automaton.walk(b, answers)
        some = slice(None) if rows["rows"][0].is_valid else slice(0)
        add = lambda x: pa.array(np.add.reduceat(x, b.begin[:-1])[some])
        given = rows["rows"].combine_chunks().flatten().flatten()[1:]  # none, if the block only counts
        return pa.Table.from_arrays(
            [*given, pa.array((b.sizes - 1)[some]), add(known.astype(np.int64)), pa.array(np.full(len(b.sizes), n)[some]), add(word), add(total)],
            names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return with_answers(texts.crossJoin(F.broadcast(v)), three.union(two).union(one)).applyInArrow(_cogrouped(follow), kind)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the scores of every document, learned from those whose crc32(doc_id) mod 7 is not 2."""
    rows = with_crc(docs.select("doc_id", "text"), 7, 2)
    names = ["doc_id", "held_out"]
    learn = ~F.col("held_out")
    size, learned = n_tokens(rows, learn)
    return _scored(coded(rows, learn, names), [rows.schema[c] for c in names], Settings(GRAM_SHARE, DISCOUNT, learned), size)
