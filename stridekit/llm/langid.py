"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Text is lower-cased; every run of non-letters is one space. A character is
hashed to 12 bits, an n-gram is its up to five characters packed into one
64-bit key, so an n-gram's history and suffix are shifts and masks of its key.

One union table per order holds the sorted keys of all languages and, for each
key, every language's interpolated log-probability, so one binary search
serves all languages. Where the longest n-gram of a position is unknown the
scorer goes to the next shorter one and adds the languages' interpolation
weights of the missed history. The language with the lowest mean cross-entropy
wins (ties: the first in alphabetical order).

Training is bounded: ``ROWS_PER_LANG`` rows per language, the first in the
order of a hash of their id (documented bound; counting runs in Spark), of
which every fifth only calibrates: the temperature of ``score`` and the
rejection. A text is rejected if it has no letter, or if its cross-entropy lies
so far above its language's calibration texts that the standardised excess
passes the largest of theirs by half (at least ``MIN_CUT`` deviations).

Edge cases: null text or text without a letter is ``und`` with score 0 and is
rejected; a table without any labelled row learns nothing and gives ``und``;
one learned language gives score 1; repeated rows score alike. Languages, ids
and sources are never read by a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textblocks import blocks, bounded_batches, find, give_back, hash_unit, mix, settled, with_crc, without

ORDER = 5
ROWS_PER_LANG = 1500
CALIBRATE_EVERY = 5
MIN_CUT = 8.0
MAX_BROADCAST_ROWS = 1_000_000
UND = "und"
_BITS = 12
_SPACE = 1
_BLOCK = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    t = np.zeros(0x110000, bool)
    for i in range(0x110000):
        if chr(i).isalpha():
            t[i] = True
    return t


def _char_ids(x: np.ndarray) -> np.ndarray:
    """12-bit ids (2 and up) of letters: small code points are their own, others are hashed."""
    wide = x >= 4000
    if wide.any():
        x = x.copy()
        x[wide] = (mix(x[wide].astype(np.uint64)) % np.uint64(4000)).astype(x.dtype)
    return x.astype(np.uint64) + np.uint64(2)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character ids of all texts (letters, and one space for each run of others) and row offsets."""
    low = [t.lower() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    x = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[x] if len(x) else np.zeros(0, bool)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter behind a letter stands for its run
    begin = offs[:-1][offs[:-1] < offs[1:]]
    keep[begin] = letter[begin]
    ids = np.full(int(keep.sum()), _SPACE, np.uint64)
    ids[letter[keep]] = _char_ids(x[letter])
    return ids, np.concatenate([[0], np.cumsum(keep)])[offs]


def _ngrams(ids: np.ndarray, offs: np.ndarray, order: int) -> list[np.ndarray]:
    """Packed n-grams of order 1 to ``order`` that end at each position (0: does not fit into the text)."""
    place = np.arange(len(ids)) - np.repeat(offs[:-1], np.diff(offs))
    out, key = [], ids.copy()
    out.append(key)
    for k in range(2, order + 1):
        prev = np.zeros_like(key)
        prev[1:] = key[:-1]
        key = ((prev << np.uint64(_BITS)) | ids) * (place >= k - 1)
        out.append(key)
    return out


def _count(order: int, langs: list[str]):
    where = {x: i for i, x in enumerate(langs)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                ids, offs = normalised(texts)
                keys = [np.unique(g[g > 0], return_counts=True) for g in _ngrams(ids, offs, order)]
                total.setdefault(lang, []).append(keys)
        for lang, parts in total.items():
            for k in range(order):
                u, at = np.unique(np.concatenate([p[k][0] for p in parts]), return_inverse=True)
                c = np.bincount(at, weights=np.concatenate([p[k][1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(u), where[lang], np.int32)), pa.array(np.full(len(u), k + 1, np.int32)), pa.array(u.view(np.int64)), pa.array(c)],
                    names=["lang", "k", "gram", "c"],
                )

    return scan


class Model:
    """Per order the sorted keys with the languages' log-probabilities, and the histories' log weights."""

    def __init__(self, langs: list[str], order: int):
        self.langs, self.order = langs, order
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.hist: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.logw: list[np.ndarray] = [np.zeros((0, len(langs)), np.float32)]
        self.temperature, self.mean, self.spread, self.cut = 1.0, np.zeros(len(langs)), np.ones((len(langs), 2)), np.inf

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean cross-entropy (nats a character) of each text in each language, and the number of characters."""
        ce, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        size = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for i, j in blocks(size, _BLOCK):
            ids, offs = normalised(texts[i:j])
            n[i:j] = np.diff(offs)
            for a in range(0, len(ids), _BLOCK):  # a longer text goes through in pieces that overlap by a history
                b, a0 = min(len(ids), a + _BLOCK), max(0, a - self.order + 1)
                logs = self._log_probs(ids[a0:b], np.clip(offs, a0, b) - a0)[a - a0 :]
                row = np.searchsorted(offs, np.arange(a, b), side="right") - 1
                for lang in range(len(self.langs)):
                    ce[i:j, lang] -= np.bincount(row, weights=logs[:, lang], minlength=j - i)
        return ce / np.maximum(n, 1)[:, None], n

    def _log_probs(self, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), len(self.langs)), np.float32)
        left = np.arange(len(ids))
        grams = _ngrams(ids, offs, self.order)
        for k in range(self.order, 0, -1):
            key = grams[k - 1][left]
            at, hit = find(self.keys[k - 1], key)
            out[left[hit]] += self.logp[k - 1][at[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                break
            if k > 1:
                at, known = find(self.hist[k - 1], key >> np.uint64(_BITS))
                known &= key > 0
                out[left[known]] += self.logw[k - 1][at[known]]
            else:
                out[left] += self.unknown
        return out

    def judge(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        ce, n = self.losses(texts)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = ce.argmin(axis=1)
        p = self._posterior(ce, n)
        rows = np.arange(len(texts))
        letters = n > 0  # without a letter nothing is left to score
        score = np.where(letters, p[rows, best], 0.0)
        excess = (ce[rows, best] - self.mean[best]) / self._deviation(best, n)
        names = [self.langs[i] if ok else UND for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, score, np.where(letters, ce[rows, best], 0.0), ~letters | (excess > self.cut)

    def _posterior(self, ce: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Softmax of the mean log-likelihood gaps, sharpened by the length's root and the temperature."""
        z = -(ce - ce.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None] / self.temperature
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def _deviation(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.sqrt(self.spread[lang, 0] + self.spread[lang, 1] / np.maximum(n, 1))

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        ce, n = self.losses(texts)
        y = np.array([self.langs.index(x) for x in langs], int)
        ok = n > 0
        ce, n, y = ce[ok], n[ok], y[ok]
        if not len(y):
            return
        rows = np.arange(len(y))

        def loss(t: float) -> float:
            self.temperature = t
            return float(-np.log(np.maximum(self._posterior(ce, n)[rows, y], 1e-12)).mean())

        self.temperature = min(np.geomspace(0.02, 5, 30), key=loss)
        right = ce.argmin(axis=1) == y
        z = []
        for k in range(len(self.langs)):
            own = right & (y == k)
            if not own.any():
                continue
            c, m = ce[own, k], n[own]
            self.mean[k] = np.average(c, weights=m)
            # variance a + b / length by least squares, kept positive
            sq = (c - self.mean[k]) ** 2
            b = max(float((sq * m).mean()), 1e-4)
            a = max(float(np.median(sq)) * 0.1, 1e-5)
            self.spread[k] = a, b
            z.append((c - self.mean[k]) / self._deviation(np.full(own.sum(), k), m))
        self.cut = max(MIN_CUT, 1.5 * float(np.concatenate(z).max())) if z else np.inf


def fit(counts: pd.DataFrame, langs: list[str], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from the counts (lang: place in ``langs``, k, gram, c) of all orders."""
    m, width = Model(langs, order), len(langs)
    lang, k_all, g_all, c_all = (counts[c].to_numpy() for c in ("lang", "k", "gram", "c"))
    mask = lambda k: np.uint64((1 << (_BITS * k)) - 1)
    raw = []
    for k in range(1, order + 1):
        own = k_all == k
        keys, at = np.unique(g_all[own].astype(np.int64).view(np.uint64), return_inverse=True)
        c = np.zeros((len(keys), width))
        c[at, lang[own]] = c_all[own]
        raw.append((keys, c))
    below = None
    for k in range(1, order + 1):
        keys, c = raw[k - 1]
        if k < order:  # below the highest order a key counts as many times as it has left neighbours
            above, ca = raw[k]
            at, _ = find(keys, above & mask(k))
            cont = np.zeros_like(c)
            np.add.at(cont, at, (ca > 0).astype(float))
            # a key that only begins texts has no left neighbour: it counts once
            c = np.where((c > 0) & (cont == 0), 1.0, cont)
        n1, n2 = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
        d = np.where(n1 + 2 * n2 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
        d = np.clip(d, 0.1, 0.9)
        hist, back = np.unique(keys >> np.uint64(_BITS), return_inverse=True)
        total, kinds = np.zeros((len(hist), width)), np.zeros((len(hist), width))
        np.add.at(total, back, c)
        np.add.at(kinds, back, c > 0)
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        if k == 1:
            low = np.full((len(keys), width), 1.0 / (1 << _BITS))
            m.unknown = np.log(np.maximum(weight[0] if len(hist) else np.ones(width), 1e-9) / (1 << _BITS)).astype(np.float32)
        else:
            at, _ = find(raw[k - 2][0], keys & mask(k - 1))
            low = below[at]
        p = np.maximum(c - d, 0) / np.maximum(total, 1)[back] + weight[back] * low
        m.keys.append(keys)
        m.logp.append(np.log(p).astype(np.float32))
        if k > 1:
            m.hist.append(hist)
            m.logw.append(np.log(weight).astype(np.float32))
            raw[k - 2] = (raw[k - 2][0], None)  # its counts are used up
        below = p
        del c, total, kinds, weight, low, p  # not beside the next order's
    return m


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, order: int = ORDER) -> Model:
    """Learn from ``rows_per_lang`` rows of each language of ``docs`` (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    ids = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("lang", "doc_id", hash_unit("doc_id").alias("h"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("rows"))
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    # a hash limit leaves about twice the wanted rows of each language to be ranked; one row a language is broadcast,
    # as ids are not to be dealt by language before that
    pick = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = ids.join(F.broadcast(sizes), "lang").where(F.col("h") * F.col("rows") < 2 * rows_per_lang + 100)
    ids = ids.withColumn("rank", F.row_number().over(pick)).where(F.col("rank") <= rows_per_lang)
    ids = ids.groupBy("doc_id", "lang").agg(F.min("rank").alias("rank"))
    if len(langs) * rows_per_lang <= MAX_BROADCAST_ROWS:
        ids = F.broadcast(ids)
    sample = docs.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"])
    sample = sample.where("text IS NOT NULL").withColumn("calibrate", F.col("rank") % CALIBRATE_EVERY == 0).persist()
    counts = (
        sample.where(~F.col("calibrate")).select("lang", "text").mapInArrow(_count(order, langs), "lang int, k int, gram long, c long")
        .groupBy("lang", "k", "gram").agg(F.sum("c").alias("c")).toPandas()
    )
    m = fit(counts, langs, order)
    del counts
    give_back()
    held = sample.where("calibrate").select("lang", "text").toPandas()
    m.calibrate(held["text"].tolist(), held["lang"].tolist())
    sample.unpersist()
    del held
    give_back()  # the driver goes on to other operators
    return m


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected added; reads only ``text``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    docs = without(docs, "lang_pred", "score", "cross_entropy", "rejected")
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score, ce, rejected = m.judge([t or "" for t in batch.column("text").to_pylist()])
            cols = [pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(ce), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], names=[*names, "lang_pred", "score", "cross_entropy", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(settled(scan), f"{fields}, lang_pred string, score double, cross_entropy double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the model does not reject."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = shared.value.judge([t or "" for t in batch.column("text").to_pylist()])[3]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(settled(scan), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that the query and the pipeline learn from: crc32(doc_id) mod 5 is not 0."""
    return with_crc(docs.select("doc_id", "lang", "text"), 5, 0).where(~F.col("held_out")).drop("held_out")
