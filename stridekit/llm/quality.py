"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from one vectorised pass over the whole text (bytes, words
and lines); language, source and ids are never among them. The trees are fitted
on at most ``MAX_ROWS`` labelled rows (documented bound: those with the
smallest hash of their id) and broadcast as flat arrays.

Edge cases: a null text counts as empty; an empty text has all statistics 0
and is scored like any other; a document with several labels learns from each;
labels of unknown documents or without a value are ignored; without labels the
score is 0.5 for every text; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .textblocks import ALNUM, LOWER, NON_SPACE, blocks, bounded_batches, bounded_sample, give_back, mix, settled, table_of, text_buffer, with_crc, without, words

MAX_ROWS = 20_000
FEATURES = [
    "log_bytes", "log_words", "log_lines", "letter", "upper", "digit", "space", "wide", "symbol", "mark", "mean_word", "word_spread",
    "longest_word", "distinct_words", "top_word", "repeated_next", "repeated_line", "marked_words", "bare_words", "words_a_line", "distinct_pairs",
]
_CLASSES = {
    "letter": table_of([*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 256)]),
    "upper": table_of(range(0x41, 0x5B)),
    "digit": table_of(range(0x30, 0x3A)),
    "space": ~NON_SPACE,
    "wide": table_of(range(0x80, 256)),
    "symbol": table_of(b"#$%&*+/<=>@[\\]^_`{|}~"),
    "mark": table_of(b"!\"'(),-.:;?"),
}
_NOT_NEWLINE = table_of(i for i in range(256) if i != 0x0A)


def _sums(v: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(v, dtype=float)])
    return c[bounds[1:]] - c[bounds[:-1]]


def _kinds(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of distinct hashes and the count of the most frequent one."""
    n, top = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            x = np.sort(h[a:b])
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            n[i], top[i] = len(at), np.diff(np.append(at, len(x))).max()
    return n, top


def statistics(col: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    buf, offs = text_buffer(col)
    out = []
    for i0, i1 in blocks(offs, 1 << 20):
        b, o = buf[offs[i0] : offs[i1]], offs[i0 : i1 + 1] - offs[i0]
        size = np.maximum(np.diff(o), 1).astype(float)
        f = {"log_bytes": np.log1p(np.diff(o))}
        for name, t in _CLASSES.items():
            f[name] = _sums(t[b], o) / size
        h, bounds, s, e = words(b, o, NON_SPACE, spans=True)
        n = np.diff(bounds).astype(float)
        m = np.maximum(n, 1)
        length = (e - s).astype(float)
        f["log_words"] = np.log1p(n)
        f["mean_word"] = _sums(length, bounds) / m
        f["word_spread"] = np.sqrt(np.maximum(_sums(length**2, bounds) / m - f["mean_word"] ** 2, 0))
        f["longest_word"] = np.log1p([length[x:y].max() if y > x else 0 for x, y in zip(bounds[:-1], bounds[1:], strict=True)])
        kinds, top = _kinds(h, bounds)
        f["distinct_words"], f["top_word"] = kinds / m, top / m
        inner = np.ones(len(h), bool)
        inner[bounds[:-1][n > 0]] = False
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & inner[1:]
        f["repeated_next"] = _sums(same, bounds) / m
        pair = np.zeros(len(h), np.uint64)
        pair[1:] = mix(h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])
        f["distinct_pairs"] = _kinds(pair, bounds)[0] / m
        ends = LOWER[b[e - 1]] if len(e) else np.zeros(0, np.uint8)
        f["marked_words"] = _sums(_CLASSES["symbol"][ends], bounds) / m
        f["bare_words"] = _sums(ALNUM[ends], bounds) / m
        lh, lb = words(b, o, _NOT_NEWLINE)
        lines = np.diff(lb).astype(float)
        f["log_lines"] = np.log1p(lines)
        f["words_a_line"] = n / np.maximum(lines, 1)
        f["repeated_line"] = 1 - np.where(lines > 0, _kinds(lh, lb)[0] / np.maximum(lines, 1), 1)
        out.append(np.stack([f[c] for c in FEATURES], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        offs = np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offs), pa.array(x.reshape(-1))), batch.column("quality")], names=["x", "quality"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> gbt.Trees:
    """Fit on at most ``max_rows`` rows of ``labels`` (doc_id, quality) and the texts of those documents."""
    bounded_batches(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = bounded_sample(known, max_rows, "doc_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality")  # at most max_rows small rows
    rows = sample.mapInArrow(settled(_featured), "x array<double>, quality int").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = rows["quality"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the same trees, whatever order the rows come in
    trees = gbt.fit(x[order], y[order])
    del rows, x
    give_back()  # the driver goes on to other operators
    return trees


def score(docs: DataFrame, model: gbt.Trees) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` added; reads only ``text``."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, "score", "predicted")
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(statistics(batch.column("text")))
            cols = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], names=[*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(settled(scan), f"{fields}, score double, predicted int")


def keep_good(docs: DataFrame, model: gbt.Trees, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``least``."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column("text"))) >= least))

    return docs.mapInArrow(settled(scan), docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that the query and the pipeline learn from: crc32(doc_id) mod 3 is not 1."""
    return with_crc(labels.select("doc_id", "quality"), 3, 1).where(~F.col("held_out")).drop("held_out")
