"""Vectorised text helpers for Arrow batches inside Spark tasks.

A batch's text column is read as one byte buffer with offsets, and the work is
done in blocks of about a megabyte, so memory stays bounded by the batch plus
one block (or one word, if a single word is longer than a block).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BATCH_ROWS = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
     0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25],
    dtype=np.uint64,
)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Give the memory that this process has freed, but its allocators keep, back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such C library: nothing to give back
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settled(scan):
    """``scan`` (an iterator of batches to an iterator of batches) that gives back its memory when a task ends.

    A worker lives on and runs other operators' tasks; what its allocators keep adds up over them.
    """

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


def without(df: DataFrame, *added: str) -> DataFrame:
    """``df`` without the columns whose names (in any case) an operator is about to add: the operator's replace them."""
    names = {a.lower() for a in added}
    return df.drop(*[c for c in df.columns if c.lower() in names])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def with_crc(df: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Add ``held_out``: crc32 of doc_id as text has this remainder (a null id is never held out)."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder
    return df.withColumn("held_out", F.coalesce(hit, F.lit(False)))


def table_of(word_bytes) -> np.ndarray:
    """A 256-entry table: True where a byte belongs to a word."""
    t = np.zeros(256, dtype=bool)
    t[list(word_bytes)] = True
    return t


_SPACES = {0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D}
#: ``[^\x20\x09-\x0D]+``
NON_SPACE = table_of(i for i in range(256) if i not in _SPACES)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z and every non-ASCII character
ALNUM = table_of([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (a null row is empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that near inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64 and of its inverse."""
    inv = pow(int(_BASE), -1, 1 << 64)
    p = np.full(n, _BASE, dtype=np.uint64)
    q = np.full(n, np.uint64(inv), dtype=np.uint64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def _hash_block(x: np.ndarray, isw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one block; ``cuts``: positions where a text begins."""
    if not isw.any():
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    first = isw.copy()
    first[1:] &= ~isw[:-1]
    cut = cuts[(cuts > 0) & (cuts < len(x))]
    first[cut] = isw[cut]
    last = isw.copy()
    last[:-1] &= ~isw[1:]
    last[cut - 1] = isw[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(20, int(len(x) - 1).bit_length())
    p, q = _powers(size)
    t = (x.astype(np.uint64) + np.uint64(1)) * p[: len(x)]
    t *= isw
    h = np.add.reduceat(t, starts) * q[starts]
    return mix(h), starts, ends


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, spans: bool = False):
    """Word hashes of every text, in order, and where each text's words begin.

    Returns ``(hashes, bounds)``, ``bounds[i]:bounds[i+1]`` being text i's words;
    with ``spans`` also the words' first and past-the-last byte in ``buf``. A-Z
    are lower-cased; ``table`` says which (lower-cased) bytes make words.
    """
    out, s_all, e_all, at, n = [], [], [], 0, len(buf)
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        while end < n:
            # cut where a text begins, or else behind a delimiter; a longer word makes a longer block
            k = int(np.searchsorted(offs, end, side="right")) - 1
            if offs[k] > at:
                end = int(offs[k])
                break
            gaps = np.flatnonzero(~table[LOWER[buf[at:end]]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(n, at + 2 * (end - at), *(int(o) for o in offs[k + 1 : k + 2]))
            if end in offs[k + 1 : k + 2]:
                break
        x = LOWER[buf[at:end]]
        lo, hi = np.searchsorted(offs, [at, end])
        h, s, e = _hash_block(x, table[x], offs[lo:hi] - at)
        out.append(h)
        s_all.append(s + at)
        if spans:
            e_all.append(e + at)
        at = end
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    starts = np.concatenate(s_all) if s_all else np.zeros(0, np.int64)
    bounds = np.searchsorted(starts, offs)
    if spans:
        return hashes, bounds, starts, (np.concatenate(e_all) if e_all else np.zeros(0, np.int64))
    return hashes, bounds


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``len(h) - k + 1`` runs of k consecutive words (one text); k has its own key."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, k * int(_BASE) % (1 << 64), dtype=np.uint64)
    for j in range(k):
        c = np.uint64((int(_GRAM[j % 10]) + 2 * (j // 10) * int(_GRAM[(j + 1) % 10])) % (1 << 64)) if j >= 10 else _GRAM[j]
        acc += h[j : j + m] * c
    return mix(acc)


def blocks(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of at most ``limit`` units (or one longer text)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in the sorted array ``keys`` and whether each is there."""
    if len(keys) == 0:
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return at, keys[at] == x


def hash_unit(*cols: str):
    """A uniform value in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def bounded_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key`` (all rows, if there are no more).

    A count sets a hash limit that leaves about 2n + 100 rows, so that no task has to order more than that.
    """
    total = df.count()
    h = hash_unit(key)
    if total > 2 * n + 100:
        df = df.where(h < (2.0 * n + 100) / total)
    return df.orderBy(h, key).limit(n)
