"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over training token windows.

Text is lower-cased (A-Z) and split into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The
n-grams of a test item are its runs of ``n`` words; an item of fewer words, but
not none, is one n-gram. A training word is hit if any occurrence of a test
n-gram covers it. Hash hits are verified against the n-gram's words.

The n-grams are broadcast as sorted hash arrays in blocks of at most
``max_broadcast`` n-grams: one block is one pass. A larger test set is cut into
more blocks by hash, each scanned by its own pass; the blocks' spans are then
merged per row, so the result does not depend on the bound.

Edge cases: null or wordless texts have no words and are never hit; equal
items each count; repeated rows are judged alike; an empty benchmark hits
nothing. Extra columns are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .textblocks import ALNUM, LOWER, blocks, bounded_batches, find, fresh, grams, settled, text_buffer, without, words

NGRAM = 10
MAX_BROADCAST_NGRAMS = 2_000_000
_SPANS = "array<struct<first:long,past:long,item_ids:array<string>>>"


def benchmark_ngrams(bench: DataFrame, n: int = NGRAM) -> DataFrame:
    """hash, width, words (joined by a space), item_ids: the distinct n-grams of all items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            h, bounds, s, e = words(buf, offs, ALNUM, spans=True)
            low = LOWER[buf].tobytes()
            out: list[tuple] = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                a, b = int(bounds[i]), int(bounds[i + 1])
                width = min(n, b - a)
                if not width:
                    continue
                for k, g in enumerate(grams(h[a:b], width).view(np.int64).tolist()):
                    w = b" ".join(low[s[j] : e[j]] for j in range(a + k, a + k + width))
                    out.append((g, width, w.decode("utf-8", "replace"), item))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))],
                names=["hash", "width", "words", "item_id"],
            )

    rows = bench.select(F.col("item_id").cast("string"), "text").mapInArrow(settled(scan), "hash long, width int, words string, item_id string")
    return rows.groupBy("hash", "width", "words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def _scanner(shared, fields: list[str]):
    """Adds n_words and spans (merged runs of hit words per row, with the items whose n-grams occur) to the batches."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width, text_of, items_of = shared.value
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            n_words, spans = [], []
            for i0, i1 in blocks(offs, 4 << 20):
                part, po = buf[offs[i0] : offs[i1]], offs[i0 : i1 + 1] - offs[i0]
                h, bounds, s, e = words(part, po, ALNUM, spans=True)
                n_words += np.diff(bounds).tolist()
                found: list[list] = [[] for _ in range(i1 - i0)]
                for width, keys in by_width.items():
                    g = grams(h, width)  # runs across two texts are passed over below
                    at, hit = find(keys, g)
                    for p in np.flatnonzero(hit).tolist():
                        i = int(np.searchsorted(bounds, p, side="right")) - 1
                        if p + width > bounds[i + 1]:
                            continue
                        key = (width, int(keys[at[p]]))
                        w = b" ".join(LOWER[part[s[j] : e[j]]].tobytes() for j in range(p, p + width))
                        for known, ids in zip(text_of[key], items_of[key], strict=True):
                            if known == w:
                                found[i].append((p - int(bounds[i]), p - int(bounds[i]) + width, ids))
                spans += [_merge(x) for x in found]
            cols = [batch.column(f) for f in fields]
            kinds = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("item_ids", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(spans, kinds)], names=[*fields, "n_words", "spans"])

    return scan


def _merge(found: list) -> list[dict]:
    """Overlapping or touching runs as one, with the items of all."""
    out: list[dict] = []
    for a, b, ids in sorted(found, key=lambda x: x[:2]):
        if out and a <= out[-1]["past"]:
            out[-1]["past"] = max(out[-1]["past"], b)
            out[-1]["item_ids"].update(ids)
        else:
            out.append({"first": a, "past": b, "item_ids": set(ids)})
    return [x | {"item_ids": sorted(x["item_ids"])} for x in out]


def scan_documents(docs: DataFrame, bench: DataFrame, n: int = NGRAM, max_broadcast: int = MAX_BROADCAST_NGRAMS) -> DataFrame:
    """Every row of ``docs`` with ``n_words`` and ``spans`` added (columns of these names are replaced)."""
    spark = docs.sparkSession
    docs = without(docs, "n_words", "spans")
    ensure_checkpoint_dir(spark)
    bounded_batches(spark)
    tests = benchmark_ngrams(bench, n).checkpoint()
    passes = max(1, -(-tests.count() // max_broadcast))

    def block(k: int):
        part = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("hash"), F.lit(passes)) == k)
        by_width: dict[int, list] = {}
        text_of: dict[tuple, list] = {}
        items_of: dict[tuple, list] = {}
        for r in part.collect():  # at most about max_broadcast n-grams
            key = (r["width"], r["hash"] % (1 << 64))
            by_width.setdefault(r["width"], []).append(key[1])
            text_of.setdefault(key, []).append(r["words"].encode())
            items_of.setdefault(key, []).append(r["item_ids"])
        arrays = {w: np.unique(np.array(x, dtype=np.uint64)) for w, x in by_width.items()}
        return spark.sparkContext.broadcast((arrays, text_of, items_of))

    fields = docs.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields)}, n_words long, spans {_SPANS}"
    if passes == 1:
        return docs.mapInArrow(_scanner(block(0), fields), schema)
    row = fresh(docs, "_row")
    kept = docs.withColumn(row, F.monotonically_increasing_id()).checkpoint()
    found = None
    for k in range(passes):
        one = kept.select(row, "text").mapInArrow(_scanner(block(k), [row]), f"`{row}` long, n_words long, spans {_SPANS}")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy(row).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["past"], x["past"]).alias("past"),
            F.array_sort(F.array_union(last["item_ids"], x["item_ids"])).alias("item_ids"),
        )
        touch = (F.size(acc) > 0) & (x["first"] <= last["past"])
        return F.when(touch, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    merged = merged.withColumn("spans", F.aggregate("spans", F.lit([]).cast(_SPANS), step))
    return kept.join(merged, row).drop(row)


def contamination(docs: DataFrame, bench: DataFrame, n: int = NGRAM, max_broadcast: int = MAX_BROADCAST_NGRAMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every document."""
    rows = scan_documents(docs.select("doc_id", "text"), bench, n, max_broadcast)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["item_ids"]))))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["past"] - s["first"])
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("items"), "spans").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = NGRAM, action: str = "documents", max_broadcast: int = MAX_BROADCAST_NGRAMS) -> DataFrame:
    """``docs`` without hit documents (``documents``), or with the hit words cut out of the texts (``spans``).

    Cutting removes each hit run from its first word's first byte to its last
    word's last byte; texts without hits stay byte for byte.
    """
    if action not in ("documents", "spans"):
        raise ValueError(action)
    # the found spans travel under a name of their own, so that every column of docs stays as it is
    spans, names = fresh(docs, "_hit_spans"), docs.columns
    taken = {c: fresh(docs, f"_kept_{c}") for c in names if c.lower() in ("n_words", "spans")}
    rows = scan_documents(docs.withColumnsRenamed(taken), bench, n, max_broadcast).withColumnRenamed("spans", spans).drop("n_words")
    rows = rows.withColumnsRenamed({v: k for k, v in taken.items()})
    if action == "documents":
        return rows.where(F.size(spans) == 0).select(*names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, hits in enumerate(batch.column(spans).to_pylist()):
                if hits:
                    b, o = text_buffer(pa.array([texts[i]]))
                    _, _, s, e = words(b, o, ALNUM, spans=True)
                    raw, out, at = b.tobytes(), [], 0
                    for x in hits:
                        out.append(raw[at : s[x["first"]]])
                        at = int(e[x["past"] - 1])
                    texts[i] = b"".join([*out, raw[at:]]).decode("utf-8", "replace")
            cols = [pa.array(texts, batch.schema.field("text").type) if f == "text" else batch.column(f) for f in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(cut, docs.schema)
