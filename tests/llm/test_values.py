"""The queries against plain versions on small fixtures, and the properties the operators promise."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stridekit.llm import components, decontam, gbt, langid, licenses, lm, neardup, pieces, sharding, simhash, textblocks, urls

from .helpers import AZ, alnum, odd_rows, spaced

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def run(spark, name):
    return {r[0]: r for r in entry.queries()[name](spark, SF).collect()}


def test_words_and_hashes():
    col = [r[1] for r in odd_rows()]
    for table, plain in ((textblocks.NON_SPACE, spaced), (textblocks.ALNUM, alnum)):
        h, bounds = textblocks.words(*textblocks.text_buffer(pa.array(col, pa.string())), table)
        seen = {}
        for i, t in enumerate(col):
            ws = plain(t)
            assert bounds[i + 1] - bounds[i] == len(ws)
            for w, x in zip(ws, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_op1_held_out_accuracy(spark, docs):
    got = run(spark, "op1_language_id")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_kneser_ney_sums_to_one(docs):
    model = langid.train(docs.where("doc_id < 120"))
    known = model.keys[0]
    for h in model.hist[2][:: max(1, len(model.hist[2]) // 20)]:
        mask = np.uint64(0xFFF)
        total = np.zeros(len(model.langs))
        w3 = np.exp(model.logw[2][textblocks.find(model.hist[2], np.array([h]))[0][0]].astype(float))
        prev = h & mask
        at, ok = textblocks.find(model.hist[1], np.array([prev]))
        w2 = np.exp(model.logw[1][at[0]].astype(float)) if ok[0] else 1.0
        for c in [*known.tolist(), None]:
            if c is None:  # all letters that were never seen
                total += w3 * w2 * np.exp(model.unknown.astype(float)) * ((1 << 12) - len(known))
                continue
            at, ok = textblocks.find(model.keys[2], np.array([(h << np.uint64(12)) | np.uint64(c)]))
            if ok[0]:
                total += np.exp(model.logp[2][at[0]].astype(float))
                continue
            at, ok = textblocks.find(model.keys[1], np.array([(prev << np.uint64(12)) | np.uint64(c)]))
            total += w3 * (np.exp(model.logp[1][at[0]].astype(float)) if ok[0] else w2 * np.exp(model.logp[0][textblocks.find(known, np.array([c], dtype=np.uint64))[0][0]].astype(float)))
        assert np.allclose(total, 1, atol=1e-4)


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = spaced(t)
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    both = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in both.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: (len(sets[i]), top(i)) for i in texts}


def test_op2_against_all_pairs(spark, texts):
    got = run(spark, "op2_minhash_near_dedup")
    for i, (n, c) in brute_components(texts).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c)


def test_near_copies_at_the_threshold(spark):
    """One large group of near copies, chains of edits, and pairs just above and below the threshold, over many partitions."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(200)]
    texts = {}
    for k in range(300):
        w = list(base)
        for p in rng.choice(200, 3, replace=False):
            w[p] = word()
        texts[k] = " ".join(w)
    w = [word() for _ in range(120)]
    for k in range(300, 330):  # a chain: each differs a little from the one before it
        w = w[8:] + [word() for _ in range(8)]
        texts[k] = " ".join(w)
    shared = [word() for _ in range(60)]
    for k in range(400, 700):  # one passage, else different
        texts[k] = " ".join([word() for _ in range(60)] + shared + [word() for _ in range(60)])
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for i, (n, c) in brute_components(texts).items():
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (n, c), i


def test_star_whose_links_go_to_the_template(spark):
    """More copies than the windows have places, each like the template and unlike every other copy."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(200)]
    texts = [(0, " ".join(base))]
    for k in range(1, 1201):
        w = list(base)
        for p in rng.choice(200, 5, replace=False):
            w[p] = f"x{k}y{p}"
        texts.append((k, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in texts}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(0, i) >= 0.75 for i in range(1, 1201))
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 1201 and {r["component_id"] for r in got} == {0}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300 + i, 300 + (i + 1) % 40) for i in range(40)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {7} and {got[i] for i in range(300, 340)} == {300}


def test_op3_held_out_accuracy(spark):
    got = entry.queries()["op3_quality_classifier"](spark, "/root/testdata/sf0.01")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = got.where("held_out").join(y, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    x[::7, 1] = np.nan
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    t = gbt.fit(x, y, trees=30, depth=3)
    assert ((t.score(x) >= 0.5) == y).mean() > 0.97

    def one(row, at):
        while t.feature[at] >= 0:
            v = row[t.feature[at]]
            at = t.left[at] + (not (math.isnan(v) or v <= t.cut[at]))
        return t.value[at]

    plain = [t.base + sum(one(r, k) for k in t.roots.tolist()) for r in x]
    assert np.allclose(plain, t.margin(x))


def test_op4_against_plain(spark, docs, texts):
    got = {r["doc_id"]: r for r in simhash.with_near_counts(simhash.fingerprint_digest(docs, bucket_rows=30)).collect()}
    order = sorted(texts, reverse=True)
    prints = {}
    for k, i in enumerate(order):
        j = order[(k + 1) % len(order)]
        n = len(texts[i])
        edited = texts[i][: n - n // 3] + texts[j][: n // 3]
        f = np.unpackbits(simhash.fingerprints(pa.array([texts[i], edited, texts[j]])), axis=1)
        prints[i] = f[0]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (pytest.approx((f[0] == f[1]).mean()), pytest.approx((f[0] == f[2]).mean()))
    for i in order:
        assert got[i]["n_near"] == sum((prints[i] != prints[j]).sum() <= simhash.RADIUS for j in order) - 1


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    bits = [rng.integers(0, 2, 128) for _ in range(20)]
    for b in bits[:20]:
        for flips in range(1, 9):
            c = b.copy()
            c[rng.choice(128, flips, replace=False)] ^= 1
            bits.append(c)
    hexes = [np.packbits(b).tobytes().hex() for b in bits] + [np.packbits(bits[0]).tobytes().hex()]
    got = simhash.within_radius(spark.createDataFrame([(h,) for h in hexes], "fingerprint string"), radius, 128).collect()
    kinds = sorted(set(hexes))
    dist = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {(a, b, dist(a, b)) for k, a in enumerate(kinds) for b in kinds[k + 1 :] if dist(a, b) <= radius}
    assert {(r["a"], r["b"], r["distance"]) for r in got} == want and len(got) == len(want)


def test_op5_against_plain(spark, texts):
    got = run(spark, "op5_license_scan")
    for i, t in texts.items():
        w, places, labels = alnum(t), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r["labels"].split(",")) | {""}


def test_license_rules():
    assert len(licenses.rules()) > 300
    label = lambda t: [(x.label, x.kind) for x in licenses.detect(t.encode())[1]]
    assert label("Licensed under the Apache License,\nVersion 2.0.") == [("apache", "grant")]
    assert label("SPDX-License-Identifier: GPL-3.0-or-later") == [("gpl", "tag")]
    assert label("Released under CC BY-NC-SA 4.0 (see LICENSE).")[0] == ("cc-by-nc-sa", "grant")
    assert label("GNU Lesser General Public License 2.1")[0][0] == "lgpl"
    assert label("permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files") == [("mit", "notice")]
    assert label("nothing of that kind") == []
    for r in licenses.rules():  # the gate never hides what a rule could match: every keyword is part of its rule's matches
        assert r.keyword in r.pattern.pattern.replace("licen[cs]", "licen") or r.kind == "grant", r


def plain_lm(rows, gram_share, d=lm.DISCOUNT):
    tok = {i: ["<s>", *spaced(t), "</s>"] for i, t in rows.items()}
    train = [t for i, t in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = Counter(w for t in train for w in t[1:])
    n, v = sum(c1.values()), len(c1)
    least = max(1, gram_share * n)
    often = {w for w in c1 if c1[w] >= least} | {"<s>"}
    c2 = Counter(p for t in train for p in zip(t, t[1:], strict=False))
    k2 = {p: c for p, c in c2.items() if c >= least and set(p) <= often}
    c3 = Counter(p for t in train for p in zip(t, t[1:], t[2:], strict=False))
    k3 = {p: c for p, c in c3.items() if c >= least and p[:2] in k2 and p[1:] in k2}
    of = lambda u: len(train) if u == "<s>" else c1[u]
    used2, used3 = Counter(), Counter()
    for (u, _), c in k2.items():
        used2[u] += (c - d) / of(u)
    for p, c in k3.items():
        used3[p[:2]] += (c - d) / c2[p[:2]]
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)

    def p2(u, w):
        low = p1(w) * (1 - used2[u]) if u in often else p1(w)
        return low + ((k2[u, w] - d) / of(u) if (u, w) in k2 else 0)

    def p3(a, u, w):
        if (a, u) not in k2:
            return p2(u, w)
        return p2(u, w) * (1 - used3[a, u]) + ((k3[a, u, w] - d) / c2[a, u] if (a, u, w) in k3 else 0)

    out = {}
    for i, t in tok.items():
        score = sum(math.log10(p3(t[k - 2] if k > 1 else None, t[k - 1], t[k])) for k in range(1, len(t)))
        out[i] = (len(t) - 1, sum(c1[w] > 0 for w in t[1:]), n, sum(math.log10(p1(w)) for w in t[1:]), score)
    return out


@pytest.mark.parametrize("word_share,gram_share", [(lm.WORD_SHARE, lm.GRAM_SHARE), (1e-3, 2e-4), (5e-5, 1e-3)])
def test_op6_against_plain(docs, texts, word_share, gram_share):
    rows = textblocks.with_crc(docs.select("doc_id", "text"), 7, 2)
    got = {r["doc_id"]: r for r in lm.score(rows, *lm.train(rows.where("NOT held_out"), word_share, gram_share)).collect()}
    for i, x in plain_lm(texts, gram_share).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:3]
        assert (r["base_score"], r["score"]) == (pytest.approx(x[3], rel=1e-8), pytest.approx(x[4], rel=1e-8))


def test_op7_against_plain(spark):
    got = run(spark, "op7_url_filter")
    for i, url in {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}.items():
        m = re.match(r"(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[2].translate(AZ), m[3]) if m else ("", "")
        fit = [(len(r), r, v) for v, r in urls.RULES if ("." + host).endswith("." + r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert r["verdict"] == (max(fit)[2] if fit else "block" if r["score"] > 0.5 else "allow")


def test_op8_law(spark, texts):
    got = run(spark, "op8_rendezvous_sharding")
    for i, r in got.items():
        b = texts[i].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 16, zlib.crc32(b), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40


def test_weighted_shards(spark):
    weights = [1.0, 2.0, 5.0]
    rows = spark.range(40_000).select(sharding.shard_of(F.col("id"), weights).alias("s"), sharding.shard_of(F.col("id"), [1.0, 2.0, 7.0]).alias("t"))
    share = {r["s"]: r["count"] / 40_000 for r in rows.groupBy("s").count().collect()}
    assert all(abs(share[k] - w / 8) < 0.015 for k, w in enumerate(weights))
    assert rows.where("s <> t AND t <> 2").count() == 0  # a heavier shard takes rows only into itself


def test_op9_round_trip_and_parity(spark, texts):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    for i, r in run(spark, "op9_sentencepiece").items():
        assert r["parity"] and r["round_trip"] and r["ids"] == other.encode(texts[i])


def test_marker_and_space_edges():
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        codec = pieces.Codec(f.read())
    cases = ["", " ", "  ", "a  b", "trail ", " lead", "▁x", " ▁ ", "▁", "<s> </s> <0x0A>", "日本\n\t語", "a" * 5000, "word " * 3]
    ids, offs, parity = codec.encode(cases)
    assert parity.all()
    for k, t in enumerate(cases):
        own = ids[offs[k] : offs[k + 1]].tolist()
        assert own == codec.other.encode(t) and codec.decode([own])[0] == codec.decode_flat(np.array(own, np.int32), np.array([0, len(own)]))[0]


def test_op10_against_plain(spark, texts):
    got = run(spark, "op10_benchmark_decontamination")
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = alnum(r["text"])
        k = min(decontam.NGRAM, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(r["item_id"]))
    sizes = {len(g) for g in windows}
    for i, t in texts.items():
        w, hit, items = alnum(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    items |= windows[g]
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_pipeline_against_its_parts(spark, docs, texts):
    """run() keeps the documents that the operators' decisions, applied one after the other in plain Python, keep."""
    import corpus_pipeline

    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    judged = langid.identify(docs, langid.train(langid.training_rows(docs))).collect()
    left = {r["doc_id"] for r in judged if not r["rejected"]}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from stridekit.llm import quality

    some = docs.where(F.col("doc_id").isin(sorted(left)))
    good = quality.score(some, quality.train(some, quality.training_labels(labels))).where("predicted = 1").collect()
    left = {r["doc_id"] for r in good}
    comp = brute_components({i: texts[i] for i in left})
    left = {i for i in left if comp[i][1] == i}
    windows = {tuple(w[a : a + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [alnum(r["text"])] for a in range(len(w) - 9)}
    left = {i for i in left if not any(tuple(w[a : a + 10]) in windows for w in [alnum(texts[i])] for a in range(len(w) - 9))}
    assert set(out) == left
    assert all(r["text"] == texts[i] and r["round_trip"] and r["parity"] for i, r in out.items())
