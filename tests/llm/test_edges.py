"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stridekit.llm import decontam, langid, licenses, lm, neardup, pieces, quality, sharding, simhash, urls

from .helpers import PLAIN, alnum, empty, odd, odd_rows, spaced

N = len(odd_rows())


@pytest.fixture(scope="module")
def rows(spark):
    return odd(spark).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "lazy dog and runs far away from here today now"), (2, None), (3, ""), (4, "漢字"), (5, "lazy dog and runs far away from here today now")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, 0), (None, 1, 1), (999, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")


def test_langid(spark, rows):
    model = langid.train(rows)
    got = langid.identify(rows, model).collect()
    assert len(got) == N
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1 and (letters or (r["rejected"] and r["score"] == 0))
    assert {r["score"] for r in langid.identify(rows.where("lang = 'en' OR lang IS NULL"), langid.train(rows.where("lang = 'en'"))).where("lang_pred = 'en'").collect()} == {1.0}
    kept = langid.drop_rejected(rows, model)
    assert kept.columns == rows.columns and {r["score"] for r in kept.collect()} <= {"clash"}
    none = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(rows, none).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_neardup(spark, rows):
    got = neardup.near_duplicates(rows).collect()
    assert len(got) == N
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[1]["kept"]
    assert by[3]["n_shingles"] == 1 and by[5]["component_id"] == by[6]["component_id"] == by[7]["component_id"] == 5
    assert [r["component_id"] for r in got if r["doc_id"] is None and r["n_shingles"]] == [5]
    kept = neardup.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i, r in by.items() if r["kept"])
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_two_texts_under_one_id(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = spark.createDataFrame([(5, one), (5, two), (2, one + " now"), (3, two + " now")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(2, 2, True), (3, 3, True), (5, 2, False), (5, 3, False)]


def test_dropping_decides_on_rows(spark):
    """Rows without an id, two texts under one id, empty texts: one row of each class stays, and every empty one."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    docs = spark.createDataFrame(
        [(None, a), (None, a), (None, b), (None, b + " now"), (None, c), (7, c + " now"), (7, d), (7, d), (8, d + " now"), (9, e), (None, ""), (None, None), (4, " "), (4, " ")],
        "doc_id long, text string",
    ).repartition(3)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], (r["text"] or "").removesuffix(" now").strip()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (9, e), (None, ""), (None, ""), (4, ""), (4, "")], key=str)


def test_quality(spark, rows, labels):
    model = quality.train(rows, labels)
    got = quality.score(rows, model).collect()
    assert len(got) == N and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    blank = quality.train(rows, labels.limit(0))
    assert {round(r["score"], 9) for r in quality.score(rows, blank).collect()} == {0.5}
    assert quality.keep_good(rows, model).columns == rows.columns
    assert quality.score(empty(spark), model).count() == 0


def test_simhash(spark, rows):
    got = simhash.with_near_counts(simhash.fingerprint_digest(rows)).collect()
    assert len(got) == N and all(0 <= r["near_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {"0" * (simhash.BITS // 4)}
    one = simhash.fingerprint_digest(rows.where("doc_id = 7")).collect()
    assert one[0]["near_next"] == 1.0
    assert simhash.with_near_counts(simhash.fingerprint_digest(empty(spark))).count() == 0


def test_licenses(spark, rows):
    got = licenses.scan_documents(rows).collect()
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    assert len(got) == N and all(r["n_words"] == len(alnum(texts[r["doc_id"]])) for r in got if r["doc_id"] is not None)
    assert licenses.scan(rows).count() == N and licenses.scan_documents(empty(spark)).count() == 0


def test_lm(spark, rows):
    got = lm.score_documents(rows).collect()
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    assert len(got) == N and all(r["n_tokens"] == len(spaced(texts[r["doc_id"]])) + 1 for r in got if r["doc_id"] is not None)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    blank, counts = lm.train(empty(spark))
    assert {(r["base_score"], r["score"], r["n_known"]) for r in lm.score(rows.select("doc_id", "text"), blank, counts).collect()} == {(0.0, 0.0, 0)}
    assert lm.score_documents(empty(spark)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "no scheme/net/", "x"), (4, "http://A.NET/x", "x"), (4, "http://A.NET/x", "x"), (None, "http://b.org/fr/1?q=1&r=2#f", "x"), (6, "http://" + "a" * 100_000, "x"), (7, "http://q.com", "x"), (8, "x://example.net?u=http://z.net/", "x")],
        "page_id long, url string, score string",
    )
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert got[1]["host"] == got[2]["host"] == got[3]["host"] == "" and got[4]["rule"] == "net/" and got[None]["verdict"] == "allow"
    assert got[8]["host"] == "example.net" and got[8]["path"] == "" and got[8]["rule"] is None
    assert urls.filter_urls(pages).count() == 9 and urls.filter_urls(pages.limit(0)).count() == 0


def test_sharding(spark, rows):
    got = sharding.shard_documents(rows, [1.0] * 40).collect()
    assert len(got) == N and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert all(r["size"] >= 16 for r in got) and sharding.shard_documents(empty(spark), [1.0] * 40).count() == 0
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pieces(spark, rows):
    got = pieces.encode(rows).collect()
    assert len(got) == N and all(r["parity"] and r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in got)
    assert pieces.decode(pieces.encode(rows)).where("decoded <> coalesce(text, '')").count() == 0
    assert pieces.encode(empty(spark)).count() == 0


def test_decontam(spark, rows, bench):
    got = decontam.contamination(rows, bench).collect()
    assert len(got) == N
    hit = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in got if r["contaminated"]}
    assert hit == {7: (10, 2), 8: (1, 1)}
    split = decontam.contamination(rows, bench, max_broadcast=1).drop("spans")
    assert sorted(map(str, split.collect())) == sorted(map(str, decontam.contamination(rows, bench).drop("spans").collect()))
    for action in ("documents", "spans"):
        left = decontam.decontaminate(rows, bench, action=action)
        assert left.columns == rows.columns and decontam.contamination(left, bench).where("contaminated").count() == 0
        assert {r["spans"] for r in left.collect()} == {"clash"}
    cut = decontam.decontaminate(rows, bench, action="spans").where("doc_id = 7").first()["text"]
    assert cut == "the quick brown fox jumps over the "
    assert decontam.contamination(rows, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(empty(spark), bench).count() == 0


def test_pipeline_bears_odd_rows(spark, rows, bench, labels, tmp_path):
    for name, table in (("documents", rows), ("benchmark", bench), ("labels", labels)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert set(PLAIN) <= set(corpus_pipeline.run(spark, str(tmp_path)).columns)


def test_license_words_are_the_contracts_words():
    """White space other than what separates words belongs to words."""
    for text in ("mit license\u00a0x", "x\u00a0mit license", "\u0085mit license", "mit\u2003license"):
        assert licenses.detect(text.lower().encode())[0] == []
    found = licenses.detect("a MIT\n-- license, (apache) license\u00a0".encode())[0]
    assert [(f.label, f.first) for f in found] == [("mit", 1)]
    assert sorted((f.label, f.first) for f in licenses.detect(b"a MIT\n-- license, (apache) license.")[0]) == [("apache", 3), ("mit", 1)]


def test_license_suppression_equals_comparing_all():
    import random

    rng = random.Random(1)
    for _ in range(60):
        found = [licenses.Found(str(k), "name", rng.randrange(4), a := rng.randrange(30), a + rng.randint(1, 12), 1.0) for k in range(rng.randint(0, 40))]
        kept = []
        for x in sorted(found, key=lambda x: (x.priority, x.first - x.past, x.first)):
            if not any(k.first <= x.first and x.past <= k.past for k in kept):
                kept.append(x)
        assert licenses._unsuppressed(found, 45) == kept


def test_licenses_bear_much_license_text():
    import time

    began = time.time()
    base, kept = licenses.detect(b"mit license foo " * 95_000)
    assert len(base) == len(kept) == 95_000 and time.time() - began < 30


def test_every_license_rule_holds_its_gate():
    """Each license's own names, written out, come through the gate and are found."""
    for line in licenses.LICENSES.strip().splitlines():
        label, name, *_ = (c.strip() for c in line.split(";"))
        for word in licenses.literals(name):
            text = f"x {word.strip()} license y"
            if any(r.label == label and r.kind == "name" and r.pattern.search(text) for r in licenses.rules()):
                assert any(f.label == label for f in licenses.detect(text.encode())[1]) or licenses.detect(text.encode())[1], (label, text)


def test_pieces_remember_segments(spark, monkeypatch):
    """The same ids with no room for remembered segments, with little, and over several blocks."""
    texts = spark.createDataFrame([(i, f"some words again {i % 7} é中 " * (i % 5) + "x" * (40 * (i % 2))) for i in range(60)], "doc_id long, text string").coalesce(1)
    want = sorted((r["doc_id"], r["ids"], r["parity"], r["round_trip"]) for r in pieces.encode(texts).collect())
    assert all(r[2] and r[3] for r in want)
    codec = pieces.Codec(open(pieces.DEFAULT_MODEL, "rb").read())
    rows = [r["text"] for r in texts.orderBy("doc_id").collect()]
    for room in (0, 3, 1 << 16):
        monkeypatch.setattr(pieces, "CACHED_SEGMENTS", room)
        codec.known.clear()
        for _ in range(2):  # the second time out of what is remembered
            flat, offs, same = codec.encode(rows)
            assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [r[1] for r in want] and same.all()
        assert len(codec.known) <= room


def test_url_suffixes_are_counted_over_all_examples(spark):
    """Whatever the sample of the trees, every suffix of a ruled URL is counted, and its share reaches the trees."""
    from collections import Counter

    rows = [(i, f"http://h{i}.site{i % 40}.net/x{i}") for i in range(400)] + [(1000 + i, f"http://a.b{i % 7}.org/fr/{i}") for i in range(200)] + [(5000, "http://free.com/x"), (5001, None)]
    parts = urls.with_parts(spark.createDataFrame(rows, "page_id long, url string"))
    model = urls.train(parts, max_rows=10)
    known = [(".".join(u.split("/")[2].split(".")[-k:]), k, float(u.split("/")[2].endswith("net"))) for _, u in rows[:600] for k in (1, 2)]
    for k in (1, 2):
        got = {r["s"]: (r["b"], r["n"]) for r in model.suffixes[k - 1].collect()}
        n, b = Counter(s for s, j, _ in known if j == k), Counter()
        for s, j, y in known:
            b[s] += y if j == k else 0
        assert got == {s: (b[s], n[s]) for s in n}
    assert model.prior == pytest.approx(400.5 / 601)
    assert urls.judge(parts, model).count() == len(rows)


def test_columns_of_the_operators_names_are_kept_or_replaced(spark):
    """A user's columns with names that the operators use inside stay; those that they add are replaced."""
    names = ["_known", "_base", "_score", "_rare", "_row", "_log", "_seen", "f", "_f", "_part", "_at", "_of", "_before", "n_near", "fingerprint", "slot", "n_tokens", "score", "n_known"]
    docs = spark.createDataFrame([(i, f"some words {i % 2} again", *[f"mine{i}"] * len(names)) for i in range(6)], ", ".join(["doc_id long", "text string", *[f"{c} string" for c in names]]))

    def kept(df, replaced):
        rows = df.collect()
        assert len(rows) == 6 and len(df.columns) == len(set(df.columns))
        for r in rows:
            assert all(r[c] == f"mine{r['doc_id']}" for c in names if c not in replaced)
            assert all(not str(r[c]).startswith("mine") for c in replaced)
        return rows

    kept(lm.score(docs, *lm.train(docs)), {"n_tokens", "score", "n_known"})
    near = kept(simhash.with_near_counts(simhash.with_fingerprint(docs)), {"fingerprint", "n_near"})
    assert {r["n_near"] for r in near} == {2}
    slots = kept(sharding.with_slots(docs.withColumn("shard", F.when(F.col("doc_id") > 1, F.col("doc_id") % 2))), {"slot"})
    of = {}
    for r in slots:
        of.setdefault(r["shard"], []).append(r["slot"])
    assert {k: sorted(v) for k, v in of.items()} == {None: [0, 1], 0: [0, 1], 1: [0, 1]}


def test_the_shard_with_the_largest_weight_wins(spark):
    """The winner of every key, recomputed from the hashes of (key, shard) that Spark gives."""
    weights = [1.0, 2.5, 0.5, 4.0]
    keys = spark.range(300).select(F.col("id"), sharding.shard_of(F.col("id"), weights).alias("s"), F.xxhash64(F.col("id").cast("string")).alias("d"))
    rows = keys.select("id", "s", *[F.xxhash64("d", F.lit(i)).alias(f"h{i}") for i in range(len(weights))]).collect()
    for r in rows:
        scores = [w / -math.log((((r[f"h{i}"] % 2**64) >> 12) + 0.5) / 2**52) for i, w in enumerate(weights)]
        assert r["s"] == scores.index(max(scores))
    share = [sum(r["s"] == i for r in rows) / len(rows) for i in range(len(weights))]
    assert all(abs(x - w / sum(weights)) < 0.1 for x, w in zip(share, weights))
