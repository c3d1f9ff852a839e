"""Splits by selected hashes, keyword tables by automaton, entities and word boundaries, against plain versions."""

import hashlib
import html
import html.entities
import random
import re

import pytest
from pyspark.sql import functions as F

from stridekit.functions import keywords as KW
from stridekit.functions import text as T
from stridekit.operators import automaton as AU
from stridekit.operators import corpus as C
from stridekit.operators import selection as SEL


@pytest.mark.parametrize("bucket_rows", [50_000, 2])
def test_cuts_are_the_kth_hashes(spark, bucket_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), hashlib.md5(str(i).encode()).hexdigest()) for i in range(900)]
    rows += [("c", "00000000" + hashlib.md5(str(i).encode()).hexdigest()[8:]) for i in range(20)] + [("d", "f" * 32)]
    df = spark.createDataFrame(rows, "g string, h string").checkpoint()
    for k in (F.floor(F.col("n") * 0.9), F.lit(7), F.lit(0), F.lit(10**6), F.lit(1)):
        got = {r["g"]: r["cut"] for r in SEL.cuts(df, ["g"], "h", k, bucket_rows).collect()}
        for g in ("a", "b", "c", "d", None):
            hs = sorted(h for x, h in rows if x == g)
            n = spark.range(1).select(F.lit(len(hs)).cast("long").alias("n")).select(F.least(k.cast("long"), F.col("n"))).first()[0]
            assert sum(h <= got[g] for h in hs) == n


def test_splits_keep_all_rows_and_sizes(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"c{i % 3}", "x" * i) for i in range(200)], "id long, cls string, text string").repartition(4)
    got = C.split_per_class(df, "cls", "id")
    assert got.columns == ["id", "cls", "text", "split"] and got.count() == 200
    for r in got.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("split") == "train", 1)).alias("t")).collect():
        assert r["t"] == int(0.9 * r["n"])
    one = C.global_split(df, "id")
    assert one.where("split = 'train'").count() == 180
    first = sorted(range(200), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:180]
    assert {r["id"] for r in one.where("split = 'train'").collect()} == set(first)
    assert C.split_per_class(df.limit(0), "cls", "id").count() == 0 and C.split_per_class(df.where("id = 5"), "cls", "id").first()["split"] == "train"
    assert C.stratified_split(df, "cls", "id", 0.2).where("split = 'test'").count() == sum(-(-n // 5) for n in (29, 57, 57, 57))


TABLE = [("TITAN", 3, "rep"), ("TITAN", 1, "re"), ("ORACLE", 3, "set"), ("ORACLE", 3, "set"), ("MUSE", 1, "MVP"), ("GG", 3, "é"), ("SAGE", 1, ""), ("SAGE", 1, "a b")]


def plain_scores(text, mode):
    t = (text or "").lower()
    hit = (lambda k: k in t) if mode == "substring" else (lambda k: k == "" or re.search(r"\b" + re.escape(k) + r"\b", t))
    return {c: sum(w for cls, w, k in TABLE if cls == c and hit(k)) for c in KW.CLASS_ORDER}


@pytest.mark.parametrize("mode", ["substring", "word"])
def test_automaton_equals_the_plain_rule(spark, mode):
    rng = random.Random(5)
    texts = [None, "", "Reps and sets", "rep", "resets é", "caféé a b", "mvp MVP", "é", "xéx", "set_", "set-rep re"] + ["".join(rng.choice("resta pébA ") for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r["id"]: r for r in AU.classify(df, F.col("text"), TABLE, mode=mode).collect()}
    for i, t in enumerate(texts):
        want = plain_scores(t, mode)
        assert {c: got[i][f"score_{c}"] for c in KW.CLASS_ORDER} == want
        best = max(KW.CLASS_ORDER, key=lambda c: want[c])
        assert got[i]["best_class"] == (best if want[best] >= 3 else None)
    if mode == "substring":
        plain = [x for x in TABLE if x[2]]
        a = AU.classify(df, F.col("text"), plain).select("id", *[f"score_{c}" for c in ("TITAN", "ORACLE", "GG", "SAGE", "MUSE")])
        b = C.classify(df.withColumn("text", F.coalesce("text", F.lit(""))), F.col("text"), plain).select(*a.columns)
        assert a.exceptAll(b).count() == 0
    assert AU.classify(df, F.col("text"), []).where("best_class IS NOT NULL").count() == 0


def test_entities_equal_the_html5_rules(spark):
    names = list(html.entities.html5)
    texts = [f"a&{n} b" for n in names] + [f"&{n}x" for n in names if not n.endswith(";")]
    texts += ["&amp;lt;", "&#39;&#x27;&#128;&#0;&#xD800;&#1114112;&#13;", "& &; &#; &#x; &unknown; &notit; &nbsp", "no entity", None, "&" * 50]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", T.html_unescape("t").alias("u"), F.col("t")).collect()
    assert all(r["u"] == (None if r["t"] is None else html.unescape(r["t"])) for r in got) and len(got) == len(texts)


def test_words_stand_between_python_boundaries(spark):
    texts = ["stuck", "unstuck", "stucké", "é stuck", "éstuck", "stuck_up", "(stuck)", "stuck\n", "x\nstuck", "stuck²", "stuck-in", "STUCK"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", KW.count_present(F.lower("t"), ["stuck"], "word").alias("n")).collect()}
    assert got == {t: int(bool(re.search(r"\bstuck\b", t.lower()))) for t in texts}


def test_bio_follows_the_rule(spark):
    rows = [("System.", " pirate "), ("System.", None), ("System.", "  "), (None, "x"), (" S ", "y")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, b string").select(C.append_bio(F.col("s"), F.col("b"))).collect()]
    lead = "Speak in the style of this character: "
    assert got == [f"System. {lead}pirate", "System.", "System.", f"{lead}x", f"S  {lead}y"]
