"""Text helpers and order-dependent curation rules on literal rows."""

from pyspark.sql import functions as F

from stridekit.functions import keywords as KW
from stridekit.functions import text as T
from stridekit.operators import corpus as C


def _v(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("r")).first().r


def test_clean_text(spark):
    assert _v(spark, T.clean_text(F.col("t")), "‘Hi’ “there” — café…  \n x ") == "'Hi' \"there\" - cafe... x"


def test_clean_post(spark):
    s = "**Bold** and *it* &amp; link http://x.y/z ok\n\n\n\nend"
    assert _v(spark, T.clean_post(F.col("t")), s) == "Bold and it & link  ok\n\nend"
    assert _v(spark, T.clean_post(F.col("t")), " [deleted] ") == ""


def test_cut_at_word(spark):
    long = "word " * 300
    out = _v(spark, T.cut_at_word(F.col("t"), 800), long)
    assert out.endswith("...") and len(out) <= 803 and not out[:-3].endswith(" ")
    assert _v(spark, T.cut_at_word(F.col("t"), 800), "x" * 900) == "x" * 800 + "..."


def test_chat_markup(spark):
    df = spark.createDataFrame([("<s>[INST] <<SYS>> sys <</SYS>> How to squat? [/INST] Keep your back straight. </s>",)], "t string")
    q, a = T.split_chat_markup(F.col("t"))
    r = df.select(q.alias("q"), a.alias("a")).first()
    assert r.q == "How to squat?" and r.a == "Keep your back straight."


def test_transcript_and_last_exchange(spark):
    df = spark.createDataFrame([(1, "Student: (greeting) hi there|EOM|Teacher: hello|EOM||EOM|Student: why?|EOM|Teacher: because", "Solve x")],
                               "id int, tr string, p string")
    r = C.transcript_pairs(df, "id", "tr", "p").orderBy("turn_pos").collect()
    assert [(x.user, x.assistant) for x in r] == [("Math problem: Solve x\n\nStudent: (greeting) hi there", "hello"), ("why?", "because")]
    blob = spark.createDataFrame([(1, "Customer: hi\nSalesman: hello\nCustomer: price?\nthanks\nSalesman: It costs ten dollars per month.")], "id int, b string")
    e = C.last_exchange(blob, "id", "b").first()
    assert e.user == "price?" and e.assistant == "It costs ten dollars per month."


def test_sanitize_and_fallback(spark):
    assert _v(spark, T.sanitize_key(F.col("t")), "us er/../1_a-b") == "user1_a-b"
    df = spark.createDataFrame([(" ", "b", "c")], "a string, b string, c string")
    assert df.select(T.first_nonempty("a", "b", "c").alias("r")).first().r == "b"


def test_cascade_equals_sequential(spark):
    texts = ["run fast", "lift heavy", "run and lift", "calm mind", "run again", "lift again", "calm run"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_no int, text string")
    stages = [("PHANTOM", ["run"], 2), ("TITAN", ["lift"], 2), ("SAGE", ["calm"], 1)]
    got = {r.row_no: r["class"] for r in C.cascade(df, F.col("text"), stages, ["row_no"]).collect()}
    counts, want = {}, {}
    for i, t in enumerate(texts):  # the rule, row by row
        for cls, kws, q in stages:
            if counts.get(cls, 0) < q and any(k in t for k in kws):
                want[i] = cls
                counts[cls] = counts.get(cls, 0) + 1
                break
    assert got == want


def test_topup_sources_in_order(spark):
    cur = spark.createDataFrame([("A", 95), ("B", 200)], "class string, n long")
    cand = spark.createDataFrame([(i, "A", 1 if i < 300 else 2, i, 250) for i in range(600)] + [(1000 + i, "B", 1, i, 10) for i in range(5)],
                                 "doc_id long, class string, source_order int, row_no long, max_samples int")
    out = C.need_based_topup(cur, cand, target=100, extra=200)
    per = {(r["class"], r.source_order): r["count"] for r in out.groupBy("class", "source_order").count().collect()}
    # A needs 5: first source gives min(5+200, 250, 300) = 205; then A is at 300 >= 100, second source gives 0
    assert per == {("A", 1): 205}


def test_oversample_draws(spark):
    df = spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(40)], "doc_id long, label string")
    out = C.oversample(df, "label", "x", "doc_id", 0.12)
    assert out.where("label = 'x'").count() == int(40 * 0.12)
    assert out.where("label = 'y'").count() == 37


def test_dedup_first_wins_keeps_earliest(spark):
    df = spark.createDataFrame([(1, "A", "s2", "same text"), (2, "A", "s1", "same text"), (3, "B", "s1", "same text")],
                               "doc_id int, class string, source string, user string")
    got = sorted(r.doc_id for r in C.dedup_first_wins(df, ["class"], F.substring("user", 1, 100), ["source", "doc_id"]).collect())
    assert got == [2, 3]


def test_label_maps(spark):
    df = spark.createDataFrame([(["Inspirational", "sadness"], ["joy", "grief"], "fear")], "tags array<string>, emo array<string>, e string")
    r = df.select(KW.tags_to_class(F.col("tags")).alias("t"), KW.emotion_set_to_class(F.col("emo")).alias("s"),
                  KW.emotion_to_class(F.col("e")).alias("m")).first()
    assert (r.t, r.s, r.m) == ("motivated", "struggling", "struggling")


def test_lexicon_duplicate_counts_twice(spark):
    df = spark.createDataFrame([("i want to stop",)], "t string")
    s, m = KW.lexicon_hits(F.col("t"))
    assert df.select(s.alias("s")).first().s == 2


def test_sequential_dedup_quota_matches_row_by_row(spark):
    import random

    random.seed(5)
    sources = ["s1", "s2", "s3"]
    rows = [(i, random.choice(sources), random.choice("ABCDEFGH"), random.choice(["x", "y"])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_no int, source string, k string, cls string")
    got = sorted(r.row_no for r in C.sequential_dedup_quota(df, "source", sources, F.col("k"), "cls", 3, ["row_no"]).collect())
    want, seen = [], set()
    for s in sources:  # the rule, source by source, row by row
        counts, seen_here = {}, set()
        for row_no, src, k, cls in sorted(r for r in rows if r[1] == s):
            if k in seen or k in seen_here:
                continue
            seen_here.add(k)  # first row of a key in this source decides it
            if counts.get(cls, 0) < 3:
                counts[cls] = counts.get(cls, 0) + 1
                want.append(row_no)
        seen |= {k for row_no, src, k, cls in rows if row_no in want}
    assert got == sorted(want)


def test_strip_takes_all_whitespace_at_the_ends_without_a_regex(spark):
    from stridekit.functions import text as T

    rows = [("",), (None,), (" ",), ("a b",), ("\u3000\u2003\x1f a\u00a0b\n\x85",), ("\u200b x \u180e",), ("\t\r\n",), ("\U0001f600 ",)]
    rows += [(f"{c}x{c}y{c}",) for c in map(chr, range(1, 0x3100))]
    df = spark.createDataFrame(rows, "x string").select("x", T.py_strip("x").alias("got"))
    assert all(r["got"] == (r["x"] if r["x"] is None else r["x"].strip()) for r in df.collect())
    assert "regexp" not in df._jdf.queryExecution().executedPlan().toString()
