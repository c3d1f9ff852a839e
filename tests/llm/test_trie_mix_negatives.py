"""Conversation trie, source mixing and hard negatives against plain versions, and on odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridekit.llm import mixing, negatives, turntrie

from .helpers import empty, odd, odd_rows, spaced


# ---------------------------------------------------------------------- trie

def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        paths[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(spaced(path[-1][1])) if path else 0
        below[path] = (0 if kids[path] else 1) + sum(below[k][0] for k in kids[path]), own + sum(below[k][1] for k in kids[path])
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in m if paths[c] == path)
        out.append((m[0], len(path), members[path[:-1]][0] if path else None, len(m), len(kids[path]), *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def test_trie_equals_the_plain_one(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for c in [*range(-25, 130), 400, 401, 2**40]:
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t, "user" if t % 2 else None, rng.choice(["yes", "no", "a b  c", "", None])) for t in range(n)]
    for c in range(200, 240):  # one long conversation in many copies, cut off and changed at different depths, over several segments
        n = rng.choice([31, 32, 33, 64, 64, 65, 90, 100])
        rows += [(c, t, "user", f"word {t}" if t < 70 or c % 3 else f"other {t}") for t in range(n)]
    for c in range(300, 380):  # many equal ones
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    got = sorted((tuple(r) for r in turntrie.prefix_trie(trie_rows(spark, rows)).collect()), key=str)
    assert got == plain_trie(rows)
    monkeypatch.setattr(turntrie, "IDS_A_PIECE", 2)
    assert sorted((tuple(r) for r in turntrie.prefix_trie(trie_rows(spark, rows)).collect()), key=str) == got


def test_trie_bears_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, -3, "a", "b"), (2, 5, "", ""), (2, 5, "", ""), (20, 0, "user", "x " * 50_000), (39, None, None, None)]
    got = sorted((tuple(r) for r in turntrie.prefix_trie(trie_rows(spark, rows)).collect()), key=str)
    assert got == plain_trie(rows)
    assert turntrie.prefix_trie(trie_rows(spark, rows).limit(0)).count() == 0
    extra = trie_rows(spark, rows).withColumns({"p": F.lit("clash"), "a": F.lit(1), "w": F.lit(None)})
    assert sorted((tuple(r) for r in turntrie.prefix_trie(extra).collect()), key=str) == got


def test_trie_of_conversations_as_they_are(spark):
    rows = [(c, t, "u", f"{t if t < 3 else c}") for c in range(6) for t in range(4)]
    got = {(r["depth"], r["conv_id"]): r for r in turntrie.trie(turntrie.whole(turntrie.turns(trie_rows(spark, rows)))).collect()}
    assert len(got) == 1 + 3 + 6 and got[3, 0]["n_children"] == 6 and got[0, 0]["n_leaves"] == 6 and got[0, 0]["saved_tokens"] == 15


# -------------------------------------------------------------------- mixing

@pytest.mark.parametrize("seed", range(30))
def test_fit_is_the_best_of_all_choices(seed):
    rng = random.Random(seed)
    length = np.array(rng.sample(range(1, 40), rng.randint(1, 4)))
    count = np.array([rng.randint(1, 3) for _ in length])
    budget = rng.randint(0, int(length @ count) + 5)
    take = mixing.fit_budget(length, count, budget)
    assert (take >= 0).all() and (take <= count).all()
    best = min(abs(sum(n * l for n, l in zip(ns, length)) - budget) for ns in itertools.product(*(range(c + 1) for c in count)))
    assert abs(int(take @ length) - budget) == best


def test_a_large_budget_is_spread_over_all_lengths():
    rng = np.random.default_rng(5)
    length = np.unique(rng.integers(1, 5000, 600))
    count = rng.integers(1, 400, len(length))
    budget = int(length @ count) // 3
    take = mixing.fit_budget(length, count, budget)
    assert int(take @ length) == budget and (take <= count).all()
    share = take.sum() / count.sum()
    assert 0.3 < share < 0.37 and abs(take[length > 2500].sum() / count[length > 2500].sum() - 1 / 3) < 0.02


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in stopped)
        free = sum(weight[s] for s in order if s not in stopped)
        over = {s for s in order if s not in stopped and rest * weight[s] / free > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else rest * weight[s] / free for s in order}
        stopped |= over


def check_mix(got, size_of):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += size_of(r)
        taken[r["source"]] += r["taken"]
        assert r["size"] == size_of(r) and 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    aims = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], aims[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    return aims, taken, sizes


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "é", "\U0001f600", "", None]), " ".join(["w"] * rng.choice([0, 1, 1, 2, 7, 7, 40, 333]))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    sized = docs.select("*", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(sized, F.col("size"))
    got = mixed.collect()
    aims, taken, _ = check_mix(got, lambda r: len(spaced(r["text"])))
    assert len(got) == len(rows) and all(abs(taken[s] - aims[s]) <= 0.5 for s in aims)
    again = mixing.mix(sized.repartition(3), F.col("size")).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    out = mixing.repeated(mixed)
    assert out.columns == sized.columns and out.count() == sum(r["copies"] for r in got)
    spread = mixing.mix(sized, F.col("size"), window=2000).collect()  # the proportional part as well
    aims, taken, _ = check_mix(spread, lambda r: len(spaced(r["text"])))
    assert all(abs(taken[s] - aims[s]) <= 0.5 for s in aims)


def test_mix_bears_odd_rows(spark):
    got = mixing.mix(odd(spark).select("*", mixing.n_words(F.col("text")).alias("size"), F.lit("clash").alias("target"), F.lit(7).alias("h")), F.col("size")).collect()
    assert len(got) == len(odd_rows()) and {r["score"] for r in got} == {"clash"} and {r["h"] for r in got} == {7}
    check_mix(got, lambda r: len(spaced(r["text"])))
    assert {r["target"] for r in mixing.mix_documents(odd(spark).where("doc_id = 0")).collect()} == {0.0}
    assert mixing.mix_documents(empty(spark)).count() == 0


# ----------------------------------------------------------------- negatives

def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for dims, top in ((1, 3), (8, 200), (13, 2**20), (150, 100), (64, 2**27)):
        a, c = rng.integers(-top, top, (9, dims)), rng.integers(-top, top, (1100, dims))
        planes = negatives.pack(c)
        assert (negatives.unpack(planes)[:, :dims] == c).all()
        v = negatives.unpack(negatives.pack(a))
        got = np.concatenate([s for _, s in negatives.scores(np.ascontiguousarray(planes.transpose(1, 2, 0)), v)])
        assert (got == c @ a.T).all()


def plain_negatives(rows):
    fit = []
    for i, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        limit = math.isqrt((2**63 - 1) // (100 * max(len(vector), 1)))
        fit.append((i, label, [max(-limit, min(limit, math.floor(256 * x))) for x in vector]))
    out = []
    for k, (i, label, v) in enumerate(fit):
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, c)), j is None, j or 0, other) for m, (j, other, c) in enumerate(fit) if m != k))
        for p in [s for s in scored if s[3] == label][:5]:
            within = [s for s in scored if s[3] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(i, None if p[1] else p[2], n + 1, None if s[1] else s[2], -p[0], -s[0]) for n, s in enumerate(within)]
    return sorted(out, key=str)


VECTORS = "vec_id long, label int, embedding array<float>"


def mined(df, **how):
    return sorted((tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **how).collect()), key=str)


def test_negatives_equal_the_plain_ones(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 2), [rng.choice([-0.5, 0.25, 0.3, 0.9]) for _ in range(6)]) for i in range(0, 1500, 5)]
    rows += [(i, 1, [0.9] * 6) for i in range(3000, 3040)] + [(i, 0, [0.9] * 6) for i in range(3100, 3140)]  # ties
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    want = plain_negatives(rows)
    assert len(want) > 100 and mined(df) == want
    assert mined(df, anchors_a_pass=4) == want  # several passes


def test_negatives_bear_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (1, 1, [1.0]), (2, 2, [0.9, 0.99, 5.0]), (3, 2, []), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [1.0, nan]),
            (8, 1, [inf, 1.0]), (None, 2, [0.95, 0.95]), (None, 1, [0.9, 0.9]), (100, 3, [3e38, -3e38]), (101, 3, [3e38, -3e38]), (102, 4, [3e38, -2.9e38]), (200, 5, []), (201, 5, []), (202, 6, []),
            (300, 9, [1.0] * 3000), (301, 9, [1.0] * 3000), (302, 8, [0.99] * 3000), (-100, 1, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert mined(df.withColumns({"row": F.lit("clash"), "planes": F.lit(1), "anchor": F.lit(None)})) == plain_negatives(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id = 1")) == []
