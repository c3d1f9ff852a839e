"""op6 keeps n-grams of every count, however many tokens there are, and whatever the blocks and buckets."""

import random
import re

import numpy as np
import pytest

from stridekit.llm import lm

from .test_values import plain_lm


def texts():
    rng = random.Random(5)
    rare = [f"w{i}" for i in range(400)]
    rows = {i: " ".join(rng.choice(rare) for _ in range(40)) for i in range(120)}
    rows |= {i + 200: rows[i] for i in range(40)}  # some trigrams occur twice
    return rows | {400: None, 401: "", 402: "one", 403: "the end"}


def check(spark, rows):
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, x in plain_lm(rows, 0).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:3]
        assert (r["base_score"], r["score"]) == (pytest.approx(x[3], rel=1e-8), pytest.approx(x[4], rel=1e-8))


def test_rare_ngrams_count_in_a_large_corpus(spark):
    check(spark, texts() | {i: "la la li la " * 20_000 for i in range(1000, 1020)})


@pytest.mark.parametrize("block,bucket", [(60, 500), (1, 10_000)])
def test_many_blocks_and_buckets(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(lm, "_BLOCK", block)
    monkeypatch.setattr(lm, "_BUCKET", bucket, raising=False)
    check(spark, texts())


def test_high_bytes_of_keys_pack_beside_random_low_ones():
    """Ascending random keys take little more than their differences' information."""
    rng = np.random.default_rng(1)
    for n in (1, 700, 43_000):
        keys = np.unique(rng.integers(0, 1 << 57, n, dtype=np.uint64))
        packed = lm._pack_keys(keys)
        assert (lm._unpack_keys(packed) == keys).all()
        assert len(packed) < 100 + (57 - np.log2(n) + 1.44) / 8 * n * 1.03
    for x in ([], [0], [0] * 9, [255], [256, 0], [(1 << 64) - 1, 5]):
        assert lm._unpack(lm._pack(np.array(x, np.uint64))).tolist() == x


def test_answers_are_shuffled_to_their_blocks_once(spark, capsys):
    """The last step reads the exchanges of the answers again, through the union."""
    lm.score_documents(spark.createDataFrame(list(texts().items()), "doc_id long, text string")).explain()
    plan = capsys.readouterr().out
    above = plan[: plan.index("Union")].splitlines()[-4:]
    assert not any(re.search(r"Exchange hashpartitioning\(block", x) for x in above)
