"""Dialogue extraction edge cases on literal rows."""

from stridekit.operators import corpus as C


def test_post_best_comment_rules(spark):
    posts = spark.createDataFrame([
        (1, "How to train?", "x" * 700, 12, True),
        (2, "Low score", "", 3, True),           # score < 10: dropped
        (3, "Link only", "", 50, False),         # link post without text: dropped
        (4, "No comments", "", 20, True),        # no qualifying comment: dropped
    ], "post_id long, title string, selftext string, score long, is_self boolean")
    long_a, long_b = "a" * 80, "b" * 80
    comments = spark.createDataFrame([
        (1, 1, long_a, 5), (1, 2, long_b, 5),    # tie on score: earlier position wins
        (1, 3, "short", 99),                     # too short
        (1, 4, "c" * 90, 0),                     # score 0
        (4, 1, "tiny", 5),
    ], "post_id long, pos long, body string, score long")
    out = C.post_best_comment(posts, comments).collect()
    assert [r.post_id for r in out] == [1]
    r = out[0]
    assert r.answer == long_a and r.answer_score == 5
    assert r.question == "How to train?\n\n" + "x" * 600


def test_child_without_parent_and_lang(spark):
    msgs = spark.createDataFrame([
        (1, None, "user", "hi there", "en"),
        (2, 1, "assistant", "hello, how can I help", None),  # missing lang counts as en
        (3, 99, "assistant", "orphan reply", "en"),           # parent missing: dropped
        (4, 1, "assistant", "bonjour", "fr"),                 # not English: dropped
    ], "mid long, parent long, role string, text string, lang string")
    out = C.parent_child_pairs(msgs, "mid", "parent", lang="lang").collect()
    assert [(r.message_id, r.user) for r in out] == [(2, "hi there")]
