"""Every branch of the rules is entered by the registered queries' rows (sf0.01)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

from .conftest import SF01


def values(spark, query, column):
    return {r[0] for r in E.queries()[query](spark, SF01).select(column).distinct().collect()}


@pytest.mark.parametrize(
    "query,column,wanted",
    [
        ("dialogue_lexicon", "lex_class", {"struggling", "motivated", None}),
        ("dialogue_routing", "mode", {"motivation", "build_advisor", "xp_coach", "general"}),
        ("dialogue_persona_retag", "persona", {"GENERIC", "TITAN"}),
        ("sentiment_prior_blend", "flag", {"support_mode", "hype_mode"}),
        ("activity_build_switch", "reason", {None, "Must reach Legendary badge first.", "Secondary build slot already active."}),
        ("activity_build_switch", "success", {True, False}),
        ("labels_single_emotion", "label", {"neutral", "motivated", "struggling"}),
        ("labels_emotion_set", "label", {"neutral", "motivated", "struggling"}),
        ("labels_tags", "label", {"neutral", "motivated", "struggling"}),
    ],
)
def test_branches(spark, query, column, wanted):
    assert wanted <= values(spark, query, column)


def test_oversampling_draws_and_override(spark):
    rows = E.queries()["corpus_oversample"](spark, SF01)
    assert rows.count() > rows.select("doc_id").distinct().count()
    hits = E.queries()["sentiment_prior_blend"](spark, SF01).select(F.greatest("s_hits", "m_hits").alias("h")).distinct().collect()
    assert {0, 1, 3} <= {r["h"] for r in hits}
