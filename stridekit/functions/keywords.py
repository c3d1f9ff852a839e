"""Keyword scoring, lexicon signals, message routing and label maps.

Keyword tables for classification are parameters (lists of
(class, weight, keyword)); the class order breaks ties. Matching is presence of
a substring of the lower-cased text (or whole word with ``mode='word'``), one
count per keyword. Compiled into one expression per class: one scan, no join,
no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- FIXED VALUES
# Class order for ties.
CLASS_ORDER = ["TITAN", "ORACLE", "PHANTOM", "SAGE", "MUSE", "EMPIRE", "GG"]
PRIMARY_WEIGHT, SECONDARY_WEIGHT = 3, 1
MIN_CLASS_SCORE = 3

# Sentiment lexicon. "want to stop" appears twice and counts twice.
STRUGGLING_PHRASES = [
    "falling behind", "give up", "giving up", "want to quit", "want to stop",
    "can't keep going", "can't do this", "nothing works", "doesn't work",
    "no motivation", "zero motivation", "lost motivation", "burned out",
    "burnt out", "bad day", "rough day", "terrible day", "hard day",
    "hate myself", "hate this", "want to stop", "ready to quit",
]
STRUGGLING_WORDS = [
    "exhausted", "exhausting", "hopeless", "overwhelmed", "depressed",
    "burnout", "stuck", "failing", "failure", "worthless", "pointless",
    "useless", "unmotivated", "drained", "struggling", "broken", "slipping",
    "relapsed", "missed", "skipped", "failed", "anxious", "anxiety",
    "stressed", "stress", "crying", "behind",
]
MOTIVATED_PHRASES = [
    "crushed it", "killed it", "nailed it", "beast mode", "on fire",
    "let's go", "lets go", "no excuses", "personal best", "personal record",
    "new record", "best ever", "leveled up", "levelled up", "all in",
    "showing up", "30-day streak", "best day", "great day",
]
MOTIVATED_WORDS = [
    "unstoppable", "hyped", "pumped", "incredible", "accomplished",
    "milestone", "proud", "gains", "winning", "motivated", "energized",
    "energised", "excited", "smashed", "destroyed", "awesome", "fantastic",
    "streak", "pr",
]

# Message-mode routing keywords (substring of the lower-cased message).
XP_KEYWORDS = ["xp", "exp", "points", "earn", "cap", "streak", "multiplier",
               "how much", "calculate", "formula", "daily", "limit", "activities"]
BUILD_KEYWORDS = ["build", "switch", "change", "legendary", "badge", "unlock",
                  "secondary", "archive", "new build", "which build"]
MOTIVATION_KEYWORDS = ["tired", "can't", "cant", "unmotivated", "lazy", "skip",
                       "give up", "giving up", "quit", "hard", "struggling",
                       "failed", "missed", "feel like"]

# Label maps.
EMOTION_TO_CLASS = [("sadness", "struggling"), ("fear", "struggling"), ("anger", "struggling"),
                    ("joy", "motivated"), ("love", "neutral"), ("surprise", "neutral")]
GO_STRUGGLING = ["sadness", "grief", "fear", "nervousness", "disappointment",
                 "remorse", "embarrassment", "disgust", "annoyance", "disapproval"]
GO_MOTIVATED = ["admiration", "amusement", "excitement", "gratitude", "joy",
                "love", "optimism", "pride", "relief"]
MOTIVATED_TAGS = ["inspirational", "motivation", "success", "courage", "achievement",
                  "confidence", "determination", "perseverance", "strength", "goals",
                  "winning", "victory", "champion", "power", "ambition"]
STRUGGLING_TAGS = ["sadness", "struggle", "grief", "depression", "pain", "failure",
                   "loss", "fear", "doubt", "despair", "difficult", "adversity"]
SENTIMENT_LABELS = ["neutral", "motivated", "struggling"]
# ------------------------------------------------------------ END FIXED VALUES


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def count_present(lower_text: Column, keywords: list[str], mode: str = "substring") -> Column:
    """Number of keywords present (each counted once; duplicates in the list count again)."""
    # Plain expressions, no lambda over an array of keywords: a lambda that
    # refers to the text would re-evaluate it (e.g. lower()) per keyword, while
    # subexpression elimination shares it across these terms.
    if not keywords:
        return F.lit(0)
    total = F.lit(0)
    for k in keywords:
        hit = lower_text.rlike(word_pattern(k)) if mode == "word" else F.contains(lower_text, F.lit(k))
        total = total + F.when(hit, 1).otherwise(0)
    return total


def word_pattern(word: str) -> str:
    """The word between Python's word boundaries, spelled out: engines differ in what ``\\b`` takes for a letter."""
    return r"(^|[^\p{L}\p{N}_])" + re.escape(word) + r"([^\p{L}\p{N}_]|$)"


def any_present(lower_text: Column, keywords: list[str]) -> Column:
    """Any keyword is a substring."""
    out = None
    for k in keywords:
        c = F.contains(lower_text, F.lit(k))
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


def class_scores(text: Column, table: list[tuple[str, int, str]], mode: str = "substring") -> dict[str, Column]:
    """Per class, the sum of weights of the keywords present."""
    lower = F.lower(text)
    by_class: dict[str, dict[int, list[str]]] = {}
    for cls, w, kw in table:
        by_class.setdefault(cls, {}).setdefault(w, []).append(kw)
    out = {}
    for cls, groups in by_class.items():
        expr = F.lit(0)
        for w, kws in groups.items():
            expr = expr + count_present(lower, kws, mode) * F.lit(w)
        out[cls] = expr.cast("int")
    return out


def best_class(scores: dict[str, Column], order: list[str] = CLASS_ORDER, min_score: int = MIN_CLASS_SCORE) -> Column:
    """Arg-max class; ties to the first class in ``order``; below ``min_score`` -> NULL."""
    cands = [F.struct(scores[c].alias("score"), F.lit(-i).alias("neg_order"), F.lit(c).alias("cls"))
             for i, c in enumerate(order) if c in scores]
    best = F.greatest(*cands) if len(cands) > 1 else cands[0]
    return F.when(best["score"] >= min_score, best["cls"])


def lexicon_hits(text: Column) -> tuple[Column, Column]:
    """(struggling hits, motivated hits): phrases as substrings, words on word boundaries."""
    lower = F.lower(text)
    s = count_present(lower, STRUGGLING_PHRASES) + count_present(lower, STRUGGLING_WORDS, "word")
    m = count_present(lower, MOTIVATED_PHRASES) + count_present(lower, MOTIVATED_WORDS, "word")
    return s.cast("int"), m.cast("int")


def lexicon_class(s_hits: Column, m_hits: Column) -> tuple[Column, Column]:
    """Strictly larger side wins with its hit count; tie or none -> (NULL, 0)."""
    cls = F.when(s_hits > m_hits, F.lit("struggling")).when(m_hits > s_hits, F.lit("motivated"))
    hits = F.when(s_hits > m_hits, s_hits).when(m_hits > s_hits, m_hits).otherwise(F.lit(0))
    return cls, hits.cast("int")


def route_message(message: Column, sentiment: Column | None = None) -> Column:
    """Motivation > build_advisor > xp_coach > general; 'struggling' sentiment forces motivation."""
    msg = F.lower(message)
    mot = any_present(msg, MOTIVATION_KEYWORDS)
    if sentiment is not None:
        mot = (F.coalesce(sentiment, F.lit("")) == "struggling") | mot
    return (
        F.when(mot, F.lit("motivation"))
        .when(any_present(msg, BUILD_KEYWORDS), F.lit("build_advisor"))
        .when(any_present(msg, XP_KEYWORDS), F.lit("xp_coach"))
        .otherwise(F.lit("general"))
    )


def emotion_to_class(label: Column) -> Column:
    """Single emotion -> class, default neutral."""
    m = F.create_map(*[x for a, b in EMOTION_TO_CLASS for x in (F.lit(a), F.lit(b))])
    return F.coalesce(m[label], F.lit("neutral"))


def emotion_set_to_class(labels: Column) -> Column:
    """Struggling set beats motivated set, else neutral."""
    return (
        F.when(F.arrays_overlap(labels, _arr(GO_STRUGGLING)), F.lit("struggling"))
        .when(F.arrays_overlap(labels, _arr(GO_MOTIVATED)), F.lit("motivated"))
        .otherwise(F.lit("neutral"))
    )


def tags_to_class(tags: Column) -> Column:
    """Tags lower-cased, '-' -> ' '; motivated beats struggling, else neutral."""
    t = F.transform(tags, lambda x: F.replace(F.lower(x), F.lit("-"), F.lit(" ")))
    return (
        F.when(F.arrays_overlap(t, _arr(MOTIVATED_TAGS)), F.lit("motivated"))
        .when(F.arrays_overlap(t, _arr(STRUGGLING_TAGS)), F.lit("struggling"))
        .otherwise(F.lit("neutral"))
    )
