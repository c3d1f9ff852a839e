"""Keyword tables by one multi-pattern automaton (D1, D2, B19 for tables of any size).

``functions.keywords`` turns a table into one ``contains`` a keyword, which suits a few; here a
text is passed once, whatever the number of keywords: an Aho-Corasick automaton, built once in
a worker, reports every occurrence, and the distinct keywords found are added up. The table
is a parameter: rows (class, weight, keyword), or a small DataFrame of them.

A keyword counts once a text, as a substring of the lower-cased text; with ``mode="word"`` it must stand between
word boundaries as Python's ``\\b`` has them. Upper-case keywords never match, an empty one always does, and one
that stands in several rows counts for each. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as KW

#: A table is sent to every worker; a larger one is a join, not a table of keywords.
MAX_KEYWORDS = 1_000_000


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


class Automaton:
    """Scores of texts by keyword table; classes are numbered in ``order``."""

    def __init__(self, table: list[tuple[str, int, str]], order: list[str], mode: str = "substring"):
        if mode not in ("substring", "word"):
            raise ValueError(f"unknown mode {mode!r}")
        self.table, self.order, self.mode = table, order, mode
        self.machine = None

    def __getstate__(self):
        return self.__dict__ | {"machine": None}  # built anew in each worker

    def _built(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        self.rows: list[list[tuple[int, int]]] = []  # by keyword: (class, weight)
        self.always = [(self.order.index(c), w) for c, w, k in self.table if not k and c in self.order]
        numbers: dict[str, int] = {}
        for c, w, k in self.table:
            if k and c in self.order:
                if k not in numbers:
                    numbers[k] = len(numbers)
                    self.rows.append([])
                    machine.add_word(k, (numbers[k], k))
                self.rows[numbers[k]].append((self.order.index(c), w))
        machine.make_automaton()
        self.machine = machine

    def found(self, text: str) -> set[int]:
        if self.machine is None:
            self._built()
        if not self.rows or not text:
            return set()
        if self.mode == "substring":
            return {n for _, (n, _) in self.machine.iter(text)}
        out = set()
        for end, (n, k) in self.machine.iter(text):
            start = end - len(k) + 1
            before, after = start > 0 and _wordy(text[start - 1]), end + 1 < len(text) and _wordy(text[end + 1])
            if before != _wordy(k[0]) and after != _wordy(k[-1]):
                out.add(n)
        return out

    def scores(self, text: str | None) -> list[int]:
        out = [0] * len(self.order)
        found = self.found(text or "")
        for c, w in self.always:
            out[c] += w
        for n in found:
            for c, w in self.rows[n]:
                out[c] += w
        return out


def keyword_table(rows: DataFrame) -> list[tuple[str, int, str]]:
    """A (class, weight, keyword) DataFrame as a table; its size is checked."""
    got = rows.select("class", "weight", "keyword").limit(MAX_KEYWORDS + 1).collect()
    if len(got) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} keywords")
    return [tuple(r) for r in got]


def class_scores(text: Column, table: list[tuple[str, int, str]], order: list[str] = KW.CLASS_ORDER, mode: str = "substring") -> Column:
    """Array of the classes' scores, in ``order``, for each text."""
    automaton = Automaton(table, list(order), mode)

    @F.pandas_udf("array<int>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([automaton.scores(t) for t in texts], dtype=object)

    return scored(F.lower(text))


def classify(df: DataFrame, text: Column, table: list[tuple[str, int, str]], order: list[str] = KW.CLASS_ORDER,
             min_score: int = KW.MIN_CLASS_SCORE, mode: str = "substring") -> DataFrame:
    """``df`` with score_<class> for every class of ``order`` and best_class (null below ``min_score``)."""
    scored = df.withColumn("_scores", class_scores(text, table, order, mode))
    scored = scored.select(*df.columns, *[F.col("_scores")[i].alias(f"score_{c}") for i, c in enumerate(order)])
    return scored.withColumn("best_class", KW.best_class({c: F.col(f"score_{c}") for c in order}, list(order), min_score))


def any_present(text: Column, keywords: list[str], mode: str = "substring") -> Column:
    """Any keyword is in the text."""
    return class_scores(text, [("any", 1, k) for k in keywords], ["any"], mode)[0] > 0
