"""Rows that every operator and stage has to bear, and plain versions of the word rules."""

import re

from pyspark.sql import types as T

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("score", "n_words", "spans", "_row", "rejected", "fingerprint", "ids", "component_id", "slot")]
)
PLAIN = ["doc_id", "text", "lang", "source", "n_chars"]


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def alnum(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def odd_rows():
    """Nulls, empty and blank texts, one letter, ties, repeated rows, a very long text, a long word, non-BMP characters."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    texts = [None, "", " \t\n", "x", "12 34 !?", base, base, base + " now", "É" * 40 + " ünïcode 😀 漢字", "word " * 60000, "a" * 1_500_000, "line\nline\nline\r\n", "\x00 nul"]
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "fr", None if i % 3 == 0 else "s", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "s", 1), (None, None, None, None, None), (-7, "Negative id", "fr", "s", 2)]
    return [r + tuple("clash" for _ in range(9)) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
