"""Registered source/sink queries: round trips through Spark's file formats
over the given tables (written under the session's checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keywords as KW
from ..operators import anomaly as AN
from ..operators import corpus as C
from ..sources import files as FL
from ..sources.tables import activity_log, read_table
from ..streaming.user_state import _scratch
from . import params as P
from . import sql_text as S
from .anomaly_queries import _features_sql
from .corpus_queries import _classified_sql, classified
from .registry import register

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@register("source_jsonl_roundtrip", "SELECT doc_id, source, lang, n_chars FROM documents")
def q_jsonl(spark, sf):
    """A3 write + A1 read (explicit schema, malformed lines quarantined)."""
    path = _scratch(spark, "jsonl")
    FL.write_jsonl(read_table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), path)
    good, _bad = FL.read_jsonl(spark, path, DOC_SCHEMA)
    return good


_F = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in AN.FEATURES)
_CODE = "CASE anomaly_type " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in AN.ANOMALY_TYPES) + " END"


@register("source_feature_csv_roundtrip", f"""
    WITH {_features_sql()}
    SELECT user_id, day, {_F}, CAST(anomaly_type <> 'none' AS INTEGER) AS is_anomaly, anomaly_type,
           CAST({_CODE} AS INTEGER) AS type_code FROM lab""")
def q_feature_csv(spark, sf):
    """A4 write (fixed columns) + A2 typed read with the type-code check."""
    lab = AN.weak_labels(AN.user_day_features(activity_log(spark, sf)))
    path = _scratch(spark, "features_csv")
    FL.write_csv(lab, path, ["user_id", "day", *AN.FEATURES, "is_anomaly", "anomaly_type"])
    extra = [T.StructField("user_id", T.LongType()), T.StructField("day", T.DateType())]
    return FL.read_feature_csv(spark, path, extra)


@register("source_registry_union", """
    SELECT doc_id AS id, length(coalesce(text, '')) AS n_chars, 'documents' AS source FROM documents
    UNION ALL SELECT item_id, length(coalesce(text, '')), 'benchmark' FROM benchmark""")
def q_registry(spark, sf):
    """Chosen sources in order, an unknown name skipped, union by name."""
    builders = {
        "documents": lambda: read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")),
        "benchmark": lambda: read_table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")),
    }
    return FL.source_registry(builders, ["documents", "no_such_source", "benchmark"])


_CLS = "[" + ", ".join(f"'{c}'" for c in KW.CLASS_ORDER) + "]"


@register("corpus_hash_class", f"""
    SELECT doc_id, {_CLS}[CAST(CAST(('0x' || substr({S.shuffle_key(P.SEED, 'doc_id')}, 1, 8)) AS BIGINT) % 7 AS INTEGER) + 1] AS class
    FROM documents""")
def q_hash_class(spark, sf):
    """Deterministic class for context-free rows."""
    return read_table(spark, sf, "documents").select("doc_id", C.hash_class(F.col("doc_id")).alias("class"))


@register("corpus_training_rows", f"""
    WITH {_classified_sql()}
    SELECT doc_id, class FROM (
      SELECT doc_id, class, row_number() OVER (ORDER BY doc_id) AS rn FROM cd
      WHERE "user" <> '' AND assistant <> '' AND class IN ('TITAN', 'ORACLE'))
    WHERE rn <= 100""")
def q_training_rows(spark, sf):
    """Class filter, complete rows, first 100 by doc_id."""
    return C.training_rows(classified(spark, sf), "class", ["TITAN", "ORACLE"], 100, ["doc_id"]).select("doc_id", "class")
