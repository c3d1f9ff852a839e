"""Readers for the parquet tables and the activity-log view built on ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity log derived from ``events`` (one row per event).

    user_id, event_id, ts, day, activity_type, duration_minutes, intensity, build.
    Unmapped event types keep a NULL activity and later score the 0.5 default.
    Events without a duration of 1 to 480 minutes are rejected (B22); see ``rejected_events``.
    """
    ev = read_table(spark, sf_dir, "events")
    return events_to_activity_log(ev)


def events_to_activity_log(ev: DataFrame) -> DataFrame:
    act = F.create_map(*[x for a, b in K.EVENT_ACTIVITY for x in (F.lit(a), F.lit(b))])
    builds = F.array(*[F.lit(b) for b in K.BUILDS])
    k = F.get_json_object("props", "$.k").cast("int")
    intensities = F.array(*[F.lit(n) for n, _ in K.INTENSITY])
    return ev.select(
        "user_id",
        "event_id",
        "ts",
        F.to_date("ts").alias("day"),
        act[F.col("event_type")].alias("activity_type"),
        (F.floor("value") + 1).cast("int").alias("duration_minutes"),
        F.element_at(intensities, F.pmod(k, F.lit(3)) + 1).alias("intensity"),
        F.element_at(builds, F.pmod(F.col("user_id"), F.lit(7)).cast("int") + 1).alias("build"),
    ).where(F.col("duration_minutes").between(*K.DURATION_MINUTES))


def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that ``activity_log`` rejects, with the reason."""
    minutes = F.floor("value") + 1
    low, high = K.DURATION_MINUTES
    reason = F.when(minutes.isNull(), "missing duration").when(minutes < low, "duration too short").when(minutes > high, "duration too long")
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", reason.alias("reason"))
    return ev.where(F.col("reason").isNotNull())


def rejected_events_sql() -> str:
    low, high = K.DURATION_MINUTES
    return f"""
      SELECT event_id, user_id, CASE WHEN value IS NULL THEN 'missing duration' WHEN floor(value) + 1 < {low} THEN 'duration too short'
             ELSE 'duration too long' END AS reason
      FROM events WHERE value IS NULL OR floor(value) + 1 NOT BETWEEN {low} AND {high}"""


# SQL text of the same view for the DuckDB oracle.
def activity_log_sql() -> str:
    act = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.EVENT_ACTIVITY)
    builds = ", ".join(f"'{b}'" for b in K.BUILDS)
    ints = ", ".join(f"'{n}'" for n, _ in K.INTENSITY)
    return f"""
      SELECT user_id, event_id, ts, CAST(ts AS DATE) AS day,
             CASE event_type {act} END AS activity_type,
             CAST(floor(value) + 1 AS INTEGER) AS duration_minutes,
             ([{ints}])[CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS INTEGER) + 1] AS intensity,
             ([{builds}])[CAST(user_id % 7 AS INTEGER) + 1] AS build
      FROM events WHERE floor(value) + 1 BETWEEN {K.DURATION_MINUTES[0]} AND {K.DURATION_MINUTES[1]}"""
