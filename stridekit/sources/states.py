"""Saved user states of any shape (A7, A8), read as VARIANT.

A document is a state or a list of states; a folder may hold both. With ``lines`` every line of
every file is a document, so a file holds as many users as it likes and is split over tasks;
without, every file is one document, as a state saved by itself is. Missing keys get their
defaults, values of the wrong kind are null, documents that are no JSON go to ``bad_documents``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BUILDS = "array<struct<build:string,total_xp:bigint,is_legacy:boolean>>"
_BUILD = "struct<build:string,total_xp:bigint,is_legacy:boolean>"
_LOGS = "array<struct<activity:string,duration:int,intensity:string,xp:int,notes:string,logged_at:string>>"
COUNTS = [("current_streak", 0), ("longest_streak", 0), ("daily_xp_today", 0), ("shields_remaining", 4), ("sessions_today", 0), ("overtime_xp_today", 0)]


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    texts = spark.read.text(path, wholetext=not lines, recursiveFileLookup=True).where(F.trim("value") != "")
    return texts.select("value", F.try_parse_json("value").alias("v"))


def read_json_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``v``: one VARIANT a record; a list root gives a record for each element, any other root one."""
    docs = _documents(spark, path, lines).where("v IS NOT NULL").select("v", F.schema_of_variant("v").startswith("ARRAY").alias("list"))
    several = docs.where("list").select("v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("v"))
    return docs.where(~F.col("list")).select("v").unionByName(several)


def bad_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The documents that are no JSON."""
    return _documents(spark, path, lines).where("v IS NULL").select("value")


def _get(key: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{key}", kind)


def _build(b: Column, legacy: bool | None) -> Column:
    flag = F.lit(legacy) if legacy is not None else F.coalesce(b["is_legacy"], F.lit(False))
    return F.struct(b["build"].alias("build"), F.coalesce(b["total_xp"], F.lit(0)).cast("long").alias("total_xp"), flag.alias("is_legacy"))


def load_user_states(spark: SparkSession, path: str, lines: bool = False, today: dt.date | None = None) -> DataFrame:
    """States with defaults for missing keys; the last reset and the shields' month default to ``today``.

    ``secondary_build`` is null where there is none, ``legacy_builds`` and ``activity_history`` are empty lists. Records without a
    user_id are no states.
    """
    today = today or dt.date.today()
    docs = read_json_documents(spark, path, lines)
    secondary = _get("secondary_build", _BUILD)
    rows = docs.select(
        _get("user_id", "string").alias("user_id"), F.coalesce(_get("username", "string"), _get("user_id", "string")).alias("username"),
        _build(_get("primary_build", _BUILD), None).alias("primary_build"), F.when(secondary.isNotNull(), _build(secondary, None)).alias("secondary_build"),
        F.coalesce(F.transform(_get("legacy_builds", _BUILDS), lambda b: _build(b, True)), F.array().cast(_BUILDS)).alias("legacy_builds"),
        *[F.coalesce(_get(c, "int"), F.lit(v)).alias(c) for c, v in COUNTS],
        F.to_date(_get("last_activity_date", "string")).alias("last_activity_date"),
        F.coalesce(F.to_date(_get("last_reset_date", "string")), F.lit(today)).alias("last_reset_date"),
        F.coalesce(_get("shields_reset_month", "int"), F.lit(today.month)).alias("shields_reset_month"),
        F.coalesce(_get("activity_history", _LOGS), F.array().cast(_LOGS)).alias("activity_history"),
    )
    return rows.where("user_id IS NOT NULL")


def activity_history(states: DataFrame) -> DataFrame:
    """One row for each logged activity of each state, numbered in log order from 0."""
    return states.select("user_id", F.posexplode("activity_history").alias("pos", "log")).select("user_id", "pos", "log.*")


def builds(states: DataFrame) -> DataFrame:
    """One row for each build of each state: primary, secondary and legacy ones."""
    kinds = [("primary", F.array("primary_build")), ("secondary", F.array_compact(F.array("secondary_build"))), ("legacy", F.col("legacy_builds"))]

    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x["build"].alias("build"), x["total_xp"].alias("total_xp"), x["is_legacy"].alias("is_legacy"))

    parts = [F.transform(b, named(kind)) for kind, b in kinds]
    return states.select("user_id", F.explode(F.concat(*parts)).alias("b")).select("user_id", "b.*")
