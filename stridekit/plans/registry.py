"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder reads the given parquet tables (or what Spark derives from
them) in full; nothing is sampled or capped unless the cap is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import activity as A
from ..sources.tables import activity_log, rejected_events, rejected_events_sql
from . import sql_activity as SA

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


# ------------------------------------------------------------------ activity

@register("activity_rejected_events", rejected_events_sql())
def q_activity_rejected_events(spark, sf):
    return rejected_events(spark, sf)


@register("activity_daily_xp", SA.daily_raw_xp_sql())
def q_activity_daily_xp(spark, sf):
    return A.daily_raw_xp(activity_log(spark, sf))


@register("activity_streaks", SA.streaks_sql())
def q_activity_streaks(spark, sf):
    return A.streak_days(activity_log(spark, sf))


@register("activity_xp_ledger", SA.ledger_sql())
def q_activity_xp_ledger(spark, sf):
    return A.xp_ledger(activity_log(spark, sf)).drop("ts")


def _ledger(spark, sf):
    return A.xp_ledger(activity_log(spark, sf))


@register("activity_user_snapshot", SA.snapshot_sql())
def q_activity_user_snapshot(spark, sf):
    return A.user_snapshot(_ledger(spark, sf), recent=None)


@register("activity_recent_logs", SA.recent_logs_sql())
def q_activity_recent_logs(spark, sf):
    return A.recent_logs(_ledger(spark, sf), 5)


@register("activity_best_activities", SA.best_activities_sql())
def q_activity_best_activities(spark, sf):
    return A.best_activities(A.user_snapshot(_ledger(spark, sf), recent=None))


@register("activity_xp_preview", SA.preview_sql())
def q_activity_xp_preview(spark, sf):
    log = activity_log(spark, sf)
    snap = A.user_snapshot(A.xp_ledger(log), recent=None)
    proposals = log.select("user_id", "event_id", "activity_type", "duration_minutes", "intensity")
    return A.xp_preview(snap, proposals)


@register("activity_build_switch", SA.switch_sql())
def q_activity_build_switch(spark, sf):
    from pyspark.sql import functions as F
    from ..functions.constants import BADGE_THRESHOLDS, BUILDS, LEGENDARY_BADGE_INDEX

    # forty times the month's XP stand for a longer history; every third user has a second build
    builds = F.array(*[F.lit(b) for b in BUILDS])
    snap = A.user_snapshot(_ledger(spark, sf), recent=None).select(
        "user_id", "primary_build", (F.col("total_xp") * 40).alias("total_xp"),
        (F.col("total_xp") * 40 >= BADGE_THRESHOLDS[LEGENDARY_BADGE_INDEX]).alias("is_legendary"),
        F.when(F.col("user_id") % 3 == 0, F.element_at(builds, (F.pmod(F.col("user_id") + 2, F.lit(7)) + 1).cast("int"))).alias("secondary_build"),
    )
    requests = snap.select(
        "user_id",
        F.element_at(builds, (F.pmod(F.col("user_id") + 1, F.lit(7)) + 1).cast("int")).alias("new_build"),
        F.when(F.col("user_id") % 2 == 0, F.lit("archive")).otherwise(F.lit("secondary")).alias("mode"),
    )
    return A.switch_builds(snap, requests)


@register("activity_gamer_sessions", SA.gamer_sql())
def q_activity_gamer_sessions(spark, sf):
    return A.gamer_sessions(_ledger(spark, sf))
