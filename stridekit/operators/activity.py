"""Activity scoring: relevance, XP, streaks with shields, the daily cap with the
level -> cap feedback, badges, snapshots, previews, build switching.

Shapes at scale
---------------
* Lookups (relevance, intensity, badges) are literal maps in the expression:
  no join at all, and they stay inside whole-stage codegen.
* Streaks work on distinct (user, day) rows; a user's group is bounded by the
  number of days, not by the number of events.
* Per-event running sums within a (user, day) use ``running_aggregates``
  (range partitioning + local scan), so one hot user-day is split over tasks.
* The cap depends on the level, which depends on all earlier credits. The cap
  changes at two totals only (6,500 and 23,000 XP), so the fold runs on the
  user-day table: per day the credit under a constant cap is ``least(cap,
  day_sum)``; a day on which the total crosses a cap boundary is resolved from
  the day's sorted prefix sums at or below the top cap (at most ~1,000 values,
  a bounded array). The result is exact, not an approximation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions import xp as X
from ..functions.scan import running_aggregates

def _builds() -> Column:
    return F.array(*[F.lit(b) for b in K.BUILDS])


def relevance_score(activity: Column | str, build: Column | str) -> Column:
    """F1: relevance of an activity for a build; unknown -> 0.5."""
    a = F.col(activity) if isinstance(activity, str) else activity
    b = F.col(build) if isinstance(build, str) else build
    table = F.create_map(
        *[x for name, scores in K.RELEVANCE for x in (F.lit(name), F.array(*[F.lit(s) for s in scores]))]
    )
    idx = F.array_position(_builds(), b)
    score = F.when(idx > 0, F.element_at(table[a], idx.cast("int")))
    return F.coalesce(score, F.lit(K.UNKNOWN_RELEVANCE))


def intensity_multiplier(intensity: Column | str) -> Column:
    """light 1.0, moderate 1.5, intense 2.0 (NULL for an unknown value)."""
    i = F.col(intensity) if isinstance(intensity, str) else intensity
    m = F.create_map(*[x for n, v in K.INTENSITY for x in (F.lit(n), F.lit(v))])
    return m[F.lower(i)]


def with_relevance(log: DataFrame) -> DataFrame:
    """F1-F3 columns: relevance_score, is_primary, relevance_mult, intensity_mult."""
    score = relevance_score("activity_type", "build")
    return (
        log.withColumn("relevance_score", score)
        .withColumn("is_primary", F.col("relevance_score") >= K.PRIMARY_THRESHOLD)
        .withColumn(
            "relevance_mult",
            F.when(F.col("is_primary"), F.lit(K.PRIMARY_MULT)).otherwise(F.lit(K.SECONDARY_MULT)),
        )
        .withColumn("intensity_mult", intensity_multiplier("intensity"))
    )


def raw_xp(duration: Column, imult: Column, rmult: Column, smult: Column) -> Column:
    """minutes x intensity x relevance x streak, same multiplication order."""
    return duration.cast("double") * imult * rmult * smult


def daily_raw_xp(log: DataFrame) -> DataFrame:
    """M0: XP per user and day before the cap, streak multiplier fixed at 1.

    Partial aggregation runs map-side, so a hot user is combined before the shuffle.
    """
    ev = with_relevance(log)
    xp = X.half_even_int(raw_xp(F.col("duration_minutes"), F.col("intensity_mult"), F.col("relevance_mult"), F.lit(1.0)))
    return ev.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(F.col("duration_minutes")).cast("long").alias("minutes"),
        F.sum(xp).cast("long").alias("raw_xp"),
        F.sum(F.when(F.col("is_primary"), xp).otherwise(0)).cast("long").alias("primary_xp"),
    )


# --------------------------------------------------------------------- streaks

def streak_days(log: DataFrame) -> DataFrame:
    """per active (user, day): streak after the day's update, shield use,
    break flag, longest streak so far and shields left in the month.

    Gap 1 extends; gap 2 extends while the month (of the active day) still has a
    shield; any other gap resets to 1. Windows are per user over distinct days.
    """
    days = log.select("user_id", "day").distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    month = F.date_trunc("month", F.col("day"))
    w_month = Window.partitionBy("user_id", month).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = days.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    d = d.withColumn("two_day_gaps", F.sum(F.when(F.col("gap") == 2, 1).otherwise(0)).over(w_month))
    d = d.withColumn("shield_used", (F.col("gap") == 2) & (F.col("two_day_gaps") <= K.SHIELDS_PER_MONTH))
    d = d.withColumn("streak_broken", F.col("gap").isNotNull() & (F.col("gap") != 1) & ~F.col("shield_used"))
    d = d.withColumn("run_id", F.sum(F.when(F.col("gap").isNull() | F.col("streak_broken"), 1).otherwise(0)).over(run))
    d = d.withColumn("current_streak", F.row_number().over(Window.partitionBy("user_id", "run_id").orderBy("day")))
    return d.select(
        "user_id",
        "day",
        F.col("current_streak").cast("int").alias("current_streak"),
        F.max("current_streak").over(run).cast("int").alias("longest_streak"),
        F.coalesce(F.col("shield_used"), F.lit(False)).alias("shield_used"),
        F.coalesce(F.col("streak_broken"), F.lit(False)).alias("streak_broken"),
        (F.lit(K.SHIELDS_PER_MONTH) - F.least(F.col("two_day_gaps"), F.lit(K.SHIELDS_PER_MONTH))).cast("int").alias("shields_remaining"),
    )


# ---------------------------------------------------------------------- ledger

def scored_events(log: DataFrame, streaks: DataFrame | None = None) -> DataFrame:
    """Events with streak (after the day's update) and rounded raw XP ``rr``."""
    streaks = streak_days(log) if streaks is None else streaks
    ev = with_relevance(log).join(streaks, ["user_id", "day"])
    smult = X.streak_multiplier("current_streak")
    raw = raw_xp(F.col("duration_minutes"), F.col("intensity_mult"), F.col("relevance_mult"), smult)
    return ev.withColumn("streak_mult", smult).withColumn("raw_xp", raw).withColumn("rr", X.half_even_int(raw))


def _first_at_least(pvals: Column, p_over: Column, h: Column) -> Column:
    # ``get`` is null where no prefix sum at or below the top cap reaches h; ``element_at`` fails there
    return F.coalesce(F.get(F.filter(pvals, lambda x: x >= h), F.lit(0)), p_over)


def day_ledger(day_sums: DataFrame) -> DataFrame:
    """The cross-day fold on (user_id, day, day_p, pvals, p_over).

    Returns per day: t_start (total XP before the day), cap_pre, and for the day
    on which the total crosses a cap boundary: cap_post, cross_h (XP still
    needed at the day start) and cross_pk (the first prefix sum >= cross_h).
    """
    w = Window.partitionBy("user_id").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("user_id")
    df = day_sums
    points = K.cap_change_points()
    prev_cross, prev_t_after, prev_cum = None, F.lit(0), None
    t_start_expr, cap_pre_expr = None, None
    cap_post_expr = h_expr = pk_expr = None
    for i, (thr, c_pre, c_post) in enumerate(points):
        c = F.least(F.lit(c_pre), F.col("day_p"))
        df = df.withColumn(f"_cum{i}", F.sum(c).over(run))
        if prev_cross is None:
            in_phase = F.lit(True)
            base = F.lit(0)
        else:
            in_phase = F.col(prev_cross).isNotNull() & (F.col("day") > F.col(prev_cross))
            base = F.col(prev_t_after) - F.max(F.when(F.col("day") == F.col(prev_cross), F.col(f"_cum{i}"))).over(whole)
        df = df.withColumn(f"_ts{i}", F.when(in_phase, base + F.col(f"_cum{i}") - c))
        df = df.withColumn(f"_x{i}", F.min(F.when(F.col(f"_ts{i}") + c >= thr, F.col("day"))).over(whole))
        is_x = F.col("day") == F.col(f"_x{i}")
        h = F.lit(thr) - F.col(f"_ts{i}")
        pk = _first_at_least(F.col("pvals"), F.col("p_over"), h)
        credit = F.least(F.lit(c_post), F.least(F.lit(c_pre), pk) + F.col("day_p") - pk)
        df = df.withColumn(f"_h{i}", F.when(is_x, h)).withColumn(f"_pk{i}", F.when(is_x, pk))
        df = df.withColumn(f"_ta{i}", F.max(F.when(is_x, F.col(f"_ts{i}") + credit)).over(whole))
        before_x = F.col(f"_x{i}").isNull() | (F.col("day") < F.col(f"_x{i}"))
        cond_plain = in_phase & before_x
        cond_x = in_phase & is_x
        for expr_name, val_plain, val_x in (
            ("t", F.col(f"_ts{i}"), F.col(f"_ts{i}")),
            ("cap", F.lit(c_pre), F.lit(c_pre)),
            ("post", F.lit(None).cast("int"), F.lit(c_post)),
            ("h", F.lit(None).cast("long"), F.col(f"_h{i}")),
            ("pk", F.lit(None).cast("long"), F.col(f"_pk{i}")),
        ):
            cur = {"t": t_start_expr, "cap": cap_pre_expr, "post": cap_post_expr, "h": h_expr, "pk": pk_expr}[expr_name]
            cur = F.when(cond_plain, val_plain) if cur is None else cur.when(cond_plain, val_plain)
            cur = cur.when(cond_x, val_x)
            if expr_name == "t":
                t_start_expr = cur
            elif expr_name == "cap":
                cap_pre_expr = cur
            elif expr_name == "post":
                cap_post_expr = cur
            elif expr_name == "h":
                h_expr = cur
            else:
                pk_expr = cur
        prev_cross, prev_t_after = f"_x{i}", f"_ta{i}"
    # last phase: top cap, no further boundary
    top = sorted(K.DAILY_CAP_TIERS)[-1][1]
    c = F.least(F.lit(top), F.col("day_p"))
    df = df.withColumn("_cumtop", F.sum(c).over(run))
    in_top = F.col(prev_cross).isNotNull() & (F.col("day") > F.col(prev_cross))
    base = F.col(prev_t_after) - F.max(F.when(F.col("day") == F.col(prev_cross), F.col("_cumtop"))).over(whole)
    df = df.withColumn("_tstop", F.when(in_top, base + F.col("_cumtop") - c))
    t_start_expr = t_start_expr.when(in_top, F.col("_tstop"))
    cap_pre_expr = cap_pre_expr.when(in_top, F.lit(top))
    return df.select(
        "user_id",
        "day",
        "day_p",
        t_start_expr.cast("long").alias("t_start"),
        cap_pre_expr.cast("int").alias("cap_pre"),
        cap_post_expr.cast("int").alias("cap_post"),
        h_expr.cast("long").alias("cross_h"),
        pk_expr.cast("long").alias("cross_pk"),
    )


def xp_ledger(log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """F7 + F8 + F12 + F16 + F17: one row per logged activity, in log order per user.

    Every event is credited ``min(rounded raw XP, cap - credited today)``, the cap
    following the level reached before the event; badges are announced when a
    credit crosses a threshold; streak flags sit on the day's first event.
    """
    top_cap = max(c for _, c in K.DAILY_CAP_TIERS)
    streaks = streak_days(log)
    ev = scored_events(log, streaks).withColumn("_one", F.lit(1))
    ev = running_aggregates(
        ev, ["user_id", "day"], ["ts", "event_id"], {"p": ("rr", "sum"), "n_today": ("_one", "sum")}, num_partitions
    )
    day_sums = ev.groupBy("user_id", "day").agg(
        F.sum("rr").cast("long").alias("day_p"),
        F.sort_array(F.collect_set(F.when(F.col("p") <= top_cap, F.col("p")))).alias("pvals"),
        F.min(F.when(F.col("p") > top_cap, F.col("p"))).alias("p_over"),
    )
    days = day_ledger(day_sums).drop("day_p")
    led = ev.join(days, ["user_id", "day"])
    p, rr = F.col("p"), F.col("rr").cast("long")
    p_prev = p - rr
    cross = F.col("cap_post").isNotNull()
    cap_pre, cap_post = F.col("cap_pre"), F.col("cap_post")
    m = F.least(cap_pre, F.col("cross_pk")) - F.col("cross_pk")
    qual_prev = cross & (F.least(cap_pre, p_prev) >= F.col("cross_h"))
    d_prev = F.when(~cross, F.least(cap_pre, p_prev)).when(~qual_prev, F.least(cap_pre, p_prev)).otherwise(F.least(cap_post, p_prev + m))
    d_cur = F.when(~cross, F.least(cap_pre, p)).when(~qual_prev, F.least(cap_pre, p)).otherwise(F.least(cap_post, p + m))
    cap_i = F.when(cross & qual_prev, cap_post).otherwise(cap_pre)
    led = (
        led.withColumn("daily_xp_before", d_prev.cast("int"))
        .withColumn("daily_xp_after", d_cur.cast("int"))
        .withColumn("daily_cap", cap_i.cast("int"))
    )
    remaining = F.greatest(F.lit(0), F.col("daily_cap") - F.col("daily_xp_before"))
    t_before = F.col("t_start") + F.col("daily_xp_before")
    t_after = F.col("t_start") + F.col("daily_xp_after")
    first_today = F.col("n_today") == 1
    led = (
        led.withColumn("final_xp", (F.col("daily_xp_after") - F.col("daily_xp_before")).cast("int"))
        .withColumn("was_capped", F.col("rr") > remaining)
        .withColumn("daily_xp_remaining", (remaining - F.col("final_xp")).cast("int"))
        .withColumn("total_xp_before", t_before.cast("long"))
        .withColumn("total_xp_after", t_after.cast("long"))
        .withColumn("power_up_name", X.streak_milestone("current_streak"))
        .withColumn("shield_used", F.col("shield_used") & first_today)
        .withColumn("streak_broken", F.col("streak_broken") & first_today)
    )
    b_before, b_after = X.badge_index("total_xp_before"), X.badge_index("total_xp_after")
    led = led.withColumn("badge_earned", F.when(b_after > b_before, X.badge_name(F.col("build"), b_after)))
    led = led.withColumn(
        "chatbot_hint",
        F.when(F.col("streak_broken"), F.lit("support_mode")).when(
            F.col("badge_earned").isNotNull() | F.col("power_up_name").isNotNull(), F.lit("hype_mode")
        ),
    )
    return led.select(
        "user_id", "event_id", "ts", "day", "activity_type", "duration_minutes", "intensity", "build",
        F.col("duration_minutes").cast("double").alias("base_xp"),
        "intensity_mult", "relevance_mult", "streak_mult", "raw_xp", "final_xp", "was_capped",
        "daily_xp_before", "daily_xp_after", "daily_cap", "daily_xp_remaining", "is_primary", "power_up_name",
        "current_streak", "longest_streak", "shield_used", "streak_broken", "shields_remaining",
        F.col("n_today").cast("int").alias("n_today"), "total_xp_before", "total_xp_after", X.level_of("total_xp_after").alias("level_after"),
        "badge_earned", "chatbot_hint",
    )


# -------------------------------------------------------------------- snapshot

def recent_logs(ledger: DataFrame, recent: int = 5) -> DataFrame:
    """The last ``recent`` logs per user (recent_rank 1 = latest).

    No user's whole history is ranked: count events per (user, day), walk the
    user's days from the latest (a window bounded by the number of days), keep
    the days that hold the last N, and rank there by each event's position in
    its day (``n_today``).
    """
    per_day = ledger.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("_cnt"))
    w_back = Window.partitionBy("user_id").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.withColumn("_later", F.coalesce(F.sum("_cnt").over(w_back), F.lit(0))).where(F.col("_later") < recent)
    tail = ledger.join(per_day, ["user_id", "day"]).withColumn(
        "recent_rank", (F.col("_later") + F.col("_cnt") - F.col("n_today") + 1).cast("int")
    )
    return tail.where(F.col("recent_rank") <= recent).select(
        "user_id", "recent_rank",
        F.col("activity_type").alias("activity"), F.col("duration_minutes").alias("duration"),
        "intensity", F.col("final_xp").alias("xp"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("logged_at"),
    )


def user_snapshot(ledger: DataFrame, recent: int | None = 5) -> DataFrame:
    """F20 (+F11): latest state per user, as of the user's last logged event.

    ``max_by`` is a partial aggregate (one row per user per task before the
    shuffle). With ``recent`` set, the last logs are attached as an array built
    from ``recent_logs`` (bounded to N rows per user).
    """
    order = F.struct("ts", "event_id")
    latest = ledger.groupBy("user_id").agg(
        F.max_by(F.struct(*[c for c in ledger.columns if c != "user_id"]), order).alias("s"),
        F.count(F.lit(1)).alias("total_activities"),
    )
    s = F.col("s")
    total = s["total_xp_after"]
    level = X.level_of(total)
    cap = X.daily_cap_of(level)
    snap = latest.select(
        "user_id",
        s["build"].alias("primary_build"),
        total.alias("total_xp"),
        level.alias("level"),
        F.coalesce(X.badge_name(s["build"], X.badge_index(total)), F.lit("Unranked")).alias("badge"),
        X.badge_name(s["build"], X.badge_index(total) + 1).alias("next_badge"),
        X.xp_to_next_badge(total).alias("xp_to_next_badge"),
        X.xp_to_next_level(total).alias("xp_to_next_level"),
        (X.badge_index(total) >= K.LEGENDARY_BADGE_INDEX).alias("is_legendary"),
        s["current_streak"].alias("current_streak"),
        s["longest_streak"].alias("longest_streak"),
        X.streak_multiplier(s["current_streak"]).alias("streak_multiplier"),
        s["shields_remaining"].alias("shields_remaining"),
        s["day"].alias("last_activity_date"),
        s["daily_xp_after"].alias("daily_xp_today"),
        cap.alias("daily_xp_cap"),
        F.greatest(F.lit(0), cap - s["daily_xp_after"]).cast("int").alias("daily_xp_remaining"),
        (s["daily_xp_after"] >= cap).alias("daily_cap_reached"),
        "total_activities",
    )
    if not recent:
        return snap
    logs = recent_logs(ledger, recent).groupBy("user_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(-F.col("recent_rank"), F.struct("activity", "duration", "intensity", "xp", "logged_at")))),
            lambda x: x.getField("col2"),
        ).alias("recent_logs")
    )
    return snap.join(logs, "user_id", "left")


# ---------------------------------------------------------- best / preview

def activity_catalog(spark: SparkSession) -> DataFrame:
    """The activity table (38 rows, fixed) with its table order."""
    return spark.createDataFrame(
        [(i, name) for i, (name, _) in enumerate(K.RELEVANCE)], "table_order int, activity_type string"
    )


def best_activities(snapshot: DataFrame, duration: int = 60, top: int = 10) -> DataFrame:
    """per user, the top activities by projected XP at ``duration`` minutes,
    intense; ties keep table order. The catalogue is fixed at 38 rows, expanded
    per user with ``inline`` (38 rows per user, no join); the rank window holds 38 rows."""
    cat = F.array(*[F.struct(F.lit(i).alias("table_order"), F.lit(n).alias("activity_type")) for i, (n, _) in enumerate(K.RELEVANCE)])
    x = snapshot.select(
        "user_id", "primary_build", "current_streak", "daily_xp_today", "daily_xp_cap", F.inline(cat)
    )
    raw = raw_xp(
        F.lit(duration), F.lit(2.0),
        F.when(relevance_score("activity_type", "primary_build") >= K.PRIMARY_THRESHOLD, 1.0).otherwise(0.5),
        X.streak_multiplier("current_streak"),
    )
    remaining = F.greatest(F.lit(0), F.col("daily_xp_cap") - F.col("daily_xp_today"))
    x = x.withColumn("projected_xp", F.least(X.half_even_int(raw), remaining).cast("int"))
    w = Window.partitionBy("user_id").orderBy(F.col("projected_xp").desc(), F.col("table_order"))
    return (
        x.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top)
        .select("user_id", "rank", "activity_type", "projected_xp")
    )


def xp_preview(snapshot: DataFrame, proposals: DataFrame) -> DataFrame:
    """XP a proposed (user_id, activity_type, duration_minutes, intensity)
    would earn from the user's latest state; nothing is changed."""
    x = proposals.join(snapshot.select("user_id", "primary_build", "current_streak", "daily_xp_today", "daily_xp_cap"), "user_id")
    score = relevance_score("activity_type", "primary_build")
    is_primary = score >= K.PRIMARY_THRESHOLD
    imult = intensity_multiplier("intensity")
    rmult = F.when(is_primary, 1.0).otherwise(0.5)
    smult = X.streak_multiplier("current_streak")
    raw = raw_xp(F.col("duration_minutes"), imult, rmult, smult)
    rounded = X.half_even_int(raw)
    remaining = F.greatest(F.lit(0), F.col("daily_xp_cap") - F.col("daily_xp_today"))
    keep = [c for c in proposals.columns if c not in ("user_id", "activity_type", "duration_minutes", "intensity")]
    return x.select(
        "user_id", *keep, "activity_type", "duration_minutes", "intensity",
        F.least(rounded, remaining).cast("int").alias("projected_xp"),
        imult.alias("intensity_mult"), rmult.alias("relevance_mult"), smult.alias("streak_mult"),
        F.bround(raw, 1).alias("raw_xp"), is_primary.alias("is_primary"),
        (rounded > remaining).alias("would_cap"), remaining.cast("int").alias("daily_remaining"),
    )


# ------------------------------------------------------------- build switching

def switch_builds(snapshot: DataFrame, requests: DataFrame) -> DataFrame:
    """apply (user_id, new_build, mode) requests. ``archive`` keeps the old
    build as legacy and starts the new one at the 500 XP bonus; ``secondary``
    opens the single secondary slot, unless the snapshot's ``secondary_build`` (if it
    has that column) holds one. Both need the legendary badge."""
    slot = F.col("secondary_build") if "secondary_build" in snapshot.columns else F.lit(None).cast("string")
    x = requests.join(snapshot.select("user_id", "primary_build", "total_xp", "is_legendary", slot.alias("_slot")), "user_id")
    valid_build = F.array_contains(_builds(), F.lower("new_build"))
    taken = (F.col("mode") == "secondary") & F.col("_slot").isNotNull()
    ok = valid_build & F.col("is_legendary") & F.col("mode").isin("archive", "secondary") & ~taken
    reason = (
        F.when(~valid_build, F.lit("Unknown build"))
        .when(~F.col("mode").isin("archive", "secondary"), F.lit("mode must be 'secondary' or 'archive'"))
        .when(~F.col("is_legendary"), F.lit("Must reach Legendary badge first."))
        .when(taken, F.lit("Secondary build slot already active."))
    )
    archive = ok & (F.col("mode") == "archive")
    return x.select(
        "user_id", "mode", F.lower("new_build").alias("new_build"), ok.alias("success"), reason.alias("reason"),
        F.when(archive, F.lower("new_build")).otherwise(F.col("primary_build")).alias("primary_build"),
        F.when(archive, F.lit(K.LEGACY_BONUS_XP).cast("long")).otherwise(F.col("total_xp")).alias("primary_total_xp"),
        F.when(archive, F.col("primary_build")).alias("archived_build"),
        F.when(archive, F.col("total_xp")).alias("archived_total_xp"),
        F.when(ok & (F.col("mode") == "secondary"), F.lower("new_build")).otherwise(F.col("_slot")).alias("secondary_build"),
    )


# --------------------------------------------------------------------- gamer

def gamer_xp(
    df: DataFrame,
    activity="activity_type", duration="duration_minutes", intensity="intensity", streak="current_streak",
    level="current_level", daily_so_far="daily_xp_so_far", sessions_before="primary_sessions_today",
    overtime_before="overtime_xp_today",
) -> DataFrame:
    """the gamer-build calculator as columns (combo, boss day, speedrun,
    side-quest 0.4x, overtime pool), from the counters before the session."""
    a, d = F.col(activity), F.col(duration)
    prim = relevance_score(a, F.lit("gamer")) >= K.PRIMARY_THRESHOLD
    rmult = F.when(prim, F.lit(1.0)).otherwise(F.lit(K.GAMER_SIDE_QUEST_MULT))
    raw = raw_xp(d, intensity_multiplier(intensity), rmult, X.streak_multiplier(streak))
    rounded = X.half_even_int(raw)
    base_cap = X.daily_cap_of(level)
    boss = X.is_boss_day(streak)
    eff_cap = F.when(boss, base_cap * 2).otherwise(base_cap)
    so_far = F.col(daily_so_far)
    rem = F.greatest(F.lit(0), eff_cap - so_far)
    earned = F.least(rounded, rem)
    cap_hit = (so_far + earned >= eff_cap)
    combo = F.when(prim, X.combo_multiplier(F.col(sessions_before) + 1)).otherwise(F.lit(0.0))
    combo_xp = F.floor(earned * combo).cast("int")
    speed = F.when(
        prim & (F.lower(F.col(intensity)) == "intense") & (d <= K.GAMER_SPEEDRUN_MAX_MINUTES), F.lit(K.GAMER_SPEEDRUN_BONUS)
    ).otherwise(F.lit(0))
    pool_left = F.greatest(F.lit(0), K.GAMER_OVERTIME_LIMIT - F.col(overtime_before))
    overtime = F.when(prim & (cap_hit | (so_far >= eff_cap)), F.least(F.greatest(F.lit(0), rounded - rem), pool_left)).otherwise(F.lit(0))
    bonus = combo_xp + speed + overtime
    return df.select(
        "*",
        earned.cast("int").alias("base_final_xp"),
        combo.alias("combo_multiplier"),
        combo_xp.alias("combo_bonus_xp"),
        boss.alias("is_boss_day"),
        (boss & (so_far > base_cap)).alias("boss_day_cap_used"),
        speed.cast("int").alias("speedrun_bonus"),
        overtime.cast("int").alias("overtime_xp"),
        (~prim).alias("side_quest_penalty"),
        bonus.cast("int").alias("gamer_bonus_total"),
        (earned + bonus).cast("int").alias("gamer_final_xp"),
        F.greatest(F.lit(0), K.GAMER_OVERTIME_LIMIT - F.col(overtime_before) - overtime).cast("int").alias("overtime_pool_remaining"),
    )


def gamer_sessions(ledger: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """F15 over the log of gamer-build users.

    State before each session comes from the XP ledger (streak, level before
    the event, XP credited today); the day's counters are running values within
    (user, day): earlier primary sessions, and overtime already granted, which
    is ``least(150, sum of earlier primary overflow)``. Running values use the
    hot-key-safe scan.
    """
    g = ledger.where(F.col("build") == "gamer")
    prim = relevance_score("activity_type", F.lit("gamer")) >= K.PRIMARY_THRESHOLD
    rmult = F.when(prim, F.lit(1.0)).otherwise(F.lit(K.GAMER_SIDE_QUEST_MULT))
    rounded = X.half_even_int(raw_xp(F.col("duration_minutes"), F.col("intensity_mult"), rmult, F.col("streak_mult")))
    level = X.level_of("total_xp_before")
    eff_cap = F.when(X.is_boss_day("current_streak"), X.daily_cap_of(level) * 2).otherwise(X.daily_cap_of(level))
    rem = F.greatest(F.lit(0), eff_cap - F.col("daily_xp_before"))
    g = g.withColumn("_prim", F.when(prim, 1).otherwise(0)).withColumn(
        "_over", F.when(prim, F.greatest(F.lit(0), rounded - rem)).otherwise(F.lit(0))
    )
    g = running_aggregates(
        g, ["user_id", "day"], ["ts", "event_id"], {"_prim_run": ("_prim", "sum"), "_over_run": ("_over", "sum")}, num_partitions
    )
    g = (
        g.withColumn("current_level", level)
        .withColumn("daily_xp_so_far", F.col("daily_xp_before"))
        .withColumn("primary_sessions_today", (F.col("_prim_run") - F.col("_prim")).cast("int"))
        .withColumn("overtime_xp_today", F.least(F.lit(K.GAMER_OVERTIME_LIMIT), F.col("_over_run") - F.col("_over")).cast("int"))
    )
    out = gamer_xp(g)
    return out.select(
        "user_id", "event_id", "day", "activity_type", "duration_minutes", "intensity", "current_streak",
        "current_level", "daily_xp_so_far", "primary_sessions_today", "overtime_xp_today",
        "base_final_xp", "combo_multiplier", "combo_bonus_xp", "is_boss_day", "boss_day_cap_used", "speedrun_bonus",
        "overtime_xp", "side_quest_penalty", "gamer_bonus_total", "gamer_final_xp", "overtime_pool_remaining",
    )


def calculate_xp(df: DataFrame, activity="activity_type", duration="duration_minutes", intensity="intensity",
                 build="primary_build", streak="current_streak", level="current_level", so_far="daily_xp_so_far") -> DataFrame:
    """F7 as columns: the breakdown of one activity given the state before it."""
    score = relevance_score(activity, build)
    is_primary = score >= K.PRIMARY_THRESHOLD
    imult = intensity_multiplier(intensity)
    rmult = F.when(is_primary, F.lit(K.PRIMARY_MULT)).otherwise(F.lit(K.SECONDARY_MULT))
    smult = X.streak_multiplier(streak)
    raw = raw_xp(F.col(duration), imult, rmult, smult)
    rounded = X.half_even_int(raw)
    cap = X.daily_cap_of(level)
    remaining = F.greatest(F.lit(0), cap - F.col(so_far))
    earned = F.least(rounded, remaining)
    return df.select(
        "*",
        F.col(duration).cast("double").alias("base_xp"), imult.alias("intensity_mult"), rmult.alias("relevance_mult"),
        smult.alias("streak_mult"), raw.alias("raw_xp"), earned.cast("int").alias("final_xp"),
        (rounded > remaining).alias("was_capped"), F.col(so_far).cast("int").alias("daily_xp_before"),
        (F.col(so_far) + earned).cast("int").alias("daily_xp_after"), cap.alias("daily_cap"),
        (remaining - earned).cast("int").alias("daily_xp_remaining"), is_primary.alias("is_primary"),
        X.streak_milestone(streak).alias("power_up_name"),
    )
