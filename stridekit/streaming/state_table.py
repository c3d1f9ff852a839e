"""Live user state for streams in which one user may send most events.

Each micro-batch of a streaming query is folded by DataFrame operations on top of a
versioned state table, so no task holds a user's events: running sums within (user, day) go
through the split scan, and only user-days, bounded by the days of a micro-batch,
are folded per user. Events are credited under the rules of the batch ledger and of
``user_state``: late days draw on their own pool and leave the streak alone.

Batch n reads state version n - 1 and overwrites its results and version n. A batch that is
run again, after a failure or by hand, finds the same state and writes the same rows:
replaying changes nothing. A version holds one row a user: total, streak, longest, last active day,
month and shields used, and the pools of the last ``KEEP_DAYS`` days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as K
from ..functions import xp as X
from ..functions.scan import running_aggregates
from ..operators.activity import raw_xp, with_relevance
from .user_state import KEEP_DAYS, with_announcements

STATE = "user_id long, total long, streak int, longest int, last_day date, month int, shields_used int, pools map<date,int>"
_DAYS = "array<struct<day:date,streak:int,longest:int,shield:boolean,broken:boolean,used:int>>"
_CREDITS = "array<struct<day:date,t_start:bigint,pool:int,room:int,cap:int,cap_after:int,room_after:int,at:bigint,at_credit:bigint,credit:bigint,known:boolean>>"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _streak_fold(days: Column) -> Column:
    """Ascending days on top of the state columns: streak columns of each day, and the state after them."""
    start = F.struct(
        F.coalesce("streak", F.lit(0)).alias("streak"), F.coalesce("longest", F.lit(0)).alias("longest"), F.col("last_day").alias("last"),
        F.coalesce("month", F.lit(0)).alias("month"), F.coalesce("shields_used", F.lit(0)).alias("used"), F.array().cast(_DAYS).alias("out"),
    )

    def step(s: Column, day: Column) -> Column:
        gap = F.datediff(day, s["last"])  # null on the first day of all, below 0 on a late one
        month = (F.year(day) * 12 + F.month(day)).cast("int")
        used = F.when(month == s["month"], s["used"]).otherwise(F.lit(0))
        late = F.coalesce(gap < 0, F.lit(False))
        shield = F.coalesce(gap == 2, F.lit(False)) & (used < K.SHIELDS_PER_MONTH)
        broken = F.coalesce(gap >= 2, F.lit(False)) & ~shield
        streak = F.when(late | F.coalesce(gap == 0, F.lit(False)), s["streak"]).when(gap.isNull() | broken, F.lit(1)).otherwise(s["streak"] + 1).cast("int")
        longest = F.greatest(s["longest"], streak)
        now = F.when(late, s["used"]).otherwise(used + shield.cast("int")).cast("int")
        row = F.struct(day.alias("day"), streak.alias("streak"), longest.alias("longest"), shield.alias("shield"), broken.alias("broken"), now.alias("used"))
        return F.struct(
            streak.alias("streak"), longest.alias("longest"), F.when(late, s["last"]).otherwise(day).alias("last"),
            F.when(late, s["month"]).otherwise(month).cast("int").alias("month"), now.alias("used"), F.array_append(s["out"], row).alias("out"),
        )

    return F.aggregate(days, start, step)


def _credit_fold(days: Column, newest: Column) -> Column:
    """Ascending (day, day_p, pvals, p_over) on top of total and pools: what the credits of each day follow, and the total after them.

    ``pvals``: the day's running raw XP up to the top cap, ``p_over``: the first beyond it. At most one cap boundary is
    crossed in a day; ``at`` is the running raw XP with which it is, ``at_credit`` the credit up to there.
    """
    bounds = K.cap_change_points()
    top = bounds[-1][2]
    start = F.struct(F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.array().cast(_CREDITS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        pool = F.coalesce(F.element_at("pools", x["day"]), F.lit(0)).cast("int")
        known = F.datediff(newest, x["day"]) < KEEP_DAYS
        cap, after, bound = F.lit(top), F.lit(None).cast("int"), F.lit(None).cast("long")
        for least, before, then in reversed(bounds):
            below = s["total"] < least
            cap, after, bound = F.when(below, F.lit(before)).otherwise(cap), F.when(below, F.lit(then)).otherwise(after), F.when(below, F.lit(least)).otherwise(bound)
        room = F.greatest(cap - pool, F.lit(0))
        plain = F.least(x["day_p"], room.cast("long"))
        crossed = F.coalesce(known & (s["total"] + plain >= bound), F.lit(False))
        need = bound - s["total"]
        at = F.when(crossed, F.coalesce(F.get(F.filter(x["pvals"], lambda p: p >= need), F.lit(0)), x["p_over"]))
        at_credit = F.least(at, room.cast("long"))
        room_after = F.greatest(after - pool - at_credit, F.lit(0)).cast("int")
        credit = F.when(~known, F.lit(0)).when(crossed, at_credit + F.least(x["day_p"] - at, room_after.cast("long"))).otherwise(plain).cast("long")
        row = F.struct(
            x["day"].alias("day"), s["total"].alias("t_start"), pool.alias("pool"), F.when(known, room).otherwise(F.lit(0)).cast("int").alias("room"),
            F.when(known, cap).otherwise(F.lit(0)).cast("int").alias("cap"), after.cast("int").alias("cap_after"), room_after.alias("room_after"),
            at.cast("long").alias("at"), at_credit.cast("long").alias("at_credit"), credit.alias("credit"), known.alias("known"),
        )
        return F.struct((s["total"] + credit).alias("total"), F.array_append(s["out"], row).alias("out"))

    return F.aggregate(days, start, step)


def fold_batch(activity: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A micro-batch of the activity log on top of a state: one result row an event, and the new state."""
    spark = activity.sparkSession
    scored = with_relevance(activity).withColumn("base", raw_xp(F.col("duration_minutes"), F.col("intensity_mult"), F.col("relevance_mult"), F.lit(1.0)))
    scored = scored.select("user_id", "event_id", "ts", "day", "build", "base")
    dated = scored.groupBy("user_id").agg(F.sort_array(F.collect_set("day")).alias("days")).join(state, "user_id", "left")
    # one row a user; read by the events, by the credits and by the new state
    streaks = dated.withColumn("s", _streak_fold(F.col("days"))).withColumn("newest", F.greatest("last_day", F.element_at("days", -1))).checkpoint()
    per_day = streaks.select("user_id", F.explode("s.out").alias("d")).select("user_id", "d.*")
    ev = scored.join(per_day, ["user_id", "day"])
    ev = ev.withColumn("rr", X.half_even_int(F.col("base") * X.streak_multiplier("streak"))).withColumn("one", F.lit(1))
    ev = running_aggregates(ev.drop("base"), ["user_id", "day"], ["ts", "event_id"], {"p": ("rr", "sum"), "n": ("one", "sum")})

    top = max(c for _, c in K.DAILY_CAP_TIERS)
    sums = ev.groupBy("user_id", "day").agg(
        F.sum("rr").cast("long").alias("day_p"), F.sort_array(F.collect_set(F.when(F.col("p") <= top, F.col("p")))).alias("pvals"),
        F.min(F.when(F.col("p") > top, F.col("p"))).alias("p_over"),
    )
    days = sums.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("day", "day_p", "pvals", "p_over"))).alias("sums"))
    credits = streaks.join(days, "user_id").withColumn("c", _credit_fold(F.col("sums"), F.col("newest"))).checkpoint()

    rows = ev.join(credits.select("user_id", F.explode("c.out").alias("d")).select("user_id", "d.*"), ["user_id", "day"])
    rr, p = F.col("rr").cast("long"), F.col("p")
    behind = F.coalesce(p - rr >= F.col("at"), F.lit(False))  # the event stands behind the one that crossed the boundary

    def credited(x: Column) -> Column:
        return F.when(behind, F.col("at_credit") + F.least(x - F.col("at"), F.col("room_after").cast("long"))).otherwise(F.least(x, F.col("room").cast("long")))

    before, after = credited(p - rr), credited(p)
    first = F.col("n") == 1
    results = rows.select(
        "user_id", "event_id", "day", "build", rr.alias("rr"), (after - before).cast("int").alias("final_xp"),
        (F.col("pool") + before).cast("int").alias("daily_xp_before"), (F.col("pool") + after).cast("int").alias("daily_xp_after"),
        F.when(behind, F.col("cap_after")).otherwise(F.col("cap")).alias("daily_cap"), F.col("streak").alias("current_streak"), F.col("longest").alias("longest_streak"),
        (F.col("shield") & first).alias("shield_used"), (F.col("broken") & first).alias("streak_broken"),
        (K.SHIELDS_PER_MONTH - F.col("used")).cast("int").alias("shields_remaining"),
        (F.col("t_start") + before).alias("total_xp_before"), (F.col("t_start") + after).alias("total_xp_after"),
    )
    return with_announcements(results), _state_after(spark, state, credits)


def _state_after(spark: SparkSession, state: DataFrame, credits: DataFrame) -> DataFrame:
    """Users of the batch with their new row, others as they were."""
    known = F.filter("c.out", lambda d: d["known"])
    fresh = F.map_from_entries(F.transform(known, lambda d: F.struct(d["day"], (d["pool"] + d["credit"]).cast("int"))))
    held = F.map_filter(F.coalesce("pools", F.create_map().cast("map<date,int>")), lambda day, _: ~F.array_contains(F.col("days"), day))
    last = F.col("s.last")
    moved = credits.select(
        "user_id", F.col("c.total").alias("total"), F.col("s.streak").alias("streak"), F.col("s.longest").alias("longest"), last.alias("last_day"),
        F.col("s.month").alias("month"), F.col("s.used").alias("shields_used"),
        F.map_filter(F.map_concat(held, fresh), lambda day, _: F.datediff(last, day) < KEEP_DAYS).alias("pools"),
    )
    return state.join(moved.select("user_id"), "user_id", "left_anti").unionByName(moved)


# ---------------------------------------------------------------------- batches

def run_batch(activity: DataFrame, batch: int, root: str) -> None:
    """Fold one micro-batch: reads version ``batch`` - 1 of the state, overwrites the results of the batch and version ``batch``."""
    spark = activity.sparkSession
    # a hot user's events meet their user-days in a join that may be split
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    state = spark.read.parquet(f"{root}/state/version={batch - 1}") if batch else empty_state(spark)
    results, after = fold_batch(activity, state)
    results.write.mode("overwrite").parquet(f"{root}/results/batch={batch}")
    after.write.mode("overwrite").parquet(f"{root}/state/version={batch}")


def start(stream: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Start the query that folds a streaming activity log into ``root`` (results/batch=n, state/version=n)."""
    return (
        stream.writeStream.foreachBatch(lambda rows, batch: run_batch(rows, batch, root))
        .option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    )


def results(spark: SparkSession, root: str) -> DataFrame:
    """The results of all batches so far."""
    return spark.read.option("basePath", f"{root}/results").parquet(f"{root}/results").drop("batch")
