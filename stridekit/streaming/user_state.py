"""Live user state as a keyed stateful stream (J1, J2) and stream scoring.

Every event is credited when it arrives, under the rules of the batch ledger
(``operators.activity.xp_ledger``). The stateful step does only what needs the
state: it folds a user's new user-days, column-wise, and returns each event's
credit and streak. What depends on single rows (relevance before it; level,
badge and hint after it) stays in column expressions shared with the ledger.

Order: within a micro-batch a user's events are taken by (ts, event_id). If the
source delivers a user's days in order (files or offsets by time), the stream
equals the ledger row for row, however the rows are cut into micro-batches on
day boundaries; a batch that ends inside a day continues that day's pool.

Late events (J2): an event of a day before the user's last active day changes
neither streak nor last day; it is credited against its own day's pool, under
the cap of the user's present level. The pools of the last ``KEEP_DAYS`` days
are state; an older event earns nothing, so no delivery order can pass a cap.
With a watermark, Spark drops rows behind it before they get here.

A group holds one user's events of one micro-batch: bound it at the source
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), or use ``state_table``, which splits a
user's events over tasks. ``late_events`` keeps the pools in event time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import xp as X
from ..operators.activity import with_relevance
from ..session import ensure_checkpoint_dir
from ..sources.tables import events_to_activity_log

KEEP_DAYS = 60

OUTPUT_COLUMNS = [
    "user_id", "event_id", "day", "final_xp", "was_capped", "daily_xp_before", "daily_xp_after", "daily_cap", "current_streak",
    "longest_streak", "shield_used", "streak_broken", "shields_remaining", "total_xp_before", "total_xp_after", "level_after",
    "badge_earned", "chatbot_hint",
]
FOLDED = (
    "user_id long, event_id long, day date, build string, rr long, final_xp int, daily_xp_before int, daily_xp_after int, daily_cap int, "
    "current_streak int, longest_streak int, shield_used boolean, streak_broken boolean, shields_remaining int, total_xp_before long, total_xp_after long"
)
_STATE = "total long, streak int, longest int, last_day int, month int, shields_used int, pool_days array<int>, pools array<int>"

# the streak multiplier as a step function: thresholds ascending, and the value from each on
_STEPS = sorted((days, mult) for days, mult, _ in K.STREAK_MILESTONES)
_STEP_AT = np.array([d for d, _ in _STEPS])
_STEP_MULT = np.array([1.0, *[m for _, m in _STEPS]])


def _streaks(days: np.ndarray, last: int, streak: int, longest: int, month: int, used: int) -> dict[str, list]:
    """Streak columns of ascending new days, continuing from the state (``last`` < 0: none)."""
    out: dict[str, list] = {c: [] for c in ("streak", "longest", "shield", "broken", "month", "used")}
    months = days.astype("datetime64[D]").astype("datetime64[M]").astype(int) + 1970 * 12 + 1
    for day, of in zip(days.tolist(), months.tolist()):
        gap = day - last if last >= 0 else None
        # the k-th two-day gap of a month takes the month's k-th shield
        used = (used if of == month else 0) + (gap == 2)
        shield = gap == 2 and used <= K.SHIELDS_PER_MONTH
        broken = gap is not None and gap >= 2 and not shield
        if gap != 0:  # 0: the batch goes on in the last active day
            streak = 1 if gap is None or broken else streak + 1
        last, month, longest = day, of, max(longest, streak)
        for c, v in zip(out, (streak, longest, shield, broken, month, min(used, K.SHIELDS_PER_MONTH))):
            out[c].append(v)
    return out


def _credits(prefix: np.ndarray, pool: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Credited XP after each of a day's events, and the cap that held for each; ``prefix``: running raw XP.

    Under one cap the credit is min(prefix, cap - pool). The cap changes behind the
    event with which the total reaches a cap boundary; from there the same holds
    for the rest of the day under the next cap.
    """
    bounds = K.cap_change_points()
    tiers = [b[1] for b in bounds] + [bounds[-1][2]]
    tier = sum(total >= b[0] for b in bounds)
    credit, cap = np.zeros(len(prefix), np.int64), np.zeros(len(prefix), np.int64)
    start, done, raw = 0, 0, 0
    while start < len(prefix):
        credit[start:] = done + np.minimum(prefix[start:] - raw, max(0, tiers[tier] - pool - done))
        cap[start:] = tiers[tier]
        if tier == len(bounds):
            break
        over = np.flatnonzero(total + credit[start:] >= bounds[tier][0])
        if not len(over):
            break
        last = start + int(over[0])
        start, done, raw = last + 1, int(credit[last]), int(prefix[last])
        tier = sum(total + done >= b[0] for b in bounds)
    return credit, cap


def fold_events(new: pd.DataFrame, state: tuple | None, keep: int | None = KEEP_DAYS) -> tuple[pd.DataFrame, tuple]:
    """One user's events of a micro-batch on top of the state: their result rows and the new state.

    Days ``keep`` or more days back earn nothing and leave the state (None: all given days count)."""
    total, streak, longest, last, month, used, pool_days, pools = state or (0, 0, 0, -1, -1, 0, [], [])
    pool = dict(zip(pool_days, pools, strict=True))
    order = np.lexsort((new["event_id"].to_numpy(), new["ts"].to_numpy()))
    of = new["day"].to_numpy()[order].astype("datetime64[D]").astype(int)
    days, place = np.unique(of, return_inverse=True)
    late = int(np.searchsorted(days, last))  # the days before the last active one come first
    own = _streaks(days[late:], last, streak, longest, month, used)
    table = {c: np.array([v] * late + own[c])[place] for c, v in (("streak", streak), ("longest", longest), ("shield", False), ("broken", False), ("used", used))}
    mult = _STEP_MULT[np.searchsorted(_STEP_AT, table["streak"], side="right")]
    rr = np.rint(new["base"].to_numpy(float)[order] * mult).astype(np.int64)
    newest = max(last, int(days[-1]))
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])  # rows stand by time, so by day
    before, after, t_before, t_after, caps = (np.zeros(len(of), np.int64) for _ in range(5))
    for lo, hi in zip(starts, np.r_[starts[1:], len(of)]):
        d, day = int(of[lo]), slice(lo, hi)
        known = keep is None or d > newest - keep
        had = pool.get(d, 0)
        credit, caps[day] = _credits(np.cumsum(rr[day]), had, total) if known else (np.zeros(hi - lo, np.int64), 0)
        prior = np.r_[0, credit[:-1]]
        before[day], after[day], t_before[day], t_after[day] = had + prior, had + credit, total + prior, total + credit
        total += int(credit[-1])
        if known:
            pool[d] = had + int(credit[-1])
    first = np.zeros(len(of), bool)
    first[starts] = True
    if late < len(days):
        streak, longest, month, used = (own[c][-1] for c in ("streak", "longest", "month", "used"))
        last = int(days[-1])
    kept = sorted(d for d in pool if keep is None or d > last - keep)
    out = pd.DataFrame({
        **{c: new[c].to_numpy()[order] for c in ("user_id", "event_id", "day", "build")}, "rr": rr,
        "final_xp": (after - before).astype(np.int32), "daily_xp_before": before.astype(np.int32), "daily_xp_after": after.astype(np.int32),
        "daily_cap": caps.astype(np.int32), "current_streak": table["streak"].astype(np.int32), "longest_streak": table["longest"].astype(np.int32),
        "shield_used": table["shield"] & first, "streak_broken": table["broken"] & first,
        "shields_remaining": (K.SHIELDS_PER_MONTH - table["used"]).astype(np.int32), "total_xp_before": t_before, "total_xp_after": t_after,
    })
    return out, (int(total), streak, longest, last, month, used, [int(d) for d in kept], [int(pool[d]) for d in kept])


def _step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows, after = fold_events(pd.concat(list(batches), ignore_index=True), state.get if state.exists else None)
    state.update(after)
    yield rows


def live_user_state(activity: DataFrame, watermark: str | None = None) -> DataFrame:
    """Streaming activity log -> one result row per event."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    a = activity.withWatermark("ts", watermark) if watermark else activity
    base = F.col("duration_minutes").cast("double") * F.col("intensity_mult") * F.col("relevance_mult")
    rows = with_relevance(a).select("user_id", "event_id", "ts", "day", "build", base.alias("base"))
    out = rows.groupBy("user_id").applyInPandasWithState(_step, FOLDED, _STATE, "append", GroupStateTimeout.NoTimeout)
    return with_announcements(out)


def with_announcements(out: DataFrame) -> DataFrame:
    """What follows from single folded rows: capped or not, level, badge and hint."""
    before, after = X.badge_index("total_xp_before"), X.badge_index("total_xp_after")
    badge = F.when(after > before, X.badge_name(F.col("build"), after))
    room = F.greatest(F.lit(0), F.col("daily_cap") - F.col("daily_xp_before"))
    lively = F.col("badge_earned").isNotNull() | X.streak_milestone("current_streak").isNotNull()
    return (
        out.withColumn("was_capped", F.col("rr") > room)
        .withColumn("level_after", X.level_of("total_xp_after"))
        .withColumn("badge_earned", badge)
        .withColumn("chatbot_hint", F.when(F.col("streak_broken"), "support_mode").when(lively, "hype_mode"))
        .select(*OUTPUT_COLUMNS)
    )


def _scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming query to completion (``availableNow``) into a parquet
    folder under the shared checkpoint folder and read the result back."""
    spark = stream.sparkSession
    root = _scratch(spark, name)
    q = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", os.path.join(root, "checkpoint"))
        .option("path", os.path.join(root, "data"))
        .trigger(availableNow=True)
        .start()
    )
    finish(q)
    return spark.read.parquet(os.path.join(root, "data"))


def finish(query) -> None:
    """Wait for a query that ends by itself; its error, if there is one, is raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def stream_files(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Stream of the files of ``path`` (a table folder or one file), oldest first, ``max_files_per_trigger`` a micro-batch."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    files = table.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a file: a stream reads folders, so its folder under its name
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def stream_events(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Stream of the activity log of event files."""
    return events_to_activity_log(stream_files(spark, path, max_files_per_trigger))


def score_stream(model, features_stream: DataFrame) -> DataFrame:
    """Apply a fitted ``PipelineModel`` to a streaming DataFrame."""
    return model.transform(features_stream)
