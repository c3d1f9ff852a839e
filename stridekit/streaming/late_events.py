"""Out-of-order events in event time (J2), on Spark's arbitrary state operator.

A user's state is a row (total, streak, longest, last active day, month, shields used)
and, for each day, the XP that the day's pool has given. An event of an earlier day than the
last active one leaves the streak and the last day alone and draws on its own day's
pool, under the cap of the user's present level.

Users are dealt over ``BUCKETS`` buckets by a hash. A bucket is one group of the state operator: its users are folded
together, column-wise, its state is one value with a row a user and a map from day to the pools of that day, so a
micro-batch costs a few calls of the state store for each bucket and not for each user. The newest day of a bucket's rows
has an event-time timer at its end: when the watermark passes it, Spark drops every further row of that day and those
before it before they get here, so their entries go. State stays bounded by the watermark's delay, and no delivery order can
give a day more than its cap.

Within a micro-batch a user's rows are taken by (ts, event_id). A bucket's rows of one micro-batch are
one group, and its value is written anew with each; ``state_table`` is for streams in which one user sends most of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K
from ..operators.activity import raw_xp, with_relevance
from .user_state import _STEP_AT, _STEP_MULT, FOLDED, with_announcements

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 256  # a checkpoint's state is read with the number it was written with
_NOBODY = -(1 << 63)  # stands for a user id of null
_DAY_MS = 86_400_000
# rows of 64-bit integers, by user: id and the six numbers; id and XP
_USER, _USERS, _POOL, _POOLS = 7, "rows binary", 2, "rows binary"


def _rows(value: tuple | None, width: int) -> np.ndarray:
    """A state value as a table of integers."""
    return np.frombuffer(value[0] if value is not None else b"", np.int64).reshape(-1, width)


def _merged(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rows by id, those of ``new`` in place of ``old`` ones with their id."""
    both = np.concatenate([old[~np.isin(old[:, 0], new[:, 0])], new])
    return both[np.argsort(both[:, 0])]


def _found(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each id is among rows ordered by id, and whether it is."""
    at = np.minimum(np.searchsorted(rows[:, 0], ids), max(len(rows) - 1, 0))
    return at, rows[at, 0] == ids if len(rows) else np.zeros(len(ids), bool)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of several runs, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _streaks(of: np.ndarray, day: np.ndarray, turns: list[np.ndarray], users: np.ndarray, seen: np.ndarray) -> dict[str, np.ndarray]:
    """Streak columns of user-days (``of``: the user's place, ``turns``: their k-th user-days), as ``user_state._streaks``
    has them; ``users`` is brought up to date."""
    _, _, streak, longest, last, month, used = users.T  # views
    months = day.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) + 1970 * 12 + 1
    late = seen[of] & (day < last[of])
    out = {"streak": streak[of], "longest": longest[of], "used": used[of], "shield": np.zeros(len(of), bool), "broken": np.zeros(len(of), bool)}
    seen = seen.copy()
    for turn in turns:
        i = turn[~late[turn]]
        u = of[i]
        gap, known = day[i] - last[u], seen[u]
        count = np.where(month[u] == months[i], used[u], 0) + (known & (gap == 2))
        shield = known & (gap == 2) & (count <= K.SHIELDS_PER_MONTH)
        broken = known & (gap >= 2) & ~shield
        streak[u] = np.where(known & (gap == 0), streak[u], np.where(known & ~broken, streak[u] + 1, 1))
        longest[u] = np.maximum(longest[u], streak[u])
        last[u], month[u], used[u], seen[u] = day[i], months[i], np.minimum(count, K.SHIELDS_PER_MONTH), True
        for c, x in (("streak", streak[u]), ("longest", longest[u]), ("used", used[u]), ("shield", shield), ("broken", broken)):
            out[c][i] = x
    return out


def _credits(prefix: np.ndarray, size: np.ndarray, pool: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``user_state._credits`` of several user-days at once, with ``size`` events each."""
    bounds = np.array([b[0] for b in K.cap_change_points()])
    tiers = np.array([b[1] for b in K.cap_change_points()] + [K.cap_change_points()[-1][2]])
    first = np.cumsum(size) - size
    start, done, raw = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    credit, cap = np.zeros(len(prefix), np.int64), np.zeros(len(prefix), np.int64)
    go = np.arange(len(size))
    while len(go):
        left = size[go] - start[go]
        at, seg = _spread(first[go] + start[go], left), np.repeat(go, left)
        tier = np.searchsorted(bounds, total + done, side="right")
        credit[at] = done[seg] + np.minimum(prefix[at] - raw[seg], np.maximum(0, tiers[tier] - pool - done)[seg])
        cap[at] = tiers[tier][seg]
        over = np.flatnonzero(total[seg] + credit[at] >= np.r_[bounds, np.iinfo(np.int64).max][tier][seg])
        go, place = np.unique(seg[over], return_index=True)  # the first event over
        last = at[over[place]]
        start[go], done[go], raw[go] = last + 1 - first[go], credit[last], prefix[last]
        go = go[start[go] < size[go]]
    return credit, cap


def fold_users(new: pd.DataFrame, users: np.ndarray, pools: dict[int, np.ndarray]) -> tuple[pd.DataFrame, np.ndarray, dict[int, np.ndarray]]:
    """``user_state.fold_events`` of all users of a micro-batch at once, without a limit of days.

    ``users``: rows by id (id, total, streak, longest, last day, month, shields used); ``pools``: for each day rows by id (id, XP).
    Returns the events' result rows, the users, and the pools of the days that have events.
    """
    order = np.lexsort((new["event_id"].to_numpy(), new["ts"].to_numpy(), new["user_id"].to_numpy()))
    user = new["user_id"].to_numpy()[order]
    of_day = new["day"].to_numpy()[order].astype("datetime64[D]").astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (of_day[1:] != of_day[:-1])])  # user-days
    size = np.diff(np.r_[starts, len(user)])
    day = of_day[starts]
    ids, first, of = np.unique(user[starts], return_index=True, return_inverse=True)
    mine = np.zeros((len(ids), _USER), np.int64)
    mine[:, 5] = -1
    at, seen = _found(users, ids)
    mine[seen] = users[at[seen]]
    mine[:, 0] = ids
    kth = np.arange(len(starts)) - first[of]
    by = np.argsort(kth, kind="stable")
    turns = np.split(by, np.cumsum(np.bincount(kth))[:-1])  # every user's first day, every user's second, ...
    days = _streaks(of, day, turns, mine, seen)
    had = np.zeros(len(starts), np.int64)
    by = np.argsort(day, kind="stable")
    dates, begin = np.unique(day[by], return_index=True)
    groups = dict(zip(dates.tolist(), np.split(by, begin[1:])))
    for d, i in groups.items():
        if d in pools:
            at, there = _found(pools[d], user[starts[i]])
            had[i[there]] = pools[d][at[there], 1]

    table = {c: np.repeat(x, size) for c, x in days.items()}
    rr = np.rint(new["base"].to_numpy(float)[order] * _STEP_MULT[np.searchsorted(_STEP_AT, table["streak"], side="right")]).astype(np.int64)
    running = np.cumsum(rr)
    prefix = running - np.repeat(running[starts] - rr[starts], size)
    credit, caps = np.zeros(len(user), np.int64), np.zeros(len(user), np.int64)
    opening, earned = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)  # the total before a user-day, its credit
    total = mine[:, 1]
    for i in turns:
        at = _spread(starts[i], size[i])
        opening[i] = total[of[i]]
        credit[at], caps[at] = _credits(prefix[at], size[i], had[i], opening[i])
        earned[i] = credit[starts[i] + size[i] - 1]
        total[of[i]] += earned[i]
    head = np.zeros(len(user), bool)
    head[starts] = True
    prior = np.where(head, 0, np.r_[0, credit[:-1]])
    pool, before = np.repeat(had, size), np.repeat(opening, size)
    out = pd.DataFrame({
        "user_id": user, **{c: new[c].to_numpy()[order] for c in ("event_id", "day", "build")}, "rr": rr,
        "final_xp": (credit - prior).astype(np.int32), "daily_xp_before": (pool + prior).astype(np.int32), "daily_xp_after": (pool + credit).astype(np.int32),
        "daily_cap": caps.astype(np.int32), "current_streak": table["streak"].astype(np.int32), "longest_streak": table["longest"].astype(np.int32),
        "shield_used": table["shield"] & head, "streak_broken": table["broken"] & head,
        "shields_remaining": (K.SHIELDS_PER_MONTH - table["used"]).astype(np.int32), "total_xp_before": before + prior, "total_xp_after": before + credit,
    })
    none = np.zeros((0, _POOL), np.int64)
    given = {d: _merged(pools.get(d, none), np.column_stack([user[starts[i]], had[i] + earned[i]])) for d, i in groups.items()}
    return out, _merged(users, mine), given


class UserDays(StatefulProcessor):
    """The fold of a bucket's users over a value and a map of day pools (days since 1970)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.user = handle.getValueState("user", _USERS)
        self.pools = handle.getMapState("pools", "day int", _POOLS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        held = {int(day): _rows(value, _POOL) for (day,), value in self.pools.iterator()}
        out, users, pools = fold_users(new, _rows(self.user.get(), _USER), held)
        self.user.update((users.tobytes(),))
        for day, pool in pools.items():
            self.pools.updateValue((day,), (pool.tobytes(),))
        newest = max(pools)
        if not held or newest > max(held):  # its timer takes the days before it too
            self.handle.registerTimer((newest + 1) * _DAY_MS)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS - 1
        days = [int(day) for (day,) in self.pools.keys()]
        if all(day <= closed for day in days):
            self.pools.clear()
        else:
            for day in days:
                if day <= closed:
                    self.pools.removeKey((day,))
        return iter(())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def late_user_state(activity: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Streaming activity log -> one result row per event that is not behind the watermark (``delay`` behind the latest event)."""
    use_rocksdb(activity.sparkSession)
    base = raw_xp(F.col("duration_minutes"), F.col("intensity_mult"), F.col("relevance_mult"), F.lit(1.0))
    timed = activity.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    user = F.coalesce("user_id", F.lit(_NOBODY))  # a null would make all ids of the group floats
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
    rows = with_relevance(timed).select(bucket.alias("bucket"), user.alias("user_id"), "event_id", "ts", "day", "build", base.alias("base"))
    folded = rows.groupBy("bucket").transformWithStateInPandas(UserDays(), FOLDED, "Append", "EventTime")
    return with_announcements(folded.withColumn("user_id", F.nullif("user_id", F.lit(_NOBODY))))
