"""The live user-state stream: equal to the ledger over several files and batches, late events against their own pools."""

import datetime as dt
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from stridekit.functions import constants as K
from stridekit.operators import activity as A
from stridekit.sources.tables import events_to_activity_log, read_table
from stridekit.operators import anomaly as AN
from stridekit.streaming import late_events as LE
from stridekit.streaming import scoring as SC
from stridekit.streaming import state_table as ST
from stridekit.streaming import user_state as US

from .conftest import SF001

COLS = US.OUTPUT_COLUMNS


def folder_of(frames):
    """A table folder whose files are the frames, in order of age."""
    flat = tempfile.mkdtemp(prefix="stream-src-", dir="/tmp")
    for i, df in enumerate(frames):
        out = tempfile.mkdtemp(prefix="stream-part-", dir="/tmp")
        df.coalesce(1).write.mode("overwrite").parquet(out)
        (part,) = [f for f in os.listdir(out) if f.endswith(".parquet")]
        to = os.path.join(flat, f"e{i:03d}.parquet")
        os.link(os.path.join(out, part), to)
        os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
    return flat


def test_stream_over_a_folder_of_files_in_time_order_equals_the_ledger(spark):
    ev = read_table(spark, SF001, "events")
    days = sorted(r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().collect())[:10]
    noon = F.hour("ts") < 12  # one of the days comes in two files
    frames = []
    for i, d in enumerate(days):
        one = ev.where(F.to_date("ts") == F.lit(d))
        frames += [one.where(noon), one.where(~noon)] if i == 4 else [one]
    got = US.run_to_table(US.live_user_state(US.stream_events(spark, folder_of(frames))), "test")
    batch = A.xp_ledger(events_to_activity_log(ev.where(F.to_date("ts").isin(days)))).select(*COLS)
    # the second file of a day repeats no first-event flags, so the flags are compared per day
    flags = ["shield_used", "streak_broken", "chatbot_hint"]
    assert got.count() == batch.count()
    assert got.drop(*flags).exceptAll(batch.drop(*flags)).count() == 0


def events(days, minutes=480, user=1, first=0):
    rows = []
    for i, d in enumerate(days):
        ts = pd.Timestamp(d) + pd.Timedelta(hours=8, minutes=first + i)
        rows.append({"user_id": user, "event_id": first + i, "ts": ts, "day": ts.date(), "build": "strength", "base": float(minutes)})
    return pd.DataFrame(rows)


def test_late_events_share_their_days_pool():
    state = None
    for d in ("2024-01-01", "2024-01-02", "2024-01-03"):
        out, state = US.fold_events(events([d]), state)
    assert out["current_streak"].tolist() == [3]
    late, state = US.fold_events(events(["2024-01-02"] * 3, first=10), state)
    assert late["final_xp"].tolist() == [120, 0, 0]  # 480 of 600 were credited on the day itself
    assert late["current_streak"].tolist() == [3, 3, 3] and not late["streak_broken"].any()
    again, state = US.fold_events(events(["2024-01-02"], first=20), state)
    assert again["final_xp"].tolist() == [0] and state[3] == (dt.date(2024, 1, 3) - dt.date(1970, 1, 1)).days
    gap, state = US.fold_events(events(["2023-12-31"] * 3, first=30), state)  # a day that had no event in time
    assert gap["final_xp"].tolist() == [480, 120, 0]
    old, state = US.fold_events(events(["2023-01-01"], first=40), state)
    assert old["final_xp"].tolist() == [0]


def test_caps_rise_within_a_day():
    """Stepping one event at a time gives the same credits as the day at once, across both cap boundaries."""
    for start in (6_400, 22_900, 6_000):
        state = (start, 3, 3, 19_722, 2024 * 12, 0, [], [])
        day = "2024-01-01"
        whole, end = US.fold_events(events([day] * 12, minutes=97), state)
        rows, s = [], state
        for i in range(12):
            one, s = US.fold_events(events([day], minutes=97, first=i), s)
            rows.append(one)
        assert pd.concat(rows)["final_xp"].tolist() == whole["final_xp"].tolist()
        assert pd.concat(rows)["daily_cap"].tolist() == whole["daily_cap"].tolist() and s[0] == end[0]
        assert set(whole["daily_cap"]) <= {c for _, c in K.DAILY_CAP_TIERS}


def test_shields_and_months_across_batches():
    days = ["2024-01-01", "2024-01-03", "2024-01-05", "2024-01-07", "2024-01-09", "2024-01-11", "2024-02-01", "2024-02-03"]
    whole, _ = US.fold_events(events(days, minutes=10), None)
    state, rows = None, []
    for i, d in enumerate(days):
        one, state = US.fold_events(events([d], minutes=10, first=i), state)
        rows.append(one)
    for c in ("current_streak", "longest_streak", "shield_used", "streak_broken", "shields_remaining"):
        assert pd.concat(rows)[c].tolist() == whole[c].tolist(), c
    assert whole["current_streak"].tolist() == [1, 2, 3, 4, 5, 1, 1, 2]
    assert whole["shield_used"].tolist() == [False, True, True, True, True, False, False, True]
    assert whole["shields_remaining"].tolist() == [4, 3, 2, 1, 0, 0, 4, 3]


# ------------------------------------------------------- state table and event time

def activity_rows(spark, rows):
    return spark.createDataFrame(
        [(u, e, dt.datetime.combine(dt.date(2024, 1, 1) + dt.timedelta(days=d), dt.time(m // 60, m % 60)), minutes, "competitive_gaming" if e % 3 else "reading", K.INTENSITY[e % 3][0], K.BUILDS[u % 7]) for u, e, d, m, minutes in rows],
        "user_id long, event_id long, ts timestamp, duration_minutes int, activity_type string, intensity string, build string",
    ).withColumn("day", F.to_date("ts"))


def random_batches(seed, hot=400):
    """Three micro-batches of days 0-9, 8-17, 16-40 with late rows, several boundary days, and one user with most events."""
    import random

    rng = random.Random(seed)
    batches, e = [], 0
    for lo, hi in ((0, 10), (8, 18), (16, 40)):
        rows = []
        for u in [1] * hot + [2, 3, 4, 5] * 15:
            d = rng.randrange(lo, hi) if u != 4 else rng.randrange(lo, hi, 2)
            if rng.random() < 0.05:
                d = rng.randrange(0, hi)
            rows.append((u, e, d, rng.randrange(24 * 60), rng.choice([1, 5, 30, 200, 480])))
            e += 1
        batches.append(rows)
    batches.append([(6, e, 200, 5, 480), (1, e + 1, 3, 1, 480), (1, e + 2, 150, 1, 480), (2, e + 3, 39, 1, 480)])
    return batches


def folded(spark, batches):
    """The same batches through the plain fold of one user after the other."""
    out, states = {}, {}
    for rows in batches:
        scored = A.with_relevance(activity_rows(spark, rows))
        base = F.col("duration_minutes").cast("double") * F.col("intensity_mult") * F.col("relevance_mult")
        df = scored.select("user_id", "event_id", "ts", "day", "build", base.alias("base")).toPandas()
        for u, part in df.groupby("user_id"):
            got, states[u] = US.fold_events(part, states.get(u))
            for r in got.to_dict("records"):
                out[r["event_id"]] = tuple(r[c] for c in ("final_xp", "daily_xp_before", "daily_xp_after", "daily_cap", "current_streak", "longest_streak", "shield_used", "streak_broken", "shields_remaining", "total_xp_before", "total_xp_after"))
    return out


def test_state_table_equals_the_plain_fold_and_replays(spark, tmp_path):
    batches = random_batches(1)
    want = folded(spark, batches)
    for n, rows in enumerate(batches):
        ST.run_batch(activity_rows(spark, rows), n, str(tmp_path))

    def read():
        return {r["event_id"]: tuple(r[c] for c in ("final_xp", "daily_xp_before", "daily_xp_after", "daily_cap", "current_streak", "longest_streak", "shield_used", "streak_broken", "shields_remaining", "total_xp_before", "total_xp_after"))
                for r in ST.results(spark, str(tmp_path)).collect()}

    got = read()
    assert got == want and {v[3] for v in got.values()} >= {0, 600, 800, 1000}
    state = sorted(map(str, spark.read.parquet(f"{tmp_path}/state/version=3").collect()))
    for n in (1, 2, 3):  # batches that are run again write the same rows and states
        ST.run_batch(activity_rows(spark, batches[n]), n, str(tmp_path))
    assert read() == want and sorted(map(str, spark.read.parquet(f"{tmp_path}/state/version=3").collect())) == state


def test_state_table_where_a_boundary_is_reached_only_beyond_the_top_cap(spark, tmp_path):
    kind = next(i for i, (n, _) in enumerate(K.INTENSITY) if n == "intense")
    rows = [(u, 3 * (40 * u + d) + kind, d, 60, 480) for u in range(7) for d in range(40)]  # one large event a day
    ST.run_batch(activity_rows(spark, rows), 0, str(tmp_path))
    want = folded(spark, [rows])
    got = {r["event_id"]: (r["final_xp"], r["daily_cap"], r["total_xp_after"]) for r in ST.results(spark, str(tmp_path)).collect()}
    assert got == {e: (v[0], v[3], v[10]) for e, v in want.items()} and {v[1] for v in got.values()} >= {600, 800, 1000}


def test_state_table_as_a_stream(spark):
    ev = read_table(spark, SF001, "events")
    days = sorted(r.d for r in ev.select(F.to_date("ts").alias("d")).distinct().collect())[:6]
    stream = US.stream_events(spark, folder_of([ev.where(F.to_date("ts") == F.lit(d)) for d in days]), max_files_per_trigger=3)
    root = US._scratch(spark, "test")
    US.finish(ST.start(stream, root))
    assert len(os.listdir(f"{root.removeprefix('file:')}/state")) == 2  # two micro-batches, a version each
    got, batch = ST.results(spark, root), A.xp_ledger(events_to_activity_log(ev.where(F.to_date("ts").isin(days)))).select(*COLS)
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_late_events_in_event_time(spark):
    """Late rows draw on their day's pool, rows behind the watermark do not come through, and pools of closed days leave the state."""
    batches = [[(1, 1, 0, 600, 480), (1, 2, 1, 600, 480)], [(1, 3, 2, 600, 480), (1, 4, 1, 700, 480)], [(1, 5, 20, 600, 30)], [(1, 6, 21, 600, 30)], [(1, 7, 2, 900, 480), (1, 8, 22, 600, 30)]]
    root = US._scratch(spark, "test-late")
    for rows in batches:
        activity_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(activity_rows(spark, []).schema).parquet(f"{root}/src")
        US.finish(LE.late_user_state(stream, "5 days").writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start())
    got = {r["event_id"]: r for r in spark.read.parquet(f"{root}/out").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 8}  # the last batch's late row is behind the watermark
    assert got[4]["daily_xp_before"] == got[2]["daily_xp_after"] and got[4]["current_streak"] == got[2]["current_streak"] and not got[4]["streak_broken"]
    assert got[3]["current_streak"] == 3 and got[5]["streak_broken"]
    pools = spark.read.format("statestore").option("stateVarName", "pools").load(f"{root}/cp")
    kept = {r["day"] for r in pools.select("user_map_key.day").collect()}
    first = (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days
    assert kept and min(kept) >= first + 16


def test_features_out_of_the_stream_equal_the_batch_job(spark):
    """Two micro-batches out of order; the days that the watermark has closed equal the batch features."""
    rows = [r for part in random_batches(2, hot=60)[:3] for r in part]
    log = activity_rows(spark, [r for r in rows if r[2] < 30])
    root = US._scratch(spark, "test-features")
    late = F.pmod("event_id", F.lit(5)) == 0
    for part in (log.where("day < '2024-01-20'").where(~late), log.where("day >= '2024-01-20' OR event_id % 5 = 0")):
        part.write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/src")
        US.finish(SC.user_day_features(stream, "40 days").writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start())
    assert spark.read.parquet(f"{root}/out").count() == 0  # nothing is closed yet
    end = activity_rows(spark, [(9, 10**6, 100, 0, 5)])
    end.write.mode("append").parquet(f"{root}/src")
    US.finish(SC.user_day_features(spark.readStream.schema(log.schema).parquet(f"{root}/src"), "40 days").writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start())
    got, want = spark.read.parquet(f"{root}/out"), AN.user_day_features(log)
    assert got.count() == want.count() > 50 and got.exceptAll(want.select(*got.columns)).count() == 0


def test_only_summed_days_reach_the_features_python_state(spark):
    """The events of a day are added up by Spark's aggregate; the Python state gets a row a user-day."""
    root = US._scratch(spark, "test-summed")
    activity_rows(spark, [(1, e, e // 50, e % 50, 5) for e in range(500)] + [(2, 10**6, 60, 0, 5)]).write.parquet(f"{root}/src")
    stream = spark.readStream.schema(activity_rows(spark, []).schema).parquet(f"{root}/src")
    q = SC.user_day_features(stream, "2 days").writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start()
    US.finish(q)
    assert "stateStoreSave" in {o["operatorName"] for p in q.recentProgress for o in p["stateOperators"]}
    assert spark.read.parquet(f"{root}/out").select("activities_per_day").collect() == [(50,)] * 10


def test_a_users_late_pools_share_one_timer():
    """One timer a micro-batch, at the end of the newest day, serves all days before it."""
    class Handle:
        timers = []

        def registerTimer(self, at):
            self.timers.append(at)

    class Held(dict):
        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, key, value):
            self[key] = value

        def containsKey(self, key):
            return key in self

        getValue = dict.get

    class Kept:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    p = LE.UserDays()
    p.handle, p.user, p.pools = Handle(), Kept(), Held()
    days = [f"2024-01-{d:02d}" for d in range(1, 9)]
    (out,) = p.handleInputRows((1,), iter([events(days, minutes=10)]), None)
    assert len(out) == 8 and len(p.pools) == 8 and len(p.handle.timers) == 1
    (out,) = p.handleInputRows((1,), iter([events(days[2:3], minutes=10, first=50)]), None)
    assert out["daily_xp_before"].tolist() == [10] and len(p.handle.timers) == 1


def test_users_folded_together_equal_users_folded_alone(spark):
    """Several micro-batches with late rows, cap boundaries crossed within a day, and users that come and go."""
    import numpy as np

    users, pools, states = np.zeros((0, 7), np.int64), {}, {}
    caps = set()
    for rows in random_batches(7, hot=600):
        rows = rows + [(u, 10**6 + 1000 * rows[0][1] + i, rows[0][2], 60 * (u % 24), 480) for i, u in enumerate(range(50, 90, 1 + len(rows) % 3))]
        base = F.col("duration_minutes").cast("double") * F.col("intensity_mult") * F.col("relevance_mult")
        df = A.with_relevance(activity_rows(spark, rows)).select("user_id", "event_id", "ts", "day", "build", base.alias("base")).toPandas()
        got, users, touched = LE.fold_users(df, users, pools)
        pools |= touched
        want = []
        for u, part in df.groupby("user_id"):
            one, states[u] = US.fold_events(part, states.get(u), keep=None)
            want.append(one)
        got, want = (x.sort_values("event_id", ignore_index=True) for x in (got, pd.concat(want)))
        pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False)
        caps |= set(got["daily_cap"])
    assert caps == {c for _, c in K.DAILY_CAP_TIERS}
    assert [tuple(r) for r in users.tolist()] == [(u, *states[u][:6]) for u in sorted(states)]
    assert {(u, d): x for d, rows in pools.items() for u, x in rows.tolist()} == {(u, d): x for u, s in states.items() for d, x in zip(s[6], s[7])}


def test_late_events_of_many_users_are_one_group_a_bucket(spark):
    """The state operator has one row for the users of a bucket and one a day, however many users there are; null is a user too."""
    batches = random_batches(3, hot=40)[:2]
    batches[1] += [(u, 5000 + u, 15, 30, 240) for u in range(100, 140)]
    root = US._scratch(spark, "test-buckets")
    got = {}
    for rows in batches:
        log = activity_rows(spark, rows).withColumn("user_id", F.nullif("user_id", F.lit(3)))
        log.write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/src")
        US.finish(LE.late_user_state(stream, "40 days", buckets=2).writeStream.format("parquet").option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").trigger(availableNow=True).start())
    kept = spark.read.format("statestore").option("stateVarName", "user").load(f"{root}/cp")
    assert kept.count() <= 2
    for r in spark.read.parquet(f"{root}/out").collect():
        got[r["event_id"]] = tuple(r[c] for c in ("final_xp", "daily_xp_before", "daily_xp_after", "daily_cap", "current_streak", "longest_streak", "shield_used", "streak_broken", "shields_remaining", "total_xp_before", "total_xp_after"))
        assert (r["user_id"] is None) == (r["event_id"] in {row[1] for rows in batches for row in rows if row[0] == 3})
    assert got == folded(spark, batches)
