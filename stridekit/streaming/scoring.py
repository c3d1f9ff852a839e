"""User-day features and message signals from streams.

``user_day_features`` makes the batch job's features out of the event stream, in event time: open
user-days are the state of a windowed aggregate, and a day's row comes out when the watermark passes
its end; a second, small state keeps each user's last closed day, so the gap to it is known. Rows may
arrive in any order within the watermark's delay. What depends on single rows (rounding, types, models) are the batch job's
column expressions. ``message_signals`` joins a message stream with a static table of class
probabilities and applies the lexicon rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import anomaly as AN
from ..operators import sentiment as SE
from ..operators.activity import intensity_multiplier
from .late_events import use_rocksdb

_DAYS = "user_id long, day date, n long, xp double, switches long, minutes long, longest long, gap long"


class LastDay(StatefulProcessor):
    """Each user's last closed day (days since 1970)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A user's newly closed days, in order, each with the gap to the closed day before it (0 on the first)."""
        days = pd.concat(list(rows), ignore_index=True).sort_values("day", kind="stable", ignore_index=True)
        at = days["day"].to_numpy().astype("datetime64[D]").astype("int64")
        before = self.last.get()
        days["gap"] = np.diff(at, prepend=int(before[0]) if before is not None else at[0])
        self.last.update((int(at[-1]),))
        yield days

    def close(self) -> None:
        pass


def user_day_features(activity: DataFrame, delay: str) -> DataFrame:
    """G1 out of a streaming activity log: a row for each user-day when the watermark (``delay`` behind the latest event) has passed it."""
    use_rocksdb(activity.sparkSession)
    timed = activity.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    xp = F.col("duration_minutes").cast("double") * intensity_multiplier("intensity")
    rows = timed.select("user_id", "event_id", "ts", "day", "intensity", F.col("duration_minutes").cast("long").alias("duration_minutes"), xp.alias("xp"))
    open_days = rows.groupBy("user_id", "day", F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("xp"), F.lit(0.0)).alias("xp"),
        F.sort_array(F.collect_list(F.struct("ts", "event_id", "intensity"))).alias("sessions"),
        F.sum("duration_minutes").alias("minutes"), F.max("duration_minutes").alias("longest"),
    )
    kinds = F.col("sessions.intensity")
    # the last one meets null, which is no switch
    pairs = F.zip_with(kinds, F.slice(kinds, F.lit(2), F.size(kinds)), lambda a, b: F.coalesce(a != b, F.lit(False)))
    switches = F.size(F.filter(pairs, lambda x: x)).cast("long")
    closed = open_days.select("user_id", "day", "n", "xp", switches.alias("switches"), "minutes", "longest")
    # one small row a user-day; the events stay in the aggregate's state
    out = closed.groupBy("user_id").transformWithStateInPandas(LastDay(), _DAYS, "Append", "None")
    return out.select("user_id", "day", *AN.feature_columns("n", "xp", "switches", "minutes", "longest", "gap"))


def score_days(features: DataFrame, stats: DataFrame, model) -> DataFrame:
    """Weak labels, scaling by the static ``stats`` row, a fitted pipeline's scores and the type rules, on a stream of features."""
    return AN.score(model, AN.apply_scaler(AN.weak_labels(features), stats))


def message_signals(messages: DataFrame, priors: DataFrame, text: str = "text") -> DataFrame:
    """D11-D14 on a stream of messages: lexicon signals blended with the class probabilities m_<label> of the one-row table ``priors``."""
    joined = messages.withColumn("_one", F.lit(1)).join(F.broadcast(priors.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return SE.blend(joined, text, {l: f"m_{l}" for l in SE.LABELS})
