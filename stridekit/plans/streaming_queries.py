"""Registered streaming queries: each runs a Structured Streaming job to
completion (``availableNow``) over the given tables and returns its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as AN
from ..operators import sentiment as SE
from ..sources.tables import events_to_activity_log, read_table
from ..streaming import late_events as LE
from ..streaming import scoring as SC
from ..streaming import state_table as ST
from ..streaming import user_state as US
from . import params as P
from . import sql_activity as SA
from . import sql_text as S
from .anomaly_queries import _features_sql, _split
from .corpus_queries import labelled
from .registry import register
from .sentiment_queries import blend_sql

_STREAM_COLS = US.OUTPUT_COLUMNS


@register("stream_user_state", f"""
    WITH led AS ({SA.ledger_sql()})
    SELECT {", ".join(_STREAM_COLS)} FROM led""")
def q_stream_user_state(spark, sf):
    """The live user state over ``events``, folded batch by batch into a versioned state
    table; on in-order delivery it equals the batch ledger (the oracle is the ledger SQL)."""
    stream = US.stream_events(spark, f"{sf.rstrip('/')}/events.parquet", max_files_per_trigger=1000)
    root = US._scratch(spark, "user_state")
    US.finish(ST.start(stream, root))
    return ST.results(spark, root)


@register("stream_late_events", SA.late_ledger_sql(P.LATE_EVERY, P.LATE_DAYS, P.BATCH_DAYS))
def q_stream_late_events(spark, sf):
    """``events`` replayed in micro-batches by the day of arrival, a part of them days late; the oracle
    steps through each user's events in order of arrival."""
    events = read_table(spark, sf, "events")
    late = F.when(F.pmod("event_id", F.lit(P.LATE_EVERY)) == 3, 1 + F.pmod("event_id", F.lit(P.LATE_DAYS))).otherwise(0)
    first = events.agg(F.min(F.to_date("ts")).alias("first")).first()["first"]
    arrived = events.withColumn("batch", F.floor((F.datediff(F.to_date("ts"), F.lit(first)) + late) / P.BATCH_DAYS).cast("int"))
    root = US._scratch(spark, "late")
    arrived.write.partitionBy("batch").parquet(f"{root}/arrived")
    batches = sorted(r["batch"] for r in arrived.select("batch").distinct().collect())  # one number a micro-batch
    for n in batches:
        # what has arrived by now; each run takes what is new
        spark.read.parquet(f"{root}/arrived/batch={n}").write.mode("append").parquet(f"{root}/events")
        stream = events_to_activity_log(spark.readStream.schema(events.schema).parquet(f"{root}/events"))
        US.finish(LE.late_user_state(stream, f"{P.LATE_DAYS + 1} days").writeStream.format("parquet").outputMode("append")
                  .option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/data").trigger(availableNow=True).start())
    return spark.read.parquet(f"{root}/data")


@register("stream_user_day_features", f"""
    WITH {_features_sql()} SELECT user_id, day, {", ".join(AN.FEATURES)} FROM feat
    WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY < (SELECT max(ts) FROM al) - INTERVAL {P.FEATURE_DELAY_DAYS} DAY""")
def q_stream_user_day_features(spark, sf):
    """G1 out of the event stream: the user-days that the watermark has closed."""
    stream = US.stream_events(spark, f"{sf.rstrip('/')}/events.parquet", max_files_per_trigger=1000)
    return US.run_to_table(SC.user_day_features(stream, f"{P.FEATURE_DELAY_DAYS} days"), "features")


@register("stream_anomaly_scores", None)
def q_stream_anomaly_scores(spark, sf):
    """A logistic-regression pipeline fitted on the batch train split, applied to the user-days as they come out of the event stream."""
    sp = _split(spark, sf)
    train = sp.where(F.col("split") == "train")
    stats = AN.fit_scaler(train).checkpoint()
    model = AN.fit_models(AN.apply_scaler(train, stats), P.SEED, which=("logistic_regression",))
    stream = US.stream_events(spark, f"{sf.rstrip('/')}/events.parquet", max_files_per_trigger=1000)
    scored = SC.score_days(SC.user_day_features(stream, f"{P.FEATURE_DELAY_DAYS} days"), stats, model)
    return US.run_to_table(scored.select("user_id", "day", "is_anomaly", "score_logistic_regression", "predicted_anomaly", "predicted_type"), "anomaly_scores")


_SAID = f"([{', '.join(S.q(x) for x in P.SAID)}])"


@register("stream_message_signals", blend_sql(f"""
    pri AS (SELECT {", ".join(f"count(*) FILTER (WHERE label = '{l}') / count(*) AS m_{l}" for l in SE.LABELS)} FROM lab),
    sd AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || {_SAID}[CAST((conv_id + turn) % {len(P.SAID)} AS INTEGER) + 1] AS text FROM conversations WHERE role = 'user')""",
    ["conv_id", "turn"]))
def q_stream_message_signals(spark, sf):
    """D11-D14 on a stream of user messages, joined with a static table of class shares."""
    shares = labelled(spark, sf).agg(*[(F.count(F.when(F.col("label") == l, 1)) / F.count(F.lit(1))).alias(f"m_{l}") for l in SE.LABELS])
    said = F.element_at(F.array(*[F.lit(x) for x in P.SAID]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(P.SAID))) + 1).cast("int"))
    raw = US.stream_files(spark, f"{sf.rstrip('/')}/conversations.parquet", max_files_per_trigger=1000).where("role = 'user'")
    messages = raw.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said).alias("text"))
    signals = SC.message_signals(messages, shares.checkpoint())
    cols = ["conv_id", "turn", "s_hits", "m_hits", *[f"p_{l}" for l in SE.LABELS], "pred_label", "confidence", "flag"]
    return US.run_to_table(signals.select(*cols), "messages")
