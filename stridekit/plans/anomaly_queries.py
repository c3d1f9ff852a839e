"""Registered anomaly queries over the activity log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as AN
from ..operators import corpus as C
from ..sources.tables import activity_log, activity_log_sql
from . import params as P
from . import sql_text as S
from .registry import register


def _features_sql() -> str:
    return f"""
    al AS ({activity_log_sql()}),
    ev AS (
      SELECT *, CAST(duration_minutes AS DOUBLE) * (CASE intensity WHEN 'light' THEN 1.0::DOUBLE
                 WHEN 'moderate' THEN 1.5::DOUBLE WHEN 'intense' THEN 2.0::DOUBLE END) AS xp,
             lag(intensity) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS prev_int
      FROM al),
    dd AS (
      SELECT user_id, day, count(*) AS n, least(sum(xp), 600.0::DOUBLE) AS xp,
             sum(CASE WHEN prev_int IS NOT NULL AND prev_int <> intensity THEN 1 ELSE 0 END) AS sw,
             sum(duration_minutes) AS mins, max(duration_minutes) AS mx
      FROM ev GROUP BY user_id, day),
    feat AS (
      SELECT user_id, day, CAST(n AS INTEGER) AS activities_per_day, round_even(xp, 1) AS daily_xp_total,
             CAST(coalesce(date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day), 0) AS INTEGER) AS streak_gap_days,
             round_even(sw / greatest(1, n - 1), 3) AS intensity_switch_rate,
             round_even(mins / n, 1) AS avg_session_duration, CAST(mx AS INTEGER) AS max_session_duration,
             CASE WHEN xp >= {AN.DAILY_CAP * AN.CAP_FRACTION} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sessions_at_cap_ratio,
             round_even(xp / mins, 3) AS xp_per_minute
      FROM dd),
    lab AS (
      SELECT *, CASE WHEN activities_per_day >= 8 OR max_session_duration > 300 THEN 'xp_grinding'
                     WHEN streak_gap_days BETWEEN 3 AND 7 THEN 'impossible_streak'
                     WHEN activities_per_day >= 4 AND intensity_switch_rate >= 1.0 THEN 'intensity_spoofing'
                     ELSE 'none' END AS anomaly_type
      FROM feat)"""


_FEATS = ", ".join(AN.FEATURES)


@register("anomaly_user_day_features", f"WITH {_features_sql()} SELECT user_id, day, {_FEATS} FROM feat")
def q_features(spark, sf):
    return AN.user_day_features(activity_log(spark, sf))


_INFER = """CASE WHEN streak_gap_days >= 3 THEN 'impossible_streak'
                 WHEN intensity_switch_rate >= 0.85 THEN 'intensity_spoofing'
                 WHEN activities_per_day >= 8 OR max_session_duration >= 300 OR sessions_at_cap_ratio >= 1.0 THEN 'xp_grinding'
                 WHEN intensity_switch_rate > 0.5 THEN 'intensity_spoofing' ELSE 'xp_grinding' END"""
_CODE = "CASE anomaly_type " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in AN.ANOMALY_TYPES) + " END"


@register("anomaly_weak_labels", f"""
    WITH {_features_sql()}
    SELECT user_id, day, anomaly_type, CAST(anomaly_type <> 'none' AS INTEGER) AS is_anomaly,
           {_INFER} AS inferred_type, CAST({_CODE} AS INTEGER) AS type_code
    FROM lab""")
def q_weak_labels(spark, sf):
    lab = AN.infer_type(AN.weak_labels(AN.user_day_features(activity_log(spark, sf))))
    return lab.select("user_id", "day", "anomaly_type", "is_anomaly", "inferred_type", AN.type_code(F.col("anomaly_type")).alias("type_code"))


@register("anomaly_label_distribution", f"""
    WITH {_features_sql()}
    SELECT CAST(anomaly_type <> 'none' AS INTEGER) AS is_anomaly, anomaly_type, count(*) AS n,
           round_even(count(*) / (SELECT count(*) FROM lab), 4) AS ratio
    FROM lab GROUP BY ALL""")
def q_label_distribution(spark, sf):
    return AN.label_distribution(AN.weak_labels(AN.user_day_features(activity_log(spark, sf))))


# Single-rule predictors scored against the weak labels (G10 on rules).
_RULES = {
    "gap_rule": "streak_gap_days >= 3",
    "switch_rule": "intensity_switch_rate >= 0.85",
    "volume_rule": "activities_per_day >= 8 OR max_session_duration >= 300",
}


def _metrics_sql(src: str) -> str:
    return f"""
    m AS (SELECT model, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                 count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                 count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
                 count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM {src} GROUP BY model),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
                 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM m)
    SELECT model, tp, fp, tn, fn, round_even((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
           round_even(p, 6) AS precision, round_even(rc, 6) AS recall,
           round_even(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 6) AS f1
    FROM r"""


@register("anomaly_rule_metrics", f"""
    WITH {_features_sql()},
    preds AS ({" UNION ALL ".join(f"SELECT '{k}' AS model, CAST(anomaly_type <> 'none' AS INTEGER) AS label, CAST(({v}) AS INTEGER) AS prediction FROM lab" for k, v in _RULES.items())}),
    {_metrics_sql('preds')}""")
def q_rule_metrics(spark, sf):
    lab = AN.weak_labels(AN.user_day_features(activity_log(spark, sf)))
    parts = None
    for k, cond in _RULES.items():
        p = lab.select(F.lit(k).alias("model"), F.col("is_anomaly").alias("label"), F.expr(cond).cast("int").alias("prediction"))
        parts = p if parts is None else parts.unionByName(p)
    return AN.binary_metrics(parts)


def _split_key():
    return F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("day").cast("string"))


def _split(spark, sf):
    lab = AN.weak_labels(AN.user_day_features(activity_log(spark, sf))).withColumn("_key", _split_key())
    return C.global_split(lab, "_key", 0.8, P.SEED)


@register("anomaly_scaled_features", f"""
    WITH {_features_sql()},
    sp AS (SELECT *, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM (
             SELECT *, row_number() OVER (ORDER BY {S.shuffle_key(P.SEED, "CAST(user_id AS VARCHAR) || ':' || CAST(day AS VARCHAR)")},
                                                   CAST(user_id AS VARCHAR) || ':' || CAST(day AS VARCHAR)) AS rn,
                    count(*) OVER () AS n FROM lab)),
    st AS (SELECT {", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in AN.FEATURES)} FROM sp WHERE split = 'train')
    SELECT user_id, day, split,
           {", ".join(f"round_even(({c} - mu_{c}) / (CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END), 6) AS z_{c}" for c in AN.FEATURES)}
    FROM sp, st""")
def q_scaled_features(spark, sf):
    sp = _split(spark, sf)
    stats = AN.fit_scaler(sp.where(F.col("split") == "train"))
    z = AN.apply_scaler(sp, stats)
    return z.select("user_id", "day", "split", *[F.bround(f"z_{c}", 6).alias(f"z_{c}") for c in AN.FEATURES])


def _scored(spark, sf, rf_trees: int = 150):
    """The three models, fitted anew, and their scores of the held-out days."""
    sp = _split(spark, sf)
    stats = AN.fit_scaler(sp.where(F.col("split") == "train"))
    z = AN.apply_scaler(sp, stats).checkpoint(eager=True)
    model = AN.fit_models(z.where(F.col("split") == "train"), P.SEED, rf_trees)
    return AN.score(model, z.where(F.col("split") == "val")).drop("features", "r_lr", "p_lr", "r_dt", "p_dt", "r_rf", "p_rf")


@register("anomaly_model_scores", None)
def q_model_scores(spark, sf):
    """Fit LR/DT/RF on the train split, score the held-out days."""
    s = _scored(spark, sf)
    return s.select(
        "user_id", "day", "is_anomaly", *[f"score_{m}" for m in AN.MODELS], "confidence", "predicted_anomaly",
        "predicted_type", "vote_or",
    )


@register("anomaly_model_metrics", None)
def q_model_metrics(spark, sf):
    """G8 + G10: per-model decisions (long form) and held-out metrics."""
    s = _scored(spark, sf)
    return AN.binary_metrics(AN.scores_long(s, ["user_id", "day"]).withColumnRenamed("is_anomaly", "label"))
