"""File sources and sinks (A1-A9) with Spark's own readers and writers."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A1: JSON lines with an explicit schema, parsed with ``from_json`` in
    PERMISSIVE mode. Blank lines are dropped; malformed lines go to the second
    DataFrame (``_corrupt_record``, the raw line)."""
    s = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim(F.col("value")) != "")
    parsed = lines.select(
        F.col("value"),
        F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"),
    )
    good = parsed.where(F.col(f"r.{CORRUPT}").isNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    bad = parsed.where(F.col(f"r.{CORRUPT}").isNotNull()).select(F.col("value").alias(CORRUPT))
    return good, bad


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3: JSON lines, overwrite or append."""
    df.write.mode(mode).json(path)


FEATURE_SCHEMA = T.StructType([
    T.StructField("activities_per_day", T.DoubleType()),
    T.StructField("daily_xp_total", T.DoubleType()),
    T.StructField("streak_gap_days", T.DoubleType()),
    T.StructField("intensity_switch_rate", T.DoubleType()),
    T.StructField("avg_session_duration", T.DoubleType()),
    T.StructField("max_session_duration", T.DoubleType()),
    T.StructField("sessions_at_cap_ratio", T.DoubleType()),
    T.StructField("xp_per_minute", T.DoubleType()),
    T.StructField("is_anomaly", T.IntegerType()),
    T.StructField("anomaly_type", T.StringType()),
])


def read_feature_csv(spark: SparkSession, path: str, extra: list[T.StructField] | None = None) -> DataFrame:
    """A2: typed feature CSV (8 floats, int label, type name); the type name
    maps to its code and an unknown name fails the job."""
    from ..operators.anomaly import type_code

    schema = T.StructType(list(extra or []) + list(FEATURE_SCHEMA.fields))
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.withColumn("type_code", type_code(F.col("anomaly_type")))


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """A4: CSV with a fixed column list (other fields ignored), with header."""
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def nested_to_json(col: str) -> F.Column:
    """A nested column serialised for a flat sink."""
    return F.to_json(F.col(col))


def read_json_tree(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Every JSON file under ``folder`` (recursively); a list root gives one
    row per element, an object root one row."""
    r = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(folder)


def source_registry(builders: dict[str, Callable[[], DataFrame]], names: list[str] | str) -> DataFrame:
    """Build the chosen sources ('all' = every one, in registry order);
    unknown names are logged and skipped; the parts are unioned by name with a
    ``source`` column."""
    chosen = list(builders) if names == "all" else list(names)
    out = None
    for n in chosen:
        if n not in builders:
            log.warning("unknown source %r skipped", n)
            continue
        part = builders[n]().withColumn("source", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no known source selected")
    return out
