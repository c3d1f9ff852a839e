"""Running aggregates and ranks that do not put a whole group into one task.

``running_aggregates`` computes, per row, the running SUM or MAX (or the LAG) of value
columns within groups ``keys`` ordered by ``order`` (which must make the order
total). A window ``partitionBy(keys).orderBy(order)`` holds one key's rows in
one task; a key may hold a third of all rows. Instead, at every size and in the JVM:

1. ``repartitionByRange(keys + order)``: Spark's sampled range bounds cut a hot
   key into many partitions by its order columns; the partition's number is
   kept and the rows are checkpointed, so both readers below see the same cuts;
2. a window over (partition number, keys) gives the value local to the partition;
3. a key that goes on in later partitions carries its totals over: one row for
   each (partition, key) is aggregated, and those with an earlier partition, at
   most one for each partition, are joined back.

Integer sums stay integers. Callers pass only the columns they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

_PART = "_scan_part"


def running_aggregates(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, str]],
    num_partitions: int | None = None,
) -> DataFrame:
    """aggs: {output column: (input column, 'sum' | 'max' | 'lag')}. NULL inputs
    are skipped like SQL (running SUM of nothing is 0, running MAX of nothing
    NULL); 'lag' is the previous row's value within the group (NULL on the first)."""
    ensure_checkpoint_dir(df.sparkSession)
    types = {f.name: f.dataType for f in df.schema.fields}
    cut = [*keys, *order]
    ranged = df.repartitionByRange(num_partitions, *cut) if num_partitions else df.repartitionByRange(*cut)
    rows = ranged.withColumn(_PART, F.spark_partition_id()).checkpoint()

    inside = Window.partitionBy(_PART, *keys).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(_PART)
    all_earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    local, whole, carried, final = [], [], [], []
    for out, (src, how) in aggs.items():
        integral = isinstance(types[src], (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
        kind = types[src] if how == "lag" else T.LongType() if integral else T.DoubleType()
        here, before = f"_l_{out}", F.col(f"_c_{out}")
        if how == "sum":
            local.append(F.coalesce(F.sum(src).over(so_far), F.lit(0)).alias(here))
            whole.append(F.sum(src).alias(f"_t_{out}"))
            carried.append(F.sum(f"_t_{out}").over(all_earlier).alias(f"_c_{out}"))
            value = F.col(here) + F.coalesce(before, F.lit(0))
        elif how == "max":
            local.append(F.max(src).over(so_far).alias(here))
            whole.append(F.max(src).alias(f"_t_{out}"))
            carried.append(F.max(f"_t_{out}").over(all_earlier).alias(f"_c_{out}"))
            value = F.greatest(here, before)  # skips nulls
        else:
            # in a struct, so that a null value differs from no row
            local.append(F.lag(F.struct(src)).over(inside).alias(here))
            whole.append(F.max_by(F.struct(src), F.struct(*order)).alias(f"_t_{out}"))
            carried.append(F.lag(f"_t_{out}").over(earlier).alias(f"_c_{out}"))
            value = F.coalesce(F.col(here), before).getField(src)
        final.append(value.cast(kind).alias(out))
    totals = rows.groupBy(_PART, *keys).agg(*whole)
    carry = totals.select(_PART, *keys, F.lag(_PART).over(earlier).alias("_prev"), *carried).where("_prev IS NOT NULL").drop("_prev")
    # at most one row for each partition: only a partition's first key can go on from an earlier one
    carry = carry.withColumnsRenamed({_PART: "_cp", **{k: f"_ck_{k}" for k in keys}})
    on = F.col(_PART) == F.col("_cp")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_ck_{k}"))
    scanned = rows.select("*", *local).join(F.broadcast(carry), on, "left")
    return scanned.select(*[F.col(c) for c in df.columns], *final)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Exact ``row_number()`` over (partition ``keys``, ``order``) without a single
    task per key; empty ``keys`` rank globally. ``order`` must be total. For the
    first rows of a group use ``first_rows``."""
    return running_aggregates(df.withColumn("_rn_one", F.lit(1)), keys, order, {out: ("_rn_one", "sum")}, num_partitions).drop("_rn_one")


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group (of the table, if there are no keys).

    Spark prunes to ``n`` rows a group and task before the shuffle, or takes the top ``n`` of each task."""
    if not keys:
        return df.orderBy(*order).limit(n)
    nth = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= n).drop("_nth")
