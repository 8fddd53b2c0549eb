"""Running totals and dense ordinals over a global order, without a global window.

A window with no partitioning, or one whose partition is a whole corpus, would
pull an unbounded group into one task.  Instead:

1. range-partition by (group, order) and pin the result with ``checkpoint()`` so
   that the partition number of a row can never change on a retry;
2. total each (partition, group) pair;
3. a group that continues from an earlier partition needs one offset; a partition
   can hold at most one such group, so the offsets are never more rows than
   there are partitions and may be broadcast;
4. add the offset to the running total inside (partition, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from satchel.plans.session import shared_dir

_PART = "__part"


def running_total(
    df: DataFrame,
    order: Sequence[str],
    value: Column,
    out: str,
    group: Sequence[str] = (),
    exclusive: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the group.

    ``order`` must be a total order inside the group.  Pass narrow rows: keys and
    numbers, not bodies.
    """
    spark = df.sparkSession
    shared_dir(spark)
    group, order = list(group), list(order)
    by = [F.col(c) for c in group + order]
    ranged = df.withColumn("__value", value.cast("bigint"))
    ranged = ranged.repartitionByRange(partitions, *by) if partitions else ranged.repartitionByRange(*by)
    pinned = ranged.withColumn(_PART, F.spark_partition_id()).checkpoint()

    totals = pinned.groupBy(*group, _PART).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    offsets = (
        totals.withColumn(
            "__offset",
            F.sum("__sum").over(earlier.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)),
        )
        .filter(F.col("__offset").isNotNull())
        .select(*group, _PART, "__offset")
    )
    frame = (
        Window.partitionBy(_PART, *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    return (
        pinned.withColumn("__run", F.coalesce(F.sum("__value").over(frame), F.lit(0)))
        .join(F.broadcast(offsets), [*group, _PART], "left")
        .withColumn(out, F.col("__run") + F.coalesce(F.col("__offset"), F.lit(0)))
        .drop(_PART, "__value", "__run", "__offset")
    )


def ordinals(
    df: DataFrame, order: Sequence[str], out: str = "ord", group: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``: 1, 2, 3 ... in the given order inside each group."""
    return running_total(df, order, F.lit(1), out, group, exclusive=False)
