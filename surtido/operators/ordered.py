"""Ordered analytics over a whole table without a one-partition window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surtido.session import default_parallelism, materialize

SLICE_ROWS = 1_000_000  # rows of a slice of a large table, about
LEAST_ROWS = 20_000     # rows that are worth a slice of their own


def slices_for(rows: int, parallelism: int) -> int:
    """Slices of an ordered table: as many as tasks for a small one, and ``SLICE_ROWS`` each for a large one."""
    return max(1, -(-rows // SLICE_ROWS), min(parallelism, -(-rows // LEAST_ROWS)))


def running_totals(df: DataFrame, order: Sequence[Column], values: Mapping[str, Column]) -> DataFrame:
    """Add cumulative sums in a global order.

    Two-phase prefix sum: rows are written, range-partitioned in order into slices whose number
    grows with theirs, and written once more with their slice; each slice is summed on its own and starts
    from the total of the slices before it. ``order`` should end in a unique key, which
    also lets long runs of ties spread over several slices. The only data on one
    task are the per-slice totals, one row a slice. Each ``out``
    comes with ``{out}_total``, the sum over all rows.
    """
    spark = df.sparkSession
    names = {out: f"_value_{i}" for i, out in enumerate(values)}
    # Written first: range bounds are sampled from it, which would else run the whole input once more.
    keyed = materialize(df.withColumns({names[out]: c for out, c in values.items()}), "unordered")
    slices = slices_for(keyed.count(), default_parallelism(spark))
    ranged = materialize(
        keyed.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_slice").agg(*[F.sum(v).alias(v) for v in names.values()])
    everything = Window.partitionBy()
    offsets = totals.select(
        "_slice",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in names.values()],
        *[F.sum(v).over(everything).alias(f"{out}_total") for out, v in names.items()])
    within = (Window.partitionBy("_slice").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumns({out: F.sum(v).over(within) for out, v in names.items()})
    joined = local.join(F.broadcast(offsets), "_slice")  # one row a slice
    return (joined.withColumns({out: F.col(out) + F.col(f"{v}_before") for out, v in names.items()})
            .select(*df.columns, *names, *[f"{out}_total" for out in names]))


def ranked(df: DataFrame, order: Sequence[Column], out: str = "ranking") -> DataFrame:
    """Position 1..n in a global order."""
    return running_totals(df, order, {out: F.lit(1).cast("bigint")}).drop(f"{out}_total")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows in an order; each task keeps only its own n."""
    return df.orderBy(*order).limit(n)
