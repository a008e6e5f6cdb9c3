"""How rows are laid out and when columns are computed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logharvest.session import stored


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row, whatever follows.

    Catalyst inlines a projected expression into the lambdas and pushed-down
    filters that use it, which would split a file's text again for every call
    in it. It does not move expressions across a generator, so the value goes
    through one that makes exactly one row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores even if the input is a few unsplittable pieces.

    Only moves rows when the scan has fewer partitions than the cluster has
    cores, which no large input does; then rows go round-robin, so neither one
    project nor one directory makes a heavy task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Row numbers from 0 in the given order, without a single-task window.

    The rows are sorted in ranges and stored with their place in their range;
    adding the sizes of the ranges before, one number per range, gives the
    index. Stored, because the two passes must see the same ranges.
    """
    columns = df.columns
    ranges = stored(
        df.orderBy(*order).select(
            "*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__place")
        ),
        "sorted",
    )
    first = F.min("__place").alias("__first")
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), first)
    # One row per range: as many as the sort has partitions.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__range", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    index = F.col("__start") + F.col("__place") - F.col("__first")
    return ranges.join(F.broadcast(starts), "__range").select(index.alias(name), *columns)
