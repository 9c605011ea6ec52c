"""Global ranks and deterministic choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def earliest(value: str, at: str, tie: str) -> Column:
    """Value of the row with the least ``at``, then the least ``tie``: a reproducible "any value"."""
    return F.min_by(value, F.struct(at, tie))


def row_numbers(df: DataFrame, name: str, order: list[Column], unique: str, ranges: int | None = None) -> DataFrame:
    """``row_number()`` over the whole table; ``order`` is ascending and ends with the unique column.

    The input is checkpointed and cut into ranges, as many as there are shuffle partitions, by the sort keys of
    a hash-chosen (so reproducible) sample of as many rows; rows are numbered inside their range and shifted
    by the sizes of the earlier ranges.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    staged = cut_lineage(df.withColumn("_key", key))
    sample = staged.select("_key", F.xxhash64(unique).alias("_h"), unique).orderBy("_h", unique).limit(ranges)
    bounds = sample.agg(F.sort_array(F.collect_list("_key"))).scalar()
    ranged = staged.withColumn("_bounds", bounds)
    ranged = ranged.withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_key")))).drop("_bounds")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # at most ranges + 1 rows
    placed = ranged.join(F.broadcast(starts), "_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return placed.withColumn(name, (inside + F.col("_start")).cast("bigint")).drop("_key", "_range", "_start")
