"""Joining lookups onto large tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def attach(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``lookup``, which has one narrow row per key.

    The lookup is written to the shared folder and read back, so the planner knows its bytes: below the
    session's broadcast threshold it travels to the large side, beyond that both sides are shuffled and
    adaptive execution splits the partitions of hot keys.
    """
    return rows.join(stored(lookup, "lookup"), key, "left")


def cut_hot(rows: DataFrame, key: str, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_part``, and (key, _parts) of the keys that hold more than ``most`` rows: those are cut into
    parts of about that size. At most ``rows / most`` keys are that large."""
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    large = large.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    part = F.when(parts > 1, F.pmod(F.xxhash64(*rows.columns), parts)).otherwise(0).cast("int")
    return rows.join(F.broadcast(large), key, "left").withColumn("_part", part).drop("_parts"), large


def join_cut(cut: DataFrame, large: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Rows cut by ``cut_hot`` inner-joined with ``lookup``, whose rows go to each part of their key. What is
    broadcast is one number for each large key."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    spread = lookup.join(F.broadcast(large), key, "left").withColumn("_part", every).drop("_parts")
    return cut.join(spread, [key, "_part"]).drop("_part")


def join_salted(rows: DataFrame, lookup: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """``rows`` inner-joined with ``lookup`` on ``key`` where some keys may hold most of ``rows``."""
    return join_cut(*cut_hot(rows, key, most), lookup, key)
