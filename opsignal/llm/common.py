"""Helpers shared by the operators: staging, text, and joins that a hot key cannot overload."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: later passes survive lost executors, and the
    planner knows the size in bytes."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ASCII texts take the fast path, where ``lower`` does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def packed(df: DataFrame, drop: tuple[str, ...] = ()) -> Column:
    """All columns of a row in one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in drop])


def giving_back(read: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives the free memory of its Python worker back when it ends: workers live on, and
    what one task has freed would count for the executor while another stage works there."""

    def run(batches: Iterator) -> Iterator:
        yield from read(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def join_counted(
    rows: DataFrame, counted: DataFrame, on: str, n: str, total: int, parts: int = 1000, how: str = "left"
) -> DataFrame:
    """Joins ``rows`` with ``counted``, which has one row per key and in ``n`` how many rows the key has.

    Keys above a ``parts``-th of all rows are at most ``parts`` keys, whatever the data: that proven bound
    allows to broadcast them, and their rows are never gathered. Every other key is light enough to shuffle.
    Both inputs are read twice, so pass staged tables. ``total`` is the number of rows.
    """
    floor = total / parts
    heavy = counted.where(F.col(n) > floor).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(heavy), on, "left")
    light = counted.where(F.col(n) <= floor)
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns).join(light, on, how)
    return marked.where("_hot").drop("_hot").unionByName(rest)
