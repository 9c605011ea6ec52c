"""Approximate nearest neighbours by cross-polytope hashing with several probes per table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

TABLES, PROBES, HASHES = 12, 8, 1
#: Vectors, and queries, that meet in one task at most (in expectation).
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the length is a power of two."""
    n, width, h = *x.shape, 1
    while h < width:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotated(units: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation: three times random signs and a Hadamard transform."""
    width = 1 << max(0, (units.shape[1] - 1).bit_length())
    x = np.zeros((len(units), width))
    x[:, : units.shape[1]] = units
    signs = np.random.default_rng([seed, width]).choice([-1.0, 1.0], size=(3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def probes(units: np.ndarray, table: int, hashes: int, count: int) -> np.ndarray:
    """For each row the ``count`` best buckets of a table, best first. A bucket is the nearest signed axis
    under each of ``hashes`` rotations; the farther axes are tried in the order of their summed closeness."""
    best, value = np.zeros((len(units), 1), dtype=np.int64), np.zeros((len(units), 1))
    for i in range(hashes):
        x = rotated(units, table * 1000 + i)
        both = np.concatenate([x, -x], axis=1)
        axes = np.argsort(-both, axis=1, kind="stable")[:, : min(count, both.shape[1])]
        score = value[:, :, None] + np.take_along_axis(both, axes, axis=1)[:, None, :]
        names = best[:, :, None] * both.shape[1] + axes[:, None, :]
        score, names = score.reshape(len(units), -1), names.reshape(len(units), -1)
        keep = np.argsort(-score, axis=1, kind="stable")[:, :count]
        best, value = np.take_along_axis(names, keep, axis=1), np.take_along_axis(score, keep, axis=1)
    return best


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, only finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def buckets(rows: DataFrame, tables: int, hashes: int, count: int) -> DataFrame:
    """(vec_id, vec, bucket): one row per table and probe. Vectors of different lengths share no bucket."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [np.asarray(v, dtype=np.float64) for v in batch["vec"]]
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x = np.stack([vectors[i] for i in at])
                x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares of large components would overflow
                units = x / np.linalg.norm(x, axis=1, keepdims=True)
                part = batch.iloc[at]
                for table in range(tables):
                    found = probes(units, table, hashes, count)
                    names = (found * tables + table) * 65537 + int(length)
                    yield pd.DataFrame({"vec_id": np.repeat(part["vec_id"].to_numpy(), found.shape[1]), "vec": np.repeat(part["vec"].to_numpy(), found.shape[1]), "bucket": names.ravel()})

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.mapInPandas(read, f"vec_id long, vec {kind}, bucket long")


def ranked(k: int):
    """Of one block of vectors, the k nearest of each query of one block of queries."""

    def compare(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(base) and len(asked):
            x = np.stack([np.asarray(v, dtype=np.float64) for v in base["vec"]])
            q = np.stack([np.asarray(v, dtype=np.float64) for v in asked["vec"]])
            ids, names = base["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            square = (x * x).sum(axis=1)
            rough = (q * q).sum(axis=1)[:, None] + square[None, :] - 2 * (q @ x.T)
            rough[names[:, None] == ids[None, :]] = np.inf
            spare = 1e-9 * (square.max() + (q * q).sum(axis=1))
            kth = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            for i in range(len(q)):
                near = np.flatnonzero((rough[i] <= kth[i] + spare[i]) & (names[i] != ids))
                score = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((ids[near], score))[:k]
                found["query_id"] += [names[i]] * len(order)
                found["vec_id"] += ids[near][order].tolist()
                found["score"] += score[order].tolist()
        return pd.DataFrame(found).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return compare


def met(base: DataFrame, asked: DataFrame, block: int, k: int) -> DataFrame:
    """Brings vectors and queries of a bucket together in blocks, so that a full bucket is many small tasks.
    Every vector of a bucket meets every query of it exactly once."""
    sizes = base.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    asking = asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m"))
    shape = sizes.join(asking, "bucket").select(
        "bucket", F.ceil(F.col("_n") / block).alias("_nb"), F.ceil(F.col("_m") / block).alias("_mb")
    )
    shape = staged(shape, "bucket-sizes")
    # by the vector too: rows that share a vec_id are spread as well
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = base.join(shape, "bucket").select("bucket", mine("_nb").alias("b"), every("_mb").alias("q"), "vec_id", "vec")
    right = asked.join(shape, "bucket").select("bucket", every("_nb").alias("b"), mine("_mb").alias("q"), "vec_id", "vec")
    keys = ["bucket", "b", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda x, y: ranked(k)(x, y), "query_id long, vec_id long, score double"
    )


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest per query; a vector found in several tables counts once."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    places = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return places.dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")


def nearest(
    base: DataFrame, asked: DataFrame, k: int = 10, tables: int = TABLES, count: int = PROBES, hashes: int = HASHES, block: int = BLOCK
) -> DataFrame:
    """The k nearest vectors of ``base`` for each vector of ``asked`` (both vec_id, embedding), by Euclidean
    distance, found by cross-polytope hashing and ranked exactly on the original vectors.

    All of ``base`` is hashed into ``tables`` tables, by the nearest signed axis under ``hashes`` rotations
    of the unit vector; a query looks into ``count`` buckets of each. A query that finds fewer than k that
    way is compared with all vectors. A vector never finds its own vec_id. Raise ``hashes`` with the size of
    the table: buckets shrink by twice the dimension each time.

    Returns query_id, rank (from 1), vec_id, score.

    Cases: vectors that are null, zero, or hold null or non-finite components take no part, as query or
    candidate; vectors of another length are no candidates. Ties go to the smaller vec_id. Rows that repeat
    vec_id and vector count once; a null vec_id takes no part. Fewer than k candidates give all of them. Other
    columns are ignored. An empty table gives an empty result.
    """
    clean = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    # copies would take places of a block, and all land in one
    vectors, queries = (clean(df).dropDuplicates(["vec_id", "vec"]) for df in (base, asked))
    vectors = staged(vectors, "vectors")
    hashed, looking = buckets(vectors, tables, hashes, 1), buckets(queries, tables, hashes, count)
    found = staged(best(met(hashed, looking, block, k), k), "neighbours")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = staged(queries.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"), "short-queries")
    if short.isEmpty():
        return found
    length = F.size("vec").cast("long").alias("bucket")
    rest = best(met(vectors.select("vec_id", "vec", length), short.select("vec_id", "vec", length), block, k), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
