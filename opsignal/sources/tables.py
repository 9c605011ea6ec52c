"""Writing tables, keeping keyed copies of them, and checking what was written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SNAPSHOT
from ..session import stored
from .versions import Version, commit, new_data_folder, prepared, version_of


def stamped(df: DataFrame, stamp: str | None) -> DataFrame:
    """With the time of the run in column ``stamp``, if any."""
    return df.withColumn(stamp, F.current_timestamp()) if stamp else df


def write_table(df: DataFrame, path: str, stamp: str | None = "computed_at", partition_by: str | None = None) -> DataFrame:
    """Replace the table at ``path``, content and schema, by a new committed version, and read that. Whoever reads
    the old version goes on doing so; a write that fails changes nothing."""
    spark = df.sparkSession
    return commit(spark, prepared(stamped(df, stamp), path, partition_by)).read(spark)


# Keyed copies ----------------------------------------------------------------------------------


def _fingerprint(df: DataFrame) -> Column:
    """Digest of the whole row. NULL and text are told apart by the JSON form."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def _same_key(key: list[str]) -> Column:
    """NULL-safe equality of two keyed frames aliased s and c."""
    return reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key])


def _operations(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Key columns and ``op`` from two frames of key and ``_print``."""
    both = new.withColumnRenamed("_print", "_new").alias("s").join(old.withColumnRenamed("_print", "_old").alias("c"), _same_key(key), "full")
    op = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    keys = [F.coalesce(F.col(f"s.{k}"), F.col(f"c.{k}")).alias(k) for k in key]
    return both.select(*keys, op.alias("op")).where("op is not null")


def changes_since(source: DataFrame, copy: DataFrame, key: list[str]) -> DataFrame:
    """Key columns and ``op`` (insert, update, delete) that turn the copy into the source."""
    prints = lambda df: df.select(*key, _fingerprint(df).alias("_print"))
    return _operations(prints(source), prints(copy.select(*source.columns)), key)


def _digests(rows: DataFrame) -> dict[str, list]:
    """Per part: rows, and two sums over the digests of its rows. Equal parts have equal sums."""
    piece = lambda at: F.sum(F.conv(F.substring("_print", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    found = rows.groupBy("_part").agg(F.count("*").alias("n"), piece(1).alias("a"), piece(17).alias("b"))
    return {str(r["_part"]): [r.n, r.a, r.b] for r in found.collect()}


def _columns(schema: T.StructType) -> list:
    return [(f.name, f.dataType) for f in schema.fields]


def sync_copy(spark: SparkSession, source: DataFrame, path: str, key: list[str], policy: str, parts: int = 64) -> DataFrame:
    """Bring the serving copy at ``path`` to the state of ``source``; (op, n) tells what changed.

    The source is staged once, so that all steps see the same rows, and a key that occurs twice is refused before
    anything is written. The copy is laid out in ``parts`` by a hash of the key. SNAPSHOT writes all of them;
    TRIGGERED writes the parts whose digest differs from that of the last version, compares only those row by row,
    and carries the folders of the others over. The new version becomes visible in one step; where nothing
    changed there is none. A change of columns, of the key or of ``parts`` writes all of them too.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    staged = stored(source.select("*", _fingerprint(source).alias("_print"), part.alias("_part")), "sync")
    twice = key_violations(staged, key).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{path}: keys that occur more than once, among them {[tuple(r[k] for k in key) for r in twice]}")
    last = version_of(spark, path)
    new = _digests(staged)
    layout = [key, parts]
    everything = policy == SNAPSHOT or last is None or last.layout != layout or _columns(last.schema) != _columns(source.schema)
    before = {} if everything else last.digests
    touched = sorted(p for p in set(new) | set(before) if new.get(p) != before.get(p))
    if not touched and not everything:
        return spark.createDataFrame([], "op string, n long")
    here = staged.where(F.col("_part").isin([int(p) for p in touched]))
    folder = new_data_folder()
    here.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{path.rstrip('/')}/{folder}")
    folders = {p: f"{folder}/_part={p}" for p in touched if p in new}
    if everything:
        done = staged.agg(F.lit("insert").alias("op"), F.count("*").alias("n"))
    else:
        folders |= {p: f for p, f in last.folders.items() if p not in touched}
        narrow = staged.select(*key, "_print")
        done = _operations(here.select(*narrow.columns), last.read(spark, touched, narrow.schema), key).groupBy("op").agg(F.count("*").alias("n"))
    commit(spark, Version(path.rstrip("/"), source.schema, folders, new, layout))
    return done


# Checks ----------------------------------------------------------------------------------------


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once or contain NULL, with their row count and the reason."""
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    counted = df.groupBy(*key).agg(F.count("*").alias("n"))
    return counted.where(has_null | (F.col("n") > 1)).withColumn(
        "reason", F.when(has_null, "null key").otherwise("duplicate key")
    )


def key_audit(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(table_name, violations): how many key values of each table are NULL or occur more than once."""
    counts = [key_violations(tables[n], k).agg(F.lit(n).alias("table_name"), F.count("*").alias("violations")) for n, k in keys.items()]
    return reduce(DataFrame.unionByName, counts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("cnt")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def metric_profile(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows per metric type, points and distinct metric names per service)."""
    types = metrics.groupBy("metric_type").agg(F.count("*").alias("count"))
    services = metrics.groupBy("service_name").agg(
        F.count("*").alias("data_points"), F.count_distinct("metric_name").alias("distinct_metrics")
    )
    return types, services.orderBy(F.desc("data_points"), "service_name")


def random_sample(df: DataFrame, key: list[str], n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key: random, yet the same on every run."""
    parts = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    return df.orderBy(F.md5(parts), *key).limit(n)
