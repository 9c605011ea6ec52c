"""Exact deduplication that a hot text cannot overload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, lower_az, staged, whole_text


def content_digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def combine(rows: DataFrame, salts: int) -> DataFrame:
    """One row per digest and content: the largest doc_id and the number of rows.

    The first grouping removes copies inside each task before anything is sent and merges the rest by salted
    digest; the second merges the winners of the salts. Both group by the full content as well, so texts
    that share a digest stay apart.
    """
    salted = rows.groupBy("digest", "content", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_duplicates(
    docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = content_digest
) -> DataFrame:
    """One row per document with the group of equal texts it is in.

    Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id stays.

    Returns doc_id, keep_id, group_size, kept, digest (binary).

    Cases: null text is the empty text, and all empty texts are one group. A null doc_id loses against any
    other; a group of null doc_ids has a null keep_id. Rows that repeat a doc_id and its text are one
    document: each is listed, all are marked alike, and group_size counts each. Other columns are ignored.
    An empty table gives an empty result.
    """
    content = lower_az(whole_text())
    rows = docs.select("doc_id", content.alias("content")).withColumn("digest", digest(F.col("content")))
    groups = staged(combine(rows, salts).select("digest", "keep_id", "group_size"), "groups")
    members = staged(rows.select("doc_id", "digest"), "members")
    total = members.count()
    per_digest = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"))
    collided = per_digest.where("contents > 1")
    if collided.isEmpty():
        joined = join_counted(members, groups, "digest", "group_size", total)
    else:
        # contents that share a digest: told apart by the content itself
        apart = members.join(collided, "digest", "left_anti")
        single = join_counted(apart, groups.join(collided, "digest", "left_anti"), "digest", "group_size", total)
        mixed = rows.join(collided.select("digest"), "digest", "left_semi")
        several = mixed.join(combine(mixed, salts), ["digest", "content"]).select(*single.columns)
        joined = single.unionByName(several)
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )
