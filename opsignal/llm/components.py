"""Connected components by joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def between(links: DataFrame) -> DataFrame:
    """Each link between two different nodes once, the smaller node first."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(id, component): every node takes its smallest neighbour, if that is smaller, and follows these steps down to a
    node without a smaller neighbour. Ways shorten by half in each round; only a sum reaches the driver."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("near")))
    now = staged(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("component")), "components")
    total = None
    while True:
        found = now.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if found == total:
            return now
        total = found
        jump = now.select(F.col("id").alias("component"), F.col("component").alias("further"))
        now = staged(now.join(jump, "component").select("id", F.col("further").alias("component")), "components")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b): the smallest node that it is connected with.

    In each round the nodes go to their ``roots``, and only links between different roots, each once, are left for
    the next one. Every other node has a smaller neighbour, so at least half of the nodes go, and a link is read
    again only while it still connects something. Every round is written to the shared folder.
    """
    left = staged(between(links), "arcs")
    found = None
    while found is None or not left.isEmpty():
        now = roots(left)
        ends = [now.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")) for end in ("a", "b")]
        left = left.join(ends[0], "a").join(ends[1], "b")
        left = staged(between(left.select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "arcs")
        found = now if found is None else staged(renamed(found, now), "components")
    return found


def renamed(found: DataFrame, further: DataFrame) -> DataFrame:
    """``found`` (component, ...) after its components have got components of their own (``further``)."""
    onward = further.select(F.col("id").alias("component"), F.col("component").alias("_further"))
    rows = found.join(onward, "component", "left").withColumn("component", F.coalesce("_further", "component"))
    return rows.select(*found.columns)
