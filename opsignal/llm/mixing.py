"""Mixes sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, staged, whole_text

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Key ranges per source. Of a source of 30 billion documents, the one range that is sorted holds 7 million.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A weight from 0.25 to 1: highest where words have six characters on average, blanks included."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.lit(0.25) + F.lit(0.75) * F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(mean - F.lit(6.0)) / F.lit(6.0))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number between 0 and 1 that depends on the document and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def scored(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """Adds _size, _key and _range to the packed rows. The smaller its key, the earlier a document is taken."""
    rows = docs.select(packed(docs).alias("_doc"), *([weight.alias("_weight")] if weight is not None else []))
    text = whole_text("_doc.text")
    rows = rows.withColumn("_size", word_count(text))
    if weight is None:
        rows = rows.withColumn("_weight", quality(text, F.col("_size")))
    rows = rows.withColumn("_key", -F.log(uniform(F.col("_doc.doc_id"), seed)) / F.col("_weight"))
    return rows.withColumn("_range", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * RANGES))


def source_targets(sizes: DataFrame, share: float, most: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    ``share`` of all words is dealt out by weight; no target exceeds ``most`` times its source, and what
    exceeds goes to the others by weight. Sources are lifted to one common level per unit of weight: in
    order of the level at which each is full, the level that the rest would have is compared with it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = Window.orderBy("_full", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = (
        sizes.withColumn("_w", dealt.cast("long"))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_full", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after))
    )
    level = F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "source", "_level"))).over(everything)
    rows = rows.withColumn("_level", level["_level"])
    return rows.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")), F.col("_cap").cast("double")).alias("target"),
    )


def mixing_plan(sizes: DataFrame, share: float, most: int) -> DataFrame:
    """One row per source: its target, complete epochs, and the place in key order up to which documents
    are taken once more. ``sizes``: (source, doc_id, _size, _key, _range), staged.

    Words are summed by key range first; only the range in which a source reaches its target is sorted, so
    no task sees a whole source.
    """
    ranges = staged(sizes.groupBy("source", "_range").agg(F.sum("_size").alias("words")), "ranges")
    per_source = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = staged(
        source_targets(per_source, share, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        ranges.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "before", "rest")
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        sizes.groupBy("source", "_range", "_key", "doc_id").agg(F.sum("_size").alias("words"))
        .join(crossing, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("after", F.col("before") + F.sum("words").over(inside))
        # the document that crosses the target is taken if that comes nearer to it
        .where(F.col("after") - F.col("words") / 2 <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("_range", "_key", "doc_id")).alias("last"))
        .select(F.col("source").alias("_s"), "last")
    )
    cut = cut.unionByName(
        # no document of the crossing range is taken: everything in the ranges before it is
        crossing.select("_s", F.struct(F.col("_r").alias("_range"), F.lit(-1.0).alias("_key"), F.lit(None).cast("long").alias("doc_id")).alias("last"))
    ).groupBy("_s").agg(F.max("last").alias("last"))
    return plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix(
    docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 7, weight: Column | None = None
) -> DataFrame:
    """How often each document is taken so that every source comes near its target.

    A source's target gives its complete epochs, in which every document is taken, and a rest. The rest is
    drawn without replacement: each document has the key -ln(u)/weight with u from its doc_id, and the
    smallest keys are taken until their words come nearest to the rest.

    ``weight``: a positive column of ``docs``; by default a quality weight of the text.

    Returns the columns of ``docs``, then size, source_size, target, copies, taken (copies times size).
    Reruns give the same.

    Cases: a null text has size 0; its taken words are 0. Null is a source of its own, the last. Rows that
    repeat a doc_id within a source share its key and are taken together. Without any words all targets are
    0. Result columns of the same name in ``docs`` are replaced. An empty table gives an empty result.
    """
    rows = scored(docs, seed, weight)
    sizes = staged(rows.select("_doc.source", "_doc.doc_id", "_size", "_key", "_range"), "sizes")
    plan = staged(mixing_plan(sizes, share, most), "mixing-plan").withColumnRenamed("source", "_source")
    both = rows.join(plan, F.col("_doc.source").eqNullSafe(F.col("_source")), "left")
    place = F.struct("_range", "_key", F.col("_doc.doc_id").alias("doc_id"))
    copies = F.col("epochs") + F.coalesce(place <= F.col("last"), F.lit(False)).cast("long")
    new = ("size", "source_size", "target", "copies", "taken")
    return both.select(
        *[F.col(f"_doc.`{c}`") for c in docs.columns if c not in new],
        F.col("_size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("_size")).alias("taken"),
    )
