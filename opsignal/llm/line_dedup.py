"""Removes lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, join_counted, lower_az, packed, staged, whole_text


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return lower_az(F.trim(line, F.lit(BLANKS)))


def line_hash(key: Column) -> Column:
    """128 bits: with 64, a corpus of 100 TB would have colliding lines."""
    return F.unhex(F.md5(key))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents without the lines whose key at least ``min_docs`` documents hold.

    Lines are cut at the line feed. A key shorter than ``min_chars`` code points is never dropped, so empty
    lines stay. Kept lines keep their text and order.

    Returns the columns of ``docs`` with the new ``text`` (never null), then n_lines, n_dropped. An ``n_chars``
    column is brought up to date.

    Cases: a null or empty text is one empty line. Every row is a document of its own, also when doc_id is
    null or repeats: it counts each of its keys once. A document that loses all lines stays with an empty
    text. Columns named n_lines or n_dropped are replaced. An empty table gives an empty result.
    """
    lines = F.split(whole_text(), "\n", -1)
    keys = F.transform(lines, line_key)
    per_doc = docs.select(F.explode(F.array_distinct(keys)).alias("key")).where(F.length("key") >= min_chars)
    common = staged(
        per_doc.groupBy(line_hash(F.col("key")).alias("hash"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs),
        "common-lines",
    )
    total = common.agg(F.sum("n")).first()[0] or 0
    # (doc_id, digest of the text) names a row well enough: rows alike in both lose the same lines
    named = [F.col("doc_id").alias("_id"), F.unhex(F.md5(whole_text())).alias("_digest")]
    placed = (
        docs.select(*named, F.posexplode(keys).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select("_id", "_digest", "pos", line_hash(F.col("key")).alias("hash"))
    )
    dropped = (
        join_counted(placed, common, "hash", "n", total, how="inner")
        .groupBy("_id", "_digest")
        .agg(F.collect_set("pos").alias("_drop"))
    )
    whole = docs.select(packed(docs, ("n_lines", "n_dropped")).alias("_doc"), *named).alias("w")
    both = whole.join(
        dropped.alias("d"),
        F.col("w._id").eqNullSafe(F.col("d._id")) & (F.col("w._digest") == F.col("d._digest")),
        "left",
    )
    lines = F.split(whole_text("_doc.text"), "\n", -1)
    none = F.array().cast("array<int>")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drop", none))
    out = both.select("_doc", "_drop", lines.alias("_lines")).select(
        "_doc",
        F.when(F.col("_drop").isNull(), whole_text("_doc.text"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
        .alias("_text"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.size(F.coalesce("_drop", none)).cast("long").alias("_n_dropped"),
    )
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *[new[c].alias(c) if c in new else F.col(f"_doc.`{c}`") for c in columns],
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
    )
