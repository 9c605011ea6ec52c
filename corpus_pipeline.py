"""A training corpus in five stages: toxic documents go, shared lines go, one document of each group of
near-duplicates stays, sources are mixed to their target weights, and the result is packed into sequences.

Cases, for all stages: a null or empty text is a document like any other, rows with a null or repeated doc_id are
documents of their own, further columns are carried along whatever their names, and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsignal.llm import line_dedup, mixing, near_dedup, packing, toxicity
from opsignal.llm.common import packed, staged, table
from opsignal.llm.queries import tokenizer


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5, by a model fitted on the labelled ones that are not held out. A null or empty
    text is scored by its features; without labels of both classes the share of toxic ones decides."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs.select(packed(docs).alias("_row"), F.col("text")), "_score")
    return scored.where("_score < 0.5").select("_row.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share. A null text becomes empty, as does one that loses all
    its lines; no document goes."""
    return line_dedup.drop_common_lines(docs).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the rows with the smallest doc_id. Texts without words are one class; of a class
    in which every doc_id is null all rows stay."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, each time as a row of its own. One of no words has size 0, so
    taking it costs nothing; a null source is a source, the last one."""
    taken = mixing.mix(docs.select(packed(docs).alias("_row"), "doc_id", "text", "source"))
    return taken.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_n")).select("_row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document in pieces of power-of-two lengths. A null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_common_lines),
    ("near dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", sequences),
]

#: Scores, signatures and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
