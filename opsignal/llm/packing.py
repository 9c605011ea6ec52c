"""Packs documents into training sequences of power-of-two lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder
from .common import giving_back, whole_text
from .tokens import encoder

#: Bytes of ids in one batch on the way back to Spark.
BATCH_BYTES = 1 << 23


def piece_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the powers of two that make up the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """Cuts each document's ids into pieces of power-of-two lengths. Every piece is a sequence of its own:
    none crosses documents, and none needs padding within its length bucket.

    Returns doc_id, start (ids of the document before the piece), length (the bucket), ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (0). ``longest`` must be a power of two. Nothing is
    shuffled. ``bucketed`` lays sequences of one length together.

    Cases: a null or empty text is the end id alone. Rows that repeat a doc_id are packed each for itself,
    null doc_ids too. Other columns are ignored. An empty table gives no piece.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        rows: list[list] = [[] for _ in fields]
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(words.encode(text.as_py()), dtype=words.dtype).astype("<u4").tobytes() + end
                at, n = 0, len(ids) // 4
                for length in piece_lengths(n, longest):
                    for column, value in zip(rows, (doc_id, at, length, ids[4 * at : 4 * (at + length)], n)):
                        column.append(value)
                    at += length
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, (_, t) in zip(rows, fields)], names=[f for f, _ in fields])
                    rows, held = [[] for _ in fields], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, (_, t) in zip(rows, fields)], names=[f for f, _ in fields])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    pieces = texts.mapInArrow(giving_back(cut), schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def bucketed(sequences: DataFrame) -> DataFrame:
    """The sequences staged with one folder per length, so that a batch of training reads equal lengths only: a
    filter on ``length`` opens one folder."""
    folder = new_folder(sequences.sparkSession, "buckets")
    sequences.write.partitionBy("length").parquet(folder)
    return sequences.sparkSession.read.schema(sequences.schema).parquet(folder)
