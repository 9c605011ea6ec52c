"""Token ids of a corpus in wavelet matrix files, one compressed file per shard.

A wavelet matrix keeps one bit-plane per bit of an id, highest first. Each plane lists the bits of all
positions; before the next plane, positions with bit 0 move in front of those with bit 1, in order. With
the number of ones before each position (rank) and its inverse (select) a file answers what stands at a
position, how often a token occurs in a range, and where, without the other tokens being decoded.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder, qualified
from .common import staged, whole_text
from .tokens import encoder

MAGIC = b"WMATRIX1"
#: Bits per entry of the rank directory.
BLOCK = 512
#: A shard is closed at the first document boundary after so many tokens.
SHARD_TOKENS = 1 << 21


class Plane:
    """One bit-plane: the bits, eight to a byte, and the ones before each block."""

    def __init__(self, bits: np.ndarray, n: int):
        self.n = n
        words = np.zeros(-(-max(n, 1) // BLOCK) * (BLOCK // 8), dtype=np.uint8)
        words[: len(bits)] = bits
        self.words = words.view("<u8")
        ones = np.bitwise_count(self.words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = n - int(self.before[-1])

    def bit(self, at: int) -> int:
        return int(self.words[at >> 6] >> np.uint64(at & 63)) & 1

    def rank1(self, at: int) -> int:
        """Ones before position ``at``."""
        block, word = at // BLOCK, at >> 6
        ones = int(self.before[block]) + int(np.bitwise_count(self.words[block * (BLOCK // 64) : word]).sum())
        if at & 63:
            ones += int(np.bitwise_count(self.words[word] & np.uint64((1 << (at & 63)) - 1)))
        return ones

    def rank(self, bit: int, at: int) -> int:
        return self.rank1(at) if bit else at - self.rank1(at)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) position with this bit."""
        starts = np.minimum(np.arange(len(self.before)) * BLOCK, self.n)
        before = self.before if bit else starts - self.before
        block = int(np.searchsorted(before, k, side="right")) - 1
        inside = self.words[block * (BLOCK // 64) : (block + 1) * (BLOCK // 64)].view(np.uint8)
        bits = np.unpackbits(inside, bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])


class WaveletMatrix:
    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n = planes, n

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now = [], ids
        for b in range(bits - 1, -1, -1):
            ones = (now >> now.dtype.type(b)) & now.dtype.type(1) != 0
            planes.append(Plane(np.packbits(ones, bitorder="little"), len(ids)))
            now = np.concatenate([np.compress(~ones, now), np.compress(ones, now)])
        return cls(planes, len(ids))

    def decode(self, dtype: str = "<u4") -> np.ndarray:
        """All ids, from the last plane up: the order before each move is restored."""
        now = np.zeros(self.n, dtype=dtype)
        for level, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane.words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            earlier = np.empty_like(now)
            earlier[np.flatnonzero(~ones)] = now[: plane.zeros]
            earlier[np.flatnonzero(ones)] = now[plane.zeros :] | now.dtype.type(1 << level)
            now = earlier
        return now

    def access(self, at: int) -> int:
        """The id at a position."""
        token = 0
        for plane in self.planes:
            bit = plane.bit(at)
            token = token << 1 | bit
            at = plane.rank(bit, at) + (plane.zeros if bit else 0)
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of the token among positions lo to hi stand after the last plane."""
        if token >> len(self.planes):
            return 0, 0
        for i, plane in enumerate(self.planes):
            bit = token >> (len(self.planes) - 1 - i) & 1
            lo, hi = (plane.rank(bit, x) + (plane.zeros if bit else 0) for x in (lo, hi))
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token at positions from lo to before hi."""
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the token."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(f"token {token} occurs {hi - lo} times")
        at = lo + k
        for level, plane in enumerate(reversed(self.planes)):
            bit = token >> level & 1
            at = plane.select(bit, at - (plane.zeros if bit else 0))
        return at


def to_bytes(doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """The file: magic, length of the header, header, compressed sections. The header lists the sections."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    parts = {"known": known, "doc_ids": ids, "lengths": lengths.astype("<i8")}
    parts |= {f"plane{i}": p.words.view(np.uint8)[: -(-p.n // 8)] for i, p in enumerate(matrix.planes)}
    sections = {k: squeeze(v.tobytes()) for k, v in parts.items()}
    header = {"n": matrix.n, "bits": len(matrix.planes), "sections": {k: len(v) for k, v in sections.items()}}
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections.values()])


def from_bytes(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and the matrix."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    (size,) = struct.unpack_from("<I", data, 8)
    header, at, parts = json.loads(data[12 : 12 + size]), 12 + size, {}
    for name, length in header["sections"].items():
        parts[name] = zstandard.ZstdDecompressor().decompress(data[at : at + length])
        at += length
    planes = [Plane(np.frombuffer(parts[f"plane{i}"], np.uint8), header["n"]) for i in range(header["bits"])]
    known = np.frombuffer(parts["known"], np.uint8)
    ids = [int(d) if k else None for d, k in zip(np.frombuffer(parts["doc_ids"], "<i8"), known)]
    return ids, np.frombuffer(parts["lengths"], "<i8"), WaveletMatrix(planes, header["n"])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` to each and writes them in ascending doc_id order.

    Every task holds a range of doc_ids and writes its shards one after the other, each under a name of its
    own that is then renamed, so that a task that runs twice leaves the same files. ``folder`` must be
    reachable by all executors; by default it is a new one in the shared folder.

    Returns the staged list of files: part, seq, path, n_docs, n_tokens.

    Cases: null text is empty and gives the end id alone; null doc_ids come first; rows with the same doc_id
    follow each other by the digest of their text. A text longer than a shard makes its shard longer. Other columns are ignored.
    An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    folder = qualified(spark, folder)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = encoder(tokenizer)
        end = np.array([end_id], dtype=words.dtype).tobytes()
        bits = max(1, max(words.tokenizer.get_vocab_size() - 1, end_id).bit_length())
        part, seq, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pd.DataFrame:
            files, root = _open(folder)
            files.create_dir(root, recursive=True)
            lengths = np.array([len(x) for x in held]) // words.dtype.itemsize
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), dtype=words.dtype), bits)
            name = f"part-{part:06d}-{seq:06d}.wm"
            attempt = f"{root}/.{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(attempt) as out:
                out.write(to_bytes(ids, lengths, matrix))
            files.move(attempt, f"{root}/{name}")
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [f"{folder}/{name}"], "n_docs": [len(ids)], "n_tokens": [matrix.n]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                held.append(words.encode(text) + end)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                size += len(held[-1]) // words.dtype.itemsize
                if size >= shard_tokens:
                    yield close()
                    seq, held, ids, size = seq + 1, [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # the digest and a running number cut the rows of one doc_id, and rows that are all alike, over many tasks
    order = [F.col("doc_id"), F.md5("text"), F.monotonically_increasing_id()]
    keyed = rows.withColumns({f"_{i}": c for i, c in enumerate(order)})
    ordered = keyed.repartitionByRange(parts, "_0", "_1", "_2").sortWithinPartitions("_0", "_1", "_2").select("doc_id", "text")
    return staged(ordered.mapInPandas(write, "part long, seq long, path string, n_docs long, n_tokens long"), "shard-list")


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of shards listed by ``write_shards``, from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 and, if wanted, the ids as little-endian unsigned 32-bit integers."""
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = per_part.select(
        F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")
    )
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    placed = shards.join(earlier, "part").select("path", (F.col("base") + inside).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                files, name = _open(path)
                with files.open_input_stream(name) as f:
                    ids, lengths, matrix = from_bytes(f.read())
                ends = np.cumsum(lengths)
                bits = memoryview(matrix.decode().tobytes())
                cuts = [bits[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                out = {
                    "doc_id": pd.array(ids, dtype="Int64"),
                    "start": start + ends - lengths,
                    "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(c) for c in cuts],
                }
                yield pd.DataFrame(out | ({"ids": [bytes(c) for c in cuts]} if with_ids else {}))

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "path").mapInPandas(read, schema)
