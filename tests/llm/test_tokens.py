"""Token ids, wavelet matrix files and packing against the tokenizer itself."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opsignal.llm import packing, wavelet
from opsignal.llm.queries import tokenizer
from opsignal.llm.tokens import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PARTS = ["a", "Zb", " ", "  ", "\n", "\t", "é", "ß", "İ", "Σ", "1", "²", "'s", "'LL", ".", ",", "日", "́", "\x85", "\xa0", " ", "<|endoftext|>", "\x1c", "word", "Ⅷ", " \n"]
TEXTS = [(1, None), (2, ""), (3, "Hello, World's end.\nNext  line "), (4, "a b " * 6000), (5, "日本 ß"), (None, "none"), (4, "again"), (0, "x" * 5000)]


@pytest.mark.parametrize("name", FILES)
def test_words_give_the_ids_of_the_text(name):
    mine, whole, rnd = Encoder(tokenizer(name)), Tokenizer.from_file(tokenizer(name)), random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(mine.encode(text), mine.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def encoded(name, end):
    whole = Tokenizer.from_file(tokenizer(name))
    return [(d, np.array(whole.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4").tobytes()) for d, t in TEXTS]


def test_wavelet_matrix():
    ids = np.random.default_rng(1).zipf(1.4, 3000).astype(np.uint16)
    docs, lengths, matrix = wavelet.from_bytes(wavelet.to_bytes([7, None], np.array([1000, 2000]), wavelet.WaveletMatrix.build(ids, 16)))
    assert docs == [7, None] and lengths.tolist() == [1000, 2000] and (matrix.decode() == ids).all()
    assert [matrix.access(i) for i in (0, 511, 512, 2999)] == ids[[0, 511, 512, 2999]].tolist()
    for token in (1, 2, 9, 60000):
        where = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(where) and matrix.count(token, 100, 777) == ((where >= 100) & (where < 777)).sum()
        assert [matrix.occurrence(token, k) for k in range(min(5, len(where)))] == where[:5].tolist()
        with pytest.raises(IndexError):
            matrix.occurrence(token, len(where))
    empty = wavelet.from_bytes(wavelet.to_bytes([], np.zeros(0), wavelet.WaveletMatrix.build(ids[:0], 16)))[2]
    assert empty.n == 0 and empty.count(3) == 0


def test_shards_round_trip(spark, documents, tmp_path):
    shards = wavelet.write_shards(documents(*TEXTS), tokenizer(FILES[0]), 0, str(tmp_path / "s"), shard_tokens=4000)
    assert shards.count() > 1 and len(list((tmp_path / "s").glob("part-*.wm"))) == shards.count()
    got = wavelet.read_documents(shards, with_ids=True).orderBy("start").collect()
    text = dict(zip(range(len(TEXTS)), TEXTS))
    order = sorted(text, key=lambda i: (TEXTS[i][0] is not None, TEXTS[i][0] or 0, hashlib.md5((TEXTS[i][1] or "").encode()).hexdigest()))
    ids, at = encoded(FILES[0], 0), 0
    for row, i in zip(got, order, strict=True):
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (TEXTS[i][0], at, len(ids[i][1]) // 4, ids[i][1])
        assert row.ids_crc32 == zlib.crc32(ids[i][1])
        at += row.n_tokens
    assert wavelet.read_documents(wavelet.write_shards(documents(), tokenizer(FILES[0]))).collect() == []


def test_packing(documents):
    rows = packing.pack(documents(*TEXTS), tokenizer(FILES[1])).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in rows)
    want = sorted(((d, x) for d, x in encoded(FILES[1], 1)), key=str)
    got, held = [], b""
    for r in sorted(rows, key=lambda r: r.sequence_id):
        assert r.start == len(held) // 4 and len(r.ids) == 4 * r.length and r.length <= 2048
        held += bytes(r.ids)
        if len(held) == 4 * r.doc_tokens:
            got.append((r.doc_id, held))
            held = b""
    assert sorted(got, key=str) == want and packing.pack(documents(), tokenizer(FILES[1])).collect() == []
    assert packing.piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]


def test_one_doc_id_fills_many_shards(spark, documents, tmp_path):
    """Rows that are all alike, in number and text, are cut over several tasks."""
    rows = documents(*[(None, "same text")] * 4000, (1, "other"))
    parts = [r.n_docs for r in wavelet.write_shards(rows, tokenizer(FILES[0]), 0, str(tmp_path / "s")).collect()]
    assert len(parts) > 1 and sum(parts) == 4001 and max(parts) < 3000


def test_a_bare_folder_belongs_to_the_default_file_system(spark, tmp_path):
    assert wavelet.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert wavelet.qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.defaultFS", "viewfs://store")
    conf.set("fs.viewfs.mounttable.store.link./shared", f"file://{tmp_path}")
    try:
        assert wavelet.qualified(spark, "/shared/x") == "viewfs://store/shared/x"
    finally:
        conf.unset("fs.defaultFS")
        conf.unset("fs.viewfs.mounttable.store.link./shared")


def test_buckets_hold_equal_lengths(documents):
    packed = packing.pack(documents(*TEXTS), tokenizer(FILES[1]))
    laid = packing.bucketed(packed)
    key = lambda r: (r.sequence_id, r.start)
    assert sorted(laid.select(*packed.columns).collect(), key=key) == sorted(packed.collect(), key=key)
    files = [(r.f.rsplit("/", 2)[1], r.length) for r in laid.select(F.input_file_name().alias("f"), "length").distinct().collect()]
    assert files and all(folder == f"length={n}" for folder, n in files)
    plan = laid.where("length = 512")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(length" in plan
    assert packing.bucketed(packing.pack(documents(), tokenizer(FILES[1]))).collect() == []
