"""Texts that are very long or repeat: personal data in linear time, toxicity without cuts or clips."""

from __future__ import annotations

import math
import time

from pyspark.sql import functions as F

from opsignal.llm import pii, toxicity


def test_a_text_of_many_addresses_takes_linear_time(documents):
    """A megabyte with 50,000 addresses, each a span and a candidate."""
    n = 50_000
    docs = documents((1, " ".join(f"u{i}@site{i % 7}.example" for i in range(n))), (2, "call +1 (555) 123-4567 now"))
    start = time.perf_counter()
    got = {r.doc_id: r.base for r in pii.personal_data(docs).select("doc_id", F.size("base").alias("base")).collect()}
    took = time.perf_counter() - start
    assert got == {1: n, 2: 1} and took < 300, took


def described(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(pii.runs(F.col("t"), pii.base_spans(F.col("t"))).alias("r"))
    return [(r.name, r.start, r.end, r.kind, r.patterns) for r in df.first().r]


def test_contexts_are_whole_words_of_any_length(spark):
    long = "w" * 500
    (one,) = described(spark, f"first {long}\t \nid7 {long}x. rest")
    assert one == ("id7", 509, 512, None, [f"L {long}", f"LL first {long}", f"R {long}x", f"LR {long} _ {long}x"])


def test_words_of_a_run_are_candidates_too(spark):
    got = described(spark, "see a1 b2 there")
    assert [(name, start, end) for name, start, end, _, _ in got] == [("a1", 4, 6), ("b2", 7, 9), ("a1 b2", 4, 9)]
    assert got[0][4] == ["L see", "R #", "LR see _ #"] and got[1][4] == ["L #", "R there", "LR # _ there"]
    assert got[2][4] == ["L see", "R there", "LR see _ there"]


def test_kinds_of_candidates_beyond_one_chunk(spark):
    text = " ".join(f"m{i}@x.yz" if i % 3 else f"n{i}" for i in range(pii.CHUNK * 2 + 5))
    got = described(spark, text)
    singles = got[: pii.CHUNK * 2 + 5]
    assert [k for _, _, _, k, _ in singles] == [0 if i % 3 else None for i in range(len(singles))]
    assert all(text[s:e] == name for name, s, e, _, _ in got)


PLACE = 9  # of the share of shouted words among the features


def test_shouting_in_a_long_text_counts():
    reader = toxicity.Reader({"idiot": 3.0})
    quiet, loud = reader.features("tree " * 5000), reader.features("tree " * 5000 + "IDIOT ÄRGER")
    assert quiet[PLACE] == 0 and loud[PLACE] > 0


def test_hits_are_not_clipped():
    reader = toxicity.Reader({f"bad{c}{d}": 2.0 for c in "abcdefgh" for d in "ijklm"})
    words = [f"bad{c}{d}" for c in "abcdefgh" for d in "ijklm"]
    assert reader.features(" ".join(words))[1] == math.log1p(40) and reader.features(" ".join(words))[4] == math.log1p(40)
    assert reader.features(" ".join(words * 9))[1] == math.log1p(360)


def test_a_labelled_id_that_repeats_does_not_flood_the_sample(spark, monkeypatch):
    """A third of all rows bear one labelled id: the sample keeps to its size."""
    texts = [(i, f"some plain words here {i} " + ("idiot" if i % 2 else "friend")) for i in range(400)]
    texts += [(1, f"idiot again {i}") for i in range(3000)] + [(3, "idiot alike")] * 3000
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    sizes = []
    real = toxicity.staged
    monkeypatch.setattr(toxicity, "staged", lambda df, label: (out := real(df, label), label == "toxicity-sample" and sizes.append(out.count()))[0])
    got = toxicity.toxicity(docs, labels, sample=500).where("doc_id < 400").distinct().count()
    assert sizes and sizes[0] < 700 and got > 300
