"""The pipeline's stages on rows that are easy to get wrong."""

from __future__ import annotations

import pytest

import corpus_pipeline

ROWS = [
    (1, "a calm text of some plain words about trees", "a"), (1, "another text under the same number, about rivers", "a"), (2, None, None), (3, "", "b"),
    (None, "a text without a number that stands alone here", "b"), (None, None, None), (4, "word " * 30_000, "c"), (5, " \n\n ", "c"),
    *[(10 + i, f"shared line\nown words of document number {i} and some more of them {i * 7}", "d") for i in range(12)],
    *[(30 + i, "copied words that all of these documents have in common, every one", "d") for i in range(5)],
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, sf_dir, documents, name, stage):
    docs = documents(*ROWS)
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns and {r.key for r in rows} == {"k"}
    texts = [(r.doc_id, r.text) for r in rows] if name != "packing" else []
    if name == "toxicity":
        assert len(rows) == len(ROWS)
    if name == "line dedup":
        assert len(rows) == len(ROWS) and not any("shared line" in (t or "") for _, t in texts) and sum(d is None for d, _ in texts) == 2
    if name == "near dedup":
        kept = [d for d, _ in texts]
        assert kept.count(1) == 2 and [d for d in kept if d and d >= 30] == [30] and sum(d in (2, 3, 5) for d in kept) == 1
        assert (None, "a text without a number that stands alone here") in texts
    if name == "mixing":
        assert {d for d, _ in texts} >= {1, None, 4} and len(rows) >= len(ROWS) - 12
    if name == "packing":
        # every row of the input gives pieces that add up to its tokens; those of no words are the end id alone
        assert sum(r.start + r.length == r.doc_tokens for r in rows) == len(ROWS)
        assert sum(r.doc_tokens == 1 for r in rows) >= 3 and all(r.length & (r.length - 1) == 0 for r in rows)
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.collect() == []
