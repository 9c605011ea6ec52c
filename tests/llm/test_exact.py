"""Exact deduplication, shared lines, mixing: edge cases, and every query with SQL against it."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from opsignal.llm import exact_dedup, line_dedup, mixing
from opsignal.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(tuple(map(str, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == theirs


def duplicates(df, **kw):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df, **kw).collect())


ROWS = [(1, "Ab\tÄ"), (2, "aB\tÄ"), (3, "ab\tä"), (4, None), (5, ""), (6, "x" * 50_000), (7, "X" * 50_000), (7, "X" * 50_000), (None, "Y"), (None, "y")]
GROUPS = sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 3, False), (7, 7, 3, True), (7, 7, 3, True), (-1, None, 2, True), (-1, None, 2, True)], key=str)


def test_exact_duplicates(documents):
    assert sorted(duplicates(documents(*ROWS)), key=str) == GROUPS
    assert duplicates(documents()) == []


def test_texts_that_share_a_digest_stay_apart(documents):
    weak = lambda c: F.lit(b"0")
    assert sorted(duplicates(documents(*ROWS), digest=weak), key=str) == GROUPS


def test_hot_group_and_many_small_ones(documents):
    rows = [(i, "same") for i in range(300)] + [(i, f"t{i // 2}") for i in range(300, 700)]
    got = duplicates(documents(*rows))
    assert [g for g in got if g[0] < 300] == [(i, 299, 300, i == 299) for i in range(300)]
    assert all(g[1] == g[0] | 1 and g[2] == 2 for g in got if g[0] >= 300)


def brute_lines(rows, min_docs, min_chars):
    blank = " \t\n\x0b\f\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blank).translate(low)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    held = {}
    for i, (_, lines) in enumerate(split):
        for k in set(map(key, lines)):
            held.setdefault(k, set()).add(i)
    gone = {k for k, v in held.items() if len(v) >= min_docs and len(k) >= min_chars}
    return sorted(
        (d or -1, "\n".join(x for x in lines if key(x) not in gone), len(lines), sum(key(x) in gone for x in lines)) for d, lines in split
    )


def test_common_lines(documents):
    rows = [(1, "A\n b \nÄ\n\n"), (2, "a\nB\r\nc\na"), (3, "\tA\nä"), (4, None), (5, ""), (6, "a"), (None, "A\nz"), (7, "B"), (7, "B"), (8, "q\n" * 3000 + "a")]
    for least, chars in ((3, 1), (2, 2), (1, 0), (50, 1)):
        out = line_dedup.drop_common_lines(documents(*rows), least, chars)
        assert out.columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "key", "hash", "n"]
        got = out.collect()
        assert sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in got) == brute_lines(rows, least, chars)
        assert all(r.n_chars == len(r.text) and r.n == 1 for r in got)
    assert line_dedup.drop_common_lines(documents()).collect() == []


def test_mixing(documents):
    rows = [(i, "word " * (i % 7), "abc"[i % 3] if i % 11 else None) for i in range(400)] + [(900, None, "a"), (901, "w " * 5000, "hot")]
    out = mixing.mix(documents(*rows))
    got = out.collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size <= 2 * r.size and r.source_size >= r.size
    assert sizes["hot"] == 5000 and abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= (2500 if s == "hot" else 3)
    level = {s: target[s] / w for s, w in zip([*sorted(x for x in sizes if x), None], (3, 1, 2, 3, 1)) if target[s] < 2 * sizes[s]}
    assert max(level.values()) - min(level.values()) < 1e-6
    again = mixing.mix(documents(*rows).repartition(3))
    assert out.exceptAll(again).isEmpty()
    assert mixing.mix(documents()).collect() == []
    assert [r.taken for r in mixing.mix(documents((1, None), (2, " "))).collect()] == [0, 0]


def test_text_digest_is_of_the_normal_form(spark, sf_dir):
    row = QUERIES["op2_exact_dedup"](spark, sf_dir).first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert row.text_sha256 == hashlib.sha256(text.translate(low).encode()).hexdigest()
