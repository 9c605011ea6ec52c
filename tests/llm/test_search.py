"""Nearest neighbours and near-duplicates against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsignal.llm import ann, components, near_dedup

SCHEMA = "vec_id long, embedding array<float>, vec string, bucket long"


def brute(vectors, ids, i, k):
    distance = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
    order = [j for j in np.lexsort((ids, distance)) if ids[j] != ids[i]][:k]
    return [(ids[j], distance[j]) for j in order]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(40, 24)), 30, axis=0) + 0.6 * rng.normal(size=(1200, 24))
    vectors = vectors.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)], SCHEMA)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 40 = 0"), block=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, hits = np.arange(len(vectors)), 0
    for q in range(0, 1200, 40):
        found, want = sorted(got[q]), brute(vectors, ids, q, 10)
        assert [r for r, *_ in found] == list(range(1, 11))
        for _, v, score in found:
            assert abs(score - np.linalg.norm(vectors[v] - vectors[q])) < 1e-12
        hits += len({v for _, v, _ in found} & {v for v, _ in want})
    assert hits >= 0.9 * 300


def test_vectors_that_take_no_part_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 1.0]),
            (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [3e38, 3e38]), (9, [1.0]), (None, [1.0, 0.0]), (10, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df.where("vec_id IN (0, 1, 2, 9)")).collect())
    assert got == [(0, 1, 6), (0, 2, 7), (0, 3, 8)]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []
    copies = spark.createDataFrame([(i, [1.0, 2.0], "x", 1) for i in range(40)], SCHEMA)
    assert [r.vec_id for r in ann.nearest(copies, copies.where("vec_id = 3")).orderBy("rank").collect()] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_copies_of_a_vector_take_one_place(spark):
    rows = [(0, [1.0, 0.0]), *[(1, [1.0, 0.01])] * 30, *[(i, [1.0, i / 50]) for i in range(2, 20)]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted((r["rank"], r.vec_id) for r in ann.nearest(df, df.where("vec_id = 0")).collect())
    assert got == [(i, i) for i in range(1, 11)]


def sets_of(text):
    words = (text or "").lower().split()
    runs = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    # a shingle weighs as much as it occurs
    return frozenset((run, nth) for run, times in runs.items() for nth in range(times))


def brute_classes(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= 0.8 * len(a | b) > 0:
            parent[root(j)] = root(i)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(root(i), []).append(rows[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in classes.items()}
    return sorted(((d, least[root(i)], len(classes[root(i)]), d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates(documents):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    rows = []
    for group in range(25):
        base = [word() for _ in range(rnd.choice((8, 40, 90, 400)))]
        for _ in range(rnd.choice((1, 2, 6))):
            copy = list(base)
            for _ in range(rnd.choice((0, 1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy).upper() if rnd.random() < 0.3 else "\n".join(copy)))
    passage = " ".join(word() for _ in range(60))
    rows += [(len(rows) + i, passage + " " + " ".join(word() for _ in range(20 + i))) for i in range(30)]
    chorus = [" ".join(word() for _ in range(12)) for _ in range(3)]
    rows += [(600 + 10 * k + i, " ".join((chorus[k] + " ") * n)) for k in range(3) for i, n in enumerate((1, 2, 2, 9, 10, 11, 30))]
    for k in range(8):
        plain = [word() for _ in range(100)]
        rows += [(700 + 2 * k, " ".join(plain)), (701 + 2 * k, " ".join(plain + plain[: 10 + k]))]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "a b"), (504, "A  b"), (None, "only this one here and now"), (505, "x " * 9000), (503, "c d")]
    got = near_dedup.near_duplicates(documents(*rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in got), key=str) == brute_classes(rows)
    assert near_dedup.near_duplicates(documents()).collect() == []


def test_weights_are_counts():
    text = "a b c d e f " * 4 + "g h i j k"
    elements, times = near_dedup.shingles(text)
    whole = near_dedup.bag(elements, times)
    plain = near_dedup.shingles(" ".join(f"w{i}" for i in range(40)))[0]
    assert (near_dedup.signature(plain) == near_dedup.signature(plain, np.ones(len(plain)))).all()
    assert len(whole) == times.sum() == 25 and len(set(whole.tolist())) == 25 and set(elements.tolist()) <= set(whole.tolist())
    # hit by the same darts as the set of all occurrences, in the share of the weighted similarity
    more = near_dedup.shingles("a b c d e f " * 7)
    x, y = (near_dedup.signature(e, t.astype(float), 4000) for e, t in ((elements, times), more))
    one, two = set(whole.tolist()), set(near_dedup.bag(*more).tolist())
    assert abs((x == y).mean() - len(one & two) / len(one | two)) < 0.04 and len(one & two) < len(set(elements.tolist())) * 4


def test_one_of_each_class_stays(documents):
    text = " ".join(f"w{i}" for i in range(50))
    kept = near_dedup.keep_one(documents((1, "other words that stand alone here"), (2, text), (3, text), (4, text + " more")))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns[-3:] == ["key", "hash", "n"]


def test_each_text_of_a_doc_id_is_judged_in_its_own_class(documents):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(1, a), (7, a), (7, b), (None, a), (None, c), (None, c), (None, None), (2, d), (1, d)]
    kept = near_dedup.keep_one(documents(*rows)).collect()
    want = [(1, a), (7, b), (None, c), (None, c), (None, None), (1, d)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)


def test_each_text_meets_its_own_set_only(spark, documents, monkeypatch):
    rows = [(None, f"{i} words of a text of its own {i}") for i in range(20)]
    docs = documents(*rows)
    wanted = near_dedup.sketch(docs).select("doc_id", "digest", F.xxhash64("name").alias("id"))
    monkeypatch.setattr(DataFrame, "dropDuplicates", lambda self, *_: self)
    assert len(near_dedup.shingle_sets(docs, wanted).collect()) == 20
    plan = near_dedup.shingle_sets(docs, wanted)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.split("\n") if "Join Inner" in line)
    assert "_t#" in join and "digest#" in join


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 62, 400).astype(np.uint64), rng.integers(0, 1 << 62, 100).astype(np.uint64)
    x, y = near_dedup.signature(a, k=2000), near_dedup.signature(np.concatenate([a[:300], b]), k=2000)
    assert abs((x == y).mean() - 300 / 500) < 0.06
    w, v = rng.uniform(0.1, 3, 400), rng.uniform(0.1, 3, 400)
    x, y = near_dedup.signature(a, w, 2000), near_dedup.signature(a, v, 2000)
    assert abs((x == y).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.06
    assert (near_dedup.signature(a[:1], k=160) == near_dedup.signature(a[:1], k=160)).all()


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    marks = [np.arange(160, dtype="<u2").tobytes(), (np.arange(160) + 7).astype("<u2").tobytes()]
    rows = [(1, i, i, 10 + i % 2, marks[i % 2], 20) for i in range(20)]
    df = spark.createDataFrame(rows, "key long, id long, component long, n long, signature binary, m long")
    monkeypatch.setattr(near_dedup, "DENSE", 4)
    dense = near_dedup.screened(df, 0.8).collect()
    assert [(r.a, r.b, r.key, r.i, r.j) for r in dense] == [(None, None, 1, 0, 0)]
    monkeypatch.setattr(near_dedup, "DENSE", 100)
    whole = sorted((r.a, r.b) for r in near_dedup.screened(df, 0.8).collect())
    assert len(whole) == 2 * 45
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    assert sorted((r.a, r.b) for r in near_dedup.screened(df, 0.8).collect()) == whole


def test_dense_groups_give_the_same_classes(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "DENSE", 0)
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rnd.choice((1, 2, 3))):
            copy[rnd.randrange(120)] = f"x{rnd.random()}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_duplicates(documents(*rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in got), key=str) == brute_classes(rows)


def test_connected_nodes_of_a_group_are_not_repeated(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    schema = "key long, id long, component long, m long, main long, most long"
    for inside, others, most_rows in ((100, 5, 100 + 5 * 10), (200, 5, 200 + 5 * 20), (100, 25, 100 * 3 + 25 * 13), (4, 5, 9)):
        group = [(1, i, min(i, others), inside + others, others, inside) for i in range(inside + others)]
        rows = near_dedup.in_blocks(spark.createDataFrame(group, schema)).collect()
        assert len(rows) == most_rows
        blocks = {}
        for r in rows:
            blocks.setdefault((r.i, r.j), []).append(r)
        met = {(x.id, y.id) for block in blocks.values() for x, y in itertools.product(block, block)}
        assert all((x[1], y[1]) in met for x, y in itertools.product(group, group) if x[2] != y[2])


def test_links_of_a_block_connect_components(spark):
    one, two = list(range(10)), list(range(50, 60))
    rows = [(1, 0, 0, i, c, s) for i, (c, s) in enumerate([(0, one), (0, one), (0, two), (3, two), (3, two), (5, one), (6, [99])])]
    df = spark.createDataFrame(rows, "key long, i long, j long, id long, component long, shingles array<long>")
    links = near_dedup.links_in_place(df, 0.8).collect()
    assert sorted(sorted((r.a, r.b)) for r in links) == [[0, 3], [0, 5]]


def test_links_inside_a_component_are_not_read_again(spark, monkeypatch):
    rnd = random.Random(5)
    links = [(0, i) for i in range(1, 150)] + [(i + 1, i) for i in range(200, 300)] + [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(80)]
    links += [(1, 0), (7, 7), (149, 250), (600 + 2 * 3, 601), (601, 600), (606, 700)]
    want = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    read, write = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, label: (read.append(df.count()) if label == "arcs" else None, write(df, label))[1])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert read[0] == len({frozenset(x) for x in links if x[0] != x[1]}) and sum(read[1:]) < read[0] / 4 and read[-1] == 0
