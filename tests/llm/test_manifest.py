"""The Merkle manifest against a plain restatement of its rule."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opsignal.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(nodes, fanout):
    """(root, per node the (before, after) texts on its way up)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place - place % fanout
            ways[i].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + fanout])))
            at[i] = place // fanout
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def brute(rows, fanout, found):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: h("".join(map(coded, (*r[:4], text))))
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    grown = {s: grow([leaf(r, r[4]) for r in trees[s]], fanout) for s in order}
    root, over = grow([grown[s][0] for s in order], fanout)
    out = []
    for s, above in zip(order, over):
        subroot, ways = grown[s]
        for r, way in zip(trees[s], ways):
            node = leaf(r, found(r)) if found(r) is not None else leaf(r, r[4])
            for before, after in way + above:
                node = h(before + node + after)
            out.append((r[0], leaf(r, r[4]), subroot, root, h("".join(a + b for a, b in way + above)), node, node == root))
    return Counter(out)


def run(spark, rows, found=None, **kw):
    docs = spark.createDataFrame(
        [(*r, found and found(r), "k", 1, 2) for r in rows],
        "doc_id long, source string, lang string, n_chars long, text string, found string, tree string, pos long, n long",
    )
    return Counter(tuple(r) for r in merkle.manifest(docs, **kw).collect())


ODD = [
    (1, "a", "en", 3, "x\ny"), (2, "a", None, None, None), (3, "a", "de", 0, ""), (3, "a", "de", 1, "z\n"), (3, "a", "de", 1, "z\n"),
    (None, "a", "en", 1, "q"), (None, None, None, None, None), (9, "é", "en", 9, "\n" + "w" * 200_000), (10, "\U0001f600", "en", 1, "é"),
    (11, "￮", "en", 1, "-"), (12, "", "en", 1, "0:"),
]


@pytest.mark.parametrize("fanout, local", [(3, 1), (3, 5), (2, 2), (4, 0)])
def test_odd_rows(spark, fanout, local):
    found = lambda r: r[4].replace("\n", "") if r[4] is not None and r[0] is not None and r[0] % 3 == 0 else None
    assert run(spark, ODD, found, fanout=fanout, local=local) == brute(ODD, fanout, found)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 27, 28, 100])
def test_ragged_trees_and_a_hot_source(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.randrange(10**6), rnd.choice(["hot", "hot", "hot", f"s{i}"]), "en", i, f"t{i}\n") for i in range(n)]
    none = lambda r: None
    got = run(spark, rows, local=1)
    assert got == brute(rows, 3, none) and all(r[-1] for r in got)


def test_one_changed_row_fails_alone(spark):
    rows = [(i, f"s{i % 2}", "en", i, f"line {i}\nline") for i in range(60)]
    found = lambda r: r[4] + "!" if r[0] == 17 else r[4]
    assert [r[0] for r in run(spark, rows, found, local=1) if not r[-1]] == [17]


def test_empty(spark):
    assert run(spark, []) == Counter()


def test_a_block_never_holds_more_than_its_places(spark):
    rows = spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("pos"), F.lit(1000).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    blocks = merkle.blocked(rows, 3, 4, [])
    assert blocks.agg(F.max(F.size("leaves"))).first()[0] == 81 and blocks.count() == 13
