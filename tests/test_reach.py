"""Reachability by components, levels and bitmaps against brute force."""

from __future__ import annotations

import random
import re

import pytest

from opsignal.operators import reach


def brute(arcs):
    after = {}
    for a, b in arcs:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    out = {}
    for start in after:
        seen, todo = {start}, [start]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[start] = len(seen) - 1
    return out


def shapes():
    rnd = random.Random(9)
    rand = lambda n, m: [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    return {
        "chain": [(i, i + 1) for i in range(60)],
        "ladder": [(i, i + d) for i in range(50) for d in (1, 2)],
        "ring with tails": [(i, (i + 1) % 20) for i in range(20)] + [(20 + i, i) for i in range(5)] + [(i, 40 + i) for i in range(3)],
        "hub": [(i, 1000) for i in range(300)] + [(1000, 2000 + i) for i in range(300)],
        "two rings": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 6), (6, 0)],
        "sparse": rand(80, 90),
        "dense": rand(25, 200),
        "many small": [(3 * i, 3 * i + 1) for i in range(60)] + [(3 * i + 1, 3 * i) for i in range(0, 60, 2)],
    }


def frame(spark, arcs):
    return spark.createDataFrame([(f"s{a}", f"s{b}") for a, b in arcs], "a string, b string")


def named(arcs):
    return {f"s{k}": v for k, v in brute([x for x in arcs if x[0] != x[1]]).items()}


def test_sizes_by_one_task_where_the_rest_is_small(spark):
    arcs = [(f"{k}:{a}", f"{k}:{b}") for k, shape in shapes().items() for a, b in shape]
    got = {r.node: r.n for r in reach.reach_sizes(frame(spark, arcs + arcs[:3])).collect()}
    assert got == named(arcs)


@pytest.mark.parametrize("shape, local, nodes, most", [("two rings", 0, 2, 2), ("hub", 0, 20, 50), ("sparse", 40, 7, 9), ("many small", 10, 1, 1)])
def test_sizes_by_rounds(spark, shape, local, nodes, most):
    """Without the step that finishes a small rest in one task, and with strips of a few nodes or one level."""
    arcs = shapes()[shape]
    got = reach.reach_sizes(frame(spark, arcs), local=local, strip_nodes=nodes, strip_arcs=most)
    assert {r.node: r.n for r in got.collect()} == named(arcs)


def test_no_arcs(spark):
    assert reach.reach_sizes(frame(spark, [])).collect() == []
    only_loops = spark.createDataFrame([("x", "x"), (None, "x"), ("x", None)], "a string, b string")
    assert reach.reach_sizes(only_loops).collect() == []


def test_more_nodes_than_one_bitmap_holds(spark):
    """A star of 40,000 leaves, so that sets spread over two buckets."""
    arcs = spark.range(40_000).selectExpr("'hub' AS a", "concat('n', id) AS b").unionByName(
        spark.sql("SELECT 'top' AS a, 'hub' AS b UNION ALL SELECT 'n7', 'end'")
    )
    got = {r.node: r.n for r in reach.reach_sizes(arcs).where("node IN ('hub', 'top', 'n7', 'n8', 'end')").collect()}
    assert got == {"hub": 40_001, "top": 40_002, "n7": 1, "n8": 0, "end": 0}


def test_no_set_meets_another(spark, monkeypatch):
    """What is joined is arcs with bitmaps or names; every intermediate table is as long as the nodes or the arcs."""
    arcs = shapes()["dense"]
    seen = []
    real = reach.stored

    def counted(df, label):
        out = real(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(reach, "stored", counted)
    reach.reach_sizes(frame(spark, arcs), local=0, strip_nodes=5).collect()
    assert len(seen) > 8 and max(n for _, n in seen) <= len(set(arcs)), seen
    assert not re.search("closure|pairs", " ".join(label for label, _ in seen))


def test_a_hot_key_is_cut(spark):
    from pyspark.sql import functions as F

    from opsignal.operators.lookups import join_salted

    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("v"))
    lookup = spark.sql("SELECT explode(array('hot', 'hot', 'k1', 'k2', 'none')) AS k").withColumn("w", F.monotonically_increasing_id())
    want = sorted(map(tuple, rows.join(lookup, "k").select("k", "v", "w").collect()))
    got = join_salted(rows, lookup, "k", most=100)
    assert sorted(map(tuple, got.select("k", "v", "w").collect())) == want and len(want) == 1400 + 12
    # the hot key goes to seven parts
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()
