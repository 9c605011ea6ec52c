"""Graph operators against brute force."""

from __future__ import annotations

import random
from collections import deque

from opsignal.plans import graph, impact


def breadth_first(arcs, seed, depth):
    seen, queue = {seed: 0}, deque([seed])
    while queue:
        n = queue.popleft()
        if seen[n] == depth:
            continue
        for a, b in arcs:
            if a == n and b not in seen:
                seen[b] = seen[n] + 1
                queue.append(b)
    return seen


def random_edges(n=30, m=45, seed=7):
    r = random.Random(seed)
    return sorted({(f"s{r.randrange(n)}", f"s{r.randrange(n)}") for _ in range(m)})


def edge_frame(spark, edges):
    rows = [(a, b, 1, 100) for a, b in edges]
    return spark.createDataFrame(rows, "src_service string, dst_service string, incident_link_count bigint, flow_count bigint")


def test_k_hop(spark):
    edges = random_edges()
    seeds = ["s0", "s5", "alone"]
    both = edges + [(b, a) for a, b in edges]
    frame = spark.createDataFrame([(s,) for s in seeds], "seed string")
    got = {(r.seed, r.node): r.hop for r in graph.k_hop_neighborhood(edge_frame(spark, edges), frame, 3).collect()}
    want = {(s, n): h for s in seeds for n, h in breadth_first(both, s, 3).items()}
    assert got == want


def test_a_hop_reads_its_frontier_only(spark, monkeypatch):
    """Rows written by each hop: the nodes at that distance, none twice, and nothing after the end of a short walk."""
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(9)] + [("c03", f"leaf{i}") for i in range(50)]
    frame = spark.createDataFrame([("c03",)], "seed string")
    written, joined = [], []
    real, real_join = graph.stored, graph.join_cut
    monkeypatch.setattr(graph, "stored", lambda df, label: (out := real(df, label), label == "hop" and written.append(out.count()))[0])
    monkeypatch.setattr(graph, "join_cut", lambda cut, large, last, key: (joined.append(last.count()), real_join(cut, large, last, key))[1])
    got = graph.k_hop_neighborhood(edge_frame(spark, chain), frame, 20)
    assert got.count() == 10 + 50
    # from c03: 52 neighbours, then both ways along the chain until its far end
    assert written == [1, 52, 2, 2, 1, 1, 1, 0] and joined == written[:-1]


def test_a_hub_is_cut(spark, monkeypatch):
    monkeypatch.setattr(graph, "ARCS_AT_ONCE", 10)
    edges = [("hub", f"n{i}") for i in range(95)] + [(f"n{i}", f"m{i}") for i in range(5)]
    frame = spark.createDataFrame([("n0",), ("hub",), ("gone",)], "seed string")
    both = edges + [(b, a) for a, b in edges]
    got = {(r.seed, r.node): r.hop for r in graph.k_hop_neighborhood(edge_frame(spark, edges), frame, 3).collect()}
    assert got == {(s, n): h for s in ("n0", "hub", "gone") for n, h in breadth_first(both, s, 3).items()}


def test_blast_radius_bounded_and_to_the_end(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c12", "c9"), ("x", "c12"), ("x", "x")]
    rel = spark.createDataFrame(chain, "source_service string, target_service string")
    back = [(b, a) for a, b in chain]

    def want(depth):
        out = {t: len(set(breadth_first(back, t, depth)) - {t}) for _, t in chain}
        return {k: v for k, v in out.items() if v}

    for depth in (1, 3, None):
        got = {r.service_name: r.blast_radius for r in impact.dependency_blast_radius(rel, depth).collect()}
        assert got == want(depth or 99), depth


def test_incident_view_falls_back_to_busiest(spark):
    plain = edge_frame(spark, [(f"a{i:02}", "b") for i in range(40)]).selectExpr(
        "src_service", "dst_service", "0L AS incident_link_count", "cast(substr(src_service, 2) AS bigint) AS flow_count"
    )
    nodes = spark.createDataFrame([(f"a{i:02}",) for i in range(40)] + [("b",), ("c",)], "service_name string")
    kept_nodes, kept = graph.incident_view(nodes, plain)
    assert kept.count() == 30 and kept.agg({"flow_count": "min"}).first()[0] == 10
    assert kept_nodes.count() == 31
    linked = plain.unionByName(edge_frame(spark, [("z", "b")]))
    assert [r.src_service for r in graph.incident_view(nodes, linked)[1].collect()] == ["z"]


def test_domain_mode_breaks_ties_by_name(spark):
    rows = [("a", "Net "), ("a", "application"), ("b", "infra"), ("b", "infrastructure"), ("b", "net"), ("", "x"), ("c", "")]
    inc = spark.createDataFrame(rows, "root_service string, domain string")
    none = spark.createDataFrame([], "service string, domain string")
    got = {r.service_name: r.domain for r in graph.service_domain_mode(inc, none, none).collect()}
    assert got == {"a": "application", "b": "infrastructure"}


def test_no_self_links(inputs):
    assert graph.incident_edges(inputs.incidents).where("src_service = dst_service").isEmpty()
