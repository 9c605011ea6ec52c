"""The service graph: nodes, edges, neighbourhoods and who propagates to whom."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_if, or_zero
from ..functions.scoring import normal_domain
from ..operators.lookups import cut_hot, join_cut
from ..session import stored


def service_domain_mode(incidents: DataFrame, alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """The domain a service is seen with most often; equal counts go to the first name."""

    def seen(df: DataFrame, service: str) -> DataFrame:
        named = df.where((F.col(service) != "") & (F.col("domain") != ""))
        return named.select(F.col(service).alias("service_name"), normal_domain("domain").alias("domain"))

    votes = seen(incidents, "root_service")
    votes = votes.unionByName(seen(alerts, "service")).unionByName(seen(changes, "service"))
    counted = votes.groupBy("service_name", "domain").agg(F.count("*").alias("n"))
    return counted.groupBy("service_name").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("domain"))


def topology_nodes(ranking: DataFrame, service_domains: DataFrame) -> DataFrame:
    return ranking.join(service_domains, "service_name", "left").select(
        "service_name",
        "risk_score",
        "risk_rank",
        "incident_count_as_root",
        "avg_health_score",
        "total_revenue_impact",
        F.coalesce("domain", F.lit("unknown")).alias("domain"),
    )


def network_edges(flows: DataFrame) -> DataFrame:
    named = flows.where((F.col("src_service") != "") & (F.col("dst_service") != ""))
    return named.groupBy("src_service", "dst_service").agg(
        F.count("*").alias("network_flow_count"),
        F.avg("latency_us").alias("avg_latency_us"),
        count_if(F.col("connection_reset")).alias("reset_count"),
        count_if(F.col("timeout")).alias("timeout_count"),
        F.sum("retransmits").alias("total_retransmits"),
    )


def incident_edges(incidents: DataFrame) -> DataFrame:
    links = incidents.select(F.col("root_service").alias("src_service"), F.explode("impacted_services").alias("dst_service"))
    other = links.where(F.col("src_service") != F.col("dst_service"))
    return other.groupBy("src_service", "dst_service").agg(F.count("*").alias("incident_link_count"))


def topology_edges(flows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Flow edges and incident links in one edge list; flow_count weighs an incident link as 100 flows."""
    both = network_edges(flows).unionByName(incident_edges(incidents), allowMissingColumns=True)
    sums = ("network_flow_count", "incident_link_count", "reset_count", "timeout_count", "total_retransmits")
    merged = both.groupBy("src_service", "dst_service").agg(
        F.avg("avg_latency_us").alias("avg_latency_us"),
        *[or_zero(F.sum(c)).alias(c) for c in sums],
    )
    return merged.withColumn("flow_count", F.col("network_flow_count") + F.col("incident_link_count") * 100)


def incident_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the incident view: linked edges, or the 30 busiest when no edge is linked."""
    any_link = edges.agg(F.coalesce(F.max(F.col("incident_link_count") > 0), F.lit(False))).scalar()
    linked = edges.where("incident_link_count > 0")
    busiest = edges.orderBy(F.desc("flow_count"), "src_service", "dst_service").limit(30).where(~any_link)
    kept = linked.unionByName(busiest)
    return nodes.join(_ends(kept), "service_name", "left_semi"), kept


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_service", "dst_service")).alias("service_name"))


#: Arcs of one node that one task joins; a node with more is cut.
ARCS_AT_ONCE = 100_000


def _hops(arcs: DataFrame, seeds: DataFrame, depth: int, both_ways: bool) -> DataFrame:
    """Least number of arcs from each seed to each node, up to ``depth``; ``arcs`` (a, b), ``seeds`` (seed).

    A hop joins the nodes found by the last one with their arcs, and keeps what is not known yet. With arcs
    ``both_ways`` a neighbour of the last hop was found by the last two hops or not at all, so only these are
    compared. Each hop is written; the walk ends when one is empty. Nodes with very many arcs are cut.
    """
    cut, large = cut_hot(arcs.where("a <> b").distinct(), "a", ARCS_AT_ONCE)
    cut = stored(cut, "arcs")
    large = stored(large, "hubs")
    start = seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    found = [stored(start, "hop")]
    for level in range(1, depth + 1):
        last = found[-1].select("seed", F.col("node").alias("a"))
        onward = join_cut(cut, large, last, "a").select("seed", F.col("b").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, found[-2:] if both_ways else found).select("seed", "node")
        fresh = stored(onward.join(known, ["seed", "node"], "left_anti").withColumn("hop", F.lit(level)), "hop")
        if fresh.isEmpty():
            break
        found.append(fresh)
    return reduce(DataFrame.unionByName, found)


def k_hop_neighborhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hop) over undirected edges; the seed itself has hop 0."""
    there = edges.select(F.col("src_service").alias("a"), F.col("dst_service").alias("b"))
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return _hops(there.unionByName(back), seeds, depth, both_ways=True)


def reverse_hops(relationships: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hop): services that depend on the seed through at most ``depth`` relationships."""
    against = relationships.select(F.col("target_service").alias("a"), F.col("source_service").alias("b"))
    return _hops(against, seeds, depth, both_ways=False)


def propagation_signal(edges: DataFrame) -> DataFrame:
    """Outbound against inbound incident links of every service on an edge."""
    sides = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src_service").alias("service_name"), F.col("incident_link_count").alias("o"), F.lit(0).cast("bigint").alias("i")),
                F.struct(F.col("dst_service").alias("service_name"), F.lit(0).cast("bigint").alias("o"), F.col("incident_link_count").alias("i")),
            )
        )
    )
    summed = sides.groupBy("service_name").agg(F.sum("o").alias("outbound_links"), F.sum("i").alias("inbound_links"))
    label = F.when(F.col("outbound_links") >= F.col("inbound_links"), "Likely root / propagator")
    return summed.withColumn("signal", label.otherwise("Likely impacted by upstream dependency"))


def root_candidates(nodes: DataFrame, limit: int = 6) -> DataFrame:
    order = [F.desc("incident_count_as_root"), F.desc("risk_score"), "service_name"]
    return nodes.where("incident_count_as_root > 0").orderBy(*order).limit(limit)


def upstream_downstream(edges: DataFrame, service: str) -> tuple[DataFrame, DataFrame]:
    """(edges into, edges out of) a service that carry incident links, strongest first."""
    linked = edges.where("incident_link_count > 0")

    def side(end: str) -> DataFrame:
        rows = linked.where(F.col(end) == F.lit(service))
        return rows.orderBy(F.desc("incident_link_count"), "src_service", "dst_service")

    return side("dst_service"), side("src_service")
