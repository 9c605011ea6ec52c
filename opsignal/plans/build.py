"""All tables in dependency order: bronze in, silver and gold written once each."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import stamped
from ..sources.versions import Version, commit, prepared, with_shared
from . import gold, impact, silver

Tables = dict[str, DataFrame]

# Large telemetry is laid out by day, so that windows prune folders.
DAY_OF = {
    "bronze_metrics": "event_timestamp",
    "bronze_logs": "event_timestamp",
    "bronze_traces": "event_timestamp",
    "bronze_network_flows": "event_timestamp",
}

# The column with the time of the run; every other silver and gold table has computed_at.
STAMP: dict[str, str | None] = {
    "silver_incidents": "enriched_at",
    "silver_alerts": "enriched_at",
    "silver_changes": "enriched_at",
    "silver_servicenow_correlation": None,
}

# table -> (builder, names of the tables it reads); order is the order of writing.
SILVER: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "silver_incident_changes": (silver.incident_changes, ("bronze_incidents", "bronze_topology_changes")),
    "silver_incidents": (silver.silver_incidents, ("bronze_incidents", "bronze_alerts", "bronze_topology_changes")),
    "silver_alerts": (silver.silver_alerts, ("bronze_alerts", "bronze_incidents")),
    "silver_changes": (silver.silver_changes, ("bronze_topology_changes", "bronze_incidents")),
    "silver_service_health": (silver.silver_service_health, ("bronze_metrics", "bronze_incidents", "bronze_logs")),
    "silver_business_impact": (silver.silver_business_impact, ("bronze_incidents",)),
    "silver_servicenow_correlation": (silver.silver_servicenow_correlation, ("bronze_incidents",)),
}
GOLD: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "gold_root_cause_patterns": (gold.root_cause_patterns, ("silver_incidents",)),
    "gold_service_risk_ranking": (
        gold.service_risk_ranking,
        ("silver_incidents", "silver_service_health", "silver_changes"),
    ),
    "gold_change_incident_correlation": (gold.change_incident_correlation, ("silver_changes", "silver_incidents")),
    "gold_domain_impact_summary": (gold.domain_impact_summary, ("silver_incidents", "silver_alerts", "silver_changes")),
    "gold_business_impact_summary": (gold.business_impact_summary, ("silver_incidents",)),
}

# Built where the configuration tables are given: profiles of the services, rates of the business units.
CONFIGURED: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "silver_revenue_impact": (impact.revenue_impact, ("bronze_incidents", "config_impact_models")),
    "gold_service_relationships": (impact.service_relationships, ("config_service_profiles",)),
    "gold_dependency_blast_radius": (impact.profile_blast_radius, ("config_service_profiles",)),
    "gold_service_profiles": (impact.enrich_services, ("gold_service_risk_ranking", "config_service_profiles")),
    "gold_business_unit_profiles": (impact.enrich_business_units, ("gold_business_impact_summary", "config_impact_models")),
}

# Builders of tables with columns that many rows share -> the rows, the shared columns by key, and the key. As part of
# the rows, lists of services grow with the square of the services.
SHARED = {gold.root_cause_patterns: gold.root_cause_parts}


def _read_by(tables: Tables, inputs: tuple[str, ...]) -> list[DataFrame]:
    return [tables[i].drop("ingested_at", "enriched_at", "computed_at", "event_date") for i in inputs]


def derive(tables: Tables, targets: dict) -> Tables:
    """The targets as plans over ``tables``, without writing anything."""
    out = dict(tables)
    for name, (build, inputs) in targets.items():
        out[name] = build(*_read_by(out, inputs))
    return out


def build_all(spark: SparkSession, bronze: Tables, folder: str, at_once: int = 4) -> Tables:
    """Write every table below ``folder`` and return them as read back. Repeating it replaces them.

    The tables of one layer do not read each other, so up to ``at_once`` of them run as concurrent
    jobs; the next layer reads what the last one wrote. All tables are written before the first one is
    committed: readers see the old build until then, and a build that fails changes nothing. ``bronze`` may hold
    the configuration tables; the tables that depend on them are then built too. Columns that many rows share are
    written once for each key and are part of every row that is read.
    """
    folder = folder.rstrip("/")
    targets = {**SILVER, **GOLD, **CONFIGURED}
    written: dict[str, Version] = {}
    done: Tables = {}

    def write(name: str, df: DataFrame, stamp: str | None, partition_by: str | None = None) -> None:
        written[name] = prepared(stamped(df, stamp), f"{folder}/{name}", partition_by)

    def land(name: str) -> None:
        df = bronze[name]
        if name in DAY_OF:
            df = df.selectExpr("*", f"to_date({DAY_OF[name]}) AS event_date").hint("rebalance", "event_date")
        write(name, df, "ingested_at", "event_date" if name in DAY_OF else None)

    def refine(name: str) -> None:
        (build, inputs), stamp = targets[name], STAMP.get(name, "computed_at")
        df = derive(done, {name: targets[name]})[name]
        if build not in SHARED:
            return write(name, df, stamp)
        rows, once, key = SHARED[build](*_read_by(done, inputs))
        write(name, rows, stamp)
        written[name] = with_shared(written[name], once, key, [*df.columns, *([stamp] if stamp else [])])

    with ThreadPoolExecutor(at_once) as pool:
        for names, make in ((list(bronze), land), (list(SILVER), refine), (list(GOLD), refine), (list(CONFIGURED), refine)):
            names = [n for n in names if n not in CONFIGURED or set(CONFIGURED[n][1]) <= set(done)]
            list(pool.map(make, names))
            done.update((n, written[n].read(spark)) for n in names)
        list(pool.map(lambda v: commit(spark, v), written.values()))
    return done
