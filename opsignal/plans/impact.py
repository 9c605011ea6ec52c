"""Business impact computed from configurable rates, and service dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators.lookups import attach
from ..operators.reach import reach_sizes
from .graph import reverse_hops

# Model names and the rates used where a model row leaves one out.
SHIPMENT, PRODUCTIVITY, TRIAL, SALES, BLAST = (
    "shipment_throughput",
    "productivity_loss",
    "trial_delay",
    "lost_sales",
    "blast_multiplier",
)
DEFAULTS = {
    "shipments_per_hour": 100.0,
    "avg_order_value_usd": 12500.0,
    "affected_people": 50.0,
    "loaded_rate_per_hour_usd": 1500.0,
    "trial_delay_cost_per_day_usd": 350000.0,
    "revenue_per_hour_usd": 95000.0,
    "affected_users": 100.0,
    "blended_rate_per_hour_usd": 150.0,
}
MODEL_COLUMNS = "business_unit string, impact_type string, " + ", ".join(
    f"{c} double" for c in (*DEFAULTS, "productivity_loss_hours", "trial_delay_days")
)


def _rate(name: str):
    return F.coalesce(F.col(name), F.lit(DEFAULTS[name]))


def _impact_terms() -> dict:
    hours = F.col("mttr_minutes") / 60.0
    loss_hours = F.coalesce("productivity_loss_hours", hours)
    return {
        "hours": hours,
        "shipments": _rate("shipments_per_hour") * hours,
        "people": F.coalesce("affected_people", "affected_users", F.lit(DEFAULTS["affected_people"])),
        "loss_hours": loss_hours,
        "delay_days": F.coalesce("trial_delay_days", F.greatest(F.lit(0.25), hours / 8)),
    }


def with_models(incidents: DataFrame, models: DataFrame) -> DataFrame:
    """Incidents beside the rates of their business unit."""
    return attach(incidents, models, "business_unit")


def _loss(t: dict):
    return t["people"] * t["loss_hours"] * _rate("loaded_rate_per_hour_usd")


def _revenue(t: dict):
    kind, loss = F.col("impact_type"), _loss(t)
    revenue = (
        F.when(kind == SHIPMENT, t["shipments"] * _rate("avg_order_value_usd"))
        .when(kind == PRODUCTIVITY, loss)
        .when(kind == TRIAL, t["delay_days"] * _rate("trial_delay_cost_per_day_usd"))
        .when(kind == SALES, t["hours"] * _rate("revenue_per_hour_usd"))
        .when(kind == BLAST, _rate("affected_users") * t["hours"] * _rate("blended_rate_per_hour_usd"))
        .otherwise(0.0)
    )
    return half_up(revenue, 2)


def revenue_impact(incidents: DataFrame, models: DataFrame) -> DataFrame:
    """(incident_id, revenue_impact_usd, shipments_delayed, productivity_loss_usd) by model type."""
    t, kind = _impact_terms(), F.col("impact_type")
    own = incidents.select("incident_id", "business_unit", "mttr_minutes")
    return with_models(own, models).select(
        "incident_id",
        _revenue(t).alias("revenue_impact_usd"),
        F.when(kind == SHIPMENT, F.bround(t["shipments"].cast("decimal(28,10)"), 0).cast("bigint"))
        .otherwise(0)
        .alias("shipments_delayed"),
        half_up(F.when(kind == PRODUCTIVITY, _loss(t)).otherwise(0.0), 2).alias("productivity_loss_usd"),
    )


def impact_narrative(incidents: DataFrame, models: DataFrame) -> DataFrame:
    """(incident_id, narrative): one sentence in the terms of the model."""
    t = _impact_terms()
    kind = F.col("impact_type")

    def whole(x):
        return F.format_number(x, 0)

    def tenths(x):
        return F.format_string("%.1f", half_up(x, 1))

    def number(x):
        return F.regexp_replace(F.format_string("%.2f", half_up(x, 2)), r"\.?0+$", "")

    usd = F.concat(F.lit("$"), whole(_revenue(t)))
    text = (
        F.when(
            kind == SHIPMENT,
            F.concat(
                F.bround(t["shipments"].cast("decimal(28,10)"), 0).cast("bigint"),
                F.lit(" shipments delayed over "), tenths(t["hours"]), F.lit(" hrs x $"),
                whole(_rate("avg_order_value_usd")), F.lit(" avg order value = "), usd, F.lit(" revenue at risk"),
            ),
        )
        .when(
            kind == PRODUCTIVITY,
            F.concat(
                number(t["people"]), F.lit(" data scientists lost "), number(t["loss_hours"]),
                F.lit(" hrs productivity x $"), whole(_rate("loaded_rate_per_hour_usd")),
                F.lit("/hr loaded rate = "), usd, F.lit(" productivity loss"),
            ),
        )
        .when(
            kind == TRIAL,
            F.concat(
                number(t["delay_days"]), F.lit(" day trial delay x $"),
                whole(_rate("trial_delay_cost_per_day_usd")), F.lit("/day = "), usd, F.lit(" trial delay cost"),
            ),
        )
        .when(
            kind == SALES,
            F.concat(
                tenths(t["hours"]), F.lit(" hrs downtime x $"), whole(_rate("revenue_per_hour_usd")),
                F.lit("/hr = "), usd, F.lit(" lost sales revenue"),
            ),
        )
        .otherwise(
            F.concat(
                F.col("affected_user_count"), F.lit(" users impacted across "), F.col("blast_radius"),
                F.lit(" services for "), F.col("mttr_minutes"), F.lit(" min"),
            )
        )
    )
    own = incidents.select("incident_id", "business_unit", "mttr_minutes", "affected_user_count", "blast_radius")
    return with_models(own, models).select("incident_id", text.alias("narrative"))


def sla_flag(severity: str = "severity", minutes: str = "mttr_minutes"):
    return (F.col(severity) == "P1") & (F.col(minutes) > 30)


# Dependencies ----------------------------------------------------------------------------------


def service_relationships(profiles: DataFrame) -> DataFrame:
    """One row per (service, dependency) out of the dependency list of every service."""
    return profiles.select(
        F.col("service_name").alias("source_service"), F.explode(F.array_distinct("depends_on")).alias("target_service")
    ).select("*", F.lit("depends_on").alias("relationship_type"), F.lit(1.0).alias("weight"))


def relationship_kinds(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Relationships of all kinds, one row per (source, target, kind): dependencies of the profiles, impacts seen in
    incidents, and network flows; ``edges`` as ``graph.topology_edges`` gives them. The description tells what
    an observed relationship rests on."""
    declared = service_relationships(profiles).withColumn("description", F.lit(None).cast("string"))
    kinds = (("impacts", "incident_link_count", " incidents"), ("network_flow", "network_flow_count", " flows"))
    seen = [
        F.struct(F.lit(kind).alias("relationship_type"), F.lit(1.0).alias("weight"), F.col(n).alias("n"), F.concat(F.col(n).cast("string"), F.lit(unit)).alias("description"))
        for kind, n, unit in kinds
    ]
    observed = edges.select(F.col("src_service").alias("source_service"), F.col("dst_service").alias("target_service"), F.inline(F.array(*seen)))
    return declared.unionByName(observed.where("n > 0").drop("n"))


def dependency_blast_radius(relationships: DataFrame, max_depth: int | None = None) -> DataFrame:
    """How many services depend on each one, directly or through others; with ``max_depth`` through at most so
    many relationships."""
    if max_depth is None:
        arcs = relationships.select(F.col("target_service").alias("a"), F.col("source_service").alias("b"))
        return reach_sizes(arcs).where("n > 0").select(F.col("node").alias("service_name"), F.col("n").alias("blast_radius"))
    targets = relationships.select(F.col("target_service").alias("seed")).distinct()
    reach = reverse_hops(relationships, targets, max_depth).where("seed <> node")
    return reach.groupBy(F.col("seed").alias("service_name")).agg(F.count("*").alias("blast_radius"))


def profile_blast_radius(profiles: DataFrame) -> DataFrame:
    """Blast radius by the dependency lists of the service profiles."""
    return dependency_blast_radius(service_relationships(profiles))


def enrich_services(ranking: DataFrame, profiles: DataFrame) -> DataFrame:
    """Service ranking with tier, domain and business unit of the service profile."""
    extra = profiles.select("service_name", "tier", F.col("domain").alias("profile_domain"), F.col("business_unit").alias("profile_business_unit"))
    return ranking.join(extra, "service_name", "left")


def enrich_business_units(units: DataFrame, models: DataFrame) -> DataFrame:
    """Business-unit totals with the model type and rates of the unit."""
    return units.join(models, "business_unit", "left")
