"""Enriched tables: incidents, alerts, changes, daily service health, business impact, tickets.

Builders keep the order-free content only; the stamp of the run is added when a table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.numbers import count_if, or_zero, percent
from ..functions.times import calendar, whole_minutes
from ..operators.intervals import change_incident_matches, following_counts

HOUR = 3600
CHANGE_STRUCT = "array<struct<change_id: string, change_type: string, service: string, executed_at: timestamp>>"

# Metric names the health score and the metric window read.
CPU = "system.cpu.utilization"
MEMORY = "system.memory.utilization"
LATENCY = "http.server.request.duration"
ACTIVE = "http.server.active_requests"


# Incidents -------------------------------------------------------------------------------------


def scored_incidents(incidents: DataFrame) -> DataFrame:
    """The row-wise part of silver incidents: no join, no shuffle."""
    return incidents.select(
        "*",
        scoring.severity_level().alias("severity_level"),
        *calendar("created_at", "incident", ("date", "hour", "day_of_week", "week")),
        scoring.impact_score().alias("impact_score"),
    )


def correlated_alerts(alerts: DataFrame) -> DataFrame:
    """Per incident id: sorted distinct alert names and the number of alerts. Counted by name first, so that
    the raw rows meet fixed-width states only."""
    named = alerts.where(F.col("incident_id").isNotNull()).groupBy("incident_id", "alert_name").agg(F.count("*").alias("n"))
    return named.groupBy("incident_id").agg(
        F.sort_array(F.collect_list("alert_name")).alias("correlated_alert_types"),
        F.sum("n").alias("correlated_alert_count"),
    )


def incident_changes(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per incident and change of the two hours before it on any touched service. What only counts or
    filters such changes reads this and no list."""
    pairs = change_incident_matches(
        changes, incidents, 2 * HOUR, ["change_id", "change_type", "executed_at"], ["incident_id", "created_at"]
    )
    return pairs.select("incident_id", "change_id", "change_type", "service", "executed_at")


def change_counts(related: DataFrame) -> DataFrame:
    """Changes and types of change before each incident, out of ``incident_changes``; by type first."""
    typed = related.groupBy("incident_id", "change_type").agg(F.count("*").alias("n"))
    return typed.groupBy("incident_id").agg(F.sum("n").alias("changes"), F.count("change_type").alias("change_types"))


def preceding_changes(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Per incident id: changes of the two hours before it on any touched service, as a list."""
    change = F.struct("change_id", "change_type", "service", "executed_at")
    listed = incident_changes(incidents, changes).groupBy("incident_id")
    return listed.agg(F.sort_array(F.collect_list(change)).alias("preceding_changes"))


def silver_incidents(incidents: DataFrame, alerts: DataFrame, changes: DataFrame) -> DataFrame:
    out = scored_incidents(incidents)
    out = out.join(correlated_alerts(alerts), "incident_id", "left")
    out = out.join(preceding_changes(incidents, changes), "incident_id", "left")
    return out.withColumns(
        {
            "correlated_alert_types": F.coalesce("correlated_alert_types", F.array().cast("array<string>")),
            "correlated_alert_count": or_zero("correlated_alert_count"),
            "preceding_changes": F.coalesce("preceding_changes", F.array().cast(CHANGE_STRUCT)),
        }
    )


# Alerts ----------------------------------------------------------------------------------------


def alert_incident_flags(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Alerts with is_incident_correlated and is_pre_incident_signal.

    The signal is false without an incident id, NULL when the id is unknown. Alerts without an id
    get a private join key so that they spread over all tasks instead of meeting at NULL.
    """
    opened = incidents.groupBy(F.col("incident_id").alias("_ref")).agg(F.min("created_at").alias("_opened"))
    own = F.concat(F.lit("\u0000"), F.col("alert_id"))
    keyed = alerts.withColumn("_ref", F.coalesce("incident_id", own))
    joined = keyed.join(opened, "_ref", "left")
    early = F.when(F.col("incident_id").isNull(), False).otherwise(F.col("fired_at") < F.col("_opened"))
    return joined.select(
        *alerts.columns,
        F.col("incident_id").isNotNull().alias("is_incident_correlated"),
        early.alias("is_pre_incident_signal"),
    )


def silver_alerts(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    return alert_incident_flags(alerts, incidents).select(
        "*",
        whole_minutes("fired_at", "resolved_at").alias("duration_minutes"),
        *calendar("fired_at", "alert", ("date", "hour", "day_of_week")),
        scoring.breach_pct().alias("breach_magnitude_pct"),
    )


# Changes ---------------------------------------------------------------------------------------


def scored_changes(changes: DataFrame) -> DataFrame:
    """The row-wise part of silver changes."""
    return changes.select(
        "*",
        *calendar("executed_at", "change", ("date", "hour", "day_of_week")),
        scoring.change_risk().alias("risk_score"),
    )


def with_following_incidents(changes: DataFrame, incidents: DataFrame) -> DataFrame:
    horizons = {"incidents_within_4h": 4 * HOUR, "incidents_within_24h": 24 * HOUR}
    counts = following_counts(changes, incidents, horizons)
    out = changes.join(counts, ["service", "executed_at"], "left")
    return out.withColumns({name: or_zero(name) for name in horizons})


def silver_changes(changes: DataFrame, incidents: DataFrame) -> DataFrame:
    return with_following_incidents(scored_changes(changes), incidents)


# Service health --------------------------------------------------------------------------------


def daily_metrics(metrics: DataFrame) -> DataFrame:
    """Average, maximum and minimum per service, day and metric."""
    named = metrics.where(F.col("service_name").isNotNull())
    return named.groupBy("service_name", F.to_date("event_timestamp").alias("metric_date"), "metric_name").agg(
        F.avg("metric_value").alias("avg_value"),
        F.max("metric_value").alias("max_value"),
        F.min("metric_value").alias("min_value"),
    )


def daily_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy(
        F.col("root_service").alias("service_name"), F.to_date("created_at").alias("incident_date")
    ).agg(
        F.count("*").alias("incident_count"),
        count_if(F.col("severity") == "P1").alias("p1_count"),
        F.sum("blast_radius").alias("total_blast_radius"),
        F.avg("mttr_minutes").alias("avg_mttr"),
    )


def daily_error_logs(logs: DataFrame) -> DataFrame:
    named = logs.where(F.col("service_name").isNotNull())
    return named.groupBy("service_name", F.to_date("event_timestamp").alias("log_date")).agg(
        F.count("*").alias("total_logs"),
        count_if(F.col("severity_text").isin("ERROR", "FATAL")).alias("error_count"),
    )


def daily_vitals(metrics: DataFrame) -> DataFrame:
    """One row per service and day that has CPU points, with the three metrics side by side.

    One aggregation over the points replaces a self-join per metric. Latency points are histograms
    without a plain value, so their average and maximum stay NULL; the ratio of the histogram sums
    is given beside them.
    """
    name, value = F.col("metric_name"), F.col("metric_value")
    aggs = [F.count(F.when(name == CPU, 1)).alias("_cpu_points")]
    for metric, label in ((CPU, "cpu_pct"), (MEMORY, "memory_pct"), (LATENCY, "latency_ms")):
        # a day that is not known holds for the CPU points themselves only: nothing can be put beside them
        picked = F.when((name == metric) & ((name == CPU) | F.col("event_timestamp").isNotNull()), value)
        aggs += [F.avg(picked).alias(f"avg_{label}"), F.max(picked).alias(f"max_{label}")]
    latency = [F.sum(F.when((name == LATENCY) & F.col("event_timestamp").isNotNull(), F.col(c))) for c in ("histogram_sum", "histogram_count")]
    aggs.append((latency[0] / F.nullif(latency[1], F.lit(0))).alias("hist_avg_latency_ms"))
    wanted = metrics.where(F.col("service_name").isNotNull() & name.isin(CPU, MEMORY, LATENCY))
    daily = wanted.groupBy("service_name", F.to_date("event_timestamp").alias("health_date")).agg(*aggs)
    return daily.where("_cpu_points > 0").drop("_cpu_points")


def silver_service_health(metrics: DataFrame, incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """Composite health per service and day; only days with CPU points appear."""
    key = ["service_name", "health_date"]
    out = daily_vitals(metrics)
    out = out.join(daily_incidents(incidents).withColumnRenamed("incident_date", "health_date"), key, "left")
    out = out.join(daily_error_logs(logs).withColumnRenamed("log_date", "health_date"), key, "left")
    return out.select(
        *key,
        "avg_cpu_pct",
        "max_cpu_pct",
        "avg_memory_pct",
        "max_memory_pct",
        "avg_latency_ms",
        "max_latency_ms",
        "hist_avg_latency_ms",
        or_zero("incident_count").alias("incident_count"),
        or_zero("p1_count").alias("p1_incident_count"),
        or_zero("total_blast_radius").alias("total_blast_radius"),
        or_zero("avg_mttr").alias("avg_mttr_minutes"),
        or_zero("error_count").alias("error_log_count"),
        or_zero("total_logs").alias("total_log_count"),
        F.coalesce(percent("error_count", "total_logs", 2), F.lit(0.0)).alias("error_rate_pct"),
        scoring.health_score().alias("health_score"),
    )


# Business impact and tickets -------------------------------------------------------------------


def silver_business_impact(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "incident_id",
        "title",
        "severity",
        "root_service",
        "domain",
        "business_unit",
        "created_at",
        "resolved_at",
        "mttr_minutes",
        "revenue_impact_usd",
        "revenue_model",
        "affected_user_count",
        "productivity_loss_usd",
        "shipments_delayed",
        "sla_breached",
        "blast_radius",
        "failure_pattern_id",
        "failure_pattern_name",
        "downstream_impact_narrative",
        "root_cause_explanation",
        scoring.revenue_level().alias("revenue_impact_level"),
        scoring.weighted_downtime().alias("weighted_downtime_minutes"),
        *calendar("created_at", "impact", ("date", "week", "month", "year")),
    )


def silver_servicenow_correlation(incidents: DataFrame) -> DataFrame:
    """Duplicate share of the tickets of every incident that has any."""
    return incidents.where("servicenow_ticket_count > 0").select(
        "incident_id",
        "business_unit",
        "failure_pattern_name",
        "servicenow_ticket_count",
        "servicenow_duplicate_tickets",
        percent("servicenow_duplicate_tickets", "servicenow_ticket_count", 1).alias("duplicate_pct"),
        "affected_user_count",
        "affected_roles",
        "root_cause_explanation",
        "downstream_impact_narrative",
        "revenue_impact_usd",
        "productivity_loss_usd",
        "shipments_delayed",
        "severity",
        "root_service",
        "domain",
        "mttr_minutes",
        "created_at",
    )
