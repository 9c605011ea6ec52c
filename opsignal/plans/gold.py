"""Aggregated tables: failure patterns, service risk, change correlation, domains, business units.

``incidents`` is any frame with the incident columns plus ``impact_score``; the array columns of
silver incidents are not needed, so callers may pass the join-free form.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.numbers import count_if, half_up, or_zero, percent
from ..functions.times import whole_minutes
from ..operators.intervals import change_incident_matches
from ..operators.lookups import attach
from ..operators.ordering import earliest, row_numbers
from ..session import stored


def _severity_counts(*levels: str):
    return [count_if(F.col("severity") == level).alias(f"{level.lower()}_count") for level in levels]


def _set_of(column: str):
    return F.sort_array(F.collect_set(column))


# Failure patterns ------------------------------------------------------------------------------

PATTERN_GRAIN = ["failure_pattern_id", "failure_pattern_name", "root_service", "domain"]


def _with_pattern(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("failure_pattern_id").isNotNull())


def impacted_services_by_pattern(incidents: DataFrame) -> DataFrame:
    """Distinct services first, spread over all tasks, then the list."""
    listed = _with_pattern(incidents).select("failure_pattern_id", F.explode("impacted_services").alias("svc"))
    return listed.distinct().groupBy("failure_pattern_id").agg(
        # not collect_set, before which Spark would take the distinct away
        F.sort_array(F.collect_list("svc")).alias("all_impacted_services")
    )


def pattern_stats(incidents: DataFrame) -> DataFrame:
    """In two steps: by minutes and texts with fixed-width states, then percentiles and texts over those rows."""
    totals = {
        "revenue_impact_usd": "total_revenue_impact",
        "affected_user_count": "total_affected_users",
        "servicenow_ticket_count": "total_servicenow_tickets",
        "servicenow_duplicate_tickets": "total_duplicate_tickets",
    }
    texts = ("business_unit", "revenue_model", "root_cause_explanation")
    fine = _partials(
        _with_pattern(incidents),
        [*PATTERN_GRAIN, "mttr_minutes", *texts],
        ("blast_radius", "revenue_impact_usd", "affected_user_count"),
        ("servicenow_ticket_count", "servicenow_duplicate_tickets"),
        most=("created_at", "blast_radius"),
    )
    minutes = F.expr("try_divide(sum(mttr_minutes * n), sum(if(mttr_minutes IS NULL, 0, n)))")
    return fine.groupBy(*PATTERN_GRAIN).agg(
        *[earliest(c, "first_at", c).alias(c) for c in texts],
        F.sum("n").alias("occurrence_count"),
        minutes.alias("avg_mttr_minutes"),
        F.max("mttr_minutes").alias("max_mttr_minutes"),
        F.min("mttr_minutes").alias("min_mttr_minutes"),
        F.percentile("mttr_minutes", 0.5, F.col("n")).alias("p50_mttr_minutes"),
        F.percentile("mttr_minutes", 0.95, F.col("n")).alias("p95_mttr_minutes"),
        _mean("blast_radius").alias("avg_blast_radius"),
        F.max("blast_radius_max").alias("max_blast_radius"),
        *[F.sum(f"{c}_sum").alias(name) for c, name in totals.items()],
        _mean("revenue_impact_usd").alias("avg_revenue_impact"),
        _mean("affected_user_count").alias("avg_affected_users"),
        *[F.sum(c).alias(c) for c in ("p1_count", "p2_count", "p3_count")],
        F.sum("sla").alias("sla_breach_count"),
        F.min("first_at").alias("first_occurrence"),
        F.max("created_at_max").alias("last_occurrence"),
        # the root service is part of the grain, so its set has one member (none for NULL)
        F.when(F.col("root_service").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("root_service"))
        .alias("affected_root_services"),
    )


def weekly_trend(incidents: DataFrame) -> DataFrame:
    return _with_pattern(incidents).groupBy(
        "failure_pattern_id",
        F.weekofyear("created_at").alias("week_num"),
        F.year("created_at").alias("year_num"),
    ).agg(F.count("*").alias("weekly_count"))


def trend_summary(incidents: DataFrame) -> DataFrame:
    """Mean weekly count of the newest weeks and of those before, over weeks that have incidents.

    Weeks are numbered year*52 + ISO week; the ranges share the week four before the newest.
    """

    def index(year, week):
        return year * 52 + week

    newest = (
        _with_pattern(incidents)
        .agg(F.max(index(F.year("created_at"), F.weekofyear("created_at"))))
        .scalar()
    )
    weeks = weekly_trend(incidents).withColumn("_age", newest - index(F.col("year_num"), F.col("week_num")))
    return weeks.groupBy("failure_pattern_id").agg(
        F.avg(F.when(F.col("_age") <= 4, F.col("weekly_count"))).alias("recent_avg"),
        F.avg(F.when(F.col("_age").between(4, 8), F.col("weekly_count"))).alias("previous_avg"),
    )


def days_between_occurrences():
    gap = F.date_diff("last_occurrence", "first_occurrence") / (F.col("occurrence_count") - 1.0)
    return F.when(F.col("occurrence_count") > 1, half_up(gap, 1))


def plain_patterns(incidents: DataFrame) -> DataFrame:
    """Failure patterns without the list of all impacted services: what ranks and filters read."""
    out = pattern_stats(incidents).join(trend_summary(incidents), "failure_pattern_id", "left")
    out = out.withColumn("trend_direction", scoring.trend_direction())
    return out.withColumns(
        {
            "recent_weekly_avg": half_up("recent_avg", 2),
            "previous_weekly_avg": half_up("previous_avg", 2),
            "priority_score": scoring.priority_score(),
            "avg_days_between_occurrences": days_between_occurrences(),
        }
    ).drop("recent_avg", "previous_avg")


def root_cause_patterns(incidents: DataFrame, shown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Failure patterns, each row with all services that its pattern impacts. ``shown`` puts the lists into another
    form: once for each pattern, not for each of its rows."""
    rows, lists, key = root_cause_parts(incidents)
    # last, so that the lists are copied once and not carried through the other join
    return rows.join(shown(lists) if shown else lists, key, "left")


def root_cause_parts(incidents: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The two sides of ``root_cause_patterns`` and the key that joins them."""
    return plain_patterns(incidents), impacted_services_by_pattern(incidents), "failure_pattern_id"


def with_impacted_services(chosen: DataFrame, incidents: DataFrame) -> DataFrame:
    """A few chosen patterns with their lists, gathered from the incidents of these patterns only."""
    own = incidents.join(chosen.select("failure_pattern_id").distinct(), "failure_pattern_id", "left_semi")
    return chosen.join(impacted_services_by_pattern(own), "failure_pattern_id", "left")


# Service risk ----------------------------------------------------------------------------------


def _mean(name: str):
    """Mean from the partial sum and count that ``_partials`` leaves behind."""
    return F.expr(f"try_divide(sum({name}_sum), sum({name}_n))")


def _partials(
    incidents: DataFrame, keys: list[str], means: tuple[str, ...], sums: tuple[str, ...], most: tuple[str, ...] = ()
) -> DataFrame:
    """First of two aggregation steps, by fine keys, with fixed-width states only.

    Text states such as "value of the earliest row" would make Spark sort the raw rows; over the far
    fewer rows of this step they cost nothing.
    """
    return incidents.groupBy(*keys).agg(
        F.min("created_at").alias("first_at"),
        F.count("*").alias("n"),
        *_severity_counts("P1", "P2", "P3"),
        count_if(F.col("sla_breached")).alias("sla"),
        *[f(c).alias(f"{c}_{tag}") for c in means for f, tag in ((F.sum, "sum"), (F.count, "n"))],
        *[F.sum(c).alias(f"{c}_sum") for c in sums],
        *[F.max(c).alias(f"{c}_max") for c in most],
    )


def incident_stats(incidents: DataFrame) -> DataFrame:
    fine = _partials(
        incidents,
        ["root_service", "business_unit", "failure_pattern_id"],
        ("mttr_minutes", "blast_radius", "impact_score"),
        ("revenue_impact_usd", "affected_user_count"),
    )
    return fine.groupBy(F.col("root_service").alias("service_name")).agg(
        earliest("business_unit", "first_at", "business_unit").alias("business_unit"),
        F.sum("n").alias("incident_count"),
        *[F.sum(c).alias(c) for c in ("p1_count", "p2_count", "p3_count")],
        _mean("mttr_minutes").alias("avg_mttr"),
        F.sum("blast_radius_sum").alias("total_blast_radius"),
        _mean("blast_radius").alias("avg_blast_radius"),
        F.sum("revenue_impact_usd_sum").alias("total_revenue_impact"),
        F.sum("affected_user_count_sum").alias("total_affected_users"),
        F.sum("sla").alias("sla_breaches"),
        F.count_distinct("failure_pattern_id").alias("unique_failure_patterns"),
        _mean("impact_score").alias("avg_impact_score"),
    )


def impacted_stats(incidents: DataFrame) -> DataFrame:
    listed = incidents.select(F.explode("impacted_services").alias("service_name"))
    return listed.groupBy("service_name").agg(F.count("*").alias("times_impacted"))


def health_stats(health: DataFrame) -> DataFrame:
    return health.groupBy("service_name").agg(
        F.avg("health_score").alias("avg_health_score"),
        F.min("health_score").alias("min_health_score"),
        F.avg("error_rate_pct").alias("avg_error_rate"),
        F.avg("avg_cpu_pct").alias("avg_cpu"),
    )


def change_stats(changes: DataFrame) -> DataFrame:
    return changes.groupBy("service").agg(
        F.count("*").alias("total_changes"),
        F.sum("incidents_within_4h").alias("changes_followed_by_incidents"),
    )


def by_key(key: list[str], **parts: DataFrame) -> DataFrame:
    """One row per key out of tables that have one row per key and no other column in common, and ``sources``,
    the tables it came from. A key with a missing part is kept apart per table, as no equality ever matches it."""
    tagged = [df.withColumn("_source", F.lit(name)) for name, df in parts.items()]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    rows = rows.withColumn("_apart", F.when(missing, F.col("_source")))
    values = [c for c in rows.columns if c not in (*key, "_source", "_apart")]
    return rows.groupBy(*key, "_apart").agg(
        *[F.max(c).alias(c) for c in values], F.collect_set("_source").alias("sources")
    ).drop("_apart")


def service_risk(incidents: DataFrame, health: DataFrame, changes: DataFrame) -> DataFrame:
    """Every service that caused, suffered or reported anything, with its risk score but no rank.

    Change figures attach to services that are root or impacted somewhere, not to those known from
    health alone.
    """
    merged = by_key(
        ["service_name"],
        root=incident_stats(incidents),
        hit=impacted_stats(incidents),
        health=health_stats(health),
        change=change_stats(changes).withColumnRenamed("service", "service_name"),
    )
    involved = F.array_contains("sources", "root") | F.array_contains("sources", "hit")
    merged = merged.where(involved | F.array_contains("sources", "health"))
    for c in ("total_changes", "changes_followed_by_incidents"):
        merged = merged.withColumn(c, F.when(involved, F.col(c)))
    out = merged.select(
        "service_name",
        F.coalesce("business_unit", F.lit("shared-infrastructure")).alias("business_unit"),
        or_zero("incident_count").alias("incident_count_as_root"),
        or_zero("times_impacted").alias("times_impacted_by_others"),
        *[or_zero(c).alias(c) for c in ("p1_count", "p2_count", "p3_count")],
        or_zero("avg_mttr").alias("avg_mttr_minutes"),
        *[
            or_zero(c).alias(c)
            for c in (
                "total_blast_radius",
                "avg_blast_radius",
                "total_revenue_impact",
                "total_affected_users",
                "sla_breaches",
                "unique_failure_patterns",
            )
        ],
        F.coalesce("avg_health_score", F.lit(100.0)).alias("avg_health_score"),
        F.coalesce("min_health_score", F.lit(100.0)).alias("min_health_score"),
        or_zero("avg_error_rate").alias("avg_error_rate"),
        or_zero("avg_cpu").alias("avg_cpu_utilization"),
        or_zero("total_changes").alias("total_changes"),
        or_zero("changes_followed_by_incidents").alias("risky_changes"),
    )
    return out.withColumn("risk_score", scoring.risk_score())


def with_risk_rank(services: DataFrame) -> DataFrame:
    """Rank by the shorter score, highest first; equal scores go by name."""
    return row_numbers(services, "risk_rank", [-scoring.rank_basis(), F.col("service_name")], "service_name")


def service_risk_ranking(incidents: DataFrame, health: DataFrame, changes: DataFrame) -> DataFrame:
    return with_risk_rank(service_risk(incidents, health, changes))


# Change to incident correlation ----------------------------------------------------------------


def change_incident_pairs(changes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Each change with each incident on a touched service within the next 24 hours."""
    pairs = change_incident_matches(
        changes,
        incidents,
        24 * 3600,
        ["change_id", "change_type", "risk_level", "risk_score", "executed_at", "executed_by"],
        [
            "incident_id",
            "severity",
            "title",
            "root_service",
            "business_unit",
            "created_at",
            "mttr_minutes",
            "blast_radius",
            "revenue_impact_usd",
            "failure_pattern_id",
        ],
    )
    pairs = pairs.withColumn("minutes_between", whole_minutes("executed_at", "created_at"))
    return pairs.select(
        "change_id",
        F.col("service").alias("change_service"),
        "change_type",
        "risk_level",
        "risk_score",
        F.col("executed_at").alias("change_time"),
        "executed_by",
        "incident_id",
        F.col("severity").alias("incident_severity"),
        F.col("title").alias("incident_title"),
        F.col("root_service").alias("incident_root_service"),
        "business_unit",
        F.col("created_at").alias("incident_time"),
        "mttr_minutes",
        "blast_radius",
        "revenue_impact_usd",
        "failure_pattern_id",
        "minutes_between",
        scoring.correlation_window().alias("correlation_window"),
    )


def change_type_stats(pairs: DataFrame) -> DataFrame:
    changes, incidents = F.count_distinct("change_id"), F.count_distinct("incident_id")
    return pairs.groupBy("change_type").agg(
        changes.alias("total_changes"),
        incidents.alias("incidents_caused"),
        percent(incidents, changes, 2).alias("incident_rate_pct"),
        F.avg("minutes_between").alias("avg_time_to_incident"),
        F.sum("revenue_impact_usd").alias("total_impact_usd"),
        F.sum("blast_radius").alias("total_blast_radius"),
    )


def change_incident_correlation(changes: DataFrame, incidents: DataFrame) -> DataFrame:
    # the most expensive join of the build: once, for the rates and for the result
    pairs = stored(change_incident_pairs(changes, incidents), "pairs")
    rates = change_type_stats(pairs).select(
        "change_type",
        F.col("incident_rate_pct").alias("change_type_incident_rate"),
        F.col("total_changes").alias("change_type_total_count"),
    )
    scored = pairs.withColumn("correlation_strength", scoring.correlation_strength())
    return attach(scored, rates, "change_type")


# Domains ---------------------------------------------------------------------------------------


def domain_incidents_daily(incidents: DataFrame) -> DataFrame:
    """In two steps, so that the sets are made of distinct services and patterns, not of raw rows."""
    fine = _partials(
        incidents.withColumn("incident_date", F.to_date("created_at")),
        ["domain", "incident_date", "root_service", "failure_pattern_id"],
        ("mttr_minutes",),
        ("blast_radius", "revenue_impact_usd", "affected_user_count"),
    )
    return fine.groupBy("domain", "incident_date").agg(
        F.sum("n").alias("incident_count"),
        *[F.sum(c).alias(c) for c in ("p1_count", "p2_count", "p3_count")],
        _mean("mttr_minutes").alias("avg_mttr"),
        F.sum("blast_radius_sum").alias("total_blast_radius"),
        F.sum("revenue_impact_usd_sum").alias("total_revenue_impact"),
        F.sum("affected_user_count_sum").alias("total_affected_users"),
        F.sum("sla").alias("sla_breaches"),
        _set_of("root_service").alias("affected_services"),
        _set_of("failure_pattern_id").alias("failure_patterns"),
    ).select(
        "*",
        F.month("incident_date").alias("incident_month"),
        F.year("incident_date").alias("incident_year"),
    )


def domain_alerts_daily(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("domain", F.to_date("fired_at").alias("alert_date")).agg(
        F.count("*").alias("alert_count"),
        count_if(F.col("severity") == "critical").alias("critical_alert_count"),
        count_if(F.col("is_pre_incident_signal")).alias("pre_incident_signals"),
    )


def domain_changes_daily(changes: DataFrame) -> DataFrame:
    return changes.groupBy("domain", F.to_date("executed_at").alias("change_date")).agg(
        F.count("*").alias("change_count"),
        count_if(F.col("risk_level") == "high").alias("high_risk_changes"),
        F.sum("incidents_within_4h").alias("changes_causing_incidents"),
    )


def domain_impact_summary(incidents: DataFrame, alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Domain by day, whichever of the three sources has rows."""
    key = ["domain", "summary_date"]
    daily = domain_incidents_daily(incidents).drop("affected_services", "failure_patterns")
    out = by_key(
        key,
        incident=daily.withColumnRenamed("incident_date", "summary_date"),
        alert=domain_alerts_daily(alerts).withColumnRenamed("alert_date", "summary_date"),
        change=domain_changes_daily(changes).withColumnRenamed("change_date", "summary_date"),
    )
    measures = (
        "total_blast_radius",
        "total_revenue_impact",
        "total_affected_users",
        "sla_breaches",
        "alert_count",
        "critical_alert_count",
        "pre_incident_signals",
        "change_count",
        "high_risk_changes",
        "changes_causing_incidents",
    )
    out = out.select(
        *key,
        F.month("summary_date").alias("summary_month"),
        F.year("summary_date").alias("summary_year"),
        or_zero("incident_count").alias("incident_count"),
        *[or_zero(c).alias(c) for c in ("p1_count", "p2_count", "p3_count")],
        or_zero("avg_mttr").alias("avg_mttr_minutes"),
        *[or_zero(c).alias(c) for c in measures],
    )
    return out.withColumn("domain_risk_score", scoring.domain_risk_score())


# Business units --------------------------------------------------------------------------------


def business_impact_summary(incidents: DataFrame) -> DataFrame:
    totals = {
        "affected_user_count": "total_affected_users",
        "productivity_loss_usd": "total_productivity_loss",
        "shipments_delayed": "total_shipments_delayed",
        "servicenow_ticket_count": "total_servicenow_tickets",
        "servicenow_duplicate_tickets": "total_duplicate_tickets",
    }
    fine = _partials(
        incidents,
        ["business_unit", "revenue_model", "failure_pattern_id", "root_service"],
        ("mttr_minutes", "blast_radius"),
        ("revenue_impact_usd", *totals),
    )
    tickets, duplicates = F.sum("servicenow_ticket_count_sum"), F.sum("servicenow_duplicate_tickets_sum")
    return fine.groupBy("business_unit").agg(
        F.sum("n").alias("total_incidents"),
        *[F.sum(c).alias(c) for c in ("p1_count", "p2_count")],
        half_up(_mean("mttr_minutes"), 1).alias("avg_mttr_minutes"),
        half_up(F.sum("revenue_impact_usd_sum"), 2).alias("total_revenue_impact"),
        earliest("revenue_model", "first_at", "revenue_model").alias("primary_revenue_model"),
        *[F.sum(f"{c}_sum").alias(name) for c, name in totals.items()],
        percent(duplicates, tickets, 1).alias("overall_duplicate_pct"),
        half_up(_mean("blast_radius"), 1).alias("avg_blast_radius"),
        F.sum("sla").alias("sla_breaches"),
        F.count_distinct("failure_pattern_id").alias("unique_failure_patterns"),
        F.count_distinct("root_service").alias("affected_services_count"),
    )
