"""Analytical queries over the silver and gold tables.

Windows of N days count back from the newest row of the table. Parameters enter as literals, never
as SQL text. Sorted results end with a unique column, so a limit always keeps the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.numbers import count_if, half_up, or_zero, percent
from ..functions.times import recent
from ..operators.intervals import MICROS, following, per_service, preceding_by_type
from ..session import stored
from .gold import change_incident_pairs, with_impacted_services
from .silver import ACTIVE, CPU, LATENCY, MEMORY


def _rounded(agg, column: str, digits: int, name: str):
    return half_up(agg(column), digits).alias(name)


def _p(level: str):
    return count_if(F.col("severity") == level).alias(f"{level.lower()}_count")


def _newest(df: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(ts), key).limit(limit)


# Incidents -------------------------------------------------------------------------------------

INCIDENT_LIST = [
    "incident_id",
    "title",
    "description",
    "severity",
    "severity_level",
    "status",
    "created_at",
    "resolved_at",
    "mttr_minutes",
    "root_service",
    "impacted_services",
    "blast_radius",
    "domain",
    "failure_pattern_id",
    "failure_pattern_name",
    "revenue_impact_usd",
    "affected_user_count",
    "sla_breached",
    "correlated_alert_count",
    "impact_score",
]
INCIDENT_DETAIL = INCIDENT_LIST + [
    "environment",
    "region",
    "business_unit",
    "affected_roles",
    "productivity_loss_hours",
    "productivity_loss_usd",
    "shipments_delayed",
    "servicenow_ticket_count",
    "servicenow_duplicate_tickets",
    "downstream_impact_narrative",
    "root_cause_explanation",
    "revenue_model",
]


def incident_summary(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        F.count("*").alias("total_incidents"),
        *[_p(level) for level in ("P1", "P2", "P3")],
        _rounded(F.avg, "mttr_minutes", 1, "avg_mttr"),
        _rounded(F.sum, "revenue_impact_usd", 2, "total_revenue_impact"),
        F.sum("affected_user_count").alias("total_user_impact"),
        count_if(F.col("sla_breached")).alias("total_sla_breaches"),
        _rounded(F.avg, "blast_radius", 1, "avg_blast_radius"),
    )


def ticket_noise(tickets: DataFrame, incidents: DataFrame, days: int = 90, limit: int = 10) -> DataFrame:
    """Services with the most duplicate tickets; the window is anchored at the newest incident."""
    total, duplicates = F.sum("servicenow_ticket_count"), F.sum("servicenow_duplicate_tickets")
    per_service = recent(tickets, "created_at", days, anchor=incidents).groupBy(
        F.col("root_service").alias("service_name")
    ).agg(
        F.count_distinct("incident_id").alias("incident_count"),
        total.alias("total_tickets"),
        duplicates.alias("total_duplicates"),
        percent(duplicates, total, 1).alias("duplicate_pct"),
        _rounded(F.sum, "revenue_impact_usd", 2, "total_revenue_impact"),
    )
    order = [F.desc("total_duplicates"), F.desc("duplicate_pct"), "service_name"]
    return per_service.where("total_tickets > 0").orderBy(*order).limit(limit)


def incident_timeline(
    incidents: DataFrame, days: int = 90, severity: str | None = None, domain: str | None = None
) -> DataFrame:
    rows = recent(incidents, "created_at", days)
    for name, value in (("severity", severity), ("domain", domain)):
        if value:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows.groupBy(F.to_date("created_at").alias("incident_date")).agg(
        F.count("*").alias("incident_count"),
        *[_p(level) for level in ("P1", "P2", "P3")],
        _rounded(F.sum, "revenue_impact_usd", 2, "daily_revenue_impact"),
        F.sum("affected_user_count").alias("daily_user_impact"),
        _rounded(F.avg, "mttr_minutes", 1, "avg_mttr"),
    ).orderBy("incident_date")


def recent_incidents(incidents: DataFrame, limit: int = 20) -> DataFrame:
    return _newest(incidents.select(*INCIDENT_LIST), "created_at", "incident_id", limit)


def incidents_by_service(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("root_service", "domain").agg(
        F.count("*").alias("incident_count"),
        _p("P1"),
        _rounded(F.avg, "mttr_minutes", 1, "avg_mttr"),
        _rounded(F.avg, "blast_radius", 1, "avg_blast_radius"),
        _rounded(F.sum, "revenue_impact_usd", 2, "total_revenue_impact"),
        F.sum("affected_user_count").alias("total_user_impact"),
    ).orderBy(F.desc("incident_count"), "root_service", "domain")


def incidents_by_hour(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("incident_hour").agg(
        F.count("*").alias("incident_count"), _p("P1"), _rounded(F.avg, "mttr_minutes", 1, "avg_mttr")
    ).orderBy("incident_hour")


def mttr_trend(incidents: DataFrame, days: int = 90) -> DataFrame:
    """By ISO week number alone, so the same week of two years shares a row."""
    return recent(incidents, "created_at", days).groupBy(F.weekofyear("created_at").alias("week_num")).agg(
        F.min(F.to_date("created_at")).alias("week_start"),
        _rounded(F.avg, "mttr_minutes", 1, "avg_mttr"),
        half_up(F.percentile("mttr_minutes", 0.5), 1).alias("p50_mttr"),
        half_up(F.percentile("mttr_minutes", 0.95), 1).alias("p95_mttr"),
        F.count("*").alias("incident_count"),
    ).orderBy("week_num")


def incident_detail(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.where(F.col("incident_id") == F.lit(incident_id)).select(*INCIDENT_DETAIL).limit(1)


# Failure patterns ------------------------------------------------------------------------------

PATTERN_KEY = ["failure_pattern_id", "failure_pattern_name", "root_service", "domain"]


def _pattern_order(first: str):
    return [F.desc(first), *PATTERN_KEY]


def patterns_by_priority(patterns: DataFrame) -> DataFrame:
    return patterns.select(
        "failure_pattern_id",
        "failure_pattern_name",
        "root_service",
        "domain",
        "occurrence_count",
        "avg_mttr_minutes",
        "p50_mttr_minutes",
        "p95_mttr_minutes",
        "avg_blast_radius",
        "max_blast_radius",
        "total_revenue_impact",
        "avg_revenue_impact",
        F.col("total_affected_users").alias("total_user_impact"),
        F.col("avg_affected_users").alias("avg_user_impact"),
        "p1_count",
        "p2_count",
        "p3_count",
        "sla_breach_count",
        "first_occurrence",
        "last_occurrence",
        "trend_direction",
        "recent_weekly_avg",
        "previous_weekly_avg",
        "priority_score",
        "avg_days_between_occurrences",
        "root_cause_explanation",
    ).orderBy(*_pattern_order("priority_score"))


def _first_patterns(patterns: DataFrame, incidents: DataFrame, first: str, limit: int) -> DataFrame:
    """The first patterns with their impacted services: ranked without the lists, which only the chosen get."""
    chosen = stored(patterns.drop("all_impacted_services").orderBy(*_pattern_order(first)).limit(limit), "patterns")
    return with_impacted_services(chosen, incidents)


def top_systemic_issue(patterns: DataFrame, incidents: DataFrame) -> DataFrame:
    return _first_patterns(patterns, incidents, "priority_score", 1)


def pattern_timeline(incidents: DataFrame, pattern_id: str) -> DataFrame:
    return incidents.where(F.col("failure_pattern_id") == F.lit(pattern_id)).select(
        "incident_id",
        "title",
        "severity",
        "created_at",
        "resolved_at",
        "mttr_minutes",
        "root_service",
        "blast_radius",
        "revenue_impact_usd",
        "affected_user_count",
        "sla_breached",
    ).orderBy(F.desc("created_at"), "incident_id")


def pattern_signals(incidents: DataFrame, alerts: DataFrame, pattern_id: str) -> tuple[DataFrame, DataFrame]:
    """(newest 50 alerts tied to incidents of the pattern, those incidents)."""
    own = incidents.where(F.col("failure_pattern_id") == F.lit(pattern_id)).select(
        "incident_id", "created_at", "root_service"
    )
    tied = alerts.join(own.select("incident_id"), "incident_id", "left_semi").select(
        "alert_id",
        "incident_id",
        "service",
        "alert_name",
        "severity",
        "fired_at",
        "resolved_at",
        "threshold_value",
        "actual_value",
        "is_pre_incident_signal",
        "breach_magnitude_pct",
    )
    return _newest(tied, "fired_at", "alert_id", 50), own


CONTEXT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# Columns of a pattern that the report prints.
REPORT_PATTERN = [
    "failure_pattern_name",
    "root_service",
    "domain",
    "occurrence_count",
    "trend_direction",
    "total_revenue_impact",
    "total_affected_users",
    "avg_mttr_minutes",
    "p1_count",
    "sla_breach_count",
    "avg_days_between_occurrences",
]


def _top_patterns(patterns: DataFrame, pattern_id: str | None, n: int) -> DataFrame:
    if pattern_id:
        return patterns.where(F.col("failure_pattern_id") == F.lit(pattern_id))
    return patterns.orderBy(*_pattern_order("priority_score")).limit(n)


def _top_services(services: DataFrame, n: int) -> DataFrame:
    return services.orderBy(F.desc("risk_score"), "service_name").limit(n)


def analysis_context(
    patterns: DataFrame, services: DataFrame, pattern_id: str | None = None, incidents: DataFrame | None = None
) -> DataFrame:
    """One row whose ``context`` is a JSON document: the top patterns, whole rows, and the ten riskiest services.

    With ``incidents`` the patterns are chosen without their lists of services, which are gathered for the chosen only.
    """
    if incidents is None:
        top = _top_patterns(patterns, pattern_id, 5)
    else:
        top = stored(_top_patterns(patterns.drop("all_impacted_services"), pattern_id, 5), "patterns")
        top = with_impacted_services(top, incidents)
    chosen = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("priority_score")).alias("_o"), *top.columns))).alias("a"))
    risky = _top_services(services, 10).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-F.col("risk_score")).alias("_o"),
                    "service_name",
                    "risk_score",
                    "incident_count_as_root",
                    "total_revenue_impact",
                    F.col("total_affected_users").alias("total_user_impact"),
                    "avg_mttr_minutes",
                    "unique_failure_patterns",
                )
            )
        ).alias("a")
    )

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.transform("a", lambda s: s.dropFields("_o")).alias("a"))

    doc = F.struct(
        F.col("a").alias("top_failure_patterns"),
        plain(risky).scalar().alias("highest_risk_services"),
    )
    return plain(chosen).select(F.to_json(doc, {"timestampFormat": CONTEXT_TIME}).alias("context"))


def _report_lines() -> str:
    """SQL for the array of (section, place, line) over ``a`` (patterns), ``b`` (services), ``how_many``."""

    def money(x: str) -> str:
        return f"'$', format_number(coalesce({x}.total_revenue_impact, 0), 0)"

    def score(x: str) -> str:
        """Two decimals, the last one only if it is not zero."""
        return f"regexp_replace(format_string('%.2f', {x}), '0$', '')"

    def name(x: str) -> str:
        return f"coalesce({x}.failure_pattern_name, 'Unknown Pattern')"

    def root(x: str) -> str:
        return f"coalesce({x}.root_service, 'unknown')"

    def line(section: int, place: str, *parts: str) -> str:
        return f"named_struct('section', {section}, 'place', cast({place} AS int), 'line', concat({', '.join(parts)}))"

    first = "get(a, 0).p"
    summary = line(
        1, "1", "'Analysis of '", "how_many", "' recurring failure patterns reveals systemic reliability issues centered on **'",
        root(first), "'** in the **'", f"coalesce({first}.domain, 'unknown')", "'** domain. The top pattern has occurred **'",
        f"coalesce({first}.occurrence_count, 0)", "' times** with a total revenue impact of **'", money(first), "'**.'",
    )
    facts = [
        ("'**'", name(first), "'**'"),
        ("'- Root Service: `'", root(first), "'`'"),
        ("'- Occurrences: '", f"coalesce({first}.occurrence_count, 0)"),
        ("'- Trend: '", f"coalesce({first}.trend_direction, 'unknown')"),
        ("'- Average MTTR: '", f"coalesce(cast({first}.avg_mttr_minutes AS string), '0')", "' minutes'"),
        ("'- P1 incidents: '", f"coalesce({first}.p1_count, 0)"),
        ("'- SLA breaches: '", f"coalesce({first}.sla_breach_count, 0)"),
        ("'- Total user impact: '", f"coalesce({first}.total_affected_users, 0)", "' users affected'"),
        ("'- Recurrence interval: every '", f"coalesce(cast({first}.avg_days_between_occurrences AS string), 'N/A')", "' days'"),
    ]
    # The headings of the report.
    headings = ["Executive Summary", "Top Systemic Issue", "Remediation Roadmap", "Highest Risk Services"]
    titles = [line(i, "0", f"'## {h}'") for i, h in enumerate(headings, 1)]
    head = [titles[0], summary, titles[1], *[line(2, str(i), *parts) for i, parts in enumerate(facts, 1)], titles[2]]
    fix = line(
        3, "i + 1", "i + 1", "'. **Fix '", name("e.p"), "'** (Priority Score: '", score("coalesce(e.p.priority_score, 0D)"), "') - Affecting `'",
        root("e.p"), "'`, '", "coalesce(e.p.occurrence_count, 0)", "' occurrences, '", money("e.p"), "' impact'",
    )
    risk = line(
        4, "i + 1", "'- **'", "coalesce(e.p.service_name, 'N/A')", "'**: Risk Score '", score("coalesce(e.p.risk_score, 0D)"), "', '",
        "coalesce(e.p.incident_count_as_root, 0)", "' incidents as root cause, '", money("e.p"), "' revenue impact'",
    )
    nothing = line(1, "1", "'No failure patterns detected in the analysis period.'")
    found = f"concat(array({', '.join(head)}), transform(a, (e, i) -> {fix}), "
    found += f"filter(array({titles[3]}), x -> size(b) > 0), transform(b, (e, i) -> {risk}))"
    return f"CASE WHEN size(a) = 0 THEN array({nothing}) ELSE {found} END"


def rule_based_report(patterns: DataFrame, services: DataFrame, pattern_id: str | None = None) -> DataFrame:
    """Ranked text lines (section, place, line): summary, top issue, fixes, riskiest services.

    Five patterns and five services at most are gathered into one row; the lines come out of it.
    """

    def gathered(df: DataFrame, score: str, key: list[str], extra: list[str]) -> DataFrame:
        order = F.struct((-F.col(score)).alias("o"), *key)
        return df.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*key, score, *extra).alias("p")))).alias("a"))

    chosen = _top_patterns(patterns, pattern_id, 5)
    five = chosen.orderBy(*_pattern_order("priority_score")).limit(5) if pattern_id else chosen
    shown = [c for c in REPORT_PATTERN if c not in PATTERN_KEY]
    tops = gathered(five, "priority_score", PATTERN_KEY, shown)
    risky = gathered(_top_services(services, 5), "risk_score", ["service_name"], ["incident_count_as_root", "total_revenue_impact"])
    how_many = chosen.agg(F.count("*")).scalar() if pattern_id else F.size("a")
    one = tops.select("a", risky.scalar().alias("b"), how_many.alias("how_many"))
    return one.select(F.inline(F.expr(_report_lines()))).orderBy("section", "place")


# Services --------------------------------------------------------------------------------------


def risk_ranking(ranking: DataFrame) -> DataFrame:
    return ranking.select(
        "service_name",
        "risk_rank",
        "risk_score",
        "incident_count_as_root",
        "times_impacted_by_others",
        "p1_count",
        "p2_count",
        "p3_count",
        "avg_mttr_minutes",
        "total_blast_radius",
        "avg_blast_radius",
        "total_revenue_impact",
        F.col("total_affected_users").alias("total_user_impact"),
        "sla_breaches",
        "unique_failure_patterns",
        "avg_health_score",
        "min_health_score",
        "avg_error_rate",
        "avg_cpu_utilization",
        "total_changes",
        "risky_changes",
    ).orderBy("risk_rank")


def health_timeline(health: DataFrame, service: str, days: int = 30, anchor: DataFrame | None = None) -> DataFrame:
    """``anchor``: where the newest health_date is read, if ``health`` is not a written table."""
    return recent(health, "health_date", days, anchor).where(F.col("service_name") == F.lit(service)).select(
        "health_date",
        "health_score",
        "avg_cpu_pct",
        "max_cpu_pct",
        "avg_memory_pct",
        "max_memory_pct",
        "avg_latency_ms",
        "max_latency_ms",
        "incident_count",
        "p1_incident_count",
        "error_log_count",
        "error_rate_pct",
    ).orderBy("health_date")


def window_parts() -> list:
    """Mergeable parts of the metric window: maxima and histogram sums of a set of points."""
    name, value = F.col("metric_name"), F.col("metric_value")
    return [
        F.max(F.when(name == CPU, value)).alias("cpu"),
        F.max(F.when(name == MEMORY, value)).alias("mem"),
        F.max(F.when(name == ACTIVE, value)).alias("act"),
        F.sum(F.when(name == LATENCY, F.col("histogram_sum"))).alias("lat_sum"),
        F.sum(F.when(name == LATENCY, F.col("histogram_count"))).alias("lat_n"),
    ]


#: How the parts of two sets of points become those of both.
MERGED = {"cpu": F.max, "mem": F.max, "act": F.max, "lat_sum": F.sum, "lat_n": F.sum}


def window_values() -> list:
    return [
        half_up("cpu", 1).alias("cpu_pct"),
        half_up("mem", 1).alias("mem_pct"),
        half_up("act", 0).alias("active_requests"),
        half_up(F.col("lat_sum") / F.nullif(F.col("lat_n"), F.lit(0)), 1).alias("avg_latency_ms"),
    ]


def hour_label(ts: str):
    return F.date_format(ts, "MM-dd HH:mm")


def metrics_window(metrics: DataFrame, service: str, start: str, end: str) -> DataFrame:
    """Hourly maxima and mean latency of one service between two instants, both included. A table laid out by
    day is read for these days only."""
    if "event_date" in metrics.columns:
        metrics = metrics.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    inside = metrics.where(
        (F.col("service_name") == F.lit(service))
        & F.col("event_timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )
    hourly = inside.groupBy(F.date_trunc("hour", "event_timestamp").alias("hour_ts")).agg(*window_parts())
    return hourly.select("hour_ts", hour_label("hour_ts").alias("hour_label"), *window_values()).orderBy("hour_ts")


def service_incidents(incidents: DataFrame, service: str, limit: int = 20) -> DataFrame:
    own = F.col("root_service") == F.lit(service)
    hit = own | F.array_contains("impacted_services", F.lit(service))
    rows = incidents.where(hit).select(
        "incident_id",
        "title",
        "severity",
        "created_at",
        "resolved_at",
        "mttr_minutes",
        "root_service",
        "blast_radius",
        "failure_pattern_name",
        "revenue_impact_usd",
        "affected_user_count",
        F.when(own, "root_cause").otherwise("impacted").alias("role"),
    )
    return _newest(rows, "created_at", "incident_id", limit)


def service_alerts(alerts: DataFrame, service: str, days: int = 30) -> DataFrame:
    rows = recent(alerts, "fired_at", days).where(F.col("service") == F.lit(service)).select(
        "alert_id",
        "alert_name",
        "severity",
        "fired_at",
        "resolved_at",
        "threshold_value",
        "actual_value",
        "duration_minutes",
        "breach_magnitude_pct",
        "is_incident_correlated",
        "is_pre_incident_signal",
    )
    return _newest(rows, "fired_at", "alert_id", 50)


# Changes ---------------------------------------------------------------------------------------


def correlation_summary(correlation: DataFrame) -> DataFrame:
    return correlation.groupBy("change_type", "change_type_incident_rate").agg(
        F.count_distinct("change_id").alias("total_changes"),
        F.count_distinct("incident_id").alias("correlated_incidents"),
        _rounded(F.avg, "correlation_strength", 3, "avg_correlation_strength"),
        _rounded(F.max, "correlation_strength", 3, "max_correlation_strength"),
        _rounded(F.avg, "minutes_between", 1, "avg_time_to_incident_min"),
        _rounded(F.sum, "revenue_impact_usd", 2, "total_revenue_impact"),
        F.sum("blast_radius").alias("total_blast_radius"),
    ).orderBy(F.desc("avg_correlation_strength"), "change_type")


def change_timeline(changes: DataFrame, incidents: DataFrame, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(changes, incidents), each within its own window."""
    recent_changes = recent(changes, "executed_at", days).select(
        "change_id",
        "service",
        "change_type",
        "description",
        "executed_at",
        "executed_by",
        "risk_level",
        "risk_score",
        "domain",
        "incidents_within_4h",
        "incidents_within_24h",
    )
    recent_incidents_ = recent(incidents, "created_at", days).select(
        "incident_id",
        "title",
        "severity",
        "created_at",
        "resolved_at",
        "root_service",
        "blast_radius",
        "domain",
        "failure_pattern_name",
    )
    return recent_changes.orderBy("executed_at", "change_id"), recent_incidents_.orderBy("created_at", "incident_id")


def high_correlation(changes: DataFrame, incidents: DataFrame, min_strength: float = 0.5, limit: int = 50) -> DataFrame:
    """The strongest change/incident pairs, without building the others.

    Strength depends on the lag window, on whether the change was made on the root service, and on the risk of the
    change. So running counts tell how many incidents of each strength every change has. The first ``limit``
    (change, strength) in the order of the result hold the first ``limit`` pairs, and only they are joined.
    """
    ends = {label: (minutes + 1) * 60 * MICROS - 1 for minutes, label in scoring.LAG_WINDOWS} | {"long_delay": 24 * 3600 * MICROS}
    at_root = incidents.where("root_service IS NOT NULL").select(F.col("root_service").alias("service"), "created_at")
    every = following(changes, per_service(incidents, "created_at"), ends)
    root = following(changes, at_root, ends).withColumnsRenamed({label: f"root_{label}" for label in ends})
    counted = changes.select("change_id", "service", "executed_at", "risk_score").join(every, ["service", "executed_at"]).join(root, ["service", "executed_at"])
    groups, before = [], []
    for label in ends:
        same, both = [F.col(c) - (F.col(before[-1][i]) if before else 0) for i, c in enumerate((f"root_{label}", label))]
        before.append((f"root_{label}", label))
        for n, on_root in ((same, F.col("service")), (both - same, F.lit(None).cast("string"))):
            groups.append(F.struct(F.lit(label).alias("correlation_window"), on_root.alias("incident_root_service"), n.alias("n")))
    held = counted.select("change_id", F.col("service").alias("change_service"), "risk_score", F.inline(F.array(*groups))).where("n > 0")
    scored = held.select("change_id", scoring.correlation_strength().alias("correlation_strength")).distinct()
    order = [F.desc("correlation_strength"), "change_id"]
    first = stored(scored.where(F.col("correlation_strength") >= F.lit(min_strength)).orderBy(*order).limit(limit), "strongest")

    pairs = change_incident_pairs(changes.join(first.select("change_id").distinct(), "change_id", "left_semi"), incidents)
    strong = pairs.withColumn("correlation_strength", scoring.correlation_strength())
    return strong.join(first, ["change_id", "correlation_strength"], "left_semi").select(
        "change_id",
        "change_service",
        "change_type",
        "risk_level",
        "change_time",
        "executed_by",
        "incident_id",
        "incident_severity",
        "incident_title",
        "incident_root_service",
        "incident_time",
        "minutes_between",
        "correlation_window",
        "correlation_strength",
        "revenue_impact_usd",
        "blast_radius",
        "failure_pattern_id",
    ).orderBy(*order, "incident_id").limit(limit)


def risky_change_types(changes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incident rate over all changes of a type, whether or not an incident followed within 24 hours.

    An incident counts once for a type; its revenue counts once for every change of the type before it. Both come
    from counts of the changes before an incident; no pair is built.
    """
    made = changes.groupBy("change_type").agg(F.count("*").alias("total_changes"))
    caused = preceding_by_type(changes, incidents, 24 * 3600, "revenue_impact_usd")
    caused = caused.withColumn("_revenue", F.col("revenue_impact_usd") * F.col("n")).groupBy("change_type").agg(
        F.count("*").alias("_incidents"), _rounded(F.sum, "_revenue", 2, "_impact")
    )
    return made.join(caused, "change_type", "left").select(
        "change_type",
        "total_changes",
        or_zero("_incidents").alias("incidents_caused"),
        percent(or_zero("_incidents"), "total_changes", 2).alias("incident_rate_pct"),
        or_zero("_impact").alias("total_revenue_impact"),
    ).orderBy(F.desc("incident_rate_pct"), "change_type")


def changes_by_executor(changes: DataFrame) -> DataFrame:
    return changes.groupBy("executed_by").agg(
        F.count("*").alias("total_changes"),
        F.sum("incidents_within_4h").alias("incidents_caused_4h"),
        F.sum("incidents_within_24h").alias("incidents_caused_24h"),
        _rounded(F.avg, "risk_score", 2, "avg_risk_score"),
        count_if(F.col("risk_level") == "high").alias("high_risk_changes"),
    ).orderBy(F.desc("incidents_caused_4h"), "executed_by")


# Domains ---------------------------------------------------------------------------------------


def domain_summary(domains: DataFrame) -> DataFrame:
    totals = {
        "incident_count": "total_incidents",
        "p1_count": "total_p1",
        "p2_count": "total_p2",
        "p3_count": "total_p3",
        "total_blast_radius": "total_blast_radius",
        "total_affected_users": "total_user_impact",
        "sla_breaches": "total_sla_breaches",
        "alert_count": "total_alerts",
        "critical_alert_count": "total_critical_alerts",
        "change_count": "total_changes",
        "high_risk_changes": "total_high_risk_changes",
        "changes_causing_incidents": "total_changes_causing_incidents",
    }
    return domains.groupBy("domain").agg(
        *[F.sum(source).alias(name) for source, name in totals.items()],
        _rounded(F.avg, "avg_mttr_minutes", 1, "avg_mttr"),
        _rounded(F.sum, "total_revenue_impact", 2, "total_revenue_impact"),
        _rounded(F.avg, "domain_risk_score", 2, "avg_daily_risk_score"),
        _rounded(F.sum, "domain_risk_score", 2, "cumulative_risk_score"),
    ).orderBy(F.desc("cumulative_risk_score"), "domain")


def domain_heatmap(domains: DataFrame, days: int = 90, anchor: DataFrame | None = None) -> DataFrame:
    """``anchor``: where the newest summary_date is read, if ``domains`` is not a written table."""
    return recent(domains, "summary_date", days, anchor).select(
        "domain",
        "summary_date",
        "incident_count",
        "p1_count",
        "total_revenue_impact",
        F.col("total_affected_users").alias("total_user_impact"),
        "alert_count",
        "critical_alert_count",
        "change_count",
        "domain_risk_score",
    ).orderBy("summary_date", "domain")


def domain_trend(domains: DataFrame, domain: str | None = None, days: int = 90, anchor: DataFrame | None = None) -> DataFrame:
    """``anchor`` as in ``domain_heatmap``."""
    rows = recent(domains, "summary_date", days, anchor)
    if domain:
        rows = rows.where(F.col("domain") == F.lit(domain))
    week = F.weekofyear("summary_date").alias("week_num")
    return rows.groupBy("domain", "summary_year", "summary_month", week).agg(
        F.min("summary_date").alias("week_start"),
        F.sum("incident_count").alias("weekly_incidents"),
        F.sum("p1_count").alias("weekly_p1"),
        _rounded(F.sum, "total_revenue_impact", 2, "weekly_revenue_impact"),
        F.sum("total_affected_users").alias("weekly_user_impact"),
        _rounded(F.avg, "domain_risk_score", 2, "avg_risk_score"),
        F.sum("change_count").alias("weekly_changes"),
        F.sum("alert_count").alias("weekly_alerts"),
    ).orderBy("domain", "week_start", "week_num")


def domain_services(ranking: DataFrame, incidents: DataFrame, domain: str) -> DataFrame:
    roots = incidents.where(F.col("domain") == F.lit(domain)).select(F.col("root_service").alias("service_name"))
    return ranking.join(roots, "service_name", "left_semi").select(
        "service_name",
        "risk_rank",
        "risk_score",
        "incident_count_as_root",
        "times_impacted_by_others",
        "p1_count",
        "avg_mttr_minutes",
        "total_revenue_impact",
        F.col("total_affected_users").alias("total_user_impact"),
        "avg_health_score",
        "avg_error_rate",
        "risky_changes",
    ).orderBy(F.desc("risk_score"), "service_name")


def domain_incidents(incidents: DataFrame, domain: str, days: int = 90, limit: int = 50) -> DataFrame:
    rows = recent(incidents, "created_at", days).where(F.col("domain") == F.lit(domain)).select(
        "incident_id",
        "title",
        "severity",
        "created_at",
        "resolved_at",
        "mttr_minutes",
        "root_service",
        "blast_radius",
        "failure_pattern_name",
        "revenue_impact_usd",
        "affected_user_count",
        "sla_breached",
    )
    return _newest(rows, "created_at", "incident_id", limit)


def domain_alerts(alerts: DataFrame, domain: str, days: int = 30) -> DataFrame:
    return recent(alerts, "fired_at", days).where(F.col("domain") == F.lit(domain)).groupBy(
        "service", "alert_name"
    ).agg(
        F.count("*").alias("alert_count"),
        count_if(F.col("severity") == "critical").alias("critical_count"),
        count_if(F.col("is_incident_correlated")).alias("incident_correlated"),
        count_if(F.col("is_pre_incident_signal")).alias("pre_incident_count"),
        _rounded(F.avg, "breach_magnitude_pct", 2, "avg_breach_magnitude"),
    ).orderBy(F.desc("alert_count"), "service", "alert_name")


# Answers to common questions ---------------------------------------------------------------------

STORY = [
    "incident_id",
    "title",
    "severity",
    "root_service",
    "business_unit",
    "created_at",
    "mttr_minutes",
    "revenue_impact_usd",
    "affected_user_count",
    "downstream_impact_narrative",
    "root_cause_explanation",
]
# The extra measure shown for a business unit.
STORY_MEASURE = {"supply-chain": "shipments_delayed", "digital-surgery": "productivity_loss_usd"}


def bu_p1_story(incidents: DataFrame, business_unit: str) -> DataFrame:
    extra = [STORY_MEASURE[business_unit]] if business_unit in STORY_MEASURE else []
    rows = incidents.where((F.col("business_unit") == F.lit(business_unit)) & (F.col("severity") == "P1"))
    rows = rows.select(*STORY, *extra, "servicenow_ticket_count", "servicenow_duplicate_tickets")
    return _newest(rows, "created_at", "incident_id", 5)


def duplicate_tickets_by_pattern(tickets: DataFrame) -> DataFrame:
    total, duplicates = F.sum("servicenow_ticket_count"), F.sum("servicenow_duplicate_tickets")
    return tickets.groupBy("failure_pattern_name", "business_unit").agg(
        total.alias("total_tickets"),
        duplicates.alias("total_duplicates"),
        percent(duplicates, total, 1).alias("duplicate_pct"),
    ).orderBy(F.desc("total_duplicates"), "failure_pattern_name", "business_unit").limit(10)


def revenue_by_bu(units: DataFrame) -> DataFrame:
    return units.select(
        "business_unit",
        "total_incidents",
        "total_revenue_impact",
        "primary_revenue_model",
        "total_affected_users",
        "total_servicenow_tickets",
        "overall_duplicate_pct",
        "total_productivity_loss",
        "total_shipments_delayed",
    ).orderBy(F.desc("total_revenue_impact"), "business_unit")


def patterns_by_blast(patterns: DataFrame, incidents: DataFrame) -> DataFrame:
    first = _first_patterns(patterns, incidents, "avg_blast_radius", 10)
    return first.orderBy(*_pattern_order("avg_blast_radius")).select(
        "failure_pattern_name",
        "root_service",
        "business_unit",
        "occurrence_count",
        "avg_blast_radius",
        "total_revenue_impact",
        "all_impacted_services",
        "root_cause_explanation",
    )


def recent_p1(incidents: DataFrame) -> DataFrame:
    return _newest(incidents.where(F.col("severity") == "P1").select(*STORY), "created_at", "incident_id", 10)


# The words that decide what a question is about; the first list with a hit wins.
INTENT_WORDS = {
    "supply_chain": ("shipment", "supply chain", "delays in shipment", "shipping", "inventory"),
    "productivity": ("data scientist", "digital surgery", "sagemaker", "productivity", "ml engineer"),
    "duplicate_tickets": ("duplicate", "servicenow", "tickets"),
    "revenue": ("revenue", "business impact", "cost", "financial"),
    "blast_radius": ("blast radius", "most impacted", "cascading"),
}


def question_intent(questions: DataFrame, text: str = "question") -> DataFrame:
    lowered = F.lower(F.col(text))
    label = F
    for intent, words in INTENT_WORDS.items():
        label = label.when(lowered.rlike("|".join(words)), F.lit(intent))
    return questions.withColumn("intent", label.otherwise(F.lit("recent_p1")))
