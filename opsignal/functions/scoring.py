"""Labels and scores of incidents, alerts, changes and services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, half_up

# Result-defining labels, weights and limits.
SEVERITY_LEVELS = {"P1": "critical", "P2": "high", "P3": "medium"}
SEVERITY_WEIGHTS = {"P1": 100, "P2": 60, "P3": 30}
DOWNTIME_WEIGHTS = {"P1": 1.0, "P2": 0.5}
RISK_LEVEL_WEIGHTS = {"high": 3.0, "medium": 2.0}
CHANGE_CLASS_WEIGHTS = {
    2.0: (
        "database_migration",
        "network_route_change",
        "firewall_rule_update",
        "vpc_peering_update",
        "security_group_change",
    ),
    1.5: ("deployment", "dependency_upgrade", "terraform_apply"),
}
REVENUE_TIERS = ((1_000_000, "critical"), (100_000, "high"), (10_000, "moderate"))
LAG_WINDOWS = ((30, "immediate"), (120, "short_delay"), (480, "delayed"))
LAG_WEIGHTS = {"immediate": 0.9, "short_delay": 0.7, "delayed": 0.4}
DOMAIN_SYNONYMS = {
    "infrastructure": ("infra", "infrastructure"),
    "application": ("app", "application"),
    "network": ("net", "network"),
}


def pick(key: str, values: dict, default) -> str:
    """SQL for ``values[key]``, or the default for any other key and for NULL."""

    def literal(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)

    branches = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in values.items())
    return f"CASE {key} {branches} ELSE {literal(default)} END"


def tier(value: str, limits: tuple, comparison: str, default: str) -> str:
    """SQL for the label of the first limit the value meets."""
    branches = " ".join(f"WHEN {value} {comparison} {limit} THEN '{label}'" for limit, label in limits)
    return f"CASE {branches} ELSE '{default}' END"


def severity_level() -> Column:
    return F.expr(pick("severity", SEVERITY_LEVELS, "low"))


def impact_score() -> Column:
    spread = "1 + log2(greatest(blast_radius, 1))"
    money = "1 + least(revenue_impact_usd / 100000, 5)"
    return half_up(f"(({pick('severity', SEVERITY_WEIGHTS, 10)}) * ({spread}) * ({money}))", 2)


def breach_pct() -> Column:
    over = "(actual_value - threshold_value) / threshold_value * 100"
    return half_up(f"(CASE WHEN threshold_value > 0 THEN {over} ELSE 0D END)", 2)


def change_risk() -> Column:
    kinds = {name: weight for weight, names in CHANGE_CLASS_WEIGHTS.items() for name in names}
    level, kind = pick("risk_level", RISK_LEVEL_WEIGHTS, 1.0), pick("change_type", kinds, 1.0)
    return F.expr(f"({level}) * (CASE WHEN rollback_available THEN 1D ELSE 1.5D END) * ({kind})")


def revenue_level() -> Column:
    return F.expr(tier("revenue_impact_usd", REVENUE_TIERS, ">", "low"))


def weighted_downtime() -> Column:
    return F.expr(f"mttr_minutes * blast_radius * ({pick('severity', DOWNTIME_WEIGHTS, 0.25)})")


def health_score() -> Column:
    """100 minus load, incident and error-log penalties; it may fall below zero.

    Reads max_cpu_pct, max_memory_pct, incident_count, p1_count and error_count, any of them NULL.
    """
    load = "least(coalesce(max_cpu_pct, 0), 100) * 0.15D - least(coalesce(max_memory_pct, 0), 100) * 0.10D"
    events = "coalesce(incident_count, 0) * 15 - coalesce(p1_count, 0) * 25"
    logs = "least(coalesce(error_count, 0) * 0.1D, 20)"
    return half_up(f"(100 - {load} - {events} - {logs})", 2)


MOVED_UP, MOVED_DOWN = "recent_avg > previous_avg * 1.2D", "recent_avg < previous_avg * 0.8D"


def trend_direction() -> Column:
    return F.expr(f"CASE WHEN {MOVED_UP} THEN 'worsening' WHEN {MOVED_DOWN} THEN 'improving' ELSE 'stable' END")


def priority_score() -> Column:
    """Over the pattern columns plus ``trend_direction``."""
    return half_up(
        "(occurrence_count * 2D + total_revenue_impact / 10000D + total_affected_users / 10D + p1_count * 20D"
        " + sla_breach_count * 15D + avg_blast_radius * 5D"
        " + CASE WHEN trend_direction = 'worsening' THEN 50 ELSE 0 END)",
        2,
    )


# The shorter sum that orders services; the full risk score adds to it.
RANK_BASIS = "incident_count_as_root * 10D + p1_count * 30D + total_revenue_impact / 10000D + total_affected_users / 5D"


def rank_basis() -> Column:
    return half_up(f"({RANK_BASIS})", 6)


def risk_score() -> Column:
    return half_up(
        f"({RANK_BASIS} + sla_breaches * 20D + avg_blast_radius * 5D + times_impacted_by_others * 2D"
        " + (100 - avg_health_score) * 0.5D + risky_changes * 8D)",
        2,
    )


def domain_risk_score() -> Column:
    return half_up(
        "(incident_count * 10 + p1_count * 25 + total_revenue_impact / 5000D + total_affected_users / 2D"
        " + sla_breaches * 15 + changes_causing_incidents * 8)",
        2,
    )


def correlation_window() -> Column:
    return F.expr(tier("minutes_between", LAG_WINDOWS, "<=", "long_delay"))


def correlation_strength() -> Column:
    """Lag weight, half as much again on the root service itself, scaled by change risk."""
    same = "CASE WHEN change_service = incident_root_service THEN 1.5D ELSE 1D END"
    return half_up(f"(({pick('correlation_window', LAG_WEIGHTS, 0.2)}) * ({same}) * risk_score / 3D)", 3)


def normal_domain(domain: Column | str) -> Column:
    """Lower-case, trimmed domain name with its short forms spelled out."""
    d = F.lower(F.trim(col(domain)))
    out = F
    for full, names in DOMAIN_SYNONYMS.items():
        out = out.when(d.isin(*names), F.lit(full))
    return out.otherwise(d)
