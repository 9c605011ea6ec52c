"""Small frames for unit tests."""

from __future__ import annotations

from datetime import datetime, timedelta

T0 = datetime(2024, 3, 4, 12, 0, 0)

INCIDENT = {
    "incident_id": "I1",
    "title": "t",
    "description": "d",
    "severity": "P1",
    "status": "resolved",
    "created_at": T0,
    "resolved_at": T0 + timedelta(minutes=60),
    "mttr_minutes": 60,
    "root_service": "a",
    "impacted_services": ["b"],
    "blast_radius": 1,
    "domain": "application",
    "failure_pattern_id": "F1",
    "failure_pattern_name": "n1",
    "environment": "prod",
    "region": "r",
    "revenue_impact_usd": 1000.0,
    "sla_breached": True,
    "business_unit": "u",
    "affected_user_count": 10,
    "user_impact_count": 10,
    "affected_roles": ["engineer"],
    "productivity_loss_hours": 1.0,
    "productivity_loss_usd": 0.0,
    "shipments_delayed": 0,
    "servicenow_ticket_count": 4,
    "servicenow_duplicate_tickets": 1,
    "downstream_impact_narrative": "x",
    "root_cause_explanation": "y",
    "revenue_model": "m",
}
INCIDENT_SCHEMA = (
    "incident_id string, title string, description string, severity string, status string, created_at timestamp, "
    "resolved_at timestamp, mttr_minutes int, root_service string, impacted_services array<string>, blast_radius int, "
    "domain string, failure_pattern_id string, failure_pattern_name string, environment string, region string, "
    "revenue_impact_usd double, sla_breached boolean, business_unit string, affected_user_count int, user_impact_count int, "
    "affected_roles array<string>, productivity_loss_hours double, productivity_loss_usd double, shipments_delayed int, "
    "servicenow_ticket_count int, servicenow_duplicate_tickets int, downstream_impact_narrative string, "
    "root_cause_explanation string, revenue_model string"
)
CHANGE = {
    "change_id": "C1",
    "service": "a",
    "change_type": "deployment",
    "description": "d",
    "executed_at": T0,
    "executed_by": "bot",
    "risk_level": "high",
    "rollback_available": True,
    "domain": "application",
    "environment": "prod",
    "region": "r",
}
CHANGE_SCHEMA = (
    "change_id string, service string, change_type string, description string, executed_at timestamp, executed_by string, "
    "risk_level string, rollback_available boolean, domain string, environment string, region string"
)
ALERT = {
    "alert_id": "A1",
    "incident_id": None,
    "service": "a",
    "alert_name": "HighCPU",
    "severity": "critical",
    "fired_at": T0,
    "resolved_at": T0 + timedelta(minutes=5),
    "threshold_value": 80.0,
    "actual_value": 90.0,
    "domain": "app",
    "environment": "prod",
}
ALERT_SCHEMA = (
    "alert_id string, incident_id string, service string, alert_name string, severity string, fired_at timestamp, "
    "resolved_at timestamp, threshold_value double, actual_value double, domain string, environment string"
)


def _frame(spark, base, schema, rows):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], schema)


def incidents(spark, *rows):
    return _frame(spark, INCIDENT, INCIDENT_SCHEMA, rows)


def changes(spark, *rows):
    return _frame(spark, CHANGE, CHANGE_SCHEMA, rows)


def alerts(spark, *rows):
    return _frame(spark, ALERT, ALERT_SCHEMA, rows)


def rows_by(df, *key):
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in key)
        out[k if len(key) > 1 else k[0]] = r
    return out
