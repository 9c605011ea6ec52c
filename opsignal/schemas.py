"""Landing schemas, bronze schemas and table keys."""

from __future__ import annotations

# Landing documents -----------------------------------------------------------------------------

_ATTR = "array<struct<key: string, value: struct<stringValue: string, intValue: string>>>"

RAW_LOGS = f"""
resourceLogs array<struct<
  resource: struct<attributes: {_ATTR}>,
  scopeLogs: array<struct<
    scope: struct<name: string>,
    logRecords: array<struct<
      timeUnixNano: string, severityNumber: bigint, severityText: string,
      body: struct<stringValue: string>, attributes: {_ATTR}, traceId: string, spanId: string>>>>>>
"""

RAW_TRACES = f"""
resourceSpans array<struct<
  resource: struct<attributes: {_ATTR}>,
  scopeSpans: array<struct<
    scope: struct<name: string>,
    spans: array<struct<
      traceId: string, spanId: string, parentSpanId: string, name: string, kind: bigint,
      startTimeUnixNano: string, endTimeUnixNano: string,
      status: struct<code: bigint, message: string>,
      attributes: {_ATTR}, resource: struct<attributes: {_ATTR}>>>>>>>
"""

RAW_INCIDENTS = """
incident_id string, title string, description string, severity string, status string,
created_at string, resolved_at string, mttr_minutes bigint, root_service string,
impacted_services array<string>, blast_radius bigint, domain string, failure_pattern_id string,
failure_pattern_name string, environment string, region string, revenue_impact_usd double,
sla_breached boolean, business_unit string, affected_user_count bigint, affected_roles array<string>,
productivity_loss_hours double, productivity_loss_usd double, shipments_delayed bigint,
servicenow_ticket_count bigint, servicenow_duplicate_tickets bigint,
downstream_impact_narrative string, root_cause_explanation string, revenue_model string
"""

RAW_ALERTS = """
alert_id string, incident_id string, service string, alert_name string, severity string,
fired_at string, resolved_at string, threshold_value double, actual_value double,
domain string, environment string
"""

RAW_CHANGES = """
change_id string, service string, change_type string, description string, executed_at string,
executed_by string, risk_level string, rollback_available boolean, domain string,
environment string, region string
"""

# Bronze tables ---------------------------------------------------------------------------------

BRONZE_METRICS = """
service_name string, environment string, region string, host_name string, service_version string,
scope_name string, metric_name string, metric_unit string, metric_value double,
histogram_count bigint, histogram_sum double, metric_type string, timestamp_unix_nano bigint,
event_timestamp timestamp
"""

BRONZE_FLOWS = """
flow_id string, event_timestamp timestamp, src_ip string, src_port int, dst_ip string, dst_port int,
protocol string, bytes_sent bigint, bytes_received bigint, packets_sent bigint, packets_received bigint,
latency_us bigint, retransmits int, src_service string, dst_service string, src_zone string,
dst_zone string, direction string, connection_reset boolean, timeout boolean, tls_version string,
dns_query string, dns_response_code int, load_balancer_id string, environment string, region string
"""

# Keys at the true grain of each table, and how its serving copy is refreshed. -------------------

KEYS = {
    "bronze_metrics": ["service_name", "metric_name", "event_timestamp"],
    "bronze_network_flows": ["flow_id"],
    "silver_incidents": ["incident_id"],
    "silver_incident_changes": ["incident_id", "change_id"],
    "silver_alerts": ["alert_id"],
    "silver_changes": ["change_id"],
    "silver_service_health": ["service_name", "health_date"],
    "silver_business_impact": ["incident_id"],
    "silver_servicenow_correlation": ["incident_id"],
    "gold_root_cause_patterns": ["failure_pattern_id", "failure_pattern_name", "root_service", "domain"],
    "gold_service_risk_ranking": ["service_name"],
    "gold_change_incident_correlation": ["change_id", "incident_id"],
    "gold_domain_impact_summary": ["domain", "summary_date"],
    "gold_business_impact_summary": ["business_unit"],
}
SNAPSHOT, TRIGGERED = "SNAPSHOT", "TRIGGERED"
REFRESH = {t: SNAPSHOT if t.startswith("bronze_") else TRIGGERED for t in KEYS}
