"""Boundaries and unusual inputs of the enrichment rules."""

from __future__ import annotations

from datetime import datetime, timedelta

from helpers import T0, alerts, changes, incidents, rows_by
from pyspark.sql import functions as F

from opsignal.functions.nested import attribute, parse_service_list
from opsignal.functions.numbers import half_up, humanize, humanize_currency
from opsignal.functions.times import from_nanos, recent
from opsignal.plans import silver


def minutes(n):
    return T0 + timedelta(minutes=n)


def test_severity_and_impact_score(spark):
    df = silver.scored_incidents(
        incidents(
            spark,
            {"incident_id": "a", "severity": "P1", "blast_radius": 4, "revenue_impact_usd": 200000.0},
            {"incident_id": "b", "severity": "P9", "blast_radius": 0, "revenue_impact_usd": 9e6},
            {"incident_id": "c", "severity": None, "blast_radius": 1, "revenue_impact_usd": 0.0},
        )
    )
    got = rows_by(df, "incident_id")
    assert (got["a"].severity_level, got["a"].impact_score) == ("critical", 900.0)
    assert (got["b"].severity_level, got["b"].impact_score) == ("low", 60.0)
    assert (got["c"].severity_level, got["c"].impact_score) == ("low", 10.0)


def test_calendar_is_sunday_one_and_iso_week(spark):
    got = silver.scored_incidents(incidents(spark, {"created_at": datetime(2027, 1, 1, 23, 59)})).first()
    assert (got.incident_day_of_week, got.incident_week, got.incident_hour) == (6, 53, 23)


def test_silver_incidents_without_alerts_or_changes_has_empty_lists(spark):
    got = silver.silver_incidents(
        incidents(spark, {}), alerts(spark, {"incident_id": "other"}), changes(spark, {"service": "z"})
    ).first()
    assert (got.correlated_alert_types, got.correlated_alert_count, got.preceding_changes) == ([], 0, [])


def test_preceding_changes_window_is_closed_and_covers_null_list(spark):
    inc = incidents(spark, {"incident_id": "n", "impacted_services": None}, {"incident_id": "l", "impacted_services": ["a", "b", "a"]})
    chg = changes(
        spark,
        {"change_id": "edge", "executed_at": minutes(-120)},
        {"change_id": "same", "executed_at": T0},
        {"change_id": "old", "executed_at": minutes(-120) - timedelta(microseconds=1)},
        {"change_id": "late", "executed_at": T0 + timedelta(microseconds=1)},
        {"change_id": "imp", "service": "b", "executed_at": minutes(-1)},
    )
    got = rows_by(silver.preceding_changes(inc, chg), "incident_id")
    assert [c.change_id for c in got["n"].preceding_changes] == ["edge", "same"]
    assert [c.change_id for c in got["l"].preceding_changes] == ["edge", "imp", "same"]


def test_alert_flags(spark):
    df = alerts(
        spark,
        {"alert_id": "none"},
        {"alert_id": "unknown", "incident_id": "nope"},
        {"alert_id": "before", "incident_id": "I1", "fired_at": minutes(-1)},
        {"alert_id": "at", "incident_id": "I1"},
    )
    got = rows_by(silver.alert_incident_flags(df, incidents(spark, {})), "alert_id")
    assert got["none"].is_incident_correlated is False and got["none"].is_pre_incident_signal is False
    assert got["unknown"].is_incident_correlated is True and got["unknown"].is_pre_incident_signal is None
    assert got["before"].is_pre_incident_signal is True
    assert got["at"].is_pre_incident_signal is False


def test_alert_duration_truncates_and_zero_threshold_is_zero(spark):
    df = alerts(
        spark,
        {"alert_id": "x", "resolved_at": T0 + timedelta(seconds=119), "threshold_value": 0.0},
        {"alert_id": "y", "threshold_value": 80.0, "actual_value": 70.0},
    )
    got = rows_by(silver.silver_alerts(df, incidents(spark, {})), "alert_id")
    assert (got["x"].duration_minutes, got["x"].breach_magnitude_pct) == (1, 0.0)
    assert got["y"].breach_magnitude_pct == -12.5


def test_change_risk_and_following_counts(spark):
    chg = changes(
        spark,
        {"change_id": "c", "change_type": "vpc_peering_update", "rollback_available": False},
        {"change_id": "n", "change_type": "config_change", "risk_level": None, "rollback_available": None},
        {"change_id": "lone", "service": "zz"},
    )
    inc = incidents(
        spark,
        {"incident_id": "0"},
        {"incident_id": "4h", "created_at": minutes(240)},
        {"incident_id": "4h+", "created_at": minutes(240) + timedelta(microseconds=1)},
        {"incident_id": "24h", "created_at": minutes(1440), "root_service": "q", "impacted_services": ["a"]},
        {"incident_id": "24h+", "created_at": minutes(1440) + timedelta(microseconds=1)},
        {"incident_id": "past", "created_at": T0 - timedelta(microseconds=1)},
        {"incident_id": "both", "created_at": minutes(5), "impacted_services": ["a", "a"]},
        {"incident_id": "null list", "created_at": minutes(6), "impacted_services": None},
    )
    got = rows_by(silver.silver_changes(chg, inc), "change_id")
    assert (got["c"].risk_score, got["n"].risk_score) == (9.0, 1.5)
    assert (got["c"].incidents_within_4h, got["c"].incidents_within_24h) == (4, 6)
    assert (got["lone"].incidents_within_4h, got["lone"].incidents_within_24h) == (0, 0)


def _metric(spark, rows):
    schema = "service_name string, metric_name string, metric_value double, histogram_sum double, histogram_count bigint, event_timestamp timestamp"
    return spark.createDataFrame(rows, schema)


def test_health_only_for_days_with_cpu_and_may_be_negative(spark):
    metrics = _metric(
        spark,
        [
            ("a", silver.CPU, 150.0, None, None, T0),
            ("a", silver.LATENCY, None, 30.0, 2, T0),
            ("a", silver.LATENCY, None, 70.0, 3, T0),
            ("b", silver.MEMORY, 10.0, None, None, T0),
            (None, silver.CPU, 10.0, None, None, T0),
        ],
    )
    logs = spark.createDataFrame([("a", "FATAL", T0)] * 3 + [("a", "INFO", T0)], "service_name string, severity_text string, event_timestamp timestamp")
    inc = incidents(spark, *[{"incident_id": str(i)} for i in range(4)], {"incident_id": "b", "root_service": "b"})
    rows = silver.silver_service_health(metrics, inc, logs).collect()
    assert [r.service_name for r in rows] == ["a"]
    r = rows[0]
    assert r.avg_latency_ms is None and r.max_latency_ms is None and r.hist_avg_latency_ms == 20.0
    assert (r.error_log_count, r.total_log_count, r.error_rate_pct) == (3, 4, 75.0)
    assert r.health_score == round(100 - 15 - 0 - 60 - 100 - 0.3, 2)


def test_impact_tiers_are_strict_and_tickets_need_some(spark):
    inc = incidents(
        spark,
        {"incident_id": "m", "revenue_impact_usd": 1000000.0, "severity": "P4", "mttr_minutes": 8, "blast_radius": 3},
        {"incident_id": "z", "revenue_impact_usd": 10000.0, "servicenow_ticket_count": 0},
    )
    got = rows_by(silver.silver_business_impact(inc), "incident_id")
    assert (got["m"].revenue_impact_level, got["m"].weighted_downtime_minutes) == ("high", 6.0)
    assert got["z"].revenue_impact_level == "low"
    tickets = silver.silver_servicenow_correlation(inc).collect()
    assert [(t.incident_id, t.duplicate_pct) for t in tickets] == [("m", 25.0)]


def test_half_up_ignores_summation_noise(spark):
    df = spark.createDataFrame([(0.1 + 0.2,), (2.675,), (-0.125,), (1e20,), (None,)], "x double")
    assert [r[0] for r in df.select(half_up("x", 2)).collect()] == [0.3, 2.68, -0.13, 1e20, None]


def test_humanize(spark):
    df = spark.createDataFrame([(None,), (0.0,), (12.5,), (999.9994,), (1000.0,), (1250.0,), (1.25e6,), (-5.0,)], "x double")
    assert [r[0] for r in df.select(humanize("x")).collect()] == ["--", "0", "12.5", "999.999", "1.0K", "1.3K", "1.3M", "-5"]
    assert [r[0] for r in df.select(humanize_currency("x")).collect()] == ["--", "$0", "$13", "$1000", "$1K", "$1K", "$1.3M", "$-5"]


def test_service_list_forms(spark):
    df = spark.createDataFrame([('["a","b"]',), ("['a', 'b']",), (" a , b,, ",), ("",), (None,), ("[]",)], "x string")
    got = [r[0] for r in df.select(parse_service_list("x")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["a", "b"], [], [], []]


def test_attribute_takes_the_first_match(spark):
    df = spark.sql(
        "SELECT array(named_struct('key','k','value',named_struct('stringValue','1')),"
        "named_struct('key','k','value',named_struct('stringValue','2'))) AS a"
    )
    assert df.select(attribute("a", "k"), attribute("a", "none")).first() == ("1", None)


def test_nanos_keep_microseconds(spark):
    got = spark.sql("SELECT 1772539200123456789L AS n").select(from_nanos("n").cast("string")).first()[0]
    assert got.endswith(".123456")


def test_recent_is_relative_to_the_newest_row(spark):
    df = incidents(spark, {}, {"created_at": minutes(-1440)}, {"created_at": minutes(-1441)})
    assert recent(df, "created_at", 1).count() == 2
    days = df.select(F.to_date("created_at").alias("d"))
    assert recent(days, "d", 0).count() == 1
