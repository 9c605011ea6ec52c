"""Aggregates: published figures, invariants and rules that are easy to get wrong."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from helpers import T0, alerts, changes, incidents, rows_by
from pyspark.sql import functions as F

from opsignal.functions import scoring
from opsignal.operators.ordering import row_numbers
from opsignal.plans import gold, impact, serve, silver


def patterns(spark, *rows):
    return gold.root_cause_patterns(silver.scored_incidents(incidents(spark, *rows)))


@pytest.mark.parametrize(
    "occurrences, revenue, users, p1, sla, blast, trend, expected",
    [(9, 10_200_000.0, 180, 0, 0, 4.0, "worsening", 1126.0), (1, 7_512_500.0, 57, 1, 1, 5.0, "stable", 818.95)],
)
def test_priority_score_of_known_cases(spark, occurrences, revenue, users, p1, sla, blast, trend, expected):
    df = spark.createDataFrame(
        [(occurrences, revenue, users, p1, sla, blast, trend)],
        "occurrence_count bigint, total_revenue_impact double, total_affected_users bigint, p1_count bigint, "
        "sla_breach_count bigint, avg_blast_radius double, trend_direction string",
    )
    assert df.select(scoring.priority_score()).first()[0] == expected


def test_trend_shares_the_week_four_before_the_newest(spark):
    newest = datetime(2024, 5, 27)
    rows = [{"incident_id": f"n{i}", "created_at": newest} for i in range(2)]
    rows += [{"incident_id": f"s{i}", "created_at": newest - timedelta(weeks=4)} for i in range(6)]
    rows += [{"incident_id": f"o{i}", "created_at": newest - timedelta(weeks=8)} for i in range(1)]
    rows += [{"incident_id": "out", "created_at": newest - timedelta(weeks=9)}]
    got = patterns(spark, *rows).first()
    assert (got.recent_weekly_avg, got.previous_weekly_avg, got.trend_direction) == (4.0, 3.5, "stable")


def test_pattern_seen_once_has_no_interval_and_is_stable(spark):
    got = patterns(spark, {}).first()
    assert got.avg_days_between_occurrences is None
    assert (got.trend_direction, got.previous_weekly_avg) == ("stable", None)


def test_pattern_grain_and_first_values(spark):
    got = patterns(
        spark,
        {"incident_id": "late", "created_at": T0 + timedelta(days=3), "business_unit": "late", "impacted_services": ["x"]},
        {"incident_id": "early", "business_unit": "early", "impacted_services": ["y", "x"]},
        {"incident_id": "other", "domain": "network", "impacted_services": None},
        {"incident_id": "none", "failure_pattern_id": None},
    )
    by = rows_by(got, "domain")
    assert set(by) == {"application", "network"}
    assert by["application"].business_unit == "early"
    assert by["application"].avg_days_between_occurrences == 3.0
    assert by["application"].affected_root_services == ["a"]
    # the set is joined by pattern id alone
    assert by["network"].all_impacted_services == ["x", "y"]


@pytest.mark.parametrize("minutes, label", [(30, "immediate"), (31, "short_delay"), (120, "short_delay"), (121, "delayed"), (480, "delayed"), (481, "long_delay")])
def test_correlation_window_limits(spark, minutes, label):
    df = spark.createDataFrame([(minutes,)], "minutes_between bigint")
    assert df.select(scoring.correlation_window()).first()[0] == label


def test_pairs_are_unique_and_end_inclusive(spark):
    chg = silver.scored_changes(changes(spark, {"rollback_available": False, "change_type": "database_migration"}))
    inc = silver.scored_incidents(
        incidents(
            spark,
            {"incident_id": "root and impacted", "impacted_services": ["a", "a"], "created_at": T0 + timedelta(seconds=59)},
            {"incident_id": "end", "root_service": "b", "impacted_services": ["a"], "created_at": T0 + timedelta(hours=24)},
            {"incident_id": "out", "created_at": T0 + timedelta(hours=24, microseconds=1)},
            {"incident_id": "elsewhere", "root_service": "b"},
        )
    )
    got = rows_by(gold.change_incident_correlation(chg, inc), "incident_id")
    assert set(got) == {"root and impacted", "end"}
    assert (got["root and impacted"].minutes_between, got["root and impacted"].correlation_strength) == (0, 4.05)
    assert (got["end"].correlation_window, got["end"].correlation_strength) == ("long_delay", 0.6)
    assert got["end"].change_type_incident_rate == 200.0


def test_ranking_covers_health_only_services_without_their_changes(spark):
    scored = silver.scored_incidents(incidents(spark, {}))
    health = spark.createDataFrame(
        [("h", 40.0, 1.0, 9.0), ("a", 80.0, 0.0, 5.0)],
        "service_name string, health_score double, error_rate_pct double, avg_cpu_pct double",
    )
    made = changes(spark, {"service": "h"}, {"service": "b"}).selectExpr("*", "3L AS incidents_within_4h")
    got = rows_by(gold.service_risk_ranking(scored, health, made), "service_name")
    assert set(got) == {"a", "b", "h"}
    assert (got["h"].total_changes, got["h"].risk_score, got["h"].business_unit) == (0, 30.0, "shared-infrastructure")
    assert (got["b"].risky_changes, got["b"].avg_health_score, got["b"].times_impacted_by_others) == (3, 100.0, 1)
    # rank follows the shorter score; equal services by name
    assert {n: r.risk_rank for n, r in got.items()} == {"a": 1, "b": 2, "h": 3}


def test_ranges_give_the_same_numbers_as_one_window(spark):
    df = spark.range(3000).selectExpr("concat('n', id) AS name", "pmod(xxhash64(id), 7) / 2 AS score")
    order = [-F.col("score"), F.col("name")]
    split = row_numbers(df, "rank", order, "name", ranges=10)
    whole = row_numbers(df, "rank", order, "name", ranges=1)
    assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()
    assert split.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (1, 3000, 3000)


def test_domain_days_come_from_any_source(spark):
    inc = silver.scored_incidents(incidents(spark, {"domain": "d"}, {"domain": None, "incident_id": "n"}))
    alr = silver.silver_alerts(alerts(spark, {"domain": "only alerts"}), incidents(spark, {}))
    chg = silver.silver_changes(changes(spark, {"domain": "only changes"}), incidents(spark, {}))
    got = rows_by(gold.domain_impact_summary(inc, alr, chg), "domain")
    assert set(got) == {"d", None, "only alerts", "only changes"}
    assert got["only alerts"].incident_count == 0 and got["only alerts"].alert_count == 1
    assert got["only changes"].domain_risk_score == 8.0


def test_invariants_on_generated_data(inputs):
    domains = inputs.domains
    assert domains.agg(F.sum("incident_count")).first()[0] == inputs.incidents.where("domain IS NOT NULL").count()
    assert inputs.silver_changes.where("incidents_within_4h > incidents_within_24h").isEmpty()
    assert inputs.pairs.groupBy("change_id", "incident_id").count().where("count > 1").isEmpty()
    impacted = inputs.incidents.select(F.explode("impacted_services").alias("service_name")).distinct()
    assert impacted.join(inputs.services, "service_name", "left_anti").isEmpty()
    n = inputs.services.count()
    assert inputs.ranking.agg(F.count_distinct("risk_rank"), F.max("risk_rank")).first() == (n, n)


def test_report_without_patterns(spark, inputs):
    empty = inputs.patterns.where("false")
    lines = serve.rule_based_report(empty, inputs.services).collect()
    assert [r.line for r in lines] == ["No failure patterns detected in the analysis period."]
    one = serve.rule_based_report(inputs.patterns, inputs.services, "FP-7").where("section = 3 AND place > 0")
    assert one.count() == min(5, inputs.patterns.where("failure_pattern_id = 'FP-7'").count())


def test_text_parameters_are_values_not_sql(inputs):
    hostile = "x' OR '1'='1"
    assert serve.incident_detail(inputs.silver_incidents, hostile).isEmpty()
    assert serve.pattern_timeline(inputs.scored, hostile).isEmpty()
    assert serve.incident_timeline(inputs.scored, 90, severity=hostile).isEmpty()


def test_revenue_models(spark):
    models = spark.createDataFrame(
        [
            ("ship", impact.SHIPMENT, 340.0, 12500.0, None, None, None, None, None, None, None, None),
            ("trial", impact.TRIAL, None, None, None, None, None, None, None, None, None, None),
            ("odd", "unknown", None, None, None, None, None, None, None, None, None, None),
        ],
        impact.MODEL_COLUMNS,
    )
    inc = incidents(
        spark,
        {"incident_id": "s", "business_unit": "ship", "mttr_minutes": 106},
        {"incident_id": "t", "business_unit": "trial", "mttr_minutes": 30},
        {"incident_id": "o", "business_unit": "odd"},
        {"incident_id": "none", "business_unit": "missing"},
    )
    got = rows_by(impact.revenue_impact(inc, models), "incident_id")
    assert (got["s"].shipments_delayed, got["s"].revenue_impact_usd) == (601, 7508333.33)
    assert got["t"].revenue_impact_usd == 87500.0
    assert got["o"].revenue_impact_usd == 0.0 and got["none"].revenue_impact_usd == 0.0
    flags = inc.select(impact.sla_flag().alias("f"), "incident_id")
    assert rows_by(flags, "incident_id")["t"].f is False


def test_lists_are_gathered_for_the_chosen_patterns_only(spark, inputs):
    """The set of impacted services is joined behind the limit, from the incidents of the chosen patterns."""
    from opsignal.plans import gold, serve

    plan = serve.top_systemic_issue(inputs.plain_patterns, inputs.scored)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "LeftSemi" in plan[: plan.index("Generate explode")] + plan[plan.index("Generate explode") :]
    full = gold.root_cause_patterns(inputs.scored)
    want = full.orderBy(F.desc("avg_blast_radius"), *serve.PATTERN_KEY).limit(10).collect()
    got = serve.patterns_by_blast(inputs.plain_patterns, inputs.scored).collect()
    assert [(r.failure_pattern_name, r.root_service, r.all_impacted_services) for r in got] == [(r.failure_pattern_name, r.root_service, r.all_impacted_services) for r in want]


def test_change_counts_equal_the_lists(inputs):
    from opsignal.plans import silver

    listed = {r.incident_id: r.preceding_changes for r in silver.preceding_changes(inputs.incidents, inputs.changes).collect()}
    counted = {r.incident_id: (r.changes, r.change_types) for r in silver.change_counts(silver.incident_changes(inputs.incidents, inputs.changes)).collect()}
    assert counted == {k: (len(v), len({c.change_type for c in v})) for k, v in listed.items()} and counted


def test_lists_are_put_into_text_once_a_pattern(spark, sf_dir):
    """Every row of a pattern carries the same list: sorting and joining it is work of the pattern, not of the row."""
    from opsignal.catalog import QUERIES, tidy

    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    plan = QUERIES["g8_root_cause_patterns"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    above = plan[: plan.index("Join LeftOuter")]
    assert "all_impacted_services" in above and "array_join(sort_array(all_impacted_services" not in above

    rows = [
        {"incident_id": "1", "root_service": "a", "impacted_services": ["z", "b"]},
        {"incident_id": "2", "root_service": "c", "impacted_services": ["b", None]},
        {"incident_id": "3", "failure_pattern_id": "F2", "impacted_services": []},
        {"incident_id": "4", "failure_pattern_id": None},
    ]
    scored = silver.scored_incidents(incidents(spark, *rows))
    key = ("failure_pattern_id", "root_service")
    got = rows_by(tidy(gold.root_cause_patterns(scored, tidy)), *key)
    assert got == rows_by(tidy(gold.root_cause_patterns(scored)), *key)
    assert {k: r.all_impacted_services for k, r in got.items()} == {("F1", "a"): "b,z", ("F1", "c"): "b,z", ("F2", "a"): None}


def test_the_context_gathers_lists_for_the_chosen_patterns_only(spark, inputs, sf_dir, tmp_path, monkeypatch):
    """Five patterns are chosen by narrow rows: no list goes through the sort. The document is computed once."""
    from opsignal import catalog

    rows = [
        {"incident_id": f"{p}{i}", "failure_pattern_id": f"F{p}", "root_service": f"r{i}", "impacted_services": [f"s{p}", f"t{i}"] if p else [], "blast_radius": p % 3}
        for p in range(7)
        for i in range(2 + p % 2)
    ]
    scored = silver.scored_incidents(incidents(spark, *rows))
    for chosen in (None, "F3", "F0"):
        whole = serve.analysis_context(gold.root_cause_patterns(scored), inputs.services, chosen).collect()
        assert serve.analysis_context(gold.plain_patterns(scored), inputs.services, chosen, scored).collect() == whole

    plans = []

    def seen(df, label, keep=catalog.stored):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return keep(df, label)

    monkeypatch.setattr(catalog, "stored", seen)
    monkeypatch.setattr(serve, "stored", seen)
    context = catalog.QUERIES["v13_analysis_context"](spark, sf_dir)
    assert [label for label, _ in plans] == ["patterns", "context"]
    assert "collect_list" not in plans[0][1] and "percentile" not in plans[1][1]
    assert "percentile" not in context._jdf.queryExecution().optimizedPlan().toString()
