"""Plans and skew: what would hurt on large tables."""

from __future__ import annotations

from datetime import timedelta

import pytest
from helpers import T0, changes, incidents, rows_by
from pyspark.sql import functions as F

from opsignal.catalog import QUERIES
from opsignal.operators.intervals import change_incident_matches, following_counts
from opsignal.plans import insight, silver


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Nothing is small: a join that has no key to shuffle by shows itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("p1_written_tables", "p1_build_configured")])
def test_no_nested_loop_or_cross_join(spark, sf_dir, name, no_broadcast):
    """Of every operator; those that stage tables run their jobs under the same setting."""
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["g10_impacted_stats"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in plan


def hot(spark, n):
    """Two thirds of the rows on one service, crowded into two hours; the rest spread out."""
    step = timedelta(seconds=7200 / n)
    inc = incidents(
        spark,
        *[
            {
                "incident_id": f"I{i}",
                "created_at": T0 + i * step if i % 3 else T0 + timedelta(hours=i),
                "root_service": "hot" if i % 3 else f"cold{i % 5}",
                "impacted_services": ["hot"] if i % 7 == 0 else [f"cold{i % 4}"],
            }
            for i in range(n)
        ],
    )
    chg = changes(
        spark,
        *[
            {
                "change_id": f"C{i}",
                "executed_at": T0 + (i // 2) * step if i % 3 else T0 + timedelta(hours=i),
                "service": "hot" if i % 3 else f"cold{i % 5}",
            }
            for i in range(n)
        ],
    )
    return chg, inc


def test_counts_equal_pairs_on_a_hot_service(spark):
    chg, inc = hot(spark, 240)
    pairs = change_incident_matches(chg, inc, 24 * 3600, ["change_id", "executed_at"], ["incident_id", "created_at"])
    by_pairs = {
        r.change_id: (r.four, r.all)
        for r in pairs.groupBy("change_id")
        .agg(
            F.count(F.when(F.col("created_at") <= F.col("executed_at") + F.expr("INTERVAL 4 HOURS"), 1)).alias("four"),
            F.count("*").alias("all"),
        )
        .collect()
    }
    counted = silver.with_following_incidents(chg, inc)
    got = {r.change_id: (r.incidents_within_4h, r.incidents_within_24h) for r in counted.collect()}
    assert {k: v for k, v in got.items() if v != (0, 0)} == by_pairs
    # brute force over all combinations
    a, b = chg.collect(), inc.collect()
    for c in a[::17]:
        want = sum(
            c.executed_at <= i.created_at <= c.executed_at + timedelta(hours=24)
            and (i.root_service == c.service or c.service in i.impacted_services)
            for i in b
        )
        assert got[c.change_id][1] == want


def test_hot_service_is_spread_over_slots(spark):
    """No window partition of the count holds more than an hour of one service."""
    chg, inc = hot(spark, 60)
    plan = plan_of(following_counts(chg, inc, {"h": 3600}))
    assert "windowspecdefinition(service" in plan and "slot" in plan


def test_alerts_without_incident_do_not_meet_in_one_partition(spark):
    from helpers import alerts

    df = alerts(spark, *[{"alert_id": f"A{i}"} for i in range(400)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flagged = silver.alert_incident_flags(df, incidents(spark, {}))
        sizes = [r[1] for r in flagged.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1 and max(sizes) < 300


def test_metric_windows_by_hour_equal_direct_join(spark, inputs):
    """Whole hours from the rollup and edge hours from the points add up to the direct answer."""
    inc = inputs.incidents.withColumn("resolved_at", F.when(F.col("mttr_minutes") % 2 == 0, F.col("resolved_at")))
    got = insight.incident_metrics_window(inc, inputs.metrics).groupBy("incident_id").agg(F.count("*").alias("n"))
    start = F.col("created_at") - F.expr("INTERVAL 12 HOURS")
    end = F.coalesce(F.col("resolved_at") + F.expr("INTERVAL 12 HOURS"), F.col("created_at") + F.expr("INTERVAL 24 HOURS"))
    direct = (
        inc.join(inputs.metrics.withColumnRenamed("service_name", "root_service"), "root_service")
        .where(F.col("event_timestamp").between(start, end))
        .groupBy("incident_id")
        .agg(F.count_distinct(F.date_trunc("hour", "event_timestamp")).alias("n"))
    )
    assert rows_by(got, "incident_id") == rows_by(direct, "incident_id")


def test_shared_folder_is_required_on_a_cluster():
    from opsignal import session

    class Conf:
        def get(self, _name, default):
            return default

    class Context:
        master = "spark://cluster"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())


def test_a_window_of_days_reads_only_their_folders(spark, tmp_path):
    from opsignal.plans.serve import metrics_window
    from opsignal.sources.tables import write_table

    rows = [("svc", T0 + timedelta(days=i), "system.cpu.utilization", float(i), None, None) for i in range(4)]
    points = spark.createDataFrame(
        rows, "service_name string, event_timestamp timestamp, metric_name string, metric_value double, histogram_count long, histogram_sum double"
    )
    table = write_table(points.withColumn("event_date", F.to_date("event_timestamp")), str(tmp_path / "m"), partition_by="event_date")
    day = str((T0 + timedelta(days=1)).date())
    window = metrics_window(table, "svc", f"{day} 00:00:00", f"{day} 23:59:59")
    assert "PartitionFilters: []" not in plan_of(window) and "PartitionFilters: [isnotnull(event_date" in plan_of(window)
    assert window.count() == 1


def test_no_set_or_list_is_gathered_from_raw_rows(spark, inputs):
    from opsignal.plans import gold

    for df in (
        gold.impacted_services_by_pattern(inputs.incidents),
        gold.domain_incidents_daily(inputs.scored),
        gold.pattern_stats(inputs.scored),
        silver.correlated_alerts(inputs.alerts),
    ):
        text = plan_of(df)
        first = [x for x in text.splitlines() if "Aggregate(" in x][-1]
        assert "HashAggregate" in first and "ObjectHash" not in first, text
