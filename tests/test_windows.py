"""Sweeps and running counts against direct comparison of all pairs."""

from __future__ import annotations

import random
from datetime import timedelta

from helpers import T0, changes, incidents
from pyspark.sql import functions as F

from opsignal.plans import gold, insight, serve, silver

CPU, LATENCY = serve.CPU, serve.LATENCY
POINT = "service_name string, event_timestamp timestamp, metric_name string, metric_value double, histogram_count long, histogram_sum double"


def points(spark, seed=4, n=1500):
    rnd = random.Random(seed)
    names = [CPU, serve.MEMORY, serve.ACTIVE, LATENCY, "other"]
    rows = []
    for _ in range(n):
        at = T0 + timedelta(microseconds=rnd.choice([1, 1_000, 1_000_000, 60_000_000]) * rnd.randrange(-4000, 4000))
        rows.append((rnd.choice(["a", "a", "b"]), at, rnd.choice(names), rnd.randrange(100) / 4, rnd.randrange(3), rnd.randrange(50) / 2))
    rows += [("a", T0, CPU, 99.0, None, None)] * 3 + [(None, T0, CPU, 1.0, None, None), ("a", None, CPU, 1.0, None, None)]
    return rows


def cases(rnd):
    """Created and resolved: windows over days, inside one hour, of one instant, on whole hours, turned round, still open."""
    day = timedelta(hours=24)
    out = [(T0, None), (T0, T0), (T0 + timedelta(hours=12), T0 - timedelta(hours=12)), (T0, T0 - day), (T0, T0 - day - timedelta(seconds=1))]
    for _ in range(120):
        made = T0 + timedelta(hours=12, microseconds=rnd.choice([1, 1_000_000, 60_000_000]) * rnd.randrange(-400, 400))
        out.append((made, made - day + timedelta(microseconds=rnd.choice([0, 1, 7, 900, 10**6, 10**9, 4 * 10**9]) * rnd.randint(0, 3))))
        out.append((made, made + timedelta(minutes=rnd.randrange(-100, 3000))))
    return out


def test_metric_windows_against_all_points(spark):
    rnd = random.Random(1)
    rows = points(spark)
    made = [
        {"incident_id": f"I{i}", "created_at": c, "resolved_at": r, "root_service": rnd.choice(["a", "a", "b", "c"]) if i > 5 else "a"}
        for i, (c, r) in enumerate(cases(rnd))
    ] + [{"incident_id": "none", "root_service": None}]
    got = insight.incident_metrics_window(incidents(spark, *made), spark.createDataFrame(rows, POINT))
    mine = {(r.incident_id, r.hour_ts): (r.cpu_pct, r.mem_pct, r.active_requests, r.avg_latency_ms) for r in got.collect()}
    want, inside_one_hour = {}, 0
    for inc in made[:-1]:
        start = inc["created_at"] - timedelta(hours=12)
        end = inc["resolved_at"] + timedelta(hours=12) if inc["resolved_at"] else inc["created_at"] + timedelta(hours=24)
        hours = {}
        for name, at, metric, value, n, total in rows:
            if name == inc["root_service"] and at and start <= at <= end:
                hours.setdefault(at.replace(minute=0, second=0, microsecond=0), []).append((metric, value, n, total))
        inside_one_hour += bool(hours) and end - start < timedelta(hours=1)
        for hour, held in hours.items():
            top = lambda m: max((v for x, v, _, _ in held if x == m), default=None)  # noqa: B023, E731
            count = sum(n for x, _, n, _ in held if x == LATENCY)
            total = sum(t for x, _, _, t in held if x == LATENCY)
            want[inc["incident_id"], hour] = (top(CPU), top(serve.MEMORY), top(serve.ACTIVE), total / count if count else None)
    assert set(mine) == set(want) and len(want) > 500 and inside_one_hour > 15
    for k, values in want.items():
        for a, b, tolerance in zip(mine[k], values, (0.051, 0.051, 0.51, 0.051)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= tolerance), (k, mine[k], values)


def test_metric_windows_join_rollups_only(spark, inputs):
    """One join, whose sides are exploded hours and the rollup; ends and points meet in a union."""
    plan = insight.incident_metrics_window(inputs.incidents, inputs.metrics)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert len(joins) == 1, plan
    below = plan[plan.index(joins[0]) :]
    assert "Aggregate" in below.split("Generate explode")[1]


def spread(spark, n=90, seed=3):
    rnd = random.Random(seed)
    services = ["hot", "hot", "b", "c"]
    when = lambda: T0 + timedelta(seconds=rnd.randrange(0, 200_000), microseconds=rnd.choice([0, 0, 1, 999_999]))
    chg = [
        {"change_id": f"C{i:03}", "executed_at": when(), "service": rnd.choice(services), "risk_level": rnd.choice(["high", "medium", "low"]),
         "change_type": rnd.choice(["deployment", "database_migration", "never_followed", "config"])}
        for i in range(n)
    ]
    inc = [
        {"incident_id": f"I{i:03}", "created_at": when(), "root_service": rnd.choice(services), "revenue_impact_usd": rnd.choice([None, 10.5, 2000.0]),
         "impacted_services": rnd.sample(["hot", "b", "c"], rnd.randrange(3))}
        for i in range(n)
    ]
    # exactly at the borders of the window and of the lag classes
    for k, lag in enumerate([0, 30 * 60, 31 * 60, 31 * 60 - 1, 121 * 60, 120 * 60, 481 * 60, 24 * 3600, 24 * 3600 + 1]):
        chg.append({"change_id": f"X{k}", "executed_at": T0 - timedelta(days=40 - k), "service": "edge", "risk_level": "high", "change_type": "deployment"})
        inc.append({"incident_id": f"E{k}", "created_at": T0 - timedelta(days=40 - k) + timedelta(seconds=lag), "root_service": "edge", "impacted_services": None})
    return silver.scored_changes(changes(spark, *chg)), incidents(spark, *inc)


def test_risky_types_equal_the_pairs(spark):
    chg, inc = spread(spark)
    pairs = gold.change_incident_pairs(chg, inc)
    want = {
        r.change_type: (r.n, r.impact)
        for r in pairs.groupBy("change_type").agg(F.count_distinct("incident_id").alias("n"), F.sum("revenue_impact_usd").alias("impact")).collect()
    }
    made = {r.change_type: r["count"] for r in chg.groupBy("change_type").count().collect()}
    got = {r.change_type: r for r in serve.risky_change_types(chg, inc).collect()}
    assert set(got) == set(made) and sum(n for n, _ in want.values()) > 100
    for kind, r in got.items():
        n, impact = want.get(kind, (0, 0.0))
        assert (r.total_changes, r.incidents_caused, r.total_revenue_impact) == (made[kind], n, round(impact or 0, 2))
    totals = insight.change_totals(serve.risky_change_types(chg, inc)).first()
    assert totals.incidents_caused == sum(n for n, _ in want.values())


def test_strongest_pairs_without_the_others(spark, monkeypatch):
    chg, inc = spread(spark)
    from opsignal.functions import scoring

    every = gold.change_incident_pairs(chg, inc).withColumn("correlation_strength", scoring.correlation_strength())
    rows = sorted(((-r.correlation_strength, r.change_id, r.incident_id) for r in every.collect()))
    built = []
    real = serve.change_incident_pairs
    monkeypatch.setattr(serve, "change_incident_pairs", lambda c, i: built.append(real(c, i)) or built[-1])
    for least, limit in ((0.5, 50), (0.5, 3), (0.1, 20), (0.0, 100_000), (9.0, 50)):
        got = [(-r.correlation_strength, r.change_id, r.incident_id) for r in serve.high_correlation(chg, inc, least, limit).collect()]
        assert got == [x for x in rows if -x[0] >= least][:limit], (least, limit)
    assert len(rows) > 600 and built[1].count() < len(rows) / 10 and built[0].count() < len(rows)


def test_no_pair_table_behind_the_totals(spark, inputs):
    """Changes and incidents meet in ordered lines; what is joined is one row a key and slot."""
    plan = serve.risky_change_types(inputs.scored_changes, inputs.incidents)._jdf.queryExecution().optimizedPlan().toString()
    assert "executed_at" not in " ".join(x for x in plan.splitlines() if "Join " in x)
    assert plan.count("Window") >= 2
