"""Derived views for charts: overlays, normalised radars, incident metric windows, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_if
from .serve import MERGED, hour_label, window_parts, window_values


def daily_overlay(changes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Changes, high-risk changes and incidents per day with any of them."""
    made = changes.select(F.to_date("executed_at").alias("date"), F.lit(True).alias("c"), (F.col("risk_level") == "high").alias("h"))
    seen = incidents.select(F.to_date("created_at").alias("date"), F.lit(False).alias("c"), F.lit(False).alias("h"))
    return made.unionByName(seen).groupBy("date").agg(
        count_if(F.col("c")).alias("changes"),
        count_if(F.col("h")).alias("high_risk"),
        count_if(~F.col("c")).alias("incidents"),
    )


# Radar axis names and the pattern columns behind them.
RADAR = {
    "Frequency": "occurrence_count",
    "MTTR": "avg_mttr_minutes",
    "Blast Radius": "avg_blast_radius",
    "Revenue": "total_revenue_impact",
    "User Impact": "total_affected_users",
    "SLA Breaches": "sla_breach_count",
}


def radar_normalize(patterns: DataFrame, key: list[str]) -> DataFrame:
    """Six measures of every pattern as a percentage of the largest one (at least 1)."""
    tops = patterns.agg(
        F.struct(*[F.greatest(F.max(c).cast("double"), F.lit(1.0)).alias(c) for c in RADAR.values()]).alias("t")
    ).scalar()
    axes = [
        F.struct(
            F.lit(name).alias("metric"),
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / tops[c] * 100).alias("value"),
        )
        for name, c in RADAR.items()
    ]
    return patterns.select(*key, F.inline(F.array(*axes)))


#: A block of this power of two, in microseconds, holds a whole hour.
HOUR_BLOCK = 32


def _edges(windows: DataFrame, instants: DataFrame) -> DataFrame:
    """(incident_id, service_name, hour_ts, parts) of the first and the last hour of each window.

    A sweep over the points of a (service, hour) with the ends of windows among them: running maxima and sums
    from the right answer a start, those from the left an end. Both edges of a window inside one hour are cut
    apart at the roundest instant between them and answered in the blocks beside it; points are laid into such
    smaller blocks only where an end asks for them. Ends and points meet in one line, not in a join.
    """
    first, last = F.date_trunc("hour", "_start"), F.date_trunc("hour", "_end")
    since = lambda ts, hour: F.unix_micros(ts) - F.unix_micros(hour)
    start, end = since(F.col("_start"), first), since(F.col("_end"), last)
    apart = F.when((first == last) & (start > 0), F.length(F.bin(start.bitwiseXOR(end))) - 1).otherwise(HOUR_BLOCK)
    alike = (first == last) & (start == end)

    def mark(hour, at, turn, block):
        return F.struct(hour.alias("hour_ts"), at.alias("at"), F.lit(turn).alias("turn"), F.when(alike & (start > 0), 0).otherwise(block).alias("block"))

    from_start = F.when((start > 0) & ~alike, mark(first, start, -1, apart))
    ends = windows.select(
        "incident_id", "service_name", F.inline(F.array_compact(F.array(from_start, mark(last, end, 1, apart))))
    )
    nothing = {c: t for c, t in instants.dtypes if c in MERGED}
    line = ends.select(
        "incident_id", "service_name", "hour_ts", "at", "turn", "block", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
    ).unionByName(
        instants.select(
            F.lit(None).cast("string").alias("incident_id"), "service_name", "hour_ts", "at", F.lit(0).alias("turn"), F.lit(None).cast("int").alias("block"), *nothing
        )
    )
    # the sizes of the blocks that ends ask for in this hour, as bits
    asked = F.bit_or(F.expr("shiftleft(1L, block)")).over(Window.partitionBy("service_name", "hour_ts"))
    wanted = F.filter(F.sequence(F.lit(0), F.lit(HOUR_BLOCK)), lambda k: F.call_function("shiftright", F.col("_asked"), k) % 2 == 1)
    line = line.withColumn("_asked", asked).where("_asked IS NOT NULL")
    line = line.withColumn("block", F.explode(F.when(F.col("turn") == 0, wanted).otherwise(F.array("block"))))
    line = line.withColumn("_cell", F.expr("shiftright(at, block)"))
    cell = Window.partitionBy("service_name", "hour_ts", "block", "_cell")
    # an end comes after the points of its own instant, from either side
    later = F.abs("turn")
    left = cell.orderBy("at", later).rowsBetween(Window.unboundedPreceding, 0)
    right = cell.orderBy(F.desc("at"), later).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("turn") == 0
    swept = [F.when(F.col("turn") > 0, m(c).over(left)).otherwise(m(c).over(right)).alias(c) for c, m in MERGED.items()]
    seen = F.when(F.col("turn") > 0, F.count_if(own).over(left)).otherwise(F.count_if(own).over(right))
    answered = line.select("incident_id", "service_name", "hour_ts", "turn", seen.alias("_seen"), *swept).where("turn <> 0 AND _seen > 0")
    return answered.groupBy("incident_id", "service_name", "hour_ts").agg(*[m(c).alias(c) for c, m in MERGED.items()])


def incident_metrics_window(incidents: DataFrame, metrics: DataFrame) -> DataFrame:
    """Hourly metrics of the root service around every incident.

    The window runs from 12 h before creation to 12 h after resolution, or 24 h after creation while
    open. Points are first merged by service and instant. Whole hours inside a window read one
    pre-aggregated row per service and hour; its first and last hour are answered by a sweep.
    """
    start = F.col("created_at") - F.make_dt_interval(hours=F.lit(12))
    end = F.coalesce(
        F.col("resolved_at") + F.make_dt_interval(hours=F.lit(12)),
        F.col("created_at") + F.make_dt_interval(hours=F.lit(24)),
    )
    windows = incidents.where(F.col("root_service").isNotNull()).select(
        "incident_id", F.col("root_service").alias("service_name"), start.alias("_start"), end.alias("_end")
    ).where("_start <= _end")
    hour = F.date_trunc("hour", "event_timestamp")
    key = ["service_name", "hour_ts"]
    at = (F.unix_micros("event_timestamp") - F.unix_micros(hour)).alias("at")
    named = metrics.where("service_name IS NOT NULL AND event_timestamp IS NOT NULL")
    instants = named.groupBy("service_name", hour.alias("hour_ts"), at).agg(*window_parts())
    rollup = instants.groupBy(*key).agg(*[m(c).alias(c) for c, m in MERGED.items()])

    an_hour = F.make_dt_interval(hours=F.lit(1))
    hours = windows.select(
        "incident_id", "service_name", "_start", F.date_trunc("hour", "_end").alias("_last"),
        F.explode(F.sequence(F.date_trunc("hour", "_start"), F.date_trunc("hour", "_end"), an_hour)).alias("hour_ts"),
    ).where("hour_ts >= _start AND hour_ts <> _last")
    inner = hours.select("incident_id", *key).join(rollup, key)
    return inner.unionByName(_edges(windows, instants)).select(
        "incident_id", "service_name", "hour_ts", hour_label("hour_ts").alias("hour_label"), *window_values()
    )


def incident_hour_bounds(incidents: DataFrame) -> DataFrame:
    """Hour marks that frame an incident on an hourly chart."""

    def floor_hour(ts: Column) -> Column:
        return F.date_trunc("hour", ts)

    an_hour = F.make_dt_interval(hours=F.lit(1))
    end = F.coalesce("resolved_at", "created_at") + an_hour
    return incidents.select(
        "incident_id",
        hour_label(floor_hour(F.col("created_at"))).alias("start_hour"),
        hour_label(floor_hour(end)).alias("end_hour"),
    )


def risk_scatter(services: DataFrame) -> DataFrame:
    """Services with incidents of their own: count, revenue, blast (missing or zero as 1), risk."""
    blast = F.col("avg_blast_radius")
    return services.where("incident_count_as_root > 0").select(
        F.col("service_name").alias("name"),
        F.col("incident_count_as_root").alias("x"),
        F.coalesce("total_revenue_impact", F.lit(0.0)).alias("y"),
        F.when(blast != 0, blast).otherwise(F.lit(1.0)).alias("z"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk"),
    )


def change_totals(risky_types: DataFrame) -> DataFrame:
    return risky_types.agg(
        F.coalesce(F.sum("total_changes"), F.lit(0)).alias("total_changes"),
        F.coalesce(F.sum("incidents_caused"), F.lit(0)).alias("incidents_caused"),
    )
