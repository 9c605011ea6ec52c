"""Joins and counts between changes and the incidents that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nested import touched_services
from .lookups import attach

MICROS = 1_000_000


def per_service(incidents: DataFrame, *keep: str) -> DataFrame:
    """One row per incident and touched service (root or impacted)."""
    return incidents.select(*keep, F.explode(touched_services()).alias("service"))


def _slot(ts: str, seconds: int) -> Column:
    at = F.unix_seconds(ts)
    return at - F.pmod(at, F.lit(seconds))


def change_incident_matches(
    changes: DataFrame, incidents: DataFrame, within_seconds: int, change_cols: list[str], incident_cols: list[str]
) -> DataFrame:
    """Every (change, incident) with ``executed_at <= created_at <= executed_at + window`` on a touched service.

    "Service is the root or is impacted" becomes an equality by listing the touched services, and the
    time range becomes an equality on a slot as wide as the window: an incident sits in one slot, a
    change looks into its own and the next. Both conditions together are a hashable join key, each
    pair meets once, and adaptive execution can split a slot that is too full.
    """
    left = changes.select("service", *change_cols).withColumn("_slot0", _slot("executed_at", within_seconds))
    left = left.withColumn("_slot", F.explode(F.array("_slot0", F.col("_slot0") + within_seconds))).drop("_slot0")
    right = per_service(incidents, *incident_cols).withColumn("_slot", _slot("created_at", within_seconds))
    reach = F.col("executed_at") + F.make_dt_interval(secs=F.lit(within_seconds))
    joined = left.join(right, ["service", "_slot"]).where(
        (F.col("created_at") >= F.col("executed_at")) & (F.col("created_at") <= reach)
    )
    return joined.drop("_slot")


def running_counts(points: DataFrame, probes: DataFrame, key: list[str], slot_seconds: int = 3600) -> DataFrame:
    """``probes`` (key, pos, turn, any others) with ``upto``: the sum of ``n`` over the ``points`` (key, pos, n) of
    the key that lie before ``pos`` (turn 0), or before or at it (turn 2). Positions are microseconds.

    The running count is taken inside short (key, slot) groups with the totals of the earlier slots added, so a key
    that holds most of the rows is still spread over its slots. No pair is built.
    """
    slot = f"pos - pmod(pos, {slot_seconds * MICROS}L) AS slot"
    payload = {c: t for c, t in probes.dtypes if c not in (*key, "pos", "turn")}
    line = points.selectExpr(*key, slot, "pos", "1 AS turn", "n", *[f"cast(NULL AS {t}) AS {c}" for c, t in payload.items()])
    line = line.unionByName(probes.selectExpr(*key, slot, "pos", "turn", "0L AS n", *payload))
    inside = Window.partitionBy(*key, "slot").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    running = line.withColumn("run", F.sum("n").over(inside)).where("turn <> 1")

    # one row per key and slot: bounded by the time span, not by the number of events
    totals = line.groupBy(*key, "slot").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, "slot", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return running.join(offsets, [*key, "slot"]).select(*key, "pos", "turn", *payload, (F.col("run") + F.col("base")).alias("upto"))


def following(changes: DataFrame, events: DataFrame, horizons: dict[str, int], slot_seconds: int = 3600) -> DataFrame:
    """Per (service, executed_at): ``events`` (service, created_at) within each horizon, both ends included.

    Horizons are microseconds. A window count is a difference of two running counts. Events are
    pre-aggregated per service and instant, and probes are one per distinct change instant.
    """
    instants = events.groupBy("service", F.unix_micros("created_at").alias("pos")).agg(F.count("*").alias("n"))
    asked = changes.where(F.col("service").isNotNull()).select("service", F.unix_micros("executed_at").alias("at")).distinct()
    # turn 0 stands before the incidents of the same instant, turn 2 after them
    marks = [("before", 0, 0), *[(name, ahead, 2) for name, ahead in horizons.items()]]
    structs = ", ".join(f"named_struct('probe', '{n}', 'pos', at + {ahead}L, 'turn', {turn})" for n, ahead, turn in marks)
    answered = running_counts(instants, asked.selectExpr("service", "at", f"inline(array({structs}))"), ["service"], slot_seconds)
    count_at = "max(CASE WHEN probe = '{}' THEN upto END)"
    counts = [F.expr(f"{count_at.format(h)} - {count_at.format('before')}").alias(h) for h in horizons]
    return answered.groupBy("service", "at").agg(*counts).select("service", F.timestamp_micros("at").alias("executed_at"), *horizons)


def following_counts(changes: DataFrame, incidents: DataFrame, horizons: dict[str, int], slot_seconds: int = 3600) -> DataFrame:
    """Per (service, executed_at): incidents on a touched service created within each horizon, in seconds."""
    return following(changes, per_service(incidents, "created_at"), {h: s * MICROS for h, s in horizons.items()}, slot_seconds)


def preceding_by_type(changes: DataFrame, incidents: DataFrame, within_seconds: int, keep: str) -> DataFrame:
    """(incident_id, change_type, ``keep``, n): how many changes of each type were made on a service that the incident
    touches, up to ``within_seconds`` before it; only where there are any.

    An incident asks once for every type that its services ever saw: two running counts of the type, at its own time
    and at the start of the window.
    """
    typed = changes.where("service IS NOT NULL AND change_type IS NOT NULL AND executed_at IS NOT NULL")
    points = typed.groupBy("service", "change_type", F.unix_micros("executed_at").alias("pos")).agg(F.count("*").alias("n"))
    types = typed.groupBy("service", "change_type").agg(F.lit(1)).groupBy("service").agg(F.collect_list("change_type").alias("types"))
    asked = attach(per_service(incidents, "incident_id", "created_at", keep), types, "service")
    asked = asked.select("incident_id", keep, "service", F.unix_micros("created_at").alias("at"), F.explode("types").alias("change_type"))
    ends = f"named_struct('pos', at - {within_seconds * MICROS}L, 'turn', 0, 'sign', -1), named_struct('pos', at, 'turn', 2, 'sign', 1)"
    probes = asked.selectExpr("service", "change_type", "incident_id", keep, f"inline(array({ends}))")
    counted = running_counts(points, probes, ["service", "change_type"])
    per_incident = counted.groupBy("incident_id", "change_type", keep).agg(F.sum(F.col("sign") * F.col("upto")).alias("n"))
    return per_incident.where("n > 0")
