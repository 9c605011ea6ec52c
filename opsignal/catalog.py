"""Every operator as a named query over the generated tables.

A query takes (spark, sf_dir), derives its inputs from the parquet tables and returns columns in a
form two engines print alike: times and dates as text, lists sorted and joined, fractions rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures as fx
from .functions.nested import attribute, parse_service_list
from .functions.numbers import half_up_sql, humanize, humanize_currency
from .functions import scoring
from .functions.times import calendar, whole_minutes
from .plans import build, gold, graph, impact, insight, serve, silver
from .schemas import KEYS, RAW_LOGS, REFRESH, SNAPSHOT, TRIGGERED
from .session import cut_lineage, new_folder, stored
from .sources import binary, documents, tables, versions
from .streaming.events import BATCH, incremental_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A figure by which the rows of a written table are compared.
FIGURES = {
    "silver_incidents": "impact_score",
    "silver_alerts": "duration_minutes",
    "silver_changes": "incidents_within_24h",
    "silver_service_health": "health_score",
    "silver_business_impact": "weighted_downtime_minutes",
    "silver_servicenow_correlation": "duplicate_pct",
    "gold_root_cause_patterns": "priority_score",
    "gold_service_risk_ranking": "risk_score",
    "gold_change_incident_correlation": "correlation_strength",
    "gold_domain_impact_summary": "domain_risk_score",
    "gold_business_impact_summary": "total_revenue_impact",
}

# Parameters of the parameterised queries; the SQL side uses the same.
SERVICE, DOMAIN, PATTERN, DAYS = "svc-7", "application", "FP-7", 20


def tidy(df: DataFrame) -> DataFrame:
    """Columns in a form that does not depend on the engine."""

    def plain(field: T.StructField) -> str:
        c, t = f"`{field.name}`", field.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = half_up_sql(c, 4)
        elif isinstance(t, T.TimestampType):
            c = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        elif isinstance(t, T.DateType):
            c = f"cast({c} AS string)"
        elif isinstance(t, T.ArrayType):
            if isinstance(t.elementType, T.StructType):
                parts = ", ".join(f"cast(s.{n} AS string)" for n in t.elementType.names)
                c = f"transform({c}, s -> concat_ws('|', {parts}))"
            c = f"array_join(sort_array({c}), ',')"
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = f"cast({c} AS bigint)"
        return f"{c} AS `{field.name}`"

    return df.selectExpr(*[plain(f) for f in df.schema.fields])


def query(fn: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
    return fn


class Inputs:
    """Bronze inputs and the silver and gold plans over them, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def bronze(self, name: str) -> DataFrame:
        return self._once(name, lambda: getattr(fx, name)(self.spark, self.sf_dir))

    incidents = property(lambda s: s.bronze("incidents"))
    alerts = property(lambda s: s.bronze("alerts"))
    changes = property(lambda s: s.bronze("changes"))
    metrics = property(lambda s: s.bronze("metrics"))
    logs = property(lambda s: s.bronze("logs"))
    flows = property(lambda s: s.bronze("flows"))
    traces = property(lambda s: s.bronze("traces"))

    # silver incidents without the joined columns: what the aggregates read
    scored = property(lambda s: s._once("scored", lambda: silver.scored_incidents(s.incidents)))
    silver_incidents = property(
        lambda s: s._once("si", lambda: silver.silver_incidents(s.incidents, s.alerts, s.changes))
    )
    silver_alerts = property(lambda s: s._once("sa", lambda: silver.silver_alerts(s.alerts, s.incidents)))
    scored_changes = property(lambda s: s._once("sc0", lambda: silver.scored_changes(s.changes)))
    silver_changes = property(lambda s: s._once("sc", lambda: silver.silver_changes(s.changes, s.incidents)))
    health = property(lambda s: s._once("sh", lambda: silver.silver_service_health(s.metrics, s.incidents, s.logs)))
    tickets = property(lambda s: s._once("st", lambda: silver.silver_servicenow_correlation(s.incidents)))
    patterns = property(lambda s: s._once("gp", lambda: gold.root_cause_patterns(s.scored)))
    plain_patterns = property(lambda s: s._once("gp0", lambda: gold.plain_patterns(s.scored)))
    services = property(lambda s: s._once("gs", lambda: gold.service_risk(s.scored, s.health, s.silver_changes)))
    ranking = property(lambda s: s._once("gr", lambda: gold.with_risk_rank(s.services)))
    pairs = property(lambda s: s._once("pairs", lambda: gold.change_incident_pairs(s.scored_changes, s.scored)))
    correlation = property(
        lambda s: s._once("gc", lambda: gold.change_incident_correlation(s.scored_changes, s.scored))
    )
    domains = property(
        lambda s: s._once("gd", lambda: gold.domain_impact_summary(s.scored, s.silver_alerts, s.silver_changes))
    )
    units = property(lambda s: s._once("gu", lambda: gold.business_impact_summary(s.scored)))
    # the days of derived tables, read off their sources: a window over a plan needs no second run of it
    health_days = property(
        lambda s: s.metrics.where((F.col("metric_name") == silver.CPU) & F.col("service_name").isNotNull()).select(
            F.to_date("event_timestamp").alias("health_date")
        )
    )
    domain_days = property(
        lambda s: reduce(
            DataFrame.unionByName,
            [df.select(F.to_date(c).alias("summary_date")) for df, c in
             ((s.incidents, "created_at"), (s.alerts, "fired_at"), (s.changes, "executed_at"))],
        )
    )
    edges = property(lambda s: s._once("edges", lambda: graph.topology_edges(s.flows, s.incidents)))
    service_domains = property(
        lambda s: s._once("sd", lambda: graph.service_domain_mode(s.incidents, s.alerts, s.changes))
    )
    nodes = property(lambda s: s._once("nodes", lambda: graph.topology_nodes(s.ranking, s.service_domains)))
    relationships = property(
        lambda s: s._once("rel", lambda: impact.service_relationships(fx.service_profiles(s.spark, s.sf_dir)))
    )
    models = property(lambda s: s._once("models", lambda: fx.impact_models(s.spark, s.sf_dir)))


# Sources ---------------------------------------------------------------------------------------


def landed(files: DataFrame) -> DataFrame:
    """Encoded payloads stored once; Spark has no writer for binary files."""
    return cut_lineage(files)


@query
def i1_ingest_otlp_metrics(spark, sf_dir):
    """Read by the file source from files of many documents."""
    landing = fx.land_files(fx.metric_files(spark, sf_dir), new_folder(spark, "metrics"))
    return binary.metrics_table(binary.decode_metrics(binary.read_files(spark, landing)))


@query
def i2_ingest_network_flows(spark, sf_dir):
    return binary.flows_table(binary.decode_flows(landed(fx.flow_files(spark, sf_dir))))


def _ingested(spark, sf_dir, table):
    """Documents written to files, then read by the file source."""
    landing = fx.land(fx.LANDING[table](spark, sf_dir), new_folder(spark, "landing"))
    return documents.ingest(spark, table, landing)


@query
def i3_ingest_logs(spark, sf_dir):
    return _ingested(spark, sf_dir, "bronze_logs")


@query
def i4_ingest_traces(spark, sf_dir):
    return _ingested(spark, sf_dir, "bronze_traces")


@query
def i5_ingest_incidents(spark, sf_dir):
    return _ingested(spark, sf_dir, "bronze_incidents")


@query
def i6_ingest_alerts(spark, sf_dir):
    return _ingested(spark, sf_dir, "bronze_alerts")


@query
def i7_ingest_changes(spark, sf_dir):
    return _ingested(spark, sf_dir, "bronze_topology_changes")


@query
def i8_attr_lookup(spark, sf_dir):
    landing = fx.land(fx.log_documents(spark, sf_dir), new_folder(spark, "landing"))
    docs = documents.read_documents(spark, landing, RAW_LOGS)
    resource = F.col("resourceLogs")[0]
    record = resource["scopeLogs"][0]["logRecords"][0]
    return docs.select(
        record["traceId"].alias("trace_id"),
        attribute(resource["resource"]["attributes"], "service.name").alias("service_name"),
        attribute(record["attributes"], "failure_pattern").alias("failure_pattern_id"),
        attribute(record["attributes"], "no.such.key").alias("missing"),
    )


@query
def i9_decode_summary(spark, sf_dir):
    files = landed(fx.metric_files(spark, sf_dir))
    summary = binary.decode_summary(binary.decode_metrics(files), files)
    return summary.select("path", "service_name", "points", (F.col("size_kb") > 0).alias("has_size"))


@query
def k1_table_sink(spark, sf_dir):
    written = tables.write_table(Inputs(spark, sf_dir).alerts, new_folder(spark, "alerts"), "ingested_at")
    return written.withColumn("ingested_at", F.col("ingested_at").isNotNull())


@query
def k2_keyed_sync(spark, sf_dir):
    """A copy from before medium-risk changes arrived, network rows were corrected and deployments left."""
    source = Inputs(spark, sf_dir).scored_changes
    older = source.where("risk_level <> 'medium'").withColumn(
        "executed_by", F.when(F.col("domain") == "network", "unknown").otherwise(F.col("executed_by"))
    )
    current = source.where("change_type <> 'deployment'")
    key, policy = KEYS["silver_changes"], REFRESH["silver_changes"]
    copy = new_folder(spark, "copy")
    tables.sync_copy(spark, older, copy, key, SNAPSHOT)
    done = tables.sync_copy(spark, current, copy, key, policy)
    assert policy == TRIGGERED
    after = versions.read_table(spark, copy)
    state = after.agg(F.lit("rows after").alias("op"), F.count("*").alias("n"))
    left = tables.changes_since(current, after, key)
    return done.unionByName(state).unionByName(left.agg(F.lit("still different").alias("op"), F.count("*").alias("n")))


@query
def q1_pk_check(spark, sf_dir):
    """The alert table against a key it does not have: ids of incidents repeat and are missing."""
    return tables.key_violations(Inputs(spark, sf_dir).alerts, ["incident_id"])


def _all_tables(spark, sf_dir):
    return build.derive(fx.bronze(spark, sf_dir), {**build.SILVER, **build.GOLD})


@query
def q1_key_audit(spark, sf_dir):
    """Every table with a declared key."""
    return tables.key_audit(_all_tables(spark, sf_dir), KEYS)


@query
def q2_row_count_audit(spark, sf_dir):
    return tables.row_counts(_all_tables(spark, sf_dir))


@query
def q3_metric_profile(spark, sf_dir):
    types, services = tables.metric_profile(Inputs(spark, sf_dir).metrics)
    by_type = types.select(F.lit("metric_type").alias("profile"), F.col("metric_type").alias("name"),
                           F.col("count").alias("points"), F.lit(None).cast("bigint").alias("distinct_metrics"))
    by_service = services.select(F.lit("service").alias("profile"), F.col("service_name").alias("name"),
                                 F.col("data_points").alias("points"), "distinct_metrics")
    return by_type.unionByName(by_service)


@query
def q4_random_sample(spark, sf_dir):
    return tables.random_sample(Inputs(spark, sf_dir).alerts, ["alert_id"])


# Silver ----------------------------------------------------------------------------------------


@query
def s1_severity_level(spark, sf_dir):
    return Inputs(spark, sf_dir).incidents.select("incident_id", scoring.severity_level().alias("severity_level"))


@query
def s2_calendar_parts(spark, sf_dir):
    parts = ("date", "hour", "day_of_week", "week", "month", "year")
    return Inputs(spark, sf_dir).incidents.select("incident_id", *calendar("created_at", "incident", parts))


@query
def s3_correlated_alerts(spark, sf_dir):
    return silver.correlated_alerts(Inputs(spark, sf_dir).alerts)


@query
def s4_preceding_changes(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return silver.preceding_changes(t.incidents, t.changes)


@query
def s4_incident_changes(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return silver.incident_changes(t.incidents, t.changes)


@query
def s4_change_counts(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return silver.change_counts(silver.incident_changes(t.incidents, t.changes))


@query
def s5_impact_score(spark, sf_dir):
    return Inputs(spark, sf_dir).incidents.select("incident_id", scoring.impact_score().alias("impact_score"))


@query
def s6_silver_incidents(spark, sf_dir):
    return Inputs(spark, sf_dir).silver_incidents


@query
def s7_alert_duration(spark, sf_dir):
    return Inputs(spark, sf_dir).alerts.select(
        "alert_id", whole_minutes("fired_at", "resolved_at").alias("duration_minutes")
    )


@query
def s8_breach_magnitude(spark, sf_dir):
    return Inputs(spark, sf_dir).alerts.select("alert_id", scoring.breach_pct().alias("breach_magnitude_pct"))


@query
def s9_alert_incident_flags(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    flags = silver.alert_incident_flags(t.alerts, t.incidents)
    return flags.select("alert_id", "is_incident_correlated", "is_pre_incident_signal")


@query
def s10_silver_alerts(spark, sf_dir):
    return Inputs(spark, sf_dir).silver_alerts


@query
def s11_change_risk_score(spark, sf_dir):
    return Inputs(spark, sf_dir).changes.select("change_id", scoring.change_risk().alias("risk_score"))


@query
def s12_incidents_after_change(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    counted = silver.with_following_incidents(t.changes, t.incidents)
    return counted.select("change_id", "incidents_within_4h", "incidents_within_24h")


@query
def s13_silver_changes(spark, sf_dir):
    return Inputs(spark, sf_dir).silver_changes


@query
def s14_daily_metrics(spark, sf_dir):
    return silver.daily_metrics(Inputs(spark, sf_dir).metrics)


@query
def s15_daily_incidents(spark, sf_dir):
    return silver.daily_incidents(Inputs(spark, sf_dir).incidents)


@query
def s16_daily_error_logs(spark, sf_dir):
    return silver.daily_error_logs(Inputs(spark, sf_dir).logs)


@query
def s17_service_health(spark, sf_dir):
    return Inputs(spark, sf_dir).health


@query
def s18_business_impact(spark, sf_dir):
    return silver.silver_business_impact(Inputs(spark, sf_dir).incidents)


@query
def s19_ticket_correlation(spark, sf_dir):
    return Inputs(spark, sf_dir).tickets


# Gold ------------------------------------------------------------------------------------------


@query
def g1_impacted_services_agg(spark, sf_dir):
    return gold.impacted_services_by_pattern(Inputs(spark, sf_dir).scored)


@query
def g2_pattern_stats(spark, sf_dir):
    return gold.pattern_stats(Inputs(spark, sf_dir).scored)


@query
def g3_weekly_trend(spark, sf_dir):
    return gold.weekly_trend(Inputs(spark, sf_dir).scored)


@query
def g4_trend_summary(spark, sf_dir):
    return gold.trend_summary(Inputs(spark, sf_dir).scored)


@query
def g5_trend_direction(spark, sf_dir):
    trend = gold.trend_summary(Inputs(spark, sf_dir).scored)
    return trend.select("failure_pattern_id", scoring.trend_direction().alias("trend_direction"))


@query
def g6_priority_score(spark, sf_dir):
    return Inputs(spark, sf_dir).patterns.select(*gold.PATTERN_GRAIN, "priority_score")


@query
def g7_recurrence_interval(spark, sf_dir):
    stats = gold.pattern_stats(Inputs(spark, sf_dir).scored)
    return stats.select(*gold.PATTERN_GRAIN, gold.days_between_occurrences().alias("avg_days_between_occurrences"))


@query
def g8_root_cause_patterns(spark, sf_dir):
    return gold.root_cause_patterns(Inputs(spark, sf_dir).scored, tidy)


@query
def g9_incident_stats(spark, sf_dir):
    return gold.incident_stats(Inputs(spark, sf_dir).scored)


@query
def g10_impacted_stats(spark, sf_dir):
    return gold.impacted_stats(Inputs(spark, sf_dir).scored)


@query
def g11_health_stats(spark, sf_dir):
    return gold.health_stats(Inputs(spark, sf_dir).health)


@query
def g12_change_stats(spark, sf_dir):
    return gold.change_stats(Inputs(spark, sf_dir).silver_changes)


@query
def g13_service_risk_ranking(spark, sf_dir):
    return Inputs(spark, sf_dir).services


@query
def g14_risk_rank(spark, sf_dir):
    return Inputs(spark, sf_dir).ranking.select("service_name", "risk_rank")


@query
def g15_change_incident_pairs(spark, sf_dir):
    return Inputs(spark, sf_dir).pairs.drop("correlation_window")


@query
def g16_correlation_window(spark, sf_dir):
    return Inputs(spark, sf_dir).pairs.select("change_id", "incident_id", "correlation_window")


@query
def g17_change_type_stats(spark, sf_dir):
    return gold.change_type_stats(Inputs(spark, sf_dir).pairs)


@query
def g18_correlation_strength(spark, sf_dir):
    pairs = Inputs(spark, sf_dir).pairs
    return pairs.select("change_id", "incident_id", scoring.correlation_strength().alias("correlation_strength"))


@query
def g19_change_incident_correlation(spark, sf_dir):
    return Inputs(spark, sf_dir).correlation


@query
def g20_domain_incidents_daily(spark, sf_dir):
    return gold.domain_incidents_daily(Inputs(spark, sf_dir).scored)


@query
def g21_domain_alerts_daily(spark, sf_dir):
    return gold.domain_alerts_daily(Inputs(spark, sf_dir).silver_alerts)


@query
def g22_domain_changes_daily(spark, sf_dir):
    return gold.domain_changes_daily(Inputs(spark, sf_dir).silver_changes)


@query
def g23_domain_impact_summary(spark, sf_dir):
    return Inputs(spark, sf_dir).domains


@query
def g24_business_impact_summary(spark, sf_dir):
    return Inputs(spark, sf_dir).units


# Serving ---------------------------------------------------------------------------------------


@query
def v1_incident_summary(spark, sf_dir):
    return serve.incident_summary(Inputs(spark, sf_dir).scored)


@query
def v2_ticket_noise(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.ticket_noise(t.tickets, t.scored, DAYS, 10)


@query
def v3_incident_timeline(spark, sf_dir):
    return serve.incident_timeline(Inputs(spark, sf_dir).scored, DAYS, severity="P2", domain=DOMAIN)


@query
def v4_recent_incidents(spark, sf_dir):
    return serve.recent_incidents(Inputs(spark, sf_dir).silver_incidents, 20)


@query
def v5_incidents_by_service(spark, sf_dir):
    return serve.incidents_by_service(Inputs(spark, sf_dir).scored)


@query
def v6_incidents_by_hour(spark, sf_dir):
    return serve.incidents_by_hour(Inputs(spark, sf_dir).scored)


@query
def v7_mttr_trend(spark, sf_dir):
    return serve.mttr_trend(Inputs(spark, sf_dir).scored, DAYS)


@query
def v8_incident_detail(spark, sf_dir):
    return serve.incident_detail(Inputs(spark, sf_dir).silver_incidents, "INC-0")


@query
def v9_patterns_by_priority(spark, sf_dir):
    return serve.patterns_by_priority(Inputs(spark, sf_dir).plain_patterns)


@query
def v10_top_systemic_issue(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.top_systemic_issue(t.plain_patterns, t.scored)


@query
def v11_pattern_timeline(spark, sf_dir):
    return serve.pattern_timeline(Inputs(spark, sf_dir).scored, PATTERN)


@query
def v12_pattern_signals(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    alerts, incidents = serve.pattern_signals(t.scored, t.silver_alerts, PATTERN)
    marked = incidents.select(F.lit("incident").alias("signal"), "incident_id", F.col("created_at").alias("seen_at"),
                              F.col("root_service").alias("service"))
    return alerts.select("*", F.lit("alert").alias("signal"), F.col("fired_at").alias("seen_at")).drop("fired_at").unionByName(
        marked, allowMissingColumns=True
    )


@query
def v13_analysis_context(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    # read by both parts
    doc = stored(serve.analysis_context(t.plain_patterns, t.services, incidents=t.scored), "context")
    pattern = T.ArrayType(t.patterns.schema)
    service = ("array<struct<service_name: string, risk_score: double, incident_count_as_root: bigint, total_revenue_impact: double, "
               "total_user_impact: bigint, avg_mttr_minutes: double, unique_failure_patterns: bigint>>")

    def part(name, path, schema):
        entries = F.from_json(F.get_json_object("context", f"$.{path}"), schema, {"timestampFormat": serve.CONTEXT_TIME})
        return doc.select(F.posexplode(entries).alias("place", "e")).select(F.lit(name).alias("part"), "place", "e.*")

    return part("pattern", "top_failure_patterns", pattern).unionByName(
        part("service", "highest_risk_services", service), allowMissingColumns=True)


@query
def v14_rule_based_report(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.rule_based_report(t.patterns, t.services)


@query
def v15_risk_ranking(spark, sf_dir):
    return serve.risk_ranking(Inputs(spark, sf_dir).ranking)


@query
def v16_health_timeline(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.health_timeline(t.health, SERVICE, DAYS, t.health_days)


@query
def v17_metrics_window(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.metrics_window(t.metrics, SERVICE, "2024-01-05 06:30:00", "2024-01-20 18:15:00")


@query
def v18_service_incidents(spark, sf_dir):
    return serve.service_incidents(Inputs(spark, sf_dir).scored, SERVICE, 20)


@query
def v19_service_alerts(spark, sf_dir):
    return serve.service_alerts(Inputs(spark, sf_dir).silver_alerts, SERVICE, DAYS)


@query
def v20_correlation_summary(spark, sf_dir):
    return serve.correlation_summary(Inputs(spark, sf_dir).correlation)


@query
def v21_change_timeline(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    changes, incidents = serve.change_timeline(t.silver_changes, t.scored, DAYS)
    return changes.withColumn("entry", F.lit("change")).unionByName(
        incidents.withColumn("entry", F.lit("incident")), allowMissingColumns=True
    )


@query
def v22_high_correlation(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.high_correlation(t.scored_changes, t.scored, 0.5)


@query
def v23_risky_change_types(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.risky_change_types(t.scored_changes, t.incidents)


@query
def v24_changes_by_executor(spark, sf_dir):
    return serve.changes_by_executor(Inputs(spark, sf_dir).silver_changes)


@query
def v25_domain_summary(spark, sf_dir):
    return serve.domain_summary(Inputs(spark, sf_dir).domains)


@query
def v26_domain_heatmap(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.domain_heatmap(t.domains, DAYS, t.domain_days)


@query
def v27_domain_trend(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.domain_trend(t.domains, None, DAYS, t.domain_days)


@query
def v28_domain_services(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.domain_services(t.ranking, t.scored, DOMAIN)


@query
def v29_domain_incidents(spark, sf_dir):
    return serve.domain_incidents(Inputs(spark, sf_dir).scored, DOMAIN, DAYS, 50)


@query
def v30_domain_alerts(spark, sf_dir):
    return serve.domain_alerts(Inputs(spark, sf_dir).silver_alerts, "NET", DAYS)


@query
def v31_bu_p1_story(spark, sf_dir):
    rows = Inputs(spark, sf_dir).scored
    return serve.bu_p1_story(rows, "supply-chain").unionByName(
        serve.bu_p1_story(rows, "digital-surgery"), allowMissingColumns=True
    )


@query
def v32_duplicate_tickets_by_pattern(spark, sf_dir):
    return serve.duplicate_tickets_by_pattern(Inputs(spark, sf_dir).tickets)


@query
def v33_revenue_by_bu(spark, sf_dir):
    return serve.revenue_by_bu(Inputs(spark, sf_dir).units)


@query
def v34_patterns_by_blast(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return serve.patterns_by_blast(t.plain_patterns, t.scored)


@query
def v35_recent_p1(spark, sf_dir):
    return serve.recent_p1(Inputs(spark, sf_dir).scored)


@query
def v36_question_intent(spark, sf_dir):
    return serve.question_intent(fx.questions(spark, sf_dir)).select("conv_id", "turn", "intent")


# Graph -----------------------------------------------------------------------------------------


@query
def n1_service_domain_mode(spark, sf_dir):
    return Inputs(spark, sf_dir).service_domains


@query
def n2_topology_nodes(spark, sf_dir):
    return Inputs(spark, sf_dir).nodes


@query
def n3_network_edges(spark, sf_dir):
    return graph.network_edges(Inputs(spark, sf_dir).flows)


@query
def n4_incident_edges(spark, sf_dir):
    return graph.incident_edges(Inputs(spark, sf_dir).incidents)


@query
def n5_topology_edges(spark, sf_dir):
    return Inputs(spark, sf_dir).edges


@query
def n6_incident_view(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    nodes, edges = graph.incident_view(t.nodes, t.edges)
    return edges.select(F.lit("edge").alias("item"), "src_service", "dst_service", "flow_count").unionByName(
        nodes.select(F.lit("node").alias("item"), F.col("service_name").alias("src_service")), allowMissingColumns=True
    )


@query
def n7_k_hop_neighborhood(spark, sf_dir):
    edges = Inputs(spark, sf_dir).edges
    seeds = edges.where(F.col("src_service").isin(SERVICE, "svc-3")).select(F.col("src_service").alias("seed"))
    return graph.k_hop_neighborhood(edges, seeds, 3)


@query
def n8_propagation_signal(spark, sf_dir):
    return graph.propagation_signal(Inputs(spark, sf_dir).edges)


@query
def n9_root_candidates(spark, sf_dir):
    return graph.root_candidates(Inputs(spark, sf_dir).nodes)


@query
def n10_upstream_downstream(spark, sf_dir):
    up, down = graph.upstream_downstream(Inputs(spark, sf_dir).edges, SERVICE)
    columns = ["src_service", "dst_service", "incident_link_count"]
    return up.select(F.lit("upstream").alias("side"), *columns).unionByName(
        down.select(F.lit("downstream").alias("side"), *columns)
    )


# Chart data ------------------------------------------------------------------------------------


@query
def d1_daily_overlay(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return insight.daily_overlay(t.changes, t.incidents)


@query
def d2_radar_normalize(spark, sf_dir):
    return insight.radar_normalize(Inputs(spark, sf_dir).patterns, gold.PATTERN_GRAIN)


@query
def d3_incident_metrics_window(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return insight.incident_metrics_window(t.incidents, t.metrics)


@query
def d4_incident_hour_bounds(spark, sf_dir):
    return insight.incident_hour_bounds(Inputs(spark, sf_dir).incidents)


@query
def d5_parse_service_list(spark, sf_dir):
    """The impacted services in the three text forms they arrive in."""
    rows = Inputs(spark, sf_dir).incidents.select("incident_id", F.to_json("impacted_services").alias("js"))
    loose = F.regexp_replace("js", '"', "'")
    bare = F.regexp_replace("js", r'[\[\]"]', " ")
    forms = F.array(F.struct(F.lit("json").alias("form"), F.col("js").alias("raw")),
                    F.struct(F.lit("loose").alias("form"), loose.alias("raw")),
                    F.struct(F.lit("bare").alias("form"), bare.alias("raw")))
    return rows.select("incident_id", F.inline(forms)).select("incident_id", "form", parse_service_list("raw").alias("services"))


@query
def d6_risk_scatter(spark, sf_dir):
    return insight.risk_scatter(Inputs(spark, sf_dir).services)


@query
def d7_change_totals(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return insight.change_totals(serve.risky_change_types(t.scored_changes, t.incidents))


@query
def d8_humanize_number(spark, sf_dir):
    rows = Inputs(spark, sf_dir).incidents.select("incident_id", "revenue_impact_usd", "mttr_minutes", "productivity_loss_usd")
    usd = F.nullif(F.col("productivity_loss_usd"), F.lit(0.0))
    return rows.select(
        "incident_id",
        humanize("revenue_impact_usd").alias("revenue"),
        humanize_currency("revenue_impact_usd").alias("revenue_usd"),
        humanize(F.col("mttr_minutes") / 60.0).alias("hours"),
        humanize_currency(usd).alias("loss_usd"),
    )


# Business impact -------------------------------------------------------------------------------


@query
def b1_revenue_impact(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return impact.revenue_impact(t.incidents, t.models)


@query
def b2_impact_narrative(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return impact.impact_narrative(t.incidents, t.models)


@query
def b3_sla_flag(spark, sf_dir):
    return Inputs(spark, sf_dir).incidents.select("incident_id", impact.sla_flag().alias("sla_breached"))


@query
def b4_service_relationships(spark, sf_dir):
    return Inputs(spark, sf_dir).relationships


@query
def b4_relationship_kinds(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return impact.relationship_kinds(fx.service_profiles(spark, sf_dir), t.edges)


@query
def b5_dependency_blast_radius(spark, sf_dir):
    return impact.dependency_blast_radius(Inputs(spark, sf_dir).relationships)


@query
def b6_profile_enrichment(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    services = impact.enrich_services(t.services, fx.service_profiles(spark, sf_dir))
    units = impact.enrich_business_units(t.units, t.models)
    return services.select(F.lit("service").alias("kind"), F.col("service_name").alias("name"), "risk_score", "tier",
                           "profile_domain", "profile_business_unit").unionByName(
        units.select(F.lit("unit").alias("kind"), F.col("business_unit").alias("name"), "total_revenue_impact",
                     "impact_type", "shipments_per_hour"), allowMissingColumns=True)


# Streaming and ordering ------------------------------------------------------------------------


def _streamed(spark, sf_dir, table):
    """Documents landed as files and picked up by the streaming reader."""
    landing, target, checkpoint = (new_folder(spark, n) for n in ("landing", "bronze", "offsets"))
    fx.land(fx.LANDING[table](spark, sf_dir), landing)
    incremental_ingest(spark, table, landing, target, checkpoint).awaitTermination()
    return spark.read.parquet(target).drop("ingested_at", BATCH)


@query
def r1_incremental_event_ingest(spark, sf_dir):
    return _streamed(spark, sf_dir, "bronze_incidents")


@query
def r1_incremental_alert_ingest(spark, sf_dir):
    return _streamed(spark, sf_dir, "bronze_alerts")


@query
def r1_incremental_change_ingest(spark, sf_dir):
    return _streamed(spark, sf_dir, "bronze_topology_changes")


@query
def p1_build_all(spark, sf_dir):
    built = build.build_all(spark, fx.bronze(spark, sf_dir), new_folder(spark, "tables"))
    return tables.row_counts(built)


@query
def p1_build_configured(spark, sf_dir):
    """The tables that depend on configuration: rows of each, with the profiles and rates among the inputs."""
    config = {"config_service_profiles": fx.service_profiles(spark, sf_dir), "config_impact_models": fx.impact_models(spark, sf_dir)}
    built = build.build_all(spark, {**fx.bronze(spark, sf_dir), **config}, new_folder(spark, "tables"))
    return tables.row_counts({name: built[name] for name in build.CONFIGURED})


@query
def p1_written_tables(spark, sf_dir):
    """One figure of every row of the silver and gold tables, as written and read back."""
    built = build.build_all(spark, fx.bronze(spark, sf_dir), new_folder(spark, "tables"))
    parts = [
        built[name].select(F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS[name]]).alias("row_key"),
                           F.col(figure).cast("double").alias("figure"))
        for name, figure in FIGURES.items()
    ]
    return reduce(DataFrame.unionByName, parts)
