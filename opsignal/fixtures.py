"""Bronze-shaped inputs derived from the ``events`` table, and their landing forms.

The mapping is fixed by FIXTURES.md. It is a projection of the events, so every input grows with them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.impact import MODEL_COLUMNS
from .schemas import RAW_ALERTS, RAW_CHANGES, RAW_INCIDENTS
from .session import configure, qualified

# Fixed values of the mapping.
CHANGE_TYPES = (
    "deployment",
    "config_change",
    "scaling_event",
    "database_migration",
    "certificate_rotation",
    "firewall_rule_update",
    "dependency_upgrade",
    "feature_flag_toggle",
    "infra_patch",
    "network_route_change",
    "vpc_peering_update",
    "security_group_change",
    "terraform_apply",
)
EXECUTORS = ("deploy-bot", "sre-team", "dev-team", "infra-automation", "security-scanner", "terraform-ci")
ALERT_NAMES = ("HighCPU", "HighMemory", "HighLatency", "ErrorRate", "PacketLoss", "DiskFull")
DOMAINS = ("application", "infrastructure", "network")
ALERT_DOMAINS = ("app", " Infra ", "NET")
UNITS = ("supply-chain", "digital-surgery", "clinical-trials", "commercial-pharma", "shared-infrastructure")
MODELS = ("shipment_throughput", "productivity_loss", "trial_delay", "lost_sales", "blast_multiplier")
QUESTION_WORDS = ("shipment", "productivity", "duplicate", "revenue", "blast radius", "hello")

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def one_of(values: tuple, n: str) -> str:
    """SQL for ``values[n]``, n in 0..len-1."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({n} + 1 as int))"


ENVIRONMENT = one_of(("prod", "staging"), "id % 2") + " AS environment"
REGION = one_of(("us-east-1", "us-west-2"), "id % 2") + " AS region"
CENTS = "cast(round(v * 100) as bigint)"


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """id, ts, u, kind, v, k of the events of the given kinds (all without any)."""
    raw = configure(spark).read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    if kinds:
        raw = raw.where(F.col("event_type").isin(*kinds))
    return raw.selectExpr(
        "event_id AS id",
        "cast(ts AS timestamp) AS ts",
        "user_id AS u",
        "event_type AS kind",
        "value AS v",
        "cast(get_json_object(props, '$.k') AS int) AS k",
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir, "error").selectExpr(
        "*",
        "cast(5 + (k * 37) % 180 AS int) AS m",
        "CASE WHEN k <> 99 THEN concat('pattern ', (u + k) % 40) END AS pattern",
        "CASE WHEN k <> 99 THEN concat('pattern ', (u + k) % 40) ELSE 'untitled' END AS titled",
    )
    return rows.selectExpr(
        "concat('INC-', id) AS incident_id",
        "titled AS title",
        "concat('failure of ', titled) AS description",
        "CASE WHEN k < 10 THEN 'P1' WHEN k < 40 THEN 'P2' WHEN k < 85 THEN 'P3' ELSE 'P4' END AS severity",
        "'resolved' AS status",
        "ts AS created_at",
        "ts + make_dt_interval(0, 0, m) AS resolved_at",
        "m AS mttr_minutes",
        "concat('svc-', u) AS root_service",
        "CASE WHEN k % 4 > 0 THEN transform(sequence(1, k % 4), j -> concat('svc-', u + j)) "
        "ELSE cast(array() AS array<string>) END AS impacted_services",
        "k % 4 AS blast_radius",
        f"{one_of(DOMAINS, 'u % 3')} AS domain",
        "CASE WHEN k <> 99 THEN concat('FP-', (u + k) % 40) END AS failure_pattern_id",
        "pattern AS failure_pattern_name",
        ENVIRONMENT,
        REGION,
        f"{CENTS} * 50D AS revenue_impact_usd",
        "k < 10 AND m > 30 AS sla_breached",
        f"{one_of(UNITS, 'u % 5')} AS business_unit",
        "k * 2 AS affected_user_count",
        "k * 2 AS user_impact_count",
        "array('engineer') AS affected_roles",
        "m / 60D AS productivity_loss_hours",
        f"CASE WHEN u % 5 = 1 THEN cast({CENTS} AS double) ELSE 0D END AS productivity_loss_usd",
        "CASE WHEN u % 5 = 0 THEN k ELSE 0 END AS shipments_delayed",
        "k % 9 AS servicenow_ticket_count",
        "cast((k % 9) div 3 AS int) AS servicenow_duplicate_tickets",
        "concat('impact of ', titled) AS downstream_impact_narrative",
        "concat('cause of ', titled) AS root_cause_explanation",
        f"{one_of(MODELS, 'u % 5')} AS revenue_model",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "click").selectExpr(
        "concat('ALT-', id) AS alert_id",
        "CASE WHEN k < 60 THEN concat('INC-', id + k % 7 - 3) END AS incident_id",
        "concat('svc-', u) AS service",
        f"{one_of(ALERT_NAMES, 'k % 6')} AS alert_name",
        "CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' ELSE 'warning' END AS severity",
        "ts AS fired_at",
        "ts + make_dt_interval(0, 0, 10 + k) AS resolved_at",
        "CASE WHEN k = 50 THEN 0D ELSE cast(70 + k % 25 AS double) END AS threshold_value",
        "60 + v % 60 AS actual_value",
        f"{one_of(ALERT_DOMAINS, 'u % 3')} AS domain",
        ENVIRONMENT,
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "signup").selectExpr(
        "concat('CHG-', id) AS change_id",
        "concat('svc-', u) AS service",
        f"{one_of(CHANGE_TYPES, 'k % 13')} AS change_type",
        "concat('change on svc-', u) AS description",
        "ts AS executed_at",
        f"{one_of(EXECUTORS, 'k % 6')} AS executed_by",
        f"{one_of(('low', 'medium', 'high'), 'k % 3')} AS risk_level",
        "k % 4 <> 0 AS rollback_available",
        f"{one_of(DOMAINS, 'u % 3')} AS domain",
        ENVIRONMENT,
        REGION,
    )


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per view and purchase event: the reporting host and an array of five points."""

    def point(name: str, unit: str, form: str, value: str = "NULL", count: str = "NULL", total: str = "NULL") -> str:
        return (
            f"named_struct('metric_name', '{name}', 'metric_unit', '{unit}', 'metric_value', cast({value} AS double), "
            f"'histogram_count', cast({count} AS bigint), 'histogram_sum', cast({total} AS double), 'metric_type', '{form}')"
        )

    points = [
        point("system.cpu.utilization", "%", "gauge", "least(99.5D, k + v * 0.05D)"),
        point("system.memory.utilization", "%", "gauge", "(k * 7) % 100"),
        point("http.server.request.duration", "ms", "histogram", "NULL", "k + 1", "v * (k + 1)"),
        point("http.server.active_requests", "1", "sum", "k * 3"),
        point("db.client.connections.usage", "1", "gauge", "k % 50"),
    ]
    return events(spark, sf_dir, "view", "purchase").selectExpr(
        "concat('svc-', u) AS service_name",
        ENVIRONMENT,
        REGION,
        "concat('host-', u % 10) AS host_name",
        "'1.0.0' AS service_version",
        "'otel' AS scope_name",
        f"array({', '.join(points)}) AS points",
        "unix_micros(ts) * 1000 AS timestamp_unix_nano",
        "ts AS event_timestamp",
        "id AS event_id",
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points per view and purchase event."""
    rows = metric_events(spark, sf_dir)
    kept = [c for c in rows.columns if c not in ("points", "event_id")]
    return rows.selectExpr(*kept, "inline(points)")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr(
        "*",
        "CASE WHEN kind = 'error' AND k % 10 = 0 THEN 'FATAL' WHEN kind = 'error' THEN 'ERROR' "
        "WHEN kind = 'click' AND k < 20 THEN 'WARN' ELSE 'INFO' END AS level",
    )
    return rows.selectExpr(
        "concat('svc-', u) AS service_name",
        ENVIRONMENT,
        REGION,
        "concat('host-', u % 10) AS host_name",
        "concat('svc-', u) AS scope_name",
        "CASE level WHEN 'FATAL' THEN 21L WHEN 'ERROR' THEN 17L WHEN 'WARN' THEN 13L ELSE 9L END AS severity_number",
        "level AS severity_text",
        "concat('event ', kind) AS log_message",
        "cast(id AS string) AS trace_id",
        "concat('s', id) AS span_id",
        "CASE WHEN kind = 'error' THEN concat('FP-', (u + k) % 40) END AS failure_pattern_id",
        "unix_micros(ts) * 1000 AS timestamp_unix_nano",
        "ts AS event_timestamp",
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root span per purchase and k % 3 child spans."""
    spans = events(spark, sf_dir, "purchase").selectExpr(
        "*", "explode(sequence(0, k % 3)) AS j", "unix_micros(ts) * 1000 AS began", f"{CENTS} * 10000 AS took"
    )
    return spans.selectExpr(
        "concat('t', id) AS trace_id",
        "concat('s', id, '-', j) AS span_id",
        "CASE WHEN j = 0 THEN '' ELSE concat('s', id, '-0') END AS parent_span_id",
        "concat('CALL svc-', u + j) AS operation_name",
        "CASE WHEN j = 0 THEN 2L ELSE 3L END AS span_kind",
        "began AS start_time_unix_nano",
        "began + took AS end_time_unix_nano",
        "took / 1000000.0 AS duration_ms",
        "CASE WHEN k < 5 THEN 2L ELSE 1L END AS status_code",
        "CASE WHEN j > 0 THEN NULL WHEN k < 5 THEN 'error' ELSE 'ok' END AS status_message",
        "concat('svc-', u + j) AS service_name",
        "CASE WHEN j > 0 THEN NULL WHEN k < 5 THEN '503' ELSE '200' END AS http_status_code",
        "CASE WHEN j > 0 THEN concat('svc-', u + j) END AS peer_service",
        "concat('svc-', u + j) AS resource_service_name",
        ENVIRONMENT,
        REGION,
        "ts AS event_timestamp",
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "purchase").selectExpr(
        "concat('flow-', id) AS flow_id",
        "ts AS event_timestamp",
        "concat('10.0.0.', u % 250) AS src_ip",
        "1024 + k AS src_port",
        "concat('10.0.1.', u % 250) AS dst_ip",
        "8080 AS dst_port",
        f"{one_of(('TCP', 'HTTP'), 'k % 2')} AS protocol",
        "k * 100L AS bytes_sent",
        "k * 10L AS bytes_received",
        "cast(k AS bigint) AS packets_sent",
        "cast(k AS bigint) AS packets_received",
        f"{CENTS} AS latency_us",
        "k % 6 AS retransmits",
        "concat('svc-', u) AS src_service",
        "CASE WHEN k = 77 THEN '' ELSE concat('svc-', u + 1 + k % 3) END AS dst_service",
        "'zone-a' AS src_zone",
        "'zone-b' AS dst_zone",
        "'egress' AS direction",
        "k % 10 = 0 AS connection_reset",
        "k % 20 = 0 AS timeout",
        "'TLSv1.3' AS tls_version",
        "'' AS dns_query",
        "0 AS dns_response_code",
        "concat('lb-', u % 3) AS load_balancer_id",
        ENVIRONMENT,
        REGION,
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = configure(spark).read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return turns.selectExpr("conv_id", "turn", f"concat(text, ' ', {one_of(QUESTION_WORDS, 'conv_id % 6')}) AS question")


def service_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("u").distinct().selectExpr(
        "concat('svc-', u) AS service_name",
        f"{one_of(DOMAINS, 'u % 3')} AS domain",
        f"{one_of(('critical', 'high', 'medium'), 'u % 3')} AS tier",
        f"{one_of(UNITS, 'u % 5')} AS business_unit",
        "array(concat('svc-', u + 1), concat('svc-', u + 2)) AS depends_on",
    )


def impact_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per business unit; the measured rates are the mean ``k`` of its error events."""
    per_unit = events(spark, sf_dir, "error").groupBy((F.col("u") % 5).alias("n")).agg(
        F.round(F.avg("k")).cast("double").alias("rate")
    )
    given = {
        "shipments_per_hour": "rate",
        "avg_order_value_usd": "12500D",
        "affected_people": "rate",
        "affected_users": "rate",
    }
    names = [c.split()[0] for c in MODEL_COLUMNS.split(", ")][2:]
    return per_unit.selectExpr(
        f"{one_of(UNITS, 'n')} AS business_unit",
        f"{one_of(MODELS, 'n')} AS impact_type",
        *[f"cast({given.get(c, 'NULL')} AS double) AS {c}" for c in names],
    )


def bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "bronze_metrics": metrics(spark, sf_dir),
        "bronze_logs": logs(spark, sf_dir),
        "bronze_traces": traces(spark, sf_dir),
        "bronze_incidents": incidents(spark, sf_dir),
        "bronze_alerts": alerts(spark, sf_dir),
        "bronze_topology_changes": changes(spark, sf_dir),
        "bronze_network_flows": flows(spark, sf_dir),
    }


# Landing forms ---------------------------------------------------------------------------------


def _iso(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def _as_json(rows: DataFrame, schema: str) -> DataFrame:
    """Rows as one JSON document each, with the landing schema's field order and NULLs left out."""
    names = [c.split()[0] for c in schema.strip().split(",")]
    times = [n for n, t in rows.dtypes if t == "timestamp"]
    fields = [_iso(n).alias(n) if n in times else F.col(n) for n in names]
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))


def incident_documents(spark, sf_dir) -> DataFrame:
    return _as_json(incidents(spark, sf_dir), RAW_INCIDENTS.replace("array<string>", "array"))


def alert_documents(spark, sf_dir) -> DataFrame:
    return _as_json(alerts(spark, sf_dir), RAW_ALERTS)


def change_documents(spark, sf_dir) -> DataFrame:
    return _as_json(changes(spark, sf_dir), RAW_CHANGES)


def _text_attribute(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


def _resource(*pairs: tuple[str, str]) -> Column:
    return F.struct(F.array(*[_text_attribute(key, F.col(c)) for key, c in pairs]).alias("attributes"))


def log_documents(spark, sf_dir) -> DataFrame:
    rows = logs(spark, sf_dir)
    extra = F.array(_text_attribute("log.source", F.col("service_name")), _text_attribute("failure_pattern", F.col("failure_pattern_id")))
    attributes = F.filter(extra, lambda a: a["value"]["stringValue"].isNotNull())
    record = F.struct(
        F.col("timestamp_unix_nano").cast("string").alias("timeUnixNano"),
        F.col("severity_number").alias("severityNumber"),
        F.col("severity_text").alias("severityText"),
        F.struct(F.col("log_message").alias("stringValue")).alias("body"),
        attributes.alias("attributes"),
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
    )
    resource = _resource(
        ("service.name", "service_name"),
        ("deployment.environment", "environment"),
        ("cloud.region", "region"),
        ("host.name", "host_name"),
    )
    scope = F.struct(F.struct(F.col("scope_name").alias("name")).alias("scope"), F.array(record).alias("logRecords"))
    doc = F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeLogs"))).alias("resourceLogs"))
    return rows.select(F.to_json(doc).alias("value"))


def trace_documents(spark, sf_dir) -> DataFrame:
    rows = traces(spark, sf_dir)

    def attribute(key: str, name: str, variant: str) -> Column:
        value = F.struct(
            F.when(F.lit(variant == "s"), F.col(name)).alias("stringValue"),
            F.when(F.lit(variant == "i"), F.col(name)).alias("intValue"),
        )
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    attributes = F.filter(
        F.array(
            attribute("service.name", "service_name", "s"),
            attribute("http.status_code", "http_status_code", "i"),
            attribute("peer.service", "peer_service", "s"),
        ),
        lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"]).isNotNull(),
    )
    span = F.struct(
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"),
        F.col("operation_name").alias("name"),
        F.col("span_kind").alias("kind"),
        F.col("start_time_unix_nano").cast("string").alias("startTimeUnixNano"),
        F.col("end_time_unix_nano").cast("string").alias("endTimeUnixNano"),
        F.struct(F.col("status_code").alias("code"), F.col("status_message").alias("message")).alias("status"),
        attributes.alias("attributes"),
        _resource(
            ("service.name", "resource_service_name"),
            ("deployment.environment", "environment"),
            ("cloud.region", "region"),
        ).alias("resource"),
    )
    scope = F.struct(F.struct(F.lit("tracer").alias("name")).alias("scope"), F.array(span).alias("spans"))
    doc = F.struct(F.array(F.struct(F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))
    return rows.select(F.to_json(doc).alias("value"))


def spread(df: DataFrame) -> DataFrame:
    """One partition per core: the events are a single small file, landing files are many."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def land(documents: DataFrame, folder: str) -> str:
    """Write documents to ``folder``, one per line."""
    spread(documents).write.text(folder)
    return folder


LANDING = {
    "bronze_incidents": incident_documents,
    "bronze_alerts": alert_documents,
    "bronze_topology_changes": change_documents,
    "bronze_logs": log_documents,
    "bronze_traces": trace_documents,
}


def _size_prefixed(number: int, body: bytes) -> bytes:
    return bytes([number << 3 | 2]) + _number(len(body)) + body


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def encode_metric_document(resource: dict[str, str], scope: str, points: list[tuple]) -> bytes:
    """points: (name, unit, value, count, sum, form, nanos); whole ``sum`` values are written as integers."""
    sp = _size_prefixed
    attrs = b"".join(sp(1, sp(1, key.encode()) + sp(2, sp(1, text_.encode()))) for key, text_ in resource.items())
    metrics_ = b""
    for name, unit, value, count, total, form, nanos in points:
        body = b"\x11" + struct.pack("<Q", int(nanos))
        if form == "histogram":
            body += b"\x20" + _number(int(count)) + b"\x29" + struct.pack("<d", total)
        elif form == "sum":
            body += b"\x31" + struct.pack("<q", int(value))
        else:
            body += b"\x21" + struct.pack("<d", value)
        number = {"gauge": 5, "sum": 7, "histogram": 9}[form]
        metrics_ += sp(2, sp(1, name.encode()) + sp(3, unit.encode()) + sp(number, sp(1, body)))
    scoped = sp(2, sp(1, sp(1, scope.encode())) + metrics_)
    return sp(1, sp(1, attrs) + scoped)


def encode_flow_batch(records: list[tuple], kinds: str) -> bytes:
    """records in layout order; kinds has one letter (s, i, q, ?) per field."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">H", len(raw)) + raw

    out = b"NFLOW" + struct.pack(">ii", 1, len(records)) + text("2024-01-01T00:00:00Z") + text("collector")
    for record in records:
        body = b"".join(text(v) if k == "s" else struct.pack(">" + k, v) for k, v in zip(kinds, record))
        out += struct.pack(">i", len(body)) + body
    return out


FILE_SCHEMA = "path string, length bigint, content binary"


def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OTLP document per event, shaped like the rows of a binary file source."""
    names = ("service.name", "deployment.environment", "cloud.region", "host.name", "service.version")
    owner = ("service_name", "environment", "region", "host_name", "service_version")
    values = ("metric_name", "metric_unit", "metric_value", "histogram_count", "histogram_sum", "metric_type")
    docs = spread(metric_events(spark, sf_dir))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                points = [(*(p[v] for v in values), r["timestamp_unix_nano"]) for p in r["points"]]
                raw = encode_metric_document({n: r[o] for n, o in zip(names, owner)}, r["scope_name"], points)
                rows.append((f"metrics/ev-{r['event_id']}.pb", len(raw), raw))
            yield pd.DataFrame(rows, columns=["path", "length", "content"])

    return docs.mapInPandas(encode, FILE_SCHEMA)


def flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow batch per event, shaped like the rows of a binary file source."""
    from .sources.binary import FLOW_FIELDS

    kinds = "".join(k for _, k in FLOW_FIELDS)
    names = [n for n, _ in FLOW_FIELDS]
    rows_ = spread(flows(spark, sf_dir)).withColumn("nanos", F.unix_micros("event_timestamp") * 1000).select(*names)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for record in pdf.itertuples(index=False, name=None):
                raw = encode_flow_batch([record], kinds)
                rows.append((f"flows/{record[0]}.pb", len(raw), raw))
            yield pd.DataFrame(rows, columns=["path", "length", "content"])

    return rows_.mapInPandas(encode, FILE_SCHEMA)


def land_files(files: DataFrame, folder: str) -> str:
    """Real files of several documents each, one a batch, written by the tasks under names that a second run of a task
    replaces. Documents of this format may follow each other in a file."""
    from pyarrow import fs

    target = qualified(files.sparkSession, folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        for n, batch in enumerate(batches):
            name = f"{root}/part-{TaskContext.get().partitionId():05d}-{n:05d}.pb"
            with store.open_output_stream(name) as out:
                for content in batch["content"]:
                    out.write(content)
            yield pd.DataFrame({"docs": [len(batch)]})

    files.select("content").mapInPandas(write, "docs long").agg(F.sum("docs")).collect()
    return folder
