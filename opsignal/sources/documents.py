"""JSON landing files: logs, traces, incidents, alerts, changes.

Schemas are given, so nothing is scanned twice, and fields nobody asks for are not parsed. The
``*_table`` functions take the parsed documents, so a batch file source, a streaming file source and
a table of documents share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import attribute
from ..functions.times import from_nanos
from ..schemas import RAW_ALERTS, RAW_CHANGES, RAW_INCIDENTS, RAW_LOGS, RAW_TRACES

RESOURCE_FIELDS = {
    "service_name": "service.name",
    "environment": "deployment.environment",
    "region": "cloud.region",
    "host_name": "host.name",
}


#: Where the JSON reader puts a line that it cannot parse.
BAD = "_bad"


def _nested(schema: str) -> str:
    """The columns of a schema as the fields of a struct."""
    return T.StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def read_documents(spark: SparkSession, path: str, schema: str, one_array_per_file: bool = False) -> DataFrame:
    """Documents of a folder. ``one_array_per_file``: a file is one JSON array on a single line.

    Such an array is cut where a document starts, by the reader itself, so that a large file is read by many tasks
    and no task holds more than a document at a time. Text that is not JSON of this schema is left out;
    ``rejected_documents`` lists it.
    """
    if not one_array_per_file:
        return parsed(spark.read.text(path), schema)
    return pieces(spark, path, schema).select(F.inline("docs"))


def opening(schema: str) -> str:
    """What a document starts with: its first field. Inside a JSON string the quotes would be escaped, so this
    text stands nowhere else as long as no inner object has that field."""
    return f'{{"{T.StructType.fromDDL(schema)[0].name}":'


def pieces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line, docs) of files that are one JSON array each: the text from one document to the next, and what it
    holds. A file that spells the start of its documents in another way is a single piece, parsed as an array."""
    start = opening(schema)
    found = spark.read.option("lineSep", start).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    body = F.rtrim("line", F.lit(", \t\r\n]"))
    # the array of the first field went with the closing brackets only if there is no brace behind it
    row = F.from_json(F.concat(F.lit(start), body), f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    fields = F.struct(*[row[c].alias(c) for c in T.StructType.fromDDL(schema).names])
    array = F.from_json("line", f"array<struct<{_nested(schema)}>>")
    docs = F.when(row.isNotNull() & row[BAD].isNull(), F.array(fields)).otherwise(array)
    return found.where(F.trim("line", F.lit(" \t\r\n[],")) != "").select("path", "line", docs.alias("docs"))


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """The documents of text lines, without those that cannot be parsed. Lines are parsed once, whatever columns are
    asked for."""
    lines = lines.where(F.trim("value") != "")
    row = F.from_json("value", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    return lines.select(F.inline(F.array(row))).where(F.col(BAD).isNull()).drop(BAD)


def split(lines: DataFrame, schema: str) -> DataFrame:
    """(line, doc, bad) of the lines that are not blank: each parsed once, for whoever takes the documents and whoever
    takes the rejects."""
    row = F.from_json("value", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    held = lines.where(F.trim("value") != "").select(F.col("value").alias("line"), row.alias("doc"))
    return held.select("line", "doc", (F.col("doc").isNull() | F.col(f"doc.{BAD}").isNotNull()).alias("bad"))


def rejected_documents(spark: SparkSession, path: str, schema: str, one_array_per_file: bool = False) -> DataFrame:
    """(path, line) of the lines that are neither JSON of this schema nor an array of it; of the pieces, where a file
    is one array."""
    if one_array_per_file:
        return pieces(spark, path, schema).where("docs IS NULL").select("path", "line")
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    parsed = F.from_json("line", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    array = F.from_json("line", f"array<struct<{_nested(schema)}>>")
    return lines.where((F.trim("line") != "") & parsed[BAD].isNotNull() & ~(F.ltrim("line").startswith("[") & array.isNotNull()))


def logs_table(docs: DataFrame) -> DataFrame:
    resources = docs.select(F.explode("resourceLogs").alias("rl"))
    scopes = resources.select(F.col("rl.resource.attributes").alias("ra"), F.explode("rl.scopeLogs").alias("sl"))
    records = scopes.select("ra", F.col("sl.scope.name").alias("scope_name"), F.explode("sl.logRecords").alias("r"))
    nanos = F.col("r.timeUnixNano").cast("bigint")
    return records.select(
        *[attribute("ra", key).alias(name) for name, key in RESOURCE_FIELDS.items()],
        "scope_name",
        F.col("r.severityNumber").alias("severity_number"),
        F.col("r.severityText").alias("severity_text"),
        F.col("r.body.stringValue").alias("log_message"),
        F.col("r.traceId").alias("trace_id"),
        F.col("r.spanId").alias("span_id"),
        attribute("r.attributes", "failure_pattern").alias("failure_pattern_id"),
        nanos.alias("timestamp_unix_nano"),
        from_nanos(nanos).alias("event_timestamp"),
    )


def traces_table(docs: DataFrame) -> DataFrame:
    """One row per span. Resource fields come from the span, or from the enclosing resource if absent."""
    resources = docs.select(F.explode("resourceSpans").alias("rs"))
    scopes = resources.select(F.col("rs.resource.attributes").alias("ra"), F.explode("rs.scopeSpans").alias("ss"))
    spans = scopes.select("ra", F.explode("ss.spans").alias("s"))
    start, end = F.col("s.startTimeUnixNano").cast("bigint"), F.col("s.endTimeUnixNano").cast("bigint")

    def resource(key: str) -> Column:
        return F.coalesce(attribute("s.resource.attributes", key), attribute("ra", key))

    return spans.select(
        F.col("s.traceId").alias("trace_id"),
        F.col("s.spanId").alias("span_id"),
        F.col("s.parentSpanId").alias("parent_span_id"),
        F.col("s.name").alias("operation_name"),
        F.col("s.kind").alias("span_kind"),
        start.alias("start_time_unix_nano"),
        end.alias("end_time_unix_nano"),
        ((end - start) / F.lit(1000000.0).cast("decimal(8,1)")).alias("duration_ms"),
        F.col("s.status.code").alias("status_code"),
        F.col("s.status.message").alias("status_message"),
        attribute("s.attributes", "service.name").alias("service_name"),
        attribute("s.attributes", "http.status_code", "intValue").alias("http_status_code"),
        attribute("s.attributes", "peer.service").alias("peer_service"),
        resource("service.name").alias("resource_service_name"),
        resource("deployment.environment").alias("environment"),
        resource("cloud.region").alias("region"),
        from_nanos(start).alias("event_timestamp"),
    )


def _typed(docs: DataFrame, casts: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(c) for c in docs.columns])


def incidents_table(docs: DataFrame) -> DataFrame:
    ints = ("mttr_minutes", "blast_radius", "affected_user_count", "shipments_delayed",
            "servicenow_ticket_count", "servicenow_duplicate_tickets")
    typed = _typed(docs, {"created_at": "timestamp", "resolved_at": "timestamp", **{c: "int" for c in ints}})
    return typed.withColumn("user_impact_count", F.col("affected_user_count"))


def alerts_table(docs: DataFrame) -> DataFrame:
    return _typed(docs, {"fired_at": "timestamp", "resolved_at": "timestamp"})


def changes_table(docs: DataFrame) -> DataFrame:
    return _typed(docs, {"executed_at": "timestamp"})


# name -> (landing schema, documents to table)
DOCUMENT_TABLES = {
    "bronze_logs": (RAW_LOGS, logs_table),
    "bronze_traces": (RAW_TRACES, traces_table),
    "bronze_incidents": (RAW_INCIDENTS, incidents_table),
    "bronze_alerts": (RAW_ALERTS, alerts_table),
    "bronze_topology_changes": (RAW_CHANGES, changes_table),
}


def ingest(spark: SparkSession, table: str, path: str) -> DataFrame:
    schema, build = DOCUMENT_TABLES[table]
    return build(read_documents(spark, path, schema, one_array_per_file=table == "bronze_traces"))
