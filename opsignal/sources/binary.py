"""Binary landing files: OTLP metric documents and network-flow batches.

Both decoders run inside ``mapInArrow`` and yield bounded batches, so a file is never held as a list
of rows. A reader cannot split a binary file; the task that reads it therefore only cuts it into its
records, and the records are rebalanced over tasks before decoding. There the records of a batch are read
together, as columns; only those that this leaves out are read one by one. A record that cannot be decoded
gives one row with ``decode_error`` set, and the next one goes on; a broken frame ends its file with
such a row. Neither fails the job.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.times import from_nanos
from ..schemas import BRONZE_FLOWS, BRONZE_METRICS
from .columnar import Fields, fields, numbers, record_bytes, texts

BATCH_ROWS = 20_000


def read_files(spark: SparkSession, path: str, pattern: str = "*.pb") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


# Protocol buffer wire format -------------------------------------------------------------------


def _varint(buf, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value & (1 << 64) - 1, at
        shift += 7
        if shift > 63:
            raise ValueError(f"number too long at byte {at}")


def _signed(value: int) -> int:
    """The 64 bits as a signed number, the form a bigint column can hold."""
    return value - (1 << 64) if value >> 63 else value


def _fields(buf) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of one message given as bytes or a view."""
    at, end = 0, len(buf)
    while at < end:
        tag = buf[at]
        at += 1
        if tag > 127:
            tag, at = _varint(buf, at - 1)
        kind = tag & 7
        if kind == 2:
            size = buf[at]
            at += 1
            if size > 127:
                size, at = _varint(buf, at - 1)
        elif kind == 0:
            value, at = _varint(buf, at)
            yield tag >> 3, 0, value
            continue
        elif kind == 1:
            size = 8
        elif kind == 5:
            size = 4
        else:
            raise ValueError(f"wire type {kind} at byte {at}")
        stop = at + size
        if stop > end:
            raise ValueError(f"field runs past the end at byte {at}")
        yield tag >> 3, kind, buf[at:stop]
        at = stop


def _all(buf, number: int) -> Iterator:
    return (v for n, kind, v in _fields(buf) if n == number and kind == 2)


def _text(raw) -> str:
    return str(raw, "utf-8")


def _attribute(buf) -> tuple[str, str]:
    key = value = ""
    for number, kind, v in _fields(buf):
        if number == 1 and kind == 2:
            key = _text(v)
        elif number == 2 and kind == 2:
            for variant, _, x in _fields(v):
                if variant == 1:
                    value = _text(x)
                elif variant == 2:
                    value = str(bool(x))
                elif variant == 3:
                    value = str(_signed(x))
                elif variant == 4:
                    value = str(DOUBLE(x)[0])
                break
    return key, value


DOUBLE, LONG = (struct.Struct(f).unpack for f in ("<d", "<q"))

# OTLP field numbers of the metric forms.
FORMS = {5: "gauge", 7: "sum", 9: "histogram"}
RESOURCE_KEYS = ("service.name", "deployment.environment", "cloud.region", "host.name", "service.version")


def _metric_messages(content: bytes) -> Iterator[tuple[tuple, bytes]]:
    """(resource and scope values, metric message) for every metric of a document."""
    for resource_metrics in _all(memoryview(content), 1):
        attrs: dict[str, str] = {}
        for resource in _all(resource_metrics, 1):
            attrs.update(map(_attribute, _all(resource, 1)))
        owner = tuple(attrs.get(k, "") for k in RESOURCE_KEYS)
        for scope_metrics in _all(resource_metrics, 2):
            scope = ""
            for s in _all(scope_metrics, 1):
                scope = next(map(_text, _all(s, 1)), "")
            for metric in _all(scope_metrics, 2):
                yield (*owner, scope), bytes(metric)


def _points(metric: bytes) -> Iterator[tuple]:
    """(name, unit, value, count, sum, form, nanos) for every data point of a metric."""
    name = unit = ""
    forms = []
    for number, kind, v in _fields(metric):
        if number == 1 and kind == 2:
            name = _text(v)
        elif number == 3 and kind == 2:
            unit = _text(v)
        elif number in FORMS and kind == 2:
            forms.append((FORMS[number], v))
    for form, body in forms:
        for point in _all(body, 1):
            nanos, value, count, total = 0, None, 0, 0.0
            for number, kind, v in _fields(point):
                if number == 2 and kind == 1:
                    (nanos,) = LONG(v)
                elif form == "histogram":
                    if number == 4 and kind == 0:
                        count = _signed(v)
                    elif number == 5 and kind == 1:
                        (total,) = DOUBLE(v)
                elif number == 4 and kind == 1:
                    (value,) = DOUBLE(v)
                elif number == 6 and kind == 1:
                    value = float(LONG(v)[0])
            if form == "histogram":
                yield name, unit, None, count, total, form, nanos
            else:
                yield name, unit, value, None, None, form, nanos


def _point_columns(record: pa.Array) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """``_points`` of many metric messages at once: (message of each point, columns, messages that it leaves out)."""
    buf, start, stop = record_bytes(record)
    n = len(start)
    outer = fields(buf, start, stop)
    bad = outer.bad
    block = outer.kind == 2
    named, units = outer.where(block & (outer.number == 1)), outer.where(block & (outer.number == 3))
    bodies = outer.where(block & np.isin(outer.number, list(FORMS)))
    inner = fields(buf, bodies.start, bodies.stop)
    bad[bodies.message[inner.bad]] = True
    held = inner.where((inner.number == 1) & (inner.kind == 2))
    point = fields(buf, held.start, held.stop)
    body = held.message
    owner = bodies.message[body]
    bad[owner[point.bad]] = True
    count = len(owner)
    histogram = bodies.number[body] == 9

    def of(number: tuple[int, ...], kind: int, only: np.ndarray) -> tuple[np.ndarray, Fields, np.ndarray]:
        found = point.where(np.isin(point.number, number) & (point.kind == kind) & only[point.message])
        return *found.last(count), found

    every = np.ones(count, dtype=bool)
    has, at, f = of((2,), 1, every)
    nanos = np.zeros(count, dtype=np.int64)
    nanos[has] = numbers(buf, f.start[at[has]], "<i8")
    has_value, at, f = of((4, 6), 1, ~histogram)
    value = np.zeros(count)
    chosen = at[has_value]
    value[has_value] = np.where(f.number[chosen] == 4, numbers(buf, f.start[chosen], "<f8"), numbers(buf, f.start[chosen], "<i8").astype(np.float64))
    has, at, f = of((4,), 0, histogram)
    number = np.zeros(count, dtype=np.int64)
    number[has] = f.value[at[has]].view(np.int64)
    has, at, f = of((5,), 1, histogram)
    total = np.zeros(count)
    total[has] = numbers(buf, f.start[at[has]], "<f8")

    def text(held: Fields) -> pa.Array:
        has, at = held.last(n)
        if not len(held.start):
            return pa.array([""] * count, pa.string())
        size = np.where(has, held.stop[at] - held.start[at], 0)
        return texts(buf, held.start[at][owner], size[owner])

    forms = pa.array(list(FORMS.values()))
    columns = [
        text(named), text(units), pa.array(value, mask=~has_value), pa.array(number, mask=~histogram), pa.array(total, mask=~histogram),
        forms.take(pa.array(np.searchsorted(list(FORMS), bodies.number[body]))), pa.array(nanos),
    ]
    good = ~bad[owner]
    return owner[good], [c.filter(pa.array(good)) for c in columns], np.flatnonzero(bad)


# Network-flow batches --------------------------------------------------------------------------

# The record layout, big-endian. s = length-prefixed text, i = int32, q = int64, ? = bool.
FLOW_LAYOUT = (
    "flow_id:s nanos:q src_ip:s src_port:i dst_ip:s dst_port:i protocol:s bytes_sent:q bytes_received:q "
    "packets_sent:q packets_received:q latency_us:q retransmits:i src_service:s dst_service:s src_zone:s "
    "dst_zone:s direction:s connection_reset:? timeout:? tls_version:s dns_query:s dns_response_code:i "
    "load_balancer_id:s environment:s region:s"
)
FLOW_FIELDS = [tuple(f.split(":")) for f in FLOW_LAYOUT.split()]


def _flow_text(buf, at: int) -> tuple[str, int]:
    (size,) = struct.unpack_from(">H", buf, at)
    if at + 2 + size > len(buf):
        raise ValueError(f"text runs past the end at byte {at}")
    return _text(buf[at + 2 : at + 2 + size]), at + 2 + size


def _flow_records(content: bytes) -> Iterator[tuple[tuple, bytes]]:
    buf = memoryview(content)
    if bytes(buf[:5]) != b"NFLOW":
        raise ValueError("no flow batch header")
    (count,) = struct.unpack_from(">i", buf, 9)
    _, at = _flow_text(buf, 13)
    _, at = _flow_text(buf, at)
    for _ in range(count):
        (size,) = struct.unpack_from(">i", buf, at)
        if at + 4 + size > len(buf):
            raise ValueError(f"record runs past the end at byte {at}")
        yield (), bytes(buf[at + 4 : at + 4 + size])
        at += 4 + size


def _flow(record: bytes) -> Iterator[tuple]:
    at, out = 0, []
    for _, kind in FLOW_FIELDS:
        if kind == "s":
            value, at = _flow_text(record, at)
        else:
            (value,) = struct.unpack_from(">" + kind, record, at)
            at += struct.calcsize(">" + kind)
        out.append(value)
    yield tuple(out)


def _flow_columns(record: pa.Array) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """``_flow`` of many records at once, in the form of ``_point_columns``."""
    buf, at, stop = record_bytes(record)
    columns: list = []
    good = np.ones(len(at), dtype=bool)
    kinds = {"i": ">i4", "q": ">i8", "?": ">u1"}
    for _, kind in FLOW_FIELDS:
        width = 2 if kind == "s" else np.dtype(kinds[kind]).itemsize
        good &= at + width <= stop
        at = np.where(good, at, 0)
        if kind == "s":
            size = np.where(good, numbers(buf, at, ">u2"), 0).astype(np.int64)
            good &= at + 2 + size <= stop
            size = np.where(good, size, 0)
            columns.append((at + 2, size))
            at = at + 2 + size
        else:
            column = numbers(buf, at, kinds[kind])
            columns.append(column != 0 if kind == "?" else column)
            at = at + width
    rows = np.flatnonzero(good)
    out = [texts(buf, c[0][rows], c[1][rows]) if isinstance(c, tuple) else pa.array(c[rows]) for c in columns]
    return rows, out, np.flatnonzero(~good)


# Spark side ------------------------------------------------------------------------------------


def _guarded(path: str, rows: Callable[[], Iterator[tuple]], width: int) -> Iterator[tuple]:
    """Rows of one file or record with (path, error) in front; a failure becomes the last row."""
    try:
        for row in rows():
            yield (path, None, *row)
    except (ValueError, IndexError, struct.error) as problem:
        yield (path, str(problem), *([None] * width))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while block := list(islice(rows, BATCH_ROWS)):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*block), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Values of the named columns, one row at a time, so that only one file is copied into Python."""
    for batch in batches:
        picked = [batch.column(c) for c in columns]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in picked)


def _decode(
    files: DataFrame, cut: Callable, read: Callable, at_once: Callable, owner: list[tuple[str, str]], fields: list[tuple[str, str]]
) -> DataFrame:
    """files (path, length, content) -> rows of owner and record fields, with path and decode_error.

    ``cut`` gives the records of a file, ``at_once`` the columns of many records, and ``read`` the rows of one: of
    those that ``at_once`` leaves out, broken ones among them.
    """
    lead = [("path", "string"), ("decode_error", "string")]

    def schemas(columns: list[tuple[str, str]]) -> tuple[T.StructType, pa.Schema]:
        spark_schema = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns))
        return spark_schema, to_arrow_schema(spark_schema)

    out_schema, out_arrow = schemas([*lead, *owner, *fields])
    cut_schema, cut_arrow = schemas([*lead, *owner, ("record", "binary")])
    width = len(owner) + len(fields)

    def cut_up(batches):
        def rows():
            for path, content in _rows(batches, ["path", "content"]):
                yield from _guarded(path, lambda: ((*own, rec) for own, rec in cut(content)), len(owner) + 1)

        yield from _batches(rows(), cut_arrow)

    def whole(batch: pa.RecordBatch, alone: list[int]) -> pa.RecordBatch:
        """The columns of the records that can be read at once; the others are added to ``alone``."""
        sound = batch.column("decode_error").is_null()
        places = np.flatnonzero(sound.to_numpy(zero_copy_only=False))
        try:
            of, columns, left = at_once(batch.column("record").filter(sound))
        except (ValueError, pa.ArrowInvalid):  # a text that is not UTF-8: which one, each record tells by itself
            of, columns, left = np.zeros(0, dtype=np.int64), None, np.arange(len(places))
        alone += [*places[left].tolist(), *np.flatnonzero(~sound.to_numpy(zero_copy_only=False)).tolist()]
        if columns is None:
            return pa.RecordBatch.from_pylist([], schema=out_arrow)
        lead = batch.take(pa.array(places[of]))
        kept = [lead.column(i) for i in range(2 + len(owner))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *columns], out_arrow)], schema=out_arrow)

    def pieces(batches):
        for batch in batches:
            alone: list[int] = []
            yield whole(batch, alone)

            def rows(part=batch.take(pa.array(sorted(alone), pa.int64()))):
                for path, error, *own, record in _rows([part], cut_schema.names):
                    if error is not None:
                        yield (path, error, *([None] * width))
                    else:
                        yield from _guarded(path, lambda: ((*own, *r) for r in read(record)), width)  # noqa: B023

            yield from _batches(rows(), out_arrow)

    records = files.select("path", "content").mapInArrow(cut_up, cut_schema).hint("rebalance")
    return records.mapInArrow(pieces, out_schema)


METRIC_OWNER = [(n, "string") for n in ("service_name", "environment", "region", "host_name", "service_version", "scope_name")]
METRIC_FIELDS = [
    ("metric_name", "string"),
    ("metric_unit", "string"),
    ("metric_value", "double"),
    ("histogram_count", "bigint"),
    ("histogram_sum", "double"),
    ("metric_type", "string"),
    ("timestamp_unix_nano", "bigint"),
]


def decode_metrics(files: DataFrame) -> DataFrame:
    """One row per data point, plus ``path`` and ``decode_error``. Zero values stay zero."""
    rows = _decode(files, _metric_messages, _points, _point_columns, METRIC_OWNER, METRIC_FIELDS)
    # a point without a time has zero
    known = F.when(F.col("timestamp_unix_nano") != 0, from_nanos("timestamp_unix_nano"))
    return rows.withColumn("event_timestamp", known)


def decode_flows(files: DataFrame) -> DataFrame:
    """One row per flow, plus ``path`` and ``decode_error``."""
    types = {"s": "string", "i": "int", "q": "bigint", "?": "boolean"}
    rows = _decode(files, _flow_records, _flow, _flow_columns, [], [(n, types[t]) for n, t in FLOW_FIELDS])
    return rows.withColumn("event_timestamp", from_nanos("nanos")).drop("nanos")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.strip().split(",")]


def _clean(decoded: DataFrame, schema: str, strict: bool) -> DataFrame:
    """The table without the bookkeeping columns. ``strict`` fails the job on a bad file."""
    if strict:
        fail = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("decode_error")))
        decoded = decoded.withColumn("path", F.when(F.col("decode_error").isNotNull(), fail.cast("string")).otherwise(F.col("path")))
        return decoded.where(F.col("path").isNotNull()).select(*_columns(schema))
    return decoded.where(F.col("decode_error").isNull()).select(*_columns(schema))


def metrics_table(decoded: DataFrame, strict: bool = False) -> DataFrame:
    return _clean(decoded, BRONZE_METRICS, strict)


def flows_table(decoded: DataFrame, strict: bool = False) -> DataFrame:
    return _clean(decoded, BRONZE_FLOWS, strict)


def rejected_files(decoded: DataFrame) -> DataFrame:
    """(path, decode_error) of every record that could not be decoded and every file not read to its end."""
    return decoded.where(F.col("decode_error").isNotNull()).select("path", "decode_error")


def decode_summary(decoded: DataFrame, files: DataFrame) -> DataFrame:
    """Points, service and size of every file, also of those without points."""
    points = decoded.where(F.col("decode_error").isNull()).groupBy("path").agg(
        F.count("*").alias("points"), F.max("service_name").alias("service_name")
    )
    sizes = files.select("path", (F.col("length") / 1024.0).alias("size_kb"))
    return sizes.join(points, "path", "left").withColumn("points", F.coalesce("points", F.lit(0)))
