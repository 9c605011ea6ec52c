"""Landing files: round trips, malformed input, writing, syncing and streaming."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import pytest
from helpers import T0, alerts
from pyspark.sql import functions as F

from opsignal import fixtures as fx
from opsignal.plans.build import GOLD, SILVER, build_all
from opsignal.schemas import KEYS, RAW_INCIDENTS, RAW_TRACES, SNAPSHOT, TRIGGERED
from opsignal.sources import binary, documents, tables, versions
from opsignal.streaming.events import incremental_ingest

NANOS = int(T0.timestamp()) * 10**9 + 123456789
RESOURCE = {"service.name": "svc", "cloud.region": "eu"}
POINTS = [
    ("cpu", "%", 0.0, None, None, "gauge", NANOS),
    ("req", "1", -3, None, None, "sum", NANOS),
    ("lat", "ms", None, 300, 12.5, "histogram", 0),
]


def write(folder: Path, name: str, content: bytes) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)


def test_metric_files(spark, tmp_path):
    folder = tmp_path / "m"
    write(folder, "a.pb", fx.encode_metric_document(RESOURCE, "scope", POINTS))
    write(folder, "empty.pb", b"")
    write(folder, "cut.pb", fx.encode_metric_document(RESOURCE, "scope", POINTS)[:-3])
    write(folder, "wire.pb", b"\x0b\x01")
    write(folder, "note.txt", b"not a metric file")
    files = binary.read_files(spark, str(folder))
    decoded = binary.decode_metrics(files)
    got = {r.metric_name: r for r in binary.metrics_table(decoded).collect()}
    assert set(got) == {"cpu", "req", "lat"}
    assert got["cpu"].metric_value == 0.0 and got["req"].metric_value == -3.0
    assert got["cpu"].event_timestamp.microsecond == 123456
    assert (got["lat"].metric_value, got["lat"].histogram_count, got["lat"].histogram_sum) == (None, 300, 12.5)
    assert got["lat"].event_timestamp is None
    assert (got["cpu"].environment, got["cpu"].region, got["cpu"].service_name) == ("", "eu", "svc")
    bad = {r.path.rsplit("/", 1)[-1] for r in binary.rejected_files(decoded).collect()}
    assert bad == {"cut.pb", "wire.pb"}
    sizes = {r.path.rsplit("/", 1)[-1]: r.points for r in binary.decode_summary(decoded, files).collect()}
    # the file source itself passes over files of no bytes
    assert sizes == {"a.pb": 3, "cut.pb": 0, "wire.pb": 0}
    with pytest.raises(Exception, match="wire type|past the end"):
        binary.metrics_table(decoded, strict=True).where("metric_name = 'none'").collect()


def test_integer_attribute_is_signed():
    ten_bytes = b"\xff" * 9 + b"\x01"
    assert binary._attribute(b"\x0a\x01k\x12\x0b\x18" + ten_bytes) == ("k", "-1")


def test_numbers_beyond_a_bigint_do_not_fail_the_job(spark, tmp_path):
    huge = [("lat", "ms", None, 2**64 - 1, 1.0, "histogram", NANOS)]
    write(tmp_path / "h", "huge.pb", fx.encode_metric_document(RESOURCE, "s", huge))
    write(tmp_path / "h", "long.pb", b"\x0a" + b"\xff" * 11 + b"\x01")
    decoded = binary.decode_metrics(binary.read_files(spark, str(tmp_path / "h")))
    assert binary.metrics_table(decoded).first().histogram_count == -1
    assert binary.rejected_files(decoded).first().decode_error.startswith("number too long")


def test_flow_files(spark, tmp_path):
    kinds = "".join(k for _, k in binary.FLOW_FIELDS)
    sample = {"s": "é", "i": -7, "q": NANOS, "?": True}
    good = fx.encode_flow_batch([tuple(sample[k] for k in kinds)] * 3, kinds)
    folder = tmp_path / "f"
    write(folder, "a.pb", good)
    write(folder, "magic.pb", b"XFLOW" + good[5:])
    write(folder, "short.pb", good[:-1])
    decoded = binary.decode_flows(binary.read_files(spark, str(folder)))
    rows = binary.flows_table(decoded).collect()
    # the two whole records of the short file are kept, its broken one is reported
    assert len(rows) == 5 and {r.flow_id for r in rows} == {"é"}
    assert rows[0].src_port == -7 and rows[0].timeout is True and rows[0].event_timestamp.microsecond == 123456
    errors = {r.path.rsplit("/", 1)[-1] for r in binary.rejected_files(decoded).collect()}
    assert errors == {"magic.pb", "short.pb"}
    alone = tmp_path / "one"
    write(alone, "magic.pb", b"XFLOW" + good[5:])
    with pytest.raises(Exception, match="no flow batch header"):
        binary.flows_table(binary.decode_flows(binary.read_files(spark, str(alone))), strict=True).collect()


def test_a_broken_record_between_good_ones(spark, tmp_path):
    one = fx.encode_metric_document(RESOURCE, "scope", POINTS[:1])
    other = fx.encode_metric_document(RESOURCE, "scope", POINTS[1:2])
    write(tmp_path / "m", "a.pb", one + b"\x0a\x06\x12\x04\x12\x02\x0b\x01" + other)
    decoded = binary.decode_metrics(binary.read_files(spark, str(tmp_path / "m")))
    assert {r.metric_name for r in binary.metrics_table(decoded).collect()} == {"cpu", "req"}
    assert binary.rejected_files(decoded).count() == 1

    kinds = "".join(k for _, k in binary.FLOW_FIELDS)
    sample = {"s": "é", "i": -7, "q": NANOS, "?": True}
    good = fx.encode_flow_batch([tuple(sample[k] for k in kinds)] * 3, kinds)
    first = next(binary._flow_records(good))[1]
    start = good.index(first, good.index(first) + 1)
    write(tmp_path / "f", "a.pb", good[:start] + b"\xff\xff" + good[start + 2 :])
    decoded = binary.decode_flows(binary.read_files(spark, str(tmp_path / "f")))
    assert binary.flows_table(decoded).count() == 2 and binary.rejected_files(decoded).count() == 1


@pytest.mark.parametrize("table", list(fx.LANDING))
def test_document_files(spark, sf_dir, tmp_path, table):
    folder = str(tmp_path / table)
    fx.LANDING[table](spark, sf_dir).repartition(3).write.text(folder)
    got = documents.ingest(spark, table, folder)
    want = fx.bronze(spark, sf_dir)[table].select(*got.columns)
    assert got.count() == want.count()
    assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert got.exceptAll(want).isEmpty()


def test_trace_array_file_and_resource_fallback(spark, tmp_path):
    span = '{"traceId":"t","spanId":"s","startTimeUnixNano":"1000","endTimeUnixNano":"2500000","attributes":[]}'
    outer = '{"attributes":[{"key":"cloud.region","value":{"stringValue":"eu"}}]}'
    doc = f'{{"resourceSpans":[{{"resource":{outer},"scopeSpans":[{{"spans":[{span}]}}]}}]}}'
    write(tmp_path / "t", "x.json", f"[{doc},{doc}]".encode())
    rows = documents.ingest(spark, "bronze_traces", str(tmp_path / "t")).collect()
    assert len(rows) == 2 and rows[0].region == "eu" and float(rows[0].duration_ms) == 2.499


def test_rejected_documents(spark, tmp_path):
    write(tmp_path / "d", "x.json", b'{"incident_id":"1"}\n{oops\n')
    bad = documents.rejected_documents(spark, str(tmp_path / "d"), RAW_INCIDENTS).collect()
    assert [r.line for r in bad] == ["{oops"]
    assert [r.incident_id for r in documents.ingest(spark, "bronze_incidents", str(tmp_path / "d")).collect()] == ["1"]
    write(tmp_path / "t", "a.json", b'[{"resourceSpans":[]},{"resourceSpans":[]}]')
    write(tmp_path / "t", "b.json", b"[{oops")
    bad = documents.rejected_documents(spark, str(tmp_path / "t"), RAW_TRACES).collect()
    assert [r.line for r in bad] == ["[{oops"]


def test_one_large_array_is_read_by_several_tasks(spark, sf_dir, tmp_path):
    docs = [r.value for r in fx.trace_documents(spark, sf_dir).limit(300).collect()]
    flat = [d for x in docs for d in (json.loads(x) if x.lstrip().startswith("[") else [json.loads(x)])]
    tricky = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": 'a {"resourceSpans": [ ] } b', "spanId": "],}", "startTimeUnixNano": "1", "endTimeUnixNano": "2"}]}]}]}
    flat = flat * 4 + [tricky, {"resourceSpans": []}]
    write(tmp_path / "one", "x.json", json.dumps(flat).encode())
    write(tmp_path / "lines", "x.json", "\n".join(map(json.dumps, flat)).encode())
    write(tmp_path / "loose", "x.json", json.dumps(flat).replace('{"resourceSpans"', '{ "resourceSpans"').encode())
    write(tmp_path / "bad", "x.json", json.dumps(flat[:2]).encode()[:-40])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = documents.ingest(spark, "bronze_traces", str(tmp_path / "one"))
        parts = [r[0] for r in got.select(F.spark_partition_id()).distinct().collect()]
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) > 3
    line = documents.traces_table(documents.read_documents(spark, str(tmp_path / "lines"), RAW_TRACES))
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted(line.collect(), key=key) and any(r.span_id == "],}" for r in rows)
    assert sorted(documents.ingest(spark, "bronze_traces", str(tmp_path / "loose")).collect(), key=key) == sorted(rows, key=key)
    assert documents.rejected_documents(spark, str(tmp_path / "one"), RAW_TRACES, True).isEmpty()
    assert documents.rejected_documents(spark, str(tmp_path / "bad"), RAW_TRACES, True).count() == 1
    assert documents.read_documents(spark, str(tmp_path / "bad"), RAW_TRACES, True).count() == 1


@pytest.mark.parametrize("table, key", [("bronze_incidents", "incident_id"), ("bronze_alerts", "alert_id"), ("bronze_topology_changes", "change_id")])
def test_stream_passes_over_bad_lines(spark, tmp_path, table, key):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "offsets"))
    write(tmp_path / "landing", "x.json", f'{{"{key}":"1"}}\n{{oops\n'.encode())
    incremental_ingest(spark, table, landing, target, checkpoint).awaitTermination()
    assert [r[key] for r in spark.read.parquet(target).collect()] == ["1"]
    assert [r.line for r in spark.read.parquet(f"{target}.rejects").collect()] == ["{oops"]


def test_stream_that_fails_between_its_sinks_takes_each_line_once(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "offsets"))
    rejects = tmp_path / "rejects"
    rejects.write_text("a file where the folder of the second sink should be")
    run = lambda: incremental_ingest(spark, "bronze_incidents", landing, target, checkpoint, 1, rejects=str(rejects)).awaitTermination()
    for i in range(3):
        write(tmp_path / "landing", f"{i}.json", f'{{"incident_id":"{i}"}}\n\n{{oops {i}\nnull\n'.encode())
    with pytest.raises(Exception):  # noqa: B017
        run()
    # the rows of the first batch are there, its rejects are not
    assert spark.read.parquet(target).count() == 1
    rejects.unlink()
    run()
    write(tmp_path / "landing", "9.json", b'{"incident_id":"9"}\n')
    run()
    rows, bad = spark.read.parquet(target), spark.read.parquet(str(rejects))
    assert sorted(r.incident_id for r in rows.collect()) == ["0", "1", "2", "9"]
    assert sorted(r.line for r in bad.collect()) == ["null"] * 3 + [f"{{oops {i}" for i in range(3)]
    assert rows.select("batch_id").distinct().count() == 4


def test_write_table_replaces_content_and_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(5), path)
    again = tables.write_table(spark.sql("SELECT 'x' AS name"), path)
    assert again.columns == ["name", "computed_at"] and again.count() == 1


def test_sync(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, "null"), (4, "d"), (None, "n")], "id int, v string")
    path = str(tmp_path / "copy")
    assert tables.sync_copy(spark, old, path, ["id"], TRIGGERED).first().n == 4
    done = {r.op: r.n for r in tables.sync_copy(spark, new.where("id <> 1 OR id IS NULL"), path, ["id"], TRIGGERED).collect()}
    assert done == {"insert": 1, "update": 2, "delete": 1}
    state = versions.read_table(spark, path)
    assert sorted((r.id or 0, r.v) for r in state.collect()) == [(0, "n"), (2, "B"), (3, "null"), (4, "d")]
    tables.sync_copy(spark, old, path, ["id"], SNAPSHOT)
    assert versions.read_table(spark, path).count() == 4
    # the one before is still there, as are readers of it
    assert versions.read_table(spark, path, 2).where("v = 'B'").count() == state.where("v = 'B'").count() == 1


def test_key_violations(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    got = {r.k: (r.n, r.reason) for r in tables.key_violations(df, ["k"]).collect()}
    assert got == {1: (2, "duplicate key"), None: (1, "null key")}


def test_random_sample_repeats_and_depends_on_seed(spark):
    df = alerts(spark, *[{"alert_id": f"A{i}"} for i in range(50)])

    def ids(seed):
        return [r.alert_id for r in tables.random_sample(df.repartition(7), ["alert_id"], 10, seed).collect()]

    assert ids(1) == ids(1) and ids(1) != ids(2) and len(set(ids(1))) == 10


def test_stream_takes_each_file_once_across_restarts(spark, sf_dir, tmp_path):
    landing, target, checkpoint = (str(tmp_path / n) for n in ("landing", "bronze", "offsets"))
    docs = fx.incident_documents(spark, sf_dir)
    half = F.pmod(F.xxhash64("value"), F.lit(2))

    def drop(part):
        docs.where(half == part).coalesce(1).write.mode("append").text(landing)
        incremental_ingest(spark, "bronze_incidents", landing, target, checkpoint, max_files_per_trigger=1).awaitTermination()
        return spark.read.parquet(target)

    assert drop(0).count() == docs.where(half == 0).count()
    rows = drop(1)
    assert rows.count() == docs.count() == rows.select("incident_id").distinct().count()
    incremental_ingest(spark, "bronze_incidents", landing, target, checkpoint).awaitTermination()
    assert spark.read.parquet(target).count() == docs.count()


def test_build_all_is_repeatable_and_keyed(spark, sf_dir, tmp_path):
    bronze = fx.bronze(spark, sf_dir)
    first = {n: df.count() for n, df in build_all(spark, bronze, str(tmp_path)).items()}
    built = build_all(spark, bronze, str(tmp_path))
    assert {n: df.count() for n, df in built.items()} == first
    assert set(first) == set(bronze) | set(SILVER) | set(GOLD)
    for name, key in KEYS.items():
        null_allowed = built[name].dropna(subset=key)
        assert tables.key_violations(null_allowed, key).isEmpty(), name


def test_struct_layout_is_big_endian():
    kinds = "".join(k for _, k in binary.FLOW_FIELDS)
    raw = fx.encode_flow_batch([], kinds)
    assert struct.unpack_from(">i", raw, 9) == (0,)
    assert list(binary._flow_records(raw)) == []
