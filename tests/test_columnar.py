"""Records read as columns against records read one by one."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from opsignal import fixtures as fx
from opsignal.sources import binary, columnar

KINDS = "".join(k for _, k in binary.FLOW_FIELDS)


def metric_records(rnd, n):
    out = []
    for _ in range(n):
        form = rnd.choice(["gauge", "sum", "histogram"])
        point = {
            "gauge": ("é" * rnd.randrange(60), "%", rnd.uniform(-9, 9), None, None, form, rnd.randrange(1 << 62)),
            "sum": ("", "", rnd.randrange(-9, 9), None, None, form, rnd.randrange(99)),
            "histogram": ("lat" * rnd.randrange(70), "ms", None, rnd.choice([0, 1, 127, 128, 300, 2**63 + 5, 2**64 - 1]), rnd.random(), form, 0),
        }[form]
        out += [m for _, m in binary._metric_messages(fx.encode_metric_document({}, "s", [point]))]
    return out


def flow_records(rnd, n):
    value = {"s": lambda: "ü" * rnd.randrange(40), "i": lambda: rnd.randrange(-(1 << 31), 1 << 31), "q": lambda: rnd.randrange(-(1 << 63), 1 << 63), "?": lambda: rnd.random() < 0.5}
    batch = fx.encode_flow_batch([tuple(value[k]() for k in KINDS) for _ in range(n)], KINDS)
    return [r for _, r in binary._flow_records(batch)]


def one_by_one(read, record):
    try:
        return list(read(record))
    except (ValueError, IndexError, binary.struct.error):
        return None


def damaged(rnd, record):
    cut = rnd.randrange(len(record) + 1)
    return rnd.choice([record[:cut], record[:cut] + bytes([rnd.randrange(256)]) + record[cut + 1 :], record + record, b"", record[:cut] + b"\xff" * 12])


@pytest.mark.parametrize("make, read, at_once", [(metric_records, binary._points, binary._point_columns), (flow_records, binary._flow, binary._flow_columns)])
@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_same_rows_or_left_to_be_read_alone(make, read, at_once, share):
    rnd = random.Random(5)
    for _ in range(30):
        records = [damaged(rnd, r) if rnd.random() < share else r for r in make(rnd, rnd.choice([0, 1, 5, 60]))]
        try:
            of, columns, left = at_once(pa.array(records, pa.binary()))
        except (ValueError, pa.ArrowInvalid):
            # one text is not UTF-8, so the whole batch is read one by one
            assert any(one_by_one(read, r) is None for r in records)
            continue
        got: dict[int, list] = {i: [] for i in range(len(records))}
        for i, row in zip(of.tolist(), zip(*[c.to_pylist() for c in columns])):
            got[i].append(row)
        for i, record in enumerate(records):
            if i in set(left.tolist()):
                assert got[i] == []
            else:
                want = one_by_one(read, record)
                # a broken record is never read as columns, whatever is read is the same
                assert want is not None and list(map(repr, got[i])) == list(map(repr, want)), (i, record)
        if share == 0:
            assert len(left) == 0


def test_long_messages_and_slices():
    points = [("m" + str(i), "u", float(i), None, None, "gauge", i) for i in range(300)]
    records = [m for _, m in binary._metric_messages(fx.encode_metric_document({}, "s", points))]
    # one message with very many points among short ones is left to be read alone
    body = records[0] + records[1] * 400
    of, columns, left = binary._point_columns(pa.array([*records, body], pa.binary()).slice(100))
    assert left.tolist() == [200] and of.tolist() == list(range(200))
    assert columns[2].to_pylist() == [float(i) for i in range(100, 300)]
    assert len(list(binary._points(body))) > 1


def test_no_text_outside_utf8_passes():
    with pytest.raises((ValueError, pa.ArrowInvalid)):
        columnar.texts(*columnar.record_bytes(pa.array([b"\xff\xfe"]))[:2], size=__import__("numpy").array([2]))


def test_a_batch_of_rejects_and_one_bad_text(spark, tmp_path):
    good = fx.encode_metric_document({"service.name": "svc"}, "s", [("cpu", "1", 1.0, None, None, "gauge", 5)])
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.pb").write_bytes(good)
    (tmp_path / "m" / "b.pb").write_bytes(good.replace(b"cpu", b"\xff\xfe\xfd"))
    (tmp_path / "m" / "c.pb").write_bytes(b"\x0b\x01")
    decoded = binary.decode_metrics(binary.read_files(spark, str(tmp_path / "m"))).coalesce(1)
    assert [r.metric_name for r in binary.metrics_table(decoded).collect()] == ["cpu"]
    assert binary.rejected_files(decoded).count() == 2
    only_bad = binary.decode_flows(binary.read_files(spark, str(tmp_path / "m")))
    assert binary.rejected_files(only_bad).count() == 3 and binary.flows_table(only_bad).count() == 0
