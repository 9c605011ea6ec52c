"""Reading many binary records at once: positions of all records move on together, field by field, and values are
gathered as whole columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: With fewer records than this left, the rest is not worth array operations.
FEW = 8


def record_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column and where each record starts and stops in them. One spare byte lies behind."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return np.concatenate([raw, np.zeros(16, dtype=np.uint8)]), at[:-1].copy(), at[1:].copy()


def numbers(buf: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Fixed-width values at these positions; ``kind`` as numpy writes it, for instance ``>i4``."""
    width = np.dtype(kind).itemsize
    return buf[at[:, None] + np.arange(width)].reshape(-1).view(kind).astype(np.dtype(kind).newbyteorder("="))


def texts(buf: np.ndarray, start: np.ndarray, size: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """The texts at these positions; null where not ``known``. Raises ValueError if one is not UTF-8."""
    if known is not None:
        size = np.where(known, size, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    valid = None if known is None else pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    out = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()), valid)
    out.validate(full=True)
    return out.cast(pa.string())


def varints(buf: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base-128 numbers: value, position after it, and whether it ended in time."""
    value = np.zeros(len(at), dtype=np.uint64)
    at, going = at.copy(), np.ones(len(at), dtype=bool)
    for i in range(10):
        byte = buf[np.minimum(at, len(buf) - 1)]
        value = np.where(going, value | ((byte & 127).astype(np.uint64) << np.uint64(7 * i)), value)
        at = at + going
        going = going & (byte > 127)
        if not going.any():
            break
    return value, at, ~going & (at <= stop)


@dataclass
class Fields:
    """All fields of many messages in the order of their position within each: which message, field number, wire kind,
    the number (kind 0), start and stop of the bytes (else). ``bad`` are messages that need a closer look."""

    message: np.ndarray
    number: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    bad: np.ndarray

    def where(self, mask: np.ndarray) -> Fields:
        return Fields(*(c[mask] for c in (self.message, self.number, self.kind, self.value, self.start, self.stop)), self.bad)

    def last(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``n`` messages whether it has any field here, and the place of its last one."""
        place = np.full(n, -1, dtype=np.int64)
        place[self.message] = np.arange(len(self.message))
        return place >= 0, np.maximum(place, 0)


def fields(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Fields:
    """Fields of protocol buffer messages. Every round reads one field of each message that goes on. Messages that
    are broken, that hold field numbers above 15, or that go on when few others do, are marked bad."""
    bad = np.zeros(len(start), dtype=bool)
    live = np.flatnonzero(start < stop)
    at, end = start[live], stop[live]
    rows: list[tuple] = []
    rounds = 0
    while len(live):
        if rounds > 16 and len(live) < FEW:
            bad[live] = True
            break
        rounds += 1
        tag = buf[at]
        kind, at = tag & 7, at + 1
        value, after, whole = varints(buf, at, end)
        lead = kind == 2
        begin = np.where(lead, after, at)
        size = np.select([lead, kind == 1, kind == 5], [np.minimum(value, np.uint64(1 << 40)).astype(np.int64), 8, 4], 0)
        close = np.where(kind == 0, after, begin + size)
        good = (tag < 128) & np.isin(kind, (0, 1, 2, 5)) & (whole | (kind == 1) | (kind == 5)) & (close <= end)
        bad[live[~good]] = True
        rows.append(tuple(c[good] for c in (live, tag >> 3, kind, value, begin, close)))
        going = good & (close < end)
        live, at, end = live[going], close[going], end[going]
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return Fields(none, none, none, none.astype(np.uint64), none, none, bad)
    columns = [np.concatenate(c) for c in zip(*rows)]
    order = np.argsort(columns[0], kind="stable")
    return Fields(*(c[order] for c in columns), bad)
