"""Secrets in texts: all rules in one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, Rule

# The base rules, then forms that well-known services give to their keys.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", tail=8, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", tail=12),
    Rule("hex", r"[0-9a-f]+", tail=32),
)
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", tail=36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", tail=24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", tail=35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", tail=20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
KINDS = [r.kind for r in RULES]
SPANS = "array<struct<start:int,kind:int,end:int>>"


@cache
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    """Compiled once in a process."""
    return Automaton(list(rules))


def found_in(data: bytes, machine: Automaton) -> list[dict]:
    """Spans in code points, by start and kind."""
    spans = list(machine.scan(data))
    if not spans:
        return []
    places, at, points = {}, 0, 0
    for byte in sorted({p for start, _, end in spans for p in (start, end)}):
        points += len(data[at:byte].decode())
        places[byte], at = points, byte
    spans.sort()
    return [{"start": places[s], "kind": k, "end": places[e]} for s, k, e in spans]


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: array of (start, kind, end) in code points, by start, then kind (the place in ``rules``).

    A rule gives its leftmost, longest matches that do not overlap; those with too short a tail are dropped and
    not tried again. Spans of different rules may overlap. The automaton is compiled once in each Python
    process; memory is that of one batch and of one symbol a byte of the longest text.

    Cases: null and empty texts have no spans. Every row is a document, also if rows repeat or doc_id is null.
    Other columns are ignored. An empty table gives an empty result.
    """
    key = docs.schema["doc_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(rules)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            spans = [found_in(t.as_buffer().to_pybytes() if t.is_valid else b"", machine) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {key.simpleString()}, spans {SPANS}")


def printed(spans: Column, kinds: list[str] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def of_base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(BASE))
