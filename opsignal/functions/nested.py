"""Attribute lists and service lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def attribute(attrs: Column | str, key: str, variant: str = "stringValue") -> Column:
    """Value of the first attribute with this key, NULL when there is none."""
    hits = F.filter(col(attrs), lambda a: a["key"] == F.lit(key))
    return F.get(hits, F.lit(0))["value"][variant]


def touched_services(root: Column | str = "root_service", impacted: Column | str = "impacted_services") -> Column:
    """The root service and every impacted one, each once; a NULL list counts as empty."""
    none = F.array().cast("array<string>")
    listed = F.concat(F.array(col(root)), F.coalesce(col(impacted), none))
    return F.filter(F.array_distinct(listed), lambda s: s.isNotNull())


def parse_service_list(raw: Column | str) -> Column:
    """JSON array text to an array; other text is stripped of brackets and quotes and split at commas."""
    raw = col(raw)
    parsed = F.from_json(raw, "array<string>")
    is_json = parsed.isNotNull() & F.trim(raw).startswith("[")
    bare = F.split(F.regexp_replace(raw, r"^\[|\]$", ""), ",")
    cleaned = F.filter(
        F.transform(bare, lambda s: F.regexp_replace(s, r"""^['"\s]+|['"\s]+$""", "")), lambda s: s != ""
    )
    none = F.array().cast("array<string>")
    return F.when(raw.isNull() | (raw == ""), none).when(is_json, parsed).otherwise(cleaned)
