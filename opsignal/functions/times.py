"""Calendar parts, durations and windows relative to the newest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import col


def calendar(ts: Column | str, prefix: str, parts: tuple[str, ...]) -> list[Column]:
    """The named parts of a timestamp as ``<prefix>_<part>`` (day_of_week: 1 = Sunday, ISO week)."""
    ts = col(ts)
    build = {
        "date": F.to_date,
        "hour": F.hour,
        "day_of_week": F.dayofweek,
        "week": F.weekofyear,
        "month": F.month,
        "year": F.year,
    }
    return [build[p](ts).alias(f"{prefix}_{p}") for p in parts]


def whole_minutes(start: Column | str, end: Column | str) -> Column:
    """Full minutes from start to end, truncated toward zero."""
    return F.timestamp_diff("MINUTE", col(start), col(end))


def recent(df: DataFrame, ts: str, days: int, anchor: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``days`` days counted back from the newest ``ts`` of the anchor table."""
    newest = (df if anchor is None else anchor).agg(F.max(ts)).scalar()
    if dict(df.dtypes)[ts] == "date":
        return df.where(F.col(ts) >= F.date_sub(newest, days))
    return df.where(F.col(ts) >= newest - F.make_dt_interval(days=F.lit(days)))


def from_nanos(nanos: Column | str) -> Column:
    """Epoch nanoseconds to a microsecond timestamp without passing through doubles."""
    return F.timestamp_micros(F.call_function("div", col(nanos), F.lit(1000)))
