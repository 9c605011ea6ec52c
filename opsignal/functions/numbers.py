"""Rounding, ratios and display of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up_sql(x: str, digits: int) -> str:
    """Half-up rounding on the decimal value, so summation order cannot flip a tie.

    Values beyond the decimal's range have no digits left to round and pass through.
    """
    return f"coalesce(cast(round(try_cast({x} AS decimal(28,10)), {digits}) AS double), cast({x} AS double))"


def half_up(x: Column | str, digits: int) -> Column:
    """``half_up_sql`` as a column."""
    if isinstance(x, str):
        return F.expr(half_up_sql(x, digits))
    x = x.cast("double")
    return F.coalesce(F.round(x.try_cast("decimal(28,10)"), digits).cast("double"), x)


def percent(part: Column | str, whole: Column | str, digits: int) -> Column:
    """``part`` as a percentage of ``whole``; NULL when the whole is zero."""
    ratio = col(part).cast("double") * F.lit(100.0) / F.nullif(col(whole).cast("double"), F.lit(0.0))
    return half_up(ratio, digits)


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def or_zero(x: Column | str) -> Column:
    return F.expr(f"coalesce({x}, 0)") if isinstance(x, str) else F.coalesce(x, F.lit(0))


def _fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", half_up(x, digits))


def humanize(x: Column | str) -> Column:
    """1234567 -> 1.2M, 1234 -> 1.2K, smaller values with up to three decimals, NULL -> --."""
    n = col(x).cast("double")
    plain = F.regexp_replace(F.format_number(half_up(n, 3), 3), r"\.?0+$", "")
    return (
        F.when(n.isNull(), "--")
        .when(n >= 1e6, F.concat(_fixed(n / 1e6, 1), F.lit("M")))
        .when(n >= 1e3, F.concat(_fixed(n / 1e3, 1), F.lit("K")))
        .otherwise(plain)
    )


def humanize_currency(x: Column | str) -> Column:
    """As ``humanize`` with a dollar sign; thousands and small values carry no decimals."""
    n = col(x).cast("double")
    return (
        F.when(n.isNull(), "--")
        .when(n >= 1e6, F.concat(F.lit("$"), _fixed(n / 1e6, 1), F.lit("M")))
        .when(n >= 1e3, F.concat(F.lit("$"), _fixed(n / 1e3, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), _fixed(n, 0)))
    )
