"""Column builders: exact sums, medians, text forms, the normal tail and other pieces shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(column: Column) -> Column:
    """Sum that doesn't depend on the order of rows: through decimals of four places."""
    return F.sum(column.cast("decimal(24,4)")).cast("double")


def exact_avg(column: Column) -> Column:
    return F.sum(column.cast("decimal(24,4)")).cast("double") / F.count(column)


def median(column: Column) -> Column:
    """Mean of the middle two; null for no values."""
    return F.percentile(column, F.lit(0.5))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: column expressions that mention another repeat its work."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def middle(ordered: Column) -> Column:
    """Median of an ordered array without nulls; null for an empty one."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array without nulls; null for an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def mad(values: Column, center: Column) -> Column:
    """Median of the absolute deviations from `center` of an array, unscaled."""
    return let(F.array_sort(F.transform(values, lambda x: F.abs(x - center))), middle)


def canonical_number(value: Column, text: Column | None = None) -> Column:
    """A number with up to six decimals and no trailing zeros; -0 and an empty form give 0; null gives None, or the text."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")
    form = F.when(plain.isin("", "-0"), "0").otherwise(plain)
    return F.when(value.isNotNull() & ~F.isnan(value), form).otherwise(F.coalesce(text, F.lit("None")) if text is not None else F.lit("None"))


def normal_tail(x: Column) -> Column:
    """P(Z > x) by a Chebyshev fit of erfc with a relative error of about 1e-7; only exp and a polynomial, so that SQL engines agree."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + z / 2)
    # fixed values: coefficients of the fit, lowest power first
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = F.lit(c) + t * poly
    half = 0.5 * t * F.exp(-z * z + poly)
    return F.when(x >= 0, half).otherwise(1 - half)


def normal_tail_sql(x: str) -> str:
    """The same in SQL text."""
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    z = f"(abs({x}) / sqrt(2.0::double))"
    t = f"(1 / (1 + {z} / 2))"
    poly = f"{fit[-1]}::double"
    for c in reversed(fit[:-1]):
        poly = f"({c}::double + {t} * {poly})"
    half = f"(0.5::double * {t} * exp(-{z} * {z} + {poly}))"
    return f"(case when {x} >= 0 then {half} else 1 - {half} end)"


def hours_minutes(hours: Column) -> Column:
    """7.21 -> '7 hours 13 minutes', 8.0 -> '8 hours'; minutes carry at 60. Null gives null."""
    minutes = F.round(hours * 60).cast("long")
    h, m = F.floor(minutes / 60).cast("long"), F.pmod(minutes, F.lit(60)).cast("long")
    return F.when(m > 0, F.format_string("%d hours %d minutes", h, m)).when(hours.isNotNull(), F.format_string("%d hours", h))


def compact_number(value: Column) -> Column:
    """Thousands with separators and no decimals, smaller ones with one decimal."""
    return F.when(F.abs(value) >= 1000, F.format_number(value, 0)).when(value.isNotNull(), F.format_string("%.1f", value))


def html_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell glob as an anchored regular expression."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def delta_arrow(value: Column, base: Column, tolerance_pct: float = 1.5) -> Column:
    """up, down or flat by the change in percent of `base`; null where either is null or the base is 0."""
    pct = (value - base) / F.nullif(F.abs(base), F.lit(0.0)) * 100
    return F.when(pct > tolerance_pct, "up").when(pct < -tolerance_pct, "down").when(pct.isNotNull(), "flat")
