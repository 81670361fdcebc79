"""Quantities recorded in different units: a graph of affine conversions and an equi-join on (unit, target)."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: to = a * from + b.
EDGES = [
    ("g", "kg", 0.001, 0.0),
    ("lb", "kg", 0.45359237, 0.0),
    ("st", "lb", 14.0, 0.0),
    ("fraction", "%", 100.0, 0.0),
    ("g/L", "mg/dL", 100.0, 0.0),
    ("mmol/L", "mg/dL", 18.0156, 0.0),
    ("mmol/L", "g/L", 0.180156, 0.0),
    ("mg/L", "mg/dL", 0.1, 0.0),
    ("K", "degC", 1.0, -273.15),
    ("degF", "degC", 5.0 / 9.0, -160.0 / 9.0),
    ("kJ", "kcal", 1.0 / 4.184, 0.0),
    ("J", "kJ", 0.001, 0.0),
    ("cal", "kcal", 0.001, 0.0),
    ("min", "h", 1.0 / 60.0, 0.0),
    ("s", "min", 1.0 / 60.0, 0.0),
    ("ms", "s", 0.001, 0.0),
]
#: Spellings of units, compared without case and white space; only cal and Cal differ by case.
SPELLINGS = {
    "kg": ["kg", "kgs", "kilogram", "kilograms", "kilo", "kilos"],
    "g": ["g", "gr", "gram", "grams"],
    "lb": ["lb", "lb.", "lbs", "lbs.", "pound", "pounds"],
    "st": ["st", "st.", "stone", "stones"],
    "%": ["%", "percent", "pct", "percentage"],
    "fraction": ["fraction", "1", "ratio"],
    "mg/dL": ["mg/dl"],
    "g/L": ["g/l"],
    "mg/L": ["mg/l"],
    "mmol/L": ["mmol/l", "mm", "mmol<180.156>/l", "mmol<180.1558800000541>/l"],
    "degC": ["degc", "c", "°c", "ºc", "cel", "celsius", "℃"],
    "degF": ["degf", "f", "°f", "ºf", "fahrenheit", "℉", "[degf]"],
    "K": ["k", "kelvin", "°k"],
    "kcal": ["kcal", "kilocalorie", "kilocalories", "kcals", "Cal"],
    "cal": ["cal"],
    "kJ": ["kj", "kilojoule", "kilojoules"],
    "J": ["j", "joule", "joules"],
    "h": ["h", "hr", "hrs", "hour", "hours"],
    "min": ["min", "mins", "min.", "minute", "minutes"],
    "s": ["s", "sec", "secs", "second", "seconds"],
    "ms": ["ms"],
    "count": ["count", "steps"],
    "count/min": ["count/min", "bpm", "beats/min", "breaths/min", "rpm"],
}
#: White space with the non-breaking, thin and narrow spaces.
SPACES = r"[\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+"
#: Percentages up to this are fractions.
FRACTION_UP_TO = 1.5


class UnitGraph:
    """Units as nodes, affine conversions as edges in both directions; compositions along shortest paths."""

    def __init__(self, edges=tuple(EDGES), tolerance: float = 1e-6):
        self.out: dict[str, list[tuple[str, float, float]]] = {}
        for a, b, scale, offset in edges:
            self.out.setdefault(a, []).append((b, scale, offset))
            self.out.setdefault(b, []).append((a, 1.0 / scale, -offset / scale))
        self.paths = {unit: self._from(unit) for unit in self.out}
        self._check(tolerance)

    def _from(self, start: str) -> dict[str, tuple[float, float]]:
        found, queue = {start: (1.0, 0.0)}, deque([start])
        while queue:
            unit = queue.popleft()
            scale, offset = found[unit]
            for other, s, o in self.out[unit]:
                if other not in found:
                    found[other] = (s * scale, s * offset + o)
                    queue.append(other)
        return found

    def _check(self, tolerance: float) -> None:
        """Every edge must agree with the composition of the shortest paths to its ends, from any unit: no cycle drifts."""
        for start, reach in self.paths.items():
            for unit, (scale, offset) in reach.items():
                for other, s, o in self.out[unit]:
                    direct, via = reach[other], (s * scale, s * offset + o)
                    if any(abs(x - y) > tolerance * max(1.0, abs(x)) for x, y in zip(direct, via)):
                        raise ValueError(f"conversions from {start} to {other} disagree: {direct} and {via}")

    def convert(self, source: str, target: str) -> tuple[float, float] | None:
        return (1.0, 0.0) if source == target else self.paths.get(source, {}).get(target)


def spelling(text):
    """The key under which a unit is looked up: no white space, lower case; Cal and CAL stay apart from cal."""
    plain = F.regexp_replace(text, SPACES, "")
    return F.when(plain.isin("Cal", "CAL", "Cals"), F.lit("Cal")).otherwise(F.lower(plain))


def conversion_table(spark: SparkSession, graph: UnitGraph | None = None) -> DataFrame:
    """(spelling, target, unit, scale, offset) for all spellings and the targets they reach; a fixed table of a few hundred rows."""
    graph = graph or UnitGraph()
    rows = [
        (word, target, unit, *graph.convert(unit, target))
        for unit, words in SPELLINGS.items()
        for word in words
        for target in SPELLINGS
        if graph.convert(unit, target) is not None
    ]
    return spark.createDataFrame(rows, "spelling string, target string, unit string, scale double, shift double")


_NUMBER = r"([-+]?[0-9]+(?:[.,][0-9]+)?)"


def parsed_text(text):
    """(amount, unit) of a free-text measurement, null without a number.

    A decimal comma is a point. Two-part forms are folded into the smaller unit: `7 h 54 min` and `7h06` into minutes,
    `10 st 6.2 lb` into pounds. Words before the number (about, approx., reading:, ~) are skipped.
    """
    number = lambda x: F.expr("try_cast(x as double)") if x is None else F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    hours = rf"(?i){_NUMBER}\s*h(?:ours?|rs?)?\s*([0-9]{{1,2}})\s*(?:m|min|mins|minutes)?\s*$"
    stone = rf"(?i){_NUMBER}\s*(?:st|stones?)\.?\s*{_NUMBER}\s*(?:lbs?|pounds?)?\.?\s*$"
    plain = rf"{_NUMBER}\s*(.*?)\s*$"
    two = lambda pattern, k: number(F.regexp_extract(text, pattern, 1)) * k + number(F.regexp_extract(text, pattern, 2))
    text = F.regexp_replace(text, SPACES, " ")
    clean = F.when(text.rlike(hours), F.struct(two(hours, 60).alias("amount"), F.lit("min").alias("unit")))
    clean = clean.when(text.rlike(stone), F.struct(two(stone, 14).alias("amount"), F.lit("lb").alias("unit")))
    return clean.when(text.rlike(plain), F.struct(number(F.regexp_extract(text, plain, 1)).alias("amount"), F.nullif(F.regexp_extract(text, plain, 2), F.lit("")).alias("unit")))


def to_common_units(samples: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds common_unit, common_value, source_unit (canonical, null if unknown) and changed to `samples`.

    The target is policy's unit for the metric, or for hk_type where the metric is null. Between mmol/L and mass only glucose is converted. The measurement is `value`, or,
    where that is null or NaN, the one parsed from `text_value`; its unit is the one in the text, else `unit`, else the
    common one. Percentages of at most 1.5 are fractions. changed: `value` isn't already the measurement in the common
    unit. An unknown unit or metric, or no measurement at all, gives null common_value and changed = false.

    policy and the conversions are broadcast: policy has one row a metric (it is reduced to one here), the conversions
    are fixed.
    """
    spark = samples.sparkSession
    one = policy.filter("metric is not null").groupBy("metric").agg(F.max("unit").alias("_t"))
    by_type = policy.filter("hk_type is not null").groupBy("hk_type").agg(F.max("unit").alias("_t2"))
    policy_rows = F.broadcast(one), F.broadcast(by_type)
    df = samples.join(policy_rows[0], "metric", "left").join(policy_rows[1], "hk_type", "left").withColumn("_target", F.when(F.col("metric").isNotNull(), F.col("_t")).otherwise(F.col("_t2")))
    has_value = F.col("value").isNotNull() & ~F.isnan("value")
    df = df.withColumn("_p", F.when(~F.coalesce(has_value, F.lit(False)), parsed_text(F.col("text_value"))))
    df = df.withColumns({"_amount": F.when(has_value, F.col("value")).otherwise(F.col("_p.amount")), "_unit": F.coalesce(spelling(F.col("_p.unit")), F.nullif(spelling(F.col("unit")), F.lit("")), spelling(F.col("_target")))})
    fraction = (F.col("_target") == "%") & (F.abs("_amount") <= FRACTION_UP_TO)
    df = df.withColumn("_unit", F.when(fraction, F.lit("fraction")).otherwise(F.col("_unit")))
    table = conversion_table(spark).select(F.col("spelling").alias("_unit"), F.col("target").alias("_target"), F.col("unit").alias("_source"), F.col("scale").alias("_scale"), F.col("shift").alias("_shift"))
    df = df.join(F.broadcast(table), ["_unit", "_target"], "left")
    common = F.col("_amount") * F.col("_scale") + F.col("_shift")
    # the molar edge is glucose's
    molar = (F.col("_source") == "mmol/L") != (F.col("_target") == "mmol/L")
    common = F.when(~molar | F.lower(F.coalesce("metric", "hk_type")).contains("glucose"), common)
    changed = F.col("_amount").isNotNull() & F.col("_source").isNotNull() & (~F.coalesce(has_value, F.lit(False)) | (F.col("_source") != F.col("_target")))
    return df.select(*samples.columns, F.col("_target").alias("common_unit"), common.alias("common_value"), F.col("_source").alias("source_unit"), changed.alias("changed"))
