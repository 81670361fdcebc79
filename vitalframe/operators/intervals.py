"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    """Unites overlapping or touching [s, e] within `by`: order by start, compare with the running maximum end, label, aggregate."""
    ordered = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = df.withColumn("opens", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    island = opens.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def periods(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, from_ts, to_ts): the union of an entity's intervals, overlapping, nested or touching ones joined.

    Rows with a null entity, start or end, or whose end isn't after the start, cover nothing. Copies change nothing. Other
    columns are ignored. Islands are formed per entity and day first, so that an entity with a third of all rows is spread
    over its days; the second pass sees only periods that don't overlap within a day.
    """
    clean = intervals.select(F.col(entity).alias("entity"), F.col(start).alias("s"), F.col(end).alias("e")).filter("entity is not null and e > s")
    daily = _islands(clean.withColumn("day", F.to_date("s")), ["entity", "day"])
    return _islands(daily.drop("day"), ["entity"]).select("entity", F.col("s").alias("from_ts"), F.col("e").alias("to_ts"))


def gaps(merged: DataFrame, max_gap_s: int | None = None) -> DataFrame:
    """(entity, from_ts, to_ts) between successive periods of `periods`; with `max_gap_s` only gaps of at most that length."""
    following = F.lead("from_ts").over(Window.partitionBy("entity").orderBy("from_ts"))
    out = merged.select("entity", F.col("to_ts").alias("from_ts"), following.alias("to_ts")).filter("to_ts is not null")
    if max_gap_s is None:
        return out
    seconds = F.unix_micros(F.col("to_ts").cast("timestamp")) - F.unix_micros(F.col("from_ts").cast("timestamp"))
    return out.filter(seconds <= max_gap_s * 1_000_000)


#: Stages that are not sleep, in lower case without the category prefix and underscores.
NOT_ASLEEP = ("inbed", "awake")


def sleep_intervals(samples: DataFrame) -> DataFrame:
    """Rows of sleep_analysis that are sleep; a missing or blank stage counts as asleep."""
    stage = F.regexp_replace(F.regexp_replace(F.lower(F.trim("text_value")), "^hkcategoryvaluesleepanalysis", ""), "[_\\s-]", "")
    return samples.filter((F.col("metric") == "sleep_analysis") & ~F.coalesce(stage, F.lit("")).isin(*NOT_ASLEEP))
