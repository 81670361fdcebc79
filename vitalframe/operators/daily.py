"""Daily values: per-device aggregates, one device chosen by priority, a confidence for the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.columns import exact_sum

#: Device kinds from the best down.
PRIORITY = ["apple_watch_ultra", "whoop", "zepp_helio", "iphone", "zepp_life_scale", "myfitnesspal"]
#: Stages counted as sleep.
ASLEEP = ("asleep", "core", "deep", "rem")
#: Weights of the parts of a confidence, the lowest score of each grade, the tolerance of agreement.
WEIGHTS = {"rank": 0.35, "freshness": 0.25, "coverage": 0.2, "agreement": 0.2}
GRADES = [("A", 0.85), ("B", 0.7), ("C", 0.5)]
TOLERANCE_PCT = 12.0


def day_of(metric: Column, start: Column, end: Column) -> Column:
    """Sleep belongs to the day it ends on, everything else to the day it starts on."""
    return F.to_date(F.when(metric.isin("sleep_analysis", "sleep_duration"), F.coalesce(end, start)).otherwise(start))


def per_device(samples: DataFrame, policy: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, date, device_key, value, n): one value per device and day, by the metric's agg: sum, avg or last.

    policy (metric, agg) is broadcast, made unique here. Null values don't count; metrics with another agg or without a
    policy row are left out. `last` takes the latest start, ties by row_id. Values are rounded to three places.
    """
    how = policy.groupBy("metric").agg(F.max("agg").alias("agg")).filter(F.col("agg").isin("sum", "avg", "last"))
    rows = samples.filter("value is not null and not isnan(value)").withColumn("date", day_of(F.col("metric"), F.col("start_ts"), F.col("end_ts"))).join(F.broadcast(how), "metric")
    # one number that orders by (start, row_id): with a struct the aggregation would have to sort all rows
    order = F.unix_micros(F.col("start_ts").cast("timestamp")).cast("decimal(20,0)") * F.lit(10**15).cast("decimal(16,0)") + F.col("row_id")
    out = rows.groupBy(*by, "metric", "date", "device_key", "agg").agg(exact_sum(F.col("value")).alias("s"), F.count(F.lit(1)).alias("n"), F.max_by("value", F.when(F.col("agg") == "last", order)).alias("l"))
    value = F.when(F.col("agg") == "sum", F.col("s")).when(F.col("agg") == "avg", F.col("s") / F.col("n")).otherwise(F.col("l"))
    return out.select(*by, "metric", "date", "device_key", F.round(value, 3).alias("value"), "n")


def sleep_hours(samples: DataFrame, stage: Column, by: list[str], no_stages: tuple[str, ...] = ("whoop",)) -> DataFrame:
    """(by..., date, device_key, value, n=1): hours asleep, the greater of direct sleep_duration rows and summed stages.

    Where a device has core, deep or rem stages, their sum counts and plain `asleep` doesn't. Devices of the kinds in
    `no_stages` have only direct values. Both sides meet by conditional sums in one pass, which is the full outer join of
    their days; values of 0 or less are left out.
    """
    rows = samples.filter("metric in ('sleep_duration', 'sleep_analysis') and value is not null").withColumn("stage", stage)
    staged = (F.col("metric") == "sleep_analysis") & ~F.col("device_key").rlike("^(" + "|".join(no_stages) + ")")
    part = lambda *names: F.coalesce(exact_sum(F.when(staged & F.col("stage").isin(*names), F.col("value"))), F.lit(0.0))
    sums = rows.groupBy(*by, F.to_date(F.coalesce("end_ts", "start_ts")).alias("date"), "device_key").agg(
        exact_sum(F.when(F.col("metric") == "sleep_duration", F.col("value"))).alias("direct"), part("core", "deep", "rem").alias("deepish"), part("asleep").alias("plain")
    )
    hours = F.when(F.col("deepish") > 0, F.col("deepish")).otherwise(F.col("plain")) / 60
    out = sums.withColumn("value", F.round(F.greatest("direct", hours), 2))
    return out.filter("value > 0").select(*by, "date", "device_key", "value", F.lit(1).cast("long").alias("n"))


def rank_of(device_key: Column, priority: list[str] = PRIORITY) -> Column:
    """Position of the device's kind in the priority list, null outside it. A key is a kind, or kind_number."""
    kind = F.regexp_replace(device_key, "_[0-9]+$", "")
    return F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), kind), F.lit(0)).cast("int") - 1


def arbitrate(devices: DataFrame, by: list[str], priority: list[str] = PRIORITY) -> DataFrame:
    """The best-ranked device present per (by..., metric, date), ties by device_key; the others as a map device -> value.

    Values of several devices are never averaged. Devices outside the list take no part.
    """
    ranked = devices.withColumn("rank", rank_of(F.col("device_key"), priority)).filter("rank is not null")
    entry = F.struct("device_key", "value", "n", "rank")
    out = ranked.groupBy(*by, "metric", "date").agg(F.min_by(entry, F.struct("rank", "device_key")).alias("best"), F.collect_list(F.struct("device_key", "value")).alias("all"))
    others = F.array_sort(F.filter("all", lambda x: x["device_key"] != F.col("best.device_key")))
    return out.select(*by, "metric", "date", "best.*", F.map_from_entries(others).alias("corroboration"))


def agreement(value: Column, others: Column, tolerance_pct: float = TOLERANCE_PCT) -> Column:
    """Share of the others within the tolerance of `value`; 0.6 where there is nothing to compare with, or value is 0."""
    near = F.filter(others, lambda v: F.abs(v - value) / F.abs(value) * 100 <= tolerance_pct)
    return F.when((F.size(others) <= 0) | value.isNull() | (value == 0), F.lit(0.6)).otherwise(F.size(near) / F.size(others))


def freshness_ratio(now: Column, day: Column, last_day: Column, cadence_hours: Column) -> Column:
    """Age over the cadence, counted from the end of the day; 0 for any but the last day of the window."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(day.cast("timestamp"))) / 3_600_000_000 - 24
    return F.when(day == last_day, F.greatest(age, F.lit(0.0)) / cadence_hours).otherwise(F.lit(0.0))


def coverage(n: Column, agg: Column) -> Column:
    return F.when(agg == "sum", F.lit(1.0)).otherwise(F.least(n / 3, F.lit(1.0)))


def confidence(rank: Column, fresh: Column, cover: Column, agree: Column) -> Column:
    """The weighted score: rank 0, 1, other, none count 1, .7, .5, .25; freshness falls from 1 to 0 between ratio 1 and 2."""
    by_rank = F.when(rank == 0, 1.0).when(rank == 1, 0.7).when(rank.isNotNull(), 0.5).otherwise(0.25)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return WEIGHTS["rank"] * by_rank + WEIGHTS["freshness"] * clip(2 - F.greatest(fresh, F.lit(0.0))) + WEIGHTS["coverage"] * clip(cover) + WEIGHTS["agreement"] * agree


def grade(score: Column) -> Column:
    out = None
    for letter, least in GRADES:
        # sums of the weights fall a hair short of the bounds in binary
        hit = score >= least - 1e-12
        out = F.when(hit, letter) if out is None else out.when(hit, letter)
    return out.otherwise("D")


def scored_values(samples: DataFrame, policy: DataFrame, stage: Column, by: list[str], now: str, priority: list[str] = PRIORITY) -> DataFrame:
    """(by..., metric, date, device_key, value, n, rank, corroboration, score): arbitrated values with their unrounded score."""
    devices = per_device(samples, policy, by).unionByName(sleep_hours(samples, stage, by).withColumn("metric", F.lit("sleep_duration")))
    chosen = arbitrate(devices, by, priority).withColumn("last_day", F.max("date").over(Window.partitionBy(*by, "metric")))
    rules = F.broadcast(policy.groupBy("metric").agg(F.max("agg").alias("agg"), F.max("cadence_hours").alias("cadence")))  # one row a metric
    df = chosen.join(rules, "metric", "left")
    fresh = freshness_ratio(F.lit(now).cast("timestamp_ntz"), F.col("date"), F.col("last_day"), F.coalesce("cadence", F.lit(26)))
    score = confidence(F.col("rank"), fresh, coverage(F.col("n"), F.col("agg")), agreement(F.col("value"), F.map_values("corroboration")))
    return df.select(*by, "metric", "date", "device_key", "value", "n", "rank", "corroboration", score.alias("score"))


def daily_values(samples: DataFrame, policy: DataFrame, stage: Column, by: list[str], now: str, priority: list[str] = PRIORITY) -> DataFrame:
    """(by..., metric, date, value, device_key, n, confidence, grade, corroboration) of all metrics in one plan.

    `now` is a timestamp text; freshness counts on the last day of each (by..., metric) only.
    """
    df = scored_values(samples, policy, stage, by, now, priority)
    return df.select(*by, "metric", "date", "value", "device_key", "n", F.round("score", 3).alias("confidence"), grade(F.col("score")).alias("grade"), "corroboration")
