"""States of daily values against their baselines, freshness of sources, alerts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.operators import daily
from vitalframe.operators.baselines import trailing_baseline


@dataclass(frozen=True)
class Rule:
    """How a metric is judged; zones are the lower bounds of the good and the middling zone."""

    direction: str = "none"
    zones: tuple[float, float] | None = None
    above_median_by: float | None = None
    below_median_pct: float | None = None
    below: float | None = None


#: Directions and thresholds of the metrics of the test tables; a parameter of the operators.
RULES = {
    "heart_rate": Rule("lower", above_median_by=25.0),
    "respiratory_rate": Rule("band"),
    "hrv_sdnn": Rule("higher", below_median_pct=15.0),
    "spo2": Rule("higher"),
    "wrist_temp": Rule("band"),
    "steps": Rule("higher"),
    "sleep_duration": Rule("higher", below=6.0),
    "glucose": Rule("band"),
    "body_fat_pct": Rule("none"),
    "active_energy": Rule("higher"),
}
BAND_K = 1.5


def state(metric: Column, value: Column, med: Column, spread: Column, rules: dict[str, Rule] | None = None, k: float = BAND_K) -> Column:
    """favorable, neutral, flag; insufficient without a baseline. Zones come first, then threshold rules, then the direction.

    The neutral band is the greater of k MADs and 2 percent of the median.
    """
    band = F.greatest(spread * k, F.abs(med) * 0.02)
    out = F.when(med.isNull(), "insufficient")
    for name, r in (rules or RULES).items():
        case = F.when(F.lit(False), "")
        if r.zones:
            case = F.when(value >= r.zones[0], "favorable").when(value >= r.zones[1], "neutral").otherwise("flag")
            out = out.when(metric == name, case)
            continue
        if r.above_median_by is not None:
            case = case.when(value >= med + r.above_median_by, "flag")
        if r.below_median_pct is not None:
            case = case.when((med != 0) & ((med - value) / F.nullif(med, F.lit(0.0)) * 100 >= r.below_median_pct), "flag")
        if r.below is not None:
            case = case.when(value < r.below, "flag")
        if r.direction == "lower":
            case = case.when(value <= med, "favorable").when(value > med + band, "flag")
        elif r.direction == "higher":
            case = case.when(value >= med, "favorable").when(value < med - band, "flag")
        elif r.direction == "band":
            case = case.when(F.abs(value - med) <= band, "favorable").otherwise("flag")
        out = out.when(metric == name, case.otherwise("neutral") if r.direction != "band" else case)
    return out.otherwise("neutral")


def signals(daily: DataFrame, baselines: DataFrame, by: list[str], rules: dict[str, Rule] | None = None) -> DataFrame:
    """Daily values with their baseline and state; delta_pct is null for a median of 0. Values that are null give no row.

    by includes metric; baselines: one row per (by..., date).
    """
    return judge(daily.filter("value is not null").join(baselines.select(*by, "date", "median", "mad", "n_days"), [*by, "date"], "left"), rules)


def judge(rows: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Adds delta_pct and state to rows (metric, value, median, mad) that have their baseline beside them."""
    delta = F.round(F.try_divide(F.col("value") - F.col("median"), F.col("median")) * 100, 1)
    delta = F.when(delta == 0, 0.0).otherwise(delta)  # no negative zero
    return rows.withColumns({"delta_pct": delta, "state": state(F.col("metric"), F.col("value"), F.col("median"), F.col("mad"), rules)})


def recompute(samples: DataFrame, policy: DataFrame, stage: Column, by: list[str], now: str, start: str, days: int, window: int = 30, rules: dict[str, Rule] | None = None) -> DataFrame:
    """(by..., metric, date, value, ..., median, mad, n_days, delta_pct, state) of the `days` days from `start` on, from the samples alone.

    The samples read are those of the span and of the `window` days before it, which its baselines need, and a day on either side
    for nights; so the cost follows the span and not the history, where the store is laid out by date.
    """
    first, end = F.date_sub(F.lit(start).cast("date"), window + 1), F.date_add(F.lit(start).cast("date"), days + 1)
    near = samples.filter(F.coalesce(F.col("end_ts") >= first, F.lit(False)) | (F.col("start_ts") >= first)).filter(F.col("start_ts") < end)
    rows = daily.daily_values(near, policy, stage, by, now).drop("corroboration")
    based = trailing_baseline(rows, [*by, "metric"], [window], keep_short=True)
    return judge(based.filter((F.col("date") >= F.lit(start).cast("date")) & (F.datediff("date", F.lit(start).cast("date")) < days)), rules)


def state_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_favorable, n_neutral, n_flag, n_judged) of the signals that have a baseline."""
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    return rows.filter("state <> 'insufficient'").groupBy(*by).agg(count("favorable").alias("n_favorable"), count("neutral").alias("n_neutral"), count("flag").alias("n_flag"), F.count(F.lit(1)).alias("n_judged"))


def last_seen(samples: DataFrame) -> DataFrame:
    """(metric, device_key, last_seen, n)."""
    return samples.groupBy("metric", "device_key").agg(F.max(F.coalesce("end_ts", "start_ts")).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def anchors(daily: DataFrame, by: list[str]) -> DataFrame:
    """(by..., anchor): the last date that has a value, from which windows count, so that they hang off the data and not the clock."""
    return daily.filter("value is not null").groupBy(*by).agg(F.max("date").alias("anchor"))


def stale_metrics(seen: DataFrame, policy: DataFrame, rank: Column, by: list[str], now: str, inactive: tuple[str, ...] = (), optional: tuple[str, ...] = ("dietary_energy",), snoozed: DataFrame | None = None) -> DataFrame:
    """(by..., metric, device_key, age_hours, freshest_hours, status) of metrics whose every ranked source is late.

    late: the freshest source is older than twice the metric's cadence (stale), four times (silent). device_key and
    age_hours are those of the best-ranked source. Inactive devices and optional metrics are left out, and so are metrics that
    `snoozed` (metric, snooze_until; a date) puts off to the day of `now` or later.
    """
    rules = F.broadcast(policy.groupBy("metric").agg(F.max("cadence_hours").alias("cadence")))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3_600_000_000
    df = seen.withColumns({"rank": rank, "age": age}).filter(F.col("rank").isNotNull() & ~F.col("device_key").isin(*inactive or [""]) & ~F.col("metric").isin(*optional or [""]))
    out = df.groupBy(*by, "metric").agg(F.min("age").alias("freshest"), F.min_by(F.struct("device_key", "age"), F.struct("rank", "device_key")).alias("best")).join(rules, "metric")
    if snoozed is not None:
        off = snoozed.filter(F.col("snooze_until") >= F.to_date(F.lit(now))).select("metric").distinct()
        out = out.join(F.broadcast(off), "metric", "left_anti")  # a row a metric
    status = F.when(F.col("freshest") > 4 * F.col("cadence"), "silent").when(F.col("freshest") > 2 * F.col("cadence"), "stale")
    return out.withColumn("status", status).filter("status is not null").select(*by, "metric", "best.device_key", F.round("best.age", 1).alias("age_hours"), F.round("freshest", 1).alias("freshest_hours"), "status")


def cooldown(alerts: DataFrame, by: list[str], ts: str, hours: float = 6.0) -> DataFrame:
    """(by..., sent_at): the first alert per key and then the next at least `hours` after the one sent last.

    Whether an alert is sent depends on the one sent before, so each key is walked in order: rows are sorted within their
    partition and streamed, one key and its last time are held, whatever the key's share. by: string columns, nulls are a
    key of their own; alerts without a time are left out.
    """
    gap = int(hours * 3_600_000_000)
    rows = alerts.filter(F.col(ts).isNotNull()).select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).distinct()
    rows = rows.repartition(*by).sortWithinPartitions(*by, "_t")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = object(), 0
        for part in parts:
            keys = list(zip(*[part[c].astype(object).where(part[c].notna(), None) for c in by])) if by else [()] * len(part)
            times, keep = part["_t"].to_numpy(), []
            for i, k in enumerate(keys):
                if k != key or times[i] - last >= gap:
                    key, last = k, times[i]
                    keep.append(i)
            yield part.iloc[keep]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(walk, kinds).select(*by, F.timestamp_micros("_t").alias("sent_at"))


def dedupe_window(events: DataFrame, key: list[str], ts: str, order: str, seconds: int = 120) -> DataFrame:
    """One row per burst: repeats of a key within `seconds` of the one before fold into the first; adds n_repeats and last_ts.

    Gap and island by lag; keys with nulls group together. Ties in time are ordered by `order`.
    """
    w = Window.partitionBy(*key).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    df = events.withColumn("_g", F.sum(F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*key, "_g").agg(F.min(order).alias(order), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_repeats")).drop("_g")
