"""Trailing baselines, trends and comparisons of daily series. Calendar arithmetic throughout: gaps never shift a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.columns import exact_avg, let, mad, middle, upper_median


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01"))


def trailing_baseline(daily: DataFrame, by: list[str], windows: list[int], min_days: int = 7, keep_short: bool = False) -> DataFrame:
    """(by..., date, value, window_days, median, mad, n_days) of the values in [date - w, date); below `min_days` no row,
    or with `keep_short` one whose median and mad are null (and the other columns of `daily` stay).

    One range frame over the longest window and a filter of it for each shorter one. Null values don't count.
    """
    longest = max(windows)
    frame = Window.partitionBy(*by).orderBy(day_number(F.col("date"))).rangeBetween(-longest, -1)
    df = daily.withColumn("_past", F.collect_list(F.when(F.col("value").isNotNull(), F.struct(day_number(F.col("date")).alias("d"), "value"))).over(frame))

    def stats(w: int) -> Column:
        values = F.array_sort(F.transform(F.filter("_past", lambda x: x["d"] >= day_number(F.col("date")) - w), lambda x: x["value"]))
        enough = lambda v, x: F.when(F.size(v) >= min_days, x)
        whole = lambda v, m: F.struct(F.lit(w).alias("window_days"), enough(v, m).alias("median"), enough(v, mad(v, m)).alias("mad"), F.size(v).alias("n_days"))
        return let(values, lambda v: let(middle(v), lambda m: whole(v, m)))

    # exploding also keeps the optimizer from copying these expressions into everything that mentions a median
    df = df.withColumn("_s", F.explode(F.array(*[stats(w) for w in windows]))).select(*[c for c in daily.columns], "_s.*")
    return df if keep_short else df.filter(F.col("n_days") >= min_days).select(*by, "date", "value", "window_days", "median", "mad", "n_days")


def latest(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in `order` (which must be total); Spark limits within groups before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def half_trend(daily: DataFrame, by: list[str], tolerance_pct: float = 3.0) -> DataFrame:
    """(by..., first_avg, second_avg, pct, trend): the first n // 2 days (one at least) against the rest.

    trend: rising, falling or steady within the tolerance; null where a half is empty or the first is 0.
    """
    whole = Window.partitionBy(*by)
    df = daily.filter("value is not null").withColumns({"_k": F.row_number().over(whole.orderBy("date")), "_n": F.count(F.lit(1)).over(whole)})
    head = F.col("_k") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(1))
    out = df.groupBy(*by).agg(exact_avg(F.when(head, F.col("value"))).alias("first_avg"), exact_avg(F.when(~head, F.col("value"))).alias("second_avg"))
    pct = F.try_divide(F.col("second_avg") - F.col("first_avg"), F.abs("first_avg")) * 100
    trend = F.when(pct > tolerance_pct, "rising").when(pct < -tolerance_pct, "falling").when(pct.isNotNull(), "steady")
    return out.select(*by, "first_avg", "second_avg", F.round(pct, 4).alias("pct"), trend.alias("trend"))


def compare_periods(daily: DataFrame, by: list[str], anchor: Column, days: int, before: int) -> DataFrame:
    """(by..., current, previous, change_pct): upper medians of [anchor - days, anchor] and of the `before` days ahead of it."""
    d = F.datediff(F.col("date"), anchor)
    pick = lambda keep: upper_median(F.collect_list(F.when(keep, F.col("value"))))
    out = daily.filter("value is not null").groupBy(*by).agg(pick((d >= -days) & (d <= 0)).alias("current"), pick((d >= -days - before) & (d < -days)).alias("previous"))
    return out.withColumn("change_pct", F.round(F.try_divide(F.col("current") - F.col("previous"), F.col("previous")) * 100, 1))


def week_over_week(daily: DataFrame, by: list[str], anchor: Column) -> DataFrame:
    """(by..., avg_7d, avg_prev_7d, same_weekday_last_week, median): of (a-7, a], (a-14, a-7], day a-7 and all days."""
    d = F.datediff(F.col("date"), anchor)
    avg = lambda keep: exact_avg(F.when(keep, F.col("value")))
    return daily.filter("value is not null").groupBy(*by).agg(
        avg((d > -7) & (d <= 0)).alias("avg_7d"), avg((d > -14) & (d <= -7)).alias("avg_prev_7d"), F.max(F.when(d == -7, F.col("value"))).alias("same_weekday_last_week"), upper_median(F.collect_list("value")).alias("median")
    )


def week_trend(daily: DataFrame, by: list[str], anchor: Column) -> DataFrame:
    """(by..., head, mean_before, delta): the anchor day against the mean of the six days before that have a value."""
    d = F.datediff(F.col("date"), anchor)
    out = daily.filter("value is not null").groupBy(*by).agg(F.max(F.when(d == 0, F.col("value"))).alias("head"), exact_avg(F.when((d < 0) & (d >= -6), F.col("value"))).alias("mean_before"))
    return out.withColumn("delta", F.round(F.col("head") - F.col("mean_before"), 4))


def date_spine(daily: DataFrame, by: list[str], anchor: Column, days: int = 7) -> DataFrame:
    """The series over the `days` dates that end on the anchor, days without a row with a null value."""
    groups = daily.select(*by).distinct().select(*by, F.explode(F.sequence(F.date_sub(anchor, days - 1), anchor)).alias("date"))
    return groups.join(daily.select(*by, "date", "value"), [*by, "date"], "left")


def night_windows(asleep: DataFrame, by: list[str]) -> DataFrame:
    """(by..., date, start_ts, end_ts, midpoint): from the first start to the last end of the stages that end on a date."""
    out = asleep.filter("end_ts > start_ts").groupBy(*by, F.to_date("end_ts").alias("date")).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    middle = F.timestamp_seconds(F.floor((F.unix_micros(F.col("start_ts").cast("timestamp")) + F.unix_micros(F.col("end_ts").cast("timestamp"))) / 2_000_000))
    return out.withColumn("midpoint", F.hour(middle) + F.minute(middle) / 60)


def midpoint_shift(nights: DataFrame, by: list[str], days: int = 14, least: int = 5, hours: float = 2.0) -> DataFrame:
    """Adds usual (upper median of the previous nights' midpoints) and shifted (circular distance of at least `hours`)."""
    frame = Window.partitionBy(*by).orderBy(day_number(F.col("date"))).rangeBetween(-days, -1)
    df = nights.withColumn("_past", F.collect_list("midpoint").over(frame)).withColumn("usual", F.when(F.size("_past") >= least, upper_median(F.col("_past"))))
    away = F.abs(F.col("midpoint") - F.col("usual"))
    return df.withColumn("shifted", F.coalesce(F.least(away, 24 - away) >= hours, F.lit(False))).drop("_past")


def night_flags(nights: DataFrame, warm_months: tuple[int, ...] = (5, 6, 7, 8, 9, 10)) -> DataFrame:
    """Adds context: late_night (start between 1:00 and 12:00), heat (month), travel_or_shifted_schedule (see midpoint_shift)."""
    hour = F.hour("start_ts")
    return nights.withColumn(
        "context", F.array_compact(F.array(F.when((hour >= 1) & (hour < 12), "late_night"), F.when(F.month("date").isin(*warm_months), "heat"), F.when(F.col("shifted"), "travel_or_shifted_schedule")))
    )
