"""Queries of the general data-pipeline problems 1 to 7, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.operators import anomalies, changefeed, delivery, grid, intervals, trailing, units
from vitalframe.session import cut, scratch, table

STAMP = "yyyy-MM-dd HH:mm:ss"


#: Parts, in order of arrival, in which a whole log is admitted to a store.
ARRIVAL_SLICES = 2


def surplus_of(spark: SparkSession, arrivals: DataFrame) -> DataFrame:
    """(origin, no) of the surplus copies of whole logs."""
    store = delivery.DeliveryStore(spark, scratch(spark, "deliveries"))
    return store.admit(arrivals, "no", "keys", "origin", slices=ARRIVAL_SLICES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = delivery.sample_keys(table(spark, sf_dir, "samples")).unionByName(delivery.batch_keys(table(spark, sf_dir, "batches")))
    return surplus_of(spark, arrivals).select("origin", F.col("no").alias("row_no"))


def kept_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples without the surplus copies of problem 1, found at once and without a store."""
    samples = table(spark, sf_dir, "samples")
    return samples.join(delivery.first_arrivals(delivery.sample_keys(samples), "no", "keys").withColumnRenamed("no", "row_id"), "row_id", "left_anti")


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "samples")
    surplus = surplus_of(spark, delivery.sample_keys(samples)).select(F.col("no").alias("row_id"))
    return samples.join(surplus, "row_id", "left_anti").select("row_id", "sample_id", "hk_uuid", "metric", "device_key")


def p1_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batches without the surplus deliveries."""
    batches = table(spark, sf_dir, "batches")
    surplus = surplus_of(spark, delivery.batch_keys(batches)).select(F.col("no").alias("delivery_no"))
    return batches.join(surplus, "delivery_no", "left_anti").select("delivery_no", "batch_id", "device", F.coalesce(F.size("samples"), F.lit(0)).alias("n_samples"))


def heart_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "samples").filter("metric = 'heart_rate'")
    return grid.regular_grid(rows, "device_key", "start_ts", "value")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = heart_grid(spark, sf_dir).filter("mark <> 'observed'")
    return missing.select(F.col("source").alias("device_key"), F.date_format("slot_start", STAMP).alias("slot_start"))


def p2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heart_grid(spark, sf_dir).select(
        F.col("source").alias("device_key"), F.date_format("slot_start", STAMP).alias("slot_start"), "n_readings", *[F.round(c, 6).alias(c) for c in ("mean_value", "estimate", "support")], "mark"
    )


def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = trailing.current_versions(table(spark, sf_dir, "daily_values"))
    stored = table(spark, sf_dir, "baselines").select("device_key", "metric", "date", "window_days", "total_value", "mean_value", "n_days")
    return trailing.trailing_totals(daily, stored)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > 0.05, F.lit(True))
    wrong = stored_windows(spark, sf_dir).filter(off("total_value", "r_total") | off("mean_value", "r_mean") | ~F.col("n_days").eqNullSafe(F.col("r_days")))
    return wrong.select("device_key", "metric", F.date_format("date", "yyyy-MM-dd").alias("date"), "window_days")


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = trailing.current_versions(table(spark, sf_dir, "daily_values"))
    out = trailing.trailing_totals(daily, trailing.every_day(daily, [7, 30]))
    return out.select("device_key", "metric", F.date_format("date", "yyyy-MM-dd").alias("date"), "window_days", F.round("r_total", 4).alias("total_value"), F.round("r_mean", 4).alias("mean_value"), F.col("r_days").alias("n_days"))


#: The metrics that problem 4 asks for.
CONVERTED = ["body_mass", "body_fat_pct", "glucose", "wrist_temp", "spo2", "active_energy", "sleep_duration"]


def common_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.to_common_units(table(spark, sf_dir, "samples"), table(spark, sf_dir, "metric_policy"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common_units(spark, sf_dir).filter(F.col("changed") & F.col("metric").isin(*CONVERTED)).select("row_id", F.round("common_value").cast("long").alias("common_value"))


def p4_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common_units(spark, sf_dir).select("row_id", "metric", "common_unit", F.round("common_value", 6).alias("common_value"), "source_unit", "changed")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the surplus test reads all rows; the readings are cut down before they meet it
    samples = table(spark, sf_dir, "samples")
    surplus = delivery.first_arrivals(delivery.sample_keys(samples), "no", "keys").withColumnRenamed("no", "row_id")
    readings = samples.filter(F.col("metric").isin(*anomalies.POSSIBLE) & F.col("value").isNotNull()).select("row_id", "device_key", "metric", "start_ts", "value")
    return anomalies.flag_readings(readings.join(surplus, "row_id", "left_anti"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).filter("impossible or spike or stuck").select("row_id")


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("row_id", "device_key", "metric", "value", "impossible", "spike", "stuck")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_state(table(spark, sf_dir, "batches")).select("hk_uuid", "batch_id")


def p6_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_state(table(spark, sf_dir, "batches"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asleep = intervals.sleep_intervals(table(spark, sf_dir, "samples"))
    merged = cut(intervals.periods(asleep, "device_key", "start_ts", "end_ts"))
    both = merged.withColumn("kind", F.lit("period")).unionByName(intervals.gaps(merged, 12 * 3600).withColumn("kind", F.lit("gap")))
    return both.select(F.col("entity").alias("device_key"), "kind", F.date_format("from_ts", STAMP).alias("from_ts"), F.date_format("to_ts", STAMP).alias("to_ts"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_deliveries, p2_found, p2_grid, p3_found, p3_totals, p4_found, p4_common, p5_found, p5_flags, p6_found, p6_state, p7_found)}
