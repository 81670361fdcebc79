"""Normalising, identifying and storing raw samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalframe.functions.columns import canonical_number, exact_sum, glob_regex

SAMPLE_DTO = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("uuid", "hk_type", "type", "metric", "value", "text_value", "unit", "start", "start_ts", "end", "end_ts", "source_name", "source")]))
BATCH = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("device", T.StringType()), T.StructField("sent_at", T.StringType()), T.StructField("sync_path", T.StringType()), T.StructField("samples", SAMPLE_DTO), T.StructField("deleted", T.ArrayType(T.StringType()))])

#: Sleep stages by their category names.
STAGES = {
    "HKCategoryValueSleepAnalysisInBed": "in_bed",
    "HKCategoryValueSleepAnalysisAsleep": "asleep",
    "HKCategoryValueSleepAnalysisAsleepUnspecified": "asleep",
    "HKCategoryValueSleepAnalysisAwake": "awake",
    "HKCategoryValueSleepAnalysisAsleepCore": "core",
    "HKCategoryValueSleepAnalysisAsleepDeep": "deep",
    "HKCategoryValueSleepAnalysisAsleepREM": "rem",
}


@dataclass
class Registry:
    """Source names to devices: globs in order, the first that fits wins; ignored ones come first and give null."""

    devices: list[tuple[str, list[str]]] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    fallback: str = "other"

    def resolve(self, source: Column) -> Column:
        """Case-sensitive; non-breaking and narrow spaces count as spaces. Null gives the fallback."""
        name = F.trim(F.translate(source, "  ", "  "))
        out = None
        for key, patterns in [(None, self.ignored), *self.devices]:
            for p in patterns:
                hit, key_col = name.rlike(glob_regex(p)), F.lit(key).cast("string")
                out = F.when(hit, key_col) if out is None else out.when(hit, key_col)
        return F.lit(self.fallback) if out is None else out.otherwise(F.lit(self.fallback))


#: A consistent registry for the test tables' sources.
DEFAULT_REGISTRY = Registry(
    devices=[
        ("whoop", ["WHOOP*"]),
        ("zepp_life_scale", ["Zepp Life*"]),
        ("zepp_helio", ["Zepp*"]),
        ("apple_watch_ultra", ["*Apple Watch*", "*Watch"]),
        ("iphone", ["*iPhone*"]),
        ("myfitnesspal", ["MyFitnessPal*"]),
    ],
    ignored=["Athlytic*", "SleepWatch*"],
)


def stage_of(text: Column) -> Column:
    """The short stage name; unknown text stays, missing or blank is asleep."""
    known = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, text), F.nullif(F.trim(text), F.lit("")), F.lit("asleep"))


def instant(text: Column, tz: str = "UTC") -> Column:
    """ISO 8601 text to naive local time of `tz`, cut to seconds; text without offset is local already. Null if unreadable."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    moved = F.from_utc_timestamp(F.try_to_timestamp(text), tz)
    return F.date_trunc("second", F.when(zoned, moved).otherwise(F.try_to_timestamp(text))).cast("timestamp_ntz")


def content_id(hk_type: Column, start: Column, end: Column, source: Column, value: Column, text: Column) -> Column:
    """`ch2:` and the SHA-1 of type, start, end, source, canonical value and text, joined by bars; nulls as None."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    parts = [F.coalesce(hk_type, F.lit("None")), F.date_format(start, fmt), F.date_format(end, fmt), F.coalesce(source, F.lit("None")), canonical_number(value), F.coalesce(text, F.lit(""))]
    return F.concat(F.lit("ch2:"), F.sha1(F.concat_ws("|", *parts).cast("binary")))


def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per sample of the batches' lists; null and empty lists give none."""
    return batches.select("batch_id", "sync_path", F.explode("samples").alias("x")).select("batch_id", "sync_path", "x.*")


def normalize(raw: DataFrame, policy: DataFrame, registry: Registry = DEFAULT_REGISTRY, tz: str = "UTC") -> DataFrame:
    """Raw sample structs to rows of the store.

    raw: hk_type or type, metric, value, text_value, unit, start or start_ts, end or end_ts, source_name or source, uuid (all
    strings; absent columns count as null), plus batch_id and sync_path. A row is dropped if its metric is neither given nor
    known for its type, its source is ignored, or its start can't be read. The end defaults to the start. Sleep stages
    become text with the minutes as value; other values that aren't numbers move to text_value; blood oxygen up to 1.5 is a
    fraction. policy (metric, hk_type, unit) has a row per metric and is broadcast after it is made unique.
    """
    have = set(raw.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    kinds = policy.filter("hk_type is not null").groupBy("hk_type").agg(F.max("metric").alias("_m"))
    units = policy.filter("metric is not null").groupBy("metric").agg(F.max("unit").alias("_u"))
    df = raw.select(
        pick("hk_type", "type").alias("hk_type"), pick("metric").alias("_given"), pick("value").alias("_v"), pick("text_value").alias("_t"), pick("unit").alias("_unit"),
        instant(pick("start", "start_ts"), tz).alias("start_ts"), instant(pick("end", "end_ts"), tz).alias("_end"), pick("source_name", "source").alias("source_name"),
        pick("uuid").alias("hk_uuid"), pick("batch_id").alias("batch_id"), pick("sync_path").alias("sync_path"),
    )
    df = df.join(F.broadcast(kinds), "hk_type", "left").withColumn("metric", F.coalesce("_given", "_m")).join(F.broadcast(units), "metric", "left")
    df = df.withColumn("device_key", registry.resolve(F.col("source_name"))).filter("metric is not null and device_key is not null and start_ts is not null")
    df = df.withColumn("end_ts", F.coalesce("_end", "start_ts")).withColumn("_n", F.col("_v").try_cast("double"))
    sleep = F.col("metric") == "sleep_analysis"
    minutes = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 60_000_000
    number = F.when((F.col("metric") == "spo2") & (F.col("_n") <= 1.5), F.col("_n") * 100).otherwise(F.col("_n"))
    text = F.when(sleep, stage_of(F.coalesce("_t", F.when(F.col("_n").isNull(), F.col("_v"))))).when(F.col("_n").isNull() & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col("_t"))
    df = df.withColumns({"value": F.when(sleep, minutes).otherwise(number), "text_value": text, "unit": F.coalesce("_unit", "_u")})
    ident = content_id(F.coalesce("hk_type", "metric"), F.col("start_ts"), F.col("end_ts"), F.col("source_name"), F.col("value"), F.col("text_value"))
    return df.select(ident.alias("sample_id"), "hk_uuid", "batch_id", "metric", "hk_type", "value", "text_value", "unit", "start_ts", "end_ts", "source_name", "device_key", "sync_path")


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in `order`; rows with a null key all stay. By min_by of a struct: partial aggregation, no sort."""
    columns = [c for c in rows.columns if c != key]
    keyed = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_x")).select(key, "_x.*")
    return keyed.select(*rows.columns).unionByName(rows.filter(F.col(key).isNull()))


def upsert(stored: DataFrame, changed: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both together with one row per key: the one with the highest version (a changed row wins a tie)."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(changed.withColumn("_side", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("_side"))).alias("_x")).select(*keys, "_x.*").select(*stored.columns)


def retract(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the tombstones; null keys stay."""
    return rows.join(tombstones.select(F.col(key).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def commit_log(batches: DataFrame) -> DataFrame:
    """(batch_id, sender, n_samples, n_deleted, sync_path) per batch, the first delivery holding."""
    rows = batches.select("batch_id", F.col("device").alias("sender"), F.coalesce(F.size("samples"), F.lit(0)).alias("n_samples"), F.coalesce(F.size("deleted"), F.lit(0)).alias("n_deleted"), "sync_path", "delivery_no")
    rows = rows.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("n_samples", "n_deleted")})
    return keep_first(rows, "batch_id", ["delivery_no"]).drop("delivery_no")


def import_profile(rows: DataFrame) -> DataFrame:
    """Per metric: rows, first and last start."""
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"), F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"))


def migrate_ids(rows: DataFrame) -> DataFrame:
    """Recomputes content ids over spans cut to seconds and sleep minutes from them, then keeps the first row per id."""
    cut = {c: F.date_trunc("second", F.col(c)).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}
    df = rows.withColumns(cut).withColumn("end_ts", F.coalesce("end_ts", "start_ts"))
    minutes = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 60_000_000
    df = df.withColumn("value", F.when(F.col("metric") == "sleep_analysis", minutes).otherwise(F.col("value")))
    ident = content_id(F.coalesce("hk_type", "metric"), F.col("start_ts"), F.col("end_ts"), F.col("source_name"), F.col("value"), F.col("text_value"))
    return keep_first(df.withColumn("sample_id", ident), "sample_id", ["ingested_at", "row_id"])


def loss_guard(before: DataFrame, after: DataFrame, most: float = 0.02) -> None:
    """Raises if more than the share `most` of the rows is lost."""
    a, b = before.count(), after.count()
    if a and (a - b) / a > most:
        raise ValueError(f"{a - b} of {a} rows would be lost")


def legacy_samples(records: DataFrame) -> DataFrame:
    """(record_type, value text, unit, start_date, end_date, source_name) to store rows with an md5 id; stages by LIKE."""
    v = F.col("value")
    stage = F.when(v.like("%Deep%"), "deep").when(v.like("%REM%"), "rem").when(v.like("%Core%"), "core").when(v.like("%Awake%"), "awake").when(v.like("%InBed%"), "in_bed").when(v.like("%Asleep%"), "asleep")
    ident = F.concat(F.lit("lg:"), F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_type", "start_date", "end_date", "source_name", "value")]).cast("binary")))
    return records.select(ident.alias("sample_id"), F.col("record_type").alias("hk_type"), v.try_cast("double").alias("value"), stage.alias("text_value"), "unit", F.col("start_date").alias("start_ts"), F.col("end_date").alias("end_ts"), "source_name")


def parity(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, ours, theirs, ratio) of row counts; ratio to three places, null against none."""
    a = ours.groupBy(key).agg(F.count(F.lit(1)).alias("ours"))
    b = theirs.groupBy(key).agg(F.count(F.lit(1)).alias("theirs"))
    return a.join(b, key, "left").withColumn("theirs", F.coalesce("theirs", F.lit(0))).withColumn("ratio", F.round(F.try_divide("ours", "theirs"), 3))


VENDOR = (
    "created_at string, start string, end string, nap boolean, score struct<recovery_score: double, hrv_rmssd_milli: double, strain: double, sleep_efficiency_percentage: double, respiratory_rate: double,"
    "sleep_needed: struct<baseline_milli: double>, stage_summary: struct<total_light_sleep_time_milli: double, total_slow_wave_sleep_time_milli: double, total_rem_sleep_time_milli: double, total_awake_time_milli: double, total_in_bed_time_milli: double>>"
)


def vendor_samples(payloads: DataFrame, tz: str = "UTC") -> DataFrame:
    """(kind, payload JSON) to (date, metric, value): recovery, sleep (naps left out) and cycle records unpivoted, nulls dropped.

    The date is the local date of created_at (recovery), end (sleep) or start (cycle). Unreadable JSON gives nothing.
    """
    p = payloads.select("kind", F.from_json("payload", VENDOR).alias("p"))
    day = F.to_date(instant(F.when(F.col("kind") == "recovery", F.col("p.created_at")).when(F.col("kind") == "sleep", F.col("p.end")).otherwise(F.col("p.start")), tz))
    st = "p.score.stage_summary."
    asleep = (F.col(st + "total_light_sleep_time_milli") + F.col(st + "total_slow_wave_sleep_time_milli") + F.col(st + "total_rem_sleep_time_milli")) / 3.6e6
    pair = lambda kind, metric, value: F.struct(F.lit(metric).alias("metric"), F.when(F.col("kind") == kind, value).alias("value"))
    rows = F.array(
        pair("recovery", "recovery_score", F.col("p.score.recovery_score")), pair("recovery", "hrv_rmssd", F.col("p.score.hrv_rmssd_milli")), pair("sleep", "sleep_duration", F.round(asleep, 2)),
        pair("sleep", "respiratory_rate", F.col("p.score.respiratory_rate")), pair("sleep", "sleep_need", F.round(F.col("p.score.sleep_needed.baseline_milli") / 3.6e6, 2)), pair("cycle", "strain", F.col("p.score.strain")),
    )
    return p.filter(~((F.col("kind") == "sleep") & F.coalesce(F.col("p.nap"), F.lit(False)))).select(day.alias("date"), F.explode(rows).alias("r")).select("date", "r.*").filter("value is not null and date is not null")


def touched_days(rows: DataFrame) -> DataFrame:
    """(metric, date_min, date_max) of a batch: the span whose derived rows must be computed anew."""
    return rows.groupBy("metric").agg(F.to_date(F.min("start_ts")).alias("date_min"), F.to_date(F.max("start_ts")).alias("date_max"), exact_sum(F.lit(1)).cast("long").alias("rows"))
