"""Queries of the series operators: ingest, daily values, baselines, states, statistics. Each with its SQL for DuckDB.

The test tables hold many wearers' devices and don't say whose a device is: four device numbers in a row count as one wearer's
(subject), so that a subject has several devices, arbitration has something to do, and subjects grow with the devices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions import columns as C
from vitalframe.operators import baselines, daily, ingest, insights, reports, signals, units
from vitalframe.plans import problems
from vitalframe.plans.problems_sql import _COMMON, _SURPLUS
from vitalframe.session import cut, table

NOW = "2015-02-05 12:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}

SUBJECT_SQL = "(coalesce(try_cast(nullif(regexp_extract({d}, '_([0-9]+)$', 1), '') as integer), 0) // 4)"


#: Columns that queries return as text, so that engines can be compared: dates as yyyy-MM-dd, times as yyyy-MM-dd HH:mm:ss.
DATES, STAMPS = ("date", "date_min", "date_max"), ("first_ts", "last_ts", "last_seen")


def query(sql: str | None = None, text: str = ""):
    """Registers a query and its SQL; text: the names of its date and time columns."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            forms = {c: F.date_format(c, "yyyy-MM-dd" if c in DATES else "yyyy-MM-dd HH:mm:ss") for c in text.split()}
            return f(spark, sf_dir).withColumns(forms)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            forms = ", ".join(f"strftime({c}, '{'%Y-%m-%d' if c in DATES else '%Y-%m-%d %H:%M:%S'}') as {c}" for c in text.split())
            SQL[f.__name__] = f"select * replace ({forms}) from ({sql}) as plain" if text else sql
        return run

    return keep


def subject(device: str = "device_key") -> Column:
    """The wearer of a device, see above."""
    number = F.nullif(F.regexp_extract(device, "_([0-9]+)$", 1), F.lit("")).try_cast("int")
    return F.floor(F.coalesce(number, F.lit(0)) / 4).cast("int").alias("subject")


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples without redelivered copies, in common units, with their subject."""
    same = units.to_common_units(problems.kept_samples(spark, sf_dir), table(spark, sf_dir, "metric_policy"))
    return same.withColumns({"value": F.col("common_value"), "subject": subject()}).drop("common_unit", "common_value", "source_unit", "changed")


def stage() -> Column:
    return ingest.stage_of(F.col("text_value"))


STAGE_SQL = """(case text_value when 'HKCategoryValueSleepAnalysisInBed' then 'in_bed' when 'HKCategoryValueSleepAnalysisAsleep' then 'asleep' when 'HKCategoryValueSleepAnalysisAsleepUnspecified' then 'asleep'
    when 'HKCategoryValueSleepAnalysisAwake' then 'awake' when 'HKCategoryValueSleepAnalysisAsleepCore' then 'core' when 'HKCategoryValueSleepAnalysisAsleepDeep' then 'deep' when 'HKCategoryValueSleepAnalysisAsleepREM' then 'rem'
    else coalesce(nullif(trim(text_value), ''), 'asleep') end)"""
_DEVICE_SQL = """(case when n like 'Athlytic%' or n like 'SleepWatch%' then null when n like 'WHOOP%' then 'whoop' when n like 'Zepp Life%' then 'zepp_life_scale' when n like 'Zepp%' then 'zepp_helio'
    when n like '%Apple Watch%' or n like '%Watch' then 'apple_watch_ultra' when n like '%iPhone%' then 'iphone' when n like 'MyFitnessPal%' then 'myfitnesspal' else 'other' end)"""
_ISO = "(case when regexp_matches({x}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') then date_trunc('second', try_cast({x} as timestamptz) at time zone 'UTC') else date_trunc('second', try_cast({x} as timestamp)) end)"
CANON_SQL = "(case when {v} is null then 'None' when rtrim(rtrim(printf('%.6f', {v}), '0'), '.') in ('', '-0') then '0' else rtrim(rtrim(printf('%.6f', {v}), '0'), '.') end)"

_NORMAL = f"""
    x as (select batch_id, sync_path, unnest(samples) as s from batches),
    k as (select hk_type, max(metric) as m from metric_policy where hk_type is not null group by 1),
    u as (select metric, max(unit) as u from metric_policy group by 1),
    a as (select x.batch_id, x.sync_path, s.uuid as hk_uuid, s.hk_type as hk_type, coalesce(s.metric, k.m) as metric, s.value as v, s.text_value as t, s.unit as unit0, {_ISO.format(x='s.start_ts')} as start_ts,
        {_ISO.format(x='s.end_ts')} as e, s.source_name as source_name, trim(replace(replace(s.source_name, chr(160), ' '), chr(8239), ' ')) as n from x left join k on k.hk_type = s.hk_type),
    b as (select a.*, {_DEVICE_SQL} as device_key, coalesce(e, start_ts) as end_ts, try_cast(v as double) as num from a),
    c as (select b.*, coalesce(unit0, u.u) as unit from b left join u using (metric) where b.metric is not null and device_key is not null and start_ts is not null),
    d as (select * exclude (v), case when metric = 'sleep_analysis' then (epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0::double when metric = 'spo2' and num <= 1.5 then num * 100 else num end as value,
        case when metric = 'sleep_analysis' then {STAGE_SQL.replace('text_value', 'coalesce(t, case when num is null then v end)')} when num is null and v is not null then v else t end as text_value from c),
    normal as (select 'ch2:' || sha1(concat_ws('|', coalesce(hk_type, metric, 'None'), strftime(start_ts, '%Y-%m-%d %H:%M:%S'), strftime(end_ts, '%Y-%m-%d %H:%M:%S'), coalesce(source_name, 'None'), {CANON_SQL.format(v='value')}, coalesce(text_value, ''))) as sample_id,
        hk_uuid, batch_id, metric, hk_type, value, text_value, unit, start_ts, end_ts, source_name, device_key, sync_path from d)
"""
def stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_ts", "end_ts")})


_STAMPS_SQL = "strftime(start_ts, '%Y-%m-%d %H:%M:%S') as start_ts, strftime(end_ts, '%Y-%m-%d %H:%M:%S') as end_ts"


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalize(ingest.explode_batches(table(spark, sf_dir, "batches")), table(spark, sf_dir, "metric_policy"))


@query(f"with {_NORMAL} select * replace (strftime(start_ts, '%Y-%m-%d %H:%M:%S') as start_ts, strftime(end_ts, '%Y-%m-%d %H:%M:%S') as end_ts) from normal")
def o03_normalize(spark, sf_dir):
    """O-01, O-03 to O-11: a batch feed to store rows."""
    return stamped(normalized(spark, sf_dir))


@query(f"with {_NORMAL} select metric, cast(min(start_ts) as date) as date_min, cast(max(start_ts) as date) as date_max, count(*) as rows from normal group by 1", text="date_min date_max")
def o01_touched_days(spark, sf_dir):
    return ingest.touched_days(normalized(spark, sf_dir))


@query(f"select row_id, {CANON_SQL.format(v='value')} as canonical from samples")
def o04_canonical_value(spark, sf_dir):
    return table(spark, sf_dir, "samples").select("row_id", C.canonical_number(F.col("value")).alias("canonical"))


@query(f"""with {_NORMAL}, r as (select *, row_number() over (partition by sample_id order by batch_id, hk_uuid nulls first) as k from normal)
    select sample_id, metric, device_key, value, text_value, {_STAMPS_SQL} from r where k = 1""")
def o12_keep_first(spark, sf_dir):
    rows = ingest.keep_first(normalized(spark, sf_dir), "sample_id", ["batch_id", "hk_uuid"])
    return stamped(rows).select("sample_id", "metric", "device_key", "value", "text_value", "start_ts", "end_ts")


@query("""with r as (select *, row_number() over (partition by date, metric, device_key order by computed_at desc, value desc nulls last, n_samples desc) as k from daily_values)
    select date, metric, device_key, value from r where k = 1""", text="date")
def o13_upsert(spark, sf_dir):
    """The recomputed days (those not the first version of a day) upserted into the first versions."""
    rows = table(spark, sf_dir, "daily_values").withColumn("version", F.struct("computed_at", F.col("value").isNotNull().alias("has"), "value", "n_samples"))
    hours = F.col("computed_at") <= F.date_add("date", 1).cast("timestamp_ntz") + F.expr("interval 1 hour")
    return ingest.upsert(rows.filter(hours), rows.filter(~hours), ["date", "metric", "device_key"], "version").select("date", "metric", "device_key", "value")


@query(f"""with {_NORMAL}, dead as (select lower(x) as u from (select unnest(deleted) as x from batches) where x is not null)
    select metric, count(*) as rows from normal where hk_uuid is null or lower(hk_uuid) not in (select u from dead) group by 1""")
def o14_retract(spark, sf_dir):
    rows = normalized(spark, sf_dir).withColumn("hk_uuid", F.lower("hk_uuid"))
    dead = table(spark, sf_dir, "batches").select(F.explode("deleted").alias("hk_uuid")).withColumn("hk_uuid", F.lower("hk_uuid"))
    return ingest.retract(rows, dead, "hk_uuid").groupBy("metric").agg(F.count(F.lit(1)).alias("rows"))


@query("""with r as (select batch_id, device as sender, coalesce(len(samples), 0) as n_samples, coalesce(len(deleted), 0) as n_deleted, sync_path, row_number() over (partition by batch_id order by delivery_no) as k from batches)
    select batch_id, sender, cast(n_samples as integer) as n_samples, cast(n_deleted as integer) as n_deleted, sync_path from r where k = 1""")
def o15_commit_log(spark, sf_dir):
    return ingest.commit_log(table(spark, sf_dir, "batches"))


@query("select metric, count(*) as rows, min(start_ts) as first_ts, max(start_ts) as last_ts from samples group by 1", text="first_ts last_ts")
def o18c_import_profile(spark, sf_dir):
    return ingest.import_profile(table(spark, sf_dir, "samples"))


@query(f"""with a as (select row_id, metric, hk_type, text_value, source_name, ingested_at, date_trunc('second', start_ts) as s, coalesce(date_trunc('second', end_ts), date_trunc('second', start_ts)) as e, value from samples),
    b as (select *, case when metric = 'sleep_analysis' then (epoch_us(e) - epoch_us(s)) / 60000000.0::double else value end as v from a),
    c as (select row_id, ingested_at, metric, v, 'ch2:' || sha1(concat_ws('|', coalesce(hk_type, metric, 'None'), strftime(s, '%Y-%m-%d %H:%M:%S'), strftime(e, '%Y-%m-%d %H:%M:%S'), coalesce(source_name, 'None'), {CANON_SQL.format(v='v')}, coalesce(text_value, ''))) as sample_id from b),
    d as (select *, row_number() over (partition by sample_id order by ingested_at, row_id) as k from c)
    select sample_id, row_id, metric, v as value from d where k = 1""")
def o18d_migrate_ids(spark, sf_dir):
    return ingest.migrate_ids(table(spark, sf_dir, "samples")).select("sample_id", "row_id", "metric", "value")


_LEGACY = "select hk_type as record_type, case when metric = 'sleep_analysis' then text_value else cast(cast(value as decimal(18,3)) as varchar) end as value, unit, start_ts as start_date, end_ts as end_date, source_name from samples"


def legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "samples")
    text = F.when(F.col("metric") == "sleep_analysis", F.col("text_value")).otherwise(F.col("value").cast("decimal(18,3)").cast("string"))
    return s.select(F.col("hk_type").alias("record_type"), text.alias("value"), "unit", F.col("start_ts").alias("start_date"), F.col("end_ts").alias("end_date"), "source_name")


@query(f"""with l as ({_LEGACY}) select record_type as hk_type, case when value like '%Deep%' then 'deep' when value like '%REM%' then 'rem' when value like '%Core%' then 'core' when value like '%Awake%' then 'awake'
    when value like '%InBed%' then 'in_bed' when value like '%Asleep%' then 'asleep' end as text_value, count(*) as rows, count(try_cast(value as double)) as with_value from l group by 1, 2""")
def o19a_legacy_import(spark, sf_dir):
    return ingest.legacy_samples(legacy_records(spark, sf_dir)).groupBy("hk_type", "text_value").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value"))


@query(f"""with {_NORMAL}, o as (select metric, count(*) as ours from samples group by 1), t as (select metric, count(*) as theirs from normal group by 1)
    select metric, ours, coalesce(theirs, 0) as theirs, round(ours / nullif(theirs, 0), 3) as ratio from o left join t using (metric)""")
def o19b_parity(spark, sf_dir):
    return ingest.parity(table(spark, sf_dir, "samples"), normalized(spark, sf_dir), "metric")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor payloads made from the samples: a sleep record per sleep_duration row, a recovery record per hrv_sdnn row."""
    s = table(spark, sf_dir, "samples").filter("value is not null and metric in ('sleep_duration', 'hrv_sdnn')")
    iso = F.concat(F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    ms = F.col("value") * 1000
    sleep = F.to_json(F.struct(iso.alias("start"), iso.alias("end"), (F.col("row_id") % 7 == 0).alias("nap"), F.struct(F.struct(ms.alias("total_light_sleep_time_milli"), (ms * 2).alias("total_slow_wave_sleep_time_milli"), ms.alias("total_rem_sleep_time_milli")).alias("stage_summary"), F.col("value").alias("respiratory_rate")).alias("score")))
    recovery = F.to_json(F.struct(iso.alias("created_at"), F.struct(F.col("value").alias("hrv_rmssd_milli"), (F.col("row_id") % 100).cast("double").alias("recovery_score")).alias("score")))
    return s.select(F.when(F.col("metric") == "hrv_sdnn", "recovery").otherwise("sleep").alias("kind"), F.when(F.col("metric") == "hrv_sdnn", recovery).otherwise(sleep).alias("payload"))


@query("""with s as (select row_id, metric, cast(start_ts as date) as date, value from samples where value is not null and metric in ('sleep_duration', 'hrv_sdnn')),
    r as (select date, 'hrv_rmssd' as metric, value from s where metric = 'hrv_sdnn' union all select date, 'recovery_score', cast(row_id % 100 as double) from s where metric = 'hrv_sdnn'
        union all select date, 'respiratory_rate', value from s where metric = 'sleep_duration' and row_id % 7 <> 0
        union all select date, 'sleep_duration', round((value * 1000 + value * 1000 * 2 + value * 1000) / 3.6e6, 2) from s where metric = 'sleep_duration' and row_id % 7 <> 0)
    select date, metric, count(*) as n, round(cast(sum(cast(value as decimal(24,4))) as double), 3) as total from r group by 1, 2""", text="date")
def o17_vendor_json(spark, sf_dir):
    return ingest.vendor_samples(payloads(spark, sf_dir)).groupBy("date", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(C.exact_sum(F.col("value")), 3).alias("total"))


# daily values

_CLEAN = f"""{_SURPLUS}, {_COMMON}, cleaned as (select samples.* replace (case when samples.metric in {tuple(problems.CONVERTED)} then common.common_value else samples.value end as value), {SUBJECT_SQL.format(d='device_key')} as subject
    from samples left join common using (row_id) where row_id not in (select row_id from surplus))"""
_DAY = "cast(case when metric in ('sleep_analysis', 'sleep_duration') then coalesce(end_ts, start_ts) else start_ts end as date)"
_PER = f"""
    pol as (select metric, max(agg) as agg, max(cadence_hours) as cadence from metric_policy group by 1),
    per as (select subject, metric, {_DAY} as date, device_key,
        round(case max(agg) when 'sum' then cast(sum(cast(value as decimal(24,4))) as double) when 'avg' then cast(sum(cast(value as decimal(24,4))) as double) / count(value) else arg_max(value, struct_pack(a := start_ts, b := row_id)) end, 3) as value, count(*) as n
        from cleaned s join pol using (metric) where agg in ('sum', 'avg', 'last') and value is not null and not isnan(value) group by 1, 2, 3, 4)
"""
_SLEEP = f"""
    direct as (select subject, cast(coalesce(end_ts, start_ts) as date) as date, device_key, cast(sum(cast(value as decimal(24,4))) as double) as direct from cleaned where metric = 'sleep_duration' and value is not null group by 1, 2, 3),
    staged as (select subject, cast(coalesce(end_ts, start_ts) as date) as date, device_key, coalesce(cast(sum(cast(value as decimal(24,4))) filter ({STAGE_SQL} in ('core', 'deep', 'rem')) as double), 0) as deepish,
        coalesce(cast(sum(cast(value as decimal(24,4))) filter ({STAGE_SQL} = 'asleep') as double), 0) as plain from cleaned where metric = 'sleep_analysis' and value is not null and not regexp_matches(device_key, '^(whoop)') group by 1, 2, 3),
    slept as (select subject, date, device_key, round(greatest(direct, case when deepish > 0 then deepish else plain end / 60), 2) as value, cast(1 as bigint) as n from direct full join staged using (subject, date, device_key)),
    sleep as (select * from slept where value > 0)
"""
_RANK = "(case regexp_replace(device_key, '_[0-9]+$', '') when 'apple_watch_ultra' then 0 when 'whoop' then 1 when 'zepp_helio' then 2 when 'iphone' then 3 when 'zepp_life_scale' then 4 when 'myfitnesspal' then 5 end)"
_CHOSEN = f"""
    devs as (select * from per union all by name select *, 'sleep_duration' as metric from sleep),
    ranked as (select *, {_RANK} as rank from devs),
    groups as (select subject, metric, date, list(struct_pack(d := device_key, v := value, n := n, r := rank) order by rank, device_key) as l from ranked where rank is not null group by 1, 2, 3),
    chosen as (select subject, metric, date, l[1].d as device_key, l[1].v as value, l[1].n as n, l[1].r as rank, l[2:] as others from groups)
"""
_DAILY = f"""{_PER}, {_SLEEP}, {_CHOSEN},
    scored as (select c.*, p.agg, 0.35 * case when rank = 0 then 1.0 when rank = 1 then 0.7 else 0.5 end::double
        + 0.25 * greatest(0.0, least(1.0, 2 - greatest(case when date = max(date) over (partition by subject, metric) then greatest((epoch_us(timestamp '{NOW}') - epoch_us(cast(date as timestamp))) / 3600000000.0::double - 24, 0) / coalesce(p.cadence, 26) else 0.0::double end, 0)))
        + 0.2 * case when p.agg = 'sum' then 1.0 else least(n / 3.0::double, 1.0) end
        + 0.2 * case when len(others) = 0 or value = 0 then 0.6 else len(list_filter(others, lambda x: abs(x.v - value) / abs(value) * 100 <= 12)) / len(others) end as score
        from chosen c left join pol p using (metric))
"""


def per_device_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.per_device(samples_of(spark, sf_dir), table(spark, sf_dir, "metric_policy"), ["subject"])


def sleep_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.sleep_hours(samples_of(spark, sf_dir), stage(), ["subject"])


def daily_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.daily_values(samples_of(spark, sf_dir), table(spark, sf_dir, "metric_policy"), stage(), ["subject"], NOW)


@query(f"with {_CLEAN}, {_PER} select * from per", text="date")
def o40_per_device(spark, sf_dir):
    """O-21 to O-23, O-40: one value per device and day."""
    return per_device_of(spark, sf_dir)


@query(f"with {_CLEAN}, {_SLEEP} select * from sleep", text="date")
def o20_sleep_duration(spark, sf_dir):
    return sleep_of(spark, sf_dir)


@query(f"with {_CLEAN}, {_PER}, {_SLEEP}, {_CHOSEN} select subject, metric, date, device_key, value, cast(len(others) as integer) as n_others from chosen", text="date")
def o41_arbitration(spark, sf_dir):
    devices = per_device_of(spark, sf_dir).unionByName(sleep_of(spark, sf_dir).withColumn("metric", F.lit("sleep_duration")))
    return daily.arbitrate(devices, ["subject"]).select("subject", "metric", "date", "device_key", "value", F.size("corroboration").alias("n_others"))


@query(f"""with {_CLEAN}, {_DAILY} select subject, metric, date, value, device_key, n, cast(cast(score as decimal(10,4)) as double) as confidence, case when score >= 0.85 - 1e-12 then 'A' when score >= 0.7 - 1e-12 then 'B' when score >= 0.5 - 1e-12 then 'C' else 'D' end as grade from scored""", text="date")
def o46_daily_values(spark, sf_dir):
    """O-42 to O-46, with the confidence to four places."""
    df = daily.scored_values(samples_of(spark, sf_dir), table(spark, sf_dir, "metric_policy"), stage(), ["subject"], NOW)
    return df.select("subject", "metric", "date", "value", "device_key", "n", F.col("score").cast("decimal(10,4)").cast("double").alias("confidence"), daily.grade(F.col("score")).alias("grade"))


# baselines and trends over the stored daily values, one series per device and metric

_SERIES = """
    versions as (select device_key, metric, date, value, row_number() over (partition by device_key, metric, date order by computed_at desc nulls last, value desc nulls last) as k from daily_values),
    series as (select device_key, metric, date, value from versions where k = 1)
"""
BY = ["device_key", "metric"]


def series_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitalframe.operators.trailing import current_versions

    return current_versions(table(spark, sf_dir, "daily_values"))


_BASE = f"""{_SERIES},
    b as (select s.device_key, s.metric, s.date, any_value(s.value) as value, w.w as window_days, median(p.value) as median, mad(p.value) as mad, cast(count(p.value) as integer) as n_days
        from series s cross join (select unnest([30, 60, 90]) as w) w join series p on p.device_key = s.device_key and p.metric = s.metric and p.date < s.date and p.date >= s.date - w.w and p.value is not null group by 1, 2, 3, 5 having count(p.value) >= 7)
"""


def baselines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.trailing_baseline(series_of(spark, sf_dir), BY, [30, 60, 90])


@query(f"with {_BASE} select device_key, metric, date, value, window_days, round(median, 6) as median, round(mad, 6) as mad, n_days from b", text="date")
def o60_trailing_baseline(spark, sf_dir):
    """O-47, O-49, O-60: median and MAD of the trailing windows."""
    return baselines_of(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("median", "mad")})


@query(f"with {_SERIES} select b.date, b.metric, b.device_key, b.window_days, s.value, b.median, b.mad from series s join baselines b using (date, metric, device_key) where s.value is not null", text="date")
def o61_baseline_lookup(spark, sf_dir):
    """The current version of each day with its stored baselines, all windows."""
    values = series_of(spark, sf_dir).filter("value is not null")
    stored = table(spark, sf_dir, "baselines").select("date", "metric", "device_key", "window_days", "median", "mad")
    return values.join(stored, ["date", "metric", "device_key"]).select("date", "metric", "device_key", "window_days", "value", "median", "mad")


@query("""with r as (select *, row_number() over (partition by device_key, metric order by date desc, window_days) as k from baselines) select device_key, metric, date, window_days, total_value from r where k <= 3""", text="date")
def o62_latest_baselines(spark, sf_dir):
    return baselines.latest(table(spark, sf_dir, "baselines"), BY, [F.desc("date"), F.col("window_days")], 3).select("device_key", "metric", "date", "window_days", "total_value")


@query(f"""with {_SERIES}, r as (select *, row_number() over (partition by device_key, metric order by date) as k, count(*) over (partition by device_key, metric) as n from series where value is not null),
    h as (select device_key, metric, cast(sum(cast(value as decimal(24,4))) filter (k <= greatest(n // 2, 1)) as double) / count(*) filter (k <= greatest(n // 2, 1)) as first_avg,
        cast(sum(cast(value as decimal(24,4))) filter (k > greatest(n // 2, 1)) as double) / nullif(count(*) filter (k > greatest(n // 2, 1)), 0) as second_avg from r group by 1, 2),
    p as (select *, (second_avg - first_avg) / nullif(abs(first_avg), 0) * 100 as x from h)
    select device_key, metric, round(first_avg, 6) as first_avg, round(second_avg, 6) as second_avg, round(x, 4) as pct, case when x > 3 then 'rising' when x < -3 then 'falling' when x is not null then 'steady' end as trend from p""")
def o66_half_trend(spark, sf_dir):
    return baselines.half_trend(series_of(spark, sf_dir), BY).withColumns({c: F.round(c, 6) for c in ("first_avg", "second_avg")})


_UPPER = "list_sort(list({v}) filter ({f}))[cast(count({v}) filter ({f}) // 2 as integer) + 1]"
ANCHOR = "2015-03-15"


@query(f"""with {_SERIES}, c as (select device_key, metric, {_UPPER.format(v='value', f=f"value is not null and date >= date '{ANCHOR}' - 30 and date <= date '{ANCHOR}'")} as current,
        {_UPPER.format(v='value', f=f"value is not null and date >= date '{ANCHOR}' - 60 and date < date '{ANCHOR}' - 30")} as previous from series where value is not null group by 1, 2)
    select *, round((current - previous) / nullif(previous, 0) * 100, 1) as change_pct from c""")
def o67_compare_periods(spark, sf_dir):
    """O-48, O-67: upper medians of two periods."""
    return baselines.compare_periods(series_of(spark, sf_dir), BY, F.lit(ANCHOR).cast("date"), 30, 30)


@query(f"""with {_SERIES}, d as (select *, date - date '{ANCHOR}' as d from series where value is not null)
    select device_key, metric, round(cast(sum(cast(value as decimal(24,4))) filter (d > -7 and d <= 0) as double) / nullif(count(*) filter (d > -7 and d <= 0), 0), 6) as avg_7d,
        round(cast(sum(cast(value as decimal(24,4))) filter (d > -14 and d <= -7) as double) / nullif(count(*) filter (d > -14 and d <= -7), 0), 6) as avg_prev_7d,
        max(value) filter (d = -7) as same_weekday_last_week, list_sort(list(value))[cast(count(*) // 2 as integer) + 1] as median from d group by 1, 2""")
def o68_week_over_week(spark, sf_dir):
    return baselines.week_over_week(series_of(spark, sf_dir), BY, F.lit(ANCHOR).cast("date")).withColumns({c: F.round(c, 6) for c in ("avg_7d", "avg_prev_7d")})


@query(f"""with {_SERIES}, d as (select *, date - date '{ANCHOR}' as d from series where value is not null),
    t as (select device_key, metric, max(value) filter (d = 0) as head, cast(sum(cast(value as decimal(24,4))) filter (d < 0 and d >= -6) as double) / nullif(count(*) filter (d < 0 and d >= -6), 0) as mean_before from d group by 1, 2)
    select device_key, metric, head, round(mean_before, 6) as mean_before, round(head - mean_before, 4) as delta from t""")
def o69_week_trend(spark, sf_dir):
    return baselines.week_trend(series_of(spark, sf_dir), BY, F.lit(ANCHOR).cast("date")).withColumn("mean_before", F.round("mean_before", 6))


@query(f"""with {_SERIES}, g as (select distinct device_key, metric from series), s as (select g.*, cast(unnest(generate_series(date '{ANCHOR}' - 6, date '{ANCHOR}', interval 1 day)) as date) as date from g)
    select s.device_key, s.metric, s.date, v.value from s left join series v using (device_key, metric, date)""", text="date")
def o69_date_spine(spark, sf_dir):
    return baselines.date_spine(series_of(spark, sf_dir), BY, F.lit(ANCHOR).cast("date")).select("device_key", "metric", "date", "value")


_NIGHTS = f"""
    nights as (select device_key, cast(end_ts as date) as date, min(start_ts) as start_ts, max(end_ts) as end_ts from samples where metric = 'sleep_analysis' and {STAGE_SQL} in ('asleep', 'core', 'deep', 'rem') and end_ts > start_ts group by 1, 2),
    mid as (select *, make_timestamp(((epoch_us(start_ts) + epoch_us(end_ts)) // 2000000) * 1000000) as m from nights),
    mids as (select *, hour(m) + minute(m) / 60.0::double as midpoint from mid),
    usual as (select a.device_key, a.date, any_value(a.start_ts) as start_ts, any_value(a.midpoint) as midpoint, case when count(b.midpoint) >= 5 then list_sort(list(b.midpoint) filter (b.midpoint is not null))[cast(count(b.midpoint) // 2 as integer) + 1] end as usual
        from mids a left join mids b on b.device_key = a.device_key and b.date < a.date and b.date >= a.date - 14 group by 1, 2),
    shifts as (select *, coalesce(least(abs(midpoint - usual), 24 - abs(midpoint - usual)) >= 2, false) as shifted from usual)
"""


def nights_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    asleep = table(spark, sf_dir, "samples").filter("metric = 'sleep_analysis'").filter(stage().isin(*daily.ASLEEP))
    return baselines.midpoint_shift(baselines.night_windows(asleep, ["device_key"]), ["device_key"])


@query(f"with {_NIGHTS} select device_key, date, round(midpoint, 6) as midpoint, round(usual, 6) as usual, shifted from shifts", text="date")
def o70_midpoint_shift(spark, sf_dir):
    return nights_of(spark, sf_dir).select("device_key", "date", F.round("midpoint", 6).alias("midpoint"), F.round("usual", 6).alias("usual"), "shifted")


@query(f"""with {_NIGHTS} select device_key, date, concat_ws(',', case when hour(start_ts) >= 1 and hour(start_ts) < 12 then 'late_night' end, case when month(date) between 5 and 10 then 'heat' end, case when shifted then 'travel_or_shifted_schedule' end) as context from shifts""", text="date")
def o71_night_flags(spark, sf_dir):
    return baselines.night_flags(nights_of(spark, sf_dir)).select("device_key", "date", F.array_join("context", ",").alias("context"))


# states

_STATE = """case when median is null then 'insufficient'
    when metric = 'steps' then case when value >= median then 'favorable' when value < median - greatest(mad * 1.5, abs(median) * 0.02) then 'flag' else 'neutral' end
    when metric = 'active_energy' then case when value >= median then 'favorable' when value < median - greatest(mad * 1.5, abs(median) * 0.02) then 'flag' else 'neutral' end
    else 'neutral' end"""
_SIGNALS = f"""{_BASE}, sig as (select s.device_key, s.metric, s.date, s.value, x.median, x.mad, round((s.value - x.median) / nullif(x.median, 0) * 100, 1) as delta_pct from series s
    left join (select * from b where window_days = 30) x using (device_key, metric, date) where s.value is not null), states as (select *, {_STATE} as state from sig)"""


def signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = baselines.trailing_baseline(series_of(spark, sf_dir), BY, [30], keep_short=True)
    return signals.judge(series.filter("value is not null"))


@query(f"with {_SIGNALS} select device_key, metric, date, value, round(median, 6) as median, case when delta_pct = 0 then 0.0::double else delta_pct end as delta_pct, state from states", text="date")
def o121_signals(spark, sf_dir):
    """O-35, O-120, O-121."""
    return signals_of(spark, sf_dir).select("device_key", "metric", "date", "value", F.round("median", 6).alias("median"), "delta_pct", "state")


@query(f"""with {_SIGNALS} select device_key, date, count(*) filter (state = 'favorable') as n_favorable, count(*) filter (state = 'neutral') as n_neutral, count(*) filter (state = 'flag') as n_flag, count(*) as n_judged
    from states where state <> 'insufficient' group by 1, 2""", text="date")
def o122_state_counts(spark, sf_dir):
    return signals.state_counts(signals_of(spark, sf_dir), ["device_key", "date"])


@query("select metric, device_key, max(coalesce(end_ts, start_ts)) as last_seen, count(*) as n from samples group by 1, 2", text="last_seen")
def o52_last_seen(spark, sf_dir):
    return signals.last_seen(table(spark, sf_dir, "samples"))


@query(f"""with l as (select metric, device_key, max(coalesce(end_ts, start_ts)) as t from samples group by 1, 2), p as (select metric, max(cadence_hours) as c from metric_policy group by 1),
    a as (select *, {_RANK} as r, {SUBJECT_SQL.format(d='device_key')} as subject, (epoch_us(timestamp '{NOW}') - epoch_us(t)) / 3600000000.0::double as age from l),
    g as (select subject, metric, min(age) as freshest, arg_min(struct_pack(d := device_key, a := age), struct_pack(r := r, d := device_key)) as best from a where r is not null and metric <> 'dietary_energy' group by 1, 2)
    select subject, metric, best.d as device_key, round(best.a, 1) as age_hours, round(freshest, 1) as freshest_hours, case when freshest > 4 * c then 'silent' else 'stale' end as status from g join p using (metric) where freshest > 2 * c""")
def o126_stale_metrics(spark, sf_dir):
    seen = signals.last_seen(table(spark, sf_dir, "samples")).withColumn("subject", subject())
    return signals.stale_metrics(seen, table(spark, sf_dir, "metric_policy"), daily.rank_of(F.col("device_key")), ["subject"], NOW)


@query()
def o127_cooldown(spark, sf_dir):
    """Alerts are the unreadable readings (value null), one per metric and six hours."""
    return signals.cooldown(table(spark, sf_dir, "samples").filter("value is null"), ["metric"], "ingested_at")


@query("""with r as (select device_key, metric, value, start_ts, row_id, lag(start_ts) over w as before from samples where value is not null window w as (partition by device_key, metric, value order by start_ts, row_id)),
    g as (select *, sum(case when before is null or epoch_us(start_ts) - epoch_us(before) > 120000000 then 1 else 0 end) over (partition by device_key, metric, value order by start_ts, row_id rows unbounded preceding) as g from r)
    select device_key, metric, value, min(row_id) as row_id, min(start_ts) as first_ts, max(start_ts) as last_ts, count(*) as n_repeats from g group by device_key, metric, value, g""", text="first_ts last_ts")
def o146_dedupe_window(spark, sf_dir):
    rows = table(spark, sf_dir, "samples").filter("value is not null").select("device_key", "metric", "value", "start_ts", "row_id")
    return signals.dedupe_window(rows, ["device_key", "metric", "value"], "start_ts", "row_id")


# statistics: metrics of a subject's days

_SUBJ = f"""{_SERIES}, m as (select {SUBJECT_SQL.format(d='device_key')} as subject, metric, date, arg_min(value, struct_pack(r := {_RANK}, d := device_key)) as value from series where value is not null and {_RANK} is not null group by 1, 2, 3)"""
_SPEAR = """
    ranks as (select *, rank() over (partition by {by} order by x) + (count(*) over (partition by {by}, x) - 1) / 2.0::double as ra, rank() over (partition by {by} order by y) + (count(*) over (partition by {by}, y) - 1) / 2.0::double as rb from pairs),
    sums as (select {by}, count(*) as n, sum(ra) as sa, sum(rb) as sb, sum(ra * rb) as sab, sum(ra * ra) as saa, sum(rb * rb) as sbb from ranks group by {by}),
    rhos as (select {by}, n, case when n >= 3 and n * saa - sa * sa > 0 and n * sbb - sb * sb > 0 then (n * sab - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb)) else 0.0::double end as rho from sums where n >= 12),
    zs as (select *, abs(atanh(greatest(-0.999999::double, least(0.999999::double, rho))) * sqrt(greatest(n - 3, 0)::double)) as z from rhos),
    tests as (select {by}, n, rho, case when n <= 3 or rho = 0 then 1.0::double else least(1.0::double, 2 * {tail}) end as p from zs)
"""
_PAIRS = "pairs as (select a.subject, a.metric as a, b.metric as b, a.date, a.value as x, b.value as y from m a join m b on b.subject = a.subject and b.date = a.date and a.metric < b.metric)"
_TAIL = C.normal_tail_sql("z")


def subject_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, metric, date, value): of a subject's devices the best-ranked, values are never summed over devices."""
    rank = daily.rank_of(F.col("device_key"))
    s = series_of(spark, sf_dir).filter("value is not null").withColumn("rank", rank).filter("rank is not null")
    return s.groupBy(subject(), "metric", "date").agg(F.min_by("value", F.struct("rank", "device_key")).alias("value"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("decimal(18,6)").cast("double") for n in names})


@query(f"""with {_SUBJ} select *, rank() over (partition by subject, metric order by value) + (count(*) over (partition by subject, metric, value) - 1) / 2.0::double as rnk from m""", text="date")
def o65_rank_average(spark, sf_dir):
    return subject_days(spark, sf_dir).withColumn("rnk", insights.rank_average("value", ["subject", "metric"]))


@query(f"""with {_SUBJ}, {_PAIRS}, {_SPEAR.format(by='subject, a, b', tail=_TAIL)} select subject, a, b, n, cast(cast(rho as decimal(18,6)) as double) as rho, cast(cast(p as decimal(18,6)) as double) as p from tests""")
def o105_correlations(spark, sf_dir):
    """O-31, O-100, O-101, O-105: Spearman of all pairs of metrics."""
    pairs = insights.metric_pairs(subject_days(spark, sf_dir), ["subject"], FORBIDDEN)
    return rounded(insights.spearman(pairs, ["subject", "a", "b"], "x", "y", 12), "rho", "p")


#: Measures of one thing that are never compared.
FORBIDDEN = (("hrv_rmssd", "hrv_sdnn"),)
LAGS = [("steps", "active_energy"), ("active_energy", "steps"), ("dietary_energy", "active_energy")]


@query(f"""with {_SUBJ}, pairs as (select a.subject, a.metric as a, b.metric as b, b.date, a.value as x, b.value as y from m a join m b on b.subject = a.subject and b.date = a.date + 1
        where (a.metric, b.metric) in (('steps', 'active_energy'), ('active_energy', 'steps'), ('dietary_energy', 'active_energy'))), {_SPEAR.format(by='subject, a, b', tail=_TAIL)}
    select subject, a, b, n, cast(cast(rho as decimal(18,6)) as double) as rho, cast(cast(p as decimal(18,6)) as double) as p from tests""")
def o106_lagged(spark, sf_dir):
    """O-32, O-63, O-106."""
    pairs = insights.lagged_pairs(subject_days(spark, sf_dir), ["subject"], LAGS)
    return rounded(insights.spearman(pairs, ["subject", "a", "b"], "x", "y", 12), "rho", "p")


_MWU = """
    rk as (select *, rank() over (partition by {by} order by value) + (count(*) over (partition by {by}, value) - 1) / 2.0::double as r, cast(count(*) over (partition by {by}, value) as double) as t from grp),
    agg as (select {by}, sum(g)::bigint as n1, sum(1 - g)::bigint as n0, sum(r) filter (g = 1) as r1, sum(t * t - 1) as ties, median(value) filter (g = 1) as median_1, median(value) filter (g = 0) as median_0 from rk group by {by}),
    us as (select *, case when n1 > 0 and n0 > 0 then r1 - n1::double * (n1::double + 1) / 2 else 0.0::double end as u, n1::double * n0::double / 12 * ((n1::double + n0::double + 1) - ties / nullif((n1::double + n0::double) * (n1::double + n0::double - 1), 0)) as v from agg),
    zs as (select *, case when v > 0 then abs(u - n1::double * n0::double / 2) / sqrt(v) end as z from us),
    mwu as (select *, coalesce(case when n1 > 0 and n0 > 0 then least(1.0::double, 2 * {tail}) end, 1.0::double) as p from zs)
"""


@query(f"""with {_SUBJ}, grp as (select *, case when isodow(date) >= 6 then 1 else 0 end as g from m), {_MWU.format(by='subject, metric', tail=_TAIL)}
    select subject, metric, n1, n0, u, cast(cast(p as decimal(18,6)) as double) as p, median_1, median_0 from mwu""")
def o107_weekend(spark, sf_dir):
    """O-102, O-107: weekends against weekdays."""
    rows, by = insights.weekend_rows(subject_days(spark, sf_dir)), ["subject", "metric"]
    return rounded(insights.mann_whitney(rows, by, "value", "weekend").join(insights.group_medians(rows, by, "weekend"), by), "p")


@query(f"""with {_SUBJ}, last4 as (select *, date - date '1970-01-01' as d from m where date >= date '{ANCHOR}' - 28 and date <= date '{ANCHOR}'),
    s as (select a.subject, a.metric, median((b.value - a.value) / (b.d - a.d)) * 7 as slope, count(*) as n_pairs from last4 a join last4 b on b.subject = a.subject and b.metric = a.metric and a.d < b.d group by 1, 2)
    select subject, metric, cast(cast(slope as decimal(18,6)) as double) as slope_per_week, n_pairs from s""")
def o64_theil_sen(spark, sf_dir):
    """O-36, O-64 over four weeks."""
    days = subject_days(spark, sf_dir).filter(F.col("date").between(F.date_sub(F.lit(ANCHOR).cast("date"), 28), F.lit(ANCHOR).cast("date")))
    return rounded(insights.theil_sen(days, ["subject", "metric"]), "slope_per_week")


@query(f"""with {_SUBJ}, pairs as (select subject, metric, date, value as x, date - date '1970-01-01' as y from m where date >= date '{ANCHOR}' - 28 and date <= date '{ANCHOR}'), {_SPEAR.format(by='subject, metric', tail=_TAIL)}
    select subject, metric, n, cast(cast(rho as decimal(18,6)) as double) as rho, cast(cast(p as decimal(18,6)) as double) as p from tests""")
def o108_trend(spark, sf_dir):
    days = subject_days(spark, sf_dir).filter(F.col("date").between(F.date_sub(F.lit(ANCHOR).cast("date"), 28), F.lit(ANCHOR).cast("date")))
    return rounded(insights.spearman(days.withColumn("d", F.datediff("date", F.lit("1970-01-01"))), ["subject", "metric"], "value", "d", 12), "rho", "p")


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure events: intake rows of the samples (active energy texts serve as the log), by subject."""
    s = table(spark, sf_dir, "samples").filter("metric = 'glucose' and unit is null")
    return s.select(subject(), F.col("start_ts").alias("ts"))


_DOSES = f"""doses as (select subject, cast(ts as date) + 1 as date, max(hour(ts)) as h from (select {SUBJECT_SQL.format(d='device_key')} as subject, start_ts as ts from samples where metric = 'glucose' and unit is null) group by 1, 2)"""


@query(f"""with {_SUBJ}, {_DOSES}, grp as (select m.*, case when d.h is null then 0 when d.h >= 15 then 1 end as g from m left join doses d using (subject, date) where d.h is null or d.h >= 15), {_MWU.format(by='subject, metric', tail=_TAIL)}
    select subject, metric, n1, n0, u, cast(cast(p as decimal(18,6)) as double) as p from mwu""")
def o109_exposure(spark, sf_dir):
    """O-25, O-33, O-109: days after a late dose against days after none."""
    days = insights.exposure_days(doses(spark, sf_dir), ["subject"], 15)
    return rounded(insights.mann_whitney(insights.exposed_rows(subject_days(spark, sf_dir), days, ["subject"]), ["subject", "metric"], "value", "exposed"), "p")


@query(f"""with {_SUBJ}, {_DOSES}, wide as (select m.*, d.h, c.hour from m left join doses d using (subject, date) cross join (select unnest(range(11, 22))::integer as hour) c),
    grp as (select *, case when h is null then 0 else 1 end as g from wide where h is null or h >= hour), {_MWU.format(by='subject, metric, hour', tail=_TAIL)}
    select subject, metric, hour, n1, n0, u, cast(cast(p as decimal(18,6)) as double) as p, median_1, median_0 from mwu""")
def o111_cutoff_scan(spark, sf_dir):
    return rounded(_cutoffs(spark, sf_dir), "p")


def _cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.cutoff_scan(subject_days(spark, sf_dir), doses(spark, sf_dir), ["subject"], ["metric"], list(range(11, 22)))


@query(f"""with {_SUBJ}, {_DOSES}, wide as (select m.*, d.h, c.hour from m left join doses d using (subject, date) cross join (select unnest(range(11, 22))::integer as hour) c),
    grp as (select *, case when h is null then 0 else 1 end as g from wide where h is null or h >= hour), {_MWU.format(by='subject, metric, hour', tail=_TAIL)},
    o as (select *, cast(cast(p as decimal(18,6)) as double) as pr, round((median_0 - median_1), 2) as harm from mwu where n1 >= 5 and n0 >= 5),
    b as (select *, row_number() over (partition by subject, metric order by harm desc, round(pr, 4), hour) as k from o where harm > 0)
    select subject, metric, hour, harm, n1, n0, pr as p from b where k = 1""")
def o111_cutoff(spark, sf_dir):
    return insights.best_cutoff(rounded(_cutoffs(spark, sf_dir), "p"), ["subject", "metric"])


def tests_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of tests of each device: pairs, lagged pairs, weekends, trends of the last four weeks and days after a late dose,
    with their metrics and effects: rho, the difference of medians in percent (weekends) or the difference itself (doses).

    Doses are matched to a device by its subject, as in o109_exposure."""
    days, one = cut(series_of(spark, sf_dir).filter("value is not null")), ["device_key", "metric"]
    pairs = insights.spearman(insights.metric_pairs(days, ["device_key"], FORBIDDEN), ["device_key", "a", "b"], "x", "y", 12)
    lags = insights.spearman(insights.lagged_pairs(days, ["device_key"], LAGS), ["device_key", "a", "b"], "x", "y", 12)
    recent = days.filter(F.col("date").between(F.date_sub(F.lit(ANCHOR).cast("date"), 28), F.lit(ANCHOR).cast("date")))
    trends = insights.spearman(recent.withColumn("d", F.datediff("date", F.lit("1970-01-01"))), one, "value", "d", 12)
    late = insights.exposure_days(doses(spark, sf_dir), ["subject"], 15)
    exposed = insights.exposed_rows(days.withColumn("subject", subject()), late, ["subject"])

    def groups(rows: DataFrame, group: str) -> DataFrame:
        return insights.mann_whitney(rows, one, "value", group).filter("n1 >= 5 and n0 >= 5").join(insights.group_medians(rows, one, group), one)

    gap = F.col("median_1") - F.col("median_0")
    percent = F.coalesce(F.try_divide(gap, F.abs("median_0")) * 100, F.lit(0.0))
    weekends = groups(insights.weekend_rows(days), "weekend").filter((F.col("median_0") == 0) | (F.abs(percent) >= 5))

    def named(df: DataFrame, family: str, effect: Column, *metrics: str) -> DataFrame:
        return df.select("device_key", F.lit(family).alias("family"), F.concat_ws(":", F.lit(family), *metrics).alias("key"), F.array(*metrics).alias("metrics"), effect.alias("effect"), "p")

    rho = F.col("rho")
    pool = named(pairs, "pair", rho, "a", "b").unionByName(named(lags, "lag", rho, "a", "b")).unionByName(named(trends, "trend", rho, "metric"))
    return pool.unionByName(named(weekends, "weekend", percent, "metric")).unionByName(named(groups(exposed, "exposed"), "event", gap, "metric"))


@query(f"""with {_SUBJ}, {_PAIRS}, {_SPEAR.format(by='subject, a, b', tail=_TAIL)}, o as (select *, cast(cast(p as decimal(18,6)) as double) as pr from tests), r as (select *, row_number() over (partition by subject order by pr, a, b) as k, count(*) over (partition by subject) as c from o)
    select subject, a, b, cast(cast(least(1.0, min(pr * c / k) over (partition by subject order by k desc rows unbounded preceding)) as decimal(18,6)) as double) as q from r""")
def o104_false_discovery(spark, sf_dir):
    pairs = insights.metric_pairs(subject_days(spark, sf_dir), ["subject"])
    tests = rounded(insights.spearman(pairs, ["subject", "a", "b"], "x", "y", 12), "p")
    return rounded(insights.benjamini_hochberg(tests, "p", ["a", "b"], ["subject"]).select("subject", "a", "b", "q"), "q")


@query(f"""with {_SUBJ}, {_PAIRS}, {_SPEAR.format(by='subject, a, b', tail=_TAIL)}, o as (select *, cast(cast(p as decimal(18,6)) as double) as pr from tests), r as (select *, row_number() over (partition by subject order by pr, a, b) as k, count(*) over (partition by subject) as c from o),
    qs as (select subject, a, b, cast(cast(least(1.0, min(pr * c / k) over (partition by subject order by k desc rows unbounded preceding)) as decimal(18,6)) as double) as q from r)
    select subject, a, b, case when q < 0.01 then 'strong' when q < 0.05 then 'likely' when q < 0.1 then 'probable' when q is not null then 'early' end as evidence from qs""")
def o112_evidence(spark, sf_dir):
    return o104_false_discovery(spark, sf_dir).select("subject", "a", "b", insights.evidence(F.col("q")).alias("evidence"))


@query()
def o110_findings(spark, sf_dir):
    """O-76 to O-78, O-110: five families in one pool, one correction a device, then at most three findings of it that share no metric."""
    pool = insights.benjamini_hochberg(tests_of(spark, sf_dir), "p", ["key"], ["device_key"])
    return insights.choose_cards(insights.qualifying(pool, ["device_key"]), ["device_key"])


@query(f"with {_SERIES} select device_key, metric, max(date) as date from series where value is not null group by 1, 2", text="date")
def o53_anchor(spark, sf_dir):
    return signals.anchors(series_of(spark, sf_dir), BY).withColumnRenamed("anchor", "date")


@query(f"""with {_SERIES}, a as (select device_key, metric, max(date) as anchor from series where value is not null group by 1, 2),
    r as (select s.* from series s join a using (device_key, metric) where s.value is not null and anchor - s.date between 0 and 29)
    select r.device_key, r.metric, r.date, r.value, b.window_days, b.median, b.mad, b.n_days from r left join baselines b using (device_key, metric, date)""", text="date")
def o86_series_with_baselines(spark, sf_dir):
    """The last 30 days of each series, counted from its own last day, with the stored baselines."""
    days = series_of(spark, sf_dir)
    return reports.series_with_baselines(days, table(spark, sf_dir, "baselines"), BY, 30, signals.anchors(days, BY))


@query(f"""with l as (select metric, device_key, max(coalesce(end_ts, start_ts)) as t from samples group by 1, 2), p as (select metric, max(cadence_hours) as c from metric_policy group by 1),
    a as (select *, {_RANK} as r, {SUBJECT_SQL.format(d='device_key')} as subject, (epoch_us(timestamp '{NOW}') - epoch_us(t)) / 3600000000.0::double as age from l),
    g as (select subject, metric, min(age) as freshest from a where r is not null and metric not in ('dietary_energy', 'glucose') group by 1, 2)
    select subject, metric, round(freshest, 1) as freshest_hours from g join p using (metric) where freshest > 2 * c""")
def o28_snoozed(spark, sf_dir):
    """Stale metrics but for glucose, snoozed to the day of NOW, and not for heart_rate, whose snooze ended the day before."""
    seen = signals.last_seen(table(spark, sf_dir, "samples")).withColumn("subject", subject())
    snoozed = spark.createDataFrame([("glucose", NOW[:10]), ("heart_rate", "2015-02-04")], "metric string, until string").select("metric", F.to_date("until").alias("snooze_until"))
    stale = signals.stale_metrics(seen, table(spark, sf_dir, "metric_policy"), daily.rank_of(F.col("device_key")), ["subject"], NOW, snoozed=snoozed)
    return stale.select("subject", "metric", "freshest_hours")


@query(f"""with {_CLEAN}, {_DAILY.strip()}, r as (select subject, metric, date, value from scored where date >= date '2015-01-20' and date < date '2015-01-27'),
    b as (select r.*, (select median(p.value) from scored p where p.subject = r.subject and p.metric = r.metric and p.date < r.date and p.date >= r.date - 30) as median,
        (select count(*) from scored p where p.subject = r.subject and p.metric = r.metric and p.date < r.date and p.date >= r.date - 30) as n from r)
    select subject, metric, date, value, case when n >= 7 then round(median, 6) end as median from b""", text="date")
def o93_recompute(spark, sf_dir):
    """The days of a span recomputed from samples: daily values, their baselines over the days before, and states."""
    rows = signals.recompute(samples_of(spark, sf_dir), table(spark, sf_dir, "metric_policy"), stage(), ["subject"], NOW, "2015-01-20", 7)
    return rows.select("subject", "metric", "date", "value", F.round("median", 6).alias("median"))
