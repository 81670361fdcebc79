"""Queries of the text, report and streaming operators, each with its SQL for DuckDB where it has one."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions import columns as C
from vitalframe.operators import baselines, daily, ingest, intervals, reports, signals, text
from vitalframe.plans import series as S
from vitalframe.plans.problems_sql import _SURPLUS
from vitalframe.plans.series import ANCHOR, BY, query
from vitalframe.session import scratch, table
from vitalframe.streaming import pipeline

# text

_SPECS = ", ".join(f"({i}, '{n}', {sorted(a, key=len, reverse=True)!r}, {u!r}, {lo}, {hi})" for i, (n, a, u, lo, hi) in enumerate(text.BIOMARKERS))
_NUM, _RNG, _LT, _GT = text._NUMBER, text.RANGE, text.BELOW, text.ABOVE


@query(rf"""with specs(ord, name, aliases, units, lo, hi) as (values {_SPECS}),
    l0 as (select doc_id, string_split_regex(text, '\r\n|[\n\r]') as parts from documents where text is not null),
    l1 as (select doc_id, generate_subscripts(parts, 1) as line_no, trim(unnest(parts)) as line from l0),
    hits as (select doc_id, line_no, s.*, list_filter(aliases, lambda a: contains(lower(line), a))[1] as alias, line from l1, specs s where line <> ''),
    tails as (select *, substr(line, instr(lower(line), alias) + length(alias)) as tail from hits where alias is not null),
    nums as (select *, regexp_extract(tail, '{_NUM}') as raw from tails),
    best as (select *, row_number() over (partition by doc_id, line_no order by ord) as k from nums where raw <> ''),
    aft as (select *, substr(tail, instr(tail, raw) + length(raw)) as aft from best where k = 1),
    vals as (select doc_id, line_no, name as biomarker, cast(raw as double) as value, list_filter(units, lambda u: contains(lower(tail), u))[1] as unit, lo, hi, try_cast(regexp_extract(aft, '{_RNG}', 1) as double) as ra,
        try_cast(regexp_extract(aft, '{_RNG}', 2) as double) as rb, try_cast(regexp_extract(aft, '{_LT}', 1) as double) as lt, try_cast(regexp_extract(aft, '{_GT}', 1) as double) as gt from aft),
    refs as (select *, case when ra is not null then ra when lt is null then gt end as ref_low, case when ra is not null then rb else lt end as ref_high from vals),
    firsts as (select *, row_number() over (partition by doc_id, biomarker, value order by line_no) as j from refs)
    select doc_id, biomarker, value, unit, ref_low, ref_high, cast(greatest(0.05, least(0.95, (5 + case when unit is not null then 2 else 0 end + case when ref_low is not null or ref_high is not null then 2 else 0 end + case when value >= lo and value <= hi then 1 else -2 end) / 10.0)) as double) as confidence
    from firsts where j = 1""")
def o140_lab_rows(spark, sf_dir):
    return text.lab_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


_DATED = "case when doc_id % 3 = 0 then 'Collected ' || strftime(created_at, '%d/%m/%Y') when doc_id % 3 = 1 then 'on ' || strftime(created_at, '%Y-%m-%d') || ', printed 31/02/2020' else 'at ' || strftime(created_at, '%d-%m-%Y') end"


@query(rf"""with d as (select doc_id, {_DATED} as t from documents)
    select doc_id, strftime(coalesce(try_strptime(nullif(regexp_extract(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), ''), '%Y-%m-%d'), try_strptime(nullif(regexp_extract(t, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'), ''), '%d/%m/%Y'),
        try_strptime(nullif(regexp_extract(t, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}'), ''), '%d-%m-%Y')), '%Y-%m-%d') as panel_date from d""")
def o141_panel_date(spark, sf_dir):
    day = lambda f: F.date_format("created_at", f)
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Collected "), day("dd/MM/yyyy"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("on "), day("yyyy-MM-dd"), F.lit(", printed 31/02/2020"))).otherwise(F.concat(F.lit("at "), day("dd-MM-yyyy")))
    return table(spark, sf_dir, "documents").select("doc_id", F.date_format(text.panel_date(t), "yyyy-MM-dd").alias("panel_date"))


@query("""select row_id, substr(sha256(concat_ws('|', strftime(start_ts, '%Y-%m-%d'), metric, cast(cast(value as decimal(18,3)) as varchar))), 1, 16) as lab_id from samples where value is not null""")
def o142_lab_id(spark, sf_dir):
    s = table(spark, sf_dir, "samples").filter("value is not null")
    return s.select("row_id", text.lab_id(F.to_date("start_ts"), F.col("metric"), F.col("value").cast("decimal(18,3)")).alias("lab_id"))


_KIND = " ".join(f"when regexp_matches(text, '(?i)(^|[^a-z0-9_])({w})([^a-z0-9_]|$)') then '{k}'" for k, w in text.LOG_WORDS)


@query(f"select doc_id, case {_KIND} else 'note' end as kind from documents")
def o143_log_kind(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.log_kind(F.col("text")).alias("kind"))


_PROPOSED = "case doc_id % 3 when 0 then 'symptom' when 1 then 'food' end"


@query(f"""with k as (select doc_id, {_PROPOSED} as proposed, case {_KIND} else 'note' end as said, source from documents)
    select doc_id, case when said in ('caffeine', 'alcohol') then said else coalesce(proposed, said) end as kind, case when regexp_matches(source, '^[A-Za-z0-9_ .,/×%-]{{0,40}}$') then source else '' end as amount from k""")
def o145_guards(spark, sf_dir):
    proposed = F.when(F.col("doc_id") % 3 == 0, "symptom").when(F.col("doc_id") % 3 == 1, "food")
    return table(spark, sf_dir, "documents").select("doc_id", text.guarded_kind(proposed, F.col("text")).alias("kind"), text.guarded_amount(F.col("source")).alias("amount"))


@query(rf"""with g as (select doc_id, created_at, regexp_extract(text, '{text.STATED}', ['h', 'm', 'p', 'bh', 'bm']) as g from documents where text is not null),
    t as (select doc_id, hour(created_at) * 60 + minute(created_at) as at0, try_cast(nullif(g.h, '') as integer) as h, coalesce(try_cast(nullif(g.m, '') as integer), try_cast(nullif(g.bm, '') as integer), 0) as mi, lower(g.p) as p, try_cast(nullif(g.bh, '') as integer) as bh from g)
    select * from (select doc_id, cast(case when p <> '' then case when h <= 12 then ((at0 - ((h % 12 + case when p = 'p' then 12 else 0 end) * 60 + mi)) % 1440 + 1440) % 1440 end when bh > 23 then null when bh > 12 then ((at0 - (bh * 60 + mi)) % 1440 + 1440) % 1440
        else least(((at0 - (bh * 60 + mi)) % 1440 + 1440) % 1440, ((at0 - ((bh + 12) % 24 * 60 + mi)) % 1440 + 1440) % 1440) end as integer) as minutes_ago from t) where minutes_ago is not null""")
def o144_stated_time(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.stated_minutes_ago(F.col("text"), F.col("created_at")).cast("int").alias("minutes_ago")).filter("minutes_ago is not null")


@query()
def o148_grounding(spark, sf_dir):
    """Numbers of the second half of each text that don't occur in the first."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    half = (F.length("text") / 2).cast("int")
    bad = text.ungrounded_numbers(F.col("text").substr(half + 1, F.length("text")), F.col("text").substr(F.lit(1), half))
    return d.select("doc_id", F.size(bad).alias("n_errors"))


@query(f"select doc_id, regexp_extract(text, '{text.BLOCKLIST}') as word from documents where regexp_matches(text, '{text.BLOCKLIST}')")
def o148_blocklist(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.blocked_word(F.col("text")).alias("word")).filter("word is not null")


@query("select row_id, case when value < 70 then 'Low' when value > 110 then 'High' else '' end as flag from samples where metric = 'glucose' and value is not null")
def o123_lab_flag(spark, sf_dir):
    s = table(spark, sf_dir, "samples").filter("metric = 'glucose' and value is not null")
    return s.select("row_id", text.lab_flag(F.col("value"), F.lit(70.0), F.lit(110.0)).alias("flag"))


@query("""with m as (select row_id, cast(round(value * 60) as bigint) as m from samples where metric = 'sleep_duration' and value is not null)
    select row_id, case when m % 60 > 0 then (m // 60) || ' hours ' || (m % 60) || ' minutes' else (m // 60) || ' hours' end as spoken from m""")
def o137_hours_minutes(spark, sf_dir):
    return table(spark, sf_dir, "samples").filter("metric = 'sleep_duration' and value is not null").select("row_id", C.hours_minutes(F.col("value")).alias("spoken"))


@query("""select row_id, case when abs(value) >= 1000 then format('{:,}', cast(round(value) as bigint)) else printf('%.1f', value) end as shown from samples where metric = 'steps' and value is not null""")
def o138_number_format(spark, sf_dir):
    return table(spark, sf_dir, "samples").filter("metric = 'steps' and value is not null").select("row_id", C.compact_number(F.col("value")).alias("shown"))


@query("""select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html from documents""")
def o139_html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.html_escape(F.col("text")).alias("html"))


# reports

_STAGES = f"""st as (select *, {S.STAGE_SQL} as stage from cleaned where metric = 'sleep_analysis' and value is not null),
    nights as (select subject, device_key, cast(coalesce(end_ts, start_ts) as date) as date, {', '.join(f"cast(sum(cast(value as decimal(24,4))) filter (stage = '{s}') as double) as {s}" for s in ('deep', 'rem', 'core', 'asleep', 'awake', 'in_bed'))} from st group by 1, 2, 3)"""


def nights_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.stage_nights(S.samples_of(spark, sf_dir), S.stage(), ["subject"])


@query(f"""with {S._CLEAN}, {_STAGES} select device_key, count(distinct date) as nights, {', '.join(f'round(cast(sum(cast({s} as decimal(24,4))) as double) / count({s}), 1) as {s}' for s in ('deep', 'rem', 'core'))} from nights where deep is not null or rem is not null or core is not null group by 1""")
def o54_stage_architecture(spark, sf_dir):
    return reports.stage_architecture(nights_of(spark, sf_dir), ["device_key"])


@query("""select device_key, round(cast(sum(cast(value as decimal(24,4))) as double) / count(distinct cast(coalesce(end_ts, start_ts) as date))) as minutes_per_night, count(distinct cast(coalesce(end_ts, start_ts) as date)) as nights from samples where metric = 'sleep_analysis' and value is not null group by 1""")
def o55_minutes_per_night(spark, sf_dir):
    s = table(spark, sf_dir, "samples").filter("metric = 'sleep_analysis' and value is not null")
    day = F.to_date(F.coalesce("end_ts", "start_ts"))
    return s.groupBy("device_key").agg(F.round(C.exact_sum(F.col("value")) / F.count_distinct(day)).alias("minutes_per_night"), F.count_distinct(day).alias("nights"))


@query(f"""with {S._CLEAN}, {S._SLEEP}, {_STAGES}, ranked_sleep as (select *, {S._RANK} as rank from sleep),
    hours as (select subject, date, arg_min(value, struct_pack(r := rank, d := device_key)) as value from ranked_sleep where rank is not null group by 1, 2),
    usable as (select *, list_position(['apple_watch_ultra', 'zepp_helio', 'whoop'], regexp_replace(device_key, '_[0-9]+$', '')) as o, core is not null or deep is not null or rem is not null as staged from nights),
    best as (select *, row_number() over (partition by subject, date order by o, device_key) as k from usable where o > 0 and (staged or asleep is not null))
    select h.subject, h.date, h.value as asleep_h, b.device_key as stage_source, cast(round(case when b.o is not null then coalesce(b.deep, 0) end) as integer) as deep_min, cast(round(case when b.o is not null then coalesce(b.rem, 0) end) as integer) as rem_min,
        cast(round(case when b.o is not null then coalesce(b.core, 0) + case when b.staged then 0 else coalesce(b.asleep, 0) end end) as integer) as light_min, cast(round(case when b.o is not null then coalesce(b.awake, 0) end) as integer) as awake_min,
        case when b.in_bed > 0 then round(h.value * 60 / b.in_bed * 100, 1) end as efficiency_pct
    from hours h left join (select * from best where k = 1) b using (subject, date)""", text="date")  # fmt: skip
def o80_sleep_report(spark, sf_dir):
    """O-34, O-80: arbitrated hours with the stages of the first usable source; nights without stages keep their hours."""
    slept = daily.arbitrate(S.sleep_of(spark, sf_dir).withColumn("metric", F.lit("sleep_duration")), ["subject"]).select("subject", "date", "value")
    kind = F.regexp_replace("device_key", "_[0-9]+$", "")
    return reports.sleep_report(slept, nights_of(spark, sf_dir), ["subject"], kind)


@query(f"""with {S._SIGNALS} select device_key, metric, count(*) as n, round(cast(sum(cast(value as decimal(24,4))) as double) / count(value), 4) as mean, count(*) filter (state = 'flag') as n_flag,
    coalesce(string_agg(strftime(date, '%Y-%m-%d'), ',' order by date) filter (state = 'flag'), '') as flagged from states where date > date '{ANCHOR}' - 7 and date <= date '{ANCHOR}' group by 1, 2""")
def o81_weekly_review(spark, sf_dir):
    return reports.weekly_review(S.signals_of(spark, sf_dir), BY, F.lit(ANCHOR).cast("date"))


@query(f"""with {S._SERIES} select device_key, metric, count(*) as n, median(value) as median, arg_max(value, date) as latest from series where value is not null and date > date '{ANCHOR}' - 30 and date <= date '{ANCHOR}' group by 1, 2""")
def o82_vitals(spark, sf_dir):
    return reports.vitals(S.series_of(spark, sf_dir), BY, F.lit(ANCHOR).cast("date"))


@query("select 'samples' as name, count(*) as rows from samples union all select 'daily_values', count(*) from daily_values union all select 'sync_log', count(*) from sync_log")
def o84_counts(spark, sf_dir):
    out = None
    for name in ("samples", "daily_values", "sync_log"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("select batch_id, strftime(received_at, '%Y-%m-%d %H:%M:%S') as received_at, sender, n_samples from sync_log order by sync_log.received_at desc, batch_id limit 5")
def o74_latest_batches(spark, sf_dir):
    """O-73, O-74, O-85: the last five deliveries, a top-k report."""
    t = table(spark, sf_dir, "sync_log").orderBy(F.desc("received_at"), "batch_id").limit(5)
    return t.select("batch_id", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("received_at"), "sender", "n_samples")


@query(f"""with {S._SERIES} select device_key, metric, count(*) as n, min(value) as min, max(value) as max, list_sort(list(value))[cast(count(*) // 2 as integer) + 1] as median, arg_max(value, date) as latest from series where value is not null group by 1, 2""")
def o50_summary(spark, sf_dir):
    """O-48, O-50, O-90."""
    return reports.summary(S.series_of(spark, sf_dir), BY).drop("latest_date")


@query(f"""with {S._SERIES} select device_key, date, max(value) filter (metric = 'steps') as steps, max(value) filter (metric = 'active_energy') as active_energy, max(value) filter (metric = 'dietary_energy') as dietary_energy from series group by 1, 2""", text="date")
def o87_activity(spark, sf_dir):
    return reports.activity(S.series_of(spark, sf_dir), ["device_key"], ["steps", "active_energy", "dietary_energy"])


@query("""with d as (select device_key, metric, value, computed_at, date, row_number() over (partition by device_key, metric, date order by computed_at desc, value desc nulls last) as k from daily_values),
    a as (select device_key, max(date) as last from d group by 1)
    select d.device_key, arg_min(value, date) filter (metric = 'steps' and value is not null) as steps, arg_min(value, date) filter (metric = 'active_energy' and value is not null) as active_energy from d join a using (device_key) where k = 1 and date >= date '2015-03-14' and date <= date '2015-03-15' group by 1""")
def o136_live_record(spark, sf_dir):
    """Of the anchor day and the day before, the older value of each kind."""
    rows = S.series_of(spark, sf_dir).filter("value is not null").select("device_key", "date", F.col("metric").alias("kind"), F.col("value").alias("payload"))
    every = S.series_of(spark, sf_dir).select("device_key", "date", F.lit("none").alias("kind"), F.lit(None).cast("double").alias("payload"))
    return reports.live_record(rows.unionByName(every), ["device_key"], F.lit(ANCHOR).cast("date"), ["steps", "active_energy"])


@query("select metric, count(*) as n, cast(sum(cast(value as decimal(24,4))) as double) as total from samples where value is not null group by metric order by n desc limit 500")
def o27_read_only_sql(spark, sf_dir):
    table(spark, sf_dir, "samples").createOrReplaceTempView("samples_view")
    return reports.read_only(spark, "select metric, count(*) as n, cast(sum(cast(value as decimal(24,4))) as double) as total from samples_view where value is not null group by metric order by n desc")


@query("with d as (select metric, case metric when 'heart_rate' then 0 when 'hrv_sdnn' then 1 when 'sleep_duration' then 2 when 'steps' then 3 else 99 end as o from metric_policy) select metric, row_number() over (order by o, metric) as place from d")
def o75_custom_order(spark, sf_dir):
    order = F.array(*[F.lit(m) for m in ("heart_rate", "hrv_sdnn", "sleep_duration", "steps")])
    at = F.array_position(order, F.col("metric"))
    from pyspark.sql.window import Window

    ranked = table(spark, sf_dir, "metric_policy").select("metric", F.when(at > 0, at).otherwise(99).alias("o"))
    return ranked.select("metric", F.row_number().over(Window.orderBy("o", "metric")).cast("long").alias("place"))


@query("""with v as (select device_key, metric, date, value, row_number() over (partition by device_key, metric, date order by computed_at desc, value desc nulls last) as k from daily_values),
    c as (select v.device_key, v.metric, v.date, b.window_days, (v.value - b.median) / nullif(abs(b.median), 0) * 100 as p from v join baselines b using (device_key, metric, date) where k = 1)
    select device_key, metric, date, window_days, case when p > 1.5 then 'up' when p < -1.5 then 'down' when p is not null then 'flat' end as arrow from c""", text="date")
def o129_delta_arrow(spark, sf_dir):
    stored = table(spark, sf_dir, "baselines").select("device_key", "metric", "date", "window_days", "median")
    return S.series_of(spark, sf_dir).join(stored, ["device_key", "metric", "date"]).select("device_key", "metric", "date", "window_days", C.delta_arrow(F.col("value"), F.col("median")).alias("arrow"))


@query("""with r as (select doc_id, author_key, row_number() over (partition by author_key order by created_at desc, doc_id desc) as k from documents) select author_key, doc_id, cast(k as integer) as turn from r where k <= 10""")
def o91_history(spark, sf_dir):
    """The last ten entries of each author, the latest first."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("author_key").orderBy(F.desc("created_at"), F.desc("doc_id"))
    return table(spark, sf_dir, "documents").withColumn("turn", F.row_number().over(w)).filter("turn <= 10").select("author_key", "doc_id", "turn")


@query("""with r as (select row_id, device_key, row_number() over (partition by device_key order by ingested_at desc, row_id desc) as k from samples) select row_id, device_key from r where k > 1""")
def o147_undo_last(spark, sf_dir):
    """Without the entry logged last by each device: a tombstone and an anti-join."""
    rows = table(spark, sf_dir, "samples").select("row_id", "device_key", "ingested_at")
    last = rows.groupBy("device_key").agg(F.max_by("row_id", F.struct("ingested_at", "row_id")).alias("row_id")).select("row_id")
    return ingest.retract(rows, last, "row_id").select("row_id", "device_key")


@query("""with a as (select batch_id, 'suggested' as status from sync_log), b as (select batch_id, 'done' as status from sync_log where n_samples > 3) select status, count(*) as n from (select batch_id, coalesce(b.status, a.status) as status from a left join b using (batch_id)) group by 1""")
def o88_status_update(spark, sf_dir):
    log = table(spark, sf_dir, "sync_log")
    stored = log.select("batch_id", F.lit("suggested").alias("status"), F.lit(0).alias("v"))
    changed = log.filter("n_samples > 3").select("batch_id", F.lit("done").alias("status"), F.lit(1).alias("v"))
    return ingest.upsert(stored, changed, ["batch_id"], "v").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with s as (select *, {S.SUBJECT_SQL.format(d='device_key')} as subject from samples), l as (select metric, subject, max(coalesce(end_ts, start_ts)) as last_seen, count(distinct device_key) as devices from s group by 1, 2) select * from l""", text="last_seen")
def o85_freshness(spark, sf_dir):
    s = table(spark, sf_dir, "samples").withColumn("subject", S.subject())
    return s.groupBy("metric", "subject").agg(F.max(F.coalesce("end_ts", "start_ts")).alias("last_seen"), F.count_distinct("device_key").alias("devices"))


# streaming, over the whole log in four files


def landed(spark: SparkSession, sf_dir: str, columns: list[str], where: str = "true", files: int = 4) -> DataFrame:
    """The log of samples as a stream: written to a landing folder in `files` parts in arrival order and read from there."""
    path = f"{scratch(spark, 'landing')}/rows"
    rows = table(spark, sf_dir, "samples").filter(where).select("row_id", *columns)
    rows.repartitionByRange(files, "row_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"with {_SURPLUS} select metric, count(*) as rows from samples where row_id not in (select row_id from surplus) group by 1")
def o157_stream_dedupe(spark, sf_dir):
    """O-12, O-155, O-157: four micro-batches into the store, each message once whatever batch its copies come in."""
    landing, base = scratch(spark, "landing"), scratch(spark, "stream")
    rows = table(spark, sf_dir, "samples").select("row_id", "sample_id", "hk_uuid", "metric", "start_ts")
    for _ in land_in_order(spark, rows, landing):
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        pipeline.run_available(stream.writeStream.foreachBatch(pipeline.store_sink(f"{base}/seen", f"{base}/raw")), f"{base}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{base}/raw").groupBy("metric").agg(F.count(F.lit(1)).alias("rows"))


@query("select metric, cast(start_ts as date) as date, cast(sum(cast(value as decimal(24,4))) as double) as total, count(value) as n from samples where value is not null group by 1, 2", text="date")
def o158_late_data(spark, sf_dir):
    """O-151, O-158: the days each micro-batch touches are computed anew, so late rows of any age count."""
    base = scratch(spark, "stream")
    stream = landed(spark, sf_dir, ["metric", "start_ts", "value"], "value is not null")
    derive = lambda rows: rows.groupBy("metric", "date").agg(C.exact_sum(F.col("value")).alias("total"), F.count("value").alias("n"))
    pipeline.run_available(stream.writeStream.foreachBatch(pipeline.recompute_sink(f"{base}/raw", f"{base}/daily", derive)), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/daily").select("metric", F.col("date").cast("date").alias("date"), "total", "n")


def land_in_order(spark: SparkSession, rows: DataFrame, path: str, files: int = 4) -> Iterator[int]:
    """Lands `rows` in `path` in parts of ascending row_id, the next part when the caller asks for it.

    A stream run after each part gets the parts in this order, whatever the times of the files."""
    staged = scratch(spark, "staged")
    rows.repartitionByRange(files, "row_id").withColumn("part", F.spark_partition_id()).write.mode("append").partitionBy("part").parquet(staged)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = to(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in range(files):
        folder = to(f"{staged}/part={part}")
        for file in fs.listStatus(folder) if fs.exists(folder) else []:
            if not fs.rename(file.getPath(), to(f"{path}/{file.getPath().getName()}")):
                raise OSError(f"{file.getPath()} can't be moved to {path}")
        yield part


def stream_days(spark: SparkSession, rows: DataFrame, late: timedelta, files: int = 4) -> DataFrame:
    """(metric, date, total, n) of all `rows` (row_id, metric, start_ts, value), which arrive in parts of ascending row_id."""
    landing, days, raw, corrected, base = (scratch(spark, n) for n in ("landing", "days", "raw", "corrected", "stream"))
    derive = lambda r: r.groupBy("metric", "date").agg(C.exact_sum(F.col("value")).alias("total"), F.count("value").alias("n"))
    for _ in land_in_order(spark, rows, landing, files):
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        windows = pipeline.day_windows(stream, ["metric"], "start_ts", "value", f"{late.total_seconds():.0f} seconds")
        pipeline.run_available(windows.writeStream.format("parquet").option("path", days), f"{base}/windows")
        pipeline.run_available(stream.writeStream.foreachBatch(pipeline.late_sink(raw, corrected, derive, late)), f"{base}/late")
    kind = "metric string, date date, total double, n long"
    stored = [spark.read.schema(k).parquet(p) for k, p in ((kind, days), (kind, corrected), (rows.schema, raw))]
    return pipeline.complete_days(*stored, derive)


@query("select metric, cast(start_ts as date) as date, cast(sum(cast(value as decimal(24,4))) as double) as total, count(value) as n from samples where value is not null group by 1, 2", text="date")
def o161_day_windows(spark, sf_dir):
    """Tumbling days with a watermark of ten days; days of rows behind it are recomputed, days still open are added at the end."""
    rows = table(spark, sf_dir, "samples").filter("value is not null").select("row_id", "metric", "start_ts", "value")
    return stream_days(spark, rows, timedelta(days=10))


@query()
def o162_alert_state(spark, sf_dir):
    """O-127, O-162: alerts of unreadable readings through keyed state, one per metric and six hours.

    The log lands in one file: what is sent depends on the order of alerts, and files of one second come in any order."""
    base = scratch(spark, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    alerts = landed(spark, sf_dir, ["metric", "ingested_at"], "value is null", files=1).select("metric", F.col("ingested_at").cast("timestamp").alias("ts"))
    pipeline.run_available(pipeline.alert_stream(alerts).writeStream.format("parquet").option("path", f"{base}/sent"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sent")


@query()
def o128_escalation(spark, sf_dir):
    """Outages of a metric's delivery: a reading without a value is a failed check, one with a value a good one."""
    base = scratch(spark, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = landed(spark, sf_dir, ["metric", "ingested_at", "value"], files=1)
    checks = rows.select("metric", F.col("ingested_at").cast("timestamp").alias("ts"), F.col("value").isNotNull().alias("ok"))
    pipeline.run_available(pipeline.escalation_stream(checks).writeStream.format("parquet").option("path", f"{base}/sent"), f"{base}/checkpoint")
    return spark.read.schema("metric string, ts timestamp, stage string").parquet(f"{base}/sent")


@query()
def o128_quiet(spark, sf_dir):
    """Metrics that fell quiet: the arrival of any row is a check of its metric, its start the reading."""
    base = scratch(spark, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = landed(spark, sf_dir, ["metric", "ingested_at", "start_ts"], files=1)
    checks = rows.select("metric", F.col("ingested_at").cast("timestamp").alias("ts"), F.col("start_ts").cast("timestamp").alias("reading"))
    pipeline.run_available(pipeline.quiet_stream(checks).writeStream.format("parquet").option("path", f"{base}/sent"), f"{base}/checkpoint")
    return spark.read.schema("metric string, ts timestamp, since timestamp").parquet(f"{base}/sent")


@query("""with g as (select cast(start_ts as date) as date, metric as name, cast(value as decimal(18,3)) as value, unit, row_id from samples where metric is not null and value is not null and start_ts is not null),
    k as (select *, row_number() over (partition by date, name, value order by row_id desc) as k from g)
    select substr(sha256(concat_ws('|', strftime(date, '%Y-%m-%d'), name, cast(value as varchar))), 1, 16) as lab_id, name, cast(value as double) as value, unit from k where k = 1""")
def o142_store_labs(spark, sf_dir):
    """O-89, O-142: rows lacking a name, value or date are skipped, the others upserted by their id, the later row holding."""
    s = table(spark, sf_dir, "samples").select(F.to_date("start_ts").alias("date"), F.col("metric").alias("name"), F.col("value").cast("decimal(18,3)").alias("value"), "unit", "row_id")
    half = F.col("row_id") % 2 == 0
    stored = text.store_labs(None, s.filter(half), "row_id")
    return text.store_labs(stored, s.filter(~half), "row_id").select("lab_id", "name", F.col("value").cast("double").alias("value"), "unit")
