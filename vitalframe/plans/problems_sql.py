"""The problem queries in DuckDB SQL, over the whole tables."""

_UUID = "regexp_replace(regexp_replace(lower(trim({x})), '^urn:uuid:|[{{}}\\s]', '', 'g'), '-', '', 'g')"


def _uuid(x: str) -> str:
    plain = _UUID.format(x=x)
    return f"case when regexp_full_match({plain}, '[0-9a-f]{{32}}') and {plain} <> repeat('0', 32) then {plain} end"


_SURPLUS = f"""
    keyed as (select row_id, case when trim(sample_id) <> '' then sample_id end as s, {_uuid('hk_uuid')} as u from samples),
    firsts as (select row_id, min(row_id) over (partition by s) as fs, min(row_id) over (partition by u) as fu, s, u from keyed),
    surplus as (select row_id from firsts where (s is not null and fs < row_id) or (u is not null and fu < row_id))
"""

_GRID = """
    readings as (select device_key, start_ts, epoch(start_ts) as s, value from samples where metric = 'heart_rate' and value is not null and not isnan(value)),
    slots as (select device_key, cast(floor(s / 3600) as bigint) as slot, min(s) as a, max(s) as b, count(*) as n, avg(value) as mean_value from readings where device_key is not null and s is not null group by 1, 2),
    nexts as (select *, lead(a) over w as next_a, lead(slot) over w as next_slot from slots window w as (partition by device_key order by slot)),
    missing as (select device_key, unnest(range(slot + 1, next_slot)) as slot from nexts where next_a - b <= 7 * 86400)
"""

_DAILY = """
    versions as (select device_key, metric, date, value, row_number() over (partition by device_key, metric, date order by computed_at desc nulls last, value desc nulls last) as k from daily_values),
    days as (select device_key, metric, date, value from versions where k = 1 and value is not null and not isnan(value))
"""

_SPELL = [
    ("kg", "kg", ("kg", "kgs", "kilogram", "kilograms"), "1", "0"),
    ("kg", "g", ("g", "gram", "grams"), "0.001", "0"),
    ("kg", "lb", ("lb", "lb.", "lbs", "pound", "pounds"), "0.45359237", "0"),
    ("kg", "st", ("st", "stone", "stones"), "6.35029318", "0"),
    ("%", "%", ("%", "percent", "pct"), "1", "0"),
    ("%", "fraction", ("fraction", "1"), "100", "0"),
    ("mg/dL", "mg/dL", ("mg/dl",), "1", "0"),
    ("mg/dL", "g/L", ("g/l",), "100", "0"),
    ("mg/dL", "mmol/L", ("mmol/l", "mm", "mmol<180.156>/l"), "18.0156", "0"),
    ("degC", "degC", ("degc", "c", "°c", "cel", "celsius"), "1", "0"),
    ("degC", "degF", ("degf", "f", "°f", "fahrenheit"), "5.0/9", "-160.0/9"),
    ("degC", "K", ("k", "kelvin"), "1", "-273.15"),
    ("kcal", "kcal", ("kcal", "kilocalorie", "kilocalories", "Cal"), "1", "0"),
    ("kcal", "cal", ("cal",), "0.001", "0"),
    ("kcal", "kJ", ("kj", "kilojoule", "kilojoules"), "1/4.184", "0"),
    ("h", "h", ("h", "hr", "hrs", "hour", "hours"), "1", "0"),
    ("h", "min", ("min", "mins", "minute", "minutes"), "1/60.0", "0"),
    ("h", "s", ("s", "sec", "secs", "second", "seconds"), "1/3600.0", "0"),
]
_TABLE = " union all ".join(f"select '{t}' as target, '{u}' as unit, '{w}' as word, cast({a} as double) as scale, cast({b} as double) as shift" for t, u, words, a, b in _SPELL for w in words)

_COMMON = rf"""units as ({_TABLE}),
        clean as (select s.row_id, s.metric, p.unit as target, s.value, s.text_value,
                case when s.value is null or isnan(s.value) then regexp_extract(s.text_value, '([0-9]+(?:[.,][0-9]+)?)\s*h\s*([0-9]{{1,2}})\s*(?:min)?\s*$', ['a', 'b']) end as hm,
                case when s.value is null or isnan(s.value) then regexp_extract(s.text_value, '([0-9]+(?:[.,][0-9]+)?)\s*st\s*([0-9]+(?:[.,][0-9]+)?)\s*lb\s*$', ['a', 'b']) end as sl,
                case when s.value is null or isnan(s.value) then regexp_extract(s.text_value, '([-+]?[0-9]+(?:[.,][0-9]+)?)\s*(.*?)\s*$', ['a', 'b']) end as one, s.unit
            from (select * replace (regexp_replace(text_value, '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g') as text_value) from samples) s join metric_policy p using (metric)
            where s.metric in ('body_mass', 'body_fat_pct', 'glucose', 'wrist_temp', 'spo2', 'active_energy', 'sleep_duration')),
        amounts as (select *, case when hm is null then value when hm.a <> '' then try_cast(replace(hm.a, ',', '.') as double) * 60 + try_cast(hm.b as double)
                when sl.a <> '' then try_cast(replace(sl.a, ',', '.') as double) * 14 + try_cast(replace(sl.b, ',', '.') as double) else try_cast(replace(one.a, ',', '.') as double) end as amount,
                regexp_replace(coalesce(case when hm is null then null when hm.a <> '' then 'min' when sl.a <> '' then 'lb' when one.b <> '' then one.b end, nullif(regexp_replace(unit, '\s+', '', 'g'), ''), target), '\s+', '', 'g') as said from clean
                where (value is not null and not isnan(value)) or text_value is not null),
        named as (select *, case when target = '%' and abs(amount) <= 1.5 then 'fraction' when said in ('Cal', 'CAL') then 'Cal' else lower(said) end as word from amounts where amount is not null),
        common as (select row_id, named.target, value, units.unit as unit_name, amount * scale + shift as common_value from named join units using (target, word))
"""

SQL = {
    "p1_found": f"""
        with {_SURPLUS},
        d as (select delivery_no, min(delivery_no) over (partition by batch_id) as f from batches where trim(batch_id) <> '')
        select 'samples' as origin, row_id as row_no from surplus union all select 'batches', delivery_no from d where f < delivery_no""",
    "p1_kept": f"with {_SURPLUS} select row_id, sample_id, hk_uuid, metric, device_key from samples where row_id not in (select row_id from surplus)",
    "p1_deliveries": """
        with d as (select *, min(delivery_no) over (partition by batch_id) as f from batches)
        select delivery_no, batch_id, device, cast(coalesce(len(samples), 0) as integer) as n_samples from d where batch_id is null or trim(batch_id) = '' or f = delivery_no""",
    "p2_found": f"with {_GRID} select device_key, strftime(make_timestamp(slot * 3600000000), '%Y-%m-%d %H:%M:%S') as slot_start from missing",
    "p2_grid": f"""
        with {_GRID},
        grid as (select device_key, slot, n, mean_value from slots union all select device_key, slot, 0, null from missing),
        near as (select g.device_key, g.slot, any_value(g.n) as n, any_value(g.mean_value) as mean_value,
                sum(k.w) as a0, sum(k.w * k.v) as a1, sum(k.w * k.v * k.v) as a2, sum(k.w * k.y) as b0, sum(k.w * k.v * k.y) as b1, sum(k.w * k.w) as ww
            from grid g left join lateral (
                select 1 - power((r.s / 3600 - (g.slot + 0.5)) / 2.5, 2) as w, r.s / 3600 - (g.slot + 0.5) as v, r.value as y
                from readings r where r.device_key = g.device_key and r.s >= (g.slot - 2) * 3600 and r.s < (g.slot + 3) * 3600) k on true
            group by 1, 2),
        fit as (select *, a0 * a2 - a1 * a1 as det, case when ww > 1e-12 then a0 * a0 / ww else 0 end as support from near)
        select device_key, strftime(make_timestamp(slot * 3600000000), '%Y-%m-%d %H:%M:%S') as slot_start, n as n_readings, round(mean_value, 6) as mean_value,
            round(case when n = 0 and support < 3 then null when det > 1e-9 * a0 * a0 then (a2 * b0 - a1 * b1) / det when a0 > 1e-12 then b0 / a0 else mean_value end, 6) as estimate,
            round(support, 6) as support, case when n > 0 then 'observed' when support >= 3 then 'filled' else 'missing' end as mark
        from fit""",
    "p3_found": f"""
        with {_DAILY},
        right_ones as (select b.device_key, b.metric, b.date, b.window_days, any_value(b.total_value) as total_value, any_value(b.mean_value) as mean_value, any_value(b.n_days) as n_days,
                coalesce(sum(d.value), 0) as t, count(d.value) as n
            from baselines b left join days d on d.device_key = b.device_key and d.metric = b.metric and d.date < b.date and d.date >= b.date - cast(b.window_days as integer)
            where b.device_key is not null and b.metric is not null and b.date is not null and b.window_days >= 1 group by 1, 2, 3, 4)
        select device_key, metric, strftime(date, '%Y-%m-%d') as date, window_days from right_ones
        where coalesce(abs(total_value - t) > 0.05, true) or coalesce(abs(mean_value - t / window_days) > 0.05, true) or n_days is distinct from n""",
    "p3_totals": f"""
        with {_DAILY},
        span as (select device_key, metric, min(date) as a, max(date) as b from versions where device_key is not null and metric is not null and date is not null group by 1, 2),
        asked as (select device_key, metric, cast(unnest(generate_series(a, b + 1, interval 1 day)) as date) as date from span),
        wide as (select *, unnest([7, 30]) as window_days from asked)
        select w.device_key, w.metric, strftime(w.date, '%Y-%m-%d') as date, w.window_days, round(coalesce(sum(d.value), 0), 4) as total_value,
            round(coalesce(sum(d.value), 0) / w.window_days, 4) as mean_value, cast(count(d.value) as integer) as n_days
        from wide w left join days d on d.device_key = w.device_key and d.metric = w.metric and d.date < w.date and d.date >= w.date - w.window_days group by 1, 2, 3, 4""",
    "p4_found": f"""
        with {_COMMON}
        select row_id, cast(round(common_value) as bigint) as common_value from common where value is null or isnan(value) or unit_name <> target""",
    "p6_found": f"""
        with b as (select batch_id, cast(sent_at as timestamptz) as moment, samples, deleted from batches),
        e as (select {_uuid('x')} as key, moment, 0 as op, batch_id from (select batch_id, moment, unnest(samples).uuid as x from b)
            union all select {_uuid('x')}, moment, 1, batch_id from (select batch_id, moment, unnest(deleted) as x from b)),
        last as (select key, arg_max(struct_pack(op := op, batch_id := batch_id), struct_pack(moment := moment, batch_id := batch_id, op := op)) as z from e where key is not null group by key)
        select concat_ws('-', key[1:8], key[9:12], key[13:16], key[17:20], key[21:32]) as hk_uuid, z.batch_id as batch_id from last where z.op = 0""",
    "p6_state": f"""
        with b as (select batch_id, cast(sent_at as timestamptz) as moment, samples, deleted from batches),
        u0 as (select batch_id, moment, unnest(samples) as x, generate_subscripts(samples, 1) as place from b),
        d0 as (select batch_id, moment, unnest(deleted) as x, generate_subscripts(deleted, 1) as place from b),
        e as (select {_uuid('x.uuid')} as key, struct_pack(moment := moment, batch_id := batch_id, op := 0, place := place) as seq, x from u0
            union all select {_uuid('x')}, struct_pack(moment := moment, batch_id := batch_id, op := 1, place := place), null from d0),
        f as (select *, max(seq) filter (seq.op = 1) over (partition by key) as dead from e where key is not null),
        live as (select * from f where seq.op = 0 and (dead is null or seq > dead))
        select concat_ws('-', key[1:8], key[9:12], key[13:16], key[17:20], key[21:32]) as hk_uuid, arg_max(seq.batch_id, seq) as batch_id,
            {', '.join(f"arg_max(x.{c}, seq) filter (x.{c} is not null) as {c}" for c in ("hk_type", "metric", "value", "text_value", "unit", "start_ts", "end_ts", "source_name"))} from live group by key""",
    "p7_found": r"""
        with asleep as (select device_key, start_ts as s, end_ts as e from samples where metric = 'sleep_analysis' and end_ts > start_ts and device_key is not null
                and coalesce(regexp_replace(regexp_replace(lower(trim(text_value)), '^hkcategoryvaluesleepanalysis', ''), '[_\s-]', '', 'g'), '') not in ('inbed', 'awake')),
        marked as (select *, case when s > max(e) over (partition by device_key order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as opens from asleep),
        labelled as (select *, sum(opens) over (partition by device_key order by s, e rows unbounded preceding) as island from marked),
        periods as (select device_key, min(s) as s, max(e) as e from labelled group by device_key, island),
        ends as (select device_key, e as s, lead(s) over (partition by device_key order by s) as e from periods),
        both_kinds as (select device_key, 'period' as kind, s, e from periods union all select device_key, 'gap', s, e from ends where e - s <= interval 12 hour)
        select device_key, kind, strftime(s, '%Y-%m-%d %H:%M:%S') as from_ts, strftime(e, '%Y-%m-%d %H:%M:%S') as to_ts from both_kinds""",
}
