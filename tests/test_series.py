"""Boundary rows of the series operators, worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from vitalframe.functions import columns as C
from vitalframe.operators import baselines, daily, ingest, insights, signals

D = dt.date(2026, 7, 1)
T = dt.datetime(2026, 7, 1, 8)


def one(spark, **cols):
    df = spark.range(1)
    return df.select(*[v.alias(k) for k, v in cols.items()]).first()


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_medians(spark):
    r = one(spark, upper=C.upper_median(arr(8, 1, 4, 2)), mad=C.mad(arr(1, 2, 4, 8), F.lit(3.0)), none=C.upper_median(F.array().cast("array<double>")))
    assert (r.upper, r.mad, r.none) == (4.0, 1.5, None)


@pytest.mark.parametrize("value,text", [(62.0, "62"), (0.0, "0"), (-0.0, "0"), (0.0757658928, "0.075766"), (None, "None"), (float("nan"), "None"), (1.5, "1.5"), (-2.25, "-2.25"), (100.0, "100")])
def test_canonical_number(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(C.canonical_number(F.col("v"))).first()[0] == text


@pytest.mark.parametrize("x", [-3.0, -0.5, 0.0, 0.3, 1.0, 1.96, 4.0])
def test_normal_tail(spark, x):
    assert math.isclose(one(spark, p=C.normal_tail(F.lit(x))).p, 0.5 * math.erfc(x / math.sqrt(2)), rel_tol=2e-7)


@pytest.mark.parametrize("hours,text", [(7.21, "7 hours 13 minutes"), (8.0, "8 hours"), (7.999, "8 hours"), (None, None)])
def test_hours_minutes(spark, hours, text):
    assert one(spark, t=C.hours_minutes(F.lit(hours).cast("double"))).t == text


@pytest.mark.parametrize("others,share", [([112.0], 1.0), ([112.1], 0.0), ([112.0, 112.1], 0.5), ([], 0.6)])
def test_agreement(spark, others, share):
    a = F.array(*[F.lit(x) for x in others]) if others else F.array().cast("array<double>")
    assert one(spark, a=daily.agreement(F.lit(100.0), a), z=daily.agreement(F.lit(0.0), a)).asDict() == {"a": share, "z": 0.6}


@pytest.mark.parametrize("rank,cover,agree,score,grade", [(0, 1.0, 0.6, 0.92, "A"), (1, 1 / 3, 0.6, 0.68167, "C"), (None, 0.0, 0.0, 0.3375, "D"), (2, 1.0, 1.0, 0.825, "B")])
def test_confidence(spark, rank, cover, agree, score, grade):
    s = daily.confidence(F.lit(rank).cast("int"), F.lit(0.0), F.lit(cover), F.lit(agree))
    r = one(spark, s=s, g=daily.grade(s))
    assert math.isclose(r.s, score, abs_tol=1e-4) and r.g == grade


STATE_RULES = {
    "low": signals.Rule("lower"), "zone": signals.Rule(zones=(67.0, 34.0)), "pct": signals.Rule("none", below_median_pct=15.0), "band": signals.Rule("band"), "high": signals.Rule("higher"), "hours": signals.Rule("none", below=7.0), "above": signals.Rule("none", above_median_by=5.0),
}


@pytest.mark.parametrize(
    "metric,value,med,mad,state",
    [("low", 61.2, 60.0, 0.0, "neutral"), ("low", 61.3, 60.0, 0.0, "flag"), ("low", 60.0, 60.0, 0.0, "favorable"), ("zone", 67.0, 1.0, 0.0, "favorable"), ("zone", 66.9, 1.0, 0.0, "neutral"), ("zone", 34.0, 1.0, 0.0, "neutral"), ("zone", 33.9, 1.0, 0.0, "flag"),
     ("pct", 51.0, 60.0, 1.0, "flag"), ("pct", 51.1, 60.0, 1.0, "neutral"), ("band", 61.1, 60.0, 0.0, "favorable"), ("band", 61.3, 60.0, 0.0, "flag"), ("high", 58.7, 60.0, 0.0, "flag"), ("hours", 6.9, 8.0, 0.0, "flag"), ("above", 65.0, 60.0, 0.0, "flag"), ("other", 1.0, 60.0, 0.0, "neutral"), ("low", 1.0, None, None, "insufficient")],
)
def test_states(spark, metric, value, med, mad, state):
    r = spark.createDataFrame([(metric, value, med, mad)], "m string, v double, med double, mad double")
    assert r.select(signals.state(F.col("m"), F.col("v"), F.col("med"), F.col("mad"), STATE_RULES)).first()[0] == state


def days(spark, values, start=D):
    rows = [("x", start + dt.timedelta(days=i), v) for i, v in values.items()]
    return spark.createDataFrame(rows, "metric string, date date, value double")


def test_trailing_baseline(spark):
    df = days(spark, {i: float(i) for i in range(7)} | {7: 1000.0, 40: 5.0, 41: None})
    got = {(r.date, r.window_days): r for r in baselines.trailing_baseline(df, ["metric"], [30, 60]).collect()}
    assert (D + dt.timedelta(days=6), 30) not in got  # six days before it
    r = got[D + dt.timedelta(days=7), 30]
    assert (r.median, r.mad, r.n_days) == (3.0, 2.0, 7)  # without the day itself
    assert (D + dt.timedelta(days=40), 30) not in got and got[D + dt.timedelta(days=40), 60].n_days == 8


def test_signals_both_ways(spark):
    df = days(spark, {i: float(i % 5) for i in range(20)})
    joined = signals.signals(df, baselines.trailing_baseline(df, ["metric"], [30]), ["metric"])
    beside = signals.judge(baselines.trailing_baseline(df, ["metric"], [30], keep_short=True))
    cols = ["date", "value", "median", "mad", "delta_pct", "state"]
    assert sorted(map(str, joined.select(*cols).collect())) == sorted(map(str, beside.select(*cols).collect()))
    assert joined.filter("state = 'insufficient'").count() == 7


def test_half_trend_and_periods(spark):
    r = baselines.half_trend(days(spark, {0: 100.0, 1: 100.0, 2: 104.0, 3: 104.0}), ["metric"]).first()
    assert (r.first_avg, r.second_avg, r.trend) == (100.0, 104.0, "rising")
    single = baselines.half_trend(days(spark, {0: 100.0}), ["metric"]).first()
    assert single.trend is None
    p = baselines.compare_periods(days(spark, {0: 50.0, 10: 100.0, 11: 120.0}), ["metric"], F.lit(D + dt.timedelta(days=11)), 5, 10).first()
    assert (p.current, p.previous, p.change_pct) == (120.0, 50.0, 140.0)


def test_midpoint_shift(spark):
    nights = [("d", D + dt.timedelta(days=i), 23.5 if i % 2 else 0.5) for i in range(5)] + [("d", D + dt.timedelta(days=5), 3.0), ("d", D + dt.timedelta(days=6), 0.1)]
    df = spark.createDataFrame(nights, "device_key string, date date, midpoint double")
    got = {r.date: (r.usual, r.shifted) for r in baselines.midpoint_shift(df, ["device_key"]).collect()}
    assert got[D + dt.timedelta(days=4)] == (None, False)  # four nights before it
    assert got[D + dt.timedelta(days=5)] == (0.5, True)


SLEEP = "device_key string, metric string, text_value string, value double, start_ts timestamp_ntz, end_ts timestamp_ntz"


@pytest.mark.parametrize("rows,hours", [([("asleep", 420.0)], 7.0), ([("asleep", 420.0), ("core", 200.0), ("deep", 100.0)], 5.0), ([("asleep", 420.0), (None, 6.5)], 7.0), ([("core", 60.0), (None, 6.5)], 6.5), ([("in_bed", 480.0), ("awake", 20.0)], None)])
def test_sleep_hours(spark, rows, hours):
    data = [("w", "sleep_analysis" if s else "sleep_duration", s, v, T, T) for s, v in rows]
    got = daily.sleep_hours(spark.createDataFrame(data, SLEEP), ingest.stage_of(F.col("text_value")), []).collect()
    assert [r.value for r in got] == ([hours] if hours else [])


def test_sleep_hours_of_unstaged_kind(spark):
    data = [("whoop_1", "sleep_analysis", "core", 300.0, T, T), ("whoop_1", "sleep_duration", None, 7.5, T, T)]
    got = daily.sleep_hours(spark.createDataFrame(data, SLEEP), ingest.stage_of(F.col("text_value")), []).first()
    assert got.value == 7.5


def test_arbitration_never_averages(spark):
    rows = [("m", D, "iphone_2", 10.0, 1), ("m", D, "apple_watch_ultra_1", 20.0, 1), ("m", D, "unknown", 99.0, 1), ("m", D + dt.timedelta(days=1), "iphone_2", 7.0, 1)]
    df = spark.createDataFrame(rows, "metric string, date date, device_key string, value double, n long")
    got = {r.date: r for r in daily.arbitrate(df, []).collect()}
    assert got[D].value == 20.0 and got[D].corroboration == {"iphone_2": 10.0} and got[D + dt.timedelta(days=1)].value == 7.0


def test_registry_resolution(spark):
    names = ["WHOOP MG 3", "Zepp Life 2", "Zepp Helio", "Anna’s Apple Watch", "iPhone 4", "Athlytic 9", "whoop", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(ingest.DEFAULT_REGISTRY.resolve(F.col("n"))).collect()]
    assert got == ["whoop", "zepp_life_scale", "zepp_helio", "apple_watch_ultra", "iphone", None, "other", "other"]


RAW = "batch_id string, sync_path string, uuid string, hk_type string, metric string, value string, text_value string, unit string, start string, end string, source_name string"


def test_normalize(spark):
    policy = spark.createDataFrame([("spo2", "HKO2", "%"), ("heart_rate", "HKHR", "count/min"), ("sleep_analysis", "HKSleep", "min")], "metric string, hk_type string, unit string")
    rows = [
        ("b", None, "u1", "HKO2", None, "0.97", None, None, "2026-07-01T23:36:00.700Z", None, "WHOOP 1"),
        ("b", None, "u2", "HKHR", None, "n/a", None, "bpm", "2026-07-01T08:00:00", "2026-07-01T08:01:00", "Zepp 1"),
        ("b", None, "u3", "HKSleep", None, "HKCategoryValueSleepAnalysisAsleepCore", None, None, "2026-07-01T01:00:00+05:30", "2026-07-01T02:30:00+05:30", "Zepp 1"),
        ("b", None, "u4", "HKNothing", None, "1", None, None, "2026-07-01T08:00:00Z", None, "Zepp 1"),
        ("b", None, "u5", "HKHR", None, "1", None, None, "no time", None, "Zepp 1"),
        ("b", None, "u6", "HKHR", None, "1", None, None, "2026-07-01T08:00:00Z", None, "Athlytic"),
    ]
    got = {r.hk_uuid: r for r in ingest.normalize(spark.createDataFrame(rows, RAW), policy, tz="Asia/Kolkata").collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert got["u1"].value == 97.0 and got["u1"].unit == "%" and got["u1"].start_ts == dt.datetime(2026, 7, 2, 5, 6) == got["u1"].end_ts
    assert got["u2"].value is None and got["u2"].text_value == "n/a" and got["u2"].start_ts == dt.datetime(2026, 7, 1, 8)
    assert got["u3"].text_value == "core" and got["u3"].value == 90.0
    again = ingest.normalize(spark.createDataFrame(rows * 2, RAW), policy)
    assert ingest.keep_first(again, "sample_id", ["hk_uuid"]).count() == 3  # redelivery adds nothing


def test_upsert_retract_guard(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, ver int")
    changed = spark.createDataFrame([(1, "A", 1), (2, "old", 4), (3, "c", 1)], "k int, v string, ver int")
    assert sorted((r.k, r.v) for r in ingest.upsert(stored, changed, ["k"], "ver").collect()) == [(1, "A"), (2, "b"), (3, "c")]
    gone = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r.k for r in ingest.retract(stored, gone, "k").collect()] == [2]
    with pytest.raises(ValueError):
        ingest.loss_guard(spark.range(100), spark.range(97))
    ingest.loss_guard(spark.range(100), spark.range(98))
    ingest.loss_guard(spark.range(0), spark.range(0))


def test_vendor_samples(spark):
    rows = [("sleep", '{"end":"2026-07-01T06:00:00Z","nap":true,"score":{"respiratory_rate":15}}'), ("sleep", '{"end":"2026-07-01T06:00:00Z","score":{"respiratory_rate":15.5,"stage_summary":{"total_light_sleep_time_milli":3600000,"total_slow_wave_sleep_time_milli":3600000,"total_rem_sleep_time_milli":1800000}}}'), ("cycle", '{"start":"2026-07-01T06:00:00Z","score":{"strain":12.5}}'), ("cycle", "broken"), ("recovery", None)]
    got = {r.metric: r.value for r in ingest.vendor_samples(spark.createDataFrame(rows, "kind string, payload string")).collect()}
    assert got == {"respiratory_rate": 15.5, "sleep_duration": 2.5, "strain": 12.5}


# statistics


def test_spearman_and_mann_whitney(spark):
    rows = [("g", float(x), float(y)) for x, y in zip([1, 2, 3, 4, 5, 6], [2, 1, 4, 3, 6, 5])] + [("c", 1.0, float(i)) for i in range(5)] + [("s", 1.0, 2.0)]
    got = {r.k: r for r in insights.spearman(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", 1).collect()}
    assert math.isclose(got["g"].rho, 0.8285714, rel_tol=1e-6) and 0 < got["g"].p < 0.1
    assert (got["c"].rho, got["c"].p, got["s"].rho, got["s"].p) == (0.0, 1.0, 0.0, 1.0)
    mw = [("g", v, g) for g, vs in ((1, [5.0, 6.0, 7.0, 8.0]), (0, [1.0, 2.0, 3.0, 4.0])) for v in vs] + [("e", 1.0, 1), ("t", 1.0, 1), ("t", 1.0, 0)]
    got = {r.k: r for r in insights.mann_whitney(spark.createDataFrame(mw, "k string, v double, g int"), ["k"], "v", "g").collect()}
    assert got["g"].u == 16.0 and math.isclose(got["g"].p, 0.0209, abs_tol=1e-3)
    assert (got["e"].u, got["e"].p, got["t"].p) == (0.0, 1.0, 1.0)


def test_false_discovery(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.01, 0.2, 0.5, 0.9])], "id int, p double")
    q = [round(r.q, 4) for r in insights.benjamini_hochberg(df, "p", ["id"], []).orderBy("id").collect()]
    assert q == [0.005, 0.025, 0.3333, 0.625, 0.9]


def test_lag_over_a_missing_day(spark):
    df = spark.createDataFrame([("s", "a", D, 1.0), ("s", "b", D + dt.timedelta(days=2), 2.0), ("s", "b", D + dt.timedelta(days=1), 3.0)], "subject string, metric string, date date, value double")
    assert [(r.x, r.y) for r in insights.lagged_pairs(df, ["subject"], [("a", "b")]).collect()] == [(1.0, 3.0)]


def test_exposure_groups(spark):
    events = spark.createDataFrame([("s", dt.datetime(2026, 7, 1, 20)), ("s", dt.datetime(2026, 7, 2, 9))], "subject string, ts timestamp_ntz")
    df = spark.createDataFrame([("s", D + dt.timedelta(days=i), float(i)) for i in (1, 2, 3)], "subject string, date date, value double")
    got = {r.value: r.exposed for r in insights.exposed_rows(df, insights.exposure_days(events, ["subject"], 15), ["subject"]).collect()}
    assert got == {1.0: 1, 3.0: 0}  # the day after an early dose is in neither group


def test_theil_sen(spark):
    assert insights.theil_sen(days(spark, {0: 1.0, 1: 2.0, 2: 3.0, 5: 100.0}), ["metric"]).first().slope_per_week > 0
    assert insights.theil_sen(days(spark, {0: 1.0, 7: 15.0}), ["metric"]).first().slope_per_week == 14.0


def test_slopes_beyond_what_is_sorted_at_once():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, at_once in ((40, 100), (61, 50), (200, 1000)):
        d, v = rng.integers(0, 50, n).astype(float), rng.normal(size=n).round(1)
        direct = [(v[j] - v[i]) / (d[j] - d[i]) for i in range(n) for j in range(n) if d[j] > d[i]]
        got, pairs = insights.median_slope(d, v, at_once)
        assert pairs == len(direct) and abs(got - np.median(direct)) < 1e-12
    assert insights.median_slope(np.array([1.0, 1.0]), np.array([1.0, 2.0])) == (0.0, 0)
    assert insights.median_slope(np.arange(60.0), np.arange(60.0) * 2, 50)[0] == 2.0


def test_pools_are_corrected_apart(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate((0.01, 0.02))] + [("b", 0, 0.03)], "s string, id int, p double")
    got = {(r.s, r.id): round(r.q, 6) for r in insights.benjamini_hochberg(df, "p", ["id"], ["s"]).collect()}
    assert got == {("a", 0): 0.02, ("a", 1): 0.02, ("b", 0): 0.03}


def test_no_cutoff_where_nothing_is_harmed(spark):
    scan = "s string, hour int, n1 long, n0 long, u double, p double, median_1 double, median_0 double"
    df = spark.createDataFrame([("a", 15, 9, 9, 0.0, 0.5, 50.0, 40.0), ("b", 15, 9, 9, 0.0, 0.2, 30.0, 40.0), ("b", 16, 9, 9, 0.0, 0.1, 30.001, 40.0), ("c", 15, 4, 9, 0.0, 0.1, 1.0, 40.0)], scan)
    assert [(r.s, r.hour, r.harm) for r in insights.best_cutoff(df, ["s"]).collect()] == [("b", 16, 10.0)]


def test_snooze_and_anchor(spark):
    policy = spark.createDataFrame([("steps", 24), ("glucose", 24), ("spo2", 24)], "metric string, cadence_hours int")
    seen = spark.createDataFrame([(m, "whoop_1", dt.datetime(2015, 1, 1)) for m in ("steps", "glucose", "spo2")], "metric string, device_key string, last_seen timestamp_ntz")
    off = spark.createDataFrame([("steps", dt.date(2015, 2, 5)), ("glucose", dt.date(2015, 2, 4)), ("spo2", None)], "metric string, snooze_until date")
    got = signals.stale_metrics(seen, policy, daily.rank_of(F.col("device_key")), [], "2015-02-05 12:00:00", snoozed=off)
    assert {r.metric for r in got.collect()} == {"glucose", "spo2"}
    rows = spark.createDataFrame([("a", dt.date(2015, 1, 1), 1.0), ("a", dt.date(2015, 1, 9), None)], "s string, date date, value double")
    assert [r.anchor for r in signals.anchors(rows, ["s"]).collect()] == [dt.date(2015, 1, 1)]


def test_choose_cards_against_loop(spark):
    import random

    rng = random.Random(1)
    rows = [("s", f"k{i}", rng.sample("abcdef", rng.choice([1, 2])), rng.choice([0.01, 0.02, 0.2]), rng.uniform(-1, 1)) for i in range(30)]
    got = [r.key for r in insights.choose_cards(spark.createDataFrame(rows, "subject string, key string, metrics array<string>, q double, effect double"), ["subject"]).orderBy("place").collect()]
    taken, used = [], set()
    for _, key, metrics, _, _ in sorted(rows, key=lambda r: (r[3], -abs(r[4]), r[1])):
        if len(taken) < 3 and not used & set(metrics):
            taken.append(key)
            used |= set(metrics)
    assert got == taken


@pytest.mark.parametrize("age,status", [(24.0, None), (24.1, "stale"), (48.0, "stale"), (48.1, "silent")])
def test_staleness(spark, age, status):
    now = dt.datetime(2026, 7, 10)
    seen = spark.createDataFrame([("m", "whoop_1", now - dt.timedelta(hours=age)), ("m", "iphone_1", now - dt.timedelta(hours=500))], "metric string, device_key string, last_seen timestamp_ntz")
    policy = spark.createDataFrame([("m", 12)], "metric string, cadence_hours int")
    got = signals.stale_metrics(seen, policy, daily.rank_of(F.col("device_key")), [], "2026-07-10 00:00:00").collect()
    assert [r.status for r in got] == ([status] if status else [])
    retired = signals.stale_metrics(seen, policy, daily.rank_of(F.col("device_key")), [], "2026-07-10 00:00:00", inactive=("whoop_1", "iphone_1"))
    assert retired.count() == 0


def test_cooldown_and_bursts(spark):
    at = [T + dt.timedelta(hours=h) for h in (0, 1, 5.9, 6, 11, 12.5)]
    got = signals.cooldown(spark.createDataFrame([("m", t) for t in at] + [("m", None)], "metric string, ts timestamp_ntz"), ["metric"], "ts")
    assert sorted(r.sent_at.hour for r in got.collect()) == sorted([8, 14, 20])
    rows = [(1, "a", T), (2, "a", T + dt.timedelta(seconds=119)), (3, "a", T + dt.timedelta(seconds=400)), (4, None, T), (5, None, T)]
    got = signals.dedupe_window(spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz"), ["k"], "ts", "id").collect()
    assert sorted(((r.k or ""), r.id, r.n_repeats) for r in got) == [("", 4, 2), ("a", 1, 2), ("a", 3, 1)]


def test_empty_tables(spark):
    none = days(spark, {})
    assert baselines.trailing_baseline(none, ["metric"], [30]).count() == 0
    assert baselines.half_trend(none, ["metric"]).count() == 0
    assert insights.theil_sen(none, ["metric"]).count() == 0
    assert insights.choose_cards(spark.createDataFrame([], "subject string, key string, metrics array<string>, q double, effect double"), ["subject"]).count() == 0


def test_qualifying_findings(spark):
    rows = [
        ("pair:hrv_rmssd:steps", "pair", ["hrv_rmssd", "steps"], 0.5, 0.2), ("pair:hrv_sdnn:steps", "pair", ["hrv_sdnn", "steps"], 0.9, 0.001), ("pair:hrv_sdnn:spo2", "pair", ["hrv_sdnn", "spo2"], -0.4, 0.05),
        ("pair:hrv_rmssd:spo2", "pair", ["hrv_rmssd", "spo2"], 0.29, 0.01), ("pair:spo2:hrv_sdnn", "pair", ["spo2", "hrv_sdnn"], -0.4, 0.06), ("trend:steps", "trend", ["steps"], 0.2, 0.01),
        ("weekend:steps", "weekend", ["steps"], 0.1, 0.24), ("event:steps", "event", ["steps"], 9.0, 0.25), ("lag:a:b", "lag", ["a", "b"], -0.3, 0.09),
    ]
    df = spark.createDataFrame([("s", *r) for r in rows], "subject string, key string, family string, metrics array<string>, effect double, q double")
    got = {r.key: r.band for r in insights.qualifying(df, ["subject"]).collect()}
    assert got == {"pair:hrv_rmssd:steps": "early", "pair:hrv_sdnn:spo2": "confirmed", "weekend:steps": "early", "lag:a:b": "confirmed"}
