"""The general problem operators against brute force and on edge cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalframe.operators import anomalies, changefeed, grid, intervals, trailing, units

T0 = dt.datetime(2015, 1, 5)
READ = "device_key string, start_ts timestamp_ntz, value double, slot int"


def stamp(h):
    return T0 + dt.timedelta(hours=h)


# 2 regular grid


def grid_rows(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], READ)
    return {(r.source, int(r.slot_start.timestamp()) // 3600): r for r in grid.regular_grid(df, "device_key", "start_ts", "value", **kw).collect()}


def test_grid_against_direct_regression(spark):
    rng = random.Random(1)
    rows = [("d", stamp(rng.random() * 40 if i < 60 else 60 + rng.random() * 10), 60 + rng.gauss(0, 5)) for i in range(90)]
    got = grid_rows(spark, rows)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600
    for (_, slot), r in got.items():
        t = np.array([(x[1] - T0).total_seconds() / 3600 for x in rows])
        y = np.array([x[2] for x in rows])
        v = t - (slot - base + 0.5)
        # the support is whole slots
        near = (np.floor(t) >= slot - base - 2) & (np.floor(t) <= slot - base + 2)
        v, y = v[near], y[near]
        w = 1 - (v / 2.5) ** 2
        support = w.sum() ** 2 / (w**2).sum() if len(w) else 0
        assert math.isclose(r.support, support, rel_tol=1e-6, abs_tol=1e-9)
        if r.n_readings == 0 and support < 3:
            assert r.estimate is None and r.mark == "missing"
        else:
            x = np.stack([np.ones_like(v), v], 1)
            fit = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]
            assert math.isclose(r.estimate, fit, rel_tol=1e-5)


def test_grid_gaps_and_edges(spark):
    got = grid_rows(spark, [("a", stamp(0.5), 1.0), ("a", stamp(3.2), 2.0), ("a", stamp(3.2 + 24 * 7), 3.0), ("a", stamp(3.3 + 24 * 14), 4.0), (None, stamp(1), 5.0), ("b", None, 1.0), ("b", stamp(1), None), ("b", stamp(2), float("nan"))])
    marks = [r.mark for (s, _), r in sorted(got.items()) if s == "a"]
    assert len(got) == 4 + 24 * 7 + 1  # exactly seven days go on, six minutes more end the series
    assert marks.count("observed") == 4
    assert {s for s, _ in got} == {"a"}
    assert grid_rows(spark, []) == {}
    one = grid_rows(spark, [("a", stamp(1), 7.0), ("a", stamp(1), 7.0)])
    assert [(r.n_readings, r.estimate) for r in one.values()] == [(2, 7.0)]


# 3 trailing totals

DAILY = "device_key string, metric string, date date, value double, computed_at timestamp_ntz"


def test_trailing_against_brute_force(spark):
    rng = random.Random(2)
    day = lambda i: dt.date(2015, 1, 1) + dt.timedelta(days=i)
    rows = [(f"d{rng.randrange(3)}", "steps", day(rng.randrange(400)), rng.choice([None, float(rng.randrange(100))]), T0 + dt.timedelta(hours=rng.randrange(9))) for _ in range(700)]
    df = spark.createDataFrame(rows, DAILY)
    current = trailing.current_versions(df)
    held = {(r.device_key, r.date): r.value for r in current.collect()}
    asked = spark.createDataFrame([(f"d{i % 4}", "steps", day(i), w, "x") for i in range(0, 420, 13) for w in (1, 7, 30, 90)], "device_key string, metric string, date date, window_days int, bucket string")
    got = trailing.trailing_totals(current, asked, tile_days=100, band_days=45).collect()
    assert len(got) == asked.count()
    for r in got:
        values = [held.get((r.device_key, r.date - dt.timedelta(days=k))) for k in range(1, r.window_days + 1)]
        values = [v for v in values if v is not None]
        assert math.isclose(r.r_total, sum(values), abs_tol=1e-9) and r.r_days == len(values) and math.isclose(r.r_mean, sum(values) / r.window_days, abs_tol=1e-9)


def test_trailing_edges(spark):
    empty = spark.createDataFrame([], DAILY)
    asked = spark.createDataFrame([("d", "m", dt.date(2015, 1, 9), 7), (None, "m", dt.date(2015, 1, 9), 7), ("d", "m", None, 7), ("d", "m", dt.date(2015, 1, 9), 0)], "device_key string, metric string, date date, window_days int")
    got = trailing.trailing_totals(trailing.current_versions(empty), asked).collect()
    assert [(r.r_total, r.r_mean, r.r_days) for r in got] == [(0.0, 0.0, 0)]
    assert trailing.trailing_totals(trailing.current_versions(empty), asked.limit(0)).count() == 0


def test_trailing_of_a_huge_window_and_many_entities(spark):
    """One dirty row asks for 100,000 days; 3,000 entities fall into one block."""
    n = 3000
    daily = spark.range(n * 3).selectExpr("concat('d', id % 3000) as device_key", "'m' as metric", "date_add(date'2015-01-01', cast(id div 3000 as int) * 400) as date", "cast(id as double) as value")
    asked = spark.range(n).selectExpr("concat('d', id) as device_key", "'m' as metric", "date'2017-06-01' as date", "if(id = 7, 100000, if(id % 2 = 0, 10, 800)) as window_days", "id as x")
    got = {r.x: (r.r_total, r.r_days) for r in trailing.trailing_totals(daily, asked).collect()}
    assert len(got) == n and got[7] == (7.0 + 3007 + 6007, 3) and got[8] == (0.0, 0) and got[9] == (3009.0 + 6009, 2)


def test_current_version(spark):
    d = dt.date(2015, 1, 5)
    rows = [("d", "m", d, 1.0, T0), ("d", "m", d, None, T0 + dt.timedelta(hours=1)), ("e", "m", d, None, T0), ("e", "m", d, 4.0, T0), ("f", "m", d, 2.0, None)]
    got = {r.device_key: r.value for r in trailing.current_versions(spark.createDataFrame(rows, DAILY)).collect()}
    assert got == {"d": None, "e": 4.0, "f": 2.0}


# 4 units

SAMPLE = "row_id long, metric string, hk_type string, value double, text_value string, unit string, target string"
POLICY = [("body_mass", "HKBodyMass", "kg"), ("spo2", "HKO2", "%"), ("glucose", None, "mg/dL"), ("wrist_temp", None, "degC"), ("active_energy", None, "kcal"), ("sleep_duration", None, "h")]


@pytest.mark.parametrize(
    "metric,value,text,unit,common,changed",
    [
        ("body_mass", 80.0, None, "kg", 80.0, False),
        ("body_mass", 80.0, None, "KG ", 80.0, False),
        ("body_mass", 80.0, None, None, 80.0, False),
        ("body_mass", 176.4, None, "lb.", 80.01369, True),
        ("body_mass", 80000.0, None, "grams", 80.0, True),
        ("body_mass", 12.6, None, "stone", 80.01369, True),
        ("body_mass", None, "10 st 6.2 lb", "", 66.3153, True),
        ("body_mass", None, "about 80,5 kg", None, 80.5, True),
        ("body_mass", None, "not measured", "kg", None, False),
        ("body_mass", None, None, "kg", None, False),
        ("body_mass", 5.0, None, "furlong", None, False),
        ("spo2", 0.97, None, None, 97.0, True),
        ("spo2", 0.97, None, "%", 97.0, True),
        ("spo2", 97.0, None, "pct", 97.0, False),
        ("spo2", None, "0,9670 fraction", None, 96.7, True),
        ("glucose", 5.5, None, "mmol<180.156>/L", 99.0858, True),
        ("glucose", 100.0, None, "MG/DL", 100.0, False),
        ("glucose", None, "reading: 0.747 g/L", None, 74.7, True),
        ("wrist_temp", 91.9, None, "°F", 33.2778, True),
        ("wrist_temp", 307.15, None, "kelvin", 34.0, True),
        ("wrist_temp", None, "36,1Cel", "", 36.1, True),
        ("active_energy", 500.0, None, "Cal", 500.0, False),
        ("active_energy", 500000.0, None, "cal", 500.0, True),
        ("active_energy", 418.4, None, "kilojoules", 100.0, True),
        ("sleep_duration", None, "7 h 54 min", "", 7.9, True),
        ("sleep_duration", None, "7h06", None, 7.1, True),
        ("sleep_duration", None, "366 min", None, 6.1, True),
        ("sleep_duration", 22320.0, None, "sec", 6.2, True),
        ("unknown_metric", 5.0, None, "kg", None, False),
        (None, 176.4, None, "lb", 80.01369, True),
    ],
)
def test_units(spark, metric, value, text, unit, common, changed):
    policy = spark.createDataFrame(POLICY, "metric string, hk_type string, unit string")
    row = spark.createDataFrame([(1, metric, "HKBodyMass" if metric is None else None, value, text, unit, "clash")], SAMPLE)
    got = units.to_common_units(row, policy).collect()
    assert len(got) == 1
    assert got[0].changed is changed or bool(got[0].changed) == changed
    assert (got[0].common_value is None) if common is None else math.isclose(got[0].common_value, common, rel_tol=1e-5)
    assert got[0].target == "clash"


def test_unit_graph_cycles():
    units.UnitGraph()
    with pytest.raises(ValueError):
        units.UnitGraph([("a", "b", 2.0, 0.0), ("b", "c", 2.0, 0.0), ("a", "c", 5.0, 0.0)])
    assert units.UnitGraph([("a", "b", 2.0, 1.0)]).convert("b", "a") == (0.5, -0.5)
    assert units.UnitGraph([("a", "b", 2.0, 1.0)]).convert("a", "z") is None


# 5 anomalies


def series(rng, n, step_s, level=60.0, sd=2.0):
    t, out = 0.0, []
    for _ in range(n):
        t += step_s * rng.uniform(0.7, 1.3)
        out.append([t, round(level + rng.gauss(0, sd), 1)])
    return out


def flags(spark, points, metric="heart_rate"):
    rows = [(i, "d", metric, T0 + dt.timedelta(seconds=s), v, "x") for i, (s, v) in enumerate(points)]
    df = spark.createDataFrame(rows, "row_id long, device_key string, metric string, start_ts timestamp_ntz, value double, tile string")
    return {r.row_id: r for r in anomalies.flag_readings(df).collect()}


def test_spikes_effort_and_stuck(spark):
    rng = random.Random(5)
    pts = series(rng, 6000, 150)
    pts[100][1], pts[200][1], pts[201][1] = 255.0 + 256, 120.0, 122.0
    pts[300][1] = 28.0
    for k in range(24):  # effort: a rise and fall over an hour
        pts[1000 + k][1] += 45 * math.sin(math.pi * (k + 0.5) / 24)
    for k in range(15):
        pts[2000 + k][1] = 61.3
    for k in range(4):
        pts[2500 + k][1] = 60.2
    pts[4096][1] = 130.0  # at a tile's edge
    got = flags(spark, pts)
    assert len(got) == len(pts)
    bad = {i for i, r in got.items() if r.impossible or r.spike or r.stuck}
    assert bad == {100, 200, 201, 300, 4096} | set(range(2000, 2015))
    assert got[100].impossible and got[200].spike and got[2000].stuck


def test_anomalies_edges(spark):
    assert flags(spark, []) == {}
    assert [r.stuck or r.spike or r.impossible for r in flags(spark, [[0, 60.0]]).values()] == [False]
    got = flags(spark, [[0, None], [1, float("nan")], [2, 0.0], [2, 60.0]])
    assert {i: r.impossible for i, r in got.items()} == {2: True, 3: False}
    assert flags(spark, [[0, 60.0]], metric="steps") == {}


# 6 change feed

BATCH = "batch_id string, delivery_no long, sent_at string, received_at timestamp_ntz, samples array<struct<uuid:string,hk_type:string,metric:string,value:string,text_value:string,unit:string,start_ts:string,end_ts:string,source_name:string>>, deleted array<string>"
U1, U2 = "AAAAAAAA-0000-0000-0000-000000000001", "bbbbbbbb-0000-0000-0000-000000000002"


def up(u, **kw):
    return tuple(kw.get(f, u if f == "uuid" else None) for f in ("uuid", *changefeed.FIELDS))


def state(spark, batches):
    df = spark.createDataFrame([(b, i, at, T0, s, d) for i, (b, at, s, d) in enumerate(batches)], BATCH)
    return {r.hk_uuid: r for r in changefeed.current_state(df).collect()}


def test_change_feed(spark):
    got = state(
        spark,
        [
            ("b3", "2015-01-05T03:00:00Z", [up(U1.lower(), value="3")], []),
            ("b1", "2015-01-05T06:30:00+05:30", [up(U1, value="1", unit="kg"), up(U2, value="9"), up(None), up("")], None),
            ("b2", "2015-01-05T02:00:00.000Z", [], [U2.upper(), "", None]),
            ("b1", "2015-01-05T01:00:00Z", [up(U1, value="1", unit="kg"), up(U2, value="9")], []),  # redelivered late
        ],
    )
    assert set(got) == {U1.lower()}
    assert (got[U1.lower()].batch_id, got[U1.lower()].value, got[U1.lower()].unit) == ("b3", "3", "kg")  # a null leaves the column


def test_deletes_follow_samples_and_revival(spark):
    assert state(spark, [("b1", "2015-01-05T01:00:00Z", [up(U1)], [U1])]) == {}
    got = state(spark, [("b1", "2015-01-05T01:00:00Z", [up(U1, unit="kg")], [U1]), ("b2", "2015-01-05T02:00:00Z", [up(U1, value="2")], []), ("b0", "2015-01-05T00:30:00Z", None, [U1])])
    assert got[U1.lower()].batch_id == "b2" and got[U1.lower()].unit is None  # nothing survives the delete
    assert state(spark, []) == {}


def test_change_feed_hot_key_against_brute_force(spark):
    rng = random.Random(8)
    ids = [f"{i:08x}-0000-0000-0000-000000000000" for i in range(1, 12)]
    batches, seen = [], []
    for i in range(120):
        pick = lambda: ids[0] if rng.random() < 0.4 else rng.choice(ids)
        b = (f"b{i:03d}", (T0 + dt.timedelta(minutes=rng.randrange(10**6))).strftime("%Y-%m-%dT%H:%M:%SZ"), [up(pick(), value=str(i)) for _ in range(3)], [pick() for _ in range(rng.randrange(2))])
        batches += [b] * rng.choice([1, 1, 2])
        seen.append(b)
    alive = {}
    for b, _, s, d in sorted(seen, key=lambda x: (x[1], x[0])):
        for x in s:
            alive[x[0]] = b
        for u in d:
            alive.pop(u, None)
    rng.shuffle(batches)
    assert {u: r.batch_id for u, r in state(spark, batches).items()} == alive


# 7 intervals


def merged(spark, rows):
    df = spark.createDataFrame([(d, None if a is None else stamp(a), None if b is None else stamp(b), 1) for d, a, b in rows], "device_key string, start_ts timestamp_ntz, end_ts timestamp_ntz, day int")
    p = intervals.periods(df, "device_key", "start_ts", "end_ts")
    hours = lambda r: (r.entity, (r.from_ts - T0).total_seconds() / 3600, (r.to_ts - T0).total_seconds() / 3600)
    return sorted(map(hours, p.collect())), sorted(map(hours, intervals.gaps(p, 12 * 3600).collect()))


def test_intervals(spark):
    p, g = merged(spark, [("a", 1, 3), ("a", 2, 2.5), ("a", 3, 4), ("a", 23, 26), ("a", 25, 30), ("a", 42, 43), ("a", 1, 3), ("b", 5, 5), ("b", 6, 4), ("b", None, 3), ("b", 1, None), (None, 1, 2)])
    assert p == [("a", 1, 4), ("a", 23, 30), ("a", 42, 43)]
    assert g == [("a", 30, 42)]  # twelve hours exactly; nineteen are too long
    assert merged(spark, []) == ([], [])


def test_intervals_against_sweep(spark):
    rng = random.Random(4)
    rows = [("abc"[rng.randrange(3)] if rng.random() < 0.6 else "a", s, s + rng.randrange(1, 40) / 4) for s in [rng.randrange(2000) / 2 for _ in range(300)]]
    want = []
    for e in "abc":
        out = []
        for s, t in sorted((s, t) for d, s, t in rows if d == e):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], t)
            else:
                out.append([s, t])
        want += [(e, s, t) for s, t in out]
    assert merged(spark, rows)[0] == sorted(want)


def test_sleep_stages(spark):
    rows = [("sleep_analysis", t) for t in ("core", None, "", "InBed", "in_bed", "awake", "HKCategoryValueSleepAnalysisAwake", "HKCategoryValueSleepAnalysisInBed", "HKCategoryValueSleepAnalysisAsleepREM")] + [("steps", "core")]
    got = intervals.sleep_intervals(spark.createDataFrame(rows, "metric string, text_value string"))
    assert got.count() == 4
    assert got.filter(F.col("text_value").isNull()).count() == 1


def test_stuck_across_tiles_of_uneven_density(spark):
    """Dense readings, then one a day: a stuck stretch of eight days lies across a tile edge."""
    dense = [[i * 60, 60.0 + i * 37 % 23] for i in range(5 * anomalies.TILE_ROWS - 50)]
    sparse = [[1_300_000 + d * 86400, 60.0 + d * 37 % 23] for d in range(100)]
    for d in range(46, 54):
        sparse[d][1] = 70.5
    got = flags(spark, dense + sparse)
    assert {i for i, r in got.items() if r.stuck} == {len(dense) + d for d in range(46, 54)}


def test_flags_do_not_depend_on_the_tiles(spark):
    rng = random.Random(7)
    pts = series(rng, 3000, 200)
    for i in rng.sample(range(3000), 40):
        pts[i][1] += rng.choice([-35, 60])
    for i in (395, 1999):
        for k in range(14):
            pts[i + k][1] = 63.1
    pts.append([pts[-1][0] + 10**9, 60.0])  # one stray time
    rows = [(i, "d", "heart_rate", T0 + dt.timedelta(seconds=s), v) for i, (s, v) in enumerate(pts)]
    df = spark.createDataFrame(rows, "row_id long, device_key string, metric string, start_ts timestamp_ntz, value double")
    got = [{r.row_id: (r.impossible, r.spike, r.stuck) for r in anomalies.flag_readings(df, n).collect()} for n in (400, 10_000)]
    assert got[0] == got[1] and len(got[0]) == len(pts)
    assert {i for i, r in got[0].items() if r[2]} >= {395 + k for k in range(14)} | {1999 + k for k in range(14)}


def test_a_source_with_long_normal_runs_is_not_stuck(spark):
    """Each value twelve times, as is this source's habit, and one stretch of ninety."""
    pts = [[i * 300, 60.0 + (i // 12 * 7) % 19] for i in range(4800)]
    for k in range(90):
        pts[2400 + k][1] = 71.7
    bad = {i for i, r in flags(spark, pts).items() if r.stuck or r.spike or r.impossible}
    assert bad == {2400 + k for k in range(90)}


@pytest.mark.parametrize("p,limit", [(0.02, 7), (0.1, 7), (0.4, 15), (0.5, 19)])
def test_stuck_limit_follows_the_source(p, limit):
    from collections import Counter

    normal = Counter({k: round(3000 * (1 - p) * p ** (k - 1)) for k in range(1, 15)})
    got = anomalies.stuck_limit(normal + Counter({40: 4}), 4096)
    assert limit <= got <= limit + 1
    assert anomalies.stuck_limit(Counter({1: 500, 9: 400, 40: 2}), 4096) > 9  # runs of nine are this source's normal
