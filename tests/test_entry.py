"""Every query against its SQL on the smallest test tables; queries without SQL must run."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(r.state for r in df.select("state").collect()) - {"insufficient"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - {n for n in entry.queries() if n.startswith(("p8", "p9", "p10"))}))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in entry.oracle_sql():
        return
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_flagship_keeps_wearers_apart(spark):
    rows = entry.entry(spark).collect()
    number = lambda key: int(key.rsplit("_", 1)[1]) if key[-1].isdigit() else 0
    assert len({r.subject for r in rows}) > 1 and all(r.subject == number(r.device_key) // 4 for r in rows)


def test_findings_of_devices_with_like_numbers(spark, tmp_path):
    """Device numbers 1 and 9 and 41: their series aren't summed."""
    import datetime as dt

    rows = [(f"whoop_{k}", m, dt.date(2015, 3, 1) + dt.timedelta(days=i), float(i % 7 * sign + 9), dt.datetime(2015, 4, 1)) for k, sign in ((1, 1), (9, -1), (41, 1)) for m in ("steps", "active_energy") for i in range(60)]
    spark.createDataFrame(rows, "device_key string, metric string, date date, value double, computed_at timestamp_ntz").write.parquet(f"{tmp_path}/daily_values.parquet")
    spark.createDataFrame([], "device_key string, metric string, unit string, start_ts timestamp_ntz").write.parquet(f"{tmp_path}/samples.parquet")
    got = entry.queries()["o110_findings"](spark, str(tmp_path)).collect()
    assert {r.device_key for r in got if r.key == "pair:active_energy:steps"} == {"whoop_1", "whoop_9", "whoop_41"}


def test_findings_of_all_families(spark, tmp_path):
    """A device for each family; trend and event findings come out, and no test of a forbidden pair."""
    import datetime as dt

    from vitalframe.plans import series

    first, noise = dt.date(2015, 1, 15), lambda i: float(i * 7919 % 101)
    value = {
        "whoop_1": {"steps": lambda i: 100.0 + noise(i), "active_energy": lambda i: 50.0 + noise(i)},
        "whoop_2": {"steps": lambda i: 100.0 + i},
        "whoop_3": {"steps": lambda i: 200.0 + noise(i) - (150 if i % 5 == 1 else 0)},
        "whoop_4": {"steps": lambda i: 100.0 + noise(i) + (200 if (first + dt.timedelta(days=i)).weekday() >= 5 else 0)},
        "whoop_5": {"hrv_rmssd": lambda i: 50.0 + noise(i), "hrv_sdnn": lambda i: 40.0 + noise(i)},
        "whoop_6": {"steps": lambda i: 100.0 + noise(i), "active_energy": lambda i: 100.0 + noise(i - 1)},
    }
    rows = [(d, m, first + dt.timedelta(days=i), f(i), dt.datetime(2015, 4, 1)) for d, ms in value.items() for m, f in ms.items() for i in range(60)]
    spark.createDataFrame(rows, "device_key string, metric string, date date, value double, computed_at timestamp_ntz").write.parquet(f"{tmp_path}/daily_values.parquet")
    taken = [("glucose_meter_3", "glucose", None, dt.datetime(2015, 1, 15, 18) + dt.timedelta(days=i)) for i in range(0, 60, 5)]
    spark.createDataFrame(taken, "device_key string, metric string, unit string, start_ts timestamp_ntz").write.parquet(f"{tmp_path}/samples.parquet")
    pool = {(r.device_key, r.key) for r in series.tests_of(spark, str(tmp_path)).collect()}
    assert ("whoop_2", "trend:steps") in pool and ("whoop_3", "event:steps") in pool and not any(k.startswith("pair:hrv") for _, k in pool)
    got = {(r.device_key, r.key) for r in entry.queries()["o110_findings"](spark, str(tmp_path)).collect()}
    assert got >= {("whoop_1", "pair:active_energy:steps"), ("whoop_2", "trend:steps"), ("whoop_3", "event:steps"), ("whoop_4", "weekend:steps"), ("whoop_6", "lag:steps:active_energy")}
