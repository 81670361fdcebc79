import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import reports, text
from vitalframe.sources import readers
from vitalframe.streaming import pipeline

LAB = """Report date 2026-06-18
HbA1c 5.4 % < 5.7
LDL Cholesterol 110 mg/dL 0 - 100
Total Cholesterol 190 mg/dL < 200
Vitamin D 31 ng/mL 30 - 100
TSH 2.1 mIU/L 0.4 to 4.0
TSH 2.1 mIU/L 0.4 to 4.0
Ferritin pending
nothing here 5
"""


def col(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_lab_rows(spark):
    df = spark.createDataFrame([(1, LAB, "x"), (2, None, "x"), (3, "", "x")], "doc_id int, text string, line string")
    got = {r.biomarker: r for r in text.lab_rows(df.select("doc_id", "text"), "doc_id", "text").collect()}
    assert set(got) == {"HbA1c", "LDL Cholesterol", "Total Cholesterol", "Vitamin D", "TSH"}
    assert (got["HbA1c"].value, got["HbA1c"].unit, got["HbA1c"].ref_low, got["HbA1c"].ref_high) == (5.4, "%", None, 5.7) and got["HbA1c"].confidence >= 0.8
    assert (got["LDL Cholesterol"].value, got["LDL Cholesterol"].ref_low, got["LDL Cholesterol"].ref_high) == (110.0, 0.0, 100.0)


@pytest.mark.parametrize("t,day", [(LAB, "2026-06-18"), ("on 18/06/2026", "2026-06-18"), ("31/02/2026 or 18-06-2026", "2026-06-18"), ("none", None), (None, None)])
def test_panel_date(spark, t, day):
    got = col(spark, t).select(text.panel_date(F.col("x"))).first()[0]
    assert (got and got.isoformat()) == day


@pytest.mark.parametrize("t,kind", [("double Espresso", "caffeine"), ("a glass of wine", "alcohol"), ("magnesium", "med"), ("sore calves", "symptom"), ("water", "water"), ("late lunch", "food"), ("steam room", "note"), ("", "note"), (None, "note")])
def test_log_kind(spark, t, kind):
    assert col(spark, t).select(text.log_kind(F.col("x"))).first()[0] == kind


@pytest.mark.parametrize("t,minutes", [("coffee at 4 PM", 79), ("at 16:00", 79), ("wine at 9pm", 1219), ("at 4:30", 49), ("at 25:00", None), ("13pm", None), ("no time", None), (None, None)])
def test_stated_time(spark, t, minutes):
    now = F.lit(dt.datetime(2026, 7, 1, 17, 19))
    assert col(spark, t).select(text.stated_minutes_ago(F.col("x"), now)).first()[0] == minutes


@pytest.mark.parametrize("t,bad", [("resting heart rate 57", []), ("it is 44", [44.0]), ("at 07:30 you had 2", []), ("57.0 and 57.00", []), ("1,234 steps", []), (None, [])])
def test_grounding(spark, t, bad):
    got = col(spark, t).select(text.ungrounded_numbers(F.col("x"), F.lit('{"rhr": 57, "steps": 1234}'))).first()[0]
    assert (got or []) == bad


def test_lab_flag_and_text(spark):
    r = spark.range(1).select(text.lab_flag(F.lit(150.0), F.lit(None).cast("double"), F.lit(100.0)).alias("f"), text.reference_text(F.lit(1.5), F.lit(2.0)).alias("t")).first()
    assert (r.f, r.t) == ("High", "1.5 to 2.0")


def test_read_only(spark):
    spark.range(900).createOrReplaceTempView("ro_numbers")
    assert reports.read_only(spark, "with x as (select * from ro_numbers) select * from x").count() == 500
    assert reports.read_only(spark, "select id, (select max(id) from ro_numbers) as m from ro_numbers where id in (select id from ro_numbers) limit 3").count() == 3
    refused = [
        "drop view ro_numbers", "create table t as select 1", "insert into t select 1", "set x = 1", "with x as (select 1 as a) insert into t select * from x",
        "from ro_numbers insert into t select id insert into u select id", "select reflect('java.lang.System', 'exit', 3)", "select * from (select Java_Method('java.util.UUID', 'randomUUID') as u) where u > (select try_reflect('a', 'b'))",
    ]
    for bad in refused:
        with pytest.raises(ValueError):
            reports.read_only(spark, bad)
    with pytest.raises(Exception):
        reports.read_only(spark, "with")


def test_renderers(spark):
    df = spark.createDataFrame([("<b>", None)], "a string, b int")
    assert "&lt;b&gt;" in reports.html_table(df) and reports.markdown_table(df).count("\n") == 3
    many = spark.range(30).select(F.col("id"), F.create_map(F.lit("k"), F.col("id")).alias("m")).repartition(5)
    short = reports.markdown_table(many, 3)
    assert "| 0 | {'k': 0} |\n| 1 |" in short and short.endswith("Only the first 3 rows are shown.\n") and "first 3 rows" in reports.html_table(many, 3)


def test_xml_csv_documents_pages(spark, tmp_path):
    xml = tmp_path / "export.xml"
    xml.write_text('<HealthData><Record type="HKHR" sourceName="Zepp" unit="bpm" value="61" startDate="2026-07-01 08:00:00 +0200" endDate="2026-07-01 08:01:00 +0200"/><Record type="HKHR" sourceName="Zepp" value="x"/></HealthData>')
    rows = readers.read_export(spark, str(xml)).collect()
    assert rows[0].start == "2026-07-01T08:00:00+02:00" and rows[0].value == "61" and rows[1].start is None
    assert readers.read_export(spark, str(xml), limit=1).count() == 1

    staged = spark.createDataFrame([("s", None, "m", None, 1.5, None, "kg", dt.datetime(2026, 7, 1), None, "src", "dev", None)], readers.STAGED)
    readers.write_staged(staged, str(tmp_path / "csv"))
    assert readers.read_staged(spark, str(tmp_path / "csv")).collect() == staged.collect()

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("HDL 40")
    (docs / "b.png").write_bytes(b"\x89PNG")
    assert {r.path[-5:]: (r.text, r.status) for r in readers.read_documents(spark, str(docs)).collect()} == {"a.txt": ("HDL 40", "ok"), "b.png": (None, "needs_ocr")}

    with_ocr = readers.read_documents(spark, str(docs), lambda content: "text of the picture" if content[:1] == b"\x89" else None)
    assert {(r.text, r.status) for r in with_ocr.collect()} == {("HDL 40", "ok"), ("text of the picture", "ok")}
    spark.range(3).write.parquet(str(tmp_path / "attached"))
    readers.attach(spark, str(tmp_path / "attached"), "attached")
    assert spark.sql("select count(*) from attached").first()[0] == 3

    pages = tmp_path / "pages" / "sleep"
    pages.mkdir(parents=True)
    (pages / "first.json").write_text(json.dumps({"records": [{"id": 1}, {"id": 2}], "nextToken": "t2"}))
    (pages / "t2.json").write_text(json.dumps({"records": [{"id": 3}], "nextToken": "t3"}))
    (pages / "t3.json").write_text(json.dumps({"records": [], "nextToken": "first"}))  # an empty page is the end
    got = readers.read_pages(spark, str(tmp_path / "pages"), "sleep,cycle").collect()
    assert [(r.kind, json.loads(r.payload)["id"]) for r in got] == [("sleep", 1), ("sleep", 2), ("sleep", 3)]


def test_write_days_replaces_only_touched(spark, tmp_path):
    path = str(tmp_path / "days")
    make = lambda rows: spark.createDataFrame(rows, "v int, date string")
    readers.write_days(make([(1, "2026-07-01"), (2, "2026-07-02")]), path)
    readers.write_days(make([(9, "2026-07-02")]), path)
    assert sorted((r.v, str(r.date)) for r in spark.read.parquet(path).collect()) == [(1, "2026-07-01"), (9, "2026-07-02")]


def test_batch_files_streamed_with_repeats(spark, tmp_path):
    landing, base = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    from vitalframe.operators import ingest

    policy = spark.createDataFrame([("heart_rate", "HKHR", "count/min")], "metric string, hk_type string, unit string")
    batch = lambda b, *vs: json.dumps({"batch_id": b, "samples": [{"uuid": f"u{v}", "hk_type": "HKHR", "value": str(v), "start": "2026-07-01T08:00:00Z", "source_name": "Zepp"} for v in vs], "deleted": []})
    (landing / "1.json").write_text(batch("b1", 60, 61) + "\n" + batch("b1", 60, 61))
    (landing / "2.json").write_text(batch("b1", 60, 61) + "\n" + batch("b2", 62))
    stream = readers.stream_batches(spark, str(landing), 1)
    rows = ingest.normalize(ingest.explode_batches(stream), policy).withColumn("row_id", F.xxhash64("hk_uuid", "batch_id"))
    once = rows.dropDuplicates(["row_id"])
    pipeline.run_available(once.writeStream.foreachBatch(pipeline.store_sink(f"{base}/seen", f"{base}/raw")), f"{base}/cp")
    assert sorted(r.value for r in spark.read.parquet(f"{base}/raw").collect()) == [60.0, 61.0, 62.0]


def test_escalation(spark, tmp_path):
    t = dt.datetime(2026, 7, 1, 0)
    rows = [("m", t + dt.timedelta(hours=h), ok) for h, ok in ((0, False), (1, False), (7, False), (25, False), (26, True), (27, False), (28, True))]
    src = str(tmp_path / "src")
    df = spark.createDataFrame(rows, "metric string, ts timestamp, ok boolean")
    df.coalesce(1).write.parquet(src)
    out = pipeline.escalation_stream(spark.readStream.schema(df.schema).parquet(src))
    pipeline.run_available(out.writeStream.format("parquet").option("path", str(tmp_path / "o")), str(tmp_path / "cp"))
    assert [r.stage for r in spark.read.parquet(str(tmp_path / "o")).orderBy("ts").collect()] == ["open", "reminder", "urgent", "recovered", "open"]


def test_recompute_span_and_slices():
    assert pipeline.recompute_span(None, 99, 30) is None
    assert pipeline.recompute_span(25, 20, 30) == 30
    assert pipeline.recompute_span(299, 5, 30) is None
    assert pipeline.recompute_span(300, 5, 30) == 2
    a = dt.date(2026, 1, 1)
    assert pipeline.slices(a, a) == []
    got = pipeline.slices(a, a + dt.timedelta(days=130))
    assert [(y - x).days for x, y in got] == [60, 60, 10] and got[0][0] == a and got[1][0] == got[0][1]


@pytest.mark.parametrize("proposed,t,kind", [("symptom", "double espresso", "caffeine"), ("food", "a sore neck", "food"), (None, "a sore neck", "symptom"), (None, None, "note")])
def test_guards(spark, proposed, t, kind):
    df = spark.createDataFrame([(proposed, t)], "p string, x string")
    assert df.select(text.guarded_kind(F.col("p"), F.col("x"))).first()[0] == kind
    r = spark.range(1).select(text.guarded_amount(F.lit("2 x 100 mg/d")).alias("a"), text.guarded_amount(F.lit(">&#x2013;90")).alias("b"), text.guarded_amount(F.lit(None).cast("string")).alias("c")).first()
    assert tuple(r) == ("2 x 100 mg/d", "", "")


@pytest.mark.parametrize("q,label", [(0.005, "strong"), (0.01, "likely"), (0.05, "probable"), (0.1, "early"), (None, None)])
def test_evidence(spark, q, label):
    from vitalframe.operators import insights

    assert col(spark, q, "double").select(insights.evidence(F.col("x"))).first()[0] == label


def test_day_windows_lose_no_rows(spark, tmp_path):
    """Rows weeks late, in the last part as in the first, and days still open count."""
    from vitalframe.plans import reports, series  # noqa: F401  reports registers its queries with series

    start = dt.datetime(2026, 1, 1)
    at = [0, 1, 2, 3, 60, 61, 62, 63, 2, 20, 64, 65, 66, 1, 40, 67]  # days, four rows a part
    rows = [(i, "steps" if i % 3 else "spo2", start + dt.timedelta(days=d, hours=i), 1.5 * i + 1) for i, d in enumerate(at)]
    spark.createDataFrame(rows, "row_id long, metric string, start_ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/samples.parquet")
    want = {}
    for _, metric, ts, value in rows:
        total, n = want.get((metric, str(ts.date())), (0.0, 0))
        want[metric, str(ts.date())] = (total + value, n + 1)
    got = series.QUERIES["o161_day_windows"](spark, str(tmp_path)).collect()
    assert {(r.metric, r.date): (r.total, r.n) for r in got} == want and len(got) == len(want)


def run_stream(spark, tmp_path, rows, kind, stream, schema):
    df = spark.createDataFrame(rows, kind)
    src, out = str(tmp_path / "checks"), str(tmp_path / "sent")
    df.coalesce(1).write.parquet(src)
    made = stream(spark.readStream.schema(df.schema).parquet(src))
    pipeline.run_available(made.writeStream.format("parquet").option("path", out), str(tmp_path / "cp"))
    return spark.read.schema(schema).parquet(out).collect()


def test_outages_within_the_cooldown_open_silently(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 7, 1) + dt.timedelta(hours=h)
    rows = [("m", at(0), False), ("m", at(0.5), True), ("m", at(1), False), ("m", at(7.5), False), ("m", at(8), True), ("m", at(11), False)]
    got = run_stream(spark, tmp_path, rows, "metric string, ts timestamp, ok boolean", pipeline.escalation_stream, "metric string, ts timestamp, stage string")
    assert sorted((r.ts, r.stage) for r in got) == [(at(0), "open"), (at(7.5), "reminder"), (at(8), "recovered"), (at(11), "open")]


def test_quiet_streams(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 7, 1) + dt.timedelta(hours=h)
    rows = [("m", at(1), at(0)), ("m", at(6), at(0)), ("m", at(20), None), ("m", at(31), at(0)), ("m", at(32), at(31.5)), ("m", at(40), at(31.5)), ("n", at(9), None)]
    got = run_stream(spark, tmp_path, rows, "metric string, ts timestamp, reading timestamp", pipeline.quiet_stream, "metric string, ts timestamp, since timestamp")
    assert sorted((r.metric, r.ts, r.since) for r in got) == [("m", at(6), at(0)), ("m", at(31), at(0)), ("m", at(40), at(31.5))]


def test_store_labs(spark):
    from vitalframe.operators import text

    kind = "date date, name string, value double, note string, v int"
    day = dt.date(2026, 7, 1)
    first = text.store_labs(None, spark.createDataFrame([(day, "HDL", 40.0, "a", 1), (day, "", 1.0, "b", 1), (day, "LDL", None, "c", 1), (None, "LDL", 1.0, "d", 1)], kind), "v")
    again = text.store_labs(first, spark.createDataFrame([(day, "HDL", 40.0, "later", 2), (day, "HDL", 41.0, "other", 2)], kind), "v")
    assert sorted((r.name, r.value, r.note) for r in again.collect()) == [("HDL", 40.0, "later"), ("HDL", 41.0, "other")]
