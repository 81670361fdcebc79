"""Composites over samples, daily values and logs: what a report or an API reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions.columns import exact_avg, exact_sum, median, upper_median

#: Kinds of devices whose stages describe a night, the first with usable stages counts.
STAGE_SOURCES = ["apple_watch_ultra", "zepp_helio", "whoop"]


#: Functions that call any Java method.
_REFLECTION = ("reflect", "java_method", "try_reflect")


def _nodes(node, jvm) -> Iterator:
    """All nodes of a parsed plan: operators, expressions and what is nested in either (sub-queries, common table expressions)."""
    kind = lambda name: jvm.java.lang.Class.forName(name)
    tree, product, iterable = kind("org.apache.spark.sql.catalyst.trees.TreeNode"), kind("scala.Product"), kind("scala.collection.Iterable")
    open_ = [node]
    while open_:
        x = open_.pop()
        if not hasattr(x, "getClass"):
            continue
        if tree.isInstance(x):
            yield x
        parts = x.iterator() if iterable.isInstance(x) else x.productIterator() if product.isInstance(x) else None
        while parts is not None and parts.hasNext():
            open_.append(parts.next())


def read_only(spark: SparkSession, text: str, limit: int = 500) -> DataFrame:
    """The rows of a query, the first `limit`. Anything but a query is refused by its parsed plan, not by its first word: every node
    is looked at, in sub-queries and common table expressions too, for commands, inserts and calls of Java methods."""
    jvm = spark._jvm
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    kinds = [jvm.java.lang.Class.forName(f"{logical}.{k}") for k in ("Command", "ParsedStatement")]
    for node in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), jvm):
        name = node.getClass().getSimpleName()
        if any(k.isInstance(node) for k in kinds) or "InsertInto" in name or "ExecuteImmediate" in name:
            raise ValueError("only queries are allowed")
        if name == "UnresolvedFunction" and node.nameParts().last().lower() in _REFLECTION:
            raise ValueError("calls of Java methods aren't allowed")
    return spark.sql(text).limit(limit)


def summary(daily: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, min, max, median, latest, latest_date): upper median and the last value."""
    v = daily.filter("value is not null")
    return v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), upper_median(F.collect_list("value")).alias("median"), F.max_by("value", "date").alias("latest"), F.max("date").alias("latest_date"))


def vitals(daily: DataFrame, by: list[str], anchor: Column, days: int = 30) -> DataFrame:
    """(by..., n, median, latest) over the `days` days that end on the anchor."""
    d = F.datediff(F.col("date"), anchor)
    return daily.filter("value is not null").filter((d > -days) & (d <= 0)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), median(F.col("value")).alias("median"), F.max_by("value", "date").alias("latest"))


def stage_nights(samples: DataFrame, stage: Column, by: list[str]) -> DataFrame:
    """(by..., device_key, date, deep, rem, core, asleep, awake, in_bed): minutes per night, null without a row of the stage."""
    rows = samples.filter("metric = 'sleep_analysis' and value is not null").withColumn("stage", stage)
    sums = [exact_sum(F.when(F.col("stage") == s, F.col("value"))).alias(s) for s in ("deep", "rem", "core", "asleep", "awake", "in_bed")]
    return rows.groupBy(*by, "device_key", F.to_date(F.coalesce("end_ts", "start_ts")).alias("date")).agg(*sums)


def stage_architecture(nights: DataFrame, by: list[str]) -> DataFrame:
    """(by..., nights, deep, rem, core): mean minutes over the nights that have the stage."""
    mean = [F.round(exact_avg(F.col(s)), 1).alias(s) for s in ("deep", "rem", "core")]
    return nights.filter("deep is not null or rem is not null or core is not null").groupBy(*by).agg(F.count_distinct("date").alias("nights"), *mean)


def sleep_report(hours: DataFrame, nights: DataFrame, by: list[str], kind: Column) -> DataFrame:
    """Arbitrated hours per night with the stages of the first source that has some: light is core, or asleep where unstaged.

    hours: by..., date, value; nights: see stage_nights; kind: the device kind of a night's row.
    """
    staged = F.col("core").isNotNull() | F.col("deep").isNotNull() | F.col("rem").isNotNull()
    order = F.array_position(F.array(*[F.lit(k) for k in STAGE_SOURCES]), kind)
    usable = nights.filter((order > 0) & (staged | F.col("asleep").isNotNull())).withColumn("_o", order)
    light = F.coalesce("core", F.lit(0.0)) + F.when(staged, 0.0).otherwise(F.coalesce("asleep", F.lit(0.0)))
    whole = lambda c: F.round(F.coalesce(c, F.lit(0.0))).cast("int")
    entry = F.struct("device_key", whole(F.col("deep")).alias("deep_min"), whole(F.col("rem")).alias("rem_min"), whole(light).alias("light_min"), whole(F.col("awake")).alias("awake_min"), F.col("in_bed"))
    best = usable.groupBy(*by, "date").agg(F.min_by(entry, F.struct("_o", "device_key")).alias("e"))
    out = hours.join(best, [*by, "date"], "left")
    efficiency = F.when(F.col("e.in_bed") > 0, F.round(F.col("value") * 60 / F.col("e.in_bed") * 100, 1))
    return out.select(*by, "date", F.col("value").alias("asleep_h"), F.col("e.device_key").alias("stage_source"), "e.deep_min", "e.rem_min", "e.light_min", "e.awake_min", efficiency.alias("efficiency_pct"))


def activity(daily: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by..., date, one column per metric): the series side by side."""
    columns = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return daily.filter(F.col("metric").isin(*metrics)).groupBy(*by, "date").agg(*columns)


def live_record(payloads: DataFrame, by: list[str], anchor: Column, kinds: list[str]) -> DataFrame:
    """(by..., one column per kind): of the anchor day and the day before; where both have a payload the older holds."""
    d = F.datediff(F.col("date"), anchor)
    return payloads.filter((d >= -1) & (d <= 0)).groupBy(*by).agg(*[F.min_by(F.when(F.col("kind") == k, F.col("payload")), F.when(F.col("kind") == k, F.col("date"))).alias(k) for k in kinds])


def weekly_review(signals: DataFrame, by: list[str], anchor: Column) -> DataFrame:
    """(by..., n, mean, n_flag, flagged): the seven days that end on the anchor, with the dates of flagged values."""
    d = F.datediff(F.col("date"), anchor)
    week = signals.filter((d > -7) & (d <= 0))
    flagged = F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == "flag", F.date_format("date", "yyyy-MM-dd")))), ",")
    return week.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(exact_avg(F.col("value")), 4).alias("mean"), F.count(F.when(F.col("state") == "flag", 1)).alias("n_flag"), flagged.alias("flagged"))


def _first(rows: DataFrame, limit: int) -> tuple[list, bool]:
    """The first `limit` rows in the order of all columns (those without an order are compared as text), and whether there are more."""
    order = [F.col(f"`{c}`") if rows.schema[c].dataType.simpleString().split("<")[0] not in ("map", "variant") else F.col(f"`{c}`").cast("string") for c in rows.columns]
    got = rows.orderBy(*order).limit(limit + 1).collect()
    return got[:limit], len(got) > limit


def markdown_table(rows: DataFrame, limit: int = 200) -> str:
    """A report's rows as a markdown table, ordered by their columns; at most `limit` rows are gathered, a last line says that there are more."""
    got, more = _first(rows, limit)
    head = "| " + " | ".join(rows.columns) + " |\n| " + " | ".join("---" for _ in rows.columns) + " |\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in got) + (f"\nOnly the first {limit} rows are shown.\n" if more else "")


def html_table(rows: DataFrame, limit: int = 200) -> str:
    """The same in HTML."""
    from html import escape

    got, more = _first(rows, limit)
    cell = lambda v, tag: f"<{tag}>{escape('' if v is None else str(v))}</{tag}>"
    body = "".join("<tr>" + "".join(cell(v, "td") for v in r) + "</tr>" for r in got)
    return f"<table><tr>{''.join(cell(c, 'th') for c in rows.columns)}</tr>{body}</table>" + (f"<p>Only the first {limit} rows are shown.</p>" if more else "")


def series_with_baselines(daily: DataFrame, baselines: DataFrame, by: list[str], days: int, anchor: DataFrame) -> DataFrame:
    """(by..., date, value, window_days, median, mad, n_days): the series of the `days` days that end on the anchor, each day with its
    stored baselines, one row for each window; days without one have nulls there.

    daily: one row per (by..., date); baselines: one per (by..., date, window_days); anchor: see signals.anchors.
    """
    by_anchor = [c for c in anchor.columns if c != "anchor"]
    recent = daily.filter("value is not null").join(anchor, by_anchor).filter(F.datediff("anchor", "date").between(0, days - 1)).drop("anchor")
    return recent.join(baselines.select(*by, "date", "window_days", "median", "mad", "n_days"), [*by, "date"], "left")
