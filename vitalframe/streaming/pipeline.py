"""Structured Streaming: at-least-once input, exactly-once store, late data, keyed alert state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from vitalframe.operators.delivery import DeliveryStore, sample_keys
from vitalframe.sources.readers import write_days


def run_available(query_writer, checkpoint: str) -> StreamingQuery:
    """Starts a writer over what is there now and waits for its end."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dedupe_stream(rows: DataFrame, key: str, ts: str, late: str = "48 hours") -> DataFrame:
    """Drops copies that arrive within `late` of each other in event time; the store's dictionary settles the rest."""
    return rows.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", late).dropDuplicatesWithinWatermark([key]).drop("_event")


def day_windows(rows: DataFrame, by: list[str], ts: str, value: str, late: str = "48 hours") -> DataFrame:
    """(by..., date, total, n): tumbling days in event time; a day comes out when the watermark passes it."""
    df = rows.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", late)
    out = df.groupBy(F.window("_event", "1 day").alias("w"), *by).agg(F.sum(F.col(value).cast("decimal(24,4)")).cast("double").alias("total"), F.count(value).alias("n"))
    return out.select(*by, F.to_date("w.start").alias("date"), "total", "n")


def store_sink(store: str, raw: str, arrivals=sample_keys, no: str = "row_id"):
    """A foreachBatch function: admits each message once, over all batches ever, and writes it to <raw>/batch=<query>-<id>.

    arrivals: how rows become arrivals (see delivery.sample_keys). A batch is named by its streaming query, whose id lives in
    the checkpoint folder, and its number: one replayed after a failure, before or after its commit, gets the stored answer and
    writes the same rows to the same folder again; a stream with a new checkpoint folder goes on in the store.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        surplus = DeliveryStore(spark, store).admit(arrivals(batch), "no", "keys", "origin", batch=name).select(F.col("no").alias(no))
        batch.join(surplus, no, "left_anti").write.mode("overwrite").parquet(f"{raw}/batch={name}")

    return write


def _keep(batch: DataFrame, batch_id: int, raw: str, ts: str) -> None:
    """Adds a batch to the raw rows, laid out by day and batch; a batch that is replayed replaces its own part."""
    days = batch.withColumns({"date": F.to_date(ts), "batch": F.lit(batch_id)})
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(raw)


def _of_days(spark: SparkSession, raw: str, days: list, schema) -> DataFrame:
    """The raw rows of some days, with `date`; only the folders of those days are listed and read."""
    plain = [f for f in schema.fields if f.name not in ("date", "batch")]
    kinds = T.StructType([*plain, T.StructField("date", T.DateType()), T.StructField("batch", T.IntegerType())])
    if not days:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).option("basePath", raw).parquet(*[f"{raw}/date={d}" for d in days])


def recompute_sink(raw: str, derived: str, derive, ts: str = "start_ts"):
    """A foreachBatch function: recomputes the days a batch touches from all raw rows, however late its rows are. Its cost follows
    the touched days, not the history. Rows without a time are kept and derive nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _keep(batch, batch_id, raw, ts)
        days = [r[0] for r in batch.select(F.to_date(ts).alias("date")).filter("date is not null").distinct().collect()]  # calendar days
        write_days(derive(_of_days(batch.sparkSession, raw, days, batch.schema)), derived)

    return write


def late_sink(raw: str, corrected: str, derive, late: timedelta, ts: str = "start_ts"):
    """A foreachBatch function beside day_windows: keeps all rows, and recomputes from them the days of rows that come after
    the watermark, which the windows drop.

    The watermark is the latest event time of the earlier batches less `late`, of which each batch leaves its own in
    <raw>-newest. That of Spark is never ahead of it, so each dropped row's day is recomputed; a day recomputed without need has
    the same total.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _keep(batch, batch_id, raw, ts)
        batch.agg(F.max(ts).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{raw}-newest/batch={batch_id}")
        newest = spark.read.parquet(f"{raw}-newest").filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        if newest is None:
            return
        old = batch.select(F.to_date(ts).alias("date")).filter(F.date_add("date", 1) <= F.lit(newest - late)).distinct()
        days = [r[0] for r in old.collect()]  # calendar days
        write_days(derive(_of_days(spark, raw, days, batch.schema)), corrected)

    return write


def complete_days(emitted: DataFrame, corrected: DataFrame, raw: DataFrame, derive, ts: str = "start_ts") -> DataFrame:
    """All days of the stream so far: those recomputed for late rows, the other days the windows let out, and from the raw
    rows the days that are still open."""
    closed = emitted.join(F.broadcast(corrected.select("date").distinct()), "date", "left_anti").unionByName(corrected)
    # one row per calendar day at most
    still_open = raw.withColumn("date", F.to_date(ts)).join(F.broadcast(closed.select("date").distinct()), "date", "left_anti")
    return closed.unionByName(derive(still_open))


def recompute_span(waiting_s: float | None, quiet_s: float, full_days: int, quiet: float = 20.0, forced: float = 300.0, forced_days: int = 2) -> int | None:
    """How many days a debounced recomputation covers now, None for not yet.

    waiting_s: since the first pending batch, None without one; quiet_s: since the last. A quiet feed gets the full span
    of what is pending; one that never falls quiet gets a short span every `forced` seconds.
    """
    if waiting_s is None:
        return None
    if quiet_s >= quiet:
        return full_days
    return min(full_days, forced_days) if waiting_s >= forced else None


def slices(start: date, end: date, days: int = 60) -> list[tuple[date, date]]:
    """[start, end) cut into half-open pieces of at most `days`, for a re-read of history piece by piece."""
    out = []
    while start < end:
        stop = min(end, start + timedelta(days=days))
        out.append((start, stop))
        start = stop
    return out


class Cooldown(StatefulProcessor):
    """Passes the first alert of a key and then those at least `hours` after the one passed last."""

    def __init__(self, hours: float = 6.0):
        self.gap = pd.Timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sent timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        sent = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        times = sorted(t for part in rows for t in part["ts"])
        out = []
        for t in times:
            if sent is None or t - sent >= self.gap:
                sent = t
                out.append(t)
        if out:
            self.last.update((sent.to_pydatetime(),))
            yield pd.DataFrame({"metric": [key[0]] * len(out), "sent_at": out})

    def close(self) -> None:
        pass


class Escalation(StatefulProcessor):
    """Stages of an outage per key: open at the first failure, then at 6 and 24 hours; a success after stage 2 or more recovers.

    Input rows (ts, ok) in order; output (metric, ts, stage) with stage open, reminder, urgent, recovered. An outage that opens
    within `cooldown` hours of the notice sent last opens silently; its later stages are sent all the same.
    """

    def __init__(self, cooldown: float = 2.0):
        self.cooldown = pd.Timedelta(hours=cooldown)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "since timestamp, stage int, sent timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        since, stage, sent = self.state.get() if self.state.exists() else (None, 0, None)
        since, sent = (pd.Timestamp(x) if x is not None else None for x in (since, sent))
        out = []
        for t, ok in sorted((t, bool(ok)) for part in rows for t, ok in zip(part["ts"], part["ok"])):
            if ok:
                if stage >= 2:
                    out.append((t, "recovered"))
                since, stage = None, 0
                continue
            since = since if since is not None else t
            hours = (t - since).total_seconds() / 3600
            reached = 3 if hours >= 24 else 2 if hours >= 6 else 1
            if reached > stage:
                stage = reached
                if stage > 1 or sent is None or t - sent >= self.cooldown:
                    sent = t
                    out.append((t, ["open", "reminder", "urgent"][stage - 1]))
        self.state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in (since, stage, sent)))
        if out:
            yield pd.DataFrame({"metric": [key[0]] * len(out), "ts": [t for t, _ in out], "stage": [s for _, s in out]})

    def close(self) -> None:
        pass


class Quiet(StatefulProcessor):
    """Notices of a stream that has fallen quiet: a check (ts) at least `quiet` hours after the latest reading (reading) that was
    reported, at most one in `again` hours; a fresh reading ends the silence without a notice."""

    def __init__(self, quiet: float = 6.0, again: float = 24.0):
        self.quiet, self.again = pd.Timedelta(hours=quiet), pd.Timedelta(hours=again)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "reading timestamp, sent timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        latest, sent = (pd.Timestamp(x) if x is not None else None for x in (self.state.get() if self.state.exists() else (None, None)))
        checks = sorted(((t, r) for part in rows for t, r in zip(part["ts"], part["reading"])), key=lambda x: x[0])
        out = []
        for t, reading in checks:
            latest = latest if pd.isna(reading) else reading if latest is None else max(latest, reading)
            if latest is None or t - latest < self.quiet:
                sent = None
            elif sent is None or t - sent >= self.again:
                sent = t
                out.append((t, latest))
        self.state.update(tuple(x.to_pydatetime() if x is not None else None for x in (latest, sent)))
        if out:
            yield pd.DataFrame({"metric": [key[0]] * len(out), "ts": [t for t, _ in out], "since": [r for _, r in out]})

    def close(self) -> None:
        pass


def alert_stream(alerts: DataFrame, hours: float = 6.0) -> DataFrame:
    """Alerts (metric, ts) through Cooldown; state is kept per metric in the RocksDB state store."""
    return alerts.groupBy("metric").transformWithStateInPandas(Cooldown(hours), "metric string, sent_at timestamp", "append", "none")


def escalation_stream(checks: DataFrame) -> DataFrame:
    return checks.groupBy("metric").transformWithStateInPandas(Escalation(), "metric string, ts timestamp, stage string", "append", "none")


def quiet_stream(checks: DataFrame, quiet: float = 6.0, again: float = 24.0) -> DataFrame:
    """Checks (metric, ts, reading) through Quiet."""
    return checks.groupBy("metric").transformWithStateInPandas(Quiet(quiet, again), "metric string, ts timestamp, since timestamp", "append", "none")
