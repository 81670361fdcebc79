"""Sources and sinks: batch JSON, health-export XML, staged CSV, text documents, paged payloads, partitioned parquet."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vitalframe.operators.ingest import BATCH

EXPORT = "_type string, _sourceName string, _unit string, _value string, _startDate string, _endDate string"
STAGED = "sample_id string, hk_uuid string, metric string, hk_type string, value double, text_value string, unit string, start_ts timestamp_ntz, end_ts timestamp_ntz, source_name string, device_key string, sync_path string"


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Batch files, one JSON object each or per line; unreadable ones give a row of nulls."""
    return spark.read.schema(BATCH).json(path)


def stream_batches(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream: the landing folder stands for the push endpoint, the checkpoint for the acknowledgement."""
    return spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_export(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of a health export as raw rows for `normalize`; dates are yyyy-MM-dd HH:mm:ss Z. The file is split by record."""
    rows = spark.read.format("xml").option("rowTag", "Record").schema(EXPORT).load(path)
    iso = lambda c: F.regexp_replace(c, r"^(\S+) (\S+) ([+-]\d{2})(\d{2})$", "$1T$2$3:$4")
    out = rows.select(F.col("_type").alias("hk_type"), F.col("_value").alias("value"), F.col("_unit").alias("unit"), iso("_startDate").alias("start"), iso("_endDate").alias("end"), F.col("_sourceName").alias("source_name"))
    return out.limit(limit) if limit else out


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    r"""Header-less CSV of store rows, \N for null."""
    return spark.read.schema(STAGED).option("nullValue", r"\N").csv(path)


def write_staged(rows: DataFrame, path: str) -> None:
    rows.select(*[c.split()[0] for c in STAGED.split(", ")]).write.mode("overwrite").option("nullValue", r"\N").csv(path)


def read_documents(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """(path, text, status) of the files of a folder: text files decoded, others as `extract` gives them.

    extract: bytes -> text or None, run in the executors (for PDF or OCR). Without it, or where it gives nothing, the status is
    `needs_ocr` and the text null.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    is_text = F.lower("path").rlike(r"\.(txt|md|csv)$")
    text = F.when(is_text, F.decode("content", "UTF-8"))
    if extract is None:
        return rows.select("path", text.alias("text"), F.when(is_text, "ok").otherwise("needs_ocr").alias("status"))
    read = F.udf(lambda content: extract(bytes(content)) if content is not None else None, "string")
    rows = rows.withColumn("text", text).withColumn("more", read(F.when(~is_text, F.col("content"))))
    return rows.select("path", F.coalesce("text", "more").alias("text"), F.when(is_text | F.col("more").isNotNull(), "ok").otherwise("needs_ocr").alias("status"))


def attach(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A read-only catalogue entry: a temporary view over parquet files. Views can't be written to."""
    rows = spark.read.parquet(path)
    rows.createOrReplaceTempView(name)
    return rows


def write_days(rows: DataFrame, path: str, day: str = "date") -> None:
    """Replaces the days that occur in `rows`, and only those: dynamic partition overwrite."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_store(rows: DataFrame, path: str) -> None:
    """Store layout: a folder per metric, sorted by start within files, so that metric and time filters prune."""
    rows.repartition("metric", F.to_date("start_ts")).sortWithinPartitions("start_ts").write.mode("overwrite").partitionBy("metric").parquet(path)


class PagedSource(DataSource):
    """Payload pages in a folder, one folder per kind: <path>/<kind>/<token>.json with records and an optional nextToken.

    Stands for a paged REST endpoint: each kind is read by following nextToken from `first`, until there is none, the page is missing
    or has no records (a short page isn't the end). path: any that Arrow's file systems read (file, hdfs, s3), which executors must share.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "kind string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.kinds = options.get("kinds", "recovery,sleep,cycle").split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.kinds]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        token = "first"
        while token:
            page = f"{root.rstrip('/')}/{partition.value}/{token}.json"
            if store.get_file_info(page).type == fs.FileType.NotFound:
                return
            with store.open_input_stream(page) as f:
                body = json.loads(f.read())
            if not body.get("records"):
                return
            for record in body["records"]:
                yield partition.value, json.dumps(record)
            token = body.get("nextToken")


def read_pages(spark: SparkSession, path: str, kinds: str = "recovery,sleep,cycle") -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("path", path).option("kinds", kinds).load()
