"""Session helpers: table access and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session; they needn't have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_vitalframe_sent", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="vitalframe-"), "vitalframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.join("vitalframe", os.path.relpath(os.path.join(folder, n), here)))
    context.addPyFile(archive)
    # stateful streaming workers take no files, only the path
    paths = [os.path.dirname(here), *filter(None, [context.environment.get("PYTHONPATH")])]
    context.environment["PYTHONPATH"] = os.pathsep.join(paths)
    context._vitalframe_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data folder `sf_dir`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set a temporary one is, on a
    local master (tests); on a cluster that is an error, since executors can't share it."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vitalframe-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def scratch(spark: SparkSession, label: str) -> str:
    """A new, empty folder in the shared folder, deleted when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder, which is deleted when the application ends."""
    spark = df.sparkSession
    ship(spark)
    shared_folder(spark)
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if not folder.isEmpty() and getattr(context, "_vitalframe_folder", None) != folder.get():
        path = context._jvm.org.apache.hadoop.fs.Path(folder.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        context._vitalframe_folder = folder.get()
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle partitions, `least` at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
