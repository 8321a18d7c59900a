"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the library's results rely on (UTC) or that suit its plans (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Rows of whole texts that a Python worker holds at a time.
ROWS = 256


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can read.

    Only a local session without that setting gets a folder of its own machine.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        context.setCheckpointDir(base)
    return f"{base}/plumbline-{uuid.uuid4().hex}"


def settled(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """frame written as Parquet below folder and read back, which cuts its lineage."""
    path = f"{folder}/{name}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def shuffled(frame: DataFrame) -> DataFrame:
    """frame, whose joins are shuffles: Spark takes a table for as small as its compressed files and would send millions of like rows through the driver."""
    return frame.hint("merge")


def spread(frame: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A table of a few megabytes, which often is one file with one row group, dealt to all cores; larger ones come in splits of their own."""
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism) if size <= most else frame


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to ROWS rows where the session has Spark's own default, which is for short rows; a caller's own setting stays.

    Spark knows no other place for this bound than the session, and what it sends at once is held twice, in the JVM and in the worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that settled() wrote and no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
