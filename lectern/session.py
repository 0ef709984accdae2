"""A session with the settings that the operators expect, and views of a folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("lectern")
    if master:
        builder = builder.master(master)
    # unions that keep their inputs' partitioning fail where adaptive execution has changed one of them
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.unionOutputPartitioning": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in {**base, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes of an Arrow batch that Spark hands to a Python function; a longer single row is a batch of its own.
BATCH_BYTES = 4 << 20


def arrow_ready(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches handed to Python, so that 10,000 long texts cannot fill a worker. A lower limit that the
    session already has stays; otherwise this one holds for all that the session runs from now on."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    arrow_ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Registers the named tables as temporary views; nothing is read but their footers."""
    for name in names:
        read(spark, folder, name).createOrReplaceTempView(name)


#: Bytes of a table below which it is dealt out anew for work that costs more than a shuffle.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: it may come in a single row group, which is one task. Larger ones stay as they are read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df
