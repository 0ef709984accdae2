"""Files of documents: where they are, and what is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.biblio import resolved_path


def located(files: DataFrame) -> DataFrame:
    """Adds path and, where there is none, error_class: storage that is not local is unsupported, no path is not found."""
    local = F.coalesce("storage_kind", F.lit("local")) == "local"
    path = resolved_path(F.coalesce("storage_kind", F.lit("local")), F.col("file_path"), F.col("storage_uri"))
    error = F.when(~local, F.lit("permanent_unsupported")).when(path.isNull(), F.lit("permanent_not_found"))
    return files.withColumns({"path": path, "error_class": error})


def contents(spark: SparkSession, *folders: str, pattern: str | None = None) -> DataFrame:
    """path (without a scheme, as files name it) and content of all files below some folders."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(list(folders)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
