"""Python functions hold a bounded part of a table at once."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import providers
from lectern.session import BATCH_BYTES, read


def test_models_get_few_texts_at_once(spark):
    class Counting:
        def embed(self, texts):
            return [[float(len(texts))] for _ in texts]

        def score(self, pairs):
            return [float(len(pairs)) for _ in pairs]

    df = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), "id")).alias("t"))
    got = df.select("t", providers.embed_column(Counting)(F.col("t")).alias("v"), providers.rerank_column(Counting)(F.lit("q"), F.col("t")).alias("s")).collect()
    assert len(got) == 3000 and all(len(r["v"]) == (r["t"] is not None) for r in got)
    assert max(r["s"] for r in got) <= providers.STEP and max(r["v"][0] for r in got if r["v"]) <= providers.STEP


def test_batches_are_bounded_in_bytes(spark, small):
    @F.pandas_udf("long")
    def sizes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([len(x)] * len(x))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    read(spark, small, "documents")
    assert int(spark.conf.get(key)) == BATCH_BYTES
    spark.conf.set(key, "1000")
    assert read(spark, small, "documents").select(sizes("text").alias("n")).agg(F.max("n")).first()[0] < 20
    spark.conf.unset(key)
