"""The trigram index: the same as reading all texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import ngrams


@pytest.mark.parametrize("ids", [[], [0], [-1], [5, 6, 7], [-(2**62), -3, 0, 1, 300, 2**40, 2**62], [-(2**63), 2**63 - 1], list(range(0, 100_000, 7))])
def test_lists_come_back(ids):
    data = ngrams.packed(np.array(ids, np.int64))
    assert ngrams.unpacked(data).tolist() == ids
    assert len(ids) < 1000 or len(data) < 1.1 * len(ids)


def test_grams_that_every_match_has():
    assert ngrams.needles("%abc_def%") == {"abc", "def"} and ngrams.needles("a%b_c") == set() and {"10%", "0%_", "%_x"} == ngrams.needles("%10\\%\\_x%")
    assert ngrams.needles("%\u0130bc%") <= ngrams.grams_of("x\u0130bcd") and ngrams.needles("%ABC%") == {"abc"}


PATTERNS = ["%abc%", "abc%", "%abc", "%a_c%", "%abca%bcab%", "%ab%", "", "%", "%ABC%", "%\u00e9ab%", "%100\\%%", "%zzzz%", "%b\u0130c%"]


@pytest.mark.parametrize("block", [10, 50_000])
def test_same_as_reading_all(spark, tmp_path, block):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcABC\u00e9 \u0130%1\u4e2d0_") for _ in range(rng.randrange(60))) for _ in range(150)] + [None, "", "100%", "abc"]
    df = spark.createDataFrame([(i * 7 - 200, t) for i, t in enumerate(texts)] + [(1, "again abc"), (1, "again xyz")], "id long, text string").withColumn("gram", F.lit("x"))
    index = ngrams.build(df, "id", "text", f"file://{tmp_path}/index", block)
    for pattern in PATTERNS:
        for either in (True, False):
            want = df.where(F.col("text").ilike(pattern) if either else F.col("text").like(pattern))
            assert sorted(map(str, ngrams.like(index, pattern, either).collect())) == sorted(map(str, want.collect())), pattern


def test_a_search_reads_the_lists_it_needs(spark, tmp_path):
    df = spark.range(200).select("id", F.concat(F.lit("text number "), "id").alias("text"))
    index = ngrams.build(df, "id", "text", f"file://{tmp_path}/index", 50)
    assert sorted(r["id"] for r in ngrams.candidates(index, "%er 17%").collect()) == [17, *range(170, 180)]
    plan = index.lists.where((F.col("part") == 3) & F.col("gram").isin("abc"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram,abc)]" in plan


def test_no_row_for_each_gram_of_each_document(spark, tmp_path):
    df = spark.range(0, 200, 1, 1).select("id", F.concat(F.lit("text number "), "id").alias("text"))
    index = ngrams.build(df, "id", "text", f"file://{tmp_path}/index", 50)
    assert [r["n"] for r in index.lists.where("gram = 'tex'").collect()] == [50] * 4
    # what one task has made is whole: its lists need no other task's, so nothing is gathered by gram and document
    lists = list(ngrams._listed_rows([(i, "abcd") for i in range(7)], 3, 0, 1 << 30))
    assert [(r.num_rows, r["block"][0].as_py(), r["n"].to_pylist()) for r in lists] == [(2, 0, [3, 3]), (2, 1, [3, 3]), (2, 2, [1, 1])]
    assert len(list(ngrams._listed_rows([(i, "abcd") for i in range(7)], 100, 0, 4))) == 4
