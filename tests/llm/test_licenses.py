"""Whole licenses as templates."""

import random

import duckdb
import pytest

from lectern.llm import licenses

FIRST = len(licenses.BASE) + len(licenses.NOTICES)


def whole(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = licenses.passages(licenses.votes(docs)).where(f"accepted AND template >= {FIRST}").collect()
    return docs, {r["doc_id"]: (r["label"], r["start"], r["stop"], r["coverage"]) for r in spans}


def edited(words, edits, seed):
    rng = random.Random(seed)
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(10, len(words) - 10)] = "changed"
    return words


@pytest.mark.parametrize("label", sorted(licenses.WHOLE))
def test_whole_licenses_with_and_without_changes(spark, label):
    text = licenses.WHOLE[label]
    words = licenses.template_of(text).split()
    some = [f"Copyright (c) 2020 Somebody\n{text}\nand code", " ".join(edited(words, 2, 1)), " ".join(words[: len(words) // 2]), " ".join(words[::-1]), "of the software and of the use in the software " * 200]
    docs, got = whole(spark, some)
    assert got[0] == (label, 4, 4 + len(words), 1.0)
    assert 0.75 <= got[1][3] < 1 and got[1][0] == label and set(got) == {0, 1}
    rows = licenses.digest(licenses.passages(licenses.votes(docs)))
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    found = c.execute(licenses.oracle_sql())
    names = [x[0] for x in found.description]
    assert sorted(map(tuple, found.fetchall())) == sorted(tuple(r[n] for n in names) for r in rows.collect())


def test_templates_have_words(spark):
    with pytest.raises(ValueError, match="2 words"):
        licenses._templates(spark, [("one", "x")], [], 2)
    assert len(licenses.template_of(licenses.WHOLE["mit"]).split()) > 150
