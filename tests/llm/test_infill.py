"""Fill in the middle: the list of boundaries, cuts by hand and the exact way back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import infill
from lectern.llm.common import table


@pytest.mark.parametrize("alphabet", ["abc", "\u00e9\u00fc", "\u6f22\u5b57", "\U0001f642\U0001f600", "ab \u00e9\u6f22\U0001f642"])
def test_boundaries_are_those_of_code_points(alphabet):
    rng = random.Random(4)
    for size in (0, 1, 2, 7, 8, 511, 512, 513, 4000):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        found = infill.encoded(text.encode())
        assert found["units"] == size
        assert infill.selected(found, list(range(size + 1))) == [len(text[:i].encode()) for i in range(size + 1)]


def test_boundaries_are_found_in_steps(monkeypatch):
    text = "a\u00e9\u6f22\U0001f642" * 100
    want = infill.encoded(text.encode())
    for step in (1, 3, 10, 999, 1000, 1001):
        monkeypatch.setattr(infill, "STEP_BYTES", step)
        assert infill.encoded(text.encode()) == want
    assert 8 * sum(len(want[k]) for k in ("lows", "highs")) < 5 * 401


def by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, text)
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


ODD = [(1, None), (2, ""), (3, "a<P>b"), (4, "<S>"), (5, "x <M>"), (None, "no name"), (6, "<"), (7, "P><S"), (8, "<P <S <M >"), *((i, "\u00e9\u6f22\U0001f642 a\x00\r\n") for i in range(20, 60)), *((i, "the same text") for i in range(100, 180)), (100, "the same text"), (9, "S>M>P>" * 50)]


@pytest.mark.parametrize("crowd", [1, 7, 1024])
def test_same_as_by_hand(spark, small, crowd):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(odd).withColumn("key", F.lit("x")).withColumn("list", F.lit("y"))
    got = infill.fill_in_middle(docs, crowd=crowd).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = [(r["doc_id"], *by_hand(r["doc_id"], r["text"])) for r in docs.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["back"] == r["text"] for r in got)


def test_different_texts_of_one_key_are_refused(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="two texts have one key"):
        infill.fill_in_middle(docs, key=F.lit("k")).collect()
