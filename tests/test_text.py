"""Normalisation, sentences, chunks and pages: cases traced by hand, and invariants."""

import bisect

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.html import html_to_text
from lectern.operators import chunking


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[k] for k in names)], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("-", ""), ("exam-\nple", "example"), ("a--\nb", "a-b"), ("well-", "well"), ("a -\nb", "a b"), ("state-of-\nthe-art", "state-ofthe-art"), ("-\n", ""), ("one\r\ntwo\r\n\r\nthree  four", "one two\n\nthree four"), (" x \n\n\n\ny z", "x\n\ny z")])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize_extracted(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("3.14", ["3.", "14"]), ("e.g. x", ["e.", "g.", "x"]), ("...", [".", ".", "."]), ("no end", ["no end"]), ("a! b?\nc", ["a!", "b?", "c"]), ("", [])])
def test_sentences(spark, raw, want):
    assert one(spark, T.sentences(F.col("t")), t=raw) == want


def test_paragraph_spans(spark):
    raw = "a\n\nb\n\n\nc\n\n  \n\nd "
    got = [tuple(s) for s in one(spark, T.paragraph_spans(F.col("t")), t=raw)]
    assert [g[0] for g in got] == ["a", "b", "c", "d"] and all(raw[b:e] == p for p, b, e in got)


def test_pages(spark):
    at = lambda a, b, pages: tuple(one(spark, T.page_range(T.page_ends(F.col("p")), F.col("a"), F.col("b")), p=pages, a=a, b=b))
    pages = ["alpha beta", "gamma delta"]
    assert at(0, 10, pages) == (1, 1) and at(12, 23, pages) == (2, 2) and at(6, 17, pages) == (1, 2)
    assert at(10, 11, pages) == (2, 2) and at(40, 50, pages) == (2, 2) and at(3, 3, pages) == (None, None)
    assert at(0, 3, [""]) == (None, None)
    assert tuple(spark.range(1).select(T.page_range(T.page_ends(F.array().cast("array<string>")), F.lit(0), F.lit(3)).alias("x")).first()["x"]) == (None, None)


def plain_chunks(text, most):
    """The packer, as a loop."""
    if len(text) <= most:
        return [text]
    out, size = [], 0
    for p in filter(None, map(str.strip, text.split("\n\n"))):
        import re

        parts = [(p, "\n\n", False)] if len(p) <= most else [(s, " ", i == 0) for i, s in enumerate(filter(None, (x.strip() for x in re.findall(r"[^.!?]*[.!?]|[^.!?]+\Z", p))))]
        for s, sep, force in parts:
            if not out or (size and (force or size + len(sep) + len(s) > most)):
                out.append(s)
                size = len(s)
            else:
                out[-1] += sep + s
                size += len(sep) + len(s)
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=120), min_size=1, max_size=12))
def test_chunks_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = chunking.chunks(df, "id", "t", target_tokens=5).orderBy("id", "chunk_index").collect()
    for i, t in enumerate(texts):
        assert [r["content"] for r in got if r["id"] == i] == plain_chunks(t, 20)


def test_many_pieces_take_time_in_proportion(spark):
    df = spark.createDataFrame([(1, "One two. " * 200_000), (2, "a\n\nb " * 100_000), (3, None)], "id int, t string")
    got = chunking.chunks(df, "id", "t", 10).collect()
    assert {r["id"] for r in got} == {1, 2} and all(len(r["content"]) <= 40 for r in got)
    spans = df.select("id", F.size(T.paragraph_spans(F.col("t"))).alias("p"), F.size(T.sentence_spans(F.col("t"))).alias("s")).collect()
    assert {r["id"]: (r["p"], r["s"]) for r in spans if r["id"] < 3} == {1: (1, 200_000), 2: (100_001, 1)}


def test_sentence_spans(spark):
    raw = " One two. Three!  four"
    got = [tuple(s) for s in one(spark, T.sentence_spans(F.col("t")), t=raw)]
    assert [g[0] for g in got] == ["One two.", "Three!", "four"] and all(raw[b:e] == p for p, b, e in got)


def test_blank_is_an_error_row(spark):
    df = spark.createDataFrame([(1, " \n"), (2, "x"), (3, None)], "id int, t string")
    got = {r["id"]: (r["content"], r["error_class"]) for r in chunking.chunk_or_error(df, "id", "t").collect()}
    assert got == {1: (None, "permanent_validation"), 2: ("x", None), 3: (None, "permanent_validation")}


def test_html():
    assert html_to_text("<p>one</p><p>two &amp; three</p>") == "one\n\ntwo & three"
    assert html_to_text("<title>t</title><script>var a='</p>';</script><div>x</div>") == "tvar a='</p>';\nx"
    assert html_to_text(None) is None and html_to_text("") is None and html_to_text("<p> </p>") is None and html_to_text("a<!-- c -->b") == "ab"


def test_full_html(spark):
    for raw, want in (("  <!DOCTYPE html><p>", True), ("<p>x</p>", False), ("x <html> <body>", True), ("x" * 2050 + "<html><body>", False), ("<?xml ?>", True)):
        assert one(spark, T.looks_like_full_html(F.col("t")), t=raw) is want


def test_mime(spark):
    df = spark.createDataFrame([(" Application/X-PDF", None), (None, "/a/b.PDF"), ("", "x.html"), (None, "none")], "m string, p string")
    assert [r[0] for r in df.select(T.guessed_mime(F.col("m"), F.col("p"))).collect()] == ["application/pdf", "application/pdf", "text/html", None]


def test_annotation_and_json(spark):
    assert one(spark, T.annotation_content(F.col("a"), F.col("b")), a=" x\ny ", b="note") == "Highlighted text:\n> x\n> y\n\nAnnotation comment:\nnote"
    assert one(spark, T.annotation_content(F.col("a"), F.col("b")), a=" ", b=None) is None
    assert one(spark, T.canonical_json(b=F.col("a"), a=F.lit(1)), a="é") == '{"a":1,"b":"é"}'


def test_page_ranges_of_many_pages(spark):
    """Merged, not compared one by one: the same as by hand, and 5,000 pages with 20,000 spans in one go."""
    pages = {1: ["ab", "", "cde"], 2: [], 3: [""], 4: ["x" * 10] * 5000, 5: None}
    spans = [(d, a, b) for d in (1, 2, 3, 5, 6) for a in range(9) for b in range(a, 11)] + [(4, a, a + 25) for a in range(0, 60_000, 3)]
    got = chunking.with_pages(spark.createDataFrame([(*s, "kept") for s in spans], "id int, start int, end int, other string"), chunking.page_rows(spark.createDataFrame(list(pages.items()), "id int, ps array<string>"), "id", "ps")).collect()
    assert len(got) == len(spans) and {r["other"] for r in got} == {"kept"}
    ends = {d: [sum(map(len, p[: i + 1])) + 2 * i for i in range(len(p))] for d, p in pages.items() if p}

    def page(d, at):
        return min(bisect.bisect_right(ends[d], at), len(ends[d]) - 1) + 1

    for r in got:
        d, a, b = r["id"], r["start"], r["end"]
        want = (page(d, a), page(d, b - 1)) if d in ends and ends[d][-1] > 0 and b > a else (None, None)
        assert (r["page_start"], r["page_end"]) == want, r


def test_references_that_no_semicolon_closes():
    cut_short = "<title>a &ampp</title><p>b &amp; c &copy;</p><script>x&y&amp</script>d&lt<p>e</p>"
    assert html_to_text(cut_short, closed=True) == "a &ampp\nb & c ©\nx&y&ampd&lt\ne"
    assert html_to_text(cut_short) == "a &p\nb & c ©\nx&y&ampd<\ne"
    assert html_to_text("﷐&amp x", closed=True) == "﷐&amp x"
