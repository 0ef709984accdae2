"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and extra columns with names of its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import alignment, chat, common, decontaminate, infill, language, licenses, lmscore, neardup, packing, quality, secretscan, sharding, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion of ink and amber beside the quiet river"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
ROWS = [
    (1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, None, "en", "a", 1), (3, "", "de", None, None), (4, " \n\t ", None, "a", 1), (5, LONG, "en", "a", 1), (6, PROSE + " now", "en", "a", 1), (None, "Das ist ein Text ohne Kennung", "de", "a", 1),
    (7, "x" * 200_000, "fr", "a", 1), (8, "émoji 🙂 漢字 œuvre", "fr", "a", 1), (9, "Das ist ein kleiner Text über das Wetter und die Straße", "de", "a", 1), (10, "Released under the MIT License.", "en", "a", 1),
]
BENCH = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, PROSE), (4, "lazy dog")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["row", "word", "words", "own", "h1", "keys", "rep", "one", "kept", "score", "hash", "spans", "items", "n_words", "ambiguous", "lang_pred", "component_id", "gram_hash", "label", "template"]
    return spark.createDataFrame(ROWS, DOCS).select("*", *(F.lit("extra").alias(c) for c in extra))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (9, 0, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return rows.select("*", *(F.lit("extra").alias(c) for c in ("text", "good", "trusted", "bucket", "ratio", "h")))


def runs(spark, docs, labels):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").select("*", *(F.lit("extra").alias(c) for c in ("doc_id", "words", "n", "shingles", "item", "seen")))
    return {
        "licenses": lambda: licenses.digest(licenses.passages(licenses.votes(docs))),
        "lmscore": lambda: lmscore.score_documents(docs),
        "quality": lambda: quality.judge(docs, labels),
        "language": lambda: language.predicted(docs),
        "sharding": lambda: sharding.assign(docs, limit=1000, cell=3),
        "packing": lambda: packing.pack_documents(docs),
        "decontaminate": lambda: decontaminate.digest(decontaminate.contamination(docs, bench)),
        "neardup": lambda: neardup.near_duplicates(docs),
        "secretscan": lambda: secretscan.digest(secretscan.spans(docs)),
        "alignment": lambda: alignment.aligned(docs),
        "infill": lambda: infill.digest(infill.fill_in_middle(docs)),
    }


NAMES = ["licenses", "lmscore", "quality", "language", "sharding", "packing", "decontaminate", "neardup", "alignment", "infill", "secretscan"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(spark, docs, labels, name):
    rows = runs(spark, docs, labels)[name]().collect()
    want = sorted(str(r[0]) for r in ROWS)
    if name == "packing":
        assert sorted({str(r["doc_id"]) for r in rows}) == sorted(set(want))
    else:
        assert sorted(str(r["doc_id"]) for r in rows) == want


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, labels, name):
    assert runs(spark, none, labels)[name]().count() == 0


def test_without_labels(spark, docs, labels):
    rows = quality.judge(docs, labels.limit(0)).collect()
    assert all(r["ratio"] == 0 and r["kept"] == (not r["base_failed"]) for r in rows)


def test_defined_results(spark, docs, labels):
    lang = {r["doc_id"]: r for r in language.predicted(docs).collect()}
    assert [lang[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and lang[2]["score"] == 0
    near = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert near[6]["component_id"] == 1 and not near[6]["kept"] and near[2]["n_shingles"] == 0 and near[2]["kept"]
    assert near[None]["component_id"] is None and not near[None]["kept"]
    lic = {r["doc_id"]: r for r in licenses.digest(licenses.passages(licenses.votes(docs))).collect()}
    assert (lic[10]["n_base"], lic[10]["first_word"], lic[10]["labels"]) == (1, 3, "mit") and lic[2]["n_words"] == 0 and lic[2]["score"] == 0
    packs = [r for r in packing.pack_documents(docs).collect() if r["doc_id"] == 2]
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in packs] == [(0, 1, 1)]


def test_pipeline_with_odd_rows(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, none):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = common.cut(stage(spark, kept, str(tmp_path)), "t")
            assert kept.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()


def test_one_row_of_each_group_of_copies_stays(spark):
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(7, PROSE), (None, PROSE), (3, PROSE), (3, PROSE), (3, other), (None, LONG[:3000]), (None, LONG[:3000]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("x"))
    got = corpus_pipeline.deduplicated(spark, docs, "")
    want = [(3, PROSE), (3, other), (None, LONG[:3000]), (None, None)]
    assert got.columns == docs.columns and sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string").collect()))


def test_chat_edges(spark):
    rows = [(1, 0, "User: hi\nthere"), (1, 1, None), (1, None, "System: be kind"), (None, 0, "A: yes"), (2, 0, ""), (1, 0, "User: hi\nthere"), (3, 5, "y\n" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("block", F.lit("x")).withColumn("entry", F.lit("x"))
    got = chat.parse(df).collect()
    assert {r["conv_id"] for r in got} == {1, 3, None} and sum(r["n_lines"] for r in got if r["conv_id"] == 3) == 5000
    assert chat.parse(df.limit(0)).count() == 0
    assert chat.recovered(spark.createDataFrame([(1, 0, None, "x"), (None, None, "user", None)], "conv_id long, turn long, role string, text string")).count() == 1
    assert chat.recovered(df.limit(0)).count() == 0


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.NET/en/x?q#f"), (5, "http://net"), (6, "http://x.net/"), (7, "http://example.net/en/"), (7, "http://example.net/en/"), (8, "://"), (9, "http://a.org/fr/" + "z" * 100_000), (10, "http://notexample.com/de/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("host", F.lit("y"))
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 2, 3, 8)] == [("", "", None)] * 4
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5]["rule"] is None and got[6]["rule"] == "net/" and got[9]["rule"] == "org/fr/" and got[10]["rule"] is None
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert urls.judge(df.limit(0)).count() == 0
