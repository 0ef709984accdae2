"""MATCH and k among the conditions of a statement."""

import pytest

from lectern.operators import vector
from lectern.operators.providers import HashingEmbedder, register
from lectern.plans import sqlgate
from lectern.plans.match import Denied, replaced


@pytest.fixture(scope="module")
def library(spark):
    model = HashingEmbedder(16)
    texts = [f"text number {i} about {t}" for i, t in enumerate(["river", "stone", "river bank", "cloud", "stone wall", "rain cloud"])]
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(model.embed(texts))] + [(99, None)], "vec_id long, embedding array<float>").createOrReplaceTempView("vec_documents")
    spark.createDataFrame([(i, i % 2, t, "title" if i < 3 else "note") for i, t in enumerate(texts)], "id long, reference_id long, content string, kind string").createOrReplaceTempView("lib_documents")
    spark.createDataFrame([(0, "even"), (1, "odd")], "id long, title string").createOrReplaceTempView("reference_items")
    vector.register(spark, "vec_documents")
    register(spark, lambda: HashingEmbedder(16))
    return texts, model


def run(spark, sql):
    return sqlgate.search(spark, sql, HashingEmbedder(16), ("vec_documents",)).collect()


def nearest(library, topic, k):
    texts, model = library
    q, vs = model.embed([topic])[0], model.embed(texts)
    far = [(sum((a - b) ** 2 for a, b in zip(q, v)) ** 0.5, i) for i, v in enumerate(vs)]
    return [i for _, i in sorted(far)[:k]]


def test_the_documented_statement(spark, library):
    got = run(spark, """SELECT r.title, d.kind, d.content
FROM vec_documents v
JOIN lib_documents d ON v.rowid = d.id
JOIN reference_items r ON d.reference_id = r.id
WHERE v.embedding MATCH embed('river bank')
  AND k = 4
ORDER BY rerank_score('river bank', d.content) DESC, d.id
LIMIT 3;""".rstrip(";"))
    near = nearest(library, "river bank", 4)
    score = lambda i: len({"river", "bank"} & set(library[0][i].split())) / 2
    assert [r["content"] for r in got] == [library[0][i] for i in sorted(near, key=lambda i: (-score(i), i))[:3]]


@pytest.mark.parametrize("where", [
    "v.embedding MATCH embed('stone') AND k = 2", "k = 2 AND v.embedding MATCH embed('stone')", "v.k = 2 AND embedding match embed('stone')", "d.id >= 0 AND v.embedding MATCH embed('stone') AND d.id < 100 AND k=2",
])
def test_either_order_and_among_others(spark, library, where):
    got = run(spark, f"SELECT d.id FROM lib_documents AS d JOIN vec_documents AS v ON d.id = v.rowid WHERE {where}")
    assert {r["id"] for r in got} == set(nearest(library, "stone", 2))


def test_conditions_come_after_the_nearest_are_known(spark, library):
    got = run(spark, "SELECT d.id FROM vec_documents v JOIN lib_documents d ON d.id = v.rowid WHERE v.embedding MATCH embed('cloud') AND k = 3 AND d.kind = 'title'")
    assert {r["id"] for r in got} == {i for i in nearest(library, "cloud", 3) if i < 3}


def test_subqueries_common_tables_and_unions(spark, library):
    sql = """WITH a AS (SELECT rowid FROM vec_documents WHERE embedding MATCH embed('rain') AND k = 2)
SELECT id, 'a' AS part FROM lib_documents WHERE id IN (SELECT rowid FROM a)
UNION ALL SELECT d.id, 'b' FROM lib_documents d LEFT JOIN vec_documents v ON v.rowid = d.id AND k = 1 AND v.embedding MATCH embed('stone') WHERE v.rowid IS NULL"""
    got = run(spark, sql)
    assert {r["id"] for r in got if r["part"] == "a"} == set(nearest(library, "rain", 2))
    assert {r["id"] for r in got if r["part"] == "b"} == set(range(6)) - set(nearest(library, "stone", 1))


def test_a_join_keeps_only_what_matched(spark, library):
    got = run(spark, "SELECT d.id FROM lib_documents d LEFT JOIN vec_documents v ON v.rowid = d.id WHERE v.embedding MATCH embed('stone') AND k = 2")
    assert {r["id"] for r in got} == set(nearest(library, "stone", 2))


@pytest.mark.parametrize("where", ["embedding MATCH array(1D) OR k = 3", "embedding MATCH array(1D)", "NOT embedding MATCH array(1D) AND k = 2", "embedding MATCH AND k = 2"])
def test_what_cannot_be_is_refused(where):
    with pytest.raises(Denied):
        replaced(f"SELECT 1 FROM vec_documents WHERE {where}", ("vec_documents",), "vec_id")


def test_two_relations_and_other_tables(spark):
    with pytest.raises(Denied):
        replaced("SELECT 1 FROM t WHERE embedding MATCH array(1D) AND k = 2", ("vec_documents",), "vec_id")
    with pytest.raises(Denied):
        replaced("SELECT 1 FROM vec_documents a, vec_documents b WHERE embedding MATCH array(1D) AND k = 2", ("vec_documents",), "vec_id")
    both = replaced("SELECT 1 FROM vec_documents a, vec_documents b WHERE a.embedding MATCH array(1D) AND b.k = 3 AND b.embedding MATCH array(2D) AND a.k = 2", ("vec_documents",), "vec_id")
    assert "array(1D)) AS distance FROM vec_documents ORDER BY distance NULLS LAST, vec_id LIMIT 2) AS a" in both and "LIMIT 3) AS b" in both and "MATCH" not in both


def test_words_that_only_look_like_it(spark, library):
    for sql in ("SELECT match FROM embedding", "SELECT embedding FROM t WHERE a = 1"):
        assert replaced(sql, ("vec_documents",), "vec_id") == sql
    assert sqlgate.rewrite("SELECT 'embedding MATCH x AND k = 1' AS s /* embedding MATCH y */") == "SELECT 'embedding MATCH x AND k = 1' AS s /* embedding MATCH y */"
