"""Queue, sync, migration, sources, gate, models, streams and the store."""

import hashlib
import json
import random
import sqlite3
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import ParseException

from lectern import cli, schema, scratch, settings
from lectern.operators import jobs as J
from lectern.operators import migrate, providers, status, sync, vector
from lectern.plans import catalog, documentation, library, migration, pages, sqlgate
from lectern.plans.store import Store
from lectern.sources import biblio
from lectern.streaming import queue as S

NOW = datetime(2024, 5, 1, 12, 0, 0)
POLICY = J.Policy(lease_seconds=60, batch_size=10, max_attempts=3, backoff_base_seconds=1, backoff_max_seconds=5)


def job(spark, **change):
    base = {"id": "j", "queue_name": "embedding", "job_type": "embed_document", "entity_type": "document", "entity_id": 1, "dedupe_key": "k", "payload_json": None, "status": "queued", "priority": 100, "available_at": NOW, "claimed_by": None, "claim_token": None, "claim_expires_at": None, "attempts": 0, "max_attempts": 5, "last_error": None, "created_at": NOW, "updated_at": NOW}
    rows = [tuple({**base, **c}[f.name] for f in schema.TABLES["jobs"]) for c in (change.pop("rows", None) or [change])]
    return spark.createDataFrame(rows, schema.TABLES["jobs"])


def done(spark, *rows):
    return spark.createDataFrame(rows, "id string, token string, error_class string, error_message string")


def test_claim_and_success(spark):
    claimed = J.claim(job(spark), NOW, "w", POLICY)
    r = claimed.first()
    assert (r["status"], r["attempts"], r["claimed_by"], r["claim_expires_at"]) == ("claimed", 1, "w", NOW + timedelta(seconds=60))
    assert J.complete(claimed, done(spark, ("j", r["claim_token"], None, None)), NOW, POLICY).first()["status"] == "succeeded"
    assert J.renew(claimed, NOW + timedelta(seconds=9), "j", r["claim_token"], POLICY).first()["claim_expires_at"] == NOW + timedelta(seconds=69)


def test_retry_until_dead(spark):
    for limit, want in ((1, "dead"), (5, "retry")):
        claimed = J.claim(job(spark, max_attempts=limit), NOW, "w", POLICY)
        r = J.complete(claimed, done(spark, ("j", claimed.first()["claim_token"], "retryable_io", "no")), NOW, POLICY).first()
        assert (r["status"], r["last_error"], r["claim_token"]) == (want, "no", None)
        assert want == "dead" or NOW < r["available_at"] <= NOW + timedelta(seconds=5)
    claimed = J.claim(job(spark), NOW, "w", POLICY)
    assert J.complete(claimed, done(spark, ("j", claimed.first()["claim_token"], "permanent_validation", "no")), NOW, POLICY).first()["status"] == "dead"


def test_stale_token(spark):
    claimed = J.claim(job(spark), NOW, "w", POLICY).withColumn("claim_token", F.lit("different-token"))
    told = done(spark, ("j", "old", None, None))
    assert J.complete(claimed, told, NOW, POLICY).first()["status"] == "claimed"
    assert tuple(J.attempt_outcomes(claimed, told).first()) == ("j", "retryable_fail", "stale_claim")


def test_reclaim_and_limits(spark):
    old = NOW - timedelta(minutes=1)
    for attempts, limit, want in ((1, 5, "retry"), (1, 1, "dead")):
        r = J.reclaim_expired(job(spark, status="claimed", claim_expires_at=old, claim_token="t", claimed_by="w", attempts=attempts, max_attempts=limit), NOW, POLICY).first()
        assert (r["status"], r["claimed_by"], r["claim_token"]) == (want, None, None)
    assert J.claimable(job(spark, status="retry", attempts=1, max_attempts=1), NOW, POLICY).count() == 0
    assert J.claimable(job(spark, available_at=NOW + timedelta(seconds=1)), NOW, POLICY).count() == 0


def test_claim_order_and_upkeep(spark):
    table = job(spark, rows=[{"id": f"j{i}", "priority": i % 3, "created_at": NOW - timedelta(minutes=i), "status": "dead" if i > 7 else "queued", "updated_at": NOW - timedelta(minutes=i), "entity_id": i} for i in range(12)])
    assert [r["id"] for r in J.claimable(table, NOW, J.Policy(batch_size=3)).collect()] == ["j6", "j3", "j0"]
    assert {r["id"] for r in J.requeue_dead(table, NOW, 2).where("status = 'retry'").collect()} == {"j8", "j9"}
    assert {r["id"] for r in J.cancel(table, NOW, "embedding", "", 3).where("status = 'cancelled'").collect()} == {"j3"}
    assert J.depth_by_queue(table).first()["by_status"] == {"dead": 4, "queued": 8}
    assert J.new_jobs(table.withColumn("dedupe_key", F.lit("k")), table.limit(0)).count() == 1


def test_backoff_and_workers(spark):
    waits = [r["w"] for r in spark.range(1, 12).select(J.backoff_seconds(F.col("id")).alias("w")).collect()]
    assert waits == [5, 10, 20, 40, 80, 160, 320, 640, 900, 900, 900]
    jittered = spark.range(1, 12).select(J.backoff_seconds(F.col("id")).alias("a"), J.backoff_seconds(F.col("id"), jitter_key=F.lit("k")).alias("b")).collect()
    assert all(a <= b <= min(900, a + max(1, a // 4)) for a, b in jittered)
    none = spark.createDataFrame([], schema.TABLES["worker_runs"])
    both = J.register_worker(J.register_worker(none, NOW, "a", "embedding", "x"), NOW, "b", "embedding", "x")
    assert {r["worker_id"]: r["status"] for r in both.collect()} == {"a": "stopped", "b": "running"}
    assert {r["worker_id"]: r["status"] for r in J.heartbeat(both, NOW, "b", "failed").collect()}["b"] == "failed"


def test_sync_report(spark):
    item = "key string, title string, abstract_note string, year string, authors string"
    first = library.Source(spark.createDataFrame([("ABC123", "A Title", "An abstract", "2024", "Doe, Jane")], item))
    refs = spark.createDataFrame([], "source_id string, title string, authors string, year string")
    docs, files = spark.createDataFrame([], "source_id string, kind string, content string"), spark.createDataFrame([], "owner string, file_path string")
    one = library.synchronize(first, refs, files, docs)
    assert one.report().startswith("Changes detected")
    two = library.synchronize(first, one.references, one.files, one.documents)
    told = {r["artifact"]: tuple(r)[1:] for r in two.counts.collect()}
    assert told["References"] == (0, 0, 1, 0) and told["Documents"] == (0, 0, 2, 0) and two.report().startswith("No library changes detected")
    ready = two.documents.withColumn("embedding_status", F.lit("ready"))
    better = library.Source(first.items.withColumn("title", F.lit("A Better Title")))
    three = library.synchronize(better, two.references, two.files, ready)
    told = {r["artifact"]: tuple(r)[1:] for r in three.counts.collect()}
    assert told["References"] == (0, 1, 0, 1) and told["Documents"] == (0, 1, 1, 1)
    assert {r["kind"]: r["embedding_status"] for r in three.documents.collect()} == {"title": "pending", "abstract": "ready"}
    gone = library.synchronize(library.Source(first.items.limit(0)), one.references, one.files, one.documents)
    assert gone.references.count() == 1 and library.synchronize(library.Source(first.items.limit(0)), one.references, one.files, one.documents, mirror=True).references.count() == 0


def test_seeding_and_chunks(spark):
    docs = spark.createDataFrame([(1, "title", "a", None, "pending"), (2, "title", "  ", None, "pending"), (3, "fulltext_chunk", "old", 7, "ready"), (4, "fulltext_chunk", "kept", 8, "error")], "id long, kind string, content string, document_file_id long, embedding_status string")
    assert {r["entity_id"] for r in sync.embedding_candidates(docs).collect()} == {1, 4}
    new = spark.createDataFrame([(9, "fulltext_chunk", "new", 7)], "id long, kind string, content string, document_file_id long")
    assert {r["id"] for r in sync.replace_chunks(docs, new).collect()} == {1, 2, 4, 9}
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<float>")
    assert {r["doc_id"]: r["embedding"][0] for r in sync.upsert_vectors(v, spark.createDataFrame([(2, [5.0]), (3, [6.0])], v.schema)).collect()} == {1: 1.0, 2: 5.0, 3: 6.0}


def legacy(spark):
    docs = spark.createDataFrame([(1, "title", "Paper", "ready", None), (2, "abstract", "Abs", "ready", None), (3, "pdf_chunk", "chunk one", "ready", None), (4, "pdf_chunk", "chunk two", "error", None), (5, "fulltext_chunk", "   ", "pending", None)], "id long, kind string, content string, embedding_status string, embedding_error string")
    files = spark.createDataFrame([(1, "/tmp/paper.pdf", "text", "ready", None, None), (2, "/tmp/other.pdf", None, "extracting", None, "")], "id long, file_path string, extracted_text string, extraction_status string, storage_kind string, storage_uri string")
    return docs, files


def test_migration(spark):
    docs, files = legacy(spark)
    assert migrate.reasons(docs, files).first()["reasons"] == [migrate.REASONS[k] for k in ("pdf_chunk", "extracting", "storage_uri", "storage_kind", "empty")]
    assert migrate.change_counts(docs, files).first().asDict() == {"renamed": 2, "requeued_embeddings": 0, "repaired": 1, "storage_uris": 2, "requeued_extractions": 1}
    new_docs, new_files = migrate.migrated_documents(docs), migrate.migrated_files(files)
    assert migrate.reasons(new_docs, new_files).first()["reasons"] == []
    assert [r["storage_uri"] for r in new_files.orderBy("id").collect()] == ["/tmp/paper.pdf", "/tmp/other.pdf"]
    assert new_docs.where("id = 5").first()["embedding_error"] == migrate.REPAIRED
    migrate.check_unchanged(migrate.text_digest(docs, "id", "content"), migrate.text_digest(new_docs, "id", "content"))
    with pytest.raises(ValueError):
        migrate.check_unchanged(migrate.text_digest(docs, "id", "content"), migrate.text_digest(docs.withColumn("content", F.lit("x")), "id", "content"))


def test_digests_of_texts(spark, tmp_path):
    rows = [(i, f"text {i} é" * (i % 7)) for i in random.Random(3).sample(range(3000), 3000)] + [(3000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    chars = sum(len(t or "") for _, t in rows)
    records = [f"{i}\x1f{t or ''}\x1e".encode() for i, t in sorted(rows, key=lambda r: r[0])]
    want = hashlib.sha256(b"".join(records)).hexdigest()
    got = catalog.QUERIES["text_digest_ordered"](spark, str(tmp_path))
    assert tuple(got.first()) == (3001, chars, want) and [t for _, t in got.dtypes] == ["bigint", "bigint", "string"]
    none = spark.createDataFrame([], "id long, t string")
    assert tuple(migrate.ordered_text_digest(none, "id", "t").first()) == (0, 0, hashlib.sha256().hexdigest())
    sums = [sum(int(hashlib.sha256(r).hexdigest()[8 * k : 8 * k + 8], 16) for r in records) for k in range(8)]
    assert tuple(catalog.QUERIES["text_digest"](spark, str(tmp_path)).first()) == (3001, chars, hashlib.sha256("|".join(map(str, sums)).encode()).hexdigest())
    assert migrate.text_digest(none, "id", "t").first()["rows"] == 0


@pytest.mark.parametrize("resumed", [True, False])
def test_an_ordered_digest_is_taken_in_parts(spark, monkeypatch, tmp_path, resumed):
    """Each task hashes one range of ids, and hands its state on; where the library has no state to hand on, one task hashes all."""
    monkeypatch.setattr(migrate, "new_path", lambda spark, name: str(tmp_path / name))
    if not resumed:
        monkeypatch.setattr(migrate, "_libcrypto", lambda: None)
    ids = random.Random(4).sample(range(-2000, 2000), 4000) + [7] * 300 + [None]
    rows = [(i, None if n % 50 == 0 else f"{'' if n % 3 else 'a' * 90}{n} \u00e9" * (n % 5)) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    records = sorted((-(10**9) if i is None else i, b"" if i is None else f"{i}\x1f{t or ''}\x1e".encode()) for i, t in rows)
    found = migrate.ordered_text_digest(df, "id", "t", part_bytes=30_000)
    assert tuple(found.first()) == (4301, sum(len(t or "") for _, t in rows), hashlib.sha256(b"".join(r for _, r in records)).hexdigest())
    of_parts = [sum(pq.read_table(f, columns=["r"]).nbytes for f in p.glob("*.parquet")) for p in (tmp_path / "ordered").glob("part=*")]
    assert (len(of_parts) > 8 and max(of_parts) < 100_000) if resumed else not of_parts


def test_of_rows_with_one_key_the_last_counts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 5), (1, "a", 9), (2, "c", 1), (2, "b", 0), (3, "p", 1), (3, "q", 1)], "k int, v string, seen int")
    got = {r["k"]: (r["outcome"], r["new_v"]) for r in sync.diff(old, new, ["k"], ["v"], order="seen").collect()}
    assert got == {1: ("unchanged", "a"), 2: ("updated", "c"), 3: ("added", "q")}
    assert {r["k"]: r["new_v"] for r in sync.diff(old, new, ["k"], ["v"]).collect()} == {1: "x", 2: "c", 3: "q"}
    v = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<float>")
    twice = spark.createDataFrame([(1, [5.0], 1), (1, [2.0], 2)], "doc_id long, embedding array<float>, at int")
    assert [r["embedding"][0] for r in sync.upsert_vectors(v, twice, order="at").collect()] == [2.0]


def test_requeue_without_a_limit_joins_nothing(spark):
    table = job(spark, rows=[{"id": f"j{i}", "status": "dead", "queue_name": "embedding" if i % 2 else "extraction", "updated_at": NOW - timedelta(minutes=i)} for i in range(6)])
    every = J.requeue_dead(table, NOW, queue="embedding")
    assert {r["id"] for r in every.where("status = 'retry'").collect()} == {"j1", "j3", "j5"} and "Join" not in every._jdf.queryExecution().executedPlan().toString()
    many = J.requeue_dead(table, NOW, J.SENT + 1)
    assert "broadcast" not in many._jdf.queryExecution().logical().toString() and many.where("status = 'retry'").count() == 6


def test_files_change_in_any_of_seven_columns(spark):
    items = spark.createDataFrame([("K", "t", None, "2024", "x")], "key string, title string, abstract_note string, year string, authors string")
    files = spark.createDataFrame([("A", "K", "application/pdf", "/a.pdf", 7, 1)], "key string, parent_key string, mime_type string, file_path string, item_id long, link_mode long")
    empty = lambda s: spark.createDataFrame([], s)
    first = library.synchronize(library.Source(items, files), empty("source_id string"), empty("owner string, file_path string"), empty("source_id string, kind string, content string"))
    row = first.files.first()
    assert (row["storage_kind"], row["storage_uri"], row["extraction_status"], json.loads(row["metadata_json"])["link_mode"]) == ("local", "/a.pdf", "pending", 1)
    changed = {"mime_type": "text/html", "source_system": "other", "source_id": "B", "storage_kind": "s3", "storage_uri": "/b.pdf", "metadata_json": "{}", "extraction_status": "ready"}
    for column, value in [(None, None), *changed.items()]:
        stored = first.files if column is None else first.files.withColumn(column, F.lit(value))
        told = library.synchronize(library.Source(items, files), first.references, stored, first.documents)
        assert {r["artifact"]: r["updated"] for r in told.counts.collect()}["Document files"] == (column is not None), column
        assert told.files.select(*changed).first() == first.files.select(*changed).first()
    done = first.files.withColumn("extracted_text", F.lit("text")).withColumn("extraction_status", F.lit("ready"))
    kept = library.synchronize(library.Source(items, files), first.references, done, first.documents)
    assert kept.files.first()["extraction_status"] == "ready" and kept.files.first()["extracted_text"] == "text"


def test_status(spark):
    files = spark.createDataFrame([(1, None, "pending", None), (2, "", "ready", None), (3, "application/pdf", "error", "bad")], "id long, mime_type string, extraction_status string, extraction_error string")
    docs = spark.createDataFrame([(1, "note", "error", "e", NOW), (2, "note", None, None, None)], "id long, kind string, embedding_status string, embedding_error string, embedding_updated_at timestamp")
    attempts = spark.createDataFrame([("a", "permanent_fail", NOW)], "id string, outcome string, finished_at timestamp")
    got = status.library_status(docs, docs, files, job(spark), spark.createDataFrame([], schema.TABLES["worker_runs"]), attempts)
    assert got["summary"]["files_by_mime"] == {"unknown": 2, "application/pdf": 1} and got["embedding"] == {"note": {"error": 1, "null": 1}}
    assert got["queue"] == {"embedding": {"queued": 1}} and got["errors"]["embedding"] == [{"doc_id": 1, "kind": "note", "error": "e"}] and got["errors"]["extraction"][0]["file_id"] == 3


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = tmp_path_factory.mktemp("biblio") / "zotero.sqlite"
    db = sqlite3.connect(path)
    kinds = {"long": "INTEGER", "string": "TEXT"}
    for table, columns in biblio.SCHEMAS.items():
        db.execute(f"CREATE TABLE {table} ({', '.join(f'{c.split()[0]} {kinds[c.split()[1]]}' for c in columns.split(', '))})")
    put = lambda t, *rows: db.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    put("itemTypes", (1, "book"), (2, "attachment"), (3, "note"), (4, "annotation"))
    put("items", (1, "K1", 1, "2024"), (2, "A1", 2, "2024"), (3, "A2", 2, "2024"), (4, "A3", 2, "2024"), (5, "N1", 3, "2024"), (6, "X1", 4, "2024"), (7, "X2", 4, "2024"), (8, "K2", 1, "2023"))
    put("itemDataValues", (1, "A Title"), (2, "An abstract"), (3, "2021-05-06"))
    put("itemData", (1, 1, 1), (1, 2, 2), (1, 6, 3))
    put("creators", (1, "Jane", "Doe"), (2, None, "Group"), (3, "First", ""))
    put("itemCreators", (1, 2, 0), (1, 3, 1), (1, 1, 2))
    put("itemAttachments", (2, 1, 0, "application/pdf", "storage:a.pdf"), (3, 99, 0, "application/pdf", "/x.pdf"), (4, 1, 0, "text/html", "/y.html"))
    put("itemAnnotations", (6, 2, 1, "me", "marked", "why", "red", "3", "s", "{}", 0), (7, 77, 1, "me", "x", None, None, None, None, None, 0))
    put("itemNotes", (5, 1, "<p>note</p>", "t"))
    db.commit()
    db.close()
    return str(path)


def test_bibliography(spark, database, tmp_path):
    t = biblio.tables(spark, database)
    items = {r["key"]: r for r in biblio.items(t).collect()}
    assert (items["K1"]["title"], items["K1"]["abstract_note"], items["K1"]["year"], items["K1"]["authors"]) == ("A Title", "An abstract", "2021", "Group; Doe, Jane") and items["K2"]["title"] is None and set(items) == {"K1", "K2"}
    path = database.replace("zotero.sqlite", "storage/A1/a.pdf")
    assert [(r["key"], r["parent_key"], r["file_path"]) for r in biblio.attachments(t, database).collect()] == [("A1", "K1", path)]
    assert biblio.attachments(t, database, spark.createDataFrame([("/none",)], "path string")).count() == 0
    assert [(r["key"], r["parent_key"], r["attachment_key"]) for r in biblio.annotations(t).collect()] == [("X1", "K1", "A1")]
    source = library.Source(biblio.items(t), biblio.attachments(t, database), biblio.annotations(t), biblio.notes(t))
    empty = lambda s: spark.createDataFrame([], s)
    got = library.synchronize(source, empty("source_id string, title string"), empty("owner string, file_path string"), empty("source_id string, kind string, content string"))
    content = {(r["source_id"], r["kind"]): r["content"] for r in got.documents.collect()}
    assert content[("N1", "note")] == "note" and content[("X1", "annotation")].startswith("Highlighted text:\n> marked") and content[("K2", "title")] is None
    assert {r["artifact"]: r["added"] for r in got.counts.collect()} == {"References": 2, "Documents": 4, "Document files": 1, "Annotations": 1, "Notes": 1, "Total": 9}
    again = library.synchronize(source, got.references, got.files, got.documents)
    assert {r["artifact"]: r["changed"] for r in again.counts.collect()}["Total"] == 0


def test_database_discovery(tmp_path):
    assert biblio.find_database("/x") == "/x" and biblio.find_database(None, {"ZOTERO_DB_PATH": "/y"}) == "/y"
    with pytest.raises(FileNotFoundError):
        biblio.find_database(None, {"ZOTERO_DB_PATH": "${HOME}/z"}, tmp_path)


@pytest.fixture
def gate(spark, small):
    from lectern.session import TABLES, views

    views(spark, small, *TABLES)
    return spark


@pytest.mark.parametrize("sql", [
    "SELECT 1 AS one", "WITH a AS (SELECT * FROM nation) SELECT count(*) FROM a", "SELECT * FROM region ORDER BY 1 LIMIT 2", "SELECT * FROM (VALUES (1)) v(x)", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)",
    "SELECT r_name FROM region UNION SELECT n_name FROM nation", "SELECT k, v FROM region LATERAL VIEW explode(map(1, 2)) t AS k, v", "SELECT row_number() OVER (ORDER BY n_name) FROM nation", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT * FROM t",
])
def test_gate_lets_through(gate, sql):
    assert sqlgate.search(gate, sql).count() >= 1


@pytest.mark.parametrize("sql", [
    "INSERT INTO nation VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO nation SELECT * FROM a", "CREATE TABLE t (a INT)", "DROP TABLE nation", "CREATE VIEW v AS SELECT 1", "ALTER TABLE nation ADD COLUMN x INT", "SET a=1", "PRAGMA writable_schema = ON", "CALL p()", "EXECUTE IMMEDIATE 'SELECT 1'", "ADD JAR 'x'",
    "TRUNCATE TABLE nation", "DELETE FROM nation", "UPDATE nation SET n_name = ''", "MERGE INTO nation USING region ON true WHEN MATCHED THEN DELETE", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT reflect('java.lang.Math', 'abs', 1)", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "SELECT (SELECT count(*) FROM text.`/etc/passwd`)", "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)", "SELECT " + ", ".join(f"{i} AS c{i}" for i in range(60)) + ", java_method('java.lang.Math', 'abs', 1)", "SELECT 1 WHERE 1 IN (" + ", ".join(map(str, range(60))) + ", (SELECT count(*) FROM text.`/etc/passwd`))", "SHOW TABLES", "DESCRIBE nation", "CACHE TABLE nation", "REFRESH TABLE nation", "USE other", "SELECT * FROM unknown_view", "SELECT 1; SELECT 2", "",
])
def test_gate_denies(gate, sql):
    with pytest.raises((ValueError, ParseException)):
        sqlgate.search(gate, sql)


def test_literals_names_and_comments_are_left_alone(gate):
    sqlgate.register_names(gate)
    row = sqlgate.search(gate, "SELECT 'total(x)' AS a, \"group_concat(y)\" AS b, 'it''s strftime(''%Y'', z) and iif(1, 2, 3)' AS c, r_name AS `total(n)`, 'reflect(x)' AS d /* iif(1,2,3) */ FROM region LIMIT 1 -- total(x)").first()
    assert tuple(row)[:3] == ("total(x)", "group_concat(y)", "it's strftime('%Y', z) and iif(1, 2, 3)") and row["d"] == "reflect(x)" and "total(n)" in row.asDict()
    row = sqlgate.search(gate, "SELECT total(CASE WHEN abs(n_nationkey) > (1 + 1) THEN 1 ELSE 0 END) AS t, iif(max(n_nationkey) > 1, 1, 2) AS i, iif(false, 'a', iif(true, 'b', 'c')) AS s, group_concat(lower(n_name), ',') AS g FROM nation").first()
    assert (row["t"], row["i"], row["s"]) == (22.0, 1, "b") and len(row["g"].split(",")) == 25
    assert [tuple(r) for r in sqlgate.search(gate, "SELECT key, value FROM json_each('{\"a\": 1, \"b\": \"x\"}') ORDER BY key").collect()] == [("a", "1"), ("b", "x")]
    assert [tuple(r) for r in sqlgate.search(gate, "SELECT t.n_nationkey, j.key, j.value FROM nation t, LATERAL json_each('[7, 8]') j WHERE t.n_nationkey = 3 ORDER BY 2").collect()] == [(3, "0", "7"), (3, "1", "8")]
    assert tuple(sqlgate.search(gate, "SELECT vec_length(array(1D, 2D)) AS n, vec_to_json(array(1D, 2.5D)) AS j").first()) == (2, "[1.0,2.5]")


@pytest.mark.parametrize("sql", ["SELECT input_file_name() FROM nation", "SELECT raise_error('x')", "SELECT from_protobuf(X'00', 'm', '/etc/passwd')", "WITH a AS (SELECT reflect('java.lang.Math', 'random') AS x) SELECT x FROM a", "SELECT n_name FROM nation WHERE n_name IN (SELECT java_method('a', 'b'))", "SELECT some.other(1)", "SELECT * FROM python_worker_logs()", "SELECT nothing_like_it(1)"])
def test_functions_that_nobody_allowed(gate, sql):
    with pytest.raises(sqlgate.Denied):
        sqlgate.search(gate, sql)


def test_statements_register_what_they_name(spark, small):
    for name in spark.catalog.listTables():
        spark.catalog.dropTempView(name.name)
    catalog.QUERIES["cte_chain"](spark, small)
    assert {t.name for t in spark.catalog.listTables() if t.isTemporary} == {"orders", "customer"}


def test_shape_and_rewrites(gate, small):
    df = gate.sql("SELECT 1 AS a, 2 AS a, X'00' AS b, array(CAST(1 AS FLOAT)) AS v, 'é' AS t")
    assert sqlgate.shaped(df) == [{"a": 2, "b": "<blob>", "v": "<blob>", "t": "é"}] and json.loads(sqlgate.as_json(df))[0]["t"] == "é"
    model = providers.HashingEmbedder(64)
    vector.register(gate, "embeddings")
    sql = sqlgate.rewrite("SELECT vec_id FROM embeddings WHERE embedding MATCH embed('it''s') AND k = 3", model, ("embeddings",))
    assert "LIMIT 3" in sql and "embed(" not in sql and "MATCH" not in sql
    got = sqlgate.search(gate, "SELECT vec_id FROM embeddings WHERE embedding MATCH embed('a topic') AND k = 3", model, ("embeddings",))
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()
    joined = "SELECT d.doc_id, v.distance FROM (SELECT * FROM embeddings e WHERE e.embedding MATCH embed('a topic') AND k = 3) v JOIN documents d ON d.doc_id = v.vec_id ORDER BY 2"
    assert [r["doc_id"] for r in sqlgate.search(gate, joined, model, ("embeddings",)).collect()] == [r["vec_id"] for r in vector.knn(gate.table("embeddings"), model.embed(["a topic"])[0], 3).collect() if r["vec_id"] < 200]
    one = catalog.QUERIES["knn_table_function"](gate, small)
    assert "TakeOrderedAndProject" in one._jdf.queryExecution().executedPlan().toString()
    lateral = "SELECT q.vec_id AS a, n.vec_id AS b FROM (SELECT * FROM embeddings WHERE vec_id IN (7, 9)) q, LATERAL knn(CAST(q.embedding AS ARRAY<DOUBLE>), 5) n"
    found = sqlgate.search(gate, lateral).collect()
    assert [r["b"] for r in found if r["a"] == 7] == [r["vec_id"] for r in one.collect()] and len(found) == 10
    want = vector.knn(gate.table("embeddings"), model.embed(["a topic"])[0], 3)
    assert {r["vec_id"] for r in got.collect()} == {r["vec_id"] for r in want.collect()}
    with pytest.raises(sqlgate.Denied):
        sqlgate.rewrite("SELECT 1 FROM nation WHERE embedding MATCH array(1) AND k = 3")
    sqlgate.register_names(gate)
    row = gate.sql("SELECT json_extract('{\"a\": {\"b\": 1}}', '$.a.b') AS j, if(true, 'x', 'y') AS i, glob('a*c', 'abc') AS g, julianday(TIMESTAMP '2000-01-01 12:00:00') AS d").first()
    assert tuple(row) == ("1", "x", True, 2451545.0)


def test_models(spark):
    df = spark.createDataFrame([("the cat", ), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(providers.embed_column(providers.HashingEmbedder)(F.col("t"))).collect()]
    assert len(got[0]) == 384 and got[1:] == [[], []]
    providers.register(spark)
    assert spark.sql("SELECT rerank_score('a b', 'b c') AS s").first()["s"] == 0.5
    errors = spark.createDataFrame([(429,), (404,), (400,), (503,), (415,), (504,)], "s int").select(providers.http_error_class(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in errors] == ["retryable_rate_limit", "permanent_not_found", "permanent_validation", "retryable_io", "permanent_unsupported", "retryable_timeout"]


def test_batch_search_beyond_one_block(spark, small, monkeypatch):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    want = sorted(map(tuple, vector.knn_batch(e, q, 4).collect()))
    monkeypatch.setattr(vector, "QUERIES_AT_ONCE", 1)
    assert sorted(map(tuple, vector.knn_batch(e, q, 4).collect())) == want and vector.knn_batch(e, q.limit(0), 4).count() == 0


def test_batch_search_breaks_ties_by_id_in_large_groups_of_copies(spark):
    rng = random.Random(4)
    near, far = [0.1, 0.3, 0.7], [rng.random() + 5 for _ in range(3)]
    rows = [(i, near if i < 2000 else far) for i in rng.sample(range(3000), 3000)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    q = e.where("vec_id IN (5, 2999)")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vector.knn_batch(e, q, 10).collect())
    assert got == [(5, n + 1, n) for n in range(10)] + [(2999, n + 1, 2000 + n) for n in range(10)]
    twice = vector.knn_batch(e.where("vec_id < 3").unionByName(e.where("vec_id < 3")), q, 4).where("query_id = 5").orderBy("rank").collect()
    assert [r["vec_id"] for r in twice] == [0, 0, 1, 1]


def test_extraction_isolates_bad_files(spark):
    files = spark.createDataFrame([("a", b"page one\x0cpage two"), ("b", b"\xff\xfe"), ("c", b"-")], "path string, content binary")
    got = {r["path"]: (r["extraction_status"], r["extracted_text"], r["error_class"]) for r in S.extracted(files, providers.PlainTextExtractor).collect()}
    assert got == {"a": ("ready", "page one\n\npage two", None), "b": ("error", None, "permanent_validation"), "c": ("error", None, "permanent_validation")}


def test_streams_restart_where_they_were(spark, tmp_path):
    schema_ = "path string, content binary"
    one = lambda n: spark.createDataFrame([(n, n.encode())], schema_).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def go():
        stream = S.extracted(S.event_stream(spark, f"{tmp_path}/in", schema_), providers.PlainTextExtractor)
        S.poll(stream, lambda df, n: seen.append((n, sorted(r["path"] for r in df.collect()))), f"{tmp_path}/check").awaitTermination()

    one("a")
    go()
    one("b")
    go()
    go()
    assert [paths for _, paths in seen] == [["a"], ["b"]]


def test_windowed_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    counts = S.tumbling_counts(S.event_stream(spark, f"{small}/events.parquet*", events.schema))
    counts.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/lib")
    assert store.read("jobs").count() == 0 and not store.exists("jobs")
    store.commit(jobs=job(spark), vectors=spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<float>"))
    for _ in range(3):
        store.write("jobs", J.claim(store.read("jobs"), NOW, "w"))
    assert store.read("jobs").first()["status"] == "claimed" and len(store.versions("jobs")) == 4 and store.vacuum() == 2 and store.read("jobs").count() == 1
    with pytest.raises(KeyError):
        store.read("nothing")


def test_command_line(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    store = Store(spark, root)
    store.write("jobs", job(spark, rows=[{"id": "a", "status": "dead"}, {"id": "b", "status": "claimed", "claim_expires_at": NOW - timedelta(days=1)}, {"id": "c"}]))
    go = lambda *a: cli.run(cli.parser().parse_args(["--store", root, *a]), NOW)
    assert go("stats") == {"embedding": {"claimed": 1, "dead": 1, "queued": 1}}
    assert go("requeue-dead", "--limit", "5") == {"changed": 1} and go("cleanup-leases", "--queue", "embedding") == {"changed": 1} and go("cancel", "--entity-id", "1") == {"changed": 3}
    docs, files = legacy(spark)
    store.commit(documents=docs, document_files=files)
    assert go("migrate", "--dry-run")["reasons"] == go("migrate", "--dry-run")["reasons"] != []
    done = go("migrate")
    assert len(done["reasons"]) == 5 and done["jobs"] == {"embedding": 1, "extraction": 1} and go("migrate")["reasons"] == []
    assert store.read("jobs").where("job_type = 'extract_file'").first()["status"] == "queued"
    assert go("status")["summary"]["documents"] == 5


def test_opening_a_store_migrates_it(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    docs, files = legacy(spark)
    Store(spark, root).commit(documents=docs, document_files=files)
    store, report = migration.opened(spark, root, NOW)
    assert len(report["reasons"]) == 5 and "jobs" not in report and store.read("jobs").count() == 0
    assert store.read("documents").where("kind = 'pdf_chunk'").count() == 0 and migration.opened(spark, root, NOW)[1]["reasons"] == []


def test_settings_and_documentation():
    env = {"EMBED_DISABLED": "Yes", "QUEUE_LEASE_SECONDS": "3", "QUEUE_BATCH_SIZE": "x", "QUEUE_MAX_ATTEMPTS": "${N}", "EXTRACTION_BACKEND": " "}
    s = settings.load(env)
    assert s.embed_disabled and s.policy.lease_seconds == 15 and s.policy.batch_size == 32 and s.policy.max_attempts == 5 and s.extraction_backend == "local"
    assert "MATCH" in documentation.text("workflows") and "workflows" in documentation.text("?")


def test_previews(spark):
    class Squares:
        def sizes(self, content):
            return [(100.0, 50.0)] * len(content)

        def png(self, content, page, scale):
            return f"{page}:{scale}".encode()

    df = spark.createDataFrame([("a", b"123"), ("b", b"1")], "path string, content binary")
    got = [tuple(r) for r in pages.previews(df, Squares, 1, 2, 200).collect()]
    assert [(r[0], r[1], bytes(r[2]) if r[2] else None) for r in got] == [("a", 1, b"1:2.0"), ("a", 2, b"2:2.0"), ("b", None, None)]
    for wrong in ((0, None), (3, 2), (1, 11)):
        with pytest.raises(ValueError):
            pages.wanted(*wrong)
    assert pages.wanted(2, None, 5)[1] == 64 and pages.wanted(2)[0] == range(2, 3)


def test_schema_evolution(spark):
    old = spark.createDataFrame([(1, 1, "/a")], "id long, reference_id long, file_path string").withColumn("label", F.lit("x"))
    got = schema.evolved(old, "document_files")
    assert got.first()["storage_kind"] == "local" and got.columns[-1] == "label"
    assert schema.invalid(got.withColumn("extraction_status", F.lit("odd")), "extraction_status", schema.EXTRACTION_STATUS).count() == 1


def test_scratch(spark):
    assert scratch.cut(spark.range(3), "x").count() == 3
    path = scratch.new_path(spark, "x")
    assert spark.sparkContext.applicationId in path


def test_only_own_tables_are_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    other = tmp_path / "lectern" / "another-application"
    other.mkdir(parents=True)
    scratch.cut(spark.range(3), "x")
    own = tmp_path / "lectern" / spark.sparkContext.applicationId
    assert own.exists()
    scratch.release(spark)
    assert not own.exists() and other.exists()


def test_only_small_tables_are_dealt_out(spark, small, monkeypatch):
    from lectern import session

    df = spark.read.parquet(f"{small}/documents.parquet")
    dealt = lambda d: "Exchange" in d._jdf.queryExecution().executedPlan().toString()
    assert dealt(session.spread(df))
    monkeypatch.setattr(session, "SMALL", 10)
    assert not dealt(session.spread(df))


def test_files_are_located(spark, tmp_path):
    from lectern.sources import files

    rows = spark.createDataFrame([("local", "/a", None), ("s3", "/a", None), ("local", "", "/b"), (None, None, None)], "storage_kind string, file_path string, storage_uri string")
    assert [(r["path"], r["error_class"]) for r in files.located(rows).collect()] == [("/a", None), (None, "permanent_unsupported"), ("/b", None), (None, "permanent_not_found")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.pdf").write_bytes(b"1")
    assert [(r["path"], bytes(r["content"])) for r in files.contents(spark, str(tmp_path), pattern="*.pdf").collect()] == [(str(tmp_path / "x" / "one.pdf"), b"1")]
