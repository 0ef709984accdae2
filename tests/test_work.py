"""Rounds of the workers, chunk spans, and what the SQL front end rewrites."""

import base64
import json
import threading
import zlib
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F
from test_text import plain_chunks

from lectern import schema
from lectern.functions import html
from lectern.operators import chunking
from lectern.operators import jobs as J
from lectern.operators.providers import HashingEmbedder
from lectern.plans import sqlgate, work

NOW = datetime(2024, 5, 1, 12)


def extractor():
    """A class that workers get by value, as they cannot import the tests."""

    class Pages:
        name = "pages"

        def extract(self, path, content):
            if content == b"poison":
                raise ValueError("not a document")
            return content.decode().split("|")

    return Pages


def tables(spark, mimes):
    files = spark.createDataFrame([(i, 1, f"/f{i}", m) for i, m in enumerate(mimes)], "id long, reference_id long, file_path string, mime_type string")
    base = spark.createDataFrame([], schema.TABLES["jobs"])
    jobs = files.select(F.concat(F.lit("j"), "id").alias("id"), F.lit("extraction").alias("queue_name"), F.lit("extract_file").alias("job_type"), F.lit("document_file").alias("entity_type"), F.col("id").alias("entity_id"), F.concat(F.lit("extract_file:"), "id").alias("dedupe_key"), F.lit("queued").alias("status"), F.lit(100).alias("priority"), J.instant(NOW).alias("available_at"), F.lit(0).alias("attempts"), F.lit(5).alias("max_attempts"), J.instant(NOW).alias("created_at"), J.instant(NOW).alias("updated_at"))
    return base.unionByName(jobs, allowMissingColumns=True), schema.evolved(files, "document_files"), spark.createDataFrame([], schema.TABLES["documents"])


def test_extraction_then_embedding(spark):
    pdf = "application/pdf"
    jobs, files, docs = tables(spark, [pdf, pdf, "text/html", pdf, pdf])
    contents = spark.createDataFrame([("/f0", b"alpha page one|omega page two"), ("/f1", b"poison"), ("/f2", b"<p>"), ("/f4", b"-")], "path string, content binary")
    got = work.extract(jobs, files, docs, contents, extractor(), NOW)
    assert {r["id"]: (r["extraction_status"], r["extraction_backend"]) for r in got.files.collect()} == {0: ("ready", "pages"), 1: ("error", "pages"), 2: ("skipped", "pages"), 3: ("error", "pages"), 4: ("error", "pages")}
    assert {r["id"]: r["status"] for r in got.jobs.where("queue_name = 'extraction'").collect()} == {"j0": "succeeded", "j1": "dead", "j2": "succeeded", "j3": "dead", "j4": "dead"}
    error = {r["id"]: r["extraction_error"] for r in got.files.collect()}
    assert "does not support mime type" in error[2] and error[4] == "normalized extraction is empty"
    chunk = got.documents.first()
    assert chunk["content"] == "alpha page one\n\nomega page two" and json.loads(chunk["metadata_json"])["loc"] == {"page_start": 1, "page_end": 2} and chunk["document_file_id"] == 0
    outcomes = {r["job_id"]: (r["outcome"], r["error_class"], r["attempt_no"]) for r in got.attempts.collect()}
    assert outcomes["j1"] == ("permanent_fail", "permanent_validation", 1) and outcomes["j3"][1] == "permanent_not_found" and outcomes["j0"] == ("succeeded", None, 1)
    waiting = got.jobs.where("queue_name = 'embedding'")
    assert [(r["status"], r["entity_id"]) for r in waiting.collect()] == [("queued", chunk["id"])]
    none = spark.createDataFrame([], schema.TABLES["vectors"])
    done = work.embed(got.jobs, got.documents, none, HashingEmbedder, NOW + timedelta(seconds=1))
    assert [(r["doc_id"], len(r["embedding"])) for r in done.vectors.collect()] == [(chunk["id"], 384)]
    assert done.documents.first()["embedding_status"] == "ready" and {r["status"] for r in done.jobs.where("queue_name = 'embedding'").collect()} == {"succeeded"}
    # a second round finds nothing to do
    again = work.extract(done.jobs, got.files, done.documents, contents, extractor(), NOW + timedelta(seconds=2))
    assert again.attempts.count() == 0 and again.documents.count() == 1 and again.jobs.count() == done.jobs.count()


def test_an_expired_claim_is_done_again(spark):
    jobs, files, docs = tables(spark, ["application/pdf"])
    jobs = jobs.withColumn("available_at", J.instant(NOW - timedelta(hours=2)))
    stuck = J.claim(jobs, NOW - timedelta(hours=1), "gone")
    got = work.extract(stuck, files, docs, spark.createDataFrame([("/f0", b"text")], "path string, content binary"), extractor(), NOW)
    row = got.jobs.where("id = 'j0'").first()
    assert (row["status"], row["attempts"]) == ("succeeded", 2) and got.attempts.first()["attempt_no"] == 2


def test_blank_documents_fail(spark):
    jobs, _, _ = tables(spark, ["x"])
    jobs = jobs.withColumn("queue_name", F.lit("embedding"))
    docs = schema.evolved(spark.createDataFrame([(0, 1, "note", "\n")], "id long, reference_id long, kind string, content string"), "documents")
    done = work.embed(jobs, docs, spark.createDataFrame([], schema.TABLES["vectors"]), HashingEmbedder, NOW)
    assert done.documents.first()["embedding_status"] == "error" and done.jobs.first()["status"] == "dead" and done.vectors.count() == 0


def test_spans_are_where_the_pieces_stand(spark):
    texts = ["alpha beta.\n\ngamma delta.", "  One two three. Four! \n\n\n Five six?  seven " * 4, "short", "x" * 50, "", "a.b.c.d " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = chunking.chunks(df, "id", "t", 5, spans=True).orderBy("id", "chunk_index").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r["id"] == i]
        assert [r["content"] for r in own] == plain_chunks(t, 20)
        covered = set()
        for r in own:
            assert "".join(t[r["start"] : r["end"]].split()) == "".join(r["content"].split())
            assert covered.isdisjoint(range(r["start"], r["end"]))
            covered |= set(range(r["start"], r["end"]))
        assert all(k in covered or t[k].isspace() for k in range(len(t)))


def test_articles_come_first_for_whole_pages(spark):
    class Article:
        def markdown(self, text):
            return None if "hard" in text else "# found"

        def recall(self, text):
            return "recalled"

    df = spark.createDataFrame([("<html><body>x</body></html>",), ("<html><body>hard</body></html>",), ("<p>note</p>",), ("",)], "h string")
    got = [tuple(r["x"]) for r in df.select(html.with_article(Article)(F.col("h")).alias("x")).collect()]
    assert got == [("# found", "trafilatura_markdown"), ("recalled", "trafilatura_recall"), ("note", "html_fallback"), (None, "empty")]


def test_names_of_other_engines(spark):
    spark.createDataFrame([("a", 1), ("b", None)], "k string, v int").createOrReplaceTempView("kv")
    row = sqlgate.search(spark, "SELECT group_concat(k, '-') AS g, total(v) AS t, strftime('%Y/%m', max(TIMESTAMP '2024-03-01 00:00:00')) AS d FROM kv").first()
    assert (sorted(row["g"].split("-")), row["t"], row["d"]) == (["a", "b"], 1.0, "2024/03")


def pdf(pages, packed=False):
    """A small PDF: one Latin font, and one with a map to Unicode."""
    chart = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00E9> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<6F22> <5B57>] endbfrange"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [%s] >>" % b" ".join(b"%d 0 R" % (10 + i) for i in range(len(pages))), 3: b"<< /Type /Font >>", 4: b"<< /Type /Font /ToUnicode 5 0 R >>", 5: b"<< >>\nstream\n" + chart + b"\nendstream"}
    for i, content in enumerate(pages):
        objects[10 + i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (100 + i)
        objects[100 + i] = b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(content) + b"\nendstream"
    if packed:
        some = {k: objects.pop(k) for k in (1, 2, 3)}
        head, body = b"", b""
        for k, v in some.items():
            head, body = head + b"%d %d " % (k, len(body)), body + v + b" "
        objects[200] = b"<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >>\nstream\n" % len(head) + zlib.compress(head + body) + b"\nendstream"
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"%%EOF"


def test_pdf_texts(spark):
    from lectern.sources.pdf import PdfTextExtractor
    from lectern.streaming.queue import extracted

    one = rb"BT /F1 12 Tf 72 700 Td (Hello \(a\) w\366rld) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* <4142> Tj ET"
    two = b"BT /F2 9 Tf 1 0 0 1 0 0 Tm <0010001100120001> Tj 5 0 Td <00200021> Tj ET"
    want = ["Hello (a) wörld\nsecond line\nAB", "abcé 漢字"]
    for packed in (False, True):
        assert PdfTextExtractor().extract("x", pdf([one, two], packed)) == want
    files = spark.createDataFrame([("a", pdf([one, two])), ("b", b"plain"), ("c", pdf([]))], "path string, content binary")
    got = {r["path"]: (r["extraction_status"], r["extracted_text"], r["error_message"]) for r in extracted(files, PdfTextExtractor).collect()}
    assert got["a"] == ("ready", "Hello (a) wörld second line AB\n\nabcé 漢字", None)
    assert got["b"] == ("error", None, "not a PDF") and got["c"][0] == "error"


def test_remote_extraction(spark):
    from lectern.operators.providers import RemoteExtractor, extract_or_error

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            content = base64.b64decode(body["contents"][0]["parts"][0]["inline_data"]["data"])
            asked.append((self.path, self.headers["x-goog-api-key"], content))
            code = {b"busy": 429, b"bad": 400, b"gone": 404, b"down": 503}.get(content, 200)
            parts = [] if content == b"none" else [{"text": "# Title"}, {"text": content.decode()}]
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"candidates": [{"content": {"parts": parts}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}/v1beta/"
        files = spark.createDataFrame([(c.decode(), c) for c in (b"fine", b"busy", b"bad", b"gone", b"down", b"none")], "path string, content binary").coalesce(1)
        got = {r["path"]: (r["page_texts"], r["error_class"]) for r in extract_or_error(files, lambda: RemoteExtractor(address, "m", "secret")).collect()}
    finally:
        server.shutdown()
    assert got["fine"] == (["# Title\nfine"], None) and asked[0] == ("/v1beta/models/m:generateContent", "secret", b"fine")
    assert {k: v[1] for k, v in got.items() if v[1]} == {"busy": "retryable_rate_limit", "bad": "permanent_validation", "gone": "permanent_not_found", "down": "retryable_io", "none": "permanent_validation"}
