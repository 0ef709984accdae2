"""Texts to chunks with spans and page ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

_SENTENCE = re.compile(T.SENTENCE.replace(r"\z", r"\Z"))


def _stripped(part: str, start: int) -> tuple[str, int]:
    text = part.strip()
    return text, start + len(part) - len(part.lstrip()) if text else start


def pieces(text: str, most: int) -> Iterator[tuple[str, str, bool, int]]:
    """What the packer packs: paragraphs that fit, or the sentences of those that do not, each with its separator, whether a chunk must start there, and its place."""
    at = 0
    for part in text.split("\n\n"):
        paragraph, start = _stripped(part, at)
        at += len(part) + 2
        if not paragraph:
            continue
        if len(paragraph) <= most:
            yield paragraph, "\n\n", False, start
            continue
        first = True
        for m in _SENTENCE.finditer(paragraph):
            sentence, place = _stripped(m[0], start + m.start())
            if sentence:
                yield sentence, " ", first, place
                first = False


def packed(text: str, most: int) -> Iterator[tuple[str, int, int]]:
    """(content, start, end) of a text's chunks: a new one starts where a piece must, or where it would not fit any more. A text that fits is one chunk, as it is."""
    if len(text) <= most:
        yield text, 0, len(text)
        return
    held, size, begin, end = [], 0, 0, 0
    for piece, gap, must, start in pieces(text, most):
        if held and (must or size + len(gap) + len(piece) > most):
            yield "".join(held), begin, end
            held, size = [], 0
        if held:
            held.append(gap)
            size += len(gap)
        else:
            begin = start
        held.append(piece)
        size, end = size + len(piece), start + len(piece)
    if held:
        yield "".join(held), begin, end


def chunks(documents: DataFrame, id_col: str, text_col: str, target_tokens: int = T.TARGET_TOKENS, spans: bool = False) -> DataFrame:
    """id, chunk_index, content, and with spans also start and end (of the first and the last piece, in the text; code points). Null texts give none.

    One pass over the texts, each by itself: where a chunk ends depends on where the one before did, which an expression can only
    follow by copying what it has at each piece."""
    most = int(target_tokens * T.CHARS_PER_TOKEN)
    names = ["id", "chunk_index", "content", "start", "end"][: 5 if spans else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = list(enumerate(packed(text, most)))
                ids += [i] * len(own)
                rows += [(k, *c) for k, c in own]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns[: len(names) - 1]], names)

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, chunk_index int, content string" + ", start int, end int" * spans)


def chunk_or_error(documents: DataFrame, id_col: str, text_col: str, target_tokens: int = T.TARGET_TOKENS) -> DataFrame:
    """As chunks(), with a row that says why for each text that gives none or a blank one."""
    blank = documents.where(T.is_blank_text(F.col(text_col))).select(F.col(id_col).alias("id"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("content"), F.lit("permanent_validation").alias("error_class"), F.lit("normalized extraction is empty").alias("error_message"))
    good = chunks(documents.where(~T.is_blank_text(F.col(text_col))), id_col, text_col, target_tokens)
    none = F.lit(None).cast("string")
    return blank.unionByName(good.select("id", "chunk_index", "content", none.alias("error_class"), none.alias("error_message")))


def page_rows(documents: DataFrame, id_col: str, pages_col: str) -> DataFrame:
    """id, page and stop: of each page the first offset of the joined pages that is past it. Only lengths of pages go on from here."""
    return documents.select(F.col(id_col).alias("id"), F.inline(T.page_ends(F.col(pages_col)))).select("id", F.col("p").alias("page"), F.col("e").alias("stop"))


def page_ranges(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """id, start, end, page_start, page_end of distinct spans (id, start, end) over pages (id, page, stop): null without pages or for an empty span.

    One merge of both, sorted by place from the end of each document: the last page that was passed before an offset holds it,
    and past the last page's end it is that page. The cost is in spans plus pages."""
    ends = F.array(F.struct(F.lit(True).alias("first"), F.col("start").cast("long").alias("place")), F.struct(F.lit(False).alias("first"), (F.col("end") - 1).cast("long").alias("place")))
    offsets = spans.select("id", "start", "end").distinct().select("id", "start", "end", F.inline(ends))
    rows = offsets.unionByName(pages.select("id", F.col("stop").cast("long").alias("place"), "page"), allowMissingColumns=True)
    so_far = Window.partitionBy("id").orderBy(F.desc("place"), F.col("page").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("id")
    at = F.coalesce(F.last("page", ignorenulls=True).over(so_far), F.max("page").over(whole))
    found = rows.withColumn("at", at).withColumn("size", F.max(F.when(F.col("page").isNotNull(), F.col("place"))).over(whole)).where("first IS NOT NULL")
    some = lambda first: F.max(F.when((F.col("size") > 0) & (F.col("end") > F.col("start")) & (F.col("first") == first), F.col("at")))
    return found.groupBy("id", "start", "end").agg(some(True).alias("page_start"), some(False).alias("page_end"))


def with_pages(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_start and page_end to spans (id, start, end and others)."""
    return spans.join(page_ranges(spans, pages), ["id", "start", "end"], "left").select(*spans.columns, "page_start", "page_end")
