"""Text as columns: white space, normalisation, sentences, paragraphs and page ranges, in Spark expressions. Only running sums of
lengths leave them, as an expression can only build an array by copying it at each element."""

from __future__ import annotations

from mimetypes import MimeTypes

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode text knows it, and line breaks (fixed values).
WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LB = r"\r\n|[\x{A}-\x{D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
SENTENCE = r"[^.!?]*[.!?]|[^.!?]+\z"
CHARS_PER_TOKEN = 4.0
TARGET_TOKENS = 512
PDF = "application/pdf"
#: Extensions that a missing MIME type is guessed from: those of the standard library, whatever the machine's own files say.
MIME_BY_EXTENSION = {e[1:]: m for e, m in sorted(MimeTypes().types_map[True].items())}

#: The characters of WS.
_SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """Without white space, of any kind, at either end. Only the ends are looked at, as no regular expression would."""
    return F.btrim(c, F.lit(_SPACES))


def is_blank_sql(c: Column) -> Column:
    """What SQL's TRIM calls blank: null or blanks (U+0020) only."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def is_blank_text(c: Column) -> Column:
    """What text processing calls blank: null or white space of any kind."""
    return F.coalesce(strip(c) == "", F.lit(True))


def normalize_content(c: Column) -> Column:
    """Stripped, and null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def canonical_mime(c: Column) -> Column:
    m = F.nullif(F.lower(strip(c)), F.lit(""))
    return F.when(m == "application/x-pdf", F.lit(PDF)).otherwise(m)


def guessed_mime(mime: Column, path: Column) -> Column:
    """The canonical MIME type, or else that of the path's extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    known = F.create_map(*(F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair))
    return F.coalesce(canonical_mime(mime), F.try_element_at(known, extension))


def _normal_block(block: Column) -> Column:
    lines = F.filter(F.transform(F.split(block, LB), strip), lambda x: x != "")
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"-(\n|\z)", "")
    return strip(F.regexp_replace(joined, rf"{WS}+", " "))


def normalize_extracted(c: Column) -> Column:
    """Paragraphs on one line each: words that a line break hyphenates are joined, other line breaks and runs of white space become one blank."""
    text = F.regexp_replace(c, r"\r\n|\r", "\n")
    return F.array_join(F.filter(F.transform(F.split(text, r"\n\n"), _normal_block), lambda x: x != ""), "\n\n")


def normalize_pages(pages: Column) -> Column:
    """Each page on its own."""
    return F.transform(pages, normalize_extracted)


def sentences(c: Column) -> Column:
    """A cut after every full stop, exclamation or question mark; the tail is kept, blank ones are not."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), 0), strip), lambda x: x != "")


def _lead(c: Column) -> Column:
    return F.length(c) - F.length(F.ltrim(c, F.lit(_SPACES)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def running(sizes: pd.Series) -> pd.Series:
    """Running sums of each array; null for null."""
    return sizes.map(lambda x: None if x is None else np.cumsum(x))


def _spans(parts: Column, gap: int) -> Column:
    """array<struct<piece, start, end>> of the stripped parts of a text that stand `gap` characters apart, blank ones left out; code points, end exclusive."""
    after = running(F.transform(parts, lambda p: (F.length(p) + gap).cast("long")))
    at = lambda p, end: end - gap - F.length(p) + _lead(p)
    spans = F.zip_with(parts, after, lambda p, end: F.struct(strip(p).alias("piece"), at(p, end).alias("start"), (at(p, end) + F.length(strip(p))).alias("end")))
    return F.filter(spans, lambda s: s["piece"] != "")


def paragraph_spans(c: Column) -> Column:
    """array<struct<piece, start, end>> of paragraphs."""
    return _spans(F.split(c, r"\n\n"), 2)


def sentence_spans(c: Column) -> Column:
    """array<struct<piece, start, end>> of sentences."""
    return _spans(F.regexp_extract_all(c, F.lit(SENTENCE), 0), 0)


def page_ends(pages: Column) -> Column:
    """array<struct<p, e>>: for each page the first offset of "\\n\\n".join(pages) that is past it; the gap after a page is the next one's."""
    return F.transform(running(F.transform(pages, lambda p: (F.length(p) + 2).cast("long"))), lambda e, i: F.struct((i + 1).alias("p"), (e - 2).alias("e")))


def page_of(ends: Column, offset: Column) -> Column:
    """Page of an offset; past the end, the last one."""
    found = F.filter(ends, lambda x: x["e"] > offset)
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))["p"]).otherwise(F.size(ends))


def page_range(ends: Column, start: Column, end: Column) -> Column:
    """struct<page_start, page_end>; null without pages or for an empty span."""
    some = (F.size(ends) > 0) & (F.get(ends, F.size(ends) - 1)["e"] > 0) & (end > start)
    return F.struct(F.when(some, page_of(ends, start)).alias("page_start"), F.when(some, page_of(ends, end - 1)).alias("page_end"))


def looks_like_full_html(c: Column) -> Column:
    low = F.lower(F.ltrim(c, F.lit(_SPACES)))
    head = F.substring(low, 1, 2048)
    return F.coalesce(low.startswith("<!doctype html") | low.startswith("<html") | low.startswith("<?xml") | (head.contains("<html") & (head.contains("<body") | head.contains("</html>"))), F.lit(False))


def annotation_content(highlighted: Column, comment: Column) -> Column:
    """A quoted highlight and a comment, or whichever there is, or null."""
    text, note = normalize_content(highlighted), normalize_content(comment)
    quoted = F.concat(F.lit("Highlighted text:\n"), F.array_join(F.transform(F.split(text, LB), lambda x: F.concat(F.lit("> "), x)), "\n"))
    return F.nullif(F.concat_ws("\n\n", quoted, F.concat(F.lit("Annotation comment:\n"), note)), F.lit(""))


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and without blanks; null if no field is given."""
    if not fields:
        return F.lit(None).cast("string")
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
