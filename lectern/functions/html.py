"""Text of HTML by the standard parser: break tags become line breaks, all character data is kept."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import looks_like_full_html

#: Tags around which lines break (fixed values).
BREAKS = frozenset(("p", "br", "div", "li", "ul", "ol", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th"))

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("mode", T.StringType())])


class _Events(HTMLParser):
    """What markup holds, in order: (whether it is a tag, its name or the character data)."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[bool, str]] = []
        self.feed(markup)

    def _tag(self, name: str, *_) -> None:
        self.found.append((True, name))

    handle_starttag = handle_endtag = _tag

    def handle_data(self, data: str) -> None:
        self.found.append((False, data))


#: White space that is put right, one rule after the other (fixed values).
TIDY = [(re.compile(r"[ \t]+\n"), "\n"), (re.compile(r"\n{3,}"), "\n\n")]


#: An ampersand that begins no character reference which a semicolon closes.
_OPEN = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def html_to_text(html: str | None, closed: bool = False) -> str | None:
    """None for None and for what holds no text. The parser also reads old names that no semicolon closes (&amp, even in &amputated);
    with `closed` these stay as they are, as in a page that was cut short inside of one."""
    html = html or ""
    # what stands for such an ampersand while the page is parsed, scripts included: a code point that is no character, and not in the page
    stand_in = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in html), "&") if closed else "&"
    text = "".join("\n" if tag else value for tag, value in _Events(_OPEN.sub(stand_in, html) if closed else html).found if not tag or value in BREAKS)
    text = text.replace(stand_in, "&")
    for pattern, by in TIDY:
        text = pattern.sub(by, text)
    return text.strip() or None


def _fallback(closed: bool):
    @F.pandas_udf(RESULT)
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in parts:
            texts = [html_to_text(x, closed) for x in html]
            yield pd.DataFrame({"text": texts, "mode": ["html_fallback" if t else "empty" for t in texts]})

    return extract


#: text, and the mode by which it was found (html_fallback, or empty); the second leaves character references alone that no semicolon closes.
extract_html, extract_html_closed = _fallback(False), _fallback(True)


@F.pandas_udf(T.StringType())
def note_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in parts:
        yield html.map(html_to_text)


class Article(Protocol):
    """A library that finds the main text of a whole page."""

    def markdown(self, html: str) -> str | None: ...

    def recall(self, html: str) -> str | None: ...


#: Ways to the text of HTML by the mode that is reported, best first; the first two need an article extractor, for whole pages.
WAYS: list[tuple[str, bool, Callable[[Article, str], str | None]]] = [
    ("trafilatura_markdown", True, lambda article, html: article.markdown(html)),
    ("trafilatura_recall", True, lambda article, html: article.recall(html)),
    ("html_fallback", False, lambda _, html: html_to_text(html)),
]


def _by_article(article: Article, html: str | None, whole: bool) -> tuple[str | None, str]:
    for mode, pages_only, way in WAYS:
        text = (way(article, html) or "").strip() if html and (whole or not pages_only) else ""
        if text:
            return text, mode
    return None, "empty"


def with_article(make: Callable[[], Article], always: bool = False) -> Callable[[Column], Column]:
    """As extract_html, but whole pages (or, if asked, all HTML) go to an article extractor first; the mode says what the text came from."""

    @F.pandas_udf(RESULT)
    def extract(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        article = make()
        for pages, whole in parts:
            yield pd.DataFrame([_by_article(article, *row) for row in zip(pages, whole, strict=True)], columns=["text", "mode"])

    return lambda c: extract(c, F.lit(True) if always else looks_like_full_html(c))
