"""Pluggable models: what an embedder, a reranker and an extractor have to offer, offline versions, and their use in plans."""

from __future__ import annotations

import json
from base64 import b64encode
from collections.abc import Callable, Iterator
from hashlib import md5
from typing import Protocol
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    name: str
    version: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    name: str

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Extractor(Protocol):
    name: str

    def extract(self, path: str, content: bytes) -> list[str]:
        """Texts of the pages; raises for what it cannot read."""


class HashingEmbedder:
    """Unit vectors of signed hashed words and word pairs: deterministic, and near for texts that share words."""

    name, version = "hashing", "1"

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()
            for gram in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = int.from_bytes(md5(gram.encode(), usedforsecurity=False).digest()[:4], "big")
                row[h % self.dim] += 1 if h & (1 << 31) else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32).tolist()


class OverlapReranker:
    name = "overlap"

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            q = set(query.lower().split())
            out.append(len(q & set(text.lower().split())) / len(q) if q else 0.0)
        return out


#: Texts that a model gets at once: what it returns for them, in Python's own numbers, is many times a vector's size.
STEP = 256


def embed_column(make: Callable[[], Embedder]) -> Callable[[Column], Column]:
    """A column function; the model is made once in each worker and gets STEP texts at a time. Null and empty texts give an empty vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in parts:
            for at in range(0, len(batch), STEP):
                texts = batch.iloc[at : at + STEP]
                some = texts.notna() & (texts != "")
                got = iter(model.embed(texts[some].tolist()) if some.any() else [])
                yield pd.Series([np.asarray(next(got) if x else [], np.float32) for x in some], dtype=object)

    return embed


def rerank_column(make: Callable[[], Reranker]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def rerank(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for queries, texts in parts:
            for at in range(0, len(texts), STEP):
                query, text = queries.iloc[at : at + STEP].fillna(""), texts.iloc[at : at + STEP].fillna("")
                yield pd.Series(model.score(list(zip(query, text, strict=True))), dtype=float)

    return rerank


def register(spark: SparkSession, embedder: Callable[[], Embedder] = HashingEmbedder, reranker: Callable[[], Reranker] = OverlapReranker) -> None:
    spark.udf.register("embed", embed_column(embedder))
    spark.udf.register("rerank_score", rerank_column(reranker))


#: Exceptions to error classes (what is none of these may be tried again).
ERROR_CLASS = [(FileNotFoundError, "permanent_not_found"), (NotImplementedError, "permanent_unsupported"), (TimeoutError, "retryable_timeout"), (ValueError, "permanent_validation"), (OSError, "retryable_io")]


#: HTTP status to error class; other 4xx are refusals for good, the rest may be tried again.
STATUS_CLASS = {429: "retryable_rate_limit", 408: "retryable_timeout", 504: "retryable_timeout", 404: "permanent_not_found", 415: "permanent_unsupported"}


def error_class(e: BaseException) -> str:
    if isinstance(e, HTTPError):
        return STATUS_CLASS.get(e.code, "permanent_validation" if 400 <= e.code < 500 else "retryable_io")
    return next((name for kind, name in ERROR_CLASS if isinstance(e, kind)), "retryable_io")


def http_error_class(status: Column) -> Column:
    named = F.coalesce(*(F.when(status == code, F.lit(name)) for code, name in STATUS_CLASS.items()))
    return F.coalesce(named, F.when(status.between(400, 499), F.lit("permanent_validation")), F.lit("retryable_io"))


def extract_or_error(files: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """path, page_texts, error_class, error_message of binary files (path, content): a bad file is a row with an error and never fails the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            pages: list[list[str] | None] = []
            errors: list[tuple[str | None, str | None]] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages.append(model.extract(path, content or b""))
                    errors.append((None, None))
                except Exception as e:  # noqa: BLE001
                    pages.append(None)
                    errors.append((error_class(e), str(e)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.list_(pa.string())), pa.array([e[0] for e in errors], pa.string()), pa.array([e[1] for e in errors], pa.string())], ["path", "page_texts", "error_class", "error_message"])

    return files.select("path", "content").mapInArrow(run, "path string, page_texts array<string>, error_class string, error_message string")


class PlainTextExtractor:
    """Pages between form feeds; anything that is not UTF-8 is refused."""

    name = "plain"

    def extract(self, path: str, content: bytes) -> list[str]:
        try:
            return content.decode("utf-8").split("\f")
        except UnicodeDecodeError:
            raise ValueError(f"not a text: {path}") from None


class RemoteExtractor:
    """A model behind an HTTP service of the generateContent form, asked for a document's text as Markdown: one request a file, which holds the file. What it answers is one page."""

    name = "remote"
    ASK = "Give the whole text of this document as Markdown, with its headings, lists, tables and formulas, and nothing else."

    def __init__(self, endpoint: str, model: str, key: str, mime_type: str = "application/pdf", seconds: float = 300) -> None:
        self.url = f"{endpoint.rstrip('/')}/models/{model}:generateContent"
        self.key, self.mime_type, self.seconds = key, mime_type, seconds

    def extract(self, path: str, content: bytes) -> list[str]:
        parts = [{"inline_data": {"mime_type": self.mime_type, "data": b64encode(content).decode()}}, {"text": self.ASK}]
        body = json.dumps({"contents": [{"role": "user", "parts": parts}]}).encode()
        with urlopen(Request(self.url, body, {"Content-Type": "application/json", "x-goog-api-key": self.key}), timeout=self.seconds) as answer:
            told = json.load(answer)
        texts = [p["text"] for c in (told.get("candidates") or [])[:1] for p in c.get("content", {}).get("parts", []) if p.get("text")]
        if not texts:
            raise ValueError(f"no text for {path}")
        return ["\n".join(texts)]
