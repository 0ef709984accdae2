"""Language identification by error-correcting output codes.

Each language has a codeword; each column of the code splits the languages in two, and a binary classifier over hashed
character n-grams (1 to 3, letters only, case folded) predicts that bit. Up to six languages use the exhaustive code,
more a seeded random code with rows far apart. Decoding is loss-weighted: the distance to a codeword is the sum over
bits of the logistic loss of the bit's margin, each weighted by how well that bit's classifier did for that language on
a fold that it was not fitted on. The nearest codeword wins; a text whose two nearest ones are close is ambiguous.

The classifiers are fitted on a bounded sample of labelled documents: of each language the `per_language` documents with
the smallest hashes of their doc_id, fewer if there are so many languages that these would be more than `most_rows` in all, but never
fewer than four. So each language is learnt, however many rows it has; of more than `most_rows` / 4 languages, the ones
with the most documents. Prediction looks at whole texts and at nothing else.

Nulls: a null text, or one without a letter, is `und` with score 0 and not ambiguous; a null lang is no label. A row with
null doc_id is predicted like others, is not held out and is not learnt from. Without any labelled row every text is
`und`. Repeated rows are predicted each; in fitting, rows with one doc_id and lang count once (the text that sorts first).
Ties: of languages that are equally near, the one that sorts first wins, and the text is ambiguous. Very long texts are
read whole, one at a time and in parts. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import STEP_BYTES, arrow_ready, column_bytes, part_of, steps, unused

PER_LANGUAGE = 400
MOST_ROWS = 6000
BUCKETS = 4096
#: Texts whose features are held at once.
TEXTS = 256
#: A text is ambiguous if the runner-up has at least this share of the winner's and its own weight.
AMBIGUOUS = 0.4
UNDETERMINED = "und"


def fold(col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col(col).cast("string")) % of


_letters: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters["is"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters["is"]


def _counted(c: np.ndarray, row: np.ndarray, x: np.ndarray, buckets: int, old: int = 0) -> None:
    """Adds to x (a row of buckets for each text) the n-grams of the characters c that are in rows of texts, but for those that end among the first `old`."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        h = h[: max(0, len(c) - n + 1)] * np.uint64(0x100000001B3) + (c[n - 1 :] + np.uint64(n << 21))
        here = row[: len(h)]
        same = (here == row[n - 1 :]) & (np.arange(len(h)) + n > old)
        x += np.bincount(here[same] * buckets + ((h[same] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), minlength=len(x))


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at a blank, where there is one, and at a character in any case. (Only a sigma where a word of such length is cut may be folded otherwise.)"""
    at = 0
    while at < len(text):
        stop = text.rfind(b" ", at, at + STEP_BYTES) + 1
        if not stop:
            stop = at + STEP_BYTES
            while stop < len(text) and text[stop] & 0xC0 == 0x80:
                stop += 1
        yield text[at:stop]
        at = stop


def _long_counts(text: bytes, buckets: int) -> tuple[np.ndarray, int]:
    """The n-gram counts of one long text, part by part, and its letters: what a whole pass would count."""
    is_letter, x = _letter_table(), np.zeros(buckets)
    n_letters, tail, after_letter = 0, np.zeros(0, np.uint64), False
    for part in (*_parts(text), b" "):
        c = np.frombuffer(part.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter[c]
        n_letters += int(letter.sum())
        keep = letter | np.concatenate(([after_letter], letter[:-1]))
        c, after_letter = np.where(letter, c, 0x20).astype(np.uint64)[keep], bool(letter[-1])
        joined = np.concatenate((tail, c))
        _counted(joined, np.zeros(len(joined), np.int64), x, buckets, len(tail))
        tail = joined[-2:]
    return x, n_letters


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of square-rooted n-gram counts, and the number of letters, of at most TEXTS texts."""
    if len(texts) == 1 and len(texts[0]) > STEP_BYTES:
        x, n = _long_counts(texts[0], buckets)
        n_letters = np.array([n])
    else:
        is_letter = _letter_table()
        whole = [t.decode("utf-8", "replace").lower() for t in texts]
        sizes = np.array([len(t) + 2 for t in whole])
        c = np.frombuffer("".join(f" {t} " for t in whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        letter = is_letter[c]
        n_letters = np.bincount(row[letter], minlength=len(texts))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of runs of other characters only the first counts
        x = np.zeros(len(texts) * buckets)
        _counted(np.where(letter, c, 0x20).astype(np.uint64)[keep], row[keep], x, buckets)
    x = np.sqrt(x.reshape(len(texts), buckets)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), n_letters


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1."""
    if n <= 6:
        columns = [[1] + [1 if i in chosen else -1 for i in range(1, n)] for k in range(n - 1) for chosen in combinations(range(1, n), k)]
        return np.array(columns, float).reshape(-1, n).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        least = ((code[:, None] != code[None]).sum(2) + np.eye(n) * 1e9).min()
        if least > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, least
    return best


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Logistic regressions with a bias as last row, one for each column of y, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    ahead, step = w.copy(), 4 / 2
    for k in range(rounds):
        g = -(x.T @ (y / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))).astype(np.float32)) / len(x) + l2 * ahead
        new = ahead - step * g
        ahead, w = new + (k / (k + 3)) * (new - w), new
    return w


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the winner, its share, and whether the runner-up is close."""
        z = (x @ self.weights[:-1] + self.weights[-1]).astype(float)
        loss = np.logaddexp(0, -z[:, None, :] * self.code[None])
        distance = (loss * self.trust[None]).sum(2) * self.code.shape[1]
        p = np.exp(distance.min(1, keepdims=True) - distance)
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, axis=1)
        second = order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return p.argmax(1), order[:, -1], second / (second + order[:, -1]) > AMBIGUOUS


def fit(x: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    row = np.array([languages.index(k) for k in labels])
    if not code.shape[1]:
        return Model(languages, code, np.zeros((x.shape[1] + 1, 0), np.float32), np.zeros(code.shape))
    y, at = code[row], np.arange(len(row)) % 5 == 0
    trust = np.ones(code.shape)
    if (~at).sum() > 1:
        w = _fit(x[~at], y[~at], rounds=60)
        right = (np.sign(x[at] @ w[:-1] + w[-1]) == y[at]).astype(float)
        for k in range(len(languages)):
            trust[k] = (right[row[at] == k].sum(0) + 1) / ((row[at] == k).sum() + 1)
    return Model(languages, code, _fit(x, y), trust / trust.sum(1, keepdims=True))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in steps(column_bytes(batch, "text")):
            for k in range(0, len(texts), TEXTS):
                x, letters = features(texts[k : k + TEXTS])
                rows = [(np.flatnonzero(v).astype(np.int16), v[v != 0]) if n else ([], []) for v, n in zip(x, letters, strict=True)]
                part = batch.slice(at + k, len(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int16())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "lang", "at", "value"])


def _sample(labelled: DataFrame, per_language: int, most_rows: int) -> DataFrame | None:
    """doc_id, lang, text of the documents to fit on, `per_language` of each language at most."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "lang", "text")
    most = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, most_rows // 4))
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return None
    each = min(per_language, max(4, most_rows // len(sizes)))
    # a hash leaves out most rows where they are read; only then are repeated ones told apart and the rest counted off
    hashed, bands = F.xxhash64("doc_id"), {}
    for lang, n in sizes.items():
        bands.setdefault(max(each, 1 << max(0, n - 1).bit_length()), []).append(lang)
    wanted = F.lit(False)
    for n, languages in bands.items():
        wanted = wanted | (F.col("lang").isin(languages) & part_of(hashed, 2 * each, n))
    once = rows.where(wanted).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select("doc_id", "lang", "text")


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model | None:
    """Fits a model on a bounded, hash-chosen sample of rows (doc_id, text, lang)."""
    arrow_ready(labelled.sparkSession)
    chosen = _sample(labelled, per_language, most_rows)
    if chosen is None:
        return None
    found = chosen.mapInArrow(_featured, "doc_id string, lang string, at array<short>, value array<float>").toArrow()  # most_rows rows, or four of each language
    found = found.filter(pc.greater(pc.list_value_length(found["at"]), 0)).sort_by([("lang", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    if not found.num_rows:
        return None
    counts = pc.list_value_length(found["at"]).to_numpy()
    x = np.zeros((found.num_rows, BUCKETS), np.float32)
    x[np.repeat(np.arange(found.num_rows), counts), pc.list_flatten(found["at"]).to_numpy()] = pc.list_flatten(found["value"]).to_numpy()
    return fit(x, found["lang"].to_pylist())


_TOLD = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def verdict(model: Model | None) -> Callable[[Column], Column]:
    """A column function: what a text is told to be. Texts go to Python and verdicts come back, and other columns stay where they are."""

    @F.arrow_udf(_TOLD)
    def told(texts: pa.Array) -> pa.Array:
        lang, score, ambiguous = [], [], []
        for _, some in steps([b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]):
            for k in range(0, len(some), TEXTS):
                x, letters = features(some[k : k + TEXTS])
                known = (letters > 0) & (model is not None)
                best, p, near = model.decode(x) if model else (np.zeros(len(x), int),) * 3
                lang += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
                score += np.where(known, p, 0.0).tolist()
                ambiguous += (known & near.astype(bool)).tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], ["lang_pred", "score", "ambiguous"])

    return told


def identify(documents: DataFrame, model: Model | None, carried: list[str] | None = None) -> DataFrame:
    """lang_pred, score, ambiguous after the carried columns of each document (doc_id, if none are named)."""
    arrow_ready(documents.sparkSession)
    carried = ["doc_id"] if carried is None else carried
    told = unused(documents.columns, "told")
    return documents.withColumn(told, verdict(model)(F.col("text"))).select(*(F.col(f"`{c}`") for c in carried), f"{told}.*")


def learn_from_folds(documents: DataFrame) -> Model | None:
    """Learns from those four of five documents that are not held out."""
    return learn(documents.where((fold("doc_id", 5) != 0) & F.col("doc_id").isNotNull()))


def predicted(documents: DataFrame) -> DataFrame:
    """Learns from four of five documents and predicts all."""
    found = identify(documents, learn_from_folds(documents))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
