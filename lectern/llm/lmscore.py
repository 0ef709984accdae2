"""Document probability under a subword lattice.

A text is lower-cased (A-Z) and taken as its words, each with a word mark before it, and one end token. The pieces of an
existing vocabulary give every word a lattice of segmentations, weighted by the vocabulary's own scores (its order, read as a
Zipf law). A word's marginal probability is the sum over all its segmentations, by a forward recursion in log space; as no piece
crosses a word mark, the document's is the product over its words and the end token: the score. Characters that the
vocabulary lacks are spelt by its byte pieces, so each text has a positive probability, and with the end token the
probabilities of all texts sum to at most one.

Beside it stands the score under weights that the corpus has taught: estimated anew, ROUNDS times, from the expected counts
of pieces over all segmentations of all training words, smoothed by the vocabulary's weights.

The learnt score is that of a model over words which falls back to this lattice: a word has (c + A p) / (N + A), where c is its
count in training, p its probability over all segmentations under the weights that the corpus has taught, N the number of training
tokens and A that of words seen once (what Good and Turing hold back for words not seen). Words of training are so as probable as
they are frequent, all others are spelt, and the probabilities of all texts still sum to at most one. Without training words A is 1.

The base score is an add-0.1 unigram model over words, from the same table of counts. That table covers every word of
every document and stays distributed. The `hot` most frequent short words, a fixed number, are sent to the tasks, which
sum their scores where the documents are read; all other words are joined by a shuffle, in which no key is hot any more.

Nulls: a null text is empty, and so is scored as the end token alone. Null doc_id is held in (training, not held out
by its remainder, which is null: held_out is false). Repeated rows get a row each. Extra columns are ignored. Without
training documents c, N and V are 0. Ties: words of equal counts go to the tasks all or none, as a step of the histogram of
counts does; this changes where a score is summed, not the score. Very long texts and words are read whole, in steps. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BLANK_BYTES, Words, arrow_ready, column_bytes, cut, mix, steps

MARK = "▁"
#: The key of the end token in tables of words; no word has a blank.
END = " "
HOT = 65_536
HOT_BYTES = 64
FLUSH = 150_000
#: Words that one step of the recursion takes, and the weight of the starting probabilities, in pieces.
STEP_WORDS = 8192
PRIOR = 2000.0
ZIPF = 30.0
#: Times that the weights are estimated anew.
ROUNDS = 2

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SLOTS = 1 << 22


@dataclass
class Pieces:
    """A vocabulary ready for look-up by hashes of substrings; logp has a weight for each piece, byte pieces, and the end."""

    hashes: np.ndarray
    ids: np.ndarray
    bits: np.ndarray
    byte_ids: np.ndarray
    logp: np.ndarray
    longest: int

    def with_logp(self, logp: np.ndarray) -> Pieces:
        return Pieces(self.hashes, self.ids, self.bits, self.byte_ids, logp, self.longest)

    @property
    def end(self) -> float:
        return float(self.logp[-1])


def _hashes_of(strings: list[str]) -> np.ndarray:
    out = []
    for s in strings:
        h, power = 0, 1
        for ch in s:
            h = (h + _code_values(np.array([ord(ch)]))[0].item() * power) & 0xFFFFFFFFFFFFFFFF
            power = (power * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
        out.append(h)
    return np.array(out, np.uint64)


def _code_values(c: np.ndarray) -> np.ndarray:
    return mix(c.astype(np.uint64) + np.uint64(0x1234567))


def build(scored: list[tuple[str, float]], byte_pieces: dict[int, float]) -> Pieces:
    """From (piece, score) and byte -> score; scores are log weights and are normalised here together with the end token."""
    names = [p for p, _ in scored]
    h = _hashes_of(names)
    order = np.argsort(h)
    bits = np.zeros(_SLOTS, bool)
    bits[(h & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
    logw = np.array([s for _, s in scored] + [byte_pieces[b] for b in range(256)] + [0.0])
    logw[-1] = logw[:-1].max() - 5
    logp = logw - np.logaddexp.reduce(logw)
    return Pieces(h[order], order.astype(np.int64), bits, len(names) + np.arange(256), logp, max(map(len, names)))


def load(path: str | None = None) -> Pieces:
    """The public vocabulary: its scores fall by one from piece to piece, so they are ranks, weighed as 1 / (rank + ZIPF)."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    scored, least = [], 0.0
    for i in range(sp.get_piece_size()):
        piece, score = sp.id_to_piece(i), sp.get_score(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or (MARK * 2 in piece) or score < -1e8:
            continue
        scored.append((piece, -math.log(ZIPF - score)))
        least = min(least, scored[-1][1])
    return build(scored, dict.fromkeys(range(256), least))


@dataclass
class _Lattice:
    """The pieces that match inside a step of words: from boundary, to boundary, id (or -1 - number of an unknown character)."""

    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    piece: np.ndarray
    where: np.ndarray
    unknown: list[np.ndarray]
    size: int


def _lattice(words: list[str], v: Pieces) -> _Lattice:
    c = np.frombuffer("\0".join([*(MARK + w for w in words), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    last = first + lengths - 1
    n = len(c)
    up = np.full(n + 1, _BASE)
    down = np.full(n + 1, _INVERSE)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_code_values(c) * up[:n], out=total[1:])
    inside = np.ones(n, bool)
    inside[last] = False
    starts, stops, ids = [], [], []
    covered = ~inside
    for k in range(1, min(v.longest, n) + 1):
        h = (total[k:] - total[:-k]) * down[: n + 1 - k]
        at = np.flatnonzero(v.bits[(h & np.uint64(_SLOTS - 1)).astype(np.int64)])
        found = np.searchsorted(v.hashes, h[at])
        found[found == len(v.hashes)] = 0
        real = v.hashes[found] == h[at]
        at, found = at[real], found[real]
        if k == 1:
            covered[at] = True
        starts.append(at)
        stops.append(at + k)
        ids.append(v.ids[found])
    lone = np.flatnonzero(~covered)
    unknown: list[np.ndarray] = []
    if len(lone):
        codes, number = np.unique(c[lone], return_inverse=True)
        unknown = [v.byte_ids[np.frombuffer(chr(x).encode("utf-8", "surrogatepass"), np.uint8)] for x in codes]
        starts.append(lone)
        stops.append(lone + 1)
        ids.append(-1 - number)
    where = np.arange(n + 1) - np.repeat(first, lengths)[np.minimum(np.arange(n + 1), n - 1)]
    return _Lattice(first, last, np.concatenate(starts), np.concatenate(stops), np.concatenate(ids), where, unknown, n + 1)


def _weights(g: _Lattice, logp: np.ndarray) -> np.ndarray:
    if not g.unknown:
        return logp[g.piece]
    spelt = np.array([logp[b].sum() for b in g.unknown])
    return np.where(g.piece >= 0, logp[np.maximum(g.piece, 0)], spelt[np.minimum(-1 - np.minimum(g.piece, -1), len(spelt) - 1)])


def _groups(key: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1)


def _forward(g: _Lattice, w: np.ndarray) -> np.ndarray:
    alpha = np.full(g.size, -np.inf)
    alpha[g.first] = 0
    # pieces that start equally far into their words end at different boundaries
    for m in _groups(g.where[g.start]):
        stop = g.stop[m]
        alpha[stop] = np.logaddexp(alpha[stop], alpha[g.start[m]] + w[m])
    return alpha


def lattice_scores(words: list[str], v: Pieces, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Natural-log marginal probability of each word, with its mark, over all its segmentations, under each set of weights."""
    out = [np.zeros(len(words)) for _ in weights]
    for i in range(0, len(words), STEP_WORDS):
        part = words[i : i + STEP_WORDS]
        g = _lattice(part, v)
        for scores, logp in zip(out, weights, strict=True):
            scores[i : i + len(part)] = _forward(g, _weights(g, logp))[g.last]
    return out


def word_log_probabilities(words: list[str], v: Pieces) -> np.ndarray:
    return lattice_scores(words, v, [v.logp])[0]


def expected_counts(words: list[str], weights: np.ndarray, v: Pieces) -> np.ndarray:
    """Expected number of each piece over all segmentations of words that occur `weights` times."""
    out = np.zeros(len(v.logp))
    for i in range(0, len(words), STEP_WORDS):
        part = words[i : i + STEP_WORDS]
        g = _lattice(part, v)
        w = _weights(g, v.logp)
        alpha = _forward(g, w)
        beta = np.full(g.size, -np.inf)
        beta[g.last] = 0
        for m in reversed(_groups(g.where[g.stop])):
            start = g.start[m]
            beta[start] = np.logaddexp(beta[start], w[m] + beta[g.stop[m]])
        word = np.searchsorted(g.first, g.start, "right") - 1
        n = np.exp(alpha[g.start] + w + beta[g.stop] - alpha[g.last][word]) * weights[i : i + len(part)][word]
        known = g.piece >= 0
        out += np.bincount(g.piece[known], n[known], minlength=len(out))
        for k, ids in enumerate(g.unknown):
            np.add.at(out, ids, n[g.piece == -1 - k].sum())
    return out


def re_estimated(v: Pieces, counts: np.ndarray, ends: float, prior: float = PRIOR) -> Pieces:
    n = counts + prior * np.exp(v.logp)
    n[-1] = ends + prior * math.exp(v.end)
    return v.with_logp(np.log(n) - math.log(n.sum()))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learnt: Counter = Counter()
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(learnt.keys() | held.keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array([learnt[k] for k in keys], pa.int64()), pa.array([held[k] for k in keys], pa.int64())], ["word", "c", "h"])
        learnt.clear()
        held.clear()
        return out

    for batch in batches:
        for x, out in zip(column_bytes(batch, "text"), batch.column(batch.schema.get_field_index("held_out")).to_pylist(), strict=True):
            into = held if out else learnt
            into.update(x.translate(BLANK_BYTES).split())
            into[b" "] += 1
            if len(learnt) + len(held) > FLUSH:
                yield flush()
    yield flush()


def _estimating(v: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(v.logp))
        for batch in batches:
            total += expected_counts(batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), float), v)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "n"])

    return run


def _learnt(c: np.ndarray, spelt: np.ndarray, n: int, held_back: int) -> np.ndarray:
    """Natural-log probability of words with counts c in training, of which the lattice gives `spelt`; in logs, as a long word's own underflows."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.asarray(c, float)), math.log(held_back) + spelt) - math.log(n + held_back)


def _word_scoring(v: Pieces, start: np.ndarray, n: int, held_back: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            own, taught = lattice_scores(words, v, [start, v.logp])
            scores = [pa.array(x / math.log(10)) for x in (own, taught, _learnt(batch.column(1).to_numpy(zero_copy_only=False), taught, n, held_back))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *scores], ["word", "c", "lattice", "estimated", "learnt"])

    return run


def _document_scoring(hot: list[tuple[str, bool, float, float, float, float]], end: tuple[bool, float, float, float, float]):
    """A row for each document with what its hot words and its end token sum to, and a row for each distinct other word of it."""
    hashes = Words([" ".join(w for w, *_ in hot).encode()], BLANK_BYTES).hashes if hot else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    hashes, values = hashes[order], np.array([x[1:] for x in hot], float).reshape(-1, 5)[order]
    bits = np.zeros(_SLOTS, bool)
    bits[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "word", "times", "n_tokens", "known", "base", "score", "anew", "learnt"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, texts in steps(column_bytes(batch, "text")):
                w = Words(texts, BLANK_BYTES)
                n, rows = len(texts), row + 1 + np.arange(len(texts))
                row += n
                docs = np.repeat(np.arange(n), w.counts)
                maybe = np.flatnonzero(bits[(w.hashes & np.uint64(_SLOTS - 1)).astype(np.int64)])
                index = np.searchsorted(hashes, w.hashes[maybe])
                index[index == len(hashes)] = 0
                real = hashes[index] == w.hashes[maybe] if len(hashes) else np.zeros(0, bool)
                sums = [np.bincount(docs[maybe[real]], values[index[real], k], n) + float(end[k]) for k in range(5)]
                other = np.ones(len(w.hashes), bool)
                other[maybe[real]] = False
                other = np.flatnonzero(other)
                rest = Counter(zip(docs[other].tolist(), map(w.word, other.tolist()), strict=True))
                # a document's own key is no word, and so matches nothing
                keys = [f" {r}" for r in rows.tolist()] + [x.decode() for _, x in rest]
                zeros = np.zeros(len(rest), np.int64)
                place = np.concatenate([np.arange(n), np.array([d for d, _ in rest], np.int64)])
                columns = [
                    pa.array(rows[place]), ids.slice(at, n).take(pa.array(place)), pa.array(keys, pa.string()), pa.array(np.concatenate([np.zeros(n, np.int64), np.fromiter(rest.values(), np.int64, len(rest))])),
                    pa.array(np.concatenate([w.counts + 1, zeros])), pa.array(np.concatenate([sums[0].astype(np.int64), zeros])), *(pa.array(np.concatenate([sums[k], zeros.astype(float)])) for k in (1, 2, 3, 4)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return run


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """`most` rows at most: short words in the upper steps of a histogram of counts, as many steps as hold no more.

    A top-k would send that many rows of each partition to the driver."""
    step = F.floor(F.log2(F.col("c") + F.col("h")) * 16)
    short = table.where((F.col("word") != END) & (F.octet_length("word") <= HOT_BYTES) & (F.col("c") + F.col("h") > 0)).withColumn("step", step)
    least, held = None, 0
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):  # 16 steps for each doubling of counts
        held += r["n"]
        if held > most:
            break
        least = r["step"]
    return short.where(F.col("step") >= least) if least is not None else short.limit(0)


def score_documents(documents: DataFrame, folds: int = 10, vocabulary: str | None = None, hot_words: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, estimated_score (under the weights that are estimated anew), the number of distinct training tokens V, and learnt_score (of training words and the lattice); all scores log10."""
    arrow_ready(documents.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = docs.select("text", held.alias("held_out")).mapInArrow(_counting, "word string, c long, h long")
    table = cut(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("h").alias("h")), "words")
    seen = table.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends"), F.count_if(F.col("c") == 1).alias("once")).first()
    n, v, ends = seen["n"] or 0, seen["v"] or 0, seen["ends"] or 0
    held_back = max(1, seen["once"] or 0)

    pieces = load(vocabulary)
    learnt = table.where(f"c > 0 AND word <> '{END}'").select("word", "c")
    start = pieces
    for _ in range(rounds):
        expected = learnt.mapInArrow(_estimating(pieces), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        total = np.zeros(len(pieces.logp))
        for r in expected.collect():  # a row for each piece of the vocabulary at most
            total[r["piece"]] = r["n"]
        pieces = re_estimated(start, total, float(ends))

    base_of = F.log10((F.col("c") + 0.1) / (n + 0.1 * (v + 1)))
    frequent = sorted((r["word"], r["c"], r["base"]) for r in _most_frequent(table, hot_words).select("word", "c", base_of.alias("base")).collect())
    own, taught = lattice_scores([w for w, _, _ in frequent], pieces, [start.logp, pieces.logp])
    lattice = [x / math.log(10) for x in (own, taught, _learnt([c for _, c, _ in frequent], taught, n, held_back))]
    hot = [(w, c > 0, base, *map(float, scores)) for (w, c, base), *scores in zip(frequent, *lattice, strict=True)]
    end = (ends > 0, math.log10((ends + 0.1) / (n + 0.1 * (v + 1))), *(float(x) / math.log(10) for x in (start.end, pieces.end, _learnt(ends, pieces.end, n, held_back))))

    scored = table.select("word", "c").mapInArrow(_word_scoring(pieces, start.logp, n, held_back), "word string, c long, lattice double, estimated double, learnt double").select("word", (F.col("c") > 0).cast("long").alias("k"), base_of.alias("b"), "lattice", "estimated", F.col("learnt").alias("l"))
    rows = docs.mapInArrow(_document_scoring(hot, end), "row long, doc_id long, word string, times long, n_tokens long, known long, base double, score double, anew double, learnt double")
    joined = rows.join(scored, "word", "left")

    def total_of(own: str, by_word: str) -> Column:
        return F.sum(F.col(own) + F.coalesce(F.col("times") * F.col(by_word), F.lit(0)))

    summed = joined.groupBy("row", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), total_of("known", "k").alias("n_known"), total_of("base", "b").alias("base_score"), total_of("score", "lattice").alias("score"), total_of("anew", "estimated").alias("estimated_score"), total_of("learnt", "l").alias("learnt_score"))
    return summed.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "estimated_score", F.lit(v).cast("long").alias("train_types"), "learnt_score")
