"""Alignment of two tokenizations of each text by elementary intervals of its bytes.

The byte offsets at which tokens of either side end, taken together, cut a text into elementary intervals. A binary
search in each side's ends finds the token that owns an interval, so each interval is one overlap of an A and a B token.
An end that both sides share closes a group. The tokens of A and B that end there are linked: as a product, where tokens
without bytes make several end together.

Neither vocabulary has a token that goes on over a blank that follows something else, so texts are cut there into words
with the blanks before them, and a task tokenises and aligns a word once as long as it remembers it. Where a vocabulary
has such tokens, or a word is not given back byte by byte, the whole text is tokenised.

A pair of ids is linked only if one token's bytes end in the other's, so both vocabularies together allow no more pairs
than their tokens have ends, whatever the corpus: counts of pairs are summed in each task and by a shuffle, checked
against that bound, and sent to every task. What is known of a document, its distinct pairs with their numbers among
it, is stored, so texts are tokenised once and are never shuffled.

Nulls: a null or empty text, and one that a vocabulary does not give back byte by byte, has no tokens: zeros, and an empty
string for the digest. Null doc_id stays null. Repeated rows, and rows with one doc_id, get their own row each, and count each. Ties:
all pairs with the highest count of a B id are best. Very long texts are read whole, one at a time. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_ready, column_bytes, cut

#: Words that a task remembers, and characters of them.
WORDS, WORD_CHARS = 400_000, 8 << 20
#: Characters of a text that are taken at once.
PART_CHARS = 1 << 20
#: Before a blank that follows something else.
_CUT = re.compile(r"(?<=\S)(?= )")
_SHIFT = 32


@dataclass
class Tokenizer:
    """ids of texts that begin with a blank, the bytes of each id, and whether no token goes on over a blank that follows something else."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]
    apart: bool

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)


def byte_level(path: str | None = None) -> Tokenizer:
    """The byte-level vocabulary, where no string is special. Its pattern ends a token before each white space that follows something else."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    core = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return Tokenizer(lambda texts: list(map(core.encode_ordinary, texts)), pieces, True)


def sentence_pieces(path: str | None = None) -> Tokenizer:
    """The vocabulary of pieces, which adds the first blank of its own."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("\u2581", " ").encode() for i in range(model.get_piece_size())]
    return Tokenizer(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), pieces, not any(re.search(rb"[^ ] ", p) for p in pieces))


@dataclass
class Aligned:
    """Two tokenizations of the same bytes: groups by the number of tokens of each side up to their ends, links as ids and the group that they close, and overlaps as two tokens each."""

    a: np.ndarray
    b: np.ndarray
    a_stop: np.ndarray
    b_stop: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_group: np.ndarray
    overlaps: np.ndarray

    def spelling(self, spell: list[str]) -> list[str]:
        """Of `a1,a2|b1;a3|b2,b3`, each id with the mark that follows it. Each id takes its place in the row of all."""
        order = np.zeros(len(self.a) + len(self.b), np.int64)
        group_a = np.searchsorted(self.a_stop, np.arange(len(self.a)), "right")
        group_b = np.searchsorted(self.b_stop, np.arange(len(self.b)), "right")
        b_start = np.concatenate(([0], self.b_stop[:-1]))
        order[np.arange(len(self.a)) + b_start[group_a]] = self.a * 3
        order[np.arange(len(self.b)) + self.a_stop[group_b]] = self.b * 3
        order[self.a_stop + b_start - 1] += 1
        order[self.a_stop + self.b_stop - 1] += 2
        return list(map(spell.__getitem__, order.tolist()))


def spelled(ids: int) -> list[str]:
    return [f"{i}{mark}" for i in range(ids) for mark in ",|;"]


def align(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Of ids that spell the same bytes, not none."""
    a_end, b_end = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    ends = np.union1d(a_end, b_end)
    # the first token that ends at or after an interval's end owns it; where it ends there on both sides, a group closes
    owner_a, owner_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    shared = (a_end[owner_a] == ends) & (b_end[owner_b] == ends)
    first_a, first_b, at = owner_a[shared], owner_b[shared], ends[shared]
    a_stop, b_stop = np.searchsorted(a_end, at, "right"), np.searchsorted(b_end, at, "right")
    many = (a_stop - first_a) * (b_stop - first_b)
    group = np.repeat(np.arange(len(many)), many)
    nth, wide = np.arange(len(group)) - (np.cumsum(many) - many)[group], (b_stop - first_b)[group]
    return Aligned(a, b, a_stop, b_stop, a[first_a[group] + nth // wide], b[first_b[group] + nth % wide], group, np.stack((owner_a, owner_b)))


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many of them each text has."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, counts.sum()), counts


def given_back(t: Tokenizer, ids: list[list[int]], data: list[bytes]) -> np.ndarray:
    """Which texts their tokens spell byte by byte."""
    every, counts = flat(ids)
    ends = np.concatenate(([0], np.cumsum(t.sizes[every])))[np.cumsum(counts)]
    if b"".join(map(t.pieces.__getitem__, every.tolist())) == b"".join(data) and (ends == np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))).all():
        return np.ones(len(data), bool)
    return np.array([b"".join(map(t.pieces.__getitem__, i)) == d for i, d in zip(ids, data, strict=True)])


class Words:
    """Aligned words, by number: sizes (A tokens, B tokens, groups, links, overlaps), spelled groups and linked pairs."""

    def __init__(self, one: Tokenizer, two: Tokenizer) -> None:
        self.one, self.two = one, two
        self.spell = spelled(max(len(one.pieces), len(two.pieces)))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)
        self.pairs, self.pair_at, self.chars = np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def learn(self, words: list[str]) -> None:
        """Aligns new words, all in one go; one that is not given back has no tokens."""
        data, ids = [w.encode() for w in words], [t.encode(words) for t in (self.one, self.two)]
        right = np.logical_and(*(given_back(t, i, data) for t, i in zip((self.one, self.two), ids, strict=True)))
        sizes, texts = np.zeros((len(words), 5), np.int64), [""] * len(words)
        good, pair_of, pairs = np.flatnonzero(right), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(good):
            (a, n_a), (b, n_b) = (flat(i if len(good) == len(words) else [i[k] for k in good]) for i in ids)
            found = align(a, b, self.one.sizes, self.two.sizes)
            a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
            groups = np.searchsorted(found.a_stop, a_stop, "right")
            links = np.searchsorted(found.link_group, groups)
            overlaps = np.searchsorted(found.overlaps[0], a_stop)
            sizes[good] = np.stack([n_a, n_b, *(np.diff(x, prepend=0) for x in (groups, links, overlaps))], axis=1)
            marks, at = found.spelling(self.spell), 0
            for k, stop in zip(good.tolist(), (a_stop + b_stop).tolist(), strict=True):
                texts[k], at = "".join(marks[at:stop]), stop
            pairs, pair_of = found.link_a << _SHIFT | found.link_b, sizes[:, 3]
        self.number.update(zip(words, range(len(self.texts), len(self.texts) + len(words)), strict=True))
        self.texts += texts
        self.sizes = np.concatenate((self.sizes, sizes))
        self.pairs = np.concatenate((self.pairs, pairs))
        self.pair_at = np.concatenate((self.pair_at, self.pair_at[-1] + np.cumsum(pair_of if len(good) else np.zeros(len(words), np.int64))))
        self.chars += sum(map(len, words))

    def need(self, words: Iterable[str]) -> None:
        """Aligns those words that are not remembered; what is remembered has a limit, beyond which it begins anew."""
        if len(self.number) > WORDS or self.chars > WORD_CHARS:
            self.forget()
        if new := [w for w in dict.fromkeys(words) if w not in self.number]:
            self.learn(new)


@dataclass
class Document:
    """What is known of a text so far."""

    sizes: np.ndarray = field(default_factory=lambda: np.zeros(5, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lost: bool = False
    mark: str = ""

    def __post_init__(self) -> None:
        self.sha = hashlib.sha256()

    def add(self, known: Words, words: list[str]) -> None:
        """Further words, all remembered."""
        at = np.fromiter(map(known.number.__getitem__, words), np.int64, len(words))
        self.lost |= not known.sizes[at, 0].all()
        if self.lost:
            return
        self.sizes += known.sizes[at].sum(axis=0)
        self.sha.update((self.mark + "".join(map(known.texts.__getitem__, at.tolist()))[:-1]).encode())
        self.mark = ";"
        word, times = np.unique(at, return_counts=True)
        many = known.pair_at[word + 1] - known.pair_at[word]
        place = np.repeat(known.pair_at[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        found = np.concatenate((self.pairs, known.pairs[place]))
        self.pairs, where = np.unique(found, return_inverse=True)
        self.times = np.bincount(where, np.concatenate((self.times, np.repeat(times, many))), len(self.pairs)).astype(np.int64)

    def row(self) -> tuple:
        if self.lost or not self.sizes[0]:
            return 0, 0, 0, 0, 0, "", b"", b""
        return *self.sizes.tolist(), self.sha.hexdigest(), self.pairs.astype("<i8").tobytes(), self.times.astype("<i8").tobytes()


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """A text in parts of about so many characters, which end between words."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + size)
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop


_STORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs binary, times binary"


def _aligning(vocabularies: tuple[str | None, str | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(byte_level(vocabularies[0]), sentence_pieces(vocabularies[1]))
        apart = known.one.apart and known.two.apart
        for batch in batches:
            texts = [" " + data.decode("utf-8", "replace") if data else "" for data in column_bytes(batch, "text")]
            found = [Document(lost=not apart) for _ in texts]
            step: list[tuple[Document, list[str]]] = []
            size = 0
            for i, part in ((i, p) for i, text in enumerate(texts if apart else []) for p in [*parts(text), ""]):
                if size > PART_CHARS or (i + 1 == len(texts) and not part):
                    known.need(w for _, words in step for w in words)
                    for document, words in step:
                        document.add(known, words)
                    step, size = [], 0
                if part:
                    step.append((found[i], _CUT.split(part)))
                    size += len(part)
            for i, text in enumerate(texts):
                if text and found[i].lost:
                    found[i] = Document()
                    known.need([text])
                    found[i].add(known, [text])
            rows = [(doc_id, *document.row()) for doc_id, document in zip(batch.column(0).to_pylist(), found, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _STORED.split(", ")])

    return run


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs in a task: those of a batch are merged with what is held, which the vocabularies bound."""
    held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        pairs = np.concatenate([held, *(np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist())])
        times = np.concatenate([counts, *(np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist())])
        held, where = np.unique(pairs, return_inverse=True)
        counts = np.zeros(len(held), np.int64)
        np.add.at(counts, where, times)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts, pa.int64())], ["pair", "count"])


def _scoring(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for batch in batches:
            sums = []
            for pairs, times in zip(batch.column(batch.schema.get_field_index("pairs")).to_pylist(), batch.column(batch.schema.get_field_index("times")).to_pylist(), strict=True):
                at, times = np.searchsorted(known, np.frombuffer(pairs, "<i8")), np.frombuffer(times, "<i8")
                sums.append((int(times[best[at]].sum()), int((times * counts[at]).sum())))
            kept = [batch.column(i) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1))], [*batch.schema.names[:7], "n_best", "count_sum"])

    return run


def pair_counts(stored: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id) and count, over all links of the corpus."""
    return stored.select("pairs", "times").mapInArrow(_summing, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def most_pairs(one: Tokenizer, two: Tokenizer) -> int:
    """No corpus links more pairs of ids: of two linked tokens one's bytes end in the other's, and a token has as many ends as bytes, each of which few tokens of the other side spell."""
    spells: dict[bytes, list[int]] = {}
    for side, t in enumerate((one, two)):
        for piece in t.pieces:
            spells.setdefault(piece, [0, 0])[side] += 1
    total = sum(n for t, other in ((one, 1), (two, 0)) for p in t.pieces for i in range(len(p) + 1) if (n := spells.get(p[i:], (0, 0))[other]))
    return total


def aligned(documents: DataFrame, vocabularies: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """A row for each document: the contract's columns, and the number of overlaps."""
    spark = documents.sparkSession
    arrow_ready(spark)
    stored = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligning(vocabularies), _STORED), "aligned")
    most = most_pairs(byte_level(vocabularies[0]), sentence_pieces(vocabularies[1]))
    counted = cut(pair_counts(stored), "pairs")
    if counted.count() > most:
        raise ValueError("more pairs of ids than two vocabularies can link")
    table = counted.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    known, counts = table["pair"].to_numpy()[order], table["count"].to_numpy()[order]
    highest = np.zeros(1 << 20 if not len(known) else int((known & 0xFFFFFFFF).max()) + 1, np.int64)
    np.maximum.at(highest, known & 0xFFFFFFFF, counts)
    shared = spark.sparkContext.broadcast((known, counts, counts == highest[known & 0xFFFFFFFF]))
    return stored.mapInArrow(_scoring(shared), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, n_best long, count_sum long")
