"""Vector bin packing of tokenised examples into training sequences.

An example has three demands: tokens, one segment, and loss-bearing tokens. A sequence has a limit on each. Every
demand is put in proportion to its limit, and an example goes to that open sequence, of those where it fits under all
three limits, whose remaining capacity has the largest dot product with it, so that long examples meet sequences short
of tokens last and short ones do not use up segments where tokens are left.

Examples are cut freely: what fills whole sequences is cut off first, and what is left of a document may be cut once
more to close a sequence exactly. Each partition packs on its own (no shuffle, and no token id ever leaves the task
that made it), with a bounded set of open sequences; identifiers hold the partition's number, so a task that is run
again gives the same rows.

Nulls and empty texts are documents of the end token alone. Null doc_id stays null in its piece. Repeated rows are
packed each. Ties: of sequences with equal dot products the one in the first place is taken. Very long texts are tokenised
whole, one at a time. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_ready, column_bytes

TOKENS = 2048
SEGMENTS = 64
LOSS_TOKENS = 2048
END = 1
#: Sequences that a task keeps open at once.
OPEN = 64
#: A remainder is cut to close a sequence only if each part has at least so many tokens.
LEAST_PART = 16

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass
class Limits:
    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = LOSS_TOKENS
    open: int = OPEN
    least_part: int = LEAST_PART


@dataclass
class Packer:
    """Open sequences as remaining capacities; place() says where an example goes, and closes what is full."""

    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        self.left = np.zeros((self.limits.open, 3), np.int64)
        self.name = np.full(self.limits.open, -1, np.int64)
        self.full = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        self.made = 0

    def _new(self) -> int:
        free = np.flatnonzero(self.name < 0)
        # with none free, the sequence with the fewest tokens left is closed
        slot = int(free[0]) if len(free) else int(np.argmin(self.left[:, 0]))
        self.left[slot] = (self.limits.tokens, self.limits.segments, self.limits.loss)
        self.name[slot] = self.made
        self.made += 1
        return slot

    def _put(self, slot: int, need: tuple[int, int, int]) -> tuple[int, int]:
        at = (int(self.name[slot]), int(self.limits.tokens - self.left[slot, 0]))
        self.left[slot] -= need
        if (self.left[slot] <= 0).any():
            self.name[slot], self.left[slot] = -1, 0
        return at

    def place(self, tokens: int, loss: int) -> tuple[int, int]:
        """Sequence and offset of an example that is to stay whole."""
        need = np.array([tokens, 1, loss])
        fits = (self.left >= need).all(axis=1) & (self.name >= 0)
        if fits.any():
            dot = (self.left / self.full) @ (need / self.full)
            dot[~fits] = -1
            return self._put(int(np.argmax(dot)), tuple(need))
        return self._put(self._new(), tuple(need))

    def gap(self, tokens: int) -> int | None:
        """Tokens of the best open sequence that a cut of the example can close: the most that are left of those below its length."""
        ok = (self.name >= 0) & (self.left[:, 1] >= 1) & (self.left[:, 2] >= self.left[:, 0]) & (self.left[:, 0] >= self.limits.least_part) & (self.left[:, 0] <= tokens - self.limits.least_part)
        return int(self.left[ok, 0].max()) if ok.any() else None

    def can_hold(self, tokens: int, loss: int) -> bool:
        return bool(((self.left >= (tokens, 1, loss)).all(axis=1) & (self.name >= 0)).any())

    def pieces(self, tokens: int, no_loss: int = 0) -> list[tuple[int, int, int, int, int]]:
        """(start, length, sequence, offset, loss) of an example whose first `no_loss` tokens bear no loss."""
        out, start = [], 0

        def loss_of(a: int, n: int) -> int:
            return n - max(0, min(no_loss, a + n) - a)

        while tokens - start:
            rest = tokens - start
            whole = min(self.limits.tokens, max(0, no_loss - start) + self.limits.loss)
            size = min(rest, whole)
            if size < whole and not self.can_hold(size, loss_of(start, size)) and (gap := self.gap(size)):
                size = gap
            seq, offset = self.place(size, loss_of(start, size))
            out.append((start, size, seq, offset, loss_of(start, size)))
            start += size
        return out


def byte_bpe(path: str | None = None, added: str | None = None):
    """ids of texts by the public byte-level vocabulary: its ranks in the faster of the two libraries, which give the same ids once texts are split at the added tokens of the other's file. Paths that are not given are looked up where this runs."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    with open(added or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    coder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)
    core, names = coder._core_bpe, set(special)
    return lambda text: np.frombuffer(core.encode_to_tiktoken_buffer(text, names), np.uint32)


def _packing(limits: Limits, vocabulary: str | None, added: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = byte_bpe(vocabulary, added)
        packer = Packer(limits)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            names = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).to_pylist()
            for name, text in zip(names, column_bytes(batch, "text"), strict=True):
                ids = np.append(ids_of(text.decode("utf-8", "replace")), np.uint32(end)).astype("<u4")
                for start, length, seq, offset, loss in packer.pieces(len(ids)):
                    row = (name, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + seq, offset, loss)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    return run


def pack_documents(documents: DataFrame, limits: Limits | None = None, vocabulary: str | None = None, added: str | None = None, end: int = END) -> DataFrame:
    """A row for each piece of each document; every token bears loss."""
    arrow_ready(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packing(limits or Limits(), vocabulary, added, end), SCHEMA)


#: Limits for instruction data, of whose tokens only answers bear loss.
INSTRUCTIONS = Limits(tokens=2048, segments=8, loss=1024)


def _turns(limits: Limits, vocabulary: str | None, added: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = byte_bpe(vocabulary, added)
        packer, base = Packer(limits), TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "answers")), strict=True)
            rows = []
            for (conv, turn, answers), text in zip(keys, column_bytes(batch, "text"), strict=True):
                n = len(ids_of(text.decode("utf-8", "replace"))) + 1
                rows += [(conv, turn, start, length, n, base + seq, offset, loss) for start, length, seq, offset, loss in packer.pieces(n, 0 if answers else n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(8)], [c.split()[0] for c in _PLACED.split(", ")])

    return run


_PLACED = "conv_id long, turn long, start long, length long, turn_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_turns(conversations: DataFrame, limits: Limits = INSTRUCTIONS, vocabulary: str | None = None, added: str | None = None) -> DataFrame:
    """A row for each piece of each turn (conv_id, turn, role, text); tokens of the assistant's turns, and their ends, bear loss, a null role is not the assistant."""
    arrow_ready(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("answers"), "text")
    return rows.mapInArrow(_turns(limits, vocabulary, added), _PLACED)


def _placing(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = [(k, *p[:2], base + p[2], *p[3:]) for k, n, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for p in packer.pieces(n or 0, (n or 0) - min(n or 0, loss or 0))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["example_id", "start", "length", "sequence_id", "offset", "loss_tokens"])

    return run


def pack_examples(examples: DataFrame, limits: Limits | None = None) -> DataFrame:
    """For instruction data: rows (example_id, n_tokens, n_loss), whose loss-bearing tokens stand last, to placed pieces."""
    arrow_ready(examples.sparkSession)
    rows = examples.select(*(F.col(c).cast("long").alias(c) for c in ("example_id", "n_tokens", "n_loss")))
    return rows.mapInArrow(_placing(limits or Limits()), "example_id long, start long, length long, sequence_id long, offset long, loss_tokens long")


def padding(lengths: Iterable[int], full: int = TOKENS) -> int:
    """Padded tokens of sequences of these lengths: to the full length, or none at a power of two."""
    return sum(0 if n & (n - 1) == 0 else full - n for n in lengths)
