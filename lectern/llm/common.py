"""What the corpus operators share: byte-level words, vectorised hashes and bounded slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.scratch import cut, release, shared_dir  # noqa: F401
from lectern.session import BATCH_BYTES, arrow_ready  # noqa: F401

#: Bytes of text that one vectorised step takes; a longer single text is a step of its own.
STEP_BYTES = 1 << 19

_upper = {c: c + 32 for c in range(0x41, 0x5B)}
_lower_or_digit = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B))
#: A-Z become a-z and the white space \x09-\x0D a blank; other bytes stay.
BLANK_BYTES = bytes(_upper.get(c, 0x20 if 9 <= c <= 13 else c) for c in range(256))
#: A-Z become a-z; every ASCII byte that is no letter or digit becomes a blank.
RULE_BYTES = bytes(_upper.get(c, c if c >= 0x80 or c in _lower_or_digit else 0x20) for c in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): near values become unrelated ones."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers; those for a usual step are kept."""
    if len(_powers[which]) >= n:
        return _powers[which][:n]
    factor = np.full(max(n, STEP_BYTES + 2), _BASE if which == "up" else _INVERSE, np.uint64)
    factor[0] = 1
    np.cumprod(factor, out=factor)
    if n <= STEP_BYTES + 2:
        _powers[which] = factor
    return factor[:n]


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the blank-separated words of one translated byte string. A long one is taken
    in parts that end between words, so that what is held beside it does not grow with it."""
    if len(data) <= STEP_BYTES + 1:
        return _words_of_part(data)
    found, at = [], 0
    while at < len(data):
        stop = data.rfind(b" ", at, at + STEP_BYTES) + 1
        if not stop:
            stop = data.find(b" ", at + STEP_BYTES) + 1 or len(data)
        starts, ends, hashes = _words_of_part(data[at:stop])
        found.append((starts + at, ends + at, hashes))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _words_of_part(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([1], a == 0x20, [1])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[a] * _power("up", len(a)), out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * _power("down", len(a) + 1)[starts])


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes (of a whole array, or along one document)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out += h[k : k + n]
    return mix(out)


def steps(texts: Iterable[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in steps of at most `most` bytes (or one text), with the index of the first."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield at, held


class Words:
    """The words of a step of texts: word hashes in one array, and which text each word is in."""

    def __init__(self, texts: list[bytes], table: bytes) -> None:
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        self.data = b" ".join([*texts, b""]).translate(table)
        self.starts, self.ends, self.hashes = words_in(self.data)
        self.first = np.searchsorted(self.starts, self.text_at)
        self.counts = np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def part_limit(wanted: int, of: int) -> int:
    """Of all 63-bit hashes, those up to here are enough for `wanted` of `of` distinct values, and six standard deviations
    more, so that at no size of a table are fewer than `wanted` found, but for one chance in 10**9."""
    return min((1 << 63) - 1, int((wanted + 6 * wanted**0.5 + 18) / max(1, of) * (1 << 63)))


def part_of(hashed: Column, wanted: int, of: int) -> Column:
    """Whether a 64-bit hash is in that part."""
    return F.shiftrightunsigned(hashed, 1) <= F.lit(part_limit(wanted, of))


def unused(columns: Iterable[str], name: str) -> str:
    """The name, or a longer one if a column is called so."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
