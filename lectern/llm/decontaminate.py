"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `window` consecutive words (a shorter item is one window). A window's
shingles are its runs of `shingle` words. Shingles are ordered by rarity, counted over all documents; as only exact
containment counts, a window's necessary prefix is its one rarest shingle, and a window with a shingle that no document has
needs none. Documents are joined on the prefix shingles; a match at word p of a shingle that stands at word o of a window
must let the whole window fit at p - o (the length and positional bounds), and is then verified word by word.

The benchmark's windows, their shingles and the counts are tables on the executors. What each task gets is a bit table of
fixed size, which says of most shingles of documents that the benchmark has none like them. The prefix table is sent to all
tasks if it has `most_bytes` at most, counted before; no text is shuffled then. A larger one is joined with the shingles
that pass a bit table of the prefixes, which carry the words around them, and documents are joined with what was found.
Either way documents are read twice, however large the benchmark is, and both give the same rows.

Nulls: a null text has no words; a benchmark row with null item_id or without words matches nothing. Repeated document
rows, and rows with one doc_id or none, each get their row; repeated item rows count once. Ties: of a window's equally rare
shingles the one with the smallest hash, then the first, is its prefix; any would find the same. Very long texts are read
whole, words in parts. Extra columns are ignored. Empty tables give empty results, or rows without hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import RULE_BYTES, Words, arrow_ready, column_bytes, cut, steps, unused, windows

WINDOW = 10
SHINGLE = 5
#: Bytes of the prefix table (words, items and 64 for each row) up to which it is sent to every task.
MOST_BYTES = 16 << 20
#: Shingles and windows that a task holds before it hands them on.
FLUSH = 1 << 16
_SLOTS = 1 << 22
#: Slots of the bit table, as a power of two; a shingle has two.
_BITS = 25


class _Seen:
    """Membership of hashes in a fixed sorted set: a bit table answers for most, a binary search for the rest."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.bits = np.zeros(_SLOTS, bool)
        self.bits[self._slot(self.keys)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(_SLOTS - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that are in the set, and their index there."""
        at = np.flatnonzero(self.bits[self._slot(h)])
        index = np.searchsorted(self.keys, h[at])
        index[index == len(self.keys)] = 0
        real = self.keys[index] == h[at]
        return at[real], index[real]


def _cutting(window: int, shingle: int):
    """Windows of each item (words with a blank between, as many as `n`) with the hashes of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), column_bytes(batch, "text"), strict=True):
                w = Words([text], RULE_BYTES)
                total = len(w.hashes)
                n, width = min(window, total), min(shingle, total)
                hashes = windows(w.hashes, width).astype(np.int64) if total else np.zeros(0, np.int64)
                each = n - width + 1
                for first in range(0, total - n + 1 if total else 0, FLUSH):
                    starts = range(first, min(first + FLUSH, total - n + 1))
                    words = [b" ".join(w.word(k) for k in range(i, i + n)) for i in starts]
                    grams = pa.ListArray.from_arrays(pa.array(range(0, len(words) * each + 1, each), pa.int32()), pa.array(np.concatenate([hashes[i : i + each] for i in starts])))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([n] * len(words), pa.int32()), grams], ["item", "words", "n", "shingles"])

    return run


def _bit_table(shingles: DataFrame) -> np.ndarray:
    """Two bits for each of the hashes (column shingle), in 1 << _BITS slots: 1 << (_BITS - 6) numbers at most are sent to the driver."""
    mask = (1 << _BITS) - 1
    slots = shingles.select(F.explode(F.array(F.col("shingle").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("shingle", _BITS).bitwiseAND(F.lit(mask)))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint64)
    return out


class _Maybe:
    """Which hashes a bit table may hold: a small table in a task's cache answers for most, two bits for the rest."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.near = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, _SLOTS).any(0)

    def _bit(self, slot: np.ndarray) -> np.ndarray:
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.near[(h & np.uint64(_SLOTS - 1)).astype(np.int64)])
        mask, h = np.uint64((1 << _BITS) - 1), h[at]
        return at[self._bit(h & mask) & self._bit((h >> np.uint64(_BITS)) & mask)]


def _passing(w: Words, maybe: _Maybe, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each width, places, documents and hashes of the shingles that pass and do not cross into the next text."""
    for width in widths:
        h = windows(w.hashes, width)
        at = maybe.find(h)
        docs = np.searchsorted(w.first, at, "right") - 1
        inside = at + width <= w.first[docs + 1]
        yield at[inside], docs[inside], h[at[inside]]


def _counting(bits: np.ndarray, widths: list[int]):
    """Occurrences, in parts, of the shingles of a partition of documents that the bit table lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, held, size = _Maybe(bits), [], 0

        def summed() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["shingle", "n"])

        for batch in batches:
            for _, texts in steps(column_bytes(batch, "text")):
                for _, _, h in _passing(Words(texts, RULE_BYTES), maybe, widths):
                    held.append(h)
                    size += len(h)
                if size > FLUSH:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return run


def _candidates(bits: np.ndarray, widths: list[int], window: int):
    """Shingles that may be prefixes: row, at (their place in the document), shingle, and the words around them, of which `left` stand before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = _Maybe(bits)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for base, texts in steps(column_bytes(batch, "text")):
                w = Words(texts, RULE_BYTES)
                for at, docs, h in _passing(w, maybe, widths):
                    low, high = np.maximum(at - window + 1, w.first[docs]), np.minimum(at + window, w.first[docs + 1])
                    for k in range(0, len(at), FLUSH):
                        here = slice(k, k + FLUSH)
                        around = [b" ".join(w.word(j) for j in range(a, b)) for a, b in zip(low[here].tolist(), high[here].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[base + docs[here]]), pa.array(at[here] - w.first[docs[here]]), pa.array(h[here].astype(np.int64)), pa.array((at - low)[here].astype(np.int32)), pa.array(around, pa.binary()).cast(pa.string())],
                            ["row", "at", "shingle", "left", "around"],
                        )

    return run


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans that touch or overlap as one."""
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND_TYPE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _matching(rows: list) -> Callable[[Column], Column]:
    """A column function: of a text its number of words, the words that windows cover and the items whose windows occur, from the rows of a prefix table that a task can hold. Texts go to Python; other columns stay where they are."""
    numbers: dict[str, int] = {}
    wanted: list[tuple[list[bytes], list[str]]] = []
    prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
    chosen: dict[int, set[int]] = defaultdict(set)
    for r in rows:
        if r["words"] not in numbers:
            number = numbers[r["words"]] = len(wanted)
            wanted.append((r["words"].encode("utf-8", "surrogatepass").split(b" "), []))
            shingle = r["shingle"] & ((1 << 64) - 1)
            prefix[shingle].append((number, r["offset"]))
            chosen[r["width"]].add(shingle)
        wanted[numbers[r["words"]]][1].append(r["item"])
    found = {width: _Seen(np.array(sorted(k), np.uint64)) for width, k in chosen.items()}
    prefix = dict(prefix)

    @F.arrow_udf(_FOUND_TYPE)
    def matched(texts: pa.Array) -> pa.Array:
        texts_all = [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]
        n_words = np.zeros(len(texts_all), np.int64)
        spans: list[list[dict]] = [[] for _ in texts_all]
        items: list[list] = [[] for _ in texts_all]
        for base, some in steps(texts_all):
            w = Words(some, RULE_BYTES)
            n_words[base : base + len(some)] = w.counts
            places: dict[int, set[tuple[int, int]]] = defaultdict(set)
            here: dict[int, set] = defaultdict(set)
            for width, s in found.items():
                at, index = s.find(windows(w.hashes, width))
                docs = np.searchsorted(w.first, at, "right") - 1
                for p, k, d in zip(at.tolist(), index.tolist(), docs.tolist(), strict=True):
                    for number, offset in prefix[int(s.keys[k])]:
                        words, names = wanted[number]
                        start, end = p - offset, p - offset + len(words)
                        if start < w.first[d] or end > w.first[d + 1]:
                            continue
                        if all(w.word(start + j) == x for j, x in enumerate(words)):
                            places[d].add((int(start - w.first[d]), int(end - w.first[d])))
                            here[d].update(names)
            for d, got in places.items():
                spans[base + d], items[base + d] = _merged(got), sorted(here[d])
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return matched


def _finishing(carried: list[str], spans: str, items: str):
    """Documents with the spans and items that were joined to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            n_words = [int(n) for _, texts in steps(column_bytes(batch, "text")) for n in Words(texts, RULE_BYTES).counts]
            merged = [_merged([(s["start"], s["end"]) for s in x or []]) for x in column(spans).to_pylist()]
            names = [sorted(x or []) for x in column(items).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(column, carried), pa.array(n_words, pa.int64()), pa.array(merged, _SPANS), pa.array(names, pa.list_(pa.string()))], [*carried, "n_words", "spans", "items"])

    return run


def _joined(docs: DataFrame, prefixes: DataFrame, widths: list[int], window: int, carried: list[str], kinds: str) -> DataFrame:
    """The same for a prefix table of any size, by joins on prefix shingles and on a key of each row."""
    key, spans, items = (unused(docs.columns, c) for c in ("row_key", "found_spans", "found_items"))
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    bits = _bit_table(prefixes.select("shingle").distinct())
    met = keyed.select(key, "text").mapInArrow(_candidates(bits, widths, window), "row long, at long, shingle long, left int, around string").join(prefixes, "shingle")
    begin = F.col("left") - F.col("offset")
    same = (begin >= 0) & (F.array_join(F.slice(F.split("around", " "), F.greatest(begin, F.lit(0)) + 1, F.col("n")), " ") == F.col("words"))
    start = F.col("at") - F.col("offset")
    hits = met.where(same).select("row", F.struct(start.cast("long").alias("start"), (start + F.col("n")).cast("long").alias("end")).alias("span"), "item")
    found = hits.groupBy(F.col("row").alias(key)).agg(F.collect_set("span").alias(spans), F.collect_set("item").alias(items))
    return keyed.join(found, key, "left").mapInArrow(_finishing(carried, spans, items), kinds)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_bytes: int = MOST_BYTES, carried: list[str] | None = None) -> DataFrame:
    """The carried columns of each document (doc_id, if none are named), n_words, merged word spans covered by benchmark windows, and the items (as strings) that occur."""
    arrow_ready(documents.sparkSession)
    carried = ["doc_id"] if carried is None else carried
    docs = documents.select(*dict.fromkeys([*carried, "text"]))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(carried).schema), _FOUND])
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    cuts = cut(items.mapInArrow(_cutting(window, shingle), "item string, words string, n int, shingles array<long>"), "windows")
    once = cuts.dropDuplicates(["words"])
    grams = once.select("words", "n", F.posexplode("shingles").alias("offset", "shingle"))
    widths = sorted(r["width"] for r in once.select(F.least("n", F.lit(shingle)).alias("width")).distinct().collect())  # `shingle` of them at most
    rows = []
    if widths:
        counted = docs.select("text").mapInArrow(_counting(_bit_table(grams.select("shingle")), widths), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("seen"))
        rarest = grams.join(counted, "shingle", "left").groupBy("words", "n").agg(F.min(F.struct("seen", "shingle", "offset")).alias("s"), F.count_if(F.col("seen").isNull()).alias("unseen")).where("unseen = 0")
        prefixes = rarest.select("words", "n", F.least("n", F.lit(shingle)).alias("width"), "s.shingle", "s.offset").join(cuts.select("words", "item").distinct(), "words")
        prefixes = cut(prefixes, "prefixes")
        if (prefixes.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64).alias("n")).first()["n"] or 0) > most_bytes:
            return _joined(docs, prefixes, widths, window, carried, kinds)
        rows = prefixes.collect()  # most_bytes at most
    return docs.withColumn(found := unused(docs.columns, "found"), _matching(rows)(F.col("text"))).select(*(F.col(f"`{c}`") for c in carried), f"{found}.*")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from contamination()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
