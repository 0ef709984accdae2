"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set is that of its distinct word shingles (all words as one if it has fewer). SuperMinHash gives each
element of the set a random rank in a random permutation of the signature's slots: at level j an element offers j + u to
the slot its permutation has at j, and a slot keeps the least offer. As the offers of level j + 1 all exceed those of
level j, a document stops as soon as every slot is filled by a level reached. Signatures are cut into bands.

1. Documents with equal sets form a class, known by its smallest doc_id; from here on only classes count.
2. Classes that agree on a band meet in its bucket. The bucket's pivot is the class that meets most others in all its
   buckets (the centre of a group of copies); every class of the bucket is compared with the pivot on full sets, and is
   near it or far from it. Near classes are linked.
3. Links are grouped by union-find inside each partition, then across partitions by the spread of smallest labels with
   pointer jumping.
4. Classes that were compared with one pivot p, and are in different groups so far, may still be similar if one of them is
   far from p. What they have in common does not tell them apart, so sets are written as their differences D from the
   centre of p's classes (the elements that more than half of them have): |x ^ y| = |D(x) ^ D(y)|. With the reach
   R(x) = |D(x)| - k |x|, k = (100 - similarity) / (100 + similarity), x and y are similar iff they share at least
   (R(x) + R(y)) / 2 elements of D(x) and D(y). If that is 0 or less, both are similar to the class with the smallest
   reach, which is enough to group them. All others must share an element, and then, in one order of all elements by
   rarity among p's classes, an element of the necessary prefixes of D(x) and D(y) (those of a set join; the shorter ones
   for the class with the smaller reach). Classes are joined on these, and pairs that pass the size and positional bounds
   are verified on full sets. No element of more than half of the classes is in any D, those of one class or one group
   alone are not joined, and the commonest come last, so what a template repeats meets nobody; no pair that shares a bucket
   is left out.

A pair at the threshold shares no bucket with probability (1 - t**rows)**bands: 3e-6 for the defaults.

Nulls: a null, empty or blank text has an empty set and is linked with nothing; a row with null doc_id is linked with
nothing, has no component and is not kept. Rows that share a doc_id count as one document when links are followed, but
each row gets its own result. Ties: of classes that meet equally many others the smallest id is the pivot; which one it is
changes what is compared, not what is linked. Very long texts are read whole, words in parts. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import BLANK_BYTES, Words, arrow_ready, column_bytes, cut, mix, steps, windows

WORDS = 5
#: In hundredths.
SIMILARITY = 80
BANDS = 32
ROWS = 5


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one document's word hashes."""
    return np.unique(windows(h, min(words, len(h)))) if len(h) else h


def superminhash(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots, level in the top byte) of the sets that stand one after the other in `elements`.

    Level by level for all documents at once; those whose slots are all filled by a level reached drop out."""
    docs = np.repeat(np.arange(len(counts)), counts)
    out = np.full((len(counts), slots), 0xFFFFFFFF, np.uint32)
    flat = out.reshape(-1)
    order = None
    for level in range(slots):
        u = mix(elements + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = level + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            row = np.arange(len(elements))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, level]
        np.minimum.at(flat, docs * slots + slot, np.uint32(level << 24) | (u >> np.uint64(40)).astype(np.uint32))
        if level + 1 == slots:
            break
        going = (out.max(1) >> np.uint32(24)) > level
        stay = going[docs]
        if not stay.any():
            break
        if order is None:
            picked = pick[stay]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(picked), 1))
            order[np.arange(len(picked)), picked] = 0
        else:
            order = order[stay]
        elements, docs = elements[stay], docs[stay]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band, unlike those of other bands."""
    s = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), 1))
    for k in range(rows):
        h = mix(h * np.uint64(0x100000001B3) + s[:, :, k])
    return h


def _signing(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, keys = [], [], [], []
            for _, texts in steps(column_bytes(batch, "text")):
                w = Words(texts, BLANK_BYTES)
                sets = [shingle_set(w.hashes[a:b], words) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                counts = np.array([len(s) for s in sets])
                some = counts > 0
                n += counts.tolist()
                one += [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                two += [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                got = iter(band_keys(superminhash(np.concatenate([s for s in sets if len(s)]), counts[some], bands * rows), bands, rows).astype(np.int64) if some.any() else [])
                keys += [next(got) if x else [] for x in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "one", "two", "keys"])

    return run


def _comparing(words: int, similarity: int):
    """Pairs (x, p) to whether their full sets are similar, the size of x's and the elements in which they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            near, sizes, differ = [], [], []
            for xt, pt in zip(column_bytes(batch, "x_text"), column_bytes(batch, "p_text"), strict=True):
                if pt != last[0]:
                    last = (pt, shingle_set(Words([pt], BLANK_BYTES).hashes, words))
                s, t = shingle_set(Words([xt], BLANK_BYTES).hashes, words), last[1]
                apart = np.setxor1d(s, t, assume_unique=True)
                near.append(bool(len(s) and len(t)) and (100 + similarity) * len(apart) <= (100 - similarity) * (len(s) + len(t)))
                sizes.append(len(s))
                differ.append(apart.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(differ, pa.list_(pa.int64()))], ["x", "p", "near", "n", "differ"])

    return run


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (x, p) of a partition to one link from each node to the smallest node of its group."""
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        top = a
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[a] != top:
            parent[a], a = top, parent[a]
        return top

    for batch in batches:
        for x, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(x), root(p)
            parent[max(a, b)] = min(a, b)
    nodes = [k for k in parent if root(k) != k]
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(k) for k in part], pa.int64())], ["x", "p"])


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the links (x, p)."""
    forest = links.mapInArrow(union_find, "x long, p long").distinct()
    ends = cut(forest.select(F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("p").alias("near")), F.struct(F.col("p").alias("node"), F.col("x").alias("near")))).alias("e")).select("e.*"), "ends")
    labels = cut(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        heard = ends.join(labels.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(F.min("component").alias("heard"))
        new = labels.join(heard, "node").select("node", F.least("component", "heard").alias("next"), "component")
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("top"))
        labels = cut(new.join(up, "next").select("node", F.least("next", "top").alias("component"), (F.least("next", "top") != F.col("component")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "component")


def _compared(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    with_x = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("x_text")), "x")
    with_p = with_x.join(texts.select(F.col("doc_id").alias("p"), F.col("text").alias("p_text")), "p")
    kind = "x long, p long, near boolean, n long, differ array<long>"
    return with_p.select("x", "p", "x_text", "p_text").mapInArrow(_comparing(words, similarity), kind)


def _centred(compared: DataFrame, labels: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Classes of pivots that some class is far from, with their differences from the centre (p, x, n, component, reach,
    apart; reach in units of 1 / (100 + similarity)), and how many classes hold an element that more than one does (p, token, held, size)."""
    # what is joined by pivot is stored first: its size is known then, so a small one is sent to all tasks, and with a large one a
    # pivot of many classes can be split
    pivots = cut(compared.groupBy("p").agg(F.count("*").alias("size"), F.max(~F.col("near")).alias("far")).where("far AND size > 1").select("p", "size"), "pivots")
    members = compared.join(pivots, "p").select("p", "x", "n", "size", "differ")
    counts = cut(members.select("p", "size", F.explode("differ").alias("token")).groupBy("p", "token").agg(F.count("*").alias("held"), F.max("size").alias("size")).where("held > 1"), "counts")
    # the pivot is one of the classes; an array is no longer than twice the mean difference
    common = cut(counts.where("2 * held > size + 1").groupBy("p").agg(F.collect_list("token").alias("common")), "common")
    group = labels.select(F.col("node").alias("x"), "component")
    moved = F.concat(F.array_except("differ", "common"), F.array_except("common", "differ"))
    apart = F.when(F.col("common").isNull(), F.col("differ")).otherwise(moved)
    rows = members.join(common, "p", "left").join(group, "x", "left").select("p", "x", "n", F.coalesce("component", "x").alias("component"), apart.alias("apart"))
    reach = F.size("apart") * (100 + similarity) - F.col("n") * (100 - similarity)
    return cut(rows.select("p", "x", "n", "component", reach.alias("reach"), "apart"), "centred"), counts


def _prefixes(centred: DataFrame, counts: DataFrame, similarity: int) -> DataFrame:
    """Elements of necessary prefixes that classes of different groups hold: p, token, x, n, component, reach, differ (how many), at, short (whether in the shorter prefix)."""
    tokens = centred.select("p", "x", "n", "component", "reach", F.size("apart").alias("differ"), F.explode("apart").alias("token"))
    # elements of one class alone come first, as the rarest, and meet nothing; they only count for the places of others
    met = tokens.join(counts.select("p", "token", F.least("held", F.col("size") + 1 - F.col("held")).alias("often")), ["p", "token"])
    own = Window.partitionBy("p", "x")
    met = met.withColumn("at", F.col("differ") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "token")) - 1)
    least = F.greatest(F.lit(1), F.col("differ") - F.floor(F.col("n") * (100 - similarity) / similarity))
    shorter = F.greatest(F.lit(1), F.ceil(F.col("reach") / (100 + similarity)))
    kept = met.where(F.col("at") <= F.col("differ") - least).withColumn("short", F.col("at") <= F.col("differ") - shorter).drop("often")
    rows = cut(kept, "prefixes")
    mixed = rows.groupBy("p", "token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("short").alias("any")).where("a <> b AND any").select("p", "token")
    return cut(rows.join(mixed, ["p", "token"], "left_semi"), "mixed")


def _meetings(prefixes: DataFrame, similarity: int) -> DataFrame:
    """Pairs of classes that meet in a prefix element and pass the size and positional bounds, a row for each such element."""
    y = prefixes.where("short").select("p", "token", *(F.col(c).alias(f"y_{c}") for c in ("x", "n", "component", "reach", "differ", "at")))
    once = (F.col("component") != F.col("y_component")) & ((F.col("y_reach") < F.col("reach")) | ((F.col("y_reach") == F.col("reach")) & (F.col("y_x") < F.col("x"))))
    size = F.least("n", "y_n") * 100 >= F.greatest("n", "y_n") * similarity
    # if this is the first element that the two share, no more than the shorter rest of them is shared
    shared = F.least(F.col("differ") - F.col("at"), F.col("y_differ") - F.col("y_at"))
    return prefixes.join(y, ["p", "token"]).where(once & size & (shared * 2 * (100 + similarity) >= F.col("reach") + F.col("y_reach")))


def _far_pairs(compared: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """Pairs of classes that were compared with one pivot, are in different groups and may be similar."""
    centred, counts = _centred(compared, labels, similarity)
    first = cut(centred.groupBy("p").agg(F.min(F.struct("reach", "x", "component")).alias("first")), "first")
    sure = centred.drop("apart").join(first, "p").where((F.col("reach") + F.col("first.reach") <= 0) & (F.col("component") != F.col("first.component"))).select("x", F.col("first.x").alias("y_x"))
    pairs = sure.unionByName(_meetings(_prefixes(centred, counts, similarity), similarity).select("x", "y_x"))
    return pairs.select(F.greatest("x", "y_x").alias("x"), F.least("x", "y_x").alias("p")).distinct()


def near_duplicates(documents: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of documents."""
    arrow_ready(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInArrow(_signing(words, bands, rows), "doc_id long, n_shingles long, one long, two long, keys array<long>"), "signed")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(real.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "classes")
    every = classes.select("rep", F.explode("keys").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(every.join(shared, "bucket").select("bucket", "rep", "n"), "members")
    met = members.groupBy("rep").agg(F.sum("n").alias("met"))
    ranked = members.select("bucket", "rep").join(met, "rep")
    pivots = ranked.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("met"), "rep")).alias("s")).select("bucket", F.col("s.rep").alias("p"))
    pairs = cut(members.join(pivots, "bucket").where("rep <> p").select(F.col("rep").alias("x"), "p").distinct(), "pairs")
    labels = None
    if not pairs.isEmpty():
        # one row of each id and text, however often it is repeated
        texts = cut(docs.join(met.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").distinct(), "texts")
        compared = cut(_compared(pairs, texts, words, similarity), "compared")
        links = compared.where("near").select("x", "p")
        labels = components(links)
        more = cut(_far_pairs(compared, labels, similarity), "far")
        if not more.isEmpty():
            links = links.unionByName(cut(_compared(more, texts, words, similarity).where("near").select("x", "p"), "links"))
            labels = components(links)
    return _result(signed, classes, labels)


def _result(signed: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows keep their own id but for those of classes with copies or links, which are looked up."""
    named = classes.select("one", "two", "rep", "copies")
    if labels is None:
        moved = named.where("copies > 1").select("one", "two", F.col("rep").alias("component"))
    else:
        moved = named.join(labels.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 OR component <> rep").select("one", "two", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), F.col("one")).alias("one"), "two").join(moved, ["one", "two"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
