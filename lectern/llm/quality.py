"""Quality rules and a log-likelihood ratio of hashed n-grams, in DataFrame operations only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over the buckets are
counted: the raw corpus (all words of all documents) and the trusted target (all documents labelled as good but for one in four,
which are left to calibration). A document's score is the sum over its n-grams of log P(target) - log P(raw), over
the number of its n-grams. Every document gets a verdict from one threshold, which is calibrated on labelled documents
that were not counted for the target, all of them, by exact percentiles: halfway between the low end of good ones (all but `SPARED` of them are above it)
and the middle of bad ones, or `MARGIN` below that low end if no bad ones are labelled or their middle is above it.

Base rules count words, symbols, repeated lines and repeated 8-word windows. Windows are told apart by 64-bit hashes,
built by doubling (pairs, fours, eights). All of a document's figures are computed in its own row, from arrays, so no
text or word is shuffled; only bucket counts are.

Nulls: a null or blank text has no words, fails the base rules and has score 0. Labels with null doc_id, or null
quality and not toxic, are ignored; a document counts as good only if every label says so and none says toxic. Without labels the ratio is 0 for all and
only base rules decide. Repeated rows get a row each, and so do rows with null doc_id, which are judged but never trusted.
Ties: a ratio equal to the threshold is kept; of equal hashes in a sample any one may be chosen, as they are of one id. Very
long texts are judged whole, in their own row. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, part_of

#: Buckets for words, and as many for pairs.
BUCKETS = 1 << 13
#: Documents of the target, and of calibration: all that are labelled. A smaller number takes those with the smallest hashes.
TARGET_ROWS = ALL = sys.maxsize
CALIBRATION_ROWS = ALL
#: Labelled documents whose ids are sent to every task; of more, the texts are joined by a shuffle.
SENT_IDS = 250_000
#: Steps in which a place in the order of ratios is narrowed down, and rows that are looked at one by one in the end.
BINS = 4096
#: Counts added to each bucket.
SMOOTH = 1.0
SPARED = 0.005
MARGIN = 0.05
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _buckets(first: Column, second: Column) -> tuple[Column, Column]:
    """Buckets of a word (given its hash) and of the pair that it begins (null at the end)."""
    one = F.pmod(first, F.lit(BUCKETS)).cast("int")
    two = F.when(second.isNotNull(), (F.pmod(F.xxhash64(first, second), F.lit(BUCKETS)) + BUCKETS).cast("int"))
    return one, two


def _chosen(ids: DataFrame, rows: int) -> DataFrame:
    """Of distinct doc_ids, the `rows` with the smallest hashes, or all."""
    if rows >= ALL // 2:
        return ids
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    return ids.where(part_of(order, rows, ids.count())).orderBy(order).limit(rows)


def fit(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log ratios by bucket (array, one row), and the sample kept for calibration (doc_id, good)."""
    toxic = F.coalesce(F.col("toxic") > 0, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    marked = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | toxic)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.coalesce(F.min("quality") > 0, F.lit(False)) & ~F.max(toxic)).alias("good"))
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    target = _chosen(marked.where(F.col("good") & (part != 0)).select("doc_id"), TARGET_ROWS)
    kept = [_chosen(marked.where((F.col("good") if good else ~F.col("good")) & ((part == 0) if good else F.lit(True))).select("doc_id"), CALIBRATION_ROWS // 2).withColumn("good", F.lit(good)) for good in (True, False)]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the raw corpus needs no ids, so only the labelled texts are ever shuffled
    raw = _bucket_counts(docs.select("text"), "raw")
    trusted = _bucket_counts(_labelled(docs, cut(target, "target")), "target")
    counts = raw.join(F.broadcast(trusted), "bucket", "left").fillna(0, ["target"])
    return _ratios(counts), kept[0].unionByName(kept[1])


def _labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents that a stored table names, with its columns."""
    return docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id")


def _bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    """bucket and its number of words or pairs in all these texts: 2 * BUCKETS rows at most."""
    words = docs.select(words_of(F.col("text")).alias("words")).select("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("next"))
    pairs = words.select(F.explode(F.arrays_zip("words", "next")).alias("g")).select(F.xxhash64("g.words").alias("h"), F.when(F.col("g.next").isNotNull(), F.xxhash64("g.next")).alias("k"))
    one, two = _buckets(F.col("h"), F.col("k"))
    return pairs.select(F.explode(F.array(one, two)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name)).where("bucket IS NOT NULL")


def _ratios(counts: DataFrame) -> DataFrame:
    """One row with an array of log ratios for all buckets; words and pairs are two multinomials each. Buckets are a fixed number."""
    every = counts.sparkSession.range(2 * BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left").fillna(0, ["raw", "target"])
    kind = (F.col("bucket") >= BUCKETS).cast("int")
    totals = counts.groupBy((F.col("bucket") >= BUCKETS).cast("int").alias("kind")).agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    joined = every.withColumn("kind", kind).join(F.broadcast(totals), "kind")
    mass = SMOOTH * BUCKETS
    log_of = lambda n, of: F.log((F.col(n) + SMOOTH) / (F.col(of) + mass))
    ratio = F.when(F.col("all_target") > 0, log_of("target", "all_target") - log_of("raw", "all_raw")).otherwise(F.lit(0.0))
    pairs = joined.select("bucket", ratio.alias("r")).agg(F.array_sort(F.collect_list(F.struct("bucket", "r"))).alias("s"))
    return pairs.select(F.transform("s", lambda x: x["r"]).alias("ratios"))


def _rest(c: str, k: int) -> Column:
    return F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1)))


def _both(c: str, k: int) -> Column:
    return F.zip_with(c, _rest(c, k), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def _with_ratio(rows: DataFrame, ratios: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows with hashes of words in h1, and now of pairs in h2; their number of words and their log ratio by n-gram."""
    rows = rows.withColumn("h2", _both("h1", 1))
    rows, table = rows.withColumn("ratios", ratios.scalar()), F.col("ratios")
    total = F.aggregate("h1", F.lit(0.0), lambda s, h: s + F.element_at(table, F.pmod(h, F.lit(BUCKETS)).cast("int") + 1))
    total = F.aggregate("h2", total, lambda s, h: s + F.coalesce(F.element_at(table, F.pmod(h, F.lit(BUCKETS)).cast("int") + BUCKETS + 1), F.lit(0.0)))
    n = F.size("h1").cast("long")
    return rows, n, F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0))


def figures(documents: DataFrame, ratios: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """All figures of each document after its carried columns (doc_id, if none are named), without verdicts."""
    carried = ["doc_id"] if carried is None else carried
    docs = documents.select(F.struct(*carried).alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        "own",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h1"),
    )
    rest, both = _rest, _both
    rows, n, ratio = _with_ratio(rows, ratios)
    rows = rows.select("own", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", ratio.alias("ratio"), F.when(n > WINDOW, both("h2", 2)).alias("h4"), n.alias("n"))
    rows = rows.withColumn("h8", F.when(F.col("n") > WINDOW, F.slice(both("h4", 4), F.lit(1), F.greatest(F.size("h4") - (WINDOW - 1), F.lit(0))))).drop("h4")
    # only documents with a repeated window go on to find its places
    rows = rows.withColumn("h8", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.col("h8")))
    rows = rows.withColumn("placed", F.when(F.col("h8").isNotNull(), F.array_sort(F.zip_with("h8", F.sequence(F.lit(0), F.size("h8") - 1), lambda h, at: F.struct(h.alias("h"), at.alias("at")))))).drop("h8")
    rows = rows.withColumn("beside", F.when(F.col("placed").isNotNull(), F.arrays_zip(F.col("placed").alias("x"), rest("placed", 1).alias("y"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,at:int>")), F.slice("placed", F.lit(1), F.size("placed") - 1)).alias("w"))))
    rows = rows.drop("placed").withColumn("places", F.array_sort(F.transform(F.filter("beside", lambda z: F.coalesce(z["x"]["h"] == z["y"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["w"]["h"], F.lit(False))), lambda z: z["x"]["at"]))).drop("beside")
    covered = F.aggregate(F.zip_with("places", rest("places", 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    own = [F.col(f"own.`{c}`").alias(c) for c in carried]
    # a generator, as the optimiser would compute all of this again for every condition on one of the figures
    return rows.select(F.inline(F.array(F.struct(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "ratio"))))


def _calibrated(documents: DataFrame, ratios: DataFrame, sample: DataFrame) -> DataFrame:
    """good, ratio of the stored calibration documents that have words. Of more than are sent to the tasks, the ratios are joined and no texts."""
    docs, few = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample.count() <= SENT_IDS
    if few:
        docs = docs.join(F.broadcast(sample), "doc_id")
    carried = ["doc_id", "good"] if few else ["doc_id"]
    rows, n, ratio = _with_ratio(docs.select(*carried, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h1")), ratios)
    rows = rows.select(*carried, n.alias("n_words"), ratio.alias("ratio"))
    return cut((rows if few else rows.join(sample, "doc_id")).select("good", "n_words", "ratio"), "calibration").where("n_words > 0").select("good", "ratio")


def _at(values: DataFrame, place: int) -> float:
    """The ratio at a place, from 0, in the order of ratios: the rows are counted in BINS steps between the least and the largest,
    and so again in the step that holds the place, so that no task and no driver sees more than BINS rows of counts."""
    ends = values.agg(F.min("ratio").alias("low"), F.max("ratio").alias("high")).first()
    low, high = ends["low"], ends["high"]
    while low < high:
        within = values.where(F.col("ratio").between(low, high))
        step = F.least(F.floor((F.col("ratio") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in sorted(within.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("ratio").alias("low"), F.max("ratio").alias("high")).collect(), key=lambda r: r["step"]):
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def _percentile(values: DataFrame, n: int, part: float) -> float:
    """As percentile(), between neighbours in a straight line, of values too many for the map of one task."""
    at = part * (n - 1)
    first = int(at)
    low = _at(values, first)
    return low if at == first else low + (at - first) * (_at(values, first + 1) - low)


def threshold(documents: DataFrame, ratios: DataFrame, sample: DataFrame) -> float:
    """From the ratios of all calibration documents."""
    rows = _calibrated(documents, ratios, sample)
    n = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if True not in n:
        return float("-inf")
    low = _percentile(rows.where("good"), n[True], SPARED)
    middle = _percentile(rows.where("NOT good"), n[False], 0.5) if False in n else low
    return (low + middle) / 2 if middle < low else low - MARGIN


def judge(documents: DataFrame, labels: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Base figures, base_failed, kept, ratio, threshold after the carried columns (doc_id, if none are named): a row for each document."""
    ratios, sample = fit(documents, labels)
    ratios, sample = cut(ratios, "ratios"), cut(sample, "sample")
    limit = threshold(documents, ratios, sample)
    scored = figures(documents, ratios, carried)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= limit)).withColumn("threshold", F.lit(limit))
