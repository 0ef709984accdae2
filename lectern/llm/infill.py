"""Fill-in-the-middle over an index of distinct texts.

Documents are grouped by the SHA-256 of their text, and the group's texts themselves are compared: a group is one set of
equal texts, or the query stops. For each distinct text the byte offsets at which its code points begin are computed
once and kept as an Elias-Fano list: the low bits of each offset, and the high bits in unary with a running count of
ones for each block of 512 bits, a quarter to half a byte for each code point. The list is joined with the documents that
hold the text; each has a seed of its own, and each seeded cut is one select in the list, which says at which byte to slice.

Only texts that are not the same within a task are shuffled, once. A text that more than `crowd` documents share is
indexed once, stored, and dealt out in blocks of about `crowd` documents, so that no group meets in one task.

Nulls: a null text is empty, and an empty text is plain. A null doc_id is seeded as the empty word and stays null. Repeated
rows, and rows with one doc_id, get their own row each. Ties: equal cuts give an empty middle. Very long texts are read
whole; offsets are found in steps. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import STEP_BYTES, arrow_ready, cut

#: Markers of the three parts, and the percentages of documents that are cut and, of these, that begin with the suffix.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT, SUFFIX_FIRST = 90, 20
SEED = "1:"
#: Documents of one text that are handled in one row; more are dealt out in blocks.
CROWD = 1024
#: Bits of a block, for which the ones before it are known.
BLOCK = 512

LIST = T.StructType([T.StructField("units", T.LongType()), T.StructField("width", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("lows", "highs", "ranks"))])


def encoded(data: bytes) -> dict:
    """The Elias-Fano list of the offsets at which code points of UTF-8 bytes begin, and of their end."""
    a = np.frombuffer(data, np.uint8)
    units = int(np.count_nonzero((a & 0xC0) != 0x80))
    width = max(0, (len(a) // max(1, units)).bit_length() - 1)
    high = np.zeros((len(a) >> width) + units + 1, bool)
    low = np.zeros((units + 1) * width, bool)
    done = 0
    for at in range(0, len(a) + 1, STEP_BYTES):
        part = np.flatnonzero((a[at : at + STEP_BYTES] & 0xC0) != 0x80) + at
        if at + STEP_BYTES > len(a):
            part = np.append(part, len(a))
        number = np.arange(done, done + len(part))
        high[(part >> width) + number] = True
        for b in range(width):
            low[number * width + b] = (part >> b) & 1
        done += len(part)
    ones = np.add.reduceat(high, np.arange(0, len(high), BLOCK), dtype=np.int64)
    return {"units": units, "width": width, "lows": np.packbits(low).tobytes(), "highs": np.packbits(high).tobytes(), "ranks": np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<i8").tobytes()}


def selected(found: dict, at: list[int]) -> list[int]:
    """The elements at these places of a list: the block that holds each one's bit, and then its bit."""
    highs, lows = np.frombuffer(found["highs"], np.uint8), np.frombuffer(found["lows"], np.uint8)
    ranks, width, out = np.frombuffer(found["ranks"], "<i8"), found["width"], []
    for i in at:
        block = int(np.searchsorted(ranks, i, "right")) - 1
        bits = np.flatnonzero(np.unpackbits(highs[block * BLOCK // 8 : (block + 1) * BLOCK // 8]))
        value = (block * BLOCK + int(bits[i - ranks[block]]) - i) << width
        for b in range(width):
            bit = i * width + b
            value |= (int(lows[bit >> 3]) >> (7 - (bit & 7)) & 1) << b
        out.append(value)
    return out


@F.arrow_udf(LIST)
def boundaries(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("units", pa.int64()), ("width", pa.int32()), ("lows", pa.binary()), ("highs", pa.binary()), ("ranks", pa.binary())])
    return pa.array([encoded(t.as_buffer()) for t in texts.cast(pa.large_binary())], kind)


@F.arrow_udf(T.ArrayType(T.LongType()))
def offsets(lists: pa.Array, at: pa.Array) -> pa.Array:
    return pa.array([selected(x.as_py(), y.as_py()) for x, y in zip(lists, at, strict=True)], pa.list_(pa.int64()))


def indexed(rows: DataFrame, *also: Column) -> DataFrame:
    """key, text and its list, a row for each distinct text; the texts of a key must be one."""
    found = rows.groupBy("key").agg(F.collect_set("text").alias("texts"), *also)
    one = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("two texts have one key")))
    return found.withColumn("text", one).drop("texts").withColumn("list", boundaries("text"))


def _draw(doc_id: Column, seed: str, number: int) -> Column:
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, seed: str = SEED, cut_share: int = CUT, suffix_first: int = SUFFIX_FIRST, crowd: int = CROWD, key: Column | None = None) -> DataFrame:
    """doc_id, text, n (code points), form, prefix_chars, middle_chars and output, a row for each document."""
    arrow_ready(documents.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.sha2("text", 256) if key is None else key)
    crowded = cut(rows.groupBy("key").count().where(F.col("count") > crowd).select("key", F.ceil(F.col("count") / crowd).alias("blocks")), "crowded")
    few = indexed(rows.join(crowded, "key", "left_anti"), F.collect_list(F.struct("doc_id")).alias("docs")).select("text", "list", "docs")
    many = rows.join(crowded, "key")
    texts = cut(indexed(many, F.max("blocks").alias("blocks")), "crowded-texts")
    dealt = texts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    members = many.groupBy("key", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("doc_id")).alias("docs"))
    # merged, not broadcast: a text is there once for each of its blocks
    held = few.unionByName(dealt.hint("merge").join(members, ["key", "block"]).select("text", "list", "docs"))

    units = F.col("list.units")
    places = lambda d: (F.pmod(_draw(d["doc_id"], seed, 0), units + 1), F.pmod(_draw(d["doc_id"], seed, 1), units + 1))
    at = F.flatten(F.transform("docs", lambda d: F.array(F.least(*places(d)), F.greatest(*places(d)))))
    held = held.withColumn("at", at).withColumn("bytes", offsets("list", "at"))
    pairs = lambda c: F.transform(F.sequence(F.lit(0), F.size("docs") - 1), lambda i: F.struct(F.get(c, i * 2).alias("lo"), F.get(c, i * 2 + 1).alias("hi")))
    each = held.select("text", units.alias("n"), F.explode(F.arrays_zip(F.col("docs").alias("d"), pairs(F.col("at")).alias("at"), pairs(F.col("bytes")).alias("bytes"))).alias("x"))
    each = each.select(F.col("x.d.doc_id").alias("doc_id"), "text", "n", F.col("x.at").alias("at"), F.col("x.bytes").alias("bytes"))

    doc_id = F.col("doc_id")
    plain = (F.col("n") == 0) | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (_draw(doc_id, seed, 2) % 100 >= cut_share)
    form = F.when(plain, "plain").when(_draw(doc_id, seed, 3) % 100 < suffix_first, "spm").otherwise("psm")
    each = each.withColumn("form", form)
    data, lo, hi = F.col("text").cast("binary"), F.col("bytes.lo").cast("int"), F.col("bytes.hi").cast("int")
    part = lambda a, b: F.substring(data, a + 1, b - a).cast("string")
    prefix, middle, suffix = part(F.lit(0), lo), part(lo, hi), part(hi, F.octet_length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return each.select("doc_id", "text", "n", "form", chars(F.col("at.lo")).alias("prefix_chars"), chars(F.col("at.hi") - F.col("at.lo")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form. No marker is in a text that was cut, and none can arise where parts meet."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "spm", F.concat(second, third, first)).otherwise(F.concat(first, third, second))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle_sql() -> str:
    """The same, in DuckDB's SQL."""
    h = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"
    marked = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    p, m, s = "substr(t, 1, lo)", "substr(t, lo + 1, hi - lo)", "substr(t, hi + 1)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, length(t)::BIGINT AS n FROM d),
c AS (SELECT *, least({h(0)} % (n + 1), {h(1)} % (n + 1)) AS lo, greatest({h(0)} % (n + 1), {h(1)} % (n + 1)) AS hi,
  CASE WHEN n = 0 OR {marked} OR {h(2)} % 100 >= {CUT} THEN 'plain' WHEN {h(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || {s} || '{PREFIX}' || {p} || '{MIDDLE}' || {m} ELSE '{PREFIX}' || {p} || '{SUFFIX}' || {s} || '{MIDDLE}' || {m} END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
