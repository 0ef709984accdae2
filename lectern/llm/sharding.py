"""Shards of bounded size by extendible hashing.

A directory is indexed by the leading bits of each document's hash. It starts as one bucket; a bucket that is over the
byte limit splits on the next bit, others stay, so shards have as many leading bits in common as they need and no more.
The directory is found from sums of bytes by prefix, which are made on the executors: documents are summed up into
cells of `cell` leading bits (a fixed number of cells at most), cells into all their shorter prefixes, and a cell's
shard is its shortest prefix that is within the limit. Cells that are over the limit themselves are split on their next
bits in further rounds, which read only their documents' ids and sizes.

Documents whose hashes agree in all bits (rows with one id) cannot be split by bits: such a bucket overflows into a
chain of numbered pages, over which its rows are dealt by a salt until every page is within the limit. One document over
the limit has a page of its own.

Nulls: a null text has 0 bytes; rows with null doc_id share the hash of the word `null`. Repeated rows each get their
row. Ties: rows of one hash share a bucket; on a chain any of them may be on any page. Very long texts are sized, not read
into anything. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, unused

LIMIT = 32 << 20
#: Bits of the hash; the first 15 hexadecimal digits of md5.
BITS = 60
CELL = 14
HASH_DIGITS = 15


def hash_bits(doc_id: Column) -> Column:
    """60 bits, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, HASH_DIGITS), 16, 10).cast("long")


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def _round(sized: DataFrame, done: int, cell: int, limit: int) -> DataFrame:
    """For rows whose first `done` bits name an oversized cell: each prefix of `cell` bits with the depth and bytes of its shard, null if it is over the limit itself."""
    cells = sized.groupBy(_prefix(F.col("hash"), cell).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"))
    levels = cells.select("prefix", "bytes", F.explode(F.sequence(F.lit(done), F.lit(cell))).alias("depth")).withColumn("top", F.expr(f"shiftright(prefix, {cell} - depth)"))
    fits = levels.groupBy("depth", "top").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    if not done:  # 2 ** (cell + 1) rows at most: every task can hold them, and no prefix's cells have to meet in one
        fits = F.broadcast(fits)
    best = levels.join(fits, ["depth", "top"]).groupBy("prefix").agg(F.min("depth").alias("depth"))
    shards = best.withColumn("top", F.expr(f"shiftright(prefix, {cell} - depth)")).join(fits, ["depth", "top"])
    return cells.select("prefix").join(shards.select("prefix", "depth", "shard_bytes"), "prefix", "left")


def assign(documents: DataFrame, limit: int = LIMIT, cell: int = CELL, carried: list[str] | None = None) -> DataFrame:
    """doc_id, hash, n_bytes, shard (its bits, and the page of a chain), depth, page, shard_bytes, global_depth, after the carried columns (none, if none are named)."""
    own = [f"`{c}`" for c in carried or []]
    sized = documents.select(*own, F.col("doc_id").cast("long").alias("doc_id"), hash_bits(F.col("doc_id")).alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    sized = cut(sized, "sized")
    rows, done, parts = sized, 0, []
    while True:
        upto = min(BITS, done + cell)
        leaves = cut(_round(rows, done, upto, limit), "directory")
        placed = rows.withColumn("prefix", _prefix(F.col("hash"), upto)).join(leaves, "prefix", "left").drop("prefix")
        parts.append(placed.where("depth IS NOT NULL").withColumn("page", F.lit(0).cast("long")))
        if leaves.where("depth IS NULL").isEmpty():
            break
        rows = placed.where("depth IS NULL").drop("depth", "shard_bytes")
        if upto == BITS:
            parts.append(_chains(rows, limit, own))
            break
        rows, done = cut(rows, "oversized"), upto
    if len(parts) > 1:
        parts = [cut(p, "placed") for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    deepest = out.agg(F.max("depth").alias("d")).first()["d"]
    name = F.substring(F.lpad(F.bin("hash"), BITS, "0"), F.lit(1), F.col("depth").cast("int"))
    return out.select(*own, "doc_id", "hash", "n_bytes", F.concat(name, F.when(F.col("page") > 0, F.concat(F.lit("."), F.col("page"))).otherwise(F.lit(""))).alias("shard"), F.col("depth").cast("long").alias("depth"), F.col("page").cast("long").alias("page"), F.col("shard_bytes").cast("long").alias("shard_bytes"), F.lit(deepest).cast("long").alias("global_depth"))


def _chains(rows: DataFrame, limit: int, own: list[str]) -> DataFrame:
    """Pages for rows with one hash: rows are dealt by a salt into so many pages as make each fit twice over; a page that is still too large is dealt again."""
    parts, n = [], 0
    sums = rows.groupBy("hash").agg(F.sum("n_bytes").alias("all"))
    rows = rows.join(sums, "hash").withColumn("first", F.lit(1).cast("long"))
    while True:
        n += 1
        pages = F.ceil(F.col("all") * 2 / F.lit(limit)).cast("long")
        dealt = cut(rows.select(*own, "doc_id", "hash", "n_bytes", "crc", "first", pages.alias("pages"), (F.col("first") + F.pmod(F.xxhash64("crc", "n_bytes", F.monotonically_increasing_id(), F.lit(n)), pages)).alias("page")), "dealt")
        total = dealt.groupBy("hash", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("held"))
        placed = dealt.join(total, ["hash", "page"])
        small = F.expr(f"shard_bytes <= {limit} OR held = 1")
        columns = [*own, "doc_id", "hash", "n_bytes", "crc", F.lit(BITS).alias("depth"), "shard_bytes", "page"]
        parts.append(placed.where(small).select(*columns))
        rows = placed.where(~small)
        if rows.isEmpty():
            break
        over = rows.select("hash", "page", "shard_bytes").distinct().groupBy("hash").agg(F.sum("shard_bytes").alias("all"))
        last = dealt.groupBy("hash").agg(F.max(F.col("first") + F.col("pages")).alias("next"))
        rows = rows.join(over, "hash").join(last, "hash").select(*own, "doc_id", "hash", "n_bytes", "crc", "all", F.col("next").alias("first"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_shards(documents: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes each row of documents once, under the folder shard=<bits> of its shard; rows are named by a key of their own, as doc_ids can be null or repeated, and joined by it, not collected."""
    key = unused(documents.columns, "row_key")
    keyed = cut(documents.withColumn(key, F.monotonically_increasing_id()), "keyed")
    placed = assign(keyed, limit, carried=[key]).select(F.col(f"`{key}`"), "shard")
    keyed.join(placed, key).drop(key).repartition("shard").write.partitionBy("shard").parquet(path)
