"""Queries that apply each corpus operator, with its production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import alignment, chat, decontaminate, infill, language, licenses, lmscore, neardup, packing, quality, secretscan, sharding, urls
from lectern.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recovered(table(spark, sf_dir, "conversations"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.passages(licenses.votes(table(spark, sf_dir, "documents"))))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmscore.score_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("learnt_score").alias("score"), F.col("score").alias("vocabulary_score"), "estimated_score", "train_types")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "threshold")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.spans(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(table(spark, sf_dir, "documents")))


def packing_of_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 where its three limits bind: turns of conversations, of which only answers bear loss."""
    return packing.pack_turns(table(spark, sf_dir, "conversations"))


#: Bytes of a shard in the query that shows shards of small tables.
SMALL_SHARDS = 256 << 10


def sharding_of_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 with a limit that splits small tables too."""
    return sharding.assign(table(spark, sf_dir, "documents"), SMALL_SHARDS)


#: Bytes of a shard at which some buckets split once more than their neighbours.
UNEVEN_SHARDS = 160 << 10


def sharding_of_uneven_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 where only the buckets that are too large split on another bit, so depths differ."""
    return sharding.assign(table(spark, sf_dir, "documents"), UNEVEN_SHARDS)


def quality_base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4's figures without the ratio, and what the base rules make of them."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3's counts and its unigram score over words."""
    return op3_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"), "train_types")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8's parts of URLs, and the verdicts that its rules give."""
    return op8_url_filter(spark, sf_dir).where("rule IS NOT NULL").select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op")}
    return found | {f.__name__: f for f in (packing_of_instructions, sharding_of_small_shards, sharding_of_uneven_shards, quality_base_figures, lm_base_scores, url_rules)}


def _sharding(limit: int) -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash, coalesce(strlen(text), 0)::BIGINT AS n_bytes
  FROM documents
), levels AS (
  SELECT depth::BIGINT AS depth, hash >> (60 - depth) AS top, sum(n_bytes)::BIGINT AS shard_bytes
  FROM sized, range(0, 41) r(depth) GROUP BY ALL HAVING sum(n_bytes) <= {limit}
), best AS (
  SELECT s.doc_id, s.hash, s.n_bytes, min(l.depth) AS depth
  FROM sized s JOIN levels l ON s.hash >> (60 - l.depth) = l.top GROUP BY ALL
)
SELECT b.doc_id, b.hash, b.n_bytes, left(lpad(bin(b.hash), 60, '0'), b.depth::INT) AS shard, b.depth, 0::BIGINT AS page, l.shard_bytes,
  (max(b.depth) OVER ())::BIGINT AS global_depth
FROM best b JOIN levels l ON l.depth = b.depth AND l.top = b.hash >> (60 - b.depth)
"""


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_DECONTAMINATION = f"""
WITH b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM s, range(1, (SELECT max(len(w)) + 1 FROM s)) r(i) WHERE i + n - 1 <= len(w)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM spots, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hit AS (SELECT rid, i, n, item_id FROM g JOIN win USING (n, g)),
covered AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_SPACED.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
often AS (SELECT rid, g FROM g GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS at_word FROM g JOIN often USING (rid, g)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN hit USING (rid)
"""

#: crc32 has no name in that engine: its table, and the sum over a text's bytes.
_CRC_TABLE = "SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
_LM = f"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC} % 10 = 0 AS held_out, list_concat({_SPACED.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")}, [' ']) AS w FROM documents, crc),
tokens AS (SELECT rid, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score FROM tokens LEFT JOIN c USING (word), n GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 4) AS base_score, v AS train_types FROM d JOIN s USING (rid), n
"""

_HOST = f"translate(regexp_extract(after, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
_FITS = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
h AS (SELECT page_id, {_HOST} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN {_FITS('example.net', '/en/')} THEN 'example.net/en/' WHEN {_FITS('example.com', '/de/')} THEN 'example.com/de/' WHEN {_FITS('org', '/fr/')} THEN 'org/fr/' WHEN {_FITS('net', '/')} THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r WHERE rule IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle_sql(), "op6_sharding": _sharding(sharding.LIMIT), "sharding_of_small_shards": _sharding(SMALL_SHARDS), "sharding_of_uneven_shards": _sharding(UNEVEN_SHARDS), "op9_decontamination": _DECONTAMINATION, "quality_base_figures": _QUALITY, "lm_base_scores": _LM, "url_rules": _URLS, "op12_secret_scan": secretscan.oracle_sql(), "op13_fill_in_middle": infill.oracle_sql()}
