"""URL filter: rules first, then the likelihood ratio of two variable-order Markov models over characters.

One model is fitted on accepted URLs, one on rejected ones. The probability of a character mixes all context lengths up
to ORDER with the Witten-Bell weights of the contexts: a context seen often with few successors counts for much, one
never seen hands over to the next shorter one. A URL's score is the difference of the two log-likelihoods per character.
The threshold is calibrated on accepted URLs that were not fitted on: the largest value of a fixed grid, at most 0, below
which no more than `REFUSED` of them fall.

The models read the whole host, path and query of every URL that no rule decides. Labels come from the rules (a URL that
a rule decides is an example for that verdict; the host's end and the path's start that this very rule names are not read
in it, as the models would only learn to stretch the rules) and from examples that the caller may pass. Of each verdict a
bounded sample is fitted: the distinct URLs with the smallest hashes, `per_class` of them at most, and of these in turn each that
fits into the `FIT_CHARS` characters that all together may have. Each URL is read whole. A rule's verdict always stands; the
models judge the rest, and what they know is what rules and examples show.

Nulls: a null URL, or one without `://`, has an empty host and path, no rule, and is judged by its characters (none for
null). A URL without characters has ratio 0 and passes. Without both classes of labels everything is allowed, with ratio
and threshold 0. Examples with a null url, or another verdict than allow or block, are ignored. Repeated rows are judged
each and fitted once. Ties: of rules of one length that fit, the one that sorts first decides; a ratio equal to the
threshold passes. Very long URLs are judged whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_ready, column_bytes, cut, mix, part_of, steps

ORDER = 5
PER_CLASS = 20_000
SLOTS = 1 << 17
#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Characters of all URLs together that are fitted for a verdict.
FIT_CHARS = 8 << 20
#: Characters that one vectorised step takes.
STEP_CHARS = 1 << 16
#: Share of accepted URLs that the calibrated threshold may refuse.
REFUSED = 0.05


def parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column, by name."""
    after = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]], value) -> Column:
    """Of the longest rule that fits, value(rule)."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
        out = F.when(fits, F.lit(value(r))) if out is None else out.when(fits, F.lit(value(r)))
    return F.lit(None).cast("string") if out is None else out


@dataclass
class Counts:
    """Hashed counts of one class: for each order of contexts, n of (context, character), n and kinds of (context)."""

    pair: np.ndarray
    context: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, urls: list[bytes], order: int = ORDER) -> Counts:
        out = cls(*(np.zeros((order + 1, SLOTS), np.float64) for _ in range(3)))
        seen = np.zeros((order + 1, SLOTS * 32), np.uint8)  # a bit for each character after each context
        for _, pairs, contexts, chars in _steps(urls, order):
            for k in range(order + 1):
                out.pair[k] += np.bincount(pairs[k], minlength=SLOTS)
                out.context[k] += np.bincount(contexts[k], minlength=SLOTS)
                after = np.unique(contexts[k] * 256 + chars)
                np.bitwise_or.at(seen[k], after >> 3, np.left_shift(1, after & 7).astype(np.uint8))
        for k in range(order + 1):
            out.kinds[k] = np.bitwise_count(seen[k]).reshape(SLOTS, 32).sum(axis=1)
        return cls(*(x.astype(np.float32) for x in (out.pair, out.context, out.kinds)))

    def log_likelihood(self, pairs: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(pairs[0]), 1 / 256)
        for k in range(len(pairs)):
            n, t = self.context[k][contexts[k]], self.kinds[k][contexts[k]]
            p = np.where(n > 0, (self.pair[k][pairs[k]] + t * p) / np.maximum(n + t, 1e-9), p)
        return np.log(p)


def _slots(urls: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order, slots of (context, character) and of (context) at each character and at the end of each URL."""
    c = np.frombuffer(b"\0".join([*urls, b""]), np.uint8)
    begin = np.repeat(np.concatenate(([0], np.cumsum([len(u) + 1 for u in urls])[:-1])).astype(np.int64), [len(u) + 1 for u in urls])
    at = np.arange(len(c))
    h = np.zeros(len(c), np.uint64)
    pairs, contexts = [], []
    for k in range(order + 1):
        if k:
            back = at - k
            inside = back >= begin
            h = mix(h * np.uint64(0x100000001B3) + np.where(inside, c[np.maximum(back, 0)].astype(np.uint64) + np.uint64(2), np.uint64(1)))
        contexts.append((h % np.uint64(SLOTS)).astype(np.int64))
        pairs.append((mix(h + c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SLOTS)).astype(np.int64))
    return pairs, contexts, c


def _steps(urls: list[bytes], order: int, most: int | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """For each character in turn, in bounded steps, the URL that it is in and its slots. A long URL is taken in parts, each with the characters before it that contexts look back at."""
    most = most or STEP_CHARS
    for at, some in steps(urls, most):
        if len(some) > 1 or len(some[0]) <= most:
            yield at + np.repeat(np.arange(len(some)), [len(u) + 1 for u in some]), *_slots(some, order)
            continue
        u = some[0]
        for i in range(0, len(u) + 1, most):
            before = min(i, order)
            # the end mark is there in the last part only
            part = slice(before, None if i + most > len(u) else -1)
            pairs, contexts, c = _slots([u[i - before : i + most]], order)
            yield np.full(len(c[part]), at), [x[part] for x in pairs], [x[part] for x in contexts], c[part]


@dataclass
class Ratio:
    allow: Counts
    block: Counts
    threshold: float = 0.0

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Mean over characters of log P(accepted) - log P(rejected)."""
        sizes, total = np.array([len(u) + 1 for u in urls], np.int64), np.zeros(len(urls))
        for owner, pairs, contexts, _ in _steps(urls, len(self.allow.pair) - 1):
            d = self.allow.log_likelihood(pairs, contexts) - self.block.log_likelihood(pairs, contexts)
            first = owner[0] if len(owner) else 0
            sums = np.bincount(owner - first, d)
            total[first : first + len(sums)] += sums
        out = total / sizes
        out[sizes == 1] = 0
        return out


def comparable(url: bytes, rule: str | None = None) -> bytes:
    """What the models read: the whole host, path and query, A-Z lower-cased, digits alike; of a URL that a rule decides, without that rule's own labels and start of the path."""
    rest = url.split(b"://", 1)[-1].split(b"#", 1)[0].lower().translate(bytes(0x30 if 0x30 <= c <= 0x39 else c for c in range(256)))
    if not rest:
        return b""
    end = next((i for i, c in enumerate(rest) if c in b"/?"), len(rest))
    host, tail = rest[:end], rest[end:]
    if rule is not None:
        labels, slash, path = rule.partition("/")
        host = host[: max(0, len(host) - len(labels.encode()))].rstrip(b".")
        tail = tail[len((slash + path).encode()) :]
    return host + (tail if tail.startswith(b"/") else b"/" + tail)


def fit(labelled: list[tuple[bytes, str]]) -> Ratio | None:
    """From (what the models read of a URL, verdict); one of five is kept for calibration."""
    chosen = sorted(set(labelled))
    used = [x for i, x in enumerate(chosen) if i % 5]
    if not {"allow", "block"} <= {v for _, v in used}:
        return None
    models = {}
    for verdict in ("allow", "block"):
        models[verdict] = Counts.of([u for u, v in used if v == verdict])
    out = Ratio(models["allow"], models["block"])
    if good := [u for u, v in chosen[::5] if v == "allow"]:
        s, grid = out.scores(good), np.linspace(-1, 0, 101)
        fine = [g for g in grid if (s < g).mean() <= REFUSED]
        out.threshold = float(max(fine, default=grid[0]))
    return out


def _judging(model: Ratio | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = batch.column(4).to_pylist()
            urls = [comparable(u, r) if u else b"" for u, r in zip(column_bytes(batch, "url"), rules, strict=True)]
            s = model.scores(urls) if model else np.zeros(len(urls))
            passed = s >= model.threshold if model else np.ones(len(urls), bool)
            passed |= np.array([not u for u in urls], bool)
            said = ["allow" if x else "block" for x in passed]
            kept = [r if r is not None else v for r, v in zip(batch.column(5).to_pylist(), said, strict=True)]
            limit = pa.array(np.full(len(urls), model.threshold if model else 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4)), pa.array(kept, pa.string()), pa.array(s), limit], ["page_id", "host", "path", "rule", "verdict", "ratio", "threshold"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, per_class: int = PER_CLASS, examples: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio, threshold: a row for each row of pages (page_id, url). Examples: (url, verdict)."""
    arrow_ready(pages.sparkSession)
    rules = RULES if rules is None else rules
    host, path = parts("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    ruled = rows.select("*", _rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]).alias("rule"), _rule(F.col("host"), F.col("path"), rules, lambda r: r[0]).alias("ruled"))
    labelled = ruled.where("ruled IS NOT NULL").select("url", "rule", "ruled")
    if examples is not None:
        labelled = labelled.unionByName(examples.where("url IS NOT NULL AND verdict IN ('allow', 'block')").select("url", F.lit(None).cast("string").alias("rule"), F.col("verdict").alias("ruled")))
    labelled = labelled.withColumn("h", F.xxhash64("url"))
    sizes = {r["ruled"]: r["n"] for r in labelled.groupBy("ruled").agg(F.approx_count_distinct("h").alias("n")).collect()}
    sample = []
    for verdict, n in sorted(sizes.items()):
        # the hash chooses among rows first, so that only chosen URLs are shuffled to tell them apart
        chosen = labelled.where((F.col("ruled") == verdict) & part_of(F.col("h"), per_class, n)).select("h", "url", "rule").distinct()
        chosen = cut(chosen.withColumn("size", F.octet_length("url")), "labelled-urls")
        told = chosen.select("h", "size").orderBy("h", "size").limit(per_class).collect()
        taken, left = [], FIT_CHARS
        for r in told:
            if r["size"] <= left:
                taken.append((r["h"], r["size"]))
                left -= r["size"]
        wanted = F.broadcast(pages.sparkSession.createDataFrame(taken, "h long, size int").distinct())  # `per_class` rows at most
        found = chosen.join(wanted, ["h", "size"]).select("url", "rule").collect()
        sample += [(comparable(r["url"].encode("utf-8", "surrogatepass"), r["rule"]), verdict) for r in found]
    return ruled.mapInArrow(_judging(fit(sample)), "page_id long, host string, path string, rule string, verdict string, ratio double, threshold double")
