"""Secrets by pattern and by a battery of randomness tests, in DataFrame operations only.

Three kinds are found by pattern: assignments to names of secrets, access keys and long hexadecimal runs. A fourth,
`random`, is what a battery of tests finds among all runs of at least LEAST symbols that could encode bytes:

* The encoding is inferred: the smallest alphabet of ENCODINGS that has all of a run's symbols.
* Three tests hold the run against symbols drawn evenly from that alphabet: chi-squared for their counts, runs above and
  below the alphabet's middle, and the serial correlation of neighbours. Each gives a standardised deviation, and their
  squares add up to a chi-squared value of three degrees of freedom; a run beyond its 99th percentile is not random.
* False discoveries are ordinary words that pass. So what is left is held against ordinary writing: all words of the
  corpus that are too short to be a candidate give the symbols' frequencies, and with them the mean and variance of the
  number of equal pairs that a word of n symbols has. A run with far fewer equal pairs has a small p-value, and only a long
  one can have a very small one. Benjamini and Hochberg's procedure keeps the share of false discoveries below RATE,
  for each encoding and each length (by powers of two) on its own, so that many short words neither hide the long secrets
  nor are let in with them. Each distinct run is one test, however often it is repeated.

p-values are bounded from above (p <= exp(-z*z/2)/2), in steps of an eighth of a deviation, which errs on the side of
keeping a run out. Positions are code points; an assignment's span is its whole match, and a run's has the `=` that pad it.

Matches, not texts, are shuffled and stored. Only tables of a bounded size are broadcast: symbols, encodings and thresholds.

Nulls: a null text is empty. Null doc_id stays null. Repeated rows, and rows with one doc_id, get their own row each. Ties: spans
that begin together stand in the order of KINDS; runs with one deviation are found or not together. Very long texts are
read whole, and their matches are placed by one running sum for each document and kind. A run of one symbol, of which no
correlation can be computed, is not random. Extra columns are ignored. An empty table gives no rows; without ordinary
words nothing is `random`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut

#: The patterns, letters of the first in either case, and the characters that a match (its value, of an assignment) has at least.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Symbols of a run that is tested, and the share of false discoveries.
LEAST = 16
RATE = 0.01
#: The 99th percentile of chi-squared with three degrees of freedom (a fixed value).
MOST = 11.345
#: Steps of a deviation, and the largest that is told apart.
STEPS, FAR = 8, 512

SYMBOLS = "A-Za-z0-9+/_-"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from the smallest to the largest; the first that has all symbols of a run is its encoding.
ENCODINGS = [
    ("decimal", _DIGITS), ("hex", _DIGITS + _LOWER[:6]), ("upper hex", _DIGITS + _UPPER[:6]), ("lower", _LOWER), ("upper", _UPPER), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER),
    ("upper base36", _DIGITS + _UPPER), ("letters", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64 for urls", _UPPER + _LOWER + _DIGITS + "-_"), ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
]


def _class(alphabet: str) -> str:
    return "[" + alphabet.replace("-", "") + ("-" if "-" in alphabet else "") + "]+"


def _one_case(alphabet: str) -> bool:
    return alphabet in (alphabet.lower(), alphabet.upper())


def _patterns(least: int) -> tuple[str, str, str, str]:
    # a run or a key that is too short can be left out at once, as it ends where the longer one would; an assignment cannot
    return ASSIGN, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", f"[0-9a-f]{{{HEX_LEAST},}}", f"[{SYMBOLS}]{{{least},}}={{0,2}}"


def matches(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """row, doc_id, kind (its place in KINDS), start, stop and value of each match, and a row with null kind for a document without any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def found(kind: int, pattern: str) -> Column:
        parts = F.transform(F.split("text", pattern, -1), F.length)
        every = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        placed = F.zip_with(F.transform(every, lambda m, i: F.struct(i.alias("nth"), m.alias("value"))), F.slice(parts, F.lit(1), F.size(every)), lambda m, gap: F.struct(F.lit(kind).alias("kind"), m["nth"].alias("nth"), gap.alias("gap"), m["value"].alias("value")))
        return F.when(F.col("text").rlike(pattern), placed).otherwise(F.array().cast("array<struct<kind: int, nth: int, gap: int, value: string>>"))

    each = docs.select("row", "doc_id", F.explode_outer(F.concat(*(found(k, p) for k, p in enumerate(_patterns(least))))).alias("m")).select("row", "doc_id", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("nth")
    each = each.repartition("row").withColumn("stop", F.sum(F.col("gap") + F.length("value")).over(so_far)).withColumn("start", F.col("stop") - F.length("value"))
    return each.select("row", "doc_id", "kind", "start", "stop", "value")


def measured(found: DataFrame) -> DataFrame:
    """Adds, to runs that may be random: token (without padding), encoding, n, the pairs of equal symbols and the battery's sum."""
    token = F.when(F.col("kind") == 3, F.rtrim(F.col("value"), F.lit("=")))
    encoding, alphabet = F, F
    for name, symbols in ENCODINGS:
        fits = F.col("token").rlike(rf"\A{_class(symbols)}\z")
        encoding, alphabet = encoding.when(fits, F.lit(name)), alphabet.when(fits, F.lit(symbols))
    found = found.withColumn("token", token).withColumn("encoding", encoding).withColumn("alphabet", alphabet).withColumn("n", F.length("token").cast("double"))
    times = lambda s: (F.length("token") - F.length(F.replace("token", s))).cast("long")
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0).cast("long"), lambda a, s: a + times(s) * times(s))
    found = found.withColumn("squares", squares).withColumn("v", F.transform(F.split("token", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("long")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    v, size = F.col("v"), F.length("alphabet").cast("double")
    after = F.concat(F.slice("v", F.lit(2), F.size("v")), F.slice("v", F.lit(1), F.lit(1)))
    high = lambda x: x * 2 >= F.length("alphabet")
    found = found.withColumns({
        "size": size, "high": total(F.transform(v, lambda x: high(x).cast("long"))), "changes": total(F.zip_with(v, after, lambda x, y: (high(x) != high(y)).cast("long"))),
        "ring": (high(F.get(v, F.lit(0))) != high(F.element_at(v, -1))).cast("double"), "sum_v": total(v), "sum_v2": total(F.transform(v, lambda x: x * x)), "sum_next": total(F.zip_with(v, after, lambda x, y: x * y)),
    })
    return found.withColumn("battery", F.expr(_BATTERY)).withColumn("pairs", (F.col("squares") - F.col("n")) / 2).drop("v", "alphabet", "size", "high", "changes", "ring", "sum_v", "sum_v2", "sum_next", "squares")


#: The three deviations, squared and added. A change on the way back to the first symbol ends no run.
_MEAN = "(2 * high * (n - high) / n + 1)"
_TESTS = (
    "(size / n * squares - n - (size - 1)) / sqrt(2 * (size - 1) * (n - 1) / n)",
    f"(changes - ring + 1 - {_MEAN}) / sqrt(({_MEAN} - 1) * ({_MEAN} - 2) / (n - 1))",
    "((n * sum_next - sum_v * sum_v) / (n * sum_v2 - sum_v * sum_v) + 1 / (n - 1)) / sqrt(n * n / ((n - 1) * (n - 1) * (n - 2)))",
)
_BATTERY = f"CASE WHEN high > 0 AND high < n AND n > 2 THEN {' + '.join(f'({x}) * ({x})' for x in _TESTS)} END"
#: How many deviations fewer equal pairs a run has than ordinary writing of its length, in steps.
_FEWER = "n * (n - 1) / 2 * s2 - pairs"
_SPREAD = "n * (n - 1) / 2 * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * greatest(s3 - s2 * s2, 0)"


def ordinary(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """encoding, s2 and s3: sums of squares and cubes of the frequencies that its symbols have in all shorter words of the corpus. For an alphabet of one case, letters of either case count."""
    words = documents.select(F.explode(F.split("text", f"[^{SYMBOLS}]+")).alias("word")).where((F.length("word") > 0) & (F.length("word") < least))
    counts = words.groupBy("word").agg(F.count("*").alias("times"))
    symbols = counts.select("times", F.explode(F.split("word", "")).alias("symbol")).groupBy("symbol").agg(F.sum("times").cast("double").alias("times"))
    known = [(name, s, written) for name, alphabet in ENCODINGS for s in alphabet for written in ({s.lower(), s.upper()} if _one_case(alphabet) else {s})]
    of = documents.sparkSession.createDataFrame(known, "encoding string, letter string, symbol string").coalesce(1).join(F.broadcast(symbols), "symbol").groupBy("encoding", "letter").agg(F.sum("times").alias("times"))
    totals = of.groupBy("encoding").agg(F.sum("times").alias("total"))
    share = F.col("times") / F.col("total")
    return of.join(F.broadcast(totals), "encoding").groupBy("encoding").agg(F.round(F.sum(share * share), 9).alias("s2"), F.round(F.sum(share * share * share), 9).alias("s3"))


def tested(found: DataFrame, usual: DataFrame) -> DataFrame:
    """Adds band (of lengths), steps (of the deviation from ordinary writing) and passed (the battery)."""
    found = found.join(F.broadcast(usual), "encoding", "left")
    spread = F.expr(_SPREAD)
    steps = F.when(spread > 0, F.least(F.greatest(F.floor(F.expr(_FEWER) / F.sqrt(spread) * STEPS), F.lit(0)), F.lit(FAR)).cast("int"))
    return found.withColumn("steps", F.coalesce(steps, F.lit(0))).withColumn("passed", F.coalesce(F.col("battery") <= MOST, F.lit(False))).withColumn("band", F.length(F.bin(F.length("token").cast("long")))).drop("s2", "s3", "battery", "pairs", "n")


def thresholds(found: DataFrame, rate: float = RATE) -> DataFrame:
    """encoding, band and the steps from which runs are found, where there are any; at most a row for each length of each encoding."""
    distinct = found.where("kind = 3").select("encoding", "band", "steps", "passed", "token").distinct()
    counts = distinct.groupBy("encoding", "band", "steps").agg(F.count("*").alias("tests"), F.count_if("passed").alias("passes"))
    counts = counts.withColumn("tests", F.sum("tests").over(Window.partitionBy("encoding", "band")))
    counts = counts.withColumn("passes", F.sum("passes").over(Window.partitionBy("encoding", "band").orderBy(F.desc("steps"))))
    z = F.col("steps") / STEPS
    good = (F.col("steps") > 0) & (F.col("passes") > 0) & (F.col("tests") * 0.5 * F.exp(-z * z / 2) <= F.col("passes") * rate)
    return counts.where(good).groupBy("encoding", "band").agg(F.min("steps").alias("least_steps"))


def spans(documents: DataFrame, least: int = LEAST, rate: float = RATE) -> DataFrame:
    """row, doc_id, kind, start, stop (code points, end exclusive), value and encoding (of what is random): a row for each span, and one with null kind for each document without any."""
    found = cut(tested(measured(matches(documents, least)), cut(ordinary(documents, least), "ordinary")), "matches")
    limits = cut(thresholds(found, rate), "thresholds")
    value = F.regexp_extract("value", ASSIGN, 2)
    held = found.join(F.broadcast(limits), ["encoding", "band"], "left")
    good = F.when(F.col("kind") == 0, F.length(value) >= ASSIGN_LEAST).when(F.col("kind") < 3, F.lit(True)).otherwise(F.col("passed") & (F.col("steps") >= F.col("least_steps")))
    kept = F.coalesce(good, F.lit(False))
    null = lambda c: F.when(kept, F.col(c)).alias(c)
    return held.select("row", "doc_id", *(null(c) for c in ("kind", "start", "stop", "value", "encoding")))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, a row for each document, and the number of random runs."""
    of = lambda k: F.count_if(F.col("kind") == k).cast("long")
    names = F.array(*map(F.lit, KINDS))
    place = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "stop"))
    rows = found.groupBy("row", "doc_id").agg(of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), of(3).alias("n_random"), F.array_sort(F.collect_list(place)).alias("spans"))
    spelled = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def oracle_sql() -> str:
    """The same, in DuckDB's SQL."""
    either = "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in "password|passwd|secret|token|api_?key")
    patterns = [ASSIGN.replace("(?i)", "").replace("password|passwd|secret|token|api_?key", either).replace("'", "''"), *_patterns(LEAST)[1:]]
    found = " UNION ALL ".join(f"SELECT rid, {k} AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gaps FROM d" for k, p in enumerate(patterns))
    known = ", ".join(f"('{name}', '{alphabet}', {str(_one_case(alphabet)).lower()})" for name, alphabet in ENCODINGS)
    of = lambda i: " ".join(f"WHEN regexp_full_match(token, '{_class(alphabet)}') THEN '{(name, alphabet)[i]}'" for name, alphabet in ENCODINGS)
    total = lambda f: f"list_sum(list_transform(range(1, len(v) + 1), lambda i: {f}))::DOUBLE"
    spelled = lambda c: f"coalesce(string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER ({c}), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, kind, unnest(ms) AS value, unnest(gaps[1:len(ms)]) AS gap, unnest(range(0, len(ms))) AS nth FROM ({found})),
ends AS (SELECT *, (sum(length(gap) + length(value)) OVER (PARTITION BY rid, kind ORDER BY nth))::BIGINT AS stop FROM m),
placed AS MATERIALIZED (SELECT *, stop - length(value) AS start, rtrim(value, '=') AS token FROM ends),
words AS (SELECT unnest(regexp_split_to_array(t, '[^{SYMBOLS}]+')) AS word FROM d),
symbols AS (SELECT symbol, count(*)::DOUBLE AS times FROM (SELECT unnest(string_split(word, '')) AS symbol FROM words WHERE length(word) BETWEEN 1 AND {LEAST - 1}) GROUP BY symbol),
known AS (SELECT encoding, one, unnest(string_split(alphabet, '')) AS letter FROM (VALUES {known}) k(encoding, alphabet, one)),
letters AS (SELECT encoding, letter, sum(times) AS times FROM known JOIN symbols ON CASE WHEN one THEN lower(symbol) = lower(letter) ELSE symbol = letter END GROUP BY ALL),
shares AS (SELECT encoding, times / sum(times) OVER (PARTITION BY encoding) AS share FROM letters),
usual AS (SELECT encoding, round(sum(share * share), 9) AS s2, round(sum(share * share * share), 9) AS s3 FROM shares GROUP BY encoding),
runs AS (SELECT *, CASE {of(0)} END AS encoding, CASE {of(1)} END AS alphabet, length(token)::DOUBLE AS n FROM (SELECT DISTINCT token FROM placed WHERE kind = 3)),
coded AS (SELECT *, length(alphabet)::DOUBLE AS size, list_transform(string_split(token, ''), lambda c: (instr(alphabet, c) - 1)::BIGINT) AS v,
  list_sum(list_transform(string_split(alphabet, ''), lambda c: (length(token) - length(replace(token, c, ''))) ** 2))::DOUBLE AS squares FROM runs),
after AS (SELECT *, list_concat(v[2:], v[1:1]) AS w FROM coded),
figures AS (SELECT *, {total('(v[i] * 2 >= size)::INT')} AS high, {total('((v[i] * 2 >= size) <> (w[i] * 2 >= size))::INT')} AS changes, ((v[1] * 2 >= size) <> (v[-1] * 2 >= size))::INT::DOUBLE AS ring,
  {total('v[i]')} AS sum_v, {total('v[i] * v[i]')} AS sum_v2, {total('v[i] * w[i]')} AS sum_next, (squares - n) / 2 AS pairs FROM after),
told AS (SELECT token, encoding, length(bin(length(token))) AS band, coalesce({_BATTERY} <= {MOST}, false) AS passed,
  coalesce(CASE WHEN {_SPREAD} > 0 THEN least(greatest(floor(({_FEWER}) / sqrt({_SPREAD}) * {STEPS}), 0), {FAR})::INT END, 0) AS steps FROM figures LEFT JOIN usual USING (encoding)),
counts AS (SELECT encoding, band, steps, count(*) AS tests, count(*) FILTER (passed) AS passes FROM told GROUP BY ALL),
sums AS (SELECT encoding, band, steps, sum(tests) OVER (PARTITION BY encoding, band) AS tests, sum(passes) OVER (PARTITION BY encoding, band ORDER BY steps DESC) AS passes FROM counts),
limits AS (SELECT encoding, band, min(steps) AS least_steps FROM sums WHERE steps > 0 AND passes > 0 AND tests * 0.5 * exp(-(steps / {STEPS}) * (steps / {STEPS}) / 2) <= passes * {RATE} GROUP BY ALL),
kept AS (SELECT rid, kind, start, stop FROM placed LEFT JOIN told USING (token) LEFT JOIN limits USING (encoding, band)
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(value, '{patterns[0]}', 2)) >= {ASSIGN_LEAST} WHEN 3 THEN passed AND steps >= least_steps ELSE true END)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random,
  sha256({spelled('kind < 3')}) AS base_sha256, {spelled('kind IS NOT NULL')} AS spans
FROM d LEFT JOIN kept USING (rid) GROUP BY rid, doc_id
"""
