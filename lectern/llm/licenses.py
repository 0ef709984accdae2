"""License passages by diagonal voting, in DataFrame operations only.

Every template is a list of words. All rolling word k-grams of all documents are hashed and joined with the hashes of
the templates' k-grams; a gram at word p that equals a template's gram at word t votes for the diagonal p - t. Votes are
summed up by document, template and diagonal; diagonals of one template that are at most `gap` apart belong to one
passage with inserted or dropped words, and are merged. A merged passage is verified by the share of the template's grams
that it holds in the template's order, each at most `gap` diagonals from the one before: all of a short template's, three
quarters of a longer one's, as whole licenses come with other names and years. A diagonal that holds all grams of a template is an exact place. Hashes only find candidates:
the join also compares the words.

Short names and notices are known by pairs of words. Pairs of a whole license stand in any text, so a template of more than LONG
words is known by WIDE words in a row; these are looked up by their first pair too, in the same join.

The templates are a fixed, small table (their number is checked), so their side is broadcast and the grams of the
corpus are never shuffled; only votes and a row for each document are.

Nulls: a null text has no words, no places and score 0. Repeated rows, and rows with one doc_id or none, get their own
row each. Ties: a gram that stands in a template more than once, or in several templates, votes for each. Very long texts are
read whole; a step of the verification looks at a template's grams, so it takes time in proportion to a passage's votes. A template
may have any number of words, so whole licenses are among them.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a gram, at least two; no template is shorter. Words of a gram of a template that is longer than LONG.
K = 2
WIDE, LONG = 6, 30
GAP = 3
#: Words of a template up to which all its grams are needed; the share that a longer one needs.
SHORT = 6
SHARE = 0.75
MOST_GRAMS = 10_000

#: The phrases whose places are counted.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Further names and notices of licenses, as they are published.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("creative commons attribution", "cc-by"),
    ("cc by 4 0", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("creative commons zero", "cc0"),
    ("all rights reserved", "reserved"),
]

#: Whole licenses, as they are published, without the lines that name a holder.
WHOLE = {
    "mit": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
    """,
    "isc": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.
    """,
    "bsd": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
    """,
    "unlicense": """
        This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large
        and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
    """,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def template_of(text: str) -> str:
    """The words of a license's text, as templates have them."""
    return " ".join(w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w)


KNOWN = [*NOTICES, *((template_of(text), label) for label, text in WHOLE.items())]


def _templates(spark: SparkSession, base: list[tuple[str, str]], notices: list[tuple[str, str]], k: int) -> DataFrame:
    rows = []
    for number, (phrase, label) in enumerate([*base, *notices]):
        words = phrase.split()
        if len(words) < k:
            raise ValueError(f"a template has {k} words at least: {phrase!r}")
        width = WIDE if len(words) > LONG else k
        rows += [(number, label, number < len(base), len(words), width, t, words[t : t + width]) for t in range(len(words) - width + 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError("too many templates to send to every task")
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, length int, width int, at int, gram array<string>").coalesce(1)
    return grams.select("template", "label", "base", "length", "width", "at", *(F.get("gram", F.lit(i)).alias(f"t{i}") for i in range(max(k, WIDE)))).withColumn("gram_hash", F.xxhash64(*(f"t{i}" for i in range(k))))


def votes(documents: DataFrame, base: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, k: int = K) -> DataFrame:
    """A row for each vote, and one with null template for each document (at its last word, or null without words)."""
    known = _templates(documents.sparkSession, BASE if base is None else base, KNOWN if notices is None else notices, k)
    most = max(k, WIDE)
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    shifted = docs.select("row", "doc_id", F.col("words").alias("w0"), *(F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{i}") for i in range(1, most)))
    rolled = shifted.select("row", "doc_id", F.posexplode_outer(F.arrays_zip(*(f"w{i}" for i in range(most)))).alias("pos", "g")).select("row", "doc_id", "pos", "g.*")
    whole = F.col(f"w{k - 1}").isNotNull()
    hashed = rolled.withColumn("gram_hash", F.when(whole, F.xxhash64(*(f"w{i}" for i in range(k)))))
    # the words past a template's gram are null in it
    same = F.expr(" AND ".join(["d.gram_hash = t.gram_hash", *(f"w{i} = t{i}" for i in range(k)), *(f"(t{i} IS NULL OR coalesce(w{i} = t{i}, false))" for i in range(k, most))]))
    met = hashed.alias("d").join(F.broadcast(known.alias("t")), same, "left")
    last = F.col("w1").isNull()
    return met.where(F.col("template").isNotNull() | last).select("row", "doc_id", F.when(last, F.coalesce(F.col("pos") + 1, F.lit(0))).alias("n_words"), "template", "label", "base", "length", "width", "at", "pos")


def passages(found: DataFrame, gap: int = GAP) -> DataFrame:
    """Merged passages: row, doc_id, template, label, base, start, stop (words), coverage, score, accepted, exact places (number, first, last); documents' own rows stay, with n_words."""
    by_row = found.repartition("row")
    lines = by_row.groupBy("row", "doc_id", "template", "label", "base", "length", "width", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.max("n_words").alias("n_words"), F.count("at").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_list("at").alias("ats"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    grouped = lines.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1)))
    grouped = grouped.withColumn("passage", F.sum("new").over(order)).withColumn("exact", F.col("votes") == F.col("length") - F.col("width") + 1)
    spans = grouped.groupBy("row", "doc_id", "template", "label", "base", "length", "width", "passage").agg(
        F.max("n_words").alias("n_words"), F.min("first").alias("start"), (F.max("last") + F.first("width")).alias("stop"), F.collect_list(F.struct("diagonal", "ats")).alias("lines"),
        F.count_if("exact").alias("places"), F.min(F.when(F.col("exact"), F.col("diagonal"))).alias("first_place"), F.max(F.when(F.col("exact"), F.col("diagonal"))).alias("last_place"),
    )
    grams = F.col("length") - F.col("width") + 1
    needed = F.when(F.col("length") <= SHORT, F.lit(1.0)).otherwise(F.lit(SHARE))
    spans = spans.withColumn("held", F.when(F.size("lines") == 1, F.size(F.get("lines", F.lit(0))["ats"])).otherwise(F.size(F.array_distinct(F.flatten(F.col("lines.ats"))))))
    # on one line grams are in order; of several lines that hold too few in any order nothing more is asked
    open_ = (F.size("lines") > 1) & (F.col("places") == 0) & (F.col("held") >= needed * grams)
    held = F.when(open_, in_order(F.col("lines"), grams, gap)).otherwise(F.col("held"))
    spans = spans.withColumn("coverage", held / grams).drop("lines")
    return spans.withColumn("accepted", F.coalesce(F.col("coverage") >= needed, F.lit(False)))


def in_order(lines: Column, grams: Column, gap: int) -> Column:
    """Of votes given by diagonal and the template's positions on it, the most that follow each other: in the order of the text, each at
    a later position of the template, and at most `gap` diagonals from the last vote there was for the position before it."""
    placed = lambda x: F.transform(x["ats"], lambda t: F.struct((x["diagonal"] + t).alias("pos"), (-t).alias("down"), x["diagonal"].alias("diagonal")))
    votes = F.array_sort(F.flatten(F.transform(lines, placed)))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("diagonal"))
    start = F.struct(F.lit(0).alias("best"), F.transform(F.sequence(F.lit(0), grams - 1), lambda _: none).alias("ends"))

    def step(a: Column, v: Column) -> Column:
        before = F.filter(F.slice(a["ends"], F.lit(1), -v["down"]), lambda e: (e["n"] > 0) & (F.abs(e["diagonal"] - v["diagonal"]) <= gap))
        n = F.coalesce(F.array_max(F.transform(before, lambda e: e["n"])), F.lit(0)) + 1
        ends = F.transform(a["ends"], lambda e, t: F.when(t == -v["down"], F.struct(n.alias("n"), v["diagonal"].alias("diagonal"))).otherwise(e))
        return F.struct(F.greatest(a["best"], n).alias("best"), ends.alias("ends"))

    return F.aggregate(votes, start, step, lambda a: a["best"])


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns, a row for each document."""
    place = F.col("base") & (F.col("places") > 0)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(place, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(place, F.col("first_place"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("last_place"))).cast("long").alias("last_word"),
        joined(F.when(place, F.col("label"))).alias("base_labels"),
        joined(F.when(place | F.col("accepted"), F.col("label"))).alias("labels"),
        F.round(F.coalesce(F.max(F.when(place | F.col("accepted"), F.col("coverage"))), F.lit(0.0)), 6).alias("score"),
    )
    return out.drop("row")


def oracle_sql() -> str:
    """The same, in DuckDB's SQL, without hashes."""
    known = ", ".join(f"({n}, '{p}', '{label}', {str(n < len(BASE)).lower()})" for n, (p, label) in enumerate([*BASE, *KNOWN]))
    return rf"""
WITH RECURSIVE t AS (SELECT template, label, base, string_split(phrase, ' ') AS tw FROM (VALUES {known}) v(template, phrase, label, base)),
tw AS (SELECT *, CASE WHEN len(tw) > {LONG} THEN {WIDE} ELSE {K} END AS width FROM t),
tg AS (SELECT template, label, base, len(tw) - width + 1 AS grams, len(tw) AS length, i - 1 AS place, {", ".join(f"CASE WHEN width > {i} THEN tw[i + {i}] END AS t{i}" for i in range(WIDE))} FROM tw, range(1, (SELECT max(len(tw)) FROM t)) r(i) WHERE i + width - 1 <= len(tw)),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, {", ".join(f"unnest(w[{i + 1}:]) AS w{i}" for i in range(WIDE))}, unnest(range(0, len(w))) AS pos FROM d),
met AS MATERIALIZED (SELECT rid, template, label, base, length, grams, pos, place, pos - place AS diagonal FROM p JOIN tg ON w0 = t0 AND w1 = t1 AND (t2 IS NULL OR ({" AND ".join(f"w{i} = t{i}" for i in range(2, WIDE))}))),
votes AS (SELECT rid, template, label, base, length, grams, diagonal, count(*) AS votes, list(place) AS ats FROM met GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {GAP} THEN 0 ELSE 1 END AS fresh FROM votes WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
numbered AS MATERIALIZED (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal)::BIGINT AS passage FROM marked),
spans AS MATERIALIZED (
  SELECT rid, template, label, base, length, grams, passage, len(list_distinct(flatten(list(n.ats)))) AS held, count(*) AS lines, count(*) FILTER (votes = grams) AS places, CASE WHEN length <= {SHORT} THEN 1.0 ELSE {SHARE} END AS needed,
    min(diagonal) FILTER (votes = grams) AS first_place, max(diagonal) FILTER (votes = grams) AS last_place
  FROM numbered n GROUP BY rid, template, label, base, length, grams, passage
),
unsure AS (
  SELECT rid, template, passage, m.grams, m.place, m.diagonal, row_number() OVER (PARTITION BY rid, template, passage ORDER BY m.pos, m.place DESC) AS number
  FROM spans JOIN numbered n USING (rid, template, passage) JOIN met m USING (rid, template, diagonal) WHERE lines > 1 AND places = 0 AND held >= needed * m.grams
),
walk AS (
  SELECT rid, template, passage, 0::BIGINT AS number, 0::BIGINT AS best, list_transform(range(0, grams), lambda i: 0::BIGINT) AS ends, list_transform(range(0, grams), lambda i: 0::BIGINT) AS lines FROM unsure WHERE number = 1
  UNION ALL
  SELECT rid, template, passage, number, greatest(best, n), list_transform(range(0, grams), lambda i: CASE WHEN i = place THEN n ELSE ends[i + 1] END), list_transform(range(0, grams), lambda i: CASE WHEN i = place THEN diagonal ELSE lines[i + 1] END)
  FROM (SELECT u.*, w.best, w.ends, w.lines, 1 + coalesce(list_max(list_transform(list_filter(range(0, u.place), lambda i: w.ends[i + 1] > 0 AND abs(w.lines[i + 1] - u.diagonal) <= {GAP}), lambda i: w.ends[i + 1])), 0) AS n
    FROM walk w JOIN unsure u ON u.rid = w.rid AND u.template = w.template AND u.passage = w.passage AND u.number = w.number + 1)
),
ordered AS (SELECT rid, template, passage, max(best) AS best FROM walk GROUP BY ALL),
told AS (SELECT *, base AND places > 0 AS place, (base AND places > 0) OR coverage >= needed AS good FROM (SELECT s.*, coalesce(best, held) / grams AS coverage FROM spans s LEFT JOIN ordered USING (rid, template, passage)))
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, coalesce(sum(places) FILTER (place), 0)::BIGINT AS n_base,
  (min(first_place) FILTER (place))::BIGINT AS first_word, (max(last_place) FILTER (place))::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (place)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (good)), ','), '') AS labels,
  round(coalesce(max(coverage) FILTER (good), 0)::DOUBLE, 6) AS score
FROM d LEFT JOIN told USING (rid) GROUP BY d.rid, d.doc_id
"""
