"""Transcripts to turns: a hidden Markov model recovers who speaks, and turns are rendered in one canonical form.

States are a role with "begins a turn" or "goes on". A line that is not blank is observed by its speaker marker (if it
starts with one), whether a blank line stands before it, whether it is the first of its segment, its length and whether it
asks. Viterbi's best path gives every line its state; a state that begins a turn starts one, and its marker is taken off.

A transcript comes in segments (rows of conv_id and turn, in the order of turn, null turns first; rows with one turn in the
order of a hash of their texts). Rows are dealt out by ranges of that order, so that one endless conversation, whatever
its turn numbers are, is in many partitions, and each partition is cut as it streams by into blocks of one conversation, of `SEGMENTS`
segments or `BLOCK_BYTES` bytes. For a block that may not be a whole conversation the best score from every entry state to every
exit state is found in the same pass. These small matrices are multiplied up by partition, chained along each conversation, and
chained again inside each partition, which fixes each block's entry and exit state; blocks are then decoded on their
own. The path is the one that a single pass over the whole transcript would find.

Nulls: a null text has no lines; a conversation without lines gives no turns; null conv_id is a conversation of its own.
Repeated rows are repeated segments. Ties between paths go to the state that comes first. A very long text is a block of its
own, read whole. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_ready, cut

#: Segments and bytes of text at which a block ends.
SEGMENTS = 64
BLOCK_BYTES = 1 << 20
ROLES = ["system", "user", "assistant"]
STATES = [(r, begins) for r in ROLES for begins in (True, False)]
#: Speaker names as transcripts write them.
NAMES = {
    "system": ["system", "system prompt", "context"],
    "user": ["user", "human", "question", "q", "customer", "instruction", "prompter", "me", "you"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "model", "response", "agent", "chatbot", "gpt"],
}
_role_of = {n: r for r, names in NAMES.items() for n in names}
_names = "|".join(sorted(map(re.escape, _role_of), key=lambda n: -len(n)))
MARKER = re.compile(rf"\s*(?:<\|(?P<a>{_names})\|>|\[(?P<b>{_names})\]:?|#{{1,4}}\s*(?P<c>{_names})\s*:?\s*$|(?:\*\*)?(?P<d>{_names})(?:\*\*)?\s*:(?:\*\*)?|(?P<e>{_names})\s*>)\s*", re.IGNORECASE)

#: The model. Chance that the next turn is of a role, by the role before it (none: the first turn).
NEXT_ROLE = {None: (0.25, 0.7, 0.05), "system": (0.02, 0.93, 0.05), "user": (0.01, 0.04, 0.95), "assistant": (0.01, 0.96, 0.03)}
#: Chance that a line is the last of its turn; that a turn's first line has its own marker, or another role's; that a line
#: inside a turn looks like a marker; that a blank line stands before a first line, or inside.
LAST_LINE = {"system": 0.5, "user": 0.4, "assistant": 0.25}
MARKED, MISMARKED, INSIDE_MARKED = 0.72, 0.001, 0.002
BLANK_BEFORE, BLANK_INSIDE = 0.6, 0.06
#: Chance that a turn's first line, or one inside a turn, is the first of its segment.
OPENS, OPENS_INSIDE = 0.8, 0.005
#: Chances of lines under 80 characters, under 300 and longer; and of a question mark at the end.
LENGTHS = {"system": (0.4, 0.45, 0.15), "user": (0.45, 0.4, 0.15), "assistant": (0.3, 0.4, 0.3)}
ASKS = {"system": 0.01, "user": 0.25, "assistant": 0.04}


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """log chances of the first state, and of a state after a state."""
    first, then = np.full(len(STATES), -np.inf), np.full((len(STATES), len(STATES)), -np.inf)
    for j, (role, begins) in enumerate(STATES):
        if begins:
            first[j] = np.log(NEXT_ROLE[None][ROLES.index(role)])
        for i, (before, _) in enumerate(STATES):
            if begins:
                then[i, j] = np.log(LAST_LINE[before] * NEXT_ROLE[before][ROLES.index(role)])
            elif role == before:
                then[i, j] = np.log(1 - LAST_LINE[before])
    return first, then


FIRST, THEN = _transitions()


def _emissions() -> np.ndarray:
    """log chances in each state (columns) of each code of features (rows, see code_of)."""
    out = np.empty((4 * 2 * 2 * 3 * 2, len(STATES)))
    for code, (marker, blank, opens, size, asks) in enumerate(itertools.product((None, *ROLES), (0, 1), (0, 1), range(3), (0, 1))):
        for j, (role, begins) in enumerate(STATES):
            if begins:
                p = MARKED if marker == role else MISMARKED if marker else 1 - MARKED - 2 * MISMARKED
                p *= (BLANK_BEFORE if blank else 1 - BLANK_BEFORE) * (OPENS if opens else 1 - OPENS)
            else:
                p = INSIDE_MARKED / 3 if marker else 1 - INSIDE_MARKED
                p *= (BLANK_INSIDE if blank else 1 - BLANK_INSIDE) * (OPENS_INSIDE if opens else 1 - OPENS_INSIDE)
            out[code, j] = np.log(p * LENGTHS[role][size] * (ASKS[role] if asks else 1 - ASKS[role]))
    return out


EMISSIONS = _emissions()
_emitted, _first = EMISSIONS.tolist(), FIRST.tolist()
_end = [[math.log(LAST_LINE[a] * p) for p in NEXT_ROLE[a]] for a in ROLES]
_stay = [math.log(1 - LAST_LINE[a]) for a in ROLES]


def code_of(line: str, after_blank: bool, opens: bool) -> int:
    """A line's features as one number."""
    role = marked_role(line) if ":" in line or "]" in line or ">" in line or "#" in line else None
    marker = 0 if role is None else 1 + ROLES.index(role)
    size = 0 if len(line) < 80 else 1 if len(line) < 300 else 2
    return (((marker * 2 + after_blank) * 2 + opens) * 3 + size) * 2 + line.rstrip().endswith("?")


def marked_role(line: str) -> str | None:
    m = MARKER.match(line)
    return _role_of[next(g for g in m.groups() if g).lower()] if m else None


def lines_of(segments: list[str | None]) -> list[tuple[int, str, bool, bool]]:
    """(segment, line, whether a blank line stands before, whether it is the segment's first) of the lines that are not blank; a blank line counts in its own segment only."""
    out = []
    for k, text in enumerate(segments):
        blank, opens = False, True
        for line in (text or "").split("\n"):
            if line and not line.isspace():
                out.append((k, line, blank, opens))
                blank = opens = False
            else:
                blank = True
    return out


def codes_of(lines: list[tuple[int, str, bool, bool]]) -> list[int]:
    return [code_of(line, blank, opens) for _, line, blank, opens in lines]


def best_scores(codes: list[int], first: bool) -> np.ndarray:
    """Best score from each entry state (before the first line) to each exit state; at the start of a transcript all entries are alike."""
    score = np.tile(FIRST, (len(STATES), 1)) if first else THEN.copy()
    score = score + EMISSIONS[codes[0]]
    for c in codes[1:]:
        score = (score[:, :, None] + THEN[None]).max(1) + EMISSIONS[c]
    return score


def best_path(codes: list[int], entry: int | None, leave: int | None) -> list[int]:
    """Viterbi's states, given the state before the first line and the last state (None: free). What a state leads to depends on its role alone, so each step first takes the better of a role's two states."""
    score = [a + b for a, b in zip(_first if entry is None else THEN[entry].tolist(), _emitted[codes[0]], strict=True)]
    back = []
    for c in codes[1:]:
        e = _emitted[c]
        from_ = [2 * r if score[2 * r] >= score[2 * r + 1] else 2 * r + 1 for r in range(3)]
        a, b, d = (score[i] for i in from_)
        new, came = [0.0] * 6, [0] * 6
        for r in range(3):
            x, y, z = a + _end[0][r], b + _end[1][r], d + _end[2][r]
            new[2 * r], came[2 * r] = (x + e[2 * r], from_[0]) if x >= y and x >= z else (y + e[2 * r], from_[1]) if y >= z else (z + e[2 * r], from_[2])
            new[2 * r + 1], came[2 * r + 1] = score[from_[r]] + _stay[r] + e[2 * r + 1], from_[r]
        score = new
        back.append(came)
    path = [score.index(max(score)) if leave is None else leave]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def decode(segments: list[str | None]) -> list[int]:
    """States of a whole transcript's lines, in one pass."""
    lines = lines_of(segments)
    return best_path(codes_of(lines), None, None) if lines else []


_BLOCKS = "conv_id long, part long, block long, turns array<long>, texts array<string>, opening array<double>, inner array<double>"


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to blocks, one row each; those that may not be a whole conversation with their best scores."""
    part, number, ready, size = TaskContext.get().partitionId(), 0, [], 0
    conv, turns, texts, held, whole = None, [], [], 0, False  # whole: what has been read of this conversation is all there was before

    def closed(alone: bool) -> None:
        nonlocal number, turns, texts, size, held
        codes = [] if alone else codes_of(lines_of(texts))
        made = [best_scores(codes, f).reshape(-1).tolist() if codes else None for f in (True, False)]
        ready.append((conv, part, number, turns, texts, *made))
        number, size = number + 1, size + held
        turns, texts, held = [], [], 0

    def batch_of() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*ready, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCKS.split(", ")])

    seen = False
    for batch in batches:
        for c, turn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not seen or c != conv:
                if turns:
                    closed(whole)
                # the first conversation of a partition may have begun in the one before
                conv, whole, seen = c, seen, True
            elif len(turns) >= SEGMENTS or held >= BLOCK_BYTES:
                closed(False)
                whole = False
            turns.append(turn)
            texts.append(text)
            held += len(text or "")
        if size >= BLOCK_BYTES or len(ready) > 4096:
            yield batch_of()
            ready, size = [], 0
    if turns:
        closed(False)  # the last one may go on in the next
    if ready:
        yield batch_of()


def _chain(rows: list[dict], entry: int | None, leave: int | None) -> list[tuple[int | None, int]]:
    """Entry and exit state of each of several blocks (or parts) that follow each other."""
    n, score, kept = len(STATES), None, []
    for r in rows:
        if score is None and entry is None:
            options = np.array(r["opening"]).reshape(n, n)
        else:
            m = np.array(r["inner"]).reshape(n, n)
            options = np.where(np.arange(n)[:, None] == entry, m, -np.inf) if score is None else score[:, None] + m
        kept.append(options)
        score = options.max(0)
    state, out = (int(score.argmax()) if leave is None else leave) if rows else None, []
    for options in reversed(kept):
        at = int(options[:, state].argmax())
        out.append((at, state))
        state = at
    out.reverse()
    return [(entry if i == 0 else at, x) for i, (at, x) in enumerate(out)]


def _multiplied(t: pa.Table) -> pa.Table:
    """A conversation's blocks in one partition as one matrix."""
    rows = sorted(t.to_pylist(), key=lambda r: r["block"])
    n, products = len(STATES), []
    for first in ("opening", "inner"):
        m = np.array(rows[0][first]).reshape(n, n)
        for r in rows[1:]:
            m = (m[:, :, None] + np.array(r["inner"]).reshape(1, n, n)).max(1)
        products.append(m.reshape(-1).tolist())
    return pa.table({"conv_id": pa.array([rows[0]["conv_id"]], pa.int64()), "part": pa.array([rows[0]["part"]], pa.int64()), "opening": pa.array([products[0]], pa.list_(pa.float64())), "inner": pa.array([products[1]], pa.list_(pa.float64()))})


def _over_parts(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["part"])
    ends = _chain(rows, None, None)
    return pa.table({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int64()), "entry": pa.array([e for e, _ in ends], pa.int64()), "leave": pa.array([x for _, x in ends], pa.int64())})


def _inside(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["block"])
    ends = _chain(rows, rows[0]["entry"], rows[0]["leave"])
    return pa.table({"part": pa.array([r["part"] for r in rows], pa.int64()), "block": pa.array([r["block"] for r in rows], pa.int64()), "entry": pa.array([e for e, _ in ends], pa.int64()), "leave": pa.array([x for _, x in ends], pa.int64())})


_TURNS = "conv_id long, block long, number long, role string, text string, continues boolean, n_lines long, segments array<long>"


def _decoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to turns."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            lines = lines_of(r["texts"])
            if not lines:
                continue
            codes, turns = codes_of(lines), []
            for (k, line, _, _), c, s in zip(lines, codes, best_path(codes, r["entry"], r["leave"]), strict=True):
                role, begins = STATES[s]
                if begins and c >= len(EMISSIONS) // 4 and marked_role(line) == role:
                    line = MARKER.sub("", line, count=1)
                if begins or not turns:
                    turns.append((role, [], not begins, []))
                if line or not begins:
                    turns[-1][1].append(line)
                turns[-1][3].append(r["turns"][k])
            out += [(r["conv_id"], r["part"] << 32 | r["block"], i, role, "\n".join(kept), goes_on, len(at), at) for i, (role, kept, goes_on, at) in enumerate(turns)]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _TURNS.split(", ")])


def parse(segments: DataFrame) -> DataFrame:
    """From (conv_id, turn, text): recovered turns as conv_id, block, number (of the turn in its block), role, text, continues (the turn began in an earlier block), n_lines, segments (the input turn of each line)."""
    arrow_ready(segments.sparkSession)
    rows = segments.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("salt"))
    order = ["conv_id", "turn", "h", "salt"]  # the last tells equal rows apart, so that no number of them has to stay together
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "text")
    blocks = cut(ordered.mapInArrow(_cutting, _BLOCKS), "blocks")
    open_ = blocks.where("inner IS NOT NULL").select("conv_id", "part", "block", "opening", "inner")
    matrix = "opening array<double>, inner array<double>"
    parts = open_.groupBy("conv_id", "part").applyInArrow(_multiplied, f"conv_id long, part long, {matrix}")
    placed = parts.groupBy("conv_id").applyInArrow(_over_parts, "conv_id long, part long, entry long, leave long").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "entry", "leave")
    known = open_.join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    ends = cut(known.groupBy("conv_id", "part").applyInArrow(_inside, "part long, block long, entry long, leave long"), "ends")
    return blocks.select("conv_id", "part", "block", "turns", "texts").join(ends, ["part", "block"], "left").mapInArrow(_decoding, _TURNS)


def rendered(turns: DataFrame) -> DataFrame:
    """parse()'s turns with `rendered`: what stands in the canonical transcript, which is these one after the other, by block and number."""
    head = F.when(F.col("continues"), F.lit("")).otherwise(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    return turns.withColumn("rendered", F.concat(head, "text", F.lit("\n")))


def recovered(conversations: DataFrame) -> DataFrame:
    """The query: recovered and rendered turns of the conversations' texts; their roles are not looked at."""
    turns = rendered(parse(conversations.select("conv_id", "turn", "text")))
    return turns.select("conv_id", "block", "number", F.col("segments")[0].alias("segment"), "role", "continues", "n_lines", "rendered")
