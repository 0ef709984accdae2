"""Window frames that Spark has no words for: GROUPS, and EXCLUDE.

Rows that are equal in a window's order are peers, and have one frame of GROUPS or RANGE. So rows are first summed up by peers, in a
GROUP BY that all tasks share; frames are made over these sums, of which there is one row for the peers, and are joined back to the rows.
What EXCLUDE takes away is taken from the aggregate: the sum or the number over the frame, less that over the current row or its peers;
for the least and the largest, of what stands before them in the frame, after them, and beside them. A relation that may give other rows
when it is read again (LIMIT, rand) is read once: there a frame of GROUPS is one of RANGE over dense_rank(), row by row. Frames of ROWS are
made row by row too; if no bound is UNBOUNDED, partitions are cut into parts along their order, which tasks share, and frames that reach over
a cut are made over the rows near cuts. Sums of binary floats may differ in their last digits from those that were never added, and sums of
decimals may be of a wider type."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lectern.plans.match import Denied, _block, _Token, _tokens

_KINDS = ("ROWS", "RANGE", "GROUPS")
_AGGREGATES = ("sum", "count", "avg", "min", "max")
_AFTER_FROM = frozenset("WHERE GROUP HAVING WINDOW ORDER SORT CLUSTER DISTRIBUTE LIMIT OFFSET QUALIFY LATERAL".split())
_BOUND = r"(UNBOUNDED PRECEDING|UNBOUNDED FOLLOWING|CURRENT ROW|\d+ PRECEDING|\d+ FOLLOWING)"
_FRAME = re.compile(rf"(ROWS|RANGE|GROUPS) (?:BETWEEN {_BOUND} AND {_BOUND}|{_BOUND})(?: EXCLUDE (NO OTHERS|CURRENT ROW|GROUP|TIES))?", re.IGNORECASE)


#: Words of relations that may give other rows when they are read again.
_UNSTEADY = frozenset("LIMIT OFFSET TABLESAMPLE RAND RANDN RANDOM RANDSTR UNIFORM UUID SHUFFLE MONOTONICALLY_INCREASING_ID SPARK_PARTITION_ID ROW_NUMBER NTILE LAG LEAD NTH_VALUE FIRST FIRST_VALUE LAST LAST_VALUE ANY_VALUE MODE COLLECT_LIST ARRAY_AGG LISTAGG STRING_AGG MIN_BY MAX_BY".split())
#: The number of a part of _Parts: frames in parts are no less steady than those of the statement.
_NUMBER = "spark_partition_id() AS _part"
_DIRECTION = re.compile(r"(.*?)(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?", re.IGNORECASE | re.DOTALL)


def _items(text: str) -> list[str]:
    """What commas part."""
    commas = [t.start for t in _tokens(text) if t.text == "," and not t.depth]
    return [text[a:b].strip() for a, b in zip([0, *(c + 1 for c in commas)], [*commas, len(text)])] if text else []


def _directed(order: str) -> list[tuple[str, bool, bool]]:
    """Expressions of an ORDER BY, each with whether it descends, and whether nulls come first."""
    found = [_DIRECTION.fullmatch(item) for item in _items(order)]
    return [(m[1], down := (m[2] or "").upper() == "DESC", m[3].upper() == "FIRST" if m[3] else not down) for m in found]


def _over(of: str, directed: list[tuple[str, bool, bool]], kind: str, first: str, last: str) -> str:
    """A frame up to the partition's end becomes one from its start in the other order: Spark makes that in one pass, and the former anew for each row."""
    if last == "UNBOUNDED FOLLOWING" and first != "UNBOUNDED PRECEDING":
        directed = [(e, not down, not nulls_first) for e, down, nulls_first in directed]
        first, last = "UNBOUNDED PRECEDING", first.replace("PRECEDING", "\0").replace("FOLLOWING", "PRECEDING").replace("\0", "FOLLOWING")
    order = ", ".join(f"{e} {'DESC' if down else 'ASC'} NULLS {'FIRST' if nulls_first else 'LAST'}" for e, down, nulls_first in directed)
    return f"OVER ({f'PARTITION BY {of} ' if of else ''}ORDER BY {order} {kind} BETWEEN {first} AND {last})"


def _argument(x: str) -> str:
    """An argument as one value; count(a, b) counts rows that have both."""
    x = re.sub(r"^ALL\b", "", x, flags=re.IGNORECASE).strip()
    if re.match(r"DISTINCT\b", x, re.IGNORECASE):
        raise Denied("DISTINCT over GROUPS or with EXCLUDE is not there")
    if len(several := _items(x)) > 1:
        x = f"CASE WHEN {' AND '.join(f'({e}) IS NOT NULL' for e in several)} THEN 1 END"
    return x


class _Peers:
    """Subqueries _rows, the relation with columns of helpers; _sums, a row for all peers; _ends, the two ends of their values; and _frames, what is joined back."""

    def __init__(self, n: int, of: str, order: str, inner: str) -> None:
        self.n, self.inner = n, inner
        self.of = {f"_of{n}_{i}": e for i, e in enumerate(_items(of))}
        self.directed = _directed(order)
        self.by = {f"_by{n}_{i}": e for i, (e, _, _) in enumerate(self.directed)}
        self.arguments: dict[str, str] = {}
        self.sums: dict[str, str] = {}
        self.ends: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def argument(self, x: str) -> str:
        """The column of an argument."""
        return self.arguments.setdefault(_argument(x), f"_x{self.n}_{len(self.arguments)}")

    def piece(self, expression: str) -> str:
        """A column that all peers share."""
        return self.pieces.setdefault(expression, f"_w{self.n}_{len(self.pieces)}")

    def summed(self, name: str, x: str) -> str:
        """The aggregate of an argument over peers."""
        return self.sums.setdefault(f"{name}({x if x == '*' else self.argument(x)})", f"_s{self.n}_{len(self.sums)}")

    def framed(self, name: str, x: str, kind: str, first: str, last: str) -> str:
        """The aggregate over a frame, from those over peers. Peers are one row there: a frame of GROUPS is one of ROWS, and so is one of RANGE without distances."""
        again = "sum" if name == "count" else name
        if kind == "GROUPS" or not any(b[0].isdigit() for b in (first, last)):
            kind = "ROWS"
        over = _over(", ".join(self.of), [(c, *rest) for c, (_, *rest) in zip(self.by, self.directed)], kind, first, last)
        made = f"{again}({self.summed(name, x)}) {over}"
        return self.piece(f"coalesce({made}, 0)" if name == "count" else made)

    def others(self, name: str, x: str) -> str:
        """The least or largest value of a row's peers without the row."""
        column = self.argument(x)
        end = self.ends.setdefault(f"{column}{' DESC' if name == 'max' else ''}", f"_e{self.n}_{len(self.ends)}")
        best, number, second = (self.piece(f"{end}.{c}") for c in ("_best", "_number", "_second"))
        return f"CASE WHEN {column} = {best} AND {number} = 1 THEN {second} ELSE {best} END"

    def helpers(self) -> list[str]:
        return [*self.of, *self.by, *self.arguments.values(), *self.pieces.values()]

    def columns(self) -> list[str]:
        return [f"{e} AS {c}" for e, c in [*((e, c) for c, e in {**self.of, **self.by}.items()), *self.arguments.items()]]

    def queries(self) -> list[str]:
        keys = [*self.of, *self.by]
        listed, same = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys)
        made = [f"_sums{self.n} AS (SELECT {', '.join([listed, *(f'{e} AS {c}' for e, c in self.sums.items())])} FROM _rows GROUP BY {listed})"]
        joins = ""
        for column, name in self.ends.items():
            value = column.split()[0]
            two = f"SELECT {listed}, {value}, count(*) AS _c, row_number() OVER (PARTITION BY {listed} ORDER BY {column}) AS _r FROM _rows WHERE {value} IS NOT NULL GROUP BY {listed}, {value}"
            cells = ", ".join(f"max(CASE WHEN _r = {r} THEN {v} END) AS {c}" for r, v, c in ((1, value, "_best"), (1, "_c", "_number"), (2, value, "_second")))
            made.append(f"{name} AS (SELECT {listed}, {cells} FROM ({two}) WHERE _r <= 2 GROUP BY {listed})")
            joins += f" LEFT JOIN {name} ON {same(f'_sums{self.n}', name)}"
        own = ", ".join(f"_sums{self.n}.{k}" for k in keys)
        # beside _ends, names of keys would mean two columns
        shown = [re.sub(r"\b_(of|by)\d+_\d+\b", lambda m: f"_sums{self.n}.{m[0]}", e) for e in self.pieces]
        made.append(f"_frames{self.n} AS (SELECT {', '.join([own, *(f'{e} AS {c}' for e, c in zip(shown, self.pieces.values()))])} FROM _sums{self.n}{joins})")
        return made

    def join(self) -> str:
        return f" JOIN _frames{self.n} ON " + " AND ".join(f"_rows.{k} <=> _frames{self.n}.{k}" for k in [*self.of, *self.by])


class _Parts:
    """Frames of ROWS in parts of their partitions. A frame reaches `before` rows back and `after` rows on: rows that are so near to an end of their part have it
    from the edges, which are the first and last `before + after` rows of all parts, in order; there a frame lacks none of its rows, nor any between them."""

    def __init__(self, n: int, of: str, order: str, bounds: list[str]) -> None:
        self.part, self.at, self.many, self.edge = (f"_{c}{n}" for c in ("part", "at", "many", "edge"))
        self.n = n
        self.of = {f"_in{n}_{i}": e for i, e in enumerate(_items(of))}
        self.directed = _directed(order)
        self.by = {f"_on{n}_{i}": e for i, (e, _, _) in enumerate(self.directed)}
        self.before, self.after = (max([0, *(int(b.split()[0]) for b in bounds if b.endswith(side))]) for side in ("PRECEDING", "FOLLOWING"))
        self.arguments: dict[str, str] = {}
        self.within: dict[str, str] = {}
        self.across: dict[str, str] = {}
        # parts follow the first expressions that go one way; a hint knows but one order, with nulls first
        self.down = self.directed[0][1]
        self.ranges: dict[str, str] = {}
        for c, (e, down, nulls_first) in zip(self.by, self.directed):
            if down != self.down:
                break
            self.ranges |= {c: e} if nulls_first != down else {f"{c}_null": f"({e}) IS NULL", c: e}

    def argument(self, x: str) -> str:
        """The column of an argument."""
        return self.arguments.setdefault(_argument(x), f"_a{self.n}_{len(self.arguments)}")

    def framed(self, name: str, x: str, first: str, last: str) -> str:
        """The aggregate over a frame, from the row's part or from the edges."""
        x = x if x == "*" else self.argument(x)
        within = _over(", ".join([*self.of, self.part]), [(c, *rest) for c, (_, *rest) in zip(self.by, self.directed)], "ROWS", first, last)
        across = _over(", ".join([*self.of, f"if({self.edge}, -1, {self.part})"]), [(self.part, self.down, True), (self.at, False, True)], "ROWS", first, last)
        inside, over = (made.setdefault(f"{name}({x}) {w}", f"_{c}{self.n}_{len(made)}") for made, w, c in ((self.within, within, "u"), (self.across, across, "v")))
        return f"CASE WHEN {self.at} <= {self.before} OR {self.many} - {self.at} < {self.after} THEN {over} ELSE {inside} END"

    def helpers(self) -> list[str]:
        return [*self.of, *self.by, *(c for c in self.ranges if c not in self.by), *self.arguments.values(), self.part, self.at, self.many, self.edge, *self.within.values(), *self.across.values()]

    def columns(self) -> list[str]:
        return [f"{e} AS {c}" for c, e in {**self.of, **self.by, **self.ranges, **{c: e for e, c in self.arguments.items()}}.items()]

    def relation(self, rows: str) -> str:
        """Rows with these frames."""
        part = _over(", ".join([*self.of, self.part]), [(c, *rest) for c, (_, *rest) in zip(self.by, self.directed)], "ROWS", "UNBOUNDED PRECEDING", "{}")
        within = [f"count(*) {part.format('CURRENT ROW')} AS {self.at}", f"count(*) {part.format('UNBOUNDED FOLLOWING')} AS {self.many}", *(f"{e} AS {c}" for e, c in self.within.items())]
        reach = self.before + self.after
        # a hint holds for what its SELECT returns, so the number of the part is taken from outside
        dealt = f"SELECT *, {_NUMBER}{self.n} FROM (SELECT /*+ REPARTITION_BY_RANGE({', '.join([*self.of, *self.ranges])}) */ * FROM {rows})"
        edges = f"SELECT *, {self.at} <= {reach} OR {self.many} - {self.at} < {reach} AS {self.edge} FROM (SELECT *, {', '.join(within)} FROM ({dealt}))"
        return f"(SELECT {', '.join(['*', *(f'{e} AS {c}' for e, c in self.across.items())])} FROM ({edges}))"


@dataclass
class _Window:
    """`name(argument) OVER (PARTITION BY of ORDER BY order kind BETWEEN first AND last EXCLUDE without)`, from a place to another."""

    start: int
    stop: int
    name: str
    argument: str
    of: str
    order: str
    kind: str
    first: str
    last: str
    without: str

    def over(self, peers: str, nth: str, first: str, last: str) -> str:
        # of rows that are equal in the order, a reversed one would take others for the first ones
        order = peers if self.kind == "GROUPS" else nth if self.kind == "ROWS" and self.last == "UNBOUNDED FOLLOWING" else self.order
        return _over(self.of, _directed(order), "RANGE" if self.kind == "GROUPS" else self.kind, first, last)

    def holds_current(self) -> bool:
        beyond = lambda bound, side: bound.endswith(side) and not bound.startswith(("0 ", "UNBOUNDED"))
        return not (beyond(self.first, "FOLLOWING") or beyond(self.last, "PRECEDING"))

    def in_parts(self) -> bool:
        """Frames of all rows before or after one would need every part."""
        return self.kind == "ROWS" and not any(b.startswith("UNBOUNDED") for b in (self.first, self.last))

    def text(self, peers: str, nth: str, sums: _Peers | None = None, parts: _Parts | None = None) -> str:
        """The same without words that Spark lacks; peers and nth are columns with the peers' number, and a row's own in its partition. Over sums of peers or in parts, columns of these."""
        x = self.argument
        if parts is not None:
            own = x if x == "*" else parts.argument(x)
            near = lambda name, first, last: parts.framed(name, x, first, last)
            among = None
        elif sums is None:
            own = x
            near = lambda name, first, last: f"{name}({x}) {self.over(peers, nth, first, last)}"
            beside = f"OVER (PARTITION BY {', '.join(filter(None, (self.of, peers)))})"
            among = lambda name: f"{name}({x}) {beside}"
        else:
            own = x if x == "*" else sums.argument(x)
            near = lambda name, first, last: sums.framed(name, x, self.kind, first, last)
            among = lambda name: sums.piece(sums.summed(name, x))
        if self.without in ("", "NO OTHERS") or not self.holds_current():
            if sums is None or self.name != "avg":
                return near(self.name, self.first, self.last)
            number = near("count", self.first, self.last)
            return f"CASE WHEN {number} > 0 THEN {near('sum', self.first, self.last)} / {number} END"
        own_n, own_x = ("1", "0") if x == "*" else (f"if({own} IS NULL, 0, 1)", f"coalesce({own}, 0)")
        gone_n = {"CURRENT ROW": lambda: own_n, "GROUP": lambda: among("count"), "TIES": lambda: f"{among('count')} - {own_n}"}[self.without]
        left = lambda: f"({near('count', self.first, self.last)} - ({gone_n()}))"
        if self.name == "count":
            return left()
        if self.name in ("sum", "avg"):
            total = lambda s: f"coalesce({s}, 0)"
            gone = {"CURRENT ROW": lambda: own_x, "GROUP": lambda: total(among("sum")), "TIES": lambda: f"{total(among('sum'))} - {own_x}"}[self.without]
            rest = f"({total(near('sum', self.first, self.last))} - ({gone()}))"
            return f"CASE WHEN {left()} > 0 THEN {rest}{f' / {left()}' if self.name == 'avg' else ''} END"
        if self.kind == "RANGE":
            raise Denied(f"{self.name} over RANGE with EXCLUDE is not there: write GROUPS")
        others = []
        if self.first != "CURRENT ROW" and not self.first.startswith("0 "):
            others.append(near(self.name, self.first, "1 PRECEDING"))
        if self.last != "CURRENT ROW" and not self.last.startswith("0 "):
            others.append(near(self.name, "1 FOLLOWING", self.last))
        if self.without == "TIES":
            others.append(own)
        elif self.without == "CURRENT ROW" and self.kind == "GROUPS" and sums is not None:
            others.append(sums.others(self.name, x))
        elif self.without == "CURRENT ROW" and self.kind == "GROUPS":
            of, by = ", ".join(filter(None, (self.of, peers))), [(nth, False, True)]
            others += [f"{self.name}({x}) {_over(of, by, 'ROWS', *bounds)}" for bounds in (("UNBOUNDED PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", "UNBOUNDED FOLLOWING"))]
        either = {"min": "least", "max": "greatest"}[self.name]
        return f"{either}({', '.join(others)}, NULL)" if others else f"if(true, NULL, {own})"


def _close(tokens: list[_Token], at: int) -> int:
    """The parenthesis that ends the one at a place."""
    return next(i for i in range(at + 1, len(tokens)) if tokens[i].text == ")" and tokens[i].depth == tokens[at].depth)


def _windows(code: str, tokens: list[_Token]) -> list[tuple[int, _Window]]:
    """Calls over a window with such a frame, each with the place of its OVER."""
    out = []
    for i, t in enumerate(tokens):
        if t.word != "OVER" or i + 1 == len(tokens) or tokens[i + 1].text != "(":
            continue
        end = _close(tokens, i + 1)
        inside = [k for k in range(i + 2, end) if tokens[k].depth == t.depth + 1]
        frame = next((k for k in inside if tokens[k].word in _KINDS and k + 1 < end and tokens[k + 1].word in ("BETWEEN", "UNBOUNDED", "CURRENT") or tokens[k].word in _KINDS and tokens[k + 1].text.isdigit()), None)
        if frame is None or not (tokens[frame].word == "GROUPS" or any(tokens[k].word == "EXCLUDE" for k in inside if k > frame)):
            continue
        m = _FRAME.fullmatch(" ".join(x.text for x in tokens[frame:end]))
        order = next((k for k in inside if tokens[k].word == "ORDER"), None)
        if m is None or order is None:
            raise Denied("a frame of GROUPS or with EXCLUDE needs an ORDER BY, and bounds that are numbers")
        of = next((k for k in inside if tokens[k].word == "PARTITION"), None)
        text = lambda a, b: code[tokens[a].start : tokens[b - 1].stop] if a < b else ""
        if tokens[i - 1].text != ")":
            raise Denied("what stands before OVER is no call")
        begin = next(k for k in range(i - 2, -1, -1) if tokens[k].text == "(" and tokens[k].depth == tokens[i - 1].depth)
        name = tokens[begin - 1].text.lower()
        if name not in _AGGREGATES:
            raise Denied(f"{name} over GROUPS or with EXCLUDE is not there")
        bounds = [b.upper() for b in ((m[2], m[3]) if m[2] else (m[4], "CURRENT ROW"))]
        if m[1].upper() == "ROWS" and (m[5] or "").upper() in ("GROUP", "TIES"):
            raise Denied("a frame of ROWS may cut peers apart in any order: EXCLUDE GROUP and TIES need RANGE or GROUPS")
        out.append((i, _Window(tokens[begin - 1].start, tokens[end].stop, name, text(begin + 1, i - 1).strip(), text(of + 2, order) if of is not None else "", text(order + 2, frame), m[1].upper(), *bounds, (m[5] or "").upper())))
    return out


def _select(tokens: list[_Token], at: int) -> tuple[int, int]:
    """The query block around a token: outwards, up to one that begins with SELECT."""
    while True:
        first, last = _block(tokens, at)
        if any(tokens[k].word == "SELECT" and tokens[k].depth == tokens[at].depth for k in range(first, last)):
            return first, last
        if not first:
            raise Denied("a window outside of a query")
        at = first - 1


def replaced(code: str) -> str:
    """A statement, with what is quoted put away, without such frames."""
    while found := _windows(code, tokens := _tokens(code)):
        first, last = _select(tokens, found[0][0])
        own = [w for at, w in found if _select(tokens, at) == (first, last)]
        depth = tokens[first].depth
        at_depth = [k for k in range(first, last) if tokens[k].depth == depth]
        source = next((k for k in at_depth if tokens[k].word == "FROM"), None)
        if source is None:
            raise Denied("a window needs a FROM")
        stop = next((k for k in at_depth if k > source and tokens[k].word in _AFTER_FROM), last)
        where = stop if stop < last and tokens[stop].word == "WHERE" else None
        end = next((k for k in at_depth if k > (where or stop - 1) and tokens[k].word in _AFTER_FROM), last) if where is not None else stop
        if any(tokens[k].word == "JOIN" or tokens[k].text == "," for k in at_depth if source < k < stop) or any(tokens[k].word in ("GROUP", "WINDOW", "HAVING") for k in at_depth):
            raise Denied("frames of GROUPS or with EXCLUDE are over one relation: put a join or a GROUP BY into a subquery")
        named = tokens[stop - 1]
        alias = named.text if named.depth == depth and re.fullmatch(r"\w+", named.text) else "framed"
        inner = code[tokens[source].start : tokens[end - 1].stop]
        begins = max(k for k in at_depth if k < source and tokens[k].word == "SELECT")
        read = [*tokens[:begins], *tokens[source:end]]  # with what names stand for
        steady = not any(t.word in _UNSTEADY and before.word != "NULLS" and not code.startswith(_NUMBER, t.start) for before, t in zip([tokens[0], *read], read))
        columns, helpers, sums, parts, names = [], [], {}, {}, {}
        for n, (of, order) in enumerate(dict.fromkeys((w.of, w.order) for w in own)):
            names[of, order] = f"_peers{n}", f"_nth{n}"
            these = [w for w in own if (w.of, w.order) == (of, order)]
            if steady and any(w.kind != "ROWS" for w in these):
                sums[of, order] = _Peers(n, of, order, inner)
            if steady and (bounds := [b for w in these if w.in_parts() for b in (w.first, w.last)]):
                parts[of, order] = _Parts(n, of, order, bounds)
            over = f"OVER ({f'PARTITION BY {of} ' if of else ''}ORDER BY {order})"
            if not steady:
                columns.append(f"dense_rank() {over} AS _peers{n}")
                helpers.append(f"_peers{n}")
            if not steady or any(w.kind == "ROWS" and w.last == "UNBOUNDED FOLLOWING" for w in these):
                columns.append(f"row_number() {over} AS _nth{n}")
                helpers.append(f"_nth{n}")
        edits = [(w.start, w.stop, w.text(*names[k := (w.of, w.order)], sums.get(k) if w.kind != "ROWS" else None, parts.get(k) if w.in_parts() else None)) for w in own]
        for made in (*sums.values(), *parts.values()):
            columns += made.columns()
            helpers += made.helpers()
        relation = f"SELECT {', '.join(['*', *columns])} {inner}"
        rows = "_rows" if sums else f"({relation})"
        for p in parts.values():
            rows = p.relation(rows)
        if sums:
            shared = ", ".join(["_rows.*", *(c for peers in sums.values() for c in peers.pieces.values())])
            relation = f"WITH {', '.join([f'_rows AS ({relation})', *(q for peers in sums.values() for q in peers.queries())])} SELECT {shared} FROM {rows}{' AS _rows' if parts else ''}{''.join(peers.join() for peers in sums.values())}"
        elif parts:
            relation = f"SELECT * FROM {rows}"
        edits.append((tokens[source].start, tokens[end - 1].stop, f"FROM ({relation}) AS {alias}"))
        excepted = f" EXCEPT ({', '.join(helpers)})" if helpers else ""
        edits += [(tokens[k].start, tokens[k].stop, f"*{excepted}") for k in at_depth if tokens[k].text == "*" and k < source and (tokens[k - 1].word == "SELECT" or tokens[k - 1].text in (",", "."))]
        for a, b, new in sorted(edits, reverse=True):
            code = code[:a] + new + code[b:]
    return code
