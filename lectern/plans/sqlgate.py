"""Read-only SQL: a statement is parsed, its plan and its functions are held against allow-lists, and only then analysed and run.

Some forms are rewritten first, outside of literals, quoted names and comments: embed('literal') becomes a constant vector,
computed once on the driver; `x.embedding MATCH <vector> AND k = <n>`, wherever it stands, turns the vector view x into its n
rows nearest to it (see match.py); frames of GROUPS and with EXCLUDE become others (see frames.py); and names of other engines that no SQL function can stand for become Spark's."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.providers import Embedder
from lectern.plans import frames
from lectern.plans.match import Denied, replaced

#: Plan nodes that only read.
ALLOWED = frozenset((
    "Project", "Filter", "Aggregate", "Sort", "Distinct", "Deduplicate", "Join", "LateralJoin", "Union", "Intersect", "Except", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "OneRowRelation", "LocalRelation", "Range", "Window", "WithWindowDefinition", "Generate", "Expand", "Pivot", "Unpivot", "Sample",
    "UnresolvedRelation", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "ResolvedInlineTable", "UnresolvedWith", "UnresolvedHaving", "UnresolvedHint", "UnionLoop",
))
#: Groups of built-in functions that compute from their arguments alone, and the few of the miscellaneous group that do.
FUNCTION_GROUPS = frozenset(f"{g}_funcs" for g in ("agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "datetime", "generator", "hash", "json", "lambda", "map", "math", "predicate", "string", "struct", "url", "variant", "window", "xml"))
MISC_FUNCTIONS = frozenset(("typeof", "uuid", "version", "user", "current_user", "session_user", "monotonically_increasing_id", "spark_partition_id", "bitmap_count", "hll_sketch_estimate"))
TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"))


def parse(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _plans(node) -> Iterator:
    """All nodes of a parsed plan, with those of its subqueries and common tables."""
    yield node
    if node.getClass().getSimpleName() == "UnresolvedWith":
        for relation in _each(node.cteRelations()):
            yield from _plans(relation._2())
    for group in (node.children(), node.innerChildren()):
        for child in _each(group):
            if hasattr(child, "nodeName"):
                yield from _plans(child)


def _expressions(expression) -> Iterator:
    yield expression
    for child in _each(expression.children()):
        yield from _expressions(child)


def _named(node) -> list[str]:
    return [str(x).lower() for x in _each(node)]


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Lower-cased names of the tables that a statement names, those of its own common tables left out."""
    found, own = set(), set()
    for node in _plans(parse(spark, sql)):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            found.add(".".join(_named(node.multipartIdentifier())))
        elif kind == "UnresolvedWith":
            own |= {str(r._1()).lower() for r in _each(node.cteRelations())}
    return found - own


def _allowed_function(spark: SparkSession, parts: list[str]) -> bool:
    """Built-in functions by their group; others only if this session registered them."""
    state = spark._jsparkSession.sessionState()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[-1])
    if len(parts) > 1 or not state.catalog().isTemporaryFunction(identifier):
        found = state.functionRegistry().lookupFunction(identifier)
        if len(parts) > 1 or found.isEmpty():
            return False
        return found.get().getGroup() in FUNCTION_GROUPS or parts[-1] in MISC_FUNCTIONS
    return True


def check(spark: SparkSession, sql: str) -> None:
    """Raises Denied, or Spark's own error if the statement does not parse."""
    if not sql or not sql.strip():
        raise ValueError("the statement is empty")
    catalog = spark._jsparkSession.sessionState().catalog()
    common, tables, functions = set(), [], set()
    for node in _plans(parse(spark, sql)):
        kind = node.getClass().getSimpleName()
        if kind not in ALLOWED:
            raise Denied(f"{kind} is not a read-only operation")
        if kind == "UnresolvedWith":
            common |= {str(r._1()).lower() for r in _each(node.cteRelations())}
        elif kind == "UnresolvedRelation":
            tables.append(_named(node.multipartIdentifier()))
        elif kind == "UnresolvedTableValuedFunction":
            name = _named(node.name())
            if len(name) > 1 or name[0] not in TABLE_FUNCTIONS and not catalog.isTemporaryFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name[0])):
                raise Denied(f"table function {'.'.join(name)} is not allowed")
        for top in _each(node.expressions()):
            functions |= {tuple(_named(e.nameParts())) for e in _expressions(top) if e.getClass().getSimpleName() == "UnresolvedFunction"}
        if kind == "Generate" and node.generator().getClass().getSimpleName() == "UnresolvedGenerator":
            functions.add((str(node.generator().name().funcName()).lower(),))
    for parts in tables:
        if len(parts) > 1 or not (parts[0] in common or catalog.getRawTempView(parts[0]).isDefined()):
            raise Denied(f"not a registered view: {'.'.join(parts)}")
    for parts in sorted(functions):
        if not _allowed_function(spark, list(parts)):
            raise Denied(f"function {'.'.join(parts)} is not allowed")


#: String literals, quoted names and comments, as Spark reads them.
_QUOTED = re.compile(r"""[rR]'[^']*'|[rR]"[^"]*"|'(?:\\.|''|[^'\\])*'|"(?:\\.|""|[^"\\])*"|`(?:``|[^`])*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)
_HIDDEN = re.compile("\x00([0-9]+)\x01")


class _Code:
    """A statement with what is quoted put away, so that what is left can be rewritten as code."""

    def __init__(self, sql: str) -> None:
        self.kept: list[str] = []
        self.text = _QUOTED.sub(self._put_away, sql.replace("\x00", "").replace("\x01", ""))

    def _put_away(self, m: re.Match) -> str:
        self.kept.append(m[0])
        return f"\x00{len(self.kept) - 1}\x01"

    def shown(self, text: str) -> str:
        return _HIDDEN.sub(lambda m: self.kept[int(m[1])], text)

    def literal(self, text: str) -> str | None:
        """The value of what is a plain string literal and nothing else."""
        m = _HIDDEN.fullmatch(text.strip())
        quoted = self.kept[int(m[1])] if m else ""
        return quoted[1:-1].replace("''", "'") if quoted.startswith("'") else None

    def calls(self, name: str, change: Callable[[list[str]], str | None]) -> None:
        """Replaces each call of a function by change(arguments), where that is not None; arguments may hold further calls."""
        at = 0
        while m := re.compile(rf"(?<![\w.]){name}\s*\(", re.IGNORECASE).search(self.text, at):
            depth, start, parts, i = 1, m.end(), [], m.end()
            while i < len(self.text) and depth:
                c = self.text[i]
                depth += (c in "([") - (c in ")]")
                if not depth or depth == 1 and c == ",":
                    parts.append(self.text[start:i])
                    start = i + 1
                i += 1
            new = change(parts) if not depth else None
            if new is not None:
                self.text = self.text[: m.start()] + new + self.text[i:]
            at = m.start() + 1


#: Codes of strftime to patterns of date_format (fixed values).
_DATES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%%": "%"}


def _other_names(code: _Code) -> None:
    """Aggregates, formats and conditionals of other engines that no SQL function can stand for."""
    code.calls("group_concat", lambda a: f"listagg({', '.join(a)})")
    code.calls("total", lambda a: f"coalesce(sum({a[0]}), 0D)" if len(a) == 1 else None)
    code.calls("iif", lambda a: f"if({', '.join(a)})" if len(a) == 3 else None)

    def dated(a: list[str]) -> str | None:
        pattern = code.literal(a[0])
        return None if pattern is None or len(a) != 2 else f"date_format({a[1]}, '{re.sub('%.', lambda c: _DATES.get(c[0], c[0]), pattern)}')"

    code.calls("strftime", dated)


def rewrite(sql: str, embedder: Embedder | None = None, vector_views: tuple[str, ...] = ("vectors",), id_col: str = "vec_id") -> str:
    code = _Code(sql)
    _other_names(code)
    if embedder is not None:

        def vector(a: list[str]) -> str | None:
            text = code.literal(a[0]) if len(a) == 1 else None
            return None if text is None else "array(" + ", ".join(f"{float(x)!r}D" for x in embedder.embed([text])[0]) + ")"

        code.calls("embed", vector)

    return code.shown(frames.replaced(replaced(code.text, tuple(v.lower() for v in vector_views), id_col)))


def search(spark: SparkSession, sql: str, embedder: Embedder | None = None, vector_views: tuple[str, ...] = ("vectors",), id_col: str = "vec_id") -> DataFrame:
    """The rows of a read-only statement."""
    sql = rewrite(sql, embedder, vector_views, id_col)
    check(spark, sql)
    return spark.sql(sql)


def shaped(df: DataFrame) -> list[dict]:
    """Rows as dictionaries: of equal names the last counts, bytes and vectors are "<blob>"."""
    blob = {f.name for f in df.schema if f.dataType.typeName() == "binary" or f.dataType.simpleString() == "array<float>"}
    return [{k: "<blob>" if k in blob and v is not None else v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


def as_json(df: DataFrame) -> str:
    return json.dumps(shaped(df), indent=2, ensure_ascii=False, default=str)


def register_names(spark: SparkSession) -> None:
    """Names of other SQL engines that Spark lacks; nothing is done in a session that has them."""
    if spark._jsparkSession.sessionState().catalog().isTemporaryFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier("vec_to_json")):
        return
    functions = {
        "json_extract(doc STRING, path STRING) RETURNS STRING": "get_json_object(doc, path)",
        "julianday(t TIMESTAMP) RETURNS DOUBLE": "unix_micros(t) / 86400e6D + 2440587.5D",
        "unixepoch(t TIMESTAMP) RETURNS BIGINT": "unix_timestamp(t)",
        "likely(c BOOLEAN) RETURNS BOOLEAN": "c",
        "glob(pattern STRING, s STRING) RETURNS BOOLEAN": "s RLIKE concat('^', replace(replace(regexp_replace(pattern, '([.+^$(){}|\\\\\\\\])', '\\\\\\\\$1'), '*', '.*'), '?', '.'), '$')",
        "vec_length(v ARRAY<DOUBLE>) RETURNS INT": "size(v)",
        "json_each(doc STRING) RETURNS TABLE(key STRING, value STRING)": (
            "SELECT key, value FROM (SELECT explode(CASE WHEN startswith(ltrim(doc), '[') THEN map_from_entries(transform(from_json(doc, 'array<string>'), (x, i) -> struct(CAST(i AS STRING), x))) ELSE from_json(doc, 'map<string,string>') END) AS (key, value))"
        ),
        "vec_to_json(v ARRAY<DOUBLE>) RETURNS STRING": "to_json(v)",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
