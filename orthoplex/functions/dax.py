"""DAX formulas: classification, and lowering to aggregate SQL over a star.

A formula is parsed into a small tree; aggregates become SQL aggregate calls (with
FILTER for CALCULATE and FILTER), RELATED columns become columns of a joined
dimension, measure references are expanded.  What cannot be lowered raises
``Unsupported`` with the reason, so a converter can report it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace


class Unsupported(ValueError):
    """A formula beyond the supported part of DAX."""


@dataclass(frozen=True)
class Lowered:
    """sql: an aggregate expression over ``f`` and dimension aliases; flag: a period flag that restricts it; tables joined for RELATED; cumulative: (base, prior year)."""

    sql: str
    flag: str | None = None
    tables: frozenset[str] = frozenset()
    cumulative: tuple[str, bool] | None = None


_TOKEN = re.compile(
    r"\s+|//[^\n]*|--[^\n]*|/\*.*?\*/|(?P<string>\"(?:[^\"]|\"\")*\")|(?P<number>\d+(?:\.\d+)?)|(?P<column>\[[^\]]*\])|(?P<table>'[^']*')"
    r"|(?P<word>[A-Za-z_][\w.]*)|(?P<op>&&|\|\||<>|<=|>=|[-+*/=<>(),&{}])",
    re.S,
)
_AGGREGATES = {"SUM": "SUM", "AVERAGE": "AVG", "MIN": "MIN", "MAX": "MAX", "COUNT": "COUNT", "COUNTA": "COUNT", "MEDIAN": "MEDIAN", "DISTINCTCOUNT": "DISTINCT", "PRODUCT": "PRODUCT"}
_ROWWISE = {"SUMX": "SUM", "AVERAGEX": "AVG", "MINX": "MIN", "MAXX": "MAX", "COUNTX": "COUNT", "MEDIANX": "MEDIAN"}
_SCALARS = {"ABS": "ABS", "ROUND": "ROUND", "INT": "FLOOR", "SQRT": "SQRT", "UPPER": "UPPER", "LOWER": "LOWER", "LEN": "LENGTH", "YEAR": "YEAR", "MONTH": "MONTH", "DAY": "DAY"}


@dataclass(frozen=True)
class Node:
    kind: str  # call, column, measure, number, string, op, table
    text: str
    args: tuple[Node, ...] = ()


def tidy(text: str) -> str:
    """Without comments, a leading equals sign and blanks around parentheses."""
    text = re.sub(r"//[^\n]*|--[^\n]*", "", text).strip().lstrip("=").strip()
    return re.sub(r"\s*\)", ")", re.sub(r"\s*\(\s*", "(", text))


def parse(text: str) -> Node:
    text, tokens, at = text.strip().lstrip("="), [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unsupported(f"cannot read {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(value: str | None = None) -> tuple[str, str] | None:
        nonlocal place
        if value is None or tokens[place][1] == value:
            place += 1
            return tokens[place - 1]
        return None

    def binary(level: int) -> Node:
        levels = [("||",), ("&&",), ("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/")]
        if level == len(levels):
            return unary()
        left = binary(level + 1)
        while tokens[place][0] == "op" and tokens[place][1] in levels[level]:
            op = take()[1]
            left = Node("op", op, (left, binary(level + 1)))
        return left

    def unary() -> Node:
        if take("-"):
            return Node("op", "neg", (unary(),))
        if take("("):
            inner = binary(0)
            if not take(")"):
                raise Unsupported("unbalanced parentheses")
            return inner
        kind, value = take()
        if kind == "number":
            return Node("number", value)
        if kind == "string":
            return Node("string", value[1:-1].replace('""', '"'))
        if kind == "column":
            return Node("measure", value[1:-1])
        if kind in ("table", "word"):
            name = value.strip("'")
            if tokens[place][0] == "column":
                return Node("column", take()[1][1:-1], (Node("table", name),))
            if kind == "word" and take("("):
                args: list[Node] = []
                while not take(")"):
                    if tokens[place][0] == "end":
                        raise Unsupported("unbalanced parentheses")
                    args.append(binary(0))
                    take(",")
                return Node("call", name.upper(), tuple(args))
            return Node("table", name)
        raise Unsupported(f"unexpected {value or kind!r}")

    out = binary(0)
    if tokens[place][0] != "end":
        raise Unsupported(f"unexpected {tokens[place][1]!r}")
    return out


def calls_of(node: Node) -> set[str]:
    return ({node.text} if node.kind == "call" else set()) | {c for a in node.args for c in calls_of(a)}


def classify(text: str) -> str:
    """simple, time_ytd, time_prior_year, sql_fallback, calculated_table or manual."""
    try:
        node = parse(tidy(text))
        calls = calls_of(node)
    except Unsupported:
        node, calls = None, {w.upper() for w in re.findall(r"([A-Za-z.]+)\s*\(", text)}
    if calls & {"TOTALYTD", "DATESYTD"}:
        return "time_ytd"
    if "SAMEPERIODLASTYEAR" in calls:
        return "time_prior_year"
    if calls & {"ALLSELECTED", "ISONORAFTER", "ALL", "ALLEXCEPT", "KEEPFILTERS", "SUMX", "AVERAGEX", "MINX", "MAXX", "COUNTX", "RANKX", "TODAY", "NOW", "UTCNOW", "MEDIAN", "PERCENTILE", "FILTER"}:
        return "sql_fallback"
    if "DATATABLE" in calls:
        return "calculated_table"
    if calls & {"CALCULATE", "SUM", "COUNT", "COUNTA", "COUNTROWS", "DISTINCTCOUNT", "MIN", "MAX", "AVERAGE", "DIVIDE"}:
        return "simple"
    if node is not None and node.kind in ("number", "string"):
        return "simple"
    if node is not None and node.kind == "op" and any(a.kind in ("measure", "column") for a in node.args):
        return "sql_fallback"
    return "manual"


class Lowerer:
    """``column`` turns (table, column) into SQL text and the table to join for it (None: the fact's own)."""

    def __init__(self, column: Callable[[str, str], tuple[str, str | None]], measures: Mapping[str, str] | None = None) -> None:
        self.column_of, self.measures = column, {k.lower(): v for k, v in (measures or {}).items()}

    def lower(self, text: str) -> Lowered:
        return self._value(parse(text), ())

    def _value(self, n: Node, busy: tuple[str, ...]) -> Lowered:
        if n.kind == "number":
            return Lowered(n.text)
        if n.kind == "string":
            return Lowered("'" + n.text.replace("'", "''") + "'")
        if n.kind == "measure":
            key = n.text.lower()
            if key in busy:
                raise Unsupported(f"[{n.text}] refers to itself")
            if key not in self.measures:
                raise Unsupported(f"unknown measure [{n.text}]")
            return self._value(parse(self.measures[key]), (*busy, key))
        if n.kind == "op":
            if n.text == "neg":
                return self._joined("-({})", [self._value(n.args[0], busy)])
            if n.text not in "+-*/":
                raise Unsupported(f"operator {n.text} between aggregates")
            a, b = (self._value(x, busy) for x in n.args)
            if n.text == "/":
                return self._joined("try_divide(CAST(COALESCE({}, 0) AS DOUBLE), CAST(COALESCE({}, 0) AS DOUBLE))", [a, b])
            return self._joined("(COALESCE({}, 0) " + n.text + " COALESCE({}, 0))", [a, b])
        if n.kind != "call":
            raise Unsupported(f"a bare {n.kind} is no measure")
        name, args = n.text, n.args
        if name in _AGGREGATES:
            sql, tables = self._row(args[0])
            return Lowered(f"COUNT(DISTINCT {sql})" if name == "DISTINCTCOUNT" else f"{_AGGREGATES[name]}({sql})", None, tables)
        if name == "COUNTROWS":
            return self._over(args[0], "COUNT", "*", frozenset())
        if name in _ROWWISE:
            sql, tables = self._row(args[1])
            return self._over(args[0], _ROWWISE[name], sql, tables)
        if name == "DIVIDE":
            a, b = self._value(args[0], busy), self._value(args[1], busy)
            out = self._joined("try_divide(CAST(COALESCE({}, 0) AS DOUBLE), CAST(COALESCE({}, 0) AS DOUBLE))", [a, b])
            return self._joined("COALESCE({}, {})", [out, self._value(args[2], busy)]) if len(args) > 2 else out
        if name == "CALCULATE":
            return self._calculate(args, busy)
        if name == "TOTALYTD":
            return replace(self._value(args[0], busy), flag="ytd_flag")
        if name == "BLANK":
            return Lowered("NULL")
        if name == "IF":
            parts = [self._value(a, busy) for a in args[1:]]
            return self._joined(f"CASE WHEN {self._test(args[0], busy)} THEN {{}} " + ("ELSE {} " if len(parts) > 1 else "") + "END", parts)
        if name in _SCALARS:
            return self._joined(f"{_SCALARS[name]}({', '.join(['{}'] * len(args))})", [self._value(a, busy) for a in args])
        raise Unsupported(f"function {name}")

    def _joined(self, form: str, parts: list[Lowered]) -> Lowered:
        flags = {p.flag for p in parts if p.flag}
        if len(flags) > 1 or (flags and any(p.flag is None and re.search(r"[A-Z]\(", p.sql) for p in parts)):
            raise Unsupported("different periods in one formula")
        return Lowered(form.format(*[p.sql for p in parts]), next(iter(flags), None), frozenset().union(*[p.tables for p in parts]))

    def _over(self, source: Node, function: str, sql: str, tables: frozenset[str]) -> Lowered:
        if source.kind == "call" and source.text == "FILTER":
            test, more = self._condition(source.args[1])
            return Lowered(f"{function}({sql}) FILTER (WHERE {test})", None, tables | more)
        if source.kind != "table":
            raise Unsupported("rows of anything but a table or FILTER")
        return Lowered(f"{function}({sql})", None, tables)

    def _calculate(self, args: tuple[Node, ...], busy: tuple[str, ...]) -> Lowered:
        names = {c for a in args[1:] for c in calls_of(a)}
        if names & {"ALLSELECTED", "ISONORAFTER"}:
            return replace(self._value(args[0], busy), cumulative=(self._value(args[0], busy).sql, "SAMEPERIODLASTYEAR" in names))
        out, tests = self._value(args[0], busy), []
        for a in args[1:]:
            if a.kind == "call" and a.text == "DATESYTD":
                out = replace(out, flag="ytd_flag")
                continue
            if a.kind == "call" and a.text == "SAMEPERIODLASTYEAR":
                out = replace(out, flag="prior_year_ytd_flag")
                continue
            if a.kind == "call" and a.text in ("KEEPFILTERS", "FILTER"):
                a = a.args[-1]
            if a.kind == "call" and a.text in ("ALL", "ALLEXCEPT", "REMOVEFILTERS"):
                raise Unsupported(f"{a.text} removes filters")
            test, tables = self._condition(a)
            tests.append(test)
            out = replace(out, tables=out.tables | tables)
        if not tests:
            return out
        if not re.fullmatch(r"[A-Z]+\((?:DISTINCT )?.*\)", out.sql, re.S) or "FILTER (" in out.sql or out.sql.startswith(("CAST", "COALESCE", "CASE")):
            raise Unsupported("CALCULATE with filters around more than one aggregate")
        return replace(out, sql=f"{out.sql} FILTER (WHERE {' AND '.join(tests)})")

    def _test(self, n: Node, busy: tuple[str, ...]) -> str:
        if n.kind == "op" and n.text in ("=", "<>", "<", ">", "<=", ">="):
            a, b = (self._value(x, busy).sql for x in n.args)
            return f"{a} {n.text} {b}"
        raise Unsupported("condition between aggregates")

    def _condition(self, n: Node) -> tuple[str, frozenset[str]]:
        """A condition on single rows."""
        if n.kind == "op" and n.text in ("&&", "||"):
            (a, x), (b, y) = (self._condition(k) for k in n.args)
            return f"({a} {'AND' if n.text == '&&' else 'OR'} {b})", x | y
        if n.kind == "op" and n.text in ("=", "<>", "<", ">", "<=", ">="):
            (a, x), (b, y) = (self._row(k) for k in n.args)
            return f"{a} {n.text} {b}", x | y
        if n.kind == "call" and n.text == "NOT":
            a, x = self._condition(n.args[0])
            return f"NOT ({a})", x
        raise Unsupported("a filter that is no comparison")

    def _row(self, n: Node) -> tuple[str, frozenset[str]]:
        """An expression over single rows."""
        if n.kind == "column":
            sql, table = self.column_of(n.args[0].text, n.text)
            return sql, frozenset([table] if table else [])
        if n.kind == "call" and n.text == "RELATED":
            return self._row(n.args[0])
        if n.kind == "number":
            return n.text, frozenset()
        if n.kind == "string":
            return "'" + n.text.replace("'", "''") + "'", frozenset()
        if n.kind == "op" and n.text == "neg":
            a, x = self._row(n.args[0])
            return f"-({a})", x
        if n.kind == "op" and n.text in "+-*/":
            (a, x), (b, y) = (self._row(k) for k in n.args)
            return f"({a} {n.text} {b})", x | y
        if n.kind == "call" and n.text in ("TRUE", "FALSE"):
            return n.text, frozenset()
        if n.kind == "call" and n.text in _SCALARS:
            parts = [self._row(a) for a in n.args]
            return f"{_SCALARS[n.text]}({', '.join(p for p, _ in parts)})", frozenset().union(*[t for _, t in parts])
        raise Unsupported(f"{n.text} over rows")
