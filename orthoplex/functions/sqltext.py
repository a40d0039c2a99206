"""Aggregate SQL text of measures: dialect, additivity, and conditional forms."""

from __future__ import annotations

import re
from dataclasses import dataclass

_CAST = re.compile(r"(\b[\w.]+\b|\([^()]*\))\s*::\s*([A-Za-z]+(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?)")
_CALL = re.compile(r"^\s*([A-Za-z_]+)\s*\(\s*(DISTINCT\s+)?", re.I)
#: Names that differ between the dialects measures are written in and Spark's.
_TYPES = {"varchar": "STRING", "text": "STRING", "hugeint": "DECIMAL(38,0)", "int4": "INT", "int8": "BIGINT", "float8": "DOUBLE", "float4": "FLOAT", "timestamptz": "TIMESTAMP"}


def to_spark(sql: str) -> str:
    """The same expression for Spark: x::T as CAST, type names, strings otherwise untouched."""
    out = []
    for k, piece in enumerate(re.split(r"('(?:[^']|'')*')", sql)):
        if k % 2 == 0:
            before = None
            while before != piece:
                before, piece = piece, _CAST.sub(r"CAST(\1 AS \2)", piece)
            piece = re.sub(r"(?i)\bAS\s+(\w+)(?!\s*\()", lambda m: "AS " + _TYPES.get(m.group(1).lower(), m.group(1)), piece)
        out.append(piece)
    return "".join(out)


def _closes(text: str, start: int) -> int:
    """Index of the parenthesis that closes the one at ``start``."""
    depth, quote = 0, ""
    for k in range(start, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return k
    return -1


@dataclass(frozen=True)
class Aggregate:
    """A single aggregate call, with an optional CAST around it."""

    function: str
    distinct: bool
    argument: str
    cast: str | None = None

    def text(self, condition: str | None = None) -> str:
        call = f"{self.function}({'DISTINCT ' if self.distinct else ''}{self.argument})"
        if condition:
            call += f" FILTER (WHERE {condition})"
        return f"CAST({call} AS {self.cast})" if self.cast else call

    @property
    def additive(self) -> bool:
        return not self.distinct and self.function.upper() in ("SUM", "COUNT")

    def partial(self) -> str:
        """What a rollup stores."""
        return f"{self.function}({self.argument})"

    def merge(self, column: str) -> str:
        """The measure over a rollup's stored column."""
        return f"CAST(SUM({column}) AS {self.cast})" if self.cast else f"SUM({column})"


def single_aggregate(sql: str) -> Aggregate | None:
    """The parts of an expression that is one aggregate call, else None."""
    text, cast = sql.strip(), None
    m = re.match(r"(?i)CAST\s*\(", text)
    if m and _closes(text, m.end() - 1) == len(text) - 1:
        body = text[m.end() : -1]
        k = re.search(r"(?i)\s+AS\s+([A-Za-z]+(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?)\s*$", body)
        if k:
            text, cast = body[: k.start()].strip(), k.group(1)
    m = _CALL.match(text)
    if not m:
        return None
    start = text.index("(")
    if _closes(text, start) != len(text) - 1 or m.group(1).upper() in ("COALESCE", "CAST", "NULLIF", "ROUND", "ABS", "IF"):
        return None
    return Aggregate(m.group(1), bool(m.group(2)), text[m.end() : -1].strip(), cast)
