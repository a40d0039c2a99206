"""A grammar for the supported part of MDX.

``parse`` turns a statement into a tree of plain nodes; names keep their spelling,
keywords and function names are read without regard to case.  Nothing here knows a
model: what a name means is decided in ``orthoplex.plans.resolve``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class MdxError(ValueError):
    """A statement that does not parse."""


@dataclass(frozen=True)
class Name:
    """A member or set reference: parts (text, is_key) and trailing calls such as Members."""

    parts: tuple[tuple[str, bool], ...]
    tail: str = ""  # members, children, allmembers, currentmember.children ...

    @property
    def head(self) -> str:
        return self.parts[0][0]

    @property
    def is_measure(self) -> bool:
        return self.parts[0][0].lower() == "measures"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[object, ...]
    tail: str = ""


@dataclass(frozen=True)
class Braces:
    items: tuple[object, ...]


@dataclass(frozen=True)
class Tuple:
    items: tuple[object, ...]


@dataclass(frozen=True)
class Minus:
    item: object


@dataclass(frozen=True)
class Compare:
    left: object
    op: str
    right: float


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Empty:
    """An argument that is left out."""


@dataclass(frozen=True)
class Axis:
    set: object
    name: str
    non_empty: bool = False
    properties: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    axes: tuple[Axis, ...]
    cube: str
    where: object | None = None
    subselects: tuple[Select, ...] = ()
    withs: tuple[tuple[str, str, str], ...] = ()  # kind, name, text
    cell_properties: tuple[str, ...] = ()
    drillthrough: bool = False
    max_rows: int | None = None
    text: str = field(default="", compare=False)


_TOKEN = re.compile(
    r"\s+|--[^\n]*|//[^\n]*|/\*.*?\*/|(?P<key>&\[(?:[^\]]|\]\])*\])|(?P<name>\[(?:[^\]]|\]\])*\])|(?P<number>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    r"|(?P<string>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(?P<op><>|<=|>=|[<>=])|(?P<word>[A-Za-z_@][A-Za-z0-9_]*)|(?P<sign>[(){},.;*+\-/:])",
    re.S,
)
_AXES = {"columns": "columns", "rows": "rows", "pages": "pages", "0": "columns", "1": "rows", "2": "pages"}


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise MdxError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group(), m.start()))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "", len(self.text))

    def next(self) -> tuple[str, str, int]:
        token = self.peek()
        self.at += 1
        return token

    def word(self, *words: str) -> bool:
        """Takes these keywords if they come next."""
        for k, w in enumerate(words):
            kind, text, _ = self.peek(k)
            if kind not in ("word", "number") or text.lower() != w:
                return False
        self.at += len(words)
        return True

    def sign(self, text: str) -> bool:
        if self.peek()[1] == text and self.peek()[0] in ("sign", "op"):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not (self.sign(text) or self.word(text)):
            kind, found, at = self.peek()
            raise MdxError(f"expected {text!r}, found {found or kind!r} at {at}")


def _unbracket(text: str) -> str:
    return text.strip("&")[1:-1].replace("]]", "]")


def parse(text: str) -> Select:
    if text.split(None, 1)[:1] and text.split(None, 1)[0].lower() in ("evaluate", "define"):
        raise MdxError("DAX queries are not supported: ask in MDX")
    reader = _Reader(text.strip().rstrip(";"))
    drill, most = reader.word("drillthrough"), None
    if drill and reader.word("maxrows"):
        most = int(float(reader.next()[1]))
    found = _select(reader, text)
    if reader.word("return"):
        while reader.peek()[0] != "end":
            reader.next()
    if reader.peek()[0] != "end":
        raise MdxError(f"unexpected {reader.peek()[1]!r} at {reader.peek()[2]}")
    return Select(**{**found.__dict__, "drillthrough": drill, "max_rows": most})


def _select(reader: _Reader, text: str) -> Select:
    withs = _withs(reader) if reader.word("with") else ()
    reader.need("select")
    axes = []
    if not (reader.peek()[0] == "word" and reader.peek()[1].lower() == "from"):
        axes.append(_axis(reader))
        while reader.sign(","):
            axes.append(_axis(reader))
    reader.need("from")
    inner: tuple[Select, ...] = ()
    if reader.sign("("):
        sub = _select(reader, text)
        reader.need(")")
        cube, inner = sub.cube, (sub, *sub.subselects)
    else:
        kind, name, at = reader.next()
        if kind not in ("name", "word"):
            raise MdxError(f"expected a cube at {at}")
        cube = _unbracket(name) if kind == "name" else name
    where = _set(reader) if reader.word("where") else None
    cells = tuple(_property_list(reader)) if reader.word("cell", "properties") else ()
    return Select(tuple(axes), cube, where, inner, withs, cells, text=text)


def _withs(reader: _Reader) -> tuple[tuple[str, str, str], ...]:
    found = []
    while reader.peek()[1].lower() in ("member", "set"):
        kind = reader.next()[1].lower()
        name = ""
        while reader.peek()[1].lower() != "as":
            if reader.peek()[0] == "end":
                raise MdxError("AS expected in WITH")
            name += reader.next()[1]
        reader.next()
        body, depth = [], 0
        while reader.peek()[0] != "end":
            token = reader.peek()
            if depth == 0 and token[0] == "word" and token[1].lower() in ("member", "set", "select"):
                break
            depth += {"(": 1, "{": 1, ")": -1, "}": -1}.get(token[1], 0) if token[0] == "sign" else 0
            body.append(token)
            reader.next()
        if body:
            start = body[0][2]
            end = reader.peek()[2]
            found.append((kind, name, reader.text[start:end].strip().strip("'").rstrip(",").strip()))
    return tuple(found)


def _axis(reader: _Reader) -> Axis:
    empty = reader.word("non", "empty")
    found = _set(reader)
    properties: list[str] = []
    if reader.word("dimension", "properties") or reader.word("properties"):
        properties = _property_list(reader)
    reader.need("on")
    if reader.word("axis"):
        reader.need("(")
        name = reader.next()[1]
        reader.need(")")
    else:
        name = reader.next()[1]
    if name.lower() not in _AXES:
        raise MdxError(f"unknown axis {name!r}")
    return Axis(found, _AXES[name.lower()], empty, tuple(properties))


def _property_list(reader: _Reader) -> list[str]:
    """Property names, bracketed prefixes included."""
    out = []
    while True:
        text = ""
        while reader.peek()[0] in ("name", "word") or reader.peek()[1] == ".":
            if reader.peek()[0] == "word" and reader.peek()[1].lower() == "on":
                break
            text += reader.next()[1]
        if text:
            out.append(text)
        if not reader.sign(","):
            return out


def _set(reader: _Reader) -> object:
    """A set expression; a*b*c is a cross join."""
    parts = [_term(reader)]
    while reader.sign("*"):
        parts.append(_term(reader))
    return parts[0] if len(parts) == 1 else Call("crossjoin", tuple(parts))


def _term(reader: _Reader) -> object:
    kind, text, at = reader.peek()
    if reader.sign("{"):
        return Braces(_items(reader, "}"))
    if reader.sign("("):
        return Tuple(_items(reader, ")"))
    if reader.sign("-"):
        if reader.peek()[0] == "number":
            return Number(-float(reader.next()[1]))
        return Minus(_term(reader))
    if kind == "number":
        return Number(float(reader.next()[1]))
    if kind == "string":
        reader.next()
        return Text(text[1:-1].replace(text[0] * 2, text[0]))
    if kind in ("name", "key"):
        return _name(reader)
    if kind == "word":
        if reader.peek(1)[1] == "(":
            reader.next()
            reader.next()
            args = _items(reader, ")")
            return Call(text.lower(), args, _tail(reader))
        if reader.peek(1)[1] == "." or reader.peek(1)[0] == "key":
            return _name(reader)
        reader.next()
        return Name(((text, False),))
    raise MdxError(f"unexpected {text or kind!r} at {at}")


def _items(reader: _Reader, end: str) -> tuple[object, ...]:
    out: list[object] = []
    if reader.sign(end):
        return ()
    while True:
        if reader.peek()[1] in (",", end):
            out.append(Empty())
        else:
            item = _set(reader)
            if reader.peek()[0] == "op":
                op = reader.next()[1]
                right = _term(reader)
                if not isinstance(right, Number):
                    raise MdxError("a comparison needs a number on its right")
                item = Compare(item, op, right.value)
            out.append(item)
        if reader.sign(end):
            return tuple(out)
        reader.need(",")


def _name(reader: _Reader) -> Name:
    parts: list[tuple[str, bool]] = []
    words: list[str] = []
    while True:
        kind, text, at = reader.next()
        if kind == "name":
            parts.append((_unbracket(text), False))
        elif kind == "key":
            parts.append((_unbracket(text), True))
        elif kind == "word":
            if parts and text.lower() in ("members", "children", "allmembers", "currentmember", "count", "parent", "siblings", "defaultmember", "hierarchy", "unique_name"):
                words.append(text.lower())
            else:
                parts.append((text, False))
        else:
            raise MdxError(f"unexpected {text!r} at {at}")
        if reader.peek()[0] == "key":
            continue
        if not reader.sign("."):
            return Name(tuple(parts), ".".join(words))


def _tail(reader: _Reader) -> str:
    words = []
    while reader.peek()[1] == "." and reader.peek(1)[0] == "word":
        reader.next()
        words.append(reader.next()[1].lower())
    return ".".join(words)
