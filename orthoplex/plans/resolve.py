"""From a parsed statement and a model to a resolved query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from orthoplex.plans import mdx
from orthoplex.plans.model import Dimension, Model, ModelError
from orthoplex.plans.query import Cell, Collapse, CubeQuery, Filter, Group, SetOp

_ALL = ("all", "(all)")
_SAME = {"hierarchize", "addcalculatedmembers", "nonempty", "distinct", "stripcalculatedmembers", "cachedset", "include_calc_members"}


@dataclass
class Part:
    """What a set says about one dimension."""

    dimension: Dimension
    level: int = 0
    members: list[tuple[int | None, tuple[str, ...]]] = field(default_factory=list)
    all_only: bool = False
    all_level: bool = False  # the members of the All level itself
    excluded: list[tuple[int | None, tuple[str, ...]]] = field(default_factory=list)


@dataclass
class Found:
    parts: list[Part] = field(default_factory=list)
    measures: list[str] = field(default_factory=list)
    tuples: list[tuple[list[str], list[Part]]] = field(default_factory=list)
    set_ops: list[SetOp] = field(default_factory=list)
    collapse: list[Collapse] = field(default_factory=list)
    nothing: bool = False  # children of a leaf or of a measure
    enumerates: bool = False  # a set of members rather than single ones

    def part(self, dimension: Dimension) -> Part | None:
        return next((p for p in self.parts if p.dimension.id == dimension.id), None)

    def take(self, other: Found) -> None:
        """Union: members of one dimension come together."""
        self.measures += [m for m in other.measures if m not in self.measures]
        for p in other.parts:
            mine = self.part(p.dimension)
            if mine is None:
                self.parts.append(p)
                continue
            if p.all_only:
                continue
            if mine.all_only:
                mine.all_only, mine.level, mine.members = False, p.level, p.members
            elif not mine.members or not p.members:
                mine.members, mine.level = [], max(mine.level, p.level)
            else:
                mine.members += [m for m in p.members if m not in mine.members]
                mine.level = max(mine.level, p.level)
            mine.excluded += p.excluded
        self.tuples += other.tuples
        self.set_ops += other.set_ops
        self.collapse += other.collapse
        self.nothing |= other.nothing
        self.enumerates |= other.enumerates


class Resolver:
    def __init__(self, model: Model, prefix_levels: bool = True) -> None:
        self.model, self.prefix_levels = model, prefix_levels

    # ---- names

    def name(self, n: mdx.Name) -> Found:
        if n.is_measure:
            if "children" in n.tail and len(n.parts) > 1:
                return Found(nothing=True)
            if "members" in n.tail or "children" in n.tail or len(n.parts) == 1:
                return Found(measures=[m.id for m in self.model.measures if m.visible], enumerates=True)
            return Found(measures=[self.model.measure(n.parts[1][0]).id])
        dimension = self.model.dimension(n.head)
        rest = list(n.parts[1:])
        if rest and not rest[0][1] and rest[0][0].lower() in (dimension.hierarchy.lower(), dimension.caption.lower(), dimension.id.lower()):
            rest = rest[1:]
        return self._member(dimension, rest, n.tail)

    def _member(self, d: Dimension, rest: list[tuple[str, bool]], tail: str) -> Found:
        lists = "members" in tail
        children = "children" in tail
        if not rest:
            if lists or children:
                return Found([Part(d, 0)], enumerates=True)
            return Found([Part(d, all_only=True)])
        first, is_key = rest[0]
        if not is_key and first.lower() in (*_ALL, d.all_level.lower()):
            if lists:
                return Found([Part(d, all_only=True, all_level=True)], enumerates=True)
            return Found([Part(d, 0)], enumerates=True) if children else Found([Part(d, all_only=True)])
        level: int | None = None
        if not is_key:
            found = d.level(first)
            named = found is not None or first.lower() in (d.leaf_level.lower(), d.caption.lower())
            if named and (len(rest) > 1 or lists or d.levels):
                level = d.chain.index(found) if found else len(d.chain) - 1
                rest = rest[1:]
        if not rest:
            return Found([Part(d, level or 0)], enumerates=True)
        keys = tuple(k for k, _ in rest)
        if level is None and d.levels and len(keys) > 1:
            level = len(keys) - 1
        if level is not None and len(keys) > level + 1:
            raise ModelError(f"{'|'.join(keys)!r} has more keys than level {d.chain[level].name!r} of {d.caption!r} is deep")
        if level is not None and not d.levels:
            level = None
        if children:
            if level is None or level + 1 >= len(d.chain):
                return Found(nothing=True)
            return Found([Part(d, level + 1, [(level, keys)])], enumerates=True)
        return Found([Part(d, level if level is not None else len(d.chain) - 1, [(level, keys)])])

    # ---- sets

    def set(self, node: object) -> Found:
        if isinstance(node, mdx.Name):
            return self.name(node)
        if isinstance(node, mdx.Braces):
            out = Found()
            tuples = [x for x in node.items if isinstance(x, mdx.Tuple)]
            for item in node.items:
                if isinstance(item, mdx.Tuple) and (len(tuples) > 1 or len(item.items) > 1):
                    found = self.set(item)
                    plain = len(found.measures) <= 1 and all(p.members or p.all_only for p in found.parts)
                    if plain and (found.measures or len(found.parts) > 1 or (found.parts and found.parts[0].members)):
                        out.tuples.append((found.measures, found.parts))
                        continue
                    out.take(found)
                elif not isinstance(item, mdx.Empty):
                    out.take(self.set(item))
            return out
        if isinstance(node, mdx.Tuple):
            out = Found()
            for item in node.items:
                if not isinstance(item, mdx.Empty):
                    out.take(self.set(item))
            return out
        if isinstance(node, mdx.Minus):
            found = self.set(node.item)
            return Found(collapse=[Collapse(p.dimension.id, tuple("|".join(k) for _, k in p.members)) for p in found.parts])
        if isinstance(node, mdx.Call):
            return self.call(node)
        if isinstance(node, (mdx.Empty, mdx.Number, mdx.Text, mdx.Compare)):
            return Found()
        raise ModelError(f"cannot use {node!r} as a set")

    def _drilled(self, found: Found) -> Found:
        """One level below the members of a set; All opens the first level."""
        for p in found.parts:
            if p.all_only:
                p.all_only, p.level = False, 0
            elif p.members:
                level = p.members[-1][0]
                level = p.level if level is None else level
                p.level = min(level + 1, len(p.dimension.chain) - 1)
        found.enumerates = True
        return found

    def call(self, c: mdx.Call) -> Found:
        name, args = c.name, [a for a in c.args if not isinstance(a, mdx.Empty)]
        if name in _SAME:
            found = self.set(args[0])
            found.enumerates = True
            return found
        if name == "head":
            out = self.set(args[0])
            if len(args) > 1 and not isinstance(args[1], mdx.Number):
                raise ModelError("Head needs a number")
            out.set_ops.append(SetOp("head", args[1].value if len(args) > 1 else 1))
            out.enumerates = True
            return out
        if name in ("crossjoin", "union"):
            out = Found()
            for a in args:
                out.take(self.set(a))
            out.enumerates = True
            return out
        if name in ("drilldownlevel", "drilldownleveltop"):
            return self._drilled(self.set(args[0]))
        if name in ("drilldownmember", "drillupmember"):
            out, more = self.set(args[0]), self.set(args[1])
            for p in out.parts:
                if p.all_only:
                    p.all_only = False
                elif all(level is None for level, _ in p.members):
                    p.members = []
            out.enumerates = True
            if more.collapse:
                out.collapse += more.collapse
                return out
            for p in self._drilled(more).parts:
                mine = out.part(p.dimension)
                if mine is None:
                    out.parts.append(p)
                elif p.dimension.levels:
                    mine.level, mine.members = p.level, p.members
            return out
        if name == "except":
            out, less = self.set(args[0]), self.set(args[1])
            for p in less.parts:
                if mine := out.part(p.dimension):
                    mine.excluded += p.members
            return out
        if name == "descendants":
            out = self.set(args[0])
            if len(args) > 1:
                below = self.set(args[1])
                for p, q in zip(out.parts, below.parts, strict=False):
                    p.level, p.all_only = q.level, False
            else:
                self._drilled(out)
            out.enumerates = True
            return out
        if name in ("topcount", "bottomcount", "toppercent"):
            out = self.set(args[0])
            if not isinstance(args[1], mdx.Number):
                raise ModelError(f"{name} needs a number")
            kind = {"topcount": "top", "bottomcount": "bottom", "toppercent": "percent"}[name]
            out.set_ops.append(SetOp(kind, args[1].value, self._measure_of(args[2:])))
            out.enumerates = True
            return out
        if name == "order":
            out = self.set(args[0])
            words = [a.head.upper() for a in args[1:] if isinstance(a, mdx.Name)]
            out.set_ops.append(SetOp("order", measure=self._measure_of(args[1:2]), descending=any(w in ("DESC", "BDESC") for w in words)))
            out.enumerates = True
            return out
        if name == "filter":
            out = self.set(args[0])
            test = args[1]
            if not isinstance(test, mdx.Compare):
                raise ModelError("Filter needs a comparison with a number")
            out.set_ops.append(SetOp("filter", test.right, self._measure_of([test.left]), op=test.op))
            out.enumerates = True
            return out
        raise ModelError(f"unsupported function {name!r}")

    def _measure_of(self, nodes: list[object]) -> str | None:
        for n in nodes:
            if isinstance(n, (mdx.Tuple, mdx.Braces)):
                return self._measure_of(list(n.items))
            if isinstance(n, mdx.Name) and n.is_measure:
                return self.name(n).measures[0]
        return None

    # ---- statements

    def query(self, s: mdx.Select) -> CubeQuery:
        if s.withs:
            return self._with(s)
        where = self.set(s.where) if s.where is not None else Found()
        axes = [(a, self.set(a.set)) for a in s.axes]
        whole = Found()
        for _, f in axes:
            whole.take(_copy(f))
        filters = self._filters([where, *[self.set(a.set) for sub in s.subselects for a in sub.axes]])
        measures = list(dict.fromkeys([*whole.measures, *where.measures]))
        slicers = tuple((p.dimension.id, "|".join(p.members[0][1]) if p.members else "All") for p in where.parts)
        axis_dims = tuple((a.name, tuple([*(["Measures"] if f.measures else []), *[p.dimension.id for p in f.parts]])) for a, f in axes)
        properties = tuple(p for a, _ in axes for p in a.properties)
        if whole.nothing:
            return CubeQuery("empty", filters=filters, axes=axis_dims)
        if s.drillthrough:
            members = self._filters([Found(parts=[p for p in whole.parts if p.members])])
            for measure_names, parts in whole.tuples:
                measures += [m for m in measure_names if m not in measures]
                members += self._filters([Found(parts=parts)])
            return CubeQuery("drillthrough", tuple(measures) or (self.model.default_measure().id,), filters=_merged([*filters, *members]), max_rows=s.max_rows)
        if whole.tuples and not whole.parts:
            cells = []
            for names, parts in whole.tuples:
                measure = (names or where.measures or [None])[0] or self._default(parts).id
                cells.append(Cell(measure, _merged([*filters, *self._filters([Found(parts=parts)])])))
            if len(cells) == 1:
                return CubeQuery("total", (cells[0].measure,), filters=cells[0].filters, axes=axis_dims, slicers=slicers)
            if all(not c.filters or c.filters == filters for c in cells) and len({c.measure for c in cells}) == len(cells):
                return CubeQuery("total", tuple(c.measure for c in cells), filters=filters, axes=axis_dims, slicers=slicers)
            return CubeQuery("tuples", cells=tuple(cells), axes=axis_dims, slicers=slicers)
        if not measures:
            alone = len(axes) == 1 and not where.parts and not whole.enumerates and not whole.set_ops
            if alone and whole.parts and all(p.members for p in whole.parts):
                return CubeQuery("members", filters=self._filters([whole]), groups=tuple(self._group(p) for p in whole.parts), axes=axis_dims, properties=properties)
            if any(p.all_level for p in whole.parts):
                return CubeQuery("total", (self._default(whole.parts).id,), axes=axis_dims)
            measures = [self._default(whole.parts).id]
        groups, own = [], []
        for p in whole.parts:
            if p.all_only:
                continue
            groups.append(self._group(p, filters))
            own.append(p)
        filters = _merged([*filters, *self._filters([Found(parts=own)])])
        if not groups:
            return CubeQuery("total", tuple(measures), filters=filters, axes=axis_dims, slicers=slicers)
        return CubeQuery("group", tuple(measures), tuple(groups), filters, tuple(whole.set_ops), (), tuple(whole.collapse), axis_dims, None, slicers, properties)

    def _group(self, p: Part, filters: tuple[Filter, ...] = ()) -> Group:
        """A level below the first is grouped with those above it, unless filters pin these or the key alone was asked for."""
        level = p.level if p.dimension.levels else 0
        pinned = {k for k, _ in p.members} | {f.level for f in filters if f.dimension == p.dimension.id}
        deep = max((k for k in pinned if k is not None), default=-1)
        keys = max((len(k) for _, k in p.members), default=1)
        prefix = self.prefix_levels and level > 0 and not (deep >= level - 1 and (deep == 0 or keys > deep or deep == level)) and bool(p.dimension.levels)
        return Group(p.dimension.id, level, prefix)

    def _default(self, parts: list[Part]):
        for p in parts:
            if p.dimension.fact is not None and not p.dimension.shared:
                return self.model.default_measure(self.model.fact(p.dimension.fact))
        return self.model.default_measure()

    def _filters(self, found: list[Found]) -> tuple[Filter, ...]:
        out = []
        for f in found:
            for p in f.parts:
                by_level: dict[int | None, list[tuple[str, ...]]] = {}
                for level, key in p.members:
                    by_level.setdefault(level, []).append(key)
                out += [Filter(p.dimension.id, level, tuple(keys)) for level, keys in by_level.items()]
                without: dict[int | None, list[tuple[str, ...]]] = {}
                for level, key in p.excluded:
                    without.setdefault(level, []).append(key)
                out += [Filter(p.dimension.id, level, tuple(keys), True) for level, keys in without.items()]
        return _merged(out)

    def _with(self, s: mdx.Select) -> CubeQuery:
        """The calculated members that clients send: names and captions of members, and counts of children."""
        text = " ".join(body for _, _, body in s.withs)
        probes = []
        for _, name, body in s.withs:
            if m := re.search(r"strtomember\(\s*[\"'](.+?)[\"']\s*\)\s*\.\s*([\w.]+)", body, re.I):
                probes.append((name.split("].[")[-1].strip("[]"), m.group(1), m.group(2)))
        if probes:
            return CubeQuery("probe", probes=tuple(probes))
        m = re.search(r"\[([^\]]+)\]\s*\.\s*\[([^\]]+)\]\.\s*currentmember\.\s*children", text, re.I)
        if not m:
            raise ModelError("unsupported calculated member")
        if m.group(1).lower() == "measures":
            return CubeQuery("empty")
        d = self.model.dimension(m.group(1))
        return CubeQuery("count", groups=(Group(d.id, 0),))


def _copy(f: Found) -> Found:
    parts = [Part(p.dimension, p.level, list(p.members), p.all_only, p.all_level, list(p.excluded)) for p in f.parts]
    return Found(parts, list(f.measures), list(f.tuples), list(f.set_ops), list(f.collapse), f.nothing, f.enumerates)


def _merged(filters) -> tuple[Filter, ...]:
    """Members of one level of a dimension come together (union); different levels all hold."""
    out: dict[tuple[str, int | None, bool], list[tuple[str, ...]]] = {}
    for f in filters:
        keys = out.setdefault((f.dimension, f.level, f.exclude), [])
        keys += [k for k in f.keys if k not in keys]
    return tuple(Filter(d, level, tuple(keys), x) for (d, level, x), keys in out.items())


def resolve(text: str, model: Model, prefix_levels: bool = True) -> CubeQuery:
    return Resolver(model, prefix_levels).query(mdx.parse(text))
