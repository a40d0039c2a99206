"""Cellsets: the axes and cells of a query's result.

A cellset is what one client shows, so it is built from collected rows; at most
``MAX_CELLS`` cells, else it is refused rather than cut.  Ancestors of the members
on an axis, All included, are aggregated from the source rows, so totals are right
for measures that do not add up, too.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from orthoplex.operators.cube import ALL, Cube
from orthoplex.operators.rowsets import hierarchy_name, level_name, member_name, quoted
from orthoplex.plans.model import Dimension, ModelError, User
from orthoplex.plans.query import CubeQuery, Group
from orthoplex.plans.resolve import resolve

MAX_CELLS = 1_000_000
CHILDREN_MASK, DRILLED, SAME_PARENT = 0xFFFF, 0x10000, 0x20000


@dataclass
class Member:
    hierarchy: str
    unique: str
    caption: str
    level: str
    level_number: int
    parent: str | None = None
    info: int = 0


@dataclass
class Axis:
    name: str
    tuples: list[tuple[Member, ...]] = field(default_factory=list)


@dataclass
class Cell:
    ordinal: int
    value: float | str
    formatted: str


@dataclass
class Cellset:
    axes: list[Axis]
    slicer: Axis
    cells: list[Cell]


def formatted(value: float, units: str = "") -> str:
    """Without decimals where there are none, else with two; then the units."""
    text = f"{value:.0f}" if value == int(value) else f"{value:.2f}"
    return f"{text} {units}".strip()


def _path_member(d: Dimension, path: tuple[str, ...], children: int = 0, drilled: bool = False) -> Member:
    number = len(path) - (0 if d.has_all else 1)
    parent = member_name(d, path[:-1]) if path and (len(path) > 1 or d.has_all) else None
    return Member(hierarchy_name(d), member_name(d, path), path[-1] if path else ALL, level_name(d, number), number, parent, min(children, CHILDREN_MASK) | (DRILLED if drilled else 0))


def _measure_member(cube: Cube, measure: str) -> Member:
    m = cube.model.measure(measure)
    return Member("[Measures]", f"[Measures].{quoted(m.caption)}", m.display or m.caption, "[Measures].[MeasuresLevel]", 0)


def _slicer(cube: Cube, q: CubeQuery, shown: set[str]) -> Axis:
    """The measure first unless it is on an axis, then every visible dimension that is on none."""
    members = [] if any("Measures" in names for _, names in q.axes) or not q.measures else [_measure_member(cube, q.measures[0])]
    given = dict(q.slicers)
    for d in sorted(cube.model.dimensions, key=lambda d: d.ordinal):
        if d.visible and d.id not in shown:
            key = given.get(d.id, ALL)
            members.append(_path_member(d, () if key == ALL else tuple(key.split("|"))))
    return Axis("SlicerAxis", [tuple(members)])


def cellset(cube: Cube, text: str, user: User | None = None) -> Cellset:
    q = resolve(text, cube.model, cube.prefix_levels)
    if q.kind == "empty":
        return Cellset([Axis("Axis0")], Axis("SlicerAxis"), [])
    if q.kind == "members":
        found = cube.dataframe(q, user).limit(MAX_CELLS).collect()
        tuples = []
        for r in found:
            d = cube.model.dimension(r["dimension"])
            above = () if r["parent"] in (None, ALL) else tuple(r["parent"].split("|"))
            tuples.append((_path_member(d, (*above, r["member"])),))
        return Cellset([Axis("Axis0", tuples)], _slicer(cube, q, {g.dimension for g in q.groups}), [])
    if q.kind == "probe":
        rows = cube.dataframe(q, user).collect()
        members = [(Member("[Measures]", f"[Measures].[{r.member}]", r.member, "[Measures].[MeasuresLevel]", 0, info=0 if k == 0 else SAME_PARENT),) for k, r in enumerate(rows)]
        return Cellset([Axis("Axis0", members)], _slicer(cube, q, set()), [Cell(k, r.value, r.value) for k, r in enumerate(rows)])
    if q.kind == "count":
        n = cube.dataframe(q, user).first()[0]
        d = cube.model.dimension(q.groups[0].dimension)
        return Cellset([Axis("Axis0", [(_path_member(d, ()),)])], Axis("SlicerAxis"), [Cell(0, float(n), str(n))])
    if q.kind == "tuples":
        rows = cube.dataframe(q, user).collect()
        tuples = [(_measure_member(cube, c.measure), *[_path_member(cube.model.dimension(f.dimension), f.keys[0]) for f in c.filters]) for c in q.cells]
        return Cellset([Axis("Axis0", tuples)], _slicer(cube, q, set()), [Cell(r["ord"], r["value"], formatted(r["value"], cube.model.measure(r["measure"]).units)) for r in rows])
    return _grid(cube, q, user)


def _grid(cube: Cube, q: CubeQuery, user: User | None) -> Cellset:
    """Members (with their ancestors) on rows, measures on columns."""
    paths = _rows(cube, q, user)
    measures = list(q.measures)
    if len(paths) * len(measures) > MAX_CELLS:
        raise ModelError(f"the cellset has more than {MAX_CELLS} cells")
    shown = {g.dimension for g in q.groups}
    on_axis = any("Measures" in names for _, names in q.axes)
    measure_tuples = [(_measure_member(cube, m),) for m in measures]
    dims = [cube.model.dimension(g.dimension) for g in q.groups]
    tuples, previous = [], None
    for path, _, size in paths:
        row = []
        for k, (d, own) in enumerate(zip(dims, path, strict=True)):
            member = _path_member(d, own, size[k], len(own) <= q.groups[k].level and bool(own or q.groups))
            if previous is not None and len(previous[k]) == len(own) and previous[k][:-1] == own[:-1] and own:
                member.info |= SAME_PARENT
            row.append(member)
        tuples.append(tuple(row))
        previous = path
    axes = []
    if not dims:
        axes = [Axis("Axis0", measure_tuples)] if on_axis or len(measures) > 1 else []
    else:
        axes = [Axis("Axis0", measure_tuples), Axis("Axis1", tuples)] if on_axis else [Axis("Axis0", tuples)]
    cells, width = [], len(measures) if on_axis or not dims else 1
    for r, (_, values, _) in enumerate(paths):
        for c, m in enumerate(measures[:width]):
            cells.append(Cell(r * width + c, values[m], formatted(values[m], cube.model.measure(m).units)))
    return Cellset(axes, _slicer(cube, q, shown), cells)


Row = tuple[tuple[tuple[str, ...], ...], dict[str, float], list[int]]


def _rows(cube: Cube, q: CubeQuery, user: User | None) -> list[Row]:
    """(a key path per dimension, measure values, children per dimension) in the order of the axis."""
    if not q.groups:
        r = cube.dataframe(q, user).first()
        return [((), {m: (r[m] if r else 0.0) for m in q.measures}, [])]
    dims = [cube.model.dimension(g.dimension) for g in q.groups]
    above: list[tuple[str, ...]] = []
    for g, d in zip(q.groups, dims, strict=True):
        pinned = [k for f in q.filters if f.dimension == d.id and f.level == g.level - 1 and not f.exclude for k in f.keys]
        above.append(pinned[0] if len(pinned) == 1 and not g.prefix else ())
    depths = []
    for g, base, d in zip(q.groups, above, dims, strict=True):
        lowest = 0 if d.has_all and not q.collapse else 1
        depths.append([None] if base or q.set_ops else list(range(lowest, (g.level + 1 if g.prefix or g.level == 0 else 1) + 1)))
    out: list[Row] = []
    for combination in product(*depths):
        groups, places = [], []
        for g, depth in zip(q.groups, combination, strict=True):
            if depth == 0:
                places.append(None)
                continue
            level = g.level if depth is None or not g.prefix else depth - 1
            groups.append(Group(g.dimension, level, g.prefix and level > 0))
            places.append(level)
        part = CubeQuery("group" if groups else "total", q.measures, tuple(groups), q.filters, q.set_ops, (), q.collapse if len(groups) == len(q.groups) else (), q.axes)
        labels = cube.labels(tuple(groups))
        for r in cube.dataframe(part, user).limit(MAX_CELLS + 1).collect():
            values, at, path = [r[c] for c in labels], 0, []
            for k, (g, level) in enumerate(zip(q.groups, places, strict=True)):
                if level is None:
                    path.append(())
                    continue
                width = level + 1 if g.prefix and level > 0 else 1
                keys = tuple(values[at : at + width])
                path.append(() if keys == (ALL,) and q.collapse else (*above[k], *keys))
                at += width
            out.append((tuple(path), {m: r[m] for m in q.measures}, [0] * len(dims)))
    if not q.set_ops:
        out.sort(key=lambda row: [[(x,) for x in path] for path in row[0]])
    children: dict[tuple[int, tuple], set] = {}
    for path, _, _ in out:
        for k, own in enumerate(path):
            for j in range(len(own)):
                children.setdefault((k, own[:j]), set()).add(own[: j + 1])
    return [(path, values, [len(children.get((k, own), ())) for k, own in enumerate(path)]) for path, values, _ in out]
