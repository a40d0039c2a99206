"""Resolved queries: what is asked of a cube, free of syntax and of Spark.

All classes are frozen, so a query is its own cache key.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Group:
    """A grouping by a dimension: its level (index in the chain), with the levels above it if ``prefix``."""

    dimension: str
    level: int = 0
    prefix: bool = False


@dataclass(frozen=True)
class Filter:
    """Members of a level, any of which may hold. A key path ends at the level and may name ancestors before it."""

    dimension: str
    level: int | None  # None: the dimension's own column
    keys: tuple[tuple[str, ...], ...]
    exclude: bool = False


@dataclass(frozen=True)
class SetOp:
    kind: str  # top, bottom, percent, order, filter, head
    n: float = 0
    measure: str | None = None
    descending: bool = False
    op: str = ""


@dataclass(frozen=True)
class Cell:
    measure: str
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Collapse:
    """Members of one group whose other group is summed to All."""

    dimension: str
    members: tuple[str, ...]


@dataclass(frozen=True)
class CubeQuery:
    kind: str  # total, group, tuples, count, members, drillthrough, probe, empty
    measures: tuple[str, ...] = ()
    groups: tuple[Group, ...] = ()
    filters: tuple[Filter, ...] = ()
    set_ops: tuple[SetOp, ...] = ()
    cells: tuple[Cell, ...] = ()
    collapse: tuple[Collapse, ...] = ()
    axes: tuple[tuple[str, tuple[str, ...]], ...] = ()  # axis name, dimensions or Measures on it
    max_rows: int | None = None
    slicers: tuple[tuple[str, str], ...] = ()
    properties: tuple[str, ...] = ()
    probes: tuple[tuple[str, str, str], ...] = ()  # calculated member, the member it names, the property asked for
