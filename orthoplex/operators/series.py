"""Running totals along a hierarchy of periods."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoplex.plans.model import User
from orthoplex.plans.query import CubeQuery, Filter, Group

if TYPE_CHECKING:
    from orthoplex.operators.cube import Cube


def cumulative(cube: Cube, measure: str, dimension: str, level: int, *, filters: tuple[Filter, ...] = (), user: User | None = None, year: int | None = None) -> DataFrame:
    """A measure per period with its running total since the start of the outermost period (the year); of one year, if given.

    Each period's value is aggregated from the source; running totals then add those values, also where members recur.
    """
    d = cube.model.dimension(dimension)
    m = cube.model.measure(measure)
    if year is not None:
        filters = (*filters, Filter(d.id, 0, ((str(year),),)))
    rows = cube.dataframe(CubeQuery("group", (m.id,), (Group(d.id, level, level > 0),), filters), user, ordered=False)
    names = [x.name for x in d.chain[: level + 1]]
    # periods are numbers in text: order by value, not by label
    order = [F.col(f"`{n}`").try_cast("long") for n in names[1:]] + [F.col(f"`{n}`") for n in names[1:]]
    running = Window.partitionBy(names[0]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(f"`{m.id}`").over(running))


def nested(cube: Cube, measure: str, inner: tuple[Group, ...], outer: tuple[Group, ...] = (), function: str = "avg", *, filters: tuple[Filter, ...] = (), user: User | None = None) -> DataFrame:
    """An aggregate of a measure's values per group: by ``outer``, the average (sum, min, max, count, median) over ``inner``."""
    if function not in ("avg", "sum", "min", "max", "count", "median"):
        raise ValueError(f"unknown function {function!r}")
    rows = cube.dataframe(CubeQuery("group", (measure,), (*outer, *inner), filters), user, ordered=False)
    labels = cube.labels((*outer, *inner))[: len(cube.labels(outer))]
    value = getattr(F, function)(F.col(f"`{measure}`")).cast("double").alias(measure)
    return rows.groupBy(*[F.col(f"`{c}`") for c in labels]).agg(value) if labels else rows.agg(value)
