"""Members of dimensions and how to move between them."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplex.functions.sqltext import to_spark
from orthoplex.plans.model import Dimension, User
from orthoplex.plans.query import Filter
from orthoplex.plans.security import Grant, grant

if TYPE_CHECKING:
    from orthoplex.operators.cube import Cube


def _source(cube: Cube, d: Dimension, g: Grant) -> DataFrame | None:
    """The rows that define a dimension's members, as far as the user may see them."""
    from orthoplex.operators.cube import alias_of

    table = cube.model.table_of(d)
    access = g.table(table)
    if g.permission == "none" or access.kind == "hidden":
        return None
    on_fact = any(f.table == table for f in cube.model.facts)
    out = cube.table(table).alias("f" if on_fact else alias_of(d))
    if access.kind == "filtered":
        out = out.where(F.expr(to_spark(access.predicate)))
    return out


def members(cube: Cube, dimension: str, *, level: int | None = None, user: User | None = None, grant_: Grant | None = None, parent: Filter | None = None) -> DataFrame:
    """(dimension, level, member, parent) in order: distinct labels of a level, under a parent if given."""
    d = cube.model.dimension(dimension)
    g = grant_ or grant(cube.model, user)
    k = len(d.chain) - 1 if level is None else level
    here = d.chain[k]
    rows = _source(cube, d, g)
    if rows is None:
        return cube.spark.createDataFrame([], "dimension string, level string, member string, parent string")
    if parent is not None:
        rows = rows.where(cube._holds(d, parent, cube.model.table_of(d), None))
    column = here.column if d.levels else d.column
    above = F.concat_ws("|", *[F.col(f"`{x.column}`").cast("string") for x in d.chain[:k]]) if k else F.lit("All" if d.has_all else None).cast("string")
    out = rows.select(F.lit(d.id).alias("dimension"), F.lit(here.name).alias("level"), F.col(f"`{column}`").cast("string").alias("member"), above.alias("parent"))
    return out.where("member is not null").distinct().orderBy("parent", "member")


def children(cube: Cube, dimension: str, path: tuple[str, ...] = (), user: User | None = None) -> DataFrame:
    """Members one level below a path of keys; below nothing, those of the first level."""
    d = cube.model.dimension(dimension)
    if not path:
        return members(cube, dimension, level=0, user=user)
    if len(path) >= len(d.chain):
        return members(cube, dimension, level=0, user=user).limit(0)
    return members(cube, dimension, level=len(path), user=user, parent=Filter(d.id, len(path) - 1, (path,)))


def siblings(cube: Cube, dimension: str, path: tuple[str, ...], user: User | None = None) -> DataFrame:
    return children(cube, dimension, path[:-1], user)


def child_counts(cube: Cube, dimension: str, level: int = 0, user: User | None = None) -> DataFrame:
    """(member path columns, children): number of different members below each member of a level."""
    d = cube.model.dimension(dimension)
    rows = _source(cube, d, grant(cube.model, user))
    names = [x.name for x in d.chain[: level + 1]]
    if rows is None or level + 1 >= len(d.chain):
        return cube.spark.createDataFrame([], ", ".join([*[f"`{n}` string" for n in names], "children long"]))
    keys = [F.col(f"`{x.column}`").cast("string").alias(x.name) for x in d.chain[: level + 1]]
    return rows.groupBy(*keys).agg(F.countDistinct(f"`{d.chain[level + 1].column}`").alias("children")).dropna(subset=names)


def cardinality(cube: Cube, dimension: str, exact: bool = False) -> DataFrame:
    """(level, members) of each level, estimated unless ``exact``: hints for clients."""
    d = cube.model.dimension(dimension)
    count = F.countDistinct if exact else F.approx_count_distinct
    rows = cube.table(cube.model.table_of(d)).agg(*[count(f"`{x.column if d.levels else d.column}`").alias(x.name) for x in d.chain])
    return reduce(DataFrame.unionByName, [rows.select(F.lit(x.name).alias("level"), F.col(f"`{x.name}`").alias("members")) for x in d.chain])
