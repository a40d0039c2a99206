"""Rollups: design, build, validation and routing.

For every level but the leaf of a dimension with a hierarchy and a relationship, a
rollup holds the additive measures of a fact by that level, the levels above it and
the fact's own (relationship-free) dimensions.  A query goes to the coarsest rollup
that covers it; never when a row filter applies to the user, nor with time flags.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplex.functions.sqltext import single_aggregate, to_spark
from orthoplex.plans.model import Fact, Measure, Model
from orthoplex.plans.query import CubeQuery, Filter, Group
from orthoplex.plans.security import Grant

if TYPE_CHECKING:
    from orthoplex.operators.cube import Cube

VERSION = 1


class RollupError(RuntimeError):
    """A rollup that does not add up to its fact."""


@dataclass(frozen=True)
class Design:
    name: str
    fact: str
    dimension: str
    level: int
    leaves: tuple[str, ...]  # dimensions of the fact itself
    measures: tuple[str, ...]


@dataclass(frozen=True)
class Rollup:
    design: Design
    data: DataFrame

    def answer(self, cube: Cube, measures: list[Measure], q: CubeQuery, filters: tuple[Filter, ...]) -> DataFrame:
        out = self.data
        for f in filters:
            d = cube.model.dimension(f.dimension)
            if f.dimension == self.design.dimension:
                tests = []
                for path in f.keys:
                    chain = d.chain[f.level - len(path) + 1 : f.level + 1]
                    tests.append(reduce(lambda a, b: a & b, [F.col(_level(d.id, x.name)) == k for x, k in zip(chain, path, strict=True)]))
                test = reduce(lambda a, b: a | b, tests)
            else:
                test = F.col(_leaf(d.id)).isin([k[-1] for k in f.keys])
            out = out.where(~test if f.exclude else test)
        keys, labels = [], iter(cube.labels(q.groups))
        for g in q.groups:
            d = cube.model.dimension(g.dimension)
            if g.dimension == self.design.dimension:
                keys += [F.col(_level(d.id, d.chain[k].name)).alias(next(labels)) for k in (range(g.level + 1) if g.prefix else [g.level])]
            else:
                keys.append(F.col(_leaf(d.id)).alias(next(labels)))
        sums = [F.coalesce(F.expr(single_aggregate(to_spark(m.sql)).merge(f"`{m.id}`")).cast("double"), F.lit(0.0)).alias(m.id) for m in measures]
        return out.groupBy(*keys).agg(*sums).dropna(subset=cube.labels(q.groups)) if keys else out.agg(*sums)


def _level(dimension: str, level: str) -> str:
    return f"{dimension}__{level}".replace(" ", "_")


def _leaf(dimension: str) -> str:
    return f"{dimension}__leaf".replace(" ", "_")


def additive(m: Measure) -> bool:
    found = single_aggregate(to_spark(m.sql))
    return m.time is None and m.fallback is None and found is not None and found.additive


def design(model: Model) -> list[Design]:
    """Coarsest first."""
    out = []
    for fact in model.facts:
        measures = tuple(m.id for m in model.measures if model.fact_of(m).id == fact.id and additive(m))
        leaves = tuple(d.id for d in model.dimensions if not any(r.dimension == d.id for r in model.relationships) and d.table is None and (d.fact is None or model.fact(d.fact).id == fact.id) and not d.date_role)
        for d in model.dimensions:
            if measures and len(d.levels) >= 2 and model.relationship(d, fact):
                out += [Design(f"agg_{fact.id}_{d.id}_{level.name}".replace(" ", "_").lower(), fact.id, d.id, k, leaves, measures) for k, level in enumerate(d.levels[:-1])]
    return sorted(out, key=lambda x: x.level)


def _build(cube: Cube, x: Design) -> DataFrame:
    model = cube.model
    fact, d = model.fact(x.fact), model.dimension(x.dimension)
    groups = (Group(d.id, x.level, True), *[Group(k) for k in x.leaves])
    joined = cube._star(fact, CubeQuery("group", groups=groups), [], Grant("administrator"), [])
    keys = [cube._column(d, fact, level.column).cast("string").alias(_level(d.id, level.name)) for level in d.levels[: x.level + 1]]
    keys += [F.col(f"f.`{model.dimension(k).column}`").cast("string").alias(_leaf(k)) for k in x.leaves]
    sums = [F.expr(single_aggregate(to_spark(model.measure(m).sql)).partial()).alias(m) for m in x.measures]
    return joined.groupBy(*keys).agg(*sums)


def _coarser(cube: Cube, x: Design, finer: DataFrame) -> DataFrame:
    """A rollup from a finer one of the same fact and dimension: what is additive adds up."""
    d = cube.model.dimension(x.dimension)
    keys = [_level(d.id, level.name) for level in d.levels[: x.level + 1]] + [_leaf(k) for k in x.leaves]
    return finer.groupBy(*keys).agg(*[F.sum(f"`{m}`").alias(m) for m in x.measures])


def fingerprint(cube: Cube, x: Design) -> str:
    """Changes with the design, the measures' expressions and the fact's schema."""
    return json.dumps([VERSION, x.name, x.level, x.leaves, [(m, cube.model.measure(m).sql) for m in x.measures], cube.schema(cube.model.fact(x.fact).table).simpleString()])


def build(cube: Cube, path: str, *, stamp: str = "", refresh: bool = False, validate_totals: bool = True) -> list[Rollup]:
    """Writes the rollups below ``path`` where their stamp is missing or differs, checks their totals, and routes queries to them from now on.

    ``stamp`` stands for the state of the data (a version or load time); it is kept beside each rollup.
    """
    found = []
    finer: dict[tuple[str, str], DataFrame] = {}
    for x in reversed(design(cube.model)):  # the fact is read once for each dimension, at its finest level
        where = f"{path.rstrip('/')}/{x.name}"
        want = stamp + fingerprint(cube, x)
        fs, mark = _mark(cube, where, want)
        if refresh or not fs.exists(mark):
            below = finer.get((x.fact, x.dimension))
            (_build(cube, x) if below is None else _coarser(cube, x, below)).write.mode("overwrite").parquet(where)
            fs.delete(mark.getParent(), True)
            fs.create(mark, True).close()
        found.insert(0, Rollup(x, cube.spark.read.parquet(where)))
        finer[x.fact, x.dimension] = found[0].data
    if validate_totals:
        validate(cube, found)
    cube.rollups = found
    return found


def _mark(cube: Cube, where: str, stamp: str) -> tuple[Any, Any]:
    """The file system of a rollup, and the empty file beside it whose name stands for its stamp."""
    jvm = cube.spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{where}_stamp/{hashlib.sha256(stamp.encode()).hexdigest()}")
    return mark.getFileSystem(cube.spark.sparkContext._jsc.hadoopConfiguration()), mark


def validate(cube: Cube, found: list[Rollup], tolerance: float = 1e-6) -> None:
    """Every rollup must add up to the rows of its fact that join its dimension."""
    wanted: dict[tuple[str, str], Any] = {}
    for r in found:
        model = cube.model
        fact, d = model.fact(r.design.fact), model.dimension(r.design.dimension)
        texts = {m: single_aggregate(to_spark(model.measure(m).sql)) for m in r.design.measures}
        if (fact.id, d.id) not in wanted:
            joined = cube._star(fact, CubeQuery("group", groups=(Group(d.id, r.design.level, True),)), [], Grant("administrator"), [])
            wanted[fact.id, d.id] = joined.agg(*[F.expr(t.text()).cast("double").alias(m) for m, t in texts.items()]).first()
        want = wanted[fact.id, d.id]
        have = r.data.agg(*[F.expr(t.merge(f"`{m}`")).cast("double").alias(m) for m, t in texts.items()]).first()
        for m in texts:
            a, b = want[m] or 0.0, have[m] or 0.0
            if abs(a - b) > tolerance * max(1.0, abs(a)):
                raise RollupError(f"{r.design.name}: {m} is {b}, its fact has {a}")


def covers(cube: Cube, x: Design, fact: Fact, measures: list[Measure], q: CubeQuery, filters: tuple[Filter, ...]) -> bool:
    if x.fact != fact.id or q.collapse or any(m.id not in x.measures for m in measures):
        return False
    for g in q.groups:
        if g.dimension == x.dimension:
            if g.level > x.level:
                return False
        elif g.dimension not in x.leaves:
            return False
    for f in filters:
        if f.dimension == x.dimension:
            if f.level is None or f.level > x.level:
                return False
        elif f.dimension not in x.leaves:
            return False
    return True


def choose(cube: Cube, fact: Fact, measures: list[Measure], q: CubeQuery, filters: tuple[Filter, ...], g: Grant) -> Rollup | None:
    """The coarsest rollup that answers a query for this user.

    A rollup holds the fact's rows that join its dimension; a query that does not use the
    dimension is answered by it only where that join loses none (checked once per rollup).
    """
    tables = [fact.table, *[r.table for d in cube.model.dimensions if (r := cube.model.relationship(d, fact))]]
    if any(g.table(t).kind != "full" for t in tables):
        return None
    for r in cube.rollups:
        if covers(cube, r.design, fact, measures, q, filters):
            uses = any(x.dimension == r.design.dimension for x in (*q.groups, *filters))
            if uses or _lossless(cube, r.design):
                return r
    return None


def _lossless(cube: Cube, x: Design) -> bool:
    known = cube.__dict__.setdefault("_lossless", {})
    key = (x.fact, x.dimension)
    if key not in known:
        fact, d = cube.model.fact(x.fact), cube.model.dimension(x.dimension)
        rel = cube.model.relationship(d, fact)
        keys = cube.table(rel.table).select(F.col(f"`{rel.column}`").alias("__key"))
        orphans = cube.table(fact.table).join(keys, F.col(f"`{rel.fact_column}`") == F.col("__key"), "left_anti").limit(1).count()
        twice = keys.groupBy("__key").count().where("count > 1").limit(1).count()
        known[key] = orphans == 0 and twice == 0
    return known[key]
