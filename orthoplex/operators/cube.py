"""Resolved cube queries as lazy DataFrames.

One pass over a fact answers all of its measures: dimensions that are grouped,
filtered or secured are joined once (inner, by their key), those that only restrict
become left semi joins, time flags become FILTER clauses.  A dimension's
side is broadcast where its measured size allows (one small job per dimension table
and cube: Catalyst's own estimate of a flattened dimension is the product of its
inputs, which would shuffle the fact instead); beyond that Spark joins by shuffle and
adaptive execution splits what is skewed.  Calendars are bounded by ``MAX_DAYS``.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoplex.functions.sqltext import single_aggregate, to_spark
from orthoplex.operators import rollup as rollups
from orthoplex.plans.model import Dimension, Fact, Measure, Model, ModelError, Relationship, User
from orthoplex.plans.query import Cell, CubeQuery, Filter, Group, SetOp
from orthoplex.plans.resolve import resolve
from orthoplex.plans.security import NONE, Access, Grant, grant

ALL = "All"
MAX_DRILLTHROUGH = 1000
#: Bytes of a dimension table up to which its side of a join is broadcast.
BROADCAST_BYTES = 64 << 20


def alias_of(dimension: Dimension) -> str:
    """The name under which row filters see a joined dimension."""
    return "_" + dimension.id.lower().replace(" ", "_")


class Cube:
    """A model over tables."""

    def __init__(self, spark: SparkSession, model: Model, tables: Mapping[str, DataFrame], *, calendars: frozenset[str] = frozenset(), prefix_levels: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> None:
        self.spark, self.model, self.tables = spark, model, dict(tables)
        self.broadcast_bytes, self._sizes = broadcast_bytes, {}
        self.calendars, self.prefix_levels = calendars, prefix_levels
        self.rollups: list[rollups.Rollup] = []
        self._schemas: dict[str, T.StructType] = {}

    # ---- entry points

    def query(self, text: str, user: User | None = None, *, ordered: bool = True) -> DataFrame:
        return self.dataframe(resolve(text, self.model, self.prefix_levels), user, ordered=ordered)

    def dataframe(self, q: CubeQuery, user: User | None = None, *, ordered: bool = True) -> DataFrame:
        """The rows a query asks for: label columns named by dimension (or level), then a column per measure."""
        g = grant(self.model, user)
        if q.kind == "empty":
            return self._empty([], [])
        if q.kind == "tuples":
            out = self._cells(q.cells, g)
            return out.orderBy("ord") if ordered else out
        if q.kind == "probe":
            return self._probe(q)
        if q.kind == "count":
            return self._count(q, g)
        if q.kind == "members":
            return self._named_members(q, g)
        if q.kind == "drillthrough":
            return self.drillthrough(q, user)
        measures = [self.model.measure(m) for m in q.measures]
        extra = [self.model.measure(s.measure) for s in q.set_ops if s.measure and s.measure not in q.measures]
        out = self._measures(q, measures + [m for k, m in enumerate(extra) if m not in extra[:k]], g)
        labels = self.labels(q.groups)
        default = measures[0].id
        limited = False
        for op in q.set_ops:
            out = apply_set_op(out, op, op.measure or default, labels)
            limited |= op.kind in ("top", "bottom", "order", "head")
        out = out.select(*[F.col(f"`{c}`") for c in [*labels, *[m.id for m in measures]]])
        if ordered and labels and not limited:
            out = out.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in labels])
        return out

    # ---- names

    def labels(self, groups: tuple[Group, ...]) -> list[str]:
        out: list[str] = []
        for g in groups:
            d = self.model.dimension(g.dimension)
            out += [level.name for level in d.chain[: g.level + 1]] if g.prefix else [d.chain[g.level].name if d.levels else d.id]
        return out if len(set(out)) == len(out) else [f"{g.dimension} {c}" if out.count(c) > 1 else c for g, c in self._owned(groups)]

    def _owned(self, groups: tuple[Group, ...]) -> list[tuple[Group, str]]:
        out = []
        for g in groups:
            d = self.model.dimension(g.dimension)
            names = [level.name for level in d.chain[: g.level + 1]] if g.prefix else [d.chain[g.level].name if d.levels else d.id]
            out += [(g, n) for n in names]
        return out

    def schema(self, table: str) -> T.StructType:
        if table not in self._schemas:
            self._schemas[table] = self.table(table).schema
        return self._schemas[table]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ModelError(f"no table {name!r}")
        return self.tables[name]

    # ---- security

    def _blocked(self, g: Grant, tables: set[str]) -> bool:
        return g.permission == NONE or any(g.table(t).kind == "hidden" for t in tables)

    # ---- aggregation

    def _measures(self, q: CubeQuery, measures: list[Measure], g: Grant) -> DataFrame:
        """All measures of a query, a sub-plan per fact, merged by label with 0.0 for what is missing."""
        by_fact: dict[str, list[Measure]] = {}
        for m in measures:
            by_fact.setdefault(self.model.fact_of(m).id, []).append(m)
        labels = self.labels(q.groups)
        frames = [self._of_fact(self.model.fact(f), ms, q, g) for f, ms in by_fact.items()]
        out = frames[0]
        for other in frames[1:]:
            out = out.crossJoin(other) if not labels else out.join(other, labels, "full")  # without labels both have one row
        return out.select(*[F.col(f"`{c}`") for c in labels], *[F.coalesce(F.col(f"`{m.id}`"), F.lit(0.0)).alias(m.id) for m in measures])

    def _of_fact(self, fact: Fact, measures: list[Measure], q: CubeQuery, g: Grant) -> DataFrame:
        fallback = [m for m in measures if m.fallback is not None]
        if fallback:
            return self._with_fallback(fact, measures, fallback, q, g)
        filters = [f for f in q.filters if self.model.compatible(self.model.dimension(f.dimension), measures[0])]
        used = {fact.table}
        for d in {*[x.dimension for x in (*q.groups, *filters)], *[d for m in measures for d in m.requires]}:
            rel = self.model.relationship(self.model.dimension(d), fact)
            used.add(rel.table if rel else self.model.dimension(d).table or fact.table)
        labels = self.labels(q.groups)
        if self._blocked(g, used):
            return self._empty(labels, [m.id for m in measures])
        found = rollups.choose(self, fact, measures, q, tuple(filters), g) if self.rollups else None
        if found is not None:
            return found.answer(self, measures, q, tuple(filters))
        plain = [m for m in measures if m.time is None]
        timed = [m for m in measures if m.time is not None]
        odd = [m for m in timed if single_aggregate(to_spark(m.sql)) is None]
        required = tuple(dict.fromkeys(d for m in measures for d in m.requires))
        joined = self._star(fact, q, filters, g, [m for m in timed if m not in odd], required)
        if not plain and timed and len(timed) > len(odd):
            any_flag = reduce(lambda a, b: a | b, [F.expr(f) for f in {self._flag(m) for m in timed if m not in odd}])
            joined = joined.where(any_flag)
        keys = self._keys(fact, q)
        aggregates = []
        for m in [*plain, *[m for m in timed if m not in odd]]:
            text = to_spark(m.sql)
            if m.time is not None:
                text = single_aggregate(text).text(self._flag(m))
            aggregates.append(F.coalesce(F.expr(text).cast("double"), F.lit(0.0)).alias(m.id))
        frames = []
        if aggregates:
            frames.append(self._aggregate(joined, keys, labels, aggregates))
        for m in odd:  # no single call to put the condition into: a plan of its own
            date = self.model.date_dimension_of(m)
            rel = self._date_relationship(m, fact)
            own = self._star(fact, q, filters, g, [], required)
            days = self.table(date.table).where(F.col(m.time.flag)).select(F.col(date.key).alias("__day")).distinct()
            own = own.join(F.broadcast(days), F.col(f"f.{rel.fact_column if rel else date.key}") == F.col("__day"), "left_semi")
            frames.append(self._aggregate(own, keys, labels, [F.coalesce(F.expr(to_spark(m.sql)).cast("double"), F.lit(0.0)).alias(m.id)]))
        out = frames[0]
        for other in frames[1:]:
            out = out.crossJoin(other) if not labels else out.join(other, labels, "full")
        return out

    def _aggregate(self, joined: DataFrame, keys: list[Column], labels: list[str], aggregates: list[Column]) -> DataFrame:
        if not keys:
            return joined.agg(*aggregates)
        out = joined.groupBy(*keys).agg(*aggregates)
        return out.dropna(subset=labels) if labels else out

    def _keys(self, fact: Fact, q: CubeQuery) -> list[Column]:
        """Label columns; a collapsed member's partner dimension reads All."""
        out, labels = [], iter(self.labels(q.groups))
        for g in q.groups:
            d = self.model.dimension(g.dimension)
            levels = range(g.level + 1) if g.prefix else [g.level]
            for k in levels:
                label = self._column(d, fact, d.chain[k].column if d.levels else d.column).cast("string")
                for c in q.collapse:
                    if c.dimension != d.id and any(x.dimension == c.dimension for x in q.groups):
                        other = self.model.dimension(c.dimension)
                        level = next(x.level for x in q.groups if x.dimension == c.dimension)
                        member = self._column(other, fact, other.chain[level].column if other.levels else other.column).cast("string")
                        label = F.when(member.isin(list(c.members)), F.lit(ALL)).otherwise(label)
                out.append(label.alias(next(labels)))
        return out

    def _column(self, d: Dimension, fact: Fact, column: str) -> Column:
        rel = self.model.relationship(d, fact)
        return F.col(f"{alias_of(d)}.`{column}`") if rel else F.col(f"f.`{column}`")

    # ---- joins and filters

    def _star(self, fact: Fact, q: CubeQuery, filters: list[Filter], g: Grant, timed: list[Measure], required: tuple[str, ...] = ()) -> DataFrame:
        out = self.table(fact.table).alias("f")
        grouped = {x.dimension for x in q.groups} | set(required)
        secured = {d.id for d in self.model.dimensions if (r := self.model.relationship(d, fact)) and g.table(r.table).kind == "filtered"}
        filtered: dict[str, list[Filter]] = {}
        for f in filters:
            filtered.setdefault(f.dimension, []).append(f)
        for name in dict.fromkeys([*grouped, *[d.id for d in self.model.dimensions if d.id in secured], *filtered]):
            d = self.model.dimension(name)
            rel = self.model.relationship(d, fact)
            if rel is None:
                if d.table and d.table != fact.table:
                    raise ModelError(f"dimension {d.id!r} has no relationship to {fact.table!r}")
                for f in filtered.get(name, []):
                    out = out.where(self._holds(d, f, fact.table, "f"))
                continue
            dim = self.table(rel.table)
            if name in filtered and rel.table in self.calendars:
                out = out.where(self._key_range(d, rel, filtered[name]))
            if name in grouped or name in secured:
                side = dim if name in secured or name in required else dim.select(*self._needed(d, rel, filtered.get(name, []), timed, fact))
                out = out.join(self._small(side, rel.table).alias(alias_of(d)), F.col(f"f.`{rel.fact_column}`") == F.col(f"{alias_of(d)}.`{rel.column}`"))
                for f in filtered.get(name, []):
                    out = out.where(self._holds(d, f, rel.table, alias_of(d)))
            else:
                side = dim
                for f in filtered[name]:
                    side = side.where(self._holds(d, f, rel.table, None))
                side = self._small(side.select(F.col(f"`{rel.column}`").alias("__key")), rel.table)
                out = out.join(side, F.col(f"f.`{rel.fact_column}`") == F.col("__key"), "left_semi")
        present = {alias_of(self.model.dimension(n)) for n in grouped | secured}
        for m in timed:
            alias = self._flag_alias(m)
            if alias not in present:
                date, rel = self.model.date_dimension_of(m), self._date_relationship(m, fact)
                flags = {x.time.flag for x in timed if self._flag_alias(x) == alias}
                days = self.table(date.table).select(F.col(f"`{date.key}`"), *sorted(flags)).alias(alias)
                out = out.join(self._small(days, date.table), F.col(f"f.`{rel.fact_column if rel else date.key}`") == F.col(f"{alias}.`{date.key}`"), "left")
                present.add(alias)
        for access, _ in self._predicates(fact, g):
            out = out.where(F.expr(to_spark(access.predicate)))
        return out

    def _predicates(self, fact: Fact, g: Grant) -> list[tuple[Access, str]]:
        tables = [fact.table, *[r.table for d in self.model.dimensions if (r := self.model.relationship(d, fact))]]
        out = []
        for t in dict.fromkeys(tables):
            access = g.table(t)
            if access.kind == "filtered":
                out.append((access, t))
        return out

    def _small(self, side: DataFrame, table: str) -> DataFrame:
        return F.broadcast(side) if table in self.calendars or self._bytes(table, side.columns) <= self.broadcast_bytes else side

    def _bytes(self, table: str, columns: list[str]) -> int:
        """About how much those columns of a dimension table take in memory, from its rows (filters aside, so at most that)."""
        own = tuple(f.name for f in self.schema(table) if f.name in columns and isinstance(f.dataType, (T.StringType, T.BinaryType)))
        if (table, own, len(columns)) not in self._sizes:
            variable = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in own]
            row = reduce(lambda a, b: a + b, variable, F.lit(32 + 8 * len(columns)).cast("long"))
            self._sizes[table, own, len(columns)] = self.table(table).agg(F.sum(row)).first()[0] or 0
        return self._sizes[table, own, len(columns)]

    def _key_range(self, d: Dimension, rel: Relationship, filters: list[Filter]) -> Column:
        """The fact's keys lie between the first and the last day that the filters allow: a predicate that the scan can use.

        Calendars are bounded, so asking for the two days costs next to nothing.
        """
        days = self.table(rel.table)
        for f in filters:
            days = days.where(self._holds(d, f, rel.table, None))
        key = F.col(f"`{rel.column}`")
        lo, hi = days.agg(F.min(key), F.max(key)).first()
        return F.col(f"f.`{rel.fact_column}`").between(F.lit(lo), F.lit(hi)) if lo is not None else F.lit(False)

    def _needed(self, d: Dimension, rel: Relationship, filters: list[Filter], timed: list[Measure], fact: Fact) -> list[Column]:
        names = [rel.column, *[level.column for level in d.chain], d.column]
        for m in timed:
            if self.model.date_dimension_of(m).dimension == d.id:
                names.append(m.time.flag)
        have = set(self.schema(rel.table).names)
        return [F.col(f"`{c}`") for c in dict.fromkeys(names) if c in have]

    def _date_relationship(self, m: Measure, fact: Fact) -> Relationship | None:
        date = self.model.date_dimension_of(m)
        role = self.model.find_dimension(date.dimension) if date.dimension else None
        return self.model.relationship(role, fact) if role else None

    def _flag_alias(self, m: Measure) -> str:
        date = self.model.date_dimension_of(m)
        role = self.model.find_dimension(date.dimension) if date.dimension else None
        return alias_of(role) if role else "_calendar"

    def _flag(self, m: Measure) -> str:
        return f"{self._flag_alias(m)}.`{m.time.flag}`"

    def _holds(self, d: Dimension, f: Filter, table: str, alias: str | None) -> Column:
        """Whether a row belongs to one of the members: levels of a path are AND-ed, members OR-ed."""
        prefix = f"{alias}." if alias else ""

        def level_is(column: str, keys: list[str]) -> Column:
            return equals(F.col(f"{prefix}`{column}`"), self.schema(table)[column].dataType, keys)

        if f.level is None or not d.levels:
            column = d.column if f.level is None or not d.levels else d.chain[f.level].column
            out = level_is(column, [k[-1] for k in f.keys])
        else:
            singles = [k[0] for k in f.keys if len(k) == 1]
            tests = [level_is(d.chain[f.level].column, singles)] if singles else []
            for path in (k for k in f.keys if len(k) > 1):
                chain = d.chain[f.level - len(path) + 1 : f.level + 1]
                tests.append(reduce(lambda a, b: a & b, [level_is(level.column, [k]) for level, k in zip(chain, path, strict=True)]))
            out = reduce(lambda a, b: a | b, tests)
        return ~out if f.exclude else out

    # ---- other kinds

    def _cell(self, cell: Cell, ordinal: int, g: Grant) -> DataFrame:
        m = self.model.measure(cell.measure)
        one = self._measures(CubeQuery("total", (m.id,), filters=cell.filters), [m], g)
        return one.select(F.lit(ordinal).cast("long").alias("ord"), F.lit(m.id).alias("measure"), F.col(f"`{m.id}`").alias("value"))

    def _cells(self, cells: tuple[Cell, ...], g: Grant) -> DataFrame:
        """(ord, measure, value) of each cell: one scan of a fact for all of its cells that single aggregates answer."""
        together: dict[str, list[int]] = {}
        parts = []
        for k, cell in enumerate(cells):
            m = self.model.measure(cell.measure)
            fact = self.model.fact_of(m)
            plain = m.time is None and m.fallback is None and not m.requires and single_aggregate(to_spark(m.sql)) is not None
            if plain and not self.rollups and not self._predicates(fact, g) and not self._blocked(g, self._used(fact, self._own(cell.filters, m))):
                together.setdefault(fact.id, []).append(k)
            else:
                parts.append(self._cell(cell, k, g))
        for fact_id, places in together.items():
            parts.append(self._one_scan(self.model.fact(fact_id), places, cells) if len(places) > 1 else self._cell(cells[places[0]], places[0], g))
        return reduce(DataFrame.unionByName, parts)

    def _own(self, filters: tuple[Filter, ...], m: Measure) -> list[Filter]:
        return [f for f in filters if self.model.compatible(self.model.dimension(f.dimension), m)]

    def _used(self, fact: Fact, filters: list[Filter]) -> set[str]:
        """The tables that a query with these filters touches."""
        out = {fact.table}
        for f in filters:
            d = self.model.dimension(f.dimension)
            rel = self.model.relationship(d, fact)
            out.add(rel.table if rel else d.table or fact.table)
        return out

    def _one_scan(self, fact: Fact, places: list[int], cells: tuple[Cell, ...]) -> DataFrame:
        out, joined = self.table(fact.table).alias("f"), set()
        tests, shown = [], []
        for k in places:
            m = self.model.measure(cells[k].measure)
            test = F.lit(True)
            for f in self._own(cells[k].filters, m):
                d = self.model.dimension(f.dimension)
                rel = self.model.relationship(d, fact)
                if rel is not None and d.id not in joined:
                    joined.add(d.id)
                    side = self.table(rel.table).select(*self._needed(d, rel, [], [], fact)).dropDuplicates([rel.column])
                    out = out.join(self._small(side, rel.table).alias(alias_of(d)), F.col(f"f.`{rel.fact_column}`") == F.col(f"{alias_of(d)}.`{rel.column}`"), "left")
                test = test & self._holds(d, f, rel.table if rel else fact.table, alias_of(d) if rel else "f")
            tests.append((k, m, test))
        any_of = reduce(lambda a, b: a | b, [t for *_, t in tests])
        out = out.where(any_of).select("*", *[t.alias(f"__cell{k}") for k, _, t in tests])
        for k, m, _ in tests:
            shown.append(F.coalesce(F.expr(single_aggregate(to_spark(m.sql)).text(f"__cell{k}")).cast("double"), F.lit(0.0)).alias(f"v{k}"))
        rows = F.array(*[F.struct(F.lit(k).cast("long").alias("ord"), F.lit(m.id).alias("measure"), F.col(f"v{k}").alias("value")) for k, m, _ in tests])
        return out.agg(*shown).select(F.inline(rows))

    def _probe(self, q: CubeQuery) -> DataFrame:
        """(ord, member, value): the unique name, caption or level of members that a client asks for by name."""
        return self.spark.createDataFrame([(k, name, self.probe_value(target, what)) for k, (name, target, what) in enumerate(q.probes)], "ord long, member string, value string")

    def probe_value(self, target: str, what: str) -> str:
        parts = [x.strip("[]") for x in target.split("].[")] if "&" not in target else [target.split("]")[0].strip("[")]
        if parts[0].lower() == "measures":
            m = self.model.measure(parts[-1].strip("[]"))
            known = {"uniquename": f"[Measures].[{m.caption}]", "caption": m.display, "level.uniquename": "[Measures].[MeasuresLevel]"}
        else:
            d = self.model.dimension(parts[0])
            caption = target.rsplit("&[", 1)[-1].rstrip("]") if "&[" in target else parts[-1]
            known = {"uniquename": target, "caption": caption, "level.uniquename": f"[{d.caption}].[{d.hierarchy}]"}
        return known.get(what.lower(), "")

    def _count(self, q: CubeQuery, g: Grant) -> DataFrame:
        """Number of different members of a level that occur in the fact; nulls don't count."""
        group = q.groups[0]
        d = self.model.dimension(group.dimension)
        fact = self.model.fact(d.fact)
        rel = self.model.relationship(d, fact)
        if self._blocked(g, {fact.table, *([rel.table] if rel else [])}):
            return self._empty([], []).select(F.lit(0).cast("long").alias("members"))
        joined = self._star(fact, q, list(q.filters), g, [])
        column = self._column(d, fact, d.chain[group.level].column if d.levels else d.column)
        return joined.agg(F.countDistinct(column).alias("members"))

    def _named_members(self, q: CubeQuery, g: Grant) -> DataFrame:
        """The members that are named, as far as they exist and may be seen."""
        from orthoplex.operators.members import members

        parts = []
        for group in q.groups:
            d = self.model.dimension(group.dimension)
            own = [f for f in q.filters if f.dimension == group.dimension]
            for f in own:
                found = members(self, group.dimension, level=group.level if f.level is None or not d.levels else f.level, grant_=g, parent=f)
                parts.append(found.select("dimension", "level", "member", "parent"))
        return reduce(DataFrame.unionByName, parts)

    def drillthrough(self, q: CubeQuery | str, user: User | None = None, *, limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
        """Source rows of the measure's fact that belong to the given members, at most 1000 unless told otherwise."""
        if isinstance(q, str):
            q = resolve(q, self.model, self.prefix_levels)
        g = grant(self.model, user)
        measure = self.model.measure(q.measures[0]) if q.measures else self.model.default_measure()
        fact = self.model.fact_of(measure)
        filters = [f for f in q.filters if self.model.compatible(self.model.dimension(f.dimension), measure)]
        if self._blocked(g, self._used(fact, filters)):
            return self.table(fact.table).limit(0)
        out = self._star(fact, CubeQuery("drillthrough"), filters, g, []).select("f.*")
        sortable = [f.name for f in self.schema(fact.table) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        order = [*(order_by or []), *[F.col(f"`{c}`") for c in sortable if c not in (order_by or [])]]  # all columns: rows at the limit are the same in every run
        return out.orderBy(*order).limit(limit or q.max_rows or MAX_DRILLTHROUGH)

    def _with_fallback(self, fact: Fact, measures: list[Measure], fallback: list[Measure], q: CubeQuery, g: Grant) -> DataFrame:
        """Measures given as a whole SQL statement, which reads what it likes and knows no filters.

        So it is refused under filters, where its declared capability does not cover the
        query, and to users from whom any table of the cube is hidden or filtered.
        """
        labels = self.labels(q.groups)
        used = self._used(fact, [Filter(x.dimension, None, ()) for x in q.groups])
        if self._blocked(g, used):
            return self._empty(labels, [m.id for m in measures])
        known = {*self.tables, *[f.table for f in self.model.facts], *[r.table for r in self.model.relationships]}
        if any(g.table(t).kind != "full" for t in known):
            raise ModelError("measures from SQL statements do not honour access rules; refused")
        plain = [m for m in measures if m not in fallback]
        frames = [self._of_fact(fact, plain, q, g)] if plain else []
        for m in fallback:
            if not m.fallback_sql or m.fallback == "Stub":
                raise ModelError(f"measure {m.caption!r} has no statement yet")
            if m.fallback == "ScalarOnly" and labels:
                raise ModelError(f"measure {m.caption!r} answers totals only")
            if [f for f in q.filters if self.model.compatible(self.model.dimension(f.dimension), m)]:
                raise ModelError(f"measure {m.caption!r} is a statement that knows no filters")
            found = self._statement(to_spark(m.fallback_sql))
            names = found.columns
            frames.append(found.select(*[F.col(f"`{names[k]}`").cast("string").alias(c) for k, c in enumerate(labels)], F.col(f"`{names[len(labels)]}`").cast("double").alias(m.id)))
        out = frames[0]
        for other in frames[1:]:
            out = out.crossJoin(other) if not labels else out.join(other, labels, "full")
        return out

    def _statement(self, text: str) -> DataFrame:
        """A statement over this cube's tables; they are named within it alone, so that two cubes of a session stay apart."""
        body = text.strip().rstrip(";")
        named = [t for t in self.tables if re.search(rf"(?<![\w.]){re.escape(t)}(?!\w)", body, re.I)]
        if not named:
            return self.spark.sql(body)
        heads = ", ".join(f"`{t}` AS (SELECT * FROM {{t{k}}})" for k, t in enumerate(named))
        own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
        rest = body[own.end() :] if own else body
        escaped = rest.replace("{", "{{").replace("}", "}}")
        start = f"WITH {'RECURSIVE ' if own and own.group(1) else ''}{heads}"
        return self.spark.sql(f"{start}, {escaped}" if own else f"{start} {escaped}", **{f"t{k}": self.tables[t] for k, t in enumerate(named)})

    def totals(self, dimension: str, level: int, measures: list[str], filters: tuple[Filter, ...] = (), user: User | None = None) -> DataFrame:
        """Members down to a level with the totals of their ancestors, each from the source rows: level columns, lvl (levels summed away) and measures."""
        g = grant(self.model, user)
        found = [self.model.measure(m) for m in measures]
        fact = self.model.fact_of(found[0])
        d = self.model.dimension(dimension)
        q = CubeQuery("group", tuple(m.id for m in found), (Group(d.id, level, level > 0),), filters)
        labels = self.labels(q.groups)
        rel = self.model.relationship(d, fact)
        if self._blocked(g, {fact.table, *([rel.table] if rel else [])}):
            return self._empty(labels, [m.id for m in found]).withColumn("lvl", F.lit(0).cast("long"))
        joined = self._star(fact, q, list(filters), g, [], tuple(dict.fromkeys(x for m in found for x in m.requires)))
        aggregates = [F.coalesce(F.expr(to_spark(m.sql)).cast("double"), F.lit(0.0)).alias(m.id) for m in found]
        keyed = joined.select("*", *[k.alias(f"__{n}") for k, n in zip(self._keys(fact, q), labels, strict=True)])
        keyed = keyed.dropna(subset=[f"__{n}" for n in labels])
        summed = reduce(lambda a, b: a + b, [F.grouping(f"__{n}").cast("long") for n in labels])
        out = keyed.rollup(*[f"__{n}" for n in labels]).agg(summed.alias("lvl"), *aggregates)
        return out.select(*[F.col(f"__{n}").alias(n) for n in labels], "lvl", *[m.id for m in found])

    def _empty(self, labels: list[str], measures: list[str]) -> DataFrame:
        fields = [*[T.StructField(c, T.StringType()) for c in labels], *[T.StructField(m, T.DoubleType()) for m in measures]]
        return self.spark.createDataFrame([], T.StructType(fields))


def equals(column: Column, kind: T.DataType, keys: list[str]) -> Column:
    """Whether a column reads as one of the keys; compared in its own type where that loses nothing, so filters reach the scan."""
    if isinstance(kind, T.StringType):
        return column.isin(list(keys))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        exact = [int(k) for k in keys if k.lstrip("-").isdigit() and str(int(k)) == k]
        return column.isin(exact) if exact else F.lit(False)
    if isinstance(kind, T.DateType):
        days = []
        for k in keys:
            try:
                days.append(dt.date.fromisoformat(k))
            except ValueError:
                continue
        return column.isin(days) if days else F.lit(False)
    return column.cast("string").isin(list(keys))


def apply_set_op(df: DataFrame, op: SetOp, measure: str, labels: list[str]) -> DataFrame:
    """TopCount, BottomCount, TopPercent (of rows; of the total where op is "value"), Order and Filter over grouped rows; ties in label order."""
    value, ties = F.col(f"`{measure}`"), [F.col(f"`{c}`").asc() for c in labels]
    if op.kind == "top":
        return df.orderBy(value.desc(), *ties).limit(int(op.n))
    if op.kind == "head":
        return df.orderBy(*ties).limit(int(op.n)) if ties else df.limit(int(op.n))
    if op.kind == "bottom":
        return df.orderBy(value.asc(), *ties).limit(int(op.n))
    if op.kind == "order":
        return df.orderBy(value.desc() if op.descending else value.asc(), *ties)
    if op.kind == "percent":
        if op.op == "value":  # the fewest top members that reach the share of the total: a window over one axis, as many rows as a client shows
            order = Window.orderBy(value.desc(), *ties)
            before = F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            shares = df.select("*", before.alias("__before"), F.sum(value).over(Window.partitionBy()).alias("__total"))
            return shares.where(F.col("__before") < F.col("__total") * F.lit(float(op.n)) / 100).drop("__before", "__total")
        return df.orderBy(value.desc(), *ties).limit(math.ceil(df.count() * float(op.n) / 100))  # a count first, so that no task sorts the whole axis
    if op.kind == "filter":
        near = F.abs(value - F.lit(op.n)) < 1e-9
        tests = {">": value > op.n, ">=": value >= op.n, "<": value < op.n, "<=": value <= op.n, "=": near, "<>": ~near}
        return df.where(tests[op.op])
    raise ModelError(f"unknown set operation {op.kind!r}")
