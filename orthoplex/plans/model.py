"""Cube definitions: facts, dimensions, levels, measures, relationships, date roles and roles.

``load_model`` reads the JSON form (same keys and defaults as the documents that
spreadsheet front ends of this kind use) and checks it; every other module works
on the frozen classes here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any


class ModelError(ValueError):
    """A cube definition or a query that does not fit it."""


@dataclass(frozen=True)
class Fact:
    id: str
    table: str
    source: str = ""
    group: str = ""


@dataclass(frozen=True)
class Level:
    name: str
    column: str
    number: int
    cardinality: int = 0


@dataclass(frozen=True)
class Relationship:
    fact: str
    fact_column: str
    dimension: str
    table: str
    column: str


@dataclass(frozen=True)
class Dimension:
    id: str
    column: str
    caption: str = ""
    hierarchy: str = ""
    all_level: str = "(All)"
    leaf_level: str = ""
    ordinal: int = 0
    visible: bool = True
    has_all: bool = True
    cardinality: int = 0
    description: str = ""
    fact: str | None = None
    shared: bool = False
    date_role: bool = False
    levels: tuple[Level, ...] = ()
    table: str | None = None  # of a "table.column" field

    def level(self, name: str) -> Level | None:
        for level in self.levels:
            if level.name.lower() == name.lower():
                return level
        return None

    @property
    def chain(self) -> tuple[Level, ...]:
        """The levels in order; a flat dimension has its leaf alone."""
        return self.levels or (Level(self.leaf_level or self.caption or self.id, self.column, 0, self.cardinality),)


@dataclass(frozen=True)
class TimeFlag:
    dimension: str
    flag: str


@dataclass(frozen=True)
class Measure:
    id: str
    sql: str
    caption: str = ""
    display: str = ""
    description: str = ""
    format: str = ""
    units: str = ""
    ordinal: int = 0
    visible: bool = True
    fact: str | None = None
    aggregator: int = 1
    group: str = ""
    precision: int = 18
    scale: int = 2
    expression: str = ""
    time: TimeFlag | None = None
    fallback_sql: str | None = None
    fallback: str | None = None  # ScalarOnly, Universal or Stub
    requires: tuple[str, ...] = ()  # dimensions whose columns the expression uses


@dataclass(frozen=True)
class DateDimension:
    dimension: str = ""
    table: str = "date_dim"
    key: str = "date_key"
    full_date: str = "full_date"
    year: str = "year"
    quarter: str = "quarter"
    month: str = "month"
    ytd: str = "ytd_flag"
    prior_year_ytd: str = "prior_year_ytd_flag"
    current_year: str = "current_year_flag"
    qtd: str = "qtd_flag"
    mtd: str = "mtd_flag"

    @property
    def flags(self) -> tuple[str, ...]:
        return self.ytd, self.prior_year_ytd, self.current_year, self.qtd, self.mtd


@dataclass(frozen=True)
class TablePermission:
    table: str
    filter: str = ""
    metadata: str = "read"


@dataclass(frozen=True)
class Role:
    name: str
    permission: str = "read"
    members: tuple[str, ...] = ()
    tables: tuple[TablePermission, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Model:
    catalog: str
    cube: str
    facts: tuple[Fact, ...]
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]
    relationships: tuple[Relationship, ...] = ()
    roles: tuple[Role, ...] = ()
    date_dimension: DateDimension | None = None
    auth: dict[str, Any] | None = None
    db_path: str | None = None
    warnings: tuple[str, ...] = ()

    # ---- lookups

    def fact(self, fact_id: str | None) -> Fact:
        """By id or table; None is the first."""
        if fact_id is None:
            return self.facts[0]
        for f in self.facts:
            if fact_id in (f.id, f.table):
                return f
        raise ModelError(f"unknown fact table {fact_id!r}")

    def fact_of(self, measure: Measure) -> Fact:
        return self.fact(measure.fact)

    def find_measure(self, name: str) -> Measure | None:
        """By id, caption or display name, brackets aside."""
        key = name.strip().strip("[]").lower()
        for by in ("id", "caption", "display"):
            for m in self.measures:
                if getattr(m, by).lower() == key:
                    return m
        return None

    def find_dimension(self, name: str) -> Dimension | None:
        """By caption, id or hierarchy, brackets aside; of a unique name the first part counts."""
        key = name.strip()
        key = key[1:].split("]")[0] if key.startswith("[") else key
        key = key.lower()
        for by in ("caption", "id", "hierarchy"):
            for d in self.dimensions:
                if getattr(d, by).lower() == key:
                    return d
        return None

    def measure(self, name: str) -> Measure:
        if found := self.find_measure(name):
            return found
        raise ModelError(f"unknown measure {name!r}")

    def dimension(self, name: str) -> Dimension:
        if found := self.find_dimension(name):
            return found
        raise ModelError(f"unknown dimension {name!r}")

    def relationship(self, dimension: Dimension, fact: Fact) -> Relationship | None:
        """The first relationship of a dimension to this fact; one that names no known fact holds for all."""
        for r in self.relationships:
            if r.dimension == dimension.id and r.fact in (fact.id, fact.table):
                return r
        known = {x for f in self.facts for x in (f.id, f.table)}
        for r in self.relationships:
            if r.dimension == dimension.id and (len(self.facts) == 1 or r.fact not in known):
                return r
        return None

    def compatible(self, dimension: Dimension, measure: Measure) -> bool:
        """Whether the dimension means something to the measure's fact; a filter on one that doesn't is ignored."""
        fact = self.fact_of(measure)
        if any(r.dimension == dimension.id for r in self.relationships):
            if self.relationship(dimension, fact):
                return True
            return False
        if dimension.shared or dimension.date_role or dimension.fact is None:
            return True
        return self.fact(dimension.fact).table == fact.table

    def date_dimension_of(self, measure: Measure) -> DateDimension:
        """The calendar of a measure's time flag: that of its date role, with the global column names."""
        base = self.date_dimension or DateDimension()
        role = self.find_dimension(measure.time.dimension) if measure.time else None
        if role is None:
            return base
        rel = self.relationship(role, self.fact_of(measure))
        return replace(base, dimension=role.id, **({"table": rel.table, "key": rel.column} if rel else {}))

    def default_measure(self, fact: Fact | None = None) -> Measure:
        for m in sorted(self.measures, key=lambda m: m.ordinal):
            if m.visible and (fact is None or self.fact_of(m).table == fact.table):
                return m
        raise ModelError("no visible measure")

    def default_dimension(self) -> Dimension:
        found = [d for d in self.dimensions if d.visible]
        if not found:
            raise ModelError("no visible dimension")
        return min(found, key=lambda d: d.ordinal)

    def table_of(self, dimension: Dimension) -> str:
        """Where the members of a dimension are: its own table, that of its relationship, or a fact."""
        if dimension.table:
            return dimension.table
        for r in self.relationships:
            if r.dimension == dimension.id:
                return r.table
        return self.fact(dimension.fact).table


def _measure(raw: dict[str, Any], base: Path | None) -> Measure:
    time = raw.get("time_intelligence")
    sql_file = raw.get("sql_fallback_file")
    sql = None
    if sql_file and base and (base / sql_file).is_file():
        sql = (base / sql_file).read_text(encoding="utf-8")
    elif raw.get("fallback_sql"):
        sql = raw["fallback_sql"]
    capability = raw.get("fallback_capability")
    return Measure(
        id=raw["id"],
        sql=raw["sql_expr"],
        caption=raw["caption"],
        display=raw.get("display_name", raw["caption"]),
        description=raw.get("description", ""),
        format=raw.get("format_string", ""),
        units=raw.get("units", ""),
        ordinal=raw.get("ordinal", 0),
        visible=raw.get("visible", True),
        fact=raw.get("fact_table"),
        aggregator=raw.get("aggregator", 1),
        group=raw.get("measure_group_name", ""),
        precision=raw.get("numeric_precision", 18),
        scale=raw.get("numeric_scale", 2),
        expression=raw.get("expression", ""),
        time=TimeFlag(time["dimension_id"], time["flag_column"]) if time else None,
        fallback_sql=sql,
        requires=tuple(raw.get("requires", ())),
        fallback=(capability if capability in ("ScalarOnly", "Universal") else "Stub") if sql_file or capability or sql else None,
    )


def _dimension(raw: dict[str, Any]) -> Dimension:
    column, table = raw["physical_field"], None
    if "." in column:
        table, column = column.split(".", 1)
    levels = tuple(sorted((Level(x["name"], x["column"], x["level_number"], x.get("cardinality", 0)) for x in raw.get("hierarchy_levels", [])), key=lambda x: x.number))
    return Dimension(
        id=raw["id"],
        column=column,
        caption=raw["caption"],
        hierarchy=raw.get("hierarchy_name", raw["caption"]),
        all_level=raw.get("all_level_name", "(All)"),
        leaf_level=raw.get("leaf_level_name", raw["caption"]),
        ordinal=raw.get("ordinal", 0),
        visible=raw.get("visible", True),
        has_all=raw.get("has_all", True),
        cardinality=raw.get("cardinality_hint", 0),
        description=raw.get("description", ""),
        fact=raw.get("fact_table"),
        shared=raw.get("shared", False),
        date_role=raw.get("is_date_role", False),
        levels=levels,
        table=table,
    )


def _date_dimension(raw: dict[str, Any] | None) -> DateDimension | None:
    if raw is None:
        return None
    raw = raw.get("date_dimension", raw)
    flags = raw.get("flag_columns", {})
    names = {"year_column": "year", "quarter_column": "quarter", "month_column": "month", "ytd_flag_column": "ytd", "prior_year_ytd_flag_column": "prior_year_ytd", "current_year_flag_column": "current_year", "qtd_flag_column": "qtd", "mtd_flag_column": "mtd"}
    given = {names[k]: v for k, v in flags.items() if k in names}
    for key, name in (("dimension_id", "dimension"), ("table_name", "table"), ("date_key_column", "key"), ("full_date_column", "full_date")):
        if key in raw:
            given[name] = raw[key]
    return DateDimension(**given)


def _role(raw: dict[str, Any]) -> Role:
    tables = tuple(TablePermission(t["table"], t.get("filter_expression", ""), t.get("metadata_permission", "read")) for t in raw.get("table_permissions", []))
    return Role(raw["name"], raw.get("model_permission", "read"), tuple(m["member_name"] for m in raw.get("members", [])), tables, raw.get("description", ""))


def model_from_dict(raw: dict[str, Any], base: Path | None = None) -> Model:
    """Builds and checks a model; raises ModelError where it is inconsistent."""
    for key in ("catalog", "cube", "source_name", "table_name", "dialect", "dimensions", "measures"):
        if key not in raw:
            raise ModelError(f"missing key {key!r}")
    if raw["dialect"] not in ("duckdb", "spark"):
        raise ModelError(f"unsupported dialect {raw['dialect']!r}")
    measures = tuple(_measure(m, base) for m in raw["measures"])
    declared = raw.get("fact_tables") or []
    if declared:
        facts = tuple(Fact(f["id"], f["table_name"], f.get("source_name", f["table_name"]), f.get("measure_group_name", f["id"])) for f in declared)
    else:
        facts = (Fact("default", raw["table_name"], raw["source_name"], measures[0].group if measures else raw["cube"]),)
    known = {x for f in facts for x in (f.id, f.table)}
    date = _date_dimension(raw.get("time_intelligence"))
    warnings = []
    for m in measures:
        if declared and (m.fact is None or m.fact not in known):
            raise ModelError(f"measure {m.id!r} names no known fact table")
        fact = next((f for f in facts if m.fact in (f.id, f.table)), facts[0])
        if m.group and m.group != fact.group:
            warnings.append(f"measure {m.id!r} is in group {m.group!r}, its fact in {fact.group!r}")
    dimensions = []
    for d in map(_dimension, raw["dimensions"]):
        if declared and d.fact is not None and d.fact not in known:
            raise ModelError(f"dimension {d.id!r} names an unknown fact table {d.fact!r}")
        if d.date_role and d.fact is None and d.table is None and date is not None and not any(r["dimension_id"] == d.id for r in raw.get("relationships", [])):
            d = replace(d, table=date.table)
        dimensions.append(d)
    relationships = tuple(Relationship(r["fact_table"], r["fact_column"], r["dimension_id"], r["dim_table"], r["dim_column"]) for r in raw.get("relationships", []))
    path = raw.get("db_path")
    if path and base and not Path(path).is_absolute():
        path = str(base / path)
    return Model(raw["catalog"], raw["cube"], facts, tuple(dimensions), measures, relationships, tuple(map(_role, raw.get("roles", []))), date, raw.get("auth"), path, tuple(warnings))


def load_model(path: str | Path) -> Model:
    path = Path(path)
    return model_from_dict(json.loads(path.read_text(encoding="utf-8")), path.parent)


@dataclass(frozen=True)
class User:
    """Who asks. Nobody (None) where authentication is off counts as administrator."""

    name: str = ""
    groups: tuple[str, ...] = ()
    roles: tuple[str, ...] = field(default=())
