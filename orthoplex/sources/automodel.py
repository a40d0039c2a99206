"""A cube definition inferred from table schemas.

Fact: the table with the most rows (ties: the most numeric columns).  Foreign keys
are given or guessed from names; string columns of the tables they reach and of the
fact become dimensions, numeric columns that are no keys become measures, dates get
a Year/Quarter/Month/Date hierarchy over a calendar of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthoplex.functions.calendar import calendar_for

MAX_CARDINALITY = 10_000
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_STRING = (T.StringType, T.BooleanType)
_DATE = (T.DateType, T.TimestampType, T.TimestampNTZType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SAFE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_PERIODS = (("Year", "year", 11), ("Quarter", "quarter", 44), ("Month", "month", 132))


def key_like(name: str) -> bool:
    name = name.lower()
    return name in ("id", "key", "code") or name.endswith(("_id", "_key", "_code", "id_", "key_")) or bool(re.search(r"[a-z](?:Id|Key|ID)\Z", name)) or bool(re.fullmatch(r"[a-z]+_?\w*key", name))


def guess_foreign_keys(schemas: Mapping[str, T.StructType], fact: str) -> list[tuple[str, str, str, str]]:
    """x_id or x_key of the fact reaches table x, xs or dim_x, by its column of the same name, id, code or its first."""
    out = []
    lower = {t.lower(): t for t in schemas}
    for column in schemas[fact].names:
        m = re.fullmatch(r"(\w+?)_(?:id|key)", column, re.I)
        if not m:
            continue
        stem = m.group(1).lower()
        table = next((lower[t] for t in (stem, stem + "s", "dim_" + stem) if t in lower and lower[t] != fact), None)
        if table is None or not schemas[table].names:
            continue
        names = schemas[table].names
        target = next((c for want in (column.lower(), "id", "code") for c in names if c.lower() == want), names[0])
        out.append((fact, column, table, target))
    return out


def _dimension(id_: str, column: str, ordinal: int, cardinality: int, **more: Any) -> dict[str, Any]:
    return {"id": id_, "physical_field": column, "caption": id_, "hierarchy_name": id_, "all_level_name": "(All)", "leaf_level_name": id_, "ordinal": ordinal, "visible": True, "has_all": True, "cardinality_hint": cardinality, **more}


def infer(tables: Mapping[str, DataFrame], *, fact: str | None = None, foreign_keys: Iterable[tuple[str, str, str, str]] = (), catalog: str = "AUTO", cardinalities: bool = True) -> dict[str, Any]:
    """The definition in the form that ``model_from_dict`` reads."""
    names = [t for t in tables if _SAFE.match(t)]
    if not names:
        raise ValueError("no tables")
    schemas = {t: tables[t].schema for t in names}
    if fact is None:
        counts = {t: tables[t].count() for t in names}
        fact = max(names, key=lambda t: (counts[t], sum(isinstance(f.dataType, _NUMERIC) for f in schemas[t])))
    elif fact not in schemas:
        raise ValueError(f"no table {fact!r}")
    declared = [k for k in foreign_keys if k[0] == fact]
    keys = declared + [k for k in guess_foreign_keys(schemas, fact) if k[1] not in {d[1] for d in declared}]
    wanted: dict[str, list[str]] = {}
    for _, _, table, _ in keys:
        wanted[table] = [f.name for f in schemas[table] if isinstance(f.dataType, _STRING) and _SAFE.match(f.name)]
    consumed = {k[1] for k in keys}
    own = [f.name for f in schemas[fact] if isinstance(f.dataType, _STRING) and _SAFE.match(f.name) and f.name not in consumed]
    dates = [f.name for f in schemas[fact] if isinstance(f.dataType, _DATE) and _SAFE.match(f.name)]
    wanted.setdefault(fact, [])
    wanted[fact] = wanted[fact] + own + dates
    hints: dict[tuple[str, str], int] = {}
    if cardinalities:
        for table, columns in wanted.items():
            if columns:
                row = tables[table].agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in columns]).first()
                hints |= {(table, c): min(MAX_CARDINALITY, row[c]) for c in columns}
    dimensions: list[dict[str, Any]] = []
    relationships: list[dict[str, Any]] = []
    taken: set[str] = set()

    def unique(column: str, table: str) -> str:
        name, k = column, 2
        if name in taken:
            name = f"{table}_{column}"
        while name in taken:
            name, k = f"{table}_{column}_{k}", k + 1
        taken.add(name)
        return name

    for _, fact_column, table, target in keys:
        for column in wanted[table]:
            id_ = unique(column, table)
            dimensions.append(_dimension(id_, column, len(dimensions) + 1, hints.get((table, column), 0)))
            relationships.append({"fact_table": "default", "fact_column": fact_column, "dimension_id": id_, "dim_table": table, "dim_column": target})
    dimensions += [_dimension(unique(c, fact), c, len(dimensions) + 1 + k, hints.get((fact, c), 0)) for k, c in enumerate(own)]
    measures = []
    for f in schemas[fact]:
        if isinstance(f.dataType, _NUMERIC) and _SAFE.match(f.name) and f.name not in consumed and not key_like(f.name):
            sql = f"SUM(CAST({f.name} AS DOUBLE))" if isinstance(f.dataType, _INTEGRAL) else f"SUM({f.name})"
            measures.append({"id": f.name, "sql_expr": sql, "caption": f.name, "display_name": f.name, "format_string": "#,##0" if isinstance(f.dataType, _INTEGRAL) else "#,##0.00", "units": "", "ordinal": len(measures) + 1, "visible": True, "measure_group_name": fact})
    if not measures:
        measures.append({"id": "row_count", "sql_expr": "COUNT(*)", "caption": "Row Count", "display_name": "Row Count", "format_string": "#,##0", "units": "", "ordinal": 1, "visible": True, "measure_group_name": fact})
    out: dict[str, Any] = {"catalog": catalog, "cube": "AutoModel", "source_name": fact, "table_name": fact, "dialect": "spark", "relationships": relationships, "dimensions": dimensions, "measures": measures}
    for k, column in enumerate(dates):
        table = "date_dim" if k == 0 else f"date_dim_{column}"
        id_ = unique(column, fact)
        levels = [{"name": n, "column": c, "level_number": i, "cardinality": size} for i, (n, c, size) in enumerate(_PERIODS)]
        levels.append({"name": "Date", "column": column, "level_number": 3, "cardinality": 4018})
        dimensions.append(_dimension(id_, column, len(dimensions) + 1, hints.get((fact, column), 0), is_date_role=True, hierarchy_levels=levels))
        relationships.append({"fact_table": "default", "fact_column": column, "dimension_id": id_, "dim_table": table, "dim_column": column})
        if k == 0:
            out["time_intelligence"] = {"date_dimension": {"dimension_id": id_, "table_name": table, "date_key_column": column, "full_date_column": column}}
    return out


def calendars(definition: Mapping[str, Any], tables: Mapping[str, DataFrame], as_of: Any = None) -> dict[str, DataFrame]:
    """The calendars that an inferred definition refers to, over the range of each date column, and the fact with plain dates."""
    out: dict[str, DataFrame] = {}
    fact = tables[definition["table_name"]]
    for d in definition["dimensions"]:
        if d.get("is_date_role"):
            column = d["physical_field"]
            rel = next(r for r in definition["relationships"] if r["dimension_id"] == d["id"])
            out[rel["dim_table"]] = calendar_for(fact, column, as_of).withColumnRenamed("full_date", column)
            out[definition["table_name"]] = out.get(definition["table_name"], fact).withColumn(column, F.col(column).cast("date"))
    return out
