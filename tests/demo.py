"""The demo star as a model: 20,000 sales, a calendar, five dimensions, six measures."""

from __future__ import annotations

import datetime as dt

from orthoplex.functions.calendar import calendar
from orthoplex.operators.cube import Cube
from orthoplex.plans.model import model_from_dict
from orthoplex.sources.demo import sales_fact

AS_OF = dt.date(2026, 5, 20)


def _dimension(name, column, ordinal, **more):
    return {"id": name, "physical_field": column, "caption": name, "hierarchy_name": name, "all_level_name": "(All)", "leaf_level_name": name, "ordinal": ordinal, "visible": True, "has_all": True, "cardinality_hint": 10, **more}


def _measure(name, sql, ordinal, flag=None):
    out = {"id": name.replace(" ", ""), "sql_expr": sql, "caption": name, "display_name": name, "format_string": "#,##0", "units": "", "ordinal": ordinal, "visible": True, "measure_group_name": "Sales"}
    return out | ({"time_intelligence": {"dimension_id": "Date", "flag_column": flag}} if flag else {})


DEFINITION = {
    "catalog": "DEMO", "cube": "Sales", "source_name": "sales_fact", "table_name": "sales_fact", "dialect": "duckdb",
    "relationships": [{"fact_table": "default", "fact_column": "date_key", "dimension_id": "Date", "dim_table": "date_dim", "dim_column": "date_key"}],
    "dimensions": [
        _dimension("Category", "category", 1), _dimension("Territory", "territory", 2), _dimension("Channel", "channel", 3), _dimension("Segment", "segment", 4),
        _dimension("Date", "full_date", 5, is_date_role=True, hierarchy_levels=[{"name": n, "column": c, "level_number": k} for k, (n, c) in enumerate((("Year", "year"), ("Quarter", "quarter"), ("Month", "month"), ("Date", "full_date")))]),
    ],
    "measures": [_measure("Revenue", "SUM(revenue)", 1), _measure("Units", "SUM(units)", 2), _measure("Revenue YTD", "SUM(revenue)", 3, "ytd_flag"), _measure("Revenue Prior", "SUM(revenue)", 4, "prior_year_ytd_flag"), _measure("Revenue QTD", "SUM(revenue)", 5, "qtd_flag"), _measure("Revenue MTD", "SUM(revenue)", 6, "mtd_flag")],
    "time_intelligence": {"date_dimension": {"dimension_id": "Date"}},
}


def demo_cube(spark, **more):
    tables = {"sales_fact": sales_fact(spark), "date_dim": calendar(spark, as_of=AS_OF)}
    return Cube(spark, model_from_dict({**DEFINITION, **more}), tables, calendars=frozenset({"date_dim"}))
