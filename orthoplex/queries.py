"""The catalogue: queries over the test tables, and the SQL that each equals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplex.functions.calendar import calendar, date_key
from orthoplex.functions.dax import Lowerer
from orthoplex.operators import rollup
from orthoplex.operators.cube import Cube
from orthoplex.operators.members import child_counts, children, members
from orthoplex.operators.series import cumulative, nested
from orthoplex.plans.model import Model, User, model_from_dict

AS_OF = dt.date(2000, 6, 15)

NET = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))*(1-CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"
QTY = "CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)"
ORDTOT = "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
VALUE = "CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"


def _measure(id_: str, sql: str, caption: str, fact: str, flag: str | None = None, role: str = "Ship Date", **more: Any) -> dict[str, Any]:
    out: dict[str, Any] = {"id": id_, "sql_expr": sql, "caption": caption, "display_name": caption, "format_string": "#,##0.00", "units": "", "ordinal": len(_measures), "visible": True, "fact_table": fact, "measure_group_name": fact, **more}
    if flag:
        out["time_intelligence"] = {"dimension_id": role, "flag_column": flag}
    _measures.append(out)
    return out


_measures: list[dict[str, Any]] = []
_measure("net", NET, "Net Revenue", "line_sales")
_measure("qty", QTY, "Quantity", "line_sales")
_measure("n_lines", "COUNT(*)", "Line Count", "line_sales")
_measure("avg_qty", "AVG(l_quantity)", "Avg Quantity", "line_sales")
_measure("n_parts", "COUNT(DISTINCT l_partkey)", "Distinct Parts", "line_sales")
_measure("median_qty", "MEDIAN(l_quantity)", "Median Quantity", "line_sales")
for _flag, _name in (("ytd_flag", "YTD"), ("prior_year_ytd_flag", "Prior YTD"), ("qtd_flag", "QTD"), ("mtd_flag", "MTD")):
    _id = _name.lower().replace(" ", "_")
    _measure(f"net_{_id}", NET, f"Net Revenue {_name}", "line_sales", _flag)
    _measure(f"qty_{_id}", QTY, f"Quantity {_name}", "line_sales", _flag)
    _measure(f"n_{_id}", "COUNT(*)", f"Line Count {_name}", "line_sales", _flag)
_measure("order_total", ORDTOT, "Order Total", "order_sales")
_measure("n_orders", "COUNT(*)", "Order Count", "order_sales")
_measure("n_buyers", "COUNT(DISTINCT o_custkey)", "Buyers", "order_sales")
_measure("n_events", "COUNT(*)", "Event Count", "event_log")
_measure("event_value", VALUE, "Event Value", "event_log")

#: Formulas as a spreadsheet model has them; lowered to expressions over the star.
FORMULAS = {
    "Returned Qty": 'CALCULATE(SUM(lineitem[l_quantity]), lineitem[l_returnflag] = "R")',
    "Accepted Qty": 'CALCULATE(SUM(lineitem[l_quantity]), lineitem[l_returnflag] = "A")',
    "All Qty": "SUM(lineitem[l_quantity])",
    "Return Share": "DIVIDE([Returned Qty], [All Qty], 0)",
    "Return Surplus": "[Returned Qty] - [Accepted Qty]",
    "Returned Value": 'SUMX(FILTER(lineitem, lineitem[l_returnflag] = "R"), lineitem[l_quantity] * RELATED(part[p_retailprice]))',
}


def _column(table: str, column: str) -> tuple[str, str | None]:
    if table == "part":
        return f"CAST(_part_brand.{column} AS DECIMAL(18,2))", "Part Brand"
    return (f"CAST(f.{column} AS DECIMAL(18,2))" if column in ("l_quantity", "l_extendedprice") else f"f.{column}"), None


_lowerer = Lowerer(_column, FORMULAS)
for _caption, _id in (("Return Share", "return_share"), ("Return Surplus", "return_surplus"), ("Returned Value", "returned_value")):
    _lowered = _lowerer.lower(FORMULAS[_caption])
    _measure(_id, _lowered.sql, _caption, "line_sales", requires=sorted(_lowered.tables), expression=FORMULAS[_caption])


def _dimension(id_: str, field: str, fact: str | None = None, levels: tuple[tuple[str, str], ...] = (), **more: Any) -> dict[str, Any]:
    return {
        "id": id_, "physical_field": field, "caption": id_, "hierarchy_name": id_, "all_level_name": "(All)", "leaf_level_name": id_, "ordinal": 0, "visible": True, "has_all": True, "cardinality_hint": 0,
        "fact_table": fact, "hierarchy_levels": [{"name": n, "column": c, "level_number": k} for k, (n, c) in enumerate(levels)], **more,
    }


_PERIODS = (("Year", "year"), ("Quarter", "quarter"), ("Month", "month"), ("Date", "full_date"))
_PLACES = (("Region", "r_name"), ("Nation", "n_name"))

CUBE: dict[str, Any] = {
    "catalog": "TRADE",
    "cube": "Sales",
    "source_name": "lineitem",
    "table_name": "lineitem",
    "dialect": "spark",
    "fact_tables": [{"id": i, "source_name": t, "table_name": t, "measure_group_name": i} for i, t in (("line_sales", "lineitem"), ("order_sales", "orders"), ("event_log", "events"))],
    "relationships": [
        {"fact_table": f, "fact_column": fc, "dimension_id": d, "dim_table": t, "dim_column": c}
        for f, fc, d, t, c in (
            ("line_sales", "l_partkey", "Part Brand", "part", "p_partkey"),
            ("line_sales", "l_partkey", "Part Type", "part", "p_partkey"),
            ("line_sales", "l_suppkey", "Supplier", "supplier_geo", "s_suppkey"),
            ("order_sales", "o_custkey", "Customer", "customer_geo", "c_custkey"),
            ("order_sales", "o_custkey", "Market Segment", "customer_geo", "c_custkey"),
            ("line_sales", "date_key", "Ship Date", "ship_calendar", "date_key"),
            ("order_sales", "date_key", "Order Date", "order_calendar", "date_key"),
            ("event_log", "date_key", "Event Date", "event_calendar", "date_key"),
        )
    ],
    "dimensions": [
        {**d, "ordinal": k}
        for k, d in enumerate([
            _dimension("Return Flag", "l_returnflag", "line_sales"),
            _dimension("Line Status", "l_linestatus", "line_sales"),
            _dimension("Part Brand", "p_brand"),
            _dimension("Part Type", "p_type"),
            _dimension("Supplier", "s_name", None, (*_PLACES, ("Supplier", "s_name"))),
            _dimension("Customer", "c_name", None, (*_PLACES, ("Customer", "c_name"))),
            _dimension("Market Segment", "c_mktsegment"),
            _dimension("Order Status", "o_orderstatus", "order_sales"),
            _dimension("Order Priority", "o_orderpriority", "order_sales"),
            _dimension("Event Type", "event_type", "event_log"),
            _dimension("Ship Date", "full_date", None, _PERIODS, is_date_role=True),
            _dimension("Order Date", "full_date", None, _PERIODS, is_date_role=True),
            _dimension("Event Date", "full_date", None, _PERIODS, is_date_role=True),
        ])
    ],
    "measures": _measures,
    "time_intelligence": {"date_dimension": {"dimension_id": "Ship Date", "table_name": "ship_calendar"}},
}
CALENDARS = frozenset({"ship_calendar", "order_calendar", "event_calendar"})


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of the cube: facts with a date key, flattened places, calendars."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    trade = calendar(spark, dt.date(1990, 1, 1), dt.date(2010, 12, 31), AS_OF)
    return {
        "lineitem": read("lineitem").withColumn("date_key", date_key(F.col("l_shipdate"))),
        "orders": read("orders").withColumn("date_key", date_key(F.col("o_orderdate"))),
        "events": read("events").withColumn("date_key", date_key(F.col("ts"))),
        "part": read("part"),
        "supplier_geo": read("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name"),
        "customer_geo": read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name"),
        "nations": nations,
        "ship_calendar": trade,
        "order_calendar": trade,
        "event_calendar": calendar(spark, dt.date(2020, 1, 1), dt.date(2030, 12, 31), dt.date(2024, 1, 20)),
    }


def model(**more: Any) -> Model:
    return model_from_dict({**CUBE, **more})


def cube(spark: SparkSession, sf_dir: str, *, prefix_levels: bool = True, **more: Any) -> Cube:
    return Cube(spark, model(**more), tables(spark, sf_dir), calendars=CALENDARS, prefix_levels=prefix_levels)


def _plain(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_MACROS = {
    "{NET}": NET, "{QTY}": QTY, "{ORDTOT}": ORDTOT, "{VALUE}": VALUE,
    "{YEAR}": "CAST(year(l_shipdate) AS VARCHAR)", "{QTR}": "CAST(quarter(l_shipdate) AS VARCHAR)", "{MON}": "CAST(month(l_shipdate) AS VARCHAR)",
    "{YTD}": "(CAST(l_shipdate AS DATE) <= DATE '2000-06-15' AND year(l_shipdate) = 2000)",
    "{PRIOR}": "(year(l_shipdate) = 1999 AND dayofyear(l_shipdate) <= dayofyear(DATE '2000-06-15'))",
    "{QTD}": "(CAST(l_shipdate AS DATE) <= DATE '2000-06-15' AND year(l_shipdate) = 2000 AND quarter(l_shipdate) = 2)",
    "{MTD}": "(CAST(l_shipdate AS DATE) <= DATE '2000-06-15' AND year(l_shipdate) = 2000 AND month(l_shipdate) = 6)",
    "{GEO}": "(SELECT s_suppkey, r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
}


def _sql(text: str) -> str:
    for name, body in _MACROS.items():
        text = text.replace(name, body)
    return text


def _register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = build
    if sql:
        _SQL[name] = _sql(sql)


def _mdx(name: str, text: str, sql: str | None, *, user: User | None = None, prefix_levels: bool = True, **more: Any) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(cube(spark, sf_dir, prefix_levels=prefix_levels, **more).query(text, user))

    _register(name, build, sql)


_mdx("q01_total", "SELECT FROM [Sales] WHERE ([Measures].[Net Revenue])", "SELECT {NET} AS net FROM lineitem")
_mdx("q02_total_slicer", "SELECT {[Measures].[Net Revenue]} ON COLUMNS FROM [Sales] WHERE ([Return Flag].[Return Flag].&[R])", "SELECT {NET} AS net FROM lineitem WHERE l_returnflag IN ('R')")
_mdx("q03_group1", "SELECT {[Measures].[Net Revenue]} ON COLUMNS, [Return Flag].[Return Flag].Members ON ROWS FROM [Sales]", "SELECT l_returnflag AS return_flag, {NET} AS net FROM lineitem GROUP BY 1")
_mdx(
    "q04_crossjoin2",
    "SELECT NON EMPTY CrossJoin(Hierarchize({DrilldownLevel({[Return Flag].[Return Flag].[All]},,,INCLUDE_CALC_MEMBERS)}), Hierarchize({DrilldownLevel({[Line Status].[Line Status].[All]},,,INCLUDE_CALC_MEMBERS)})) "
    "DIMENSION PROPERTIES PARENT_UNIQUE_NAME,HIERARCHY_UNIQUE_NAME ON COLUMNS FROM [Sales] WHERE ([Measures].[Net Revenue]) CELL PROPERTIES VALUE, FORMAT_STRING",
    "SELECT l_returnflag AS return_flag, l_linestatus AS line_status, {NET} AS net FROM lineitem GROUP BY 1, 2",
)
_mdx(
    "q05_crossjoin3",
    "SELECT {[Measures].[Quantity]} ON 0, {[Return Flag].[Return Flag].Members} * {[Line Status].[Line Status].Members} * {[Part Type].[Part Type].Members} ON 1 FROM [Sales]",
    "SELECT l_returnflag AS return_flag, l_linestatus AS line_status, p_type AS part_type, {QTY} AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3",
)


def _star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    first = c.table("part").agg(F.min("p_type")).first()[0]
    return _plain(c.query(f"SELECT {{[Measures].[Net Revenue]}} ON 0, [Part Brand].[Part Brand].Members ON 1 FROM [Sales] WHERE ([Part Type].[Part Type].&[{first}])"))


_register("q06_star_join", _star_join, "SELECT p_brand AS part_brand, {NET} AS net FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN (SELECT MIN(p_type) FROM part) GROUP BY 1")
_mdx("q07_subselect", "SELECT {[Measures].[Net Revenue]} ON 0, [Return Flag].[Return Flag].Members ON 1 FROM (SELECT ({[Line Status].[Line Status].&[O]}) ON COLUMNS FROM [Sales])", "SELECT l_returnflag AS return_flag, {NET} AS net FROM lineitem WHERE l_linestatus IN ('O') GROUP BY 1")
_mdx(
    "q08_nested_subselect",
    "SELECT {[Measures].[Net Revenue]} ON 0, [Part Brand].[Part Brand].Members ON 1 FROM (SELECT ({[Return Flag].[Return Flag].&[A],[Return Flag].[Return Flag].&[R]}) ON COLUMNS FROM (SELECT ({[Line Status].[Line Status].&[F]}) ON COLUMNS FROM [Sales]))",
    "SELECT p_brand AS part_brand, {NET} AS net FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A','R') AND l_linestatus IN ('F') GROUP BY 1",
)
_mdx("q09_name_form", "SELECT {[Measures].[Net Revenue]} ON 0 FROM [Sales] WHERE ([Return Flag].[Return Flag].[R])", "SELECT {NET} AS net FROM lineitem WHERE l_returnflag = 'R'")
_mdx("q10_all_noop", "SELECT {[Measures].[Net Revenue]} ON 0, [Line Status].[Line Status].Members ON 1 FROM [Sales] WHERE ([Return Flag].[Return Flag].[All])", "SELECT l_linestatus AS line_status, {NET} AS net FROM lineitem GROUP BY 1")
_mdx("q11_default_measure", "SELECT Hierarchize({DrilldownLevel({[Return Flag].[Return Flag].[All]})}) ON COLUMNS FROM [Sales]", "SELECT l_returnflag AS return_flag, {NET} AS net FROM lineitem GROUP BY 1")
_mdx("q12_default_dimension", "SELECT {AddCalculatedMembers({[Order Status].[Order Status].[All].Children})} DIMENSION PROPERTIES MEMBER_TYPE ON COLUMNS FROM [Sales] CELL PROPERTIES CELL_ORDINAL", "SELECT o_orderstatus AS order_status, {ORDTOT} AS order_total FROM orders GROUP BY 1")
_mdx("q13_unrelated_filter_ignored", "SELECT {[Measures].[Net Revenue]} ON 0 FROM [Sales] WHERE ([Order Status].[Order Status].&[P])", "SELECT {NET} AS net FROM lineitem")
_mdx("q14_second_fact", "SELECT {[Measures].[Order Total],[Measures].[Order Count]} ON 0, [Market Segment].[Market Segment].Members ON 1 FROM [Sales]", "SELECT c_mktsegment AS market_segment, {ORDTOT} AS order_total, CAST(COUNT(*) AS DOUBLE) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
_mdx("q15_level_year", "SELECT {[Measures].[Net Revenue]} ON 0, [Ship Date].[Ship Date].[Year].Members ON 1 FROM [Sales]", "SELECT {YEAR} AS year, {NET} AS net FROM lineitem GROUP BY 1")
_mdx("q16_level_quarter", "SELECT {[Measures].[Net Revenue]} ON 0, [Ship Date].[Ship Date].[Quarter].Members ON 1 FROM [Sales]", "SELECT {QTR} AS quarter, {NET} AS net FROM lineitem GROUP BY 1", prefix_levels=False)
_mdx("q16_level_quarter_prefix", "SELECT {[Measures].[Net Revenue]} ON 0, [Ship Date].[Ship Date].[Quarter].Members ON 1 FROM [Sales]", "SELECT {YEAR} AS year, {QTR} AS quarter, {NET} AS net FROM lineitem GROUP BY 1, 2")
_mdx("q17_level_slicer", "SELECT {[Measures].[Net Revenue]} ON 0 FROM [Sales] WHERE ([Ship Date].[Ship Date].[Year].&[1998])", "SELECT {NET} AS net FROM lineitem WHERE year(l_shipdate) = 1998")
_mdx("q18_compound_key", "SELECT {[Measures].[Net Revenue]} ON 0, {DrilldownLevel({[Ship Date].[Ship Date].[Quarter].&[1998]&[4]})} ON 1 FROM [Sales]", "SELECT {MON} AS month, {NET} AS net FROM lineitem WHERE year(l_shipdate) = 1998 AND quarter(l_shipdate) = 4 GROUP BY 1")
_mdx("q19_bare_month_key", "SELECT {[Measures].[Net Revenue]} ON 0 FROM [Sales] WHERE ([Ship Date].[Ship Date].[Month].&[6])", "SELECT {NET} AS net FROM lineitem WHERE month(l_shipdate) = 6")
_mdx("q20_geo_drill", "SELECT {[Measures].[Net Revenue]} ON 0, {DrilldownLevel({[Supplier].[Supplier].[Region].&[ASIA]})} ON 1 FROM [Sales]", "SELECT n_name AS nation, {NET} AS net FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey WHERE r_name = 'ASIA' GROUP BY 1")


def _ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthoplex.plans.query import Filter

    return _plain(cube(spark, sf_dir).totals("Ship Date", 1, ["net"], (Filter("Ship Date", 0, (("1998",),)),)))


_register(
    "q21_ancestor_totals",
    _ancestors,
    "SELECT {YEAR} AS year, {QTR} AS quarter, CAST(GROUPING({YEAR}) + GROUPING({QTR}) AS BIGINT) AS lvl, {NET} AS net FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY GROUPING SETS (({YEAR}, {QTR}), ({YEAR}), ())",
)
_mdx(
    "q22_collapse",
    "SELECT Hierarchize(DrilldownMember(CrossJoin({[Return Flag].[Return Flag].[All],[Return Flag].[Return Flag].[Return Flag].AllMembers}, {([Line Status].[Line Status].[All])}), {-{[Return Flag].[Return Flag].&[A]}}, [Line Status].[Line Status])) ON COLUMNS FROM [Sales] WHERE ([Measures].[Quantity])",
    "SELECT l_returnflag AS return_flag, CASE WHEN l_returnflag = 'A' THEN 'All' ELSE l_linestatus END AS line_status, {QTY} AS qty FROM lineitem GROUP BY 1, 2",
)
_BRANDS = "(SELECT p_brand AS part_brand, {NET} AS net FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"
_mdx("q23_topcount", "SELECT {[Measures].[Net Revenue]} ON 0, TopCount([Part Brand].[Part Brand].Members, 5, [Measures].[Net Revenue]) ON 1 FROM [Sales]", f"SELECT * FROM {_BRANDS} t ORDER BY net DESC, part_brand LIMIT 5")
_mdx("q24_bottomcount", "SELECT {[Measures].[Net Revenue]} ON 0, BottomCount([Part Brand].[Part Brand].Members, 3, [Measures].[Net Revenue]) ON 1 FROM [Sales]", f"SELECT * FROM {_BRANDS} t ORDER BY net, part_brand LIMIT 3")
_mdx(
    "q25_toppercent",
    "SELECT {[Measures].[Net Revenue]} ON 0, TopPercent([Part Brand].[Part Brand].Members, 10, [Measures].[Net Revenue]) ON 1 FROM [Sales]",
    f"SELECT part_brand, net FROM (SELECT part_brand, net, row_number() OVER (ORDER BY net DESC, part_brand) rn, count(*) OVER () n FROM {_BRANDS} t) u WHERE rn <= ceil(n * 10 / 100.0)",
)
_mdx("q26_order", "SELECT {[Measures].[Net Revenue]} ON 0, Order([Part Brand].[Part Brand].Members, [Measures].[Net Revenue], DESC) ON 1 FROM [Sales]", f"SELECT * FROM {_BRANDS} t")
_mdx("q27_filter_value", "SELECT {[Measures].[Net Revenue]} ON 0, Filter([Part Brand].[Part Brand].Members, [Measures].[Net Revenue] > 120000000) ON 1 FROM [Sales]", f"SELECT * FROM {_BRANDS} t WHERE net > 120000000")
_mdx(
    "q28_multi_measure",
    "SELECT {[Measures].[Net Revenue],[Measures].[Quantity],[Measures].[Line Count],[Measures].[Quantity YTD]} ON 0 FROM [Sales]",
    "SELECT {NET} AS net, {QTY} AS qty, CAST(COUNT(*) AS DOUBLE) AS n_lines, COALESCE(CAST(SUM(CASE WHEN {YTD} THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE), 0.0) AS qty_ytd FROM lineitem",
)
_FLAGGED = "COALESCE(CAST(SUM(CASE WHEN {YTD} THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE), 0.0) AS qty_ytd"
_mdx("q29_multi_group", "SELECT {[Measures].[Quantity],[Measures].[Quantity YTD]} ON 0, [Return Flag].[Return Flag].Members ON 1 FROM [Sales]", f"SELECT l_returnflag AS return_flag, {{QTY}} AS qty, {_FLAGGED} FROM lineitem GROUP BY 1")
_mdx("q30_multi_group2", "SELECT {[Measures].[Net Revenue],[Measures].[Quantity YTD]} ON 0, CrossJoin([Return Flag].[Return Flag].Members, [Line Status].[Line Status].Members) ON 1 FROM [Sales]", f"SELECT l_returnflag AS return_flag, l_linestatus AS line_status, {{NET}} AS net, {_FLAGGED} FROM lineitem GROUP BY 1, 2")
_mdx(
    "q31_tupleset",
    "SELECT {([Measures].[Net Revenue],[Ship Date].[Ship Date].[Year].&[1998]),([Measures].[Net Revenue],[Ship Date].[Ship Date].[Month].&[6]),([Measures].[Quantity],[Return Flag].[Return Flag].&[R])} ON 0 FROM [Sales]",
    "SELECT CAST(0 AS BIGINT) AS ord, 'net' AS measure, {NET} AS value FROM lineitem WHERE year(l_shipdate) = 1998 UNION ALL SELECT CAST(1 AS BIGINT), 'net', {NET} FROM lineitem WHERE month(l_shipdate) = 6 UNION ALL SELECT CAST(2 AS BIGINT), 'qty', {QTY} FROM lineitem WHERE l_returnflag = 'R'",
)
_mdx(
    "q32_count_members",
    "WITH MEMBER [Measures].cChildren As 'AddCalculatedMembers([Return Flag].[Return Flag].currentmember.children).count' Set FilteredMembers As '{[Return Flag].[Return Flag].[All]}' Select {[Measures].cChildren} on ROWS, Hierarchize(Generate(FilteredMembers, Ascendants([Return Flag].[Return Flag].currentmember))) ON COLUMNS FROM [Sales]",
    "SELECT CAST(COUNT(DISTINCT l_returnflag) AS BIGINT) AS members FROM lineitem",
)
for _n, _word, _id, _flag in (("q33_ytd", "YTD", "ytd", "YTD"), ("q34_prior_ytd", "Prior YTD", "prior_ytd", "PRIOR"), ("q35_qtd", "QTD", "qtd", "QTD"), ("q36_mtd", "MTD", "mtd", "MTD")):
    _mdx(_n, f"SELECT {{[Measures].[Net Revenue {_word}],[Measures].[Line Count {_word}]}} ON 0 FROM [Sales]", f"SELECT COALESCE({{NET}}, 0.0) AS net_{_id}, CAST(COUNT(*) AS DOUBLE) AS n_{_id} FROM lineitem WHERE {{{_flag}}}")
_mdx("q37_ytd_by_brand", "SELECT {[Measures].[Net Revenue YTD]} ON 0, [Part Brand].[Part Brand].Members ON 1 FROM [Sales]", "SELECT p_brand AS part_brand, {NET} AS net_ytd FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {YTD} GROUP BY 1")


def _roles(*entries: tuple[str, str, str, str]) -> dict[str, Any]:
    """(role, table, filter, metadata permission) as the model's sections."""
    return {"auth": {}, "roles": [{"name": n, "model_permission": "read", "members": [{"member_name": "ada"}], "table_permissions": [{"table": t, "filter_expression": p, "metadata_permission": m}]} for n, t, p, m in entries]}


_ADA = User("ada")
_mdx("q38_rls_fact", "SELECT FROM [Sales] WHERE ([Measures].[Net Revenue])", "SELECT {NET} AS net FROM lineitem f WHERE f.l_returnflag = 'A'", user=_ADA, **_roles(("accepted", "lineitem", "f.l_returnflag = 'A'", "read")))
_mdx("q39_rls_dim", "SELECT {[Measures].[Net Revenue]} ON 0, [Return Flag].[Return Flag].Members ON 1 FROM [Sales]", "SELECT l_returnflag AS return_flag, {NET} AS net FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey WHERE g.r_name = 'ASIA' GROUP BY 1", user=_ADA, **_roles(("asia", "supplier_geo", "_supplier.r_name = 'ASIA'", "read")))
_mdx(
    "q40_rls_union",
    "SELECT FROM [Sales] WHERE ([Measures].[Net Revenue])",
    "SELECT {NET} AS net FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey WHERE (g.r_name = 'ASIA') OR (g.r_name = 'EUROPE')",
    user=_ADA,
    **_roles(("asia", "supplier_geo", "_supplier.r_name = 'ASIA'", "read"), ("europe", "supplier_geo", "_supplier.r_name = 'EUROPE'", "read")),
)
_mdx("q41_ols_hidden", "SELECT {[Measures].[Net Revenue]} ON 0, [Return Flag].[Return Flag].Members ON 1 FROM [Sales]", "SELECT l_returnflag AS return_flag, l_extendedprice AS net FROM lineitem WHERE 1 = 0", user=_ADA, **_roles(("none", "lineitem", "", "none")))
_register(
    "q42_drillthrough",
    lambda spark, sf_dir: cube(spark, sf_dir).query("DRILLTHROUGH MAXROWS 1000 SELECT {([Measures].[Order Count],[Order Status].[Order Status].&[P])} ON 0 FROM [Sales]").drop("date_key"),
    "SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1000",
)
_register("q43_members", lambda spark, sf_dir: members(cube(spark, sf_dir), "Part Brand").select("member"), "SELECT DISTINCT p_brand AS member FROM part")
_register("q44_children", lambda spark, sf_dir: children(cube(spark, sf_dir), "Supplier", ("ASIA",)).select(F.col("member").alias("child")), "SELECT DISTINCT n_name AS child FROM {GEO} g WHERE r_name = 'ASIA'")
_register("q45_child_counts", lambda spark, sf_dir: _plain(child_counts(cube(spark, sf_dir), "Supplier", 0)), "SELECT r_name AS region, COUNT(DISTINCT n_name) AS children FROM {GEO} g GROUP BY 1")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthoplex.operators.rowsets import rowset

    return rowset(cube(spark, sf_dir), "MDSCHEMA_LEVELS").where("DIMENSION_UNIQUE_NAME = '[Supplier]'").select(F.col("LEVEL_NAME").alias("level_name"), F.col("LEVEL_NUMBER").cast("bigint").alias("level_number"))


_register("q46_rowset_levels", _levels, "SELECT * FROM (VALUES ('(All)', CAST(0 AS BIGINT)), ('Region', 1), ('Nation', 2), ('Supplier', 3)) t(level_name, level_number)")
_mdx("q47_median", "SELECT {[Measures].[Median Quantity]} ON 0 FROM [Sales]", "SELECT median(l_quantity) AS median_qty FROM lineitem")
_mdx("q48_avg", "SELECT {[Measures].[Avg Quantity]} ON 0, [Return Flag].[Return Flag].Members ON 1 FROM [Sales]", "SELECT l_returnflag AS return_flag, AVG(l_quantity) AS avg_qty FROM lineitem GROUP BY 1")
_register(
    "q49_cumulative",
    lambda spark, sf_dir: _plain(cumulative(cube(spark, sf_dir), "n_buyers", "Order Date", 1)),
    "SELECT CAST(y AS VARCHAR) AS year, CAST(q AS VARCHAR) AS quarter, CAST(n AS DOUBLE) AS n_buyers, CAST(SUM(n) OVER (PARTITION BY y ORDER BY q ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM (SELECT year(o_orderdate) y, quarter(o_orderdate) q, count(DISTINCT o_custkey) n FROM orders GROUP BY 1, 2) t",
)
_mdx("q50_divide", "SELECT {[Measures].[Return Share]} ON 0 FROM [Sales]", "SELECT COALESCE(a / b, 0) AS return_share FROM (SELECT (SELECT SUM(l_quantity) FROM lineitem WHERE l_returnflag = 'R') a, (SELECT SUM(l_quantity) FROM lineitem) b) t")
_mdx("q51_measure_arith", "SELECT {[Measures].[Return Surplus]} ON 0 FROM [Sales]", "SELECT COALESCE((SELECT {QTY} FROM lineitem WHERE l_returnflag = 'R'), 0) - COALESCE((SELECT {QTY} FROM lineitem WHERE l_returnflag = 'A'), 0) AS return_surplus")
_mdx("q52_sumx_related", "SELECT {[Measures].[Returned Value]} ON 0 FROM [Sales]", "SELECT COALESCE(CAST(SUM(CAST(f.l_quantity AS DECIMAL(18,2)) * CAST(p.p_retailprice AS DECIMAL(18,2))) AS DOUBLE), 0) AS returned_value FROM lineitem f JOIN part p ON f.l_partkey = p.p_partkey WHERE f.l_returnflag = 'R'")


def attach_rollups(c: Cube) -> Cube:
    """Routes to rollups that are computed on the fly."""
    c.rollups = [rollup.Rollup(x, rollup._build(c, x)) for x in rollup.design(c.model) if x.fact == "line_sales" and x.dimension == "Ship Date"]
    return c


def _rollup_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    found = next(x for x in rollup.design(c.model) if x.dimension == "Ship Date" and x.level == 2)
    built = rollup._build(c, found)
    return built.select(
        F.col("Ship_Date__Year").alias("year"), F.col("Ship_Date__Quarter").alias("quarter"), F.col("Ship_Date__Month").alias("month"),
        F.col("Return_Flag__leaf").alias("return_flag"), F.col("Line_Status__leaf").alias("line_status"), F.col("net").cast("double").alias("net"), F.col("n_lines").cast("long").alias("n_lines"),
    )


_register("q53_rollup_month", _rollup_month, "SELECT {YEAR} AS year, {QTR} AS quarter, {MON} AS month, l_returnflag AS return_flag, l_linestatus AS line_status, {NET} AS net, COUNT(*) AS n_lines FROM lineitem GROUP BY 1, 2, 3, 4, 5")
_register("q54_rollup_routed_total", lambda spark, sf_dir: _plain(attach_rollups(cube(spark, sf_dir)).query("SELECT {[Measures].[Net Revenue]} ON 0 FROM [Sales]")), "SELECT {NET} AS net FROM lineitem")
_register(
    "q54_rollup_routed_group",
    lambda spark, sf_dir: _plain(attach_rollups(cube(spark, sf_dir)).query("SELECT {[Measures].[Net Revenue],[Measures].[Line Count]} ON 0, CrossJoin([Ship Date].[Ship Date].[Year].Members, [Return Flag].[Return Flag].Members) ON 1 FROM [Sales] WHERE ([Line Status].[Line Status].&[O])")),
    "SELECT {YEAR} AS year, l_returnflag AS return_flag, {NET} AS net, CAST(COUNT(*) AS DOUBLE) AS n_lines FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2",
)
_register(
    "q55_calendar",
    lambda spark, sf_dir: calendar(spark, dt.date(1998, 1, 1), dt.date(2001, 12, 31), AS_OF),
    "SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key, d AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, "
    "d <= DATE '2000-06-15' AND year(d) = 2000 AS ytd_flag, year(d) = 1999 AND dayofyear(d) <= dayofyear(DATE '2000-06-15') AS prior_year_ytd_flag, year(d) = 2000 AS current_year_flag, "
    "d <= DATE '2000-06-15' AND year(d) = 2000 AND quarter(d) = 2 AS qtd_flag, d <= DATE '2000-06-15' AND year(d) = 2000 AND month(d) = 6 AS mtd_flag "
    "FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d) t",
)


def _auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthoplex.sources.automodel import infer

    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "supplier", "nation", "region")}
    guess = infer(found, foreign_keys=[("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")])
    m = model_from_dict(guess)
    rows = [("fact", f.table) for f in m.facts] + [("dimension", d.id) for d in m.dimensions] + [("measure", x.id) for x in m.measures]
    return spark.createDataFrame(rows, "kind string, name string")


_register("q56_automodel_summary", _auto)
_mdx("q57_event_fact", "SELECT {[Measures].[Event Count],[Measures].[Event Value]} ON 0, [Event Type].[Event Type].Members ON 1 FROM [Sales]", "SELECT event_type, CAST(COUNT(*) AS DOUBLE) AS n_events, {VALUE} AS event_value FROM events GROUP BY 1")
_mdx("q58_two_facts", "SELECT {[Measures].[Net Revenue],[Measures].[Order Total]} ON 0 FROM [Sales]", "SELECT (SELECT {NET} FROM lineitem) AS net, (SELECT {ORDTOT} FROM orders) AS order_total")
_mdx(
    "q59_except_members",
    "SELECT {[Measures].[Quantity]} ON 0, Except([Return Flag].[Return Flag].Members, {[Return Flag].[Return Flag].&[N]}) ON 1 FROM [Sales]",
    "SELECT l_returnflag AS return_flag, {QTY} AS qty FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1",
)
_mdx(
    "q60_year_by_region",
    "SELECT {[Measures].[Net Revenue],[Measures].[Line Count]} ON 0, CrossJoin([Ship Date].[Ship Date].[Year].Members, [Supplier].[Supplier].[Region].Members) ON 1 FROM [Sales] WHERE ([Ship Date].[Ship Date].[Year].&[1998], [Return Flag].[Return Flag].&[R])",
    "SELECT {YEAR} AS year, r_name AS region, {NET} AS net, CAST(COUNT(*) AS DOUBLE) AS n_lines FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey WHERE year(l_shipdate) = 1998 AND l_returnflag = 'R' GROUP BY 1, 2",
)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthoplex.plans.query import Group

    return _plain(nested(cube(spark, sf_dir), "net", (Group("Part Brand"),), (Group("Return Flag"),), "max"))


def _top_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orthoplex.plans.query import CubeQuery, Group, SetOp

    return _plain(cube(spark, sf_dir).dataframe(CubeQuery("group", ("qty",), (Group("Part Brand"),), set_ops=(SetOp("percent", 30, op="value"),))))


_register("q61_nested_aggregate", _nested, "SELECT return_flag, MAX(net) AS net FROM (SELECT l_returnflag AS return_flag, p_brand, {NET} AS net FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) t GROUP BY 1")
_register(
    "q62_toppercent_of_value",
    _top_value,
    "SELECT part_brand, qty FROM (SELECT part_brand, qty, COALESCE(SUM(qty) OVER (ORDER BY qty DESC, part_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, SUM(qty) OVER () t "
    "FROM (SELECT p_brand AS part_brand, {QTY} AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) u) v WHERE b < t * 30 / 100",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
