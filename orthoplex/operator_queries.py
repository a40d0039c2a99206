"""Queries for the operators that the catalogue of statements does not reach: sources, members, rowsets, probes, formulas, rollups that are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplex import queries as base
from orthoplex.functions import dax
from orthoplex.functions.calendar import calendar_for
from orthoplex.operators import rollup
from orthoplex.operators.cellset import cellset
from orthoplex.operators.cube import Cube
from orthoplex.operators.members import cardinality, siblings
from orthoplex.operators.rowsets import rowset
from orthoplex.plans.model import User, model_from_dict
from orthoplex.sources import automodel, demo, mquery, tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    _QUERIES[name], _SQL[name] = build, base._sql(sql)


def _values(rows: Iterable[tuple], names: str) -> str:
    """The rows as SQL; numbers are long or double, as in ``_frame``."""
    def one(v: Any) -> str:
        return "NULL" if v is None else f"CAST({v} AS BIGINT)" if isinstance(v, int) and not isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


def _shared(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place that the cluster names; in a session on one machine without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.gettempdir()
    return f"{found.rstrip('/')}/orthoplex-{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources

_add("s01_parquet_tables", lambda spark, sf: tables.parquet_tables(spark, sf, ["nation"])["nation"], "SELECT * FROM nation")
_add("s02_demo_sales", lambda spark, sf: demo.sales_fact(spark).agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"), F.sum("units").alias("units")), _values([(20_000, 521586767.0, 4931640.0)], "n, revenue, units"))
_add(
    "s03_inventory_invariants",
    lambda spark, sf: demo.inventory_fact(spark).agg(F.count("*").alias("n"), F.countDistinct("warehouse").alias("warehouses"), F.min(F.col("stock_qty") >= 100).alias("bounded"), F.min(F.col("stock_cost") >= F.col("stock_qty")).alias("costs")),
    _values([(10_000, 5, True, True)], "n, warehouses, bounded, costs").replace("CAST(5 AS BIGINT)", f"CAST({len(demo.WAREHOUSES)} AS BIGINT)"),
)
_add(
    "s04_benchmark_invariants",
    lambda spark, sf: demo.benchmark_fact(spark, "small").agg(F.count("*").alias("n"), F.min(F.col("date_key").between(20200101, 20301228)).alias("days"), (F.sum((F.col("category") == demo.CATEGORIES[0]).cast("int")) * 3 >= F.count("*")).alias("skewed")),
    _values([(demo.SIZES["small"], True, True)], "n, days, skewed"),
)
_add(
    "s06_calendar_over_a_fact",
    lambda spark, sf: calendar_for(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate", base.AS_OF).agg(F.count("*").alias("n"), F.min("full_date").alias("first"), F.max("full_date").alias("last"), F.sum(F.col("ytd_flag").cast("int")).alias("ytd")),
    "SELECT COUNT(*) AS n, MIN(d) AS first, MAX(d) AS last, CAST(SUM(CASE WHEN d BETWEEN DATE '2000-01-01' AND DATE '2000-06-15' THEN 1 ELSE 0 END) AS BIGINT) AS ytd FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT CAST(CAST(MIN(o_orderdate) AS DATE) AS TIMESTAMP) a, CAST(CAST(MAX(o_orderdate) AS DATE) AS TIMESTAMP) b FROM orders) t) u",
)


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    folder = _shared(spark, "csv")
    spark.read.parquet(f"{sf}/supplier.parquet").write.option("header", True).csv(f"{folder}/supplier.csv")
    return tables.csv_tables(spark, folder, ["supplier"], {"supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"})["supplier"]


_add("s08_csv_round_trip", _csv, "SELECT * FROM supplier")

_M = {
    "database": 'let Source = Sql.Database("srv", "shop"), T = Source{[Schema="dbo",Item="Sales"]}[Data] in T',
    "csv": 'let Source = Csv.Document(File.Contents("/data/sales.csv"),[Delimiter=";",Encoding=65001]) in Source',
}


def _m_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for name, text in _M.items():
        r = mquery.extract_source(text).reader()
        rows.append((name, r["format"], r.get("path"), r["options"].get("dbtable"), r["options"].get("sep"), mquery.is_complex(text)))
    return spark.createDataFrame(rows, "name string, format string, path string, dbtable string, sep string, reshapes boolean")


_add("s09_s10_reader_specs", _m_sources, _values([("database", "jdbc", None, "dbo.Sales", None, False), ("csv", "csv", "/data/sales.csv", None, ";", False)], "name, format, path, dbtable, sep, reshapes"))


def _described(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.describe(tables.parquet_tables(spark, sf, ["region", "nation"]))
    return spark.createDataFrame([(t["table"], c, k, t["rows"]) for t in found for c, k in t["columns"]], "table_name string, column_name string, kind string, n long")


_add(
    "s13_introspection",
    _described,
    "SELECT t AS table_name, c AS column_name, k AS kind, n FROM (VALUES ('region','r_regionkey','int'),('region','r_name','string'),('nation','n_nationkey','int'),('nation','n_name','string'),('nation','n_regionkey','int')) x(t, c, k) JOIN (SELECT 'region' AS u, COUNT(*) AS n FROM region UNION ALL SELECT 'nation', COUNT(*) FROM nation) y ON t = u",
)


# ---------------------------------------------------------------- members, labels, order, probes

_HEAD = "SELECT {[Measures].[Net Revenue]} ON 0, "


def _mdx(name: str, text: str, sql: str, **how: Any) -> None:
    _add(name, lambda spark, sf: base._plain(base.cube(spark, sf, **{k: v for k, v in how.items() if k != "user"}).query(text, how.get("user"))), sql)


def _positions(text: str, label: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of an ordered answer with their places, so that order itself is compared."""
    return lambda spark, sf: spark.createDataFrame([(k, r[0]) for k, r in enumerate(base.cube(spark, sf).query(text).collect())], f"place long, {label} string")


_BRANDS = "(SELECT p_brand AS part_brand, {NET} AS net FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"
_add("t04_order_with_places", _positions(_HEAD + "Order([Part Brand].[Part Brand].Members, [Measures].[Net Revenue], DESC) ON 1 FROM [Sales]", "part_brand"), f"SELECT CAST(row_number() OVER (ORDER BY net DESC, part_brand) - 1 AS BIGINT) AS place, part_brand FROM {_BRANDS} t")
_add("t05_label_order_with_places", _positions(_HEAD + "[Part Brand].[Part Brand].Members ON 1 FROM [Sales]", "part_brand"), f"SELECT CAST(row_number() OVER (ORDER BY part_brand) - 1 AS BIGINT) AS place, part_brand FROM {_BRANDS} t")
_mdx("t07_head", _HEAD + "Head([Part Brand].[Part Brand].Members, 4) ON 1 FROM [Sales]", f"SELECT * FROM {_BRANDS} t ORDER BY part_brand LIMIT 4")
_mdx("t07_filter_then_top", _HEAD + "TopCount(Filter([Part Brand].[Part Brand].Members, [Measures].[Quantity] > 0), 3, [Measures].[Quantity]) ON 1 FROM [Sales]", "SELECT part_brand, net FROM (SELECT p_brand AS part_brand, {NET} AS net, {QTY} AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) t WHERE q > 0 ORDER BY q DESC, part_brand LIMIT 3")
_mdx("a08_all_members", "SELECT {[Return Flag].[Return Flag].[(All)].Members} ON 0 FROM [Sales]", "SELECT {NET} AS net FROM lineitem")
_mdx("a06_tuples_of_one_scan", "SELECT {([Measures].[Quantity],[Supplier].[Supplier].[Region].&[ASIA]),([Measures].[Line Count],[Supplier].[Supplier].[Region].&[ASIA],[Return Flag].[Return Flag].&[R]),([Measures].[Quantity],[Return Flag].[Return Flag].&[A])} ON 0 FROM [Sales]", "SELECT CAST(0 AS BIGINT) AS ord, 'qty' AS measure, COALESCE({QTY}, 0.0) AS value FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey WHERE r_name = 'ASIA' UNION ALL SELECT CAST(1 AS BIGINT), 'n_lines', CAST(COUNT(*) AS DOUBLE) FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey WHERE r_name = 'ASIA' AND l_returnflag = 'R' UNION ALL SELECT CAST(2 AS BIGINT), 'qty', {QTY} FROM lineitem WHERE l_returnflag = 'A'")
_mdx("u03_except_over_two_levels", "SELECT {[Measures].[Quantity]} ON 0, Except([Supplier].[Supplier].[Nation].Members, {[Supplier].[Supplier].[Region].&[ASIA],[Supplier].[Supplier].[Nation].&[EUROPE]&[FRANCE]}) ON 1 FROM [Sales]", "SELECT r_name AS region, n_name AS nation, {QTY} AS qty FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey WHERE r_name <> 'ASIA' AND NOT (r_name = 'EUROPE' AND n_name = 'FRANCE') GROUP BY 1, 2")
_mdx("f16_drill_member", "SELECT {[Measures].[Quantity]} ON 0, DrilldownMember({[Supplier].[Supplier].[Region].Members}, {[Supplier].[Supplier].[Region].&[ASIA]}) ON 1 FROM [Sales] WHERE ([Return Flag].[Return Flag].&[R])", "SELECT n_name AS nation, COALESCE({QTY}, 0.0) AS qty FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey WHERE r_name = 'ASIA' AND l_returnflag = 'R' GROUP BY 1")
_mdx("p01_named_members", "SELECT {[Supplier].[Supplier].[Nation].&[ASIA]&[CHINA]} ON 0 FROM [Sales]", "SELECT DISTINCT 'Supplier' AS dimension, 'Nation' AS level, n_name AS member, r_name AS parent FROM {GEO} g WHERE r_name = 'ASIA' AND n_name = 'CHINA'")
_mdx("p02_names_by_text", """WITH MEMBER [Measures].[x] AS 'strtomember("[Return Flag].[Return Flag].&[R]").caption' MEMBER [Measures].[y] AS 'strtomember("[Measures].[Quantity]").UniqueName' SELECT {[Measures].[x],[Measures].[y]} ON 0 FROM [Sales]""", _values([(0, "x", "R"), (1, "y", "[Measures].[Quantity]")], "ord, member, value"))


def _without_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = base.cube(spark, sf)
    c.tables["part"] = c.tables["part"].withColumn("p_brand", F.when(F.col("p_size") >= 10, F.col("p_brand")))
    return base._plain(c.query(_HEAD + "[Part Brand].[Part Brand].Members ON 1 FROM [Sales]"))


_add("f14_null_labels", _without_labels, "SELECT p_brand AS part_brand, {NET} AS net FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 10 GROUP BY 1")
_add("a12_cardinality", lambda spark, sf: cardinality(base.cube(spark, sf), "Supplier", exact=True), "SELECT 'Region' AS level, COUNT(DISTINCT r_name) AS members FROM {GEO} g UNION ALL SELECT 'Nation', COUNT(DISTINCT n_name) FROM {GEO} g UNION ALL SELECT 'Supplier', COUNT(DISTINCT s_name) FROM {GEO} g")
_add("a12_approximate_counts", lambda spark, sf: spark.createDataFrame([(c, n) for c, n in tables.approx_distinct(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_returnflag", "l_linestatus"]).items()], "name string, n long"), "SELECT 'l_returnflag' AS name, COUNT(DISTINCT l_returnflag) AS n FROM lineitem UNION ALL SELECT 'l_linestatus', COUNT(DISTINCT l_linestatus) FROM lineitem")
_add("m09_siblings", lambda spark, sf: siblings(base.cube(spark, sf), "Supplier", ("ASIA", "CHINA")).select("member"), "SELECT DISTINCT n_name AS member FROM {GEO} g WHERE r_name = 'ASIA'")


def _formatted(spark: SparkSession, sf: str) -> DataFrame:
    found = cellset(base.cube(spark, sf), "SELECT {[Measures].[Quantity]} ON 0, [Return Flag].[Return Flag].Members ON 1 FROM [Sales]")
    return spark.createDataFrame([(t[0].unique, c.formatted) for t, c in zip(found.axes[1].tuples, found.cells, strict=True)], "member string, shown string")


_add("x16_cellset_with_totals", _formatted, "SELECT '[Return Flag].[Return Flag].&[' || l_returnflag || ']' AS member, CAST(CAST({QTY} AS BIGINT) AS VARCHAR) AS shown FROM lineitem GROUP BY l_returnflag UNION ALL SELECT '[Return Flag].[Return Flag].[All]', CAST(CAST({QTY} AS BIGINT) AS VARCHAR) FROM lineitem")


def _statement(spark: SparkSession, sf: str) -> DataFrame:
    extra = {**base.CUBE["measures"][0], "id": "late", "caption": "Late Lines", "fallback_sql": "SELECT COUNT(*) FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'", "fallback_capability": "Universal"}
    return base.cube(spark, sf, measures=[*base.CUBE["measures"], extra]).query("SELECT {[Measures].[Late Lines]} ON 0 FROM [Sales]")


_add("a16_statement_measure", _statement, "SELECT CAST(COUNT(*) AS DOUBLE) AS late FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'")


def _refused(spark: SparkSession, sf: str) -> DataFrame:
    """What hidden and filtered tables leave of a drill-through and of the list of dimensions."""
    c = base.cube(spark, sf, **base._roles(("r", "supplier_geo", "", "none")))
    probe = c.query("DRILLTHROUGH SELECT {([Measures].[Quantity],[Supplier].[Supplier].[Region].&[ASIA])} ON 0 FROM [Sales]", User("ada"))
    shown = rowset(c, "MDSCHEMA_DIMENSIONS", user=User("ada")).where("DIMENSION_NAME = 'Supplier'")
    nobody = rowset(c, "MDSCHEMA_DIMENSIONS", user=User("eve"))
    return spark.createDataFrame([(probe.count(), shown.count(), nobody.count())], "rows_seen long, dimensions_seen long, without_role long")


_add("x06_discovery_under_roles", _refused, _values([(0, 0, 0)], "rows_seen, dimensions_seen, without_role"))


# ---------------------------------------------------------------- rowsets


def _rowset(name: str, rows_of: str, columns: dict[str, str], sql: str, where: str = "true", **restrictions: Any) -> None:
    _add(name, lambda spark, sf: rowset(base.cube(spark, sf), rows_of, restrictions or None).where(where).select(*[F.col(c).cast("long" if n.startswith("n_") else "string").alias(n) for n, c in columns.items()]), sql)


_dims = [d["id"] for d in base.CUBE["dimensions"]]
_rowset("r01_cubes", "MDSCHEMA_CUBES", {"catalog": "CATALOG_NAME", "cube": "CUBE_NAME"}, _values([("TRADE", "Sales")], "catalog, cube"))
_rowset("r02_catalogs", "DBSCHEMA_CATALOGS", {"catalog": "CATALOG_NAME"}, _values([("TRADE",)], "catalog"))
_rowset("r03_tables", "DBSCHEMA_TABLES", {"name": "TABLE_NAME", "kind": "TABLE_OLAP_TYPE"}, _values([("lineitem", "CUBE"), ("orders", "CUBE"), ("events", "CUBE"), ("part", "DIMENSION"), ("supplier_geo", "DIMENSION"), ("customer_geo", "DIMENSION"), ("ship_calendar", "DIMENSION"), ("order_calendar", "DIMENSION"), ("event_calendar", "DIMENSION")], "name, kind"))
_rowset("r04_dimensions", "MDSCHEMA_DIMENSIONS", {"name": "DIMENSION_UNIQUE_NAME", "n_place": "DIMENSION_ORDINAL"}, _values([("[Measures]", 0), *[(f"[{d}]", k + 1) for k, d in enumerate(_dims)]], "name, n_place"))
_rowset("r05_hierarchies", "MDSCHEMA_HIERARCHIES", {"name": "HIERARCHY_UNIQUE_NAME", "all_member": "ALL_MEMBER"}, _values([("[Measures]", ""), *[(f"[{d}].[{d}]", f"[{d}].[{d}].[All]") for d in _dims]], "name, all_member"))
_rowset("r06_measures", "MDSCHEMA_MEASURES", {"name": "MEASURE_UNIQUE_NAME", "grp": "MEASUREGROUP_NAME"}, _values([(f"[Measures].[{m['caption']}]", m["fact_table"]) for m in base.CUBE["measures"]], "name, grp"))
_rowset("r07_measure_groups", "MDSCHEMA_MEASUREGROUPS", {"name": "MEASUREGROUP_NAME"}, _values([("line_sales",), ("order_sales",), ("event_log",)], "name"))
_rowset("r08_group_dimensions", "MDSCHEMA_MEASUREGROUP_DIMENSIONS", {"grp": "MEASUREGROUP_NAME", "name": "DIMENSION_UNIQUE_NAME"}, _values([("event_log", "[Event Type]"), ("event_log", "[Event Date]")], "grp, name"), "MEASUREGROUP_NAME = 'event_log'")
_GEO_MEMBER = "SELECT '[Supplier].[Supplier].[Nation].&[' || r_name || ']&[' || n_name || ']' AS name, '[Supplier].[Supplier].[Region].&[' || r_name || ']' AS parent, COUNT(DISTINCT s_name) AS n_children FROM {GEO} g WHERE r_name = 'ASIA' GROUP BY r_name, n_name"
_COLUMNS = {"name": "MEMBER_UNIQUE_NAME", "parent": "PARENT_UNIQUE_NAME", "n_children": "CHILDREN_CARDINALITY"}
_rowset("r09_member_children", "MDSCHEMA_MEMBERS", _COLUMNS, _GEO_MEMBER, MEMBER_UNIQUE_NAME="[Supplier].[Supplier].[Region].&[ASIA]", TREE_OP=1)
_rowset("r10_member_siblings", "MDSCHEMA_MEMBERS", _COLUMNS, _GEO_MEMBER, MEMBER_UNIQUE_NAME="[Supplier].[Supplier].[Nation].&[ASIA]&[CHINA]", TREE_OP=2)
_rowset("r11_member_parent", "MDSCHEMA_MEMBERS", _COLUMNS, "SELECT '[Supplier].[Supplier].[Region].&[ASIA]' AS name, '[Supplier].[Supplier].[All]' AS parent, COUNT(DISTINCT n_name) AS n_children FROM {GEO} g WHERE r_name = 'ASIA' HAVING COUNT(*) > 0", MEMBER_UNIQUE_NAME="[Supplier].[Supplier].[Nation].&[ASIA]&[CHINA]", TREE_OP=4)
_rowset("r12_level_members", "MDSCHEMA_MEMBERS", {"name": "MEMBER_CAPTION", "n_level": "LEVEL_NUMBER"}, "SELECT DISTINCT p_type AS name, CAST(1 AS BIGINT) AS n_level FROM part UNION ALL SELECT 'All', CAST(0 AS BIGINT)", HIERARCHY_UNIQUE_NAME="[Part Type].[Part Type]")
_rowset("r13_model_tables", "TMSCHEMA_TABLES", {"name": "Name"}, _values([(t,) for t in ("lineitem", "orders", "events", "part", "supplier_geo", "customer_geo", "ship_calendar", "order_calendar", "event_calendar")], "name"))
_rowset("r14_enumerators", "DISCOVER_ENUMERATORS", {"name": "ElementName", "value": "ElementValue"}, _values([("CHILDREN", "1"), ("SIBLINGS", "2"), ("PARENT", "4"), ("SELF", "8")], "name, value"))
_rowset("r15_sets_are_empty", "MDSCHEMA_SETS", {"name": "SET_NAME"}, "SELECT 'x' AS name WHERE 1 = 0")
_rowset("r16_literals", "DISCOVER_LITERALS", {"name": "LITERAL_NAME", "value": "LITERAL_VALUE"}, _values([("DBLITERAL_CATALOG_NAME", "TRADE"), ("DBLITERAL_CATALOG_SEPARATOR", "."), ("DBLITERAL_QUOTE_PREFIX", "["), ("DBLITERAL_QUOTE_SUFFIX", "]"), ("DBLITERAL_PASS_THROUGH_COLUMNS", "true")], "name, value"))
_rowset("r17_server_properties", "DISCOVER_PROPERTIES", {"name": "PropertyName", "access": "PropertyAccessType", "value": "Value"}, _values([("Catalog", "ReadWrite", "TRADE"), ("MDXSupport", "Read", "Core"), ("DbpropMsmdActivityID", "ReadWrite", "")], "name, access, value"), "PropertyName IN ('Catalog', 'MDXSupport', 'DbpropMsmdActivityID')")
_rowset("r18_schema_rowsets", "DISCOVER_SCHEMA_ROWSETS", {"name": "SchemaName", "id": "SchemaGuid", "n_mask": "RestrictionsMask"}, _values([("MDSCHEMA_CUBES", "C8B522D8-5CF3-11CE-ADE5-00AA0044773D", 31), ("MDSCHEMA_MEMBERS", "C8B522DE-5CF3-11CE-ADE5-00AA0044773D", 16383)], "name, id, n_mask"), "SchemaName IN ('MDSCHEMA_CUBES', 'MDSCHEMA_MEMBERS')")
_rowset("r19_value_properties", "MDSCHEMA_PROPERTIES", {"name": "PROPERTY_NAME", "level": "LEVEL_UNIQUE_NAME"}, _values([("MEMBER_VALUE", "[Part Type].[Part Type].[(All)]"), ("MEMBER_VALUE", "[Part Type].[Part Type].[Part Type]")], "name, level"), DIMENSION_UNIQUE_NAME="[Part Type]", PROPERTY_TYPE=5)


# ---------------------------------------------------------------- formulas and models

_FORMULAS = {
    "SUM(Sales[Amount])": "simple", "TOTALYTD(SUM(Sales[Amount]), Dates[Date])": "time_ytd", "CALCULATE([Revenue], SAMEPERIODLASTYEAR(Dates[Date]))": "time_prior_year",
    "SUMX(Sales, Sales[Price] * Sales[Units])": "sql_fallback", "MEDIAN(Sales[Amount])": "sql_fallback", "DIVIDE([A], [B], 0)": "simple", "[A] - [B]": "sql_fallback", "DISTINCTCOUNT(Sales[Buyer])": "simple", "42": "simple",
}
_add("m03_formula_classes", lambda spark, sf: spark.createDataFrame([(t, dax.classify(t)) for t in _FORMULAS], "formula string, class string"), _values(_FORMULAS.items(), "formula, class"))


def _foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    frames = {"sales": "sale_id long, product_id long, store_key long, shop_id long", "products": "product_id long, name string", "dim_store": "id long, city string"}
    schemas = {t: spark.createDataFrame([], s).schema for t, s in frames.items()}
    return spark.createDataFrame(automodel.guess_foreign_keys(schemas, "sales"), "fact string, key_column string, dimension string, target string")


_add("j07_guessed_keys", _foreign_keys, _values([("sales", "product_id", "products", "product_id"), ("sales", "store_key", "dim_store", "id")], "fact, key_column, dimension, target"))


def _inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Totals by a label, over a model that was inferred from the tables alone."""
    found = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part")}
    guess = automodel.infer(found, fact="lineitem", foreign_keys=[("lineitem", "l_partkey", "part", "p_partkey")], cardinalities=False)
    m = model_from_dict(guess)
    brand = next(d for d in m.dimensions if d.column == "p_brand")
    measure = next(x for x in m.measures if "l_quantity" in x.sql)
    df = Cube(spark, m, {**found, **automodel.calendars(guess, found, base.AS_OF)}).query(f"SELECT {{[Measures].[{measure.caption}]}} ON 0, [{brand.caption}].[{brand.hierarchy}].Members ON 1 FROM [{m.cube}]")
    return df.toDF("brand", "quantity").withColumn("quantity", F.round("quantity", 2))


_add("m01_inferred_model", _inferred, "SELECT p_brand AS brand, ROUND(SUM(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")


# ---------------------------------------------------------------- rollups that are written and read


def _routed(spark: SparkSession, sf: str) -> Cube:
    """A cube that answers from written rollups of its first fact (by ship date and supplier)."""
    own = {"line_sales", "Ship Date", "Supplier"}
    some = {**base.CUBE, "fact_tables": base.CUBE["fact_tables"][:1], "measures": [m for m in base.CUBE["measures"] if m["fact_table"] == "line_sales"], "relationships": [r for r in base.CUBE["relationships"] if r["dimension_id"] in own]}
    some["dimensions"] = [d for d in base.CUBE["dimensions"] if d["id"] in own or d["fact_table"] == "line_sales"]
    some["measures"] = [m for m in some["measures"] if not m.get("requires")]
    c = Cube(spark, model_from_dict(some), base.tables(spark, sf), calendars=base.CALENDARS)
    rollup.build(c, _shared(spark, "rollups"), stamp="catalogue")
    return c


def _from_rollup(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        df = _routed(spark, sf).query(text)
        if not all("orthoplex-rollups" in f for f in df.inputFiles()):
            raise ValueError("the query was not answered from rollups")
        return base._plain(df)

    return build


_add("r20_written_rollup_total", _from_rollup("SELECT {[Measures].[Net Revenue],[Measures].[Line Count]} ON 0 FROM [Sales]"), "SELECT {NET} AS net, CAST(COUNT(*) AS DOUBLE) AS n_lines FROM lineitem")
_add("r21_written_rollup_months", _from_rollup("SELECT {[Measures].[Net Revenue]} ON 0, [Ship Date].[Ship Date].[Month].Members ON 1 FROM [Sales] WHERE ([Return Flag].[Return Flag].&[R])"), "SELECT {YEAR} AS year, {QTR} AS quarter, {MON} AS month, {NET} AS net FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3")
_add("r22_written_rollup_places", _from_rollup("SELECT {[Measures].[Quantity]} ON 0, [Supplier].[Supplier].[Region].Members ON 1 FROM [Sales]"), "SELECT r_name AS region, {QTY} AS qty FROM lineitem JOIN {GEO} g ON l_suppkey = g.s_suppkey GROUP BY 1")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
