"""Converters, inference, generators, streaming."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from orthoplex.functions import dax
from orthoplex.functions.calendar import calendar, calendar_for
from orthoplex.functions.sqltext import single_aggregate, to_spark
from orthoplex.operators.cube import Cube
from orthoplex.plans.model import model_from_dict
from orthoplex.sources import tabular
from orthoplex.sources.automodel import calendars, guess_foreign_keys, infer
from orthoplex.sources.demo import benchmark_fact, inventory_fact, sales_rows
from orthoplex.sources.mquery import extract_source, is_complex
from orthoplex.streaming.rollup import follow


def lower(text, measures=None):
    return dax.Lowerer(lambda t, c: (f"{'f' if t == 'Sales' else '_' + t.lower()}.{c.lower()}", None if t == "Sales" else t), measures).lower(text)


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("SUM(Sales[Amount])", "SUM(f.amount)"),
        ("= COUNTROWS ( Sales )", "COUNT(*)"),
        ("DISTINCTCOUNT('Sales'[Customer])", "COUNT(DISTINCT f.customer)"),
        ("MEDIAN(Sales[Amount])", "MEDIAN(f.amount)"),
        ('CALCULATE(SUM(Sales[Amount]), Sales[Kind] = "it\'s")', "SUM(f.amount) FILTER (WHERE f.kind = 'it''s')"),
        ("SUMX(Sales, Sales[Quantity] * Sales[Price])", "SUM((f.quantity * f.price))"),
        ("SUMX(FILTER(Sales, Sales[R] = 0 && Sales[Q] > 1), Sales[Q] * RELATED(Product[Cost]))", "SUM((f.q * _product.cost)) FILTER (WHERE (f.r = 0 AND f.q > 1))"),
        ("[A] - [B]", "(COALESCE(SUM(f.a), 0) - COALESCE(SUM(f.b), 0))"),
    ],
)
def test_lowering(text, sql):
    assert lower(text, {"A": "SUM(Sales[A])", "B": "SUM(Sales[B])"}).sql == sql


def test_lowering_of_periods_and_errors():
    assert lower("TOTALYTD(SUM(Sales[A]), 'Date'[Date])").flag == "ytd_flag"
    assert lower("CALCULATE(SUM(Sales[A]), SAMEPERIODLASTYEAR('Date'[Date]))").flag == "prior_year_ytd_flag"
    assert lower("CALCULATE(DISTINCTCOUNT(Sales[A]), FILTER(ALLSELECTED('Date'[Date]), ISONORAFTER('Date'[Date], MAX('Date'[Date]), DESC)))").cumulative is not None
    for text in ("[A]", "RANKX(Sales, [B])", "SUM(Sales[A]"):
        with pytest.raises(dax.Unsupported):
            lower(text, {"A": "[B] + 1", "B": "[A] * 2"})


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("SUM(Sales[A])", "simple"), ("CALCULATE ( SUM ( Sales[A] ), Sales[B] = 1 )", "simple"), ("TOTALYTD(SUM(Sales[A]), D[D])", "time_ytd"), ("CALCULATE([A], SAMEPERIODLASTYEAR(D[D]))", "time_prior_year"),
        ("SUMX(Sales, Sales[A])", "sql_fallback"), ("[A] - [B]", "sql_fallback"), ("DATATABLE(\"x\", STRING, {{1}})", "calculated_table"), ("5", "simple"), ("SELECTEDVALUE(T[x])", "manual"), ("MEDIAN(S[a])", "sql_fallback"), ("CALCULATE([A], ALL(T))", "sql_fallback"),
    ],
)
def test_classes(text, kind):
    assert dax.classify(text) == kind


def test_sql_text():
    assert to_spark("SUM(x::DOUBLE) || 'a::b'") == "SUM(CAST(x AS DOUBLE)) || 'a::b'"
    assert to_spark("CAST(a AS VARCHAR)") == "CAST(a AS STRING)"
    found = single_aggregate("CAST(SUM(a*(1-b)) AS DOUBLE)")
    assert found.text("c") == "CAST(SUM(a*(1-b)) FILTER (WHERE c) AS DOUBLE)" and found.additive
    assert single_aggregate("SUM(a) / SUM(b)") is None and not single_aggregate("COUNT(DISTINCT a)").additive


def test_sources_in_m():
    s = extract_source('let Source = Sql.Database("srv", "db"), T = Source{[Schema="dbo",Item="Sales"]}[Data] in T')
    assert (s.kind, s.server, s.database, s.schema, s.table) == ("sqlserver", "srv", "db", "dbo", "Sales")
    assert s.reader()["options"] == {"url": "jdbc:sqlserver://srv;databaseName=db", "dbtable": "dbo.Sales"}
    q = extract_source('Sql.Database("s", "d", [Query="SELECT 1#(lf)FROM ""t"""])')
    assert q.reader()["options"]["query"] == 'SELECT 1\nFROM "t"'
    c = extract_source('Csv.Document(Web.Contents("https://x/y.csv"),[Delimiter=";", Encoding=1252])')
    assert c.reader() == {"format": "csv", "options": {"header": "true", "sep": ";", "encoding": "windows-1252"}, "path": "https://x/y.csv"}
    assert extract_source('PostgreSQL.Database("p", "d")').kind == "postgresql" and extract_source('MySQL.Database("p", "d")').kind == "mysql"
    assert extract_source("let x = 1 in x") is None and is_complex("Table.Group(Source)") and not is_complex("Source")


BIM = {
    "name": "Shop",
    "model": {
        "tables": [
            {"name": "Sales", "columns": [{"name": "Product Key", "dataType": "int64", "sourceColumn": "product_key"}, {"name": "Date Key", "dataType": "int64", "sourceColumn": "date_key"}, {"name": "Amount", "dataType": "double", "sourceColumn": "amount"}, {"name": "Channel", "dataType": "string", "sourceColumn": "channel"}], "measures": [{"name": "Revenue", "expression": "SUM(Sales[Amount])"}, {"name": "Big", "expression": ["CALCULATE(", "SUM(Sales[Amount]), Sales[Amount] > 500)"]}, {"name": "Odd", "expression": "RANKX(Sales, 1)"}, {"name": "Cost", "expression": "SUMX(Sales, Sales[Amount] * RELATED(Product[Factor]))"}], "partitions": [{"name": "p", "source": {"type": "m", "expression": 'Sql.Database("s","d"){[Schema="dbo",Item="Sales"]}[Data]'}}]},
            {"name": "Product", "columns": [{"name": "Key", "dataType": "int64", "sourceColumn": "key", "isKey": True}, {"name": "Brand", "dataType": "string", "sourceColumn": "brand"}, {"name": "Factor", "dataType": "double", "sourceColumn": "factor"}]},
            {"name": "Date", "dataCategory": "Time", "columns": [{"name": "Date Key", "dataType": "int64", "sourceColumn": "date_key"}, {"name": "Date", "dataType": "dateTime", "sourceColumn": "full_date"}, {"name": "Year", "dataType": "int64", "sourceColumn": "year"}], "hierarchies": [{"name": "Cal", "levels": [{"name": "Year", "ordinal": 0, "column": "Year"}, {"name": "Date", "ordinal": 1, "column": "Date"}]}]},
        ],
        "relationships": [{"fromTable": "Sales", "fromColumn": "Product Key", "toTable": "Product", "toColumn": "Key"}, {"fromTable": "Sales", "fromColumn": "Date Key", "toTable": "Date", "toColumn": "Date Key"}],
        "roles": [{"name": "R", "modelPermission": "read", "members": [{"memberName": "ada"}], "tablePermissions": [{"name": "Sales", "filterExpression": '[Channel] = "Web"'}, {"name": "Product", "metadataPermission": "none"}]}],
    },
}
TMDL = """
/// Sales facts
table Sales
\tcolumn 'Product Key'
\t\tdataType: int64
\t\tsourceColumn: product_key
\tcolumn Amount
\t\tdataType: double
\t\tsourceColumn: amount
\tmeasure 'Total Revenue' =
\t\t\tSUM(Sales[Amount])
\t\tformatString: 0.00
\tmeasure N = COUNTROWS(Sales)
\tpartition Sales = m
\t\tmode: import
\t\tsource =
\t\t\tlet Source = Sql.Database("s", "d") in Source{[Schema="dbo",Item="Sales"]}[Data]
"""


def test_forms_agree(tmp_path):
    bim = tabular.parse_bim(json.dumps(BIM))
    folder = tmp_path / "m"
    for t in BIM["model"]["tables"]:
        (folder / "tables" / t["name"] / "measures").mkdir(parents=True)
        (folder / "tables" / t["name"] / f"{t['name']}.json").write_text(json.dumps({k: v for k, v in t.items() if k != "measures"}))
        for m in t.get("measures", []):
            (folder / "tables" / t["name"] / "measures" / f"{m['name']}.json").write_text(json.dumps(m))
    (folder / "database.json").write_text(json.dumps({"name": "Shop", "model": {k: v for k, v in BIM["model"].items() if k != "tables"}}))
    other = tabular.load(folder)
    assert {t.name for t in other.tables} == {"Sales", "Product", "Date"} and len(other.relationships) == 2
    assert {m.name for m in other.table("Sales").measures} == {m.name for m in bim.table("Sales").measures}
    assert tabular.classify_tables(bim) == {"Sales": "fact", "Product": "dimension", "Date": "date"}


def test_tmdl():
    m = tabular.parse_tmdl([TMDL, "relationship abc\n\tfromColumn: Sales.'Product Key'\n\ttoColumn: Product.Key\n"])
    sales = m.table("Sales")
    assert [(c.name, c.type, c.source) for c in sales.columns] == [("Product Key", "int64", "product_key"), ("Amount", "double", "amount")]
    assert {x.name: x.expression for x in sales.measures} == {"Total Revenue": "SUM(Sales[Amount])", "N": "COUNTROWS(Sales)"}
    assert (sales.partitions[0].kind, sales.partitions[0].mode) == ("m", "import") and extract_source(sales.partitions[0].expression).table == "Sales"
    assert (m.relationships[0].from_column, m.relationships[0].to_table) == ("Product Key", "Product")


def test_converted_model_runs(spark):
    bim = tabular.parse_bim(json.dumps(BIM))
    done = tabular.convert(bim)
    assert {r["measure"]: r["status"] for r in done.report} == {"Revenue": "lowered", "Big": "lowered", "Odd": "manual", "Cost": "lowered"}
    assert tabular.qualify(bim)["verdict"] == "PARTIAL" and tabular.inventory(bim)["sources"] == ["sqlserver"]
    tables = tabular.dummy_tables(spark, bim, 200, 20)
    assert set(tables) == {"sales", "product"} and tables["sales"].where("product_key not between 1 and 20").count() == 0
    tables["date"] = calendar(spark)
    definition = {**done.definition, "roles": []}
    c = Cube(spark, model_from_dict(definition), tables)
    got = {r["Brand"]: r["Cost"] for r in c.query("SELECT {[Measures].[Revenue],[Measures].[Big],[Measures].[Cost]} ON 0, [Brand].[Brand].Members ON 1 FROM [Shop]").collect()}
    want = {r[0]: r[1] for r in tables["sales"].join(tables["product"], tables["sales"].product_key == tables["product"].key).selectExpr("brand", "amount * factor v").groupBy("brand").sum("v").collect()}
    assert got == pytest.approx(want)
    role = done.definition["roles"][0]["table_permissions"]
    assert {p["table"]: p.get("filter_expression", p["metadata_permission"] if "metadata_permission" in p else "") for p in role} == {"product": "none", "sales": "channel = 'Web'"}


def test_inferred_model(spark):
    product = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "id int, name string, category string")
    sales = spark.createDataFrame([(1, 1, "N", 1.5, 2, dt.date(2024, 1, 1)), (2, 2, "S", 2.5, 1, dt.date(2024, 5, 1)), (3, 9, "N", 1.0, 1, dt.date(2025, 1, 1)), (4, 3, "S", 4.0, 4, dt.date(2025, 2, 1))], "order_id int, product_id int, region string, revenue double, units int, order_date date")
    tables = {"product": product, "sales": sales}
    assert guess_foreign_keys({t: d.schema for t, d in tables.items()}, "sales") == [("sales", "product_id", "product", "id")]
    raw = infer(tables)
    assert raw["table_name"] == "sales" and [m["id"] for m in raw["measures"]] == ["revenue", "units"]
    assert [d["id"] for d in raw["dimensions"]] == ["name", "category", "region", "order_date"]
    c = Cube(spark, model_from_dict(raw), tables | calendars(raw, tables, dt.date(2025, 1, 15)))
    assert [tuple(r) for r in c.query("SELECT {[Measures].[revenue]} ON 0, [order_date].[order_date].[Year].Members ON 1 FROM [AutoModel]").collect()] == [("2024", 4.0), ("2025", 5.0)]
    assert [tuple(r) for r in c.query("SELECT {[Measures].[units]} ON 0, [category].[category].Members ON 1 FROM [AutoModel]").collect()] == [("x", 3.0), ("y", 4.0)]
    with pytest.raises(ValueError):
        infer({})


def test_generators(spark):
    rows = sales_rows()
    assert (sum(r[4] for r in rows), sum(r[5] for r in rows), len(rows)) == (521586767.0, 4931640.0, 20000)
    assert inventory_fact(spark, 100).count() == 100 and benchmark_fact(spark, "small").count() == 10_000
    assert benchmark_fact(spark, 1000).exceptAll(benchmark_fact(spark, 1000)).count() == 0


def test_calendar(spark):
    days = calendar(spark, dt.date(2024, 2, 28), dt.date(2024, 3, 1), dt.date(2024, 2, 29)).collect()
    assert [(r.date_key, r.quarter, r.ytd_flag, r.mtd_flag) for r in days] == [(20240228, 1, True, True), (20240229, 1, True, True), (20240301, 1, False, False)]
    assert calendar_for(spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 1, 3),)], "d date"), "d").count() == 3


def test_stream(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1 + k // 10, k % 24), "a" if k % 3 else "b", float(k)) for k in range(50)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() > 0 and done.groupBy("window_start", "key").count().where("count > 1").count() == 0
