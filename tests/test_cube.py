"""The demo star: known totals, invariants, security, rollups, rendering."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from orthoplex.operators import rollup
from orthoplex.operators.cellset import cellset
from orthoplex.operators.cube import Cube
from orthoplex.operators.members import cardinality, child_counts, children, members, siblings
from orthoplex.operators.rowsets import rowset, rowset_names
from orthoplex.operators.series import cumulative
from orthoplex.plans.model import ModelError, User, model_from_dict
from orthoplex.server.xmla import BadRequest, parse_request, respond
from orthoplex.sources.demo import two_dimensions
from tests.demo import DEFINITION, demo_cube


@pytest.fixture(scope="module")
def cube(spark):
    out = demo_cube(spark)
    out.tables["sales_fact"] = out.tables["sales_fact"].cache()
    return out


def value(cube, text, column="Revenue", **how):
    return cube.query(text, **how).first()[column]


def rows(cube, text, **how):
    return [tuple(r) for r in cube.query(text, **how).collect()]


TOTAL = "SELECT {[Measures].[N]} ON 0 FROM [Sales]"
WHERE = "SELECT {{[Measures].[Revenue]}} ON 0 FROM [Sales] WHERE ({})"


@pytest.mark.parametrize(
    ("members", "want"),
    [
        ("[Category].[Category].&[Electronics]", 24719896), ("[Category].[Category].[Electronics]", 24719896), ("[Date].[Date].[Year].&[2020]", 47536588), ("[Date].[Date].[Year].&[2024]", 46223804),
        ("[Date].[Date].[Year].&[2030]", 45853856), ("[Date].[Date].[Quarter].&[2026]&[4]", 12834084), ("[Date].[Date].[Month].&[2026]&[4]&[10]", 4051532), ("[Date].[Date].[Month].&[2026]&[4]&[12]", 4602392),
        ("[Territory].[Territory].[All]", 521586767), ("[Date].[Date].[Year].&[1900]", 0),
    ],
)
def test_known_totals(cube, members, want):
    assert value(cube, WHERE.format(members)) == want


def test_totals_of_two_measures(cube):
    assert rows(cube, "SELECT {[Measures].[Revenue],[Measures].[Units]} ON 0 FROM [Sales]") == [(521586767.0, 4931640.0)]


def test_top_bottom_and_percent(cube):
    def best(call):
        return [v for _, v in rows(cube, f"SELECT {call} ON ROWS, {{[Measures].[Revenue]}} ON COLUMNS FROM [Sales]")]

    every = sorted(best("[Category].[Category].Members"))
    assert every[::-1][:3] == [28502160, 27702858, 27242512] and every[0] == 24440800
    for n in (1, 4, 25):
        assert best(f"TopCount({{[Category].[Category].Members}}, {n}, [Measures].[Revenue])") == every[::-1][:n]
        assert best(f"BottomCount({{[Category].[Category].Members}}, {n}, [Measures].[Revenue])") == every[:n]
    assert sorted(best("TopPercent({[Category].[Category].Members}, 11, [Measures].[Revenue])")) == every[-3:]


def test_drilled_months(cube):
    found = rows(cube, "SELECT {[Measures].[Revenue]} ON 0, {DrilldownLevel({[Date].[Date].[Quarter].&[2026]&[4]})} ON 1 FROM [Sales]")
    assert found == [("10", 4051532.0), ("11", 4180160.0), ("12", 4602392.0)]


def test_cross_join_either_way(cube):
    text = "SELECT {{[Measures].[Revenue]}} ON 0, CrossJoin({}.Members, {}.Members) ON 1 FROM [Sales]"
    one, two = rows(cube, text.format("[Category].[Category]", "[Territory].[Territory]")), rows(cube, text.format("[Territory].[Territory]", "[Category].[Category]"))
    assert len(one) == 40 and sorted(one) == sorted((b, a, v) for a, b, v in two)
    assert sum(v for *_, v in one) == 521586767


def test_quarters_add_up_and_merge(cube):
    text = "SELECT {[Measures].[Revenue]} ON 0, [Date].[Date].[Quarter].Members ON 1 FROM [Sales]"
    prefixed = rows(cube, text)
    assert len(prefixed) == 44 and sum(v for *_, v in prefixed) == 521586767
    merged = Cube(cube.spark, cube.model, cube.tables, calendars=cube.calendars, prefix_levels=False)
    assert [k for k, _ in rows(merged, text)] == ["1", "2", "3", "4"]


def test_flags_follow_the_given_day(cube):
    got = rows(cube, "SELECT {[Measures].[Revenue YTD],[Measures].[Revenue QTD],[Measures].[Revenue MTD],[Measures].[Revenue Prior]} ON 0 FROM [Sales]")[0]
    fact = cube.table("sales_fact")
    between = lambda a, b: float(fact.where(F.col("date_key").between(a, b)).agg(F.sum("revenue")).first()[0])
    assert got == (between(20260101, 20260520), between(20260401, 20260520), between(20260501, 20260520), between(20250101, 20250520))


def test_flag_beside_plain_measure_keeps_groups(cube):
    found = rows(cube, "SELECT {[Measures].[Revenue],[Measures].[Revenue MTD]} ON 0, [Date].[Date].[Year].Members ON 1 FROM [Sales]")
    assert len(found) == 11 and sum(v > 0 for *_, v in found) == 1


def test_collapse_sums_the_partner(cube):
    text = "SELECT {[Measures].[Revenue]} ON 0, DrilldownMember(CrossJoin({[Channel].[Channel].[All],[Channel].[Channel].[Channel].AllMembers}, {([Segment].[Segment].[All])}), {-{[Channel].[Channel].&[Online]}}, [Segment].[Segment]) ON 1 FROM [Sales]"
    found = rows(cube, text)
    own = [r for r in found if r[0] == "Online"]
    assert own == [("Online", "All", value(cube, WHERE.format("[Channel].[Channel].&[Online]")))] and len(found) > 5
    assert sum(v for *_, v in found) == 521586767


def test_tuple_set(cube):
    found = rows(cube, "SELECT {([Measures].[Units],[Segment].[Segment].[All]),([Measures].[Revenue],[Date].[Date].[Year].&[2020]),([Measures].[Revenue],[Date].[Date].[Year].&[2030])} ON 0 FROM [Sales]")
    assert [(o, v) for o, _, v in found] == [(0, 4931640.0), (1, 47536588.0), (2, 45853856.0)]


def test_count_ignores_nulls_and_absent_members(cube):
    for dimension, want in (("Segment", 5), ("Channel", 4), ("Category", 20)):
        text = f"WITH MEMBER [Measures].[n] AS '[{dimension}].[{dimension}].CurrentMember.Children.Count' SELECT {{[Measures].[n]}} ON 0 FROM [Sales]"
        assert cube.query(text).first()[0] == want


def test_two_dimension_cube(spark):
    dims = [{**DEFINITION["dimensions"][0], "id": i, "caption": i, "physical_field": c, "hierarchy_name": i} for i, c in (("Kategori", "produktkategori"), ("Region", "region"))]
    m = model_from_dict({**DEFINITION, "dimensions": dims, "relationships": [], "measures": [{**DEFINITION["measures"][0], "id": "Sales", "caption": "Sales", "sql_expr": "SUM(sales)"}], "time_intelligence": None, "table_name": "t", "source_name": "t"})
    c = Cube(spark, m, {"t": two_dimensions(spark)})
    assert value(c, "SELECT {[Measures].[Sales]} ON 0 FROM [S] WHERE ([Region].[Region].&[North])", "Sales") == 650000
    assert value(c, "SELECT {[Measures].[Sales]} ON 0 FROM [S]", "Sales") == 1250500.5


def test_null_labels_and_orphans_are_dropped(spark):
    m = model_from_dict(DEFINITION)
    fact = spark.createDataFrame([("A", None, "x", "y", 1.0, 1.0, 20240101), (None, "T", "x", "y", 2.0, 1.0, 19000101)], "category string, territory string, channel string, segment string, revenue double, units double, date_key int")
    c = demo_cube(spark)
    c.tables["sales_fact"] = fact
    assert rows(c, "SELECT {[Measures].[Revenue]} ON 0, [Category].[Category].Members ON 1 FROM [Sales]") == [("A", 1.0)]
    assert rows(c, "SELECT {[Measures].[Revenue]} ON 0, [Date].[Date].[Year].Members ON 1 FROM [Sales]") == [("2024", 1.0)]
    assert m.cube == "Sales"


def roles(*tables):
    return {"auth": {}, "roles": [{"name": "r", "members": [{"member_name": "ada"}], "table_permissions": [{"table": t, "filter_expression": f, "metadata_permission": p} for t, f, p in tables]}]}


def test_row_filters_reach_everything(spark, cube):
    c = demo_cube(spark, **roles(("sales_fact", "f.territory = 'North'", "read")))
    c.tables = cube.tables
    ada, want = User("ada"), value(cube, WHERE.format("[Territory].[Territory].&[North]"))
    assert value(c, "SELECT FROM [Sales] WHERE ([Measures].[Revenue])", user=ada) == want
    assert [k for k, _ in rows(c, "SELECT [Territory].[Territory].Members ON 0 FROM [Sales]", user=ada)] == ["North"]
    assert {r.territory for r in c.query("DRILLTHROUGH SELECT {[Measures].[Revenue]} ON 0 FROM [Sales]", ada).collect()} == {"North"}
    assert [r.member for r in members(c, "Territory", user=ada).collect()] == ["North"]
    assert rows(c, "SELECT [Territory].[Territory].Members ON 0 FROM [Sales]", user=User("eve")) == []


def test_dimension_filters_and_hidden_tables(spark, cube):
    ada = User("ada")
    c = demo_cube(spark, **roles(("date_dim", "_date.year = 2024", "read")))
    assert value(c, "SELECT FROM [Sales] WHERE ([Measures].[Revenue])", user=ada) == 46223804
    hidden = demo_cube(spark, **roles(("date_dim", "", "none")))
    assert rows(hidden, "SELECT {[Measures].[Revenue]} ON 0, [Date].[Date].[Year].Members ON 1 FROM [Sales]", user=ada) == []
    assert rowset(hidden, "MDSCHEMA_DIMENSIONS", user=ada).where("DIMENSION_NAME = 'Date'").count() == 0


def test_rollups_answer_alike_and_respect_filters(spark, cube, tmp_path):
    routed = Cube(spark, cube.model, cube.tables, calendars=cube.calendars)
    built = rollup.build(routed, str(tmp_path))
    assert [r.design.level for r in built] == [0, 1, 2]
    files = lambda: sorted((p.name, p.stat().st_mtime_ns) for p in tmp_path.rglob("part-*"))
    before = files()
    rollup.build(routed, str(tmp_path))
    assert files() == before
    built = rollup.build(routed, str(tmp_path), stamp="new data")
    assert files() != before
    for text in (
        "SELECT FROM [Sales] WHERE ([Measures].[Revenue])",
        "SELECT {[Measures].[Revenue],[Measures].[Units]} ON 0, [Date].[Date].[Quarter].Members ON 1 FROM [Sales] WHERE ([Channel].[Channel].&[Online])",
        "SELECT {[Measures].[Revenue]} ON 0, {DrilldownLevel({[Date].[Date].[Quarter].&[2026]&[4]})} ON 1 FROM [Sales]",
        "SELECT {[Measures].[Revenue]} ON 0, [Territory].[Territory].Members ON 1 FROM [Sales] WHERE ([Date].[Date].[Year].&[2024])",
    ):
        assert rows(routed, text) == rows(cube, text)
        assert "agg_default_date" in routed.query(text)._jdf.queryExecution().optimizedPlan().toString() or "agg_default_date" in str(routed.query(text).inputFiles())
    secured = demo_cube(spark, **roles(("sales_fact", "f.territory = 'North'", "read")))
    secured.rollups = built
    assert value(secured, "SELECT FROM [Sales] WHERE ([Measures].[Revenue])", user=User("ada")) == value(cube, WHERE.format("[Territory].[Territory].&[North]"))
    with pytest.raises(rollup.RollupError):
        rollup.validate(cube, [rollup.Rollup(built[0].design, built[0].data.withColumn("Revenue", F.lit(1.0)))])


def test_ancestor_totals_of_a_distinct_count(spark, cube):
    c = demo_cube(spark, measures=[*DEFINITION["measures"], {**DEFINITION["measures"][0], "id": "Cats", "caption": "Cats", "sql_expr": "COUNT(DISTINCT category)"}])
    found = c.totals("Date", 0, ["Cats"]).collect()
    assert max(r.Cats for r in found) == 20 and sum(r.lvl for r in found) == 1


def test_members_and_counts(cube):
    assert [r.member for r in children(cube, "Date", ("2024",)).collect()] == ["1", "2", "3", "4"]
    assert siblings(cube, "Date", ("2024", "1")).count() == 4 and children(cube, "Category", ("Food",)).count() == 0
    assert {r.children for r in child_counts(cube, "Date", 0).collect()} == {4}
    assert cardinality(cube, "Date", exact=True).where("level = 'Month'").first().members == 12


def test_cumulative(cube):
    found = cumulative(cube, "Revenue", "Date", 1, year=2024).collect()
    assert found[-1].running == 46223804 and [r.Quarter for r in found] == ["1", "2", "3", "4"]


def test_fallback_statements(spark, cube):
    def with_measure(capability):
        extra = {**DEFINITION["measures"][0], "id": "N", "caption": "N", "fallback_sql": "SELECT COUNT(*) FROM sales_fact", "fallback_capability": capability}
        return demo_cube(spark, measures=[*DEFINITION["measures"], extra])

    c = with_measure("ScalarOnly")
    assert rows(c, TOTAL) == [(20000.0,)]
    for text in ("SELECT {[Measures].[Revenue],[Measures].[N]} ON 0, [Channel].[Channel].Members ON 1 FROM [Sales]", TOTAL + " WHERE ([Channel].[Channel].&[Online])"):
        with pytest.raises(ModelError):  # an error, not a zero that looks like a value
            rows(c, text)
    with pytest.raises(ModelError):
        rows(with_measure("nonsense"), TOTAL)


def test_statements_keep_to_access_rules(spark):
    extra = [*DEFINITION["measures"], {**DEFINITION["measures"][0], "id": "N", "caption": "N", "fallback_sql": "WITH t AS (SELECT '{}' AS x, * FROM sales_fact) SELECT COUNT(*) FROM t", "fallback_capability": "Universal"}]
    assert rows(demo_cube(spark, measures=extra), TOTAL) == [(20000.0,)]
    hidden = demo_cube(spark, measures=extra, **roles(("sales_fact", "", "none")))
    assert rows(hidden, TOTAL, user=User("ada")) == [] and rows(hidden, TOTAL, user=User("eve")) == []
    for table, predicate, permission in (("date_dim", "_date.year = 2024", "read"), ("sales_fact", "f.channel = 'Online'", "read"), ("date_dim", "", "none")):
        with pytest.raises(ModelError):
            rows(demo_cube(spark, measures=extra, **roles((table, predicate, permission))), TOTAL, user=User("ada"))


def test_statements_of_two_cubes_stay_apart(spark):
    extra = [*DEFINITION["measures"], {**DEFINITION["measures"][0], "id": "N", "caption": "N", "fallback_sql": "SELECT COUNT(*) FROM Sales_Fact", "fallback_capability": "Universal"}]
    a, b = demo_cube(spark, measures=extra), demo_cube(spark, measures=extra)
    b.tables["sales_fact"] = b.tables["sales_fact"].limit(7)
    first = a.query(TOTAL)
    assert rows(b, TOTAL) == [(7.0,)] and first.first()[0] == 20000 and not spark.catalog.tableExists("sales_fact")


def test_drillthrough_does_not_probe_hidden_dimensions(spark):
    c = demo_cube(spark, **roles(("date_dim", "", "none")))
    assert c.query("DRILLTHROUGH SELECT {([Measures].[Revenue],[Date].[Date].[Year].&[2024])} ON 0 FROM [Sales]", User("ada")).count() == 0
    assert c.query("DRILLTHROUGH MAXROWS 3 SELECT {[Measures].[Revenue]} ON 0 FROM [Sales]", User("ada")).count() == 3


def test_named_members_keep_their_path(cube):
    assert [(r.parent, r.member) for r in cube.query("SELECT {[Date].[Date].[Quarter].&[2024]&[3]} ON 0 FROM [Sales]").collect()] == [("2024", "3")]


def test_head_and_unsupported_functions(cube):
    head = "SELECT {{[Measures].[Units]}} ON 0, {} ON 1 FROM [Sales]"
    assert [r[0] for r in rows(cube, head.format("Head([Channel].[Channel].Members, 2)"))] == [r[0] for r in rows(cube, head.format("[Channel].[Channel].Members"))][:2]
    assert len(rows(cube, head.format("Head([Channel].[Channel].Members)"))) == 1
    for text in ("Generate([Channel].[Channel].Members, [Segment].[Segment].Members)", "VisualTotals([Channel].[Channel].Members)"):
        with pytest.raises(ModelError):
            cube.query(head.format(text))
    with pytest.raises(ModelError):
        cube.query("WITH MEMBER [Measures].[Twice] AS '[Measures].[Revenue] * 2' SELECT {[Measures].[Twice]} ON 0 FROM [Sales]")


def test_except_over_two_levels(cube):
    text = "SELECT {[Measures].[Units]} ON 0, Except([Date].[Date].[Quarter].Members, {[Date].[Date].[Year].&[2024],[Date].[Date].[Quarter].&[2025]&[2]}) ON 1 FROM [Sales]"
    found = {r[:2] for r in rows(cube, text)}
    assert len(found) == 44 - 4 - 1 and not any(y == "2024" for y, _ in found) and ("2025", "2") not in found and ("2026", "2") in found


def test_names_asked_for_by_text(cube):
    text = """WITH MEMBER [Measures].[A0] AS 'strtomember("[Segment].[Segment].&[Consumer]").UniqueName' MEMBER [Measures].[A1] AS 'strtomember("[Segment].[Segment].&[Consumer]").caption' MEMBER [Measures].[A2] AS 'strtomember("[Measures].[Units]").level.UniqueName' SELECT {[Measures].[A0],[Measures].[A1],[Measures].[A2]} ON 0 FROM [Sales]"""
    want = ["[Segment].[Segment].&[Consumer]", "Consumer", "[Measures].[MeasuresLevel]"]
    assert [r.value for r in cube.query(text).orderBy("ord").collect()] == want and [c.value for c in cellset(cube, text).cells] == want


def test_a_tuple_set_is_one_scan(cube):
    cells = ["([Measures].[Units],[Date].[Date].[Year].&[2023])", "([Measures].[Revenue],[Channel].[Channel].&[Online])", "([Measures].[Revenue],[Date].[Date].[Quarter].&[2023]&[1],[Channel].[Channel].&[Online])", "([Measures].[Revenue],[Date].[Date].[Year].&[1900])"]
    df = cube.query(f"SELECT {{{','.join(cells)}}} ON 0 FROM [Sales]")
    alone = [cube.query(f"SELECT {{{c}}} ON 0 FROM [Sales]").first()[0] for c in cells]
    assert [r.value for r in df.collect()] == alone and alone[-1] == 0
    assert df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") <= 2


def test_every_rowset(cube):
    for name in rowset_names():
        if name != "MDSCHEMA_MEMBERS":
            rowset(cube, name).collect()
    for op, want in ((1, 4), (8, 1), (9, 5), (2, 11), (4, 1)):
        assert rowset(cube, "MDSCHEMA_MEMBERS", {"MEMBER_UNIQUE_NAME": "[Date].[Date].[Year].&[2024]", "TREE_OP": op}).count() == want
    assert rowset(cube, "MDSCHEMA_MEMBERS", {"HIERARCHY_UNIQUE_NAME": "[Channel].[Channel]"}).count() == 5
    with pytest.raises(KeyError):
        rowset(cube, "NOPE")


def test_discovery_rowsets(cube):
    schemas = {r.SchemaName: r for r in rowset(cube, "DISCOVER_SCHEMA_ROWSETS").collect()}
    assert sorted(schemas) == sorted(rowset_names()) and len({r.SchemaGuid for r in schemas.values()}) == len(schemas)
    levels = schemas["MDSCHEMA_LEVELS"]
    assert levels.RestrictionsMask == 1023 and [(x.Name, x.Type) for x in levels.Restrictions][-1] == ("LEVEL_VISIBILITY", "xsd:unsignedShort")
    assert rowset(cube, "DISCOVER_PROPERTIES").count() == 14 and rowset(cube, "DISCOVER_PROPERTIES", {"PropertyName": "Catalog"}).first().Value == cube.model.catalog
    assert [r.LITERAL_VALUE for r in rowset(cube, "DISCOVER_LITERALS", {"LiteralName": "DBLITERAL_QUOTE_PREFIX"}).collect()] == ["["]
    kinds = lambda **by: {r.PROPERTY_TYPE for r in rowset(cube, "MDSCHEMA_PROPERTIES", by).collect()}
    assert kinds() == {2, 5} and [kinds(PROPERTY_TYPE=k) for k in (1, 2, 5, 9)] == [{1}, {2}, {5}, set()]
    assert rowset(cube, "MDSCHEMA_KPIS").columns[3] == "KPI_NAME" and rowset(cube, "MDSCHEMA_SETS").count() == 0
    assert "LEVEL_NUMBER" in rowset(cube, "MDSCHEMA_LEVELS", {"LEVEL_NAME": "nope"}).columns


def test_nested_rowset_columns_repeat_their_element(cube):
    body = "<Discover xmlns='urn:schemas-microsoft-com:xml-analysis'><RequestType>DISCOVER_SCHEMA_ROWSETS</RequestType><Restrictions><RestrictionList><SchemaName>TMSCHEMA_TABLES</SchemaName></RestrictionList></Restrictions></Discover>"
    answer = respond(cube, soap(body))
    ET.fromstring(answer)
    assert answer.count("<row>") == 1 and "<Restrictions><Name>ID</Name><Type>xsd:long</Type></Restrictions><Restrictions><Name>Name</Name>" in answer


def test_cellset_shape(cube):
    found = cellset(cube, "SELECT {[Measures].[Revenue],[Measures].[Units]} ON 0, [Date].[Date].[Year].Members ON 1 FROM [Sales]")
    assert [len(a.tuples) for a in found.axes] == [2, 12] and len(found.cells) == 24
    assert found.axes[1].tuples[0][0].unique == "[Date].[Date].[All]" and found.axes[1].tuples[0][0].info & 0xFFFF == 11
    assert [m.hierarchy for m in found.slicer.tuples[0]][0] == "[Category].[Category]"
    assert found.cells[0].value == 521586767 and found.cells[0].formatted == "521586767"


def soap(body):
    return f'<Envelope xmlns="http://schemas.xmlsoap.org/soap/envelope/"><Body>{body}</Body></Envelope>'


def test_requests_and_answers(cube):
    execute = "<Execute xmlns='urn:schemas-microsoft-com:xml-analysis'><Command><Statement>{}</Statement></Command></Execute>"
    for statement in ("SELECT {[Measures].[Revenue]} ON 0, [Channel].[Channel].Members ON 1 FROM [Sales]", "DRILLTHROUGH MAXROWS 2 SELECT {[Measures].[Revenue]} ON 0 FROM [Sales]", ""):
        ET.fromstring(respond(cube, soap(execute.format(statement))))
    assert "Fault" in respond(cube, soap(execute.format("SELECT nonsense"))) and "Fault" in respond(cube, "<a>")
    discover = "<Discover xmlns='urn:schemas-microsoft-com:xml-analysis'><RequestType>MDSCHEMA_LEVELS</RequestType></Discover>"
    assert respond(cube, soap(discover)).count("<row>") == 14
    with pytest.raises(BadRequest):
        parse_request("<!DOCTYPE x><a/>")


def test_unknown_table_raises(spark):
    c = Cube(spark, model_from_dict(DEFINITION), {})
    with pytest.raises(ModelError):
        c.query("SELECT FROM [Sales] WHERE ([Measures].[Revenue])")


def test_dimension_size_decides_the_join(spark, cube):
    text = "SELECT {[Measures].[Revenue]} ON 0, [Date].[Date].[Year].Members ON 1 FROM [Sales]"

    def joins(limit):
        c = Cube(spark, cube.model, cube.tables, broadcast_bytes=limit)
        df = c.query(text)
        assert [tuple(r) for r in df.collect()] == rows(cube, text)
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "rightHint=(strategy=broadcast)" in joins(64 << 20) and "strategy=broadcast" not in joins(0)


def test_periods_reach_the_scan(spark, cube, tmp_path):
    cube.table("sales_fact").write.parquet(str(tmp_path / "sales"))
    c = Cube(spark, cube.model, {**cube.tables, "sales_fact": spark.read.parquet(str(tmp_path / "sales"))}, calendars=cube.calendars)
    df = c.query(WHERE.format("[Date].[Date].[Year].&[2024]"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_key,20240101)" in plan and "LessThanOrEqual(date_key,20241231)" in plan and df.first()[0] == 46223804
    assert value(c, WHERE.format("[Date].[Date].[Year].&[1900]")) == 0
