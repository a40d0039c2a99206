"""Grammar and resolution: no Spark."""

from __future__ import annotations

import pytest

from orthoplex.plans import mdx
from orthoplex.plans.model import ModelError, model_from_dict
from orthoplex.plans.query import Filter, Group, SetOp
from orthoplex.plans.resolve import resolve
from tests.demo import DEFINITION

MODEL = model_from_dict(DEFINITION)


def q(text, **how):
    return resolve(text, MODEL, **how)


def test_total_from_slicer():
    found = q("SELECT FROM [Sales] WHERE ([Measures].[Revenue])")
    assert (found.kind, found.measures) == ("total", ("Revenue",))


@pytest.mark.parametrize("text", ["select {[measures].[revenue]} on columns from [Sales]", "SELECT [Measures].[Revenue] ON 0 FROM [Sales] CELL PROPERTIES VALUE, FORMAT_STRING"])
def test_keywords_without_case(text):
    assert q(text).measures == ("Revenue",)


def test_drilldown_with_properties():
    found = q("SELECT NON EMPTY Hierarchize({DrilldownLevel({[Territory].[Territory].[All]},,,INCLUDE_CALC_MEMBERS)}) DIMENSION PROPERTIES PARENT_UNIQUE_NAME,[Territory].[Territory].[Territory]MEMBER_CAPTION ON COLUMNS FROM [Sales] WHERE ([Measures].[Units])")
    assert found.groups == (Group("Territory"),) and found.measures == ("Units",)


def test_filters_of_where_and_subselects_are_united():
    found = q("SELECT {[Measures].[Revenue]} ON 0 FROM (SELECT ({[Territory].[Territory].&[South]}) ON COLUMNS FROM [Sales]) WHERE ([Territory].[Territory].&[North],[Segment].[Segment].[All])")
    assert found.filters == (Filter("Territory", None, (("North",), ("South",))),)


def test_nested_subselects_and_default_measure():
    found = q("SELECT [Category].[Category].Members ON 0 FROM (SELECT ({[Channel].[Channel].&[Online]}) ON 0 FROM (SELECT ({[Segment].[Segment].&[Business]}) ON 0 FROM [Sales]))")
    assert {f.dimension for f in found.filters} == {"Channel", "Segment"} and found.measures == ("Revenue",)


@pytest.mark.parametrize(
    ("member", "want"),
    [
        ("[Category].[Category].&[Food]", Filter("Category", None, (("Food",),))),
        ("[Category].[Category].[Food]", Filter("Category", None, (("Food",),))),
        ("[Category].[Category].[Category].&[Food]", Filter("Category", None, (("Food",),))),
        ("[Date].[Date].[Year].&[2024]", Filter("Date", 0, (("2024",),))),
        ("[Date].[Date].[Year].[2024]", Filter("Date", 0, (("2024",),))),
        ("[Date].[Date].[Quarter].&[2026]&[4]", Filter("Date", 1, (("2026", "4"),))),
        ("[Date].[Date].[Month].&[6]", Filter("Date", 2, (("6",),))),
        ("[Category].[Category].&[O]]x]", Filter("Category", None, (("O]x",),))),
    ],
)
def test_member_forms(member, want):
    assert q(f"SELECT {{[Measures].[Revenue]}} ON 0 FROM [Sales] WHERE ({member})").filters == (want,)


def test_too_many_keys_is_an_error():
    with pytest.raises(ModelError):
        q("SELECT {[Measures].[Revenue]} ON 0 FROM [Sales] WHERE ([Date].[Date].[Year].&[2026]&[4])")


def test_drill_path_adds_a_filter_and_a_level():
    found = q("SELECT {[Measures].[Revenue]} ON 0, {DrilldownLevel({[Date].[Date].[Year].&[2024]})} ON 1 FROM [Sales]")
    assert found.groups == (Group("Date", 1),) and found.filters == (Filter("Date", 0, (("2024",),)),)


def test_levels_are_grouped_with_their_ancestors():
    text = "SELECT {[Measures].[Revenue]} ON 0, [Date].[Date].[Quarter].Members ON 1 FROM [Sales]"
    assert q(text).groups == (Group("Date", 1, True),)
    assert q(text, prefix_levels=False).groups == (Group("Date", 1, False),)


def test_set_functions():
    wanted = {
        "TopCount({s}, 12, [Measures].[Units])": SetOp("top", 12, "Units"), "BottomCount({s}, 1)": SetOp("bottom", 1), "TopPercent({s}, 7, [Measures].[Units])": SetOp("percent", 7, "Units"),
        "Order({s}, [Measures].[Units], BDESC)": SetOp("order", 0, "Units", True), "Filter({s}, [Measures].[Units] <> 4)": SetOp("filter", 4, "Units", op="<>"), "Head({s}, 6)": SetOp("head", 6),
    }
    for call, want in wanted.items():
        assert q("SELECT {[Measures].[Revenue]} ON 0, " + call.format(s="{[Channel].[Channel].Members}") + " ON 1 FROM [Sales]").set_ops == (want,)


def test_tuples_and_measure_lists():
    cells = q("SELECT {([Measures].[Revenue],[Territory].[Territory].&[North]),([Measures].[Units],[Territory].[Territory].&[South])} ON 0 FROM [Sales]").cells
    assert [c.measure for c in cells] == ["Revenue", "Units"]
    assert q("SELECT {([Measures].[Revenue]),([Measures].[Units])} ON 0 FROM [Sales]").measures == q("SELECT {[Measures].[Revenue],[Measures].[Units]} ON 0 FROM [Sales]").measures


def test_collapse():
    found = q("SELECT {[Measures].[Units]} ON 0, DrilldownMember(CrossJoin({[Segment].[Segment].[All],[Segment].[Segment].[Segment].AllMembers}, {([Channel].[Channel].[All])}), {-{[Segment].[Segment].&[Consumer]}}, [Channel].[Channel]) ON 1 FROM [Sales]")
    assert [g.dimension for g in found.groups] == ["Segment", "Channel"]
    assert (found.collapse[0].dimension, found.collapse[0].members) == ("Segment", ("Consumer",))


def test_metadata_probes():
    kinds = {"[Measures].[Units].Children": "empty", "[Channel].[Channel].[(All)].Members": "total", "[Channel].[Channel].&[Online]": "members"}
    assert {q(f"SELECT {{{x}}} ON 0 FROM [Sales]").kind == kind for x, kind in kinds.items()} == {True}
    assert q("WITH MEMBER [Measures].[n] AS '[Channel].[Channel].CurrentMember.Children.Count' SELECT {[Measures].[n]} ON 0 FROM [Sales]").kind == "count"


def test_drillthrough():
    found = q("DRILLTHROUGH MAXROWS 7 SELECT {([Measures].[Revenue],[Territory].[Territory].&[North])} ON 0 FROM [Sales]")
    assert (found.kind, found.max_rows, found.filters[0].keys) == ("drillthrough", 7, (("North",),))


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT {[A] ON 0 FROM [S]", "SELECT {[Measures].[Revenue]} ON 9 FROM [Sales]", "SELECT ~ FROM [S]"])
def test_syntax_errors(text):
    with pytest.raises(mdx.MdxError):
        mdx.parse(text)


@pytest.mark.parametrize("text", ["EVALUATE 'Sales'", "define measure Sales[m] = 1 evaluate {[m]}"])
def test_formula_queries_are_refused_by_name(text):
    with pytest.raises(mdx.MdxError, match="DAX"):
        mdx.parse(text)


@pytest.mark.parametrize("text", ["SELECT {[Measures].[Nope]} ON 0 FROM [Sales]", "SELECT [Nope].Members ON 0 FROM [Sales]", "SELECT Linreg([Category].Members) ON 0 FROM [Sales]"])
def test_unknown_names(text):
    with pytest.raises(ModelError):
        q(text)
