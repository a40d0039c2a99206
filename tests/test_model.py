"""Definitions and roles: no Spark."""

from __future__ import annotations

import pytest

from orthoplex.plans.model import ModelError, User, model_from_dict
from orthoplex.plans.security import grant
from tests.demo import DEFINITION


def model(**more):
    return model_from_dict({**DEFINITION, **more})


def test_one_fact_is_made_up():
    m = model()
    assert (m.facts[0].id, m.facts[0].table, m.facts[0].group) == ("default", "sales_fact", "Sales")
    assert m.default_measure().id == "Revenue" and m.default_dimension().id == "Category"
    assert m.find_measure("[Revenue YTD]").id == "RevenueYTD" and m.find_dimension("[Date].[Date]").id == "Date"


@pytest.mark.parametrize("change", [{"dialect": "mysql"}, {"fact_tables": [{"id": "a", "table_name": "t"}]}])
def test_bad_definitions(change):
    with pytest.raises(ModelError):
        model(**change)


def test_missing_key():
    with pytest.raises(ModelError):
        model_from_dict({k: v for k, v in DEFINITION.items() if k != "cube"})


def test_facts_and_compatibility():
    facts = [{"id": i, "source_name": i, "table_name": i, "measure_group_name": i} for i in ("sales", "stock")]
    measures = [{**DEFINITION["measures"][0], "id": i, "caption": i, "fact_table": f} for i, f in (("a", "sales"), ("b", "stock"))]
    dimensions = [{**DEFINITION["dimensions"][0], "id": "W", "caption": "W", "fact_table": "stock"}, {**DEFINITION["dimensions"][1], "shared": True}]
    m = model(fact_tables=facts, measures=measures, dimensions=dimensions, relationships=[])
    assert not m.compatible(m.dimension("W"), m.measure("a")) and m.compatible(m.dimension("W"), m.measure("b"))
    assert m.compatible(m.dimension("Territory"), m.measure("a"))


def test_date_role_takes_its_calendar():
    date = model().date_dimension_of(model().measure("RevenueYTD"))
    assert (date.table, date.key, date.dimension) == ("date_dim", "date_key", "Date")


def roles(*given):
    return [{"name": f"r{k}", "model_permission": p, "members": [{"member_name": m} for m in members], "table_permissions": [{"table": "t", "filter_expression": f, "metadata_permission": x} for f, x in tables]} for k, (p, members, tables) in enumerate(given)]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([("read", ["ada"], [])], ("full", "")),
        ([("read", ["ada"], [("x = 1", "read")])], ("filtered", "x = 1")),
        ([("read", ["ada"], [("x = 1", "read")]), ("read", ["ada"], [("y = 2", "read")])], ("filtered", "(x = 1) OR (y = 2)")),
        ([("read", ["ada"], [("", "none")])], ("hidden", "")),
        ([("read", ["ada"], [("x = 1", "none")])], ("hidden", "")),
        ([("read", ["ada"], [("", "none")]), ("read", ["ada"], [("x = 1", "read")])], ("filtered", "x = 1")),
        ([("read", ["ada"], [("", "none")]), ("read", ["ada"], [("", "read")])], ("full", "")),
        ([("read", ["ada"], [("", "none")]), ("read", ["ada"], [("", "none")])], ("hidden", "")),
        ([("read", ["ada"], [("x = 1", "read")]), ("read", ["ada"], [])], ("full", "")),
        ([("administrator", ["ada"], [("", "none")])], ("full", "")),
        ([("read", ["bob"], [])], ("hidden", "")),
        ([("none", ["ada"], [])], ("hidden", "")),
        ([("read", ["staff"], [("x = 1", "read")])], ("filtered", "x = 1")),
    ],
)
def test_table_access(given, want):
    access = grant(model(auth={}, roles=roles(*given)), User("ada", ("staff",))).table("t")
    assert (access.kind, access.predicate) == want


def test_without_auth_everybody_administers():
    assert grant(model(roles=roles(("read", ["ada"], []))), None).permission == "administrator"
    assert grant(model(auth={}), None).permission == "none"
