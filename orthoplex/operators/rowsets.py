"""Metadata rowsets as DataFrames, all but the members from the definition alone.

Unlike a plain dump of the definition they honour the asker's roles: what is hidden
from a user is not listed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplex.operators.cube import Cube
from orthoplex.operators.members import members
from orthoplex.plans.model import Dimension, User
from orthoplex.plans.query import Filter
from orthoplex.plans.security import Grant, grant

# Codes of the OLE DB for OLAP specification.
REGULAR, TIME, MEASURE = 3, 1, 2
LEVEL_ALL, LEVEL_REGULAR = 1, 0
TIME_LEVELS = {"year": 20, "quarter": 68, "month": 84, "week": 132, "date": 96, "day": 96}
MEMBER_REGULAR, MEMBER_ALL, MEMBER_MEASURE = 1, 2, 3
TREE_CHILDREN, TREE_SIBLINGS, TREE_PARENT, TREE_SELF = 1, 2, 4, 8
KEYWORDS = "SELECT FROM WHERE ON COLUMNS ROWS NON EMPTY WITH MEMBER SET MEMBERS ALLMEMBERS CHILDREN CROSSJOIN HIERARCHIZE DRILLDOWNLEVEL DRILLDOWNMEMBER ADDCALCULATEDMEMBERS TOPCOUNT BOTTOMCOUNT TOPPERCENT ORDER FILTER EXCEPT UNION DESCENDANTS GENERATE CELL DIMENSION PROPERTIES DRILLTHROUGH MAXROWS".split()
# Properties of members and of cells, with their content types.
MEMBER_PROPERTIES = {"MEMBER_CAPTION": 0, "MEMBER_NAME": 0, "MEMBER_UNIQUE_NAME": 1, "MEMBER_KEY": 1, "MEMBER_TYPE": 0, "MEMBER_VALUE": 0, "LEVEL_NUMBER": 0, "LEVEL_UNIQUE_NAME": 1, "PARENT_LEVEL": 0, "PARENT_UNIQUE_NAME": 1, "PARENT_COUNT": 0, "CHILDREN_CARDINALITY": 0}
MEASURE_PROPERTIES = ("MEMBER_CAPTION", "MEMBER_NAME", "MEMBER_UNIQUE_NAME", "MEMBER_VALUE")
CELL_PROPERTIES = {"VALUE": 0, "FORMATTED_VALUE": 1, "FORMAT_STRING": 2, "FORE_COLOR": 2, "BACK_COLOR": 2, "FONT_NAME": 2, "FONT_SIZE": 2, "CELL_ORDINAL": 0}
OF_MEMBER, OF_CELL, OF_VALUE = 1, 2, 5
# Properties of the server: name, type, writable, value (None: the model's or none).
SERVER_PROPERTIES = [
    ("ProviderName", "string", False, "orthoplex"),
    ("DbpropMsmdSubqueries", "int", True, "2"),
    ("DbpropMsmdOptimizeResponse", "long", True, "9"),
    ("DbpropMsmdActivityID", "string", True, None),
    ("DbpropMsmdCurrentActivityID", "string", True, None),
    ("ApplicationContext", "string", True, None),
    ("Catalog", "string", True, None),
    ("ServerName", "string", False, "orthoplex"),
    ("ProviderVersion", "string", False, "16.0.0.0"),
    ("MdpropMdxSubqueries", "int", False, "63"),
    ("MdpropMdxDrillFunctions", "int", False, "7"),
    ("MdpropMdxNamedSets", "int", False, "15"),
    ("MdpropMdxDdlExtensions", "int", False, "23"),
    ("MDXSupport", "string", False, "Core"),
]
# Each rowset's identifier and the columns that may restrict it.
SCHEMAS = {
    "DBSCHEMA_CATALOGS": ("C8B52211-5CF3-11CE-ADE5-00AA0044773D", "CATALOG_NAME"),
    "DBSCHEMA_TABLES": ("C8B52229-5CF3-11CE-ADE5-00AA0044773D", "TABLE_CATALOG TABLE_SCHEMA TABLE_NAME TABLE_TYPE TABLE_OLAP_TYPE"),
    "MDSCHEMA_CUBES": ("C8B522D8-5CF3-11CE-ADE5-00AA0044773D", "CATALOG_NAME SCHEMA_NAME CUBE_NAME CUBE_SOURCE BASE_CUBE_NAME"),
    "MDSCHEMA_DIMENSIONS": ("C8B522D9-5CF3-11CE-ADE5-00AA0044773D", "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_NAME DIMENSION_UNIQUE_NAME CUBE_SOURCE DIMENSION_VISIBILITY"),
    "MDSCHEMA_HIERARCHIES": ("C8B522DA-5CF3-11CE-ADE5-00AA0044773D", "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_UNIQUE_NAME HIERARCHY_NAME HIERARCHY_UNIQUE_NAME HIERARCHY_ORIGIN CUBE_SOURCE HIERARCHY_VISIBILITY"),
    "MDSCHEMA_LEVELS": ("C8B522DB-5CF3-11CE-ADE5-00AA0044773D", "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_UNIQUE_NAME HIERARCHY_UNIQUE_NAME LEVEL_NAME LEVEL_UNIQUE_NAME LEVEL_ORIGIN CUBE_SOURCE LEVEL_VISIBILITY"),
    "MDSCHEMA_MEASURES": ("C8B522DC-5CF3-11CE-ADE5-00AA0044773D", "CATALOG_NAME SCHEMA_NAME CUBE_NAME MEASURE_NAME MEASURE_UNIQUE_NAME MEASUREGROUP_NAME CUBE_SOURCE MEASURE_VISIBILITY"),
    "MDSCHEMA_PROPERTIES": ("C8B522DD-5CF3-11CE-ADE5-00AA0044773D", "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_UNIQUE_NAME HIERARCHY_UNIQUE_NAME LEVEL_UNIQUE_NAME MEMBER_UNIQUE_NAME PROPERTY_NAME PROPERTY_TYPE PROPERTY_CONTENT_TYPE PROPERTY_ORIGIN CUBE_SOURCE PROPERTY_VISIBILITY"),
    "MDSCHEMA_MEMBERS": ("C8B522DE-5CF3-11CE-ADE5-00AA0044773D", "CATALOG_NAME SCHEMA_NAME CUBE_NAME DIMENSION_UNIQUE_NAME HIERARCHY_UNIQUE_NAME LEVEL_UNIQUE_NAME LEVEL_NUMBER MEMBER_NAME MEMBER_UNIQUE_NAME MEMBER_CAPTION MEMBER_TYPE TREE_OP CUBE_SOURCE SCOPE"),
    "MDSCHEMA_SETS": ("A07CCD0B-8148-11D0-87BB-00C04FC33942", "CATALOG_NAME SCHEMA_NAME CUBE_NAME SET_NAME SCOPE HIERARCHY_UNIQUE_NAME CUBE_SOURCE SET_EVALUATION_CONTEXT"),
    "MDSCHEMA_KPIS": ("2AE44109-ED3D-4842-B16F-B694D1CB0E3F", "CATALOG_NAME SCHEMA_NAME CUBE_NAME KPI_NAME CUBE_SOURCE SCOPE"),
    "MDSCHEMA_MEASUREGROUPS": ("E1625EBF-FA96-42FD-BEA6-DB90ADAFD96B", "CATALOG_NAME SCHEMA_NAME CUBE_NAME MEASUREGROUP_NAME"),
    "MDSCHEMA_MEASUREGROUP_DIMENSIONS": ("A07CCD33-8148-11D0-87BB-00C04FC33942", "CATALOG_NAME SCHEMA_NAME CUBE_NAME MEASUREGROUP_NAME DIMENSION_UNIQUE_NAME DIMENSION_VISIBILITY"),
    "DISCOVER_DATASOURCES": ("06C03D41-F66D-49F3-B1B8-987F7AF4CF18", "DataSourceName URL ProviderName ProviderType AuthenticationMode"),
    "DISCOVER_PROPERTIES": ("4B40ADFB-8B09-4758-97BB-636E8AE97BCF", "PropertyName"),
    "DISCOVER_SCHEMA_ROWSETS": ("EEA0302B-7922-4992-8991-0E605D0E5593", "SchemaName"),
    "DISCOVER_ENUMERATORS": ("55A9E78B-ACCB-45B4-95A6-94C5065617A7", "EnumName"),
    "DISCOVER_KEYWORDS": ("1426C443-4CDD-4A40-8F45-572FAB9BBAA1", "Keyword"),
    "DISCOVER_LITERALS": ("C3EF5ECB-0A07-4665-A140-B075722DBDC2", "LiteralName"),
    "DISCOVER_XML_METADATA": ("3444B255-171E-4CB9-AD98-19E57888A75F", "DatabaseID DimensionID CubeID MeasureGroupID PartitionID PerspectiveID DimensionPermissionID RoleID DatabasePermissionID MiningModelID MiningModelPermissionID DataSourceID MiningStructureID AggregationDesignID TraceID MiningStructurePermissionID CubePermissionID AssemblyID MdxScriptID DataSourceViewID DataSourcePermissionID CalculatedColumns ObjectExpansion DBWorkloadGroupID ResourcePoolID ModifiedAfter"),
    "TMSCHEMA_MODEL": ("F1B5C3AB-7CD1-4F77-89A8-9DE3D0C9DBC0", "ID"),
    "TMSCHEMA_TABLES": ("F1B5C3AC-7CD1-4F77-89A8-9DE3D0C9DBC0", "ID Name"),
    "TMSCHEMA_COLUMNS": ("F1B5C3AD-7CD1-4F77-89A8-9DE3D0C9DBC0", "ID TableID"),
    "TMSCHEMA_MEASURES": ("F1B5C3AE-7CD1-4F77-89A8-9DE3D0C9DBC0", "ID TableID"),
    "TMSCHEMA_HIERARCHIES": ("F1B5C3AF-7CD1-4F77-89A8-9DE3D0C9DBC0", "ID TableID"),
    "TMSCHEMA_LEVELS": ("F1B5C3B0-7CD1-4F77-89A8-9DE3D0C9DBC0", "ID HierarchyID"),
    "TMSCHEMA_RELATIONSHIPS": ("F1B5C3B1-7CD1-4F77-89A8-9DE3D0C9DBC0", "ID"),
    "TMSCHEMA_PARTITIONS": ("F1B5C3B2-7CD1-4F77-89A8-9DE3D0C9DBC0", "ID TableID"),
    "DISCOVER_CALC_DEPENDENCY": ("F1B5C3B3-7CD1-4F77-89A8-9DE3D0C9DBC0", "DATABASE_NAME OBJECT_TYPE"),
}
# Restrictions that are no strings.
RESTRICTION_TYPES = {
    **dict.fromkeys(("CUBE_SOURCE", "HIERARCHY_ORIGIN", "LEVEL_ORIGIN", "PROPERTY_ORIGIN", "DIMENSION_VISIBILITY", "HIERARCHY_VISIBILITY", "LEVEL_VISIBILITY", "MEASURE_VISIBILITY", "PROPERTY_VISIBILITY"), "xsd:unsignedShort"),
    **dict.fromkeys(("PROPERTY_TYPE", "PROPERTY_CONTENT_TYPE"), "xsd:short"),
    **dict.fromkeys(("MEMBER_TYPE", "TREE_OP", "SCOPE", "SET_EVALUATION_CONTEXT"), "xsd:int"),
    **dict.fromkeys(("ID", "TableID", "HierarchyID"), "xsd:long"),
    "LEVEL_NUMBER": "xsd:unsignedInt", "ModifiedAfter": "xsd:dateTime",
}
# Columns of the rowsets that may be empty or are nested.
_NAMES = "CATALOG_NAME string, SCHEMA_NAME string, CUBE_NAME string"
_TYPES = {
    "MDSCHEMA_SETS": f"{_NAMES}, SET_NAME string, SCOPE int, DESCRIPTION string, EXPRESSION string, DIMENSIONS string, SET_CAPTION string, SET_DISPLAY_FOLDER string, SET_EVALUATION_CONTEXT int, SET_IS_VISIBLE boolean",
    "MDSCHEMA_KPIS": f"{_NAMES}, " + ", ".join(f"KPI_{x} string" for x in ("NAME", "CAPTION", "DESCRIPTION", "DISPLAY_FOLDER", "VALUE", "GOAL", "STATUS", "TREND", "STATUS_GRAPHIC", "TREND_GRAPHIC", "WEIGHT", "CURRENT_TIME_MEMBER", "PARENT_KPI_NAME")),
    "MDSCHEMA_PROPERTIES": f"{_NAMES}, DIMENSION_UNIQUE_NAME string, HIERARCHY_UNIQUE_NAME string, LEVEL_UNIQUE_NAME string, MEMBER_UNIQUE_NAME string, PROPERTY_NAME string, PROPERTY_CAPTION string, PROPERTY_DESCRIPTION string, PROPERTY_TYPE short, PROPERTY_CONTENT_TYPE short",
    "DISCOVER_SCHEMA_ROWSETS": "SchemaName string, SchemaGuid string, Restrictions array<struct<Name: string, Type: string>>, RestrictionsMask long",
    "DISCOVER_LITERALS": "LITERAL_NAME string, LITERAL_VALUE string, LITERAL_INVALID_CHARS string, LITERAL_INVALID_STARTING_CHARS string, LITERAL_MAX_LENGTH int, LITERAL_SUFFIX string",
    "DISCOVER_PROPERTIES": "PropertyName string, PropertyDescription string, PropertyType string, PropertyAccessType string, IsRequired boolean, Value string",
}


def quoted(name: str) -> str:
    return "[" + name.replace("]", "]]") + "]"


def hierarchy_name(d: Dimension) -> str:
    return f"{quoted(d.caption)}.{quoted(d.hierarchy)}"


def level_name(d: Dimension, number: int) -> str:
    """Number 0 is the All level where there is one."""
    at = number - (1 if d.has_all else 0)
    return f"{hierarchy_name(d)}.{quoted(d.all_level if at < 0 else d.chain[at].name)}"


def member_name(d: Dimension, path: tuple[str, ...]) -> str:
    """Unique name of a path of keys; of none, the All member."""
    if not path:
        return f"{hierarchy_name(d)}.[All]"
    level = f".{quoted(d.chain[len(path) - 1].name)}" if d.levels else ""
    return f"{hierarchy_name(d)}{level}." + "".join(f"&{quoted(k)}" for k in path)


def guid(*parts: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "/".join(parts)))


def _visible(cube: Cube, g: Grant) -> list[Dimension]:
    return sorted((d for d in cube.model.dimensions if d.visible and g.permission != "none" and g.table(cube.model.table_of(d)).kind != "hidden"), key=lambda d: d.ordinal)


def _measures(cube: Cube, g: Grant):
    return [m for m in sorted(cube.model.measures, key=lambda m: m.ordinal) if m.visible and g.permission != "none" and g.table(cube.model.fact_of(m).table).kind != "hidden"]


def _base(cube: Cube) -> dict[str, Any]:
    return {"CATALOG_NAME": cube.model.catalog, "SCHEMA_NAME": "", "CUBE_NAME": cube.model.cube}


def _cubes(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    return [{**_base(cube), "CUBE_TYPE": "CUBE", "CUBE_GUID": guid(cube.model.catalog, cube.model.cube), "DESCRIPTION": "", "IS_DRILLTHROUGH_ENABLED": True, "IS_LINKABLE": False, "IS_WRITE_ENABLED": False, "IS_SQL_ENABLED": False, "CUBE_CAPTION": cube.model.cube, "BASE_CUBE_NAME": "", "CUBE_SOURCE": 1, "PREFERRED_QUERY_PATTERNS": 0}] if g.permission != "none" else []


def _catalogs(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    return [{"CATALOG_NAME": cube.model.catalog, "DESCRIPTION": "", "ROLES": ",".join(r.name for r in g.roles), "DATABASE_ID": cube.model.catalog, "TYPE": "MULTIDIMENSIONAL", "VERSION": "1", "COMPATIBILITY_LEVEL": 1100}]


def _tables(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    names = [f.table for f in cube.model.facts] + [r.table for r in cube.model.relationships]
    return [{"TABLE_CATALOG": cube.model.catalog, "TABLE_SCHEMA": "", "TABLE_NAME": t, "TABLE_TYPE": "TABLE", "TABLE_GUID": guid(cube.model.catalog, t), "DESCRIPTION": "", "TABLE_OLAP_TYPE": "CUBE" if any(f.table == t for f in cube.model.facts) else "DIMENSION"} for t in dict.fromkeys(names) if g.table(t).kind != "hidden"]


def _dimensions(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    def row(name: str, ordinal: int, kind: int, size: int, hierarchy: str, text: str) -> dict[str, Any]:
        return {**_base(cube), "DIMENSION_NAME": name, "DIMENSION_UNIQUE_NAME": quoted(name), "DIMENSION_GUID": guid(cube.model.cube, name), "DIMENSION_CAPTION": name, "DIMENSION_ORDINAL": ordinal, "DIMENSION_TYPE": kind, "DIMENSION_CARDINALITY": size, "DEFAULT_HIERARCHY": hierarchy, "DESCRIPTION": text, "IS_VIRTUAL": False, "IS_READWRITE": False, "DIMENSION_UNIQUE_SETTINGS": 1, "DIMENSION_IS_VISIBLE": True}

    found = _measures(cube, g)
    out = [row("Measures", 0, MEASURE, len(found), "[Measures]", "")] if found else []
    return out + [row(d.caption, k + 1, TIME if d.date_role else REGULAR, d.cardinality, hierarchy_name(d), d.description) for k, d in enumerate(_visible(cube, g))]


def _hierarchies(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    def row(dimension: str, name: str, unique: str, kind: int, size: int, default: str, all_: str, ordinal: int, levels: int, text: str) -> dict[str, Any]:
        return {**_base(cube), "DIMENSION_UNIQUE_NAME": quoted(dimension), "HIERARCHY_NAME": name, "HIERARCHY_UNIQUE_NAME": unique, "HIERARCHY_GUID": guid(cube.model.cube, unique), "HIERARCHY_CAPTION": name, "DIMENSION_TYPE": kind, "HIERARCHY_CARDINALITY": size, "DEFAULT_MEMBER": default, "ALL_MEMBER": all_, "DESCRIPTION": text, "STRUCTURE": 0, "IS_VIRTUAL": False, "IS_READWRITE": False, "DIMENSION_UNIQUE_SETTINGS": 1, "DIMENSION_IS_VISIBLE": True, "HIERARCHY_ORDINAL": ordinal, "HIERARCHY_IS_VISIBLE": True, "HIERARCHY_ORIGIN": 1 if levels > 1 else 2, "HIERARCHY_DISPLAY_FOLDER": "", "INSTANCE_SELECTION": 0, "GROUPING_BEHAVIOR": 1, "STRUCTURE_TYPE": "Natural" if levels > 1 else "Unnatural"}

    found = _measures(cube, g)
    out = [row("Measures", "Measures", "[Measures]", MEASURE, len(found), f"[Measures].{quoted(found[0].caption)}", "", 0, 1, "")] if found else []
    for k, d in enumerate(_visible(cube, g)):
        all_ = member_name(d, ()) if d.has_all else ""
        out.append(row(d.caption, d.hierarchy, hierarchy_name(d), TIME if d.date_role else REGULAR, d.cardinality, all_, all_, k + 1, len(d.chain), d.description))
    return out


def _levels(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    def row(dimension: str, hierarchy: str, name: str, number: int, size: int, kind: int, column: str) -> dict[str, Any]:
        unique = f"{hierarchy}.{quoted(name)}"
        return {**_base(cube), "DIMENSION_UNIQUE_NAME": quoted(dimension), "HIERARCHY_UNIQUE_NAME": hierarchy, "LEVEL_NAME": name, "LEVEL_UNIQUE_NAME": unique, "LEVEL_GUID": guid(cube.model.cube, unique), "LEVEL_CAPTION": name, "LEVEL_NUMBER": number, "LEVEL_CARDINALITY": size, "LEVEL_TYPE": kind, "DESCRIPTION": "", "CUSTOM_ROLLUP_SETTINGS": 0, "LEVEL_UNIQUE_SETTINGS": 0, "LEVEL_IS_VISIBLE": True, "LEVEL_ORDERING_PROPERTY": name, "LEVEL_DBTYPE": 130, "LEVEL_NAME_SQL_COLUMN_NAME": column, "LEVEL_KEY_SQL_COLUMN_NAME": column, "LEVEL_ORIGIN": 1}

    found = _measures(cube, g)
    out = [row("Measures", "[Measures]", "MeasuresLevel", 0, len(found), LEVEL_REGULAR, "")] if found else []
    for d in _visible(cube, g):
        if d.has_all:
            out.append(row(d.caption, hierarchy_name(d), d.all_level, 0, 1, LEVEL_ALL, ""))
        for k, x in enumerate(d.chain):
            kind = TIME_LEVELS.get(x.name.lower(), LEVEL_REGULAR) if d.date_role else LEVEL_REGULAR
            out.append(row(d.caption, hierarchy_name(d), x.name, k + int(d.has_all), x.cardinality or d.cardinality, kind, x.column))
    return out


def _measure_rows(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    return [
        {**_base(cube), "MEASURE_NAME": m.caption, "MEASURE_UNIQUE_NAME": f"[Measures].{quoted(m.caption)}", "MEASURE_CAPTION": m.display, "MEASURE_GUID": guid(cube.model.cube, m.id), "MEASURE_AGGREGATOR": m.aggregator, "DATA_TYPE": 5, "NUMERIC_PRECISION": m.precision, "NUMERIC_SCALE": m.scale, "MEASURE_UNITS": m.units, "DESCRIPTION": m.description, "EXPRESSION": m.expression, "MEASURE_IS_VISIBLE": m.visible, "MEASURE_NAME_SQL_COLUMN_NAME": m.id, "MEASURE_UNQUALIFIED_CAPTION": m.caption, "MEASUREGROUP_NAME": m.group or cube.model.fact_of(m).group, "MEASURE_DISPLAY_FOLDER": "", "DEFAULT_FORMAT_STRING": m.format}
        for m in _measures(cube, g)
    ]


def _groups(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    return [{**_base(cube), "MEASUREGROUP_NAME": f.group or f.id, "DESCRIPTION": "", "IS_WRITE_ENABLED": False, "MEASUREGROUP_CAPTION": f.group or f.id} for f in cube.model.facts if g.table(f.table).kind != "hidden"]


def _group_dimensions(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    out = []
    for f in cube.model.facts:
        measure = next((m for m in cube.model.measures if cube.model.fact_of(m).id == f.id), None)
        if measure is not None and g.table(f.table).kind != "hidden":
            out += [{**_base(cube), "MEASUREGROUP_NAME": f.group or f.id, "MEASUREGROUP_CARDINALITY": "ONE", "DIMENSION_UNIQUE_NAME": quoted(d.caption), "DIMENSION_CARDINALITY": "MANY", "DIMENSION_IS_VISIBLE": True, "DIMENSION_IS_FACT_DIMENSION": cube.model.relationship(d, f) is None, "DIMENSION_GRANULARITY": hierarchy_name(d)} for d in _visible(cube, g) if cube.model.compatible(d, measure)]
    return out


def _properties(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    def row(kind: int, name: str, content: int, *at: str) -> dict[str, Any]:
        place = dict(zip(("DIMENSION_UNIQUE_NAME", "HIERARCHY_UNIQUE_NAME", "LEVEL_UNIQUE_NAME"), at))
        return {**_base(cube), **place, "PROPERTY_NAME": name, "PROPERTY_CAPTION": name, "PROPERTY_TYPE": kind, "PROPERTY_CONTENT_TYPE": content}

    measures = ("[Measures]", "[Measures]", "[Measures].[MeasuresLevel]")
    levels = [(quoted(d.caption), hierarchy_name(d), level_name(d, k)) for d in _visible(cube, g) for k in range(len(d.chain) + int(d.has_all))]
    out = [row(OF_MEMBER, p, c, *at) for at in levels for p, c in MEMBER_PROPERTIES.items()]
    out += [row(OF_MEMBER, p, MEMBER_PROPERTIES[p], *measures) for p in MEASURE_PROPERTIES]
    out += [row(OF_CELL, p, c, "[Measures]") for p, c in CELL_PROPERTIES.items()]
    return out + [row(OF_VALUE, "MEMBER_VALUE", 0, *at) for at in (measures, *levels)]


def _server_properties(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    own = {"Catalog": cube.model.catalog}
    return [{"PropertyName": n, "PropertyDescription": n, "PropertyType": t, "PropertyAccessType": "ReadWrite" if w else "Read", "IsRequired": False, "Value": own.get(n, v) or ""} for n, t, w, v in SERVER_PROPERTIES]


def _literals(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    values = [("CATALOG_NAME", cube.model.catalog, 128), ("CATALOG_SEPARATOR", ".", None), ("QUOTE_PREFIX", "[", None), ("QUOTE_SUFFIX", "]", None), ("PASS_THROUGH_COLUMNS", "true", None)]
    return [{"LITERAL_NAME": f"DBLITERAL_{n}", "LITERAL_VALUE": v, "LITERAL_MAX_LENGTH": size} for n, v, size in values]


def _schemas(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    out = []
    for name, (identifier, restricted) in SCHEMAS.items():
        by = [{"Name": c, "Type": RESTRICTION_TYPES.get(c, "xsd:string")} for c in restricted.split()]
        out.append({"SchemaName": name, "SchemaGuid": identifier, "Restrictions": by, "RestrictionsMask": (1 << len(by)) - 1})
    return out


def _model_rows(kind: str) -> Callable[[Cube, Grant], list[dict[str, Any]]]:
    def rows(cube: Cube, g: Grant) -> list[dict[str, Any]]:
        m = cube.model
        if g.permission == "none":
            return []
        if kind == "MODEL":
            return [{"ID": 1, "Name": m.cube, "Description": "", "Culture": "en-US"}]
        tables = _tables(cube, g)
        number = {t["TABLE_NAME"]: k + 1 for k, t in enumerate(tables)}
        if kind == "TABLES":
            return [{"ID": k, "ModelID": 1, "Name": t} for t, k in number.items()]
        if kind == "COLUMNS":
            return [{"ID": 1000 * k + j + 1, "TableID": k, "ExplicitName": f.name, "ExplicitDataType": f.dataType.simpleString()} for t, k in number.items() for j, f in enumerate(cube.schema(t))]
        if kind == "MEASURES":
            return [{"ID": k + 1, "TableID": number[m.fact_of(x).table], "Name": x.caption, "Expression": x.expression or x.sql, "FormatString": x.format} for k, x in enumerate(_measures(cube, g))]
        if kind == "HIERARCHIES":
            return [{"ID": k + 1, "TableID": number.get(m.table_of(d), 0), "Name": d.hierarchy} for k, d in enumerate(_visible(cube, g))]
        if kind == "LEVELS":
            return [{"ID": 100 * (k + 1) + j, "HierarchyID": k + 1, "Ordinal": j, "Name": x.name} for k, d in enumerate(_visible(cube, g)) for j, x in enumerate(d.chain)]
        if kind == "RELATIONSHIPS":
            return [{"ID": k + 1, "FromTableID": number.get(m.fact(r.fact).table, 0), "ToTableID": number[r.table], "FromColumn": r.fact_column, "ToColumn": r.column, "IsActive": True} for k, r in enumerate(m.relationships) if r.table in number]
        return [{"ID": k, "TableID": k, "Name": t, "Mode": 0} for t, k in number.items()]

    return rows


def _dependencies(cube: Cube, g: Grant) -> list[dict[str, Any]]:
    return [{"DATABASE_NAME": cube.model.catalog, "OBJECT_TYPE": "MEASURE", "TABLE": cube.model.fact_of(m).table, "OBJECT": m.caption, "EXPRESSION": m.expression or m.sql, "REFERENCED_OBJECT_TYPE": "TABLE", "REFERENCED_TABLE": cube.model.fact_of(m).table, "REFERENCED_OBJECT": cube.model.fact_of(m).table} for m in _measures(cube, g)]


_SOURCES: dict[str, tuple[Callable[[Cube, Grant], list[dict[str, Any]]], str]] = {
    "MDSCHEMA_CUBES": (_cubes, "CUBE_NAME"),
    "DBSCHEMA_CATALOGS": (_catalogs, "CATALOG_NAME"),
    "DBSCHEMA_TABLES": (_tables, "TABLE_NAME"),
    "MDSCHEMA_DIMENSIONS": (_dimensions, "DIMENSION_UNIQUE_NAME"),
    "MDSCHEMA_HIERARCHIES": (_hierarchies, "HIERARCHY_UNIQUE_NAME"),
    "MDSCHEMA_LEVELS": (_levels, "LEVEL_UNIQUE_NAME"),
    "MDSCHEMA_MEASURES": (_measure_rows, "MEASURE_UNIQUE_NAME"),
    "MDSCHEMA_MEASUREGROUPS": (_groups, "MEASUREGROUP_NAME"),
    "MDSCHEMA_MEASUREGROUP_DIMENSIONS": (_group_dimensions, "DIMENSION_UNIQUE_NAME"),
    "MDSCHEMA_PROPERTIES": (_properties, "PROPERTY_NAME"),
    "MDSCHEMA_SETS": (lambda c, g: [], "SET_NAME"),
    "MDSCHEMA_KPIS": (lambda c, g: [], "KPI_NAME"),
    "DISCOVER_PROPERTIES": (_server_properties, "PropertyName"),
    "DISCOVER_SCHEMA_ROWSETS": (_schemas, "SchemaName"),
    "DISCOVER_LITERALS": (_literals, "LITERAL_NAME"),
    "DISCOVER_ENUMERATORS": (lambda c, g: [{"EnumName": "TreeOp", "EnumDescription": "", "EnumType": "int", "ElementName": n, "ElementValue": str(v)} for n, v in (("CHILDREN", 1), ("SIBLINGS", 2), ("PARENT", 4), ("SELF", 8))], "EnumName"),
    "DISCOVER_KEYWORDS": (lambda c, g: [{"Keyword": k} for k in KEYWORDS], "Keyword"),
    "DISCOVER_DATASOURCES": (lambda c, g: [{"DataSourceName": "orthoplex", "DataSourceDescription": "", "URL": "/xmla", "DataSourceInfo": "", "ProviderName": "orthoplex", "ProviderType": "MDP", "AuthenticationMode": "Unauthenticated"}], "DataSourceName"),
    "DISCOVER_XML_METADATA": (lambda c, g: [{"METADATA": f"<Database><Name>{c.model.catalog}</Name></Database>"}], "METADATA"),
    "DISCOVER_CALC_DEPENDENCY": (_dependencies, "OBJECT"),
    **{f"TMSCHEMA_{k}": (_model_rows(k), "Name") for k in ("MODEL", "TABLES", "COLUMNS", "MEASURES", "HIERARCHIES", "LEVELS", "RELATIONSHIPS", "PARTITIONS")},
}


def rowset_names() -> list[str]:
    return [*_SOURCES, "MDSCHEMA_MEMBERS"]


def rowset(cube: Cube, name: str, restrictions: dict[str, Any] | None = None, user: User | None = None) -> DataFrame:
    """A rowset by name, restricted by column values; properties of members are given where their type is asked for."""
    g = grant(cube.model, user)
    if name == "MDSCHEMA_MEMBERS":
        return member_rows(cube, restrictions or {}, g)
    if name not in _SOURCES:
        raise KeyError(f"unknown rowset {name!r}")
    source, key = _SOURCES[name]
    asked = {c: v for c, v in (restrictions or {}).items() if v not in (None, "")}
    if name == "DISCOVER_LITERALS" and "LiteralName" in asked:
        asked["LITERAL_NAME"] = asked.pop("LiteralName")
    rows = every = source(cube, g)
    if name == "MDSCHEMA_PROPERTIES" and "PROPERTY_TYPE" not in asked:
        rows = [r for r in rows if r["PROPERTY_TYPE"] != OF_MEMBER]
    for column, value in asked.items():
        rows = [r for r in rows if column not in r or str(r[column]) == str(value)]
    types = _TYPES.get(name)
    if not rows and not types:
        types = cube.spark.createDataFrame(every).schema if every else f"`{key}` string"
    return cube.spark.createDataFrame(rows, types) if types else cube.spark.createDataFrame(rows)


def parse_member(cube: Cube, unique: str) -> tuple[Dimension | None, tuple[str, ...]]:
    """Dimension and key path of a member's unique name; the measures have no dimension."""
    from orthoplex.plans import mdx
    from orthoplex.plans.resolve import Resolver

    found = Resolver(cube.model).set(mdx._set(mdx._Reader(unique)))
    if found.measures:
        return None, (found.measures[0],)
    part = found.parts[0]
    return part.dimension, part.members[0][1] if part.members else ()


def member_rows(cube: Cube, restrictions: dict[str, Any], g: Grant) -> DataFrame:
    """Members by TREE_OP around one, or those of a hierarchy or level; only the dimension asked for is read."""
    unique, op = restrictions.get("MEMBER_UNIQUE_NAME"), int(restrictions.get("TREE_OP") or 0)
    if unique:
        d, path = parse_member(cube, unique)
        if d is None:
            return _measure_members(cube, g, path[0] if op in (0, TREE_SELF) else None)
        steps = []
        if op & TREE_CHILDREN and len(path) < len(d.chain):
            steps.append(_at_level(cube, d, len(path), path, g))
        if op & TREE_SIBLINGS and path:
            steps.append(_at_level(cube, d, len(path) - 1, path[:-1], g))
        if op & TREE_PARENT and path:
            steps.append(_exact(cube, d, path[:-1], g))
        if op & TREE_SELF or op == 0:
            steps.append(_exact(cube, d, path, g))
        return reduce(DataFrame.unionByName, steps) if steps else _exact(cube, d, path, g).limit(0)
    wanted = restrictions.get("HIERARCHY_UNIQUE_NAME") or restrictions.get("DIMENSION_UNIQUE_NAME")
    if wanted == "[Measures]":
        return _measure_members(cube, g, None)
    found = [d for d in _visible(cube, g) if wanted in (None, hierarchy_name(d), quoted(d.caption))]
    parts = [] if wanted else [_measure_members(cube, g, None)]
    level = restrictions.get("LEVEL_UNIQUE_NAME")
    for d in found:
        for k in range(-1 if d.has_all else 0, len(d.chain)):
            if level in (None, level_name(d, k + int(d.has_all))):
                parts.append(_exact(cube, d, (), g) if k < 0 else _at_level(cube, d, k, (), g))
    return reduce(DataFrame.unionByName, parts) if parts else _measure_members(cube, g, "").limit(0)


_MEMBER = "CATALOG_NAME string, CUBE_NAME string, DIMENSION_UNIQUE_NAME string, HIERARCHY_UNIQUE_NAME string, LEVEL_UNIQUE_NAME string, LEVEL_NUMBER int, MEMBER_ORDINAL int, MEMBER_NAME string, MEMBER_UNIQUE_NAME string, MEMBER_TYPE int, MEMBER_CAPTION string, MEMBER_KEY string, CHILDREN_CARDINALITY long, PARENT_LEVEL int, PARENT_UNIQUE_NAME string, PARENT_COUNT int"


def _measure_members(cube: Cube, g: Grant, only: str | None) -> DataFrame:
    rows = [(cube.model.catalog, cube.model.cube, "[Measures]", "[Measures]", "[Measures].[MeasuresLevel]", 0, k, m.caption, f"[Measures].{quoted(m.caption)}", MEMBER_MEASURE, m.caption, m.id, 0, 0, None, 0) for k, m in enumerate(_measures(cube, g)) if only in (None, m.id)]
    return cube.spark.createDataFrame(rows, _MEMBER)


def _exact(cube: Cube, d: Dimension, path: tuple[str, ...], g: Grant) -> DataFrame:
    if path:
        return _at_level(cube, d, len(path) - 1, path[:-1], g).where(F.col("MEMBER_KEY") == path[-1])
    first = members(cube, d.id, level=0, grant_=g).agg(F.count("*").alias("n"))
    return first.select(*_constants(cube, d, 0), F.lit(0).alias("MEMBER_ORDINAL"), F.lit("All").alias("MEMBER_NAME"), F.lit(member_name(d, ())).alias("MEMBER_UNIQUE_NAME"), F.lit(MEMBER_ALL).alias("MEMBER_TYPE"), F.lit("All").alias("MEMBER_CAPTION"), F.lit("All").alias("MEMBER_KEY"), F.col("n").alias("CHILDREN_CARDINALITY"), F.lit(0).alias("PARENT_LEVEL"), F.lit(None).cast("string").alias("PARENT_UNIQUE_NAME"), F.lit(0).alias("PARENT_COUNT"))


def _constants(cube: Cube, d: Dimension, number: int) -> list:
    values = {"CATALOG_NAME": cube.model.catalog, "CUBE_NAME": cube.model.cube, "DIMENSION_UNIQUE_NAME": quoted(d.caption), "HIERARCHY_UNIQUE_NAME": hierarchy_name(d), "LEVEL_UNIQUE_NAME": level_name(d, number), "LEVEL_NUMBER": number}
    return [F.lit(v).alias(k) for k, v in values.items()]


def _at_level(cube: Cube, d: Dimension, level: int, parent: tuple[str, ...], g: Grant) -> DataFrame:
    from orthoplex.operators.members import _source

    rows = _source(cube, d, g)
    if rows is None:
        return cube.spark.createDataFrame([], _MEMBER)
    if parent:
        rows = rows.where(cube._holds(d, Filter(d.id, len(parent) - 1, (parent,)), cube.model.table_of(d), None))
    keys = [F.col(f"`{x.column if d.levels else d.column}`").cast("string").alias(f"__{k}") for k, x in enumerate(d.chain[: level + 1])]
    below = F.countDistinct(f"`{d.chain[level + 1].column}`") if level + 1 < len(d.chain) else F.lit(0).cast("long")
    found = rows.groupBy(*keys).agg(below.alias("CHILDREN_CARDINALITY")).dropna()

    def name(depth: int):
        if depth == 0:
            return F.lit(member_name(d, ()))
        head = hierarchy_name(d) + (f".{quoted(d.chain[depth - 1].name)}" if d.levels else "") + "."
        return F.concat(F.lit(head), *[F.concat(F.lit("&["), F.replace(F.col(f"__{k}"), F.lit("]"), F.lit("]]")), F.lit("]")) for k in range(depth)])

    number = level + int(d.has_all)
    has_parent = level > 0 or d.has_all
    return found.select(
        *_constants(cube, d, number), F.lit(0).alias("MEMBER_ORDINAL"), F.col(f"__{level}").alias("MEMBER_NAME"), name(level + 1).alias("MEMBER_UNIQUE_NAME"), F.lit(MEMBER_REGULAR).alias("MEMBER_TYPE"), F.col(f"__{level}").alias("MEMBER_CAPTION"), F.col(f"__{level}").alias("MEMBER_KEY"),
        "CHILDREN_CARDINALITY", F.lit(max(0, number - 1)).alias("PARENT_LEVEL"), (name(level) if has_parent else F.lit(None).cast("string")).alias("PARENT_UNIQUE_NAME"), F.lit(int(has_parent)).alias("PARENT_COUNT"),
    ).orderBy("MEMBER_UNIQUE_NAME")
