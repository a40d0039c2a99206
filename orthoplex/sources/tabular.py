"""Tabular model definitions: BIM, folder and TMDL forms to one structure, and on to a cube definition."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from orthoplex.functions import dax
from orthoplex.sources.mquery import extract_source, is_complex

TYPES = {"int64": "bigint", "double": "double", "string": "string", "dateTime": "timestamp", "boolean": "boolean", "decimal": "decimal(38,10)"}
_NUMBERS = ("int64", "double", "decimal")


@dataclass
class Column:
    name: str
    type: str = "string"
    source: str = ""
    hidden: bool = False
    key: bool = False
    expression: str = ""


@dataclass
class TabularMeasure:
    name: str
    expression: str
    format: str = ""
    folder: str = ""
    description: str = ""
    hidden: bool = False


@dataclass
class Partition:
    name: str
    kind: str = "m"  # m, query, calculated, calculationGroup
    expression: str = ""
    mode: str = ""


@dataclass
class TabularHierarchy:
    name: str
    levels: list[tuple[str, str]] = field(default_factory=list)  # name, column


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    measures: list[TabularMeasure] = field(default_factory=list)
    partitions: list[Partition] = field(default_factory=list)
    hierarchies: list[TabularHierarchy] = field(default_factory=list)
    hidden: bool = False
    description: str = ""
    category: str = ""

    @property
    def calculated(self) -> bool:
        return any(p.kind in ("calculated", "calculationGroup") for p in self.partitions)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass
class TabularRelationship:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    active: bool = True


@dataclass
class TabularRole:
    name: str
    permission: str = "read"
    members: list[str] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)
    hidden: list[str] = field(default_factory=list)


@dataclass
class TabularModel:
    name: str
    tables: list[Table] = field(default_factory=list)
    relationships: list[TabularRelationship] = field(default_factory=list)
    roles: list[TabularRole] = field(default_factory=list)
    sources: list[dict[str, Any]] = field(default_factory=list)

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name.lower() == name.lower()), None)


def ident(name: str) -> str:
    """Lower case, blanks to underscores."""
    return name.strip().lower().replace(" ", "_")


def _text(value: Any) -> str:
    return "\n".join(value) if isinstance(value, list) else str(value or "")


# ---------------------------------------------------------------- BIM and folders


def _table(raw: dict[str, Any]) -> Table:
    columns = [Column(c["name"], c.get("dataType", "string"), c.get("sourceColumn", c["name"]), bool(c.get("isHidden")), bool(c.get("isKey")), _text(c.get("expression"))) for c in raw.get("columns", []) if c.get("type") != "rowNumber" and "name" in c]
    measures = [TabularMeasure(m["name"], _text(m.get("expression")), _text(m.get("formatString")), m.get("displayFolder", ""), _text(m.get("description")), bool(m.get("isHidden"))) for m in raw.get("measures", [])]
    partitions = []
    for p in raw.get("partitions", []):
        source = p.get("source", {})
        partitions.append(Partition(p.get("name", ""), source.get("type", "query" if source.get("query") else "m"), _text(source.get("expression") or source.get("query")), p.get("mode", "")))
    if "calculationGroup" in raw and not partitions:
        partitions.append(Partition(raw["name"], "calculationGroup"))
    hierarchies = [TabularHierarchy(h["name"], [(x["name"], x.get("column", x["name"])) for x in sorted(h.get("levels", []), key=lambda x: x.get("ordinal", 0))]) for h in raw.get("hierarchies", [])]
    return Table(raw["name"], columns, measures, partitions, hierarchies, bool(raw.get("isHidden")), _text(raw.get("description")), raw.get("dataCategory", ""))


def _relationship(raw: dict[str, Any]) -> TabularRelationship:
    return TabularRelationship(raw["fromTable"], raw["fromColumn"], raw["toTable"], raw["toColumn"], raw.get("isActive", True))


def _role(raw: dict[str, Any]) -> TabularRole:
    out = TabularRole(raw["name"], raw.get("modelPermission", "read"), [m.get("memberName", m.get("name", "")) for m in raw.get("members", [])])
    for p in raw.get("tablePermissions", []):
        if p.get("metadataPermission") == "none":
            out.hidden.append(p["name"])
        if p.get("filterExpression"):
            out.filters[p["name"]] = _text(p["filterExpression"])
    return out


def parse_bim(text: str) -> TabularModel:
    raw = json.loads(text.lstrip("﻿"))
    model = raw.get("model", raw)
    return TabularModel(
        raw.get("name", model.get("name", "Model")),
        [_table(t) for t in model.get("tables", [])],
        [_relationship(r) for r in model.get("relationships", []) if "fromTable" in r],
        [_role(r) for r in model.get("roles", [])],
        list(model.get("dataSources", [])) + list(model.get("expressions", [])),
    )


def parse_folder(folder: str | Path) -> TabularModel:
    """database.json beside tables/<name>/<name>.json (with columns, measures, partitions, hierarchies below), relationships and roles."""
    folder = Path(folder)

    def read(path: Path) -> dict[str, Any]:
        return json.loads(path.read_text(encoding="utf-8-sig"))

    def items(path: Path) -> list[dict[str, Any]]:
        return [read(p) for p in sorted(path.glob("*.json"))] if path.is_dir() else []

    raw = read(folder / "database.json")
    inner = raw.get("model", raw)
    tables = []
    for path in sorted((folder / "tables").iterdir()) if (folder / "tables").is_dir() else []:
        if path.is_dir():
            own = path / f"{path.name}.json"
            table = read(own) if own.is_file() else {"name": path.name}
            for part in ("columns", "measures", "partitions", "hierarchies"):
                table[part] = [*table.get(part, []), *items(path / part)]
            tables.append(table)
        elif path.suffix == ".json":
            tables.append(read(path))
    out = parse_bim(json.dumps({"name": raw.get("name", "Model"), "model": {"tables": [*inner.get("tables", []), *tables], "relationships": [*inner.get("relationships", []), *items(folder / "relationships")], "roles": [*inner.get("roles", []), *items(folder / "roles")], "dataSources": [*inner.get("dataSources", []), *items(folder / "dataSources")]}}))
    return out


# ---------------------------------------------------------------- TMDL

_HEAD = re.compile(r"^(?P<kind>[A-Za-z]+)\s+(?P<name>'(?:[^']|'')*'|[^=\s]+(?:\s(?!=)[^=\s]+)*)?\s*(?:=\s*(?P<value>.*))?$")
_OBJECTS = {"table", "column", "measure", "partition", "hierarchy", "level", "relationship", "role", "tablePermission", "member", "model", "database", "calculationGroup", "calculationItem", "expression", "annotation", "dataSource", "variation"}


@dataclass
class _Node:
    kind: str
    name: str
    value: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    children: list[_Node] = field(default_factory=list)
    note: str = ""


def _tmdl(text: str) -> _Node:
    """Objects by indentation; a value that ends with = (or an open block) goes on in the deeper lines that are no properties."""
    root = _Node("root", "")
    stack: list[tuple[int, _Node]] = [(-1, root)]
    note: list[str] = []
    body: tuple[int, Any, str] | None = None  # indent, where, property
    for line in text.lstrip("﻿").splitlines():
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip("\t ")) if "\t" not in line[: len(line) - len(line.lstrip())] else len(line) - len(line.lstrip("\t"))
        text_ = line.strip()
        if text_.startswith("///"):
            note.append(text_[3:].strip())
            body = None
            continue
        if body is not None and indent > body[0]:
            word = re.match(r"([A-Za-z]+)\s*(?::|$)", text_)
            deeper = indent > body[0] + 1
            if deeper or not (word and (":" in text_[: word.end()] or text_ in ("isHidden", "isKey", "isDefault"))):
                where, name = body[1], body[2]
                joined = (where.value if not name else where.properties.get(name, "")) + "\n" + text_
                if name:
                    where.properties[name] = joined.strip()
                else:
                    where.value = joined.strip()
                continue
        body = None
        while stack[-1][0] >= indent:
            stack.pop()
        parent = stack[-1][1]
        m = _HEAD.match(text_)
        colon = re.match(r"([A-Za-z]+)\s*:\s*(.*)$", text_)
        if colon and not (m and m.group("kind") in _OBJECTS and not text_.startswith(m.group("kind") + ":")):
            parent.properties[colon.group(1)] = colon.group(2).strip().strip('"')
        elif m and m.group("kind") in _OBJECTS:
            node = _Node(m.group("kind"), (m.group("name") or "").strip("'").replace("''", "'"), (m.group("value") or "").strip(), note=" ".join(note))
            parent.children.append(node)
            stack.append((indent, node))
            if m.group("value") is not None:
                body = (indent, node, "")
        elif re.fullmatch(r"[A-Za-z]+", text_):
            parent.properties[text_] = "true"
        elif assign := re.match(r"([A-Za-z]+)\s*=\s*(.*)$", text_):
            parent.properties[assign.group(1)] = assign.group(2)
            body = (indent, parent, assign.group(1))
        note = []
    return root


def _split_reference(text: str) -> tuple[str, str]:
    m = re.match(r"('(?:[^']|'')*'|[^.]+)\.('(?:[^']|'')*'|.+)$", text.strip())
    if not m:
        return text, ""
    return m.group(1).strip("'").replace("''", "'"), m.group(2).strip("'").replace("''", "'")


def parse_tmdl(texts: Iterable[str], name: str = "Model") -> TabularModel:
    """The texts of all .tmdl files of a model, in any order."""
    out = TabularModel(name)
    for text in texts:
        for node in _tmdl(text).children:
            children = [node, *node.children] if node.kind in ("model", "database") else [node]
            for n in children:
                if n.kind == "database" and n.name:
                    out.name = n.name
                elif n.kind == "table":
                    out.tables.append(_tmdl_table(n))
                elif n.kind == "relationship":
                    a, b = _split_reference(n.properties.get("fromColumn", "")), _split_reference(n.properties.get("toColumn", ""))
                    out.relationships.append(TabularRelationship(*a, *b, n.properties.get("isActive", "true") != "false"))
                elif n.kind == "role":
                    role = TabularRole(n.name, n.properties.get("modelPermission", "read"))
                    for c in n.children:
                        if c.kind == "member":
                            role.members.append(c.name)
                        elif c.kind == "tablePermission":
                            if c.value:
                                role.filters[c.name] = c.value
                            if c.properties.get("metadataPermission") == "none":
                                role.hidden.append(c.name)
                    out.roles.append(role)
                elif n.kind in ("expression", "dataSource"):
                    out.sources.append({"name": n.name, "expression": n.value, **n.properties})
    return out


def _tmdl_table(n: _Node) -> Table:
    out = Table(n.name, hidden=n.properties.get("isHidden") == "true", description=n.note, category=n.properties.get("dataCategory", ""))
    for c in n.children:
        p = c.properties
        if c.kind == "column":
            out.columns.append(Column(c.name, p.get("dataType", "string"), p.get("sourceColumn", c.name).strip("[]"), p.get("isHidden") == "true", p.get("isKey") == "true", c.value))
        elif c.kind == "measure":
            out.measures.append(TabularMeasure(c.name, c.value, p.get("formatString", ""), p.get("displayFolder", ""), c.note, p.get("isHidden") == "true"))
        elif c.kind == "partition":
            out.partitions.append(Partition(c.name, c.value.split("\n")[0].strip() or "m", p.get("source", "\n".join(c.value.split("\n")[1:])), p.get("mode", "")))
        elif c.kind == "hierarchy":
            out.hierarchies.append(TabularHierarchy(c.name, [(x.name, x.properties.get("column", x.name)) for x in c.children if x.kind == "level"]))
        elif c.kind == "calculationGroup":
            out.partitions.append(Partition(n.name, "calculationGroup"))
    return out


def load(path: str | Path) -> TabularModel:
    """A .bim file, a folder with database.json, or a folder of .tmdl files."""
    path = Path(path)
    if path.is_file():
        return parse_bim(path.read_text(encoding="utf-8-sig"))
    if (path / "database.json").is_file():
        return parse_folder(path)
    files = sorted(path.rglob("*.tmdl"))
    if not files:
        raise ValueError(f"{path} holds no model")
    return parse_tmdl([f.read_text(encoding="utf-8-sig") for f in files], path.name)


# ---------------------------------------------------------------- conversion


def classify_tables(model: TabularModel) -> dict[str, str]:
    """fact, date, dimension, calculated or lookup for each table."""
    sources = {r.from_table.lower() for r in model.relationships}
    targets = {r.to_table.lower() for r in model.relationships}
    out = {}
    for t in model.tables:
        name = t.name.lower()
        dated = t.category.lower() == "time" or (re.search(r"date|calendar|kalender|datum", name) and any(c.type == "dateTime" for c in t.columns))
        if t.calculated and not dated:
            out[t.name] = "calculated"
        elif dated and name not in sources:
            out[t.name] = "date"
        elif name in sources or (t.measures and name not in targets and any(c.type in _NUMBERS for c in t.columns)):
            out[t.name] = "fact"
        elif name in targets:
            out[t.name] = "dimension"
        else:
            out[t.name] = "lookup"
    return out


@dataclass
class Converted:
    definition: dict[str, Any]
    schemas: dict[str, str]  # table: Spark DDL
    loads: list[dict[str, Any]]
    report: list[dict[str, str]]


def convert(model: TabularModel) -> Converted:
    """A cube definition, the schema of every table, where each loads from, and what became of each measure."""
    kinds = classify_tables(model)
    facts = [t for t in model.tables if kinds[t.name] == "fact"] or model.tables[:1]
    by_name = {t.name.lower(): t for t in model.tables}
    home = max(facts, key=lambda t: (len(t.measures), len(t.columns)))
    dimensions: list[dict[str, Any]] = []
    relationships: list[dict[str, Any]] = []
    report: list[dict[str, str]] = []
    taken: set[str] = set()

    def unique(name: str, table: str) -> str:
        out = name if name not in taken else f"{table} {name}"
        taken.add(out)
        return out

    def physical(t: Table, column: str) -> str:
        found = t.column(column)
        return ident(found.source if found and found.source else column)

    for r in model.relationships:
        a, b = by_name.get(r.from_table.lower()), by_name.get(r.to_table.lower())
        if a is None or b is None or not r.active or kinds[a.name] != "fact":
            continue
        if kinds[b.name] == "date" or b.hierarchies:
            hierarchy = b.hierarchies[0] if b.hierarchies else None
            levels = [{"name": n, "column": physical(b, c), "level_number": k} for k, (n, c) in enumerate(hierarchy.levels)] if hierarchy else []
            id_ = unique(b.name, r.from_column)
            dimensions.append(_entry(id_, physical(b, r.to_column), len(dimensions) + 1, hierarchy_levels=levels, is_date_role=kinds[b.name] == "date"))
            relationships.append(_link(a, b, r, id_, physical))
        if kinds[b.name] != "date":
            for c in b.columns:
                if c.type in ("string", "boolean") and not c.hidden:
                    id_ = unique(c.name, b.name)
                    dimensions.append(_entry(id_, physical(b, c.name), len(dimensions) + 1))
                    relationships.append(_link(a, b, r, id_, physical))
    for t in facts:
        dimensions += [_entry(unique(c.name, t.name), physical(t, c.name), len(dimensions) + 1 + k, fact_table=ident(t.name)) for k, c in enumerate(c for c in t.columns if c.type in ("string", "boolean") and not c.hidden)]
    texts = {m.name: m.expression for t in model.tables for m in t.measures}
    measures = []
    for t in model.tables:
        owner = t if kinds[t.name] == "fact" else home

        def column(table: str, name: str, owner: Table = owner) -> tuple[str, str | None]:
            other = by_name.get(table.lower())
            if other is None:
                raise dax.Unsupported(f"unknown table {table}")
            if other is owner:
                return f"f.{physical(other, name)}", None
            link = next((x for x in relationships if x["dim_table"] == ident(other.name) and x["fact_table"] == ident(owner.name)), None)
            if link is None:
                raise dax.Unsupported(f"{table} is not related to {owner.name}")
            return f"_{link['dimension_id'].lower().replace(' ', '_')}.{physical(other, name)}", link["dimension_id"]

        for m in t.measures:
            kind = dax.classify(m.expression)
            entry: dict[str, Any] = {"id": m.name, "caption": m.name, "display_name": m.name, "description": m.description, "format_string": m.format, "units": "", "ordinal": len(measures) + 1, "visible": not m.hidden, "fact_table": ident(owner.name), "measure_group_name": ident(owner.name), "expression": m.expression}
            try:
                lowered = dax.Lowerer(column, texts).lower(m.expression)
                if "(" not in lowered.sql and not re.fullmatch(r"-?[\d.]+", lowered.sql):
                    raise dax.Unsupported("a text is no measure")
                entry |= {"sql_expr": lowered.sql, "requires": sorted(lowered.tables)}
                date = next((d["id"] for d in dimensions if d.get("is_date_role")), None)
                if lowered.flag and date:
                    entry["time_intelligence"] = {"dimension_id": date, "flag_column": lowered.flag}
                status = "cumulative" if lowered.cumulative else "lowered"
                report.append({"measure": m.name, "class": kind, "status": status, "detail": lowered.sql})
            except dax.Unsupported as e:
                entry |= {"sql_expr": "CAST(NULL AS DOUBLE)", "fallback_capability": "Stub"}
                report.append({"measure": m.name, "class": kind, "status": "manual", "detail": str(e)})
            measures.append(entry)
    if not measures:
        measures.append({"id": "Row Count", "caption": "Row Count", "display_name": "Row Count", "format_string": "#,##0", "units": "", "ordinal": 1, "visible": True, "fact_table": ident(home.name), "measure_group_name": ident(home.name), "sql_expr": "COUNT(*)"})
    roles = []
    for role in model.roles:
        permissions = [{"table": ident(x), "metadata_permission": "none"} for x in role.hidden]
        permissions += [{"table": ident(x), "filter_expression": _row_filter(text, by_name, x, physical), "dax_filter": text} for x, text in role.filters.items()]
        roles.append({"name": role.name, "model_permission": {"readRefresh": "read", "refresh": "none"}.get(role.permission, role.permission), "members": [{"member_name": m} for m in role.members], "table_permissions": permissions})
    definition = {
        "catalog": ident(model.name).upper(), "cube": model.name, "source_name": ident(home.name), "table_name": ident(home.name), "dialect": "spark",
        "fact_tables": [{"id": ident(t.name), "source_name": ident(t.name), "table_name": ident(t.name), "measure_group_name": ident(t.name)} for t in facts],
        "relationships": relationships, "roles": roles, "dimensions": dimensions, "measures": measures,
    }
    dates = [t for t in model.tables if kinds[t.name] == "date"]
    if dates:
        definition["time_intelligence"] = {"date_dimension": {"dimension_id": dates[0].name, "table_name": ident(dates[0].name)}}
    schemas = {ident(t.name): ", ".join(f"`{ident(c.source or c.name)}` {TYPES.get(c.type, 'string')}" for c in t.columns if not c.expression) for t in model.tables if not t.calculated}
    return Converted(definition, schemas, load_specs(model), report)


def _entry(id_: str, column: str, ordinal: int, **more: Any) -> dict[str, Any]:
    return {"id": id_, "physical_field": column, "caption": id_, "hierarchy_name": id_, "all_level_name": "(All)", "leaf_level_name": id_, "ordinal": ordinal, "visible": True, "has_all": True, "cardinality_hint": 0, **more}


def _link(a: Table, b: Table, r: TabularRelationship, id_: str, physical) -> dict[str, Any]:
    return {"fact_table": ident(a.name), "fact_column": physical(a, r.from_column), "dimension_id": id_, "dim_table": ident(b.name), "dim_column": physical(b, r.to_column)}


def _row_filter(text: str, tables: dict[str, Table], table: str, physical) -> str:
    """A role's DAX condition as SQL over the table; FALSE where it cannot be lowered, so that nothing leaks."""
    try:
        t = tables[table.lower()]
        lowerer = dax.Lowerer(lambda _, name: (physical(t, name), None))
        plain = re.sub(r"(?<![\w\]'])\[([^\]]+)\]", lambda m: f"'{t.name}'[{m.group(1)}]", text)
        return lowerer._condition(dax.parse(plain))[0]
    except (dax.Unsupported, KeyError):
        return "FALSE"


def load_specs(model: TabularModel) -> list[dict[str, Any]]:
    """Per table a reader specification, or why it has to be loaded by hand."""
    out = []
    for t in model.tables:
        for p in t.partitions or [Partition(t.name, "none")]:
            entry: dict[str, Any] = {"table": ident(t.name), "kind": p.kind}
            source = extract_source(p.expression) if p.kind == "m" else None
            if p.kind == "query":
                entry["reader"] = {"format": "jdbc", "options": {"query": p.expression}}
            elif source is not None:
                entry["reader"] = source.reader()
                if is_complex(p.expression):
                    entry["note"] = "the expression reshapes its source; check the result"
            elif p.kind in ("calculated", "calculationGroup"):
                entry["note"] = "computed by the model, not loaded"
            else:
                entry["note"] = "no readable source; load by hand"
            out.append(entry)
    return out


def inventory(model: TabularModel) -> dict[str, Any]:
    """Counts and classes of what a model holds."""
    kinds = classify_tables(model)
    classes: dict[str, int] = {}
    for t in model.tables:
        for m in t.measures:
            classes[c] = classes.get(c := dax.classify(m.expression), 0) + 1
    sources = [extract_source(p.expression) for t in model.tables for p in t.partitions if p.kind == "m"]
    return {
        "model": model.name, "tables": {k: sorted(n for n, x in kinds.items() if x == k) for k in sorted(set(kinds.values()))}, "columns": sum(len(t.columns) for t in model.tables),
        "measures": classes, "relationships": len(model.relationships), "roles": [r.name for r in model.roles], "sources": sorted({s.kind for s in sources if s}),
        "hierarchies": sum(len(t.hierarchies) for t in model.tables),
    }


def qualify(model: TabularModel) -> dict[str, Any]:
    """READY where everything converts, PARTIAL where some measures or loads need work, BLOCKED where there is no fact or no measure works."""
    converted = convert(model)
    manual = [r["measure"] for r in converted.report if r["status"] == "manual"]
    by_hand = [x["table"] for x in converted.loads if "reader" not in x and x["kind"] not in ("calculated", "calculationGroup")]
    facts = [n for n, k in classify_tables(model).items() if k == "fact"]
    blocked = not facts or (converted.report and len(manual) == len(converted.report))
    return {"verdict": "BLOCKED" if blocked else "PARTIAL" if manual or by_hand else "READY", "facts": facts, "manual_measures": manual, "tables_to_load_by_hand": by_hand, "measures": len(converted.report)}


def dummy_tables(spark, model: TabularModel, fact_rows: int = 10_000, dimension_rows: int = 1_000) -> dict[str, Any]:
    """A generated DataFrame per table: typed values from row numbers, keys within the rows of the table they point to."""
    from pyspark.sql import functions as F

    kinds = classify_tables(model)
    rows = {t.name.lower(): fact_rows if kinds[t.name] == "fact" else dimension_rows for t in model.tables}
    keys = {(r.from_table.lower(), r.from_column.lower()): r.to_table.lower() for r in model.relationships}
    targets = {(r.to_table.lower(), r.to_column.lower()) for r in model.relationships}
    out = {}
    for t in model.tables:
        if t.calculated or kinds[t.name] == "date":
            continue
        i, columns = F.col("id"), []
        for c in t.columns:
            place = (t.name.lower(), c.name.lower())
            dated = place in keys and kinds[next(x.name for x in model.tables if x.name.lower() == keys[place])] == "date"
            if dated or c.type == "dateTime":
                day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64(i, F.lit(c.name)), F.lit(4018)).cast("int"))
                value = day.cast("timestamp") if c.type == "dateTime" else (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("long")
            elif place in keys:
                value = F.pmod(i - 1, F.lit(rows[keys[place]])) + 1
            elif c.key or place in targets:
                value = i
            elif c.type in _NUMBERS:
                value = F.pmod(F.xxhash64(i, F.lit(c.name)), F.lit(1000)) + (0 if c.type == "int64" else 0.5)
            elif c.type == "boolean":
                value = F.pmod(i, F.lit(2)) == 0
            else:
                value = F.concat(F.lit(f"{c.name} "), F.pmod(i, F.lit(20)).cast("string"))
            columns.append(value.cast(TYPES.get(c.type, "string")).alias(ident(c.source or c.name)))
        if columns:
            out[ident(t.name)] = spark.range(1, rows[t.name.lower()] + 1).select(*columns)
    return out
