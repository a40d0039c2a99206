"""Data sources named in Power Query (M) expressions, as reader specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_STEP = r"\s*\(\s*\"([^\"]*)\"\s*,\s*\"([^\"]*)\""
_DATABASES = {"Sql": ("sqlserver", "jdbc:sqlserver://{server};databaseName={database}"), "PostgreSQL": ("postgresql", "jdbc:postgresql://{server}/{database}"), "MySQL": ("mysql", "jdbc:mysql://{server}/{database}")}
_ITEM = re.compile(r"\{\s*\[\s*(?:Schema\s*=\s*\"([^\"]*)\"\s*,\s*)?(?:Item|Name)\s*=\s*\"([^\"]*)\"", re.I)
_COMPLEX = re.compile(r"Table\.(?:NestedJoin|Join|Combine|Group|Pivot|Unpivot|AddColumn|Transform(?:Rows|Columns)|ExpandTableColumn|Buffer)|List\.|Function\.|each\s+if|try\s", re.I)


@dataclass(frozen=True)
class SourceConnection:
    """kind: sqlserver, postgresql, mysql, csv or named; what the source reads from."""

    kind: str
    server: str = ""
    database: str = ""
    schema: str = ""
    table: str = ""
    query: str = ""
    path: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def reader(self) -> dict[str, Any]:
        """format, options and path for ``spark.read``; credentials are the caller's."""
        if self.kind == "csv":
            return {"format": "csv", "options": {"header": "true", **self.options}, "path": self.path}
        if self.kind == "named":
            return {"format": "table", "options": {}, "path": self.path}
        url = next(u for k, u in _DATABASES.values() if k == self.kind).format(server=self.server, database=self.database)
        name = f"{self.schema}.{self.table}" if self.schema else self.table
        return {"format": "jdbc", "options": {"url": url, **({"query": self.query} if self.query else {"dbtable": name})}}


def _text(value: str) -> str:
    return value.replace('""', '"').replace("#(lf)", "\n").replace("#(cr)", "\r").replace("#(tab)", "\t")


def extract_source(expression: str) -> SourceConnection | None:
    """The first source of an M expression; None where it names none that can be read."""
    for function, (kind, _) in _DATABASES.items():
        m = re.search(rf"\b{function}\.Databases?{_STEP}", expression)
        if m is None and (m := re.search(rf"\b{function}\.Databases?\s*\(\s*\"([^\"]*)\"", expression)):
            parts = _ITEM.findall(expression)
            return SourceConnection(kind, m.group(1), parts[0][1] if parts else "", parts[-1][0] if parts else "", parts[-1][1] if len(parts) > 1 else "")
        if m:
            query = re.search(r"\[\s*Query\s*=\s*\"((?:[^\"]|\"\")*)\"", expression) or re.search(r"Value\.NativeQuery\s*\([^,]+,\s*\"((?:[^\"]|\"\")*)\"", expression)
            item = _ITEM.search(expression, m.end())
            schema = item.group(1) or "" if item else ""
            return SourceConnection(kind, m.group(1), m.group(2), schema, item.group(2) if item else "", _text(query.group(1)) if query else "")
    m = re.search(r"Csv\.Document\s*\(\s*(?:Web|File)\.Contents\s*\(\s*\"([^\"]*)\"", expression) or (re.search(r"(?:Web|File)\.Contents\s*\(\s*\"([^\"]*)\"", expression) if "Csv.Document" in expression else None)
    if m:
        options = {}
        if d := re.search(r"Delimiter\s*=\s*\"([^\"]*)\"", expression):
            options["sep"] = _text(d.group(1))
        if e := re.search(r"Encoding\s*=\s*(\d+)", expression):
            options["encoding"] = {"65001": "UTF-8", "1252": "windows-1252", "28591": "ISO-8859-1"}.get(e.group(1), "UTF-8")
        return SourceConnection("csv", path=m.group(1), options=options)
    m = re.search(r"Source\s*=\s*#?\"?([A-Za-z_][\w ]*)\"?\s*[,\n]", expression)
    if m and "(" not in m.group(0):
        item = _ITEM.search(expression)
        return SourceConnection("named", path=m.group(1).strip(), schema=(item.group(1) or "") if item else "", table=item.group(2) if item else "")
    return None


def is_complex(expression: str) -> bool:
    """Whether the expression reshapes its source, so that reading the source alone is not the same."""
    return bool(_COMPLEX.search(expression))
