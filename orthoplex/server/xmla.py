"""XML for Analysis: requests in, rowsets and cellsets out.

A thin shell: the body of a SOAP request is parsed, the engine answers, and the
answer is written as XML.
"""

from __future__ import annotations

import json
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Row
from pyspark.sql.types import ArrayType, StructField, StructType

from orthoplex.operators.cellset import Axis, Cellset, cellset
from orthoplex.operators.cube import Cube
from orthoplex.operators.rowsets import rowset
from orthoplex.plans import mdx
from orthoplex.plans.model import User
from orthoplex.server.identity import user_of

MAX_BODY = 1 << 20

# XML namespaces of the protocol.
SOAP, ANALYSIS = "http://schemas.xmlsoap.org/soap/envelope/", "urn:schemas-microsoft-com:xml-analysis"
ROWSET, DATASET, EMPTY = ANALYSIS + ":rowset", ANALYSIS + ":mddataset", ANALYSIS + ":empty"
XSD, XSI = "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2001/XMLSchema-instance"
_XSD = {"string": "xsd:string", "smallint": "xsd:short", "int": "xsd:int", "bigint": "xsd:long", "double": "xsd:double", "boolean": "xsd:boolean", "timestamp": "xsd:dateTime", "timestamp_ntz": "xsd:dateTime", "date": "xsd:date", "float": "xsd:float"}


@dataclass
class Request:
    """kind: discover, execute, empty (a statement without text) or session."""

    kind: str
    name: str = ""
    restrictions: dict[str, str] = field(default_factory=dict)
    statement: str = ""
    properties: dict[str, str] = field(default_factory=dict)


class BadRequest(ValueError):
    pass


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_request(body: str) -> Request:
    if "<!DOCTYPE" in body or "<!ENTITY" in body:
        raise BadRequest("document types are not allowed")
    try:
        root = ET.fromstring(body)
    except ET.ParseError as e:
        raise BadRequest(str(e)) from None
    found = {_local(x.tag): x for x in root.iter()}

    def values(name: str) -> dict[str, str]:
        top = found.get(name)
        return {} if top is None else {_local(x.tag): (x.text or "").strip() for x in top}

    if "Discover" in found:
        kind = found.get("RequestType")
        return Request("discover", (kind.text or "").strip() if kind is not None else "", values("RestrictionList"), properties=values("PropertyList"))
    if "Execute" in found:
        statement = found.get("Statement")
        text = (statement.text or "").strip() if statement is not None else ""
        return Request("execute" if text else "empty", statement=text, properties=values("PropertyList"))
    if "BeginSession" in found:
        return Request("session")
    raise BadRequest("neither Discover nor Execute")


def envelope(method: str, root: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?><soap:Envelope xmlns:soap="{SOAP}"><soap:Body><{method}Response xmlns="{ANALYSIS}"><return>{root}</return></{method}Response></soap:Body></soap:Envelope>'


def fault(message: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?><soap:Envelope xmlns:soap="{SOAP}"><soap:Body><soap:Fault><faultcode>soap:Client</faultcode><faultstring>{escape(message)}</faultstring></soap:Fault></soap:Body></soap:Envelope>'


def element_name(name: str) -> str:
    """A column's name as an XML name."""
    return "".join(c if c.isalnum() or c in "_-." else f"_x{ord(c):04X}_" for c in name)


def _declared(field: StructField) -> str:
    """The schema element of a column; an array repeats its element."""
    kind, many = field.dataType, ""
    if isinstance(kind, ArrayType):
        kind, many = kind.elementType, ' maxOccurs="unbounded"'
    head = f'<xsd:element sql:field={quoteattr(field.name)} name={quoteattr(element_name(field.name))} minOccurs="0"{many}'
    if isinstance(kind, StructType):
        return f'{head}><xsd:complexType><xsd:sequence>{"".join(map(_declared, kind))}</xsd:sequence></xsd:complexType></xsd:element>'
    return f'{head} type="{_XSD.get(kind.simpleString().split("(")[0], "xsd:string")}"/>'


def _fields(value: Row) -> str:
    """The elements of a row; nulls are left out."""
    out = []
    for name, found in zip(value.__fields__, value):
        x = element_name(name)
        for one in found if isinstance(found, list) else [found]:
            if one is not None:
                out.append(f"<{x}>{_fields(one) if isinstance(one, Row) else escape(_text(one))}</{x}>")
    return "".join(out)


def rowset_xml(df: DataFrame) -> str:
    """A DataFrame as a rowset with its inline schema."""
    schema = "".join(map(_declared, df.schema))
    head = f'<xsd:schema targetNamespace="{ROWSET}" xmlns:sql="urn:schemas-microsoft-com:xml-sql" elementFormDefault="qualified"><xsd:element name="root"><xsd:complexType><xsd:sequence minOccurs="0" maxOccurs="unbounded"><xsd:element name="row" type="row"/></xsd:sequence></xsd:complexType></xsd:element><xsd:complexType name="row"><xsd:sequence>{schema}</xsd:sequence></xsd:complexType></xsd:schema>'
    rows = [f"<row>{_fields(r)}</row>" for r in df.toLocalIterator()]
    return f'<root xmlns="{ROWSET}" xmlns:xsd="{XSD}" xmlns:xsi="{XSI}">{head}{"".join(rows)}</root>'


def _text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def _axis_info(axis: Axis) -> str:
    names = list(dict.fromkeys(m.hierarchy for t in axis.tuples[:1] for m in t))
    parts = "".join(f'<HierarchyInfo name={quoteattr(h)}>' + "".join(f'<{p} name={quoteattr(f"{h}.{q}")}/>' for p, q in (("UName", "[MEMBER_UNIQUE_NAME]"), ("Caption", "[MEMBER_CAPTION]"), ("LName", "[LEVEL_UNIQUE_NAME]"), ("LNum", "[LEVEL_NUMBER]"), ("DisplayInfo", "[DISPLAY_INFO]"))) + "</HierarchyInfo>" for h in names)
    return f'<AxisInfo name="{axis.name}">{parts}</AxisInfo>'


def _axis(axis: Axis) -> str:
    tuples = "".join(
        "<Tuple>" + "".join(f"<Member Hierarchy={quoteattr(m.hierarchy)}><UName>{escape(m.unique)}</UName><Caption>{escape(m.caption)}</Caption><LName>{escape(m.level)}</LName><LNum>{m.level_number}</LNum><DisplayInfo>{m.info}</DisplayInfo>" + (f"<PARENT_UNIQUE_NAME>{escape(m.parent)}</PARENT_UNIQUE_NAME>" if m.parent else "") + "</Member>" for m in t) + "</Tuple>"
        for t in axis.tuples
    )
    return f'<Axis name="{axis.name}"><Tuples>{tuples}</Tuples></Axis>'


def cellset_xml(found: Cellset, cube: str) -> str:
    axes = [*found.axes, found.slicer]
    info = "".join(map(_axis_info, axes))
    cells = "".join(f'<Cell CellOrdinal="{c.ordinal}"><Value xsi:type="xsd:{"string" if isinstance(c.value, str) else "double"}">{escape(c.value) if isinstance(c.value, str) else repr(c.value)}</Value><FmtValue>{escape(c.formatted)}</FmtValue></Cell>' for c in found.cells)
    return (
        f'<root xmlns="{DATASET}" xmlns:xsi="{XSI}" xmlns:xsd="{XSD}"><OlapInfo><CubeInfo><Cube><CubeName>{escape(cube)}</CubeName></Cube></CubeInfo><AxesInfo>{info}</AxesInfo>'
        f'<CellInfo><Value name="VALUE"/><FmtValue name="FORMATTED_VALUE"/></CellInfo></OlapInfo><Axes>{"".join(map(_axis, axes))}</Axes><CellData>{cells}</CellData></root>'
    )


def respond(cube: Cube, body: str, user: User | None = None) -> str:
    """The answer to a request body; errors become SOAP faults."""
    try:
        request = parse_request(body)
        if request.kind == "discover":
            return envelope("Discover", rowset_xml(rowset(cube, request.name, request.restrictions, user)))
        if request.kind in ("empty", "session"):
            return envelope("Execute", f'<root xmlns="{EMPTY}"/>')
        if mdx.parse(request.statement).drillthrough:
            return envelope("Execute", rowset_xml(cube.query(request.statement, user)))
        return envelope("Execute", cellset_xml(cellset(cube, request.statement, user), cube.model.cube))
    except (ValueError, KeyError) as e:
        return fault(str(e).strip("'\""))


def make_server(cube: Cube, address: tuple[str, int] = ("127.0.0.1", 8080), *, trace: Callable[[dict], None] | None = None, keys: list[dict] | None = None) -> ThreadingHTTPServer:
    """POST /xmla answers requests; the identity comes from a token signed by one of ``keys`` or from a trusted header, as the model says."""
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path.rstrip("/") != "/xmla" or size > MAX_BODY:
                self.send_error(413 if size > MAX_BODY else 404)
                return
            body = self.rfile.read(size).decode("utf-8", "replace")
            user = user_of(self.headers, cube.model.auth, keys)
            began = time.perf_counter()
            answer = respond(cube, body, user)
            if trace:
                trace({"request": body, "response": answer, "ms": round(1000 * (time.perf_counter() - began), 3)})
            data = answer.encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/xml; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            return

    return ThreadingHTTPServer(address, Handler)


def json_trace(path: str) -> Callable[[dict], None]:
    """Appends one JSON object per request to a file that ``spark.read.json`` reads."""

    def write(entry: dict) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(entry) + "\n")

    return write
