"""Recorded requests: what they ask, whether answers still agree, how fast they come."""

from __future__ import annotations

import json
import time
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from orthoplex.operators.cube import Cube
from orthoplex.plans import mdx
from orthoplex.plans.model import User
from orthoplex.server.xmla import BadRequest, parse_request, respond


def read_trace(path: str) -> list[dict[str, Any]]:
    """Entries as ``json_trace`` writes them."""
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def statements(entries: Iterable[dict[str, Any]]) -> list[str]:
    """The different statements of a trace, most frequent first."""
    seen: Counter = Counter()
    for e in entries:
        try:
            request = parse_request(e["request"])
        except BadRequest:
            continue
        if request.kind == "execute":
            seen[request.statement] += 1
    return [s for s, _ in seen.most_common()]


def shapes(text: str) -> set[str]:
    """What a statement uses: functions, sub-selects, slicer, several axes, calculated members, drill-through."""
    s = mdx.parse(text)
    out = {t for t, on in (("drillthrough", s.drillthrough), ("subselect", s.subselects), ("slicer", s.where is not None), ("with", s.withs), ("two axes", len(s.axes) > 1), ("no axis", not s.axes), ("properties", any(a.properties for a in s.axes))) if on}
    todo: list[object] = [a.set for a in s.axes]
    while todo:
        node = todo.pop()
        if isinstance(node, mdx.Call):
            out.add(node.name)
            todo += node.args
        elif isinstance(node, (mdx.Braces, mdx.Tuple)):
            todo += node.items
        elif isinstance(node, mdx.Minus):
            out.add("exclusion")
            todo.append(node.item)
        elif isinstance(node, mdx.Name):
            if node.tail:
                out.add(node.tail.split(".")[-1])
            if sum(k for _, k in node.parts) > 1:
                out.add("compound key")
    return out


def _facts(xml: str) -> tuple[list[str], list[str]]:
    """Captions and values of a cellset or rowset, in order."""
    root = ET.fromstring(xml)
    local = [(e.tag.rsplit("}", 1)[-1], (e.text or "").strip()) for e in root.iter()]
    return [t for n, t in local if n in ("Caption", "MEMBER_CAPTION")], [t for n, t in local if n == "Value" and t]


def differences(cube: Cube, entries: Iterable[dict[str, Any]], user: User | None = None, tolerance: float = 1e-6) -> list[dict[str, Any]]:
    """Entries whose captions or values differ from the recorded answer."""
    out = []
    for e in entries:
        now = respond(cube, e["request"], user)
        if now == e["response"]:
            continue
        (captions, values), (old_captions, old_values) = _facts(now), _facts(e["response"])
        same = len(values) == len(old_values) and all(abs(float(a) - float(b)) <= tolerance * max(1.0, abs(float(b))) for a, b in zip(values, old_values, strict=True))
        if captions != old_captions or not same:
            out.append({"request": e["request"], "captions": captions != old_captions, "values": not same})
    return out


def load(cube: Cube, bodies: list[str], *, iterations: int = 100, workers: int = 1, warm_up: int = 5, user: User | None = None) -> dict[str, float]:
    """Requests a second, error rate and percentiles of the latency in ms, over a number of requests sent by some workers at once."""
    for k in range(min(warm_up, iterations)):
        respond(cube, bodies[k % len(bodies)], user)

    def one(k: int) -> tuple[float, bool]:
        began = time.perf_counter()
        answer = respond(cube, bodies[k % len(bodies)], user)
        return 1000 * (time.perf_counter() - began), "Fault>" in answer

    began = time.perf_counter()
    with ThreadPoolExecutor(workers) as pool:
        done = list(pool.map(one, range(iterations)))
    took, times = time.perf_counter() - began, sorted(t for t, _ in done)
    at = {f"p{p}_ms": times[min(len(times) - 1, len(times) * p // 100)] for p in (50, 90, 95, 99)}
    return {"requests": iterations, "per_second": iterations / took, "error_rate": sum(f for _, f in done) / iterations, **at, "max_ms": times[-1]}
