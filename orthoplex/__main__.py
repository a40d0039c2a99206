"""python -m orthoplex: serve a cube, convert or judge a tabular model, infer a definition, query, replay."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()


def _cube(args):
    from orthoplex.functions.calendar import calendar
    from orthoplex.operators.cube import Cube
    from orthoplex.plans.model import load_model

    spark, model = _session(), load_model(args.model)
    names = dict.fromkeys([f.table for f in model.facts] + [r.table for r in model.relationships] + [d.table for d in model.dimensions if d.table])
    tables = {n: spark.read.parquet(str(p)) for n in names if (p := Path(args.data) / f"{n}.parquet").exists()}
    date = model.date_dimension.table if model.date_dimension else None
    if date and date not in tables:
        tables[date] = calendar(spark)
    return Cube(spark, model, tables, calendars=frozenset([date] if date else []))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="orthoplex")
    sub = top.add_subparsers(dest="verb", required=True)
    for verb in ("serve", "query", "replay"):
        p = sub.add_parser(verb)
        p.add_argument("--model", required=True)
        p.add_argument("--data", required=True)
        if verb == "serve":
            p.add_argument("--host", default="127.0.0.1")
            p.add_argument("--port", type=int, default=8080)
            p.add_argument("--rollups")
            p.add_argument("--trace")
        elif verb == "query":
            p.add_argument("mdx")
        else:
            p.add_argument("trace")
            p.add_argument("--iterations", type=int, default=0)
            p.add_argument("--workers", type=int, default=1)
    for verb in ("convert", "inventory", "qualify"):
        p = sub.add_parser(verb)
        p.add_argument("source")
        if verb == "convert":
            p.add_argument("target")
    p = sub.add_parser("auto-model")
    p.add_argument("data")
    p.add_argument("--fact")
    args = top.parse_args(argv)
    if args.verb in ("convert", "inventory", "qualify"):
        from orthoplex.sources import tabular

        model = tabular.load(args.source)
        if args.verb != "convert":
            print(json.dumps(getattr(tabular, args.verb)(model), indent=2))
            return 0
        done, target = tabular.convert(model), Path(args.target)
        target.mkdir(parents=True, exist_ok=True)
        for name, part in (("model", done.definition), ("schemas", done.schemas), ("loads", done.loads), ("report", done.report)):
            (target / f"{name}.json").write_text(json.dumps(part, indent=2), encoding="utf-8")
        return 0
    if args.verb == "auto-model":
        from orthoplex.sources.automodel import infer

        spark = _session()
        tables = {p.name.removesuffix(".parquet"): spark.read.parquet(str(p)) for p in sorted(Path(args.data).glob("*.parquet"))}
        print(json.dumps(infer(tables, fact=args.fact), indent=2))
        return 0
    cube = _cube(args)
    if args.verb == "query":
        cube.query(args.mdx).show(1000, False)
        return 0
    from orthoplex.server.xmla import json_trace, make_server

    if args.verb == "serve":
        if args.rollups:
            from orthoplex.operators.rollup import build

            build(cube, args.rollups)
        make_server(cube, (args.host, args.port), trace=json_trace(args.trace) if args.trace else None).serve_forever()
        return 0
    from orthoplex.server import replay

    entries = replay.read_trace(args.trace)
    differ = replay.differences(cube, entries)
    speed = replay.load(cube, [e["request"] for e in entries], iterations=args.iterations, workers=args.workers) if entries and args.iterations else {}
    print(json.dumps({"entries": len(entries), "different": len(differ), **{k: round(v, 3) for k, v in speed.items()}}))
    return int(bool(differ))


if __name__ == "__main__":
    sys.exit(main())
