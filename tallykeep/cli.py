"""Command line: report, compare, doctor, matrix, ingest and normalize over workload files."""

from __future__ import annotations

import argparse
import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from .functions import design as D
from .functions import values as V
from .operators import advisor as A
from .operators.certify import certify
from .plans.admission import parse_join_sql, parse_sql
from .plans.shapes import Predicate, QueryShape
from .sources.cdc import coerce, decode_records, read_wal, tag
from .streaming.transactions import assemble


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        w = json.load(f)
    if not isinstance(w, dict) or not isinstance(w.get("shapes"), list) or not all(isinstance(s.get("relation"), str) for s in w["shapes"]):
        raise ValueError("a workload is an object with shapes, each with a relation")
    return w


def shape_of(s: dict) -> QueryShape:
    """A shape from its SQL if that is admitted, else from its lists of columns, whose predicate isn't known then."""
    if s.get("query"):
        got = parse_sql(s["query"], name=s.get("name", ""), security_cols=s.get("security_cols", ()))
        if got.is_supported:
            return got.shape
    cols = lambda k: frozenset(c.lower() for c in s.get(k) or [])
    agg = sorted(cols("aggregate_cols"))
    return QueryShape(V.relation_name(s["relation"]), "sum" if agg else None, agg[0] if agg else None, tuple(sorted(cols("group_cols"))), Predicate(), cols("projection_cols") | frozenset(agg[1:]), cols("security_cols"), s.get("name", s["relation"]), predicate_cols=cols("predicate_cols"), join_cols=cols("join_cols"))


def events_of(spark: SparkSession, w: dict) -> DataFrame:
    rows = []
    img = lambda m, types: {k.lower(): tag(coerce(v, types.get(k, ""))) for k, v in m.items()} if m else None
    for i, e in enumerate(w.get("events") or []):
        types = {c: t.get("type", "") for c, t in w.get("schema", {}).get(e["relation"], {}).get("columns", {}).items()}
        gone = [c.lower() for c in e.get("unavailable_cols") or []]
        changed = [c.lower() for c in e["changed_cols"]] if e.get("changed_cols") else None
        rows.append(("cli", i, e.get("event_id", f"evt_{i}"), e["relation"], e.get("explicit_operation"), bool(e.get("schema_change")), img(e.get("old"), types), img(e.get("new"), types), changed, gone or None, e.get("boundary_clock"), e.get("old_image_complete"), e.get("new_image_complete"), e.get("changed_cols_complete"), None))
    return spark.createDataFrame(rows, V.EVENT_SCHEMA)


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    if args.command == "ingest":
        released = assemble(decode_records(read_wal(spark, args.path)), args.strict)
        own = {r["reason"]: r["count"] for r in released.where("decision is not null").groupBy("reason").count().collect()}
        out = {"stream": own}
        got = parse_sql(args.sql)
        if got.is_supported:
            found = certify(released.where("decision is null"), got.shape).groupBy("decision", "reason").count().collect()
            return out | {"decisions": {f"{r['decision']}:{r['reason']}": r["count"] for r in found}}
        join = parse_join_sql(args.sql)
        return out | {"admitted": join.is_supported, "reason": join.reason or got.reason, "released": released.where("decision is null").count()}
    w = load(args.path)
    shapes = [shape_of(s) for s in w["shapes"]]
    if args.command == "normalize":
        out = {}
        for name, t in w.get("schema", {}).items():
            types = {c: v.get("type", "") for c, v in t.get("columns", {}).items()}
            r = D.Relation(name, frozenset(types), [D.FD.of(f) for f in t.get("functional_dependencies", [])], types)
            tables = D.synthesize(r)
            out[name] = {**D.classify(r), "tables": [sorted(x.attributes) for x in tables], "ddl": D.ddl(tables, args.dialect)}
        return out
    if args.command == "doctor":
        types = {n: {c: v.get("type", "") for c, v in t.get("columns", {}).items()} for n, t in w.get("schema", {}).items()}
        return A.doctor(shapes, types, {s["name"]: s["params"] for s in w["shapes"] if isinstance(s.get("params"), dict)}, w.get("observed_shape_types") or [], {s.get("name", ""): s.get("query", "") for s in w["shapes"]})
    events = events_of(spark, w)
    if args.command == "compare":
        other = load(args.other)
        return A.compare((events, shapes), (events_of(spark, other), [shape_of(s) for s in other["shapes"]]))
    if args.command == "matrix":
        pairs = [tuple(r) for r in A.pair_counts(A.intersections(events, shapes)).collect()]
        return A.density(pairs, [s.name for s in shapes])
    found = A.decisions(events, shapes).cache()
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  one for each shape, column or pair
    return {**rows(A.report(found))[0], "wells": rows(A.gravity_wells(found)), "pairs": rows(A.co_invalidation(found)), **rows(A.entropy(found))[0]}


def as_markdown(out: dict) -> str:
    return "\n".join(["| item | value |", "|-|-|", *(f"| {k} | {json.dumps(v, default=str)} |" for k, v in out.items())])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallykeep")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("report", "doctor", "matrix", "normalize", "compare", "ingest"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--format", choices=("json", "markdown", "text"), default="json")
        if name == "compare":
            c.add_argument("other")
        if name == "normalize":
            c.add_argument("--dialect", choices=("postgres", "mssql"), default="postgres")
        if name == "ingest":
            c.add_argument("--sql", required=True)
            c.add_argument("--strict", action="store_true")
    args = p.parse_args(argv)
    out = run(args, SparkSession.builder.appName("tallykeep").getOrCreate())
    if args.format == "json":
        print(json.dumps(out, default=lambda v: float(v) if isinstance(v, Decimal) else str(v), indent=2))
    else:
        print(as_markdown(out) if args.format == "markdown" else "\n".join(f"{k}: {v}" for k, v in out.items()))


if __name__ == "__main__":
    main()
