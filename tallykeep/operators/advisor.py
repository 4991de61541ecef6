"""Workload analytics: which writes hit which cached shapes, and why."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.shapes import QueryShape
from .certify import certify_all, prepared


def decisions(events: DataFrame, shapes: list[QueryShape]) -> DataFrame:
    """A row for each event and shape on its relation, from one pass: seq, shape, decision, reason, cols (touched columns), hit."""
    return certify_all(events, shapes, own_relation=True).withColumn("hit", F.col("decision") != "preserve")


def report(found: DataFrame) -> DataFrame:
    """Invalidations by table and by shape, and the share avoided in percent."""
    n = found.agg(F.count("*").alias("table_invalidations"), F.count(F.when(F.col("hit"), 1)).alias("shape_invalidations"))
    share = F.when(F.col("table_invalidations") > 0, (F.col("table_invalidations") - F.col("shape_invalidations")) / F.col("table_invalidations") * 100.0).otherwise(0.0)
    return n.withColumn("avoided_pct", share)


def gravity_wells(found: DataFrame) -> DataFrame:
    """How often each column takes part in a hit."""
    hits = found.where("hit").select("shape", F.explode(F.transform("cols", lambda c: F.concat_ws(".", F.col("relation"), c))).alias("column"))
    return hits.groupBy("column").agg(F.count("*").alias("hits"), F.count_distinct("shape").alias("shapes"))


def co_invalidation(found: DataFrame) -> DataFrame:
    """Pairs of shapes hit by the same event: both repaired, both invalidated, or mixed.

    Each event's hits are at most as many as shapes, so the pairs are made within its row.
    """
    hits = found.where("hit").groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("shape", "decision"))).alias("h"))
    pairs = F.flatten(F.transform("h", lambda a: F.transform(F.filter("h", lambda b: b["shape"] > a["shape"]), lambda b: F.struct(a["shape"].alias("a"), b["shape"].alias("b"), a["decision"].alias("x"), b["decision"].alias("y")))))
    p = hits.select(F.explode(pairs).alias("p")).select("p.*")
    both = lambda d: F.count(F.when((F.col("x") == d) & (F.col("y") == d), 1))
    out = p.groupBy("a", "b").agg(F.count("*").alias("total"), both("repair").alias("both_repair"), both("invalidate").alias("both_invalidate"))
    return out.withColumn("mixed", F.col("total") - F.col("both_repair") - F.col("both_invalidate"))


def entropy(found: DataFrame) -> DataFrame:
    n = found.where("hit").groupBy("shape").count()
    p = F.col("count") / F.col("total")
    return n.crossJoin(F.broadcast(n.agg(F.sum("count").alias("total")))).agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"))  # one row


def topology(shapes: list[str], edges: set[tuple[str, str]]) -> dict:
    """Components, isolated shapes, first Betti number, coupling and largest component of the shapes' graph."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, sizes = set(), []
    for s in near:
        if s not in seen:
            todo, size = [s], 0
            seen.add(s)
            while todo:
                x = todo.pop()
                size += 1
                new = near[x] - seen
                seen |= new
                todo += new
            sizes.append(size)
    n = len(shapes)
    return {
        "components": len(sizes), "isolated": n - len(near), "beta1": max(0, len(edges) - len(near) + len(sizes)),
        "coupling_pct": len(edges) / (n * (n - 1) / 2) * 100 if n > 1 else 0.0, "largest": max(sizes, default=1 if n else 0),
    }


def intersections(events: DataFrame, shapes: list[QueryShape]) -> DataFrame:
    """Hits by columns alone (seq, shape): equal relation and a changed column in the fingerprint; nothing is certified."""
    hit = [f"if(_rel = {V.text_sql(V.relation_name(s.relation))} and arrays_overlap(changed, {V.names_sql(s.fingerprint())}), {V.text_sql(s.name)}, null)" for s in shapes]
    return prepared(events).select("seq", F.explode_outer(F.expr(f"array({', '.join(hit)})")).alias("shape")).where("shape is not null")


def pair_counts(hits: DataFrame) -> DataFrame:
    """For each pair of shapes (a <= b) how many events hit both: the entries of the sum of v times its transpose."""
    by_event = hits.groupBy("seq").agg(F.array_sort(F.collect_set("shape")).alias("h"))
    pairs = F.flatten(F.transform("h", lambda a: F.transform(F.filter("h", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return by_event.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("events"))


def density(pairs: list[tuple[str, str, int]], shapes: list[str]) -> dict:
    """Purity, entropy, largest eigenvalue and dominant shapes of the hit matrix with unit trace."""
    at = {s: i for i, s in enumerate(shapes)}
    m = np.zeros((len(shapes), len(shapes)))
    for a, b, n in pairs:
        m[at[a], at[b]] = m[at[b], at[a]] = n
    trace = np.trace(m)
    if not trace:
        return {"purity": 0.0, "entropy": 0.0, "lambda1": 0.0, "dominant": []}
    value, vector = np.linalg.eigh(m / trace)
    top = vector[:, -1]
    some = value[value > 1e-9]
    return {"purity": float((value**2).sum()), "entropy": float(-(some * np.log2(some)).sum()), "lambda1": float(value[-1]), "dominant": [s for s in shapes if abs(top[at[s]]) > 0.5 / math.sqrt(len(shapes))]}


def workload_score(events: DataFrame, shapes: list[QueryShape]) -> dict:
    """Score of a workload: first Betti number, plus coupling, plus the share of its largest component; less is better."""
    pairs = pair_counts(intersections(events, shapes)).where("a < b").collect()  # at most as many as pairs of shapes
    t = topology([s.name for s in shapes], {(r["a"], r["b"]) for r in pairs})
    return t | {"score": t["beta1"] + t["coupling_pct"] / 100 + t["largest"] / max(1, len(shapes))}


def compare(before: tuple[DataFrame, list[QueryShape]], after: tuple[DataFrame, list[QueryShape]]) -> dict:
    a, b = workload_score(*before), workload_score(*after)
    wells = gravity_wells(decisions(*before)).where("shapes > 1").orderBy(F.desc("hits"), "column").limit(5).collect()
    return {"before": a, "after": b, "improvement": a["score"] - b["score"], "lift_columns": [r["column"] for r in wells]}


# ---------------------------------------------------------------- doctor


def base_type(name: str) -> str:
    n = name.lower()
    if any(x in n for x in ("char", "text", "string", "uuid")):
        return "text"
    if any(x in n for x in ("int", "serial", "numeric", "decimal", "money", "float", "double", "real")):
        return "number"
    return "bool" if "bool" in n else "time" if "date" in n or "time" in n else n


def index_advice(shape: QueryShape) -> str | None:
    keys = sorted(shape.predicate.columns | shape.predicate_cols | set(shape.group_cols) | shape.join_cols)
    if not keys:
        return None
    include = sorted((shape.projection_cols | ({shape.agg_col} if shape.agg_col else set())) - set(keys))
    table = shape.relation.replace(".", "_")
    return f"CREATE INDEX ix_{table}_{'_'.join(keys)} ON {shape.relation} ({', '.join(keys)})" + (f" INCLUDE ({', '.join(include)})" if include else "")


def non_sargable(sql: str) -> list[str]:
    """Predicates that no index serves: a leading wildcard, a function or arithmetic around a column."""
    where = re.split(r"\bwhere\b", sql, flags=re.IGNORECASE)[1:]
    where = re.split(r"\b(?:group|order)\s+by\b", where[0], flags=re.IGNORECASE)[0] if where else ""
    out = []
    if re.search(r"\blike\s+'%", where, re.IGNORECASE):
        out.append("leading_wildcard")
    if re.search(r"\b(?!and\b|or\b|in\b|not\b)[a-z_]\w*\s*\(\s*[a-z_][\w.]*\s*[,)]", where, re.IGNORECASE):
        out.append("function_on_column")
    if re.search(r"[a-z_][\w.]*\s*[-+*/]\s*[\w.]+\s*(?:=|<|>|!)", where, re.IGNORECASE):
        out.append("arithmetic_on_column")
    return out


def doctor(shapes: list[QueryShape], types: dict[str, dict[str, str]], params: dict[str, dict[str, str]] | None = None, regimes: list[dict] = (), sql: dict[str, str] | None = None) -> dict:
    """Implicit conversions, missing indexes, predicates that no index serves, and skewed parameters."""
    conversions, indexes, slow = [], [], {}
    for s in shapes:
        have = types.get(s.relation, {})
        for c, _, v in s.predicate.terms:
            kind = "text" if isinstance(v, str) else "number"
            if c in have and base_type(have[c]) != kind:
                conversions.append((s.name, c, kind, have[c]))
        for c, kind in (params or {}).get(s.name, {}).items():
            if c in have and base_type(have[c]) != base_type(kind):
                conversions.append((s.name, c, kind, have[c]))
        if advice := index_advice(s):
            indexes.append(advice)
        if found := non_sargable((sql or {}).get(s.name, "")):
            slow[s.name] = found
    skew = [(r["relation"], r["column"]) for r in regimes if len(r.get("regimes", [])) > 1 and any(s.relation == r["relation"] and r["column"] in s.predicate.columns | s.predicate_cols | s.join_cols for s in shapes)]
    return {"implicit_conversions": conversions, "indexes": sorted(set(indexes)), "non_sargable": slow, "parameter_skew": skew}
