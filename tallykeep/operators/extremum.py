"""MIN and MAX: a mergeable multiset for whole batches, and the bounded window with its frontier for single decisions."""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shapes import QueryShape


def multiset(shape: QueryShape, rows: DataFrame) -> DataFrame:
    """How often each value stands in each group (g0.., v, cnt): signed counts of it merge like any sum."""
    groups = [F.col(c).alias(f"g{i}") for i, c in enumerate(shape.group_cols)]
    return rows.where(shape.predicate.on_rows(rows)).where(F.col(shape.agg_col).isNotNull()).groupBy(*groups, F.col(shape.agg_col).alias("v")).agg(F.count("*").alias("cnt"))


def merge_multiset(state: DataFrame, deltas: DataFrame) -> DataFrame:
    keys = [c for c in state.columns if c != "cnt"]
    return state.unionByName(deltas).groupBy(*keys).agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def extremum(state: DataFrame, agg_fn: str) -> DataFrame:
    groups = [c for c in state.columns if c not in ("v", "cnt")]
    return state.groupBy(*groups).agg((F.min if agg_fn == "min" else F.max)("v").alias("value"))


def best_window(state: DataFrame, agg_fn: str, width: int) -> DataFrame:
    """The best width values of each group, repeats included."""
    groups = [c for c in state.columns if c not in ("v", "cnt")]
    order = F.asc("v") if agg_fn == "min" else F.desc("v")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    state = state.withColumn("rank", rank).where(F.col("rank") <= width).drop("rank")  # a value counts at least once
    before = F.coalesce(F.sum("cnt").over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return state.withColumn("before", before).where(F.col("before") < width).withColumn("cnt", F.least("cnt", F.lit(width) - F.col("before"))).drop("before")


def _exact(v):
    try:
        return Decimal(str(v)) if not isinstance(v, bool) else v
    except InvalidOperation:
        return v


@dataclass
class GroupWindow:
    values: list = field(default_factory=list)  # best first, as sort keys
    total: int = 0
    frontier: object = None  # the best value ever evicted


class ExtremumWindow:
    """The best width values of each group; what lies beyond the frontier is only counted.

    process() takes one event and answers (decision, reason); after an invalidation the caller reseeds.
    """

    def __init__(self, shape: QueryShape, width: int = 8):
        if shape.agg_fn not in ("min", "max") or width < 1:
            raise ValueError("needs a min or max shape and a positive width")
        self.shape, self.width, self.groups, self.seeded = shape, width, {}, False
        self.sign = 1 if shape.agg_fn == "min" else -1

    def _key(self, row: dict):
        return tuple(row[c] for c in self.shape.group_cols) if self.shape.group_cols else "extremum"

    def seed(self, rows: list[dict]) -> None:
        self.groups, self.seeded = {}, True
        for r in rows:
            if self._matches(r) and r[self.shape.agg_col] is not None:
                self._insert(self._key(r), _exact(r[self.shape.agg_col]))

    def _matches(self, row: dict) -> bool:
        tests = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        return all(row[c] is not None and tests[op](row[c], v) for c, op, v in self.shape.predicate.terms)

    def _rank(self, v):
        return v * self.sign

    def _insert(self, key, v) -> None:
        w = self.groups.setdefault(key, GroupWindow())
        w.total += 1
        rank = self._rank(v)
        if w.frontier is not None and rank >= w.frontier:
            return
        insort(w.values, rank)
        if len(w.values) > self.width:
            w.frontier = w.values.pop()

    def _delete(self, key, v) -> bool:
        """False if the window is used up while rows remain."""
        w = self.groups.get(key)
        if w is None:
            return False
        rank = self._rank(v)
        if rank in w.values:
            w.values.remove(rank)
        elif w.frontier is None or rank < w.frontier:
            return False
        w.total -= 1
        if not w.total:
            del self.groups[key]
        return bool(w.values) or not w.total

    def value(self, key="extremum"):
        w = self.groups.get(key)
        return self.sign * w.values[0] if w and w.values else None

    def process(self, relation: str, op: str, old: dict | None, new: dict | None, schema_change: bool = False) -> tuple[str, str]:
        if schema_change or op in ("SCHEMA_CHANGE", "DDL", "TRUNCATE"):
            return "invalidate", "schema_evolution"
        if relation.lower() != self.shape.relation.lower():
            return "preserve", "unrelated_relation"
        if not self.seeded:
            return "invalidate", "missing_aggregate_state"
        need = {self.shape.agg_col, *self.shape.group_cols, *self.shape.predicate.columns}
        if old and new and not any(old.get(c) != new.get(c) or (c in old) != (c in new) for c in need):
            return "preserve", "disjoint_columns"
        if any(img is not None and not need <= img.keys() for img in (old, new)) or (old is None and new is None):
            return "invalidate", "missing_evidence_for_repair"
        for img in (old, new):
            if img and isinstance(img[self.shape.agg_col], (float, bool)):
                return "invalidate", "invalid_evidence_type"
        try:
            was = old is not None and self._matches(old) and old[self.shape.agg_col] is not None
            now = new is not None and self._matches(new) and new[self.shape.agg_col] is not None
        except TypeError:
            return "invalidate", "invalid_evidence_type"
        if not was and not now:
            return "preserve", "predicate_miss"
        a, b = (_exact(old[self.shape.agg_col]) if was else None), (_exact(new[self.shape.agg_col]) if now else None)
        if was and now and a == b and self._key(old) == self._key(new):
            return "preserve", "noop_update"
        if now and not was:
            self._insert(self._key(new), b)
            return "repair", "insert"
        whole = self._delete(self._key(old), a)
        if now:  # an update's second leg may fill the window again
            self._insert(self._key(new), b)
            w = self.groups.get(self._key(old))
            whole = whole or (w is not None and bool(w.values) and self._rank(b) == w.values[0])
        if not whole:
            self.seeded = False
            return "invalidate", "extremum_window_exhausted"
        return "repair", "value_change" if now else "delete"


def window_decisions(shape: QueryShape, rows: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Decisions of the bounded window for one stream each (stream_id, seq, decision, reason).

    events have stream_id, seq, relation, op, old and new (maps of texts, numbers as texts); rows are each
    stream's seed (stream_id, row: map). Streams are dealt over tasks; within one, order decides.
    """

    def run(key, seeds: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        w = ExtremumWindow(shape, width)
        as_row = lambda m: None if m is None else {k: (_exact(v) if k == shape.agg_col and v is not None else v) for k, v in dict(m).items()}
        w.seed([as_row(m) for m in seeds["row"]])
        out = []
        for e in changes.sort_values("seq").itertuples():
            out.append((key[0], e.seq, *w.process(e.relation, e.op, as_row(e.old), as_row(e.new))))
        return pd.DataFrame(out, columns=["stream_id", "seq", "decision", "reason"])

    return rows.groupBy("stream_id").cogroup(events.groupBy("stream_id")).applyInPandas(run, "stream_id string, seq long, decision string, reason string")
