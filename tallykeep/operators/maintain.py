"""Maintenance of group state: signed contributions of repaired changes, merged into what is stored."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.shapes import JoinShape, QueryShape, cold_state, sum_type
from .certify import Names, certify, staged


def _added(kind: str) -> list[Column]:
    """Statistics of a group added up; a sum is NULL if it doesn't fit, or if one of its parts is."""
    total = F.when(F.count("sum_val") == F.count(F.lit(1)), F.try_sum("sum_val").cast(kind))
    return [total.alias("sum_val"), F.sum("n").alias("n"), F.sum("rows").alias("rows")]


def deltas(certified: DataFrame, shape: QueryShape) -> DataFrame:
    """Group state deltas (g0.. as text, sum_val, n, rows) of the repaired events: minus the old image, plus the new."""
    n = Names(shape)
    repairs = staged(certified.where("decision = 'repair'").select("old", "new"), n.values("old", "new"), n.keys(), n.contributions())
    sides = []
    for s, img, sign in (("o", "old", -1), ("n", "new", 1)):
        groups = "".join(f"{n.key(s)(c)} as g{i}, " for i, c in enumerate(shape.group_cols))
        one = f"struct({groups}{"-" if sign < 0 else ""}_{s}sum as sum_val, cast(if(_{s}some, {sign}, 0) as bigint) as n, cast({sign} as bigint) as rows)"
        sides.append(f"if(coalesce(size(map_keys({img})), 0) > 0 and _{s}in, {one}, null)")
    one = repairs.select(F.explode_outer(F.expr(f"array({', '.join(sides)})")).alias("d")).where("d is not null")
    groups = [f"g{i}" for i in range(len(shape.group_cols))]
    return one.select("d.*").groupBy(*groups).agg(*_added(shape.sum_kind))


def merge(shape: QueryShape | JoinShape, state: DataFrame, changes: DataFrame) -> DataFrame:
    """Add deltas (groups as text) to a state, in one aggregation over both. A grouped shape drops groups without
    rows; an ungrouped one keeps its row.

    The state's types decide: a sum that they can't hold exactly comes out NULL, which overflowed() reports, and a
    group that is none of its column's type raises; certification for the fitted shape lets neither through.
    """
    groups = [f"g{i}" for i in range(len(shape.group_cols))]
    kind = state.schema["sum_val"].dataType.simpleString()
    own = state.select(*[V.key_of_column(state, g).alias(g) for g in groups], "sum_val", "n", "rows")
    exact = F.col("sum_val").try_cast(kind)
    theirs = changes.select(*groups, F.when(exact == F.col("sum_val"), exact).alias("sum_val"), "n", "rows")
    out = own.unionByName(theirs).groupBy(*groups).agg(*_added(kind))
    if groups:
        out = out.where("rows <> 0")
    return out.select(*[V.read_key(g, state.schema[g].dataType).alias(g) for g in groups], "sum_val", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rows", F.lit(0)).alias("rows"))


def overflowed(state: DataFrame) -> DataFrame:
    """Groups whose exact sum doesn't fit: they have to be rebuilt (repair_type_error)."""
    return state.where("sum_val is null and n > 0")


def maintain(shape: QueryShape, state: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certificates of the events, and the state after the repairs among them."""
    shape = shape.fitted(state)
    certified = certify(events, shape)
    return certified, merge(shape, state, deltas(certified, shape))


def maintain_or_rebuild(shape: QueryShape, state: DataFrame, events: DataFrame, table_after: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """As maintain, but recompute from the table after the batch if any event invalidates or a sum overflows."""
    certified, out = maintain(shape, state, events)
    rebuild = not certified.where(F.col("decision").isin("invalidate", "unsupported")).isEmpty() or not overflowed(out).isEmpty()
    return certified, (cold_state(shape, table_after) if rebuild else out), rebuild


def from_group_state(shape: QueryShape, rows: DataFrame) -> DataFrame:
    """A state from stored statistics: sum (sum_val or sum), n (non_null_count) and rows (row_count).

    Raises unless 0 <= n <= rows everywhere; groups without rows are left out of a grouped shape.
    """
    named = {c.lower(): c for c in rows.columns}
    pick = lambda *cs: next((F.col(named[c]) for c in cs if c in named), F.lit(None))
    groups = [F.col(named.get(f"g{i}", c)).alias(f"g{i}") for i, c in enumerate(shape.group_cols)]
    n = pick("n", "non_null_count", "__non_null_count")
    total = pick("rows", "row_count", "__row_count")
    out = rows.select(*groups, total_of(rows, next((named[c] for c in ("sum_val", "sum", "__sum_val") if c in named), None)).alias("sum_val"), n.cast("long").alias("n"), F.coalesce(total, n).cast("long").alias("rows"))
    if not out.where("n is null or n < 0 or n > rows").isEmpty():
        raise ValueError("group state needs 0 <= n <= rows")
    return out.where("rows > 0") if groups else out


def total_of(rows: DataFrame, column: str | None) -> Column:
    """A stored sum in its exact type; 0 where there is none."""
    kind = sum_type(rows.schema[column].dataType if column else None, column or "")
    return F.coalesce(F.col(column).cast(kind) if column else F.lit(None).cast(kind), F.lit(0).cast(kind))


def poke(shape: QueryShape, state: DataFrame, group: dict[str, object], amount: Decimal | int, rows: int = 1) -> DataFrame:
    """Add to (or with negative numbers take from) one group by hand; a new group appears, one without rows goes."""
    keys = {g: F.lit(None if v is None else format(v, "f") if isinstance(v, Decimal) else str(v)).cast("string") for g, v in group.items()}
    kind = state.schema["sum_val"].dataType
    one = state.sparkSession.range(1).select(*[keys[g].alias(g) for g in sorted(keys)], F.lit(str(amount)).try_cast(kind).alias("sum_val"), F.lit(rows).cast("long").alias("n"), F.lit(rows).cast("long").alias("rows"))
    return merge(shape, state, one)


def apply_changes(table: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The table after the events: the last image of each key wins, deleted keys go, a truncate drops what came before.

    Columns that an update's image doesn't have keep their value. Raises for a value that is none of its column's type.
    """
    from pyspark.sql import Window

    cut = events.where(F.upper("op") == "TRUNCATE").agg(F.max("seq").alias("cut"))
    k = lambda img: V.key_text(img, key)
    ev = events.where(F.coalesce(F.upper("op"), F.lit("")) != "TRUNCATE").withColumn("k", F.coalesce(k("new"), k("old"))).where("k is not null")
    moved = ev.where(k("old").isNotNull() & k("new").isNotNull() & (k("old") != k("new"))).select(k("old").alias("k"), "seq", F.lit(None).cast(V.IMAGE).alias("new"))
    ev = ev.select("k", "seq", "new").union(moved)
    seed = table.select(V.key_of_column(table, key).alias("k"), F.lit(-1).cast("long").alias("seq"), V.image(table, {c: c for c in table.columns}).alias("new"))
    every = seed.union(ev).crossJoin(F.broadcast(cut)).where("cut is null or seq > cut")  # cut is one row
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gone = F.max(F.when(F.coalesce(F.size(F.map_keys("new")), F.lit(0)) <= 0, F.col("seq"))).over(w)
    every = every.withColumn("gone", gone).where("gone is null or seq > gone")
    cols = []
    for f in table.schema:
        last = F.max_by(F.col("new")[f.name], F.when(V.has(F.col("new"), f.name), F.col("seq")))
        cols.append(last.alias(f.name))
    out = every.groupBy("k").agg(*cols)
    return out.select(*[V.read_key(F.col(f.name)["v"], f.dataType).alias(f.name) for f in table.schema])
