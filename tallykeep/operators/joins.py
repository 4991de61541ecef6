"""Foreign-key joins: cold evaluation, and maintenance by temporal joins against row versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.tables import cut
from ..plans.shapes import JoinClause, JoinShape, sufficient, sum_type, typed_sql
from .certify import first_rule, prepared, staged
from .maintain import merge

_END = (1 << 62) - 1


def _named(df: DataFrame, table: str, cols) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{table}__{c}") for c in sorted(cols)])


def _c(pair: tuple[str, str]) -> Column:
    return F.col(f"{pair[0]}__{pair[1]}")


def _needed(shape: JoinShape, table: str) -> frozenset[str]:
    return shape.columns_of(table, security=False) | {shape.key_of(table)}


def _predicate(shape: JoinShape, rows: DataFrame) -> Column:
    terms = [(f"{t}__{c}", op, v) for (t, c), op, v in shape.predicate]
    return F.expr(V.all_sql([f"coalesce({typed_sql(V.quoted(c), rows.schema[c].dataType, op, v)}, false)" for c, op, v in terms]))


def cold_join_state(shape: JoinShape, tables: dict[str, DataFrame]) -> DataFrame:
    """Group state of the join; Catalyst orders the joins and picks their strategy."""
    for t in shape.tables():
        absent = _needed(shape, t) - set(tables[t].columns)
        if absent:
            raise ValueError(f"{t} lacks {sorted(absent)}")
    out = _named(tables[shape.base], shape.base, _needed(shape, shape.base))
    for j in shape.joins:
        out = out.join(_named(tables[j.table], j.table, _needed(shape, j.table)), _c(j.left) == _c((j.table, j.key)), j.kind)
    groups = [_c(g).alias(f"g{i}") for i, g in enumerate(shape.group_cols)]
    value = f"{shape.agg_col[0]}__{shape.agg_col[1]}" if shape.agg_col else None
    return out.where(_predicate(shape, out)).groupBy(*groups).agg(*sufficient(shape.agg_fn, value, out))


def check_keys(shape: JoinShape, tables: dict[str, DataFrame]) -> None:
    """Raise unless every table has a unique key without NULLs, and no join key is a float or boolean."""
    for t in shape.tables():
        key = shape.key_of(t)
        kinds = {f.name: V.tag_of(f.dataType) for f in tables[t].schema}
        bad = [c for x, c in [(j.table, j.key) for j in shape.joins] + [j.left for j in shape.joins] if x == t and kinds[c] in ("bool", "float", "json")]
        if bad:
            raise ValueError(f"{t}.{bad[0]} can't be a join key")
    every = None
    for i, t in enumerate(shape.tables()):
        keys = tables[t].select(F.lit(i).alias("t"), F.col(shape.key_of(t)).cast("string").alias("k"))
        every = keys if every is None else every.union(keys)
    worst = every.groupBy("t", "k").count().where("k is null or count > 1").select("t").head()  # one pass over all tables
    if worst:
        t = shape.tables()[worst[0]]
        raise ValueError(f"{t}.{shape.key_of(t)} isn't a primary key")


def join_multiplicity(shape: JoinShape, tables: dict[str, DataFrame], dimension: str) -> DataFrame:
    """For each row of a dimension (key) how many rows of the fact table reach it (facts); 0 where none does."""
    path = _path(shape, dimension)
    rows = _named(tables[shape.base], shape.base, _needed(shape, shape.base))
    for j in path:
        rows = rows.join(_named(tables[j.table], j.table, _needed(shape, j.table)), _c(j.left) == _c((j.table, j.key)))
    key = shape.key_of(dimension)
    n = rows.groupBy(F.col(f"{dimension}__{key}").alias("_k")).agg(F.count("*").alias("facts"))
    own = tables[dimension].select(F.col(key).alias("key"))
    return own.join(n, own.key == n["_k"], "left").select("key", F.coalesce("facts", F.lit(0)).alias("facts"))


def _path(shape: JoinShape, table: str) -> list[JoinClause]:
    """Clauses that lead from the fact table to a dimension, in that order."""
    out: list[JoinClause] = []
    while table != shape.base:
        j = next(x for x in shape.joins if x.table == table)
        out.insert(0, j)
        table = j.left[0]
    return out


def versions(seed: DataFrame, table: str, key: str, events: DataFrame, cols) -> DataFrame:
    """Versions (table__column.., table__from, table__to) of a table's rows under the events.

    A version holds for from < seq <= to. An update patches its row: absent columns keep their value, explicit
    NULLs overwrite. Updates of unknown rows are dropped; an update of the key closes one row and opens another.
    """
    kinds = {f.name: f.dataType for f in seed.schema}
    k = lambda img: V.key_text(img, key)
    mine = events.where(F.col("rel") == table)
    opened = mine.select(F.coalesce(k("new"), k("old")).alias("k"), "seq", "new", (F.col("operation") == "INSERT").alias("opens"))
    moved = k("old").isNotNull() & k("new").isNotNull() & (k("old") != k("new"))
    closed = mine.where(moved).select(k("old").alias("k"), "seq", F.lit(None).cast(V.IMAGE).alias("new"), F.lit(False).alias("opens"))
    opened = opened.join(mine.where(moved).select(F.col("seq").alias("_s")), F.col("seq") == F.col("_s"), "left").withColumn("opens", F.col("opens") | F.col("_s").isNotNull()).drop("_s")
    start = seed.select(V.key_of_column(seed, key).alias("k"), F.lit(-1).cast("long").alias("seq"), V.image(seed, {c: c for c in cols}).alias("new"), F.lit(True).alias("opens"))
    every = start.union(opened.select("k", "seq", "new", "opens")).union(closed)
    by_key = Window.partitionBy("k").orderBy("seq")
    gone = F.coalesce(F.size(F.map_keys("new")), F.lit(0)) <= 0
    every = every.withColumn("gone", gone).withColumn("life", F.sum(F.when(gone, 1).otherwise(0)).over(by_key)).withColumn("until", F.lead("seq", 1, _END).over(by_key))
    life = Window.partitionBy("k", "life").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    every = every.where("not gone")
    held = [F.last(F.when(V.has(F.col("new"), c), F.col("new")[c]), ignorenulls=True).over(life)["v"].try_cast(kinds[c]).alias(f"{table}__{c}") for c in sorted(cols)]
    out = every.select(*held, F.first("opens").over(life).alias("_known"), F.col("seq").alias(f"{table}__from"), F.col("until").alias(f"{table}__to"))
    return out.where("_known").drop("_known")


def _unchanged(shape: JoinShape, seed: DataFrame, table: str) -> DataFrame:
    """Versions of a table that no event touches."""
    return _named(seed, table, _needed(shape, table)).select("*", F.lit(-1).cast("long").alias(f"{table}__from"), F.lit(_END).alias(f"{table}__to"))


def _valid(table: str, seq: Column) -> Column:
    return (F.col(f"{table}__from") < seq) & (F.col(f"{table}__to") >= seq)


def _sides(events: DataFrame, table: str, seed: DataFrame, cols) -> DataFrame:
    """(seq, side, table__column..) of the images of a table's events; side -1 is old."""
    kinds = {f.name: f.dataType for f in seed.schema}
    out = None
    for name, side in (("old", -1), ("new", 1)):
        some = events.where(F.coalesce(F.size(F.map_keys(name)), F.lit(0)) > 0)
        one = some.select("seq", F.lit(side).alias("side"), *[F.col(name)[c]["v"].try_cast(kinds[c]).alias(f"{table}__{c}") for c in sorted(cols)])
        out = one if out is None else out.union(one)
    return out


def _forward(shape: JoinShape, rows: DataFrame, world: dict[str, DataFrame], changed: str | None = None, sides: DataFrame | None = None) -> DataFrame:
    """Join fact rows (seq, side, base..) with the dimensions as they stood at seq; rows of the changed one that the
    event touches are taken from its images instead. All joins are on equal keys."""
    for j in shape.joins:
        names = [f"{j.table}__{c}" for c in sorted(_needed(shape, j.table))]
        key = f"{j.table}__{j.key}"
        right = world[j.table]
        on = (_c(j.left) == F.col(key)) & _valid(j.table, F.col("seq"))
        if j.table != changed:
            rows = rows.join(right, on, j.kind).drop(f"{j.table}__from", f"{j.table}__to")
            continue
        touched = sides.select(F.col("seq").alias("_ts"), F.col(key).alias("_tk")).distinct()
        image = sides.select(F.col("seq").alias("_is"), F.col("side").alias("_iside"), F.col(key).alias("_ik"), *[F.col(n).alias(f"_i_{n}") for n in names])
        rows = rows.join(touched, (F.col("seq") == F.col("_ts")) & (_c(j.left) == F.col("_tk")), "left")
        rows = rows.join(image, (F.col("seq") == F.col("_is")) & (F.col("side") == F.col("_iside")) & (_c(j.left) == F.col("_ik")), "left")
        rows = rows.join(right, on, "left")
        own = F.col("_ts").isNotNull()
        rows = rows.withColumns({n: F.when(own, F.col(f"_i_{n}")).otherwise(F.col(n)) for n in names})
        if j.kind == "inner":
            rows = rows.where(F.col(key).isNotNull())
        rows = rows.drop("_ts", "_tk", "_is", "_iside", "_ik", *[f"_i_{n}" for n in names], f"{j.table}__from", f"{j.table}__to")
    return rows


def contributions(shape: JoinShape, seeds: dict[str, DataFrame], events: DataFrame, world: dict[str, DataFrame], present: list[str]) -> DataFrame:
    """(seq, side, fact, inside, g0.., sum_val, n) of every fact row that an event touches, before (-1) and after (1)."""
    base = shape.base
    value = _c(shape.agg_col) if shape.agg_col else None
    kind = _sum_kind(shape, seeds)
    zero = F.lit(0).cast(kind)
    parts = []
    for t in present:
        mine = events.where(F.col("rel") == t)
        sides = _sides(mine, t, seeds[t], _needed(shape, t))
        if t == base:
            rows = _forward(shape, sides, world)
        else:
            back = sides.select("seq", F.col(f"{t}__{shape.key_of(t)}").alias("_key")).distinct()
            for j in reversed(_path(shape, t)):
                left = j.left[0]
                back = back.join(world[left], (_c(j.left) == F.col("_key")) & _valid(left, F.col("seq")))
                if left != base:
                    back = back.select("seq", F.col(f"{left}__{shape.key_of(left)}").alias("_key")).distinct()
            cols = [f"{base}__{c}" for c in sorted(_needed(shape, base))]
            facts = back.select("seq", *cols).distinct().select("seq", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), *cols)
            rows = _forward(shape, facts, world, t, sides)
        inside = _predicate(shape, rows)
        counts = F.lit(1) if value is None else F.when(value.isNotNull(), 1).otherwise(0)
        total = F.coalesce(value.cast(kind), zero) if value is not None and shape.agg_fn in ("sum", "avg") else zero
        parts.append(
            rows.select(
                "seq", "side", _c((base, shape.base_key)).cast("string").alias("fact"), inside.alias("inside"),
                *[_c(g).alias(f"g{i}") for i, g in enumerate(shape.group_cols)], total.alias("sum_val"), counts.alias("n"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _join_keys(shape: JoinShape, t: str) -> frozenset[str]:
    return frozenset([c for x, c in (j.left for j in shape.joins) if x == t] + [j.key for j in shape.joins if j.table == t])


def _sum_kind(shape: JoinShape, seeds: dict[str, DataFrame]) -> str:
    if not shape.agg_col or shape.agg_fn not in ("sum", "avg"):
        return sum_type(None)
    return sum_type(seeds[shape.agg_col[0]].schema[shape.agg_col[1]].dataType, shape.agg_col[1])


def _early(shape: JoinShape, seeds: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """The rules that an event's own row decides, in order; what none of them decides needs the tables' rows."""
    tables = shape.tables()
    listed = ", ".join(V.text_sql(t) for t in tables)
    tails = ", ".join(V.text_sql(t.rsplit(".", 1)[-1]) for t in tables)
    bare = "true" if all("." not in t for t in tables) else "false"
    ambiguous = f"_rel not in ({listed}) and substring_index(_rel, '.', -1) in ({tails}) and (not contains(_rel, '.') or {bare})"
    ours = f"_rel in ({listed}, '', '*')"
    per = lambda make: V.any_sql([f"_rel = {V.text_sql(t)} and ({make(t)})" for t in tables])
    touches = lambda cols, of: f"arrays_overlap({cols}, {V.names_sql(of)})"
    security = lambda t: frozenset(c for x, c in shape.security_cols if x == t)
    lacks = lambda keys, t: f"size(array_except({V.names_sql(shape.required_evidence(t))}, {keys})) > 0"

    def unfit(t: str) -> str:
        """Values that aren't of their column's type in the seed: they would be rounded, cut or read from another kind."""
        kinds = {f.name: f.dataType.simpleString() for f in seeds[t].schema}
        value = lambda i, c: f"{i}[{V.text_sql(c)}]"
        return V.any_sql([f"{value(i, c)}.t is not null and not {V.fits_sql(value(i, c), kinds[c])}" for i in ("_old", "_new") for c in sorted(_needed(shape, t))])

    triage = lambda when, reason: [(f"{when} and {ambiguous}", "invalidate", "ambiguous_relation"), (f"{when} and {ours}", "invalidate", reason), (when, "preserve", "unrelated_relation")]
    rules = triage("_ddl", "schema_evolution") + triage("_broken", "transaction_boundary_violation")
    return rules + [
        (f"_rel in ('', '*') or ({ambiguous})", "invalidate", "ambiguous_relation"),
        (f"_rel not in ({listed})", "preserve", "unrelated_relation"),
        ("operation = 'TRUNCATE'", "invalidate", "truncate_event"),
        ("operation not in ('INSERT', 'UPDATE', 'DELETE', 'EMPTY')", "invalidate", "unsupported_event_operation"),
        (per(unfit), "invalidate", "invalid_evidence_type"),
        (per(lambda t: touches("_gone", security(t))), "invalidate", "security_column_changed"),
        (per(lambda t: touches("_gone", shape.columns_of(t))), "invalidate", "missing_evidence_for_repair"),
        ("_declared = 'INSERT' and (size(_ok) > 0 or size(_nk) = 0)", "invalidate", "invalid_event_payload"),
        ("_declared = 'DELETE' and (size(_nk) > 0 or size(_ok) = 0)", "invalidate", "invalid_event_payload"),
        ("_declared = 'UPDATE' and (size(_ok) = 0 or size(_nk) = 0)", "invalidate", "missing_evidence_for_repair"),
        ("operation = 'EMPTY' and size(changed) = 0", "invalidate", "missing_evidence_for_repair"),
        ("operation not in ('INSERT', 'DELETE') and " + f"({per(lambda t: 'not ' + touches('changed', shape.columns_of(t)))})", "preserve", "disjoint_columns"),
        (per(lambda t: f"{touches('changed', security(t))} or (operation in ('INSERT', 'DELETE') and {'true' if security(t) else 'false'})"), "invalidate", "security_column_changed"),
        (per(lambda t: f"(operation in ('UPDATE', 'DELETE') and {lacks('_ok', t)}) or (operation in ('UPDATE', 'INSERT') and {lacks('_nk', t)}) or operation not in ('INSERT', 'DELETE', 'UPDATE')"), "invalidate", "missing_evidence_for_repair"),
    ]


def certify_join(shape: JoinShape, seeds: dict[str, DataFrame], events: DataFrame, checked: bool = False) -> tuple[DataFrame, DataFrame]:
    """Certificates (seq, event_id, relation, operation, decision, reason) and the group deltas of repairs, by event.

    Every event is judged against the rows as they stood before it. Events whose old image isn't the stored row
    are stale; after the first event that invalidates, all later ones that touch the shape miss their auxiliary
    state, and no delta of theirs is given. Evidence that isn't exactly of its column's type in the seed is
    invalid. Seeds whose keys aren't unique raise; those that check_keys has passed once are given as checked.
    """
    if not checked:
        check_keys(shape, seeds)
    groups = [f"g{i}" for i in range(len(shape.group_cols))]
    tables = shape.tables()
    place, decisions, reasons = first_rule(_early(shape, seeds))
    verdicts = ", ".join(V.text_sql(f"{d}:{r}") for d, r in zip(decisions, reasons))
    ev = staged(prepared(events), {"_at": place}, {"early": f"if(_at > 0, element_at(array({verdicts}), cast(_at as int)), null)"})
    keys = V.any_sql([f"_rel = {V.text_sql(t)} and arrays_overlap(changed, {V.names_sql(_join_keys(shape, t))})" for t in tables])
    ev = ev.select("stream_id", "seq", "event_id", "relation", F.col("_rel").alias("rel"), "operation", "old", "new", "early", F.expr(f"coalesce({keys}, false)").alias("key_change"), (F.col("_rel") == shape.base).alias("is_base"))
    ev = cut(ev)
    op = F.col("operation")

    usable = ev.where(F.col("early").isNull() | (F.col("early") == "preserve:disjoint_columns"))
    have = {r[0] for r in ev.where(F.col("rel").isin(tables)).select("rel").distinct().collect()}  # tables of the shape
    present = [t for t in tables if t in have] or [shape.base]
    world = {t: cut(versions(seeds[t], t, shape.key_of(t), usable, _needed(shape, t))) if t in present else _unchanged(shape, seeds[t], t) for t in tables}
    stale = None
    for t in present:
        cols = sorted(_needed(shape, t))
        key = shape.key_of(t)
        kinds = {f.name: f.dataType for f in seeds[t].schema}
        mine = usable.where((F.col("rel") == t) & F.col("early").isNull())
        want = F.when(op == "INSERT", F.col("new")[key]["v"]).otherwise(F.col("old")[key]["v"])
        mine = mine.withColumn("_k", want.try_cast(kinds[key]))
        found = mine.join(world[t], (F.col("_k") == F.col(f"{t}__{key}")) & _valid(t, F.col("seq")), "left")
        same = V.all_of([F.col("old")[c]["v"].try_cast(kinds[c]).eqNullSafe(F.col(f"{t}__{c}")) for c in cols])
        ok = F.when(op == "INSERT", F.col(f"{t}__from").isNull()).otherwise(F.col(f"{t}__from").isNotNull() & same)
        one = found.where(~F.coalesce(ok, F.lit(False))).select(F.col("seq").alias("_stale"))
        stale = one if stale is None else stale.union(one)

    pieces = cut(contributions(shape, seeds, usable.where("early is null"), world, present))
    kind = _sum_kind(shape, seeds)
    side = F.col("side")
    inside = pieces.where("inside")
    per_group = inside.groupBy("seq", *groups).agg(
        F.try_sum(F.when(side > 0, F.col("sum_val")).otherwise(-F.col("sum_val"))).cast(kind).alias("sum_val"), F.sum(side * F.col("n")).alias("n"), F.sum(side.cast("long")).alias("rows"),
        F.max((side < 0).cast("int")).alias("was"), F.max((side > 0).cast("int")).alias("now"),
    )
    net = per_group.groupBy("seq").agg(
        F.max(((F.col("sum_val") != 0) | (F.col("n") != 0) | (F.col("rows") != 0)).cast("int")).alias("moves"),
        F.max("was").alias("was"), F.max("now").alias("now"), F.max((F.col("was") != F.col("now")).cast("int")).alias("shifts"),
    )
    reach = pieces.groupBy("seq").agg(F.count_distinct("fact").alias("facts"))
    ev = ev.join(net.withColumnRenamed("seq", "_n"), F.col("seq") == F.col("_n"), "left").join(reach.withColumnRenamed("seq", "_f"), F.col("seq") == F.col("_f"), "left")
    ev = ev.join(stale, F.col("seq") == F.col("_stale"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    dim = F.concat(F.lit("repair:dimension_"), F.lower("operation"))
    late = (
        F.when(F.col("_stale").isNotNull(), "invalidate:stale_join_auxiliary_state")
        .when(~F.col("is_base") & (zero("facts") == 0), "preserve:zero_join_multiplicity")
        .when(F.col("is_base") & F.col("key_change") & (op == "UPDATE"), "repair:foreign_key_reparent")
        .when(~F.col("is_base") & F.col("key_change") & (op == "UPDATE"), "repair:dimension_update")
        .when((zero("moves") == 0) & ((op == "UPDATE") | ~F.col("is_base")), "preserve:noop_update")
        .when(~F.col("is_base"), dim)
        .when(op.isin("INSERT", "DELETE"), F.concat(F.lit("repair:"), F.lower("operation")))
        .when((zero("was") == 0) & (zero("now") == 1), "repair:predicate_entry")
        .when((zero("was") == 1) & (zero("now") == 0), "repair:predicate_exit")
        .when(zero("shifts") == 1, "repair:group_move")
        .otherwise("repair:value_change")
    )
    ev = ev.withColumn("v", F.coalesce("early", late))
    bad = F.when(F.col("v").startswith("invalidate"), F.col("seq"))
    ev = cut(ev.drop("old", "new"))
    firsts = ev.groupBy(F.col("stream_id").alias("_stream")).agg(F.min(bad).alias("_first")).where("_first is not null")
    ev = ev.join(firsts, F.col("stream_id").eqNullSafe(F.col("_stream")), "left")  # a row for each stream that has one
    latched = (F.col("seq") > F.col("_first")) & ~F.col("v").isin("preserve:disjoint_columns", "preserve:unrelated_relation") & F.col("early").isNull()
    ev = ev.withColumn("_latched", F.coalesce(latched, F.lit(False)))
    ev = ev.withColumn("v", F.when(F.col("_latched"), "invalidate:missing_join_auxiliary_state").otherwise(F.col("v")))
    out = ev.select("seq", "event_id", "relation", "operation", F.split("v", ":", 2)[0].alias("decision"), F.split("v", ":", 2)[1].alias("reason"))
    repaired = out.where("decision = 'repair'").select(F.col("seq").alias("_r"))
    given = per_group.join(repaired, F.col("seq") == F.col("_r"), "left_semi")
    return out, given.select("seq", *[V.key_of_column(given, g).alias(g) for g in groups], "sum_val", "n", "rows")


def merge_join(shape: JoinShape, state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state with deltas added; groups without rows go, but an ungrouped result keeps its row."""
    return merge(shape, state, deltas)


def maintain_join(shape: JoinShape, seeds: dict[str, DataFrame], state: DataFrame, events: DataFrame, checked: bool = False) -> tuple[DataFrame, DataFrame]:
    certified, deltas = certify_join(shape, seeds, events, checked)
    return certified, merge_join(shape, state, deltas)


def maintain_join_or_rebuild(shape: JoinShape, seeds: dict[str, DataFrame], state: DataFrame, events: DataFrame, tables_after: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, bool]:
    """As maintain_join, but recompute from the tables after the batch if any event invalidates."""
    certified, deltas = certify_join(shape, seeds, events)
    if certified.where("decision in ('invalidate', 'unsupported')").isEmpty():
        return certified, merge_join(shape, state, deltas), False
    return certified, cold_join_state(shape, tables_after), True
