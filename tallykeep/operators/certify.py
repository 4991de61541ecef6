"""Certification of changes against single-table shapes: projections alone, no state and no Python on the executors.

Every intermediate result is a column of its own, added stage by stage, so that no expression holds another one
many times over; and all shapes are judged in one pass over the events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.admission import parse_sql
from ..plans.shapes import AGGREGATES, SECURITY, QueryShape

_NONE = "cast(array() as array<string>)"
_FLAGS = ("old_complete", "new_complete", "changed_complete")


def staged(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """Add columns given as SQL; those of a stage may use those of the stages before."""
    for stage in stages:
        df = df.drop(*[c for c in df.columns if c in stage]).selectExpr("*", *[f"{v} as {k}" for k, v in stage.items()])
    return df


def barrier(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same columns, of which the given ones come out of a generator of one row.

    No filter is pushed below it as an expression in which every stage stands as often as it is used.
    """
    kept = [V.quoted(c) for c in df.columns if c not in columns]
    names = ", ".join(columns)
    return df.selectExpr(*kept, f"stack(1, {names}) as ({names})")


def operation_sql() -> str:
    """The event's operation: as declared, or else by which images it has."""
    return "coalesce(upper(op), case when size(_ok) > 0 and size(_nk) > 0 then 'UPDATE' when size(_nk) > 0 then 'INSERT' when size(_ok) > 0 then 'DELETE' else 'EMPTY' end)"


def prepared(events: DataFrame) -> DataFrame:
    """Events with operation, clock, changed, available_evidence and columns (_*) that all rules share."""
    empty = f"from_json('{{}}', '{V.IMAGE}')"
    numeric = lambda x: f"{x}.t in {V.NUMBERS} and {V.plain_sql(x + '.v')}"
    odd = "x.t = 'json' or (x.t = 'float' and lower(x.v) in ('nan', 'inf', '-inf', 'infinity', '-infinity'))"
    alike = lambda k: f"{numeric(f'_old[{k}]')} and {numeric(f'_new[{k}]')} and {V.canonical_sql(f'_old[{k}].v')} = {V.canonical_sql(f'_new[{k}].v')}"
    same_set = lambda a, b: f"size(array_except({a}, {b})) = 0 and size(array_except({b}, {a})) = 0"
    out = staged(
        events,
        {"_old": f"coalesce(old, {empty})", "_new": f"coalesce(new, {empty})", "_rel": V.relation_sql("coalesce(relation, '')"), "_declared": "upper(op)", "_gone": f"coalesce(unavailable_cols, {_NONE})", "_said": f"coalesce(changed_cols, {_NONE})"},
        {"_ok": "map_keys(_old)", "_nk": "map_keys(_new)"},
        {
            "operation": operation_sql(), "clock": "coalesce(boundary_clock, if(event_id <> 'unknown', event_id, null))",
            "_known": "array_intersect(_ok, _nk)", "_side": "array_union(array_except(_ok, _nk), array_except(_nk, _ok))", "_told": "array_except(_said, _gone)",
            "_odd": f"exists(map_values(_old), x -> {odd}) or exists(map_values(_new), x -> {odd})",
            "_ddl": "coalesce(schema_change, false) or coalesce(upper(op) in ('SCHEMA_CHANGE', 'DDL'), false)", "_broken": "coalesce(upper(op) = 'TX_VIOLATION', false)",
        },
        {"_apart": "filter(_known, k -> not (_old[k] <=> _new[k]))"},
        {"_differ": f"if(size(_apart) = 0, _apart, filter(_apart, k -> not coalesce({alike('k')}, false)))"},
        {
            "changed": "array_sort(case operation when 'INSERT' then array_union(_nk, _gone) when 'DELETE' then array_union(_ok, _gone) when 'UPDATE' then array_union(array_union(_differ, _side), array_union(_gone, _said)) else array_union(_said, _gone) end)",
            "available_evidence": f"array_sort(case operation when 'UPDATE' then _known when 'INSERT' then _nk when 'DELETE' then _ok else {_NONE} end)",
            "_mismatch": f"size(_said) > 0 and case operation when 'INSERT' then not ({same_set('_told', '_nk')}) when 'DELETE' then not ({same_set('_told', '_ok')}) when 'UPDATE' then "
            f"size(array_except(_differ, _told)) > 0 or size(array_intersect(_told, array_except(_known, _differ))) > 0 or (size(_side) = 0 and not ({same_set('_told', '_differ')})) else false end",
        },
    ).drop("_known", "_told", "_apart", "_differ", "_side")
    return barrier(out, [c for c in out.columns if c.startswith("_") or c in ("operation", "clock", "changed", "available_evidence")])


@dataclass(frozen=True)
class Names:
    """The columns that hold a shape's evidence of both images: values, key texts and what they add."""

    shape: QueryShape
    mark: str = "_"

    @property
    def columns(self) -> list[str]:
        return sorted(self.shape.required_evidence())

    def value(self, side: str):
        return lambda c: f"{self.mark}{side}v{self.columns.index(c)}"

    def key(self, side: str):
        return lambda c: f"{self.mark}{side}k{self.columns.index(c)}"

    def values(self, old: str, new: str) -> dict[str, str]:
        return {self.value(s)(c): f"{img}[{V.text_sql(c)}]" for s, img in (("o", old), ("n", new)) for c in self.columns}

    def keys(self) -> dict[str, str]:
        return {self.key(s)(c): V.key_sql(self.value(s)(c)) for s in "on" for c in self.columns}

    @property
    def adds(self) -> str | None:
        """The column whose values are added up."""
        return self.shape.agg_col if self.shape.agg_fn in ("sum", "avg") else None

    def contributions(self) -> dict[str, str]:
        """For each side: whether its row counts (in), how many values (some) and how much (sum) it adds."""
        out, shape = {}, self.shape
        for s in "on":
            inside = shape.predicate.on_keys(self.key(s))
            some = inside if shape.agg_col is None else f"({inside}) and coalesce({self.value(s)(shape.agg_col)}.t <> 'null', false)"
            total = V.exact_sql(f"{self.value(s)(self.adds)}.v", shape.sum_kind) if self.adds else "null"
            zero = f"cast(0 as {shape.sum_kind})"
            out |= {f"{self.mark}{s}in": inside, f"{self.mark}{s}some": some, f"{self.mark}{s}sum": f"if({some}, {total}, {zero})" if self.adds else zero}
        return out


def _bad_types(n: Names) -> str:
    """Evidence that is no exact value of its role, or of the stored state's type."""
    shape, kinds, bad = n.shape, dict(n.shape.kinds), []
    for s in "on":
        v = n.value(s)
        bad += [f"{v(c)}.t in ('bool', 'float', 'json')" for c in shape.group_cols]
        bad += [f"{v(c)}.t is not null and not {V.fits_sql(v(c), kinds[c])}" for c in shape.group_cols if c in kinds]
        bad += [f"{v(c)}.t in {V.NUMBERS} and not ({V.plain_sql(v(c) + '.v')})" for c in n.columns]
        bad += [f"{v(n.adds)}.t not in ('int', 'dec', 'null')"] if n.adds else []
        bad.append(shape.predicate.mistyped(v))
    return V.any_sql(bad)


def _rules(n: Names) -> list[tuple[str, str, str]]:
    """(condition, decision, reason) in the order in which they are tested."""
    shape, m = n.shape, n.mark
    mine = V.relation_name(shape.relation)
    tail = V.text_sql(mine.rsplit(".", 1)[-1])
    ambiguous = f"_rel <> {V.text_sql(mine)} and substring_index(_rel, '.', -1) = {tail} and (not contains(_rel, '.') or {'false' if '.' in mine else 'true'})"
    ours = f"_rel in ({V.text_sql(mine)}, '', '*')"
    mark, security = V.names_sql(shape.fingerprint()), shape.columns(SECURITY)
    touches = lambda cols, of: f"arrays_overlap({cols}, {of})"
    secret = V.names_sql(security)
    lacks = lambda keys, need: f"size(array_except({V.names_sql(need)}, {keys})) > 0"
    need = shape.required_evidence()
    in_old, in_new = "operation in ('UPDATE', 'DELETE')", "operation in ('UPDATE', 'INSERT')"
    flags = f"coalesce({', '.join(_FLAGS)}) is not null"
    yes = lambda c: f"coalesce({c}, false)"
    triage = lambda when, reason: [(f"{when} and {ambiguous}", "invalidate", "ambiguous_relation"), (f"{when} and {ours}", "invalidate", reason), (when, "preserve", "unrelated_relation")]
    rules = triage("_ddl", "schema_evolution") + triage("_broken", "transaction_boundary_violation")
    rules += [
        (f"_rel in ('', '*') or ({ambiguous})", "invalidate", "ambiguous_relation"),
        (f"_rel <> {V.text_sql(mine)}", "preserve", "unrelated_relation"),
        ("operation = 'TRUNCATE'", "invalidate", "truncate_event"),
        ("operation = 'UNKNOWN'", "invalidate", "unknown_operation"),
        ("operation not in ('INSERT', 'UPDATE', 'DELETE', 'EMPTY')", "invalidate", "unsupported_event_operation"),
        (f"{m}bad", "invalidate", "invalid_evidence_type"),
        ("_odd", "invalidate", "unsupported_row_value"),
        (f"{flags} and operation = 'UPDATE' and not ({yes('old_complete')} and {yes('new_complete')})", "invalidate", "incomplete_update_images"),
        (f"{flags} and operation = 'UPDATE' and not coalesce(changed_complete, true)", "invalidate", "unknown_changed_columns"),
        (f"{flags} and operation = 'INSERT' and (size(_ok) > 0 or not {yes('new_complete')})", "invalidate", "incomplete_or_conflicting_insert_image"),
        (f"{flags} and operation = 'DELETE' and (size(_nk) > 0 or not {yes('old_complete')})", "invalidate", "incomplete_or_conflicting_delete_image"),
        (f"{flags} and {in_old} and {lacks('_ok', shape.fingerprint())}", "invalidate", "missing_evidence_old"),
        (f"{flags} and {in_new} and {lacks('_nk', shape.fingerprint())}", "invalidate", "missing_evidence_new"),
        (touches("_gone", secret), "invalidate", "security_column_changed"),
        (touches("_gone", mark), "invalidate", "missing_evidence_for_repair"),
        ("_declared = 'INSERT' and (size(_ok) > 0 or size(_nk) = 0)", "invalidate", "invalid_event_payload"),
        ("_declared = 'DELETE' and (size(_nk) > 0 or size(_ok) = 0)", "invalidate", "invalid_event_payload"),
        ("_declared = 'UPDATE' and (size(_ok) = 0 or size(_nk) = 0)", "invalidate", "missing_evidence_for_repair"),
        ("_mismatch", "invalidate", "changed_cols_mismatch"),
        ("operation = 'EMPTY' and size(_said) = 0 and size(_gone) = 0", "invalidate", "missing_evidence_for_repair"),
        (f"operation not in ('INSERT', 'DELETE') and not {touches('changed', mark)}", "preserve", "disjoint_columns"),
        (f"{touches('changed', secret)} or (operation in ('INSERT', 'DELETE') and {'true' if security else 'false'})", "invalidate", "security_column_changed"),
    ]
    if shape.agg_fn is None:
        return [*rules, ("true", "invalidate", "shape_intersected")]
    unfit = V.any_sql([f"{n.value(s)(n.adds)}.t in {V.NUMBERS} and {V.exact_sql(n.value(s)(n.adds) + '.v', shape.sum_kind)} is null" for s in "on"] if n.adds else [])
    was, now = f"{m}oin", f"{m}nin"
    alike = V.all_sql([f"{m}osum <=> {m}nsum", f"{m}osome <=> {m}nsome"])
    update = "operation = 'UPDATE'"
    return rules + [
        (f"{'true' if shape.unparsed_predicate else 'false'} or ({in_old} and {lacks('_ok', need)}) or ({in_new} and {lacks('_nk', need)}) or operation not in ('INSERT', 'DELETE', 'UPDATE')", "invalidate", "missing_evidence_for_repair"),
        (unfit, "invalidate", "invalid_evidence_type"),
        (f"{update} and ((not {was} and not {now}) or ({was} and {now} and {m}same and {alike}))", "preserve", "noop_update"),
        (f"{update} and not {was} and {now}", "repair", "predicate_entry"),
        (f"{update} and {was} and not {now}", "repair", "predicate_exit"),
        (f"{update} and not {m}same", "repair", "group_move"),
        (update, "repair", "value_change"),
        ("operation = 'INSERT'", "repair", "insert"),
        ("operation = 'DELETE'", "repair", "delete"),
    ]


def unsupported(shape: QueryShape) -> str | None:
    """Why a shape can't be certified at all."""
    if shape.is_supported and (shape.agg_fn is None or shape.agg_fn in AGGREGATES):
        return None
    why = shape.unsupported_reason if not shape.is_supported else f"unsupported_agg_fn: {shape.agg_fn}"
    return "min_max_requires_auxiliary_state" if "min" in why.lower() or "max" in why.lower() else why


def first_rule(rules: list[tuple[str, str, str]]) -> tuple[str, list[str], list[str]]:
    """SQL for the place of the first rule that holds, and all decisions and reasons."""
    return f"array_position(array({', '.join(f'coalesce({c}, false)' for c, _, _ in rules)}), true)", [d for _, d, _ in rules], [r for _, _, r in rules]


def judged(df: DataFrame, shape: QueryShape, mark: str) -> DataFrame:
    """Add {mark}decision and {mark}reason to prepared events."""
    if why := unsupported(shape):
        return staged(df, {f"{mark}decision": "'unsupported'", f"{mark}reason": V.text_sql(why)})
    n = Names(shape, mark)
    before = set(df.columns)
    df = staged(df, n.values("_old", "_new"), n.keys())
    same = V.all_sql([V.same_sql(n.value("o")(c), n.value("n")(c)) for c in shape.group_cols])
    df = staged(df, {**n.contributions(), f"{mark}same": same, f"{mark}bad": _bad_types(n)})
    place, decisions, reasons = first_rule(_rules(n))
    pick = lambda texts: f"element_at(array({', '.join(V.text_sql(t) for t in texts)}), cast({mark}at as int))"
    df = staged(df, {f"{mark}at": place})
    df = barrier(df.drop(*[c for c in df.columns if c not in before and c != f"{mark}at"]), [f"{mark}at"])
    return staged(df, {f"{mark}decision": pick(decisions), f"{mark}reason": pick(reasons)}).drop(f"{mark}at")


def certify(events: DataFrame, shape: QueryShape) -> DataFrame:
    """Add decision, reason, operation, changed, required_evidence, available_evidence, repair_program and clock to events.

    decision is preserve, repair, invalidate or unsupported. The rules are tested in order and the first that
    holds decides; all of them are expressions over the event's own row. Numbers are compared exactly at any
    length. What is added up, and what a stored state's types (shape.fitted) can't hold exactly, is refused.
    """
    names = [c for c in events.columns if c not in ("decision", "reason")]
    df = judged(prepared(events), shape, "_s_")
    program = F.when(F.col("_s_decision") == "repair", F.lit(f"{shape.agg_fn}_by_group"))
    required = F.expr(V.names_sql(shape.required_evidence()))
    changed = ["changed"] if "changed" not in names else []
    return df.select(*names, "operation", "clock", F.col("_s_decision").alias("decision"), F.col("_s_reason").alias("reason"), *changed, required.alias("required_evidence"), "available_evidence", program.alias("repair_program"))


def certify_all(events: DataFrame, shapes: list[QueryShape], own_relation: bool = False) -> DataFrame:
    """A row for each event and shape, from one pass: seq, event_id, relation (normalised), operation, clock, shape,
    decision, reason, cols (changed columns of the fingerprint). With own_relation only shapes on the event's relation.
    """
    df, out = prepared(events), []
    for i, s in enumerate(shapes):
        df = judged(df, s, f"_{i}_")
        one = f"struct({V.text_sql(s.name or s.relation)} as shape, _{i}_decision as decision, _{i}_reason as reason, array_intersect(changed, {V.names_sql(s.fingerprint())}) as cols)"
        out.append(f"if(_rel = {V.text_sql(V.relation_name(s.relation))}, {one}, null)" if own_relation else one)
    rows = df.select("seq", "event_id", F.col("_rel").alias("relation"), "operation", "clock", F.explode_outer(F.expr(f"array({', '.join(out)})")).alias("_c"))
    return rows.where("_c is not null").select("seq", "event_id", "relation", "operation", "clock", "_c.*")


def certify_sql(events: DataFrame, sql: str, schema: dict[str, list[str]] | None = None) -> DataFrame:
    """From a statement and events to decisions: admission and certification in one. What isn't admitted is unsupported."""
    got = parse_sql(sql, schema=schema)
    shape = got.shape if got.is_supported else QueryShape("*", is_supported=False, unsupported_reason=got.reason)
    return certify(events, shape)


def with_latch(certified: DataFrame, partition: list[str]) -> DataFrame:
    """After an invalidation every later event of the partition (by seq) asks for a rebuild, as long as none is made."""
    first = certified.where(F.col("decision").isin("invalidate", "unsupported")).groupBy(*partition).agg(F.min("seq").alias("_first"))
    both = certified.join(first.select(*[F.col(c).alias(f"_l_{c}") for c in partition], "_first"), V.all_of([F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in partition]), "left")
    late = F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
    both = both.withColumns({"decision": F.when(late, "invalidate").otherwise(F.col("decision")), "reason": F.when(late, "cache_requires_rebuild").otherwise(F.col("reason"))})
    return both.drop("_first", *[f"_l_{c}" for c in partition])
