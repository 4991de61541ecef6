"""Query shapes: what a cached aggregate depends on, and the evidence that its repair needs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V

AGGREGATES = ("sum", "count", "count_star", "avg")
OPS = {"=", "!=", "<>", "<", "<=", ">", ">="}


def typed_sql(column: str, kind: T.DataType, op: str, value) -> str:
    """column op value over a typed column, in a form that the scan can take where it stays exact."""
    if isinstance(value, str):
        return f"{column} {op} {V.text_sql(value)}"
    if not isinstance(kind, (T.IntegralType, T.DecimalType)):
        return f"{column} {op} {value}"
    number = Decimal(str(value))
    places = max(0, -number.as_tuple().exponent)
    own, scale = (kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (19, 0)
    whole = max(own, len(number.as_tuple().digits) - places, 1)
    if whole + max(scale, places) > 38:  # a common type would round
        return V.compare_sql(V.canonical_sql(f"cast({column} as string)"), op, number)
    return f"{column} {op} cast({V.text_sql(format(number, 'f'))} as decimal({whole + places},{places}))"


@dataclass(frozen=True)
class Predicate:
    """A conjunction of (column, operator, literal). A NULL operand excludes the row."""

    terms: tuple[tuple[str, str, object], ...] = ()

    def __post_init__(self):
        bad = [t for t in self.terms if t[1] not in OPS]
        if bad:
            raise ValueError(f"unsupported operators: {bad}")

    @property
    def columns(self) -> frozenset[str]:
        return frozenset(c for c, _, _ in self.terms)

    def on_rows(self, rows: DataFrame) -> Column:
        """The condition over typed columns."""
        return F.expr(V.all_sql([typed_sql(V.quoted(c), rows.schema[c].dataType, op, v) for c, op, v in self.terms]))

    def on_keys(self, key_of) -> str:
        """The condition as SQL over the columns' key texts, key_of(column)."""
        return V.all_sql([f"coalesce({V.compare_sql(key_of(c), op, v)}, false)" for c, op, v in self.terms])

    def mistyped(self, value_of) -> str:
        """Operands that can't be compared exactly: floats, booleans, and texts against numbers or the reverse."""
        kind = lambda v: "('str', 'null')" if isinstance(v, str) else "('int', 'dec', 'null')"
        return V.any_sql([f"{value_of(c)}.t not in {kind(v)}" for c, _, v in self.terms])


#: What a column does for a shape. Those of the evidence must be in the images for a repair.
READ, JOIN, FILTER, GROUP, SECURITY = "read", "join", "filter", "group", "security"


@dataclass(frozen=True)
class QueryShape:
    """One aggregate over one table, grouped and filtered; or a plain projection, which is never repaired."""

    relation: str
    agg_fn: str | None = None
    agg_col: str | None = None
    group_cols: tuple[str, ...] = ()
    predicate: Predicate = Predicate()
    projection_cols: frozenset[str] = frozenset()
    security_cols: frozenset[str] = frozenset()
    name: str = ""
    is_supported: bool = True
    unsupported_reason: str = ""
    predicate_cols: frozenset[str] = frozenset()  # columns of a predicate whose terms aren't known
    join_cols: frozenset[str] = frozenset()
    kinds: tuple[tuple[str, str], ...] = ()  # types that evidence must fit, where the stored state has some

    @property
    def unparsed_predicate(self) -> bool:
        return bool(self.predicate_cols - self.predicate.columns)

    def uses(self) -> list[tuple[str, str, bool]]:
        """(column, role, whether a repair needs it), the one table that all sets of columns come from."""
        out = [(c, READ, False) for c in self.projection_cols] + [(c, JOIN, False) for c in self.join_cols]
        out += [(c, GROUP, True) for c in self.group_cols] + [(c, SECURITY, False) for c in self.security_cols]
        out += [(c, FILTER, True) for c in (*self.predicate.columns, *self.predicate_cols)]
        return out + ([(self.agg_col, READ, True)] if self.agg_col else [])

    def columns(self, role: str | None = None, needed: bool | None = None) -> frozenset[str]:
        return frozenset(c for c, r, n in self.uses() if role in (None, r) and needed in (None, n))

    def fingerprint(self) -> frozenset[str]:
        return self.columns()

    def required_evidence(self) -> frozenset[str]:
        return self.columns(needed=True)

    @property
    def sum_kind(self) -> str:
        """The type in which values are added up."""
        return dict(self.kinds).get("sum_val", f"decimal(38,{V.SCALE})")

    def fitted(self, state: DataFrame) -> QueryShape:
        """This shape for a stored state: evidence beyond the types of its groups and sum is refused."""
        kinds = {f.name: f.dataType.simpleString() for f in state.schema}
        own = [(c, kinds[f"g{i}"]) for i, c in enumerate(self.group_cols)]
        return replace(self, kinds=(*own, ("sum_val", kinds["sum_val"])))


@dataclass(frozen=True)
class JoinClause:
    """table.key is the right side's primary key; left is (table, column) of an earlier one."""

    table: str
    key: str
    left: tuple[str, str]
    kind: str = "inner"


@dataclass(frozen=True)
class JoinShape:
    """One aggregate over a fact table and dimensions joined by their primary keys, in a star or a snowflake.

    Columns are (table, column) pairs; predicate terms are ((table, column), operator, literal).
    """

    base: str
    base_key: str
    joins: tuple[JoinClause, ...]
    agg_fn: str
    agg_col: tuple[str, str] | None = None
    group_cols: tuple[tuple[str, str], ...] = ()
    predicate: tuple[tuple[tuple[str, str], str, object], ...] = ()
    security_cols: frozenset[tuple[str, str]] = frozenset()
    name: str = ""

    def tables(self) -> list[str]:
        return [self.base, *(j.table for j in self.joins)]

    def key_of(self, t: str) -> str:
        return self.base_key if t == self.base else next(j.key for j in self.joins if j.table == t)

    def columns_of(self, t: str, security: bool = True) -> frozenset[str]:
        """Columns of a table that the shape depends on."""
        pairs = [*self.group_cols, *(p[0] for p in self.predicate), *(j.left for j in self.joins), *((j.table, j.key) for j in self.joins)]
        pairs += [self.agg_col] if self.agg_col else []
        pairs += list(self.security_cols) if security else []
        return frozenset(c for x, c in pairs if x == t)

    def fingerprint(self) -> frozenset[str]:
        return frozenset(f"{t}.{c}" for t in self.tables() for c in self.columns_of(t))

    def required_evidence(self, t: str) -> frozenset[str]:
        return self.columns_of(t, security=False) | {self.key_of(t)}


@dataclass
class Admission:
    """The outcome of reading an SQL text: a shape, or the reason why there is none."""

    is_supported: bool
    shape: QueryShape | JoinShape | None = None
    reason: str = ""
    alias: dict[str, str] = field(default_factory=dict)


# ---------------------------------------------------------------- cold evaluation


def sum_type(kind: T.DataType | None, what: str = "") -> str:
    """The exact type of a column's sum: its own scale, and as many digits as there are. Floats have none."""
    if kind is None or isinstance(kind, T.IntegralType):
        return "decimal(38,0)"
    if isinstance(kind, T.DecimalType):
        return f"decimal(38,{kind.scale})"
    raise ValueError(f"{what} is {kind.simpleString()}, of which there is no exact sum: cast it to a decimal")


def sufficient(agg_fn: str, value: str | None, rows: DataFrame) -> list[Column]:
    """Sum, number of values and number of rows: what SUM, COUNT and AVG are maintained from. A sum that doesn't fit is NULL."""
    some = F.count(F.col(value)) if value is not None else F.count(F.lit(1))
    if value is None or agg_fn not in ("sum", "avg"):
        return [F.lit(0).cast("decimal(38,0)").alias("sum_val"), some.alias("n"), F.count(F.lit(1)).alias("rows")]
    kind = sum_type(rows.schema[value].dataType, value)
    total = F.try_sum(F.col(value).cast(kind)).cast(kind)
    return [F.when(some > 0, total).otherwise(F.lit(0).cast(kind)).alias("sum_val"), some.alias("n"), F.count(F.lit(1)).alias("rows")]


def displayed(agg_fn: str) -> Column:
    """The aggregate's value from its statistics."""
    if agg_fn == "count_star":
        return F.col("rows")
    if agg_fn == "count":
        return F.col("n")
    if agg_fn == "sum":
        return F.when(F.col("n") > 0, F.col("sum_val"))
    return F.when(F.col("n") > 0, F.col("sum_val").cast("double") / F.col("n"))


def cold_state(shape: QueryShape, rows: DataFrame) -> DataFrame:
    """Group state (g0.., sum_val, n, rows) from the table's rows; raises if a required column is absent."""
    absent = shape.required_evidence() - set(rows.columns)
    if absent:
        raise ValueError(f"{shape.relation} lacks {sorted(absent)}")
    kept = rows.where(shape.predicate.on_rows(rows))
    groups = [F.col(c).alias(f"g{i}") for i, c in enumerate(shape.group_cols)]
    return kept.groupBy(*groups).agg(*sufficient(shape.agg_fn, shape.agg_col, rows))


def values(shape: QueryShape | JoinShape, state: DataFrame) -> DataFrame:
    groups = [c for c in state.columns if c.startswith("g") and c[1:].isdigit()]
    return state.select(*groups, displayed(shape.agg_fn).alias("value"))


# ---------------------------------------------------------------- SQL text of shapes


def _literal_sql(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else format(Decimal(str(value)), "f")


def _aggregate_sql(agg_fn: str, column: str | None) -> str:
    return "COUNT(*)" if agg_fn == "count_star" else f"{agg_fn.upper()}({column})"


def group_state_sql(shape: QueryShape) -> str:
    """ANSI SQL for the statistics that a state is kept from: the groups, __sum_val, __non_null_count, __row_count."""
    value = shape.agg_col
    total = f"SUM({value})" if value and shape.agg_fn in ("sum", "avg") else "0"
    picked = [*shape.group_cols, f"{total} AS __sum_val", f"COUNT({value or '*'}) AS __non_null_count", "COUNT(*) AS __row_count"]
    where = " AND ".join(f"{c} {op} {_literal_sql(v)}" for c, op, v in shape.predicate.terms)
    groups = f" GROUP BY {', '.join(shape.group_cols)}" if shape.group_cols else ""
    return f"SELECT {', '.join(picked)} FROM {shape.relation}{f' WHERE {where}' if where else ''}{groups}"


def join_sql(shape: JoinShape) -> str:
    """The statement that a join shape stands for, which the admission reads back as the same shape."""
    name = ".".join
    groups = ", ".join(map(name, shape.group_cols))
    joins = "".join(f" {'LEFT JOIN' if j.kind == 'left' else 'JOIN'} {j.table} ON {name(j.left)} = {j.table}.{j.key}" for j in shape.joins)
    where = " AND ".join(f"{name(c)} {op} {_literal_sql(v)}" for c, op, v in shape.predicate)
    value = _aggregate_sql(shape.agg_fn, name(shape.agg_col) if shape.agg_col else None)
    return f"SELECT {groups + ', ' if groups else ''}{value} FROM {shape.base}{joins}{f' WHERE {where}' if where else ''}{f' GROUP BY {groups}' if groups else ''}"
