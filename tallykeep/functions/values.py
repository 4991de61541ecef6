"""Tagged values, row images and change events as Spark columns.

An image is a map from column name to a struct of a type tag and a text, so that an absent column differs from a
NULL one, and 1 from 1.0, '1' and true. Tags: null, bool, int, dec, float, str, json. Numbers stay texts until they
are added up, so that they are compared exactly at any length. Functions named *_sql return SQL text, which is
parsed in one call; larger expressions are built from it.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = "map<string,struct<t:string,v:string>>"
EVENT_SCHEMA = (
    f"stream_id string, seq long, event_id string, relation string, op string, schema_change boolean, old {IMAGE}, new {IMAGE}, "
    "changed_cols array<string>, unavailable_cols array<string>, boundary_clock string, old_complete boolean, "
    "new_complete boolean, changed_complete boolean, tx_id string"
)
#: Places after the point in which evidence is added up where the column's own type isn't known.
SCALE = 18
NUMBERS = "('int', 'dec')"
_PLAIN = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"


# ---------------------------------------------------------------- SQL text


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def names_sql(columns) -> str:
    return f"array({', '.join(text_sql(c) for c in sorted(columns))})" if columns else "cast(array() as array<string>)"


def any_sql(conditions) -> str:
    got = [f"({c})" for c in conditions]
    return " or ".join(got) if got else "false"


def all_sql(conditions) -> str:
    got = [f"({c})" for c in conditions]
    return " and ".join(got) if got else "true"


def canonical_sql(v: str) -> str:
    """The one text of a plain number: no sign but a minus, no zeros that say nothing."""
    for pattern, to in (("^[+]?(-?)0*([0-9]*)[.]?([0-9]*?)0*$", "$1$2.$3"), ("[.]$", ""), ("^(-?)(?=[.])", "$10"), ("^-?$", "0")):
        v = f"regexp_replace({v}, '{pattern}', '{to}')"
    return v


def plain_sql(v: str) -> str:
    return f"{v} rlike '{_PLAIN}'"


def key_sql(x: str) -> str:
    """A tagged value as the text of a key: 1 and 1.00 are one, NULL is itself."""
    return f"case when {x}.t in {NUMBERS} then {canonical_sql(x + '.v')} when {x}.t <> 'null' then {x}.v end"


def same_sql(a: str, b: str) -> str:
    """Typed equality of two tagged values: whole and decimal numbers by value, all else by tag and text."""
    both = all_sql([f"{x}.t in {NUMBERS} and {plain_sql(x + '.v')}" for x in (a, b)])
    return f"({a} <=> {b} or coalesce({both} and {canonical_sql(a + '.v')} = {canonical_sql(b + '.v')}, false))"


def exact_sql(v: str, kind: str) -> str:
    """The text of a number as a value of an integral or decimal type; NULL unless it is exactly that."""
    scale = int(kind.split(",")[1].rstrip(")")) if kind.startswith("decimal") else 0
    number = f"try_cast({v} as {kind if kind.startswith('decimal') else 'decimal(38,0)'})"
    number = f"if({v} rlike '^[+-]?[0-9]*[.]?[0-9]{{0,{scale}}}0*$', {number}, null)"
    return number if kind.startswith("decimal") else f"try_cast({number} as {kind})"


def fits_sql(x: str, kind: str) -> str:
    """Whether a tagged value is one of a column's type: none is rounded, cut or read from another kind."""
    if kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint"):
        ok = f"{x}.t in {NUMBERS} and {exact_sql(x + '.v', kind)} is not null"
    elif kind in ("string", "boolean"):
        ok = f"{x}.t = '{'str' if kind == 'string' else 'bool'}'"
    else:
        ok = f"try_cast({x}.v as {kind}) is not null"
    return f"coalesce({x}.t = 'null' or ({ok}), false)"


def compare_sql(c: str, op: str, value) -> str:
    """c op value, for a text against a text or a number's canonical text against a number; exact at any length."""
    if isinstance(value, str):
        return f"{c} {op} {text_sql(value)}"
    plain = format(Decimal(str(value)), "f")
    low, digits = plain.startswith("-"), plain.lstrip("+-")
    whole, _, part = digits.partition(".")
    whole, part = whole.lstrip("0") or "0", part.rstrip("0")
    low = low and (whole, part) != ("0", "")
    own = ("-" if low else "") + whole + (f".{part}" if part else "")
    size = f"trim(LEADING '-' FROM {c})"
    w, p = f"substring_index({size}, '.', 1)", f"if(contains({c}, '.'), substring_index({c}, '.', -1), '')"
    beyond = lambda x: f"(length({w}) {x} {len(whole)} or (length({w}) = {len(whole)} and ({w} {x} '{whole}' or ({w} = '{whole}' and {p} {x} '{part}'))))"
    more = f"(not startswith({c}, '-') or {beyond('<')})" if low else f"(not startswith({c}, '-') and {beyond('>')})"
    same = f"{c} = '{own}'"
    return {"=": same, "!=": f"not ({same})", "<>": f"not ({same})", ">": more, ">=": f"({more} or {same})", "<=": f"not {more}", "<": f"not ({more} or {same})"}[op]


# ---------------------------------------------------------------- columns


def normalize_relation(name: Column) -> Column:
    """Each dotted part trimmed, in lower case; the namespace stays part of the name."""
    return F.lower(F.array_join(F.transform(F.split(name, r"\."), F.trim), "."))


def relation_sql(name: str) -> str:
    return f"lower(array_join(transform(split({name}, '[.]'), p -> trim(p)), '.'))"


def relation_name(name: str) -> str:
    return ".".join(p.strip() for p in name.split(".")).lower()


def tag_of(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "str"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.DecimalType):
        return "dec"
    if isinstance(kind, T.FractionalType):
        return "float"
    return "bool" if isinstance(kind, T.BooleanType) else "json"


def tagged(value: Column, kind: T.DataType) -> Column:
    tag = tag_of(kind)
    text = F.to_json(F.struct(value)) if tag == "json" and not isinstance(kind, (T.DatetimeType,)) else value.cast("string")
    return F.struct(F.when(value.isNull(), "null").otherwise(tag).alias("t"), F.when(value.isNotNull(), text).alias("v"))


def tagged_sql(column: str, kind: T.DataType) -> str:
    tag, c = tag_of(kind), quoted(column)
    text = f"to_json(struct({c}))" if tag == "json" and not isinstance(kind, T.DatetimeType) else f"cast({c} as string)"
    return f"named_struct('t', if({c} is null, 'null', '{tag}'), 'v', if({c} is null, null, {text}))"


def image(df: DataFrame, columns: dict[str, Column | str]) -> Column:
    """An image of named columns (given by name) or expressions over df; the tags follow from their types."""
    if all(isinstance(c, str) for c in columns.values()):
        pairs = [f"{text_sql(k)}, {tagged_sql(c, df.schema[c].dataType)}" for k, c in columns.items()]
        return F.expr(f"map({', '.join(pairs)})")
    kinds = df.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()]).schema
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), tagged(F.col(c) if isinstance(c, str) else c, kinds[k].dataType))])


def empty_image() -> Column:
    return F.from_json(F.lit("{}"), IMAGE)


def has(img: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(img, name), F.lit(False))


def key_text(img: str, name: str) -> Column:
    """The key under a name of the image column img."""
    return F.expr(key_sql(f"{img}[{text_sql(name)}]"))


def key_of_column(df: DataFrame, column: str) -> Column:
    """The key of a typed column, as the text that its image would give."""
    kind, c = df.schema[column].dataType, F.col(quoted(column))
    if tag_of(kind) not in ("int", "dec"):
        return c.cast("string")
    return F.expr(canonical_sql(f"cast({quoted(column)} as string)"))


def read_key(key: Column | str, kind: T.DataType) -> Column:
    """A key's text as a value of the type; raises if it is none, which certification rules out."""
    key = F.col(key) if isinstance(key, str) else key
    got = key.try_cast(kind)
    return F.when(key.isNull() | got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit(f"no {kind.simpleString()}: "), key)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
