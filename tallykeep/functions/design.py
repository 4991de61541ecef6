"""Relational design: dependencies, keys, normal forms, decompositions, the chase and DDL. Inputs are metadata, so
all of it runs on the driver; only the checks on data at the end are DataFrame operations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Attrs = frozenset[str]


@dataclass(frozen=True, order=True)
class FD:
    """A functional dependency, from left to right."""

    left: tuple[str, ...]
    right: tuple[str, ...]

    @staticmethod
    def of(x) -> FD:
        """From 'A, B -> C', a pair, or a mapping with determinant/dependent or lhs/rhs."""
        if isinstance(x, FD):
            return x
        if isinstance(x, str):
            parts = re.split(r"->|→", x)
            if len(parts) != 2:
                raise ValueError(f"not a dependency: {x!r}")
            a, b = ([c.strip() for c in p.split(",")] for p in parts)
        elif isinstance(x, dict):
            a, b = x.get("determinant", x.get("lhs")), x.get("dependent", x.get("rhs"))
        else:
            a, b = x
        a, b = ([s] if isinstance(s, str) else list(s) for s in (a, b))
        a, b = tuple(sorted({c for c in a if c})), tuple(sorted({c for c in b if c}))
        if not b:
            raise ValueError(f"no dependent attribute: {x!r}")
        return FD(a, b)

    def __str__(self) -> str:
        return f"{','.join(self.left)} -> {','.join(self.right)}"


@dataclass
class Relation:
    name: str
    attributes: Attrs
    fds: list[FD] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    multivalued: Attrs = frozenset()

    def __post_init__(self):
        self.attributes = frozenset(self.attributes)
        self.fds = [FD.of(f) for f in self.fds]
        unknown = {c for f in self.fds for c in f.left + f.right} - self.attributes
        if unknown:
            raise ValueError(f"{self.name} has no {sorted(unknown)}")


def closure(attrs, fds: list[FD]) -> Attrs:
    got, grew = set(attrs), True
    while grew:
        grew = False
        for f in fds:
            if got.issuperset(f.left) and not got.issuperset(f.right):
                got.update(f.right)
                grew = True
    return frozenset(got)


def minimal_cover(fds: list[FD]) -> list[FD]:
    """Single dependents, no superfluous determinant, no superfluous dependency; in sorted order."""
    out = sorted({FD(f.left, (b,)) for f in fds for b in f.right if b not in f.left})
    for i, f in enumerate(out):
        left = list(f.left)
        for a in f.left:
            if len(left) > 1 and f.right[0] in closure([x for x in left if x != a], out):
                left.remove(a)
        out[i] = FD(tuple(left), f.right)
    out = sorted(set(out))
    for f in list(out):
        rest = [g for g in out if g != f]
        if f.right[0] in closure(f.left, rest):
            out = rest
    return out


def candidate_keys(attrs, fds: list[FD]) -> list[Attrs]:
    attrs = frozenset(attrs)
    right = {b for f in fds for b in f.right if b not in f.left}
    must = attrs - right
    if closure(must, fds) >= attrs:
        return [must]
    middle = sorted(attrs - must)
    found: list[Attrs] = []
    for n in range(1, len(middle) + 1):
        for extra in combinations(middle, n):
            key = must | set(extra)
            if not any(k <= key for k in found) and closure(key, fds) >= attrs:
                found.append(key)
    return sorted(found, key=lambda k: (len(k), sorted(k)))


def is_superkey(attrs, r: Relation) -> bool:
    return closure(attrs, r.fds) >= r.attributes


def elementary_fds(r: Relation) -> list[FD]:
    """Dependencies of the cover whose determinant has no smaller one for the same dependent."""
    return [f for f in minimal_cover(r.fds) if not any(f.right[0] in closure(set(f.left) - {a}, r.fds) for a in f.left)]


def elementary_keys(r: Relation) -> list[Attrs]:
    full = elementary_fds(r)
    return [k for k in candidate_keys(r.attributes, r.fds) if any(frozenset(f.left) == k for f in full)]


def violations(r: Relation) -> dict[str, list[str]]:
    """What stands against each normal form."""
    keys = candidate_keys(r.attributes, r.fds)
    prime = frozenset().union(*keys) if keys else frozenset()
    out: dict[str, list[str]] = {"1NF": [f"{c} isn't atomic" for c in sorted(r.multivalued)], "2NF": [], "3NF": [], "EKNF": [], "BCNF": []}
    elementary = frozenset().union(*elementary_keys(r)) if elementary_keys(r) else frozenset()
    for f in minimal_cover(r.fds):
        b = f.right[0]
        if any(set(f.left) < k for k in keys) and b not in prime:
            out["2NF"].append(f"{f}: depends on a part of a key")
        if is_superkey(f.left, r):
            continue
        out["BCNF"].append(f"{f}: the determinant is no superkey")
        if b not in prime:
            out["3NF"].append(f"{f}: {b} is in no key")
        if b not in elementary:
            out["EKNF"].append(f"{f}: {b} is in no elementary key")
    return out


def classify(r: Relation) -> dict:
    """The highest normal form of UNF, 1NF, 2NF, 3NF and BCNF, with keys and violations; EKNF is a flag."""
    bad = violations(r)
    highest = "UNF"
    for form in ("1NF", "2NF", "3NF", "BCNF"):
        if bad[form]:
            break
        highest = form
    ok = not bad["1NF"] and not bad["2NF"] and not bad["3NF"]
    return {"relation": r.name, "highest": highest, "keys": [sorted(k) for k in candidate_keys(r.attributes, r.fds)], "eknf": ok and not bad["EKNF"], "violations": bad}


def project(fds: list[FD], attrs) -> list[FD]:
    """A cover of the dependencies that hold within some attributes."""
    attrs = sorted(attrs)
    out = []
    for n in range(1, len(attrs)):
        for left in combinations(attrs, n):
            right = (closure(left, fds) & set(attrs)) - set(left)
            if right:
                out.append(FD(tuple(left), tuple(sorted(right))))
    return minimal_cover(out)


def synthesize(r: Relation) -> list[Relation]:
    """Third normal form: a table for each determinant of the cover, one with a key, none within another."""
    cover = minimal_cover(r.fds)
    by_left: dict[tuple[str, ...], set[str]] = {}
    for f in cover:
        by_left.setdefault(f.left, set()).update(f.right)
    heads = [frozenset(k) | v for k, v in sorted(by_left.items())]
    loose = r.attributes - frozenset().union(*heads) if heads else r.attributes
    keys = candidate_keys(r.attributes, r.fds)
    if not any(k <= h for k in keys for h in heads):
        heads.append(keys[0] | loose)
    kept = [h for i, h in enumerate(heads) if not any(h < g or (h == g and j < i) for j, g in enumerate(heads))]
    return [Relation(f"{r.name}_3nf_{i}", h, project(r.fds, h), {c: t for c, t in r.types.items() if c in h}) for i, h in enumerate(kept, 1)]


def binary_lossless(a, b, fds: list[FD]) -> bool:
    common = frozenset(a) & frozenset(b)
    got = closure(common, fds)
    return frozenset(a) <= got or frozenset(b) <= got


def decompose_bcnf(r: Relation) -> tuple[list[Relation], list[str], list[FD]]:
    """Tables in Boyce-Codd form, the steps, and the dependencies that no table keeps."""
    todo, done, steps = [r], [], []
    while todo:
        x = todo.pop(0)
        bad = next((f for f in minimal_cover(x.fds) if not is_superkey(f.left, x)), None)
        if bad is None:
            done.append(x)
            continue
        one = closure(bad.left, x.fds) & x.attributes
        two = (x.attributes - one) | set(bad.left)
        steps.append(f"{x.name}: {bad} -> ({', '.join(sorted(one))}), ({', '.join(sorted(two))})")
        todo += [Relation(f"{x.name}_{i}", h, project(x.fds, h), x.types) for i, h in enumerate((one, two), 1)]
    kept = [f for x in done for f in x.fds]
    return done, steps, [f for f in minimal_cover(r.fds) if not closure(f.left, kept) >= set(f.right)]


def chase(attrs, parts: list[Attrs], fds: list[FD]) -> tuple[bool, list[dict[str, str]]]:
    """Whether the parts join without loss, and the chased tableau; if not, its rows give spurious tuples."""
    attrs = sorted(attrs)
    rows = [{c: ("a", c) if c in p else (f"b{i}", c) for c in attrs} for i, p in enumerate(parts)]
    changed = True
    while changed:
        changed = False
        for f in fds:
            groups: dict[tuple, list[dict]] = {}
            for row in rows:
                groups.setdefault(tuple(row[c] for c in f.left), []).append(row)
            for same in groups.values():
                for c in f.right:
                    best = min(row[c] for row in same)
                    for old in {row[c] for row in same} - {best}:
                        changed = True
                        for row in rows:
                            row[c] = best if row[c] == old else row[c]
    whole = any(all(row[c][0] == "a" for c in attrs) for row in rows)
    return whole, [{c: "_".join(v) for c, v in row.items()} for row in rows]


# ---------------------------------------------------------------- DDL

_TYPES = {"postgres": {"int": "BIGINT", "decimal": "NUMERIC(38, 6)", "bool": "BOOLEAN", "time": "TIMESTAMP", "text": "TEXT"}, "mssql": {"int": "BIGINT", "decimal": "DECIMAL(38, 6)", "bool": "BIT", "time": "DATETIME2", "text": "NVARCHAR(450)"}}


def identifier(name: str) -> str:
    out = re.sub(r"\W", "_", name)
    return f"_{out}" if not out or out[0].isdigit() else out


def _kind(name: str) -> str:
    n = name.lower()
    return "int" if "int" in n or "long" in n else "decimal" if any(x in n for x in ("dec", "num", "money")) else "bool" if "bool" in n else "time" if "date" in n or "time" in n else "text"


def foreign_keys(tables: list[Relation]) -> list[tuple[str, Attrs, str]]:
    """(table, columns, parent): the columns are a key of the parent and no key of the table."""
    out = []
    for t in tables:
        own = candidate_keys(t.attributes, t.fds)
        for p in tables:
            for k in candidate_keys(p.attributes, p.fds)[:1]:
                if p is not t and k <= t.attributes and k not in own and k < p.attributes:
                    out.append((t.name, k, p.name))
    return out


def ddl(tables: list[Relation], dialect: str = "postgres") -> list[str]:
    """CREATE statements, parents before children, with foreign keys and an index for each of them."""
    kinds, links = _TYPES[dialect], foreign_keys(tables)
    todo, order = {t.name: t for t in tables}, []
    while todo:
        free = [n for n in todo if not any(c == n and p in todo for c, _, p in links)] or [next(iter(todo))]
        for n in free:
            order.append(todo.pop(n))
    out, made = [], set()
    for t in order:
        key = candidate_keys(t.attributes, t.fds)[0]
        lines = [f"  {identifier(c)} {kinds[_kind(t.types.get(c, 'text'))]}{' NOT NULL' if c in key else ''}" for c in sorted(t.attributes, key=lambda c: (c not in key, c))]
        lines.append(f"  PRIMARY KEY ({', '.join(identifier(c) for c in sorted(key))})")
        made.add(t.name)
        for child, cols, parent in links:
            if child == t.name and parent in made:
                names = ", ".join(identifier(c) for c in sorted(cols))
                lines.append(f"  FOREIGN KEY ({names}) REFERENCES {identifier(parent)} ({names})")
        out.append(f"CREATE TABLE {identifier(t.name)} (\n" + ",\n".join(lines) + "\n)")
    for child, cols, _ in links:
        out.append(f"CREATE INDEX ix_{identifier(child)}_{'_'.join(identifier(c) for c in sorted(cols))} ON {identifier(child)} ({', '.join(identifier(c) for c in sorted(cols))})")
    return out


def redundant_groups(group_cols: list[str], fds: list[FD]) -> tuple[list[str], list[str]]:
    """Group columns to keep, and those that the kept ones determine; the later ones go first."""
    kept, gone = list(group_cols), []
    for c in reversed(group_cols):
        rest = [x for x in kept if x != c]
        if rest and c in closure(rest, fds):
            kept, gone = rest, [c, *gone]
    return kept, gone


def reduced_group_by(df: DataFrame, group_cols: list[str], fds: list[FD], aggs: list) -> DataFrame:
    """Group by what determines the rest, and take the rest from any row of the group."""
    kept, gone = redundant_groups(group_cols, fds)
    out = df.groupBy(*kept).agg(*[F.first(c).alias(c) for c in gone], *aggs)
    return out.select(*group_cols, *[c for c in out.columns if c not in group_cols])


def fd_violations(df: DataFrame, fd: FD) -> DataFrame:
    """Groups of the data for which a dependency doesn't hold: (left.., n_values)."""
    right = F.struct(*[F.col(c) for c in fd.right])
    return df.groupBy(*fd.left).agg(F.count_distinct(right).alias("n_values")).where("n_values > 1")


def lossless_on_data(df: DataFrame, parts: list[list[str]]) -> DataFrame:
    """One row: distinct rows of the data, and rows of the parts' natural join; they are equal if nothing is lost."""
    cols = df.columns
    out = df.select(*parts[0]).distinct()
    for p in parts[1:]:
        out = out.join(df.select(*p).distinct(), [c for c in p if c in out.columns])
    a = df.distinct().agg(F.count("*").alias("n_rows"))
    return a.crossJoin(F.broadcast(out.select(*cols).distinct().agg(F.count("*").alias("n_joined"))))  # one row each
