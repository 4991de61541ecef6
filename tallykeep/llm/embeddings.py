"""Near-duplicate embeddings by binary codes of random rotations (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, written
from .components import connected_components

COSINE = 0.98
#: Planned share of pairs at the threshold itself that meet in some band; pairs above it meet more often.
RECALL = 0.998
#: Standard errors of the estimate by which a pair must miss the threshold to be rejected unseen.
ERRORS = 4.0
#: Buckets of more rows are dealt out as pairs of blocks of this size.
BLOCK_ROWS = 512
_SEED = 7


def _bands(most: int, cosine: float) -> tuple[int, int]:
    """Bits of a band and number of bands, for groups of at most so many vectors."""
    agree = 1 - math.acos(min(1.0, cosine)) / math.pi
    bits = min(28, max(12, math.ceil(math.log2(max(2, most))) + 1))
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(agree**bits, 1 - 1e-9))))


def rotations(dim: int, bits: int) -> np.ndarray:
    """Random rotations of the space, one below the other, scaled so that lengths and inner products stay: (bits', dim)."""
    rng = np.random.Generator(np.random.PCG64([_SEED, dim]))
    n = -(-bits // dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)]) / math.sqrt(n)


_rotations: dict[tuple[int, int], np.ndarray] = {}


def _rotation(dim: int, bits: int) -> np.ndarray:
    if (dim, bits) not in _rotations:
        _rotations[dim, bits] = rotations(dim, bits)
    return _rotations[dim, bits]


def encode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated unit vectors, and for each the inner product of the vector and its code."""
    z = x @ _rotation(x.shape[1], bits).T
    sign = z > 0
    return sign, np.abs(z).sum(1) / math.sqrt(z.shape[1])


def estimate(sign: np.ndarray, factor: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products between coded vectors and rotated ones, and each row's error."""
    n = z.shape[1]
    code = (2 * sign - 1.0) / math.sqrt(n)
    return (code @ z.T) / factor[:, None], np.sqrt((1 - factor**2).clip(0)) / factor / math.sqrt(max(1, n - 1))


def _values(sign: np.ndarray, bits: int, bands: int) -> np.ndarray:
    weight = 1 << np.arange(bits, dtype=np.int64)
    return (sign[:, : bits * bands].reshape(-1, bands, bits) * weight).sum(2)


def _code(bits: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            lists = batch.column(4)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 1024):
                    rows = at[lo : lo + 1024]
                    part = batch.take(pa.array(rows))
                    x = np.array(part.column(4).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                    unit = x / np.sqrt((x * x).sum(1))[:, None]
                    sign, factor = encode(unit, bits * bands)
                    value = _values(sign, bits, bands)
                    packed = np.packbits(sign, axis=1)
                    n = len(rows)
                    again = np.tile(np.arange(n), bands)
                    cols = [part.column(k).take(pa.array(again)) for k in (0, 1, 2, 3)]
                    body = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(again))
                    codes = pa.array([r.tobytes() for r in packed], pa.binary()).take(pa.array(again))
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(np.repeat(np.arange(bands, dtype=np.int32), n)), pa.array(value.T.ravel()), codes, pa.array(factor[again]), body],
                        ["label", "rep", "n", "dim", "band", "bucket", "code", "factor", "vector"],
                    )

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n rows the row of its component that comes first in order."""
    rank = np.argsort(order, kind="stable")
    least = np.empty(n, np.int64)
    least[rank] = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = np.minimum(new, new[rank[new]])
        if (new == least).all():
            return rank[least]
        least = new


def _compare(rows: dict, bits: int, bands: int, cosine: float):
    """Links of a bucket, or of two blocks of one: each vector's number of linked ones, and its component here."""
    dim = int(rows["dim"][0])
    x = np.frombuffer(b"".join(rows["vector"]), np.float64).reshape(-1, dim)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    n, total = len(x), len(_rotation(dim, bits * bands))
    sign = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(n, -1), axis=1)[:, :total].astype(bool)
    value = _values(sign, bits, bands)
    z = unit @ _rotation(dim, bits * bands).T
    block, (first, second), band = rows["block"], rows["pair"], int(rows["band"][0])
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    got, error = estimate(sign[left], rows["factor"][left], z[right])
    i, j = np.nonzero(got + ERRORS * error[:, None] >= cosine)
    i, j = left[i], right[j]
    ok = i < j if first == second else np.ones(len(i), bool)
    i, j = i[ok], j[ok]
    if band:  # pairs that an earlier band has are left to it
        new = ~(value[i, :band] == value[j, :band]).any(1)
        i, j = i[new], j[new]
    exact = np.einsum("ij,ij->i", x[i], x[j]) / (np.sqrt((x * x).sum(1))[i] * np.sqrt((x * x).sum(1))[j])
    i, j = i[exact >= cosine], j[exact >= cosine]
    if not len(i):
        return None
    links = np.zeros(n, np.int64)
    np.add.at(links, i, rows["n"][j])
    np.add.at(links, j, rows["n"][i])
    root = _roots(n, i, j, rows["rep"])
    have = np.flatnonzero(links)
    return rows["rep"][have], links[have], rows["rep"][root[have]]


def _search(bits: int, bands: int, cosine: float):
    names = ["label", "dim", "band", "bucket", "first", "second", "block", "rep", "n", "code", "factor", "vector"]

    def flush(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        if len(t) < 2:
            return None
        rows = {c: t.column(c).to_numpy() for c in ("dim", "band", "block", "rep", "n", "factor")}
        rows |= {c: t.column(c).to_pylist() for c in ("code", "vector")}
        rows["pair"] = (t.column("first")[0].as_py(), t.column("second")[0].as_py())
        return _compare(rows, bits, bands, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        out: list[tuple] = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in names[:6]]
            keys = list(zip(*cols))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    if held and (got := flush(held)):
                        out.append(got)
                    held, key = [], keys[a]
                held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["rep", "links", "root"])
                out = []
        if held and (got := flush(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["rep", "links", "root"])

    return run


def embedding_groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Near-duplicates among vectors with equal labels: vec_id, n_links, component_id, kept; a row for each row.

    Equal vectors of a label collapse to one with their number. Each is coded by the signs of its random
    rotations, with the correction factor that makes inner-product estimates unbiased. Bands of the code deal
    vectors into buckets; in a bucket every pair is estimated from one's code and the other's rotation, and
    pairs whose confidence bound reaches the threshold are computed exactly in double precision. Every pair is
    taken in the first band it shares. Buckets over BLOCK_ROWS are dealt out as pairs of blocks. Tasks report
    sums of links and a forest of components, not pairs, and no bucket is capped.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing; nor do vectors of different length. A row without an id links with nothing and has neither
    component nor place (kept is false). Rows that repeat an id count as vectors of their own. Other columns are
    ignored.
    """
    bound_batches(vectors.sparkSession)
    vec = F.col(embedding)
    sound = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.when(sound, F.col(label).cast("string")).alias("label"),
        F.when(sound, F.xxhash64(vec)).alias("k1"),
        F.when(sound, F.xxhash64(F.lit(1), vec)).alias("k2"),
        vec.cast("array<double>").alias("vec"),
    )
    classes = rows.where("label is not null").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("dim", F.size("vec")), "classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, bands = _bands(most, cosine)

    key = ["label", "dim", "band", "bucket"]
    schema = "label string, rep long, n long, dim int, band int, bucket long, code binary, factor double, vector binary"
    coded = classes.select("label", "rep", "n", "dim", "vec").mapInArrow(_code(bits, bands), schema)
    crowded = written(coded.groupBy(*key).count().where(F.col("count") > BLOCK_ROWS), "crowded")
    one = F.lit(0)
    if crowded.isEmpty():
        dealt = coded.select("*", one.alias("first"), one.alias("second"), one.alias("block"))
    else:
        blocks = F.coalesce(F.ceil(F.col("count") / BLOCK_ROWS).cast("int"), F.lit(1))
        dealt = coded.join(crowded, key, "left").withColumn("blocks", blocks)
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    at = [*key, "first", "second"]
    dealt = dealt.select(*at, "block", "rep", "n", "code", "factor", "vector").repartition(*at).sortWithinPartitions(*at)
    found = written(dealt.mapInArrow(_search(bits, bands, cosine), "rep long, links long, root long"), "found")
    drop(crowded)

    links = found.groupBy(F.col("rep").alias("node_l")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    info = classes.select(F.col("label").alias("l"), F.col("k1").alias("x"), F.col("k2").alias("y"), "rep", "n")
    info = info.join(links, info.rep == links.node_l, "left").join(comp, info.rep == comp.node, "left")
    info = info.select("l", "x", "y", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "label", "k1", "k2").join(info, (F.col("label") == F.col("l")) & (F.col("k1") == F.col("x")) & (F.col("k2") == F.col("y")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(node, top) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.top FROM r JOIN l ON l.b = r.node),
c AS (SELECT node, min(top) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
