"""Near copies by SimHash fingerprints of their word shingles, found as in operator 3, for the pipeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches, drop, gram_hashes, is_empty, mix64, packed_row, row_key, signed, text_buffers, word_hashes, written
from .components import connected_components
from .simhash import embedding, manhattan

#: Words of a shingle, and the share of common shingles from which two texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: A fingerprint is so many words of 64 bits. A bit differs between sets at 0.8 with a chance of 0.16 at most (0.19
#: if they have five shingles together), so of 512 bits more than MOST_BITS do with one below 1e-8 (1.2e-4).
WORDS, MOST_BITS = 8, 128
#: Bits that differ in the first two words, by which the sweep rules pairs out: above that with a chance below 1e-7.
FIRST_WORDS, FIRST_BITS = 2, 48
#: In sets of at most so many shingles bits differ oftener; two that share a cell are compared at any distance.
FEW = 32
#: Cells of at most so many texts are compared pair by pair.
CELL_TEXTS = 16
#: The sweep's classes of set sizes are a little wider than SIMILARITY allows, so only neighbours are compared; each is dealt to PARTS.
CLASS, PARTS = 1.26, 4
NO_ID = np.iinfo(np.int64).max

_TIMES = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its k-word shingles, A-Z in lower case; fewer than k words are one shingle."""
    low = data[off[0] : off[-1]]
    low = low + ((low >= 65) & (low <= 90)).astype(np.uint8) * np.uint8(32)
    words, first = word_hashes(low, off - off[0])
    for a, b in zip(first, first[1:]):
        yield np.unique(gram_hashes(words[a:b], min(k, b - a))) if b > a else np.zeros(0, np.uint64)


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, as WORDS longs: a bit is 1 if set in over half of the hashes, as in operator 3."""
    counts = np.zeros(64 * WORDS, np.int64)
    for lo in range(0, len(grams), 255):
        h = mix64(grams[lo : lo + 255, None] * _TIMES)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(grams), bitorder="little").view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    data, off = text_buffers(batch.column(column))
    for lo, hi in blocks(off):
        yield from shingle_sets(data, off[lo : hi + 1])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each text's set of shingles, how many these are, and their fingerprint."""
    for batch in batches:
        node, n, fp = [], [], []
        for g in _sets(batch, 2):
            node.append(xxhash.xxh64_intdigest(g.tobytes()))
            n.append(len(g))
            fp.append(fingerprint(g))
        cols = [batch.column(0), batch.column(1), pa.array(signed(np.array(node, np.uint64))), pa.array(n, pa.int64()), pa.array(fp, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["id", "tkey", "node", "n", "fp"])


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = pa.array([g.tobytes() for g in _sets(batch, 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), grams], ["node", "grams"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets are similar enough."""
    for batch in batches:
        ok = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= SIMILARITY for x, y in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, sets_of, comp: DataFrame | None) -> DataFrame | None:
    """The components comp (node, component) as joined by those of the pairs (a, b), a table of written(), that are near copies.

    Only texts of the pairs are made sets of: a set is about as large as its text.
    """
    if is_empty(pairs):
        drop(pairs)
        return comp
    sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    x, y = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
    found = pairs.join(x, "a").join(y, "b").select("a", "b", "ga", "gb").mapInArrow(_near, "a long, b long")
    found = written(found, "links")
    drop(pairs, sets)
    if comp is not None and is_empty(found):
        drop(found)
        return comp
    joined = connected_components(found if comp is None else found.union(comp))
    drop(found, comp)
    return joined


def _sizes(x: str, y: str) -> Column:
    """Whether two sets' sizes allow SIMILARITY; x and y are structs (n, fp)."""
    n = [F.col(f"{c}.n") for c in (x, y)]
    return F.least(*n) >= F.greatest(*n) * SIMILARITY - 1e-6


def _apart(x: str, y: str, distance) -> Column:
    """The sum of distance over the words of two fingerprints; as a lambda, so that plans don't hold it once for each word."""
    each = F.zip_with(f"{x}.fp", f"{y}.fp", lambda a, b: distance(a, b).cast("int"))
    return F.aggregate(each, F.lit(0), lambda total, d: total + d)


def _within(x: str, y: str) -> Column:
    """Whether two sketches (n, fp) leave it open that their sets are near: their sizes, then the exact distance."""
    return _sizes(x, y) & (_apart(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))) <= MOST_BITS)


def _close(x: str, y: str) -> Column:
    """The same with the Manhattan bound of the embeddings before the exact distance."""
    return _sizes(x, y) & (_apart(x, y, lambda a, b: manhattan(embedding(a), embedding(b))) <= MOST_BITS) & _within(x, y)


def _cells(nodes: DataFrame) -> DataFrame:
    """Grid cells (key, ord, node): each half of a fingerprint's words names one by the popcounts of its 16 segments."""
    halves = [(i, half) for i in range(WORDS) for half in (0xFFFFFFFF, -(1 << 32))]
    keys = [F.xxhash64(F.lit(k), embedding(F.col("fp")[i]).bitwiseAND(F.lit(half).cast("long"))) for k, (i, half) in enumerate(halves)]
    return nodes.where("n > 0").select("node", "ord", F.explode(F.array(*keys)).alias("key"))


def _grouped(cells: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Texts of cells (key, ord, node) with the component that they are in so far, c; a text alone is its own."""
    if comp is None:
        return cells.withColumn("c", F.col("node"))
    return cells.join(comp, "node", "left").select("key", "ord", "node", F.coalesce("component", "node").alias("c"))


def _links(cells: DataFrame, nodes: DataFrame, sets_of, cell_texts: int) -> DataFrame | None:
    """Components (node, component) of near copies among texts that share cells (key, ord, node); none if no two do.

    Each text is first held against one other, the first one of its cells that it shares most of them with; what
    that joins needs no further comparison. Then come the pairs of texts that aren't joined yet: all of a small
    cell, and of a large one those with its first text. Other pairs of large cells are left to the sweep. Only
    pairs whose fingerprints are close (or whose sets are small) are verified: the more texts there are, the more
    share a cell by chance, in the end nearly all.
    """
    comp = None
    first = F.min(F.struct("ord", "node", "c")).alias("first")
    for alone in (True, False):
        known = _grouped(cells, comp)
        stats = known.groupBy("key").agg(F.count("*").alias("n"), first).where("n > 1")
        shared = written(known.join(stats, "key").select("key", "ord", "node", "c", "n", F.col("first.node").alias("leader"), F.col("first.c").alias("lc")), "shared")
        if is_empty(shared):
            drop(shared)
            return comp
        sign, head = (nodes.select(F.col("node").alias(k), F.struct("n", "fp").alias(s)) for k, s in (("node", "sign"), ("leader", "lsign")))
        if alone:
            often = shared.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("k"))
            most = often.groupBy("node").agg(F.min(F.struct(-F.col("k"), "leader")).alias("m")).select("node", "m.leader")
            few = F.greatest("sign.n", "lsign.n") <= FEW
            near = most.join(sign, "node").join(head, "leader").where(_within("sign", "lsign") | (few & _sizes("sign", "lsign")))
            pairs = near.select(F.col("leader").alias("a"), F.col("node").alias("b"))
        else:
            signed_ = shared.where((F.col("n") <= cell_texts) | (F.col("c") != F.col("lc"))).join(sign, "node")
            x, y = (signed_.where(F.col("n") <= cell_texts).select("key", F.col("node").alias(k), F.col("c").alias(f"c{k}"), F.col("sign").alias(f"s{k}")) for k in "ab")
            apart = x.join(y, "key").where("a < b and ca <> cb").where(_close("sa", "sb")).select("a", "b")
            far = signed_.where(F.col("n") > cell_texts).select("leader", "node", "sign").join(head, "leader").where(_close("sign", "lsign"))
            pairs = apart.union(far.select(F.col("leader").alias("a"), F.col("node").alias("b")))
        pairs = written(pairs.distinct(), "pairs")
        drop(shared)
        comp = _verified(pairs, sets_of, comp)
    return comp


def _tile(node: np.ndarray, n: np.ndarray, c: np.ndarray, fp: np.ndarray, left: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (places, places, distance) of texts of the left and the right, or alone of the left, whose fingerprints are close."""
    a = np.flatnonzero(left)
    a = a[np.argsort(n[a], kind="stable")]
    b = a if alone else (r := np.flatnonzero(~left))[np.argsort(n[r], kind="stable")]
    for lo in range(0, len(a), 128):
        x = a[lo : lo + 128]
        first = np.searchsorted(n[b], n[x[0]] * SIMILARITY - 0.5)
        last = np.searchsorted(n[b], n[x[-1]] / SIMILARITY + 0.5, "right")
        for at in range(max(first, lo if alone else 0), last, 2048):
            y = b[at : min(at + 2048, last)]
            bits = sum(np.bitwise_count(fp[x, w][:, None] ^ fp[y, w]) for w in range(FIRST_WORDS))
            i, j = np.nonzero(bits <= FIRST_BITS)
            if alone:
                i, j = i[(ok := lo + i < at + j)], j[ok]
            i, j = x[i], y[j]
            ok = (c[i] != c[j]) & (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]) - 1e-6)
            i, j = i[ok], j[ok]
            d = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64)
            ok = d <= MOST_BITS
            if ok.any():
                yield i[ok], j[ok], d[ok]


def _tiles(nearest: bool):
    """For a tile's texts the close pairs, or of each text only that with the nearest other one."""

    def run(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        node, n, c = (table.column(k).to_numpy() for k in ("node", "n", "c"))
        fp = table.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        left = table.column("left").to_numpy()
        alone = tile // PARTS**2 % 2 == 0 and tile // PARTS % PARTS == tile % PARTS
        most = np.full(len(node), MOST_BITS + 1)
        best, out = np.zeros(len(node), np.int64), []
        for i, j, d in _tile(node, n, c, fp, left, alone):
            if not nearest:
                out.append((node[i], node[j], d))
                continue
            for p, q in ((i, j), (j, i)):
                order = np.lexsort((d, p))
                p, q, e = p[order], q[order], d[order]
                p, at = np.unique(p, return_index=True)
                better = e[at] < most[p]
                most[p[better]], best[p[better]] = e[at][better], node[q[at][better]]
        if nearest:
            has = most <= MOST_BITS
            out = [(node[has], best[has], most[has])]
        cols = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        return pa.table([pa.array(x.astype(np.int64)) for x in cols], ["a", "b", "d"])

    return run


def _sweep(nodes: DataFrame, comp: DataFrame | None, nearest: bool) -> DataFrame:
    """All pairs (a, b) of texts that aren't joined yet, whose set sizes allow SIMILARITY and whose fingerprints are close;
    with nearest, for each text only the one with the closest fingerprint.

    Sizes fall into classes, each dealt to PARTS; a tile is two parts of one class or of neighbouring ones.
    """
    known = nodes.where("n >= 4").select("node", "n", "fp", F.floor(F.log("n") / F.log(F.lit(CLASS))).cast("long").alias("k"), F.pmod("node", F.lit(PARTS)).alias("p"))
    known = known.withColumn("c", F.col("node")) if comp is None else known.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    at = lambda k, i, j, left: f"transform(sequence(0, {PARTS - 1}), q -> struct((({k}) * {PARTS} + {i}) * {PARTS} + {j} as tile, {left} as left))"
    tiles = F.expr(f"concat({at('2 * k', 'least(p, q)', 'greatest(p, q)', 'p <= q')}, {at('2 * k + 1', 'p', 'q', 'true')}, {at('2 * k - 1', 'q', 'p', 'false')})")
    rows = known.select("node", "n", "fp", "c", F.explode(tiles).alias("t")).select("node", "n", "fp", "c", F.col("t.tile").alias("tile"), F.col("t.left").alias("left"))
    found = rows.groupBy("tile").applyInArrow(_tiles(nearest), "a long, b long, d long")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _swept(nodes: DataFrame, sets_of, comp: DataFrame | None) -> DataFrame | None:
    """The components with all links that the grid has missed: first to the nearest texts, then all that are left."""
    for nearest in (True, False):
        pairs = written(_sweep(nodes, comp, nearest), "close")
        if is_empty(pairs):
            drop(pairs)
            return comp
        comp = _verified(pairs, sets_of, comp)
    return comp


def keep_first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cell_texts: int = CELL_TEXTS) -> DataFrame:
    """One document of each group of near copies, with the columns of docs: that with the smallest id.

    Two texts are near copies if their sets of five-word shingles (A-Z in lower case) have a Jaccard similarity
    of 0.8 or more. Candidates are found by SimHash fingerprints of 512 bits as in operator 3: their embedding in
    popcounts of two-bit segments gives 16 grid cells; what shares one is held against the Manhattan bound and the
    exact distance, and then verified by the exact similarity. In a cell of more than cell_texts texts all are
    compared with the first one. So no cell grows with the square of a group of copies. At 0.8 bits differ too often for equal cells to find every pair, so a sweep follows: all pairs that
    aren't joined yet and whose set sizes allow 0.8 are held against the distance, and close ones verified.
    Its work grows with the square of the number of different texts, a nanosecond or so a pair.

    Equal sets collapse first. Texts without words are one group. A row without an id comes after all others. Of
    rows that repeat an id with other texts in the group, the smallest hash decides; equal rows are kept once.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    sketches = written(rows.mapInArrow(_sketches, "id long, tkey long, node long, n long, fp array<long>"), "sketches")
    first = F.min(F.struct(F.col("id").isNull(), "id", "tkey")).alias("first")
    nodes = written(sketches.groupBy("node").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    drop(sketches)
    ordered = nodes.withColumn("ord", F.coalesce("first.id", F.lit(NO_ID)))

    def sets_of(some: DataFrame) -> DataFrame:
        one = nodes.join(some, "node").select("node", F.col("first.id").alias("_id"), F.col("first.tkey").alias("_tkey"))
        whole = rows.join(one, F.expr("id <=> _id and tkey = _tkey")).select("node", "text").dropDuplicates(["node"])
        return whole.mapInArrow(_packed_sets, "node long, grams binary")

    comp = _links(_cells(ordered), nodes, sets_of, cell_texts)
    comp = _swept(nodes, sets_of, comp)
    if comp is None:
        keep = nodes.select("first.id", "first.tkey")
    else:
        rooted = ordered.join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
        keep = rooted.groupBy("root").agg(F.min(F.struct("ord", "node", "first")).alias("least")).select("least.first.id", "least.first.tkey")
    keep = written(keep.select(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(NO_ID)).alias("own"), F.col("tkey").alias("key")), "kept")
    drop(nodes, comp)
    own = F.col(doc_id).cast("long")
    out = docs.select(own.isNull().alias("none"), F.coalesce(own, F.lit(NO_ID)).alias("own"), row_key(F.col(text)).alias("key"), packed_row(docs))
    return out.groupBy("none", "own", "key").agg(F.first("row").alias("row")).join(keep, ["none", "own", "key"]).select("row.*")
