"""SimHash near-duplicates through a segment-popcount embedding (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches, drop, long_cuts, packed_row, row_key, text_buffers, written
from .components import connected_components

#: Shingles are hashed in slices of so many, which bounds memory for very long texts.
SLICE = 1 << 16
#: Segments of two bits: the packed fields of an embedding hold 0, 1 or 2.
_LOW = 0x5555555555555555
#: A grid cell with more fingerprints than this is dealt out again by finer keys.
CELL_ROWS = 512
MAX_BITS = 2


def _add(counts: np.ndarray, words: list[bytes], k: int) -> int:
    digest, n = xxhash.xxh64_intdigest, 0
    for lo in range(0, len(words) - k + 1, SLICE):
        part = words[lo : lo + SLICE + k - 1]
        h = np.array([digest(x, 42) for x in map(b" ".join, zip(*(part[i:] for i in range(k))))], "<u8")
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return n


def fingerprint(text: bytes, k: int = 3) -> int:
    """64-bit SimHash over the word shingles of a text in UTF-8, as a signed number."""
    buf = np.frombuffer(text, np.uint8)
    cuts, counts, n, held = long_cuts(buf), np.zeros(64, np.int64), 0, []
    for a, b in zip(cuts, cuts[1:]):
        words = held + text[a:b].lower().split()
        n += _add(counts, words, k)
        held = words[max(0, len(words) - k + 1) :]
    if not n and held:  # fewer than k words
        n = _add(counts, held, len(held))
    bits = np.packbits(counts * 2 > n, bitorder="little") if n else np.zeros(8, np.uint8)
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffers(batch.column(1))
        raw = data.tobytes() if len(batch) == 1 else data
        out = np.empty(len(batch), np.int64)
        for lo, hi in blocks(off):
            for i in range(lo, hi):
                out[i] = fingerprint(bytes(raw[off[i] : off[i + 1]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["id", "tkey", "fp"])


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments of a fingerprint, packed two bits each."""
    a, b = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed embeddings, at most the Hamming distance of the fingerprints."""
    x = a.bitwiseXOR(b)
    odd = x.bitwiseAND(F.lit(_LOW))
    two = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_LOW)).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + F.bit_count(two) * 2


def _masks(free: int, parts: int, equal: int) -> list[tuple[int, int]]:
    """Split the free bits into parts; for each choice of equal parts, the bits fixed by it and those left free."""
    places = [i for i in range(0, 64, 2) if free >> i & 1]
    size = -(-len(places) // parts)
    group = [sum(3 << i for i in places[p * size : (p + 1) * size]) for p in range(parts)]
    return [(m := sum(group[p] for p in pick), free & ~m) for pick in combinations(range(parts), equal)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _cells(reps: DataFrame, choices: list[tuple[int, int]]) -> DataFrame:
    """A row for each fingerprint and choice of coordinates: the grid cell is those coordinates of the embedding."""
    keys = F.array(*[F.struct(F.lit(i).alias("pick"), embedding(F.col("fp")).bitwiseAND(F.lit(_signed(m))).alias("at")) for i, (m, _) in enumerate(choices)])
    return reps.select("fp", F.explode(keys).alias("cell")).select("fp", "cell.pick", "cell.at")


def _links(cells: DataFrame, on: list[str]) -> DataFrame:
    a, b = cells.alias("a"), cells.alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    near = (manhattan(embedding(x), embedding(y)) <= MAX_BITS) & (F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS)
    return a.join(b, same & (x < y) & near).select(x.alias("a"), y.alias("b"))


def fingerprint_links(reps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) at MAX_BITS or fewer differing bits.

    Fingerprints become points of 32 segment popcounts. If two points are within Manhattan distance 2, then of
    four blocks of coordinates two at least are equal; so each of the six pairs of blocks is a grid whose cells
    are joined with themselves, under the Manhattan bound and then the exact distance. Cells of more than
    cell_rows points are dealt out again by the coordinates still free, so no cell grows with the corpus.
    """
    full = (1 << 64) - 1
    choices = _masks(full, 4, 2)
    cells = _cells(reps, choices)
    crowded = written(cells.groupBy("pick", "at").count().where(F.col("count") > cell_rows).select("pick", "at"), "crowded")
    if crowded.isEmpty():
        return _links(cells, ["pick", "at"]).distinct()
    found = _links(cells.join(crowded, ["pick", "at"], "left_anti"), ["pick", "at"])
    rest = cells.join(crowded, ["pick", "at"], "left_semi")
    finer = []
    for i, (_, free) in enumerate(choices):
        for j, (m, _) in enumerate(_masks(free, 4, 2)):
            finer.append(F.struct(F.lit(i).alias("of"), F.lit(j).alias("sub"), embedding(F.col("fp")).bitwiseAND(F.lit(_signed(m))).alias("finer")))
    rest = rest.select("fp", "pick", "at", F.explode(F.array(*finer)).alias("f")).where("f.of = pick")
    rest = rest.select("fp", "pick", "at", "f.sub", "f.finer")
    return found.union(_links(rest, ["pick", "at", "sub", "finer"])).distinct()


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, tkey, fp) of all documents, and rows (fp, root, component_id) of the distinct fingerprints."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), row_key(F.col(text)).alias("tkey"))
    fps = written(rows.mapInArrow(_fingerprints, "id long, tkey long, fp long"), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "representatives")
    comp = connected_components(fingerprint_links(reps))
    nodes = reps.join(comp, reps.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    nodes = written(nodes, "nodes")
    drop(reps, comp)
    least = written(nodes.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    return fps, nodes.join(least, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate groups: one row (doc_id, fp, component_id) for each row of docs.

    fp is the SimHash of the lower-cased (A-Z) three-word shingles; rows link at two or fewer differing bits;
    component_id is the smallest id reachable. Null and empty texts have fingerprint zero and link like any
    other. Fewer than three words hash as one sequence. Rows link by their fingerprints alone: repeated ids keep
    a row each, which may be in different groups, and a row without an id is in its group like others; a group
    without any id has component null. Other columns are ignored.
    Copies collapse to their fingerprint first, so a group of copies is one node.
    """
    fps, label = _grouped(docs, doc_id, text)
    return fps.join(label, "fp", "left").select(F.col("id").alias("doc_id"), "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    g = simhash_groups(docs)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns of docs: that with the smallest id.

    Of rows that repeat this id with other texts in the group, the smallest hash of the text decides; equal rows
    are kept once. A group without any id keeps one row too.
    """
    fps, label = _grouped(docs, doc_id, text)
    first = F.min(F.struct(F.col("id").isNull(), "id", "tkey")).alias("first")
    least = fps.groupBy("fp").agg(first).join(label, "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = written(least.select("first.id", "first.tkey"), "kept")
    rows = docs.select(F.col(doc_id).cast("long").alias("own"), row_key(F.col(text)).alias("key"), packed_row(docs))
    return rows.join(keep, F.expr("own <=> id and key = tkey")).dropDuplicates(["own", "key"]).select("row.*")
