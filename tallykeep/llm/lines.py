"""Line deduplication by aligning overlapping documents (operator 9)."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, give_back, packed_row, row_key, text_buffers, tidy, written

#: Weight, in bits, that makes an overlap of shared lines: that of one line in a hundredth of all documents.
RARE_BITS = math.log2(100)
#: Bytes of a line that weigh one bit, however frequent it is: 67 bytes together are an overlap.
BIT_BYTES = 10
NO_ID = np.iinfo(np.int64).max


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that isn't blank: number among those, place among all lines, hash, bytes; and how many there are."""
    names = ["id", "tkey", "ordinal", "place", "line", "size", "all"]
    for batch in batches:
        data, off = text_buffers(batch.column(2))
        rows, at = [], []
        for i in range(len(batch)):
            n = 0
            for place, line in enumerate(data[off[i] : off[i + 1]].tobytes().split(b"\n")):
                if bare := line.strip():
                    rows.append((n, place, xxhash.xxh64_intdigest(line), len(bare)))
                    at.append(i)
                    n += 1
            rows[len(rows) - n :] = [(*r, n) for r in rows[len(rows) - n :]]
            if len(rows) > 1 << 16 or (i + 1 == len(batch) and rows):
                c = list(zip(*rows))
                take = pa.array(at)
                cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32())]
                cols += [pa.array(np.array(c[2], np.uint64).view(np.int64)), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names)
                rows, at = [], []


def patience_matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of equal items that a patience diff aligns, in order.

    Equal beginnings and ends are matched; between them, items that stand once on each side are the anchors, of
    which the longest increasing run is kept; the stretches between anchors are treated alike.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if once_b[x] == 1}
        pairs = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and x in where]
        tails: list[int] = []
        tops: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            n = bisect_left(tails, j)
            back.append(tops[n - 1] if n else -1)
            tails[n : n + 1], tops[n : n + 1] = [j], [k]
        chain, k = [], tops[-1] if tops else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        i0, j0 = a0, b0
        if chain:
            for i, j in reversed(chain):
                todo.append((i0, i, j0, j))
                out.append((i, j))
                i0, j0 = i + 1, j + 1
            todo.append((i0, a1, j0, b1))
    return sorted(out)


def common_blocks(a: list[tuple], b: list[tuple], bits: float) -> list[int]:
    """Items of b in aligned blocks that are rare enough; items are (ordinal, line, rarity).

    A block is a run of matches whose ordinals go on by one on both sides.
    """
    out, block, total, last = [], [], 0.0, None
    for i, j in [*patience_matches([x[1] for x in a], [x[1] for x in b]), (None, None)]:
        at = (a[i][0], b[j][0]) if i is not None else None
        if last is None or at != (last[0] + 1, last[1] + 1):
            if total >= bits:
                out += block
            block, total = [], 0.0
        if at:
            block.append(j)
            total += b[j][2]
        last = at
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the later text's lines in all blocks that the two have in common."""
    for batch in batches:
        for lo in range(0, len(batch), 64):
            part, gone = batch.slice(lo, 64), []
            for early, late in zip(part.column(2), part.column(3)):
                a, b = ([(x["ordinal"], x["line"], 0.0) for x in s.as_py()] for s in (early, late))
                place = [x["place"].as_py() for x in late]
                gone.append([place[j] for j in common_blocks(a, b, 0.0)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.list_(pa.int32()))], ["id", "tkey", "gone"])


def _without(text: str | None, gone) -> str | None:
    """The text without the lines at the given places; blank lines after a deleted one go with it."""
    if text is None or gone is None or not len(gone):
        return text
    drop, kept, last = set(map(int, gone)), [], False
    for i, line in enumerate(text.split("\n")):
        if line.strip():
            last = i in drop
        if not last:
            kept.append(line)
    return "\n".join(kept) if any(x.strip() for x in kept) else ""


def _without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([_without(t, g) for t, g in zip(text, gone)], dtype=object)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare_bits: float = RARE_BITS) -> DataFrame:
    """Delete from every document the blocks of lines that it shares with an earlier one (a smaller id).

    The columns of docs, text without the deleted lines, and n_lines, n_removed (lines that aren't blank) and
    n_partners. The first document of each line is its owner. A document overlaps an earlier one if the lines
    whose owner that one is weigh rare_bits together. A line in d of n families weighs log2(n / d) bits, and as
    much as an overlap alone if d is one or two; a family is a document with those that have half of their lines
    or more from it, so near copies count once. However frequent, a line weighs at least a bit for BIT_BYTES of
    its bytes, so a long line or passage overlaps alone, at any size of the table; short boilerplate that stands
    alone stays. The two are aligned by patience diff over their shared lines, and all aligned blocks go from
    the later one. What is deleted stands in the line's owner, where nothing earlier can delete it. Each line
    leads to one owner, so the pairs are at most as many as lines and no line is capped.

    Null and empty texts have no lines. A text of which nothing is left becomes empty. Rows that repeat an id
    are not earlier than one another; a row without an id comes after all others. Lines are compared by 64-bit
    hashes, byte for byte. An input column named like an added one is replaced.
    """
    bound_batches(docs.sparkSession)
    give_back(docs.sparkSession)
    added = ["n_lines", "n_removed", "n_partners"]
    docs = docs.drop(*added)
    keyed = docs.select(packed_row(docs), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), row_key(F.col(text)).alias("tkey"))
    lines = keyed.select("id", "tkey", F.col("row")[text].alias("text")).mapInArrow(_lines, "id long, tkey long, ordinal int, place int, line long, size long, all int")
    with tidy(docs.sparkSession):
        total = math.log2(max(2, docs.count()))
    stats = lines.groupBy("line").agg(F.min(F.struct("id", "tkey")).alias("owner"), F.max("id").alias("last")).where("owner.id < last")
    stats = written(stats.select("line", "owner"), "lines")  # so that the join can split a hot line
    shared = written(lines.join(stats, "line").select("id", "tkey", "ordinal", "place", "line", "size", "all", "owner"), "shared")

    drop(stats)
    own = written(shared.groupBy("id", "tkey", "owner", "line").agg(F.count_distinct("ordinal").alias("k"), F.max("size").alias("size"), F.max("all").alias("all")), "own")
    main = own.groupBy("id", "tkey", "owner").agg(F.sum("k").alias("k"), F.max("all").alias("all")).groupBy("id", "tkey")
    main = main.agg(F.max(F.struct("k", "owner")).alias("most"), F.max("all").alias("all"))
    family = main.select("id", "tkey", F.when(F.col("most.k") * 2 >= F.col("all"), F.col("most.owner")).otherwise(F.struct("id", "tkey")).alias("family"))
    d = own.join(family, ["id", "tkey"]).select("line", "family").distinct().groupBy("line").agg(F.count("*").alias("n"))
    rarity = F.when(F.col("n") <= 2, F.lit(max(rare_bits, total))).otherwise(F.greatest(F.lit(0.0), F.lit(total) - F.log2("n")))
    weights = written(d.select("line", rarity.alias("rarity")), "weights")  # to split a hot line here too

    weight = F.greatest(F.col("rarity"), F.col("size") / F.lit(BIT_BYTES))
    pairs = own.where("owner.id < id").join(weights, "line").groupBy("id", "tkey", "owner").agg(F.sum(weight).alias("bits")).where(F.col("bits") >= rare_bits)
    pairs = written(pairs.select("id", "tkey", F.col("owner.id").alias("id0"), F.col("owner.tkey").alias("tkey0")), "pairs")
    drop(own, weights)
    item = F.struct("ordinal", "place", "line")
    texts = shared.dropDuplicates(["id", "tkey", "ordinal"]).groupBy("id", "tkey").agg(F.sort_array(F.collect_list(item)).alias("late"))
    texts = written(texts, "sequences")
    drop(shared)
    give_back(docs.sparkSession)
    early = texts.select(F.col("id").alias("id0"), F.col("tkey").alias("tkey0"), F.col("late").alias("early"))
    both = pairs.join(texts, ["id", "tkey"]).join(early, ["id0", "tkey0"]).select("id", "tkey", "early", "late")
    gone = both.mapInArrow(_align, "id long, tkey long, gone array<int>").where("size(gone) > 0")
    gone = gone.groupBy("id", "tkey").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("_gone"), F.count("*").alias("n_partners"))
    gone = written(gone, "gone")
    drop(pairs, texts)
    give_back(docs.sparkSession)  # what is left to do moves the texts
    out = keyed.join(gone, ["id", "tkey"], "left")
    whole = F.col("row")[text]
    n_lines = F.regexp_count(F.coalesce(whole, F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*"))  # no string for each line
    without = F.pandas_udf(_without_lines, "string").asNondeterministic()  # else a filter on the text runs it a second time
    new = without(whole, F.col("_gone"))
    return out.select(
        *[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"),
    )


def lines_query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", "n_partners", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
