"""Removal of repeated passages through one compressed FM-index for each shard (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOCK_BYTES,
    blocks,
    bound_batches,
    gram_hashes,
    long_cuts,
    range_hashes,
    row_key,
    shuffle_partitions,
    signed,
    sliding_argmin,
    text_buffers,
    word_hashes,
    written,
)
from .fm_index import FMIndex

NO_ID = np.iinfo(np.int64).max
#: Words of an anchor; a window of 50 words holds 31 of them, the smallest of which by hash leads the window to its shard.
ANCHOR_WORDS = 20
#: Words that one shard's index is planned for.
SHARD_WORDS = 1 << 19
#: Anchors with more than max(HOT_LEAST, segments / HOT_PART) different segments are hot; so there are HOT_PART at most.
HOT_LEAST, HOT_PART = 512, 100_000

_SEGMENT = "id long, tkey long, start int, n_win int, anchor long, c1 long, c2 long"


def _segments(wh: np.ndarray, first: np.ndarray, window: int, hot: np.ndarray | None):
    """Runs of windows that share their anchor: text number, start, number of windows, anchor, content hashes.

    With hot, only windows whose anchor is hot, each for itself, and led by its own hash instead.
    """
    n = len(wh) - window + 1
    if n <= 0:
        return None
    grams = gram_hashes(wh, ANCHOR_WORDS)
    least = sliding_argmin(grams, window - ANCHOR_WORDS + 1)
    text = np.searchsorted(first, np.arange(n), "right") - 1
    inside = np.arange(n) + window <= first[text + 1]
    if hot is None:
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, n))
    else:
        at = grams[least]
        inside &= hot[np.minimum(np.searchsorted(hot, at), len(hot) - 1)] == at
        starts, count = np.arange(n), np.ones(n, np.int64)
    keep = inside[starts]
    starts, count = starts[keep], count[keep]
    if not len(starts):
        return None
    ends = starts + count + window - 1
    c1, c2 = range_hashes(wh, starts, ends, 0), range_hashes(wh, starts, ends, 1)
    return text[starts], starts - first[text[starts]], count, grams[least[starts]] if hot is None else c1, c1, c2


def _segmenter(window: int, hot: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SEGMENT.split(", ")]
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in blocks(off):
                wh, first = word_hashes(data, off[lo : hi + 1])
                if (got := _segments(wh, first, window, hot)) is None:
                    continue
                text, start, count, anchor, c1, c2 = got
                yield pa.RecordBatch.from_arrays(
                    [ids[lo + text], keys[lo + text], start.astype(np.int32), count.astype(np.int32), *map(signed, (anchor, c1, c2))], names
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, off = text_buffers(batch.column(2))
        out = [pack.compress(data[a:b]) for a, b in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "tkey", "packed"])


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    for x in column:
        yield unpack.decompress(x.as_buffer())


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the runs of sizes[i] places from starts[i]."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)


def _extract(window: int):
    """The word hashes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            at = wanted.offsets.to_numpy()
            flat = wanted.values
            for i, text in enumerate(_unpacked(batch.column(0))):
                buf = np.frombuffer(text, np.uint8)
                wh, _ = word_hashes(buf, np.array([0, len(buf)]))
                part = flat.slice(at[i], at[i + 1] - at[i])
                start, count = (part.field(k).to_numpy().astype(np.int64) for k in ("start", "n_win"))
                sizes = count + window - 1
                words = wh[gather(start, sizes)]
                ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
                body = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays(
                    [part.field("anchor"), part.field("c1"), part.field("c2"), part.field("owner"), body.cast(pa.binary())], ["anchor", "c1", "c2", "owner", "words"]
                )

    return run


def _search(window: int):
    """One shard: index all its segments, stream them through, and report for each window the smallest owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got)
        data, off = text_buffers(t.column("words"))
        symbols, off = data[off[0] : off[-1]].view(np.uint64), (off - off[0]) // 8
        index = FMIndex(symbols, off, t.column("owner").to_numpy(), window)
        _, owner = index.matching_statistics(symbols, off)
        count = np.diff(off) - window + 1
        ends = np.concatenate([[0], np.cumsum(count)])
        values = owner[gather(off[:-1], count)]
        c1, c2 = t.column("c1").combine_chunks(), t.column("c2").combine_chunks()
        for lo in range(0, len(count), 4096):
            hi = min(lo + 4096, len(count))
            owners = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(values[ends[lo] : ends[hi]]))
            yield pa.RecordBatch.from_arrays([c1.slice(lo, hi - lo), c2.slice(lo, hi - lo), owners], ["c1", "c2", "owners"])

    return run


def _removal(window: int):
    """Kept text, number of words and removed spans of each text, from the starts of its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, rows, size = batch.column(2), [], 0
            lo = 0
            for i, text in enumerate(_unpacked(batch.column(1))):
                at = np.sort(np.array(starts[i].as_py() or [], np.int64))
                spans: list[tuple[int, int]] = []
                if len(at):
                    new = np.flatnonzero(np.concatenate([[True], np.diff(at) > window]))
                    spans = list(zip(at[new].tolist(), (at[np.append(new[1:], len(at)) - 1] + window).tolist()))
                buf, kept, n = np.frombuffer(text, np.uint8), [], 0
                cuts = long_cuts(buf)
                for a, b in zip(cuts, cuts[1:]):
                    words = text[a:b].split()
                    if spans:
                        mask = np.ones(len(words), bool)
                        for s, e in spans:
                            mask[max(0, s - n) : max(0, e - n)] = False
                        part = b" ".join([w for w, m in zip(words, mask.tolist()) if m])
                    else:
                        part = b" ".join(words)
                    if part:
                        kept.append(part)
                    n += len(words)
                rows.append((b" ".join(kept), n, [{"start": s, "end": e} for s, e in spans]))
                size += len(text)
                if size > 4 * BLOCK_BYTES or i + 1 == len(batch):
                    yield _rows(batch.column(0).slice(lo, i + 1 - lo), rows)
                    lo, rows, size = i + 1, [], 0

    return run


def _rows(ids: pa.Array, rows: list) -> pa.RecordBatch:
    spans = pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    texts = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, texts, pa.array([r[1] for r in rows], pa.int64()), spans], ["doc_id", "kept_text", "n_words", "removed"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """Remove every word covered by a window of consecutive words that also starts in a document with a smaller id.

    One row (doc_id, kept_text, n_words, removed) for each row of docs; removed are spans [start, end) of word
    numbers, kept_text the other words joined by one space. Windows are judged on the input.

    Every window is led to a shard by its anchor, the smallest hash of its runs of ANCHOR_WORDS words; equal
    windows have equal anchors. Neighbouring windows with one anchor form a segment. Segments whose anchor
    stands in one document only can't repeat and go; equal segments collapse to one with the smallest id (so a
    group of copies is one segment); an anchor with very many different segments is dealt out by single windows.
    Each shard builds an FM-index of its segments, and their matching statistics against it give each window the
    smallest document that has it. That answer is joined back to all segments with that content.

    Null and empty texts have no words. Texts shorter than the window are kept. Rows with the same id never
    repeat one another, whatever their texts; a row without an id comes after all others. Other columns are
    ignored. Words are compared by 64-bit hashes, segments by 128-bit ones.
    """
    if not ANCHOR_WORDS <= window < 256:
        raise ValueError(f"window must be {ANCHOR_WORDS} to 255")
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), row_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    all_segments = rows.mapInArrow(_segmenter(window, None), _SEGMENT)
    shared = all_segments.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    shared = written(shared.select("anchor"), "shared")  # a table of its own, so that the join can split a hot anchor
    segments = written(all_segments.join(shared, "anchor", "left_semi").select("id", "tkey", "start", "n_win", "anchor", "c1", "c2"), "segments")

    first = F.min(F.struct("id", "tkey", "start")).alias("first")
    contents = written(segments.groupBy("anchor", "c1", "c2", "n_win").agg(first), "contents")
    total = contents.count()
    limit = max(HOT_LEAST, total // HOT_PART)
    hot = np.array([r[0] for r in contents.groupBy("anchor").count().where(F.col("count") > limit).select("anchor").collect()], np.int64).view(np.uint64)
    if len(hot):
        hot.sort()
        few = [int(x) for x in signed(hot)]
        cold = spark.createDataFrame([(x,) for x in few], "anchor long")
        single = rows.mapInArrow(_segmenter(window, hot), _SEGMENT)
        again = single.groupBy("c1", "c2").agg(first, F.max("id").alias("last")).where("first.id < last")
        again = written(again.select(F.col("c1").alias("anchor"), "c1", "c2", F.lit(1).alias("n_win"), "first"), "windows")
        single = single.join(again.select("c1", "c2"), ["c1", "c2"], "left_semi").select(*segments.columns)
        segments = segments.join(F.broadcast(cold), "anchor", "left_anti").select(*segments.columns).union(single)
        contents = contents.join(F.broadcast(cold), "anchor", "left_anti").select(*contents.columns).union(again)

    n_words = contents.agg(F.sum(F.col("n_win") + window - 1)).first()[0] or 0
    want = F.collect_list(F.struct("first.start", "n_win", "anchor", "c1", "c2", F.col("first.id").alias("owner")))
    wanted = contents.groupBy(F.col("first.id").alias("id"), F.col("first.tkey").alias("tkey")).agg(want.alias("wanted"))
    packed = rows.mapInArrow(_pack, "id long, tkey long, packed binary")
    words = packed.join(wanted, ["id", "tkey"]).dropDuplicates(["id", "tkey"]).select("packed", "wanted")
    words = words.mapInArrow(_extract(window), "anchor long, c1 long, c2 long, owner long, words binary")
    shards = max(shuffle_partitions(spark), -(-n_words // SHARD_WORDS))
    found = words.repartition(shards, "anchor").mapInArrow(_search(window), "c1 long, c2 long, owners array<long>")

    repeated = "transform(filter(sequence(0, n_win - 1), i -> owners[i] < id), i -> start + i)"
    hits = segments.join(found, ["c1", "c2"]).select("id", "tkey", F.expr(repeated).alias("at")).where("size(at) > 0")
    hits = hits.distinct().groupBy("id", "tkey").agg(F.flatten(F.collect_list("at")).alias("at"))
    out = packed.join(hits, ["id", "tkey"], "left").select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "packed", "at")
    return out.mapInArrow(_removal(window), "doc_id long, kept_text string, n_words long, removed array<struct<start:long,end:long>>")


def substring_query(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least USING (h) WHERE least.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(50) t(j)),
every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
