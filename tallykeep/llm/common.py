"""Helpers shared by the corpus operators: shared tables, Arrow buffers and vectorised word hashing."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in blocks of about so many bytes, which bounds the memory of a Python worker.
BLOCK_BYTES = 1 << 19

_serial = itertools.count()
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_GRAM_BASES = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset and the session runs in this one process, a folder of our own. On a cluster no folder
    of this machine would do, so it raises.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="tallykeep-")
        spark.sparkContext.setCheckpointDir(got)
    top = f"{got.rstrip('/')}/tallykeep-{spark.sparkContext.applicationId}"
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(_forget, spark, top)
    return top


_cleaned: set[str] = set()


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, through Hadoop's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, top: str) -> None:
    try:
        delete_path(spark, top)
    except Exception:  # the session has ended before us
        pass


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{next(_serial)}-{uuid.uuid4().hex[:8]}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as each run ends, instead of whenever the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    with tidy(spark):
        df.write.parquet(path)
    got = spark.read.schema(schema).parquet(path)
    _tables[got] = path
    return got


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of written() that nothing reads any more: all made from them has been written itself.

    Any other DataFrame is left alone.
    """
    for t in tables:
        path = None if t is None else _tables.pop(t, None)
        if path is not None:
            delete_path(t.sparkSession, path)


def is_empty(df: DataFrame) -> bool:
    with tidy(df.sparkSession):
        return df.isEmpty()


def give_back(spark: SparkSession) -> None:
    """Let the executors' JVMs return the heap that earlier work has left to them and doesn't use any more.

    A heap grows with garbage and only shrinks after a full collection. An executor's memory is shared with its
    Python workers, so over several operators in one session what each of them needed at its peak adds up.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let Arrow batches hold at most so many rows and bytes, whatever the length of texts: it bounds what both the
    JVM and the Python workers hold at once. Smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None) or "-1"
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed_row(df: DataFrame) -> Column:
    """All columns of df in one struct, so that the names of helper columns can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def words_of(text: str) -> str:
    """SQL for the words of a text column: runs of bytes other than the six ASCII white-space characters."""
    return f"filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"


def row_key(text: Column) -> Column:
    """A second key beside the id: rows that repeat an id with other text stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


# ---------------------------------------------------------------- Arrow buffers


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about size bytes, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_pow: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64; tables grow by doubling."""
    size = max(1024, 1 << max(0, n - 1).bit_length())
    for (b, s), t in _pow.items():
        if b == int(base) and s >= n:
            return t[:n]
    t = np.full(size, base, np.uint64)
    t[0] = 1
    t = np.multiply.accumulate(t)
    for k in [k for k in _pow if k[0] == int(base)]:
        del _pow[k]
    _pow[int(base), size] = t
    return t[:n]


def inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 2**64))


def _span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of each span of bytes; spans are in order and don't overlap."""
    size = ends - starts
    first = np.cumsum(size) - size
    rel = np.arange(int(size.sum())) - np.repeat(first, size)
    at = rel + np.repeat(starts, size)
    value = _BYTE_VALUES[which][buf[at]] * powers(_BASES[which], int(size.max()) if len(size) else 1)[rel]
    total = np.add.reduceat(value, first) if len(size) else np.zeros(0, np.uint64)
    return mix64(total + size.astype(np.uint64))


def split_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and for each text the index of its first word (n + 1). off starts at 0."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[buf]
    edge = np.empty(len(buf), bool)
    edge[0], edge[1:] = True, space[:-1]
    edge[off[:-1][off[:-1] < len(buf)]] = True
    starts = np.flatnonzero(edge & ~space)
    edge[-1], edge[:-1] = True, space[1:]
    edge[off[1:][off[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge & ~space) + 1
    return starts, ends, np.searchsorted(starts, off)


def long_cuts(buf: np.ndarray, size: int = BLOCK_BYTES) -> list[int]:
    """Places after white space, at most about size bytes apart, where a long text can be cut without cutting a word."""
    cuts, at = [0], 0
    while len(buf) - at > size:
        to = at + size
        while True:
            found = np.flatnonzero(_SPACE[buf[to : to + 65536]])
            if len(found):
                to += int(found[0]) + 1
                break
            to += 65536
            if to >= len(buf):
                to = len(buf)
                break
        if to >= len(buf):
            break
        cuts.append(to)
        at = to
    return [*cuts, len(buf)]


def word_hashes(buf: np.ndarray, off: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block of texts, and for each text the index of its first word (n + 1)."""
    base = off[0]
    buf, off = buf[base : off[-1]], off - base
    if len(off) == 2 and len(buf) > 2 * BLOCK_BYTES:
        cuts = long_cuts(buf)
        parts = [word_hashes(buf[a:b], np.array([0, b - a]), which)[0] for a, b in zip(cuts, cuts[1:])]
        got = np.concatenate(parts)
        return got, np.array([0, len(got)])
    starts, ends, first = split_words(buf, off)
    return _span_hashes(buf, starts, ends, which), first


def gram_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; len(words) - k + 1 of them."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    base = _GRAM_BASES[which]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, n), dtype=np.uint64)])
    return mix64((total[k:] - total[:-k]) * powers(inverse(base), n - k + 1))


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the runs words[start:end]; equal runs have equal hashes wherever they stand."""
    base = _GRAM_BASES[which]
    n = len(words)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, n), dtype=np.uint64)])
    got = (total[ends] - total[starts]) * powers(inverse(base), n + 1)[starts]
    return mix64(got + (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each run of w neighbours of x the index of the smallest, the leftmost of equals; len(x) - w + 1 of them."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(x)), 1
    while span * 2 <= w:
        a, b = at[:-span], at[span:]
        at = np.where(x[b] < x[a], b, a)
        span *= 2
    if span < w:
        a, b = at[:n], at[w - span : w - span + n]
        return np.where(x[b] < x[a], b, a)
    return at[:n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
