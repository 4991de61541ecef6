"""Document fingerprints that tell how far two versions differ: invertible Bloom lookup tables (operator 7)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, _span_hashes, bound_batches, mix64, range_hashes, shuffle_partitions, split_words

#: Cells of a fingerprint, in three parts; one hash function for each.
CELLS = 30
#: A paragraph ends with its line, or after a word whose hash is divisible by this.
BREAK = 16
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
_CHECK = np.uint64(0x082EFA98EC4E6C89)
_LEAST = np.iinfo(np.int64).min


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paragraph digests of each text: (number of the text, digest), in order.

    White space separates words and doesn't count otherwise; paragraphs end at line ends and at content-defined
    words, so that a change touches few of them however long the lines are.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, first = split_words(buf, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = _span_hashes(buf, starts, ends, 0)
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    stop = words % np.uint64(BREAK) == 0
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    stop[first[1:][first[1:] > 0] - 1] = True
    to = np.flatnonzero(stop) + 1
    since = np.concatenate([[0], to[:-1]])
    digest = range_hashes(words, since, to)
    text = np.searchsorted(first, since, "right") - 1
    order = np.lexsort((digest, text))
    text, digest = text[order], digest[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])])
    return text[new], digest[new]


class Sketches:
    """Tables of cells (count, xor of digests, xor of checks), one for each text of a block."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int32)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def places(self, text: np.ndarray, digest: np.ndarray) -> Iterator[np.ndarray]:
        third = self.cells // 3
        for j, seed in enumerate(_SEEDS):
            yield text * self.cells + j * third + (mix64(digest ^ seed) % np.uint64(third)).astype(np.int64)

    def toggle(self, text: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> None:
        check = mix64(digest ^ _CHECK) >> np.uint64(32)
        for at in self.places(text, digest):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def strings(self) -> list[str]:
        row = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        t = np.zeros(self.n * self.cells, row)
        t["count"], t["key"], t["check"] = self.count, self.key, self.check
        raw, size = t.tobytes(), self.cells * row.itemsize
        return [base64.b64encode(raw[i * size : (i + 1) * size]).decode() for i in range(self.n)]


def subtract(a: Sketches, i: np.ndarray, b: Sketches, j: np.ndarray) -> Sketches:
    """For each pair the cells of a[i] less those of b[j]."""
    out = Sketches(len(i), a.cells)
    x, y = (s.reshape(-1, a.cells) for s in (a.count, b.count))
    out.count = (x[i] - y[j]).ravel()
    for name in ("key", "check"):
        x, y = getattr(a, name).reshape(-1, a.cells), getattr(b, name).reshape(-1, a.cells)
        setattr(out, name, (x[i] ^ y[j]).ravel())
    return out


def peel(d: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recover what the pairs differ in: (pair, digest, sign), and which pairs were recovered wholly.

    All pairs are peeled at once: every round takes the digests of cells that hold just one.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        one = np.flatnonzero(np.abs(d.count) == 1)
        one = one[(mix64(d.key[one] ^ _CHECK) >> np.uint64(32)) == d.check[one]]
        if not len(one):
            break
        pair, digest, sign = one // d.cells, d.key[one], d.count[one]
        order = np.lexsort((digest, pair))
        pair, digest, sign = pair[order], digest[order], sign[order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (digest[1:] != digest[:-1])])
        pair, digest, sign = pair[new], digest[new], sign[new]
        d.toggle(pair, digest, -sign)
        found.append((pair, digest, sign))
        if len(found) > 4 * d.cells:
            break
    rest = ((d.count != 0) | (d.key != 0) | (d.check != 0)).reshape(-1, d.cells).any(1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), ~rest
    return *(np.concatenate(x) for x in zip(*found)), ~rest


def sketch(text: np.ndarray, digest: np.ndarray, n: int, cells: int = CELLS) -> Sketches:
    s = Sketches(n, cells)
    s.toggle(text, digest, 1)
    return s


def differences(left: tuple, i: np.ndarray, right: tuple, j: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """How many paragraph digests each pair differs in; left and right are (text, digest, number of texts).

    Where peeling fails the pair is tried again with tables of twice as many cells.
    """
    out = np.full(len(i), -1, np.int64)
    todo = np.arange(len(i))
    while len(todo):
        d = subtract(_some(*left, i[todo], cells), np.arange(len(todo)), _some(*right, j[todo], cells), np.arange(len(todo)))
        pair, _, _, whole = peel(d)
        n = np.bincount(pair, minlength=len(todo))
        out[todo[whole]] = n[whole]
        todo, cells = todo[~whole], cells * 2
        if cells > CELLS << 28:
            raise RuntimeError("a difference can't be peeled")
    return out


def _some(text: np.ndarray, digest: np.ndarray, n: int, pick: np.ndarray, cells: int) -> Sketches:
    """Sketches of the picked texts."""
    first = np.searchsorted(text, np.arange(n + 1))
    size = (first[1:] - first[:-1])[pick]
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first[:-1][pick], size)
    return sketch(np.repeat(np.arange(len(pick)), size), digest[at], len(pick), cells)


def likeness(a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Shared paragraphs out of all: 1 for equal sets, two empty ones included."""
    union = (a + b + differ) / 2
    return np.where(union > 0, 1 - differ / np.maximum(union, 1), 1.0)


def _block(ids: list, texts: list[str]) -> pa.RecordBatch:
    """texts has one more than ids: what follows the last."""
    n, edited = len(ids), []
    for t, follow in zip(texts, texts[1:]):
        k = len(t) // 3
        edited.append(((t[: len(t) - k] + follow[:k]) if k else t).encode())
    own, new = [t.encode() for t in texts], edited
    left, right = (*paragraph_digests(own), n + 1), (*paragraph_digests(new), n)
    prints, new_prints = sketch(*left), sketch(*right)
    size, new_size = np.bincount(left[0], minlength=n + 1), np.bincount(right[0], minlength=n)
    at = np.arange(n)
    near_edited = likeness(size[:n], new_size, differences(left, at, right, at))
    near_next = likeness(size[:n], size[1:], differences(left, at, left, at + 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in new], pa.string()),
            pa.array(prints.strings()[:n], pa.string()),
            pa.array(new_prints.strings(), pa.string()),
            pa.array(near_edited, pa.float64()),
            pa.array(near_next, pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and then in order; the first extra row ends a bucket."""
    ids, texts, size, bucket, over = [], [], 0, None, False
    for batch in batches:
        for lo in range(0, len(batch), 256):
            cols = [c.to_pylist() for c in batch.slice(lo, 256).columns]
            for b, extra, doc, text in zip(*cols):
                if b != bucket:
                    assert not texts, "a bucket without its end"
                    bucket, over = b, False
                if over:
                    continue
                text = text or ""
                if texts and (extra or size > BLOCK_BYTES):
                    yield _block(ids, [*texts, text])
                    ids, texts, size = [], [], 0
                if extra:
                    over = True
                else:
                    ids.append(doc)
                    texts.append(text)
                    size += len(text)
    assert not texts, "a bucket without its end"


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited version, and how near they and the next document are.

    The next document is that with the next smaller id, and the largest after the last; the edited text has its
    last third replaced by the beginning of the next. Fingerprints are invertible Bloom lookup tables of the
    texts' paragraph digests, in base64. Two of them are subtracted and peeled, which recovers the digests that
    differ, with larger tables where that fails; likeness is the share of common paragraphs.

    Documents are dealt into ranges of ids; only the ranges' bounds, as many as shuffle partitions, come to the
    driver. The first document of a range is also dealt to the range before as its end, so texts move once.

    Null and empty texts have no paragraphs: they are alike, and wholly unlike others. A row without an id comes
    last. Rows that repeat an id come in the order of their texts. One row alone is its own next. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)).alias("at"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = shuffle_partitions(spark)
    bounds = np.unique(np.array(rows.select("at").approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n), float)).astype(np.int64) if n > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def bucket(at: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, at.to_numpy(), "right")).astype(np.int32))

    heads = sorted((r[0], r[1]) for r in rows.select(bucket("at").alias("b"), "at").groupBy("b").agg(F.max("at")).collect())
    ends = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)] or [(0, 0)]
    ends = spark.createDataFrame(ends, "head long, b int")
    extra = rows.where(F.col("at").isin([h for _, h in heads])).join(F.broadcast(ends), F.col("at") == F.col("head"))
    both = rows.select(bucket("at").alias("b"), F.lit(0).alias("extra"), "at", "doc_id", "text").union(extra.select("b", F.lit(1), "at", "doc_id", "text"))
    dealt = both.repartition(n, "b").sortWithinPartitions("b", "extra", F.desc("at"), "text").select("b", "extra", "doc_id", "text")
    return dealt.mapInArrow(_follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
