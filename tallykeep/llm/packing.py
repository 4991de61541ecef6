"""Packing of tokenised documents into sequences by length patterns (operator 4)."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BLOCK_BYTES, blocks, bound_batches, text_buffers, tidy, written

MAX_TOKENS = 1024
END_ID = 2
#: Pieces of one length are dealt into so many groups, so that a length that most pieces have is no one task's.
SALTS = 256
PATTERN_PIECES = 3
NNLS_STEPS = 400
#: Fixed value: the pattern by which byte-level tokenizers split a text before their merges.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Any character but ASCII and the letters up to U+024F, on whose classes all pattern engines agree.
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]")


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if the file is a byte-level one whose merges make its ids in order; else None."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(char[c] for c in t): i for t, i in vocab.items() if t not in special}
    return ranks if made == sorted(made) and len(set(made)) == len(made) == len(ranks) - 256 else None


class Encoder:
    """Ids of texts, the same as those of the tokenizer that the file describes.

    Texts of common characters are merged by tiktoken over the same vocabulary, which is several times faster
    and gives the same ids; all others, and texts that hold a special token's string, by the tokenizer itself.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        described = json.loads(spec)
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        ranks = _byte_ranks(described)
        self.fast = tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. Long texts are cut before a space that follows another character, where no word goes on."""
        parts = []
        for part in _cut(text):
            if self.fast is None or _OTHER.search(part) or any(s in part for s in self.special):
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_to_numpy(part, disallowed_special=())
            parts.append(np.asarray(ids, "<u4").tobytes())
        return b"".join(parts)


def _cut(text: str, size: int = BLOCK_BYTES // 2) -> Iterator[str]:
    lo = 0
    while len(text) - lo > size:
        found = re.compile(r"(?<=\S) ").search(text, lo + size)
        if not found:
            break
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:] if lo else text


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def _pieces(spec, end_id: int, most: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = _encoder(spec.value), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            _, off = text_buffers(texts)
            for lo, hi in blocks(off):
                rows: list[tuple] = []
                for i, text in enumerate(texts.slice(lo, hi - lo).to_pylist(), lo):
                    body = encoder.encode(text or "") + end
                    n = len(body) // 4
                    at, piece = 0, 0
                    while at < n:
                        size = min(n, (n - 1) % most + 1 if not at else most)
                        part = body[4 * at : 4 * (at + size)]
                        rows.append((i, piece, at, size, zlib.crc32(part), turn % SALTS, part))
                        at, piece, turn = at + size, piece + 1, turn + 1
                c = list(zip(*rows))
                cols = [ids.take(pa.array(c[0])), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:5]), pa.array(c[5], pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                if with_ids:
                    cols, names = [*cols, pa.array(c[6], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


# ---------------------------------------------------------------- the plan, over the histogram of lengths only


def patterns(lengths: np.ndarray, most: int, pieces: int = PATTERN_PIECES) -> np.ndarray:
    """All multisets of two or three of the lengths that fill a sequence exactly; rows are padded with zeros."""
    have = np.zeros(most + 1, bool)
    have[lengths[lengths < most]] = True
    own = np.flatnonzero(have)
    found = []
    if len(own):
        two = own[(2 * own >= most) & have[most - own]]
        found.append(np.stack([two, most - two, np.zeros_like(two)], 1))
        if pieces >= 3:
            for a in own[3 * own >= most]:
                b = own[(own <= a) & (2 * own >= most - a) & (most - a - own > 0)]
                b = b[have[most - a - b]]
                found.append(np.stack([np.full_like(b, a), b, most - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def nonnegative_fit(rows: np.ndarray, target: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring their lengths nearest to the histogram, by least squares.

    Accelerated projected gradient over the sparse pattern matrix; the gradient's scale is found by power iteration.
    """
    n = len(target)

    def lengths_of(x):
        got = np.zeros(n)
        for k in range(rows.shape[1]):
            got += np.bincount(rows[:, k], x, n)
        got[0] = 0
        return got

    def back(v):
        v = v.copy()
        v[0] = 0
        return v[rows].sum(1)

    v = target + 1.0
    v[0] = 0
    for _ in range(30):
        v = lengths_of(back(v / np.linalg.norm(v)))
    scale = 1.02 * np.linalg.norm(v)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(lengths_of(y) - target) / scale)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    return x


def plan(histogram: np.ndarray, most: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many of them), which use up histogram[length] pieces of each length exactly.

    Full pieces stand alone. Patterns of two or three lengths that fill a sequence are fitted to the histogram
    by non-negative least squares, rounded down to what there is; residual pieces are packed best-fit
    decreasing, all of a length at once.
    """
    left = histogram.astype(np.int64).copy()
    out = [((most,), int(left[most]))] if left[most] else []
    left[most] = 0
    rows = patterns(np.flatnonzero(left), most)
    if len(rows):
        fit = nonnegative_fit(rows, left.astype(float))
        for k in np.argsort(-fit, kind="stable"):
            if fit[k] < 0.5:
                break
            need = Counter(int(v) for v in rows[k] if v)
            n = min(int(fit[k] + 0.5), min(int(left[v]) // m for v, m in need.items()))
            if n > 0:
                out.append((tuple(int(v) for v in rows[k] if v), n))
                for v, m in need.items():
                    left[v] -= n * m
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(most + 1)]
    for size in range(most - 1, 0, -1):
        todo = int(left[size])
        while todo:
            space = next((s for s in range(size, most) if room[s]), most)
            base, n = room[space].pop() if space < most else ((), todo)
            each = min(space // size, todo)
            used = min(n, todo // each)
            if used < n and space < most:
                room[space].append((base, n - used))
            room[space - each * size].append((base + (size,) * each, used))
            todo -= used * each
    return out + [x for group in room for x in group]


class Slots:
    """Where the piece with some rank among those of its length goes."""

    def __init__(self, sequences: list[tuple[tuple[int, ...], int]], most: int):
        used = np.zeros(most + 1, np.int64)
        rows, base = [], 0
        for lengths, n in sequences:
            offset = 0
            for v in lengths:
                rows.append((v, used[v], base, offset))
                used[v] += n
                offset += v
            base += n
        self.total = base
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key, self.first, self.base, self.offset = table[:, 0] << 44 | table[:, 1], table[:, 1], table[:, 2], table[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        return self.base[at] + rank - self.first[at], self.offset[at]


def _assign(slots, before):
    """Ranks of the pieces of each (length, salt), which come sorted, and the slots they lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, first = slots.value, before.value
        last, seen = -1, 0
        for batch in batches:
            if not len(batch):
                continue
            length, salt = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "salt"))
            key = length * SALTS + salt
            new = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(new)
            rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
            if key[0] == last:
                rank[: starts[1] if len(starts) > 1 else len(key)] += seen
            last, seen = int(key[-1]), int(rank[-1]) + 1
            sequence, offset = s.find(length, rank + first[length, salt])
            keep = [c for c in batch.schema.names if c != "salt"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most max_tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with with_ids, the
    ids themselves (little-endian 32-bit). A document is its ids and end_id; only longer ones are cut, into
    pieces of max_tokens of which the first may be shorter.

    Texts are tokenised once, into a small table of pieces in the shared folder. Only the histogram of lengths
    (max_tokens numbers, and SALTS times as many for ranks) comes to the driver, where the plan is made: each
    pattern of lengths and its repeats stand for as many sequences. The plan is sent to the tasks, whose size
    depends on max_tokens alone, and each piece finds its slot by its rank among the pieces of its length.

    Null and empty texts are the end id alone. Rows without an id and repeated ids are packed row by row. No
    rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int" + ", ids binary" * with_ids
    made = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(spec, end_id, max_tokens, with_ids), schema)
    pieces = written(made, "pieces")
    count = np.zeros((max_tokens + 1, SALTS), np.int64)
    with tidy(spark):
        for length, salt, n in pieces.groupBy("length", "salt").count().toPandas().itertuples(index=False):
            count[length, salt] = n
    sequences = plan(count.sum(1), max_tokens)
    slots = spark.sparkContext.broadcast(Slots(sequences, max_tokens))
    before = spark.sparkContext.broadcast(np.cumsum(count, 1) - count)
    dealt = pieces.repartition("length", "salt").sortWithinPartitions("length", "salt", "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_assign(slots, before), schema.replace(", salt int", "") + ", sequence_id long, offset long")
