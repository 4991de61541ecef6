"""Language identification by string kernels (operator 5)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, bound_batches, drop, packed_row, tidy, written

#: Bounds of what the model is fitted on: labelled rows of all languages together, and landmarks of all together.
TRAIN_ROWS, LANDMARKS = 8192, 256
RIDGE = 1e-4
#: Labelled rows from which the lowest score among them counts in full.
FLOOR_ROWS = 1000
#: Buckets that grams of one, two and three symbols are hashed to.
_BITS = (14, 17, 18)
_SIZES = tuple(1 << b for b in _BITS)
_FEATURES = sum(_SIZES)
#: Texts scored at once, and columns of marks made floating point at once: they bound what a worker holds.
_TEXTS, _COLUMNS = 64, 1 << 14
_TIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def held_out(doc_id: str) -> Column:
    """Whether a row's id leaves it out of the fit."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@functools.cache
def symbols() -> np.ndarray:
    """A table from code point to symbol: a letter's own code point in lower case, 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def product(marks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """marks @ weights, whose marks are bytes that become floating point a few columns at a time."""
    out = np.zeros((len(marks), weights.shape[1]))
    for lo in range(0, len(weights), _COLUMNS):
        out += marks[:, lo : lo + _COLUMNS].astype(np.float32) @ weights[lo : lo + _COLUMNS].astype(np.float32)
    return out


class Grams:
    """The set of one- to three-symbol grams of a text, as marks in a table that is used again and again.

    Every letter is a symbol of its own, whatever the script, and a run of other characters is one gap; grams
    are hashed to buckets, so that alphabets of any size have room.
    """

    def __init__(self):
        self.table = symbols()
        self.marks = np.zeros(_FEATURES, bool)

    def mark(self, text: str) -> bool:
        """Mark the grams of a whole text; false if it has no letter."""
        self.marks[:] = False
        letters, tail = False, np.zeros(1, np.uint32)
        for lo in range(0, len(text), BLOCK_BYTES):
            s = self.table[np.frombuffer(text[lo : lo + BLOCK_BYTES].encode("utf-32-le", "surrogatepass"), "<u4")]
            letters = letters or bool(s.any())
            s = self._gaps(np.concatenate([tail, s]))
            self._add(s)
            tail = s[-2:]
        if letters:
            self._add(self._gaps(np.concatenate([tail, np.zeros(1, np.uint32)])))
        return letters

    @staticmethod
    def _gaps(s: np.ndarray) -> np.ndarray:
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def _add(self, s: np.ndarray) -> None:
        h, base = (s.astype(np.uint64) + np.uint64(1)) * _TIMES[0], 0
        for k, bits in enumerate(_BITS):
            if k:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _TIMES[k] + (s[k:].astype(np.uint64) + np.uint64(1)) * _TIMES[0]
            mixed = (h ^ (h >> np.uint64(31))) * _TIMES[1]
            self.marks[(mixed >> np.uint64(64 - bits)).astype(np.int64) + base] = True
            base += 1 << bits


class Model:
    """One-versus-rest ridge regression over Nyström features; weights are of the landmarks' grams.

    A text's kernel with a landmark is the number of grams that both have, divided by the root of the product of
    their numbers. The outputs are linear in these kernels: with fewer languages than landmarks, the landmarks'
    marks times the solution give one weight for each gram and language at once, else both factors stay apart.
    Batches of texts are scored by matrix products.
    """

    def __init__(self, languages: list[str], grams: np.ndarray, factors: list[np.ndarray], floors: np.ndarray | None = None):
        self.languages, self.grams, self.factors = languages, grams, factors
        self.floors = np.zeros(1) if floors is None else floors

    def floor(self, text: str | None) -> float:
        """The score that a text of this length needs."""
        return float(self.floors[min(len(text or "").bit_length(), len(self.floors) - 1)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        g = Grams()
        marks, size = np.zeros((len(texts), len(self.grams)), bool), np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t and g.mark(t):
                marks[i] = g.marks[self.grams]
                size[i] = np.count_nonzero(g.marks)
        out = product(marks, self.factors[0])
        for more in self.factors[1:]:
            out = out @ more
        out /= np.sqrt(np.maximum(size, 1))[:, None]
        score = np.where(size > 0, ((out.max(1) + 1) / 2).clip(0, 1), 0.0)
        return [self.languages[b] if s else "und" for b, s in zip(out.argmax(1), size)], score


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the landmarks, eight in a byte."""
    g = Grams()
    for batch in batches:
        out = [np.packbits(g.marks).tobytes() if g.mark(t or "") else None for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["lang", "marks"])


def _kernel_rows(landmarks):
    """Kernels of the training texts with all landmarks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, (grams, marks, norms) = Grams(), landmarks.value
        for batch in batches:
            for lo in range(0, len(batch), _TEXTS):
                have, x, size, bits = [], [], [], []
                for k, t in zip(batch.column(0).slice(lo, _TEXTS).to_pylist(), batch.column(1).slice(lo, _TEXTS).to_pylist()):
                    if g.mark(t or ""):
                        have.append(k)
                        x.append(g.marks[grams])
                        size.append(np.count_nonzero(g.marks))
                        bits.append(len(t).bit_length())
                if have:
                    k = product(np.array(x), marks.T) / (np.sqrt(size)[:, None] * norms)
                    yield pa.RecordBatch.from_arrays([pa.array(have), pa.array([r.astype("<f8").tobytes() for r in k], pa.binary()), pa.array(bits, pa.int32())], ["lang", "row", "bits"])

    return run


def score_floors(length: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The lowest score of rows of each bit length of the text or a longer one.

    Short texts score low, so each length has its own floor. Where fewer than FLOOR_ROWS rows speak, it is that
    share of the way from 0.5, the score of a text that has no gram in common with any landmark.
    """
    floors = []
    for b in range(int(length.max(initial=0)) + 1):
        have = score[length >= b]
        low = float(have.min())
        floors.append(min(low, 0.5 + (low - 0.5) * min(1.0, len(have) / FLOOR_ROWS)))
    return np.array(floors or [0.0])


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """About TRAIN_ROWS distinct labelled rows (lang, text, key) that are not held out, as many of each language.

    A language with a share of rows below that gives all of them. Only if there are more than TRAIN_ROWS
    languages, the most frequent have a row each. Rows are drawn by a hash of id and text, and equal ones count
    once, so that no repeated id or text fills the sample. Counts cover all rows.
    """
    usable = docs.where(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    usable = usable.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("key"))
    count = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_ROWS)
    rows = [tuple(r) for r in count.collect()]
    each = TRAIN_ROWS / max(1, len(rows))
    limits = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in rows], "_lang string, most double")
    drawn = usable.join(F.broadcast(limits), F.col("lang") == F.col("_lang"))  # at most TRAIN_ROWS languages
    drawn = drawn.where(F.pmod("key", F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.col("most"))
    return written(drawn.groupBy("lang", "key").agg(F.first("text").alias("text")), "sample")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit a model on documents that are not held out and have an id, a text and a language (training_rows).

    The LANDMARKS rows with the smallest hashes are landmarks, as many of each language. What comes to the
    driver is bounded by both numbers.
    """
    spark = docs.sparkSession
    sample = training_rows(docs, doc_id, text, lang)
    keys = sorted((r[0], r[1]) for r in sample.select("lang", "key").collect())
    languages = sorted({k for k, _ in keys})
    if not languages:
        return Model([], np.zeros(0, np.int64), [])
    turn, place = [], {}
    for k, key in keys:  # the languages take turns
        place[k] = place.get(k, -1) + 1
        turn.append((place[k], key))
    chosen = spark.createDataFrame([(key,) for _, key in sorted(turn)[:LANDMARKS]], "_key long")
    few = sample.join(F.broadcast(chosen), F.col("key") == F.col("_key")).select("lang", "text")
    packed = [np.frombuffer(r[1], np.uint8) for r in few.mapInArrow(_packed, "lang string, marks binary").where("marks is not null").orderBy("lang", "marks").collect()]
    if not packed:
        return Model([], np.zeros(0, np.int64), [])
    grams = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(packed)))
    marks = np.zeros((len(packed), len(grams)), bool)
    for row, p in zip(marks, packed):
        row[:] = np.unpackbits(p)[grams]
    norms = np.sqrt(np.count_nonzero(marks, axis=1))
    inner = product(marks, marks.T) / np.outer(norms, norms)

    shared = spark.sparkContext.broadcast((grams, marks, norms))
    kernel = sample.select("lang", "text").mapInArrow(_kernel_rows(shared), "lang string, row binary, bits int").collect()
    shared.unpersist()
    drop(sample)
    k = np.empty((len(kernel), len(norms)))
    for row, r in zip(k, kernel):
        row[:] = np.frombuffer(r[1], "<f8")
    at = {c: i for i, c in enumerate(languages)}
    of, bits = np.array([at[r[0]] for r in kernel]), np.array([r[2] for r in kernel], np.int64)
    del kernel
    right = np.zeros((len(norms), len(languages)))  # k.T times a matrix of 1 for the own language and -1 for others
    np.add.at(right.T, of, 2 * k)
    right -= k.sum(0)[:, None]
    left = k.T @ k / len(k) + RIDGE * inner + 1e-9 * np.eye(len(inner))
    solved = np.linalg.solve(left, right / len(k))
    own = solved / norms[:, None]
    factors = [product(marks.T, own).astype(np.float32)] if len(languages) <= len(norms) else [marks.T, own]
    out = k @ solved
    ok = out.argmax(1) == of
    floors = score_floors(bits[ok], ((out.max(1) + 1) / 2).clip(0, 1)[ok])
    return Model(languages, grams, factors, floors)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out, score = [], []
            texts = batch.column(2)
            for lo in range(0, len(batch), _TEXTS):
                a, b = m.predict(texts.slice(lo, _TEXTS).to_pylist())
                out += a
                score.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out, lang_pred, score; a row for each row.

    Learns from rows that are not held out (train); predicts from the text alone. A null text, or one without a
    letter, is 'und' with score 0, as is everything where there is nothing to learn from. A row without an id is
    not held out and not learned from. The score is the winning output, from -1 to 1, brought to 0 to 1.
    Repeated rows get equal answers. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    with tidy(docs.sparkSession):
        model = docs.sparkSession.sparkContext.broadcast(train(docs, doc_id, text, lang))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _judge(model):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        for arr in texts:
            lang, ok = [], []
            for lo in range(0, len(arr), _TEXTS):
                part = arr.slice(lo, _TEXTS).to_pylist()
                a, b = m.predict(part)
                lang += a
                ok += [k != "und" and bool(x >= m.floor(t) - 1e-6) for k, x, t in zip(a, b, part)]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(ok, pa.bool_())], ["lang", "ok"])

    return run


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text is in a language that the model knows, with the columns of docs.

    A row goes if its text is null or has no letter, or if its score is lower than that of all held-in rows of
    its length or longer that are predicted as labelled (score_floors). A row without a language gets the
    predicted one. Rows are judged one by one, so repeats stay repeated and a missing id doesn't matter. Raises
    ValueError if docs has rows but none to learn from, as nothing could be judged; no rows give no rows.
    """
    bound_batches(docs.sparkSession)
    with tidy(docs.sparkSession):
        fitted = train(docs, doc_id, text, lang)
    if not fitted.languages and not docs.isEmpty():
        raise ValueError(f"no row with {doc_id}, {text} and {lang} to learn languages from")
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    judge = F.arrow_udf(_judge(model), "lang string, ok boolean", F.ArrowUDFType.SCALAR_ITER)
    got = docs.select(packed_row(docs), judge(F.col(text)).alias("got")).where("got.ok")
    own = lambda c: F.col("row")[c]
    return got.select(*[(F.coalesce(own(c), F.col("got.lang")) if c == lang else own(c)).alias(c) for c in docs.columns])
