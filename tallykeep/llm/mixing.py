"""Mixing to target weights by soft membership (operator 1)."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, _span_hashes, blocks, bound_batches, drop, long_cuts, packed_row, row_key, split_words, text_buffers, tidy, written

#: Bounds of what the classifier is fitted on: labelled documents of all domains, and words.
TRAIN_DOCS, WORDS = 9000, 2048
LEAST_DOCS = 5
TARGETS = {"good": 0.90, "poor": 0.09, "toxic": 0.01}
MAX_RATE = 8.0
STEPS, TOLERANCE = 60, 1e-3

_MARK = np.zeros(256, np.uint64)  # values of bytes that are neither letters nor digits
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _MARK[_b] = np.uint64((_b * 0x9E3779B97F4A7C15) % 2**64 | 1)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for each word, of the word in lower case and of its marks (0 if it has none); and the first word of each text."""
    buf, off = buf[off[0] : off[-1]], off - off[0]
    low = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    if len(off) == 2 and len(low) > 2 * BLOCK_BYTES:
        cuts = long_cuts(low)
        got = np.concatenate([tokens(low[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])])
        return got, np.array([0, len(got)])
    starts, ends, first = split_words(low, off)
    if not len(starts):
        return np.zeros((0, 2), np.uint64), first
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MARK[low], dtype=np.uint64)])
    return np.stack([_span_hashes(low, starts, ends, 0), total[ends] - total[starts]], 1), first


class Vocabulary:
    """Places of known token hashes; a small table of marks sorts out most others first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def counts(self, tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, word and count for each known token of a text."""
        flat = tok.ravel()
        maybe = np.flatnonzero(self.marks[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, flat[maybe]), max(0, len(self.hashes) - 1))
        ok = self.hashes[at] == flat[maybe] if len(self.hashes) else np.zeros(len(maybe), bool)
        text = np.searchsorted(first, maybe[ok] // 2, "right") - 1
        key, n = np.unique(text * len(self.hashes) + at[ok], return_counts=True)
        return key // max(1, len(self.hashes)), key % max(1, len(self.hashes)), n


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each document of the sample."""
    for batch in batches:
        data, off = text_buffers(batch.column(1))
        for lo, hi in blocks(off):
            tok, first = tokens(data, off[lo : hi + 1])
            text = np.repeat(np.arange(hi - lo), np.diff(first))
            text, token = np.repeat(text, 2), tok.ravel()
            order = np.lexsort((token, text))
            text, token = text[order], token[order]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (token[1:] != token[:-1])])[: len(text)] & (token != 0)
            of = batch.column(0).slice(lo, hi - lo).take(pa.array(text[new]))
            yield pa.RecordBatch.from_arrays([of, pa.array(token[new].view(np.int64))], ["domain", "token"])


def _training(vocabulary):
    """Known words of each document of the sample and their log counts, as compact bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for lo, hi in blocks(off):
                text, word, n = v.counts(*tokens(data, off[lo : hi + 1]))
                cut = np.searchsorted(text, np.arange(1, hi - lo))
                words = [x.astype("<i4").tobytes() for x in np.split(word, cut)]
                logs = [x.tobytes() for x in np.split(np.log1p(n).astype("<f4"), cut)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words, pa.binary()), pa.array(logs, pa.binary())], ["domain", "words", "logs"])

    return run


def fit(x: np.ndarray, y: np.ndarray, n: int, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by accelerated gradient; every class weighs the same."""
    weight = (1 / np.bincount(y, minlength=n).clip(1))[y]
    weight = (weight / weight.sum()).astype(np.float32)
    one = np.eye(n, dtype=np.float32)[y]
    rate = 2.0 / (float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + ridge)
    w, b = np.zeros((x.shape[1], n), np.float32), np.zeros(n, np.float32)
    vw, vb = w.copy(), b.copy()
    for k in range(steps):
        z = x @ vw + vb
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - one) * weight[:, None]
        nw, nb = vw - rate * (x.T @ g + ridge * vw), vb - rate * g.sum(0)
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def _sample(docs: DataFrame, labels: DataFrame, count: dict[str, int], doc_id: str, text: str) -> DataFrame:
    """About TRAIN_DOCS labelled documents (domain, text), as many of each domain, whatever ids repeat.

    Ids are drawn by their hash first, which bounds what is broadcast; then distinct texts of these by another,
    which bounds the rows where one id stands for many.
    """
    each = max(1.0, TRAIN_DOCS / len(count))
    draw = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = lambda n: F.create_map(*[c for k in count for c in (F.lit(k), F.lit(min(1.0, each / max(1, n.get(k, 0)))))])[F.col("domain")]
    few = labels.where(draw("doc_id") < share(count)).select(F.col("doc_id").alias("_of"), "domain")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(few), F.col("_id") == F.col("_of")).withColumn("key", F.xxhash64("_id", "text"))
    rows = written(rows.groupBy("domain", "key").agg(F.first("text").alias("text")), "labelled")
    have = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    sample = written(rows.where(draw("key", F.lit("row")) < share(have)).select("domain", "text"), "sample")
    drop(rows)
    return sample


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str):
    """Domains, vocabulary and weights, from a bounded sample of the labelled documents (doc_id, domain).

    The sample is at most about TRAIN_DOCS distinct documents, shared evenly among all domains; words are the
    WORDS whose share of documents differs most between domains. How frequent the domains are is counted over
    all labels.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and domain is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "domain").distinct()
    count = {r[0]: r[1] for r in labels.groupBy("domain").count().collect()}
    domains = sorted(count)
    if not domains:
        return [], None
    prior = np.log(np.array([count[k] for k in domains], float) / sum(count.values())).astype(np.float32)
    sample = _sample(docs, labels, count, doc_id, text)

    sizes = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    per = sample.mapInArrow(_seen, "domain string, token long").groupBy("token", "domain").agg(F.count("*").alias("n"))
    size_of = F.create_map(*[c for k in domains for c in (F.lit(k), F.lit(float(sizes.get(k, 0))))])[F.col("domain")]
    per = per.withColumn("share", (F.col("n") + 0.5) / (size_of + 1.0))
    absent = 0.5 / (max(sizes.values(), default=0) + 1.0)  # of a domain that hasn't the word at all
    seen = per.groupBy("token").agg(F.sum("n").alias("n"), F.max("share").alias("most"), F.min("share").alias("low"), F.count("*").alias("k"))
    least = F.when(F.col("k") < len(domains), F.least("low", F.lit(absent))).otherwise(F.col("low")) if len(domains) > 1 else F.lit(0.5)
    told = (F.col("most") - least) * (F.col("most") - least) / (F.col("most") + least)
    words = [r[0] for r in seen.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc(told), "token").limit(WORDS).select("token").collect()]
    v = Vocabulary(np.array(words, np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(v)
    rows = sample.mapInArrow(_training(shared), "domain string, words binary, logs binary").collect()
    shared.unpersist()
    drop(sample)
    if not rows:
        return domains, (v, np.zeros((len(v.hashes), len(domains)), np.float32), prior)
    x, at = np.zeros((len(rows), len(v.hashes)), np.float32), {k: i for i, k in enumerate(domains)}
    for row, r in zip(x, rows):
        row[np.frombuffer(r[1], "<i4")] = np.frombuffer(r[2], "<f4")
    w, b = fit(x, np.array([at[r[0]] for r in rows]), len(domains))
    return domains, (v, w, b + prior)


def _posteriors(model):
    """An Arrow function from texts to (tokens, posterior)."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v, w, b = model.value
        for arr in texts:
            data, off = text_buffers(arr)
            sizes, rows = [np.zeros(0, np.int64)], [np.zeros(0)]
            for lo, hi in blocks(off):
                tok, first = tokens(data, off[lo : hi + 1])
                text, word, n = v.counts(tok, first)
                z = np.tile(b.astype(np.float64), (hi - lo, 1))
                np.add.at(z, text, np.log1p(n)[:, None] * w[word])
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                sizes.append(np.diff(first).astype(np.int64))
                rows.append(p.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(arr) * len(b) + 1, len(b), dtype=np.int32)), pa.array(np.concatenate(rows)))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(sizes)), lists], ["tokens", "posterior"])

    return run


def rates(amount: np.ndarray, moves: np.ndarray, most: float) -> np.ndarray:
    """Rates of documents (rows of tokens by domain) after all projected steps; a row's own tokens and the steps decide."""
    r = np.ones(len(amount))
    for m in moves:
        r = np.clip(r - amount @ m, 0.0, most)
    return r


def _amounts(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Expected tokens of each document by domain, from columns tokens and posterior."""
    p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return p * batch.column(0).to_numpy(zero_copy_only=False)[:, None]


def _totals(moves: np.ndarray, n: int, most: float):
    """Of a partition: the domains' expected tokens, and the Gram matrix of the documents that are at no bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n + n * n)
        for batch in batches:
            x = _amounts(batch, n)
            r = rates(x, moves, most)
            free = x[(r > 0) & (r < most)]
            out[:n] += r @ x
            out[n:] += (free.T @ free).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["at", "v"])

    return run


def _state(member: DataFrame, moves: np.ndarray, n: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The domains' expected tokens and the Gram matrix at the present rates, over all documents."""
    parts = member.select("tokens", "posterior").mapInArrow(_totals(moves, n, most), "at long, v double")
    out = np.zeros(n + n * n)
    with tidy(member.sparkSession):
        for at, v in parts.groupBy("at").agg(F.sum("v")).collect():  # a number for each pair of domains
            out[at] = v
    return out[:n], out[n:].reshape(n, n)


def _taken(moves: np.ndarray, n: int, most: float):
    def run(tokens: pa.Array, posterior: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([tokens, posterior], ["tokens", "posterior"])
        return pa.array(rates(_amounts(batch, n), moves, most))

    return F.arrow_udf(run, "double")("tokens", "posterior")


def solve(state, wanted: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Projected steps towards the wanted tokens, and the largest error that is left, as a share of its own target.

    state(moves) gives the tokens and the Gram matrix under a list of steps. Errors are weighted by the inverse
    of the Gram matrix over the documents at no bound, which makes the unit step right while no other reaches a
    bound. A step that brings nothing is taken back and tried at half its length; the best list is returned.
    """
    n = len(wanted)
    scale = np.where(wanted > 0, wanted, wanted.sum())
    moves = np.zeros((0, n))
    now, gram = state(moves)
    best, step = np.abs((now - wanted) / scale).max(), 1.0
    for _ in range(steps):
        if best <= tolerance or not gram.any() or step < 1 / 64:
            break
        inverse = np.linalg.inv(gram + 1e-9 * np.trace(gram) / n * np.eye(n))
        tried = np.vstack([moves, step * (inverse @ (now - wanted))])
        then, there = state(tried)
        size = np.abs((then - wanted) / scale).max()
        if size < best:
            moves, now, gram, best, step = tried, then, there, size, min(1.0, 2 * step)
        else:
            step /= 2
    return moves, float(best)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", total: float | None = None, max_rate: float = MAX_RATE, keep: bool = False) -> DataFrame:
    """Rates at which to take documents so that the domains' expected tokens (words) match target shares.

    A row for each row of docs: doc_id, tkey (hash of the text), tokens, posterior (in the order of sorted
    domains), rate (0 to max_rate) and copies, which is the rate rounded down or up by a hash of the row so that
    its expectation is the rate; with keep also row, the row of docs. labels are rows (doc_id, domain); every
    target's domain must be among them.

    A classifier fitted on labelled documents gives each document a posterior over domains. The rates solve a
    least-squares problem over all documents: the sum of rate * tokens * posterior should be the target of each
    domain. Projected gradient steps start from rate 1 (solve); a step is one number for each domain, so a
    document's rate follows from its own row and the list of steps. Each step is one aggregation over a compact
    table, of which a number for each pair of domains comes to the driver. total is the number of tokens wanted;
    by default the domain with the largest target keeps its tokens. Each domain is brought within TOLERANCE of
    its own target; where rates up to max_rate can't do that, the nearest list of steps counts, with a warning.

    Null and empty texts have no tokens; their rate stays 1 and changes no total. Without labels, or without
    tokens, all rates are 1. A row without an id is mixed like others. Repeated rows get equal rates. Labels
    that are null or of unknown documents teach nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), packed_row(docs)) if keep else docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("tkey", row_key(F.col("text")))
    with tidy(spark):
        domains, model = train(docs, labels, doc_id, text)
    if not domains:
        same = {"tokens": F.lit(0).cast("long"), "posterior": F.array().cast("array<double>"), "rate": F.lit(1.0), "copies": F.lit(1)}
        return rows.withColumns(same).drop("text")
    unknown = set(targets) - set(domains)
    if unknown:
        raise ValueError(f"no labels for {sorted(unknown)}")
    n = len(domains)
    shared = spark.sparkContext.broadcast(model)
    member = F.arrow_udf(_posteriors(shared), "tokens long, posterior array<double>", F.ArrowUDFType.SCALAR_ITER)
    member = written(rows.withColumn("m", member(F.coalesce("text", F.lit("")))).select("*", "m.*").drop("m", "text"), "membership")
    shared.unpersist()
    share = np.array([targets.get(k, 0.0) for k in domains])
    share = share / share.sum()
    state = lambda moves: _state(member, moves, n, max_rate)
    moves, now = np.zeros((0, n)), state(np.zeros((0, n)))[0]
    if now.sum() > 0:
        wanted = share * (total if total is not None else now[share.argmax()] / share.max())
        moves, left = solve(state, wanted)
        if left > TOLERANCE:
            warnings.warn(f"the mix misses a target by {left:.2%} of it: rates from 0 to {max_rate} don't reach it", stacklevel=2)
    chance = F.pmod(F.xxhash64("doc_id", "tkey", F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = member.withColumn("rate", _taken(moves, n, max_rate))
    return out.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, else good or poor by quality; rows with a null among them are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return labels.where("toxic is not null and quality is not null").select("doc_id", domain.alias("domain"))


def mixing_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    domains = label_domains(labels)
    present = {r[0] for r in domains.select("domain").distinct().collect()}  # three at most
    out = mix(docs, domains, {k: v for k, v in TARGETS.items() if k in present})
    p = [F.get("posterior", F.lit(i)).alias(f"p_{k}") for i, k in enumerate(sorted(present))]
    return out.select("doc_id", "tokens", *p, "rate", "copies")


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents as often as their mix says, with the columns of docs.

    The rows are written once with their posteriors, so no text is shuffled; nulls, ties and repeats as in mix.
    """
    domains = label_domains(labels)
    present = {r[0] for r in domains.select("domain").distinct().collect()}
    out = mix(docs, domains, {k: v for k, v in TARGETS.items() if k in present}, keep=True).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
