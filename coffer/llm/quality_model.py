"""Quality classifier: learned hashed word and character n-gram vectors, averaged per document, with a softmax output.

Features of a text (bytes of UTF-8): words, pairs of neighbouring words (a word that follows itself is one feature, whatever
the word) and all runs of 3 to 5 bytes, each hashed to one of ``BUCKETS``. A document's vector is the mean of its features' vectors. Vectors and output weights are learned together by
stochastic gradient descent in numpy, on at most ``PER_CLASS`` labelled rows of each class (those whose hashed id is least),
so what the driver gathers is bounded. With two classes the softmax of a mean is the logistic of a mean of one number per
bucket, so scoring needs one table of that many floats, however large the vocabulary.

Null or empty text has no features and gets the score of the bias. Null labels, or rows without one, aren't learned from;
with one class only, every text scores its share. Repeated rows and extra columns pass; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import arrow, give_back, mix, texts

BUCKETS, DIMENSIONS, RUNS = 1 << 18, 8, (3, 4, 5)
#: Bound on the labelled rows of a class that the model is fitted to, and on their bytes.
PER_CLASS, TRAIN_BYTES = 1500, 24_000_000
EPOCHS, RATE, THRESHOLD = 10, 0.25, 0.3
#: Bytes of text that are hashed together.
CHUNK = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)


def _words(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashes of all words."""
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(data)
    up, down = (_UP, _DOWN) if n <= CHUNK else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)]
    return begin, mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def features(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of some texts, and the number of each one's text. Texts are parted by a zero byte."""
    data = np.frombuffer(b"\0".join(chunk) + b"\0", np.uint8)
    sizes = np.array([len(x) + 1 for x in chunk])
    owner = np.repeat(np.arange(len(chunk), dtype=np.int32), sizes)
    space = (data == 32) | (data <= 13) & (data >= 9) | (data == 0)
    begin, word = _words(data, space)
    by = owner[begin]
    pairs = by[1:] == by[:-1]
    both = np.where(word[1:] == word[:-1], np.uint64(1), mix(word[1:] * np.uint64(3) + word[:-1]))
    out, owners = [word, both[pairs]], [by, by[1:][pairs]]
    wide = data.astype(np.uint32)
    run, n = wide, len(data)
    for k in range(2, max(RUNS) + 1):
        run = run[: n - k + 1] * np.uint32(0x01000193) ^ wide[k - 1 :] if n >= k else run[:0]
        if k in RUNS:
            whole = owner[: len(run)] == owner[k - 1 : k - 1 + len(run)]
            whole &= data[k - 1 : k - 1 + len(run)] != 0
            hashed = (run ^ np.uint32(k)) * np.uint32(0x9E3779B1)
            out.append((hashed ^ hashed >> np.uint32(15)).astype(np.uint64)[whole])
            owners.append(owner[: len(run)][whole])
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(owners)


class Model:
    """``table``: each bucket's share in the log odds of class 1; ``bias``: those of a text without features."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), float(bias)

    def scores(self, many: list[bytes]) -> np.ndarray:
        total, n = np.zeros(len(many)), np.zeros(len(many))
        at = 0
        while at < len(many):
            to, size = at, 0
            while to < len(many) and (to == at or size + len(many[to]) < CHUNK):
                size += len(many[to]) + 1
                to += 1
            found, owner = features(many[at:to])
            total[at:to] = np.bincount(owner, weights=self.table[found], minlength=to - at)
            n[at:to] = np.bincount(owner, minlength=to - at)
            at = to
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -40, 40)))


def fit(many: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent (each parameter's step shrinks with its past gradients). Classes weigh alike up to the square root of their sizes."""
    ones = int(labels.sum())
    prior = float(np.log((ones + 1) / (len(labels) - ones + 1)))
    if not 0 < ones < len(labels):
        return Model(np.zeros(BUCKETS), prior)
    bags = []
    for t in many:
        found, times = np.unique(features([t])[0], return_counts=True)
        bags.append((found, (times / max(times.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.1, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = rng.uniform(-0.5, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.array([0.0, prior], dtype=np.float32)
    seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(output, 1e-4), np.full_like(bias, 1e-2)
    weight = np.sqrt(len(labels) / 2 / np.array([len(labels) - ones, ones]))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            found, share = bags[i]
            if not len(found):
                continue
            hidden = share @ vectors[found]
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= np.float32(weight[labels[i]])
            back = output @ p
            g_o = np.outer(hidden, p)
            seen_o += g_o * g_o
            output -= rate * g_o / np.sqrt(seen_o)
            seen_b += p * p
            bias -= 0.1 * rate * p / np.sqrt(seen_b)
            seen_v[found] += (share * share) * float(back @ back)
            vectors[found] -= (rate * share / np.sqrt(seen_v[found]))[:, None] * back
    return Model(vectors @ (output[:, 1] - output[:, 0]), bias[1] - bias[0])


def held_out(id_column: str = "doc_id"):
    """Rows that labels are never learned from. A null id is never learned from nor held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits a model to the labelled rows outside the held-out fold. Of an id's repeated labels the least counts, of its repeated texts too."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("quality") == label).orderBy(*order).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.withColumnRenamed("doc_id", "labelled_id")
    rows = (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))  # at most 2 * per_class rows of two numbers
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
        .orderBy(*order)
    )
    many: list[bytes] = []
    marks: list[int] = []
    size = 0
    for r in rows.toLocalIterator():
        raw = r["text"].encode()
        if size + len(raw) <= TRAIN_BYTES:  # whole texts only
            many.append(raw)
            marks.append(int(r["quality"]))
            size += len(raw)
    model = fit(many, np.array(marks, dtype=np.int64))
    many.clear()
    give_back()
    return model


def score(docs: DataFrame, model: Model, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` (all if None) and, under a new name, the probability of label 1."""
    names = docs.columns if columns is None else columns
    kept = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("scored_text"))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.table, model.bias))  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            found = own.scores([t.encode() for t in texts(batch.column(len(names)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*names, name])

    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add(name, "double")
    return arrow(kept, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject."""
    name = max(docs.columns, key=len) + "_score"  # no column of theirs
    return score(docs, train(docs, labels), name=name).where(F.col(name) >= THRESHOLD).drop(name)
