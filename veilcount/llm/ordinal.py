"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < K share one weight vector over hashed text features; ordered
thresholds cut the score: P(grade > k) = sigmoid(w.x - theta_k).  Training fits both
by AdaGrad on a sample of at most ``SAMPLE`` labelled documents with about ``FEATURES``
features in all, drawn by a hash of the row; scoring is one narrow scan of all documents with the weights (a fixed
number of buckets) sent along.

Features are present or absent: normalised words, word pairs, and shapes (share of
symbols, of capitals, of repeated words, length), so one telling word in a long text
counts in full.  Only features whose grades depart from the sample's by ``MIN_Z``
standard deviations at some threshold are given a weight; the thousands of chance
words of a text would drown the few that tell.

Selection: kept when the expected grade is at least ``MIN_GRADE`` and
P(grade >= 1) at least ``MIN_TAIL``.

Defined cases: null or empty text has no feature but the bias and its length class;
a very long text gives at most one feature a bucket; labels without a document or with
null ratings are not used; a rating repeated for one document counts once, different
ratings each; of more rows than the sample takes, those of the smallest hash stay,
whatever their grade, and rows of equal features in the order of their grades; without
any label all documents get grade 0 with equal probabilities and none is kept; repeated
rows are scored alike; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.llm import _text
from veilcount.llm._normal import normal
from veilcount.llm._scratch import Scratch

BUCKETS, SAMPLE, FEATURES, EPOCHS, RATE, DECAY, MIN_Z = 1 << 18, 12_000, 24_000_000, 12, 0.1, 1e-4, 4.0
MIN_GRADE, MIN_TAIL = 1.0, 0.5
_SHAPES = 256


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each feature that a document has, by document."""
    m = len(offsets) - 1
    w = _text.split_words(normal(buf), offsets)
    h, doc = w.hashes(), w.doc()
    g, ok = _text.grams(h, 2), _text.inside(w.first, 2)
    key = np.concatenate([h, g[ok]]) % _text.U(BUCKETS - _SHAPES)
    owner = np.concatenate([doc, doc[: len(g)][ok]])
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / size
    level = lambda x: np.minimum(15, np.ceil(-np.log2(np.maximum(x, 2.0**-14)))).astype(np.int64)
    symbol = (buf >= 0x21) & (buf < 0x7F) & ~_letters[buf]
    shapes = [level(share(symbol)), 16 + level(share((buf >= 0x41) & (buf <= 0x5A))), 32 + level(share((buf >= 0x30) & (buf <= 0x39))), 48 + np.minimum(15, np.log2(size).astype(np.int64)), 64 + level(share(buf == 0x0A))]
    n = np.maximum(w.counts(), 1)
    distinct = np.bincount(np.unique(np.stack([doc.astype(_text.U), h]), axis=1)[0].astype(np.int64), minlength=m) if len(h) else np.zeros(m)
    shapes.append(80 + np.minimum(15, (16 * distinct / n).astype(np.int64)))
    key = np.concatenate([key.astype(np.int64), *(BUCKETS - _SHAPES + s for s in shapes)])
    owner = np.concatenate([owner, *([np.arange(m)] * len(shapes))])
    pairs = np.unique(owner * np.int64(BUCKETS) + key)
    return pairs % BUCKETS, pairs // BUCKETS


_letters = np.zeros(256, bool)
_letters[[c for c in range(0x80) if chr(c).isalnum()]] = True


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, offsets in _text.blocks(batch.column(1)):
            key, doc = features(buf, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), pa.array(key, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["grade", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> Model:
    """AdaGrad over batches of 32 rows; thresholds stay ordered."""
    w, square = np.zeros(BUCKETS, np.float64), np.full(BUCKETS, 1e-4)
    every, owner = np.concatenate(rows), np.repeat(grades, [len(x) for x in rows])
    n, tells = np.bincount(every, minlength=BUCKETS), np.zeros(BUCKETS, bool)
    for k in range(levels - 1):
        q = np.clip((grades > k).mean(), 0.01, 0.99)
        above = np.bincount(every[owner > k], minlength=BUCKETS)
        tells |= np.abs(above - n * q) >= MIN_Z * np.sqrt(n * q * (1 - q)) + 1
    rows = [x[tells[x]] for x in rows]
    share = np.clip([(grades > k).mean() for k in range(levels - 1)], 0.01, 0.99)
    theta = -np.log(share / (1 - share))
    theta_square = np.full(levels - 1, 1e-2)
    rng = np.random.default_rng(seed)
    sizes = np.array([len(x) for x in rows])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), 32):
            pick = order[b : b + 32]
            key = np.concatenate([rows[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), sizes[pick])
            z = np.bincount(doc, w[key], len(pick))
            g = grades[pick]
            cumulative = np.concatenate([np.ones((len(pick), 1)), _sigmoid(z[:, None] - theta), np.zeros((len(pick), 1))], axis=1)
            slope = cumulative * (1 - cumulative)
            at = np.arange(len(pick))
            p = np.maximum(cumulative[at, g] - cumulative[at, g + 1], 1e-9)
            dz = -(slope[at, g] - slope[at, g + 1]) / p
            dt = np.zeros((len(pick), levels + 1))
            dt[at, g] += slope[at, g] / p
            dt[at, g + 1] -= slope[at, g + 1] / p
            used, inverse = np.unique(key, return_inverse=True)
            grad = np.bincount(inverse, dz[doc], len(used)) + decay * w[used]
            square[used] += grad**2
            w[used] -= rate * grad / np.sqrt(square[used])
            grad_t = dt[:, 1:-1].sum(axis=0)
            theta_square += grad_t**2
            theta = np.maximum.accumulate(theta - rate * grad_t / np.sqrt(theta_square))
    return Model(w, theta)


def probabilities(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, levels - 1): P(grade > k)."""
    key, doc = features(buf, offsets)
    m = len(offsets) - 1
    z = np.bincount(doc, model.weights[key], m)
    return _sigmoid(z[:, None] - model.thresholds)


def train(docs: DataFrame, ratings: DataFrame, levels: int, sample: int = SAMPLE) -> Model | None:
    """ratings: doc_id, grade (0 .. levels - 1)."""
    named = ratings.select(F.col("doc_id").cast("bigint").alias("rated"), F.col("grade").cast("int").alias("grade")).where(F.col("grade").between(0, levels - 1) & F.col("rated").isNotNull()).distinct()
    total = named.count()
    if not total:
        return None
    share = min(1.0, 0.95 * sample / total)
    fine = 1 << 40
    drawn = named.where(F.pmod(F.xxhash64(F.lit(23), "rated"), F.lit(fine)) < int(share * fine) + 1)  # about 0.95 sample rows, which is what is broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).where("text is not null")
    rows = texts.join(F.broadcast(drawn), texts["doc_id"] == drawn["rated"]).select("grade", "text").mapInArrow(_featured, "grade int, x array<int>")
    rows = Scratch(docs.sparkSession).put(rows, "features")
    size = rows.agg(F.sum(F.size("x")).alias("features")).first()["features"] or 0
    part = min(1.0, FEATURES / max(size, 1))
    h = F.xxhash64("x")
    kept = rows.where(F.pmod(F.xxhash64(F.lit(29), h), F.lit(fine)) < int(part * fine) + 1)
    got = kept.orderBy(h, "grade").limit(sample).toArrow().combine_chunks()
    if not got.num_rows:
        return None
    lists = got["x"].combine_chunks()
    values, at = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    return fit([values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], np.asarray(got["grade"].combine_chunks()).astype(np.int64), levels)


def score(docs: DataFrame, model: Model | None, levels: int, min_grade: float = MIN_GRADE, min_tail: float = MIN_TAIL) -> DataFrame:
    """One row per document: doc_id, expected_grade, tails (P(grade >= 1), P(grade >= 2), ...), kept."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    if model is None:
        return texts.select("doc_id", F.lit(0.0).alias("expected_grade"), F.array(*[F.lit(0.0)] * (levels - 1)).alias("tails"), F.lit(False).alias("kept"))
    sent = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in _text.blocks(batch.column(1)):
                tails = np.round(probabilities(sent.value, buf, offsets), 6)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * (levels - 1), pa.int32()), pa.array(tails.reshape(-1)))
                grade = np.round(tails.sum(axis=1), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(grade), lists, pa.array((grade >= min_grade) & (tails[:, 0] >= min_tail))], ["doc_id", "expected_grade", "tails", "kept"])

    return texts.mapInArrow(run, "doc_id bigint, expected_grade double, tails array<double>, kept boolean")


def grades(labels: DataFrame) -> DataFrame:
    """labels (quality, toxic) as grades: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & F.col("quality").isNotNull(), F.col("quality") + 1).alias("grade"))
