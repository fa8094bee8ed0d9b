"""Quality by ordinal regression on hashed text, with a cumulative logit link.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector for all grades and one ordered
threshold between each two. Features are hashed: words (relative weights of their counts) and
the shapes of words (letters, capitals, digits and marks in runs), each group scaled to length
one, with the share of words that repeat the one before. The expected grade ranks documents;
the tail probability P(grade >= k) selects them.

Trained on the driver, on a sample of labelled documents bounded by ``sample`` per class.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fold, fresh, map_texts, words_of

WORDS, SHAPES, SAMPLE = 1 << 14, 1 << 10, 3000
SIZE = WORDS + SHAPES + 2
KEPT = 400_000
_RUNS = [(re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w])\1+"), r"\1\1")]


def shape(word: str) -> str:
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word


class _Places(dict):
    """A word's place among the words and that of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > KEPT:
            self.clear()
        self[word] = p = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS, WORDS + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPES)
        return p


_places = _Places()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values. A text without words has only the constant place for that."""
    words = words_of(text)
    if not words:
        return np.array([SIZE - 1]), np.array([1.0])
    seen = Counter(words)
    at = np.array([_places[w] for w in seen])
    n = np.fromiter(seen.values(), float, len(seen))
    head, value = np.unique(at[:, 0], return_inverse=True)
    lexical = np.log1p(np.bincount(value, n))
    form, value = np.unique(at[:, 1], return_inverse=True)
    shapes = np.bincount(value, n)
    again = sum(map(eq, words, words[1:])) / len(words)
    return np.r_[head, form, SIZE - 2], np.r_[lexical / np.linalg.norm(lexical), shapes / np.linalg.norm(shapes), 3 * again]


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        at, value = features(text)
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[at] @ value, -50, 50)))


def fit(texts: list[str], grades: list[int], levels: int, steps: int = 300, ridge: float = 2e-4) -> Model:
    """Full-batch Adam on the ordinal log-likelihood. Thresholds keep their order as a first one
    and positive steps. Without rows, all grades are as likely as any."""
    if not texts:
        return Model(np.zeros(SIZE), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1)))
    found = [features(t) for t in texts]
    at = np.concatenate([f[0] for f in found])
    value = np.concatenate([f[1] for f in found])
    row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    y = np.asarray(grades)
    below = np.clip([(y < k).mean() for k in range(1, levels)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-2 * np.arange(levels - 1))
    z = np.r_[np.zeros(SIZE), start[:1], np.log(np.maximum(np.diff(start), 1e-2))]
    m, s = np.zeros_like(z), np.zeros_like(z)
    n = len(y)
    for step in range(1, steps + 1):
        w, gaps = z[:SIZE], np.exp(z[SIZE + 1 :])
        cuts = z[SIZE] + np.r_[0, np.cumsum(gaps)]
        x = np.bincount(row, w[at] * value, n)
        edge = np.r_[-np.inf, cuts, np.inf]
        hi, lo = (1 / (1 + np.exp(-np.clip(edge[y + d] - x, -40, 40))) for d in (1, 0))
        hi, lo = np.where(y == levels - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        up, down = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
        g = np.zeros_like(z)
        g[:SIZE] = np.bincount(at, (up - down)[row] * value, SIZE) + ridge * w
        dcut = np.bincount(y, -up, levels)[: levels - 1] + np.bincount(y, down, levels)[1:]
        g[SIZE] = dcut.sum()
        g[SIZE + 1 :] = dcut[1:][::-1].cumsum()[::-1] * gaps
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        z -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return Model(z[:SIZE], z[SIZE] + np.r_[0, np.cumsum(np.exp(z[SIZE + 1 :]))])


def sample_graded(docs: DataFrame, labels: DataFrame, grade, levels: int, per_grade: int, modulus: int, held: int) -> tuple[list[str], list[int]]:
    """Up to about per_grade labelled texts of each grade outside the held fold, in a fixed order.
    Labels whose grade is null are left out; of repeated ones the least grade counts."""
    key = fresh("id")
    rows = labels.select(F.col("doc_id").cast("long").alias(key), grade.cast("int").alias("grade")).where(f"grade >= 0 AND grade < {levels} AND `{key}` IS NOT NULL")
    rows = rows.where(fold(F.col(key), modulus) != held).groupBy(key).agg(F.min("grade").alias("grade"))
    limit = F.lit(0.0)
    for r in rows.groupBy("grade").count().collect():
        limit = F.when(F.col("grade") == r["grade"], min(1.0, per_grade / r["count"])).otherwise(limit)
    few = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < limit * 1_000_000)
    found = columns(docs, "doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col(key)).select("doc_id", "grade", "text")  # few: levels * per_grade rows
    kept = sorted({(r["doc_id"], r["grade"], r["text"] or "") for r in found.toLocalIterator()})
    return [r[2] for r in kept], [r[1] for r in kept]


def classify(docs: DataFrame, labels: DataFrame, grade, levels: int, select_from: int = 1, sample: int = SAMPLE, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of select_from or better) and kept.

    Null and empty texts share the constant place for texts without words; a null doc_id is scored
    like any; rows repeated with one doc_id and text get equal scores; an empty table no rows."""
    model = fit(*sample_graded(docs, labels, grade, levels, sample, modulus, held), levels)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            tails = np.array([model.tails(t.as_py()) for t in batch.column(1)]).reshape(-1, levels - 1)
            p = tails[:, select_from - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    scored = map_texts(columns(docs, "doc_id", "text"), run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "expected_grade", "tail_probability", "kept")
