"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

Tokens are the words of a text with A-Z lowered, then one end token. The most frequent tokens
(all, up to ``KNOWN``) have vectors of their own, as contexts and as targets; each other one
shares the vector of its spelling class, a hash of its last two bytes. The ``CONTEXT`` tokens
before a place predict it, each through a matrix of its position:

    hidden = sum_j r[h_j] . C_j        score(x | h) = hidden . q[x] + b[x]

Targets are factored, so that every probability is normalised exactly at little cost: first the
class (ranges of frequency ranks with equal shares of the corpus, and the spelling classes), then
the token among its class. A token without a vector has its share, (count + 1), of its spelling
class's known tokens, and what was never seen has the share that tokens seen once have there
(Good and Turing's estimate).

Training is noise-contrastive at both levels: batches of places meet noise that the batch, or in
a batch a class, shares, drawn from the unigram distribution; all steps are numpy matrix products.
A start is made on the driver, on documents drawn by a hash up to ``START`` tokens. Then every
task passes over all places of its documents, and the tasks' changes are averaged by row, weighted
by the number of steps that moved the row. So counts and training both cover the whole corpus.

Sizes: the counts are a distributed table. What goes to the executors or comes from one of them
has at most KNOWN tokens and 2 * KNOWN rows of WIDTH + 1 numbers. Tokens without a vector are
looked up by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fold, map_texts, written

KNOWN, GROUPS, SPELLED = 1 << 13, 64, 48
WIDTH, CONTEXT = 15, 2
#: Tokens of the start, its rounds, places in a batch there and in the pass over all documents.
START, ROUNDS, SMALL, BATCH = 1 << 20, 3, 4096, 1 << 14
#: Noise classes of a batch, noise tokens of a class in a batch.
NOISE, INNER = 24, 8
RATE = 0.15
#: Places that are scored together; rows of parameters that are averaged together.
SCORED, BLOCK = 1 << 14, 256
#: The end token. No word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    """ASCII lower case and the six white space characters are what bytes go by."""
    return [*(text.encode("utf-8", "surrogatepass").lower().split() if text else ()), END]


def spelled(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % SPELLED


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64()), pa.array(list(map(spelled, held)), pa.int32())], ["token", "n", "class"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            held.update(tokens(text.as_py()))
        if len(held) > 300_000:
            yield flush()
            held = Counter()
    yield flush()


class _Places(dict):
    """A token's number; one without a vector has that of its spelling class."""

    def __missing__(self, token: bytes) -> int:
        return self.known + spelled(token)


class Vocabulary:
    """top: the tokens with vectors and their counts, most frequent first. tail: for each spelling
    class the count, the number and the number of those seen once of its tokens outside of top."""

    def __init__(self, top: list[tuple[bytes, int]], tail: np.ndarray):
        self.tokens = [t for t, _ in top]
        count = np.array([n for _, n in top], np.float64)
        self.known = len(top)
        share = (np.cumsum(count + 1) - (count + 1) / 2) / max((count + 1).sum(), 1)
        _, group = np.unique(np.floor(share * GROUPS).astype(np.int64), return_inverse=True)
        groups = int(group.max()) + 1 if self.known else 0
        self.classes = groups + SPELLED
        self.of = np.concatenate([group, groups + np.arange(SPELLED)]).astype(np.int64)
        self.edge = np.searchsorted(group, np.arange(groups + 1))
        self.sums = np.concatenate([[0.0], np.cumsum(count + 1)])
        inner = (count + 1) / (self.sums[self.edge[1:]] - self.sums[self.edge[:-1]])[group] if self.known else count
        self.inner = np.log(inner).astype(np.float32)  # unigram share within the class
        weight = np.concatenate([np.diff(self.sums[self.edge]), tail[:, 0] + 1])
        self.outer = np.log(weight / weight.sum()).astype(np.float32)
        self.plus = np.concatenate([np.log10(count + 1), np.zeros(SPELLED)])
        mass = tail[:, 0] + tail[:, 1]  # (count + 1) over a class's known tokens
        unseen = np.clip(tail[:, 2] / np.maximum(tail[:, 0], 1), 1 / (mass + 1), np.where(mass > 0, 0.9, 1.0))
        self.log_unseen = np.log10(unseen)
        self.log_seen = np.log10(np.where(mass > 0, 1 - unseen, 1) / np.maximum(mass, 1))

    def places(self) -> _Places:
        out = _Places(zip(self.tokens, range(self.known), strict=True))
        out.known = self.known
        return out

    @property
    def rows(self) -> int:
        """Rows of parameters: context vectors, then tokens, classes and position matrices. The last
        column has the biases of tokens and classes; elsewhere it stays zero."""
        return 2 * self.known + SPELLED + self.classes + CONTEXT * (WIDTH + 1)

    def views(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.known + SPELLED, 2 * self.known + SPELLED
        return rows[:a], rows[a:b], rows[b : b + self.classes], rows[b + self.classes :]

    def fresh(self, seed: int = 9) -> np.ndarray:
        """Small random vectors; the biases make the unigram model."""
        rows = np.random.default_rng(seed).normal(0, 0.1, (self.rows, WIDTH + 1)).astype(np.float32)
        r, q, c, m = self.views(rows)
        r[:, WIDTH], q[:, WIDTH], c[:, WIDTH] = 0, self.inner, self.outer
        m[:] = np.tile(np.eye(WIDTH + 1) * (np.arange(WIDTH + 1) < WIDTH), (CONTEXT, 1))
        return rows


class Sequence:
    """The numbers of the tokens of texts in a row, ``CONTEXT`` end tokens before each text, which are
    contexts only; owner: the text of each target."""

    def __init__(self, texts: list[list[bytes]], places: _Places):
        pad, flat = [END] * CONTEXT, []
        for words in texts:
            flat += pad
            flat += words
        self.flat = np.fromiter(map(places.__getitem__, flat), np.uint16, len(flat))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.owner = np.repeat(np.arange(len(texts)), size)
        self.target = np.zeros(len(flat), bool)
        self.target[np.arange(len(self.owner)) + CONTEXT * (self.owner + 1)] = True

    def parts(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, with CONTEXT more in front; which of those after them are targets)"""
        for lo in range(CONTEXT, len(self.flat), size):
            yield self.flat[lo - CONTEXT : lo + size], self.target[lo : lo + size]


def _hidden(vectors: np.ndarray, m: np.ndarray) -> np.ndarray:
    """vectors: of a part's numbers; a row for each place after the first CONTEXT, whose last column is
    one, to meet biases. (Rows of whole width all through, as numpy takes and multiplies them fastest.)"""
    n, full = len(vectors) - CONTEXT, WIDTH + 1
    out = np.zeros((n, full), np.float32)
    for j in range(CONTEXT):
        a = CONTEXT - 1 - j
        out += vectors[a : a + n] @ m[j * full : (j + 1) * full]
    out[:, WIDTH] = 1
    return out


def _order(numbers: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders of all numbers of a part, and of its targets by their places after the first CONTEXT."""
    every = np.argsort(numbers, kind="stable")
    some = every[every >= CONTEXT] - CONTEXT
    return every, some[target[some]]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, which come sorted, and the sums of their rows of values."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first].astype(np.int64), np.add.reduceat(values, first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place; scores stay far from where a float32 ends."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Steps of noise-contrastive estimation on a vocabulary's rows of parameters."""

    def __init__(self, vocabulary: Vocabulary, rows: np.ndarray, seen: np.ndarray, seed: int = 9):
        self.v, self.rows, self.seen = vocabulary, rows, seen
        self.steps = np.zeros(len(rows), np.float32)
        self.rng = np.random.default_rng(seed)
        self.noise = np.cumsum(np.exp(vocabulary.outer.astype(np.float64)))
        self.many = np.diff(vocabulary.edge) > 1

    def move(self, offset: int, at: np.ndarray, gradient: np.ndarray) -> None:
        """AdaGrad with one scale per row."""
        at = at + offset
        self.seen[at] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        self.rows[at] -= gradient * (RATE / np.sqrt(self.seen[at]))[:, None]
        self.steps[at] += 1

    def step(self, numbers: np.ndarray, target: np.ndarray) -> None:
        v = self.v
        every, order = _order(numbers, target)
        if not len(order):
            return
        r, q, c, m = v.views(self.rows)
        vectors = r.take(numbers, axis=0)
        ones = _hidden(vectors, m).take(order, axis=0)
        t = numbers[CONTEXT:][order]
        # classes: sorted like the targets, as a class is a range of targets
        of = v.of[t]
        drawn = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE) * self.noise[-1]), v.classes - 1)
        log_k = np.float32(np.log(NOISE))
        right = c.take(of, axis=0)
        data = _sigmoid(np.einsum("ij,ij->i", ones, right) - v.outer[of] - log_k) - 1
        other = _sigmoid(ones @ c[drawn].T - (v.outer[drawn] + log_k))
        back = other @ c[drawn]
        right *= data[:, None]
        back += right
        keys, values = _sums(of, data[:, None] * ones)
        dc = np.zeros_like(c)
        dc[keys] += values
        np.add.at(dc, drawn, other.T @ ones)
        # tokens within their classes
        inside = int(np.searchsorted(t, v.known))
        moved = []
        if inside:
            w = t[:inside]
            log_k = np.float32(np.log(INNER))
            right = q.take(w, axis=0)
            data = _sigmoid(np.einsum("ij,ij->i", ones[:inside], right) - v.inner[w] - log_k) - 1
            data[~self.many[of[:inside]]] = 0  # alone in its class
            right *= data[:, None]
            back[:inside] += right
            moved.append(_sums(w, data[:, None] * ones[:inside]))
            begin = np.searchsorted(w, v.edge)
            busy = np.flatnonzero((np.diff(begin) > 0) & self.many)
            lo, hi = v.sums[v.edge[busy]], v.sums[v.edge[busy + 1]]
            words = np.searchsorted(v.sums, lo[:, None] + self.rng.random((len(busy), INNER)) * (hi - lo)[:, None], side="right") - 1
            words = np.clip(words, v.edge[busy][:, None], v.edge[busy + 1][:, None] - 1)
            level = v.inner[words] + log_k
            for g, ws, x in zip(busy.tolist(), words, level, strict=True):
                a, b = begin[g], begin[g + 1]
                near, some = q.take(ws, axis=0), ones[a:b]
                p = _sigmoid(some @ near.T - x)
                back[a:b] += p @ near
                moved.append((ws, p.T @ some))
        back[:, WIDTH] = 0
        n, full = len(target), WIDTH + 1
        by_place = np.zeros((n, full), np.float32)
        by_place[order] = back
        dr, dm = np.zeros_like(vectors), np.empty_like(m)
        for j in range(CONTEXT):
            a = CONTEXT - 1 - j
            dm[j * full : (j + 1) * full] = vectors[a : a + n].T @ by_place
            dr[a : a + n] += by_place @ m[j * full : (j + 1) * full].T
        a = v.known + SPELLED
        if moved:
            keys, values = np.concatenate([k for k, _ in moved]), np.concatenate([x for _, x in moved])
            by = np.argsort(keys.astype(np.uint16), kind="stable")
            self.move(a, *_sums(keys[by], values.take(by, axis=0)))
        touched = np.flatnonzero(dc.any(axis=1))
        self.move(a + v.known, touched, dc[touched])
        self.move(0, *_sums(numbers[every], dr.take(every, axis=0)))
        self.move(a + v.known + v.classes, np.arange(len(dm)), dm)

    def learn(self, sequence: Sequence, batch: int) -> None:
        for numbers, target in sequence.parts(batch):
            self.step(numbers, target)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sums of exp over rows, which it overwrites."""
    np.exp(np.minimum(x, 80, out=x), out=x)
    return np.log(x @ np.ones(x.shape[1], np.float32))


def log_probabilities(v: Vocabulary, rows: np.ndarray, sequence: Sequence) -> np.ndarray:
    """Natural logarithms of P(target | context), for a target without a vector that of its spelling class."""
    r, q, c, m = v.views(rows)
    across, many, out = np.ascontiguousarray(c.T), np.diff(v.edge) > 1, []
    for numbers, target in sequence.parts(SCORED):
        _, order = _order(numbers, target)
        t = numbers[CONTEXT:][order]
        ones = _hidden(r.take(numbers, axis=0), m).take(order, axis=0)
        of = v.of[t]
        value = np.einsum("ij,ij->i", ones, c.take(of, axis=0))
        for lo in range(0, len(t), 2048):
            value[lo : lo + 2048] -= _log_sum(ones[lo : lo + 2048] @ across)
        inside = int(np.searchsorted(t, v.known))
        value[:inside] += np.einsum("ij,ij->i", ones[:inside], q.take(t[:inside], axis=0)) * many[of[:inside]]
        begin = np.searchsorted(t, v.edge)
        for g in np.flatnonzero((np.diff(begin) > 0) & many).tolist():
            a, b = begin[g], begin[g + 1]
            value[a:b] -= _log_sum(ones[a:b] @ q[v.edge[g] : v.edge[g + 1]].T)
        by_place = np.empty(len(target), np.float64)
        by_place[order] = value
        out.append(by_place[target])
    return np.concatenate(out) if out else np.zeros(0)


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The tokens whose count is over a threshold that at most so many pass, by their counts. The
    threshold comes from a histogram, eight bins for each doubling, so no task sorts them all."""
    size = F.floor(F.log2("n") * 8).cast("int")
    passed, least = 0, None
    for r in sorted(counts.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["b"]):  # at most 512 bins
        if passed + r["n"] > most:
            break
        passed, least = passed + r["n"], r["b"]
    if least is None:
        return []
    top = counts.where(size >= least).toArrow()  # at most KNOWN rows
    return sorted(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of the tasks' changes; all rows of a block come to one task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, change in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(change, np.float32).astype(np.float64)
            total[block] = total[block] + x if block in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["block", "change"])


def train(learns: DataFrame, v: Vocabulary, n: int) -> np.ndarray:
    """The rows of parameters after the start and a pass over all documents (a column text)."""
    spark = learns.sparkSession
    rows, seen = v.fresh(), np.full(v.rows, 1e-2, np.float32)
    if not n:
        return rows
    some, size = [], 0
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(min(1.0, START / n) * (1 << 20))
    for r in learns.where(part).toLocalIterator():
        some.append(tokens(r["text"]))
        size += len(some[-1])
        if size >= START:
            break
    first = Trainer(v, rows, seen)
    if some:
        sequence = Sequence(some, v.places())
        for _ in range(ROUNDS):
            first.learn(sequence, SMALL)
    sent = spark.sparkContext.broadcast((v, rows, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, rows, seen = sent.value
        places, own = v.places(), Trainer(v, rows.copy(), seen.copy())
        for batch in batches:
            own.learn(Sequence([tokens(t.as_py()) for t in batch.column(0)], places), BATCH)
        change = np.concatenate([(own.rows - rows) * own.steps[:, None], own.steps[:, None]], axis=1)
        blocks = [b for b in range(0, len(change), BLOCK) if own.steps[b : b + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in blocks], pa.int32()), pa.array([change[b : b + BLOCK].tobytes() for b in blocks], pa.binary())], ["block", "change"])

    kind = "block int, change binary"
    for r in map_texts(map_texts(learns, run, kind).repartition("block"), _averaged, kind).toLocalIterator():
        change = np.frombuffer(r["change"], np.float32).reshape(-1, WIDTH + 2)
        at = r["block"] * BLOCK
        rows[at : at + len(change)] += change[:, :-1] / np.maximum(change[:, -1:], 1)
    return rows


def fit(learns: DataFrame) -> tuple[DataFrame, int, int, Vocabulary, np.ndarray]:
    """The counts (token, n, class), their sum and number, the vocabulary and its trained rows."""
    counts = written(map_texts(learns, _counts, "token binary, n long, class int").groupBy("token", "class").agg(F.sum("n").alias("n")).select("token", "n", "class"))
    total, distinct = map(int, counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())
    top = _most_frequent(counts, KNOWN)
    tail = np.zeros((SPELLED, 3))
    for r in counts.groupBy("class").agg(F.sum("n"), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1))).collect():  # SPELLED rows
        tail[r[0]] = r[1:]
    for token, n in top:
        tail[spelled(token)] -= (n, 1, n == 1)
    vocabulary = Vocabulary(top, tail)
    return counts, total, distinct, vocabulary, train(learns, vocabulary, total)


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Defined cases: a null or empty text is the end token alone; a very long one is scored whole;
    without training documents (an empty table too) N and V are 0 and every token is unseen; a null
    doc_id belongs to the fold of the empty text; rows repeated with one doc_id each train and each
    get their row; tokens of equal count are ranked by their bytes; columns but doc_id and text are
    not looked at, whatever their names."""
    rows = columns(docs, "doc_id", "text")
    counts, total, distinct, vocabulary, model = fit(rows.where(fold(F.col("doc_id"), modulus) != held).select("text"))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = sent.value
        places = v.places()
        for batch in batches:
            texts = [tokens(t.as_py()) for t in batch.column(1)]
            sequence = Sequence(texts, places)
            target, owner = sequence.flat[sequence.target], sequence.owner
            log = log_probabilities(v, model, sequence) / np.log(10)
            far = target >= v.known
            n = np.bincount(owner, minlength=len(texts))
            near = n - np.bincount(owner[far], minlength=len(texts))
            plus, log = np.bincount(owner, v.plus[target], len(texts)), np.bincount(owner, log, len(texts))
            flat = [w for words in texts for w in words]
            tail: list[Counter] = [Counter() for _ in texts]
            for i in np.flatnonzero(far).tolist():
                tail[owner[i]][flat[i]] += 1
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            out = [n, near, plus, log, [list(c) for c in tail], [list(c.values()) for c in tail]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_tokens", "near", "plus", "model", "token", "times"])

    scored = map_texts(rows, sums_of, "doc_id long, n_tokens long, near long, plus double, model double, token array<binary>, times array<long>")
    part = written(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = part.select("row", F.explode(F.arrays_zip("token", "times")).alias("x")).select("row", "x.token", "x.times")
    met = rare.join(counts.select("token", "n"), "token", "left")
    known = F.col("n").isNotNull()
    plus = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1.0)
    # SPELLED numbers each, as literals
    kind = (F.crc32(F.expr("substring(token, -2, 2)")) % SPELLED + 1).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), kind)
    far = met.groupBy("row").agg(
        F.sum(F.when(known, F.col("times")).otherwise(0)).alias("far"),
        F.sum(F.col("times") * plus).alias("far_plus"),
        F.sum(F.col("times") * F.when(known, plus + of(vocabulary.log_seen)).otherwise(of(vocabulary.log_unseen))).alias("far_model"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return part.join(far, "row", "left").select(
        "doc_id",
        (fold(F.col("doc_id"), modulus) == held).alias("held_out"),
        "n_tokens",
        (F.col("near") + zero("far")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("plus") + zero("far_plus") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + zero("far_model")).alias("score"),
    )
