"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel of two words sums over all common subsequences of three letters, each weighted by
``DECAY`` to the lengths that it spans in both words, and is normalised to 1 for a word with
itself. Letters put in between (id-i_ot) or left apart (s t u p i d, read as one word) only
stretch the spans, so such a form stays close to the insult that it hides.

Training, on labelled documents: words are the instances. Those that far more toxic documents
hold than clean ones are the first positive instances, copies of a document counting once; the
words of clean documents are negative. Landmarks are the most telling words, different from
each other, and clean words near to them. A word's features are its kernel values against the
landmarks, whitened by the landmarks' own kernel matrix (the Nyström map), and a linear machine
with squared hinge loss separates them. Twice over, the best word of each toxic document that
has no positive one joins the positive instances. A document's margin is that of its worst
word, and a logistic curve fitted on the training documents turns it into a probability.

A margin is linear in the kernel, so the machine folds into one weight for each three letters:
to score a word is to look up its subsequences. Only the text counts. The sample of labelled
documents is bounded by ``sample`` per class (drawn by a hash of the doc_id), which also bounds
the driver's memory.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fold, fresh, give_back, map_texts

DECAY, LANDMARKS, SAMPLE, LONGEST = 0.8, 160, 1500, 24
#: Marks of a word's ends.
OPEN, CLOSE = "\x02", "\x03"
#: Distinct words whose margin a worker keeps; more are computed anew.
KEPT = 100_000
#: Texts whose words are looked up together.
TOGETHER = 64
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”‘’«»¡¿"
_SPELLED = re.compile(r"(?<![^\x20\x09-\x0D])[^\W\d_](?:[\x20.\-_*]+[^\W\d_]){2,}(?![^\x20\x09-\x0D.,!?;:])")


def instances(text: str) -> set[str]:
    """The distinct words of a text, lower case and without outer punctuation; a word with marks
    inside is also read without them, and a run of single letters as one word. Each has marks at
    its ends, which count as letters, so that the shortest words have subsequences too. Of a word
    over ``LONGEST`` letters, all stretches of that length are read: what spans more letters than
    that has next to no weight in the kernel."""
    low = text.lower()
    words = {w.strip(_EDGE) for w in set(low.split())}
    for run in _SPELLED.findall(low):
        words.add("".join(c for c in run if c.isalpha()))
    words |= {"".join(c for c in w if c.isalnum()) for w in words if not w.isalnum()}
    words.discard("")
    out = set()
    for w in words:
        if len(w) > LONGEST:
            marked = OPEN + w + CLOSE
            out.update(marked[i : i + LONGEST] for i in range(len(marked) - LONGEST + 1))
        else:
            out.add(OPEN + w + CLOSE)
    return out


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of three letters in a word of n, and their weights."""
    at = np.array(list(combinations(range(n), 3)), np.int64)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


@lru_cache(maxsize=64)
def _reach(n: int) -> np.ndarray:
    """The decay from each place to the one before each later place."""
    gap = np.arange(n)[None, :] - np.arange(n)[:, None] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


def _norms(letters: np.ndarray) -> np.ndarray:
    """Square roots of the words' kernels with themselves, by the kernel's recursion over the places
    where a word's letters meet its own."""
    count, n = letters.shape
    reach = _reach(n)
    same = (letters[:, :, None] == letters[:, None, :]).astype(np.float32) * np.float32(DECAY**2)
    ends = same
    for _ in range(2):  # subsequences of two letters, then of three, by where they end
        half = (ends.reshape(-1, n) @ reach).reshape(count, n, n).transpose(0, 2, 1)
        ends = same * (half.reshape(-1, n) @ reach).reshape(count, n, n).transpose(0, 2, 1)
    return np.sqrt(ends.sum(axis=(1, 2)))


def _codes(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points have 21 bits: three are one number, and no two letters are one."""
    return (letters[:, at[:, 0]] << 42) | (letters[:, at[:, 1]] << 21) | letters[:, at[:, 2]]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length, in bounded blocks: positions in words, the words' letters (code points, a row per
    word), the places of subsequences in them, their weights, and the words' norms."""
    by_size: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_size.setdefault(len(w), []).append(k)
    for n, every in by_size.items():
        if n < 3:
            continue
        at, weight = _triples(n)
        step = max(1, 500_000 // len(at))
        for lo in range(0, len(every), step):
            some = every[lo : lo + step]
            letters = np.frombuffer("".join([words[k] for k in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.int64)
            yield np.array(some), letters, at, weight, _norms(letters)


class Kernel:
    """The normalised kernel against fixed words."""

    def __init__(self, others: list[str]):
        self.others = others
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for place, letters, at, weight, norm in subsequences(others):
            codes = _codes(letters, at)
            for k, p in enumerate(place):
                value, where = np.unique(codes[k], return_inverse=True)
                rows.append((value, np.bincount(where, weight) / norm[k], np.full(len(value), p)))
        self.codes = np.unique(np.concatenate([r[0] for r in rows])) if rows else np.zeros(0, np.int64)
        self.table = np.zeros((len(self.codes) + 1, len(others)), np.float32)
        for value, share, p in rows:
            self.table[np.searchsorted(self.codes, value), p] = share

    def of(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.others)), np.float32)
        if not len(self.codes):
            return out
        for place, letters, at, weight, norm in subsequences(words):
            codes = _codes(letters, at)
            k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            word, triple = np.nonzero(self.codes[k] == codes)
            for lo in range(0, len(word), 25_000):  # bounded blocks of matches
                w, t = word[lo : lo + 25_000], triple[lo : lo + 25_000]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                out[place[w[first]]] += np.add.reduceat(self.table[k[w, t]] * weight[t][:, None], first, axis=0)
            out[place] /= norm[:, None]
        return out

    def folded(self, alpha: np.ndarray) -> "Weights":
        """One weight for each three letters: the sum of the fixed words' entries, weighted."""
        return Weights(self.codes, self.table[: len(self.codes)] @ alpha)


class Weights:
    """Weights of three letters (codes in order), by tables: letters that stand in them have numbers,
    all others have 0; so have pairs of letters; and a pair and a letter have a place."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        three = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]) if len(codes) else np.zeros((3, 0), np.int64)
        self.letters = np.unique(three)
        number = np.searchsorted(self.letters, three) + 1
        self.width = len(self.letters) + 1
        self.pairs = np.zeros(self.width * self.width, np.int32)
        known = np.unique(number[0] * self.width + number[1])
        self.pairs[known] = np.arange(1, len(known) + 1)
        self.values = np.zeros((len(known) + 1) * self.width, np.float32)
        self.values[self.pairs[number[0] * self.width + number[1]] * self.width + number[2]] = values

    def of(self, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.zeros((len(letters), len(at)), np.float32)
        k = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        number = np.where(self.letters[k] == letters, k + 1, 0)
        pair = self.pairs[number[:, at[:, 0]] * self.width + number[:, at[:, 1]]]
        return self.values[pair * self.width + number[:, at[:, 2]]]


class Model:
    """weights: for each three letters; bias: of a word's margin; slope and shift: of the
    logistic curve over a document's margin. A text without words has the bias for its margin."""

    def __init__(self, weights: Weights, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift
        self.known: dict[str, float] = {}

    @property
    def learned(self) -> bool:
        """False if fit() found nothing to tell the classes by: all texts then have one score."""
        return bool(self.weights.values.any())

    def __getstate__(self):
        return (self.weights, self.bias, self.slope, self.shift)

    def __setstate__(self, state):
        self.__init__(*state)

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias, np.float32)
        for place, letters, at, weight, norm in subsequences(words):
            out[place] += (self.weights.of(letters, at) @ weight) / norm
        return out

    def margin(self, sets: list[set[str]]) -> np.ndarray:
        """The greatest margin of the words of each set."""
        known = self.known
        new = [w for w in set().union(*sets) if w not in known]
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list(set().union(*sets))
        known.update(zip(new, self.margins(new).tolist(), strict=True))
        return np.array([max(map(known.__getitem__, words), default=self.bias) for words in sets])

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo in range(0, len(texts), TOGETHER):
            margin = self.margin([instances(t) if t else set() for t in texts[lo : lo + TOGETHER]])
            out[lo : lo + TOGETHER] = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))
        return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Primal linear machine with squared hinge loss, by Newton steps over the active instances."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    last = None
    for _ in range(40):
        active = y * (x @ w) < 1
        if last is not None and (active == last).all():
            break
        last = active
        a, s = x[active], c * weight[active]
        w = np.linalg.solve(keep + (a * s[:, None]).T @ a, (a * s[:, None]).T @ y[active])
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable, by Newton steps; its slope is held down, so that a few
    odd documents between two clear classes don't decide where it crosses a half."""
    w, x = np.zeros(2), np.c_[margin, np.ones(len(margin))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag([5.0, 1e-3])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([5.0, 1e-3]) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _different(sets: list[set[str]]) -> list[int]:
    """A number for each set of words, shared by near copies: sets that agree in two of eight
    least hashes taken together are one."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple, int] = {}
    mult = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 2654435769, 1597334677, 3812015801], np.uint64)
    for i, words in enumerate(sets):
        if not words:
            continue
        h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
        low = ((h[:, None] ^ (h[:, None] >> np.uint64(15))) * mult % np.uint64((1 << 32) - 5)).min(axis=0)
        for band in range(4):
            key = (band, int(low[2 * band]), int(low[2 * band + 1]))
            if key in seen:
                parent[root(i)] = root(seen[key])
            else:
                seen[key] = i
    return [root(i) for i in range(len(sets))]


def _telling(bad: Counter, good: Counter, n_bad: int, n_good: int, error: float = 0.05) -> list[str]:
    """Words that more of the toxic documents hold than chance lets any word hold: Chernoff's
    bound on the binomial tail, times the number of words that were looked at, is below error."""
    p = n_bad / max(1, n_bad + n_good)
    often = {w: n for w, n in bad.items() if n >= 3}
    out = []
    for w, k in often.items():
        n = k + good[w]
        q = k / n
        gain = k * np.log(q / p) + ((n - k) * np.log((1 - q) / (1 - p)) if k < n else 0)
        if q > p and gain > np.log(len(often) / error) and q > 1 - (1 - p) / 8:
            out.append(w)
    return sorted(out, key=lambda w: (-bad[w], w))


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 2) -> Model:
    """Trains on labelled texts. Without an example of both classes, or without a telling word,
    every text gets the share of toxic ones (a half if there are no texts at all)."""
    once: dict[str, str] = {}
    sets = [{once.setdefault(w, w) for w in instances(t or "")} for t in texts]
    del once
    y = np.array([int(bool(t)) for t in toxic], np.int64)
    groups = _different(sets)
    bad, good = Counter(), Counter()
    held: dict[int, set[str]] = {}
    for words, group, t in zip(sets, groups, y, strict=True):
        if t:
            held[group] = held.get(group, set()) | words
        else:
            good.update(words)
    for words in held.values():
        bad.update(words)
    del held
    n_bad, n_good = len({g for g, t in zip(groups, y, strict=True) if t}), int((y == 0).sum())
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    seeds = _telling(bad, good, n_bad, n_good)
    if not seeds or not n_good:
        return Model(Weights(np.zeros(0, np.int64), np.zeros(0, np.float32)), 0.0, 0.0, float(np.log(share / (1 - share))))
    clean = sorted(good, key=lambda w: (zlib.crc32(w.encode()), w))
    rough = Kernel(seeds[: 2 * landmarks])
    first = Model(rough.folded(np.full(len(rough.others), 1 / len(rough.others), np.float32)), 0.0, 1.0, 0.0)
    near = np.argsort(-first.margins(clean), kind="stable")[:6000]
    negative = sorted({*clean[:12_000], *(clean[i] for i in near), *(w for w, _ in good.most_common(4000))} - set(seeds))
    chosen: list[str] = []
    alike = rough.of(rough.others)
    taken: list[int] = []
    for i, w in enumerate(rough.others):
        if len(chosen) < landmarks * 3 // 4 and (not taken or alike[i, taken].max() < 0.9):
            chosen.append(w)
            taken.append(i)
    top = rough.of(negative).max(axis=1)
    chosen += [negative[i] for i in np.argsort(-top, kind="stable")[: landmarks - len(chosen)]]
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(kernel.of(chosen).astype(np.float64))
    strong = values > 1e-3
    whiten = vectors[:, strong] / np.sqrt(values[strong])
    positive = list(seeds)
    against = kernel.of(negative) @ whiten
    for again in range(rounds + 1):
        told = kernel.of(positive) @ whiten
        x = np.vstack([told, told, against])
        label = np.r_[np.ones(len(positive)), -np.ones(len(positive) + len(negative))]
        seen = np.array([max(bad[w], 1) for w in positive], float)
        clear = np.array([good[w] for w in positive], float)  # positive ones that clean documents hold too
        weight = np.r_[seen / seen.sum(), clear / seen.sum(), [good[w] / seen.sum() + 1 / len(negative) for w in negative]] * 100
        beta, bias = _machine(x, label, weight)
        model = Model(kernel.folded((whiten @ beta).astype(np.float32)), bias, 1.0, 0.0)
        if again == rounds:
            break
        found = set(positive)
        for words, t in zip(sets, y, strict=True):
            if t and words and not words & found:
                listed = sorted(words)
                m = model.margins(listed)
                best = int(np.argmax(m))
                if m[best] > 0 and not good[listed[best]]:
                    found.add(listed[best])
        hard = [w for w, m in zip(clean, model.margins(clean), strict=True) if m > -0.5]
        extra = sorted(set(hard) - set(negative) - found)
        negative += extra
        against = np.vstack([against, kernel.of(extra) @ whiten]) if extra else against
        positive = sorted(found)
    margin = np.concatenate([model.margin(sets[lo : lo + TOGETHER]) for lo in range(0, len(sets), TOGETHER)])
    slope, shift = _curve(margin, y)
    give_back()
    return Model(model.weights, model.bias, slope, shift)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 5, held: int = 0) -> tuple[list[str], list[int]]:
    """Up to about per_class labelled texts of each class, by a hash of the doc_id, from the rows
    outside the held fold; ordered, so that a training run can be repeated."""
    key = fresh("id")
    rows = labels.select(F.col("doc_id").cast("long").alias(key), F.col(label).cast("int").alias("label")).where(f"label IS NOT NULL AND `{key}` IS NOT NULL")
    rows = rows.where(fold(F.col(key), modulus) != held).groupBy(key).agg(F.max("label").alias("label"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    limit = F.lit(0.0)
    for value, count in n.items():
        limit = F.when(F.col("label") == value, min(1.0, per_class / count)).otherwise(limit)
    few = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < limit * 1_000_000)
    found = columns(docs, "doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col(key)).select("doc_id", "label", "text")  # few: some thousand rows
    kept = sorted({(r["doc_id"], r["label"], r["text"] or "") for r in found.toLocalIterator()})
    return [r[2] for r in kept], [r[1] for r in kept]


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) for every document.

    Defined cases: a null or empty text has no words and gets the bias's margin; a null doc_id is
    scored all the same (and its fold is that of the empty text); labels with nulls are left out,
    repeated ones count once, toxic if any is; without labels every score is a half. Rows with
    one doc_id and one text get one score."""
    model = fit(*sample_labelled(docs, labels, "toxic", sample, modulus, held))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' letters, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            p = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = map_texts(columns(docs, "doc_id", "text"), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, whole rows, that are not predicted toxic: all of them if the labels taught nothing."""
    model = fit(*sample_labelled(docs, labels, "toxic", sample))
    if not model.learned:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(model.score(texts.to_pylist()) < 0.5))

    return map_texts(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
