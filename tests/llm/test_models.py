import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestream.llm import language_model, quality_classifier, queries, toxicity

from .conftest import make, words


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# -- quality ----------------------------------------------------------------------------------------


def test_ordinal_grades():
    """Held-out expected grades rise with the grade, and thresholds are in order."""
    rng = np.random.default_rng(0)
    vocab = {0: ["bad", "junk"], 1: ["fair", "plain"], 2: ["fine", "great"]}
    text = lambda g: " ".join(rng.choice(vocab[g]) if rng.random() < 0.3 else f"w{rng.integers(50)}" for _ in range(40))
    grades = rng.integers(0, 3, 400).tolist()
    model = quality_classifier.fit([text(g) for g in grades], grades, 3)
    assert (np.diff(model.thresholds) > 0).all()
    expected = {g: np.mean([model.tails(text(g)).sum() for _ in range(40)]) for g in range(3)}
    assert expected[0] + 0.5 < expected[1] < expected[2] - 0.5
    tails = model.tails(text(1))
    assert tails[0] >= tails[1]


def test_quality_query(spark, sf):
    rows = queries.op1_quality_classifier(spark, sf).collect()
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.kept, good[r.doc_id]) for r in rows if r.held_out and r.doc_id in good]
    assert len(rows) == 200 and np.mean([k == bool(g) for k, g in held]) > 0.85
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows)


def test_quality_odd(spark, odd, empty):
    from pyspark.sql import functions as F

    none = labels_of(spark, [])
    some = labels_of(spark, [(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (5, 0, 0), (99, 1, 0)])
    for labels in (none, some):
        assert quality_classifier.classify(odd, labels, F.col("quality"), 2).count() == odd.count()
        assert quality_classifier.classify(empty, labels, F.col("quality"), 2).count() == 0


def test_shapes():
    assert quality_classifier.shape("Hello42!!!") == "Aa0!!"
    assert quality_classifier.shape("aB1" * 9) == "aA0" * 9  # whole words, never prefixes
    assert quality_classifier.features(None)[0].tolist() == [quality_classifier.SIZE - 1]


# -- language model -------------------------------------------------------------------------------


def brute_base(texts, ids):
    fold = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in ids}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [w.translate(lower) for w in words(t)] + [None] for i, t in zip(ids, texts, strict=True)}
    c = Counter(w for i in ids if not fold[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (fold[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i])) for i in ids}


def test_lm_query(spark, sf, texts):
    rows = queries.op9_lm_scoring(spark, sf).collect()
    want = brute_base(texts.values(), list(texts))
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_score(text, counts, fitted):
    """log10 P(text) in plain Python, token by token, from the counts and the trained rows."""
    L = language_model
    _, _, _, v, rows = fitted
    r, q, c, m = (x.astype(float) for x in v.views(rows))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    said = [w.translate(lower).encode() for w in words(text)] + [b""]
    place = {t: i for i, t in enumerate(v.tokens)}
    number = lambda w: place.get(w, v.known + zlib.crc32(w[-2:]) % L.SPELLED)
    before, total = [number(b"")] * L.CONTEXT, 0.0
    for w in said:
        hidden = sum(r[h] @ m[j * (L.WIDTH + 1) : (j + 1) * (L.WIDTH + 1)] for j, h in enumerate(reversed(before)))
        hidden[-1] = 1
        k = number(w)
        e = np.exp(c @ hidden)
        total += math.log10(e[v.of[k]] / e.sum())
        if k < v.known:
            same = [i for i in range(v.known) if v.of[i] == v.of[k]]
            e = np.exp(q[same] @ hidden)
            total += math.log10(e[same.index(k)] / e.sum())
        else:
            t = k - v.known
            others = [n for x, n in counts.items() if x not in place and zlib.crc32(x[-2:]) % L.SPELLED == t]
            mass, once = sum(others) + len(others), others.count(1)
            unseen = min(max(once / max(sum(others), 1), 1 / (mass + 1)), 0.9 if mass else 1.0)
            total += math.log10((counts[w] + 1) / mass * (1 - unseen)) if w in counts else math.log10(unseen)
        before = [*before[1:], k]
    return total


def test_lm_against_plain_python(spark, monkeypatch, texts):
    """Few tokens with vectors, so that spelling classes and the join are exercised."""
    monkeypatch.setattr(language_model, "KNOWN", 150)
    ids = list(texts)[:60]
    df = make(spark, [texts[i] for i in ids])
    rows = {r.doc_id: r for r in language_model.score(df).collect()}
    want = brute_base([texts[i] for i in ids], list(range(60)))
    for k, r in rows.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[k][:4]
        assert r.base_score == pytest.approx(want[k][4], rel=1e-9)
    learns = df.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 7) <> 2").select("text")
    fitted = language_model.fit(learns)
    counts = {bytes(r.token): r.n for r in fitted[0].collect()}
    assert 1 < fitted[3].known <= 150 and sum(counts.values()) == fitted[1]
    for k in sorted(rows, key=lambda k: rows[k].n_tokens)[:12]:
        assert rows[k].score == pytest.approx(plain_score(texts[ids[k]], counts, fitted), rel=1e-3), k


def test_lm_normalised():
    """Probabilities of all targets after one context, and shares in a spelling class, sum to one."""
    L = language_model
    top = sorted([(f"w{i}".encode(), 1000 // (i + 1) + 1) for i in range(700)] + [(L.END, 50)], key=lambda x: (-x[1], x[0]))
    rest = [f"r{i}x{i % 7}".encode() for i in range(300)]
    tail = np.zeros((L.SPELLED, 3))
    for i, w in enumerate(rest):
        tail[L.spelled(w)] += (1 + i % 3, 1, i % 3 == 0)
    v = L.Vocabulary(top, tail)
    rows = v.fresh() + np.random.default_rng(2).normal(0, 0.3, (v.rows, L.WIDTH + 1)).astype(np.float32)
    s = L.Sequence([[b"w1"]], v.places())
    events = v.known + L.SPELLED
    s.flat = np.concatenate([[*range(5, 5 + L.CONTEXT), i] for i in range(events)]).astype(np.uint16)
    s.target = np.tile(np.arange(L.CONTEXT + 1) == L.CONTEXT, events)
    assert np.exp(L.log_probabilities(v, rows, s)).sum() == pytest.approx(1, abs=1e-4)
    for t in range(L.SPELLED):
        share = sum((2 + i % 3) * 10 ** v.log_seen[t] for i, w in enumerate(rest) if L.spelled(w) == t) + 10 ** v.log_unseen[t]
        assert share == pytest.approx(1)


def test_lm_learns_order():
    """A cycle of words that unigrams can't tell apart."""
    L = language_model
    said = [[f"w{i % 40}".encode() for i in range(k, k + 200)] + [L.END] for k in range(50)]
    top = sorted([(f"w{i}".encode(), 250) for i in range(40)] + [(L.END, 50)], key=lambda x: (-x[1], x[0]))
    v = L.Vocabulary(top, np.zeros((L.SPELLED, 3)))
    t = L.Trainer(v, v.fresh(), np.full(v.rows, 1e-2, np.float32))
    s = L.Sequence(said, v.places())
    before = L.log_probabilities(v, t.rows, s).mean()
    for _ in range(30):
        t.learn(s, 512)
    assert before < -3.5 and L.log_probabilities(v, t.rows, s).mean() > -1


def test_lm_beats_bigrams(spark):
    """Held-out documents of sf0.01 against interpolated bigrams, with the best of three weights."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    said = {i: [w.lower() for w in (t or "").encode().split()] + [b""] for i, t in texts.items()}
    one, two = Counter(), Counter()
    for i in set(texts) - held:
        one.update(said[i])
        two.update(zip([b"", *said[i][:-1]], said[i], strict=True))
    n, v = sum(one.values()), len(one)
    pairs = [(h, w) for i in held for h, w in zip([b"", *said[i][:-1]], said[i], strict=True)]
    best = max(sum(math.log10(k * two[p] / max(one[p[0]], 1) + (1 - k) * (one[p[1]] + 1) / (n + v + 1)) for p in pairs) for k in (0.1, 0.3, 0.5))
    assert sum(r.score for r in queries.op9_lm_scoring(spark, sf).collect() if r.held_out) > best


def test_lm_odd(spark, odd, empty):
    rows = language_model.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 7)} == {1}
    assert language_model.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = language_model.score(make(spark, ["a b"], held)).collect()  # nothing to learn from
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score)


# -- toxicity ---------------------------------------------------------------------------------------


def brute_kernel(a, b, decay=toxicity.DECAY):
    from itertools import combinations

    def phi(w):
        out = Counter()
        for at in combinations(range(len(w)), 3):
            out[tuple(w[i] for i in at)] += decay ** (at[2] - at[0] + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(p[k] * q[k] for k in p)
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_kernel():
    some = ["idiot", "id-iot", "banana", "scum", "aaaa"]
    got = toxicity.Kernel(["idiot", "scum", "bandana"]).of(some)
    want = [[brute_kernel(a, b) for b in ("idiot", "scum", "bandana")] for a in some]
    assert got == pytest.approx(np.array(want), abs=1e-5)
    assert got[0, 0] == pytest.approx(1)


def test_folding_is_the_kernel():
    kernel = toxicity.Kernel(["idiot", "scum"])
    model = toxicity.Model(kernel.folded(np.array([0.5, -2.0], np.float32)), 0.25, 1.0, 0.0)
    some = ["idiots", "scumm", "other", "ab", "дурак"]
    assert model.margins(some) == pytest.approx(kernel.of(some) @ [0.5, -2.0] + 0.25, abs=1e-5)


def test_every_letter_counts():
    """Letters of any script are told apart, and nothing else than the letters is."""
    some = ["дурак", "дурки", "愚か者", "愚か物", "idiot"]
    got = toxicity.Kernel(some).of(some)
    assert got == pytest.approx(np.array([[brute_kernel(a, b) for b in some] for a in some]), abs=1e-5)
    assert got[0, 1] < 0.9 and got[2, 3] == 0 and got[0, 4] == 0


def test_instances():
    mark = lambda *w: {toxicity.OPEN + x + toxicity.CLOSE for x in w}
    assert mark("stupid", "you") <= toxicity.instances("you, s t u p i d!")
    assert mark("idiot", "id-iot") <= toxicity.instances("Id-iot") and mark("a") == toxicity.instances("A")
    assert toxicity.instances("") == set()
    assert all(len(w) <= toxicity.LONGEST for w in toxicity.instances("x" * 10_000))
    long = "".join(chr(97 + i * i % 26) for i in range(60)) + "idiot" + "q" * 33
    assert {long[i : i + toxicity.LONGEST] for i in range(len(long) - toxicity.LONGEST + 1)} <= toxicity.instances(long)


@pytest.fixture(scope="module")
def insults():
    rng = np.random.default_rng(5)
    syllables = ["ba", "ke", "lo", "mi", "ru", "ta", "ven", "sor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.integers(2, 5)))
    bad = ["gnarfzig", "blorxwad", "kwizzpug"]
    text = lambda toxic: " ".join([word() for _ in range(rng.integers(5, 60))] + ([rng.choice(bad)] if toxic else []))
    y = [int(i % 3 == 0) for i in range(300)]
    return toxicity.fit([text(t) for t in y], y), bad, text


def test_toxic_words_and_disguises(insults):
    model, bad, text = insults
    clean = model.score([text(0) for _ in range(100)])
    assert np.mean([s < 0.5 for s in clean]) >= 0.98
    for b in bad:
        forms = [b, b.upper(), b + "s", ".".join(b), " ".join(b), b[:4] + "-" + b[4:], b[:3] + "x" + b[3:], b[:5] + b[4:]]
        assert [f for f in forms if model.score([f"{text(0)} {f} {text(0)}"])[0] < 0.5] == [], b


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p for p, t in held if t]) >= 0.9 and np.mean([p for p, t in held if not t]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_against_plain_python(spark, sf, docs, texts):
    """The query's scores from the trained weights, one subsequence after the other."""
    from itertools import combinations

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(*toxicity.sample_labelled(docs, labels, "toxic", toxicity.SAMPLE))
    w = model.weights
    number = {chr(c): i + 1 for i, c in enumerate(w.letters)}
    weight = lambda t: w.values[w.pairs[number.get(t[0], 0) * w.width + number.get(t[1], 0)] * w.width + number.get(t[2], 0)]

    def margin(word):
        found = Counter()
        for at in combinations(range(len(word)), 3):
            found[tuple(word[i] for i in at)] += toxicity.DECAY ** (at[2] - at[0] + 1)
        return model.bias + sum(weight(t) * x for t, x in found.items()) / math.sqrt(sum(x * x for x in found.values()))

    rows = {r.doc_id: r.score for r in queries.op10_toxicity(spark, sf).collect()}
    for k in sorted(texts, key=lambda k: len(texts[k] or ""))[:60:5]:
        x = model.slope * max(map(margin, toxicity.instances(texts[k] or "")), default=model.bias) + model.shift
        assert rows[k] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-4)


def test_toxicity_odd(spark, odd, empty):
    none, some = labels_of(spark, []), labels_of(spark, [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (5, 0, 0)])
    for labels in (none, some):
        rows = toxicity.score(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score(empty, labels).count() == 0
        assert toxicity.keep_clean(empty, labels).count() == 0
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.keep_clean(odd, some).columns == odd.columns


def test_toxicity_nothing_learned(spark, odd):
    """Without labels, with those of one class, and with too few to learn from, no document goes."""
    for rows in ([], [(1, 1, 1), (2, 1, 1), (5, 1, 1)], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1), (2, 1, 0)]):
        kept = toxicity.keep_clean(odd, labels_of(spark, rows))
        assert kept.columns == odd.columns and kept.count() == odd.count()
