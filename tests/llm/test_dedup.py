import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline as P

from lodestream.llm import components, exact_dedup, queries, simhash, substring_dedup

from .conftest import make, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# -- exact ------------------------------------------------------------------------------------------


def test_exact_on_odd_rows(spark, odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    same = hashlib.sha256(b"same text here").hexdigest()
    assert (by[1, same].keep_id, by[1, same].group_size, by[1, same].kept) == (1, 3, True)
    assert (by[2, same].keep_id, by[2, same].kept) == (1, False)
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: (r.keep_id, r.kept) for r in rows if r.text_sha256 == nothing} == {3: (3, True), 4: (3, False)}
    assert by[None, hashlib.sha256(b"no id at all").hexdigest()].kept


def test_exact_keep_first(odd, empty):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == {1: 1, 3: 1, 5: 2, 6: 1, None: 1, 7: 1, 8: 1}  # 5 twice: two different texts
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.keep_first(empty).count() == 0


def test_exact_is_native(odd):
    plan = exact_dedup.exact_dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_when_digests_collide(spark, monkeypatch):
    """Texts that share a digest stay apart: groups hold the texts themselves."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("0"))
    rows = exact_dedup.exact_dedup(make(spark, ["a", "b", "a"])).orderBy("doc_id").collect()
    assert [(r.keep_id, r.group_size) for r in rows] == [(0, 2), (1, 1), (0, 2)]


# -- SimHash ----------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(prints, radius=4):
    keys = sorted(prints)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_simhash_query(spark, sf, texts):
    rows = queries.op7_simhash(spark, sf).collect()
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    group = brute_groups(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{prints[k]:016x}", group[k]) for k in texts}


@pytest.mark.parametrize("n", [6, 300, 6000])
def test_simhash_links(spark, n):
    """Chains and dense clusters of fingerprints, against all pairs."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 64, max(2, n // 40), np.uint64)
    fp = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64)) * (rng.random(n) < 0.6).astype(np.uint64)
    fp = np.unique(fp)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(nodes, len(fp))).collect()}
    parent = np.arange(len(fp))
    for i in range(len(fp)):  # label propagation over all pairs, block by block
        parent[i] = i
    changed = True
    near = [np.flatnonzero(np.bitwise_count(fp ^ x) <= 4) for x in fp]
    while changed:
        new = np.array([parent[js].min() for js in near])
        changed = bool((new != parent).any())
        parent = new
    groups = {}
    for i, p in enumerate(parent):
        groups.setdefault(p, set()).add(int(fp[i].view(np.int64)))
    for g in groups.values():
        assert {found.get(x, x) for x in g} == {min(g)}


def test_simhash_big_place(spark, monkeypatch):
    """A place beyond the block size is cut into blocks and loses no link."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    fp = [sum(1 << b for b in range(64) if (i >> (b % 6)) & 1 and b < 6) for i in range(60)]
    nodes = spark.createDataFrame([(x,) for x in sorted(set(fp))], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(nodes, len(fp))).collect()}
    assert set(found.values()) == {0} and len(found) == 60


def test_simhash_odd_and_empty(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.fp == 0} == {3, 4, 7}
    assert {r.component_id for r in rows if r.fp == 0} == {3}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(empty).count() == 0


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


@pytest.mark.parametrize("small", [128, 3])
def test_simhash_places(monkeypatch, small):
    """Places met together, cut over batches, connect what all pairs of each place connect."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "TOGETHER", 50)
    monkeypatch.setattr(simhash, "PAIRS", 20)
    rng, rows = random.Random(3), []
    for place in range(120):
        base, halves = rng.getrandbits(62), place % 4 == 0
        for _ in range(rng.choice([1, 2, 3, 5, 12])):
            fp = base
            for _ in range(rng.randrange(12)):
                fp ^= 1 << rng.randrange(64)
            fp -= (fp >> 63) << 64
            rows.append((place, 0, int(halves), rng.randrange(2) if halves else 0, len(rows), fp, rng.randrange(80, 110), rng.randrange(4)))
    label = {r[4]: r[4] for r in rows}
    links = [(a[4], b[4]) for a in rows for b in rows if a[0] == b[0] and a[4] < b[4] and a[7] != b[7] and (a[2] == 0 or a[3] != b[3]) and ((a[5] ^ b[5]) % (1 << 64)).bit_count() <= 9 and min(a[6], b[6]) >= 0.8 * max(a[6], b[6])]

    def connect(pairs):
        out = dict(label)
        for _ in range(13):
            for a, b in pairs:
                out[a] = out[b] = min(out[a], out[b])
        return out

    columns = list(zip(*rows, strict=True))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 7], pa.int64()) for c in columns], simhash.ROW) for k in range(0, len(rows), 7)]
    got = [(r["a"], r["b"]) for b in simhash._across(9, 0.8, simhash.pivots(), iter(batches)) for r in b.to_pylist()]
    assert len(links) > len(got) > 20 and set(got) <= {x for a, b in links for x in ((a, b), (b, a))}
    assert connect(got) == connect(links)


@pytest.mark.parametrize("block", [8192, 3])
def test_simhash_similar(spark, monkeypatch, block):
    """Near copies that differ in more than four bits go; the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    texts = []
    for n in [30, 60, 60, 90, 150, 400]:
        base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(1 + n // 40)):
                w[rng.randrange(n)] = "edit" + str(rng.randrange(999))
            texts.append(" ".join(w))
    base = [f"f{i}" for i in range(70)]  # a family of which few are similar to any one
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(70)] = f"edit{rng.randrange(999)}"
        texts.append(" ".join(w))
    texts += ["a b", "A  b", "", None, "c"]
    low = [words((t or "").translate(LOWER)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in low]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    label = list(range(len(texts)))
    links = [(i, j) for i in label for j in label[:i] if sets[i] == sets[j] or (jaccard(sets[i], sets[j]) >= 0.8 and (prints[i] ^ prints[j]).bit_count() <= 14)]
    assert any((prints[i] ^ prints[j]).bit_count() > 4 for i, j in links)
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    df = make(spark, texts)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df, 14, 5, 0.8).collect()}
    assert got == dict(enumerate(label))
    kept = {r.doc_id for r in P.drop_near_copies(spark, df, "").collect()}
    assert kept == set(label)


def test_near_copies_files(spark, monkeypatch):
    """With many shuffle partitions, small steps don't make a file for each of them."""
    base = [f"f{i}" for i in range(60)]
    texts = [" ".join(base), *(" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(0, 60, 7)), "another one", None]
    made = []

    def held(df, *rows, plain=simhash.cut):
        out = plain(df, *rows)
        made.append(out.rdd.getNumPartitions())
        return out

    for module in (simhash, components):
        monkeypatch.setattr(module, "cut", held)
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in simhash.near_copies(make(spark, texts), 64, 5, 0.8).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: 0 if i < len(texts) - 2 else i for i in range(len(texts))}
    assert len(made) > 20 and sum(n > 4 for n in made) <= 8, made


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000


# -- substrings -------------------------------------------------------------------------------------


def brute_removed(texts, k):
    """Per text (by place in the list), which of its words a repeated window covers."""
    seen = Counter()
    split = [words(t) for t in texts]
    for w in split:
        seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((w, gone))
    return out


def test_substring_query(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op6_substring_dedup(spark, sf).collect()}
    keys = sorted(texts)
    for key, (w, gone) in zip(keys, brute_removed([texts[k] for k in keys], 35), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (rows[key].n_words, rows[key].n_removed, rows[key].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_substring_random(spark, seed):
    """Short alphabets make repeats within and across texts, overlaps and branches."""
    import random

    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))] for _ in range(6)]
    texts = []
    for _ in range(40):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(passages)[rng.randrange(4) :] if rng.random() < 0.6 else [str(rng.randrange(10**6)) for _ in range(rng.randrange(12))]
        texts.append(" ".join(w))
    texts += ["", None, "a b", "z " * 60]
    rows = {r.doc_id: r for r in substring_dedup.remove(make(spark, texts), window=9, kmer=4).collect()}
    for i, (w, gone) in enumerate(brute_removed(texts, 9)):
        assert rows[i].kept == " ".join(x for x, g in zip(w, gone, strict=True) if not g), i
        spans = [(s.start, s.end) for s in rows[i].spans]
        assert sum(b - a for a, b in spans) == sum(gone) == rows[i].n_removed
        assert all(all(gone[a:b]) for a, b in spans)


def twins():
    """Two different words to which the hash that picks minimizers gives one value."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_substring_twins_stay(spark):
    """Words whose hashes collide are told apart by their letters."""

    a, b = twins()
    h, _ = substring_dedup._words(pa.array([a, b]))
    assert h[0] == h[1]
    head = " ".join(f"w{i}" for i in range(34))
    rows = substring_dedup.remove(make(spark, [f"{head} {a}", f"{head} {b}", f"x {head} {b}"])).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0, 35, 35] and rows[2].kept == "x"


@pytest.mark.parametrize("seed", range(2))
def test_substring_all_hashes_collide(spark, seed):
    """Texts of colliding words only: every window has one minimizer, and the words decide."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(twins(), k=rng.randrange(5, 40))) for _ in range(12)]
    rows = {r.doc_id: r for r in substring_dedup.remove(make(spark, texts), window=9, kmer=4).collect()}
    found = brute_removed(texts, 9)
    assert any(any(g) for _, g in found) and not all(all(g) for _, g in found)
    for i, (w, gone) in enumerate(found):
        assert rows[i].kept == " ".join(x for x, g in zip(w, gone, strict=True) if not g), i


def test_substring_odd_and_empty(odd, empty):
    rows = substring_dedup.remove(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[9][0].n_removed == 30_000 and by[9][0].kept == ""  # the long text stands twice
    assert sorted(r.n_removed for r in by[5]) == [0, 30_000]
    assert by[3][0].n_words == by[4][0].n_words == by[7][0].n_words == 0
    assert substring_dedup.remove(empty).count() == 0
    cleaned = substring_dedup.without_repeats(odd)
    assert cleaned.columns == odd.columns and cleaned.dtypes == odd.dtypes
    texts = {(r.doc_id, r.text) for r in cleaned.collect()}
    assert (3, None) in texts and (7, "\n \t ") in texts and (9, "") in texts and (2, "same  text\there") in texts
    assert substring_dedup.without_repeats(empty).count() == 0


def test_word_hashes():

    texts = ["a b", None, "", " \t b\na ", "é\x1f x", "b"]
    h, n = substring_dedup._words(pa.array(texts))
    assert n.tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len({(w, int(x)) for w, x in zip(flat, h, strict=True)}) == len(set(flat))
    sliced, m = substring_dedup._words(pa.array(texts).slice(3, 2))
    assert m.tolist() == [2, 2] and sliced.tolist() == h[2:6].tolist()
