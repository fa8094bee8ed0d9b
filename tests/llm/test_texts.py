import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestream.llm import bpe_automaton, license_scan, packing, quality_rules, queries

from .conftest import make

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
STRANGE = ["Hello World's it'LL <|endoftext|> foo <|startoftext|>bar", "Σοφός ΑΣ İ ½² x\x1cy \x85 a", "é ẛ̣ don't 日本語 😀🏽", "a" * 3000, "ab" * 700 + " " * 50 + "c", "", "   ", "<|", "'''s''", "ſ ﬁ ǅ ῼ", "\n\n a\n \t", "x　 y\xa0\xa0z", None]


def oracle(spark, name, sf, df, sort=repr):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf, name):
    oracle(spark, name, sf, queries.queries()[name](spark, sf))


# -- automaton --------------------------------------------------------------------------------------


def test_bpe_query_is_the_library(spark, sf, texts):
    lib = Tokenizer.from_file(WORD_BPE)
    rows = {r.doc_id: r for r in queries.op4_bpe_automaton(spark, sf).collect()}
    for key, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        out = lib.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())
        assert (rows[key].n_tokens, rows[key].ids_sha256, rows[key].decoded_sha256) == want


def test_bpe_strange_texts(spark, odd, empty):
    lib, tok = Tokenizer.from_file(WORD_BPE), bpe_automaton.tokenizer(WORD_BPE)
    for text in STRANGE:
        ids, out = tok.encode(text or "")
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert memoryview(ids).cast("I").tolist() == want
        assert out == tok.decode(want) == lib.decode(want, skip_special_tokens=False)
    rows = bpe_automaton.encode(odd, WORD_BPE).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4, 7)} == {0}
    assert bpe_automaton.encode(empty, WORD_BPE).count() == 0


def test_bpe_all_characters():
    """Every code point, assigned ones apart from those that Python's tables don't know."""
    import unicodedata

    lib, tok = Tokenizer.from_file(WORD_BPE), bpe_automaton.tokenizer(WORD_BPE)
    every = [chr(c) for c in (*range(0x32400), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    for unknown in (False, True):
        some = [c for c in every if (unicodedata.category(c) == "Cn") == unknown]
        for lo in range(0, len(some), 200):
            text = " ".join(f"a{c}b {c}1{c}" for c in some[lo : lo + 200])
            assert memoryview(tok.encode(text)[0]).cast("I").tolist() == lib.encode(text, add_special_tokens=False).ids, hex(ord(some[lo]))


def brute_bpe(symbols, merges):
    """Textbook BPE: the earliest merge that applies, at its leftmost place, again and again."""
    rank = {m: i for i, m in enumerate(merges)}
    parts = list(symbols)
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = ["".join(parts[i : i + 2])]


@pytest.mark.parametrize("seed", range(30))
def test_automaton_is_bpe(seed):
    """Random merges over two letters, doubled ones and dead ones included."""
    rng = random.Random(seed)
    known, merges = ["a", "b"], []
    for _ in range(rng.randrange(1, 14)):
        pair = (rng.choice(known), rng.choice(known))
        if "".join(pair) not in known:
            merges.append(pair)
            known.append("".join(pair))
    automaton = bpe_automaton.Automaton({t: i for i, t in enumerate(known)}, merges)
    for n in range(1, 9):
        for k in range(1 << n):
            text = "".join("ab"[k >> i & 1] for i in range(n))
            assert [known[i] for i in automaton.path(text)] == brute_bpe(text, merges)


# -- packing ----------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_sequence, by_doc


def test_packing_query(spark, sf, texts):
    lib = Tokenizer.from_file(BYTE_BPE)
    rows = queries.op5_best_fit_packing(spark, sf).collect()
    by_sequence, by_doc = check_packing(rows, 2048)
    assert set(by_doc) == set(texts)
    for key, parts in by_doc.items():
        ids = [*lib.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 2048 for r in parts[1:])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert len(by_sequence) == -(-sum(r.length for r in rows) // 2048)  # no packing can do better


def test_byte_tokenizer_strange_texts():
    lib, tok = Tokenizer.from_file(BYTE_BPE), packing.tokenizer(BYTE_BPE)
    for text in [*STRANGE, " " * 2_000_000 + "a"]:
        assert memoryview(tok.encode(text or "")).cast("I").tolist() == lib.encode(text or "", add_special_tokens=False).ids


def least_sequences(counts, capacity):
    """Martello and Toth's lower bound: pieces over half a sequence can't share one, and what is
    too long for the gaps that they leave needs room of its own."""
    best = 0
    for least in range(capacity // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > capacity - least)
        half = {x: n for x, n in counts.items() if capacity / 2 < x <= capacity - least}
        rest = sum(x * n for x, n in counts.items() if least <= x <= capacity / 2)
        room = sum((capacity - x) * n for x, n in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    counts = {int(k): int(n) for k, n in enumerate(rng.integers(0, 40, capacity + 1)) if k and n}
    patterns = packing.plan(counts, capacity)
    used = {}
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for _, t in patterns) <= least_sequences(counts, capacity) * 1.02 + 1


def test_exact_complements():
    assert packing.plan({7: 1, 3: 1}, 10) == [([7, 3], 1)]
    assert packing.plan({7: 2, 2: 2, 1: 2}, 10) == [([7, 2, 1], 2)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [([4, 3, 2, 1], 1)]
    assert packing.plan({6: 3}, 10) == [([6], 3)] and packing.plan({}, 10) == []


def test_packing_odd(spark, odd, empty):
    rows = packing.best_fit(odd, BYTE_BPE, 64).collect()
    _, by_doc = check_packing(rows, 64)
    assert [r.length for r in by_doc[3]] == [1] and len(by_doc[1]) == 2
    assert packing.best_fit(empty, BYTE_BPE).count() == 0
    hot = packing.best_fit(make(spark, ["x y"] * 500), BYTE_BPE, 16)  # one length only
    assert len(check_packing(hot.collect(), 16)[0]) == 500 // (16 // 3)


# -- rules and licences -------------------------------------------------------------------------------


def test_rules_counts():
    text = "a b c\nx\na b c\n\nx\n#$ q"
    n, chars, symbols, dup, repeat = quality_rules.counts(text)
    assert (n, chars, symbols, dup, repeat) == (10, 11, 2, 2, 8)
    assert quality_rules.counts("a a a a") == (4, 4, 0, 0, 4)
    assert quality_rules.counts(None) == quality_rules.counts("") == (0, 0, 0, 0, 0)


def test_frequent_lines(spark):
    """A line shared by many texts of a host goes, copies of one text count once, other hosts don't."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    shared = " ".join(f"menu{j}" for j in range(40))
    texts = [f"{shared}\n{body(i)}" for i in range(30)] + [f"{shared}\n{' '.join(f'q{i}z{j}' for j in range(12))}" for i in range(4)] + [f"copied {body(99)}"] * 40
    rows = [(i, t, None, "h", 0) for i, t in enumerate(texts)] + [(1000, texts[0], None, "other", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df, most=20).collect()}
    assert all(got[i].kept and got[i].n_frequent_words == 40 for i in range(30))
    assert all(got[i].depleted and not got[i].kept for i in range(30, 34))
    assert all(got[i].kept and got[i].n_frequent_words == 0 for i in range(34, 74))
    assert got[1000].kept and got[1000].n_frequent_words == 0


def test_rules_odd(odd, empty):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == odd.count() and {r.base_failed for r in rows if r.doc_id in (3, 4, 7)} == {True}
    assert quality_rules.quality_rules(empty).count() == 0


def test_licences(spark, odd, empty):
    texts = ["Released under the MIT License.", "x\nreleased  under the MIT license\ny", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "nothing here", "All rights reserved.\nReleased under the MIT License.", "released under a very different license"]
    got = [(r.n_license_lines, r.licenses, r.best_license) for r in license_scan.scan(make(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(1, "MIT", "MIT"), (1, "MIT", "MIT"), (1, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (1, "Proprietary", "Proprietary"), (0, "", None), (2, "MIT,Proprietary", "MIT"), (0, "", None)]
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_licence_bounds_lose_nothing(seed):
    """Against every template without pruning."""
    rng = random.Random(seed)
    matcher, sets = license_scan.Matcher(None, 0.6), license_scan.template_sets()
    lines = [t for texts in license_scan.TEMPLATES.values() for t in texts]
    for _ in range(300):
        w = rng.choice(lines).split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(["x", "the", "License", ""])
        pairs = license_scan.bigrams(" ".join(w))
        scores = [(2 * len(pairs & s) / (len(pairs) + len(s)), n) for n, s in sets if pairs]
        best = min(((-d, n) for d, n in scores if d >= 0.6), default=None)
        assert matcher.best(" ".join(w)) == (best and (-best[0], best[1]))


def test_license_windows(spark):
    """Wrapped, inline and whole texts; each line alone is under the threshold."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    gpl = "some words\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\nother words"
    inline = ["Copyright 2024 Foo. Released under the MIT License.", "Copyright (c) 2024 Foo Inc. All rights reserved."]
    whole = dict(license_scan.window_templates())
    texts = [mit, mit.replace("\n", " "), gpl, *inline, "a\n" + next(t for n, t in license_scan.window_templates() if n == "Apache-2.0" and len(t) > 5000), "all of it\nrights are reserved"]
    got = [(r.n_license_lines, r.licenses) for r in license_scan.scan(make(spark, texts)).orderBy("doc_id").collect()]
    assert got[:5] == [(6, "MIT"), (1, "MIT"), (4, "GPL-3.0"), (1, "MIT"), (1, "Proprietary")]
    assert got[5][0] > 150 and "Apache-2.0" in got[5][1].split(",") and got[6] == (0, "")
    assert set(license_scan.WHOLE) <= set(whole)
