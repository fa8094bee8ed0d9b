import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from lodestream.llm import simhash, toxicity
from lodestream.llm.common import written

from .test_dedup import LOWER, brute_removed, jaccard, normal
from .conftest import words
from .test_texts import check_packing


def brute_representatives(texts):
    """The least key of each group of texts that are linked by fingerprint and five-word similarity."""
    keys = sorted(texts)
    low = {k: words((texts[k] or "").translate(LOWER)) for k in keys}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in low.items()}
    prints = {k: simhash.fingerprint(texts[k], 5) for k in keys}
    label = {k: k for k in keys}
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if sets[a] == sets[b] or ((prints[a] ^ prints[b]).bit_count() <= 14 and jaccard(sets[a], sets[b]) >= 0.8)]
    for _ in keys:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return set(label.values())


def brute(texts, toxic):
    """The texts that reach the last stage, in plain Python. toxic: labels by doc_id."""
    train = [(k, texts[k] or "") for k in sorted(texts) if k in toxic and zlib.crc32(str(k).encode()) % 5]
    model = toxicity.fit([t for _, t in train], [toxic[k] for k, _ in train])
    kept = {k: t for k, t in texts.items() if model.score([t])[0] < 0.5}
    first = {}
    for k in sorted(kept):
        first.setdefault(normal(kept[k]), k)
    kept = {k: kept[k] for k in first.values()}
    stay = brute_representatives(kept)
    kept = {k: kept[k] for k in kept if k in stay}
    keys = sorted(kept)
    for k, (w, gone) in zip(keys, brute_removed([kept[k] for k in keys], 35), strict=True):
        if any(gone):
            kept[k] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return kept


def test_pipeline_against_brute_force(spark, sf, texts):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = brute(texts, toxic)
    rows = P.run(spark, sf).collect()
    by_sequence, by_doc = check_packing(rows, 2048)
    assert set(by_doc) == set(want)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, parts in by_doc.items():
        ids = [*lib.encode(want[k] or "", add_special_tokens=False).ids, 0]
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in parts) == len(ids)
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_stages(spark, sf, docs):
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    df, before = docs, docs.count()
    for _, stage in P.STAGES[:-1]:
        df = written(stage(spark, df, sf))
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
        assert df.count() <= before
        before = df.count()


def test_stages_on_odd_and_empty(spark, sf, odd, empty):
    for start in (odd, empty):
        df = start
        for _, stage in P.STAGES:
            df = written(stage(spark, df, sf))
        assert (df.count() > 0) == (start is odd)
        if start is odd:
            assert None in {r.doc_id for r in df.collect()}
