import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def make(spark, texts, start=0):
    rows = [(i + start, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "éπ", "x" * 50]) + str(rng.randrange(500)) for _ in range(30_000))
    rows = [
        (1, "same text here", "en", "a", 1), (1, "same text here", "en", "a", 1), (2, "same  text\there", "fr", "b", 2), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, long, "de", "a", 5), (6, "w" * 100_000, "en", None, 6), (None, "no id at all", "en", "a", 7), (7, "\n \t ", "en", "a", 8), (8, "Ünïcode   déjà vu 😀 \x1f\x85\xa0x", None, "a", 9),
        (9, long, "de", "b", 5), (5, "another text under five", "en", "a", 3),
    ]
    clash = "count long, n long, id long, row long, fp long, digest string, norm string, salt long, keep_id long, length long, shard long, rank long, found string, host string, line string, score double, token string, label string"
    schema = f"{SCHEMA}, {clash}"
    extra = [7, 7, 7, 7, 7, "d", "n", 7, 7, 7, 7, 7, "f", "h", "l", 0.5, "t", "x"]
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
