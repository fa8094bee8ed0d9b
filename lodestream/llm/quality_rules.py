"""Quality rules: per-document counts, and lines that too many documents of a host share.

A line's frequency in a host is the number of different documents there that hold it; rows
with one text are one document, so copies alone make no line frequent. A line is removed from
a host's documents if its frequency exceeds both limits, one absolute and one relative to the
host. A document is depleted, and rejected, if too little of it is left.

A document sends each of its lines once, as a hash with the hash of its text, so a line that
a third of a host's documents hold is counted by many tasks, each of which sends one number.
The lines over the limits, few and copied under ``SALTS`` salts, then meet the documents'
lines, whose salt comes from the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns, cut, map_texts, words_of

SALTS = 16
SYMBOLS = re.compile(r"[#*$%&|<>]")


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def line_key(line: str) -> str:
    """A line's words in lower case (A-Z only), joined by one space."""
    return " ".join(words_of(ascii_lower(line)))


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)] if text else []
    thrice = list(zip(words, words[1:], words[2:], strict=False))
    repeated = {t for t, n in Counter(thrice).items() if n > 1} if len(set(thrice)) < len(thrice) else ()
    covered, end = 0, 0
    if repeated:
        for i, t in enumerate(thrice):
            if t in repeated:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text or "")), len(lines) - len(set(lines)), covered


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, host and text hash with each distinct line's hash and the words in all its repeats."""
    names = ["doc_id", "host", "text_hash", "line", "words"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for key, text, host in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not text:
                continue
            whole, seen = _hash(text), Counter()
            for line in text.split("\n"):
                if words := line_key(line):
                    seen[words] += words.count(" ") + 1
            for line, n in seen.items():
                for column, value in zip(out, (key, host, whole, _hash(line), n), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "host" else pa.int64()) for n, c in zip(names, out, strict=True)], names)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash"]
    for batch in batches:
        rows = [(*counts(t), _hash(t or "")) for t in batch.column(1).to_pylist()]
        values = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *values], ["doc_id", "host", *names])


def frequent_lines(lines: DataFrame, most: int = 20, share: float = 0.005) -> DataFrame:
    """(host, line, documents) of the lines in more than ``most`` documents of their host and in
    more than ``share`` of its documents. lines: rows with host, text_hash and line."""
    hosts = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    per = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
    return per.where(F.col("documents") > most).join(hosts, "host").where(F.col("documents") > share * F.col("host_documents")).select("host", "line", "documents")


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat: int = 50, most: int = 20, share: float = 0.005, words_left: int = 20, share_left: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_frequent_words (those in removed lines) and depleted.

    max_repeat and share_left are percentages of a document's words. Defined cases: a null text
    has no words and fails; a null host is the host ''; rows repeated with one doc_id each get
    their row; an empty table gives no rows."""
    rows = columns(docs.withColumn("source", F.col(host)) if host != "source" else docs, "doc_id", "text", "source").withColumn("source", F.coalesce("source", F.lit("")))
    lines = map_texts(rows, _lines, "doc_id long, host string, text_hash long, line long, words long")
    frequent = cut(frequent_lines(lines, most, share))
    salted = frequent.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = lines.withColumn("salt", F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(SALTS)).cast("int"))
    hit = spread.join(salted, ["host", "line", "salt"])
    key = ["doc_id", "host", "text_hash"]
    gone = hit.groupBy(*key, "line").agg(F.max("words").alias("words")).groupBy(*key).agg(F.sum("words").alias("gone"))
    stats = map_texts(rows, _counts, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long")
    joined = stats.alias("s").join(gone.alias("g"), F.col("s.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("s.host") == F.col("g.host")) & (F.col("s.text_hash") == F.col("g.text_hash")), "left")
    lost = F.coalesce("gone", F.lit(0))
    left = F.col("n_words") - lost
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = (lost > 0) & ((left < words_left) | (100 * left < share_left * F.col("n_words")))
    return joined.select("s.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), lost.alias("n_frequent_words"), depleted.alias("depleted"))
