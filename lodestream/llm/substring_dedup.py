"""Removal of passages that repeat anywhere in the corpus, over a compacted de Bruijn graph.

The graph's edges are the windows of ``WINDOW`` words, its nodes the overlaps between them.
An edge is repeated if its window starts at two places or more; every word under a repeated
edge goes. The graph is never built edge by edge over the whole corpus:

1. Consecutive edges of a document that share a minimizer (the ``KMER``-word run with the
   least hash among those in the window) form one fragment of a path. Equal windows have
   equal minimizers, so only fragments whose minimizer occurs twice can hold a repeated edge;
   counting minimizers, a twelfth of the words, leaves out the rest.
2. Compaction: the fragments of a minimizer are joined with the number of different fragments
   that it has. If all are the same, the path doesn't branch there and the whole fragment is
   repeated. Else the path branches inside, and one copy of each different fragment is opened
   into its edges.
3. Verification: the words of these edges are read again at their source coordinates, and the
   edges counted over the copies of their fragments; those found twice are marked in each fragment.
4. Marked fragments return to their documents as intervals of words, which merge into spans.

Hashes of words choose minimizers and nothing else: a collision there makes a candidate more,
never a repeat. Fragments and windows are equal if the BLAKE2b digests (128 bits) of their own
words, read at their coordinates and joined by one space, are equal.

Defined cases: a null or empty text has no words; a text shorter than the window never loses
any; a very long text only has more fragments, each of bounded length; rows repeated with one
doc_id count as separate places, so a row that stands twice loses what its copy repeats; there
are no ties, as every place of a repeated window goes; other columns are not looked at, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, dropped, fresh, map_texts, written

WINDOW, KMER = 35, 12
#: A fragment's kind: its minimizer and the digest of its words.
KIND = ("minimizer", "c1", "c2")
#: A fixed random number for each byte.
_BYTES = np.random.default_rng(35).integers(0, 1 << 64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ROOTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BACK = tuple(np.uint64(pow(int(r), -1, 1 << 64)) for r in _ROOTS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in UTF-8 bytes that hold texts one after the other, and the
    number of words in each text; start: where each text starts, and the end of the last."""
    gap = _SPACE[raw]
    opens = ~gap
    opens[1:] &= gap[:-1]
    inside = start[:-1][np.diff(start) > 0]
    opens[inside] = ~gap[inside]
    at = np.flatnonzero(opens)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(start) - 1, np.int64)
    power = np.full(len(raw), _ROOTS[0])
    power[0] = 1
    value = _BYTES[raw]
    value[gap] = 0
    value *= np.cumprod(power, out=power)
    back = np.full(len(raw), _BACK[0])
    back[0] = 1
    words = _mix(np.add.reduceat(value, at) * np.cumprod(back, out=back)[at])
    return words, np.diff(np.searchsorted(at, start))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a column of texts, and each text's number of words (null: none)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    start = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[start[0] : start[-1]] if data is not None and len(start) else np.zeros(0, np.uint8)
    return _hashes(raw, start - start[0])


def _digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """Two longs for each stretch of bytes."""
    view, digest = memoryview(raw), hashlib.blake2b
    found = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(found, np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


class Words:
    """The words of a column of texts, joined by one space over all texts, with their hashes."""

    def __init__(self, texts: list[bytes | None]):
        split = [t.split() if t else [] for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.raw = b" ".join([w for ws in split for w in ws])
        raw = np.frombuffer(self.raw, np.uint8)
        self.hashes = _hashes(raw, np.array([0, len(raw)]))[0]
        self.edge = np.append(np.flatnonzero(np.append(True, raw[:-1] == 32)) if len(raw) else [], len(raw) + 1).astype(np.int64)

    def digests(self, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
        """Of the words start to end (not included), by their numbers over all texts."""
        return _digests(self.raw, self.edge[start], self.edge[end] - 1)


def fragments(words: np.ndarray, sizes: np.ndarray, window: int = WINDOW, kmer: int = KMER):
    """(text, start, windows, minimizer, first word's number over all texts) of each fragment, as arrays."""
    width = window - kmer + 1
    m = len(words) - window + 1
    if m <= 0:
        return [np.zeros(0, np.int64)] * 5
    k = np.zeros(len(words) - kmer + 1, np.uint64)
    for i in range(kmer):
        k = k * _ROOTS[0] + words[i : i + len(k)]
    k = _mix(k)
    at, reach = np.arange(len(k)), 1
    while reach < width:  # at[i]: the first least of the k-mers i to i + reach - 1
        step = min(reach, width - reach)
        a, b = at[: len(at) - step], at[step:]
        at, reach = np.where(k[a] <= k[b], a, b), reach + step
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:m]
    fits = np.flatnonzero(np.arange(m) + window <= ends[owner])
    if not len(fits):
        return [np.zeros(0, np.int64)] * 5
    new = np.ones(len(fits), bool)
    new[1:] = (at[fits[1:]] != at[fits[:-1]]) | (owner[fits[1:]] != owner[fits[:-1]])
    first = np.flatnonzero(new)
    begin, count = fits[first], np.diff(np.append(first, len(fits)))
    text = owner[begin]
    return [text, begin - (ends - sizes)[text], count, k[at[begin]].view(np.int64), begin]


def _named(docs: DataFrame, id_: str = "id", row: str = "row") -> DataFrame:
    """Adds two columns that name a document: id, and row, which is 0 unless doc_ids repeat, and
    then a hash that tells texts apart (rows with one doc_id and one text have one name)."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    unique = docs.groupBy(doc_id).count().where("count > 1").isEmpty()
    which = F.lit(0).cast("long") if unique else F.xxhash64(text, doc_id.isNull())
    return docs.withColumns({id_: F.coalesce(doc_id, F.lit(-1 << 63)), row: which})


def _keyed(docs: DataFrame) -> DataFrame:
    return _named(columns(docs, "doc_id", "text"))


def _minimizers(window: int, kmer: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fragments(*_words(batch.column(0)), window, kmer)
        value, n = np.unique(found[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["minimizer", "n"])


def _fragments(window: int, kmer: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(batch.column(2).cast(pa.binary()).to_pylist())
        text, start, n, minimizer, begin = fragments(words.hashes, words.sizes, window, kmer)
        take = pa.array(text)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int8)), pa.array(minimizer), *words.digests(begin, begin + n + window - 1)], ["id", "row", "start", "windows", *KIND])


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are compressed before they are shuffled."""
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        yield batch.set_column(2, "text", pa.array([None if t is None else zlib.compress(t, 1) for t in texts.to_pylist()], pa.binary()))


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else zlib.decompress(t) for t in column.to_pylist()]


def _edges(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opens the fragments listed in a document into their windows, read again at their coordinates."""
    names = [*KIND, "copies", "place", "w1", "w2"]
    for batch in batches:
        words = Words(_texts(batch.column(0)))
        first = np.cumsum(words.sizes) - words.sizes
        found = batch.column(1)
        of = found.flatten()
        if not len(of):
            continue
        text = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
        part = {x: of.field(x).to_numpy(zero_copy_only=False) for x in (*KIND, "copies", "start", "windows")}
        n = part["windows"].astype(np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(first[text] + part["start"], n) + place
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(part[x], n)) for x in names[:4]), pa.array(place.astype(np.int8)), *words.digests(at, at + window)], names)


def repeated_fragments(keyed: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """id, row, start, mask: bit i of mask says that the window starting at start + i is repeated.
    keyed: rows with id, row and text."""
    if not 0 <= window - kmer < 62:
        raise ValueError("a fragment has window - kmer + 1 windows at most, and one bit for each")
    counted = map_texts(keyed.select("text"), partial(_minimizers, window, kmer), "minimizer long, n long")
    often = written(counted.groupBy("minimizer").agg(F.sum("n").alias("n")).where("n > 1").select("minimizer"))
    every = map_texts(keyed.select("id", "row", "text"), partial(_fragments, window, kmer), "id long, row long, start int, windows byte, minimizer long, c1 long, c2 long")
    some = written(every.join(often, "minimizer"))
    dropped(often)
    key = list(KIND)
    kinds = written(some.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "row", "start", "windows")).alias("at")))
    # Written out, like twice below, so that the joins deal out both of their sides: a passage that a third
    # of all documents hold has as many different fragments at its ends, and its key can then be split.
    branch = written(kinds.groupBy("minimizer").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("minimizer"))
    straight = kinds.join(branch, "minimizer", "left_anti").select(*key, F.expr("shiftleft(1L, cast(at.windows AS int)) - 1").alias("mask"))
    opened = kinds.join(branch, "minimizer").groupBy("at.id", "at.row").agg(F.collect_list(F.struct(*key, "copies", "at.start", "at.windows")).alias("found"))
    # A row that is repeated whole opens its fragments twice; each of its windows is repeated anyway.
    pressed = map_texts(keyed.select("id", "row", "text"), _pressed, "id long, row long, text binary")
    texts = pressed.join(opened, ["id", "row"]).select("text", "found")
    edges = written(map_texts(texts, partial(_edges, window), "minimizer long, c1 long, c2 long, copies long, place byte, w1 long, w2 long"))
    twice = written(edges.groupBy("minimizer", "w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"))
    parts = edges.join(twice, ["minimizer", "w1", "w2"]).groupBy(*key).agg(F.expr("bit_or(shiftleft(1L, cast(place AS int)))").alias("mask"))
    found = written(some.join(straight.unionByName(parts), key).groupBy("id", "row").agg(F.collect_list(F.struct("start", "mask")).alias("found")))
    dropped(some, kinds, branch, edges, twice)
    return found


def _removed(window: int, found: list[dict] | None, n: int) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    for f in found or ():
        bits = np.flatnonzero((f["mask"] >> np.arange(62)) & 1) + f["start"]
        np.add.at(gone, bits, 1)
        np.add.at(gone, bits + window, -1)
    return np.cumsum(gone)[:n] > 0


def remove(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (the removed words as [start, end) pairs) and kept, the
    words that stay joined by one space; with digests, the SHA-256 of kept instead of both."""
    keyed = _keyed(docs)
    found = repeated_fragments(keyed, window, kmer)
    pressed = map_texts(keyed.select("id", "row", "text", "doc_id"), _pressed, "id long, row long, text binary, doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lost, spans, kept = [], [], [], []
            for text, fragments_of in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                gone = _removed(window, fragments_of, len(words))
                lost.append(int(gone.sum()))
                stays = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if lost[-1] else words)
                kept.append(hashlib.sha256(stays).hexdigest() if digests else stays.decode("utf-8"))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))) if lost[-1] else np.zeros(0, int)
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            last = [pa.array(kept, pa.string())] if digests else [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), *last], names)

    names = ["doc_id", "n_words", "n_removed", *(["kept_sha256"] if digests else ["spans", "kept"])]
    kind = "kept_sha256 string" if digests else "spans array<struct<start:long,end:long>>, kept string"
    joined = pressed.join(found, ["id", "row"], "left").select("doc_id", "text", "found")
    return map_texts(joined, run, f"doc_id long, n_words long, n_removed long, {kind}")


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """The documents, whole rows, with the repeated passages out of their texts; a text that
    loses nothing stays as it is, and n_chars follows the text."""
    a, b, c = fresh("id"), fresh("row"), fresh("found")
    named = _named(docs, a, b)
    found = repeated_fragments(named.select(F.col(a).alias("id"), F.col(b).alias("row"), F.col("text").cast("string").alias("text")), window, kmer)
    joined = named.join(found.toDF(a, b, c), [a, b], "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.schema.get_field_index("text"), batch.schema.get_field_index(c)
            texts = batch.column(i).to_pylist()
            for k, fragments_of in enumerate(batch.column(j).to_pylist()):
                if fragments_of:
                    words = texts[k].encode("utf-8").split()
                    gone = _removed(window, fragments_of, len(words)).tolist()
                    texts[k] = b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode("utf-8")
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type)).drop_columns([c])

    out = map_texts(joined.drop(a, b), clean, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
