"""Best-fit packing of documents into sequences, by exact-complement hashing.

Only lengths matter to where a piece goes, so the plan is made on the table of lengths (as
many entries as a sequence has tokens, whatever the corpus holds) and then dealt out:

1. tokenize: one row per piece with its length, written to the shared folder;
2. count the pieces of each length, and in each shard of a length (about ``SHARD`` pieces);
3. plan: from the longest length down, fill the gap that it leaves exactly by one, two or
   three lengths looked up by their sum, as long as enough of each are left; where no
   combination fits, put in the longest that fits and look again. A pattern is used as often
   as the counts allow, so the plan is a short list of patterns with repetitions;
4. number the pieces of each length (a shard's offset plus a rank in the shard, so that a
   length that a third of all pieces has is still numbered in parallel) and look up each
   number's sequence and offset in the plan.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_automaton import byte_symbols
from .common import columns, map_texts, written

CAPACITY = 2048
#: Pieces of one length that are numbered together, about, unless that made more than SHARDS shards.
SHARD, SHARDS = 2_000, 200_000

#: The split that byte-level BPE files of this kind ask for with use_regex.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokenizer:
    """The ids of the tokenizers library for a byte-level BPE file. Its vocabulary, whose ids are
    in the order of the merges, is run by tiktoken, which gives the same ids several times
    faster; texts with the string of a special token go to the library itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.path, self._lib = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @property
    def lib(self):
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        return self._lib

    def _by_library(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._by_library(text)
        try:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its splitter gives up on runs of millions of white space characters
            return self._by_library(text)
        return np.asarray(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids): each document's tokens and an end
    token, cut only where they exceed the capacity; the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        tail = int(end).to_bytes(4, "little")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in names]
            for key, text in zip(keys, batch.column(1), strict=True):
                raw = memoryview(tok.encode(text.as_py() or "") + tail)
                n, at, k = len(raw) // 4, 0, 0
                while at < n:
                    size = (n % capacity or min(n, capacity)) if k == 0 else capacity
                    part = raw[4 * at : 4 * (at + size)]
                    for column, value in zip(out, (key, k, at, size, zlib.crc32(part), part.cast("I").tolist() if ids else None), strict=False):
                        column.append(value)
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
    return map_texts(columns(docs, "doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


class _Sums:
    """Which lengths are left, and the combinations of up to three of them with a given sum."""

    def __init__(self, counts: np.ndarray, even: bool = False):
        self.counts = counts
        self.most = len(counts) - 1
        self.even = even

    def _pair(self, total: int, used: dict[int, int], top: int) -> tuple[int, int] | None:
        """a >= b with a + b = total and enough of both left beside those used; a is as long as can
        be, or as short with even."""
        hi = min(total - 1, top)
        lo = (total + 1) // 2
        if hi < lo:
            return None
        left = self.left(used)
        a = np.arange(lo, hi + 1) if self.even else np.arange(hi, lo - 1, -1)
        ok = (left[a] > 0) & (left[total - a] > 0) & ((2 * a != total) | (left[a] > 1))
        k = int(np.argmax(ok))
        return (int(a[k]), int(total - a[k])) if ok[k] else None

    def left(self, used: dict[int, int]) -> np.ndarray:
        if not used:
            return self.counts
        left = self.counts.copy()
        for x, n in used.items():
            left[x] -= n
        return left

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        left = self.left(used)
        if gap <= self.most and left[gap] > 0:
            return [gap]
        if two := self._pair(gap, used, self.most):
            return list(two)
        for a in np.flatnonzero(left[: max(gap - 1, 0)])[::-1]:
            a = int(a)
            if 3 * a < gap:
                break
            if two := self._pair(gap - a, used | {a: used.get(a, 0) + 1}, a):
                return [a, *two]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, how many such sequences), for counts of pieces by length. Of a few
    ways to choose among combinations, the first that meets the bound, else the best."""
    bound, best = -(-sum(x * n for x, n in counts.items()) // capacity), None
    for even in (False, True):
        for spare in (0, 1, 2, 4):
            found = _plan(counts, capacity, even, spare)
            if best is None or sum(t for _, t in found) < sum(t for _, t in best):
                best = found
            if sum(t for _, t in best) == bound:
                return best
    return best


def _plan(counts: dict[int, int], capacity: int, even: bool, spare: int) -> list[tuple[list[int], int]]:
    """spare: how many lengths a sequence takes whole, largest first, before it looks for an exact
    complement."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    sums, out = _Sums(left, even), []
    for size in range(capacity, 0, -1):
        while left[size] > 0:
            pattern, used, gap = [size], {size: 1}, capacity - size
            while gap > 0:
                if len(pattern) > spare and (fill := sums.exact(gap, used)):
                    pattern += fill
                    break
                fits = np.flatnonzero(sums.left(used)[: gap + 1] > 0)
                if not len(fits):
                    break
                x = int(fits[-1])
                pattern.append(x)
                used[x] = used.get(x, 0) + 1
                gap -= x
            each = {x: pattern.count(x) for x in pattern}
            times = min(int(left[x]) // n for x, n in each.items())
            for x, n in each.items():
                left[x] -= n * times
            out.append((pattern, times))
    return out


def runs(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Per length, which of its numbers go where, as rows (length, first, sequence, offset): number
    first + i, for i under the pattern's times, lies in sequence + i at offset. In order."""
    rows, sequence, done = [], 0, {}
    for pattern, times in patterns:
        at = 0
        for x in pattern:
            rows.append((x, done.get(x, 0), sequence, at))
            done[x] = done.get(x, 0) + times
            at += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity).

    Ties: pieces of one length are interchangeable and numbered by doc_id and piece within a
    shard. An empty table packs into nothing. The plan that goes to the executors has at most
    a few entries for each length, so its size doesn't grow with the corpus."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    wide = max(SHARD, sum(counts.values()) // SHARDS)
    shards = np.array([max(1, -(-counts.get(size, 0) // wide)) for size in range(capacity + 1)])
    slot = np.cumsum(shards) - shards  # slot[length] + shard numbers all shards
    of = F.element_at(F.lit(shards.tolist()), F.col("length").cast("int") + 1)
    sharded = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), of).cast("long"))
    base, done = np.zeros(int(shards.sum()), np.int64), np.zeros(capacity + 1, np.int64)
    for r in sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "shard").collect():  # at most SHARDS and one per length
        base[slot[r["length"]] + r["shard"]] = done[r["length"]]
        done[r["length"]] += r["n"]
    where = runs(plan(counts, capacity))
    edge = np.searchsorted(where[:, 0], np.arange(capacity + 2))
    sent = spark.sparkContext.broadcast((slot, base, where[:, 1], where[:, 2], where[:, 3], edge))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, base, firsts, sequences, offsets, edge = sent.value
        top = int(firsts.max(initial=0)) + 1
        length_of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        key = length_of * top + firsts
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("length")).to_numpy()
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            number = base[slot[size] + shard] + batch.column(batch.schema.get_field_index("rank")).to_numpy() - 1
            k = np.searchsorted(key, size * top + np.minimum(number, top - 1), side="right") - 1
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequences[k] + number - firsts[k]), pa.array(offsets[k])], [*names, "sequence_id", "offset"])

    names = list(found.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema), "sequence_id long", "offset long"])
    ranked = sharded.withColumn("rank", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", *(c for c in ("ids_crc32",) if c in names))).cast("long"))
    return ranked.mapInArrow(place, schema)


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is its end token alone. Rows repeated with one doc_id are packed each."""
    return pack(written(pieces(docs, path, capacity)), capacity)
