"""SimHash near-duplicates through pivot distance tables.

1. Fingerprint each whole text; equal fingerprints fold to one node with its least doc_id and
   its count, so copies cost one row from here on.
2. Fingerprints that differ in at most ``radius`` bits agree in some ``m - radius`` of ``m``
   blocks of bits, whichever bits differ, so rows meet under each choice of blocks; no link is
   lost. m grows with the number of fingerprints, so that a meeting place holds few of them.
3. Pivot distance tables: every fingerprint carries its Hamming distances to ``PIVOTS`` fixed
   reference fingerprints. Two fingerprints differ by at least the greatest difference
   between their coordinates, so a pair with a difference over the radius is discarded. Rows
   are sorted by the first coordinate, which bounds the candidates to a band; the other
   coordinates thin the band, and the survivors are verified bit by bit.
4. A meeting place passes on a spanning forest of its links, never all pairs. One with more
   than ``BLOCK`` rows is cut into blocks, and each pair of blocks is a place of its own.
5. Connected components of the links give every document the least doc_id reachable.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns, cut, dropped, fresh, gathered, map_texts, released, words_of, written
from .components import components

BITS, PIVOTS, BLOCK = 64, 16, 2048
#: Counters of near_copies' sketch, the rows that carry them, and salts of common shingles.
SKETCH, PIECES, SALTS = 1 << 19, 64, 16
#: Rows of other tables that one with a set of shingles counts as.
SET_ROWS = 16
#: Bits of the marks of ids.
MARK_BITS = 23
MARKS = 1 << MARK_BITS
PLACE = ["place", "i", "j"]
ROW = [*PLACE, "side", "key", "fp", "size", "root"]
#: Rows of a place whose pairs are compared at once, such pairs in memory, and rows taken together.
SMALL, PAIRS, TOGETHER = 128, 1 << 18, 1 << 13


def hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The hashes of a text's shingles in their order, as rows of bytes."""
    words = words_of(ascii_lower(text)) if text else []
    if not words:
        return np.zeros((0, 8), np.uint8)
    if len(words) < shingle:
        parts = [" ".join(words)]
    else:
        parts = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(p.encode("utf-8", "surrogatepass"), seed) for p in parts]), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    return _print(hashes(text, shingle, seed))


def _print(raw: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). No word, or a null text: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_texts(columns(docs, "doc_id", "text"), run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, drawn once from a seeded generator."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64)


def blocks_for(n: int, radius: int) -> list[tuple[int, ...]]:
    """The choices of blocks, each as the bits that two fingerprints then share: the least number
    of blocks for which n fingerprints are fewer than the values that a choice can take."""
    m = radius + 2
    while m < 4 * radius and (m - radius) * (BITS // m) < np.log2(max(n, 2)) + 1:
        m += 1
    edge = [i * BITS // m for i in range(m + 1)]
    bits = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(m)]
    return [sum(bits[i] for i in some) for some in combinations(range(m), m - radius)]


def _forest(fp: np.ndarray, radius: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints, through the pivot table."""
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    up = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(fp) - 1):
        j = np.arange(i + 1, up[i])
        for lo in range(1, table.shape[1], 5):
            if not len(j):
                break
            j = j[np.abs(table[j, lo : lo + 5] - table[i, lo : lo + 5]).max(axis=1) <= radius]
        for k in j[np.bitwise_count(fp[j] ^ fp[i]) <= radius].tolist():
            if (a := root(i)) != (b := root(k)):
                parent[b] = a
                out.append((int(fp[i].view(np.int64)), int(fp[k].view(np.int64))))
    return out


def _solve(place: np.ndarray, fp: np.ndarray, radius: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """Links among rows that are sorted by place."""
    edge = np.flatnonzero(np.diff(place, axis=0).any(axis=1)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
    size = end - begin
    pairs = begin[size == 2]
    x, y = fp[pairs], fp[pairs + 1]
    far = np.zeros(len(x), np.int64)
    for r in refs:  # the pivot table, a coordinate at a time
        far = np.maximum(far, np.abs(np.bitwise_count(x ^ r).astype(np.int64) - np.bitwise_count(y ^ r)))
    near = (far <= radius) & (x != y)
    near[near] = np.bitwise_count(x[near] ^ y[near]) <= radius
    out = list(zip(x[near].view(np.int64).tolist(), y[near].view(np.int64).tolist(), strict=True))
    for a, b in zip(begin[size > 2], end[size > 2], strict=True):
        out += _forest(np.unique(fp[a:b]), radius, refs)
    return out


def _links(radius: int, refs: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by place; the rows of a place may come in several batches."""

    def links(place: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        found = np.array(_solve(place, fp, radius, refs), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    places, prints = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
        places.append(place)
        prints.append(batch.column(4).to_numpy().view(np.uint64))
        if (place[0] == place[-1]).all() and (places[0][0] == place[-1]).all():
            continue  # one place so far
        place, fp = np.concatenate(places), np.concatenate(prints)
        last = int(np.flatnonzero((place != place[-1]).any(axis=1))[-1]) + 1
        yield links(place[:last], fp[:last])
        places, prints = [place[last:].copy()], [fp[last:].copy()]
    if places:
        yield links(np.concatenate(places), np.concatenate(prints))


def links(nodes: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that join all that are within the radius."""
    choices = F.array(*[F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("place")) for c, m in enumerate(blocks_for(n, radius))])
    rows = nodes.select("fp", F.explode(choices).alias("at")).select("at.choice", "at.place", "fp")
    counts = cut(rows.groupBy("choice", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = rows.join(counts, ["choice", "place"])
    # a place of more than BLOCK rows: every pair of its blocks is a place of its own
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    with_all = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    placed = met.select("choice", "place", "fp", F.explode(with_all).alias("of")).select("choice", "place", "of.i", "of.j", "fp")
    sorted_rows = placed.repartition("choice", "place", "i", "j").sortWithinPartitions("choice", "place", "i", "j")
    return map_texts(sorted_rows, partial(_links, radius, pivots()), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id, group_size: one row per document.

    Defined cases: texts without words (null ones too) all have fingerprint zero and are linked
    like any others; a null doc_id is no candidate for a component_id unless all are null; rows
    repeated with one doc_id count each; an empty table gives no rows."""
    prints = cut(fingerprints(docs, shingle, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    found = components(cut(links(nodes, nodes.count(), radius)))
    rooted = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written out, so that the join with the largest component's fingerprints can be split
    heads = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("group_size")))
    known = rooted.select("fp", "root").join(heads, "root").select("fp", "component_id", "group_size")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id", "group_size")


def _set(raw: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct hashes in order, and a key that texts with the same ones share."""
    found = np.unique(np.ascontiguousarray(raw).view(np.uint64).ravel())
    return found, xxhash.xxh3_64_intdigest(found.tobytes())


def _longs(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _signatures(shingle: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; and at the end this task's counts of shingles by their hashes modulo
    SKETCH, in PIECES rows with a piece."""
    names = ["doc_id", "fp", "key", "size", "piece", "counts"]
    held = np.zeros(SKETCH, np.int64)
    for batch in batches:
        fp, keys, sets = [], [], []
        for t in batch.column(1):
            raw = hashes(t.as_py(), shingle, seed)
            found, key = _set(raw)
            fp.append(_print(raw))
            keys.append(key)
            sets.append(found)
        if sets:
            held += np.bincount((np.concatenate(sets) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        n = len(keys)
        yield pa.RecordBatch.from_arrays([batch.column(0), _longs(fp), _longs(keys), pa.array(list(map(len, sets)), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    if held.any():
        none = pa.nulls(PIECES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(held, PIECES)], pa.binary())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[piece] = total.get(piece, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "counts"])


def _prefixes(shingle: int, seed: int, similarity: float, sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set, as many as its size asks for, in one order for all sets: by the
    sketch's rank, rare ones first, then by hash. A set is sent once by a task. salt: of common ones."""
    rank, common = sent.value
    seen: set[int] = set()
    for batch in batches:
        out: list[list] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]]
        for t in batch.column(0):
            found, key = _set(hashes(t.as_py(), shingle, seed))
            n = len(found)
            if not n or key in seen:
                continue
            seen.add(key)
            at = rank[found % np.uint64(SKETCH)]
            first = np.argsort(at, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
            out[0].append(found[first])
            out[1].append(np.full(len(first), key, np.uint64))
            out[2].append((at[first] >= common) * np.int32(1 + key % SALTS))
        parts = [np.concatenate(x) for x in out]
        yield pa.RecordBatch.from_arrays([_longs(parts[0]), _longs(parts[1]), pa.array(parts[2].astype(np.int32))], ["shingle", "key", "salt"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shingle and key: those of shingles with two keys or more, and of salted ones."""
    last, sent = None, True  # the row before, and whether it was sent
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, key, salt = (batch.column(i).to_numpy() for i in range(3))
        if last is not None:
            shingle, key, salt = np.r_[last[0], shingle], np.r_[last[1], key], np.r_[last[2], salt]
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])]
        if last is not None:
            new[0] = not sent
        same = shingle[1:] == shingle[:-1]
        two = same & (key[1:] != key[:-1])
        group = np.r_[0, np.cumsum(~same)]
        many = np.zeros(group[-1] + 1, bool)
        many[group[1:][two]] = True
        if last is not None and sent:
            many[0] = True
        go = new & (many[group] | (salt > 0))
        yield pa.RecordBatch.from_arrays([pa.array(shingle[go]), pa.array(key[go])], ["shingle", "key"])
        # of a group of one key so far, its row waits for the next batch
        last, sent = (shingle[-1:], key[-1:], salt[-1:]), bool(many[group[-1]] or salt[-1] > 0)


def _pairs(t: pa.Table, radius: int, similarity: float, refs: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a place with those rows of other labels that are within the radius and the bounds of
    size. The caller may join labels on the way; rows of the largest component only meet the others."""
    fp, size, root, side = (t[c].to_numpy() for c in ("fp", "size", "root", "side"))
    fp = fp.view(np.uint64)
    one = t["i"][0].as_py() == t["j"][0].as_py()
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)
    value, count = np.unique(root, return_counts=True)
    most = value[np.argmax(count)]
    for x in (np.flatnonzero(root != most) if one else np.flatnonzero(side == 0)).tolist():
        y = (label != label[x]) & (root != root[x])
        y &= (root == most) | (np.arange(len(fp)) > x) if one else side == 1
        y = np.flatnonzero(y)
        y = y[np.abs(table[y] - table[x]).max(axis=1) <= radius]  # the pivots
        y = y[np.bitwise_count(fp[y] ^ fp[x]) <= radius]
        y = y[np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x])]
        if len(y):
            yield x, y


def _joined(t: pa.Table, radius: int, similarity: float, refs: np.ndarray, sets: list[np.ndarray] | None) -> pa.RecordBatch:
    """A spanning forest of a place's pairs of different components: of all that might be links, or with
    the sets of those that are."""
    key, out = t["key"].to_numpy(), []
    # what might be linked connects rows, what is linked connects their components
    label = np.arange(len(key)) if sets is None else np.unique(t["root"].to_numpy(), return_inverse=True)[1]
    for x, near in _pairs(t, radius, similarity, refs, label):
        for y in near.tolist():
            if label[x] != label[y]:
                if sets is not None:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both < similarity * (len(sets[x]) + len(sets[y]) - both):
                        continue
                label[label == label[y]] = label[x]
                out.append((int(key[x]), int(key[y])))
    found = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _forest_of(rows: np.ndarray, radius: int, similarity: float, refs: np.ndarray) -> pa.RecordBatch:
    """Spanning forests of the pairs that might be links, of whole places (columns ROW). The pairs of
    places of up to SMALL rows are compared together, those of larger places a row at a time."""
    i, j, side, key, fp, size, root = rows[1:]
    bits = fp.view(np.uint64)
    table = np.bitwise_count(bits[None, :] ^ refs[:, None]).astype(np.int16)
    edge = np.flatnonzero(np.diff(rows[:3], axis=1).any(axis=0)) + 1
    begin, count = np.r_[0, edge], np.diff(np.r_[0, edge, len(key)])
    parent = list(range(len(key)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for m in np.unique(count[(count > 1) & (count <= SMALL)]).tolist():
        left, right = np.triu_indices(m, 1)
        at, step = begin[count == m], max(1, PAIRS // len(left))
        for lo in range(0, len(at), step):
            x, y = ((at[lo : lo + step, None] + k[None, :]).ravel() for k in (left, right))
            go = (root[x] != root[y]) & ((i[x] == j[x]) | (side[x] != side[y]))
            x, y = x[go], y[go]
            for distance in table:  # the pivots
                go = np.abs(distance[x] - distance[y]) <= radius
                x, y = x[go], y[go]
            go = np.bitwise_count(bits[x] ^ bits[y]) <= radius
            x, y = x[go], y[go]
            go = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
            for p, q in zip(x[go].tolist(), y[go].tolist(), strict=True):
                if (r := top(p)) != (t := top(q)):
                    parent[t] = r
                    a.append(p)
                    b.append(q)
    parts = [pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], ["a", "b"])] if a else []
    for lo, n in zip(begin[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
        parts.append(_joined(pa.table(list(rows[:, lo : lo + n]), names=ROW), radius, similarity, refs, None))
    none = pa.nulls(0, pa.int64())
    whole = pa.Table.from_batches([pa.RecordBatch.from_arrays([none, none], ["a", "b"]), *parts]).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in whole.columns], ["a", "b"])


def _across(radius: int, similarity: float, refs: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forests of all places. Rows (columns ROW) come sorted by place, and those of a place may come
    in several batches; TOGETHER rows or more are taken at a time, up to the end of a place."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
        last = held[-1][:3, -1:]
        if sum(h.shape[1] for h in held) < TOGETHER or (held[0][:3, :1] == last).all():
            continue
        rows = np.concatenate(held, axis=1)
        end = int(np.flatnonzero((rows[:3] != last).any(axis=0))[-1]) + 1
        yield _forest_of(rows[:, :end], radius, similarity, refs)
        held = [rows[:, end:].copy()]
    if held:
        yield _forest_of(np.concatenate(held, axis=1), radius, similarity, refs)


def _within(radius: int, similarity: float, refs: np.ndarray, t: pa.Table) -> pa.RecordBatch:
    return _joined(t, radius, similarity, refs, [np.asarray(x.values).view(np.uint64) for x in t["shingles"]])


def _placed(rows: DataFrame, counts: DataFrame, place: str) -> DataFrame:
    """Rows at their places; of a place of more than BLOCK rows (n), every pair of blocks is one of its own."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), parts).cast("int")
    with_all = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own > k).cast("int").alias("side")))
    met = rows.join(counts, place).select(F.col(place).alias("place"), "key", "fp", "size", "root", F.explode(with_all).alias("of"))
    return met.select("place", "of.i", "of.j", "of.side", "key", "fp", "size", "root")


def _by_place(fn: Callable, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls fn with the rows of each place; they come sorted by place, over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(names.index(c)).to_numpy() for c in PLACE], axis=1).astype(np.int64)
        edge = [0, *(np.flatnonzero(np.diff(place, axis=0).any(axis=1)) + 1).tolist(), len(place)]
        for a, b in zip(edge, edge[1:], strict=False):
            if held and tuple(place[a]) != last:
                yield fn(pa.Table.from_batches(held))
                held = []
            last = tuple(place[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield fn(pa.Table.from_batches(held))


def near_copies(docs: DataFrame, radius: int, shingle: int, similarity: float, seed: int = 42) -> DataFrame:
    """doc_id, component_id: one row per document. Two documents are linked if their fingerprints
    differ in at most radius bits and their sets of shingles have at least this Jaccard similarity.

    At a wide radius choices of blocks discard hardly a pair, so sets meet by their prefixes instead:
    in any fixed order of all shingles, two sets of Jaccard similarity s share one of the first
    n - ceil(s n) + 1 shingles of each, n being its size. The order puts shingles first that few
    documents hold, by a sketch of fixed size, so that shared passages seldom bring sets together.
    Where sets meet, they are first held against one of them, whose prefix meets most others (as that
    of a text does that the others were copied from). Then, of those that are in different components
    still, pivots, fingerprints and sizes tell which might be linked; what these pairs connect is a family, which meets once, in blocks,
    and its sets are compared until it is connected or no pair is left. All links are verified by
    whole sets.

    Documents with one set of shingles are one class, whose fingerprint is the least of theirs.
    Null and empty texts have no shingles and are linked to each other only; a null doc_id is no
    candidate for a component_id unless all are null; repeated rows are of one class; very long
    texts only have longer sets; an empty table gives no rows."""
    rows = columns(docs, "doc_id", "text")
    out = written(map_texts(rows, partial(_signatures, shingle, seed), "doc_id long, fp long, key long, size long, piece int, counts binary"))
    prints = out.where("piece IS NULL").select("doc_id", "fp", "key", "size")
    held = np.zeros((PIECES, SKETCH // PIECES), np.int64)
    for r in map_texts(out.where("piece IS NOT NULL").select("piece", "counts").repartition("piece"), _summed, "piece int, counts binary").toLocalIterator():  # PIECES rows
        held[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    rank = lambda n: np.floor(4 * np.log2(n + 1.0)).astype(np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast((rank(held.ravel()), rank(4 * held.mean() + 1000)))  # SKETCH bytes
    first = map_texts(rows.select("text"), partial(_prefixes, shingle, seed, similarity, sent), "shingle long, key long, salt int")
    kept = map_texts(first.repartition("shingle", "salt").sortWithinPartitions("shingle", "key"), _shared, "shingle long, key long")
    nodes = prints.groupBy("key").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("doc_id").alias("least"))
    met = written(kept.distinct().join(nodes.drop("least"), "key").select("shingle", "key", "fp", "size"))
    # a text that others were copied from has few shingles of its own, so its prefix meets most others
    many, texts = met.count(), prints.count()  # bounds on what follows
    holders = cut(met.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), many)
    scores = cut(met.join(holders, "shingle").groupBy("key").agg(F.sum("n").alias("score")), texts)
    met_by = written(gathered(met.join(scores, "key"), many))
    released(met_by)

    def sets_of(keys: DataFrame, n: int) -> DataFrame:
        ids = _marks(keys.join(nodes, "key").select("least"))
        found = map_texts(rows, partial(_sets, shingle, seed, ids), "key long, shingles array<long>")
        return written(gathered(found.join(keys, "key", "left_semi").dropDuplicates(["key"]), n * SET_ROWS))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        n = pairs.count()
        sets = sets_of(cut(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), min(2 * n, texts)), min(2 * n, texts))
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        out = cut(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), n)
        dropped(sets)
        return out

    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("at.fp"))) <= radius) & (F.least("size", "at.size") >= similarity * F.greatest("size", "at.size"))
    heads = cut(met_by.groupBy("shingle").agg(F.max(F.struct("score", "key", "fp", "size")).alias("at")), many)
    stars = met_by.join(heads, "shingle").where((F.col("key") != F.col("at.key")) & near)
    links = linked(stars.select(F.least("at.key", "key").alias("a"), F.greatest("at.key", "key").alias("b")).distinct())
    labels = components(links, gather=True)
    rooted = met_by.join(labels.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = cut(rooted.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle", "n"), many)
    ordered = _placed(rooted, open_, "shingle").select(*ROW).repartition(*PLACE).sortWithinPartitions(*PLACE)
    maybe = cut(map_texts(ordered, partial(_across, radius, similarity, pivots()), "a long, b long").distinct())
    # what might be linked, over whatever chain of others, is one place now, and its sets decide
    family = cut(components(maybe, gather=True).toDF("key", "family").join(rooted.select("key", "fp", "size", "root").distinct(), "key"), texts)
    n = family.count()
    of = cut(family.groupBy("family").agg(F.count(F.lit(1)).alias("n")), n)
    sets = sets_of(cut(family.select("key"), n), n)
    met_again = _placed(family, of, "family").join(sets, "key").select(*ROW, "shingles").repartition(*PLACE).sortWithinPartitions(*PLACE)
    released(sets)
    more = cut(map_texts(met_again, partial(_by_place, partial(_within, radius, similarity, pivots()), [*ROW, "shingles"]), "a long, b long").distinct())
    dropped(sets)
    found = labels if more.isEmpty() else components(links.union(more), gather=True)
    rooted = nodes.join(found.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # written out, like hooks in components(), so that a large group's join can be split
    tops = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), texts)
    known = cut(rooted.select("key", "root").join(tops, "root").select("key", "component_id"), texts)
    dropped(met, met_by)
    return prints.join(known, "key").select("doc_id", "component_id")


def _marks(ids: DataFrame):
    """A broadcast of MARKS bits, of which those are set that hashes of the ids give. It only saves
    work: what passes by chance goes at the join that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS, bool)
        for batch in batches:
            bits[_mark(batch.column(0).drop_null().to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["bits"])

    total = np.zeros(MARKS // 8, np.uint8)
    for r in ids.repartition(PIECES).mapInArrow(run, "bits binary").toLocalIterator():  # PIECES rows
        total |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(total.tobytes())


def _mark(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _sets(shingle: int, seed: int, sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool)
    for batch in batches:
        ids = batch.column(0)
        go = bits[_mark(ids.fill_null(0).to_numpy())] | ids.is_null().to_numpy(zero_copy_only=False)
        found = [_set(hashes(t.as_py(), shingle, seed)) for t in batch.column(1).filter(pa.array(go))]
        flat = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.uint64)
        edge = np.cumsum([0, *(len(f) for f, _ in found)])
        yield pa.RecordBatch.from_arrays([_longs([k for _, k in found]), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), _longs(flat))], ["key", "shingles"])


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """The documents, whole rows, of which each is the least doc_id of its group: that of
    near_duplicates, or with a similarity that of near_copies. A doc_id that stands in several rows
    stays, with all of them, if it is the least of any of their groups."""
    found = near_duplicates(docs, radius, shingle, seed) if similarity is None else near_copies(docs, radius, shingle, similarity, seed)
    key = fresh("id")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay[key]), "left_semi")
