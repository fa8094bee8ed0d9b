"""BPE as a deterministic automaton over tokens, and a tokenizer that runs it.

Construction (successive merge gadgets). The first automaton has one state with a loop for
each base symbol: every sequence of symbols is accepted. A merge (u, v) -> w then rewrites
it: where an arc u leads to a state p that has an arc v to r, a copy p' of p without the arc
v is made, the arcs u are led to p' instead, and every state with an arc u gets an arc w to
r. What remains accepted are exactly the token sequences that BPE produces, one for each
text, so a text is encoded by the only path that spells it.

All arcs of one label lead to one state, so a state is named by the label that leads to it
and a version, the number of merges done when it was copied. Its missing arcs are the cuts
of that label up to that version and what its origin lacked before. The full table has a row
per label and a column per label; cells are computed from the cuts when a path first asks
for them and kept. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import columns, map_texts

#: Words and table cells kept per worker; beyond that they are computed anew.
KEPT = 400_000


def byte_symbols() -> str:
    """The printable character that stands for each byte, at its place."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in set(shown) else chr(next(spare)) for b in range(256))


class Automaton:
    """vocab: token to id; merges: pairs of tokens in order. end: what marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.end = end
        self.ids = vocab
        self.labels = {i: token for token, i in vocab.items()}
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cuts: dict[int, dict[int, int]] = {}
        made = {u + v for u, v in merges}
        for token, i in vocab.items():
            if token not in made:
                self.born[i] = 0
        for step, (u, v) in enumerate(merges, 1):
            self._gadget(step, vocab[u], vocab[v], vocab[u + v])
        self.longest = max((len(t) for t, i in vocab.items() if i in self.born), default=1)
        self.cells: dict[int, bool] = {}

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        if u not in self.born or v not in self.born or not self._arc(u, step, v):
            return  # no arc v after u: the merge never applies
        if w in self.born:
            raise ValueError("two merges make one token; arcs would not be told apart by their labels")
        self.cuts.setdefault(u, {})[v] = step
        self.born[w], self.left[w], self.right[w] = step, u, v

    def _arc(self, x: int, version: int, y: int) -> bool:
        """Does the state that label x leads to, as of this version, have an arc y?"""
        while True:
            at = self.cuts.get(x, {}).get(y)
            if at is not None and at <= version:
                return False
            if self.born[y] >= self.born[x] and y in self.left:  # added where an arc of its left part was
                version, y = min(version, self.born[y]), self.left[y]
            elif x in self.right:  # a copy of the state after its right part, made just before
                version, x = self.born[x] - 1, self.right[x]
            else:
                return True

    def follows(self, x: int, y: int) -> bool:
        key = x << 20 | y
        cell = self.cells.get(key)
        if cell is None:
            if len(self.cells) > KEPT:
                self.cells.clear()
            cell = self.cells[key] = self._arc(x, 1 << 30, y)
        return cell

    def path(self, symbols: str) -> list[int]:
        """The labels of the accepted path that spells the symbols. A prefix has one valid last
        label at most, so a place that was left once is never entered again."""
        n, last, path, starts, closed = len(symbols), -1, [], [0], set()
        ids, born, end, longest = self.ids, self.born, self.end, self.longest
        at = 0
        while at < n:
            for to in range(min(n, at + longest), at, -1):
                if to in closed:
                    continue
                label = ids.get(symbols[at:to] + end if to == n else symbols[at:to])
                if label is not None and label in born and (last < 0 or self.follows(last, label)):
                    path.append(label)
                    starts.append(to)
                    break
            else:
                if not path:
                    raise ValueError("a symbol is not in the vocabulary")
                closed.add(starts.pop())
                path.pop()
            at, last = starts[-1], path[-1] if path else -1
        return path


_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


@lru_cache(maxsize=1 << 16)
def _unknown(c: str) -> bool:
    """A character that Python's tables and the library's may treat differently: one unassigned here."""
    return unicodedata.category(c) == "Cn"


class WordTokenizer:
    """The automaton behind the normalisation, the word splitting and the special tokens of a
    word-level BPE file (NFC, lower case, white space dropped, a mark at word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("not a BPE file with word ends")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_symbols()
        self.path, self._lib = path, None
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text.lower())
        if any(map(_unknown, set(text))):
            return self.library_words(text)
        text = unicodedata.normalize("NFC", text)
        lower = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return _LONG.findall(lower)

    def library_words(self, text: str) -> list[str]:
        """By the file's own normaliser and splitter, whose tables know newer characters than Python's."""
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        text = self._lib.normalizer.normalize_str(text)
        split = self._lib.pre_tokenizer.pre_tokenize_str(text)
        byte = {c: b for b, c in enumerate(self.bytes)}
        return [bytes(map(byte.__getitem__, shown)).decode("utf-8") for shown, _ in split]

    def word_ids(self, word: str) -> list[int]:
        return self.automaton.path(word.encode("utf-8").decode("latin-1").translate(self.bytes))

    def _learn(self, word: str) -> None:
        ids = self.word_ids(word)
        self.ids_of[word] = b"".join(i.to_bytes(4, "little") for i in ids)
        self.text_of[word] = " ".join([self.labels[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the emitted arc labels."""
        if len(self.ids_of) > KEPT:
            self.ids_of.clear()
            self.text_of.clear()
        ids, out = [], []
        for part in self.split.split(text) if self.split and "<|" in text else [text]:
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                out.append(part)
                continue
            words = self.words(part)
            for w in set(words):
                if w not in self.ids_of:
                    self._learn(w)
            ids += map(self.ids_of.__getitem__, words)
            out += map(self.text_of.__getitem__, words)
        return b"".join(ids), " ".join(out)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.labels[i] for i in ids)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of ints), decoded; with digests, the SHA-256 of both instead.

    path is where every executor finds the tokenizer's file. A null text is the empty text: no
    tokens. Each document is taken alone, so ties and repeated rows need no rule; a word costs
    time in proportion to its length, so very long texts and words only take longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1):
                ids, out = tok.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                if digests:
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(out.encode("utf-8")).hexdigest())
                else:
                    first.append(memoryview(ids).cast("I").tolist())
                    second.append(out)
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = ["long", "long", "string" if digests else "array<int>", "string"]
    return map_texts(columns(docs, "doc_id", "text"), run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))
