"""Exact byte-level BPE by backtracking, and decoding by an offset table.

An Aho-Corasick automaton gives the longest vocabulary entry at every position
of a word. Entries are taken from left to right, longest first. Two neighbours
are allowed only if merging their bytes would leave the border between them
open; otherwise the next shorter entry is tried, and a position without any is
marked as dead and left for good. Every position is left at most once, so the
work is linear, and the one path that remains is what the merges give.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import PIECE, arrow_map, doc_type, id_text, keep_smaller

# How byte-level vocabularies split a text before the merges. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_CACHED = 300_000
MOST_WORDS = 600_000
MOST_PAIRS = 1_000_000
LONGEST_CACHED = 48
DECODE_IDS = 1 << 16
_CODECS: dict[str, BacktrackingCodec] = {}  # one per worker process and vocabulary


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in that byte-level vocabulary files use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BacktrackingCodec:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        plain = lambda name: "".join(chr(alphabet[c]) for c in name)  # noqa: E731  a byte per character
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # Entries are numbered by the order in which merges make them; single bytes come first.
        names = [*(c for c in alphabet if c in vocabulary), *(a + b for a, b in merges)]
        number = {name: k for k, name in enumerate(names)}
        self.singles = len(names) - len(merges)
        self.halves = [(-1, -1)] * self.singles + [(number[a], number[b]) for a, b in merges]
        self.merged = {pair: k for k, pair in enumerate(self.halves) if k >= self.singles}
        self.size = len(names)
        self.stored_id = [np.uint32(vocabulary[name]).astype("<u4").tobytes() for name in names]
        texts = [plain(name) for name in names]
        self.length = [len(t) for t in texts]
        self.allowed: dict[int, bool] = {}
        # An entry that its own bytes do not merge to can never come out.
        self.whole: dict[str, int] = {}
        for k, t in enumerate(texts):
            if k < self.singles or self._open(*self.halves[k], k):
                self.whole[t] = k
        self.shorter = [next((self.whole[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.whole), -1) for t in texts]
        self.automaton = ahocorasick.Automaton()
        for t, k in self.whole.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = {name: np.uint32(k).astype("<u4").tobytes() for name, k in special.items()}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, bytes] = {}  # of pieces between white space
        self.words: dict[str, bytes] = {}  # of the words in them
        size = max([*vocabulary.values(), *special.values()]) + 1
        stored = [b""] * size
        for name, k in vocabulary.items():
            stored[k] = plain(name).encode("latin-1")
        for name, k in special.items():
            stored[k] = name.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in stored])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(stored), np.uint8)

    def _open(self, left: int, right: int, limit: int) -> bool:
        """True if no merge numbered below ``limit`` joins the two over their border.

        Both sides are unmerged in the reverse of the order in which they were
        made; at each step the pair that then met at the border must not be one
        that would have been merged before the later of the two was finished.
        """
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < limit:
                return False
            if left > right:
                limit = left
                if left < self.singles:
                    return True
                left = self.halves[left][1]
            else:
                limit = right + 1  # of equal merges, the one further left is made first
                if right < self.singles:
                    return True
                right = self.halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        """The pair table, filled as pairs are met."""
        keep_smaller(self.allowed, MOST_PAIRS)
        got = self.allowed[left * self.size + right] = self._open(left, right, self.size)
        return got

    def word(self, word: str) -> list[int]:
        """Entry numbers of one word, given as one character per byte."""
        n, length, shorter, allowed, size = len(word), self.length, self.shorter, self.allowed, self.size
        longest = [-1] * (n + 1)
        for end, k in self.automaton.iter(word):
            longest[end - length[k] + 1] = k
        dead = bytearray(n + 1)
        out: list[int] = []
        at, k, last = 0, longest[0], -1
        while at < n:
            while k >= 0:
                end = at + length[k]
                if not dead[end]:
                    if last < 0:
                        break
                    fits = allowed.get(last * size + k)
                    if fits or fits is None and self.compatible(last, k):
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at, last, k = end, k, longest[end]
            elif out:
                dead[at] = 1
                k = out.pop()
                at -= length[k]
                last = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a byte of this text")
        return out

    def piece(self, piece: str) -> bytes:
        out = []
        for w in self.split.findall(piece):
            got = self.words.get(w)
            if got is None:
                plain = w if w.isascii() else w.encode().decode("latin-1")
                k = self.whole.get(plain)
                got = self.stored_id[k] if k is not None else b"".join([self.stored_id[k] for k in self.word(plain)])
                if len(w) <= LONGEST_CACHED:
                    self.words[w] = got
            out.append(got)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        pieces = PIECE.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    p = pieces[k]
                    got = found[k] = self.known.get(p) or self.piece(p)
                    if len(p) <= LONGEST_CACHED:
                        self.known[p] = got
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        keep_smaller(self.known, MOST_CACHED)
        keep_smaller(self.words, MOST_WORDS)
        if self.find_special is None or not self.find_special.search(text):
            return self.plain(text)
        return b"".join(self.special.get(part) or self.plain(part) for part in self.find_special.split(text) if part)

    def decode(self, ids: bytes) -> str:
        """Bytes of all entries, gathered through the offset table in blocks."""
        codes, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(codes), DECODE_IDS):
            some = codes[k : k + DECODE_IDS].astype(np.int64)
            starts = self.offsets[some]
            sizes = self.offsets[some + 1] - starts
            before = np.cumsum(sizes) - sizes
            out.append(self.bytes[np.repeat(starts - before, sizes) + np.arange(sizes.sum())].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def codec(path: str) -> BacktrackingCodec:
    if path not in _CODECS:
        _CODECS[path] = BacktrackingCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and ``ids`` (array of int) of every row. A null text counts as empty and has no ids;
    repeated rows and null keys stay; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            ids = [np.frombuffer(tool.encode(t), "<i4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(id_text(docs, id_col, text_col), run, f"doc_id {doc_type(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Key and ``text`` of rows with an array of ids. Null ids give an empty text; ids beyond the vocabulary raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            texts = [tool.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    source = encoded.select(encoded[f"`{id_col}`"].alias("doc_id"), encoded[f"`{ids_col}`"].alias("ids"))
    return arrow_map(source, run, f"doc_id {doc_type(encoded, id_col)}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Ids are hashed as little-endian unsigned 32-bit integers, decoded texts as
    UTF-8. Rows are treated as in ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = tool.encode(t)
                sizes.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(id_text(docs, id_col, text_col), run,
                     f"doc_id {doc_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
