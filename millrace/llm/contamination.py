"""Benchmark passages inside documents, by latent semantic retrieval and two checks.

1. Every word of every document counts for the inverse document frequencies
   over passages of ``PASSAGE`` words. Words that the benchmark lacks share
   ``SLOTS`` counters, so none of them counts as rarer than its counter: that
   can only let more windows through.
2. Items of more than ``WHOLE`` words are cut into overlapping passages, and an
   item is found where any of them is. Passages are met by windows of about
   their own length (``WINDOWS``). A randomised SVD of the benchmark's TF-IDF passages, summed over its
   partitions, gives a latent basis; benchmark passages and overlapping windows
   of documents are projected to it.
3. Windows whose latent cosine reaches ``COSINE`` are candidates; a sum of what
   each word can add at the most leaves out nearly all others unprojected. Whole
   neighbourhoods of candidates are compared by the longest common subsequence
   of words; a paraphrase may share less of it if it keeps the answer (the
   last words of the passage). Each place is judged by itself.
4. Word for word, a passage of any length is found by its first words, without
   the cosine; those of fewer than ``SHORT`` words are found in this way only.

The benchmark is a stated set of queries: it is met block by block, so what a
task holds is bounded whatever its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, bounded_batches, doc_type, id_text, union_all
from millrace.session import spread

PASSAGE, STEP = 32, 16  # words of a passage, and from one to the next
WHOLE = 60  # an item of up to so many words is one passage: 48 words of it in a row are 0.8 of it
WINDOWS = ((8, 12), (16, 24), (PASSAGE, None))  # words of a window, and below how many words a passage has it
SHORT = 8  # fewer words are no evidence unless they stand word for word
SLOTS = 1 << 14
RANK, OVERSAMPLE = 256, 16
COSINE, LCS, PARAPHRASE_LCS, ANSWER_WORDS = 0.4, 0.8, 0.6, 5
MIN_WORDS = 5
BLOCK_ITEMS = 500
MOST_CACHED = 300_000
TOKENS_AT_ONCE = 20_000
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>#*$%&|`~-_=+/\\…“”‘’«»¿¡"


def words_of(text: str) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


class WordIds(dict):
    """Raw word to number in a vocabulary, behind it one of ``SLOTS`` for a word outside; -2 for none. Remembers what it has met, up to a bound."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        word = raw.strip(EDGE)
        got = self.vocabulary.get(word, -2) if word else -2
        if word and got < 0:
            got = len(self.vocabulary) + zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
        if len(self) > MOST_CACHED:
            self.clear()
        self[raw] = got
        return got

    def of(self, text: str) -> np.ndarray:
        raw = text.lower().split()
        ids = np.fromiter(map(self.__getitem__, raw), np.int32, len(raw))
        return ids[ids > -2]


def lcs_share(wanted: np.ndarray, found: np.ndarray) -> float:
    """Longest common subsequence of two id sequences over the length of the first. Numbers below 0 meet nothing."""
    if not len(wanted):
        return 0.0
    row = np.zeros(len(found) + 1, np.int32)
    for w in wanted:
        step = row.copy()
        step[1:] = np.maximum(row[1:], np.where(found == w, row[:-1] + 1, 0))
        row = np.maximum.accumulate(step)
    return float(row[-1]) / len(wanted)


def _windows(steps: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Sums over a step and the next one of the same text."""
    out = steps.copy()
    out[:-1][follows[:-1]] += steps[1:][follows[:-1]]
    return out


def _run_hashes(x: np.ndarray) -> np.ndarray:
    """A number for every run of ``MIN_WORDS`` ids."""
    out = np.zeros(max(len(x) - MIN_WORDS + 1, 0), np.uint64)
    for k in range(MIN_WORDS):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (x[k : k + len(out)].astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Index:
    """Passages of one block of the benchmark that have windows of one length, projected."""

    window: int
    owners: list[int]  # items of the passages
    items: list[np.ndarray]  # passages
    local: np.ndarray  # row of the basis for every word id
    basis: np.ndarray  # words of the passages (one more for all others) x latent, idf included
    energy: np.ndarray  # squared idf of every word id
    latent: np.ndarray  # passages x latent, scaled so that a product over the window's norm is the cosine
    most: np.ndarray  # the most that a word id adds to that product with any passage

    def __post_init__(self):
        first = np.array([_run_hashes(x[:MIN_WORDS])[0] for x in self.items], np.uint64)
        self.order = np.argsort(first, kind="stable")
        self.first = first[self.order]

    def _runs(self, every: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, place) of all passages that stand word for word in some ids; ``ends`` are those of the texts."""
        h = _run_hashes(every)
        lo = np.searchsorted(self.first, h)
        for at in np.flatnonzero(self.first[np.minimum(lo, len(self.first) - 1)] == h):
            end = ends[np.searchsorted(ends, at, side="right")]
            for k in range(lo[at], len(self.first)):
                if self.first[k] != h[at]:
                    break
                item = self.items[self.order[k]]
                if at + len(item) <= end and np.array_equal(every[at : at + len(item)], item):
                    yield int(self.order[k]), int(at)

    def search(self, docs: list[tuple[int, np.ndarray]], cosine: float, lcs: float, paraphrase: float) -> list[tuple[int, int, float, float, float]]:
        docs = [(k, x) for k, x in docs if len(x)]
        best: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for at, (k, x) in enumerate(docs):
            if len(x) > 4 * TOKENS_AT_ONCE and len(docs) > 1:
                return [y for part in (docs[:at], docs[at : at + 1], docs[at + 1 :]) for y in self.search(part, cosine, lcs, paraphrase)]
        if not docs:
            return []
        step = self.window // 2
        starts, owner, first, offset = [], [], [], 0
        for at, (_, x) in enumerate(docs):
            s = np.arange(0, len(x), step)
            starts.append(s + offset)
            owner.append(np.full(len(s), at))
            first.append(s)
            offset += len(x)
        starts, owner, first = np.concatenate(starts), np.concatenate(owner), np.concatenate(first)
        every = np.concatenate([x for _, x in docs])
        ends = np.cumsum([len(x) for _, x in docs])
        exact: dict[tuple[int, int], float] = {}
        for i, place in self._runs(every, ends):
            at = int(np.searchsorted(ends, place, side="right"))
            exact[at, i] = max(exact.get((at, i), 0.0), self._cosine(every[place : place + len(self.items[i])], i))
        for a in range(0, len(starts), 4096):  # bounded also within one very long text; one step is shared with the next
            b = min(len(starts), a + 4097)
            lo, hi = starts[a], starts[b] if b < len(starts) else len(every)
            ids, at = every[lo:hi], starts[a:b] - lo
            follows = np.append(owner[a : b - 1] == owner[a + 1 : b], False)
            last = b - a - 1 if b < len(starts) else b - a
            norm, most = _windows(np.add.reduceat(self.energy[ids], at), follows), _windows(np.add.reduceat(self.most[ids], at), follows)
            norm = np.sqrt(np.maximum(norm, 1e-9))
            open_ = most >= (cosine - 1e-4) * norm  # the others cannot reach the cosine with any item
            open_[last:] = False
            if not open_.any():
                continue
            needed = open_ | np.concatenate([[False], open_[:-1] & follows[:-1]])
            sizes = np.diff(np.append(at, len(ids)))
            kept = ids[np.repeat(needed, sizes)]
            sums = np.add.reduceat(self.basis[self.local[kept]], np.cumsum(sizes[needed]) - sizes[needed], axis=0)
            place = np.cumsum(needed) - 1
            own = np.flatnonzero(open_)
            vectors = sums[place[own]]
            both = follows[own]
            vectors[both] += sums[place[own[both] + 1]]
            sims = (vectors @ self.latent.T) / norm[own][:, None]
            for w, i in zip(*np.nonzero(sims >= cosine), strict=True):
                best.setdefault((int(owner[a + own[w]]), int(i)), []).append((int(first[a + own[w]]), float(sims[w, i])))
        hits: dict[tuple[int, int], tuple[bool, float, float, float]] = {}
        for (at, i), sim in exact.items():
            best.pop((at, i), None)
            hits[at, self.owners[i]] = max(hits.get((at, self.owners[i]), (False,)), (True, 1.0, 1.0, sim))
        for (at, i), places in best.items():
            item, x = self.items[i], docs[at][1]
            reach, sim, done = len(item), max(s for _, s in places), -1
            if reach < SHORT:
                continue
            for place, _ in places:
                if place < done:
                    continue  # inside the neighbourhood that was just compared
                near = x[max(0, place - reach) : place + self.window + reach]
                there = set(near.tolist())
                if sum(w in there for w in item.tolist()) < paraphrase * reach:
                    continue  # no subsequence can be longer than the words that are there at all
                share = lcs_share(item, near)
                kept = lcs_share(item[-ANSWER_WORDS:], near)
                if share >= lcs or share >= paraphrase and kept == 1.0:
                    hits[at, self.owners[i]] = max(hits.get((at, self.owners[i]), (False,)), (True, share, kept, sim))
                done = place + step if share < lcs else place + reach
        return [(docs[at][0], item, sim, share, answer) for (at, item), (_, share, answer, sim) in hits.items()]

    def _cosine(self, own: np.ndarray, i: int) -> float:
        """Latent cosine of a run of ids and a passage."""
        return float(self.basis[self.local[own]].sum(axis=0) @ self.latent[i] / np.sqrt(max(self.energy[own].sum(), 1e-9)))


@dataclass
class Block:
    """A block of the benchmark: its items, and their passages by the length of the window."""

    vocabulary: dict[str, int]
    keys: list
    parts: list[Index]

    def search(self, texts: list[str], ids: WordIds, cosine: float = COSINE, lcs: float = LCS, paraphrase: float = PARAPHRASE_LCS) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, shared subsequence, shared answer) of all hits in some texts."""
        out: list[tuple[int, int, float, float, float]] = []
        if not self.parts:
            return out
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            own = ids.of(text)
            held.append((k, own))
            size += len(own)
            if size >= TOKENS_AT_ONCE:
                out += [hit for part in self.parts for hit in part.search(held, cosine, lcs, paraphrase)]
                held, size = [], 0
        return out + [hit for part in self.parts for hit in part.search(held, cosine, lcs, paraphrase)]


def _passages(words: list) -> list[list]:
    """The item itself, or overlapping passages of a long one; the last one ends with it."""
    n = len(words)
    if n <= WHOLE:
        return [words]
    return [words[k : k + PASSAGE] for k in [*range(0, n - PASSAGE, STEP), n - PASSAGE]]


def _frequencies(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = WordIds(vocabulary), len(vocabulary) + SLOTS
        found, passages = np.zeros(n, np.int64), 0
        for batch in batches:
            held = [np.zeros(0, np.int32)]
            for text in batch.column(1).to_pylist():
                x = ids.of(text)
                held += [x, np.full(-len(x) % PASSAGE, -1, np.int32)]
            rows = np.sort(np.concatenate(held).reshape(-1, PASSAGE), axis=1)  # a passage each; the last of a text is filled up with -1
            passages += len(rows)
            new = rows >= 0
            new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
            found += np.bincount(rows[new], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, n), pa.int64()), pa.array(np.concatenate([[passages], found]), pa.int64())], names=["word", "n"])

    return run


def _range_finder(vocabulary: dict[str, int], local: np.ndarray, idf: np.ndarray, window: int, width: int):
    """Partial sums of A' (A W) over the passages with one length of window, A being TF-IDF and W random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.random.default_rng(7).standard_normal((len(idf), width))
        total = np.zeros_like(start)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                if len(words) < MIN_WORDS:
                    continue
                for passage in _passages(words):
                    if _window_of(passage) == window:
                        at, n = np.unique(local[[vocabulary[w] for w in passage]], return_counts=True)
                        row = n * idf[at]
                        total[at] += row[:, None] * (row @ start[at])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["word", "z"])

    return run


def _window_of(passage: list) -> int:
    return next(w for w, below in WINDOWS if below is None or len(passage) < below)


def _index(own: DataFrame, vocabulary: dict[str, int], every: np.ndarray, window: int, passages: list[tuple[int, list[str]]]) -> Index:
    """The index of a block's passages (item and words) with one length of window; ``every`` has the idf of all word ids."""
    ids = [np.array([vocabulary[x] for x in w], np.int32) for _, w in passages]
    words = np.unique(np.concatenate(ids))
    n = len(words)
    local = np.full(len(every), n, np.int32)
    local[words] = np.arange(n)
    idf = every[words]
    width = min(RANK + OVERSAMPLE, len(ids), n)
    z = np.zeros((n, width))
    for r in sorted(arrow_map(own, _range_finder(vocabulary, local, idf, window, width), "word long, z array<double>").collect(), key=lambda r: r.word):
        z[r.word] += r.z
    q, _ = np.linalg.qr(z)
    rows = []
    for x in ids:
        at, count = np.unique(local[x], return_counts=True)
        rows.append((at, count * idf[at]))
    _, _, vt = np.linalg.svd(np.array([w @ q[at] for at, w in rows]), full_matrices=False)
    v = q @ vt.T[:, : min(RANK, width)]  # right singular vectors
    latent = np.array([w @ v[at] for at, w in rows])
    scale = np.sqrt([(w * w).sum() for _, w in rows]) / np.maximum((latent**2).sum(1), 1e-12)
    basis, latent = np.vstack([idf[:, None] * v, np.zeros(v.shape[1])]), latent * scale[:, None]
    most = np.zeros(n + 1)
    for k in range(0, len(latent), 1000):
        most = np.maximum(most, (basis @ latent[k : k + 1000].T).max(axis=1))
    return Index(window, [k for k, _ in passages], ids, local, basis.astype(np.float32), every.astype(np.float32) ** 2, latent.astype(np.float32), most.astype(np.float32)[local])


def indexes(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> Iterator[Block]:
    """One index per block of the benchmark. Items of fewer than ``MIN_WORDS`` words, and null ones, are left out: they would be found anywhere.

    All blocks share one vocabulary and one count of the documents' words.
    """
    items = id_text(benchmark, item_col, item_text, dealt=False)
    pieces = F.greatest(F.lit(1), F.ceil(F.size(F.split("text", r"\s+")) / STEP))
    (held,) = items.agg(F.sum(F.when(F.size(F.split("text", r"\s+")) > WHOLE, pieces).otherwise(1))).first()
    blocks = max(1, -(-(held or 0) // BLOCK_ITEMS))
    numbered = items.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    vocabulary: dict[str, int] = {}
    for r in items.select("text").toLocalIterator():
        w = words_of(r.text)
        for x in w if len(w) >= MIN_WORDS else []:
            vocabulary.setdefault(x, len(vocabulary))
    vocabulary = {w: k for k, w in enumerate(sorted(vocabulary))}
    n = len(vocabulary) + SLOTS
    if vocabulary:
        source = id_text(docs, id_col, text_col)
        counts = {r.word: r.n for r in arrow_map(source, _frequencies(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        idf = np.log((counts.get(-1, 0) + 2) / (np.array([counts.get(k, 0) for k in range(n)], float) + 1))
    for block in range(blocks):
        own = numbered.where(F.col("_block") == block).select("doc_id", "text")
        rows = sorted(((r.doc_id, w) for r in own.collect() if len(w := words_of(r.text)) >= MIN_WORDS), key=lambda x: (str(x[0]), x[1]))
        passages = [(k, p) for k, (_, w) in enumerate(rows) for p in _passages(w)]
        parts = [_index(own, vocabulary, idf, window, some) for window, _ in WINDOWS if (some := [x for x in passages if _window_of(x[1]) == window])]
        yield Block(vocabulary, [k for k, _ in rows], parts)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          cosine: float = COSINE, lcs: float = LCS, paraphrase: float = PARAPHRASE_LCS) -> DataFrame:
    """A row per document row and benchmark item found in it: key, ``item_id``, ``cosine``, ``lcs_share``, ``answer_share``.

    Null and empty texts hold nothing; repeated rows each give their hits; null
    keys stay; empty tables give no rows; other columns are ignored.
    """
    kind, item_kind = doc_type(docs, id_col), doc_type(benchmark, item_col)
    source = id_text(docs, id_col, text_col)

    def searcher(index: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = WordIds(index.vocabulary)
            for batch in batches:
                hits = index.search(batch.column(1).to_pylist(), ids, cosine, lcs, paraphrase)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([index.keys[h[1]] for h in hits], items_type),
                    *(pa.array([min(h[c], 1.0) for h in hits], pa.float64()) for c in (2, 3, 4))], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    items_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double"
    return union_all(arrow_map(source, searcher(index), schema) for index in indexes(docs, benchmark, id_col, text_col, item_col, item_text))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               cosine: float = COSINE, lcs: float = LCS, paraphrase: float = PARAPHRASE_LCS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark item is found."""
    at = docs.columns.index(text_col)
    out = spread(docs)
    bounded_batches(docs.sparkSession)

    def filter_(index: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = WordIds(index.vocabulary)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in index.search([t or "" for t in batch.column(at).to_pylist()], ids, cosine, lcs, paraphrase)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for index in indexes(docs, benchmark, id_col, text_col, item_col, item_text):
        out = out.mapInArrow(filter_(index), docs.schema)
    return out
