"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. A bounded sample of labelled rows (``MOST_LABELLED``) gives the examples;
   copies of a text are one example. Every term of every example is indexed.
2. Every document of the corpus counts for the terms' document frequencies. A
   term's weight is its inverse document frequency times how strongly the
   examples' labels hang on its presence (``class_weight``): no term is dropped.
3. The examples stand in blocks of an inverted index that knows, for every term
   and block, the largest weight. A document visits blocks in the order of the
   bound on its cosine there and stops when no block can hold a better
   neighbour, so the neighbours are exact.
4. Neighbours vote with the square of their cosine. Votes become probabilities
   by a monotone fit on the examples, each judged without itself, in tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, doc_type, id_text, keep_smaller, text_key
from millrace.llm.quality import labelled_sample

TERM = re.compile(r"[^\W_]+")
MOST_LABELLED = 2_000
NEIGHBOURS, BLOCK, EVIDENCE = 25, 64, 3
WAVE = 12  # blocks looked at together; their postings fit a processor's cache
BINS = 20
MOST_CACHED = 100_000


def held_out(key: Column) -> Column:
    """Rows that never lend a label."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all the half-open spans in turn, and how many each has."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def class_weight(n: int, toxic: float, having: np.ndarray, toxic_having: np.ndarray) -> np.ndarray:
    """Square of the correlation of term and label among ``n`` examples, corrected for continuity, plus half a part in ``n``.

    The correction takes most from terms of few examples; the last part keeps
    every term, so that texts without telling terms have neighbours too.
    """
    a, b, c, d = toxic_having, having - toxic_having, toxic - toxic_having, (n - toxic) - (having - toxic_having)
    below = (a + b) * (c + d) * (a + c) * (b + d)
    above = np.maximum(np.abs(a * d - b * c) - n / 2, 0.0) ** 2
    return np.divide(above, below, out=np.zeros(len(having)), where=below > 0) + 0.5 / max(n, 1)


@dataclass
class Examples:
    """Labelled examples as a block-max inverted index.

    Entries are pairs of a block and a term in it, in the order of blocks, so
    that a block's postings lie together. Each entry has its postings and the
    largest weight among them; each term has the list of its entries.
    """

    terms: dict[str, int]
    weight: np.ndarray
    keys: list
    labels: np.ndarray
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    blocks: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # term -> its first place in ``listed``
    listed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # entries by term
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # entry -> its first posting
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def build(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> Examples:
        """Postings of sparse unit vectors (terms, weights), one per key."""
        self.blocks = -(-len(rows) // BLOCK)
        if not rows:
            self.first = np.zeros(len(self.terms) + 1, np.int64)
            return self
        term, value = np.concatenate([at for at, _ in rows]), np.concatenate([w for _, w in rows])
        example = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        order = np.lexsort((example, term, example // BLOCK))
        term, self.example, self.value = term[order], example[order], value[order]
        block = self.example // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(block) != 0)]))
        self.block, self.most, self.start = block[new], np.maximum.reduceat(self.value, new), np.append(new, len(term))
        self.listed = np.argsort(term[new], kind="stable")
        self.first = np.searchsorted(term[new][self.listed], np.arange(len(self.terms) + 1))
        return self

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order and unit weights of a text with these counts."""
        at = np.array(sorted(counts), np.int64)
        w = (1 + np.log(np.array([counts[k] for k in at.tolist()], float))) * self.weight[at]
        return at, w / np.sqrt((w * w).sum())

    def nearest(self, at: np.ndarray, w: np.ndarray, without: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Examples with the ``k`` largest cosines above 0; of equal ones those that stand first."""
        place, n = spans(self.first[at], self.first[at + 1])
        entry, x = self.listed[place], np.repeat(w, n)
        own = self.block[entry]
        bound = np.bincount(own, x * self.most[entry], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rank = np.zeros(self.blocks, np.int16 if self.blocks < 32768 else np.int64)
        rank[order] = np.arange(len(order))
        rank, falling = rank[own], -bound[order]
        by_rank = np.argsort(rank, kind="stable")
        entry, x = entry[by_rank], x[by_rank]
        edge = np.append(0, np.cumsum(np.bincount(rank, minlength=len(order))))
        found, sims, worst, lo = np.zeros(0, np.int64), np.zeros(0), 0.0, 0
        while lo < len(order):
            hi = min(lo + WAVE, len(order))
            if len(found) == k:
                hi = min(hi, int(np.searchsorted(falling, 1e-12 - worst, "right")))
            if hi <= lo:
                break
            part = entry[edge[lo] : edge[hi]]
            posting, n = spans(self.start[part], self.start[part + 1])
            s = np.bincount(self.example[posting], np.repeat(x[edge[lo] : edge[hi]], n) * self.value[posting], len(self.keys))
            if without >= 0:
                s[without] = 0.0
            good = np.flatnonzero(s > worst - 1e-12 if len(found) == k else s > 0)
            lo = hi
            if not len(good):
                continue
            found, sims = np.concatenate([found, good]), np.concatenate([sims, s[good]])
            best = np.lexsort((found, -np.round(sims, 12)))[:k]
            found, sims = found[best], sims[best]
            worst = sims[-1] if len(found) == k else 0.0
        return found, sims

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic neighbours by squared cosine; 0 without any neighbour."""
        w = sims * sims
        return float((w * self.labels[found]).sum() / w.sum()) if len(found) and w.sum() > 0 else 0.0

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.curve))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> Examples:
        """A rising curve from votes to the share of toxic examples, by pooling neighbours that fall."""
        at = np.clip((votes * BINS).astype(int), 0, BINS - 1)
        pools: list[list[float]] = []  # sum of votes, toxic, rows
        for b in range(BINS):
            own = at == b
            if not own.any():
                continue
            pools.append([votes[own].sum(), labels[own].sum(), own.sum()])
            while len(pools) > 1 and (pools[-2][1] + 0.5) / (pools[-2][2] + 1) >= (pools[-1][1] + 0.5) / (pools[-1][2] + 1):
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            self.curve = (np.array([v / n for v, _, n in pools]), np.array([(t + 0.5) / (n + 1) for _, t, n in pools]))
        return self


def index(terms: dict[str, int], having: np.ndarray, n_docs: int, keys: list, labels: np.ndarray, counts: Sequence[dict[int, int]]) -> Examples:
    """Examples with their counts of terms, ``having`` being how many of ``n_docs`` documents hold each term."""
    at = np.array([k for c in counts for k in c], np.int64)
    y = np.repeat(labels, [len(c) for c in counts])
    tells = class_weight(len(keys), float(labels.sum()), np.bincount(at, minlength=len(terms)).astype(float), np.bincount(at, y, len(terms)))
    out = Examples(terms, (np.log((n_docs + 1) / (having + 1)) + 1) * tells, [], np.zeros(0))
    rows = [(*out.vector(c), key, y) for c, key, y in zip(counts, keys, labels, strict=True) if c]
    rows.sort(key=lambda r: (int(r[0][np.argmax(r[1])]), r[2]))  # neighbours of a kind share blocks, which makes the bounds tight
    out.keys, out.labels = [r[2] for r in rows], np.array([r[3] for r in rows], float)
    return out.build([r[:2] for r in rows])


def _counts(text: str, terms: dict[str, int]) -> dict[int, int]:
    return {terms[w]: n for w, n in Counter(TERM.findall(text.lower())).items() if w in terms}


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED,
          id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Examples:
    """Index of labelled examples. Only rows outside ``held_out`` lend their label. Without labels, scores are 0.

    Copies of a text are one example with the mean of their labels. What the
    driver holds is bounded by the ``most_labelled`` rows.
    """
    sample = labelled_sample(docs, labels.where(~held_out(F.col(id_col))), label, most_labelled, id_col, text_col)
    single = sample.groupBy(text_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.avg("y").alias("y")).persist()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [Counter(TERM.findall(t.lower())) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([[*x] for x in c], pa.list_(pa.string())),
                                              pa.array([[*x.values()] for x in c], pa.list_(pa.int64()))], names=["key", "doc_id", "y", "words", "n"])

    rows = arrow_map(single, words, f"key string, doc_id {doc_type(docs, id_col)}, y double, words array<string>, n array<long>").toArrow().sort_by("key")
    listed = [r or [] for r in rows.column("words").to_pylist()]
    terms = {w: k for k, w in enumerate(sorted({w for r in listed for w in r}))}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found[[terms[w] for w in set(TERM.findall(text.lower())) if w in terms]] += 1
                n += 1
        found[-1] = n
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    whole = arrow_map(id_text(docs, id_col, text_col), frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    having = np.zeros(len(terms) + 1)
    having[whole.column("term").to_numpy()] = whole.column("n").to_numpy()
    counts = [dict(zip([terms[w] for w in r], n, strict=True)) for r, n in zip(listed, rows.column("n").to_pylist(), strict=True)]
    keys = [*zip(rows.column("doc_id").to_pylist(), rows.column("key").to_pylist(), strict=True)]
    out = index(terms, having[:-1], int(having[-1]), keys, rows.column("y").to_numpy(), counts)
    places = {key: k for k, (_, key) in enumerate(out.keys)}
    out.keys = [key for key, _ in out.keys]

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _counts(text, terms)
                v.append(out.vote(*out.nearest(*out.vector(c), without=places[key])) if c else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.float64()), batch.column(2)], names=["key", "vote", "y"])

    judged = arrow_map(single.select("key", "text", "y"), votes, "key string, vote double, y double").toArrow().sort_by("key")
    single.unpersist()
    return out.calibrate(judged.column("vote").to_numpy(), judged.column("y").to_numpy())


def score(docs: DataFrame, examples: Examples, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on), ``evidence`` (nearest examples) and ``cosines``.

    A text that shares no term with any example, an empty and a null one have no
    evidence and get the score of a vote of 0. Repeated rows get the same score; a null key is not held out;
    an empty table gives no rows; other columns are ignored. The cost of a very long text is linear in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (examples.score(0.0) if examples.keys else 0.0, [], [])
        known: dict[bytes, tuple] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                key = hashlib.md5(text.encode(), usedforsecurity=False).digest()
                if key not in known:
                    keep_smaller(known, MOST_CACHED)
                    counts = _counts(text, examples.terms)
                    found, sims = examples.nearest(*examples.vector(counts)) if counts else (np.zeros(0, int), np.zeros(0))
                    known[key] = (examples.score(examples.vote(found, sims)), [examples.keys[k] for k in found[:EVIDENCE]],
                                  np.minimum(sims[:EVIDENCE], 1.0).tolist()) if len(found) else nothing
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(batch.column(0).type)),
                                              pa.array([x[2] for x in out], pa.list_(pa.float64()))], names=["doc_id", "score", "evidence", "cosines"])

    kind = doc_type(docs, id_col)
    out = arrow_map(id_text(docs, id_col, text_col), run, f"doc_id {kind}, score double, evidence array<{kind}>, cosines array<double>")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "cosines")
