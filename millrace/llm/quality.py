"""Quality rules: fixed limits, and gradient-boosted trees over statistics of the text.

The trees are fitted on a bounded sample of labelled rows (``MOST_LABELLED``, in
the order of a hash of the key), flattened into arrays and scored for a whole
batch level by level. Chosen statistics can only push the verdict one way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, bounded_batches, doc_type, id_text
from millrace.session import spread

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MOST_REPEATED = 10, 20  # words; percent of words in repeated windows
MOST_LABELLED = 20_000
TREES, DEPTH, RATE, BINS, RIDGE, LEAF_ROWS = 60, 3, 0.2, 48, 2.0, 25
THRESHOLD = 0.35  # least probability of good quality: a doubtful document is kept
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistic, and its allowed direction: -1 more of it never raises quality, 1 never lowers it, 0 free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "digit_share": 0, "upper_share": 0, "stops_per_word": 0, "words_per_line": 0, "short_word_share": 0, "letter_share": 1,
}


def repeated_words(words: list[str]) -> int:
    """Words inside any window of five words that is found twice or more in the text, its first place included."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False)) if len(words) >= WINDOW else []
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered, end = 0, 0
    for k, w in enumerate(windows):
        if found[w] > 1:
            covered += k + WINDOW - max(end, k)
            end = k + WINDOW
    return covered


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five counts, and the values of ``FEATURES``."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    size = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, chars = len(words), sum(map(len, words))
    symbols, dup, repeat = int(size[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words)
    upper, lower, digit, wide = int(size[65:91].sum()), int(size[97:123].sum()), int(size[48:58].sum()), int(size[192:].sum())
    each, ink = max(n, 1), max(chars, 1)
    return [n, chars, symbols, dup, repeat], [
        np.log1p(n), chars / each, symbols / each, dup / max(len(lines), 1), repeat / each, len(set(words)) / each,
        digit / ink, upper / ink, int(size[[46, 33, 63]].sum()) / each, n / max(len(lines), 1),
        sum(1 for w in words if len(w) < 4) / each, (upper + lower + wide) / ink]


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Rows of the five counts that the fixed limits reject."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    border: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.border[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, direction: np.ndarray) -> Trees:
    """Boosted trees on the logistic loss. A split against a feature's direction is not taken, and
    what lies below a split stays on its side of the middle between the two sides' values."""
    rate = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(rate / (1 - rate)))
    nodes: list[list[float]] = []  # feature, border, left, right, value
    roots = []
    borders = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    bins = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T, strict=True)]) if len(y) else np.zeros((x.shape[1], 0), int)
    total = np.full(len(y), start)

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[rows], weight[rows]
        own = float(np.clip(-g.sum() / (h.sum() + RIDGE), low, high))
        here = len(nodes)
        nodes.append([0, np.inf, here, here, RATE * own])
        best = (1e-6, None)
        if level < DEPTH and len(rows) >= 2 * LEAF_ROWS:
            for f, b in enumerate(borders):
                if not len(b):
                    continue
                k = bins[f][rows]
                gs, hs, ns = (np.cumsum(np.bincount(k, w, minlength=len(b) + 1))[:-1] for w in (g, h, None))
                vl, vr = -gs / (hs + RIDGE), -(g.sum() - gs) / (h.sum() - hs + RIDGE)
                gain = gs**2 / (hs + RIDGE) + (g.sum() - gs) ** 2 / (h.sum() - hs + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
                gain[(ns < LEAF_ROWS) | (len(rows) - ns < LEAF_ROWS) | (direction[f] * (vr - vl) < 0)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), (f, at, float(vl[at]), float(vr[at])))
        if best[1]:
            f, at, vl, vr = best[1]
            middle = float(np.clip((vl + vr) / 2, low, high))
            goes_left = bins[f][rows] <= at
            left_range = (low, middle) if direction[f] > 0 else (middle, high) if direction[f] < 0 else (low, high)
            right_range = (middle, high) if direction[f] > 0 else (low, middle) if direction[f] < 0 else (low, high)
            left = grow(rows[goes_left], level + 1, *left_range)
            right = grow(rows[~goes_left], level + 1, *right_range)
            nodes[here][:4] = [f, float(borders[f][at]), left, right]
        else:
            total[rows] += nodes[here][4]
        return here

    for _ in range(TREES if len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    flat = np.array(nodes, float).reshape(-1, 5)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), start, DEPTH)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``text``, ``y``) of at most ``most`` labelled rows. Only the bounded list of keys is broadcast, so no text is shuffled."""
    keys = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("y"))
            .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return id_text(docs, id_col, text_col).join(F.broadcast(keys), "doc_id").select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Trees:
    """Trees fitted on the statistics of at most ``most`` labelled rows. Without labels every document is as good as the next."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["x", "y"])

    rows = arrow_map(labelled_sample(docs, labels, label, most, id_col, text_col), measure, "x array<double>, y double").collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([r.y for r in rows], float)
    order = np.lexsort([*x.T, y])  # the same trees whatever the order of arrival
    return fit(x[order], y[order], np.array(list(FEATURES.values())))


def verdicts(texts: list[str], trees: Trees, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, rejected by the limits, probability of good quality, kept."""
    both = [statistics(t) for t in texts]
    counts = np.array([a for a, _ in both], np.int64).reshape(len(texts), len(COUNTS))
    p = trees.probability(np.array([b for _, b in both], float).reshape(len(texts), len(FEATURES)))
    failed = base_failed(counts)
    return counts, failed, p, ~failed & (p >= threshold)


def judge(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, the five counts, ``base_failed``, ``kept`` and ``quality`` (probability).

    A null or empty text has no words and fails. Repeated rows each get the
    same verdict; null keys stay; an empty table gives no rows; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, p, kept = verdicts(batch.column(1).to_pylist(), trees, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(kept), pa.array(p)],
                                             names=["doc_id", *COUNTS, "base_failed", "kept", "quality"])

    return arrow_map(id_text(docs, id_col, text_col), run,
                     f"doc_id {doc_type(docs, id_col)}, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean, quality double")


def keep(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(verdicts(texts, trees, threshold)[3]))

    bounded_batches(docs.sparkSession)
    return spread(docs).mapInArrow(run, docs.schema)
