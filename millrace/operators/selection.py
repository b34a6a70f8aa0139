"""The n-th smallest difference between two sides, without the differences.

The distinct values of either side are sorted and packed into blocks with their
counts. How many differences are at most x is a merge of the two sorted sides:
blocks that lie wholly on one side of x are counted from a list of the blocks,
and only tiles (a block of either side) that x cuts are looked at, no more of
them than there are blocks. The wanted value is enclosed ever closer between
two doubles, sixteen-fold each time in the order of their bits, for all wanted
places at once, until few enough pairs are left to be listed or the doubles are
neighbours. So it ends after sixteen rounds at the latest, and the result is
exact.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.session import checkpoint

BLOCK = 20_000  # distinct values in a block
LISTED = 100_000  # distinct pairs that may be listed for a place
WAYS = 16


def ordered_bits(x: float) -> int:
    """A whole number for each double, in the same order."""
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def from_bits(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n))[0] if n >= 0 else -struct.unpack("<d", struct.pack("<q", -n))[0]


def first_within(values: np.ndarray, others: np.ndarray, x: float) -> np.ndarray:
    """For each value the first place in the sorted ``others`` with value - other <= x, as doubles are subtracted."""
    at = np.searchsorted(others, values - x, side="left")
    while True:
        back = (at > 0) & (values - others[np.maximum(at - 1, 0)] <= x)
        on = (at < len(others)) & (values - others[np.minimum(at, len(others) - 1)] > x)
        if not (back | on).any():
            return at
        at = at - back + (on & ~back)


class _Side:
    """Blocks of one side in order: what they hold is on disk, what they span is here (one line a block)."""

    def __init__(self, counts: DataFrame, count: str):
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number, held = TaskContext.get().partitionId() << 32, []
            for batch in batches:
                held.append(batch)
                while sum(map(len, held)) >= BLOCK:
                    rows = pd.concat(held)
                    yield pd.DataFrame({"block": [number], "v": [rows["v"].to_numpy()[:BLOCK]], "n": [rows["n"].to_numpy()[:BLOCK]]})
                    number, held = number + 1, [rows.iloc[BLOCK:]]
            rows = pd.concat(held) if held else None
            if rows is not None and len(rows):
                yield pd.DataFrame({"block": [number], "v": [rows["v"].to_numpy()], "n": [rows["n"].to_numpy()]})

        own = counts.where(F.col(count) > 0).select("v", F.col(count).alias("n"))
        self.blocks = checkpoint(own.repartitionByRange("v").sortWithinPartitions("v").mapInPandas(pack, "block long, v array<double>, n array<long>"))
        sums = F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)
        spans = sorted(tuple(r) for r in self.blocks.select(F.array_min("v"), F.array_max("v"), sums, F.size("v"), "block").collect())
        self.low, self.high, self.weight, self.size, self.block = (np.array([x[k] for x in spans]) for k in range(5))
        self.total = sum(x[2] for x in spans)


class DifferenceMatrix:
    """All differences of a first and a second value, from counts per distinct value (``v``, ``n1``, ``n2``)."""

    def __init__(self, counts: DataFrame):
        counts = checkpoint(counts)
        self.spark = counts.sparkSession
        self.first, self.second = _Side(counts, "n1"), _Side(counts, "n2")
        self.rows, self.columns = self.first.total, self.second.total
        self.pairs = self.rows * self.columns

    def _reach(self, x: float) -> tuple[np.ndarray, np.ndarray]:
        """For each first block: where the second blocks begin that x cuts, and where those begin that lie wholly within x."""
        return first_within(self.first.low, self.second.high, x), first_within(self.first.high, self.second.low, x)

    def _tiles(self, wanted: dict[tuple[int, int], list[tuple]], schema: str) -> DataFrame:
        rows = [(int(self.first.block[i]), int(self.second.block[j]), asks) for (i, j), asks in wanted.items()]
        tiles = self.spark.createDataFrame(rows, f"block_1 long, block_2 long, asks array<struct<{schema}>>").repartition("block_1", "block_2")
        left = self.first.blocks.select(F.col("block").alias("block_1"), F.col("v").alias("v1"), F.col("n").alias("n1"))
        right = self.second.blocks.select(F.col("block").alias("block_2"), F.col("v").alias("v2"), F.col("n").alias("n2"))
        return tiles.join(left, "block_1").join(right, "block_2").select("asks", "v1", "n1", "v2", "n2")

    def within(self, bounds: Sequence[float]) -> list[tuple[int, int]]:
        """For each bound: how many pairs, and how many distinct ones, differ by it at most."""
        out, cut = [], defaultdict(list)
        behind = [np.concatenate([[0], np.cumsum(c[::-1])])[::-1].astype(object) for c in (self.second.weight, self.second.size)]
        for k, x in enumerate(bounds):
            begin, full = self._reach(x)
            out.append([int((w.astype(object) * b[full]).sum()) for w, b in zip((self.first.weight, self.first.size), behind)])
            for i in np.flatnonzero(begin < full):
                for j in range(begin[i], full[i]):
                    cut[int(i), int(j)].append((k, float(x)))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for asks, v1, n1, v2, n2 in zip(*(batch[c] for c in batch.columns)):
                    behind = np.concatenate([np.cumsum(n2[::-1])[::-1], [0]])
                    for ask in asks:
                        at = first_within(v1, v2, ask["x"])
                        found.append((ask["k"], int((n1 * behind[at]).sum()), int((len(v2) - at).sum())))
                yield pd.DataFrame(found, columns=["k", "pairs", "distinct"])

        if cut:
            some = self._tiles(cut, "k int, x double").mapInPandas(count, "k int, pairs long, distinct long")
            for r in some.groupBy("k").agg(F.sum(F.col("pairs").cast("decimal(38,0)")).alias("pairs"), F.sum("distinct").alias("distinct")).collect():
                out[r.k][0] += int(r.pairs)
                out[r.k][1] += r.distinct
        return [tuple(x) for x in out]

    def _listed(self, spans: dict[int, tuple[float, float]]) -> dict[int, list[tuple[float, int]]]:
        """The differences over the first and up to the second bound of each span, with their counts; few by promise."""
        cut = defaultdict(list)
        for k, (low, high) in spans.items():
            begin, end = self._reach(high)[0], self._reach(low)[1]
            for i in np.flatnonzero(begin < end):
                for j in range(begin[i], end[i]):
                    cut[int(i), int(j)].append((k, float(low), float(high)))

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for asks, v1, n1, v2, n2 in zip(*(batch[c] for c in batch.columns)):
                    for ask in asks:
                        start, stop = first_within(v1, v2, ask["high"]), first_within(v1, v2, ask["low"])
                        n = stop - start
                        a = np.repeat(np.arange(len(v1)), n)
                        b = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        yield pd.DataFrame({"k": np.int32(ask["k"]), "d": v1[a] - v2[b], "n": n1[a] * n2[b]})

        found = self._tiles(cut, "k int, low double, high double").mapInPandas(listed, "k int, d double, n long").groupBy("k", "d").agg(F.sum("n").alias("n")).collect()
        out = defaultdict(list)
        for r in found:
            out[r.k].append((r.d, r.n))
        return out

    def smallest(self, places: Sequence[int]) -> list[float]:
        """The differences at the given places, counted from 1 in ascending order, repeats included."""
        least, most = float(self.first.low.min() - self.second.high.max()), float(self.first.high.max() - self.second.low.min())
        distinct = int(self.first.size.sum()) * int(self.second.size.sum())
        # For each place: bits below it, bits it does not exceed, pairs up to the former, distinct pairs between.
        spans = [[ordered_bits(least) - 1, ordered_bits(most), 0, 0, distinct] for _ in places]
        while True:
            wide = [s for s in spans if s[1] - s[0] > 1 and s[4] > LISTED]
            if not wide:
                break
            cuts = [[s[0] + (s[1] - s[0]) * w // WAYS for w in range(1, WAYS)] for s in wide]
            asked = sorted({c for cut in cuts for c in cut})
            known = dict(zip(asked, self.within([from_bits(c) for c in asked])))
            for s, cut in zip(wide, cuts):
                place = places[next(k for k, x in enumerate(spans) if x is s)]
                inner = [(s[0], s[2], s[3])] + [(c, *known[c]) for c in cut]
                after = [(c, d) for c, n, d in inner if n >= place]
                low, pairs, below = max((x for x in inner if x[1] < place), key=lambda x: x[0])
                high, up_to = min(after) if after else (s[1], s[3] + s[4])
                s[:] = [low, high, pairs, below, up_to - below]
        out, open_ = [from_bits(s[1]) for s in spans], {}
        for k, s in enumerate(spans):
            if s[1] - s[0] > 1:
                open_[k] = (from_bits(s[0]), from_bits(s[1]))
        for k, found in (self._listed(open_) if open_ else {}).items():
            left = places[k] - spans[k][2]
            for d, n in sorted(found):
                left -= n
                if left <= 0:
                    out[k] = d
                    break
        return out
