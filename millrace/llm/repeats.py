"""Repeated substrings of 200 bytes or more, removed exactly, by prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes marks, for every start of a 200-byte
string, the least hash in the ``REACH`` bytes behind it. Starts with the same
mark form a phrase. The mark depends on bytes inside the string only, so equal
strings have their mark at the same distance: their phrases meet at the mark,
and nothing else ever has to be compared.

What is asked of the corpus order are its ties at 200 bytes, not the order
itself, so phrases are named (equal bytes, equal name) instead of sorted:

1. Parse. Every phrase gets a name for the bytes behind its mark and one for
   all bytes of its strings. A phrase that occurs twice is repeated as a whole;
   one whose mark is followed by bytes found nowhere else is not repeated.
2. Dictionary. What is left are different phrases that meet at equal marks,
   each taken once. They are cut in blocks of ``FINE`` starts at fixed distances
   from the mark and named again.
3. Different blocks with one core are named start by start.

Every step is a count by key, so no group of equal phrases ever meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, doc_type, id_text, written
from millrace.session import scratch_path

LENGTH = 200
TRIGGER, REACH = 8, 128
FINE = 16
CORE = LENGTH - REACH  # bytes behind a mark that every string with this mark covers
_GOLD, _M1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def phrases(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mark, first and last start of every phrase. ``data`` of fewer than 200 bytes has none."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none
    raw = np.frombuffer(data, np.uint8)
    h = np.empty(n - TRIGGER + 1, np.uint64)
    for k in range(TRIGGER):
        own = raw[k : k + (n - k) // TRIGGER * TRIGGER].view("<u8")
        h[k::TRIGGER] = own[: len(h[k::TRIGGER])]
    h *= _GOLD
    h ^= h >> np.uint64(32)
    h *= _M1
    h &= _HIGH
    h |= np.arange(len(h), dtype=np.uint64)  # of equal hashes the first one counts
    width = 1
    while width < REACH:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    marks = (h[: n - LENGTH + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero(marks[1:] != marks[:-1]) + 1
    first = np.concatenate([[0], cuts])
    return marks[first], first, np.concatenate([cuts - 1, [len(marks) - 1]])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def pack(mark: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mark and the distances to it in one number."""
    return mark << 14 | (mark - first) << 7 | (mark - last)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for row, text in enumerate(batch.column(2).to_pylist()):
            data = text.encode()
            mark, first, last = phrases(data)
            if not len(mark):
                continue
            view = memoryview(data)
            near = [h(view[m : m + CORE]) for m in mark.tolist()]
            whole = [h(view[a:b], 1) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
            n = len(mark)
            yield pa.RecordBatch.from_arrays([_signed(near), _signed(whole), pa.array(np.full(n, k1[row])), pa.array(np.full(n, k2[row])), pa.array(pack(mark, first, last))],
                                             names=["near", "whole", "k1", "k2", "place"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the dictionary's phrases: names of core and of all bytes, and the bytes on either side of the core."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    inner = LENGTH - FINE + 1
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        places, nears = batch.column(3), batch.column(4)
        for row, text in enumerate(batch.column(2).to_pylist()):
            data = text.encode()
            out: list[list] = [[], [], [], [], [], []]
            for place, near in zip(places[row].as_py(), nears[row].as_py(), strict=True):
                mark, far, close = place >> 14, place >> 7 & 127, place & 127
                for block in range(close // FINE, far // FINE + 1):
                    core = mark - block * FINE
                    left, right = data[max(0, core - FINE + 1) : core], data[core + inner : core + LENGTH]
                    for column, value in zip(out, (near, h(data[core : core + inner]), h(left + b"|" + data[core : core + LENGTH], len(left)), mark << 3 | block, left, right), strict=True):
                        column.append(value)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), _signed(out[1]), _signed(out[2]), pa.array(np.full(n, k1[row])), pa.array(np.full(n, k2[row])),
                                              pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())],
                                             names=["near", "core", "full", "k1", "k2", "place", "left", "right"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single starts of a block, each under a 128-bit name: a string is its block's core, some bytes before it and the rest behind it."""
    import xxhash

    for batch in batches:
        names: list[int] = []
        at: list[int] = []
        for near, core, block, left, right in zip(*(batch.column(c).to_pylist() for c in ("near", "core", "block", "left", "right")), strict=True):
            meeting = near.to_bytes(8, "little", signed=True) + core.to_bytes(8, "little", signed=True)
            for before in range(FINE):
                if before <= len(left) and FINE - 1 - before <= len(right):
                    names.append(xxhash.xxh3_128_intdigest(meeting + left[len(left) - before :] + b"|" + right[: FINE - 1 - before], before))
                    at.append(block << 4 | before)
        yield pa.RecordBatch.from_arrays([_signed([n & 0xFFFFFFFFFFFFFFFF for n in names]), _signed([n >> 64 for n in names]), pa.array(at, pa.int64())], names=["name", "more", "at"])


def _finish(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut(text.encode(), found or []) for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = {"n_bytes": [len(k) + g for k, g, _ in out], "n_removed": [g for _, g, _ in out], "n_spans": [r for *_, r in out]}
            kept = {"kept": pa.array([k for k, *_ in out], pa.binary())} if with_kept else {}
            sums = pa.array([hashlib.sha256(k).hexdigest() for k, *_ in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns.values()), sums, *kept.values()], names=["doc_id", *columns, "kept_sha256", *kept])

    return run


def cut(data: bytes, found: list[int]) -> tuple[bytes, int, int]:
    """What is left of ``data``, bytes removed and runs removed. ``found``: ranges of starts, each in one number."""
    if not found:
        return data, 0, 0
    ranges = np.array(found, np.int64)
    first, count = ranges >> 8, ranges & 255
    # Only starts of whole strings count.
    good = (first >= 0) & (first + LENGTH <= len(data))
    first, last = first[good], np.minimum(first + count, len(data) - LENGTH)[good]
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last + LENGTH, -1)
    gone = np.cumsum(depth[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _range(first, count):
    return F.shiftleft(first, 8).bitwiseOR(count)


def repeated_starts(source: DataFrame, folder: str) -> DataFrame:
    """(``k1``, ``k2``, ``range``): starts of strings that start anywhere else too."""
    parsed = arrow_map(source.select("k1", "k2", "text"), _parse, "near long, whole long, k1 long, k2 long, place long")
    meeting = (parsed.select("near", "whole").groupBy("near").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
               .where("n > 1").select("near", (F.col("a") != F.col("b")).alias("differ")))
    met = written(parsed.join(written(meeting, f"{folder}/marks"), "near"), f"{folder}/met")
    far, close = F.shiftright("place", 7).bitwiseAND(F.lit(127)), F.col("place").bitwiseAND(F.lit(127))
    whole = _range(F.shiftright("place", 14) - far, far - close)
    same = met.where(~F.col("differ")).select("k1", "k2", whole.alias("range"))
    other = met.where("differ")
    counted = other.groupBy("near", "whole").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    dictionary = written(counted, f"{folder}/dictionary")
    twice = other.join(dictionary.where("n > 1").select("near", "whole"), ["near", "whole"]).select("k1", "k2", whole.alias("range"))
    wanted = dictionary.select("one.*", "near").groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "near")).alias("w")).select("k1", "k2", F.col("w.place").alias("places"), F.col("w.near").alias("nears"))
    single = source.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "places", "nears")
    blocks = written(arrow_map(single, _blocks, "near long, core long, full long, k1 long, k2 long, place long, left binary, right binary"), f"{folder}/blocks")
    named = blocks.groupBy("near", "core", "full").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "place", "left", "right")).alias("one"))
    named = written(named.withColumn("block", F.monotonically_increasing_id()), f"{folder}/named")
    block_start = F.shiftright("place", 3) - F.col("place").bitwiseAND(F.lit(7)) * FINE - (FINE - 1)
    # A block at the start of a text is shorter on the left: its range begins at 0.
    from_ = F.greatest(block_start, F.lit(0).cast("long"))
    block_twice = (blocks.join(named.where("copies > 1").select("near", "core", "full"), ["near", "core", "full"])
                   .select("k1", "k2", _range(from_, block_start + (FINE - 1) - from_).alias("range")))
    shared = named.groupBy("near", "core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("near", "core")
    single_starts = arrow_map(named.join(written(shared, f"{folder}/shared"), ["near", "core"]).select("near", "core", "block", "one.left", "one.right"), _starts, "name long, more long, at long")
    names = single_starts.groupBy("name", "more").agg(F.count("*").alias("n")).where("n > 1").select("name", "more")
    found = single_starts.join(written(names, f"{folder}/names"), ["name", "more"]).select(F.shiftright("at", 4).alias("block"), F.col("at").bitwiseAND(F.lit(15)).alias("before"))
    core_start = F.shiftright("one.place", 3) - F.col("one.place").bitwiseAND(F.lit(7)) * FINE
    start_twice = (found.join(named.select("block", "one.k1", "one.k2", core_start.alias("first")), "block")
                   .select("k1", "k2", _range(F.col("first") - F.col("before"), F.lit(0).cast("long")).alias("range")))
    return same.unionByName(twice).unionByName(block_twice).unionByName(start_twice)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """Per row: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, unless ``with_kept`` is off, ``kept`` (the bytes that are left).

    A text is taken as UTF-8; a null one is empty; strings never cross texts
    and are judged on the input. Rows that repeat a row are repeats of its
    text. Null keys stay; an empty table gives no rows; other columns are ignored.
    """
    folder = scratch_path(docs.sparkSession, "repeats")
    source = id_text(docs, id_col, text_col, dealt=False).select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64("doc_id").alias("k2"), "text")
    found = repeated_starts(source, folder).groupBy("k1", "k2").agg(F.collect_set("range").alias("ranges"))
    full = source.join(found, ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    return arrow_map(full, _finish(with_kept), f"doc_id {doc_type(docs, id_col)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
