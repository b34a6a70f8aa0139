"""Token ids in raw binary shards, and constant-time access to them by key.

Files below one folder, all written by executors through the file system that
the folder's address names:

* ``shards/``: magic, raw ids (unsigned, two bytes each if the vocabulary allows
  it, else four; little endian), row borders as 64-bit counts of ids, then
  rows, ids and bytes per id. Shards hold documents in ascending key order.
* ``index/``: one minimal perfect hash per bucket of keys, behind the salt of its hashes. A slot holds a
  32-bit fingerprint of its key, the shard, the first row in it, the number of
  rows, and whether the key's rows go on in another shard.
* ``manifest``: Parquet, a row per shard with its file and its first id.

A task that is run again writes files of other names; the lists written after
it name the files of the attempt that counted.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, doc_type, id_text
from millrace.session import scratch_path

MAGIC = b"IDSHARD1"
TAIL, TAIL_BYTES = "<qqq", 24
SHARD_BYTES = 32 << 20
KEYS_PER_BUCKET = 200_000
GAMMA = 2.0  # bits per key and level of the hash
MOST_LEVELS = 64  # keys still together then share their hash: other bits are taken
PACK_CHARS, BATCH_PACKS, GATHERED, ENCODED_BYTES = 4096, 32, 1 << 20, 24 << 20
MARKS = ".,;:!?"
_LOWER_WS = "\x1c\x1d\x1e\x1f"  # white space to Python, not to the tokenizers
_ENCODERS: dict[str, WordEncoder] = {}


def _store(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


# ---------------------------------------------------------------- encoding

def _gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the coded words one after the other; ``flat`` has those of each word, ``sizes`` how many."""
    starts, parts = np.cumsum(sizes) - sizes, [flat[:0]]
    for k in range(0, len(codes), GATHERED):
        some = codes[k : k + GATHERED]
        n = sizes[some]
        parts.append(flat[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(parts)


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file whose pattern drops white space.

    Such a text is its words one after the other. The different words of some
    texts are found in Arrow and encoded in packs by the library, and the ids
    of the texts are gathered by offsets. Where the file lowers letters, ASCII
    letters are lowered first, and where it splits marks from a word before
    them, a word and its last marks are encoded apart: fewer different words remain.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = self._one("a b") == self._one("a") + self._one("b") and not any(map(str.isspace, "".join(added)))
        self.lowers = all(self._one(c.upper()) == self._one(c) for c in ("a", "z", "word"))
        self.splits = all(self._one(x + c) == self._one(x) + self._one(c) for c in (*MARKS, MARKS) for x in ("a", "word", "z"))
        # Texts with these go the plain way: white space to Python only, and strings that may be added tokens.
        self.odd = "[" + _LOWER_WS + "]" + "".join("|" + re.escape(x[:2]) for x in sorted(added))

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _packed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one word after the other, and how many each has."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        packs, start = [], 0
        while start < len(words):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PACK_CHARS, side="right")))
            packs.append((start, stop))
            start = stop
        ids, sizes = [np.zeros(0, f"<u{self.width}")], [np.zeros(0, np.int64)]
        for k in range(0, len(packs), BATCH_PACKS):
            some = packs[k : k + BATCH_PACKS]
            for (a, b), got in zip(some, self.tokenizer.encode_batch([" ".join(words[a:b]) for a, b in some], add_special_tokens=False), strict=True):
                starts = np.fromiter((x for x, _ in got.offsets), np.int64, len(got))
                cuts = np.searchsorted(starts, ends[a:b] - (ends[a - 1] if a else 0), side="left")
                cuts[-1] = len(got)
                sizes.append(np.diff(cuts, prepend=0))
                ids.append(np.array(got.ids, f"<u{self.width}"))
        return np.concatenate(ids), np.concatenate(sizes)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_packed``; words that end in marks share the ids of what is before them."""
        if not self.splits or not len(words):
            return self._packed(words.to_pylist())
        trimmed = pc.utf8_rtrim(words, characters=MARKS)
        apart = pc.and_(pc.less(pc.binary_length(trimmed), pc.binary_length(words)), pc.match_substring_regex(trimmed, "[A-Za-z]$"))
        which = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        some = pa.array(which)
        ends = [w[len(c):] for w, c in zip(words.take(some).to_pylist(), trimmed.take(some).to_pylist())]
        pieces = pa.concat_arrays([pc.if_else(apart, trimmed, words), pa.array(["", *ends], words.type)]).dictionary_encode()
        places = pieces.indices.to_numpy(zero_copy_only=False)
        flat, sizes = self._packed(pieces.dictionary.to_pylist())
        pairs = np.full((len(words), 2), places[len(words)])  # each word as its core and its marks, mostly none
        pairs[:, 0], pairs[which, 1] = places[:len(words)], places[len(words) + 1:]
        return _gathered(flat, sizes, pairs.ravel()), sizes[pairs].sum(axis=1)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not self.by_word:
            return [self._ids(x.ids) for x in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        odd = pc.match_substring_regex(column, self.odd)
        plain = pc.if_else(odd, "", column)
        lists = pc.utf8_split_whitespace(pc.ascii_lower(plain) if self.lowers else plain)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, sizes = self._distinct(coded.dictionary)
        ids = _gathered(flat, sizes, codes)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._ids(self._one(column[k].as_py()))
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- minimal perfect hash

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 bits from 64 bits, another function for each seed (a public finaliser)."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key rests at the first level where it met no other key; its slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.ranks = np.cumsum(self.bits) - self.bits
        self.starts = np.cumsum([0, *map(len, levels)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash | None:
        """None if some keys never part."""
        levels, left = [], keys
        while len(left):
            if len(levels) == MOST_LEVELS:
                return None
            size = max(64, int(len(left) * GAMMA))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that are not in it (the rest is for the fingerprints)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = (_mix(keys[open_], k) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[open_[hit]] = self.ranks[self.starts[k] + at[hit]]
            open_ = open_[~hit]
        return out

    def dumps(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", n, 8)
        total = int(sizes.sum())
        start = 8 * (n + 1)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, (total + 7) // 8, start), count=total).astype(bool)
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if n else []), start + (total + 7) // 8


def _key_bits(keys: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash key and fingerprint of each key, from independent halves."""
    import xxhash

    wide = [xxhash.xxh3_128_intdigest(k, salt) for k in keys]
    return (np.array([w & 0xFFFFFFFFFFFFFFFF for w in wide], np.uint64), np.array([(w >> 64) & 0xFFFFFFFF for w in wide], np.uint32))


_SLOT = np.dtype([("print", "<u4"), ("shard", "<i8"), ("row", "<i8"), ("rows", "<i8"), ("more", "u1")])


# ---------------------------------------------------------------- writing

def _write_file(folder: str, name: str, parts: list[bytes]) -> str:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        for part in parts:
            out.write(part)
    return f"{folder}/{name}"


def _shard_writer(folder: str, vocabulary: str, end_id: int):
    """Encode a task's rows in their order and write them in shards of bounded size; yield (key, file, row, ids, number in the task)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        """Keys and texts of neighbouring batches: more texts share their words."""
        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.nbytes
            if size >= ENCODED_BYTES:
                yield tuple(pa.concat_arrays([b.column(k) if k == 0 else b.column(k).cast(pa.large_string()) for b in some]) for k in (0, 1))
                some, size = [], 0
        if some:
            yield tuple(pa.concat_arrays([b.column(k) if k == 0 else b.column(k).cast(pa.large_string()) for b in some]) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        width, task = tool.width, TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{width}").tobytes()
        keys, payload, sizes, held, count = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            borders = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            name = f"{task:06d}-{count:05d}-{uuid.uuid4().hex}.ids"
            file = _write_file(f"{folder}/shards", name, [MAGIC, *payload, borders.tobytes(), struct.pack(TAIL, len(sizes), int(borders[-1]), width)])
            n = len(sizes)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays(keys), pa.array([task] * n, pa.int64()), pa.array([count] * n, pa.int64()), pa.array([file] * n, pa.string()),
                pa.array(range(n), pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "task", "part", "file", "row", "n_ids"])

        for own, texts in joined(batches):
            for k, ids in enumerate(tool.encode(texts)):
                keys.append(own.slice(k, 1))
                payload += [ids, end]
                sizes.append(len(ids) // width + 1)
                held += len(ids) + width
                if held >= SHARD_BYTES:
                    yield flush()
                    keys, payload, sizes, held, count = [], [], [], 0, count + 1
        if sizes:
            yield flush()

    return run


def _index_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket at a time is held."""
        bucket, rows = None, []

        def flush() -> pa.RecordBatch:
            keys = [f"{k}:{j}" for k, j, *_ in rows]
            for salt in range(MOST_LEVELS):
                bits, prints = _key_bits(keys, salt)
                if (phf := PerfectHash.of(bits)) is not None:
                    break
            slots = np.zeros(len(rows), _SLOT)
            at = phf.slots(bits)
            slots["print"][at] = prints
            for name, column in zip(("shard", "row", "rows", "more"), list(zip(*rows, strict=True))[2:], strict=True):
                slots[name][at] = column
            file = _write_file(f"{folder}/index", f"{bucket:06d}-{uuid.uuid4().hex}.mph", [np.array([salt], "<i8").tobytes(), phf.dumps(), slots.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([file], pa.string())], names=["bucket", "index_file"])

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and rows:
                    yield flush()
                    rows = []
                bucket = b
                rows.append(row)
        if rows:
            yield flush()

    return run


class IdStore:
    """Handle on a written folder: ``folder``, and the lists of shards and index files as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, key_type: str):
        self.spark, self.folder, self.buckets, self.key_type = spark, folder, buckets, key_type

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index_files")

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets))

    def lookup(self, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """Rows (``doc_id``, ``shard``, ``row``, ``rows``) of the given keys; keys that the store lacks give none."""
        own = keys.select(F.col(f"`{id_col}`").alias("doc_id")).distinct()
        name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
        routed = (own.select("doc_id", name.alias("name")).withColumn("bucket", self._bucket(F.col("name"))).join(self.index, "bucket")
                  .select("index_file", "doc_id", "name").repartition("index_file").sortWithinPartitions("index_file"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, phf, slots, salt = None, None, None, 0
            for batch in batches:
                files = np.array(batch.column(0).to_pylist(), object)
                edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if files[a] != file:
                        file = files[a]
                        store, path = _store(file)
                        with store.open_input_file(path) as source:
                            raw = source.read()
                        salt = int(np.frombuffer(raw, "<i8", 1)[0])
                        phf, start = PerfectHash.loads(raw[8:])
                        slots = np.frombuffer(raw, _SLOT, offset=8 + start)
                    names, keys, turn = batch.column(2).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a), 0
                    at = np.arange(len(names))
                    while len(at):  # a second turn only for keys whose rows cross into another shard
                        bits, prints = _key_bits([f"{names[k]}:{turn}" for k in at], salt)
                        slot = phf.slots(bits)
                        good = (slot >= 0) & (slots["print"][slot] == prints)
                        got, at = slots[slot[good]], at[good]
                        if len(at):
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(got[c].astype(np.int64)) for c in ("shard", "row", "rows"))],
                                                             names=["doc_id", "shard", "row", "rows"])
                        at, turn = at[got["more"] == 1], turn + 1

        return arrow_map(routed, run, f"doc_id {self.key_type}, shard long, row long, rows long")

    def read(self, keys: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
        """The documents of the given keys, found by the index and read from the shards.

        ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
        ``ids_crc32`` and, unless ``with_ids`` is off, ``ids`` (array of long).
        """
        found = (self.lookup(keys, id_col).join(self.shards.select("shard", "file", "first_id"), "shard")
                 .select("file", "first_id", "doc_id", "row", "rows").repartition("file").sortWithinPartitions("file", "row"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file = None
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), range(batch.num_rows), strict=True))
                at, starts, sizes, sums, ids = [], [], [], [], []
                for name, first, row, n, k in rows:
                    if name != file:
                        file = name
                        store, path = _store(name)
                        with store.open_input_file(path) as source:
                            raw = source.read()
                        if raw[:8] != MAGIC:
                            raise ValueError(f"not a shard: {name}")
                        held, total, width = struct.unpack(TAIL, raw[-TAIL_BYTES:])
                        borders = np.frombuffer(raw, "<i8", held + 1, 8 + total * width).tolist()
                        payload = np.frombuffer(raw, f"<u{width}", total, 8)
                    for r in range(row, row + n):
                        a, b = borders[r], borders[r + 1]
                        at.append(k)
                        starts.append(first + a)
                        sizes.append(b - a)
                        sums.append(zlib.crc32(payload[a:b].astype("<u4").tobytes()))
                        if with_ids:
                            ids.append(payload[a:b].astype(np.int64))
                columns = [batch.column(2).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return arrow_map(found, run, f"doc_id {self.key_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> IdStore:
    """Encode every whole text, append ``end_id``, and write shards, index and manifest below ``folder``.

    ``folder``: a new one in the session's shared folder unless given; every
    executor must reach it. Documents stand in ascending key order, null keys
    first; rows with one key stand in the order of a hash of their texts. A
    null text is an empty one and has the end id alone. An empty table gives
    an empty store. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    key_type = doc_type(docs, id_col)
    hashed = id_text(docs, id_col, text_col, dealt=False).withColumn("_tie", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    arrow_map(ordered, _shard_writer(folder, vocabulary, end_id),
              f"doc_id {key_type}, task long, part long, file string, row long, n_ids long").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    # Numbers and first ids by a window over the list of shards: one task, a row for each 32 MB of ids.
    line = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    (rows.groupBy("task", "part", "file").agg(F.count("*").alias("n_rows"), F.sum("n_ids").alias("ids"))
     .select("task", "part", "file", "n_rows", "ids", F.coalesce(F.sum("ids").over(line), F.lit(0)).alias("first_id"), F.coalesce(F.count("*").over(line), F.lit(0)).alias("shard"))
     .write.parquet(f"{folder}/manifest"))
    manifest = spark.read.parquet(f"{folder}/manifest")
    keys = manifest.agg(F.sum("n_rows")).first()[0] or 0
    store = IdStore(spark, folder, max(1, -(-keys // KEYS_PER_BUCKET)), key_type)
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    runs = (rows.join(manifest.select("file", "shard"), "file").groupBy(name.alias("name"), "shard").agg(F.min("row").alias("row"), F.count("*").alias("rows"))
            .withColumn("turn", F.row_number().over(Window.partitionBy("name").orderBy("shard")) - 1)
            .withColumn("more", (F.lead("shard").over(Window.partitionBy("name").orderBy("shard")).isNotNull()).cast("int")))
    sorted_runs = (runs.select(store._bucket(F.col("name")).alias("bucket"), "name", "turn", "shard", "row", "rows", "more")
                   .repartition("bucket").sortWithinPartitions("bucket"))
    arrow_map(sorted_runs, _index_writer(folder), "bucket long, index_file string").write.parquet(f"{folder}/index_files")
    return store
