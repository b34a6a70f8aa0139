"""What each filter of a chain removes, in every order of the chain.

Five filters judge a text: fewer than 200 words (A), under half of the words different (B), over 2 % capital letters
(C), a symbol (D), the text of a smaller id (E). The first four need the text alone. For the last one texts are put
into radix tries:

* Each task inserts whole texts into a compressed trie (an edge holds all bytes up to the next branch), a bounded
  number of bytes at a time. A text that is there already adds its id and a count to its terminal, so a group of copies
  leaves one entry of each task.
* Entries are range-partitioned by adaptive prefixes. A prefix of 4 bytes is doubled, and doubled again, wherever the
  texts that begin with it outweigh a small share of a partition, up to the whole text. Which prefixes are heavy comes
  from sums over hashes of all entries' prefixes; there are at most some for each partition and length.
* Each range goes into one trie whose terminals keep the minimum id. Walking it gives the texts found more than once
  and their first ids, which flag the documents.

Documents become bit masks of the filters they fail. Masks are counted per part, and the counts of 32 masks give every
figure of all 120 orders, whatever the number of documents.

Nulls: a null text is empty, a null part the empty string. A row without an id is never a copy and never first. Rows
that repeat an id and its text are each first. A label that is given more than once holds if any row says so. A very
long text costs its bytes once per step; a step holds 12 MB of texts, or one longer text. No documents, no parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, doc_type, written
from millrace.session import scratch_path, spread

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
HEAD, RANGE_KEY = 4, 16  # shortest prefix; bytes of it that order the ranges
TRIE_BYTES, BATCH_BYTES, PARTITION_BYTES, PARTS_OF_A_RANGE = 12 << 20, 2 << 20, 32 << 20, 8
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER = bytes(range(0x80, 0xC0))  # bytes of a character after its first
_SYMBOL = re.compile(rb"[#$%&*|]")


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # of bytes: at the six white-space characters of ASCII
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * points) << 2 | (_SYMBOL.search(text) is not None) << 3


class RadixTrie:
    """Texts as bytes on compressed edges. A node is [edge, children by first byte, what the terminal holds]."""

    def __init__(self):
        self.root = [b"", {}, None]

    def node(self, text: bytes) -> list:
        """The node at which ``text`` ends; made if it isn't there."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                return child
            edge = child[0]
            if text.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            k = self._shared(edge, text, at)
            fork = node[1][text[at]] = [edge[:k], {edge[k]: child}, None]
            child[0] = edge[k:]
            node, at = fork, at + k
        return node

    @staticmethod
    def _shared(edge: bytes, text: bytes, at: int) -> int:
        """Length of the common beginning, which is shorter than the edge, by halving."""
        low, high = 1, min(len(edge), len(text) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if edge[low:mid] == text[at + low:at + mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def terminals(self) -> Iterator[list]:
        """What the terminals hold, in the order of a walk."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _heads(text: bytes) -> list[int]:
    """Hashes of the prefixes of 4, 8, 16, ... bytes and of the whole text."""
    out, n = [], HEAD
    while n < len(text):
        out.append(n)
        n *= 2
    return np.array([xxhash.xxh3_64_intdigest(text[:k]) for k in [*out, len(text)]], np.uint64).view(np.int64).tolist()


def _entries(schema: pa.Schema):
    """Every document with its mask and the name of its text; one of equal ones in a trie also carries the text."""

    def flush(ids, parts, terminals):
        held, size = set(), 0
        columns = {name: [] for name in schema.names}
        for id_, part, terminal in zip(ids, parts, terminals):
            name, mask, first, n, text = terminal
            row = [id_, part, name, mask]
            if name in held:
                row += [None] * 4
            else:
                held.add(name)
                size += len(text)
                row += [text, first, n, _heads(text)]
            for column, value in zip(columns.values(), row):
                column.append(value)
            if size > BATCH_BYTES or len(columns["name"]) == 1000:
                yield pa.RecordBatch.from_pydict(columns, schema)
                columns, size = {name: [] for name in schema.names}, 0
        yield pa.RecordBatch.from_pydict(columns, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size, ids, parts, terminals = RadixTrie(), 0, [], [], []
        for batch in batches:
            for id_, part, text in zip(*[c.to_pylist() for c in batch.columns]):
                node = trie.node(text)
                if node[2] is None:
                    node[2] = [hashlib.md5(text).digest(), mask_of(text), None, 0, text]
                    size += len(text)
                node[2][2], node[2][3] = _least(node[2][2], id_), node[2][3] + 1
                ids.append(id_)
                parts.append(part)
                terminals.append(node[2])
            if size > TRIE_BYTES or len(ids) > 200_000:
                yield from flush(ids, parts, terminals)
                trie, size, ids, parts, terminals = RadixTrie(), 0, [], [], []
        yield from flush(ids, parts, terminals)

    return run


def _firsts(schema: pa.Schema):
    """Names and first ids of the texts of one range that more than one document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()
        for batch in batches:
            for name, first, n, text in zip(*[c.to_pylist() for c in batch.columns]):
                node = trie.node(text)
                if node[2] is None:
                    node[2] = [name, first, n]
                else:
                    node[2][1:] = _least(node[2][1], first), node[2][2] + n
        found = [(name, first) for name, first, n in trie.terminals() if n > 1 and first is not None]
        yield pa.RecordBatch.from_pydict({"name": [x[0] for x in found], "first_id": [x[1] for x in found]}, schema)

    return run


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, part, mask (bit k: fails the k-th filter). Other columns are ignored."""
    spark = docs.sparkSession
    folder, kind = scratch_path(spark, "tries"), doc_type(docs, id_col)
    texts = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                               F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")))
    arrow_id = texts.limit(0).select("doc_id").toArrow().schema.field("doc_id").type
    schema = pa.schema([("doc_id", arrow_id), ("part", pa.string()), ("name", pa.binary()), ("mask", pa.int32()), ("text", pa.binary()),
                        ("first_id", arrow_id), ("n", pa.int64()), ("heads", pa.list_(pa.int64()))])
    rows = written(arrow_map(texts, _entries(schema), f"doc_id {kind}, part string, name binary, mask int, text binary, first_id {kind}, n long, heads array<long>"),
                   f"{folder}/entries")
    entries = rows.where("text IS NOT NULL").select("name", "first_id", "n", "text", "heads")
    sizes = rows.where("text IS NOT NULL").select("heads", (F.octet_length("text") + 1).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_BYTES + 1)
    # At each length no more than PARTS_OF_A_RANGE prefixes a partition can be heavy.
    weights = sizes.select(F.explode(F.array_distinct("heads")).alias("head"), "size").groupBy("head").agg(F.sum("size").alias("w"))
    heavy = np.array([r.head for r in weights.where(F.col("w") > total / (PARTS_OF_A_RANGE * ranges)).select("head").collect()], np.int64)

    @F.pandas_udf("long")
    def prefix(heads: pd.Series) -> pd.Series:
        return heads.map(lambda x: next((h for h, full in zip(x, np.isin(x, heavy)) if not full), x[-1]))

    dealt = entries.repartitionByRange(ranges, F.substring("text", 1, RANGE_KEY), prefix("heads")).select("name", "first_id", "n", "text")
    found = pa.schema([("name", pa.binary()), ("first_id", arrow_id)])
    firsts = written(arrow_map(dealt, _firsts(found), f"name binary, first_id {kind}"), f"{folder}/firsts")
    joined = rows.select("doc_id", "part", "name", "mask").join(firsts, "name", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("mask") + F.when(copy, COPY).otherwise(0)).alias("mask"))


def _orders() -> list[tuple[str, int, int, int]]:
    """Order, step, bit of the step's filter, bits of the filters before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), step + 1, 1 << k, before))
            before |= 1 << k
    return out


AUDIT_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
                "good_lost long, toxic_lost long, shapley long")


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All orders of each part from its counts of masks."""
    orders = _orders()
    masks = np.arange(1 << len(FILTERS))[:, None]
    bit, before = (np.array([o[k] for o in orders])[None, :] for k in (2, 3))
    fails, out_before = (masks & bit) > 0, (masks & before) > 0
    here = (fails & ~out_before).astype(np.int64)
    figures = {"kept": ((masks & (before | bit)) == 0).astype(np.int64), "removed": here, "redundant": (fails & out_before).astype(np.int64),
               "unique_fails": (masks == bit).astype(np.int64)}
    failed = np.array([max(1, int(m).bit_count()) for m in masks[:, 0]])[:, None]
    shares = fails * (len(orders) // len(FILTERS) // failed)  # in so many of the orders it comes first of the filters a text fails
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                        *[(x, pa.int64()) for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])
    for batch in batches:
        for part, counted in zip(*[c.to_pylist() for c in batch.columns]):
            n = np.zeros((3, len(masks)), np.int64)
            for x in counted:
                n[:, x["mask"]] += (x["n"], x["good"], x["toxic"])
            columns = {k: n[0] @ m for k, m in figures.items()} | {"good_lost": n[1] @ here, "toxic_lost": n[2] @ here, "shapley": n[0] @ shares}
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders)), pa.array([o[0] for o in orders]), pa.array([o[1] for o in orders], pa.int32()),
                                              *[pa.array(columns[f.name], f.type) for f in list(schema)[3:]]], schema=schema)


def audit(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Per part, order of the filters and step: what the step removes, and what of it others would have removed.

    ``masks`` are the rows of ``flags``; ``labels`` say which ids are good (quality 1) or toxic (1).
    """
    known = labels.groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.max(F.col(f"`{quality_col}`") == 1).alias("good"), F.max(F.col(f"`{toxic_col}`") == 1).alias("toxic"))
    joined = masks.join(written(known, f"{scratch_path(masks.sparkSession, 'labels')}"), "doc_id", "left")
    counts = joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    lists = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counted"))  # 32 at the most
    return arrow_map(lists, _reports, AUDIT_SCHEMA)
