"""Near duplicates by ProbMinHash, banding and verification.

Every different shingle of five words is an element whose weight grows with how
often it stands in the text, from 1 to 9/8. Its arrivals form a Poisson process with that
rate, drawn from the shingle's hash, and each arrival hits a random register;
a register keeps the shingle that came first. Arrivals are drawn for all
shingles a few at a time and a shingle leaves once its next one is later than
all registers, which ends the work early. Two texts agree in a register with
the probability Jaccard of their weighted shingles. As no weight is over 9/8 of
another, that is at least 8/9 of the Jaccard similarity of the sets of
shingles, by which pairs are judged, whatever repeats in one of the texts.

Registers are banded. In a band's bucket every text meets the bucket's hub (the
first text in one of eight random orders, by the band). Two
texts at 0.8 share about sixteen buckets. Pairs
that met are verified on the exact sets of shingles of the whole texts, and
linked texts form classes.

Where a bucket of three or more texts is not all one class then, hubs have not
answered for every pair in it. Its texts are joined exactly, however they fell
into bands: shingles are put in the order of how many of these texts hold them,
and two texts at 0.8 must share one among the rarest few of each (``rest``).
Every pair of texts that such a shingle brings together and that is not of one
class is compared, unless lengths or places in the order rule it out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, doc_type, id_text, keep_smaller, written
from millrace.session import scratch_path

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 4  # two texts at 0.8 agree in a register with 0.71 at the least: one pair in 100,000 meets in no band; at equal weights one in a thousand million
MOST_WEIGHT = 1 / 8  # that repeats add to the weight of 1
REGISTERS = BANDS * ROWS
MOST_WORDS = 300_000
SALTED = 2_000  # texts with one shingle among their rarest that one task compares
_WORDS: dict[str, int] = {}  # hashes of words, one table per worker process
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of every run of five words, in order; a shorter text is one shingle, an empty one has none."""
    import xxhash

    keep_smaller(_WORDS, MOST_WORDS)
    if not words:
        return np.zeros(0, np.uint64)
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        out = _mix(out * _GOLD + h[k : len(h) - width + 1 + k])
    return out


def signature(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The element that arrives first at each register."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    if not len(elements):
        return owner
    live, rate, clock, count = elements, weights, np.zeros(len(elements)), 0
    while len(live):
        draws = max(1, -(-registers // len(live)))
        turns = np.arange(count, count + draws, dtype=np.uint64)
        raw = _mix(live[:, None] + (turns * np.uint64(2) + np.uint64(1))[None, :] * _GOLD)
        gaps = -np.log1p(-(raw >> np.uint64(11)).astype(float) * 2.0**-53) / rate[:, None]
        times = clock[:, None] + np.cumsum(gaps, axis=1)
        at = (_mix(raw ^ _M1) % np.uint64(registers)).astype(np.int64)
        t, r = times.ravel(), at.ravel()
        early = np.flatnonzero(t < first[r])
        early = early[np.argsort(-t[early], kind="stable")]
        first[r[early]] = t[early]  # the last one written is the earliest
        owner[r[early]] = live[early // draws]
        clock, count = times[:, -1], count + draws
        stay = clock < first.max()
        live, rate, clock = live[stay], rate[stay], clock[stay]
    return owner


def bands_of(text: str) -> tuple[bytes, np.ndarray]:
    """128-bit key of the sequence of words, and one 64-bit hash per band (none for a text without words)."""
    import xxhash

    words = text.split()
    hashes = shingle_hashes(words)
    elements, counts = np.unique(hashes, return_counts=True)
    key = xxhash.xxh3_128_digest("\x1f".join(words).encode("utf-8", "surrogatepass"))
    if not len(elements):
        return key, np.zeros(0, np.int64)
    owner = signature(elements, 1 + MOST_WEIGHT * np.minimum(np.log(counts), 1)).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) + _M2
    for c in owner.T:
        h = _mix(h * _GOLD + c)
    # The lowest bits of a bucket say in which of eight orders its first text is the hub.
    return key, ((h << np.uint64(3)) | (np.arange(BANDS, dtype=np.uint64) & np.uint64(7))).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [bands_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([k for k, _ in got], pa.binary()), pa.array([b for _, b in got], pa.list_(pa.int64()))],
                                         names=["doc_id", "md5", "key", "bands"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _verifier(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, hubs = batch.column(0).to_pylist(), [], batch.column(2)
            for k, text in enumerate(batch.column(3).to_pylist()):
                if a[k] != hub:
                    hub, held = a[k], np.unique(shingle_hashes(hubs[k].as_py().split()))
                b.append(jaccard(held, np.unique(shingle_hashes(text.split()))) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(b, pa.bool_()))

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, root, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = np.unique(shingle_hashes(text.split())).view(np.int64)
            for k in range(0, len(own), 100_000):
                part = own[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x, np.int64)) for x in (node, root, len(own))] + [pa.array(part)],
                                                 names=["node", "root", "size", "shingle"])


def rest(texts: DataFrame, folder: str, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (``a``, ``b``) of ``texts`` (``node``, ``root``, ``text``) of different roots that may reach the similarity: none that does is left out.

    Shingles stand in the order of how many of the texts hold them. The first
    one that two similar texts share stands among the first
    ``size - ceil(t * size) + 1`` of the longer text, and among the first
    ``size - ceil(2t / (1 + t) * size) + 1`` of the shorter one; what is behind
    it bounds what they can share in all.
    """
    spark = texts.sparkSession
    rows = written(arrow_map(texts, _shingle_rows, "node long, root long, size long, shingle long"), f"{folder}/shingles")
    held = written(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/held")
    common = rows.join(held, "shingle")
    own = Window.partitionBy("node")
    # Shingles that no other text holds come first and are not listed: they only move the others back.
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "shingle")) - 1
    size, t = F.col("size"), float(similarity)
    ranked = common.withColumn("place", place)
    least = F.ceil(size * t - 1e-9)  # a rounding error may only widen what is looked at
    both = F.ceil(size * (2 * t / (1 + t)) - 1e-9)
    first = written(ranked.where(F.col("place") <= size - least).withColumn("short", F.col("place") <= size - both).select("shingle", "node", "root", "size", "place", "short"), f"{folder}/first")
    groups = written(first.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
                     .select("shingle", F.ceil(F.col("n") / SALTED).cast("int").alias("parts")), f"{folder}/groups")
    dealt = first.join(groups, "shingle")
    longer = dealt.select("shingle", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), *(F.col(c).alias(f"{c}_l") for c in ("node", "root", "size", "place")))
    shorter = dealt.where("short").select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_s") for c in ("node", "root", "size", "place")))
    ordered = (F.col("size_s") < F.col("size_l")) | (F.col("size_s") == F.col("size_l")) & (F.col("node_s") < F.col("node_l"))
    behind = F.least(F.col("size_l") - F.col("place_l"), F.col("size_s") - F.col("place_s"))
    possible = (F.col("root_s") != F.col("root_l")) & ordered & (F.col("size_s") >= F.col("size_l") * t - 1e-9) & (behind >= (F.col("size_s") + F.col("size_l")) * (t / (1 + t)) - 1e-9)
    met = longer.join(shorter, ["shingle", "part"]).where(possible)
    return met.select(F.least("node_s", "node_l").alias("a"), F.greatest("node_s", "node_l").alias("b")).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node`` and ``root`` (least node reached) of every node with an edge (``a``, ``b``).

    Every round hangs each node's larger neighbours, then its smaller ones, on
    its least neighbour, and writes the edges; it ends when they are all stars.
    """
    spark = edges.sparkSession
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    turn, last = 0, None
    while True:
        path = f"{folder}/edges-{turn}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        last, turn = state, turn + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")), f"{path}-least")  # read back, so that the join splits a hub
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(large, f"{path}-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{path}-lower")
        joined = large.join(least, "u")
        now = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _degrees(pairs: DataFrame, path: str) -> DataFrame:
    return written(pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d")), path)


def _verified(pairs: DataFrame, degree: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs that reach the similarity on their whole texts (``node``, ``text``)."""
    # The end with more partners comes as the hub, whose shingles are kept from one row to the next.
    turned = (pairs.join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
              .select(F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("node")))
    full = (turned.join(texts.select("node", "text"), "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
            .select("hub", "node", "hub_text", "text").sortWithinPartitions("hub"))
    return arrow_map(full, _verifier(similarity), "hub long, node long").select(F.col("hub").alias("a"), F.col("node").alias("b"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, ``class_id`` (least key in the class), ``class_size`` (rows in it), ``text_class`` (one number for texts with the same words).

    Texts with the same words in order are copies and one node. Nodes are
    linked if at least ``similarity`` of their different five-word shingles are
    shared. A text of one to four words is one shingle; texts without words
    (null ones too) are copies of each other. Rows with null keys take part; a
    class of nothing else has a null ``class_id``. An empty table gives no
    rows; other columns are ignored.
    """
    return _classes(docs, similarity, id_col, text_col)[0]


def _classes(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Classes of all rows, and the written sketches with the row (key and md5 of the text) that stands for each class."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "near")
    source = id_text(docs, id_col, text_col).withColumn("md5", F.md5(F.col("text").cast("binary")))
    arrow_map(source, _sketch, f"doc_id {doc_type(docs, id_col)}, md5 string, key binary, bands array<long>").write.parquet(f"{folder}/sketches")
    sketches = spark.read.parquet(f"{folder}/sketches")
    (sketches.groupBy("key").agg(F.min(F.struct("doc_id", "md5")).alias("bearer"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
     .withColumn("node", F.monotonically_increasing_id()).write.parquet(f"{folder}/nodes"))
    nodes = spark.read.parquet(f"{folder}/nodes")  # written, so that numbers stay what they are
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    turn = F.xxhash64("node", F.col("bucket").bitwiseAND(F.lit(7)))
    hubs = places.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("node", turn).alias("hub")).where("n > 1")
    beside = written(places.join(written(hubs, f"{folder}/hubs"), "bucket"), f"{folder}/beside")
    met = beside.where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    bearers = nodes.select("node", F.col("bearer.doc_id").alias("_id"), F.col("bearer.md5").alias("_md5"))

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        bearer = bearers.join(wanted, "node")
        return written(source.join(bearer, source["doc_id"].eqNullSafe(bearer["_id"]) & (source["md5"] == bearer["_md5"])).select(*wanted.columns, "text"), f"{folder}/{name}")

    pairs = written(met, f"{folder}/pairs")
    degree = _degrees(pairs, f"{folder}/degrees")
    texts = texts_of(degree.select(F.col("n").alias("node")), "texts")
    roots = components(_verified(pairs, degree, texts, similarity), folder)
    # Buckets of three or more that are not all one class: the pairs in them without the hub are still to be compared.
    classed = beside.where("n > 2").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = written(classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket"), f"{folder}/mixed")
    left = written(classed.join(mixed, "bucket").select("node", "root").distinct(), f"{folder}/left")
    more = written(rest(texts.join(left, "node").select("node", "root", "text"), folder, similarity), f"{folder}/more")
    found = _verified(more, _degrees(more, f"{folder}/more-degrees"), texts, similarity)
    held = written(found.join(left.select(F.col("node").alias("a"), F.col("root").alias("u")), "a").join(left.select(F.col("node").alias("b"), F.col("root").alias("v")), "b")
                   .select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), f"{folder}/joined")
    if not held.isEmpty():
        higher = components(held, f"{folder}/higher").select(F.col("node").alias("root"), F.col("root").alias("above"))
        every = roots.unionByName(higher.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti"))
        roots = written(every.join(higher, "root", "left").select("node", F.coalesce("above", "root").alias("root")), f"{folder}/roots")
    owned = nodes.select("node", "key", "bearer", "first_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = owned.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("bearer").alias("stays"))
    named = owned.join(sizes, "root").select("key", "class_id", "class_size", "node")
    return sketches.select("doc_id", "key").join(named, "key").select("doc_id", "class_id", "class_size", F.col("node").alias("text_class")), sizes.select("stays.*")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the least key, null keys first.

    Of rows that share key and text, one stays. All columns stay as they are, whatever their names. Null and empty texts
    are copies of each other; an empty table stays empty. A very long text is held once, as its different shingles.
    """
    _, stays = _classes(docs, similarity, id_col, text_col)
    # All columns travel in one, so that none can clash.
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                         F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("md5"))
    named = stays.select(F.col("doc_id").alias("its_id"), F.col("md5").alias("its_md5"))
    kept = marked.join(named, marked["doc_id"].eqNullSafe(named["its_id"]) & (marked["md5"] == named["its_md5"]))
    return kept.dropDuplicates(["doc_id", "md5"]).select("row.*")
