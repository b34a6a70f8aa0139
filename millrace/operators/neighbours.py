"""Exact nearest neighbours, classification and regression by them, k-means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from millrace.operators.ranking import hash_order, top_k
from millrace.session import checkpoint, spread

# Queries are sent to every task only up to this many bytes of vectors.
BROADCAST_BYTES = 64 * 1024 * 1024
# Beyond that: rows per side of a tile, queries that a task sends on at a time, numbers in a matrix of distances,
# bytes of pivot vectors, rings around a pivot.
TILE_ROWS = 20_000
SENT_ROWS = 10_000
MATRIX = 1_000_000
PIVOT_BYTES = 16 * 1024 * 1024
RINGS = 4

FOUND = StructType([StructField("query_id", LongType()), StructField("row_id", LongType()), StructField("distance", DoubleType())])


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distance of every query to every row, in double precision."""
    if metric == "cosine":
        lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        return 1.0 - (queries @ rows.T) / np.where(lengths == 0, 1.0, lengths)
    if metric == "euclidean":
        squares = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2.0 * (queries @ rows.T)
        return np.sqrt(np.maximum(squares, 0.0))
    power = 1.0 if metric == "manhattan" else float(p)
    out = np.empty((len(queries), len(rows)))
    for i, query in enumerate(queries):
        gap = np.abs(rows - query)
        # A product is many times as fast as a power.
        out[i] = (gap * gap * gap if power == 3.0 else gap**power).sum(1) ** (1.0 / power)
    return out


def _nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest per line, ties by id."""
    k = min(k, distance.shape[1])
    if distance.shape[1] > 4 * k:
        # Everything up to the k-th value, so that ties at the cut survive.
        cut = np.partition(distance, k - 1, axis=1)[:, k - 1]
        width = int((distance <= cut[:, None]).sum(1).max())
        keep = np.argpartition(distance, width - 1, axis=1)[:, :width]
        distance, ids = np.take_along_axis(distance, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, distance), axis=1)[:, :k]
    return np.take_along_axis(distance, order, 1), np.take_along_axis(ids, order, 1)


def _frame(query_ids: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({
        "query_id": np.repeat(query_ids, distance.shape[1]),
        "row_id": ids.reshape(-1),
        "distance": distance.reshape(-1),
    })


def _search(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int, metric: str, p: float, others: bool):
    """Best k of one block of rows for all queries, some queries at a time. With ``others`` a row is no answer to itself."""
    parts = []
    step = max(1, 4_000_000 // max(1, len(rows)))
    for at in range(0, len(queries), step):
        part = queries[at:at + step]
        distance = _distances(part, rows, metric, p)
        if others:
            distance[query_ids[at:at + step, None] == row_ids[None, :]] = np.inf
        parts.append(_nearest(distance, np.broadcast_to(row_ids, distance.shape), k))
    return np.concatenate([d for d, _ in parts]), np.concatenate([i for _, i in parts])


def nearest(queries: DataFrame, store: DataFrame, k: int, metric: str = "euclidean", p: float = 2.0, others: bool = False) -> DataFrame:
    """The k nearest rows of ``store`` (row_id, vector) for every query
    (query_id, vector): query_id, row_id, distance, rank. Exact.

    With ``others`` the row whose id is the query's is left out. Each task keeps
    k candidates per query of the rows it holds, so only queries x k rows per
    task are exchanged. Queries travel to the tasks as a broadcast while their
    vectors stay under BROADCAST_BYTES; beyond that ``nearest_by_pivots`` sends
    a query only where an answer can be.
    """
    wanted, rows = _plain_sides(queries, store)
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if size.n == 0:
        return store.sparkSession.createDataFrame([], FOUND).withColumn("rank", F.lit(1))
    if size.n * size.d * 8 > BROADCAST_BYTES:
        return nearest_by_pivots(queries, store, k, metric, p, others)
    found = _search_broadcast(wanted, rows, k, metric, p, others)
    return top_k(found, ["query_id"], [F.col("distance"), F.col("row_id")], k)


def _plain_sides(queries: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")),
            store.select(F.col("row_id").cast("long"), F.col("vector").cast("array<double>")))


def _search_broadcast(wanted: DataFrame, rows: DataFrame, k: int, metric: str, p: float, others: bool) -> DataFrame:
    local = wanted.toPandas()
    ids = local["query_id"].to_numpy()
    vectors = np.stack(local["vector"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_vectors = shared.value
        best_d = best_i = None
        for batch in batches:
            if batch.empty:
                continue
            d, i = _search(query_ids, query_vectors, batch["row_id"].to_numpy(), np.stack(batch["vector"].to_numpy()), k, metric, p, others)
            if best_d is not None:
                d, i = _nearest(np.concatenate([best_d, d], 1), np.concatenate([best_i, i], 1), k)
            best_d, best_i = d, i
        if best_d is not None:
            found = _frame(query_ids, best_d, best_i)
            yield found[np.isfinite(found["distance"])]

    return rows.mapInPandas(search, FOUND)


# --- pivots --------------------------------------------------------------------


def _metric_space(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Coordinates whose distance obeys the triangle inequality. Of cosine: unit
    vectors, whose squared distance is twice the cosine distance; a vector of
    zeros gets a direction of its own."""
    if metric != "cosine":
        return vectors
    lengths = np.linalg.norm(vectors, axis=1)[:, None]
    return np.hstack([vectors / np.where(lengths == 0, 1.0, lengths), (lengths == 0).astype(float)])


class _Blocks:
    """Pivots and, for each block of rows around one of them, their least and greatest distance to it, their count and their tiles."""

    def __init__(self, pivots: np.ndarray, blocks: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, most: int, metric: str, p: float):
        self.pivots, self.blocks, self.low, self.high, self.rows = pivots, blocks, low, high, rows
        self.tile, self.cuts = _dealt(rows, most)
        self.metric, self.space, self.p = metric, "euclidean" if metric == "cosine" else metric, p

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance that no row of a block falls below, and one that none exceeds, for every vector and block."""
        away = _distances(_metric_space(vectors, self.metric), self.pivots, self.space, self.p)[:, self.blocks // RINGS]
        slack = 1e-7 + 1e-9 * away
        return np.maximum(np.maximum(away - self.high, self.low - away) - slack, 0.0), away + self.high

    def first(self, lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
        """Blocks to look into first: the nearest ones that hold k rows besides the query."""
        order = np.lexsort((upper, lower), axis=1)
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(lower.shape, bool)
        np.put_along_axis(out, order, before < k + 1, 1)
        return out

    def later(self, lower: np.ndarray, limit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Other blocks that can hold a row within ``limit`` (NaN: no limit known)."""
        reach = np.sqrt(2.0 * np.maximum(limit, 0.0)) if self.metric == "cosine" else limit
        return ~first & ~(lower > reach[:, None])


def _blocked(rows: DataFrame, metric: str, p: float) -> tuple[DataFrame, _Blocks] | None:
    """Rows with their block (checkpointed), and what the blocks hold."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if size.n == 0:
        return None
    most = int(max(1, min(np.ceil(np.sqrt(size.n)), PIVOT_BYTES // (8 * size.d))))
    chosen = rows.select("vector", "row_id", hash_order("row_id", "pivot").alias("_h")).orderBy("_h", "row_id").limit(most).collect()
    pivots = _metric_space(np.array([r.vector for r in chosen]), metric)
    space = "euclidean" if metric == "cosine" else metric

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            step = max(1, MATRIX // len(pivots))
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                away = _distances(_metric_space(np.stack(part["vector"].to_numpy()), metric), pivots, space, p)
                yield part.assign(pivot=away.argmin(1).astype("int32"), away=away.min(1))

    placed = checkpoint(rows.mapInPandas(place, "row_id long, vector array<double>, pivot int, away double"))
    edges = placed.groupBy("pivot").agg(F.min("away").alias("near"), F.max("away").alias("far"))
    ring = F.least(F.floor(RINGS * F.coalesce(F.try_divide(F.col("away") - F.col("near"), F.col("far") - F.col("near")), F.lit(0.0))), F.lit(RINGS - 1))
    ringed = placed.join(F.broadcast(edges), "pivot").select((F.col("pivot") * RINGS + ring).cast("int").alias("block"), "row_id", "vector", "away")  # a row a pivot
    held = sorted(tuple(r) for r in ringed.groupBy("block").agg(F.min("away"), F.max("away"), F.count(F.lit(1))).collect())
    block, low, high, n = (np.array(x) for x in zip(*held))
    # Small tables are cut finer, so that every core has a tile.
    most = min(TILE_ROWS, max(500, size.n // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    about = _Blocks(pivots, block, low, high, n, most, metric, p)
    tiles = rows.sparkSession.createDataFrame(list(zip(block.tolist(), about.tile.tolist(), about.cuts.tolist())), "block int, first int, cuts int")
    tile = (F.col("first") + F.pmod(F.xxhash64("row_id"), F.col("cuts").cast("long"))).cast("int").alias("tile")
    return ringed.join(F.broadcast(tiles), "block").select(tile, "block", "row_id", "vector"), about


def _dealt(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First tile and number of tiles of every block: small blocks share a tile of ``most`` rows, large ones are cut."""
    first, cuts, at, held = [], [], 0, 0
    for n in rows.tolist():
        if held and held + n > most:
            at, held = at + 1, 0
        first.append(at)
        cuts.append(max(1, -(-n // most)))
        at, held = (at + cuts[-1], 0) if cuts[-1] > 1 else (at, held + n)
    return np.array(first), np.array(cuts)


def _sent(query_ids: np.ndarray, vectors: Sequence[np.ndarray], chosen: np.ndarray, about: _Blocks) -> Iterator[pd.DataFrame]:
    """Queries for the tiles that hold a chosen block, once a tile, with the blocks to look into; some MB at a time."""
    query, block = np.nonzero(chosen)
    tile, cuts = about.tile[block], about.cuts[block]
    # Pairs stand in the order of query and tile: a run is one row.
    starts = np.flatnonzero(np.r_[True, (np.diff(query) != 0) | (np.diff(tile) != 0)]) if len(query) else np.array([], int)
    ends = np.r_[starts[1:], len(query)]
    run, extra = np.repeat(np.arange(len(starts)), cuts[starts]), np.concatenate([np.arange(c) for c in cuts[starts]] or [np.array([], int)])
    for at in range(0, len(run), SENT_ROWS):
        part = run[at:at + SENT_ROWS]
        heads = starts[part]
        yield pd.DataFrame({
            "tile": (tile[heads] + extra[at:at + SENT_ROWS]).astype("int32"), "query_id": query_ids[query[heads]],
            "vector": [vectors[q] for q in query[heads]], "blocks": [about.blocks[block[i:j]].astype("int32") for i, j in zip(heads, ends[part])],
        })


def _best_in_tile(a: pd.DataFrame, b: pd.DataFrame, k: int, metric: str, p: float, others: bool) -> pd.DataFrame:
    """Best k of every query of ``a`` among the rows of ``b`` that lie in its blocks, one block at a time."""
    ids, vectors = a["query_id"].to_numpy(), np.stack(a["vector"].to_numpy())
    row_ids, rows, at = b["row_id"].to_numpy(), np.stack(b["vector"].to_numpy()), b["block"].to_numpy()
    asked = np.concatenate(a["blocks"].to_numpy())
    asker = np.repeat(np.arange(len(a)), [len(x) for x in a["blocks"]])
    by_block, by_row = np.argsort(asked, kind="stable"), np.argsort(at, kind="stable")
    asked, asker, at = asked[by_block], asker[by_block], at[by_row]
    best_d, best_i = np.full((len(a), k), np.inf), np.full((len(a), k), np.iinfo("int64").max)
    for block in np.unique(at):
        who = asker[np.searchsorted(asked, block):np.searchsorted(asked, block, "right")]
        here = by_row[np.searchsorted(at, block):np.searchsorted(at, block, "right")]
        if len(who):
            d, i = _search(ids[who], vectors[who], row_ids[here], rows[here], k, metric, p, others)
            best_d[who], best_i[who] = _nearest(np.concatenate([best_d[who], d], 1), np.concatenate([best_i[who], i], 1), k)
    found = _frame(ids, best_d, best_i)
    return found[np.isfinite(found["distance"])]


def _tiles(routed: DataFrame, ringed: DataFrame, k: int, metric: str, p: float, others: bool) -> DataFrame:
    """Best k of every query in every tile it is sent to. A tile with many queries is cut into parts of TILE_ROWS of them."""
    asked = {r.tile: r["count"] for r in routed.groupBy("tile").count().collect()}  # some for each TILE_ROWS rows, at most one a block more
    cuts = [(tile, -(-n // TILE_ROWS)) for tile, n in asked.items()]
    if not cuts:
        return routed.sparkSession.createDataFrame([], FOUND)
    parts = F.broadcast(routed.sparkSession.createDataFrame(cuts, "tile int, qs long"))
    left = routed.join(parts, "tile").select("tile", F.pmod(F.xxhash64("query_id"), "qs").alias("q"), "query_id", "vector", "blocks")
    right = ringed.join(parts, "tile").select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)).alias("q"), "block", "row_id", "vector")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "row_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        return _best_in_tile(a, b, k, metric, p, others)

    return left.groupBy("tile", "q").cogroup(right.groupBy("tile", "q")).applyInPandas(search, FOUND)


def nearest_by_pivots(queries: DataFrame, store: DataFrame, k: int, metric: str = "euclidean", p: float = 2.0, others: bool = False) -> DataFrame:
    """The same result as ``nearest`` for any number of queries. Exact.

    Rows belong to the nearest of about sqrt(n) pivots and lie in rings around
    it. A query first looks into the blocks it stands nearest to; its k-th
    distance there and the triangle inequality say which other blocks can hold
    something nearer, and it looks into those only. Blocks lie together in tiles; a
    query travels once to a tile, whatever number of its blocks it must look into,
    so that at most queries x rows / TILE_ROWS vectors are exchanged where the
    triangle inequality excludes nothing. Cosine goes by unit vectors.
    """
    wanted, rows = _plain_sides(queries, store)
    made = _blocked(rows, metric, p)
    if made is None:
        return store.sparkSession.createDataFrame([], FOUND).withColumn("rank", F.lit(1))
    ringed, about = made
    shared = store.sparkSession.sparkContext.broadcast(about)

    def route(second: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks = shared.value
            step = max(1, MATRIX // len(blocks.blocks))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.iloc[at:at + step]
                    vectors = part["vector"].to_numpy()
                    lower, upper = blocks.bounds(np.stack(vectors))
                    chosen = blocks.first(lower, upper, k)
                    if second:
                        chosen = blocks.later(lower, part["limit"].to_numpy(float), chosen)
                    yield from _sent(part["query_id"].to_numpy(), vectors, chosen, blocks)
        return run

    schema = "tile int, query_id long, vector array<double>, blocks array<int>"
    near = checkpoint(top_k(_tiles(wanted.mapInPandas(route(False), schema), ringed, k, metric, p, others), ["query_id"], [F.col("distance"), F.col("row_id")], k).drop("rank"))
    limits = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("limit"))
    again = wanted.join(limits, "query_id", "left").select("query_id", "vector", "limit")
    far = _tiles(checkpoint(again.mapInPandas(route(True), schema)), ringed, k, metric, p, others)
    return top_k(near.unionByName(far), ["query_id"], [F.col("distance"), F.col("row_id")], k)


def classify(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Most frequent label among the neighbours, ties to the smallest label.

    ``labels``: row_id, label.
    """
    votes = found.join(labels, "row_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return top_k(votes, ["query_id"], [F.desc("votes"), F.col("label")], 1, "_r").select("query_id", F.col("label").alias("predicted"), "votes")


def regress(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean target of the neighbours. ``targets``: row_id, target."""
    return found.join(targets, "row_id").groupBy("query_id").agg(F.round(F.avg("target"), 6).alias("predicted"), F.count(F.lit(1)).alias("n"))


# --- k-means -------------------------------------------------------------------


def _closest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of every vector (ties to the lower one)."""
    return np.stack([((vectors - c) ** 2).sum(1) for c in centres], axis=1).argmin(axis=1)


def assigned(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Every row with its nearest centre. The centres (k x dimensions numbers)
    travel with the task; rows are worked on in Arrow batches."""
    points = np.array(centres, dtype=float)
    schema = StructType(df.schema.fields + [StructField("cluster", IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield batch.assign(cluster=_closest(np.stack(batch[vector].to_numpy()), points).astype("int32"))

    return df.mapInPandas(run, schema)


# Numbers of one packed block of vectors, and partial sums that the driver adds up itself.
BLOCK_NUMBERS, DRIVER_NUMBERS = 1 << 20, 1 << 21


def _packed(df: DataFrame, vector: str) -> DataFrame:
    """The vectors as blocks of plain doubles, so that a pass over them converts nothing row by row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                step = max(1, BLOCK_NUMBERS // max(1, vectors.shape[1]))
                blocks = [vectors[at : at + step].tobytes() for at in range(0, len(vectors), step)]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])

    return df.select(F.col(vector).cast("array<double>")).mapInArrow(pack, "block binary")


def _moved(blocks: DataFrame, centres: Sequence[Sequence[float]]) -> list[list[float]]:
    """The mean of every cluster. An empty cluster keeps its centre.

    A task sends one count and one sum vector per cluster. The driver adds up to ``DRIVER_NUMBERS`` of those
    numbers itself, in the order of the tasks; beyond that an exchange does, and clusters x dimensions come back.
    """
    points = np.array(centres, dtype=float)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(points), dtype="int64"), np.zeros_like(points)
        for batch in batches:
            for block in batch.column(0):
                vectors = np.frombuffer(block.as_buffer(), dtype=float).reshape(-1, points.shape[1])
                nearest_centre = _closest(vectors, points)
                found, starts = np.unique(np.sort(nearest_centre), return_index=True)
                counts += np.bincount(nearest_centre, minlength=len(points))
                sums[found] += np.add.reduceat(vectors[np.argsort(nearest_centre, kind="stable")], starts)
        columns = [pa.array(np.arange(len(points), dtype="int32")), pa.array(counts), pa.array(list(sums), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "total"])

    parts = blocks.mapInArrow(partial, "cluster int, n long, total array<double>").filter("n > 0")
    moved = points.copy()
    if blocks.rdd.getNumPartitions() * points.size <= DRIVER_NUMBERS:
        counts, sums = np.zeros(len(points)), np.zeros_like(points)
        for row in parts.collect():
            counts[row.cluster] += row.n
            sums[row.cluster] += row.total
        moved[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        return moved.tolist()
    totals = parts.select("cluster", "n", F.posexplode("total").alias("position", "x")).groupBy("cluster", "position").agg(
        (F.sum("x") / F.sum("n")).alias("mean")
    )
    for row in totals.collect():
        moved[row.cluster, row.position] = row["mean"]
    return moved.tolist()


def updated_centres(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> list[list[float]]:
    """One step: the mean of every cluster. An empty cluster keeps its centre."""
    return _moved(_packed(df, vector), centres)


def initial_centres(df: DataFrame, identifier: str, vector: str, k: int, seed: str) -> list[list[float]]:
    """The vectors of the k rows lowest in hash order."""
    rows = df.select(vector, hash_order(identifier, seed).alias("_h"), identifier).orderBy("_h", identifier).limit(k).collect()
    return [[float(x) for x in row[0]] for row in rows]


def k_means(df: DataFrame, identifier: str, vector: str, k: int, seed: str, max_iterations: int = 500, tolerance: float = 1e-5) -> tuple[DataFrame, list[list[float]], int]:
    """Assignments, centres and iterations. Stops when no coordinate of any
    centre moves by ``tolerance``."""
    centres = initial_centres(df, identifier, vector, k, seed)
    blocks = _packed(spread(df.select(vector)), vector).persist()
    iterations = 0
    while iterations < max_iterations:
        moved = _moved(blocks, centres)
        iterations += 1
        done = np.all(np.abs(np.array(moved) - np.array(centres)) < tolerance)
        centres = moved
        if done:
            break
    blocks.unpersist()
    return assigned(df.select(identifier, F.col(vector).cast("array<double>").alias(vector)), vector, centres), centres, iterations
