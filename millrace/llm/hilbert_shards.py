"""Shards along a Hilbert curve, so that files can be left out by several columns at once.

Some metadata columns are quantised into 2**bits cells each, by borders that hold about equal shares of the rows. The
index of a row's cell on the Hilbert curve orders the table, and shards are runs of that order: rows that are near in
all of these columns stand in the same shard, and a question about any of them needs few shards.

Rows of one cell, however many, stand in the order of a hash of key and text. The curve and that hash give every row
its place up to a small error before anything is sorted, which cuts the table into as many runs of about equal bytes as
files are wanted. A run is one group of one task, and its first ordinal is the number of rows in earlier runs. Texts are
exchanged once. Shard counts differ by one at the most (law ``rows``).

Nulls and NaN of a column count as its lowest cell. Rows without a key or text are rows like any other. Repeated rows
are dealt as often as they are there; rows equal in key and text may change places with each other, which no result
shows. An empty table has no shards. A long text costs its bytes, nothing is kept of it but its hash. All columns of
the table come back as they were, in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bounded_batches, written
from millrace.session import scratch_path, spread

SHARDS, BITS, MOST_BITS = 16, 5, 16  # at most 2**MOST_BITS cells in all: the table of cells is broadcast
HEAD = 6  # bytes of a string that say where it stands
ACCURACY = 10_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each column of ``cells`` (dimensions x points, numbers below 2**bits)."""
    x = cells.astype(np.int64)
    n = len(x)
    for k in range(bits - 1, 0, -1):  # undo the turns and mirrorings of the larger squares
        low = (1 << k) - 1
        for i in range(n):
            mirror = (x[i] >> k) & 1 == 1
            swap = np.where(mirror, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirror, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for k in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> k) & 1 == 1, (1 << k) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> k) & 1)
    return out


def as_number(df: DataFrame, dimension: str | Column) -> Column:
    """A number that keeps the order of the values (of strings: of their first six bytes)."""
    column = F.col(f"`{dimension}`") if isinstance(dimension, str) else dimension
    kind = df.select(column.alias("c")).schema[0].dataType
    if isinstance(kind, T.BooleanType):
        column = column.cast("int")
    elif isinstance(kind, T.DateType):
        column = F.unix_date(column)
    elif not isinstance(kind, (T.NumericType, T.TimestampType)):
        head = F.hex(F.substring(column.cast("string").cast("binary"), 1, HEAD))
        column = F.conv(F.rpad(head, 2 * HEAD, "0"), 16, 10)
    return column.cast("double")


@dataclass(frozen=True)
class Layout:
    """Shards on disk. ``row`` holds the table's own columns; ``shard`` and ``slot`` say where the row stands."""

    spark: SparkSession
    folder: str
    dimensions: tuple[str, ...]
    schema: T.StructType

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/shards")

    def boxes(self) -> DataFrame:
        """Per shard the rows and, for each dimension, the lowest and highest number in it and whether it has nulls."""
        return self.spark.read.parquet(f"{self.folder}/boxes")

    def shards_for(self, **ranges: tuple[float | str | None, float | str | None]) -> list[int]:
        """Shards that can hold rows with every named dimension within its range (both ends included, None: open)."""
        keep = F.lit(True)
        for name, (low, high) in ranges.items():
            k = self.dimensions.index(name)
            one = self.spark.range(1)
            for value, side in ((low, F.col(f"high_{k}").__ge__), (high, F.col(f"low_{k}").__le__)):
                if value is not None:
                    keep = keep & side(F.lit(one.select(as_number(one, F.lit(value))).first()[0]))
        return sorted(r.shard for r in self.boxes().where(keep).select("shard").collect())  # one row per shard

    def read(self, **ranges) -> DataFrame:
        """The table's columns, from the shards that can hold such rows only; the caller filters the rows."""
        return self.rows().where(F.col("shard").isin(self.shards_for(**ranges))).select("row.*")


def write_shards(df: DataFrame, dimensions: dict[str, str | Column], shards: int = SHARDS, bits: int = BITS,
                 id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> Layout:
    """Write ``df`` as ``shards`` runs of the Hilbert order of ``dimensions`` (a name for each, and its column).

    ``files`` is the number of runs that are sorted and written one by one; by default twice the shards or the
    session's shuffle partitions, if those are more.
    """
    if bits * len(dimensions) > MOST_BITS:
        raise ValueError(f"{len(dimensions)} dimensions of {bits} bits make more than 2**{MOST_BITS} cells")
    spark = df.sparkSession
    bounded_batches(spark)
    folder = scratch_path(spark, "hilbert")
    files = files or max(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbers = [as_number(df, c).alias(f"d{k}") for k, c in enumerate(dimensions.values())]
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = spread(df).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *numbers,
                               F.xxhash64(key.cast("string"), text).alias("x"), (F.octet_length(text) + 1).cast("long").alias("bytes"))
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = source.agg(*[F.percentile_approx(F.nanvl(f"d{k}", F.lit(None)), share, ACCURACY) for k in range(len(numbers))]).first()
    borders = [np.array(b or [], float) for b in found]

    @F.pandas_udf("int")
    def place(values: pd.DataFrame) -> pd.Series:
        cells = [np.where(np.isnan(v), 0, np.searchsorted(b, v, side="left"))
                 for b, v in zip(borders, (values[c].to_numpy(float, na_value=np.nan) for c in values.columns))]
        return pd.Series(hilbert_index(np.array(cells), bits))

    placed = source.withColumn("h", place(F.struct(*[f"d{k}" for k in range(len(numbers))])))
    keys = written(placed.select("h", "x", "bytes"), f"{folder}/keys")
    cells = sorted(tuple(r) for r in keys.groupBy("h").agg(F.sum("bytes")).collect())  # bounded by the cells, 2**MOST_BITS
    before = np.cumsum([0] + [n for _, n in cells])
    starts = spark.createDataFrame([(h, int(b), n) for (h, n), b in zip(cells, before)], "h int, first long, n long")

    def runs(frame: DataFrame) -> DataFrame:
        """Number of the even run that a row's cell and hash lead to; never falls along (h, x)."""
        share = (F.col("x").cast("double") + 2.0 ** 63) / 2.0 ** 64
        run = F.floor((F.col("first") + F.col("n") * share) * files / max(int(before[-1]), 1))
        return frame.join(F.broadcast(starts), "h").withColumn("run", F.least(run, F.lit(files - 1)).cast("int"))

    counts = sorted(tuple(r) for r in runs(keys).groupBy("run").count().collect())  # a row per file
    total, earlier = sum(n for _, n in counts), np.cumsum([0] + [n for _, n in counts])
    ordinals = spark.createDataFrame([(run, int(b)) for (run, _), b in zip(counts, earlier)], "run int, earlier long")
    line = Window.partitionBy("run").orderBy("h", "x")
    dealt = runs(placed).repartitionById(files, "run").withColumn("nth", F.row_number().over(line)).join(F.broadcast(ordinals), "run")
    dealt = dealt.withColumn("order", F.col("earlier") + F.col("nth") - 1)
    dealt = dealt.withColumn("shard", F.expr(f"int(`order` * {shards} div {max(total, 1)})"))
    dealt = dealt.withColumn("slot", F.col("order") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
    dealt = dealt.select("row", "slot", *[f"d{k}" for k in range(len(numbers))], "shard")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{folder}/shards")
    sides = [f(f"d{k}").alias(f"{name}_{k}") for k in range(len(numbers)) for name, f in (("low", F.min), ("high", F.max))]
    nulls = [F.max(F.col(f"d{k}").isNull()).alias(f"nulls_{k}") for k in range(len(numbers))]
    layout = Layout(spark, folder, tuple(dimensions), dealt.schema)
    layout.rows().groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *sides, *nulls).write.parquet(f"{folder}/boxes")
    return layout


def document_shards(docs: DataFrame) -> Layout:
    """Documents by source, language and size."""
    return write_shards(docs, {"source": "source", "lang": "lang", "size": F.octet_length(F.coalesce("text", F.lit("")))})
