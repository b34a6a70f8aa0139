"""What the operators of this subpackage share: batches, digests, byte budgets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import spread

# White space as the tokenizers' patterns understand it. Fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
# White space and the run of other characters behind it. A text may be cut
# before white space that follows something else: no pattern of the supported
# tokenizers joins characters over such a border.
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

ROOT = str(Path(__file__).resolve().parents[2])
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes: some texts are very long.

    Also lets Python workers find this package where the driver found it. A
    cluster whose machines lack that path gets the package by ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` over bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dealt: bool = True) -> DataFrame:
    """Key and text alone under fixed names, so that no other column can clash. A null text counts as empty."""
    out = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return spread(out) if dealt else out


def table(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array)
                                       else columns[f.name].cast(f.type) for f in schema], schema=schema)


def by_bytes(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes sum to ``most`` at the most (one larger item stands alone)."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def doc_type(df: DataFrame, id_col: str = "doc_id") -> str:
    """SQL type of the key column."""
    return df.schema[id_col].dataType.simpleString()


def keep_smaller(cache: dict, most: int) -> None:
    """Empty a cache that has outgrown its bound; what it held is computed again."""
    if len(cache) > most:
        cache.clear()


def text_key(column: Column) -> Column:
    """128 bits of a text in two long columns' worth of hex: equal texts, equal keys."""
    return F.md5(column.cast("binary"))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` by way of Parquet in the shared folder. What is counted by a key and then met by that key goes this way:
    read back, it is an ordinary side of a join, and Spark splits a key that gathers many rows on the other side."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for x in frames:
        out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("nothing to unite")
    return out
