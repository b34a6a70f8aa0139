"""Chunks at separators and ordered folds over a text's pieces, linear in the text.

Both are small helpers over one text at a time, run on Arrow batches: a native
fold would copy its growing result at every piece. Results leave in batches of
bounded size, whatever the text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SEPARATORS = ("\n\n", "\n", " ")
BATCH_CHARS = 1_000_000
READ_ROWS = 16


def borders(text: str, size: int, separators: Sequence[str] = SEPARATORS, hard: bool = False) -> list[int]:
    """Where the text may be cut: 0, the ends of its pieces, its length.

    A piece ends behind a separator. Only pieces longer than ``size`` are cut at
    the next separator; ``hard`` cuts what is still too long every ``size``
    characters, else it stays whole.
    """
    spans = [(0, len(text))] if text else []
    for separator in separators:
        finer = []
        for a, b in spans:
            if b - a > size:
                at = text.find(separator, a, b)
                while at >= 0:
                    finer.append((a, at + len(separator)))
                    a = at + len(separator)
                    at = text.find(separator, a, b)
                if a == b:
                    continue
            finer.append((a, b))
        spans = finer
    out = [0]
    for a, b in spans:
        if hard:
            out.extend(range(a + size, b, size))
        out.append(b)
    return out


def packed(ends: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks as spans over the given borders: each takes pieces while it fits into
    ``size`` (one longer piece stands alone) and begins with the last whole pieces
    of the one before that fit into ``overlap`` and leave room for the next piece."""
    i, last = 0, len(ends) - 1
    while i < last:
        j = max(i + 1, bisect_right(ends, ends[i] + size, i, last + 1) - 1)
        yield ends[i], ends[j]
        if j == last:
            return
        i = min(j, max(bisect_left(ends, ends[j] - overlap, i, j + 1), bisect_left(ends, ends[j + 1] - size, i, j + 1)))


def _batches(batches: Iterator[pa.RecordBatch], made: Callable[[str], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows made of batches of (identifier, text), in batches of about BATCH_CHARS; READ_ROWS texts at a time are Python strings."""
    rows, held = [], 0

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], field.type) for i, field in enumerate(schema)], schema=schema)

    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            part = batch.slice(at, READ_ROWS)
            for key, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for row in made(whole):
                    rows.append((key, *row))
                    held += 100 + sum(len(x) for x in row if isinstance(x, str))
                    if held > BATCH_CHARS:
                        yield batch_of()
                        rows, held = [], 0
    yield batch_of()


def _rows(df: DataFrame, identifier: str, text: str, schema: StructType, made: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """Rows that ``made`` yields for each text, behind its identifier; a null text is empty."""
    names = [f.name for f in schema.fields]
    plain = df.select(F.col(identifier).alias(names[0]), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    out = StructType([StructField(names[0], plain.schema[0].dataType), *schema.fields[1:]])
    arrow = to_arrow_schema(out)

    return plain.mapInArrow(lambda batches: _batches(batches, made, arrow), out)


def separated_chunks(df: DataFrame, identifier: str, text: str, size: int = 500, overlap: int = 5,
                     separators: Sequence[str] = SEPARATORS, hard: bool = False) -> DataFrame:
    """(identifier, chunk, start, text): overlapping chunks that begin and end at separators.

    Chunks keep their separators, so chunk and start give back the text. An empty
    or null text has none.
    """
    schema = StructType([StructField(identifier, StringType()), StructField("chunk", IntegerType()), StructField("start", IntegerType()), StructField("text", StringType())])

    def made(whole: str) -> Iterator[tuple]:
        for k, (a, b) in enumerate(packed(borders(whole, size, separators, hard), size, overlap)):
            yield k, a, whole[a:b]

    return _rows(df, identifier, text, schema, made)


def packed_chunks(df: DataFrame, identifier: str, text: str, size: int, separator: str = "\n") -> DataFrame:
    """(identifier, chunk, text): whole pieces between separators, packed in order into
    chunks of at most ``size`` characters; a longer piece stays whole. The chunks
    joined by the separator are the text."""
    schema = StructType([StructField(identifier, StringType()), StructField("chunk", IntegerType()), StructField("text", StringType())])

    def made(whole: str) -> Iterator[tuple]:
        # With one more separator at the end every piece has one, and a chunk has one to spare.
        ends, at = [0], whole.find(separator)
        while at >= 0:
            ends.append(at + len(separator))
            at = whole.find(separator, ends[-1])
        ends.append(len(whole) + len(separator))
        for k, (a, b) in enumerate(packed(ends, size + len(separator), 0)):
            yield k, whole[a:b - len(separator)]

    return _rows(df, identifier, text, schema, made)


def longer(summary: str, piece: str) -> str:
    """Refinement step that keeps the longer of summary and piece."""
    return piece if len(piece) > len(summary) else summary


def refined_states(df: DataFrame, identifier: str, text: str, step: Callable[[str, str], str] = longer, separator: str = "\n") -> DataFrame:
    """(identifier, step, piece, summary): a summary carried over the non-empty pieces of each text in order.

    ``step(summary, piece)`` is any Python function, for example a call to a
    model; the first summary is empty. Each state is a row of its own.
    """
    schema = StructType([StructField(identifier, StringType()), StructField("step", IntegerType()), StructField("piece", StringType()), StructField("summary", StringType())])

    def made(whole: str) -> Iterator[tuple]:
        summary, k = "", 0
        for piece in whole.split(separator):
            if piece:
                summary, k = step(summary, piece), k + 1
                yield k, piece, summary

    return _rows(df, identifier, text, schema, made)


def refined_digest(df: DataFrame, identifier: str, text: str, separator: str = "\n", step: Callable[[str, str], str] = longer) -> DataFrame:
    """One row per text: the number of states, all of them, and the last one."""
    states = refined_states(df, identifier, text, step, separator)
    ordered = F.array_sort(F.collect_list(F.struct("step", "summary")))
    return states.groupBy(identifier).agg(ordered.alias("_s")).select(
        identifier, F.size("_s").cast("long").alias("n_steps"), F.transform("_s", lambda x: x["summary"]).alias("steps"), F.element_at("_s", -1)["summary"].alias("digest"))
