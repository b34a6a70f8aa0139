"""Sinks: CSV, JSON collections, keyed upsert, partition replacement, HTML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.ranking import first_by
from millrace.session import scratch_path


# Null, empty and blank fields stay apart; line breaks inside a value are escaped, so that files can be split anywhere.
CSV_OPTIONS = {"header": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def escaped(column: Column) -> Column:
    """A text on one line: backslash, newline and carriage return as two characters each."""
    for raw, pair in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        column = F.replace(column, F.lit(raw), F.lit(pair))
    return column


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Any text comes back as it was through ``readers.read_csv(..., unescape=True)``."""
    texts = {f.name for f in df.schema if f.dataType.typeName() == "string" and f.name not in partition_by}
    rows = df.select(*(escaped(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns))
    writer = rows.write.mode("overwrite").options(**CSV_OPTIONS)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return path


def write_collection(df: DataFrame, root: str, name: str) -> str:
    """Rows as JSON documents, one folder per collection; types are kept."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None only if there is no such folder. A table that cannot be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Write, replacing exactly the partitions that occur in ``df``.

    The rebalance hint splits a large partition over several files and merges
    small ones.
    """
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def upsert(path: str, updates: DataFrame, keys: Mapping[str, Column], partition: str, order: Sequence[Column],
           ingested_at: str | None = None, ingest_column: str = "ingest_timestamp") -> None:
    """Insert or update by key into a partitioned parquet table.

    ``keys`` names key expressions (``{"headline": F.lower("headline")}``); the
    partition column is part of the key. Of several updates for one key the
    first in ``order`` counts. Only the partitions an update touches are read
    and rewritten. The merged rows are written to a staging folder first, so the
    table is never read and replaced in one plan, and a rerun gives the same table.
    With ``ingested_at`` every inserted or updated row carries that time in
    ``ingest_column``; untouched rows keep theirs.
    """
    spark = updates.sparkSession
    if ingested_at is not None:
        updates = updates.withColumn(ingest_column, F.lit(ingested_at).cast("timestamp_ntz"))
    names = ["_k_" + name for name in keys]

    def keyed(df: DataFrame) -> DataFrame:
        for name, expression in keys.items():
            df = df.withColumn("_k_" + name, expression)
        return df

    fresh = first_by(keyed(updates), [partition, *names], order)
    old = _existing(spark, path)
    if old is None:
        write_partitions(fresh.drop(*names), path, partition)
        return
    # One value per touched partition, which lets the scan prune by them.
    touched = [row[0] for row in updates.select(partition).distinct().collect()]
    kept = keyed(old.filter(F.col(partition).isin(touched))).join(fresh.select(partition, *names), [partition, *names], "left_anti")
    staging = scratch_path(spark, "upsert")
    kept.unionByName(fresh).drop(*names).write.parquet(staging)
    write_partitions(spark.read.parquet(staging), path, partition)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def merge_into_catalog(table: str, updates: DataFrame, condition: Column) -> None:
    """The same through the catalog, for table formats that support MERGE."""
    updates.mergeInto(table, condition).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def replace_partition(path: str, rows: DataFrame, partition: str, value) -> None:
    """Delete one partition and put the given rows of that partition there."""
    write_partitions(rows.filter(F.col(partition) == value), path, partition)


def html_card(title: Column, link: Column, highlights: Column, summary: Column) -> Column:
    """One row of a report as an HTML article on one line, with its text escaped."""

    def safe(column: Column) -> Column:
        text = F.regexp_replace(F.coalesce(column, F.lit("")), "[\\r\\n]+", " ")
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(raw), F.lit(entity))
        return text

    return F.concat(
        F.lit('<article class="card"><h2>'), safe(title), F.lit('</h2><a href="'), safe(link), F.lit('">'), safe(link),
        F.lit('</a><p class="lead">'), safe(highlights), F.lit("</p><p>"), safe(summary), F.lit("</p></article>"),
    )


PAGE_HEAD = ['<!DOCTYPE html>', '<html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body>']
PAGE_FOOT = ['</body></html>']


def page_frame(spark: SparkSession, title: str, column: str) -> tuple[DataFrame, DataFrame]:
    """First and last lines of a page, to stand before and behind its cards."""
    text = title
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = text.replace(raw, entity)
    frame = lambda lines: spark.createDataFrame([(x.format(title=text),) for x in lines], f"{column} string")
    return frame(PAGE_HEAD), frame(PAGE_FOOT)


def write_report(cards: DataFrame, column: str, path: str, title: str | None = None) -> str:
    """One card per line, in as many files as there are partitions. With a title, files named to sort
    first and last hold the frame of the page, so that the files in the order of their names are one page."""
    body = cards.select(column)
    if title is None:
        body.write.mode("overwrite").text(path)
        return path
    head, foot = page_frame(cards.sparkSession, title, column)
    for name, part in (("0-head", head.coalesce(1)), ("1-cards", body), ("2-foot", foot.coalesce(1))):
        part.write.mode("overwrite").text(f"{path}/{name}")
    return path
