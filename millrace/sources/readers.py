"""Scans: SQL, CSV with cleaned names, text, file listings, capped feeds and
tolerant JSON."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from millrace.functions import vocabulary as v
from millrace.functions.text import stripped
from millrace.operators.ranking import first_by, top_k


def select(tables, statement: str) -> DataFrame:
    """A SQL query over the tables of a folder."""
    tables.register_views()
    return tables.spark.sql(statement)


def from_database(spark: SparkSession, url: str, query: str, partition_column: str | None = None,
                  bounds: tuple | None = None, partitions: int = 1, fetch_size: int = 10000) -> DataFrame:
    """A query on a JDBC source; with a column and its bounds it is read in
    parallel ranges instead of through one connection."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    if partition_column is None:
        return reader.option("query", query).load()
    return (
        reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
        .option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions).load()
    )


def lower_name(name: str) -> str:
    """Lower case, dots to underscores, one trailing underscore cut."""
    return re.sub(r"_$", "", name.lower().replace(".", "_"))


def upper_name(name: str) -> str:
    """Spaces and punctuation to underscores, upper case."""
    return re.sub(r"[^\w]|[ ]", "_", name).upper()


def renamed(df: DataFrame, clean) -> DataFrame:
    return df.toDF(*[clean(c) for c in df.columns])


def unescaped(column: Column) -> Column:
    """The inverse of ``sinks.escaped``."""
    parts = F.transform(F.split(column, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.when(F.contains(column, F.lit("\\")), F.array_join(parts, "\\")).otherwise(column)


def read_csv(spark: SparkSession, path: str, schema: StructType, clean=lower_name, unescape: bool = False) -> DataFrame:
    """CSV with a header line and a declared schema: no inference pass. ``unescape``: files of ``sinks.write_csv``."""
    options = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **({"nullValue": "\\N"} if unescape else {})}
    rows = spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=False, **options)
    if unescape:
        rows = rows.select(*(unescaped(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in schema))
    return renamed(rows, clean)


def read_csv_after(spark: SparkSession, path: str, schema: StructType, skip: int, clean=upper_name, head: str | None = None) -> DataFrame:
    """CSV of which the header and ``skip`` further lines are no records.

    Only those few lines are looked at on the driver. The scan sets lines equal
    to them aside, which needs no row numbers and stays splittable; of each such
    line, as many as the preamble has are dropped and later records equal to it
    stay. ``head`` names the file that starts with them when ``path`` is a
    folder of several files.
    """
    leading = [row.value for row in spark.read.text(head or path).take(skip + 1)]
    lines = spark.read.text(path, recursiveFileLookup=True)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    preamble = spark.createDataFrame([(x, leading.count(x)) for x in sorted(set(leading))], "value string, in_head long")
    again = (lines.filter(F.col("value").isin(leading)).groupBy("value").agg(F.count("*").alias("n")).join(preamble, "value")
             .where(F.col("n") > F.col("in_head")).select("value", F.explode(F.sequence(F.col("in_head") + 1, "n"))).select("value"))
    options = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}
    records = lines.filter(~F.col("value").isin(leading)).unionByName(again).select(F.from_csv("value", fields, options).alias("r"))
    return renamed(records.select("r.*"), clean)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: its path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names and sizes of files; the contents column is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", "modificationTime")


def file_path(base: str, identifier: Column, extension: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), identifier.cast("string"), F.lit(extension))


def capped_feed(entries: DataFrame, source: str, position: str, cap: int = 40) -> DataFrame:
    """The first ``cap`` entries of each source."""
    return top_k(entries, [source], [F.col(position)], cap, "entry")


# --- tolerant JSON -------------------------------------------------------------

# Code fences, trailing commas, objects nested one level deep.
FENCE = r"(?im)^```(?:json)?\s*|\s*```$"
TRAILING_COMMA = r",(\s*[}\]])"
OBJECT = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def json_array(text: Column, required: Sequence[str] = ("headline", "category")) -> Column:
    """A valid JSON array out of a dirty reply: the bracketed region as it is,
    else without trailing commas, else the objects that parse one by one and
    carry the required fields."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, ""))
    region = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    region = F.when(region != "", region).otherwise(bare)
    mended = F.regexp_replace(region, TRAILING_COMMA, "$1")
    pieces = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(OBJECT), F.lit(0)),
        lambda x: F.regexp_replace(x, TRAILING_COMMA, "$1"),
    )

    def usable(piece: Column) -> Column:
        parsed = F.try_parse_json(piece).isNotNull()
        for field in required:
            parsed = parsed & F.get_json_object(piece, f"$.{field}").isNotNull()
        return parsed

    rescued = F.concat(F.lit("["), F.array_join(F.filter(pieces, usable), ","), F.lit("]"))
    return F.when(F.try_parse_json(region).isNotNull(), region).when(F.try_parse_json(mended).isNotNull(), mended).otherwise(rescued)


def parse_records(df: DataFrame, text: str, schema: StructType, required: Sequence[str] = ("headline", "category")) -> DataFrame:
    """One row per object found in ``text``, with its place in the array."""
    kind: DataType = ArrayType(schema)
    parsed = df.withColumn("_records", F.from_json(json_array(F.col(text), required), kind))
    others = [c for c in df.columns if c != text]
    return parsed.select(*others, F.posexplode("_records").alias("entry", "_r")).select(*others, "entry", "_r.*")


def valid_stories(stories: DataFrame, order: Sequence[Column], limit: int | None = None, headline_chars: int | None = None) -> DataFrame:
    """Stories with every required field filled, known categories, trimmed
    headlines and one row per whole headline (ignoring case, first wins).
    ``headline_chars`` cuts headlines for display after that."""
    complete = stories
    for field in v.REQUIRED_STORY_FIELDS:
        complete = complete.filter(F.coalesce(F.col(field), F.lit("")) != "")
    known = F.col("category").isin(list(v.CATEGORY_LABELS))
    tidy = complete.withColumn("category", F.when(known, F.col("category")).otherwise(v.DEFAULT_CATEGORY)).withColumn(
        "headline", stripped(F.col("headline"))
    ).filter(F.col("headline") != "")
    unique = first_by(tidy.withColumn("_key", F.lower("headline")), ["_key"], order).drop("_key")
    if headline_chars is not None:
        unique = unique.withColumn("headline", F.substring("headline", 1, headline_chars))
    return unique if limit is None else unique.orderBy(*order).limit(limit)
