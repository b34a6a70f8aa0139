"""The registered queries of this subpackage: the operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (bpe, contamination, conversation_repair, filter_audit, hilbert_shards, keyed_ids, near_duplicates, quality, repeats, sanitise,
                          token_counts, toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return put


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score(docs, toxicity.learn(docs, labels(spark, folder)))


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.judge(docs, quality.train(docs, labels(spark, folder)))


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_contamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op8_keyed_ids")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    store = keyed_ids.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"))
    return store.read(docs, with_ids=False)


@query("op6_sanitise")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.spans(documents(spark, folder))


@query("op9_repeats")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove(documents(spark, folder), with_kept=False)


@query("op10_near_duplicates")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.classes(documents(spark, folder)).drop("text_class")


AUDIT_SQL = r"""
WITH docs AS (
  SELECT coalesce(source, '') AS part, coalesce(text, '') AS t, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
         + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INTEGER)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(docs.doc_id > first_id, false) AS INTEGER) AS mask
  FROM docs LEFT JOIN known ON docs.doc_id = known.doc_id),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM masks GROUP BY part, mask),
letters AS (SELECT substr('ABCDE', k + 1, 1) AS letter, 1 << k AS bit FROM (SELECT unnest(range(0, 5)) AS k)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(g) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(x) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (mask & bit > 0), 0) AS BIGINT) AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flags(documents(spark, folder)), labels(spark, folder))


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversation_repair.turns_of(spark.read.parquet(f"{folder}/conversations.parquet"))
    return conversation_repair.report(conversation_repair.damage(turns), turns)


@query("op13_shards")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("row.text", F.lit(""))
    return hilbert_shards.document_shards(documents(spark, folder)).rows().select(
        "row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# Days drawn from an MD5, so that any engine can draw the same.
HEX = "0123456789abcdef"


def _day(text: Column | str, first: int) -> Column:
    """0 to 255, from two digits of the MD5."""
    digit = [F.instr(F.lit(HEX), F.substring(F.md5(F.encode(text, "UTF-8")), first + k, 1)) - 1 for k in (0, 1)]
    return digit[0] * 16 + digit[1]


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, fetched on a day of 2024 that its address gives."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), _day(F.col("url"), 1)))


def list_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Dated list derived from the pages: each host, each parent domain but the last label, and each first part of a path
    is added, removed and added again on days that its name gives."""
    url = F.col("url")
    asked = spark.read.parquet(f"{folder}/pages.parquet").select(F.explode(url_filter.questions(url)).alias("q")).select("q.scope", "q.key").distinct()
    listed = asked.where("scope = 'host' OR (scope = 'domain' AND key LIKE '%.%.%') OR (scope = 'prefix' AND key NOT LIKE '%/%/%')")
    name = F.concat_ws(":", "scope", "key")
    start = F.date_add(F.lit("2024-01-01").cast("date"), _day(name, 1))
    stay, gap = F.floor(_day(name, 3) / 8).cast("int") + 1, F.floor(_day(name, 5) / 4).cast("int") + 1
    steps = F.array(F.struct(F.lit("add").alias("action"), start.alias("at")), F.struct(F.lit("remove").alias("action"), F.date_add(start, stay).alias("at")),
                    F.struct(F.lit("add").alias("action"), F.date_add(start, stay + gap).alias("at")))
    return listed.select("scope", "key", F.explode(steps).alias("s")).select("scope", "key", "s.action", "s.at")


_DAY = "((instr('{hex}', substr(md5({x}), {a}, 1)) - 1) * 16 + instr('{hex}', substr(md5({x}), {b}, 1)) - 1)"


def _sql_day(x: str, first: int) -> str:
    return _DAY.format(hex=HEX, x=x, a=first, b=first + 1)


URL_SQL = f"""
WITH captured AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST({_sql_day("url", 1)} AS INTEGER) AS fetched_at,
         regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
questions AS (
  SELECT page_id, fetched_at, 'host' AS scope, host AS key FROM captured
  UNION ALL
  SELECT page_id, fetched_at, 'domain', array_to_string(string_split(host, '.')[k:], '.')
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM captured)
  UNION ALL
  SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(parts[1:k], '/')
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM captured)),
names AS (
  SELECT DISTINCT scope, key, scope || ':' || key AS name FROM questions
  WHERE scope = 'host' OR (scope = 'domain' AND key LIKE '%.%.%') OR (scope = 'prefix' AND key NOT LIKE '%/%/%')),
dated AS (
  SELECT scope, key, CAST({_sql_day("name", 1)} AS INTEGER) AS a, CAST({_sql_day("name", 3)} // 8 + 1 AS INTEGER) AS b, CAST({_sql_day("name", 5)} // 4 + 1 AS INTEGER) AS c
  FROM names),
stays AS (
  SELECT scope, key, DATE '2024-01-01' + a AS valid_from, DATE '2024-01-01' + a + b AS valid_to FROM dated
  UNION ALL
  SELECT scope, key, DATE '2024-01-01' + a + b + c, NULL FROM dated),
hits AS (
  SELECT q.page_id, count(*) AS n, min(q.scope || ':' || q.key) AS reason
  FROM questions q JOIN stays s ON q.scope = s.scope AND q.key = s.key AND s.valid_from <= q.fetched_at AND (s.valid_to IS NULL OR q.fetched_at < s.valid_to)
  GROUP BY q.page_id)
SELECT c.page_id, c.fetched_at, coalesce(h.n, 0) AS n_active, h.reason IS NOT NULL AS blocked, h.reason
FROM captured c LEFT JOIN hits h ON c.page_id = h.page_id
"""


@query("op5_url_filter", URL_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(captures(spark, folder), list_changes(spark, folder))
