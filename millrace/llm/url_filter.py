"""URL filters over time: every capture is held against the list as it stood when it was fetched.

Dated changes of the list become validity intervals, one row per stay of an
entry on the list. A capture asks for its host, each parent domain and each
leading part of its path. Questions are made distinct by key and day before
the as-of join, so a host with a third of all captures asks once a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPES = ("host", "domain", "prefix")


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a final dot; empty if there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def questions(url: Column) -> Column:
    """Array of (scope, key): the host, every domain it lies under (itself included), every leading part of its path."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("key")))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(
        F.lit("prefix").alias("scope"), F.concat_ws("/", F.array(host), F.slice(parts, 1, k)).alias("key")))).otherwise(F.array().cast("array<struct<scope:string,key:string>>"))
    own = F.array(F.struct(F.lit("host").alias("scope"), host.alias("key")))
    return F.when(host != "", F.concat(own, domains, prefixes)).otherwise(F.array().cast("array<struct<scope:string,key:string>>"))


def intervals(changes: DataFrame) -> DataFrame:
    """``scope``, ``key``, ``valid_from`` (inclusive), ``valid_to`` (exclusive, null: still listed) from dated changes.

    ``changes``: ``scope``, ``key``, ``action`` (``add`` or ``remove``), ``at``.
    Of changes to one entry at one time ``remove`` counts; an ``add`` to a
    listed entry and a ``remove`` of an unlisted one change nothing. Rows with
    a null in any of these columns, or another action, are no changes.
    """
    known = changes.select("scope", "key", "action", "at").where(F.col("action").isin("add", "remove")).dropna()
    once = known.groupBy("scope", "key", "at").agg(F.max("action").alias("action"))
    line = Window.partitionBy("scope", "key").orderBy("at")
    turns = once.withColumn("_before", F.lag("action", 1, "remove").over(line)).where(F.col("action") != F.col("_before"))
    return (turns.withColumn("valid_to", F.lead("at").over(line)).where("action = 'add'")
            .select("scope", "key", F.col("at").alias("valid_from"), "valid_to"))


def judge(captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Per capture: key, ``fetched_at``, ``n_active`` (entries that hit), ``blocked``, ``reason`` (least ``scope:key`` that hits).

    A null time or a null, empty or hostless URL meets no entry and is not
    blocked. Captures repeated in all of key, URL and time come out as often as
    they come in. Empty tables give no captures or no hits. Other columns are ignored.
    """
    rows = captures.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{time_col}`").alias("fetched_at"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("_url"))
    # Copies of a page share their questions: ask once for each page, not once for each copy.
    asked = rows.select("_url", "fetched_at").where(F.col("fetched_at").isNotNull()).distinct().withColumn("_q", F.explode(questions(F.col("_url")))).select("_url", "fetched_at", "_q.scope", "_q.key")
    listed = intervals(changes)
    open_ = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    active = asked.select("scope", "key", "fetched_at").distinct().join(listed, ["scope", "key"]).where(open_).select("scope", "key", "fetched_at").distinct()
    hits = (asked.join(active, ["scope", "key", "fetched_at"]).groupBy("_url", "fetched_at")
            .agg(F.count("*").alias("n_active"), F.min(F.concat_ws(":", "scope", "key")).alias("reason")))
    return rows.join(hits, ["_url", "fetched_at"], "left").select(
        id_col, "fetched_at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("reason").isNotNull().alias("blocked"), "reason")
