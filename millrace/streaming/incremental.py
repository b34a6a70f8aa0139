"""Incremental loads: feed staging, counters, trailing windows, content keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions import text as tx
from millrace.operators.ranking import first_by
from millrace.session import checkpoint
from millrace.sources.readers import capped_feed


def within_lookback(df: DataFrame, moment: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; rows without a date go too."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    return df.filter(F.col(moment).cast("timestamp_ntz") >= cutoff)


def staged_entries(entries: DataFrame, as_of: str, lookback_days: int, cap: int | None = None, feed_order: str = "source") -> DataFrame:
    """Every feed entry with the reason it was dropped, or ``kept``.

    Columns of ``entries``: source, position, url, title, summary, published.
    Stages in order: stale (older than the lookback or undated), incomplete,
    off_topic, duplicate (a URL seen before, by ``feed_order`` then position),
    kept. ``feed_order`` names the column that ranks the feeds. With ``cap``
    only the first entries of each source are staged. Cleaned entries are
    checkpointed: both the winners and the result come from them.
    """
    capped = entries if cap is None else capped_feed(entries, "source", "position", cap)
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(lookback_days)} days")
    title, summary = tx.clean_html(F.col("title")), tx.clean_html(F.col("summary"))
    cleaned = capped.select(
        F.col(feed_order).alias("_feed"), "source", "position", F.trim("url").alias("url"), title.alias("title"), summary.alias("summary"), "published"
    ).withColumn("topic", tx.topic_of(F.concat_ws(" ", "title", "summary")))
    fresh = F.coalesce(F.col("published").cast("timestamp_ntz") >= cutoff, F.lit(False))
    complete = (F.col("title") != "") & (F.coalesce(F.col("url"), F.lit("")) != "")
    marked = cleaned.withColumn(
        "outcome",
        F.when(~fresh, "stale").when(~complete, "incomplete").when(F.col("topic") == "off_topic", "off_topic").otherwise("kept"),
    )
    marked = checkpoint(marked)
    passed = marked.filter(F.col("outcome") == "kept").select("url", "_feed", "source", "position")
    winners = first_by(passed, ["url"], [F.col("_feed"), F.col("source"), F.col("position")]).select(
        "source", "position", F.lit(True).alias("_first")
    )
    return (
        marked.join(winners, ["source", "position"], "left")
        .withColumn("outcome", F.when((F.col("outcome") == "kept") & F.col("_first").isNull(), "duplicate").otherwise(F.col("outcome")))
        .drop("_first", "_feed")
    )


def candidates(staged: DataFrame, limit: int | None = None, title_chars: int | None = None, summary_chars: int | None = None) -> DataFrame:
    """Kept entries for curation: first topic first, newest first. Row and text limits are the caller's."""
    rank = F.when(F.col("topic") == "ai", 0).otherwise(1)
    rows = staged.filter(F.col("outcome") == "kept").orderBy(rank, F.desc("published"), "source", "position")

    def field(name: str, chars: int | None):
        return F.col(name) if chars is None else F.substring(name, 1, chars).alias(name)

    return (rows if limit is None else rows.limit(limit)).select(
        "source", "position", "url", tx.domain_of(F.col("url")).alias("domain"), "published", "topic",
        field("title", title_chars), field("summary", summary_chars),
    )


def source_counters(staged: DataFrame, top: int | None = None) -> DataFrame:
    """Fetched, kept and off-topic entries per source, most kept first."""
    counted = (
        staged.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("fetched"),
            F.count_if(F.col("outcome") == "kept").alias("kept"),
            F.count_if(F.col("outcome") == "off_topic").alias("off_topic"),
        )
        .orderBy(F.desc("kept"), "source")
    )
    return counted if top is None else counted.limit(top)


def trailing_counts(df: DataFrame, moment: str, kind: str, last_day: str, days: int) -> DataFrame:
    """Rows per day and kind over the ``days`` days that end with ``last_day``."""
    # Bounds on the stored column itself, so that they reach the scan.
    kind_of_time = df.schema[moment].dataType
    last = F.lit(last_day).cast("date")
    start, end = F.date_sub(last, days - 1).cast(kind_of_time), F.date_add(last, 1).cast(kind_of_time)
    return (
        df.filter((F.col(moment) >= start) & (F.col(moment) < end))
        .groupBy(F.to_date(moment).alias("day"), kind)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def content_keys(parts: DataFrame, by: str) -> DataFrame:
    """A key per text part that changes exactly when the text does."""
    return parts.select(by, "part", F.md5("text").alias("content_key"))


def changed_parts(current: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """Parts to recompute: those whose key is not among the stored ones."""
    return current.join(stored, [by, "part", "content_key"], "left_anti")


def store_results(results: DataFrame, path: str, computed_at: str) -> None:
    """Append results under their content keys, with the time they were computed."""
    results.withColumn("computed_at", F.lit(computed_at).cast("timestamp_ntz")).write.mode("append").parquet(path)


def cached_results(current: DataFrame, path: str, by: str, as_of: str, max_age_days: int) -> DataFrame:
    """Stored results for the current content keys that are not older than the
    limit, the newest of each: a changed text or an aged result has none."""
    oldest = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(max_age_days)} days")
    keys = [by, "part", "content_key"]
    stored = current.sparkSession.read.parquet(path).filter(F.col("computed_at") >= oldest)
    newest = first_by(stored, keys, [F.desc("computed_at")])
    return current.join(newest, keys)
