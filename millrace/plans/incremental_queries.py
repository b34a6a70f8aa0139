"""Incremental loads, streams and calendars: T1-T6, A23, C1-C3."""

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import aggregates as ag
from millrace.operators import calendar as cal
from millrace.plans.registry import query
from millrace.plans.source_queries import STORIES, UPSERTED, topic_sql, upserted
from millrace.session import scratch_path
from millrace.sources import readers, sinks
from millrace.streaming import incremental as inc
from millrace.streaming import streams

AS_OF, LOOKBACK = "2024-01-01", 2


def entries(t):
    """Documents as feed entries; copies of a text share its URL."""
    return t.documents.select(
        "source",
        F.col("doc_id").alias("position"),
        F.concat(F.lit("https://www.news.example.com/"), F.md5(F.lower(F.trim("text")))).alias("url"),
        F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
        F.col("text").alias("summary"),
        F.when(F.col("lang") != "de", F.timestamp_seconds(F.lit(1704067200) - F.col("n_chars") * 60).cast("timestamp_ntz")).alias("published"),
    )


def clean_sql(column: str) -> str:
    text = f"regexp_replace({column}, '<[^>]+>', ' ', 'g')"
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):  # what the test tables hold
        text = f"replace({text}, '{name}', '{character}')"
    return f"trim(regexp_replace(replace({text}, '&amp;', '&'), '{tx.SPACES}', ' ', 'g'))"


STAGED = f"""
entries AS (SELECT source, doc_id AS position, 'https://www.news.example.com/' || md5(lower(trim(text))) AS url,
  regexp_extract(text, '^([^\\n]*)', 1) AS title, text AS summary,
  CASE WHEN lang <> 'de' THEN TIMESTAMP '2024-01-01' - to_minutes(n_chars) END AS published FROM documents),
cleaned AS (SELECT source, position, url, {clean_sql('title')} AS title, {clean_sql('summary')} AS summary, published FROM entries),
gated AS (SELECT *, {topic_sql("(title || ' ' || summary)")} AS topic FROM cleaned),
marked AS (SELECT *, CASE WHEN NOT coalesce(published >= TIMESTAMP '{AS_OF}' - INTERVAL {LOOKBACK} DAY, false) THEN 'stale'
  WHEN title = '' OR url = '' THEN 'incomplete' WHEN topic = 'off_topic' THEN 'off_topic' ELSE 'kept' END AS o FROM gated),
staged AS (SELECT *, CASE WHEN o = 'kept' AND row_number() OVER (PARTITION BY url, o ORDER BY source, position) > 1 THEN 'duplicate' ELSE o END AS outcome FROM marked)"""


def staged(t):
    return inc.staged_entries(entries(t), AS_OF, LOOKBACK)


@query("T1_lookback_batch", f"""
WITH {STAGED} SELECT source, position, url, 'news.example.com' AS domain, published, topic, title, summary
FROM staged WHERE outcome = 'kept'""")
def _(t):
    return inc.candidates(staged(t))


@query("T2_late_rows_dropped", "SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def _(t):
    return inc.within_lookback(t.events.select("event_id", "ts", "event_type"), "ts", "2024-01-31", 7)


@query("T3_first_across_sources", f"WITH {STAGED} SELECT source, position, url, topic, outcome FROM staged")
def _(t):
    return staged(t).select("source", "position", "url", "topic", "outcome")


@query("A23_source_counters", f"""
WITH {STAGED} SELECT source, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'kept') AS kept, count(*) FILTER (WHERE outcome = 'off_topic') AS off_topic
FROM staged GROUP BY source""")
def _(t):
    return inc.source_counters(staged(t))


@query("T4_upsert_twice", UPSERTED)
def _(t):
    return t.spark.read.parquet(upserted(t, runs=2))


@query("T5_trailing_counts", """
SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts::DATE BETWEEN DATE '2024-01-09' AND DATE '2024-01-15' GROUP BY ALL""")
def _(t):
    return inc.trailing_counts(t.events, "ts", "event_type", "2024-01-15", 7)


def daily_text(t):
    line = F.concat(F.lit("- "), "event_type", F.lit(" "), "props")
    return ag.ordered_text(t.events.withColumn("day", F.to_date("ts")), ["day"], [F.col("event_id")], line, part_rows=500)


CONTENT = """keys AS (
  SELECT day, (place - 1) // 500 AS part, md5(string_agg(line, chr(10) ORDER BY place)) AS content_key FROM (
    SELECT ts::DATE AS day, '- ' || event_type || ' ' || props AS line, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS place FROM events)
  GROUP BY day, (place - 1) // 500)"""


@query("T6_content_keys", f"WITH {CONTENT} SELECT day, part, content_key FROM keys")
def _(t):
    return inc.content_keys(daily_text(t), "day")


RESULTS = """kept AS (SELECT day, part, content_key, CASE WHEN day <= DATE '2024-01-10' THEN 'old' ELSE 'new' END AS result,
  CASE WHEN day <= DATE '2024-01-10' THEN TIMESTAMP '2024-01-11 00:00:00' ELSE TIMESTAMP '2024-01-25 00:00:00' END AS computed_at FROM keys WHERE day < DATE '2024-01-25')"""


def stored_results(t) -> str:
    """Results of two earlier runs over what there was then: ten days, and the days up to the 24th."""
    path = scratch_path(t.spark, "results")
    known = inc.content_keys(daily_text(t), "day")
    inc.store_results(known.filter(F.col("day") <= F.lit("2024-01-10").cast("date")).withColumn("result", F.lit("old")), path, "2024-01-11 00:00:00")
    later = known.filter((F.col("day") > F.lit("2024-01-10").cast("date")) & (F.col("day") < F.lit("2024-01-25").cast("date")))
    inc.store_results(later.withColumn("result", F.lit("new")), path, "2024-01-25 00:00:00")
    return path


@query("T6_changed_content", f"WITH {CONTENT} SELECT day, part, content_key FROM keys WHERE day >= DATE '2024-01-25'")
def _(t):
    stored = t.spark.read.parquet(stored_results(t)).select("day", "part", "content_key")
    return inc.changed_parts(inc.content_keys(daily_text(t), "day"), stored, "day")


@query("T6_cached_results", f"WITH {CONTENT}, {RESULTS} SELECT * FROM kept WHERE computed_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def _(t):
    """What the stored results still answer: those of unchanged texts not older than two weeks."""
    return inc.cached_results(inc.content_keys(daily_text(t), "day"), stored_results(t), "day", "2024-01-31", 14)


# --- stream twins


@query("T1_stream_upsert", f"""
WITH stories AS ({STORIES}) SELECT event_id, day, event_type, headline, value FROM (
  SELECT *, row_number() OVER (PARTITION BY day, lower(headline) ORDER BY event_id) AS r FROM stories) WHERE r = 1""")
def _(t):
    target, checkpoint = scratch_path(t.spark, "stream-table"), scratch_path(t.spark, "stream-state")

    def prepare(batch):
        return batch.select("event_id", F.to_date("ts").alias("day"), "event_type",
                            F.concat(F.lit("Story "), F.col("user_id").cast("string")).alias("headline"), "value")

    events = streams.file_stream(t.spark, t.path("events"))
    streams.stream_upsert(events, prepare, {"headline": F.lower("headline")}, "day", [F.col("event_id")], target, checkpoint)
    return t.spark.read.parquet(target)


@query("T2_stream_late_rows", """
SELECT event_id, ts, event_type FROM events
WHERE event_type <> 'view' OR ts > (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 7 DAY FROM events WHERE event_type NOT IN ('view', 'error'))""")
def _(t):
    """Three micro-batches: views come last, and those behind the watermark are dropped. Lateness is judged by
    the watermark with which the batch before began, here that of the first batch."""
    source, target, checkpoint = (scratch_path(t.spark, f"stream-{x}") for x in ("source", "table", "state"))
    rows = t.events.select("event_id", "ts", "event_type")
    turn = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 1).otherwise(0)
    for k in range(3):
        rows.filter(turn == k).coalesce(1).write.mode("append").parquet(source)
    stream = streams.file_stream(t.spark, source, files_per_batch=1)
    streams.stream_in_time(stream, "ts", "event_id", "7 days", target, checkpoint)
    return t.spark.read.parquet(target).select("event_id", "ts", "event_type")


@query("T3_stream_distinct_keys", "SELECT DISTINCT user_id FROM events")
def _(t):
    target, checkpoint = scratch_path(t.spark, "stream-table"), scratch_path(t.spark, "stream-state")
    streams.stream_distinct(streams.file_stream(t.spark, t.path("events")), "ts", "user_id", "60 days", target, checkpoint)
    return t.spark.read.parquet(target).select("user_id")


WEEK = 7 * 86_400
END = "2030-01-01 00:00:00"  # the moment of the two rows that end the stream


@query("T3_stream_first_wins", f"""
SELECT event_id, ts, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // {WEEK * 10**6} ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def _(t):
    """The first event of each user and week, from micro-batches of ten days in which every seventh event comes one
    batch late. Keys expire while the stream runs; two rows at its end, which are dropped again, expire the rest."""
    source, target, checkpoint = (scratch_path(t.spark, f"stream-{x}") for x in ("source", "table", "state"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = t.events.select("event_id", "ts", "user_id", "event_type")
    first = rows.agg(F.min(seconds)).first()[0]
    turn = F.floor((seconds - first) / (10 * 86_400)) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    turns = rows.agg(F.max(turn)).first()[0]

    def arrive(batch):
        batch.write.mode("append").parquet(source)
        streams.stream_first_writes_in_windows(streams.file_stream(t.spark, source), "ts", ["user_id"], ["event_id"], WEEK, "21 days", target, checkpoint)

    for k in range(turns + 1):
        arrive(rows.where(turn == k))
    last = t.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(END).cast(t.events.schema["ts"].dataType).alias("ts"),
                                   F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"))
    for _ in range(2):
        arrive(last)
    return t.spark.read.parquet(target).where("event_id >= 0").select("event_id", "ts", "user_id", "event_type")


@query("T5_stream_daily_counts", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    target, checkpoint = scratch_path(t.spark, "stream-table"), scratch_path(t.spark, "stream-state")
    streams.stream_daily_counts(streams.file_stream(t.spark, t.path("events")), "ts", "event_type", "2 days", target, checkpoint)
    return t.spark.read.parquet(target).select("day", "event_type", "n")


# --- calendar

WEEKDAY = {"MON": 1, "TUE": 2, "WED": 3, "THU": 4, "FRI": 5}


def rule_sql(rule: tuple) -> str:
    """The rule as a condition on every day ``d`` of the years in question."""
    kind, month = rule[0], rule[1]
    if kind == "day":
        return f"month(d) = {month} AND day(d) = {rule[2]}"
    weekday = WEEKDAY[rule[2]]
    if kind == "last":
        return f"month(d) = {month} AND isodow(d) = {weekday} AND month(d + INTERVAL 7 DAY) <> {month}"
    shift = 1 if kind == "after" else 0
    return f"month(d - INTERVAL {shift} DAY) = {month} AND isodow(d - INTERVAL {shift} DAY) = {weekday} AND (day(d - INTERVAL {shift} DAY) - 1) // 7 = {rule[3] - 1}"


def calendar_sql(name: str, rules) -> str:
    parts = []
    for level, title, rule, since in rules:
        title = title.replace("'", "''")
        base = f"SELECT '{level}' AS level, d, '{title}' AS holiday_name FROM days WHERE {rule_sql(rule)} AND year(d) >= {since}"
        parts.append(base)
        if rule[0] == "day":
            parts.append(f"SELECT level, CASE isodow(d) WHEN 6 THEN d - 1 ELSE d + 1 END, holiday_name || ' (Observed)' FROM ({base}) WHERE isodow(d) IN (6, 7)")
    return f"""{name} AS (SELECT level, year(d)::INTEGER AS year, d AS date, holiday_name FROM ({' UNION ALL '.join(parts)}) WHERE year(d) IN (SELECT y FROM years))"""


def days_sql(more: int) -> str:
    return f"""years AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders
  UNION SELECT unnest(range(max(year(o_orderdate)) + 1, max(year(o_orderdate)) + 1 + {more})) FROM orders),
days AS (SELECT unnest(generate_series(make_date((SELECT min(y) FROM years), 1, 1), make_date((SELECT max(y) FROM years) + 1, 12, 31), INTERVAL 1 DAY))::DATE AS d)"""


FEDERAL = calendar_sql("federal", [("FE", *rule) for rule in cal.FEDERAL_RULES])
STATES = calendar_sql("states", cal.STATE_RULES)
WITH_ROWS = "SELECT level, year, date, holiday_name, coalesce(n, 0) AS n_rows FROM {source} LEFT JOIN (SELECT o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY 1) USING (date)"


@query("C1_federal_holidays", f"WITH {days_sql(10)}, {FEDERAL} {WITH_ROWS.format(source='federal')}")
def _(t):
    return cal.orders_on(cal.federal_holidays(cal.years_of(t.orders, "o_orderdate", more=10)), t.orders, "o_orderdate")


OWNED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY level, holiday_name) AS r FROM states WHERE date NOT IN (SELECT date FROM federal)) WHERE r = 1)"


@query("C2_state_holidays", f"WITH {days_sql(0)}, {FEDERAL}, {STATES} {WITH_ROWS.format(source=OWNED.format(keys='date'))}")
def _(t):
    return cal.orders_on(cal.state_holidays(cal.years_of(t.orders, "o_orderdate")), t.orders, "o_orderdate")


@query("C2_state_holidays_per_state", f"WITH {days_sql(0)}, {FEDERAL}, {STATES} {WITH_ROWS.format(source=OWNED.format(keys='date, level'))}")
def _(t):
    return cal.orders_on(cal.state_holidays(cal.years_of(t.orders, "o_orderdate"), shared_dates=False), t.orders, "o_orderdate")

# Rules of states as a table of the shape of ``calendar.RULE_TABLE``; a full file of all states takes its place.
STATE_TABLE = [
    ("CT", "Good Friday", "easter", None, None, None, -2, None, None),
    ("DE", "Good Friday", "easter", None, None, None, -2, None, None),
    ("DE", "Election Day", "election", None, None, 2, None, None, None),
    ("LA", "Mardi Gras", "easter", None, None, None, -47, 1857, None),
    ("NV", "Nevada Day", "last", 10, "FRI", None, None, 2000, None),
    ("TX", "Friday After Thanksgiving", "nth", 11, "THU", 4, 1, None, None),
    ("UT", "Pioneer Day", "day", 7, None, 24, None, 1849, None),
]
# Easter here by the other classic rule, which carries the leap corrections of the century as divisions.
EASTER_SQL = """
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS m FROM e3),
easter AS (SELECT y, make_date(y::INTEGER, (m // 31)::INTEGER, (m % 31 + 1)::INTEGER) AS d FROM e4)"""
NOVEMBER_TUESDAY = "month(d) = 11 AND isodow(d) = 2 AND day(d) BETWEEN 2 AND 8"
RULED = f"""
ruled AS (SELECT 'CT' AS level, d - 2 AS date, 'Good Friday' AS holiday_name FROM easter UNION ALL SELECT 'DE', d - 2, 'Good Friday' FROM easter
  UNION ALL SELECT 'DE', d, 'Election Day' FROM days WHERE {NOVEMBER_TUESDAY} AND year(d) % 2 = 0 UNION ALL SELECT 'LA', d - 47, 'Mardi Gras' FROM easter
  UNION ALL SELECT 'NV', d, 'Nevada Day' FROM days WHERE month(d) = 10 AND isodow(d) = 5 AND day(d) > 24 AND year(d) >= 2000
  UNION ALL SELECT 'TX', d, 'Friday After Thanksgiving' FROM days WHERE month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 23 AND 29
  UNION ALL SELECT 'UT', d, 'Pioneer Day' FROM days WHERE month(d) = 7 AND day(d) = 24),
states AS (SELECT level, year(date)::INTEGER AS year, date::DATE AS date, holiday_name FROM ruled WHERE year(date) IN (SELECT y FROM years))"""


@query("C2_state_rules_of_a_table", f"WITH {days_sql(0)}, {FEDERAL}, {EASTER_SQL.strip()}, {RULED.strip()} {WITH_ROWS.format(source=OWNED.format(keys='date'))}")
def _(t):
    rules = t.spark.createDataFrame(STATE_TABLE, cal.RULE_TABLE)
    return cal.orders_on(cal.state_holidays_of(cal.years_of(t.orders, "o_orderdate"), rules), t.orders, "o_orderdate")


@query("C3_holidays_of_a_year", f"""
WITH {days_sql(0)}, {FEDERAL} SELECT level, year, date, holiday_name FROM federal WHERE year = 1999""")
def _(t):
    from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

    listed = cal.federal_holidays(cal.years_of(t.orders, "o_orderdate"))
    path = sinks.write_csv(listed, scratch_path(t.spark, "holidays"), ["year"])
    schema = StructType([StructField("level", StringType()), StructField("date", DateType()), StructField("holiday_name", StringType()), StructField("year", IntegerType())])
    return readers.read_csv(t.spark, path, schema, unescape=True).filter(F.col("year") == 1999)
