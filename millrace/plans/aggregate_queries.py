"""Aggregations: A8-A21, A24-A27, W3, W4, M17."""

from pyspark.sql import functions as F

from millrace.operators import aggregates as ag
from millrace.operators.ranking import average_rank
from millrace.plans.registry import query


@query("A8_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return ag.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("A9_value_counts", "SELECT quality, count(*) AS n, count(*) / (SELECT count(*) FROM labels) AS share FROM labels GROUP BY quality")
def _(t):
    return ag.value_counts(t.labels, "quality")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
PROFILE_ONE = """SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null,
  count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique, count({c}) AS n,
  round(avg({c}::DOUBLE)::DECIMAL(28,10), 6)::DOUBLE AS mean, round(stddev_samp({c}::DOUBLE), 6) AS stddev, min({c})::DOUBLE AS lowest,
  round(quantile_cont({c}::DOUBLE, 0.25), 6) AS lower, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
  round(quantile_cont({c}::DOUBLE, 0.75), 6) AS upper, max({c})::DOUBLE AS highest FROM lineitem"""


@query("A10_numeric_profile", " UNION ALL ".join(PROFILE_ONE.format(c=c) for c in NUMBERS))
def _(t):
    return ag.profile(t.lineitem, NUMBERS)


LABELS = ["l_returnflag", "l_linestatus"]


@query("A10_label_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique FROM lineitem"
    for c in LABELS))
def _(t):
    return ag.label_profile(t.lineitem, LABELS)


FUNNEL = {
    "entered": "TRUE",
    "type_answered": "event_type <> ''",
    "views": "event_type = 'view'",
    "clicks": "event_type = 'click'",
    "signups": "event_type = 'signup'",
    "purchases": "event_type = 'purchase'",
    "errors": "event_type = 'error'",
    "cheap_purchases": "event_type = 'purchase' AND value < 20",
    "dear_purchases": "event_type = 'purchase' AND value >= 20",
    "cheap_views": "event_type = 'view' AND value < 20",
    "dear_views": "event_type = 'view' AND value >= 20",
    "without_value": "value IS NULL",
    "first_users": "user_id < 10",
}


@query("A11_funnel_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS cell, count(*) FILTER (WHERE {condition}) AS n FROM events" for name, condition in FUNNEL.items()))
def _(t):
    return ag.conditional_counts(t.events, {name: F.expr(condition) for name, condition in FUNNEL.items()})


@query("A13_min_max_by_cell", """
SELECT l_returnflag, l_linestatus, min(l_quantity) AS min_value, max(l_quantity) AS max_value FROM lineitem GROUP BY ALL""")
def _(t):
    return ag.min_max(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")


@query("A14_means_one_and_two_keys", """
SELECT o_orderstatus, o_orderpriority, grouping(o_orderpriority) = 1 AS all_second, count(o_totalprice) AS n,
  round(avg(o_totalprice), 6) AS mean
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))""")
def _(t):
    return ag.means_one_and_two_keys(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("A15_box_summary", """
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, min(l_extendedprice) AS lowest,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS lower, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS upper, max(l_extendedprice) AS highest, round(avg(l_extendedprice), 6) AS mean
FROM lineitem GROUP BY ALL""")
def _(t):
    return ag.box_summary(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")


BINS = 30
EQUAL_BINS = f"""
WITH edge AS (SELECT min({{c}}) AS low, (max({{c}}) - min({{c}})) / {BINS} AS width, count({{c}}) AS total FROM {{t}}),
counts AS (SELECT least(floor(({{c}} - low) / width), {BINS - 1})::BIGINT AS bin, count(*) AS n FROM {{t}}, edge WHERE {{c}} IS NOT NULL GROUP BY 1)
SELECT b.bin, round(low + b.bin * width, 6) AS low, round(low + (b.bin + 1) * width, 6) AS high, coalesce(n, 0) AS n{{density}}
FROM (SELECT unnest(range({BINS})) AS bin) b CROSS JOIN edge LEFT JOIN counts USING (bin)"""


@query("A16_histogram_equal_bins", EQUAL_BINS.format(c="o_totalprice", t="orders", density=""))
def _(t):
    return ag.histogram_equal_bins(t.orders, "o_totalprice", BINS)


@query("A16_histogram_density", EQUAL_BINS.format(c="value", t="events", density=", round(coalesce(n, 0) / (total * width), 9) AS density"))
def _(t):
    return ag.histogram_equal_bins(t.events, "value", BINS, density=True)


BREAKS = [0, 1, 2, 3, 5, 10, 20, 50]


def _bin_sql(i: int) -> str:
    low, high = (BREAKS[i] if i >= 0 else None), (BREAKS[i + 1] if i + 1 < len(BREAKS) else None)
    tests = ([f"value {'>=' if i == 0 else '>'} {low}"] if low is not None else []) + ([f"value {'<=' if low is not None else '<'} {high}"] if high is not None else [])
    return f"""SELECT event_type, {i}::BIGINT AS bin, {'NULL' if low is None else low}::DOUBLE AS low, {'NULL' if high is None else high}::DOUBLE AS high,
        count(*) FILTER (WHERE {' AND '.join(tests)}) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type"""


@query("A16_histogram_breaks", " UNION ALL ".join(map(_bin_sql, range(-1, len(BREAKS)))))
def _(t):
    return ag.histogram_breaks(t.events, "value", BREAKS, ["event_type"])


@query("A17_removal_report", """
WITH failed AS (SELECT CASE WHEN NOT coalesce(o_orderstatus <> 'P', false) THEN 1
    WHEN NOT coalesce(year(o_orderdate) >= 1996, false) THEN 2
    WHEN NOT coalesce(o_totalprice >= 50000, false) THEN 3 WHEN NOT coalesce(o_orderpriority <> '5-LOW', false) THEN 4 END AS step FROM orders),
steps(step, reason) AS (VALUES (1, 'pending orders'), (2, 'before 1996'), (3, 'below 50000'), (4, 'low priority')),
removed AS (SELECT s.step, s.reason, count(f.step) AS n FROM steps s LEFT JOIN failed f USING (step) GROUP BY ALL)
SELECT step, reason, n AS number_samples_removed,
  ((SELECT count(*) FROM orders) - sum(n) OVER (ORDER BY step))::BIGINT AS remaining FROM removed""")
def _(t):
    return ag.removal_report(t.orders, [
        ("pending orders", F.col("o_orderstatus") != "P"),
        ("before 1996", F.year("o_orderdate") >= 1996),
        ("below 50000", F.col("o_totalprice") >= 50000),
        ("low priority", F.col("o_orderpriority") != "5-LOW"),
    ])


@query("A18_rate_by_group", """
SELECT o_orderpriority, count(*) AS n, round(100 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*))::BIGINT AS rate_percent
FROM orders GROUP BY o_orderpriority""")
def _(t):
    return ag.rate_by_group(t.orders, "o_orderpriority", F.col("o_orderstatus") == "F")


PLANT = """plant AS (
  SELECT p_brand AS product, date_trunc('month', l_shipdate)::DATE AS month, l_quantity::BIGINT AS demand, p_size::BIGINT AS capacity
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def plant(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("product"),
        F.trunc("l_shipdate", "month").alias("month"),
        F.col("l_quantity").cast("long").alias("demand"),
        F.col("p_size").cast("long").alias("capacity"),
    )


RATE = "sum(demand)::BIGINT AS total_demand, sum(capacity)::BIGINT AS total_capacity, round(100 * (sum(demand)::BIGINT / sum(capacity)::BIGINT), 6) AS utilization_rate"


@query("A19_product_utilisation", f"WITH {PLANT} SELECT * FROM (SELECT product, {RATE} FROM plant GROUP BY product) WHERE utilization_rate > 50")
def _(t):
    return ag.utilisation(plant(t), ["product"], "demand", "capacity")


@query("A20_shortfall", f"""
WITH {PLANT} SELECT product, month, sum(greatest(demand - capacity, 0))::BIGINT AS shortfall, count(*) FILTER (WHERE demand > capacity) AS times_short
FROM plant GROUP BY product, month""")
def _(t):
    return ag.shortfall(plant(t), ["product", "month"], "demand", "capacity")


@query("W3_utilisation_change", f"""
WITH {PLANT}, monthly AS (SELECT product, month, {RATE} FROM plant GROUP BY product, month)
SELECT *, lag(utilization_rate) OVER w AS previous_rate, round(utilization_rate - lag(utilization_rate) OVER w, 6) AS change
FROM monthly WINDOW w AS (PARTITION BY product ORDER BY month)""")
def _(t):
    return ag.utilisation_change(ag.utilisation(plant(t), ["product", "month"], "demand", "capacity", None), "product", "month")


@query("A21_daily_text", """
WITH numbered AS (
  SELECT ts::DATE AS day, '- [' || event_type || '] user ' || user_id || ' -- ' || props AS line,
    row_number() OVER (PARTITION BY ts::DATE ORDER BY event_type, event_id) AS place FROM events)
SELECT day, (place - 1) // 200 AS part, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY place) AS text
FROM numbered GROUP BY day, (place - 1) // 200""")
def _(t):
    line = F.concat(F.lit("- ["), "event_type", F.lit("] user "), F.col("user_id").cast("string"), F.lit(" -- "), "props")
    return ag.ordered_text(t.events.withColumn("day", F.to_date("ts")), ["day"], [F.col("event_type"), F.col("event_id")], line, part_rows=200)


SCORES = "scores AS (SELECT user_id, event_type AS model, least(avg(value) * 2, 100.0::DOUBLE) AS probability FROM events GROUP BY user_id, event_type)"


def model_scores(t):
    return t.events.groupBy("user_id", F.col("event_type").alias("model")).agg(F.least(F.avg("value") * 2, F.lit(100.0)).alias("probability"))


@query("A24_ensemble_vote", f"""
WITH {SCORES}, averaged AS (
  SELECT user_id, avg(CASE WHEN probability > 50 THEN 1.0::DOUBLE ELSE 0.0 END) AS mean_vote, round(avg(probability), 6) AS mean_probability
  FROM scores GROUP BY user_id)
SELECT *, CASE WHEN mean_vote > 0.5 OR (mean_vote = 0.5 AND mean_probability > 50) THEN 1 ELSE 0 END AS final_vote FROM averaged""")
def _(t):
    return ag.ensemble_vote(model_scores(t), "user_id", "probability")


GRADED = "graded AS (SELECT doc_id, quality, toxic, n_chars, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))"


def graded(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("predicted", F.when(F.col("n_chars") > 800, 1).otherwise(0))


@query("A25_confusion_matrix", f"WITH {GRADED} SELECT quality, predicted, count(*) AS n FROM graded GROUP BY ALL")
def _(t):
    return ag.confusion_matrix(graded(t), "quality", "predicted")


@query("A25_roc_auc", f"""
WITH {GRADED}, ranked AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM graded),
s AS (SELECT sum(r) FILTER (WHERE quality = 1) AS w, count(*) FILTER (WHERE quality = 1) AS n_positive, count(*) FILTER (WHERE quality = 0) AS n_negative FROM ranked)
SELECT n_positive, n_negative, round((w - n_positive * (n_positive + 1) / 2) / (n_positive * n_negative), 9) AS auc FROM s""")
def _(t):
    return ag.roc_auc(graded(t), "quality", "n_chars")


@query("M17_accuracy", f"WITH {GRADED} SELECT count(*) AS n, round(100 * avg(CASE WHEN quality = predicted THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy_percent FROM graded")
def _(t):
    return ag.accuracy_percent(graded(t), "quality", "predicted")


@query("M17_mean_squared_error", "SELECT count(*) AS n, round(avg((l_discount - l_tax) * (l_discount - l_tax)), 6) AS mse FROM lineitem")
def _(t):
    return ag.mean_squared_error(t.lineitem, "l_tax", "l_discount")


@query("A26_array_statistics", """
SELECT label, (position - 1)::INTEGER AS position, count(*) AS n, round(avg(x::DOUBLE), 6) AS mean, round(stddev_pop(x::DOUBLE), 6) AS stddev
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM embeddings) GROUP BY label, position""")
def _(t):
    return ag.array_statistics(t.embeddings, ["label"], "embedding")


@query("A27_mean_over_folds", """
WITH folds AS (SELECT year(o_orderdate)::INTEGER AS epoch, o_orderpriority AS fold, avg(o_totalprice) AS loss FROM orders GROUP BY ALL)
SELECT epoch, count(*) AS n, round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS stddev FROM folds GROUP BY epoch""")
def _(t):
    folds = t.orders.groupBy(F.year("o_orderdate").alias("epoch"), F.col("o_orderpriority").alias("fold")).agg(F.avg("o_totalprice").alias("loss"))
    return ag.mean_and_spread(folds, ["epoch"], "loss")


@query("W4_average_rank", """
SELECT o_orderkey, o_totalprice, (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2)::DOUBLE AS rank,
  count(*) OVER (PARTITION BY o_totalprice) AS n_ties FROM orders""")
def _(t):
    return average_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "rank", ties="n_ties")
