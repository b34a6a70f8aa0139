"""Orders, samples, sets, reshapes and the remaining joins: O, U, R, W1, W5, W6, J3-J5, J12, J14."""

from pyspark.sql import functions as F

from millrace.operators import reshape, sampling, sets
from millrace.operators.ranking import first_by, hash_rank, rank_in_order, top_k
from millrace.plans.registry import query

# --- joins


@query("J3_merge_on_two_names", """
SELECT o_orderkey, l_partkey, l_quantity, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def _(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey", "l_quantity", "o_orderpriority")


@query("J4_three_key_merge", """
WITH c AS (SELECT l_returnflag AS item, l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY ALL),
h AS (SELECT item, kind, n, n / 2 AS height FROM c)
SELECT c.item, c.kind, c.n, h.height FROM c JOIN h ON c.item = h.item AND c.kind = h.kind AND c.n = h.n""")
def _(t):
    counts = t.lineitem.groupBy(F.col("l_returnflag").alias("item"), F.col("l_linestatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.withColumn("height", F.col("n") / 2), ["item", "kind", "n"])


@query("J5_complement_by_id", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    return sampling.complement(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("J12_month_grid", """
WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM orders)
SELECT o_orderpriority, m::DATE AS month FROM (SELECT DISTINCT o_orderpriority FROM orders),
  (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM b)""")
def _(t):
    return sets.monthly_grid(t.orders, "o_orderpriority", "o_orderdate")


@query("J14_latest_date", """
SELECT coalesce(max(CASE WHEN d <= DATE '1998-06-15' THEN d END), max(d)) AS as_of, count(DISTINCT d) AS n_dates
FROM (SELECT o_orderdate::DATE AS d FROM orders)""")
def _(t):
    return sets.latest_date(t.orders.select(F.to_date("o_orderdate").alias("d")), "d", "1998-06-15")


# --- order and limits


@query("O1_order_by_metric", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""")
def _(t):
    return rank_in_order(t.orders.select("o_orderkey", "o_totalprice"), [], [F.desc("o_totalprice"), F.col("o_orderkey")], "place")


@query("O2_two_key_order", """
SELECT event_id, day, event_type, row_number() OVER (ORDER BY day DESC, event_type, event_id) AS place
FROM (SELECT event_id, ts::DATE AS day, event_type FROM events)""")
def _(t):
    rows = t.events.select("event_id", F.to_date("ts").alias("day"), "event_type")
    return rank_in_order(rows, [], [F.desc("day"), F.col("event_type"), F.col("event_id")], "place")


TIER = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 9 END"


def tiered(t):
    tier = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(9)
    return t.events.select("event_id", "ts", tier.alias("tier"))


@query("O3_tier_then_recency", f"""
SELECT event_id, tier, row_number() OVER (ORDER BY tier, ts DESC, event_id) AS place FROM (SELECT event_id, ts, {TIER} AS tier FROM events)""")
def _(t):
    return rank_in_order(tiered(t), [], [F.col("tier"), F.desc("ts"), F.col("event_id")], "place").drop("ts")


@query("O4_cap_overall", f"SELECT event_id, {TIER} AS tier FROM events ORDER BY tier, ts DESC, event_id LIMIT 150")
def _(t):
    return tiered(t).orderBy("tier", F.desc("ts"), "event_id").limit(150).drop("ts")


@query("O5_head_per_class", """
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':head'), doc_id) AS r FROM labels) WHERE r <= 10""")
def _(t):
    return sampling.head_per_class(t.labels, "quality", "doc_id", 10, "head").select("doc_id", "quality")


@query("O5_remainder", """
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':head'), doc_id) AS r FROM labels) WHERE r > 10""")
def _(t):
    return sampling.complement(t.labels, sampling.head_per_class(t.labels, "quality", "doc_id", 10, "head"), "doc_id").select("doc_id", "quality")


@query("O6_shuffle", "SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':shuffle'), o_orderkey) AS place FROM orders")
def _(t):
    return sampling.shuffled(t.orders.select("o_orderkey"), "o_orderkey", "shuffle").withColumn("place", F.col("place").cast("long"))


# --- windows


@query("W1_first_write_wins", """
SELECT doc_id, source, key FROM (
  SELECT doc_id, source, md5(lower(trim(text))) AS key,
    row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1""")
def _(t):
    keyed = t.documents.select("doc_id", "source", F.md5(F.lower(F.trim("text"))).alias("key"))
    return first_by(keyed, ["key"], [F.col("source"), F.col("doc_id")])


PARTS = {"train": 0.6, "validation": 0.2, "test": 0.2}
PART = """CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation'
  WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'rest' END AS part"""


@query("W5_split_per_class", f"""
SELECT doc_id, quality, {PART} FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':split'), doc_id) AS r,
    count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def _(t):
    return sampling.labelled_split(t.labels, ["quality"], "doc_id", PARTS, "split").select("doc_id", "quality", "part")


@query("W5_balanced_split", f"""
SELECT doc_id, quality, {PART} FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':split'), doc_id) AS r,
    (SELECT count(*) FROM labels WHERE quality = 0) AS n FROM labels)""")
def _(t):
    return sampling.balanced_split(t.labels, "quality", 0, "doc_id", PARTS, "split").select("doc_id", "quality", "part")


@query("W6_stratified_folds", """
SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':fold'), o_orderkey) - 1) % 8)::INTEGER AS fold FROM orders""")
def _(t):
    return sampling.folds(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 8, "fold")


# --- set operations


@query("U1_stack_by_name", """
SELECT c_custkey AS key, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier""")
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    firms = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return sets.stack([people, firms])


@query("U2_stack_by_position", """
SELECT l_returnflag AS answer, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY 1""")
def _(t):
    first = t.lineitem.groupBy(F.col("l_returnflag").alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    second = t.lineitem.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("m"))
    return sets.stack([first, second], by_position=True)


@query("U3_balanced_union", """
SELECT doc_id, toxic FROM (
  SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':balance'), doc_id) AS r FROM labels)
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))""")
def _(t):
    """Of every class as many rows as the smallest one has."""
    classes = t.labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    least = classes.agg(F.min("n")).scalar()
    return hash_rank(t.labels, ["toxic"], "doc_id", "balance", "_r").filter(F.col("_r") <= least).select("doc_id", "toxic")


@query("U4_expanded_vectors", """
SELECT vec_id, label, 'original' AS kind, embedding FROM embeddings
UNION ALL SELECT vec_id, label, 'reversed', list_reverse(embedding) FROM embeddings
UNION ALL SELECT vec_id, label, 'rotated', list_concat(embedding[33:64], embedding[1:32]) FROM embeddings
UNION ALL SELECT vec_id, label, 'negated', list_transform(embedding, lambda x: -x) FROM embeddings""")
def _(t):
    v = F.col("embedding")
    return sets.expanded(t.embeddings, "embedding", {
        "original": v,
        "reversed": F.reverse(v),
        "rotated": F.concat(F.slice(v, 33, 32), F.slice(v, 1, 32)),
        "negated": F.transform(v, lambda x: -x),
    })


@query("U5_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    big = t.orders.filter(F.col("o_totalprice") > 400000)
    return sets.difference(t.orders.select("o_custkey").distinct(), big, ["o_custkey"])


# --- reshape and sampling


@query("R1_wide_to_long", """
SELECT l_orderkey, l_partkey, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'l_tax', l_tax FROM lineitem""")
def _(t):
    return reshape.to_long(t.lineitem, ["l_orderkey", "l_partkey"], ["l_discount", "l_tax"])


ITEMS = ["l_returnflag", "l_linestatus"]


@query("R2_answer_counts", " UNION ALL ".join(f"SELECT '{c}' AS item, {c} AS answer, count(*) AS n FROM lineitem GROUP BY {c}" for c in ITEMS))
def _(t):
    return reshape.answer_counts(t.lineitem, ITEMS)


@query("R3_contingency", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return reshape.contingency(t.orders, "o_orderpriority", "o_orderstatus")


@query("R3_contingency_wide", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY ALL""")
def _(t):
    return reshape.contingency_wide(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


SAMPLE = """sampled AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, r <= round(n * 0.3::DOUBLE) AS chosen FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5(o_orderkey || ':explore'), o_orderkey) AS r,
    count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders))"""


def explore(t):
    return sampling.stratified_sample(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 0.3, "explore")


@query("R4_stratified_sample", f"WITH {SAMPLE} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM sampled WHERE chosen")
def _(t):
    return explore(t)


@query("R4_sample_complement", f"WITH {SAMPLE} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM sampled WHERE NOT chosen")
def _(t):
    return sampling.complement(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), explore(t), "o_orderkey")


@query("R5_train_test_split", """
SELECT vec_id, label, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""")
def _(t):
    return sampling.train_test(t.embeddings.select("vec_id", "label"), "vec_id", 0.2, "42", ["label"])


@query("R5_train_test_unstratified", """
SELECT vec_id, label, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT *, row_number() OVER (ORDER BY md5(vec_id || ':1'), vec_id) AS r, count(*) OVER () AS n FROM embeddings)""")
def _(t):
    return sampling.train_test(t.embeddings.select("vec_id", "label"), "vec_id", 0.2, "1")


@query("R6_random_assignment", """
SELECT c_custkey, arm, CASE WHEN row_number() OVER (PARTITION BY arm ORDER BY md5(c_custkey || ':pilot/timing'), c_custkey)
    <= round(count(*) OVER (PARTITION BY arm) / 2) THEN 1 ELSE 0 END AS timing
FROM (SELECT c_custkey, CASE WHEN md5(c_custkey || ':pilot/arm') < '8' THEN 0 ELSE 1 END AS arm FROM customer)""")
def _(t):
    return sampling.random_assignment(t.customer.select("c_custkey"), "c_custkey", "pilot")


@query("A12_top_k_per_group", """
SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def _(t):
    order = [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")]
    return top_k(t.lineitem, ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice", "rank")
