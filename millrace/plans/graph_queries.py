"""Purchase-graph queries: J6-J11, A22, W2, G1-G11."""

from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans import fixtures as fx
from millrace.plans.registry import query

PAIRS = """
pairs AS (
  SELECT a.customer_id AS customer_1, b.customer_id AS customer_2, a.product_id,
         a.rating AS rating_1, b.rating AS rating_2
  FROM edges a JOIN edges b ON a.product_id = b.product_id AND a.customer_id <> b.customer_id
  WHERE a.customer_id = {customer})"""
SIMILARITY = """
similarity AS (
  SELECT customer_1, customer_2, count(*) AS n_shared,
         round(sum(rating_1 * rating_2) / (sqrt(sum(rating_1 * rating_1)) * sqrt(sum(rating_2 * rating_2))), 6) AS similarity
  FROM pairs GROUP BY customer_1, customer_2)"""
NEAR = """
near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY similarity DESC, neighbour_id) AS rank
    FROM (SELECT customer_1 AS customer_id, customer_2 AS neighbour_id, similarity FROM similarity))
  WHERE rank <= {k})"""

# Parameters of the one-customer, one-product and one-category questions.
CUSTOMER, PRODUCT, CATEGORY = 17, 3, "Brand#22"
HIGH, GAP, SMALL_GAP = 0.01, 0.02, 0.002
PAIRS = PAIRS.format(customer=CUSTOMER)


@query("J6_not_bought", f"""
{fx.GRAPH}
SELECT i.customer_id, p.product_id FROM (SELECT DISTINCT customer_id, category_id FROM edges WHERE customer_id = {CUSTOMER}) i JOIN products p USING (category_id)
WHERE discontinued = 0 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.customer_id = i.customer_id AND e.product_id = p.product_id)""")
def _(t):
    return graph.unbought_in_category(fx.edges(t), fx.products(t), CUSTOMER).select("customer_id", "product_id")


@query("J7_co_rating_pairs", f"{fx.GRAPH},{PAIRS} SELECT customer_1, customer_2, product_id FROM pairs")
def _(t):
    return graph.co_rating_pairs(fx.edges(t), CUSTOMER).select("customer_1", "customer_2", "product_id")


@query("J8_first_product_per_pair", f"""
{fx.GRAPH},{PAIRS}
SELECT customer_1, customer_2, product_id, rating_1, rating_2 FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_1, customer_2 ORDER BY abs(rating_1 - rating_2) DESC, product_id) AS rn
  FROM pairs WHERE rating_1 > {HIGH} AND rating_2 > {HIGH} AND abs(rating_1 - rating_2) < {GAP}) WHERE rn = 1""")
def _(t):
    return graph.first_product_per_pair(graph.close_high_raters(fx.edges(t), CUSTOMER, HIGH, GAP))


@query("J9_rating_gap_band", f"""
{fx.GRAPH},{PAIRS}
SELECT * FROM pairs WHERE rating_1 > {HIGH} AND rating_2 > {HIGH}
  AND abs(rating_1 - rating_2) > {SMALL_GAP} AND abs(rating_1 - rating_2) < {GAP}""")
def _(t):
    return graph.close_high_raters(fx.edges(t), CUSTOMER, HIGH, GAP, SMALL_GAP)


@query("J10_purchase_paths", f"""
WITH {fx.LINES}, {fx.PRODUCTS}
SELECT customer_id, order_id, product_id, product_name, category_id, quantity
FROM lines JOIN products USING (product_id) WHERE discontinued = 0""")
def _(t):
    return graph.purchase_paths(fx.lines(t), fx.products(t)).select(
        "customer_id", "order_id", "product_id", "product_name", "category_id", "quantity"
    )


EDGE_TABLE = f"""
{fx.GRAPH}, live AS (SELECT * FROM products WHERE discontinued = 0), edge_table AS (
SELECT 'part_of' AS edge, 'prod_' || product_id AS src, 'ctg_' || category_id AS dst FROM live
UNION SELECT 'supplies', 'suppl_' || l_suppkey, 'prod_' || l_partkey FROM lineitem WHERE l_partkey IN (SELECT product_id FROM live)
UNION SELECT 'orders', 'cust_' || o_custkey, 'ord_' || o_orderkey FROM orders
UNION SELECT 'comprised_of', 'ord_' || order_id, 'line_' || order_id || '_' || product_id FROM lines
UNION SELECT 'contains', 'line_' || order_id || '_' || product_id, 'prod_' || product_id FROM lines
  WHERE product_id IN (SELECT product_id FROM live)
UNION SELECT 'has_number_of', 'prod_' || product_id, 'rating_' || product_id FROM edges)"""


def edge_table(t):
    supplies = t.lineitem.select(F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("product_id"))
    return graph.edge_table(fx.lines(t), fx.orders(t), fx.products(t), supplies, graph.rating_counts(fx.written_edges(t)))


@query("J11_edge_table", f"{EDGE_TABLE} SELECT edge, src, dst FROM edge_table")
def _(t):
    return edge_table(t)


@query("G1_graph_counts", f"""
{EDGE_TABLE}
SELECT 'relationship' AS kind, edge AS label, count(*) AS n FROM edge_table GROUP BY edge
UNION ALL SELECT 'relationship', 'rated', count(*) FROM edges
UNION ALL SELECT 'node', 'customer', count(*) FROM customer
UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier
UNION ALL SELECT 'node', 'ctg', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'node', 'product', count(*) FROM live
UNION ALL SELECT 'node', 'order_header', count(*) FROM orders
UNION ALL SELECT 'node', 'order_line', count(*) FROM (SELECT DISTINCT order_id, product_id FROM lines)""")
def _(t):
    rated = fx.written_edges(t).select(
        F.lit("rated").alias("edge"), graph.prefixed("cust_", "customer_id").alias("src"),
        graph.prefixed("prod_", "product_id").alias("dst"),
    )
    nodes = {
        "customer": t.customer,
        "supplier": t.supplier,
        "ctg": t.part.select("p_brand").distinct(),
        "product": fx.products(t).filter(F.col("discontinued") == 0),
        "order_header": t.orders,
        "order_line": fx.lines(t).select("order_id", "product_id").distinct(),
    }
    return graph.graph_counts(nodes, edge_table(t).unionByName(rated))


PATHS = f"WITH {fx.LINES}, {fx.PRODUCTS}, paths AS (SELECT * FROM lines JOIN products USING (product_id) WHERE discontinued = 0)"


@query("G2_quantity_by_customer", f"""
{PATHS} SELECT customer_id, c_name AS customer_name, sum(quantity)::BIGINT AS total_qty_purchased
FROM paths JOIN customer ON customer_id = c_custkey GROUP BY ALL""")
def _(t):
    return graph.quantity_by_customer(graph.purchase_paths(fx.lines(t), fx.products(t)), fx.customers(t))


@query("G2_category_quantity_by_customer", f"""
{PATHS} SELECT customer_id, c_name AS customer_name, sum(quantity)::BIGINT AS total_qty_purchased
FROM paths JOIN customer ON customer_id = c_custkey WHERE category_id = '{CATEGORY}' GROUP BY ALL""")
def _(t):
    return graph.quantity_by_customer(graph.purchase_paths(fx.lines(t), fx.products(t)), fx.customers(t), CATEGORY)


@query("G2_quantity_by_customer_product", f"""
{PATHS} SELECT customer_id, category_id, product_id, count(order_id) AS total_orders,
  sum(quantity)::BIGINT AS total_prod_qty_purchased FROM paths GROUP BY ALL""")
def _(t):
    return graph.quantity_by_customer_product(graph.purchase_paths(fx.lines(t), fx.products(t)))


@query("G2_category_quantity_by_customer_product", f"""
{PATHS} SELECT customer_id, category_id, product_id, count(order_id) AS total_orders,
  sum(quantity)::BIGINT AS total_prod_qty_purchased FROM paths WHERE category_id = '{CATEGORY}' GROUP BY ALL""")
def _(t):
    return graph.quantity_by_customer_product(graph.purchase_paths(fx.lines(t), fx.products(t)), CATEGORY)


CO_BUYERS = f"""
candidates AS (
  SELECT a.customer_id, c.category_id, c.product_id, count(*) AS n_paths
  FROM edges a JOIN edges b ON a.product_id = b.product_id AND a.customer_id <> b.customer_id
  JOIN edges c ON c.customer_id = b.customer_id AND c.category_id = a.category_id AND c.product_id <> a.product_id
  WHERE a.customer_id = {CUSTOMER} AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.customer_id = a.customer_id AND o.product_id = c.product_id)
  GROUP BY ALL)"""


@query("G3_co_buyer_recommendations", f"{fx.GRAPH},{CO_BUYERS} SELECT customer_id, category_id, product_id FROM candidates")
def _(t):
    return graph.co_buyer_candidates(fx.edges(t), CUSTOMER).drop("n_paths")


@query("G3_co_buyer_paths", f"{fx.GRAPH},{CO_BUYERS} SELECT customer_id, category_id, product_id, n_paths FROM candidates")
def _(t):
    """How many ways lead to each recommended product."""
    return graph.co_buyer_candidates(fx.edges(t), CUSTOMER)


@query("G4_unbought_in_category", f"""
{fx.GRAPH}
SELECT customer_id, category_id, product_id, n_paths
FROM (SELECT customer_id, category_id, count(*) AS n_paths FROM edges WHERE customer_id = {CUSTOMER} GROUP BY ALL) i JOIN products p USING (category_id)
WHERE discontinued = 0
  AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.customer_id = i.customer_id AND o.product_id = p.product_id)""")
def _(t):
    return graph.unbought_in_category(fx.edges(t), fx.products(t), CUSTOMER)


@query("A22_recommendation_lists", f"""
{fx.GRAPH},{CO_BUYERS}
SELECT customer_id, category_id, list(product_id ORDER BY product_id) AS recommended_products
FROM (SELECT customer_id, category_id, product_id, unnest(range(n_paths)) FROM candidates) GROUP BY customer_id, category_id""")
def _(t):
    return graph.recommendation_lists(graph.co_buyer_candidates(fx.edges(t), CUSTOMER))


@query("G5_rating_difference_customer", f"{fx.GRAPH},{PAIRS} SELECT *, abs(rating_1 - rating_2) AS rating_difference FROM pairs")
def _(t):
    return graph.rating_differences(fx.edges(t), CUSTOMER)


@query("G5_rating_difference_product", f"""
{fx.GRAPH}
SELECT customer_id, product_id, rating, round(avg(rating) OVER (), 9) AS mean_rating, round(abs(rating - round(avg(rating) OVER (), 9)), 9) AS rating_difference
FROM edges WHERE product_id = {PRODUCT}""")
def _(t):
    return graph.rating_gaps_to_mean(fx.edges(t), PRODUCT)


@query("G5_rating_difference_all", f"""
{fx.GRAPH},{PAIRS} SELECT *, abs(rating_1 - rating_2) AS rating_difference FROM pairs
WHERE product_id IN (SELECT product_id FROM products WHERE category_id = '{CATEGORY}')""")
def _(t):
    return graph.rating_differences(fx.edges(t), CUSTOMER, CATEGORY)


@query("G6_close_high_raters", f"""
{fx.GRAPH},{PAIRS}
SELECT * FROM pairs WHERE rating_1 > {HIGH} AND rating_2 > {HIGH} AND abs(rating_1 - rating_2) < {GAP}""")
def _(t):
    return graph.close_high_raters(fx.edges(t), CUSTOMER, HIGH, GAP)


@query("G6_close_high_raters_quirk", f"""
{fx.GRAPH},{PAIRS} SELECT * FROM pairs WHERE rating_1 > {HIGH} AND rating_2 > {HIGH} AND rating_1 - rating_2 < {GAP}""")
def _(t):
    return graph.close_high_raters(fx.edges(t), CUSTOMER, HIGH, GAP, quirk=True)


@query("G7_customer_similarity", f"{fx.GRAPH},{PAIRS},{SIMILARITY} SELECT * FROM similarity")
def _(t):
    return graph.cosine_similarity(fx.edges(t), CUSTOMER)


@query("W2_nearest_customers", f"{fx.GRAPH},{PAIRS},{SIMILARITY},{NEAR.format(k=3)} SELECT customer_id, neighbour_id, similarity, rank FROM near")
def _(t):
    return graph.nearest_customers(graph.cosine_similarity(fx.edges(t), CUSTOMER), 3).withColumn("rank", F.col("rank").cast("long"))


@query("G8_collaborative_filter", f"""
{fx.GRAPH},{PAIRS},{SIMILARITY},{NEAR.format(k=5)}
SELECT * FROM (
  SELECT n.customer_id, e.product_id, count(*) AS n_neighbours, round(avg(e.rating), 9) AS recommendation
  FROM near n JOIN edges e ON e.customer_id = n.neighbour_id
  WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.customer_id = n.customer_id AND o.product_id = e.product_id)
  GROUP BY ALL)
WHERE recommendation > 0.04 AND recommendation < 0.3""")
def _(t):
    return graph.collaborative_filter(fx.edges(t), CUSTOMER, 5, 0.04, 0.3)


@query("G9_also_bought", f"""
{fx.GRAPH}
SELECT CAST({PRODUCT} AS BIGINT) AS original_product, b.product_id AS recommendation, count(*) AS customers_also_bought_n_times
FROM edges a JOIN edges b ON a.customer_id = b.customer_id AND a.product_id = {PRODUCT} AND b.product_id <> {PRODUCT}
GROUP BY b.product_id HAVING count(*) > 1""")
def _(t):
    return graph.also_bought(fx.edges(t), PRODUCT, more_than=1)


@query("G10_rating_counts", f"{fx.GRAPH} SELECT category_id, product_id, count(*) AS rating_count FROM edges GROUP BY ALL")
def _(t):
    return graph.rating_counts(fx.edges(t)).orderBy("category_id", F.desc("rating_count"), "product_id")


BETTER = f"""
{fx.GRAPH}, counts AS (SELECT category_id, product_id, count(*) AS n FROM edges GROUP BY ALL),
floors AS (SELECT e.customer_id, e.category_id, min(n) AS floor FROM edges e JOIN counts c ON c.product_id = e.product_id WHERE e.customer_id = {CUSTOMER} GROUP BY ALL)
SELECT f.customer_id, f.category_id, floor, c.product_id, n AS rating_count FROM floors f JOIN counts c ON c.category_id = f.category_id
WHERE n > floor AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.customer_id = f.customer_id AND o.product_id = c.product_id)"""


@query("G11_better_rated_for_customer", BETTER)
def _(t):
    return graph.better_rated_unbought(fx.edges(t), CUSTOMER)


@query("G11_better_rated_unbought", f"{BETTER} AND f.category_id = '{CATEGORY}'")
def _(t):
    return graph.better_rated_unbought(fx.edges(t), CUSTOMER, CATEGORY)
