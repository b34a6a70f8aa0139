"""The test tables under the operators' column names, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import graph, retail
from millrace.session import checkpoint
from millrace.tables import Tables

# Parts larger than this size stand in for products no longer sold.
LARGEST_SOLD_SIZE = 45


def customers(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("n_name").alias("country")
    )


def orders(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("category_id"),
        F.when(F.col("p_size") > LARGEST_SOLD_SIZE, 1).otherwise(0).alias("discontinued"),
    )


def plain_lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"),
        F.col("l_discount").cast("decimal(6,2)").alias("discount"),
    )


def lines(t: Tables) -> DataFrame:
    buyers = t.customer.select(F.col("c_custkey").alias("customer_id"))
    return retail.customer_lines(plain_lines(t), orders(t), buyers)


def edges(t: Tables) -> DataFrame:
    """The rated edges as a plan: a question about one customer or product prunes what it does not need."""
    return graph.rated_edges(retail.ratings(lines(t)), products(t))


def written_edges(t: Tables) -> DataFrame:
    """The rated edges, written once per ``Tables``, for questions that truly read all of them more than once."""
    if t.cache.get("edges") is None:
        t.cache["edges"] = checkpoint(edges(t))
    return t.cache["edges"]


# The same relations as SQL common table expressions.
LINES = """
lines AS (
  SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
         l_quantity::BIGINT AS quantity, l_extendedprice::DECIMAL(12,2) AS unit_price,
         l_discount::DECIMAL(6,2) AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

PRODUCTS = f"""
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category_id,
         CASE WHEN p_size > {LARGEST_SOLD_SIZE} THEN 1 ELSE 0 END AS discontinued FROM part)"""

CUSTOMERS = """
customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

RATINGS = """
ratings AS (
  SELECT customer_id, product_id, total_products_purchased, total_purchased,
         total_products_purchased / total_purchased AS rating
  FROM (SELECT customer_id, product_id, sum(quantity)::BIGINT AS total_products_purchased
        FROM lines GROUP BY ALL) a
  JOIN (SELECT customer_id, sum(quantity)::BIGINT AS total_purchased FROM lines GROUP BY ALL) b
  USING (customer_id))"""

EDGES = """
edges AS (
  SELECT customer_id, product_id, category_id, rating
  FROM ratings JOIN products USING (product_id) WHERE discontinued = 0)"""

GRAPH = "WITH " + ",".join([LINES, PRODUCTS, RATINGS, EDGES])
