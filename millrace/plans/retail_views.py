"""Retail joins and views: J1, J2, A1-A7."""

from pyspark.sql import functions as F

from millrace.operators import retail
from millrace.plans import fixtures as fx
from millrace.plans.registry import query

TOTALS = """
totals AS (
  SELECT customer_id, sum(quantity)::BIGINT AS total_quantity_purchased,
         sum((unit_price - discount) * quantity::DECIMAL(10,0)) AS total_spend_amount,
         count(DISTINCT product_id) AS total_unique_products_purchased
  FROM lines GROUP BY customer_id),
order_counts AS (SELECT o_custkey AS customer_id, count(o_orderkey) AS total_orders FROM orders GROUP BY o_custkey)"""


@query("J1_lines_with_customer", f"""
WITH {fx.LINES}, {fx.CUSTOMERS}
SELECT order_id, product_id, quantity, customer_id, customer_name, country FROM lines JOIN customers USING (customer_id)""")
def _(t):
    return fx.plain_lines(t).join(fx.orders(t).join(fx.customers(t), "customer_id"), "order_id").select(
        "order_id", "product_id", "quantity", "customer_id", "customer_name", "country"
    )


@query("J2_order_line_rollup", f"""
WITH {fx.LINES}, {fx.RATINGS}, order_counts AS (
  SELECT o_custkey AS customer_id, count(o_orderkey) AS total_orders FROM orders GROUP BY o_custkey)
SELECT order_id, product_id, quantity, customer_id, total_orders, total_products_purchased, total_purchased, rating
FROM lines JOIN ratings USING (customer_id, product_id) JOIN order_counts USING (customer_id)""")
def _(t):
    return retail.order_line_rollup(fx.lines(t), fx.orders(t)).select(
        "order_id", "product_id", "quantity", "customer_id", "total_orders",
        "total_products_purchased", "total_purchased", "rating",
    )


@query("A1_orders_per_customer", """
SELECT c_custkey AS customer_id, c_name, c_mktsegment, n AS total_orders
FROM customer JOIN (SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("customer_id"), "c_name", "c_mktsegment")
    return retail.customers_with_orders(people, fx.orders(t))


@query("A2_quantity_per_customer_product", f"""
WITH {fx.LINES}
SELECT customer_id, product_id, sum(quantity)::BIGINT AS total_products_purchased FROM lines GROUP BY ALL""")
def _(t):
    return fx.lines(t).groupBy("customer_id", "product_id").agg(F.sum("quantity").alias("total_products_purchased"))


@query("A3_unique_products_with_sums", f"""
WITH {fx.LINES}
SELECT customer_id, sum(quantity)::BIGINT AS total_quantity, count(DISTINCT product_id) AS unique_products,
       count(DISTINCT order_id) AS unique_orders
FROM lines GROUP BY customer_id""")
def _(t):
    return fx.lines(t).groupBy("customer_id").agg(
        F.sum("quantity").alias("total_quantity"),
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("order_id").alias("unique_orders"),
    )


@query("A4_customer_view", f"""
WITH {fx.LINES}, {fx.CUSTOMERS}, {TOTALS}
SELECT customer_id, customer_name, country AS customer_country, total_orders, total_quantity_purchased,
       total_spend_amount::DOUBLE AS total_spend_amount, total_unique_products_purchased
FROM customers JOIN totals USING (customer_id) JOIN order_counts USING (customer_id)
ORDER BY total_spend_amount DESC, customer_id""")
def _(t):
    return retail.customer_view(fx.customers(t), fx.orders(t), fx.lines(t))


@query("A5_region_view", f"""
WITH {fx.LINES}, {fx.CUSTOMERS}, {TOTALS}
SELECT country, sum(total_orders)::BIGINT AS country_total_orders,
       sum(total_quantity_purchased)::BIGINT AS country_total_orders_quirk,
       sum(total_quantity_purchased)::BIGINT AS country_total_quantity_purchased,
       sum(total_spend_amount)::DOUBLE AS country_total_spend_amount,
       sum(total_unique_products_purchased)::BIGINT AS country_total_unique_products_purchased
FROM customers JOIN totals USING (customer_id) JOIN order_counts USING (customer_id)
GROUP BY country""")
def _(t):
    return retail.region_view(fx.customers(t), fx.orders(t), fx.lines(t))


PRODUCT_SQL = """
SELECT product_id, product_name, sum(q)::BIGINT AS total_quantity_purchased, sum(s)::DOUBLE AS total_spend_amount
FROM ({inner}) JOIN products USING (product_id) WHERE discontinued = 0 GROUP BY product_id, product_name"""
PER_CUSTOMER = """SELECT customer_id, product_id, sum(quantity) AS q,
  sum((unit_price - discount) * quantity::DECIMAL(10,0)) AS s FROM lines GROUP BY customer_id, product_id"""


@query("A6_product_view", f"WITH {fx.LINES}, {fx.PRODUCTS}" + PRODUCT_SQL.format(inner=PER_CUSTOMER))
def _(t):
    return retail.product_view(fx.products(t), fx.lines(t))


@query("A6_product_view_quirk", f"WITH {fx.LINES}, {fx.PRODUCTS}" + PRODUCT_SQL.format(
    inner=f"SELECT DISTINCT product_id, q, s FROM ({PER_CUSTOMER})"))
def _(t):
    return retail.product_view(fx.products(t), fx.lines(t), quirk=True)


@query("A7_ratings", f"""
WITH {fx.LINES}, {fx.RATINGS}
SELECT customer_id, product_id, total_products_purchased, total_purchased, rating FROM ratings""")
def _(t):
    return retail.ratings(fx.lines(t))
