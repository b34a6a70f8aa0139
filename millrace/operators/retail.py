"""Retail rollups: customer, region and product views, order-line rollups and
ratings.

Inputs use these column names:

* lines: order_id, customer_id, product_id, quantity, unit_price, discount
  (one row per order line, already carrying its order's customer)
* orders: order_id, customer_id; customers: customer_id, customer_name, country
* products: product_id, product_name, category_id, discontinued
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def line_spend() -> Column:
    """Spend of a line; the discount is an absolute amount off the unit price."""
    return (F.col("unit_price") - F.col("discount")) * F.col("quantity").cast("decimal(10,0)")


def customer_lines(lines: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Order lines with their order's customer, for customers that exist.

    Orders meet customers first, so the lines are exchanged once. Orders are
    unique on their key: a hot order only makes the line side uneven, which the
    adaptive skew join splits.
    """
    owned = orders.join(customers.select("customer_id"), "customer_id", "left_semi")
    return lines.join(owned, "order_id")


def order_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(F.count("order_id").alias("total_orders"))


def customers_with_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer rows with their order count; customers without orders drop out."""
    return customers.join(order_counts(orders), "customer_id")


def purchases(lines: DataFrame) -> DataFrame:
    """One row per (customer, product): the pre-aggregate all views start from."""
    return lines.groupBy("customer_id", "product_id").agg(
        F.sum("quantity").alias("quantity"), F.sum(line_spend()).alias("spend")
    )


def customer_totals(bought: DataFrame) -> DataFrame:
    """Per customer from (customer, product) rows: the count of rows is the
    count of distinct products, so no second distinct pass is needed."""
    return bought.groupBy("customer_id").agg(
        F.sum("quantity").alias("total_quantity_purchased"),
        F.sum("spend").alias("total_spend_amount"),
        F.count("product_id").alias("total_unique_products_purchased"),
    )


def customer_view(customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders, quantity, spend and unique products per customer, by spend."""
    totals = customer_totals(purchases(lines)).join(order_counts(orders), "customer_id")
    return (
        customers.join(totals, "customer_id")
        .select(
            "customer_id",
            "customer_name",
            F.col("country").alias("customer_country"),
            "total_orders",
            "total_quantity_purchased",
            F.col("total_spend_amount").cast("double").alias("total_spend_amount"),
            "total_unique_products_purchased",
        )
        .orderBy(F.desc("total_spend_amount"), "customer_id")
    )


def region_view(customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The customer view summed per country.

    ``country_total_orders`` counts orders. The source report fills that column
    with the quantity instead; that reading is ``country_total_orders_quirk``.
    """
    totals = customer_totals(purchases(lines)).join(order_counts(orders), "customer_id")
    return (
        customers.select("customer_id", "country")
        .join(totals, "customer_id")
        .groupBy("country")
        .agg(
            F.sum("total_orders").alias("country_total_orders"),
            F.sum("total_quantity_purchased").alias("country_total_orders_quirk"),
            F.sum("total_quantity_purchased").alias("country_total_quantity_purchased"),
            F.sum("total_spend_amount").cast("double").alias("country_total_spend_amount"),
            F.sum("total_unique_products_purchased").alias("country_total_unique_products_purchased"),
        )
        .orderBy(F.desc("country_total_spend_amount"), "country")
    )


def product_view(products: DataFrame, lines: DataFrame, quirk: bool = False) -> DataFrame:
    """Quantity and spend per product still sold.

    ``quirk=True`` merges customers that bought the same quantity for the same
    spend into one before summing, as the source query's grouping does.
    """
    live = products.filter(F.col("discontinued") == 0).select("product_id", "product_name")
    bought = purchases(lines).select("product_id", "quantity", "spend")
    if quirk:
        bought = bought.distinct()
    totals = bought.groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity_purchased"),
        F.sum("spend").cast("double").alias("total_spend_amount"),
    )
    return totals.join(live, "product_id").orderBy(F.desc("total_spend_amount"), "product_id")


def ratings(lines: DataFrame) -> DataFrame:
    """Share of a customer's whole quantity that went to each product.

    The customer's total is summed from the per-product sums, so the lines are
    exchanged once for both.
    """
    per_product = lines.groupBy("customer_id", "product_id").agg(
        F.sum("quantity").alias("total_products_purchased")
    )
    per_customer = per_product.groupBy("customer_id").agg(F.sum("total_products_purchased").alias("total_purchased"))
    return per_product.join(per_customer, "customer_id").withColumn(
        "rating", F.col("total_products_purchased") / F.col("total_purchased")
    )


def order_line_rollup(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Every order line with its customer's order count, the customer's
    quantity of that product and of all products, and the rating.

    The derived tables are aggregated first and joined back on their unique
    keys; a window per customer would pull a hot customer into one task.
    """
    return lines.join(ratings(lines), ["customer_id", "product_id"]).join(order_counts(orders), "customer_id")
