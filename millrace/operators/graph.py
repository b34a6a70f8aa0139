"""Purchase-graph operators: node and edge tables, path aggregates, pair
similarities and recommendations.

A graph is one DataFrame per edge kind; a pattern is a join. ``edges`` below
means the rated edges: customer_id, product_id, category_id, rating, one row
per (customer, product).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.ranking import top_k


def rated_edges(ratings: DataFrame, products: DataFrame) -> DataFrame:
    """Ratings of products that are still sold, with the product's category."""
    live = products.filter(F.col("discontinued") == 0).select("product_id", "category_id")
    return ratings.join(live, "product_id").select("customer_id", "product_id", "category_id", "rating")


def prefixed(prefix: str, column: str) -> Column:
    """A node id such as ``cust_17``."""
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edge_table(lines: DataFrame, orders: DataFrame, products: DataFrame, supplies: DataFrame, rating_counts: DataFrame) -> DataFrame:
    """All structural edges as (edge, src, dst), one row per distinct edge.

    Only products still sold are nodes, so edges to other products drop out.
    """
    live = products.filter(F.col("discontinued") == 0)
    live_lines = lines.join(live.select("product_id"), "product_id", "left_semi")
    line_id = F.concat_ws("_", F.lit("line"), F.col("order_id").cast("string"), F.col("product_id").cast("string"))

    def edge(frame: DataFrame, name: str, keys: tuple[str, ...], src: Column, dst: Column) -> DataFrame:
        # Kinds share no edge, and the keys say which edges are equal: what is hashed are their few bytes, not the names.
        return frame.select(*keys).distinct().select(F.lit(name).alias("edge"), src.alias("src"), dst.alias("dst"))

    parts = [
        edge(live, "part_of", ("product_id", "category_id"), prefixed("prod_", "product_id"), prefixed("ctg_", "category_id")),
        edge(supplies.join(live.select("product_id"), "product_id", "left_semi"), "supplies", ("supplier_id", "product_id"),
             prefixed("suppl_", "supplier_id"), prefixed("prod_", "product_id")),
        edge(orders, "orders", ("customer_id", "order_id"), prefixed("cust_", "customer_id"), prefixed("ord_", "order_id")),
        edge(lines, "comprised_of", ("order_id", "product_id"), prefixed("ord_", "order_id"), line_id),
        edge(live_lines, "contains", ("order_id", "product_id"), line_id, prefixed("prod_", "product_id")),
        edge(rating_counts, "has_number_of", ("product_id",), prefixed("prod_", "product_id"),
             F.concat(F.lit("rating_"), F.col("product_id").cast("string"))),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def graph_counts(nodes: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """Rows per node label and per edge kind; each part is one small aggregate."""
    table = edges.groupBy(F.lit("relationship").alias("kind"), F.col("edge").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    for label, frame in nodes.items():
        table = table.unionByName(
            frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.lit(label).alias("label"), "n")
        )
    return table


def purchase_paths(lines: DataFrame, products: DataFrame) -> DataFrame:
    """customer -> order -> line -> product -> category, as one row per line."""
    live = products.filter(F.col("discontinued") == 0)
    return lines.join(live.select("product_id", "product_name", "category_id"), "product_id")


def quantity_by_customer(paths: DataFrame, customers: DataFrame, category: str | None = None) -> DataFrame:
    if category is not None:
        paths = paths.filter(F.col("category_id") == category)
    return (
        paths.groupBy("customer_id")
        .agg(F.sum("quantity").alias("total_qty_purchased"))
        .join(customers.select("customer_id", "customer_name"), "customer_id")
        .orderBy(F.desc("total_qty_purchased"), "customer_id")
    )


def quantity_by_customer_product(paths: DataFrame, category: str | None = None) -> DataFrame:
    """Order lines and quantity per (customer, category, product)."""
    if category is not None:
        paths = paths.filter(F.col("category_id") == category)
    return (
        paths.groupBy("customer_id", "category_id", "product_id")
        .agg(F.count("order_id").alias("total_orders"), F.sum("quantity").alias("total_prod_qty_purchased"))
        .orderBy(F.desc("total_prod_qty_purchased"), "customer_id", "product_id")
    )


# --- one customer beside the others ---------------------------------------------


def co_rating_pairs(edges: DataFrame, customer) -> DataFrame:
    """One row per product that ``customer`` and another customer both rated:
    customer_1 (the given one), customer_2, product_id, rating_1, rating_2.

    Only the products of the one customer are followed, so the work is linear
    in the raters of these products.
    """
    mine = edges.filter(F.col("customer_id") == customer).select(
        F.col("customer_id").alias("customer_1"), "product_id", F.col("rating").alias("rating_1")
    )
    others = edges.filter(F.col("customer_id") != customer).select(
        F.col("customer_id").alias("customer_2"), "product_id", F.col("rating").alias("rating_2")
    )
    return mine.join(others, "product_id").select("customer_1", "customer_2", "product_id", "rating_1", "rating_2")


def rating_differences(edges: DataFrame, customer, category=None) -> DataFrame:
    """Absolute rating gap of one customer and every other one over the
    products they share, in one category or in all."""
    pairs = co_rating_pairs(edges if category is None else edges.filter(F.col("category_id") == category), customer)
    return pairs.withColumn("rating_difference", F.abs(F.col("rating_1") - F.col("rating_2")))


def rating_gaps_to_mean(edges: DataFrame, product) -> DataFrame:
    """Every rating of one product beside the mean of all of them."""
    rated = edges.filter(F.col("product_id") == product).select("customer_id", "product_id", "rating")
    mean = rated.groupBy("product_id").agg(F.round(F.avg("rating"), 9).alias("mean_rating"))
    return rated.join(mean, "product_id").select(
        "customer_id", "product_id", "rating", "mean_rating", F.round(F.abs(F.col("rating") - F.col("mean_rating")), 9).alias("rating_difference")
    )


def close_high_raters(edges: DataFrame, customer, min_rating: float, max_gap: float, min_gap: float | None = None, quirk: bool = False) -> DataFrame:
    """Customers that rated a product as ``customer`` did: both above
    ``min_rating``, with a gap below ``max_gap`` (and above ``min_gap`` if given).

    Default: the gap is absolute. ``quirk=True`` leaves the absolute value out,
    so any negative gap passes.
    """
    pairs = co_rating_pairs(edges.filter(F.col("rating") > min_rating), customer)
    if quirk:
        return pairs.filter(F.col("rating_1") - F.col("rating_2") < max_gap)
    gap = F.abs(F.col("rating_1") - F.col("rating_2"))
    kept = pairs.filter(gap < max_gap)
    return kept if min_gap is None else kept.filter(gap > min_gap)


def first_product_per_pair(pairs: DataFrame) -> DataFrame:
    """One row per customer pair: the product with the widest gap comes first."""
    return top_k(
        pairs.withColumn("_gap", F.abs(F.col("rating_1") - F.col("rating_2"))),
        ["customer_1", "customer_2"],
        [F.desc("_gap"), F.col("product_id")],
        1,
        "_first",
    ).drop("_first", "_gap")


def cosine_similarity(edges: DataFrame, customer) -> DataFrame:
    """Cosine of one customer's ratings and every other one's over the products both rated."""
    return (
        co_rating_pairs(edges, customer)
        .groupBy("customer_1", "customer_2")
        .agg(
            F.count(F.lit(1)).alias("n_shared"),
            F.sum(F.col("rating_1") * F.col("rating_2")).alias("_dot"),
            F.sum(F.col("rating_1") * F.col("rating_1")).alias("_n1"),
            F.sum(F.col("rating_2") * F.col("rating_2")).alias("_n2"),
        )
        .select(
            "customer_1",
            "customer_2",
            "n_shared",
            F.round(F.col("_dot") / (F.sqrt("_n1") * F.sqrt("_n2")), 6).alias("similarity"),
        )
    )


def nearest_customers(similarity: DataFrame, neighbours: int) -> DataFrame:
    """The k most similar customers (ties by id)."""
    named = similarity.select(F.col("customer_1").alias("customer_id"), F.col("customer_2").alias("neighbour_id"), "similarity")
    return top_k(named, ["customer_id"], [F.desc("similarity"), F.col("neighbour_id")], neighbours)


def collaborative_filter(edges: DataFrame, customer, neighbours: int, low: float, high: float) -> DataFrame:
    """Mean rating by the customer's nearest customers of the products this
    customer has not bought, kept when it lies between ``low`` and ``high``."""
    near = nearest_customers(cosine_similarity(edges, customer), neighbours).select("customer_id", "neighbour_id")
    theirs = edges.select(F.col("customer_id").alias("neighbour_id"), "product_id", "rating")
    owned = edges.filter(F.col("customer_id") == customer).select("product_id")
    return (
        near.join(theirs, "neighbour_id")
        .join(owned, "product_id", "left_anti")
        .groupBy("customer_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n_neighbours"), F.round(F.avg("rating"), 9).alias("recommendation"))
        .filter((F.col("recommendation") > low) & (F.col("recommendation") < high))
    )


# --- recommendations -----------------------------------------------------------


def co_buyer_candidates(edges: DataFrame, customer) -> DataFrame:
    """Products of a category that other buyers of the customer's products in
    that category also bought and the customer did not: customer_id,
    category_id, product_id, n_paths (customer -> product <- other -> product).

    The customer's products lead to their buyers, counted per category, and
    those to what they bought there: linear in the baskets that are met.
    """
    slim = edges.select("customer_id", "category_id", "product_id")
    mine = slim.filter(F.col("customer_id") == customer)
    others = slim.filter(F.col("customer_id") != customer)
    shared = (
        others.join(mine.select("product_id"), "product_id", "left_semi")
        .groupBy("customer_id", "category_id").agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        others.join(mine.select("product_id"), "product_id", "left_anti")
        .join(shared, ["customer_id", "category_id"])
        .groupBy("category_id", "product_id")
        .agg(F.sum("_n").alias("n_paths"))
        .select(F.lit(customer).cast(edges.schema["customer_id"].dataType).alias("customer_id"), "category_id", "product_id", "n_paths")
    )


def unbought_in_category(edges: DataFrame, products: DataFrame, customer) -> DataFrame:
    """Products of the categories the customer buys from that the customer has
    not bought; n_paths counts the customer's products in the category (each
    leads to every such product)."""
    mine = edges.filter(F.col("customer_id") == customer)
    interest = mine.groupBy("customer_id", "category_id").agg(F.count(F.lit(1)).alias("n_paths"))
    live = products.filter(F.col("discontinued") == 0).select("product_id", "category_id")
    return (
        live.join(interest, "category_id").join(mine.select("product_id"), "product_id", "left_anti")
        .select("customer_id", "category_id", "product_id", "n_paths")
    )


def recommendation_lists(candidates: DataFrame) -> DataFrame:
    """The candidates of one customer as a sorted list per category, in which a product stands once per path."""
    lists = candidates.groupBy("customer_id", "category_id").agg(F.sort_array(F.collect_list(F.struct("product_id", "n_paths"))).alias("_items"))
    items = F.flatten(F.transform("_items", lambda x: F.array_repeat(x["product_id"], x["n_paths"].cast("int"))))
    return lists.select("customer_id", "category_id", items.alias("recommended_products"))


def also_bought(edges: DataFrame, product, more_than: int = 0) -> DataFrame:
    """How many buyers of ``product`` bought each other product.

    Only the buyers of the one product are followed, so the work is linear.
    """
    buyers = edges.filter(F.col("product_id") == product).select("customer_id")
    return (
        edges.filter(F.col("product_id") != product)
        .join(buyers, "customer_id", "left_semi")
        .groupBy(F.col("product_id").alias("recommendation"))
        .agg(F.count(F.lit(1)).alias("customers_also_bought_n_times"))
        .filter(F.col("customers_also_bought_n_times") > more_than)
        .select(F.lit(product).cast("long").alias("original_product"), "recommendation", "customers_also_bought_n_times")
    )


def rating_counts(edges: DataFrame) -> DataFrame:
    """Ratings per product, with its category."""
    return edges.groupBy("category_id", "product_id").agg(F.count(F.lit(1)).alias("rating_count"))


def better_rated_unbought(edges: DataFrame, customer, category=None) -> DataFrame:
    """Products of a category with more ratings than some product the customer
    bought there, and which the customer has not bought: customer_id,
    category_id, floor, product_id, rating_count.

    "More than some bought product" is "more than the least rated bought
    product", so one minimum per category replaces the pairs.
    """
    mine = edges.filter(F.col("customer_id") == customer)
    if category is not None:
        mine = mine.filter(F.col("category_id") == category)
    counts = rating_counts(edges.join(mine.select("category_id").distinct(), "category_id", "left_semi"))
    floor = (
        mine.join(counts, ["category_id", "product_id"])
        .groupBy("customer_id", "category_id")
        .agg(F.min("rating_count").alias("floor"))
    )
    return (
        counts.join(floor, "category_id").filter(F.col("rating_count") > F.col("floor"))
        .join(mine.select("product_id"), "product_id", "left_anti")
        .select("customer_id", "category_id", "floor", "product_id", "rating_count")
    )
