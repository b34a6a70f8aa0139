from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.operators import graph, retail


def rated(spark):
    """One product all customers rated, next to small ones."""
    rows = [(c, 0, "A", 0.1 + c / 100) for c in range(12)]
    rows += [(c, 1 + (c * 5 + j) % 7, "A" if (c * 5 + j) % 7 < 3 else "B", 0.05 * (j + 1)) for c in range(12) for j in range(3)]
    rows = list({(c, p): (c, p, k, r) for c, p, k, r in rows}.values())
    return rows, spark.createDataFrame(rows, "customer_id long, product_id long, category_id string, rating double").repartition(5)


def brute_pairs(rows, me):
    mine = {p: r for c, p, _, r in rows if c == me}
    return sorted((me, c, p, mine[p], r) for c, p, _, r in rows if c != me and p in mine)


def test_pairs_of_every_customer(spark):
    rows, df = rated(spark)
    for me in (0, 5, 11):
        assert sorted(tuple(r) for r in graph.co_rating_pairs(df, me).collect()) == brute_pairs(rows, me)


def test_close_raters_with_and_without_absolute_gap(spark):
    rows, df = rated(spark)
    good = [(a, b, p, x, y) for a, b, p, x, y in brute_pairs(rows, 4) if x > 0.12 and y > 0.12]
    assert good
    want = sorted((a, b, p) for a, b, p, x, y in good if abs(x - y) < 0.03)
    assert sorted((r[0], r[1], r[2]) for r in graph.close_high_raters(df, 4, 0.12, 0.03).collect()) == want
    ordered = [(a, b, p) for a, b, p, x, y in good if x - y < 0.03]
    assert sorted((r[0], r[1], r[2]) for r in graph.close_high_raters(df, 4, 0.12, 0.03, quirk=True).collect()) == sorted(ordered)


def test_recommendations_of_one_customer(spark):
    rows, df = rated(spark)
    bought, category = defaultdict(set), {}
    for c, p, k, _ in rows:
        bought[c].add(p)
        category[p] = k
    raters = Counter(p for _, p, _, _ in rows)
    for me in (0, 3, 11):
        paths, better = Counter(), {}
        for p in bought[me]:
            for other in bought:
                if other != me and p in bought[other]:
                    for q in bought[other] - bought[me]:
                        if category[q] == category[p]:
                            paths[q] += 1
        assert {r.product_id: r.n_paths for r in graph.co_buyer_candidates(df, me).collect()} == dict(paths)
        for kind in {category[p] for p in bought[me]}:
            floor = min(raters[p] for p in bought[me] if category[p] == kind)
            better |= {q: floor for q in category if category[q] == kind and q not in bought[me] and raters[q] > floor}
        assert {r.product_id: r.floor for r in graph.better_rated_unbought(df, me).collect()} == better


def test_unbought_products_of_one_customer(spark):
    rows, df = rated(spark)
    products = spark.createDataFrame([(p, "A" if p < 3 else "B", int(p == 30)) for p in range(40)], "product_id long, category_id string, discontinued int")
    edges = df.drop("category_id").join(products.select("product_id", "category_id"), "product_id")
    kinds = {"A" if p < 3 else "B" for c, p, _, _ in rows if c == 2}
    want = {p for p in range(40) if p != 30 and ("A" if p < 3 else "B") in kinds} - {p for c, p, _, _ in rows if c == 2}
    assert {r.product_id for r in graph.unbought_in_category(edges, products, 2).collect()} == want


def test_also_bought_counts_buyers(spark):
    rows, df = rated(spark)
    buyers = {c for c, p, _, _ in rows if p == 1}
    want = Counter(p for c, p, _, _ in rows if c in buyers and p != 1)
    got = {r.recommendation: r.customers_also_bought_n_times for r in graph.also_bought(df, 1).collect()}
    assert got == dict(want)


def sales(spark):
    rows = [(1, 10, 100, 2, "5.00", "0.50"), (2, 11, 100, 2, "5.00", "0.50"), (2, 11, 101, 1, "7.00", "0.00"), (3, 10, 101, 4, "7.00", "1.00")]
    return spark.createDataFrame(rows, "order_id long, customer_id long, product_id long, quantity long, p string, d string").select(
        "order_id", "customer_id", "product_id", "quantity",
        F.col("p").cast("decimal(12,2)").alias("unit_price"), F.col("d").cast("decimal(6,2)").alias("discount"))


def test_discount_is_an_amount_and_equal_customers_collapse_in_the_quirk(spark):
    products = spark.createDataFrame([(100, "a", "c", 0), (101, "b", "c", 0), (102, "old", "c", 1)], "product_id long, product_name string, category_id string, discontinued int")
    right = {r.product_id: (r.total_quantity_purchased, r.total_spend_amount) for r in retail.product_view(products, sales(spark)).collect()}
    quirk = {r.product_id: (r.total_quantity_purchased, r.total_spend_amount) for r in retail.product_view(products, sales(spark), quirk=True).collect()}
    assert right == {100: (4, 18.0), 101: (5, 31.0)}
    assert quirk == {100: (2, 9.0), 101: (5, 31.0)}


def test_ratings_sum_to_one(spark):
    totals = retail.ratings(sales(spark)).groupBy("customer_id").agg(F.sum("rating").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in totals)


def test_edges_are_told_apart_by_their_keys_before_they_are_named(spark):
    lines = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8)], "order_id long, product_id long")
    orders = spark.createDataFrame([(1, 5), (2, 5), (2, 5)], "order_id long, customer_id long")
    products = spark.createDataFrame([(7, "a", 0), (8, "b", 1)], "product_id long, category_id string, discontinued int")
    supplies = spark.createDataFrame([(3, 7), (3, 7), (3, 8)], "supplier_id long, product_id long")
    table = graph.edge_table(lines, orders, products, supplies, spark.createDataFrame([(7,)], "product_id long"))
    assert sorted(map(tuple, table.collect())) == [
        ("comprised_of", "ord_1", "line_1_7"), ("comprised_of", "ord_2", "line_2_7"), ("comprised_of", "ord_2", "line_2_8"),
        ("contains", "line_1_7", "prod_7"), ("contains", "line_2_7", "prod_7"), ("has_number_of", "prod_7", "rating_7"),
        ("orders", "cust_5", "ord_1"), ("orders", "cust_5", "ord_2"), ("part_of", "prod_7", "ctg_a"), ("supplies", "suppl_3", "prod_7")]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [order_id" in plan and "Aggregate [edge" not in plan
