import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.operators import ranking as rk


def skewed(spark, n=900):
    """A third of all rows in one group, the rest spread thin, one null group."""
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"g{i % 40}"), (i * 7919) % 101) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, v int").repartition(7)


def test_hash_rank_is_the_exact_md5_order(spark):
    rows, df = skewed(spark)
    got = {r.id: (r.place, r.n) for r in rk.hash_rank(df, ["g"], "id", "s", "place", "n").collect()}
    groups = defaultdict(list)
    for i, g, _ in rows:
        groups[g].append((hashlib.md5(f"{i}:s".encode()).hexdigest(), i))
    for members in groups.values():
        for place, (_, i) in enumerate(sorted(members), 1):
            assert got[i] == (place, len(members))
    assert len(got) == len(rows)


def test_hash_rank_spreads_a_hot_group_over_many_keys(spark):
    _, df = skewed(spark)
    hot = df.filter("g = 'hot'").withColumn("b", F.substring(rk.hash_order("id", "s"), 1, 3))
    assert hot.groupBy("b").count().agg(F.max("count")).first()[0] <= 5


def test_rank_in_order_with_a_hot_group_over_several_partitions(spark):
    rows, df = skewed(spark)
    got = {r.id: r["rank"] for r in rk.rank_in_order(df, ["g"], [F.desc("v"), F.col("id")]).collect()}
    groups = defaultdict(list)
    for i, g, v in rows:
        groups[g].append((-v, i))
    want = {i: place for members in groups.values() for place, (_, i) in enumerate(sorted(members), 1)}
    assert got == want


def test_running_total_over_all_rows(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(500)], "id long, w long").repartition(9)
    got = {r.id: r.running for r in rk.running_total(df, [], [F.col("id")], "w").collect()}
    total = 0
    for i in range(500):
        total += i % 5
        assert got[i] == total


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "v int")
    got = sorted(((r.v, r["rank"], r.n) for r in rk.average_rank(df, "v", ties="n").collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert got == [(1, 1.0, 1), (2, 2.5, 2), (2, 2.5, 2), (5, 4.0, 1), (None, None, None)]


def test_top_k_cuts_groups_before_the_exchange(spark):
    _, df = skewed(spark)
    plan = rk.top_k(df, ["g"], [F.col("v"), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan[plan.index("Exchange hashpartitioning(g"):]
    assert "WindowGroupLimit" in before_exchange and "Partial" in before_exchange


def test_first_by_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, p string")
    assert sorted(tuple(r) for r in rk.first_by(df, ["k"], [F.col("o")]).collect()) == [("a", 1, "y"), ("b", 3, None)]
