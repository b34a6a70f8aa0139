"""Statistics and regressions: M1-M6, M10-M16, M18."""

from pyspark.sql import functions as F

from millrace.operators import regression as rg
from millrace.operators import sampling
from millrace.operators import statistics as st
from millrace.plans.registry import query


@query("M1_standardised_population", """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer""")
def _(t):
    scaled, _stats = rg.standardised(t.customer.select("c_custkey", F.col("c_acctbal").alias("z")), ["z"], 0)
    return scaled.select("c_custkey", F.round("z", 6).alias("z"))


@query("M1_standardised_sample", """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer""")
def _(t):
    scaled, _stats = rg.standardised(t.customer.select("c_custkey", F.col("c_acctbal").alias("z")), ["z"], 1)
    return scaled.select("c_custkey", F.round("z", 6).alias("z"))


@query("M2_linear_descent", """
WITH RECURSIVE s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, avg(l_quantity * l_quantity) AS xx, avg(l_quantity * l_extendedprice) AS xy FROM lineitem),
gd(i, w, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, w + 0.0005::DOUBLE * 2 * (xy - w * xx - b * mx), b + 0.0005::DOUBLE * 2 * (my - w * mx - b) FROM gd, s WHERE i < 1000)
SELECT 'intercept' AS term, round(b, 4) AS estimate FROM gd WHERE i = 1000 UNION ALL SELECT 'l_quantity', round(w, 4) FROM gd WHERE i = 1000""")
def _(t):
    return rg.coefficient_frame(t.spark, rg.linear_descent(t.lineitem, "l_quantity", "l_extendedprice", 0.0005, 1000), 4)


@query("M2_linear_closed_form", """
SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def _(t):
    return rg.coefficient_frame(t.spark, rg.ridge(t.lineitem, ["l_quantity"], "l_extendedprice", 0.0), 4)


STANDARD = """z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x,
  (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS y FROM lineitem),
s AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(x * y) AS xy FROM z)"""


def standard_pair(t):
    pair = t.lineitem.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rg.standardised(pair, ["x", "y"], 0)[0]


for _name, _sign in (("M3_lasso_descent", "-"), ("M3_lasso_descent_quirk", "+")):
    @query(_name, f"""
WITH RECURSIVE {STANDARD}, gd(i, w, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, w + 0.01::DOUBLE * (2 * (xy - w * xx - b * mx) {_sign} 2 / n * 50.0::DOUBLE * CASE WHEN w > 0 THEN 1 ELSE -1 END), b + 0.01::DOUBLE * 2 * (my - w * mx - b) FROM gd, s WHERE i < 10000)
SELECT 'intercept' AS term, round(b, 6) + 0.0 AS estimate FROM gd WHERE i = 10000 UNION ALL SELECT 'x', round(w, 6) FROM gd WHERE i = 10000""")
    def _(t, quirk=_name.endswith("quirk")):
        fitted = rg.lasso_descent(standard_pair(t), ["x"], "y", 0.01, 10000, 50.0, quirk)
        return rg.coefficient_frame(t.spark, fitted).withColumn("estimate", F.col("estimate") + F.lit(0.0))


TEAMS = """teams AS (SELECT c_custkey, c_acctbal AS balance, n_orders, spent FROM customer JOIN (
  SELECT o_custkey, count(*)::DOUBLE AS n_orders, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS spent FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey),
scaled AS (SELECT c_custkey, (balance - avg(balance) OVER ()) / stddev_samp(balance) OVER () AS a, (n_orders - avg(n_orders) OVER ()) / stddev_samp(n_orders) OVER () AS b, spent AS y FROM teams),
c AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, count(*) * var_pop(a) + 2 AS aa, count(*) * var_pop(b) + 2 AS bb,
  count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS bty FROM scaled),
r AS (SELECT my - ma * wa - mb * wb AS w0, wa, wb FROM (SELECT my, ma, mb, (ay * bb - bty * ab) / (aa * bb - ab * ab) AS wa, (bty * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM c))"""


def teams(t):
    spent = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("b"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("y")
    )
    joined = t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("c_acctbal").alias("a"), "b", "y")
    return rg.standardised(joined, ["a", "b"], 1)[0]


@query("M4_ridge_closed_form", f"""
WITH {TEAMS} SELECT 'intercept' AS term, round(w0, 3) AS estimate FROM r UNION ALL SELECT 'a', round(wa, 3) FROM r UNION ALL SELECT 'b', round(wb, 3) FROM r""")
def _(t):
    return rg.coefficient_frame(t.spark, rg.ridge(teams(t), ["a", "b"], "y", 2.0), 3)


@query("M4_ridge_predict", f"WITH {TEAMS} SELECT c_custkey, round(w0 + wa * a + wb * b, 3) AS predicted FROM scaled, r")
def _(t):
    frame = teams(t)
    return frame.select("c_custkey", F.round(rg.prediction(rg.ridge(frame, ["a", "b"], "y", 2.0)), 3).alias("predicted"))


@query("M5_ridge_descent", f"""
WITH {TEAMS} SELECT 'intercept' AS term, round(w0, 3) AS estimate FROM r UNION ALL SELECT 'a', round(wa, 3) FROM r UNION ALL SELECT 'b', round(wb, 3) FROM r""")
def _(t):
    return rg.coefficient_frame(t.spark, rg.ridge_descent(teams(t), ["a", "b"], "y", 0.2, 5000, 2.0), 3)


def newton_sql(steps: int) -> str:
    """Newton steps for one regressor as a chain of aggregates."""
    parts = ["pts AS (SELECT (l_quantity - 25) / 10 AS x, CASE WHEN l_extendedprice > 40000 THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM lineitem)",
             "w0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS w)"]
    for i in range(1, steps + 1):
        parts.append(f"""g{i} AS (SELECT any_value(b) AS b, any_value(w) AS w, sum(p - y) AS gb, sum((p - y) * x) AS gw, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) AS h2
  FROM (SELECT x, y, b, w, 1 / (1 + exp(-(b + w * x))) AS p FROM pts, w{i - 1}))""")
        parts.append(f"w{i} AS (SELECT b - (gb * h2 - gw * h1) / (h0 * h2 - h1 * h1) AS b, w - (gw * h0 - gb * h1) / (h0 * h2 - h1 * h1) AS w FROM g{i})")
    return "WITH " + ", ".join(parts)


def points(t):
    return t.lineitem.select(((F.col("l_quantity") - 25) / 10).alias("x"), F.when(F.col("l_extendedprice") > 40000, 1.0).otherwise(0.0).alias("y"))


@query("M6_logistic_newton", newton_sql(8) + " SELECT 'intercept' AS term, round(b, 6) AS estimate FROM w8 UNION ALL SELECT 'x', round(w, 6) FROM w8")
def _(t):
    return rg.coefficient_frame(t.spark, rg.logistic_newton(points(t), ["x"], "y")[0])


ALPHA, STEPS = 1e-6, 10_000
# A fold over the steps: intercept and slope, moved by the gradient over the cells of equal x.
DESCENT = f"""
WITH cells AS (
  SELECT (l_quantity - 25) / 10 AS x, count(*)::DOUBLE AS n, sum(CASE WHEN l_extendedprice > 40000 THEN 1.0::DOUBLE ELSE 0.0 END) AS s FROM lineitem GROUP BY 1),
packed AS (SELECT list({{'x': x, 'n': n, 's': s}} ORDER BY x) AS c FROM cells),
gd AS (SELECT list_reduce(list_transform(range(0, {STEPS + 1}), lambda i: [0.0::DOUBLE, 0.0::DOUBLE]), lambda a, i:
  list_transform([0.0::DOUBLE, 1.0::DOUBLE], lambda k: CASE WHEN k = 0 THEN a[1] ELSE a[2] END
    - {ALPHA}::DOUBLE * list_sum(list_transform(c, lambda z: (z.n / (1 + exp(-(a[1] + a[2] * z.x))) - z.s) * CASE WHEN k = 0 THEN 1 ELSE z.x END)))) AS g FROM packed)"""


@query("M6_logistic_descent", DESCENT + " SELECT 'intercept' AS term, round(g[1], 6) AS estimate FROM gd UNION ALL SELECT 'x', round(g[2], 6) FROM gd")
def _(t):
    return rg.coefficient_frame(t.spark, rg.logistic_descent(points(t), ["x"], "y", ALPHA, STEPS)[0], 6)


# --- least squares with factors


CARS = """cars AS (SELECT ln(o_totalprice) AS price, year(o_orderdate)::DOUBLE AS age, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS f FROM orders)"""


def cars(t):
    return t.orders.select(F.log("o_totalprice").alias("price"), F.year("o_orderdate").cast("double").alias("age"), "o_orderstatus", "o_orderpriority",
                           F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("f"))


HC1_ONE = """m AS (SELECT count(*)::DOUBLE AS n, regr_slope(price, age) AS b1, regr_intercept(price, age) AS b0, avg(age) AS mx, regr_sxx(price, age) AS sxx FROM cars),
v AS (SELECT any_value(n) AS n, any_value(b1) AS b1, any_value(b0) AS b0,
  any_value(n) / (any_value(n) - 2) * sum(e * e * (age - mx) * (age - mx)) / (any_value(sxx) * any_value(sxx)) AS v1,
  any_value(n) / (any_value(n) - 2) * sum(e * e * pow(1 / n - mx * (age - mx) / sxx, 2)) AS v0
  FROM (SELECT *, price - b0 - b1 * age AS e FROM cars, m))"""


@query("M10_base_model_hc1", f"""
WITH {CARS}, {HC1_ONE} SELECT 'base' AS model, 'intercept' AS term, round(b0, 6) AS estimate, round(sqrt(v0), 6) AS std_error, round(b0 / sqrt(v0), 4) AS t_value FROM v
UNION ALL SELECT 'base', 'age', round(b1, 6), round(sqrt(v1), 6), round(b1 / sqrt(v1), 4) FROM v""")
def _(t):
    return rg.nested_models(cars(t), "price", [("base", {"age": F.col("age")})], "HC1")


FACTOR_MEANS = """cells AS (SELECT o_orderpriority AS p, count(*)::DOUBLE AS n, avg(ln(o_totalprice)) AS m, var_pop(ln(o_totalprice)) * count(*) AS ss FROM orders GROUP BY 1),
base AS (SELECT * FROM cells WHERE p = '3-MEDIUM')"""


@query("M10_factor_model", f"""
WITH {FACTOR_MEANS} SELECT 'intercept' AS term, round(m, 6) AS estimate FROM base
UNION ALL SELECT 'o_orderpriority[' || c.p || ']', round(c.m - b.m, 6) FROM cells c, base b WHERE c.p <> '3-MEDIUM'""")
def _(t):
    frame = cars(t)
    fit = rg.least_squares(frame, rg.dummies("o_orderpriority", rg.levels_of(frame, "o_orderpriority", "3-MEDIUM")), "price")
    return rg.coefficient_frame(t.spark, dict(zip(fit.terms, fit.estimate)))


@query("M10_nested_models")
def _(t):
    """Five models, each with more terms, as the used-car study fits them."""
    frame = cars(t)
    steps = [
        ("base", {"age": F.col("age")}),
        ("level_1", {"f": F.col("f")}),
        ("level_2", rg.dummies("o_orderpriority", rg.levels_of(frame, "o_orderpriority", "3-MEDIUM"))),
        ("level_3", {"age_by_f": F.col("age") * F.col("f")}),
        ("level_4", {"age_squared": (F.col("age") - 1998) * (F.col("age") - 1998)}),
    ]
    return rg.nested_models(frame, "price", steps, "HC1")


@query("M10_collinear_models", f"""
WITH {CARS}, {HC1_ONE}, terms AS (SELECT 'intercept' AS term, round(b0, 6) AS estimate, round(sqrt(v0), 6) AS std_error, round(b0 / sqrt(v0), 4) AS t_value FROM v
  UNION ALL SELECT 'age', round(b1, 6), round(sqrt(v1), 6), round(b1 / sqrt(v1), 4) FROM v)
SELECT model, term, estimate, std_error, t_value FROM terms, (VALUES ('base'), ('repeated')) m(model)
UNION ALL SELECT 'repeated', unnest(['age_twice', 'never']), NULL, NULL, NULL""")
def _(t):
    """A step that repeats a term and adds a level nobody has: both come out null, the rest as before."""
    steps = [("base", {"age": F.col("age")}), ("repeated", {"age_twice": F.col("age") * 2 - 3, "never": F.lit(0.0)})]
    return rg.nested_models(cars(t), "price", steps, "HC1")


TWO = """cells AS (SELECT g, m, count(*)::DOUBLE AS n, avg(y) AS mean, var_pop(y) * count(*) / ((count(*) - 1) * (count(*) - 1)) AS v FROM (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS g, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS m, l_quantity AS y FROM lineitem) GROUP BY g, m),
k AS (SELECT max(mean) FILTER (WHERE g = 0 AND m = 0) AS a, max(mean) FILTER (WHERE g = 1 AND m = 0) AS b, max(mean) FILTER (WHERE g = 0 AND m = 1) AS c, max(mean) FILTER (WHERE g = 1 AND m = 1) AS d,
  max(v) FILTER (WHERE g = 0 AND m = 0) AS va, max(v) FILTER (WHERE g = 1 AND m = 0) AS vb, max(v) FILTER (WHERE g = 0 AND m = 1) AS vc, max(v) FILTER (WHERE g = 1 AND m = 1) AS vd FROM cells),
f AS (SELECT 'intercept' AS term, a AS est, sqrt(va) AS se FROM k UNION ALL SELECT 'group', b - a, sqrt(va + vb) FROM k
  UNION ALL SELECT 'timing', c - a, sqrt(va + vc) FROM k UNION ALL SELECT 'group:timing', d - c - b + a, sqrt(va + vb + vc + vd) FROM k)"""


def experiment(t):
    return t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("group"),
        F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0).alias("timing"), F.col("l_quantity").alias("y"),
    )


def interaction_terms():
    return {"group": F.col("group"), "timing": F.col("timing"), "group:timing": F.col("group") * F.col("timing")}


@query("M11_hc3_errors", f"WITH {TWO} SELECT term, round(se, 6) AS std_error FROM f")
def _(t):
    frame, terms = experiment(t), interaction_terms()
    fit = rg.least_squares(frame, terms, "y")
    return rg.fit_frame(t.spark, "interaction", fit, rg.robust_covariance(frame, terms, "y", fit, "HC3")).select("term", "std_error")


@query("M12_interaction_model", f"WITH {TWO} SELECT term, round(est, 6) AS estimate FROM f")
def _(t):
    fit = rg.least_squares(experiment(t), interaction_terms(), "y")
    return rg.coefficient_frame(t.spark, dict(zip(fit.terms, fit.estimate)))


@query("M18_models_side_by_side", f"""
WITH {TWO}, one AS (SELECT g, count(*)::DOUBLE AS n, avg(y) AS mean, var_pop(y) * count(*) / ((count(*) - 1) * (count(*) - 1)) AS v
  FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS g, l_quantity AS y FROM lineitem) GROUP BY g),
s AS (SELECT 'intercept' AS term, mean AS est, sqrt(v) AS se FROM one WHERE g = 0 UNION ALL
  SELECT 'group', x.mean - y.mean, sqrt(x.v + y.v) FROM one x, one y WHERE x.g = 1 AND y.g = 0)
SELECT f.term, round(s.est, 6) AS design_estimate, round(s.se, 6) AS design_std_error, round(f.est, 6) AS interaction_estimate, round(f.se, 6) AS interaction_std_error FROM f LEFT JOIN s USING (term)""")
def _(t):
    steps = [("design", {"group": F.col("group")}), ("interaction", {k: v for k, v in interaction_terms().items() if k != "group"})]
    return rg.side_by_side(rg.nested_models(experiment(t), "y", steps, "HC3"), ["design", "interaction"])


# --- tests


RANKED = """r AS (SELECT o_orderstatus, strength, rank() OVER (ORDER BY strength) + (count(*) OVER (PARTITION BY strength) - 1) / 2 AS rk,
  count(*) OVER (PARTITION BY strength) AS ties FROM (SELECT o_orderstatus, substr(o_orderpriority, 1, 1)::INTEGER AS strength FROM orders WHERE o_orderstatus IN ('F', 'O'))),
s AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE AS b, sum(rk) FILTER (WHERE o_orderstatus = 'F') AS ra,
  sum((ties * ties * ties - ties) / ties) AS tie FROM r),
w AS (SELECT a, b, ra - a * (a + 1) / 2 AS w, sqrt(a * b / 12 * (a + b + 1 - tie / ((a + b) * (a + b - 1)))) AS sigma FROM s)"""


def answers(t):
    return t.orders.select("o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("strength"), "o_totalprice",
                           F.floor(F.col("o_totalprice") / 100).alias("hundreds"))


@query("M13_rank_sum_test", f"""
WITH {RANKED} SELECT a AS n_first, b AS n_second, round(w, 1) AS w, round((w - a * b / 2 - sign(w - a * b / 2) * 0.5) / sigma, 6) AS z FROM w""")
def _(t):
    return st.rank_sum(answers(t), "o_orderstatus", "strength", "F", "O").drop("p_value")


# The normal tail as 1 - erf, with erf by its series of positive terms; SQL has no error function.
NORMAL_TAIL = """t AS (SELECT a, b, w, round((w - a * b / 2 - sign(w - a * b / 2) * 0.5) / sigma, 6) AS z FROM w),
x AS (SELECT greatest(abs(z) / sqrt(2), 1e-12) AS x FROM t),
k AS (SELECT n, coalesce(sum(ln(2 * n + 1)) OVER (ORDER BY n), 0) AS lf FROM (SELECT unnest(range(0, 400)) AS n)),
tail AS (SELECT 1 - 2 / sqrt(pi()) * sum(exp(ln(x) - x * x + n * ln(2 * x * x) - lf)) AS p FROM x, k)"""


@query("M13_rank_sum_p_value", f"""
WITH {RANKED}, {NORMAL_TAIL} SELECT a AS n_first, b AS n_second, round(w, 1) AS w, z, abs(round(p, 6)) AS p_value FROM t, tail""")
def _(t):
    return st.rank_sum(answers(t), "o_orderstatus", "strength", "F", "O").withColumn("p_value", F.round("p_value", 6))


def shift_sql(value: str) -> str:
    return f"""
WITH c AS (SELECT {value} AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS n1, count(*) FILTER (WHERE o_orderstatus = 'O') AS n2 FROM orders GROUP BY 1),
d AS (SELECT x.v - y.v AS diff, sum(x.n1 * y.n2)::DOUBLE AS n FROM c x, c y WHERE x.n1 > 0 AND y.n2 > 0 GROUP BY 1), cum AS (SELECT diff, sum(n) OVER (ORDER BY diff) AS cum FROM d),
s AS (SELECT sum(n1)::DOUBLE * sum(n2)::DOUBLE AS pairs, 1.959963984540054 * sqrt(sum(n1)::DOUBLE * sum(n2)::DOUBLE * (sum(n1)::DOUBLE + sum(n2)::DOUBLE + 1) / 12) AS half FROM c)
SELECT (min(diff) FILTER (WHERE cum >= ceil(pairs / 2)) + min(diff) FILTER (WHERE cum >= floor(pairs / 2) + 1)) / 2 AS shift,
  min(diff) FILTER (WHERE cum >= greatest(1, floor(pairs / 2 - half))) AS low, min(diff) FILTER (WHERE cum >= least(pairs, ceil(pairs / 2 + half) + 1)) AS high FROM cum, s"""


def shift(t, value: str):
    found = st.location_shift(answers(t), "o_orderstatus", value, "F", "O")
    return t.spark.createDataFrame([tuple(map(float, found))], "shift double, low double, high double")


@query("M13_location_shift", shift_sql("substr(o_orderpriority, 1, 1)::DOUBLE"))
def _(t):
    return shift(t, "strength")


@query("M13_location_shift_of_sums", shift_sql("floor(o_totalprice / 100)::DOUBLE"))
def _(t):
    """Thousands of different values: the differences are searched, not listed."""
    return shift(t, "hundreds")


@query("M14_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY strength) + (count(*) OVER (PARTITION BY strength) - 1) / 2 AS a, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS b
  FROM (SELECT substr(o_orderpriority, 1, 1)::INTEGER AS strength, o_totalprice FROM orders))
SELECT count(*) AS n, round(corr(a, b), 9) AS rho FROM r""")
def _(t):
    return st.spearman(answers(t), "strength", "o_totalprice")


# Both tails of Student's t: the series of the incomplete beta function in t^2 / (n - 2 + t^2).
STUDENT = """r AS (SELECT rank() OVER (ORDER BY strength) + (count(*) OVER (PARTITION BY strength) - 1) / 2 AS a, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS b
  FROM (SELECT substr(o_orderpriority, 1, 1)::INTEGER AS strength, o_totalprice FROM orders)),
c AS (SELECT count(*) AS n, round(corr(a, b), 9) AS rho FROM r),
t AS (SELECT n, rho, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM c),
z AS (SELECT *, (n - 2) / 2.0::DOUBLE AS h, t * t / (n - 2 + t * t) AS z FROM t),
series AS (SELECT n, rho, t, exp(0.5 * ln(z) + h * ln(1 - z) - lgamma(0.5) - lgamma(h) + lgamma(h + 0.5)) / 0.5
    * sum(exp(lgamma(h + 0.5 + k) - lgamma(h + 0.5) - lgamma(1.5 + k) + lgamma(1.5) + k * ln(z))) AS inner_part
  FROM z, (SELECT unnest(range(0, 400)) AS k) GROUP BY n, rho, t, z, h)"""


@query("M14_spearman_test", f"WITH {STUDENT} SELECT n, rho, round(t, 6) AS t, abs(round(1 - inner_part, 6)) AS p_value FROM series")
def _(t):
    found = st.spearman_test(answers(t), "strength", "o_totalprice")
    return found.select("n", "rho", F.round("t", 6).alias("t"), F.abs(F.round("p_value", 6)).alias("p_value"))


@query("M15_chi_square_test", """
WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS expected, sum(n) OVER () AS total FROM c),
x AS (SELECT any_value(total)::BIGINT AS n, round(sum((n - expected) * (n - expected) / expected), 6) AS chi_square,
  ((SELECT count(DISTINCT a) FROM c) - 1) * ((SELECT count(DISTINCT b) FROM c) - 1) AS degrees FROM e)
SELECT n, chi_square, degrees, round(1 - sum(exp((degrees / 2.0::DOUBLE + k) * ln(chi_square / 2) - chi_square / 2 - lgamma(degrees / 2.0::DOUBLE + k + 1))), 6) AS p_value
FROM x, (SELECT unnest(range(0, 400)) AS k) GROUP BY n, chi_square, degrees""")
def _(t):
    return st.chi_square_test(t.orders, "o_orderpriority", "o_orderstatus").withColumn("p_value", F.round("p_value", 6))


@query("M15_chi_square", """
WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS expected, sum(n) OVER () AS total FROM c)
SELECT any_value(total)::BIGINT AS n, round(sum((n - expected) * (n - expected) / expected), 6) AS chi_square,
  ((SELECT count(DISTINCT a) FROM c) - 1) * ((SELECT count(DISTINCT b) FROM c) - 1) AS degrees FROM e""")
def _(t):
    return st.chi_square(t.orders, "o_orderpriority", "o_orderstatus")


SIZES, REPLICATES = [50, 100, 200], 1000


@query("M16_resampled_power", f"""
WITH pilot AS (SELECT *, row_number() OVER (ORDER BY md5(c_custkey || ':power'), c_custkey) AS place, count(*) OVER () AS total FROM (
  SELECT c_custkey, c_acctbal AS outcome, arm, CASE WHEN row_number() OVER (PARTITION BY arm ORDER BY md5(c_custkey || ':pilot/timing'), c_custkey) <= round(count(*) OVER (PARTITION BY arm) / 2) THEN 1 ELSE 0 END AS timing
  FROM (SELECT *, CASE WHEN md5(c_custkey || ':pilot/arm') < '8' THEN 0 ELSE 1 END AS arm FROM customer))),
draws AS (SELECT size, replicate, ('0x' || substr(md5('power/' || size || '/' || replicate || '/' || draw), 1, 12))::BIGINT % (SELECT count(*) FROM customer) + 1 AS place FROM (
  SELECT size, replicate, unnest(range(1, size + 1)) AS draw FROM (SELECT size, unnest(range(1, {REPLICATES + 1})) AS replicate FROM (VALUES {','.join(f'({n})' for n in SIZES)}) v(size)))),
cells AS (SELECT size, replicate, count(*) FILTER (WHERE arm = 0 AND timing = 0)::DOUBLE AS n0, count(*) FILTER (WHERE arm = 1 AND timing = 0)::DOUBLE AS n1,
  avg(outcome) FILTER (WHERE arm = 0 AND timing = 0) AS m0, avg(outcome) FILTER (WHERE arm = 1 AND timing = 0) AS m1,
  var_pop(outcome) FILTER (WHERE arm = 0 AND timing = 0) AS v0, var_pop(outcome) FILTER (WHERE arm = 1 AND timing = 0) AS v1
  FROM draws JOIN pilot USING (place) GROUP BY size, replicate)
SELECT size, count(*) AS n_replicates, round(avg(CASE WHEN abs((m1 - m0) / sqrt(v0 * n0 / ((n0 - 1) * (n0 - 1)) + v1 * n1 / ((n1 - 1) * (n1 - 1)))) > critical THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS power
FROM cells JOIN (VALUES {','.join(f'({n}, {st.student_critical(0.05, n - 4)!r}::DOUBLE)' for n in SIZES)}) k(size, critical) USING (size) GROUP BY size""")
def _(t):
    assigned = sampling.random_assignment(t.customer, "c_custkey", "pilot").withColumn("outcome", F.col("c_acctbal"))
    return st.resampled_power(assigned, "c_custkey", "arm", "timing", "outcome", SIZES, REPLICATES)
