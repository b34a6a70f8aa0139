import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates as ag
from millrace.operators import neighbours as nb
from millrace.operators import regression as rg
from millrace.operators import sampling
from millrace.operators import statistics as st

rng = np.random.default_rng(5)
X = rng.normal(size=(400, 3)) * [1, 10, 0.1] + [0, 1000, 5]
G = rng.integers(0, 3, 400)
Y = 3 + X @ [2, -0.5, 4] + np.array([0, 1.5, -2])[G] + rng.normal(size=400) * (1 + np.abs(X[:, 0]))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, *map(float, x), f"g{g}", float(y)) for i, (x, g, y) in enumerate(zip(X, G, Y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, g string, y double").repartition(5)


def design():
    return np.column_stack([np.ones(400), X, G == 1, G == 2]).astype(float)


def terms(table):
    return {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), **rg.dummies("g", rg.levels_of(table, "g"))}


def test_least_squares_and_robust_errors(table):
    d = design()
    beta, bread = np.linalg.lstsq(d, Y, rcond=None)[0], np.linalg.inv(d.T @ d)
    e = Y - d @ beta
    fit = rg.least_squares(table, terms(table), "y")
    assert np.allclose(fit.estimate, beta, rtol=1e-6) and fit.n == 400
    assert fit.r_squared == pytest.approx(1 - e @ e / ((Y - Y.mean()) @ (Y - Y.mean())), rel=1e-9)
    h = np.einsum("ij,jk,ik->i", d, bread, d)
    for kind, w in (("HC1", e**2 * 400 / 394), ("HC3", (e / (1 - h)) ** 2)):
        want = bread @ ((d * w[:, None]).T @ d) @ bread
        got = rg.robust_covariance(table, terms(table), "y", fit, kind)
        assert np.allclose(np.sqrt(np.diag(got)), np.sqrt(np.diag(want)), rtol=1e-6)


def test_nested_models_equal_single_fits(table):
    steps = [("one", {"a": F.col("a")}), ("two", {"b": F.col("b"), "c": F.col("c")})]
    rows = {(r.model, r.term): (r.estimate, r.std_error) for r in rg.nested_models(table, "y", steps, "HC3").collect()}
    for name, columns in (("one", ["a"]), ("two", ["a", "b", "c"])):
        use = {c: F.col(c) for c in columns}
        fit = rg.least_squares(table, use, "y")
        errors = np.sqrt(np.diag(rg.robust_covariance(table, use, "y", fit, "HC3")))
        for term, b, e in zip(fit.terms, fit.estimate, errors):
            assert rows[name, term] == pytest.approx((b, e), rel=1e-4, abs=1e-5)


def test_ridge_without_penalty_is_least_squares(table):
    got = rg.ridge(table, ["a", "b", "c"], "y", 0.0)
    fit = rg.least_squares(table, {c: F.col(c) for c in "abc"}, "y")
    assert np.allclose([got["intercept"], got["a"], got["b"], got["c"]], fit.estimate, rtol=1e-6)


def test_ridge_descent_reaches_the_closed_form(table):
    scaled, _ = rg.standardised(table, ["a", "b", "c"], 1)
    closed = rg.ridge(scaled, ["a", "b", "c"], "y", 2.0)
    walked = rg.ridge_descent(scaled, ["a", "b", "c"], "y", 0.1, 3000, 2.0)
    assert all(closed[k] == pytest.approx(walked[k], abs=1e-8) for k in closed)
    assert abs(rg.ridge_descent(scaled, ["b"], "y", 0.1, 3000, 2.0, quirk=True)["b"]) > abs(rg.ridge_descent(scaled, ["b"], "y", 0.1, 3000, 2.0)["b"])


def test_lasso_descent_follows_the_row_by_row_form(table):
    scaled, _ = rg.standardised(table.select("a", "y"), ["a", "y"])
    x, y = ((v - v.mean()) / v.std() for v in (X[:, 0], Y))
    w = b = 0.0
    for _ in range(200):
        sign = 1 if w > 0 else -1
        gw = -2 / 400 * (np.sum(x * (y - w * x - b)) - 30.0 * sign)
        gb = -2 / 400 * np.sum(y - w * x - b)
        w, b = w - 0.01 * gw, b - 0.01 * gb
    got = rg.lasso_descent(scaled, ["a"], "y", 0.01, 200, 30.0)
    assert got["a"] == pytest.approx(w, abs=1e-9) and got["intercept"] == pytest.approx(b, abs=1e-9)


def test_logistic_loss_falls_and_gradient_vanishes(table):
    frame = table.withColumn("hit", (F.col("y") > float(np.median(Y))).cast("double"))
    scaled, _ = rg.standardised(frame.select("a", "b", "hit"), ["a", "b"])
    fitted, losses = rg.logistic_newton(scaled, ["a", "b"], "hit", 12)
    assert all(x >= y - 1e-9 for x, y in zip(losses, losses[1:]))
    p = scaled.select((rg.probability(fitted) - F.col("hit")).alias("r"), "a").agg(F.sum("r"), F.sum(F.col("r") * F.col("a"))).first()
    assert abs(p[0]) < 1e-6 and abs(p[1]) < 1e-6
    _, walked = rg.logistic_descent(scaled, ["a", "b"], "hit", 1e-3, 4)
    assert walked == sorted(walked, reverse=True)


def test_student_tails():
    assert st.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert st.student_two_sided(12.70620474, 1) == pytest.approx(0.05, abs=1e-8)
    assert st.student_critical(0.05, 96) == pytest.approx(1.98498431, abs=1e-6)
    assert st.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)


def survey(spark):
    a, b = rng.integers(1, 6, 60), rng.integers(1, 5, 45)
    rows = [("R", int(v)) for v in a] + [("D", int(v)) for v in b] + [("R", None), ("I", 3)]
    return a, b, spark.createDataFrame(rows, "party string, v int").repartition(4)


def test_rank_sum_by_counting_pairs(spark):
    a, b, df = survey(spark)
    row = st.rank_sum(df, "party", "v", "R", "D").first()
    w = float(np.sum(a[:, None] > b[None, :]) + 0.5 * np.sum(a[:, None] == b[None, :]))
    n = 105
    ties = sum(t**3 - t for t in np.unique(np.concatenate([a, b]), return_counts=True)[1].astype(float))
    sigma = math.sqrt(60 * 45 / 12 * (n + 1 - ties / (n * (n - 1))))
    centred = w - 60 * 45 / 2
    assert row.w == pytest.approx(w, abs=0.051) and row.z == pytest.approx((centred - math.copysign(0.5, centred)) / sigma, abs=1e-6)
    assert 0 < row.p_value < 1


def test_location_shift_is_the_median_difference(spark):
    a, b, df = survey(spark)
    want = float(np.median((a[:, None] - b[None, :]).reshape(-1)))
    found = st.location_shift(df, "party", "v", "R", "D")
    assert found[0] == want and found[1] <= want <= found[2]


def test_power_is_a_share_and_repeats(spark):
    rows = [(i, i % 2, (i // 2) % 2, float((i * 37) % 11) + 4 * (i % 2)) for i in range(80)]
    pilot = spark.createDataFrame(rows, "id long, arm int, timing int, y double")
    runs = [{r["size"]: (r.n_replicates, r.power) for r in st.resampled_power(pilot, "id", "arm", "timing", "y", [12, 60], 30).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and runs[0][12][0] == 30 and 0 <= runs[0][12][1] <= runs[0][60][1] <= 1


def test_quantiles_and_profile(spark):
    values = [float(v) for v in rng.integers(0, 50, 333)]
    df = spark.createDataFrame([(v, "a" if i % 3 else "b") for i, v in enumerate(values)] + [(None, "a")], "v double, g string").repartition(6)
    row = ag.profile(df, ["v"]).first()
    assert (row.n_null, row.n_unique, row.n) == (1, len(set(values)) + 1, 333)
    assert [row.lowest, row.lower, row.median, row.upper, row.highest] == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.75, 1]), abs=1e-6)
    box = {r.g: r.median for r in ag.box_summary(df, ["g"], "v").collect()}
    assert box["b"] == pytest.approx(np.median([v for i, v in enumerate(values) if i % 3 == 0]))


def test_histogram_counts_everything(spark):
    values = [float(v) for v in rng.normal(size=500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r.n for r in ag.histogram_equal_bins(df, "v", 12).orderBy("bin").collect()]
    assert got == list(np.histogram(values, 12)[0])
    density = ag.histogram_equal_bins(df, "v", 12, density=True).collect()
    assert sum(r.density * (r.high - r.low) for r in density) == pytest.approx(1, abs=1e-5)
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.n for r in ag.histogram_equal_bins(same, "v", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_removal_log_sums_to_removed_rows(spark):
    df = spark.createDataFrame([(i if i % 7 else None,) for i in range(100)], "v int")
    rows = ag.removal_report(df, [("small", F.col("v") > 20), ("odd", F.col("v") % 2 == 0)]).orderBy("step").collect()
    kept = df.filter((F.col("v") > 20) & (F.col("v") % 2 == 0)).count()
    assert rows[-1].remaining == kept and sum(r.number_samples_removed for r in rows) == 100 - kept


def test_split_parts_are_disjoint_and_complete(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(301)], "id long, label boolean")
    parts = sampling.labelled_split(df, ["label"], "id", {"train": 0.6, "validation": 0.2, "test": 0.2}, "s")
    assert parts.count() == 301 and parts.select("id").distinct().count() == 301
    sizes = {(r.label, r.part): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert sizes[True, "train"] == 60 and sizes[True, "test"] == 20 and sizes[False, "train"] == 120


def vectors(spark):
    points = rng.normal(size=(150, 4)).round(1)
    points[100:110] = points[0]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "row_id long, vector array<float>").repartition(4)
    return points.astype(np.float32).astype(float), df


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "minkowski", "cosine"])
def test_nearest_is_exact_by_broadcast_and_by_pivots(spark, metric, monkeypatch):
    monkeypatch.setattr(nb, "TILE_ROWS", 7)
    points, df = vectors(spark)
    queries = df.filter("row_id % 10 = 0").withColumnRenamed("row_id", "query_id")
    want = {}
    for q in range(0, 150, 10):
        if metric == "cosine":
            d = 1 - points @ points[q] / np.linalg.norm(points, axis=1) / np.linalg.norm(points[q])
        else:
            p = {"euclidean": 2, "manhattan": 1, "minkowski": 3}[metric]
            d = (np.abs(points - points[q]) ** p).sum(1) ** (1 / p)
        want[q] = np.sort(d)[:6]
    frames = [nb.nearest(queries, df, 6, metric, 3.0), nb.nearest_by_pivots(queries, df, 6, metric, 3.0)]
    for frame in frames:
        rows = frame.orderBy("query_id", "rank").collect()
        assert len(rows) == 15 * 6
        for q in want:
            assert [r.distance for r in rows if r.query_id == q] == pytest.approx(want[q], abs=1e-6)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_pivots_skip_blocks_and_lose_nothing(spark, metric, monkeypatch):
    """Clusters far apart, a third of all rows equal, vectors of zeros; a row is no answer to itself."""
    monkeypatch.setattr(nb, "TILE_ROWS", 50)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 6)) * 40
    points = np.concatenate([np.repeat(centres, 50, axis=0) + draw.normal(size=(600, 6)), np.repeat(centres[:1], 300, axis=0), np.zeros((9, 6))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "row_id long, vector array<double>").repartition(5)
    queries = df.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    got, want = ({(r.query_id, r["rank"]): round(r.distance, 6) for r in f.collect()} for f in (nb.nearest_by_pivots(queries, df, 5, metric, others=True), nb.nearest(queries, df, 5, metric, others=True)))
    assert got == want and len(got) == 5 * len(range(0, len(points), 20))
    assert all(r.query_id != r.row_id for r in nb.nearest_by_pivots(queries, df, 5, metric, others=True).collect())
    _, about = nb._blocked(df, metric, 2.0)
    lower, upper = about.bounds(points[::20])
    first = about.first(lower, upper, 5)
    limits = np.array([want[q, 5] for q in range(0, len(points), 20)])
    assert (first | about.later(lower, limits, first)).mean() < 0.4
    few = nb.nearest_by_pivots(queries.limit(3), df.limit(4), 9, metric).collect()
    assert len(few) == 12 and nb.nearest_by_pivots(queries, df.limit(0), 3, metric).count() == 0 and nb.nearest_by_pivots(queries.limit(0), df, 3, metric).count() == 0


def test_nearest_of_itself_is_itself_or_an_equal_row(spark):
    points, df = vectors(spark)
    found = nb.nearest(df.withColumnRenamed("row_id", "query_id"), df, 1).collect()
    assert all(r.distance < 1e-6 and np.allclose(points[r.query_id], points[r.row_id]) for r in found)


def test_k_means_follows_the_plain_loop(spark):
    points, df = vectors(spark)
    clusters, centres, _ = nb.k_means(df, "row_id", "vector", 3, "s")
    start = np.array(nb.initial_centres(df, "row_id", "vector", 3, "s"))
    for _ in range(500):
        label = ((points[:, None] - start[None]) ** 2).sum(2).argmin(1)
        moved = np.array([points[label == i].mean(0) if (label == i).any() else start[i] for i in range(3)])
        if np.all(np.abs(moved - start) < 1e-5):
            break
        start = moved
    assert np.allclose(centres, moved, atol=1e-6)
    assert [r.cluster for r in clusters.orderBy("row_id").collect()] == list(((points[:, None] - moved[None]) ** 2).sum(2).argmin(1))


def test_centres_of_packed_blocks(spark, monkeypatch):
    """Few wide blocks instead of a conversion of every vector at every step; the same through the exchange, and empty clusters stay."""
    points, df = vectors(spark)
    centres = [points[0].tolist(), points[1].tolist(), [1e6] * points.shape[1]]
    assert nb._packed(df.coalesce(1), "vector").count() == 1
    label = ((points[:, None] - np.array(centres)[None]) ** 2).sum(2).argmin(1)
    want = [points[label == i].mean(0) if (label == i).any() else centres[i] for i in range(3)]
    assert np.allclose(nb.updated_centres(df, "vector", centres), want)
    monkeypatch.setattr(nb, "DRIVER_NUMBERS", 0)
    monkeypatch.setattr(nb, "BLOCK_NUMBERS", points.shape[1] * 7)
    assert np.allclose(nb.updated_centres(df, "vector", centres), want)


def test_votes_prefer_the_smallest_label_on_a_tie(spark):
    found = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (2, 13)], "query_id long, row_id long")
    labels = spark.createDataFrame([(10, 5), (11, 3), (12, 7), (13, 7)], "row_id long, label int")
    assert {r.query_id: r.predicted for r in nb.classify(found, labels).collect()} == {1: 3, 2: 7}


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.4), (None, 0.7)]
    df = spark.createDataFrame(rows, "y int, s double")
    pairs = [(p > n) + 0.5 * (p == n) for y, p in rows if y == 1 for z, n in rows if z == 0]
    assert ag.roc_auc(df, "y", "s").first().auc == pytest.approx(sum(pairs) / len(pairs))


def test_ensemble_tie_goes_by_probability(spark):
    df = spark.createDataFrame([(1, 60.0), (1, 45.0), (2, 51.0), (2, 20.0), (3, 80.0), (3, 70.0)], "i int, p double")
    assert {r.i: r.final_vote for r in ag.ensemble_vote(df, "i", "p").collect()} == {1: 1, 2: 0, 3: 1}


def test_ensemble_vote_does_not_depend_on_the_order_of_summation(spark):
    """A probability on the cut counts as no vote, and a mean on a rounding border goes up, whatever the last bits say."""
    df = spark.createDataFrame([(1, 50.00000000000001), (1, 50.0), (1, 49.99999999999999), (2, 0.1234565 - 3e-17), (2, 0.1234565 - 3e-17)], "i int, p double")
    got = {r.i: (r.mean_vote, r.mean_probability, r.final_vote) for r in ag.ensemble_vote(df, "i", "p").collect()}
    assert got == {1: (0.0, 50.0, 0), 2: (0.0, 0.123457, 0)}


def test_queries_travel_once_a_tile_some_at_a_time(monkeypatch):
    """Where nothing can be excluded, a query is sent to every tile, not to every block, and never in one piece for all."""
    monkeypatch.setattr(nb, "SENT_ROWS", 5)
    rows = np.array([3, 4, 2, 25, 1, 9, 1])
    about = nb._Blocks(np.zeros((2, 3)), np.arange(7), rows * 0.0, rows * 0.0, rows, 10, "euclidean", 2.0)
    assert list(zip(about.tile.tolist(), about.cuts.tolist())) == [(0, 1), (0, 1), (0, 1), (1, 3), (4, 1), (4, 1), (5, 1)]
    chosen = np.ones((4, 7), bool)
    chosen[1] = [0, 1, 0, 0, 0, 0, 1]
    chosen[2] = False
    frames = list(nb._sent(np.array([10, 11, 12, 13]), [np.full(3, float(i)) for i in range(4)], chosen, about))
    assert max(map(len, frames)) == 5
    sent = [(q, t, b.tolist(), v[0]) for f in frames for t, q, v, b in f.itertuples(index=False)]
    each = [(0, [0, 1, 2]), (1, [3]), (2, [3]), (3, [3]), (4, [4, 5]), (5, [6])]
    assert sent == [(10, t, b, 0.0) for t, b in each] + [(11, 0, [1], 1.0), (11, 5, [6], 1.0)] + [(13, t, b, 3.0) for t, b in each]
