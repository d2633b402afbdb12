import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from driftline.operators import diagnostics as dg
from driftline.operators.glm import gamma_glm, robust_t_fit
from driftline.operators.linear import (
    breusch_pagan,
    coef_table,
    mean_standard_error,
    ols_fit,
    predict_band,
    predict_grid,
    with_residuals,
)
from driftline.operators.mixed import (
    bootstrap_draws,
    bootstrap_se,
    cluster_bootstrap,
    group_effects,
    random_intercept_fit,
)
from driftline.operators.slopes import random_slopes_fit, slope_effects

RNG = np.random.default_rng(17)
N, GROUPS = 240, 12
KEY = RNG.integers(0, GROUPS, N) ** 2 // GROUPS
X1, X2 = RNG.normal(100, 5, N), RNG.normal(-3, 1, N)
Y = 2 + 0.3 * X1 - 1.5 * X2 + RNG.normal(0, 1.2, GROUPS)[KEY] + RNG.standard_t(4, N)
DESIGN = np.column_stack([np.ones(N), X1, X2])


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"a{k}", i, float(a), float(b), float(y), float(math.exp(y / 20))) for i, (k, a, b, y) in enumerate(zip(KEY, X1, X2, Y))]
    data += [("a0", 900, None, 1.0, 1.0, 1.0), (None, 901, 1.0, 1.0, None, 1.0)]
    return spark.createDataFrame(data, "k string, t int, x1 double, x2 double, y double, pos double")


def least_squares(design, y):
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    sigma2 = float(rss[0]) / (len(y) - design.shape[1])
    return beta, np.sqrt(sigma2 * np.diag(np.linalg.inv(design.T @ design))), math.sqrt(sigma2)


def test_least_squares(spark, rows):
    fit = ols_fit(rows, "y", ["x1", "x2"])
    beta, se, sigma = least_squares(DESIGN, Y)
    assert fit.coef == pytest.approx(beta, rel=1e-8)
    assert fit.std_error == pytest.approx(se, rel=1e-8)
    assert fit.sigma == pytest.approx(sigma, rel=1e-8)
    packed = VectorAssembler(inputCols=["x1", "x2"], outputCol="f").transform(rows.where("t < 900"))
    model = LinearRegression(labelCol="y", featuresCol="f", solver="normal").fit(packed)
    assert fit.coef == pytest.approx([model.intercept, *model.coefficients], rel=1e-7)
    assert fit.r2 == pytest.approx(model.summary.r2, rel=1e-8)
    table = {r.term: r for r in coef_table(spark, fit, exp=True).collect()}
    assert table["x2"].response_scale == pytest.approx(math.exp(beta[2]), rel=1e-7)


def test_residuals_and_bands(spark, rows):
    fit = ols_fit(rows, "y", ["x1", "x2"])
    total = with_residuals(rows, fit).agg(F.sum("residual"), F.sum(F.col("residual") * F.col("x1"))).first()
    assert total[0] == pytest.approx(0, abs=1e-7)
    grid = spark.createDataFrame([(95.0, -2.0)], "x1 double, x2 double")
    at = np.array([1, 95.0, -2.0])
    expected = math.sqrt(at @ fit.cov @ at)
    row = predict_band(grid, fit).withColumn("again", mean_standard_error(fit)).first()
    assert row.link == pytest.approx(at @ fit.coef)
    assert (row.se, row.again) == pytest.approx((expected, expected))
    assert (row.lower, row.upper) == pytest.approx((math.exp(row.link - row.se), math.exp(row.link + row.se)))
    assert predict_grid(grid, fit, "response").first().prediction == pytest.approx(math.exp(row.link))


def test_breusch_pagan(rows):
    beta = least_squares(DESIGN, Y)[0]
    e2 = (Y - DESIGN @ beta) ** 2
    gamma = least_squares(DESIGN, e2)[0]
    r2 = 1 - ((e2 - DESIGN @ gamma) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    test = breusch_pagan(rows, "y", ["x1", "x2"])
    assert test["statistic"] == pytest.approx(N * r2, rel=1e-6)
    assert test["df"] == 2


def dense_criterion(ratio):
    same = KEY[:, None] == KEY[None, :]
    v = np.eye(N) + ratio * same
    vi = np.linalg.inv(v)
    xx = DESIGN.T @ vi @ DESIGN
    beta = np.linalg.solve(xx, DESIGN.T @ vi @ Y)
    r = Y - DESIGN @ beta
    rss = r @ vi @ r
    free = N - DESIGN.shape[1]
    value = free * math.log(rss / free) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1]
    return value, beta, rss / free, np.linalg.inv(xx), vi, r


def test_random_intercept_matches_dense_fit(rows):
    fit = random_intercept_fit(rows, "y", ["x1", "x2"], "k")
    value, beta, sigma2, inverse, vi, r = dense_criterion(fit.ratio)
    assert fit.criterion == pytest.approx(value, abs=1e-6)
    assert fit.coef == pytest.approx(beta, rel=1e-7)
    assert fit.sigma2 == pytest.approx(sigma2, rel=1e-8)
    assert fit.std_error == pytest.approx(np.sqrt(sigma2 * np.diag(inverse)), rel=1e-7)
    for factor in (0.9, 0.99, 1.01, 1.1):
        assert dense_criterion(fit.ratio * factor)[0] > value
    effects = {row.k: row.effect for row in group_effects(fit).collect()}
    weighted = vi @ r
    for k in set(KEY):
        assert effects[f"a{k}"] == pytest.approx(fit.ratio * weighted[KEY == k].sum(), abs=1e-6)


def test_random_intercept_without_group_variance(spark):
    data = [(f"g{i % 5}", float(i), float((i * 7919) % 13) + 0.5 * i) for i in range(200)]
    fit = random_intercept_fit(spark.createDataFrame(data, "k string, x double, y double"), "y", ["x"], "k")
    assert fit.sigma2_group < 1e-3 * fit.sigma2


def test_gamma_glm_matches_reweighted_least_squares(rows):
    positive = np.exp(Y / 20)
    beta = np.array([math.log(positive.mean()), 0.0, 0.0])
    for _ in range(50):
        mu = np.exp(DESIGN @ beta)
        beta = np.linalg.solve(DESIGN.T @ DESIGN, DESIGN.T @ (np.log(mu) + (positive - mu) / mu))
    fit = gamma_glm(rows.where("t < 900"), "pos", ["x1", "x2"])
    assert fit.coef == pytest.approx(beta, rel=1e-6)
    mu = np.exp(DESIGN @ beta)
    dispersion = (((positive - mu) / mu) ** 2).sum() / (N - 3)
    assert fit.dispersion == pytest.approx(dispersion, rel=1e-6)
    assert fit.std_error == pytest.approx(np.sqrt(dispersion * np.diag(np.linalg.inv(DESIGN.T @ DESIGN))), rel=1e-5)


def test_robust_fit_is_stationary(rows):
    nu = 4.0
    fit = robust_t_fit(rows, "y", ["x1", "x2"], nu=nu, tol=1e-12)
    assert fit.converged

    def loglik(beta, sigma):
        r = (Y - DESIGN @ beta) / sigma
        return -N * math.log(sigma) - (nu + 1) / 2 * np.log1p(r * r / nu).sum()

    best = loglik(fit.coef, fit.sigma)
    for i, h in enumerate((1e-3, 1e-5, 1e-3)):
        for sign in (-1, 1):
            moved = fit.coef.copy()
            moved[i] += sign * h
            assert loglik(moved, fit.sigma) < best
    assert loglik(fit.coef, fit.sigma * 1.001) < best and loglik(fit.coef, fit.sigma * 0.999) < best
    assert not robust_t_fit(rows, "y", ["x1", "x2"], max_rounds=1).converged


def test_bootstrap(spark, rows):
    fit = cluster_bootstrap(rows, "y", ["x1", "x2"], "k", replicates=40, seed=3)
    again = cluster_bootstrap(rows.repartition(7), "y", ["x1", "x2"], "k", replicates=40, seed=3)
    assert fit.coef == pytest.approx(again.coef, rel=1e-9)
    assert fit.coef.mean(axis=0) == pytest.approx(ols_fit(rows, "y", ["x1", "x2"]).coef, rel=0.2)
    grid = spark.createDataFrame([(100.0, -3.0), (90.0, 0.0)], "x1 double, x2 double")
    for row in bootstrap_se(grid, fit).collect():
        at = fit.coef @ np.array([1, row.x1, row.x2])
        assert row.se == pytest.approx(at.std(ddof=1), rel=1e-9)
    assert bootstrap_draws(grid, fit).count() == 2 * len(fit.coef)


def pacf_by_regression(acf):
    found = []
    for k in range(1, len(acf) + 1):
        full = [1.0, *acf]
        matrix = np.array([[full[abs(i - j)] for j in range(k)] for i in range(k)])
        found.append(np.linalg.solve(matrix, acf[:k])[-1])
    return found


def check_serial(spark, rows):
    clean = rows.where("t < 900")
    order = [F.col("t")]
    series = {}
    for r in clean.orderBy("t").collect():
        series.setdefault(r.k, []).append(r.y)
    for r in dg.durbin_watson(clean, ["k"], order, "y").collect():
        e = np.array(series[r.k])
        assert r.dw == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    for r in dg.autocorrelation(clean, ["k"], order, "y", 2).collect():
        d = np.array(series[r.k]) - np.mean(series[r.k])
        if len(d) > r.lag:
            assert r.acf == pytest.approx((d[r.lag :] * d[: -r.lag]).sum() / (d**2).sum())
    d = Y - Y.mean()
    acf = [(d[k:] * d[:-k]).sum() / (d**2).sum() for k in range(1, 6)]
    assert dg.pacf(clean, order, "y", 5) == pytest.approx(pacf_by_regression(acf))


def test_serial_checks(spark, rows):
    check_serial(spark, rows)


def test_serial_checks_on_large_groups(spark, rows):
    check_serial(spark, rows)


def test_shape_checks(spark, rows):
    clean = rows.where("t < 900")
    row = dg.jarque_bera(clean, [], "y").first()
    d = Y - Y.mean()
    skew, kurt = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    assert row.jb == pytest.approx(N / 6 * (skew**2 + kurt**2 / 4))
    pairs = {r.rank: (r.y, r.theoretical) for r in dg.qq_pairs(clean, [], "y", ["t"]).collect()}
    assert [pairs[i][0] for i in range(1, N + 1)] == sorted(Y)
    assert pairs[1][1] == pytest.approx(-pairs[N][1])


def slow_shapiro(values):
    """Weights and probability number by number."""
    x, n = np.sort(values), len(values)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    a, mm, u = np.zeros(n), m @ m, n**-0.5
    outer = sum(c * u**k for k, c in enumerate(dg.OUTER_WEIGHT)) + m[-1] / math.sqrt(mm)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    elif n <= 5:
        a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * outer**2))
        a[0], a[-1] = -outer, outer
    else:
        following = sum(c * u**k for k, c in enumerate(dg.NEXT_WEIGHT)) + m[-2] / math.sqrt(mm)
        a = m / math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * outer**2 - 2 * following**2))
        a[:2], a[-2:] = [-outer, -following], [following, outer]
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    if n == 3:
        return w, max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    if n <= 11:
        top = dg.SMALL_LIMIT[0] + dg.SMALL_LIMIT[1] * n
        value, at, centre, spread = -math.log(top - math.log(1 - w)), n, dg.SMALL_MEAN, dg.SMALL_SPREAD
    else:
        value, at, centre, spread = math.log(1 - w), math.log(n), dg.LARGE_MEAN, dg.LARGE_SPREAD
    z = (value - sum(c * at**k for k, c in enumerate(centre))) / math.exp(sum(c * at**k for k, c in enumerate(spread)))
    return w, math.erfc(z / math.sqrt(2)) / 2


def test_shapiro_wilk(spark):
    rng = np.random.default_rng(8)
    groups = {f"g{n}": rng.normal(3, 2, n) for n in (3, 4, 5, 6, 9, 11, 12, 40, 700, 6000)}
    groups |= {"skewed": rng.exponential(1, 90), "ties": rng.integers(0, 6, 50).astype(float)}
    # A published example: weights of eleven men.
    groups["men"] = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float)
    data = [(k, float(v)) for k, own in groups.items() for v in own]
    data += [("one", 1.0), ("two", 1.0), ("two", 2.0), ("flat", 5.0), ("flat", 5.0), ("flat", 5.0), ("men", None)]
    found = {r.k: r for r in dg.shapiro_wilk(spark.createDataFrame(data, "k string, x double").repartition(4), ["k"], "x").collect()}
    for name, own in groups.items():
        w, p = slow_shapiro(own)
        assert found[name].n == len(own) and found[name].w == pytest.approx(w, rel=1e-9)
        assert found[name].p_value == pytest.approx(p, rel=1e-6, abs=1e-12)
    assert (found["men"].w, found["men"].p_value) == pytest.approx((0.78881, 0.006704), rel=1e-3)
    assert [(found[k].w, found[k].p_value) for k in ("one", "two", "flat")] == [(None, None)] * 3


def test_density(spark, rows):
    clean = rows.where("t < 900")
    curve = sorted(dg.kde(clean, "y", 256).collect(), key=lambda r: r.point)
    q1, q3 = np.quantile(Y, [0.25, 0.75])
    width = 0.9 * min(Y.std(ddof=1), (q3 - q1) / 1.34) * N**-0.2
    x = np.array([r.x for r in curve])
    direct = np.exp(-(((x[:, None] - Y[None, :]) / width) ** 2) / 2).mean(axis=1) / (width * math.sqrt(2 * math.pi))
    assert np.array([r.density for r in curve]) == pytest.approx(direct, abs=2e-4)
    assert np.trapezoid([r.density for r in curve], x) == pytest.approx(1, abs=2e-3)


def test_random_slopes_match_dense_criterion(spark):
    rng = np.random.default_rng(5)
    key = rng.integers(0, 15, 300)
    x = rng.normal(50, 4, 300)
    w = rng.normal(0, 1, 300)
    effect = rng.multivariate_normal([0, 0], [[4.0, 0.3], [0.3, 0.2]], 15)
    y = 1 + 0.5 * x + 0.2 * w + effect[key, 0] + effect[key, 1] * (x - 50) + rng.normal(0, 1.0, 300)
    df = spark.createDataFrame(
        [(f"g{k}", *map(float, r)) for k, *r in zip(key, x, w, y)], "k string, x double, w double, y double"
    )
    fit = random_slopes_fit(df, "y", ["x", "w"], ["x"], "k")
    assert fit.converged
    design, z = np.column_stack([np.ones(300), x, w]), np.column_stack([np.ones(300), x])
    same = key[:, None] == key[None, :]

    def dense(group_cov, sigma2):
        v = sigma2 * np.eye(300) + same * (z @ group_cov @ z.T)
        vi = np.linalg.inv(v)
        xx = design.T @ vi @ design
        beta = np.linalg.solve(xx, design.T @ vi @ y)
        r = y - design @ beta
        value = np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1] + r @ vi @ r
        return value, beta, np.linalg.inv(xx)

    best, beta, cov = dense(fit.group_cov, fit.sigma2)
    assert fit.coef == pytest.approx(beta, rel=1e-5)
    assert fit.std_error == pytest.approx(np.sqrt(np.diag(cov)), rel=1e-5)
    shifts = {r.k: (r.n, r["(Intercept)"], r.x) for r in slope_effects(fit).collect()}
    for k in set(key):
        mine = key == k
        v = fit.sigma2 * np.eye(mine.sum()) + z[mine] @ fit.group_cov @ z[mine].T
        wanted = fit.group_cov @ z[mine].T @ np.linalg.solve(v, y[mine] - design[mine] @ fit.coef)
        assert shifts[f"g{k}"] == pytest.approx((mine.sum(), *wanted), rel=1e-4, abs=1e-4)
    root = np.linalg.cholesky(fit.group_cov)
    for i, j in ((0, 0), (1, 0), (1, 1)):
        for step in (-0.02, 0.02):
            moved = root.copy()
            moved[i, j] *= 1 + step
            assert dense(moved @ moved.T, fit.sigma2)[0] > best - 1e-6
    assert dense(fit.group_cov, fit.sigma2 * 1.01)[0] > best and dense(fit.group_cov, fit.sigma2 * 0.99)[0] > best
