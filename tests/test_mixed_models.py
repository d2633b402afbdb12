"""Mixed models beyond the normal random intercept, against dense and brute-force versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators.conditional import predict_conditional, predict_conditional_band
from driftline.operators.gamma_mixed import gamma_effects, gamma_mixed_fit
from driftline.operators import student
from driftline.operators.glm import gamma_glm, robust_t_fit
from driftline.operators.slopes import random_slopes_fit, slopes_conditional
from driftline.operators.special import digamma, trigamma
from driftline.operators.student import student_effects, student_mixed_fit

RNG = np.random.default_rng(33)
N, GROUPS = 600, 20
KEY = RNG.integers(0, GROUPS, N) ** 2 // GROUPS
USED = sorted(set(KEY))
X1, X2 = RNG.normal(100, 5, N), RNG.normal(-3, 1, N)
DESIGN = np.column_stack([np.ones(N), X1, X2])
SHIFT = RNG.normal(0, 1.0, GROUPS)[KEY]
HEAVY = 2 + 0.3 * X1 - 1.5 * X2 + SHIFT + RNG.standard_t(3, N)
POSITIVE = np.exp(1 + 0.01 * X1 - 0.2 * X2 + 0.4 * SHIFT) * RNG.gamma(5, 1 / 5, N)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"a{k}", float(a), float(b), float(y), float(g)) for k, a, b, y, g in zip(KEY, X1, X2, HEAVY, POSITIVE, strict=True)]
    data += [("a0", None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(data, "k string, x1 double, x2 double, y double, pos double")


def test_gamma_function_derivatives():
    for x in (0.05, 0.5, 1.0, 3.7, 40.0, 1e5):
        h = 1e-4 * x
        assert digamma(x) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-6, abs=1e-6)
        assert trigamma(x) == pytest.approx((digamma(x + h) - digamma(x - h)) / (2 * h), rel=1e-6)
    assert digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-13)


def t_loglik(beta, sigma, nu, left, extra=0.0):
    d = (left - DESIGN @ beta) ** 2 / sigma**2 + extra
    each = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - math.log(nu * math.pi * sigma**2) / 2
    return N * each - (nu + 1) / 2 * np.log1p(d / nu).sum()


def test_degrees_of_freedom_are_estimated(rows):
    fit = robust_t_fit(rows, "y", ["x1", "x2"], nu=None)
    assert fit.converged and not fit.nu_bound
    best = t_loglik(fit.coef, fit.sigma, fit.nu, HEAVY)
    for nu, sigma in ((1.01, 1), (0.99, 1), (1, 1.01), (1, 0.99)):
        assert t_loglik(fit.coef, fit.sigma * sigma, fit.nu * nu, HEAVY) < best
    again = robust_t_fit(rows, "y", ["x1", "x2"], nu=fit.nu)
    assert again.coef == pytest.approx(fit.coef, rel=1e-7) and again.sigma == pytest.approx(fit.sigma, rel=1e-7)


def test_degrees_of_freedom_end_on_their_limit(spark):
    """Errors lighter than normal ones: no finite number is best."""
    even = spark.createDataFrame([(float(i), float(i % 2) + i / 100) for i in range(200)], "x double, y double")
    fit = robust_t_fit(even, "y", ["x"], nu=None)
    assert fit.nu_bound and fit.nu == pytest.approx(1e6)


def dense_student(nu=None):
    """The same likelihood climbed by plain nested rounds on dense arrays."""
    beta = np.linalg.lstsq(DESIGN, HEAVY, rcond=None)[0]
    sigma2, tau2, freedom = 1.0, 1.0, nu or 4.0
    one = (KEY[:, None] == np.array(USED)[None, :]).astype(float)
    mean, var = np.zeros(len(USED)), np.ones(len(USED))
    for _ in range(3000):
        left = HEAVY - DESIGN @ beta - one @ mean
        d = (left**2 + one @ var) / sigma2
        w = (freedom + 1) / (freedom + d)
        for _ in range(3):
            var = 1 / (one.T @ w / sigma2 + 1 / tau2)
            mean = var * (one.T @ (w * (HEAVY - DESIGN @ beta))) / sigma2
            beta = np.linalg.solve(DESIGN.T @ (w[:, None] * DESIGN), DESIGN.T @ (w * (HEAVY - one @ mean)))
        sigma2 = float((w * ((HEAVY - DESIGN @ beta - one @ mean) ** 2 + one @ var)).sum() / N)
        tau2 = float((mean**2 + var).mean())
        if nu is None:
            slope = lambda v: N / 2 * (digamma((v + 1) / 2) - digamma(v / 2) - 1 / v) - np.log1p(d / v).sum() / 2 + (v + 1) / (2 * v) * (d / (v + d)).sum()
            low, high = 0.2, 200.0
            for _ in range(60):
                middle = math.sqrt(low * high)
                low, high = (middle, high) if slope(middle) > 0 else (low, middle)
            freedom = low
    return beta, sigma2, tau2, freedom, mean, var


@pytest.mark.parametrize("nu", [4.0, None])
def test_student_mixed_equals_dense_rounds(rows, nu):
    fit = student_mixed_fit(rows, "y", ["x1", "x2"], "k", nu=nu, tol=1e-7)
    beta, sigma2, tau2, freedom, mean, var = dense_student(nu)
    assert fit.converged and not fit.nu_bound
    assert fit.coef == pytest.approx(beta, rel=1e-5)
    assert (fit.sigma**2, fit.sigma_group**2, fit.nu) == pytest.approx((sigma2, tau2, freedom), rel=1e-4)
    effects = {r.k: (r.effect, r.sd**2) for r in student_effects(fit).collect()}
    for i, k in enumerate(USED):
        assert effects[f"a{k}"] == pytest.approx((mean[i], var[i]), rel=1e-4, abs=1e-5)
    left = HEAVY - np.array([effects[f"a{k}"][0] for k in KEY])
    spread = np.array([effects[f"a{k}"][1] for k in KEY]) / fit.sigma**2
    value = t_loglik(fit.coef, fit.sigma, fit.nu, left, spread)
    value += sum(0.5 + 0.5 * math.log(v / tau2) - (m * m + v) / (2 * tau2) for m, v in effects.values())
    assert fit.objective == pytest.approx(value, rel=1e-6)


def test_student_mixed_without_group_variance(spark):
    data = [(f"g{i % 5}", float(i), float((i * 7919) % 13) + 0.5 * i) for i in range(200)]
    frame = spark.createDataFrame(data, "k string, x double, y double")
    fit = student_mixed_fit(frame, "y", ["x"], "k", nu=5.0)
    plain = robust_t_fit(frame, "y", ["x"], nu=5.0)
    assert fit.converged and fit.sigma_group == 0
    assert fit.coef == pytest.approx(plain.coef, rel=1e-6) and fit.std_error == pytest.approx(plain.std_error, rel=1e-6)
    assert [r.effect for r in student_effects(fit).collect()] == [0.0] * 5
    assert not student_mixed_fit(frame, "y", ["x"], "k", max_rounds=1).converged


def test_student_mixed_weighs_large_animals_in_pieces(rows, monkeypatch):
    whole = student_mixed_fit(rows, "y", ["x1", "x2"], "k", nu=3.0, tol=1e-7)
    monkeypatch.setattr(student, "PIECE_ROWS", 10)
    cut = student_mixed_fit(rows, "y", ["x1", "x2"], "k", nu=3.0, tol=1e-7)
    np.testing.assert_allclose(cut.coef, whole.coef, rtol=1e-7)
    np.testing.assert_allclose([cut.sigma, cut.sigma_group, cut.objective], [whole.sigma, whole.sigma_group, whole.objective], rtol=1e-6)
    shifts = [{r.k: (r.n, r.effect) for r in student_effects(f).collect()} for f in (whole, cut)]
    assert shifts[0].keys() == shifts[1].keys() and len(shifts[0]) == len(USED)
    for k, (n, effect) in shifts[0].items():
        assert shifts[1][k] == (n, pytest.approx(effect, abs=1e-6))


def test_student_mixed_rounds_leave_the_rows_where_they_are(spark, capsys):
    frame = spark.createDataFrame([(i % 7, float(i), float(i * i % 11)) for i in range(70)], "_key int, _z0 double, _z1 double")
    post = spark.createDataFrame([(k, 0, 0.1, 0.2) for k in range(7)], "_key int, _last bigint, _m double, _v double")
    state = student._State(np.array([0.0, 0.1]), 1.0, 1.0, 4.0)
    laid = student._laid_out(frame)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        laid.count()
        capsys.readouterr()
        student._animal_sums(laid, post, 2, state).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        laid.unpersist()
    plan = capsys.readouterr().out.split("InMemoryTableScan")[0]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the sums, after the join


def gamma_integrals(beta, shape, tau2, laplace):
    """Log likelihood: every animal's integral by Laplace's approximation or on a fine grid."""
    total = 0.0
    for k in USED:
        mine = KEY == k
        y, link = POSITIVE[mine], DESIGN[mine] @ beta

        def density(u):
            u = np.atleast_1d(u)[:, None]
            each = shape * (-y * np.exp(-link - u) - link - u) + shape * math.log(shape) - math.lgamma(shape) + (shape - 1) * np.log(y)
            return each.sum(axis=1) - u[:, 0] ** 2 / (2 * tau2) - math.log(2 * math.pi * tau2) / 2

        low, high = -20.0, 20.0
        for _ in range(200):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (a, high) if density(a)[0] < density(b)[0] else (low, b)
        mode, h = (low + high) / 2, 1e-3
        bend = -(density(mode + h) - 2 * density(mode) + density(mode - h))[0] / h**2
        if laplace:
            total += density(mode)[0] + 0.5 * math.log(2 * math.pi / bend)
        else:
            grid = mode + np.linspace(-12, 12, 4001) / math.sqrt(bend)
            values = density(grid)
            total += values.max() + math.log(np.trapezoid(np.exp(values - values.max()), grid))
    return total


def test_gamma_mixed_is_the_best_of_its_likelihood(rows):
    fit = gamma_mixed_fit(rows, "pos", ["x1", "x2"], "k")
    assert fit.converged and fit.rounds < 15
    best = gamma_integrals(fit.coef, fit.shape, fit.sigma_group**2, True)
    assert fit.loglik == pytest.approx(best, abs=1e-4)
    assert fit.loglik == pytest.approx(gamma_integrals(fit.coef, fit.shape, fit.sigma_group**2, False), abs=0.1)
    for i in range(3):
        for side in (-1, 1):
            moved = fit.coef.copy()
            moved[i] += side * 0.3 * fit.std_error[i]
            assert gamma_integrals(moved, fit.shape, fit.sigma_group**2, True) < best
    for shape, tau in ((1.03, 1), (0.97, 1), (1, 1.05), (1, 0.95)):
        assert gamma_integrals(fit.coef, fit.shape * shape, (fit.sigma_group * tau) ** 2, True) < best
    effects = {r.k: r for r in gamma_effects(fit).collect()}
    for k in USED:
        mine = KEY == k
        total, n = (POSITIVE[mine] * np.exp(-DESIGN[mine] @ fit.coef)).sum(), mine.sum()
        u = effects[f"a{k}"].effect
        assert fit.shape * (total * math.exp(-u) - n) == pytest.approx(u / fit.sigma_group**2, abs=1e-4)
        assert effects[f"a{k}"].n == n
        assert effects[f"a{k}"].sd ** -2 == pytest.approx(fit.shape * total * math.exp(-u) + fit.sigma_group**-2, rel=1e-6)


def test_gamma_mixed_standard_errors(rows):
    """Inverse curvature of the log likelihood in all parameters, by differences of the slow version."""
    fit = gamma_mixed_fit(rows, "pos", ["x1", "x2"], "k")
    at = np.concatenate([fit.coef, [math.log(fit.shape), 2 * math.log(fit.sigma_group)]])
    steps = np.concatenate([fit.std_error * [0.05, 0.05, 0.05], [0.02, 0.1]])

    def value(x):
        return gamma_integrals(x[:3], math.exp(x[3]), math.exp(x[4]), True)

    bend = np.empty((5, 5))
    for i in range(5):
        for j in range(5):
            a, b = steps[i] * np.eye(5)[i], steps[j] * np.eye(5)[j]
            bend[i, j] = (value(at + a + b) - value(at + a - b) - value(at - a + b) + value(at - a - b)) / (4 * steps[i] * steps[j])
    assert fit.std_error == pytest.approx(np.sqrt(np.diag(np.linalg.inv(-bend)))[:3], rel=0.02)


def test_gamma_mixed_without_group_variance(spark):
    rng = np.random.default_rng(2)
    data = [(f"g{i % 6}", float(i % 50), float(y)) for i, y in enumerate(rng.gamma(3, 2, 600))]
    frame = spark.createDataFrame(data, "k string, x double, y double")
    fit, plain = gamma_mixed_fit(frame, "y", ["x"], "k"), gamma_glm(frame, "y", ["x"])
    assert fit.converged
    if fit.sigma_group == 0:
        assert fit.coef == pytest.approx(plain.coef, rel=1e-5)
    assert fit.coef == pytest.approx(plain.coef, abs=0.02)


def test_gamma_mixed_intercept_only_and_bad_response(spark, rows):
    assert gamma_mixed_fit(rows, "pos", [], "k").converged
    with pytest.raises(ValueError):
        gamma_mixed_fit(spark.createDataFrame([("a", 0.0)], "k string, y double"), "y", [], "k")


def dense_conditional(design, z, same, y, group_cov, sigma2, at, at_z, member):
    """Henderson's equations: prediction x'b + z'u and its error variance."""
    n = len(y)
    v = sigma2 * np.eye(n) + same * (z @ group_cov @ z.T)
    vi = np.linalg.inv(v)
    cov = np.linalg.inv(design.T @ vi @ design)
    beta = cov @ design.T @ vi @ y
    own = np.where(member, 1.0, 0.0)[:, None] * z
    gain = group_cov @ own.T @ vi
    u = gain @ (y - design @ beta)
    lean = at - design.T @ gain.T @ at_z
    error = lean @ cov @ lean + at_z @ (group_cov - gain @ own @ group_cov) @ at_z
    return at @ beta + at_z @ u, math.sqrt(error)


def test_slopes_predict_by_animal_with_their_error(spark, rows):
    fit = random_slopes_fit(rows.where("k IS NOT NULL"), "y", ["x1", "x2"], ["x2"], "k", tol=1e-9, max_rounds=300)
    grid = spark.createDataFrame(
        [("a0", 100.0, -3.0, 9), ("a19", 90.0, 1.0, 9), ("none", 95.0, 0.0, 9), (None, 95.0, 0.0, 9)],
        "k string, x1 double, x2 double, shifts int")
    found = {r.k: r for r in predict_conditional(grid, slopes_conditional(fit)).collect()}
    z, same = DESIGN[:, [0, 2]], KEY[:, None] == KEY[None, :]
    names = {"a0": 0, "a19": USED[-1], "none": -1}
    if USED[-1] != 19:
        found["a19"] = predict_conditional(grid.where("k = 'a19'").withColumn("k", F.lit(f"a{USED[-1]}")), slopes_conditional(fit)).first()
    for k, number in names.items():
        row = found[k]
        at = np.array([1, row.x1, row.x2])
        wanted = dense_conditional(DESIGN, z, same, HEAVY, fit.group_cov, fit.sigma2, at, at[[0, 2]], KEY == number)
        if number < 0:
            wanted = (at @ fit.coef, math.sqrt(at @ fit.cov @ at))
        assert (row.fit, row.se) == pytest.approx(wanted, rel=1e-4) and row.shifts == 9
    assert (found[None].fit, found[None].se) == (found["none"].fit, found["none"].se)


def test_intercept_fits_predict_by_animal(spark, rows):
    grid = spark.createDataFrame([("a0", 100.0, -3.0), ("none", 90.0, 1.0)], "k string, x1 double, x2 double")
    student = student_mixed_fit(rows, "y", ["x1", "x2"], "k", nu=3.0, tol=1e-4)
    gamma = gamma_mixed_fit(rows, "pos", ["x1", "x2"], "k")
    shift = {r.k: r.effect for r in student_effects(student).collect()}
    moved = {r.k: r.effect for r in gamma_effects(gamma).collect()}
    for row in predict_conditional(grid, student.conditional).collect():
        at = np.array([1, row.x1, row.x2])
        assert row.fit == pytest.approx(at @ student.coef + shift.get(row.k, 0.0), rel=1e-9)
        if row.k == "none":
            assert row.se == pytest.approx(math.sqrt(at @ student.cov @ at), rel=1e-7)
    for row in predict_conditional_band(grid, gamma.conditional, 2.0).collect():
        at = np.array([1, row.x1, row.x2])
        assert row["mean"] == pytest.approx(math.exp(at @ gamma.coef + moved.get(row.k, 0.0)), rel=1e-9)
        assert row.upper == pytest.approx(row["mean"] * math.exp(2 * row.se), rel=1e-9)
