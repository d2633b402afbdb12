"""Mixed models with slopes, heavy tails and gamma errors, and predictions by animal.

The given values do not depend on the animal, so the responses here add a fixed shift,
scale or slope by animal.  The SQL side climbs the same likelihoods by plain unrolled
rounds with closed-form steps, another way than the operators', so that only the
optimum is shared.
"""

from pyspark.sql import functions as F

from driftline.operators.conditional import predict_conditional
from driftline.operators.gamma_mixed import gamma_effects, gamma_mixed_fit
from driftline.operators.glm import robust_t_fit
from driftline.operators.grids import expand_grid
from driftline.operators.slopes import random_slopes_fit, slopes_conditional
from driftline.operators.student import student_effects, student_mixed_fit
from driftline.queries.models import HOURS, one_line, timed
from driftline.queries.registry import query, rounded, sql_rnd

SHIFT, SLOPE = "(animal * 37 % 11)", "(animal * 53 % 7 - 3)"
MADE = f"""{HOURS},
made AS (SELECT *, value + 10 * {SHIFT} AS level, value + 10 * {SHIFT} + {SLOPE} * (lat - 45) AS sloped,
  (value + 1) * exp(({SHIFT} - 5) / 10.0::double) AS strength FROM timed)"""


def made(t):
    shift = F.col("animal") * 37 % 11
    slope = (F.col("animal") * 53 % 7 - 3) * (F.col("lat") - 45)
    return timed(t).withColumns({
        "level": F.col("value") + 10 * shift,
        "sloped": F.col("value") + 10 * shift + slope,
        "strength": (F.col("value") + 1) * F.exp((shift - 5) / 10.0),
    })


def _digamma(x: str) -> str:
    y = f"({x} + 10)"
    return (
        f"(ln{y} - 1.0::double / (2 * {y}) - 1.0::double / (12 * pow({y}, 2)) + 1.0::double / (120 * pow({y}, 4))"
        f" - 1.0::double / (252 * pow({y}, 6)) + 1.0::double / (240 * pow({y}, 8))"
        + "".join(f" - 1.0::double / ({x} + {k})" for k in range(10)) + ")"
    )


def _trigamma(x: str) -> str:
    y = f"({x} + 10)"
    return (
        f"(1.0::double / {y} + 1.0::double / (2 * pow({y}, 2)) + 1.0::double / (6 * pow({y}, 3)) - 1.0::double / (30 * pow({y}, 5))"
        f" + 1.0::double / (42 * pow({y}, 7)) - 1.0::double / (30 * pow({y}, 9))"
        + "".join(f" + 1.0::double / pow({x} + {k}, 2)" for k in range(10)) + ")"
    )


def _nu_step(nu: str, n: str, logs: str, pulls: str) -> str:
    """A scoring step in log(nu): slope of the likelihood over its expected curvature."""
    slope = (
        f"({n} / 2.0::double * ({_digamma(f'(({nu} + 1) / 2)')} - {_digamma(f'({nu} / 2)')} - 1 / {nu})"
        f" - {logs} / 2 + ({nu} + 1) / (2 * {nu}) * {pulls})"
    )
    curve = (
        f"({n} / 4.0::double * ({_trigamma(f'({nu} / 2)')} - {_trigamma(f'(({nu} + 1) / 2)')}"
        f" - 2 * ({nu} + 5) / ({nu} * ({nu} + 1) * ({nu} + 3))))"
    )
    return f"{nu} * exp(greatest(-1, least(1, {slope} / ({nu} * {curve}))))"


T_ROUNDS = 60


def _t_sql() -> str:
    """Reweighting rounds for one predictor with the degrees of freedom moved along."""
    parts = [
        MADE,
        "d AS MATERIALIZED (SELECT hours AS x, level AS y FROM made)",
        f"r0 AS MATERIALIZED (SELECT intercept AS a, slope AS b, rss / n AS s2, 4.0::double AS nu FROM ({one_line('x', 'y', 'd')}))",
    ]
    for i in range(1, T_ROUNDS + 1):
        parts.append(
            f"""w{i} AS MATERIALIZED (SELECT x, y, nu, dist, (nu + 1) / (nu + dist) AS w FROM (
    SELECT x, y, nu, (y - a - b * x) * (y - a - b * x) / s2 AS dist FROM d, r{i - 1}))""")
        parts.append(f"l{i} AS MATERIALIZED (SELECT count(*) AS n, any_value(nu) AS nu, sum(ln(1 + dist / nu)) AS logs, sum(dist / (nu + dist)) AS pulls FROM w{i})")
        parts.append(
            f"""r{i} AS MATERIALIZED (SELECT intercept AS a, slope AS b, rss / wn AS s2, {_nu_step('l.nu', 'l.n', 'logs', 'pulls')} AS nu
    FROM ({one_line('x', 'y', f'w{i}', 'w')}), l{i} l)""")
    return ", ".join(parts)


@query(
    "q_t_nu",
    f"""WITH {_t_sql()}
SELECT '(Intercept)' AS term, {sql_rnd('a', 4)} AS estimate FROM r{T_ROUNDS}
UNION ALL SELECT 'hours', {sql_rnd('b', 4)} FROM r{T_ROUNDS} UNION ALL SELECT 'sigma', {sql_rnd('sqrt(s2)', 4)} FROM r{T_ROUNDS}
UNION ALL SELECT 'nu', {sql_rnd('nu', 4)} FROM r{T_ROUNDS} UNION ALL SELECT 'converged', 1.0::double UNION ALL SELECT 'nu_bound', 0.0::double""",
)
def q_t_nu(t):
    fit = robust_t_fit(made(t), "level", ["hours"], nu=None)
    rows = [*zip(fit.terms, map(float, fit.coef)), ("sigma", fit.sigma), ("nu", fit.nu)]
    rows += [("converged", float(fit.converged)), ("nu_bound", float(fit.nu_bound))]
    return rounded(t.spark.createDataFrame(rows, "term string, estimate double"), estimate=4)


def _t_mixed_sql() -> str:
    """Row weights, then per-animal posteriors of a shift, then closed-form updates, in every round."""
    parts = [
        MADE,
        "c AS MATERIALIZED (SELECT avg(hours) AS xm, avg(level) AS ym, var_pop(level) AS yv FROM made)",
        "d AS MATERIALIZED (SELECT animal, hours - xm AS x, level - ym AS y FROM made, c)",
        "r0 AS MATERIALIZED (SELECT 0.0::double AS b0, 0.0::double AS b1, yv / 2 AS s2, yv / 2 AS t2, 4.0::double AS nu FROM c)",
        "p0 AS MATERIALIZED (SELECT DISTINCT animal, 0.0::double AS m, yv / 2 AS v FROM d, c)",
    ]
    for i in range(1, T_ROUNDS + 1):
        parts += [
            f"""g{i} AS MATERIALIZED (SELECT animal, count(*) AS n, sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS xx,
    sum(w * x * y) AS xy, sum(w * y * y) AS yy, sum(ln(1 + dist / nu)) AS logs, sum(dist / (nu + dist)) AS pulls FROM (
    SELECT *, (nu + 1) / (nu + dist) AS w FROM (SELECT animal, x, y, nu, ((y - b0 - b1 * x - m) * (y - b0 - b1 * x - m) + v) / s2 AS dist
      FROM d JOIN p{i - 1} USING (animal), r{i - 1})) GROUP BY animal)""",
            f"""k{i} AS MATERIALIZED (SELECT *, (a11 * k0 - a01 * k1) / (a00 * a11 - a01 * a01) AS b0, (a00 * k1 - a01 * k0) / (a00 * a11 - a01 * a01) AS b1 FROM (
    SELECT any_value(s2) AS s2, any_value(t2) AS t2, any_value(nu) AS nu, sum(n) AS n, sum(w) AS w, sum(logs) AS logs, sum(pulls) AS pulls,
      sum(w - h * w * w) AS a00, sum(sx - h * w * sx) AS a01, sum(xx - h * sx * sx) AS a11, sum(sy - h * w * sy) AS k0,
      sum(xy - h * sx * sy) AS k1, sum(yy - h * sy * sy) AS ky FROM (SELECT g.*, r.*, 1 / (s2 / t2 + w) AS h FROM g{i} g, r{i - 1} r)))""",
            f"q{i} AS MATERIALIZED (SELECT *, (ky - b0 * k0 - b1 * k1) / w AS new2 FROM k{i})",
            f"""p{i} AS MATERIALIZED (SELECT animal, g.n, (g.sy - g.w * b0 - g.sx * b1) / (q.s2 / q.t2 + g.w) AS m, new2 / (q.s2 / q.t2 + g.w) AS v
    FROM g{i} g, q{i} q)""",
            f"""r{i} AS MATERIALIZED (SELECT b0, b1, new2 AS s2, (SELECT avg(m * m + v) FROM p{i}) AS t2, {_nu_step('nu', 'n', 'logs', 'pulls')} AS nu FROM q{i})""",
        ]
    return ", ".join(parts)


@query(
    "q_t_mixed",
    f"""WITH {_t_mixed_sql()}
SELECT '(Intercept)' AS term, {sql_rnd('ym + b0 - xm * b1', 3)} AS estimate FROM r{T_ROUNDS}, c
UNION ALL SELECT 'hours', {sql_rnd('b1', 3)} FROM r{T_ROUNDS} UNION ALL SELECT 'sigma', {sql_rnd('sqrt(s2)', 3)} FROM r{T_ROUNDS}
UNION ALL SELECT 'sigma_group', {sql_rnd('sqrt(t2)', 3)} FROM r{T_ROUNDS} UNION ALL SELECT 'nu', {sql_rnd('nu', 3)} FROM r{T_ROUNDS}
UNION ALL SELECT 'converged', 1.0::double UNION ALL SELECT 'nu_bound', 0.0::double""",
)
def q_t_mixed(t):
    fit = student_mixed_fit(made(t), "level", ["hours"], "animal", tol=1e-7)
    rows = [*zip(fit.terms, map(float, fit.coef)), ("sigma", fit.sigma), ("sigma_group", fit.sigma_group), ("nu", fit.nu)]
    rows += [("converged", float(fit.converged)), ("nu_bound", float(fit.nu_bound))]
    return rounded(t.spark.createDataFrame(rows, "term string, estimate double"), estimate=3)


@query(
    "q_t_effects",
    f"WITH {_t_mixed_sql()} SELECT animal, n, {sql_rnd('m', 2)} AS effect, {sql_rnd('sqrt(v)', 3)} AS sd FROM p{T_ROUNDS}",
)
def q_t_effects(t):
    return rounded(student_effects(student_mixed_fit(made(t), "level", ["hours"], "animal", tol=1e-7)), effect=2, sd=3)


GAMMA_ROUNDS = 60


def _gamma_mixed_sql() -> str:
    """One-way gamma data: modes and parameters move together, parameters by scoring steps."""
    parts = [
        MADE,
        """g AS MATERIALIZED (SELECT animal, count(*) AS n, sum(strength) AS total, sum(ln(strength)) AS logs FROM made GROUP BY animal)""",
        """r0 AS MATERIALIZED (SELECT avg(ln(total / n)) AS b, 1.0::double AS nu, var_pop(ln(total / n)) AS t2, sum(n) AS n, sum(logs) AS logs FROM g)""",
        "u0 AS MATERIALIZED (SELECT animal, g.n, total, ln(total / g.n) - b AS u FROM g, r0)",
    ]
    for i in range(1, GAMMA_ROUNDS + 1):
        parts += [
            f"""u{i} AS MATERIALIZED (SELECT animal, n, total, u + (nu * (e - n) - u / t2) / (nu * e + 1 / t2) AS u FROM (
    SELECT u.*, nu, t2, total * exp(-b - u) AS e FROM u{i - 1} u, r{i - 1}))""",
            f"""s{i} AS MATERIALIZED (SELECT sum(ve * (1 + 1 / (2 * t2 * k * k)) - nu * n) AS gb, sum(u * u / (2 * t2) - ve / k / 2 * (1 - u / (t2 * k))) AS gt,
    sum(-nu * (e + n * u) - ve / k / 2 * (1 - (ve - nu * n) / k)) AS gn, sum(ve / (1 + t2 * ve)) AS ib, sum(pow(t2 * ve / (1 + t2 * ve), 2)) / 2 AS it,
    sum(-nu * (e + n * u) - u * u / (2 * t2) - ln(t2 * k) / 2) AS part FROM (SELECT *, nu * e AS ve, nu * e + 1 / t2 AS k FROM (
      SELECT u.n, u, nu, t2, total * exp(-b - u) AS e FROM u{i} u, r{i - 1})))""",
            f"""r{i} AS MATERIALIZED (SELECT b + gb / ib AS b, t2 * exp(greatest(-1, least(1, gt / it))) AS t2, n, logs,
    nu * exp(greatest(-1, least(1, (gn + nu * (-n * b + n * (ln(nu) + 1 - {_digamma('nu')}) + logs)) / (n * nu * nu * ({_trigamma('nu')} - 1 / nu))))) AS nu,
    part - nu * n * b + n * (nu * ln(nu) - lgamma(nu)) + (nu - 1) * logs AS loglik FROM r{i - 1}, s{i})""",
        ]
    return ", ".join(parts)


@query(
    "q_gamma_mixed",
    f"""WITH {_gamma_mixed_sql()}
SELECT '(Intercept)' AS term, {sql_rnd('b', 5)} AS estimate FROM r{GAMMA_ROUNDS} UNION ALL SELECT 'shape', {sql_rnd('nu', 5)} FROM r{GAMMA_ROUNDS}
UNION ALL SELECT 'sigma_group', {sql_rnd('sqrt(t2)', 5)} FROM r{GAMMA_ROUNDS} UNION ALL SELECT 'loglik', {sql_rnd('loglik', 3)} FROM r{GAMMA_ROUNDS}
UNION ALL SELECT 'converged', 1.0::double""",
)
def q_gamma_mixed(t):
    fit = gamma_mixed_fit(made(t), "strength", [], "animal")
    rows = [("(Intercept)", float(fit.coef[0])), ("shape", fit.shape), ("sigma_group", fit.sigma_group), ("converged", float(fit.converged))]
    table = rounded(t.spark.createDataFrame(rows, "term string, estimate double"), estimate=5)
    value = t.spark.createDataFrame([("loglik", fit.loglik)], table.schema)
    return table.unionByName(rounded(value, estimate=3))


@query(
    "q_gamma_effects",
    f"""WITH {_gamma_mixed_sql()}
SELECT animal, u.n, {sql_rnd('u', 5)} AS effect, {sql_rnd('1 / sqrt(nu * total * exp(-b - u) + 1 / t2)', 5)} AS sd FROM u{GAMMA_ROUNDS} u, r{GAMMA_ROUNDS}""",
)
def q_gamma_effects(t):
    return rounded(gamma_effects(gamma_mixed_fit(made(t), "strength", [], "animal")), effect=5, sd=5)


SLOPE_ROUNDS = 50


def _slopes_sql() -> str:
    """Expectation-maximisation for an intercept and one slope by animal, in 2 x 2 algebra."""
    parts = [
        MADE,
        "c AS MATERIALIZED (SELECT avg(lat) AS xm, avg(sloped) AS ym FROM made)",
        "z AS (SELECT animal, lat - xm AS x, sloped - ym AS y FROM made, c)",
        """g AS MATERIALIZED (SELECT animal, count(*) AS n, sum(x) AS sx, sum(x * x) AS xx, sum(y) AS sy, sum(x * y) AS xy, sum(y * y) AS yy FROM z GROUP BY animal)""",
        "r0 AS MATERIALIZED (SELECT 0.1::double AS d00, 0.0::double AS d01, 0.001::double AS d11)",
    ]
    for i in range(1, SLOPE_ROUNDS + 1):
        parts += [
            # a: inverse of (inverse of D + cross-products), h: a times cross-products, q: a times right side.
            f"""a{i} AS MATERIALIZED (SELECT animal, n, sx, xx, sy, xy, yy, p11 / pd AS a00, -p01 / pd AS a01, p00 / pd AS a11 FROM (
    SELECT *, p00 * p11 - p01 * p01 AS pd FROM (SELECT g.*, d11 / dd + n AS p00, -d01 / dd + sx AS p01, d00 / dd + xx AS p11
      FROM g, (SELECT *, d00 * d11 - d01 * d01 AS dd FROM r{i - 1}))))""",
            f"""h{i} AS MATERIALIZED (SELECT *, a00 * n + a01 * sx AS h00, a00 * sx + a01 * xx AS h01, a01 * n + a11 * sx AS h10, a01 * sx + a11 * xx AS h11,
    a00 * sy + a01 * xy AS q0, a01 * sy + a11 * xy AS q1 FROM a{i})""",
            f"""k{i} AS MATERIALIZED (SELECT *, (k11 * k0 - k01 * k1) / kd AS b0, (k00 * k1 - k01 * k0) / kd AS b1, k11 / kd AS c00, -k01 / kd AS c01, k00 / kd AS c11 FROM (
    SELECT *, k00 * k11 - k01 * k01 AS kd FROM (SELECT count(*) AS m, sum(n) AS n, sum(n - n * h00 - sx * h10) AS k00, sum(sx - n * h01 - sx * h11) AS k01,
      sum(xx - sx * h01 - xx * h11) AS k11, sum(sy - n * q0 - sx * q1) AS k0, sum(xy - sx * q0 - xx * q1) AS k1, sum(yy - sy * q0 - xy * q1) AS ky FROM h{i})))""",
            f"t{i} AS MATERIALIZED (SELECT *, (ky - b0 * k0 - b1 * k1) / (n - 2) AS s2 FROM k{i})",
            f"""r{i} AS MATERIALIZED (SELECT avg(u0 * u0 / s2 + a00 + h00 * (c00 * h00 + c01 * h01) + h01 * (c01 * h00 + c11 * h01)) AS d00,
    avg(u0 * u1 / s2 + a01 + h00 * (c00 * h10 + c01 * h11) + h01 * (c01 * h10 + c11 * h11)) AS d01,
    avg(u1 * u1 / s2 + a11 + h10 * (c00 * h10 + c01 * h11) + h11 * (c01 * h10 + c11 * h11)) AS d11
    FROM (SELECT h.*, t.s2, t.c00, t.c01, t.c11, q0 - h00 * b0 - h01 * b1 AS u0, q1 - h10 * b0 - h11 * b1 AS u1 FROM h{i} h, t{i} t))""",
        ]
    return ", ".join(parts)


SLOPES, LAST = _slopes_sql(), SLOPE_ROUNDS


def slopes(t):
    return random_slopes_fit(made(t), "sloped", ["lat"], ["lat"], "animal", max_rounds=300, tol=1e-9)


@query(
    "q_random_slopes",
    f"""WITH {SLOPES}
SELECT '(Intercept)' AS term, {sql_rnd('ym + b0 - xm * b1', 4)} AS estimate, {sql_rnd('sqrt(s2 * (c00 - 2 * xm * c01 + xm * xm * c11))', 4)} AS std_error FROM t{LAST}, c
UNION ALL SELECT 'lat', {sql_rnd('b1', 4)}, {sql_rnd('sqrt(s2 * c11)', 4)} FROM t{LAST}
UNION ALL SELECT 'sigma', {sql_rnd('sqrt(s2)', 4)}, NULL FROM t{LAST}
UNION ALL SELECT 'sd_slope', {sql_rnd('sqrt(s2 * d11)', 4)}, NULL FROM t{LAST}, r{LAST}
UNION ALL SELECT 'sd_at_45', {sql_rnd('sqrt(s2 * (d00 + 2 * (45 - xm) * d01 + (45 - xm) * (45 - xm) * d11))', 4)}, NULL FROM t{LAST}, r{LAST}, c
UNION ALL SELECT 'converged', 1.0::double, NULL""",
)
def q_random_slopes(t):
    fit = slopes(t)
    rows = [(n, float(b), float(s)) for n, b, s in zip(fit.terms, fit.coef, fit.std_error)]
    v = fit.group_cov
    rows += [("sigma", fit.sigma2**0.5, None), ("sd_slope", float(v[1, 1] ** 0.5), None)]
    rows += [("sd_at_45", float((v[0, 0] + 90 * v[0, 1] + 45 * 45 * v[1, 1]) ** 0.5), None), ("converged", float(fit.converged), None)]
    return rounded(t.spark.createDataFrame(rows, "term string, estimate double, std_error double"), estimate=4, std_error=4)


@query(
    "q_predict_slopes",
    f"""WITH {SLOPES},
grid AS (SELECT animal, l::double AS lat FROM (SELECT DISTINCT animal FROM fixes UNION ALL SELECT -1) CROSS JOIN (VALUES (30), (45), (60)) v(l)),
own AS (SELECT grid.animal, grid.lat, grid.lat - xm AS x, b0, b1, s2, c00, c01, c11, ym, coalesce(a00, 0) AS a00, coalesce(a01, 0) AS a01, coalesce(a11, 0) AS a11,
  coalesce(h00, 0) AS h00, coalesce(h01, 0) AS h01, coalesce(h10, 0) AS h10, coalesce(h11, 0) AS h11, coalesce(q0, 0) AS q0, coalesce(q1, 0) AS q1
  FROM grid CROSS JOIN c CROSS JOIN t{LAST} t LEFT JOIN h{LAST} h ON h.animal = grid.animal),
left_over AS (SELECT *, 1 - h00 - x * h10 AS e0, x - h01 - x * h11 AS e1 FROM own)
SELECT animal, lat, {sql_rnd('ym + b0 + b1 * x + q0 - h00 * b0 - h01 * b1 + x * (q1 - h10 * b0 - h11 * b1)', 3)} AS fit,
  {sql_rnd('sqrt(s2 * (c00 * e0 * e0 + 2 * c01 * e0 * e1 + c11 * e1 * e1 + a00 + 2 * x * a01 + x * x * a11))', 4)} AS se FROM left_over""",
)
def q_predict_slopes(t):
    animals = t.fixes().select("animal").distinct()
    unknown = animals.limit(1).select(F.lit(-1).cast(animals.schema["animal"].dataType).alias("animal"))
    grid = expand_grid(animals.union(unknown), {"lat": [30.0, 45.0, 60.0]})
    return rounded(predict_conditional(grid, slopes_conditional(slopes(t))).select("animal", "lat", "fit", "se"), fit=3, se=4)
