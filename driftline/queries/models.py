"""Regressions, mixed models, bootstrap and residual checks.

The SQL side solves the same normal equations in closed form for one or two
predictors and follows the same search grids, so fits are compared exactly.
"""

from pyspark.sql import functions as F

from driftline.functions import scalars as sc
from driftline.functions.distributions import chi2_tail
from driftline.operators import diagnostics as dg
from driftline.operators.glm import gamma_glm, robust_t_fit
from driftline.operators.grids import dummies, expand_grid, levels
from driftline.operators.linear import (
    breusch_pagan,
    coef_table,
    fit_summary,
    line_band,
    line_by_group,
    ols_fit,
    predict_band,
    with_residuals,
)
from driftline.operators.mixed import (
    RATIO_HIGH,
    RATIO_LOW,
    RATIO_STEPS,
    SECANT_SPAN,
    SECANT_STEPS,
    bootstrap_se,
    cluster_bootstrap,
    group_effects,
    predict_by_group,
    random_intercept_fit,
)
from driftline.queries.registry import FIXES, query, rnd, rounded, sql_rnd
from driftline.queries.tails import sql_chi2_tail, sql_t_quantiles, sql_t_tail

# Hours since the first day: the time predictor of the event models.
START_MICROS = 1704067200000000
HOURS = f"""{FIXES},
timed AS (SELECT *, (micros - {START_MICROS}) / 3600000000.0::double AS hours FROM fixes)"""


def timed(t):
    return t.fixes().withColumn("hours", (F.col("micros") - START_MICROS) / 3600000000.0)


def one_line(x: str, y: str, source: str, weight: str = "1") -> str:
    """Weighted straight line: CTE body with n, means, slope, intercept, sxx, rss."""
    return f"""SELECT *, slope_sxy / sxx AS slope, ym - slope_sxy / sxx * xm AS intercept,
  syy - slope_sxy * slope_sxy / sxx AS rss FROM (
    SELECT count(*) AS n, sum({weight}) AS wn, any_value(xm) AS xm, any_value(ym) AS ym, sum({weight} * ({x} - xm) * ({x} - xm)) AS sxx,
      sum({weight} * ({x} - xm) * ({y} - ym)) AS slope_sxy, sum({weight} * ({y} - ym) * ({y} - ym)) AS syy
    FROM {source}, (SELECT sum({weight} * {x}) / sum({weight}) AS xm, sum({weight} * {y}) / sum({weight}) AS ym FROM {source}))"""


@query(
    "q_line_by_group",
    f"""WITH {HOURS}, lines AS MATERIALIZED (
  SELECT animal, regr_count(value, hours)::bigint AS n, regr_slope(value, hours) AS slope,
    regr_intercept(value, hours) AS intercept, regr_r2(value, hours) AS r2, regr_avgx(value, hours) AS x_mean,
    regr_sxx(value, hours) AS sxx,
    CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy(value, hours)
      - regr_sxy(value, hours) * regr_sxy(value, hours) / nullif(regr_sxx(value, hours), 0), 0) / (count(*) - 2)) END AS sigma
  FROM timed GROUP BY animal),
{', '.join(sql_t_quantiles('lines', '(n - 2)', 0.05))},
placed AS (SELECT lines.*, t, intercept + slope * 360 AS fit,
    sigma * sqrt(1.0::double / n + (360 - x_mean) * (360 - x_mean) / nullif(sxx, 0)) AS se FROM lines LEFT JOIN quantiles ON nu = n - 2)
SELECT animal, n, {sql_rnd('slope')} AS slope, {sql_rnd('intercept')} AS intercept, {sql_rnd('r2')} AS r2,
  {sql_rnd('x_mean')} AS x_mean, {sql_rnd('sxx', 3)} AS sxx, {sql_rnd('sigma')} AS sigma, {sql_rnd('fit')} AS fit, {sql_rnd('se')} AS se,
  {sql_rnd('fit - t * se', 5)} AS lower, {sql_rnd('fit + t * se', 5)} AS upper FROM placed""",
)
def q_line_by_group(t):
    lines = line_band(line_by_group(timed(t), ["animal"], "value", "hours"), F.lit(360.0))
    return rounded(lines, slope=6, intercept=6, r2=6, x_mean=6, sxx=3, sigma=6, fit=6, se=6, lower=5, upper=5)


TWO = """
sums AS (SELECT count(*) AS n, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, var_pop(x1) * count(*) AS s11,
  var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y,
  covar_pop(x2, y) * count(*) AS s2y, var_pop(y) * count(*) AS syy FROM d),
slopes AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM sums),
fit AS (SELECT *, ay - b1 * a1 - b2 * a2 AS b0, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM slopes),
coefs AS (
  SELECT '(Intercept)' AS term, b0 AS b, sqrt(s2 * (1.0::double / n + (a1 * a1 * s22 + a2 * a2 * s11 - 2 * a1 * a2 * s12) / det)) AS se FROM fit
  UNION ALL SELECT 'l_quantity', b1, sqrt(s2 * s22 / det) FROM fit
  UNION ALL SELECT 'l_tax', b2, sqrt(s2 * s11 / det) FROM fit)"""
ITEMS = "d AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity AS x1, l_tax AS x2 FROM lineitem)"
PREDICTORS = ["l_quantity", "l_tax"]


@query(
    "q_ols",
    f"""WITH {ITEMS}, {TWO}
SELECT term, {sql_rnd('b', 4)} AS estimate, {sql_rnd('se', 4)} AS std_error, {sql_rnd('b / se', 4)} AS t_value,
  {sql_rnd(sql_t_tail('(b / se)', 'nu'))} AS p_value FROM coefs, (SELECT count(*) - 3 AS nu FROM d)""",
)
def q_ols(t):
    fit = ols_fit(t.lineitem, "l_extendedprice", PREDICTORS)
    return rounded(coef_table(t.spark, fit, p_value=True), estimate=4, std_error=4, t_value=4, p_value=6)


@query(
    "q_ols_aliased",
    f"""WITH {ITEMS}, {TWO}
SELECT term, {sql_rnd('b', 4)} AS estimate, {sql_rnd('se', 4)} AS std_error, {sql_rnd('b / se', 4)} AS t_value FROM coefs
UNION ALL VALUES ('doubled', NULL, NULL, NULL), ('same', NULL, NULL, NULL), ('both', NULL, NULL, NULL)""",
)
def q_ols_aliased(t):
    rows = t.lineitem.withColumns({
        "doubled": 2 * F.col("l_quantity") + 1, "same": F.lit(7.0), "both": F.col("l_quantity") - 3 * F.col("l_tax")})
    fit = ols_fit(rows, "l_extendedprice", ["l_quantity", "doubled", "same", "l_tax", "both"])
    return rounded(coef_table(t.spark, fit), estimate=4, std_error=4, t_value=4)


@query(
    "q_ols_summary",
    f"""WITH {ITEMS}, {TWO}
SELECT n, 2 AS predictors, {sql_rnd('sqrt(s2)', 4)} AS sigma, {sql_rnd('1 - s2 * (n - 3) / syy')} AS r2 FROM fit""",
)
def q_ols_summary(t):
    fit = ols_fit(t.lineitem, "l_extendedprice", PREDICTORS)
    return rounded(fit_summary(t.spark, fit), sigma=4, r2=6)


@query(
    "q_residuals",
    f"""WITH {ITEMS}, {TWO}
SELECT l_orderkey, l_linenumber, {sql_rnd('b0 + b1 * x1 + b2 * x2', 4)} AS fitted,
  {sql_rnd('y - (b0 + b1 * x1 + b2 * x2)', 4)} AS residual FROM d, fit""",
)
def q_residuals(t):
    fit = ols_fit(t.lineitem, "l_extendedprice", PREDICTORS)
    rows = with_residuals(t.lineitem, fit).select("l_orderkey", "l_linenumber", "fitted", "residual")
    return rounded(rows, fitted=4, residual=4)


@query(
    "q_ols_states",
    f"""WITH {FIXES}, d AS (SELECT kind, ln(value + 1) AS y FROM fixes),
m AS (SELECT kind, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM d GROUP BY kind),
p AS (SELECT sum(n * v) / (sum(n) - count(*)) AS s2 FROM m), base AS (SELECT n, m FROM m WHERE kind = 'click'),
coefs AS (SELECT '(Intercept)' AS term, base.m AS b, sqrt(s2 / base.n) AS se FROM base, p
  UNION ALL SELECT 'kind_' || kind, m.m - base.m, sqrt(s2 * (1.0::double / m.n + 1.0::double / base.n)) FROM m, base, p WHERE kind <> 'click')
SELECT term, {sql_rnd('b')} AS estimate, {sql_rnd('se')} AS std_error, {sql_rnd('b / se', 4)} AS t_value,
  {sql_rnd('exp(b)')} AS response_scale FROM coefs""",
)
def q_ols_states(t):
    rows = t.fixes().withColumn("log_value", F.ln(F.col("value") + 1))
    coded, names = dummies(rows, "kind", levels(rows, "kind"))
    table = coef_table(t.spark, ols_fit(coded, "log_value", names), exp=True)
    return rounded(table, estimate=6, std_error=6, t_value=4, response_scale=6)


BAND_FIT = f"d AS (SELECT ln(value + 1) AS y, hours AS x FROM timed), line AS ({one_line('x', 'y', 'd')})"


@query(
    "q_predict_band",
    f"""WITH {HOURS}, {BAND_FIT},
g AS (SELECT DISTINCT day, ((day - date '2024-01-01') * 24)::double AS hours FROM timed),
p AS (SELECT day, intercept + slope * hours AS link,
  sqrt(rss / (n - 2) * (1.0::double / n + (hours - xm) * (hours - xm) / sxx)) AS se FROM g, line)
SELECT day, {sql_rnd('link')} AS link, {sql_rnd('se')} AS se, {sql_rnd('exp(link)')} AS mean,
  {sql_rnd('exp(link - se)')} AS lower, {sql_rnd('exp(link + se)')} AS upper FROM p""",
)
def q_predict_band(t):
    rows = timed(t).withColumn("log_value", F.ln(F.col("value") + 1))
    fit = ols_fit(rows, "log_value", ["hours"])
    start = F.lit("2024-01-01").cast("date")
    grid = rows.select("day").distinct().withColumn("hours", (F.datediff("day", start) * 24).cast("double"))
    band = predict_band(grid, fit).drop("hours")
    return rounded(band, link=6, se=6, mean=6, lower=6, upper=6)


@query(
    "q_bp",
    f"""WITH {ITEMS}, line AS ({one_line('x1', 'y', 'd')}),
e AS (SELECT x1, (y - intercept - slope * x1) * (y - intercept - slope * x1) AS e2 FROM d, line)
SELECT count(*) AS n, 1 AS df, {sql_rnd('count(*) * regr_r2(e2, x1)')} AS statistic,
  {sql_rnd(sql_chi2_tail('(count(*) * regr_r2(e2, x1))', '1'))} AS p_value FROM e""",
)
def q_bp(t):
    test = breusch_pagan(t.lineitem, "l_extendedprice", ["l_quantity"])
    row = (int(test["n"]), int(test["df"]), float(test["statistic"]))
    table = t.spark.createDataFrame([row], "n bigint, df int, statistic double")
    return rounded(table.withColumn("p_value", chi2_tail(F.col("statistic"), F.col("df"))), statistic=6, p_value=6)


RESIDUALS = f"""{HOURS}, line AS (SELECT regr_slope(value, hours) AS b, regr_intercept(value, hours) AS a FROM timed),
res AS (SELECT animal, kind, fix_id, ts, value - a - b * hours AS residual FROM timed, line)"""


def residuals(t):
    rows = timed(t)
    return with_residuals(rows, ols_fit(rows, "value", ["hours"]))


def by_time():
    return [F.col("ts").asc(), F.col("fix_id").asc()]


@query(
    "q_dw",
    f"""WITH {RESIDUALS}, s AS (SELECT animal, residual, residual - lag(residual) OVER (PARTITION BY animal ORDER BY ts, fix_id) AS step FROM res)
SELECT animal, count(residual) AS n, {sql_rnd('sum(step * step) / nullif(sum(residual * residual), 0)')} AS dw FROM s GROUP BY animal""",
)
def q_dw(t):
    return rounded(dg.durbin_watson(residuals(t), ["animal"], by_time(), "residual"), dw=6)


def _acf(source: str, keys: str, lags: int) -> str:
    over = f"OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY ts, fix_id)"
    shifted = ", ".join(f"lag(residual, {k}) {over} AS l{k}" for k in range(1, lags + 1))
    mean = f"avg(residual) OVER ({'PARTITION BY ' + keys if keys else ''})"
    head = f"{keys}, " if keys else ""
    tail = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"""SELECT {head}count(*) AS n, {k}::bigint AS lag, sum((residual - m) * (l{k} - m)) / sum((residual - m) * (residual - m)) AS acf
  FROM (SELECT *, {mean} AS m, {shifted} FROM {source}){tail}"""
        for k in range(1, lags + 1)
    )


@query("q_acf", f"WITH {RESIDUALS}, a AS ({_acf('res', 'kind', 4)}) SELECT kind, n, lag, {sql_rnd('acf')} AS acf FROM a")
def q_acf(t):
    return rounded(dg.autocorrelation(residuals(t), ["kind"], by_time(), "residual", 4), acf=6)


@query(
    "q_pacf",
    f"""WITH {RESIDUALS}, a AS ({_acf('res', '', 3)}),
r AS (SELECT max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2, max(acf) FILTER (lag = 3) AS r3 FROM a)
SELECT 1::bigint AS lag, {sql_rnd('r1')} AS pacf FROM r
UNION ALL SELECT 2, {sql_rnd('(r2 - r1 * r1) / (1 - r1 * r1)')} FROM r
UNION ALL SELECT 3, {sql_rnd('(r1*r1*r1 - 2*r1*r2 + r1*r2*r2 + r3 - r1*r1*r3) / (1 - 2*r1*r1 + 2*r1*r1*r2 - r2*r2)')} FROM r""",
)
def q_pacf(t):
    values = dg.pacf(residuals(t), by_time(), "residual", 3)
    rows = [(i, float(v)) for i, v in enumerate(values, start=1)]
    return rounded(t.spark.createDataFrame(rows, "lag bigint, pacf double"), pacf=6)


def _sql_polynomial(coefficients, x: str) -> str:
    text = f"{coefficients[-1]!r}::double"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}::double)"
    return text


def sql_normal_quantile(p: str) -> str:
    q, depth = f"({p} - 0.5::double)", f"sqrt(-ln(least({p}, 1 - {p})))"
    r, m, t = f"({sc.CENTRE_SHIFT!r}::double - {q} * {q})", f"({depth} - 1.6::double)", f"({depth} - 5)"
    return f"""CASE WHEN abs({q}) <= 0.425::double THEN {q} * {_sql_polynomial(sc.CENTRE_NUM, r)} / {_sql_polynomial(sc.CENTRE_DEN, r)}
  WHEN {depth} <= 5 THEN sign({q}) * {_sql_polynomial(sc.MIDDLE_NUM, m)} / {_sql_polynomial(sc.MIDDLE_DEN, m)}
  ELSE sign({q}) * {_sql_polynomial(sc.TAIL_NUM, t)} / {_sql_polynomial(sc.TAIL_DEN, t)} END"""


@query(
    "q_qq",
    f"""WITH {FIXES}, o AS (SELECT kind, fix_id, value, row_number() OVER (PARTITION BY kind ORDER BY value, fix_id) AS rank,
    count(*) OVER (PARTITION BY kind) AS n FROM fixes),
p AS (SELECT *, (rank - 0.5::double) / n AS p FROM o)
SELECT kind, fix_id, value, rank, {sql_rnd(sql_normal_quantile('p'))} AS theoretical FROM p""",
)
def q_qq(t):
    pairs = dg.qq_pairs(t.fixes(), ["kind"], "value", ["fix_id"])
    return rounded(pairs.select("kind", "fix_id", "value", "rank", "theoretical"), theoretical=6)


@query(
    "q_qq_line",
    f"""WITH {FIXES}, q AS (SELECT kind, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM fixes GROUP BY kind),
z AS (SELECT {sql_normal_quantile('0.75::double')} AS z)
SELECT kind, {sql_rnd('q1')} AS q1, {sql_rnd('q3')} AS q3, {sql_rnd('(q3 - q1) / (2 * z)')} AS slope,
  {sql_rnd('q1 + (q3 - q1) / (2 * z) * z')} AS intercept FROM q, z""",
)
def q_qq_line(t):
    return rounded(dg.qq_line(t.fixes(), ["kind"], "value"), q1=6, q3=6, slope=6, intercept=6)


@query(
    "q_jb",
    f"""WITH {FIXES}, c AS (SELECT kind, value - avg(value) OVER (PARTITION BY kind) AS d FROM fixes),
m AS (SELECT kind, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY kind),
s AS (SELECT kind, n, m3 / pow(m2, 1.5::double) AS s, m4 / (m2 * m2) - 3 AS k FROM m)
SELECT kind, n, {sql_rnd('s')} AS skewness, {sql_rnd('k')} AS kurtosis, {sql_rnd('n / 6.0::double * (s * s + k * k / 4)', 4)} AS jb FROM s""",
)
def q_jb(t):
    return rounded(dg.jarque_bera(t.fixes(), ["kind"], "value"), skewness=6, kurtosis=6, jb=4)


# Daily means are near enough to normal for a probability worth comparing.
@query(
    "q_shapiro",
    f"""WITH {FIXES}, d AS (SELECT kind, day, avg(value) AS x FROM fixes GROUP BY kind, day),
o AS (SELECT kind, x, row_number() OVER (PARTITION BY kind ORDER BY x) AS rank, count(*) OVER (PARTITION BY kind) AS n FROM d),
m AS (SELECT *, {sql_normal_quantile('p')} AS m FROM (SELECT *, (rank - 0.375::double) / (n + 0.25::double) AS p FROM o)),
s AS (SELECT kind, any_value(n) AS n, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (rank = n - 1) AS m2, 1 / sqrt(any_value(n)) AS u FROM m GROUP BY kind),
a AS (SELECT *, {_sql_polynomial(dg.OUTER_WEIGHT, 'u')} + m1 / sqrt(mm) AS a1, {_sql_polynomial(dg.NEXT_WEIGHT, 'u')} + m2 / sqrt(mm) AS a2 FROM s),
c AS (SELECT m.kind, x, CASE WHEN rank = 1 THEN -a1 WHEN rank = m.n THEN a1 WHEN rank = 2 THEN -a2 WHEN rank = m.n - 1 THEN a2
    ELSE m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a FROM m JOIN a ON a.kind = m.kind),
w AS (SELECT kind, count(*) AS n, sum(a * x) * sum(a * x) / (var_pop(x) * count(*)) AS w FROM c GROUP BY kind),
z AS (SELECT *, (ln(1 - w) - {_sql_polynomial(dg.LARGE_MEAN, 'ln(n)')}) / exp({_sql_polynomial(dg.LARGE_SPREAD, 'ln(n)')}) AS z FROM w)
SELECT kind, n, {sql_rnd('w')} AS w, {sql_rnd(f"CASE WHEN z >= 0 THEN {sql_chi2_tail('(z * z)', '1')} / 2 ELSE 1 - {sql_chi2_tail('(z * z)', '1')} / 2 END")} AS p_value FROM z""",
)
def q_shapiro(t):
    means = t.fixes().groupBy("kind", "day").agg(F.avg("value").alias("x"))
    return rounded(dg.shapiro_wilk(means, ["kind"], "x"), w=6, p_value=6)


@query(
    "q_kde",
    f"""WITH f AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
    quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
w AS (SELECT *, 0.9::double * least(sd, iqr / 1.34::double) * pow(n, -0.2::double) AS h FROM f),
g AS (SELECT *, lo - 7 * h AS low, (hi + 7 * h - (lo - 7 * h)) / 1023 AS step, lo - 3 * h AS start,
    (hi + 3 * h - (lo - 3 * h)) / 511 AS stride FROM w),
placed AS (SELECT (value - low) / step AS place FROM events, g),
mass AS (SELECT bin, sum(w) AS w FROM (SELECT floor(place) AS bin, 1 - (place - floor(place)) AS w FROM placed
    UNION ALL SELECT floor(place) + 1, place - floor(place) FROM placed) GROUP BY bin)
SELECT p.point::bigint AS point, {sql_rnd('any_value(start + p.point * stride)')} AS x,
  {sql_rnd('''sum(w / n * exp(-((start + p.point * stride - low - bin * step) / h) * ((start + p.point * stride - low - bin * step) / h) / 2)
    / (h * sqrt(2 * pi())))''', 9)} AS density
FROM mass, g, generate_series(0, 511) p(point) GROUP BY p.point""",
)
def q_kde(t):
    return rounded(dg.kde(t.events, "value"), x=6, density=9)


def _reml_sql() -> str:
    """The same grid search as the fit, for one predictor, one CTE per grid."""
    parts = [
        HOURS,
        "c AS (SELECT avg(hours) AS xm, avg(value) AS ym FROM timed)",
        "z AS (SELECT animal, hours - xm AS x, value - ym AS y FROM timed, c)",
        "tot AS (SELECT count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM z)",
        "grp AS (SELECT animal, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM z GROUP BY animal)",
    ]

    def scored(name: str, source: str) -> list[str]:
        return [
            f"""{name}_s AS (SELECT v, any_value(t) AS t, sum(ln(1 + n * t)) AS logs, sum(t / (1 + n * t) * n * n) AS r00, sum(t / (1 + n * t) * n * sx) AS r01,
    sum(t / (1 + n * t) * n * sy) AS r0y, sum(t / (1 + n * t) * sx * sx) AS r11, sum(t / (1 + n * t) * sx * sy) AS r1y,
    sum(t / (1 + n * t) * sy * sy) AS ryy, sum(n / (1 + n * t)) AS q, sum(n * n / ((1 + n * t) * (1 + n * t))) AS d00,
    sum(n * sx / ((1 + n * t) * (1 + n * t))) AS d01, sum(n * sy / ((1 + n * t) * (1 + n * t))) AS d0y, sum(sx * sx / ((1 + n * t) * (1 + n * t))) AS d11,
    sum(sx * sy / ((1 + n * t) * (1 + n * t))) AS d1y, sum(sy * sy / ((1 + n * t) * (1 + n * t))) AS dyy FROM grp, {source} GROUP BY v)""",
            f"""{name}_g AS (SELECT v, t, logs, q, d00, d01, d0y, d11, d1y, dyy, n - r00 AS g00, -r01 AS g01, -r0y AS g0y, xx - r11 AS g11, xy - r1y AS g1y,
    yy - ryy AS gyy, n FROM {name}_s, tot)""",
            f"""{name}_b AS (SELECT *, (g11 * g0y - g01 * g1y) / (g00 * g11 - g01 * g01) AS b0,
    (g00 * g1y - g01 * g0y) / (g00 * g11 - g01 * g01) AS b1 FROM {name}_g)""",
            f"""{name} AS MATERIALIZED (SELECT *, gyy - b0 * g0y - b1 * g1y AS rss,
    t * (q - (n - 2) * (dyy - 2 * b0 * d0y - 2 * b1 * d1y + b0 * b0 * d00 + 2 * b0 * b1 * d01 + b1 * b1 * d11) / (gyy - b0 * g0y - b1 * g1y)
      - (g11 * d00 - 2 * g01 * d01 + g00 * d11) / (g00 * g11 - g01 * g01)) AS slope,
    (n - 2) * ln((gyy - b0 * g0y - b1 * g1y) / (n - 2)) + logs + ln(g00 * g11 - g01 * g01) AS score FROM {name}_b)""",
        ]

    low, high = f"{RATIO_LOW!r}::double", f"{RATIO_HIGH!r}::double"
    for i, step in enumerate(RATIO_STEPS):
        count = f"round(({high} - {low}) / {step!r}::double)::int"
        parts.append(
            f"""v{i} AS MATERIALIZED (SELECT v, pow(10.0::double, v) AS t FROM (SELECT {low} + {step!r}::double * unnest(generate_series(0, {count})) AS v))"""
            if i == 0
            else f"""v{i} AS MATERIALIZED (SELECT v, pow(10.0::double, v) AS t FROM (SELECT lo + {step!r}::double * unnest(generate_series(0, round((hi - lo) / {step!r}::double)::int)) AS v FROM best{i - 1}))"""
        )
        parts += scored(f"l{i}", f"v{i}")
        parts.append(
            f"""best{i} AS MATERIALIZED (SELECT lo, hi, v, sa, score AS sb, sc FROM (SELECT v, score, coalesce(lag(v) OVER w, v) AS lo,
    coalesce(lead(v) OVER w, v) AS hi, lag(score) OVER w AS sa, lead(score) OVER w AS sc FROM l{i} WINDOW w AS (ORDER BY v))
    ORDER BY score LIMIT 1)"""
        )
    last = len(RATIO_STEPS) - 1
    # Secant steps to where the slope vanishes; on an end of the grid the ratio stays.
    parts.append(f"p0 AS MATERIALIZED (SELECT v, pow(10.0::double, v) AS t, sa IS NOT NULL AND sc IS NOT NULL AS inside, lo, hi FROM best{last})")
    parts.append(f"p1 AS MATERIALIZED (SELECT v + {SECANT_SPAN!r}::double AS v, pow(10.0::double, v + {SECANT_SPAN!r}::double) AS t FROM p0)")
    for i in range(SECANT_STEPS + 1):
        parts += scored(f"e{i}", f"p{i}")
        if i:
            step = "b.v - CASE WHEN b.slope = a.slope THEN 0 ELSE b.slope * (b.v - a.v) / (b.slope - a.slope) END"
            parts.append(f"""p{i + 1} AS MATERIALIZED (SELECT v, pow(10.0::double, v) AS t FROM (
    SELECT CASE WHEN p0.inside THEN greatest(least({step}, p0.hi), p0.lo) ELSE p0.v END AS v FROM e{i - 1} a, e{i} b, p0))""")
    parts.append(f"peak AS (SELECT v, t FROM p{SECANT_STEPS + 1} UNION ALL SELECT -99, 0.0::double)")
    parts += scored("ends", "peak")
    parts.append("fin AS MATERIALIZED (SELECT *, rss / (n - 2) AS s2, g00 * g11 - g01 * g01 AS det FROM ends ORDER BY score, t LIMIT 1)")
    return ", ".join(parts)


REML = _reml_sql()


def reml(t):
    return random_intercept_fit(timed(t), "value", ["hours"], "animal")


@query(
    "q_reml",
    f"""WITH {REML}
SELECT '(Intercept)' AS term, {sql_rnd('ym + b0 - xm * b1', 5)} AS estimate,
  {sql_rnd('sqrt(s2 * (g11 + 2 * xm * g01 + xm * xm * g00) / det)', 5)} AS std_error FROM fin, c
UNION ALL SELECT 'hours', {sql_rnd('b1', 5)}, {sql_rnd('sqrt(s2 * g00 / det)', 5)} FROM fin
UNION ALL SELECT 'sigma', {sql_rnd('sqrt(s2)', 5)}, NULL FROM fin
UNION ALL SELECT 'sigma_group', {sql_rnd('sqrt(t * s2)', 3)}, NULL FROM fin""",
)
def q_reml(t):
    fit = reml(t)
    rows = [(n, float(b), float(s)) for n, b, s in zip(fit.terms, fit.coef, fit.std_error)]
    rows += [("sigma", fit.sigma2**0.5, None)]
    table = rounded(t.spark.createDataFrame(rows, "term string, estimate double, std_error double"), estimate=5, std_error=5)
    group = t.spark.createDataFrame([("sigma_group", fit.sigma2_group**0.5, None)], table.schema)
    return table.unionByName(rounded(group, estimate=3))


@query(
    "q_blup",
    f"""WITH {REML} SELECT animal, grp.n, {sql_rnd('t / (1 + grp.n * t) * (sy - grp.n * b0 - b1 * sx)', 3)} AS effect FROM grp, fin""",
)
def q_blup(t):
    return rounded(group_effects(reml(t)), effect=3)


@query(
    "q_predict_by_animal",
    f"""WITH {REML}, g AS (SELECT animal, h::double AS hours FROM (SELECT DISTINCT animal FROM fixes UNION ALL SELECT -1)
  CROSS JOIN (VALUES (0), (360)) v(h))
SELECT g.animal, g.hours, {sql_rnd('ym + b0 + b1 * (g.hours - xm) + coalesce(t / (1 + grp.n * t) * (sy - grp.n * b0 - b1 * sx), 0)', 3)} AS fit
FROM g CROSS JOIN fin CROSS JOIN c LEFT JOIN grp ON grp.animal = g.animal""",
)
def q_predict_by_animal(t):
    animals = t.fixes().select("animal").distinct()
    unknown = animals.limit(1).select(F.lit(-1).cast(animals.schema["animal"].dataType).alias("animal"))
    grid = expand_grid(animals.union(unknown), {"hours": [0.0, 360.0]})
    return rounded(predict_by_group(grid, reml(t)).select("animal", "hours", "fit"), fit=3)


# Gamma models need a positive response; some event values are zero.
@query(
    "q_gamma_by_state",
    f"""WITH {FIXES}, pos AS (SELECT kind, value + 1 AS y FROM fixes), m AS (SELECT kind, count(*) AS n, avg(y) AS m FROM pos GROUP BY kind),
phi AS (SELECT sum(((y - m) / m) * ((y - m) / m)) / (count(*) - 5) AS phi FROM pos JOIN m USING (kind)),
base AS (SELECT n, m FROM m WHERE kind = 'click'),
coefs AS (SELECT '(Intercept)' AS term, ln(base.m) AS b, sqrt(phi / base.n) AS se FROM base, phi
  UNION ALL SELECT 'kind_' || kind, ln(m.m / base.m), sqrt(phi / m.n + phi / base.n) FROM m, base, phi WHERE kind <> 'click')
SELECT term, {sql_rnd('b')} AS estimate, {sql_rnd('se')} AS std_error, {sql_rnd('b / se', 4)} AS t_value, {sql_rnd('exp(b)')} AS response_scale FROM coefs""",
)
def q_gamma_by_state(t):
    rows = t.fixes().withColumn("strength", F.col("value") + 1)
    coded, names = dummies(rows, "kind", levels(rows, "kind"))
    table = coef_table(t.spark, gamma_glm(coded, "strength", names), exp=True)
    return rounded(table, estimate=6, std_error=6, t_value=4, response_scale=6)


GAMMA_ROUNDS = 25


def _gamma_sql() -> str:
    """Fisher scoring, unrolled: with the log link all weights are 1, so a round adds the
    least-squares fit of (y - mu) / mu on the centred predictors."""
    parts = [
        HOURS,
        "raw AS (SELECT hours AS x1, lat AS x2, value + 1 AS y FROM timed)",
        "m AS MATERIALIZED (SELECT avg(x1) AS a1, avg(x2) AS a2 FROM raw)",
        "d AS MATERIALIZED (SELECT x1 - a1 AS c1, x2 - a2 AS c2, y FROM raw, m)",
        """s AS MATERIALIZED (SELECT *, s11 * s22 - s12 * s12 AS det FROM (SELECT count(*) AS n, sum(c1 * c1) AS s11,
    sum(c2 * c2) AS s22, sum(c1 * c2) AS s12 FROM d))""",
        "r0 AS MATERIALIZED (SELECT ln(avg(y)) AS b0, 0.0::double AS b1, 0.0::double AS b2 FROM d)",
    ]
    for i in range(1, GAMMA_ROUNDS + 1):
        parts.append(
            f"""r{i} AS MATERIALIZED (SELECT b0 + u0 AS b0, b1 + (s22 * u1 - s12 * u2) / det AS b1, b2 + (s11 * u2 - s12 * u1) / det AS b2
    FROM s, (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, avg(u) AS u0, sum(c1 * u) AS u1, sum(c2 * u) AS u2
      FROM (SELECT *, y / exp(b0 + b1 * c1 + b2 * c2) - 1 AS u FROM d, r{i - 1})))"""
        )
    last = f"r{GAMMA_ROUNDS}"
    parts.append(
        f"""phi AS (SELECT sum((y / exp(b0 + b1 * c1 + b2 * c2) - 1) * (y / exp(b0 + b1 * c1 + b2 * c2) - 1)) / (count(*) - 3) AS phi
    FROM d, {last})"""
    )
    parts.append(
        f"""coefs AS (
  SELECT '(Intercept)' AS term, b0 - b1 * a1 - b2 * a2 AS b,
    sqrt(phi * (1.0::double / n + (a1 * a1 * s22 + a2 * a2 * s11 - 2 * a1 * a2 * s12) / det)) AS se FROM {last}, m, s, phi
  UNION ALL SELECT 'hours', b1, sqrt(phi * s22 / det) FROM {last}, s, phi
  UNION ALL SELECT 'lat', b2, sqrt(phi * s11 / det) FROM {last}, s, phi)"""
    )
    return ", ".join(parts)


@query(
    "q_gamma_glm",
    f"""WITH {_gamma_sql()}
SELECT term, {sql_rnd('b', 5)} AS estimate, {sql_rnd('se', 5)} AS std_error, {sql_rnd('b / se', 3)} AS t_value,
  {sql_rnd('exp(b)', 4)} AS response_scale, true AS converged FROM coefs""",
)
def q_gamma_glm(t):
    rows = timed(t).withColumn("strength", F.col("value") + 1)
    fit = gamma_glm(rows, "strength", ["hours", "lat"])
    table = coef_table(t.spark, fit, exp=True).withColumn("converged", F.lit(fit.converged))
    return rounded(table, estimate=5, std_error=5, t_value=3, response_scale=4)


T_ROUNDS = 60
T_NU = 4.0


def _t_sql() -> str:
    """Reweighting rounds for one predictor, unrolled."""
    parts = [
        HOURS,
        "d AS MATERIALIZED (SELECT hours AS x, value AS y FROM timed)",
        "r0 AS MATERIALIZED (SELECT intercept AS a, slope AS b, rss / n AS s2 FROM (" + one_line("x", "y", "d") + "))",
    ]
    for i in range(1, T_ROUNDS + 1):
        weighted = f"(SELECT x, y, 5.0::double / (4.0::double + (y - a - b * x) * (y - a - b * x) / s2) AS w FROM d, r{i - 1})"
        parts.append(f"w{i} AS MATERIALIZED {weighted}")
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT intercept AS a, slope AS b, rss / wn AS s2 FROM (" + one_line("x", "y", f"w{i}", "w") + "))"
        )
    return ", ".join(parts)


@query(
    "q_t_fit",
    f"""WITH {_t_sql()}
SELECT '(Intercept)' AS term, {sql_rnd('a', 5)} AS estimate FROM r{T_ROUNDS}
UNION ALL SELECT 'hours', {sql_rnd('b', 5)} FROM r{T_ROUNDS} UNION ALL SELECT 'sigma', {sql_rnd('sqrt(s2)', 5)} FROM r{T_ROUNDS}
UNION ALL SELECT 'converged', 1.0::double""",
)
def q_t_fit(t):
    fit = robust_t_fit(timed(t), "value", ["hours"], nu=T_NU)
    rows = [*zip(fit.terms, map(float, fit.coef)), ("sigma", fit.sigma), ("converged", float(fit.converged))]
    return rounded(t.spark.createDataFrame(rows, "term string, estimate double"), estimate=5)


REPLICATES, SEED = 50, 69


def _poisson_sql(u: str) -> str:
    import math

    cumulative, term, text = 0.0, math.exp(-1), "CASE"
    for k in range(12):
        cumulative += term
        text += f" WHEN {u} < {cumulative!r}::double THEN {k}"
        term /= k + 1
    return text + " ELSE 12 END"


WEIGHTS = f"""drawn AS (SELECT grp.*, rep, {_poisson_sql("(('0x' || substr(md5(animal::varchar || '|' || rep || '|" + str(SEED) + "'), 1, 8))::bigint / 4294967296.0::double)")} AS w
  FROM grp, generate_series(1, {REPLICATES}) g(rep))"""


@query(
    "q_bootstrap_se",
    f"""WITH {HOURS}, c AS (SELECT avg(hours) AS xm, avg(ln(value + 1)) AS ym FROM timed),
z AS (SELECT animal, hours - xm AS x, ln(value + 1) - ym AS y FROM timed, c),
grp AS (SELECT animal, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy FROM z GROUP BY animal),
{WEIGHTS},
s AS (SELECT rep, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * xx) AS xx, sum(w * xy) AS xy FROM drawn GROUP BY rep),
b AS (SELECT rep, (n * xy - sx * sy) / (n * xx - sx * sx) AS b1, (xx * sy - sx * xy) / (n * xx - sx * sx) AS b0 FROM s),
g AS (SELECT DISTINCT day, ((day - date '2024-01-01') * 24)::double AS hours FROM timed)
SELECT day, {sql_rnd('stddev_samp(ym + b0 + b1 * (hours - xm))')} AS se FROM g, b, c GROUP BY day""",
)
def q_bootstrap_se(t):
    rows = timed(t).withColumn("log_value", F.ln(F.col("value") + 1))
    fit = cluster_bootstrap(rows, "log_value", ["hours"], "animal", REPLICATES, SEED)
    start = F.lit("2024-01-01").cast("date")
    grid = rows.select("day").distinct().withColumn("hours", (F.datediff("day", start) * 24).cast("double"))
    return bootstrap_se(grid, fit).select("day", rnd("se").alias("se"))
