"""Tail probabilities in SQL by finite sums and plain series, another way than the operators'."""


def sql_t_tail(t: str, nu: str) -> str:
    """P(|T| > |t|) for a whole number of degrees of freedom: a finite sum over powers of a cosine."""
    angle, square = f"atan(abs({t}) / sqrt({nu}))", f"(1 / (1 + {t} * {t} / {nu}))"
    odd = f"exp(lgamma(j + 1.0::double) - lgamma(j + 1.5::double) + (j + 0.5::double) * ln{square}) * sqrt(pi()) / 2"
    even = f"exp(lgamma(j + 0.5::double) - lgamma(j + 1.0::double) + j * ln{square}) / sqrt(pi())"
    total = "coalesce(list_sum(list_transform(range(({nu} - {less}) // 2 + 1), lambda j: {term})), 0)"
    odds, evens = total.format(nu=nu, less=3, term=odd), total.format(nu=nu, less=2, term=even)
    return f"""(1 - CASE WHEN {nu} % 2 = 1 THEN 2 / pi() * ({angle} + sin({angle}) * {odds}) ELSE sin({angle}) * {evens} END)"""


def sql_f_tail(f: str, d1: str, d2: str) -> str:
    """P(F > f) for even ``d1``: a finite sum."""
    x = f"({d2} / ({d2} + {d1} * {f}))"
    return (
        f"list_sum(list_transform(range({d1} // 2), lambda j: exp(lgamma({d2} / 2.0::double + j) - lgamma({d2} / 2.0::double)"
        f" - lgamma(j + 1.0::double) + {d2} / 2.0::double * ln({x})) * pow(1 - {x}, j)))"
    )


def sql_chi2_tail(x: str, df: str) -> str:
    """P(X > x) by the power series of its complement; for values that are not far out."""
    z, a = f"({x} / 2.0::double)", f"({df} / 2.0::double)"
    return (
        f"(1 - list_sum(list_transform(range(400), lambda k: exp(({a} + k) * ln({z}) - {z} - lgamma({a} + k + 1)))))"
    )


def sql_t_quantiles(source: str, nu: str, outside: float, rounds: int = 12) -> list[str]:
    """CTEs that end in ``quantiles`` (nu, t): what |T| exceeds with probability ``outside``."""
    parts = [f"tq0 AS MATERIALIZED (SELECT DISTINCT {nu} AS nu, 2.0::double AS t FROM {source} WHERE {nu} > 0)"]
    density = "exp(lgamma((nu + 1) / 2.0::double) - lgamma(nu / 2.0::double) - ln(nu * pi()) / 2 - (nu + 1) / 2.0::double * ln(1 + t * t / nu))"
    for i in range(1, rounds + 1):
        parts.append(
            f"""tq{i} AS MATERIALIZED (SELECT nu, t * exp(greatest(-2, least(2, (ln(p) - ln({outside!r}::double)) * p / (2 * t * {density})))) AS t
  FROM (SELECT nu, t, {sql_t_tail('t', 'nu')} AS p FROM tq{i - 1}))""")
    return [*parts, f"quantiles AS (SELECT * FROM tq{rounds})"]
