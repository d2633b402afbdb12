"""Small scalar helpers: longitudes, bands, axes, normal quantiles, keyed weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def unwrap_longitude(lon: Column) -> Column:
    """Map longitudes to (-360, 0]."""
    return F.when(lon > 0, lon - 360).otherwise(lon)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def normalize_id(text: Column) -> Column:
    """Trimmed id with single inner blanks; use on both sides of a join or on neither."""
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def display_key(animal: Column, day: Column) -> Column:
    return F.concat_ws("-", animal, day.cast("string"))


def band(link: Column, se: Column) -> tuple[Column, Column, Column]:
    """Mean and one-standard-error limits on the response scale of a log link."""
    return F.exp(link), F.exp(link - se), F.exp(link + se)


def axis_length_out(low: float, high: float, count: int) -> list[float]:
    if count == 1:
        return [low]
    return [low + i * (high - low) / (count - 1) for i in range(count)]


def axis_by(low: float, high: float, step: float) -> list[float]:
    """Values from ``low`` in steps of ``step`` while not above ``high``."""
    count = math.floor((high - low) / step + 1e-10) + 1
    return [low + i * step for i in range(max(count, 0))]


def repeated_axis(low: int, high: int, times: int) -> list[float]:
    return [float(v) for _ in range(times) for v in range(low, high + 1)]


# Coefficients of the published AS 241 rational approximation to
# the normal quantile (constant term first; numerator, then denominator).
CENTRE_NUM = (
    3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
    45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727,
)
CENTRE_DEN = (
    1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
    21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610,
)
MIDDLE_NUM = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
    1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640,
)
MIDDLE_DEN = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
    0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9,
)
TAIL_NUM = (
    6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
    0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
TAIL_DEN = (
    1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
    0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)
CENTRE_EDGE = 0.425
CENTRE_SHIFT = 0.180625
TAIL_EDGE = 5.0
MIDDLE_SHIFT = 1.6


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function; NULL outside (0, 1)."""
    q = p - 0.5
    r = F.lit(CENTRE_SHIFT) - q * q
    centre = q * _polynomial(CENTRE_NUM, r) / _polynomial(CENTRE_DEN, r)
    depth = F.sqrt(-F.ln(F.least(p, 1 - p)))
    m, t = depth - MIDDLE_SHIFT, depth - TAIL_EDGE
    middle = _polynomial(MIDDLE_NUM, m) / _polynomial(MIDDLE_DEN, m)
    tail = _polynomial(TAIL_NUM, t) / _polynomial(TAIL_DEN, t)
    outer = F.signum(q) * F.when(depth <= TAIL_EDGE, middle).otherwise(tail)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= CENTRE_EDGE, centre).otherwise(outer))


def plotting_position(rank: Column, count: Column) -> Column:
    """(i - a) / (n + 1 - 2a) with a = 3/8 up to ten values and 1/2 beyond."""
    a = F.when(count <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    return (rank - a) / (count + 1 - 2 * a)


def keyed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the text of ``parts``."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inversion of a uniform number."""
    cumulative, term, chain = 0.0, math.exp(-1), None
    for k in range(12):
        cumulative += term
        chain = F.when(u < cumulative, k) if chain is None else chain.when(u < cumulative, k)
        term /= k + 1
    return chain.otherwise(12)
