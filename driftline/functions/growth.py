"""Closed-form whisker growth: dates from lengths and lengths from dates.

All times are days since 1970-01-01 as doubles; the calendar date is a
separate column made with :func:`driftline.functions.timeconv.day_to_date`.
Logarithms of zero or negative arguments give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published regression of asymptotic length on follicle position,
# and of growth rate on asymptotic length.
ASYMPTOTE_BASE = 8.53
ASYMPTOTE_COLUMN = -1.96
ASYMPTOTE_ROW = 2.06
ASYMPTOTE_ROW_SQUARED = -0.56
FOLLICLE_ORIGIN = 4
RATE_LOG_INTERCEPT = -2.052821
RATE_EXPONENT = -0.9204057
# Fixed value: length (cm) added when a whisker is longer than its asymptote.
LENGTH_OFFSET = 0.1
# Fixed value: growth rate used for plain growth curves.
CURVE_RATE = 0.0132


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def asymptotic_length(column: Column, row: Column) -> Column:
    c = (column - FOLLICLE_ORIGIN).cast("double")
    r = (row - FOLLICLE_ORIGIN).cast("double")
    return (
        F.lit(ASYMPTOTE_BASE) + ASYMPTOTE_COLUMN * c + ASYMPTOTE_ROW * r + ASYMPTOTE_ROW_SQUARED * r * r
    )


def growth_rate(length: Column) -> Column:
    return F.exp(F.lit(RATE_LOG_INTERCEPT)) * F.pow(length, F.lit(RATE_EXPONENT))


def outgrown(linf: Column, length: Column) -> Column:
    """True where the recovered whisker is at least as long as its predicted asymptote."""
    return linf <= length


def effective_asymptote(linf: Column, length: Column) -> Column:
    return F.when(outgrown(linf, length), length).otherwise(linf)


def unfinished_share(linf: Column, length: Column, offset: float = LENGTH_OFFSET) -> Column:
    """One minus the grown share of the whisker, kept above zero by ``offset``."""
    grown = F.when(outgrown(linf, length), F.try_divide(length, length + F.lit(offset))).otherwise(
        F.try_divide(length, linf)
    )
    return 1 - grown


def growth_start(linf: Column, length: Column, recovery: Column, offset: float = LENGTH_OFFSET) -> Column:
    rate = growth_rate(effective_asymptote(linf, length))
    return F.try_divide(safe_ln(unfinished_share(linf, length, offset)), rate) + recovery


def realised_rate(
    linf: Column, length: Column, recovery: Column, start: Column, offset: float = LENGTH_OFFSET
) -> Column:
    return F.try_divide(-safe_ln(unfinished_share(linf, length, offset)), recovery - start)


def segment_day(distance: Column, asymptote: Column, rate: Column, start: Column) -> Column:
    return F.try_divide(-safe_ln(1 - F.try_divide(distance, asymptote)), rate) + start


def start_from_known_length(length: Column, known_length: Column, known_day: Column) -> Column:
    """Start of growth from one measured length at a known day, asymptote = recovered length."""
    grown = safe_ln(1 - F.try_divide(known_length, length))
    return F.try_divide(grown, growth_rate(length)) + known_day


def length_at(day: Column, asymptote: Column, rate: Column, start: Column) -> Column:
    return asymptote * (1 - F.exp(-rate * (day - start)))


def rate_from_length(length: Column, asymptote: Column, duration: Column) -> Column:
    """Rate that reaches ``length`` after ``duration``; NULL once length meets the asymptote."""
    return F.try_divide(-safe_ln(1 - F.try_divide(length, asymptote)), duration)
