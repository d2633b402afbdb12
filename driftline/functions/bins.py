"""Isotope classes and their ordered labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class limits, names and legend labels.
CARBON_LIMITS = (-19.0, -18.5, -18.0, -17.5, -17.0)
CARBON_NAMES = ("Low", "Low-medium", "Medium", "Medium-high", "High")
CARBON_LABELS = ("-19 to -18.5", "-18.4 to -18", "-17.9 to -17.5", "-17.4 to -17", "-16.9 to -16")
NITROGEN_LIMITS = (11.0, 12.5, 14.0, 15.5)
NITROGEN_NAMES = ("Low", "Medium", "Medium-high", "High")
NITROGEN_LABELS = ("11 to 12.4", "12.5 to 13.9", "14 to 15.4", "15.5 to 17.3")


def bin_ordinal(
    x: Column, limits: Sequence[float], closed: str = "right", below_apart: bool = False
) -> Column:
    """1-based class number; values outside all limits get the last class.

    ``closed='right'`` gives (a, b] classes with the lowest limit included,
    ``closed='left'`` gives [a, b).  ``below_apart=True`` puts values under the
    lowest limit in class 0 instead of the last.
    """
    top = len(limits)
    chain = F.when(x.isNull(), F.lit(None).cast("int"))
    if below_apart:
        chain = chain.when(x < limits[0], 0)
    for i, (low, high) in enumerate(zip(limits, limits[1:]), start=1):
        if closed == "right":
            inside = ((x >= low) if i == 1 else (x > low)) & (x <= high)
        else:
            inside = (x >= low) & (x < high)
        chain = chain.when(inside, i)
    return chain.otherwise(top)


def pick_text(ordinal: Column, texts: Sequence[str], below: str = "Below") -> Column:
    return F.when(ordinal == 0, below).otherwise(F.try_element_at(F.array(*map(F.lit, texts)), ordinal))


def carbon_class(x: Column, below_apart: bool = False) -> Column:
    return pick_text(bin_ordinal(x, CARBON_LIMITS, "right", below_apart), CARBON_NAMES)


def nitrogen_class(x: Column, below_apart: bool = False) -> Column:
    return pick_text(bin_ordinal(x, NITROGEN_LIMITS, "left", below_apart), NITROGEN_NAMES)


def relabel(name: Column, names: Sequence[str], labels: Sequence[str]) -> Column:
    pairs = [F.lit(v) for pair in zip(names, labels) for v in pair]
    return F.try_element_at(F.create_map(*pairs), name)


def class_order(name: Column, names: Sequence[str]) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0)).cast("int")
