"""Value bands, alert levels and their attributes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyra.schemas import CATEGORIES, PREDICTION_LEVELS


def category(value: Column, mode: str = "strict") -> Column:
    """Band name of a value.

    ``strict`` uses the closed integer bounds: 50.5 lies between two bands and gets NULL, as do values outside
    0..500. ``continuous`` closes the gaps upwards and has no upper end, so only negative values get NULL.
    """
    if mode not in ("strict", "continuous"):
        raise ValueError(f"unknown mode: {mode}")
    chain = None
    for name, low, high, *_ in CATEGORIES:
        if mode == "strict":
            inside = value.between(low, high)
        elif name == CATEGORIES[-1][0]:
            inside = value.isNotNull() & (value >= 0)
        else:
            inside = (value >= 0) & (value <= high)
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return chain


def category_attribute(name: Column, attribute: str) -> Column:
    """``threshold_min``, ``threshold_max``, ``alert_level``, ``color`` or ``recommendation`` of a category."""
    position = ["threshold_min", "threshold_max", "alert_level", "color", "recommendation"].index(attribute) + 1
    chain = None
    for row in CATEGORIES:
        chain = (chain.when if chain is not None else F.when)(name == row[0], F.lit(row[position]))
    return chain


def _by_prediction(value: Column, position: int) -> Column:
    chain = None
    for row in PREDICTION_LEVELS:
        inside = value.isNotNull() if row[0] is None else value <= row[0]
        chain = (chain.when if chain is not None else F.when)(inside, F.lit(row[position]))
    return chain


def prediction_level(value: Column) -> Column:
    """Alert level of a predicted value; every number has one."""
    return _by_prediction(value, 1)


def prediction_advice(value: Column) -> Column:
    """Advice for a predicted value."""
    return _by_prediction(value, 2)
