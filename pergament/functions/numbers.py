"""Rounding that does not depend on the order in which a sum was taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """Half-up to ``digits`` places of the value to ten places, as a double.

    Sums of doubles differ in their last bits with the order of the rows; at ten places they
    agree again, so ties round alike wherever the rows lie.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(28,10)"), digits).cast("double")
