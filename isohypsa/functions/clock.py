"""Readings of the clock of the task that a row passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock() -> Column:
    """Nanoseconds, read anew for every row; only differences within one task mean anything."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")
