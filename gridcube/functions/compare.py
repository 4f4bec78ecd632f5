"""Tolerance comparison of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default tolerances of the comparison (numpy's allclose defaults).
DEFAULT_RTOL = 1e-5
DEFAULT_ATOL = 1e-8


def allclose(a: Column, b: Column, atol: float | Column = DEFAULT_ATOL,
             rtol: float = DEFAULT_RTOL) -> Column:
    """``|a - b| <= atol + rtol * |b|``, with missing (NULL or NaN) equal to missing."""
    a_missing = a.isNull() | F.isnan(a)
    b_missing = b.isNull() | F.isnan(b)
    atol_c = atol if isinstance(atol, Column) else F.lit(float(atol))
    close = F.abs(a - b) <= atol_c + F.lit(float(rtol)) * F.abs(b)
    return (F.when(a_missing & b_missing, F.lit(True))
             .when(a_missing | b_missing, F.lit(False))
             .otherwise(close))
