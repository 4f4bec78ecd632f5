"""Join strategy helpers.

Coordinate tables (axis labels, (S, L) target tables, unit tables) are small
by nature but nothing *proves* it when they are derived from a big scan, so a
broadcast is only hinted after the row count has been checked. Beyond the
bound the join falls back to an ordinary shuffle join that AQE can still
re-plan (and split skewed partitions of) at run time.
"""

from __future__ import annotations

import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A coordinate table larger than this is not broadcast (rows, not bytes; the
# widest coordinate row is a few timestamps and numbers, so 2M rows < 100 MB).
MAX_BROADCAST_ROWS = 2_000_000

# Reused coordinate tables up to this many rows are rebuilt from their
# collected rows (a broadcast collects them to the driver anyway).
MAX_LOCAL_ROWS = 100_000


# Tables built on the driver from collected coordinate rows: their size is
# known, so joins broadcast them without counting again.
_SMALL: "weakref.WeakSet[DataFrame]" = weakref.WeakSet()


def mark_small(df: DataFrame) -> DataFrame:
    """Record that ``df`` was built on the driver from a known number of rows,
    at most ``MAX_BROADCAST_ROWS`` (axis tables hold up to 1M labels,
    localized tables up to ``MAX_LOCAL_ROWS`` rows)."""
    _SMALL.add(df)
    return df


def keep_small(source: DataFrame, derived: DataFrame) -> DataFrame:
    """``derived`` (a projection or rename of ``source``) keeps its mark."""
    return mark_small(derived) if is_small(source) else derived


def is_small(df: DataFrame) -> bool:
    return df in _SMALL or df.isLocal()


def localize(small: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> DataFrame:
    """A coordinate-sized table rebuilt from its collected rows, so every
    later join broadcasts it without recomputing its (possibly expensive)
    plan. Tables over ``max_rows`` are returned unchanged."""
    if is_small(small):
        return small
    rows = small.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return small
    return mark_small(small.sparkSession.createDataFrame(rows, small.schema))


def settled(df: DataFrame, path: str, max_rows: int = MAX_LOCAL_ROWS) -> DataFrame:
    """``df`` computed once, however large: written as a table at ``path`` and
    read from there, or rebuilt from its rows (see :func:`localize`) where
    there are at most ``max_rows``. The caller removes ``path``."""
    if is_small(df):
        return df
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    n = written.count()
    if n <= max_rows:
        return localize(written, max_rows)
    return mark_small(written) if n <= MAX_BROADCAST_ROWS else written


def bounded(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Return (table, fits) where ``fits`` says it holds at most ``max_rows`` rows.

    ``limit(max_rows + 1)`` lets Spark stop counting early when the table is
    unexpectedly large. Tables built from collected coordinate rows are small
    by construction and are not counted.
    """
    if is_small(small):
        return small, True
    n = small.limit(max_rows + 1).count()
    return small, n <= max_rows


def join_small(big: DataFrame, small: DataFrame, on: str | Sequence[str] | Column,
               how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with a coordinate-sized ``small`` table.

    Broadcasts ``small`` only when its size is checked to be under
    ``max_rows``; otherwise a shuffle join is planned.
    """
    small, fits = bounded(small, max_rows)
    right = F.broadcast(small) if fits else small
    return big.join(right, on, how)
