"""Joins in effect: new-time detection, region checks, alignment,
densification and coordinate broadcasting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.model import GridCube
from gridcube.plans.strategy import MAX_BROADCAST_ROWS, bounded, join_small, keep_small

class RegionError(Exception):
    pass


def new_times(listed: DataFrame, stored: DataFrame, first=None, limit: int | None = None,
              col: str = "t") -> DataFrame:
    """Listed start times that are not stored yet (``>= first``), the first
    ``limit`` of them in time order. A stored start with missing members is
    not revisited."""
    lt = listed.select(col).distinct()
    if first is not None:
        lt = lt.filter(F.col(col) >= F.lit(first).cast("timestamp_ntz"))
    st = stored.select(F.col(stored.columns[0]).alias(col)) if col not in stored.columns \
        else stored.select(col)
    out = lt.join(st.distinct(), col, "left_anti")
    if limit is not None:
        out = out.orderBy(col).limit(max(limit, 0))
    return out


def check_region(slices: DataFrame, axes: Mapping[str, DataFrame], key: str = "path") -> DataFrame:
    """Rows describing why slices cannot be written into the destination.

    ``slices`` holds one row per (slice ``key``, grid label) and a column per
    dimension in ``axes``; ``axes[dim]`` is the destination's (label, pos)
    table. A label missing from the destination is a KeyError row; labels
    of one slice that are not contiguous in the destination a ValueError row.
    """
    out = None
    for dim, axis in axes.items():
        labels = slices.select(key, dim).distinct()
        a, fits = bounded(axis.select(dim, "pos"), MAX_BROADCAST_ROWS)
        a = F.broadcast(a) if fits else a
        missing = (labels.join(a, dim, "left_anti")
                   .select(key, F.lit(dim).alias("dim"), F.col(dim).cast("string").alias("label"),
                           F.lit("KeyError").alias("error")))
        gaps = (labels.join(a, dim, "inner").groupBy(key)
                .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
                .filter(F.col("hi") - F.col("lo") + 1 != F.col("n"))
                .select(key, F.lit(dim).alias("dim"),
                        F.concat_ws(":", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("label"),
                        F.lit("ValueError").alias("error")))
        part = missing.unionByName(gaps)
        out = part if out is None else out.unionByName(part)
    return out


def raise_on_region_errors(violations: DataFrame) -> None:
    v = violations.limit(1).collect()
    if v:
        r = v[0]
        if r["error"] == "KeyError":
            raise KeyError(f"{r[0]} has {r['dim']} = {r['label']}, which is not on the stored axis")
        raise RegionError(f"{r[0]} leaves gaps on the stored axis of {r['dim']}")


def align_to(cube: GridCube, other: GridCube, dim: str = "S", strict: bool = False) -> GridCube:
    """Restrict ``cube`` to the labels ``other`` has on ``dim``. With
    ``strict`` (label selection semantics) a label of ``other`` that ``cube``
    lacks is a KeyError."""
    if dim in cube.index and dim in other.index:
        wanted = set(other.index[dim])
        missing = wanted.difference(cube.index[dim])
        if strict and missing:
            raise KeyError(f"{min(missing)!r} not found in {dim}")
        kept = tuple(v for v in cube.index[dim] if v in wanted)
        labels = cube.replace(index={dim: kept}).axis(dim).select(dim)
        return cube.replace(cells=join_small(cube.cells, labels, dim, "left_semi"), index={**cube.index, dim: kept})
    labels = other.axis(dim).select(dim)
    if strict:
        missing = labels.join(cube.axis(dim).select(dim), dim, "left_anti").limit(1).collect()
        if missing:
            raise KeyError(f"{missing[0][0]!r} not found in {dim}")
    return cube.replace(cells=join_small(cube.cells, labels, dim, "left_semi"))


def densify(cube: GridCube, template: DataFrame, axes: Mapping[str, DataFrame]) -> GridCube:
    """Make a slice dense: every combination of the ``template`` rows (e.g.
    the Y x X grid with the slice's start) and the labels of ``axes`` (e.g.
    the M, P, L axes of the file set) gets a row; absent ones carry NULLs.

    The product is the feature: an axis table is broadcast when its checked
    size allows, and joined as it is otherwise; the data is then left-joined.
    """
    dense = template
    for dim, axis in axes.items():
        dtype = dict(cube.cells.dtypes)[dim]
        labels, fits = bounded(axis.select(F.col(dim).cast(dtype).alias(dim)))
        dense = dense.crossJoin(F.broadcast(labels) if fits else labels)
    keys = list(cube.dims)
    cells = dense.select(*keys).join(cube.cells, keys, "left")
    return cube.replace(cells=cells.select(*cube.cells.columns))


def with_positions(cube: GridCube, dims: Sequence[str], cells: DataFrame | None = None) -> DataFrame:
    """``cells`` (default: the cube's) plus ``<dim>_pos`` for each dim.

    Positions always refer to the whole cube's axes, so a subset of the
    cells keeps the positions it has in the full cube."""
    out = cube.cells if cells is None else cells
    axes = cube.axes(dims)
    for d in dims:
        out = join_small(out, keep_small(axes[d], axes[d].withColumnRenamed("pos", f"{d}_pos")), d, "inner")
    return out


def align_positional(left: GridCube, right: GridCube, var: str, right_var: str | None = None,
                     dims: Sequence[str] | None = None) -> DataFrame:
    """Pair values by position on every dim (labels may differ by rounding).

    Returns left labels, ``a`` (left value) and ``b`` (right value)."""
    dims = list(dims or left.dims)
    right_var = right_var or var
    pos = [f"{d}_pos" for d in dims]
    lt = with_positions(left, dims).select(*dims, *pos, F.col(var).alias("a"))
    rt = with_positions(right, dims).select(*pos, F.col(right_var).alias("b"))
    return lt.join(rt, pos, "full_outer").select(*dims, *pos, "a", "b")


def broadcast_coord(cube: GridCube, table: DataFrame, keys: Sequence[str],
                    factor: str, names: Sequence[str]) -> GridCube:
    """Multiply data variables by an array over a subset of the dims (e.g.
    an (S, L) table), matched by dimension name."""
    cells = join_small(cube.cells, table.select(*keys, factor), list(keys), "inner")
    cells = cells.withColumns({v: F.col(v) * F.col(factor) for v in names})
    return cube.with_values(cells.select(*cube.cells.columns))
