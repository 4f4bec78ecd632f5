"""Operators on packed chunks.

A cube read from a packed store carries its chunks (``GridCube.packed``): one
row per key of the other dims, with each variable's grid as an array. Selecting
along the other dims filters those rows, selecting on the grid picks elements
of the arrays, and changes of values go through the arrays, so a chain of them
reads, changes and writes one row per chunk. ``cells`` of the result unpack the
chunks last, when an operator needs single cells.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcube.model import GridCube
from gridcube.sources.store import PRESENT, unpack_chunks


def with_chunks(cube: GridCube, frame: DataFrame, **changes) -> GridCube:
    """``cube`` with other chunks (and other fields)."""
    packed = dataclasses.replace(cube.packed, frame=frame)
    dims, index = changes.get("dims", cube.dims), changes.pop("index", cube.index)
    cells = unpack_chunks(frame, dims, cube.data_vars, packed.grid, index, packed.types)
    return cube.replace(cells=cells, packed=packed, index=index, **changes)


def map_values(cube: GridCube, functions: Mapping[str, Callable[[Column], Column]], **changes) -> GridCube:
    """Every value of the named variables through its function, in the arrays
    of a packed cube and in the columns of another. Labels stay."""
    if cube.packed is None:
        return cube.with_values(cube.cells.withColumns({v: f(F.col(v)) for v, f in functions.items()}), **changes)

    def each(f):
        return lambda x: f(x)
    arrays = {v: F.transform(F.col(v), each(f)) for v, f in functions.items()}
    return with_chunks(cube, cube.packed.frame.withColumns(arrays), **changes)


def take(cube: GridCube, dim: str, positions: Sequence[int]) -> DataFrame:
    """The chunks with only the given positions of a grid dimension, in the
    given order. A run of whole grid rows is a slice of the arrays; other
    selections pick elements by number, at most one number per grid point."""
    gy, gx = cube.packed.grid
    ny, nx = len(cube.index[gy]), len(cube.index[gx])
    columns = [c for c in (*cube.data_vars, PRESENT) if c in cube.packed.frame.columns]
    first, n = (positions[0] if positions else 0), len(positions)
    if dim == gy and list(positions) == list(range(first, first + n)):
        picked = {c: F.slice(F.col(c), first * nx + 1, n * nx) for c in columns}
    else:
        axis = F.array(*[F.lit(p) for p in positions]).cast("array<int>")
        number = F.flatten(F.transform(axis, lambda y: F.transform(F.sequence(F.lit(0), F.lit(nx - 1)), lambda x: y * nx + x))) \
            if dim == gy else \
            F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ny - 1)), lambda y: F.transform(axis, lambda x: y * nx + x)))
        picked = {c: F.transform(number, _element(c)) for c in columns}
    return cube.packed.frame.withColumns(picked)


def _element(name: str):
    return lambda i: F.get(F.col(name), i)


def keep(cube: GridCube, dim: str, rows: Callable[[DataFrame], DataFrame], labels: tuple, **changes) -> GridCube:
    """The cube with the given labels of ``dim`` in the given order; ``rows``
    filters a table that has ``dim`` as a column down to them."""
    if dim in cube.packed.grid:
        at = {v: i for i, v in enumerate(cube.index[dim])}
        frame = take(cube, dim, [at[v] for v in labels])
    else:
        frame = rows(cube.packed.frame)
    return with_chunks(cube, frame, index={**cube.index, dim: labels}, **changes)
