"""Positional and label selection.

Positional selection (``isel``) is lowered on the driver to label predicates
(a range or an ``IN`` list) so that Catalyst pushes it into the Parquet scan
(row-group statistics, partition pruning) instead of joining ``cells`` with
a position table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.model import Coord, GridCube
from gridcube.plans.strategy import MAX_BROADCAST_ROWS, bounded
from gridcube.sources.packed import keep

# More kept labels than this become a semi join with the label table
# instead of an IN list in the plan.
MAX_IN_LIST = 10_000


def _positions(n: int, sel) -> list[int]:
    if isinstance(sel, slice):
        return list(range(n))[sel]
    if isinstance(sel, int):
        return [list(range(n))[sel]]
    return [list(range(n))[i] for i in sel]


def _restrict(cube: GridCube, dim: str, labels_df: DataFrame, n_kept: int) -> DataFrame:
    if n_kept <= MAX_IN_LIST:
        labels = [r[0] for r in labels_df.select(dim).collect()]
        return cube.cells.filter(F.col(dim).isin(labels))
    small, fits = bounded(labels_df.select(dim), MAX_BROADCAST_ROWS)
    return cube.cells.join(F.broadcast(small) if fits else small, dim, "left_semi")


def _between(axis_labels: tuple, kept: tuple) -> bool:
    """Whether a label range keeps just ``kept``, a run of the axis."""
    pairs = list(zip(axis_labels, axis_labels[1:]))
    return len(kept) > 1 and (all(a < b for a, b in pairs) or all(a > b for a, b in pairs))


def _indexed(cube: GridCube, dim: str, sel) -> tuple[Callable[[DataFrame], DataFrame], tuple]:
    """The filter of ``sel`` and the labels it keeps, from the index alone."""
    labels = cube.index[dim]
    kept = tuple(labels[i] for i in _positions(len(labels), sel))
    if isinstance(sel, slice) and (sel.step or 1) == 1 and _between(labels, kept):
        lo, hi = sorted((kept[0], kept[-1]))
        return lambda df: df.filter(F.col(dim).between(lo, hi)), kept
    if len(kept) <= MAX_IN_LIST:
        return lambda df: df.filter(F.col(dim).isin(list(kept))), kept
    few = cube.replace(index={dim: kept}).axis(dim).select(dim)
    small, fits = bounded(few, MAX_BROADCAST_ROWS)
    return lambda df: df.join(F.broadcast(small) if fits else small, dim, "left_semi"), kept


def _without(cube: GridCube, cells: DataFrame, dim: str, label, index) -> GridCube:
    """``dim`` becomes a scalar coordinate."""
    return cube.replace(cells=cells.drop(dim), dims=tuple(d for d in cube.dims if d != dim), index=index,
                        coords={**cube.coords, dim: Coord((), expr=F.lit(label))},
                        descending=cube.descending - {dim})


def isel(cube: GridCube, **indexers) -> GridCube:
    """Select by position: an int (the dim becomes a scalar coordinate), a
    slice (``start:stop:step``, negative steps reverse the stored order) or
    a list of positions. Dimensions of the index start no job, and keep the
    labels that they were selected by; the index of the others stays. Slices
    and lists leave the chunks of a packed cube packed."""
    out = cube
    # positions refer to the axes of the cube as given (all indexers apply
    # at once, not one after another): one pass collects them all
    scanned = [d for d in indexers if d not in cube.index]
    axes = cube.axes(scanned) if scanned else {}
    for dim, sel in indexers.items():
        turned = out.descending ^ {dim} if isinstance(sel, slice) and (sel.step or 1) < 0 else out.descending
        if dim in cube.index:
            rows, labels = _indexed(out, dim, sel)
            if not isinstance(sel, int) and out.packed is not None:
                out = keep(out, dim, rows, labels, descending=turned)
            elif isinstance(sel, int):
                out = _without(out, rows(out.cells), dim, labels[0], {d: v for d, v in out.index.items() if d != dim})
            else:
                out = out.replace(cells=rows(out.cells), descending=turned, index={**out.index, dim: labels})
            continue
        axis = axes[dim]
        n = axis.count()
        pos = _positions(n, sel)
        if isinstance(sel, slice) and (sel.step or 1) == 1 and pos:
            lo, hi = pos[0], pos[-1]
            kept = axis.filter(F.col("pos").between(lo, hi))
            ends = kept.agg(F.min(dim).alias("a"), F.max(dim).alias("b")).first()
            cells = out.cells.filter(F.col(dim).between(ends["a"], ends["b"]))
        else:
            kept = axis.filter(F.col("pos").isin(pos))
            cells = _restrict(out, dim, kept, len(pos))
        if isinstance(sel, int):
            out = _without(out, cells, dim, kept.select(dim).first()[0], out.index)
        else:
            out = out.replace(cells=cells, descending=turned, index=out.index)
    return out


def _known(cube: GridCube, dim: str, wanted: list) -> list:
    """``wanted`` as labels of ``dim``; an unknown one is a KeyError. Looked up
    in the index, or in a filtered pass over the cells."""
    kind = dict(cube.cells.dtypes)[dim]
    typed = cube.spark.range(1).select(F.array(*[F.lit(v).cast(kind) for v in wanted]).alias("v")).first()["v"] if wanted else []
    if dim in cube.index:
        there = set(cube.index[dim])
    else:
        there = {r[0] for r in cube.cells.filter(F.col(dim).isin(typed)).select(dim).distinct().collect()} if wanted else set()
    missing = [w for w, v in zip(wanted, typed) if v not in there]
    if missing:
        raise KeyError(f"{missing[0]!r} not found in {dim}" if len(missing) == 1 else f"{missing} not found in {dim}")
    return typed


def sel(cube: GridCube, check: bool = True, **indexers) -> GridCube:
    """Select by label: exact value, list of values (with ``check``, a label
    that the dimension lacks is a KeyError) or inclusive ``slice(lo, hi)``.
    An exact value keeps the dimension, with one label. Dimensions of the
    index are checked without reading cells, and keep the stored order. A
    packed cube stays packed."""
    if cube.packed is not None and set(indexers) <= set(cube.index):
        for dim, v in indexers.items():
            one = sel(cube.replace(packed=None), check, **{dim: v})
            kept = one.index[dim]
            cube = keep(cube, dim, _indexed(cube, dim, [cube.index[dim].index(x) for x in kept])[0], kept)
        return cube
    cells, index = cube.cells, dict(cube.index)
    for dim, v in indexers.items():
        c = F.col(dim)
        kind = dict(cube.cells.dtypes)[dim]
        if isinstance(v, slice):
            ends = [None if e is None else cube.spark.range(1).select(F.lit(e).cast(kind)).first()[0] for e in (v.start, v.stop)]
            if ends[0] is not None:
                cells = cells.filter(c >= F.lit(ends[0]).cast(kind))
            if ends[1] is not None:
                cells = cells.filter(c <= F.lit(ends[1]).cast(kind))
            if dim in index:
                index[dim] = tuple(x for x in index[dim] if (ends[0] is None or x >= ends[0]) and (ends[1] is None or x <= ends[1]))
            continue
        many = isinstance(v, (list, tuple, set, frozenset))
        wanted = list(v) if many else [v]
        found = _known(cube, dim, wanted) if check else wanted
        cells = cells.filter(c.isin(found) if many else c == F.lit(found[0]))
        if dim in index:
            index[dim] = tuple(x for x in index[dim] if x in set(found))
    return cube.replace(cells=cells, index=index)


def probe_first(cube: GridCube) -> DataFrame:
    """The element at position 0 of every axis of the first data variable
    (read before serving so broken sources fail early)."""
    var = cube.data_vars[0]
    if all(cube.index.get(d) for d in cube.dims):  # a point filter: no pass to find the first labels
        cells = cube.cells
        for d in cube.dims:
            cells = cells.filter(F.col(d) == F.lit(cube.index[d][0]))
        return cells.select(*cube.dims, var).limit(1)
    firsts = cube.cells.agg(*[(F.max(d) if d in cube.descending else F.min(d)).alias(d)
                              for d in cube.dims]).first()
    cond = None
    for d in cube.dims:
        e = F.col(d) == F.lit(firsts[d])
        cond = e if cond is None else cond & e
    return cube.cells.filter(cond).select(*cube.dims, var).limit(1)
