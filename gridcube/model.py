"""The cube data model.

``GridCube.cells`` is the canonical long table: one row per grid point, one
column per dimension (``S, M, P, L, Y, X`` or provider names) and one column
per data variable. Absent (never written) points are simply absent rows;
missing values inside a written slice are NULL.

Auxiliary coordinates (e.g. ``target(S, L)``) are either
* an expression over their dimensions (``Coord.expr``; costs nothing and is
  fused into the scan's codegen stage), or
* a small table keyed by their dimensions (``Coord.table``), joined on demand
  with a size-checked broadcast.

Metadata (attributes and encodings) lives on the driver: it is schema, not
data, and it decides which expressions are built (units, calendars).
"""

from __future__ import annotations

import dataclasses
import weakref
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcube.plans.strategy import join_small, mark_small


class Axes:
    """Standard axis names (fixed values shared with the reference data model)."""
    T = "T"
    S = "S"
    L = "L"
    M = "M"
    P = "P"
    Y = "Y"
    X = "X"
    target = "target"
    target_bnds = "target_bnds"
    nbound = "nbound"
    ALL = ("T", "S", "L", "M", "P", "Y", "X", "target", "target_bnds", "nbound")
    # Primary time dimension of an ingested store before harmonisation.
    INGEST_TIME = "init_time"


# target_bnds(S, L, nbound) is carried as two columns of the (S, L) table.
TARGET_START = "target_start"
TARGET_END = "target_end"

_EMPTY: Mapping = MappingProxyType({})

# Axis tables per cells plan (and direction), computed once per plan.
_AXES: "weakref.WeakKeyDictionary[DataFrame, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()

# More labels than this make a dimension "not a coordinate": its axis is then
# numbered on the cluster instead of being held as a small local table.
MAX_AXIS_LABELS = 1_000_000


@dataclass(frozen=True)
class Coord:
    """An auxiliary (non-dimension) coordinate."""
    dims: tuple[str, ...]
    expr: Column | None = None
    table: DataFrame | None = None
    # extra columns of ``table`` that belong to this coordinate (e.g. bounds)
    extra: tuple[str, ...] = ()
    # other coordinates an ``expr`` refers to (materialised first)
    requires: tuple[str, ...] = ()

    def __post_init__(self):
        if (self.expr is None) == (self.table is None):
            raise ValueError("a Coord needs exactly one of expr or table")


@dataclass(frozen=True)
class Packed:
    """Cells held as chunks (``sources.packed``): one row per key of the dims
    outside ``grid``, each variable an array laid out by the index."""
    frame: DataFrame
    grid: tuple[str, str]
    types: Mapping[str, str]


# Fields that say nothing about the cells: chunks stay when they change.
_BESIDE_CELLS = {"coords", "attrs", "ds_attrs", "encodings", "packed"}


@dataclass(frozen=True)
class GridCube:
    cells: DataFrame
    dims: tuple[str, ...]
    data_vars: tuple[str, ...]
    coords: Mapping[str, Coord] = field(default_factory=dict)
    attrs: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    ds_attrs: Mapping[str, str] = field(default_factory=dict)
    encodings: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    # dimensions stored in descending label order (P by default, Y after a flip)
    descending: frozenset[str] = frozenset()
    # dimensions without a coordinate variable: their column holds positions
    bare_dims: frozenset[str] = frozenset()
    # labels of a dimension in stored order, where they are known without
    # reading ``cells`` (from the store, or declared); see ``with_index``
    index: Mapping[str, tuple] = field(default_factory=dict)
    # the same cells as chunks, where they come from a packed store
    packed: Packed | None = None

    # ------------------------------------------------------------------ basics
    def replace(self, **changes) -> "GridCube":
        """A copy with other fields. New ``cells`` may have other labels, so
        the index goes with the old ones unless a new one is given; a
        direction that turns round turns the index round as well."""
        if "index" not in changes:
            if "cells" in changes:
                changes["index"] = {}
            elif "descending" in changes:
                turned = self.descending ^ frozenset(changes["descending"])
                changes["index"] = {d: v[::-1] if d in turned else v for d, v in self.index.items()}
        if not set(changes) <= _BESIDE_CELLS:
            changes.setdefault("packed", None)
        return dataclasses.replace(self, **changes)

    def with_values(self, cells: DataFrame, **changes) -> "GridCube":
        """A copy with other ``cells`` whose dimensions have the same labels
        (other values or columns): the index stays."""
        return self.replace(cells=cells, index=self.index, **changes)

    def with_index(self, **labels: Iterable) -> "GridCube":
        """Declare the labels of dimensions in stored order (positions 0, 1,
        ...). Labels are coordinates: they may have no cells, but a label of
        ``cells`` that is not declared has no position. Null or repeated
        labels are an error. The direction (``descending``) follows from the
        first and last label."""
        found = {**self.index}
        for d, values in labels.items():
            values = tuple(values)
            if d not in self.dims:
                raise KeyError(f"{d!r} is not a dimension of {self.dims}")
            if None in values or len(set(values)) != len(values):
                raise ValueError(f"the labels of {d} hold nulls or repeats")
            found[d] = values
        down = frozenset(d for d, v in found.items() if len(v) > 1 and v[0] > v[-1])
        up = frozenset(d for d, v in found.items() if len(v) > 1 and v[0] < v[-1])
        return self.replace(index=found, descending=(self.descending | down) - up)

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    @property
    def variables(self) -> tuple[str, ...]:
        """All named variables: dimension coordinates, aux coordinates, data."""
        return tuple(self.dims) + tuple(self.coords) + tuple(self.data_vars)

    def var_attrs(self, name: str) -> Mapping[str, str]:
        return self.attrs.get(name, _EMPTY)

    # method forms of the common operators (labelled-array style)
    def isel(self, **indexers) -> "GridCube":
        from gridcube.operators.select import isel
        return isel(self, **indexers)

    def sel(self, **indexers) -> "GridCube":
        from gridcube.operators.select import sel
        return sel(self, **indexers)

    def rename(self, mapping: Mapping[str, str]) -> "GridCube":
        from gridcube.operators.schema import rename
        return rename(self, mapping)

    def drop_vars(self, names) -> "GridCube":
        from gridcube.operators.schema import drop_coords
        return drop_coords(self, names)

    def sizes(self) -> dict[str, int]:
        """Dimension sizes (from the axis tables)."""
        return {d: a.count() for d, a in self.axes().items()}

    def transform(self, fn, *args, **kwargs) -> "GridCube":
        out = fn(self, *args, **kwargs)
        if not isinstance(out, GridCube):
            raise TypeError(f"transform {getattr(fn, '__name__', fn)!r} returned "
                            f"{type(out).__name__}, expected a GridCube")
        return out

    # -------------------------------------------------------------- axes
    def axis(self, dim: str) -> DataFrame:
        """Labels of one dimension with their 0-based stored position."""
        return self.axes([dim])[dim]

    def axes(self, dims=None) -> dict[str, DataFrame]:
        """Axis tables ``(label, pos)`` of several dimensions.

        Axes of the index are read from it, in stored order and without a
        job. All others come from ONE pass over ``cells`` (a distinct that
        de-duplicates map-side, so the shuffle is coordinate-sized). The
        labels are coordinates: they are rebuilt on the driver as small
        tables (registered with ``mark_small``) that later joins broadcast
        without another pass, and they are remembered per ``cells`` plan. A
        dimension with more than ``MAX_AXIS_LABELS`` labels is not a
        coordinate and is numbered on the cluster instead.
        """
        dims = list(dims or self.dims)
        memo = _AXES.setdefault(self.cells, {})  # dim -> ascending labels (list) or None
        todo = [d for d in dims if d not in memo and d not in self.index]
        types = {f.name: f.dataType for f in self.cells.schema.fields}
        if todo:
            memo.update(self._collect_labels(todo, types))
        out = {}
        for d in dims:
            desc = d in self.descending
            if d in self.index or memo[d] is not None:
                labels = self.index[d] if d in self.index else memo[d][::-1] if desc else memo[d]
                schema = T.StructType([T.StructField(d, types[d]), T.StructField("pos", T.IntegerType(), False)])
                out[d] = mark_small(self.spark.createDataFrame([(v, i) for i, v in enumerate(labels)], schema))
            else:
                out[d] = self._numbered_on_cluster(d, desc, types[d])
        return out

    def _numbered_on_cluster(self, d: str, desc: bool, dtype) -> DataFrame:
        """Positions of a dimension too large to be a coordinate: a range-
        partitioned sort, then consecutive numbers from per-partition counts
        (zipWithIndex), so no single task ever holds all the labels."""
        order = F.col(d).desc() if desc else F.col(d).asc()
        labels = self.cells.select(d).distinct().filter(F.col(d).isNotNull()).orderBy(order)
        indexed = labels.rdd.zipWithIndex().map(lambda t: (t[0][0], int(t[1])))
        schema = T.StructType([T.StructField(d, dtype), T.StructField("pos", T.IntegerType(), False)])
        return self.spark.createDataFrame(indexed, schema)

    def _collect_labels(self, todo: list[str], types) -> dict[str, list | None]:
        """Distinct labels of several dims in one pass: each row is tagged
        once per dim, de-duplicated map-side and on the shuffle (no task ever
        holds more than its share), and at most ``MAX_AXIS_LABELS`` per dim
        reach the driver; a larger dim gets None (numbered on the cluster)."""
        tagged = F.array(*[
            F.struct(F.lit(i).alias("_k"),
                     *[(F.col(x) if x == d else F.lit(None).cast(types[x])).alias(x) for x in todo])
            for i, d in enumerate(todo)])
        labels = (self.cells.select(F.explode(tagged).alias("_e")).select("_e.*").distinct())
        cap = MAX_AXIS_LABELS * len(todo) + 1
        rows = labels.limit(cap).collect()
        found: dict[str, list] = {d: [] for d in todo}
        for r in rows:
            d = todo[r["_k"]]
            if r[d] is not None:
                found[d].append(r[d])
        if len(rows) < cap:
            return {d: sorted(v) for d, v in found.items()}
        out = {}
        for d in todo:  # rare: some dim is not coordinate-sized; check each alone
            few = self.cells.select(d).distinct().filter(F.col(d).isNotNull()).limit(MAX_AXIS_LABELS + 1).collect()
            out[d] = sorted(r[0] for r in few) if len(few) <= MAX_AXIS_LABELS else None
        return out

    # -------------------------------------------------------------- coords
    def with_coords(self, *names: str) -> DataFrame:
        """``cells`` with the named aux coordinates added as columns."""
        return self._attach(self.cells, names or tuple(self.coords))

    def _attach(self, df: DataFrame, names) -> DataFrame:
        wanted: list[str] = []

        def need(n: str):
            for r in self.coords[n].requires:
                need(r)
            if n not in wanted:
                wanted.append(n)

        for n in names:
            need(n)
        for name in wanted:
            if name in df.columns:
                continue
            c = self.coords[name]
            if c.expr is not None:
                df = df.withColumn(name, c.expr)
            else:
                cols = [*c.dims, name, *c.extra]
                df = join_small(df, c.table.select(*cols), list(c.dims), "left")
        return df

    def coord_frame(self, name: str) -> DataFrame:
        """The coordinate as its own small table keyed by its dims."""
        c = self.coords[name]
        if c.table is not None:
            return c.table.select(*c.dims, name, *c.extra)
        keys = self.cells.select(*c.dims).distinct()
        return self._attach(keys, [name]).select(*c.dims, name)

    # -------------------------------------------------------------- metadata
    def attrs_frame(self) -> DataFrame:
        """Attributes as a table ``(var, key, value)``; dataset attrs have var ''."""
        rows = [("", k, v) for k, v in self.ds_attrs.items()]
        for var in self.variables:
            rows += [(var, k, str(v)) for k, v in self.var_attrs(var).items()]
        schema = T.StructType([T.StructField(n, T.StringType(), False)
                               for n in ("var", "key", "value")])
        return self.spark.createDataFrame(rows, schema)

    def stamped(self) -> DataFrame:
        """``cells`` with each column's attrs written into column metadata."""
        cols = []
        for name in self.cells.columns:
            meta = {"attrs": dict(self.var_attrs(name))}
            if name in self.encodings:
                meta["encoding"] = dict(self.encodings[name])
            cols.append(F.col(name).alias(name, metadata=meta))
        return self.cells.select(*cols)


def ensure_list(x: str | Iterable[str] | None) -> list[str]:
    """Options accept one name or a list of names."""
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)
