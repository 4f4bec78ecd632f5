"""Cube stores on a shared file system.

Layout of a store at ``root``:

* ``root/cells/<time dim>=<start>/*.parquet`` — the long cell table, one
  partition per start (like one slice per start in a chunked array), so a
  predicate on the start is a partition filter; sorted by the dims inside each
  file (repeated coordinates compress to almost nothing with dictionary +
  RLE, and row-group statistics prune label predicates on every dim). New
  starts are written with dynamic partition overwrite, so re-running a
  failed or repeated load replaces exactly those starts: appends are
  idempotent, and the stored time axis is the set of partition values;
* ``root/meta/`` — one JSON text row with dims, data vars, attrs, encodings
  and axis directions (written through Spark, so any Hadoop file system works);
* ``root/index/`` — the labels of every dimension in stored order (see
  ``sources.index``): opening, slicing and describing a cube reads no cell;
* ``root/coords/<name>/`` — auxiliary coordinates as small tables;
* ``root/chunks/`` (packed layout only) — one row per (S, M, P, L) holding each
  variable's Y x X grid as an array in stored order, and in ``_present`` which
  grid points have a cell, so that a missing value and an absent cell differ.
"""

from __future__ import annotations

import datetime
import json
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcube.model import Axes, Coord, GridCube, Packed
from gridcube.plans.strategy import join_small, localize, mark_small
from gridcube.sources.index import INDEX, AxisMismatch, dict_types, extended, labels_of, load_index, save_index

# Files hold at most this many rows (about 64 MB of float cells with their coords).
MAX_RECORDS_PER_FILE = 8_000_000
# Column of a packed chunk: whether a grid point has a cell.
PRESENT = "_present"


class StoreError(Exception):
    pass


def _time_dim(cube: GridCube) -> str:
    for d in (Axes.INGEST_TIME, Axes.S):
        if d in cube.dims:
            return d
    return cube.dims[0]


def _meta(cube: GridCube, layout: str, grid: tuple[str, str] | None = None,
          fixed_axes: dict | None = None, schemas: dict | None = None,
          extra: dict | None = None) -> str:
    return json.dumps({
        **(extra or {}),
        "fixed_axes": fixed_axes or {},
        "schemas": schemas or {},
        "dims": list(cube.dims), "data_vars": list(cube.data_vars),
        "attrs": {k: dict(v) for k, v in cube.attrs.items()},
        "ds_attrs": dict(cube.ds_attrs),
        "encodings": {k: dict(v) for k, v in cube.encodings.items()},
        "descending": sorted(cube.descending), "bare_dims": sorted(cube.bare_dims),
        "layout": layout, "grid": list(grid) if grid else None,
        "time_dim": _time_dim(cube),
        "grid_types": {d: k for d, k in cube.cells.dtypes if grid and d in grid},
    }, sort_keys=True)


def _write_meta(spark: SparkSession, root: str, meta: str) -> None:
    spark.createDataFrame([(meta,)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{root}/meta")


def read_meta(spark: SparkSession, root: str) -> dict:
    """The store's metadata. Only a missing folder means that there is no
    store (``StoreError``); any other failure to read it is raised as it is,
    so that nobody takes a store for absent and writes over it."""
    try:
        row = spark.read.text(f"{root}/meta").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise StoreError(f"No store exists at {root}") from e
        raise
    if row is None:
        raise RuntimeError(f"the metadata of the store at {root} is empty or half written")
    return json.loads(row[0])


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder on the store's file system (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(p, True))


def store_exists(spark: SparkSession, root: str) -> bool:
    try:
        read_meta(spark, root)
        return True
    except StoreError:
        return False


def _partitions(df: DataFrame, t: str) -> list[str]:
    """Partition by the start itself, whatever its type (read back with the
    stored schema, so the type stays), so that an append replaces the starts
    it brings and no others."""
    return [t] if t in df.columns else []


def write_cube(cube: GridCube, root: str, mode: str = "errorifexists", layout: str = "cells",
               grid: tuple[str, str] = (Axes.Y, Axes.X), fixed_axes: dict | None = None,
               extra_meta: dict | None = None, conform=()) -> None:
    """Write ``cube`` to ``root``.

    ``mode``: ``errorifexists`` / ``overwrite`` (replace the whole store) /
    ``append`` (add or replace whole starts: dynamic partition overwrite).
    ``fixed_axes`` records axes that never grow (members, levels, leads of
    the file set) so later loads check new files without scanning cells.
    One rebalance exchange clusters rows by start (skew-split by AQE); rows
    are then sorted by the dims inside each task before the partitioned write.

    The labels of all dimensions are kept in stored order: those of the cube's
    index as they are, others ascending (or descending, as the cube says). An
    appended start comes after the stored ones. On the dimensions ``conform``,
    and on the grid of a packed store (chunks are laid out by the stored axes),
    a label that the stored or declared axis lacks is an error before anything
    is written; elsewhere it comes after the stored ones. Auxiliary coordinates over dimensions are written as small tables.
    """
    spark = cube.spark
    t = _time_dim(cube)
    existed = store_exists(spark, root)
    appends = mode == "append" and existed
    writer_mode = "overwrite" if mode == "append" else mode
    if existed and mode == "errorifexists":
        raise StoreError(f"there is a store at {root} already")

    before = read_meta(spark, root) if appends else None
    if appends and before["layout"] != layout:
        if before["layout"] == "packed":
            layout, grid = "packed", tuple(before["grid"])
        else:
            raise StoreError(f"the store at {root} has the layout {before['layout']!r}, not {layout!r}")
    types = {d: k for d, k in cube.cells.dtypes if d in cube.dims}
    stored = stored_index(spark, root, before) if appends else None
    index = dict(cube.index)
    if appends or layout == "packed" or not existed:
        scanned = [d for d in cube.dims if d not in index]
        for d, labels in (labels_of(cube.cells, scanned) if scanned and (appends or layout == "packed") else {}).items():
            index[d] = labels[::-1] if d in cube.descending else labels
    declared = [d for d in conform if d in cube.index]
    if declared:
        extended(cube.index, labels_of(cube.cells, declared), conform)
    if appends:
        index = extended(stored, index, conform)
        if layout == "packed":
            for d in grid:
                if index.get(d) != stored.get(d):
                    raise AxisMismatch(f"a packed store keeps its {d} axis; the appended cube has other labels")

    schemas = {}

    def write(df: DataFrame, sub: str, order: list[str]) -> None:
        parts = _partitions(df, t)
        schemas[sub] = df.schema.json()
        if parts:
            # gather each start's rows (AQE splits a hot start over several
            # tasks and merges small ones), so files are few and full-sized
            df = df.hint("rebalance", *parts)
        w = (df.sortWithinPartitions(*parts, *order).write.mode(writer_mode)
               .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE))
        if mode == "append":
            w = w.option("partitionOverwriteMode", "dynamic")
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(f"{root}/{sub}")

    remove_path(spark, f"{root}/{INDEX}")  # until the cells are whole again
    if layout == "cells":
        write(cube.cells, "cells", list(cube.dims))
        if not appends:  # from the written files: their dims are a few bytes a row, and nothing is computed twice
            scanned = [d for d in cube.dims if d not in index]
            written = spark.read.schema(cube.cells.schema).parquet(f"{root}/cells")
            for d, labels in (labels_of(written, scanned) if scanned else {}).items():
                index[d] = labels[::-1] if d in cube.descending else labels
    elif layout == "packed":
        laid_out = cube.packed is not None and cube.packed.grid == tuple(grid) and PRESENT in cube.packed.frame.columns \
            and all(cube.index.get(d) == index.get(d) for d in grid)
        keys = [c for c in cube.dims if c not in grid]
        chunks = cube.packed.frame.select(*keys, *cube.data_vars, PRESENT) if laid_out else \
            pack_chunks(cube.replace(index=index), grid)
        write(chunks, "chunks", keys)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    tables = _write_coords(cube, root, before, types)
    if not appends:
        extra = dict(extra_meta or {})
        extra["table_coords"] = {**extra.get("table_coords", {}), **{n: list(d) for n, (d, _) in tables.items()}}
        extra["coord_extra"] = {n: list(more) for n, (_, more) in tables.items() if more}
        _write_meta(spark, root, _meta(cube, layout, grid if layout == "packed" else None, fixed_axes,
                                       schemas, extra))
    save_index(spark, root, index, types)


def _write_coords(cube: GridCube, root: str, before: dict | None, types: dict) -> dict[str, tuple]:
    """Write auxiliary coordinates as tables; (dims, extra columns) of each. On
    an append, rows of the keys that come again replace the stored ones, and
    coordinates that the store does not have are left out, as variables are."""
    out = {}
    for name, c in cube.coords.items():
        if not c.dims or not set(c.dims) <= set(types):
            continue
        path, keys = f"{root}/coords/{name}", list(c.dims)
        table = cube.coord_frame(name)
        if before is not None:
            if name not in before.get("table_coords", {}):
                continue
            old = localize(cube.spark.read.parquet(path))
            table = localize(table).unionByName(old.join(table.select(*keys), keys, "left_anti"))
            table = localize(table)
        table.coalesce(1).write.mode("overwrite").parquet(path)
        out[name] = (c.dims, c.extra)
    return out


def stored_index(spark: SparkSession, root: str, meta: dict) -> dict[str, tuple]:
    """The labels of a store's dimensions in stored order, from its index; only
    where there is none (an older store, a load that broke off) from a pass
    over the cells, in ascending order but for descending dimensions."""
    sub = "chunks" if meta["layout"] == "packed" else "cells"
    stored = _read(spark, root, meta, sub)
    kinds = json.loads(meta["schemas"][sub])["fields"] if meta.get("schemas", {}).get(sub) else []
    types = {d: k for d, k in stored.dtypes if d in meta["dims"]} | meta.get("grid_types", {})
    found = load_index(spark, root, types) if kinds else None
    if found is None:
        scanned = labels_of(stored, [d for d in meta["dims"] if d in stored.columns])
        found = {d: v[::-1] if d in meta["descending"] else v for d, v in scanned.items()}
        for d in meta["grid"] or []:  # an older packed store
            axis = spark.read.parquet(f"{root}/axes/{d}").orderBy("pos")
            found[d] = tuple(r[d] for r in axis.collect())
    return found


def _read(spark: SparkSession, root: str, meta: dict, sub: str) -> DataFrame:
    schema = meta.get("schemas", {}).get(sub)
    reader = spark.read.schema(T.StructType.fromJson(json.loads(schema))) if schema else spark.read
    return reader.parquet(f"{root}/{sub}")


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """The cells of a store as they are written."""
    return _read(spark, root, read_meta(spark, root), "cells")


def stored_times(spark: SparkSession, root: str) -> DataFrame:
    """Distinct starts already in the store, taken from the partition
    directory names that Spark's file index has already listed: no job and no
    cell data is read. Falls back to a scan of the partition column when a
    name cannot be parsed or there are too many starts for a small table."""
    from gridcube.plans.strategy import MAX_LOCAL_ROWS, mark_small
    meta = read_meta(spark, root)
    sub = "chunks" if meta["layout"] == "packed" else "cells"
    t = meta["time_dim"]
    df = _read(spark, root, meta, sub)
    if dict(df.dtypes).get(t) == "timestamp_ntz":
        pattern = re.compile(rf"/{re.escape(t)}=([^/]+)/")
        values, parsed_all = set(), True
        for f in df.inputFiles():
            m = pattern.search(f)
            if m is None:
                parsed_all = False
                break
            try:
                # file index paths are URIs (one level of %-encoding) over
                # Spark's escaped partition value (a second level)
                values.add(datetime.datetime.fromisoformat(unquote(unquote(m.group(1)))))
            except ValueError:
                parsed_all = False
                break
        if parsed_all and len(values) <= MAX_LOCAL_ROWS:
            return mark_small(spark.createDataFrame([(v,) for v in sorted(values)], f"{t} timestamp_ntz"))
    return df.select(t).distinct()


def read_cube(spark: SparkSession, root: str, drop_variables=(), decode_times: bool = True,
              decode_cf: bool = True) -> GridCube:
    """Open a store read-only; ``drop_variables`` are pruned from the scan.

    With ``decode_cf``, packed variables (``_FillValue`` / ``missing_value`` /
    ``scale_factor`` / ``add_offset`` attrs) are unpacked on read; with
    ``decode_times=False`` time coordinates stay CF-encoded integers."""
    meta = read_meta(spark, root)
    drop = set(drop_variables)
    data_vars = tuple(v for v in meta["data_vars"] if v not in drop)
    dims = tuple(meta["dims"])
    index = stored_index(spark, root, meta)
    packed = None
    if meta["layout"] == "packed":
        chunks, grid = _read(spark, root, meta, "chunks"), tuple(meta["grid"])
        packed = Packed(chunks.drop(*drop), grid, meta.get("grid_types", {}))
        cells = unpack_chunks(chunks, dims, data_vars, grid, index, packed.types)
        coords = {}
    else:
        raw = _read(spark, root, meta, "cells")
        cells = raw.select(*dims, *data_vars)
        # coordinates stored with the cells / in their own small tables
        coords = {n: Coord(tuple(d), table=raw.select(*d, n))
                  for n, d in meta.get("cell_coords", {}).items() if n not in drop}
    more = meta.get("coord_extra", {})
    coords.update({n: Coord(tuple(d), table=spark.read.parquet(f"{root}/coords/{n}"), extra=tuple(more.get(n, ())))
                   for n, d in meta.get("table_coords", {}).items() if n not in drop})
    cube = GridCube(
        cells=cells, dims=dims, data_vars=data_vars, coords=coords,
        attrs={k: v for k, v in meta["attrs"].items() if k not in drop},
        ds_attrs=meta["ds_attrs"], encodings=meta["encodings"],
        descending=frozenset(meta["descending"]), bare_dims=frozenset(meta["bare_dims"]),
        index=index, packed=packed,
    )
    if decode_cf:
        from gridcube.sources.packed import map_values
        from gridcube.functions.cf import mask_and_scale
        encoded = {v: (lambda x, a=cube.var_attrs(v): mask_and_scale(x, a)) for v in cube.data_vars
                   if any(k in cube.var_attrs(v) for k in ("_FillValue", "missing_value",
                                                            "scale_factor", "add_offset"))}
        if encoded:
            attrs = {k: {a: b for a, b in v.items() if a not in ("_FillValue", "missing_value",
                                                                  "scale_factor", "add_offset")}
                     if k in encoded else v for k, v in cube.attrs.items()}
            cube = map_values(cube, encoded, attrs=attrs)
    if not decode_times:
        from gridcube.functions.calendar import encode_time, parse_units
        cols = {}
        for d, e in cube.encodings.items():
            if d in cube.cells.columns and "units" in e and " since " in e["units"]:
                cols[d] = encode_time(F.col(d), parse_units(e["units"]))
        cube = cube.replace(cells=cube.cells.withColumns(cols))
    return cube


def pack_chunks(cube: GridCube, grid: tuple[str, str] = (Axes.Y, Axes.X)) -> DataFrame:
    """Cells -> one row per non-grid key with each variable's grid as an array
    laid out by the cube's axes, and ``_present``: true where a cell is. A
    chunk is bounded by the grid. The cells of a chunk are put in order and the
    gaps between them filled, so the work grows with the grid, not its square.
    A label that an indexed axis lacks is an error when the chunk is written."""
    gy, gx = grid
    axes = cube.axes([gy, gx])
    ny, nx = (axes[d].count() for d in grid)
    keys = [d for d in cube.dims if d not in grid]
    c = cube.cells
    for d, name in ((gy, "_py"), (gx, "_px")):
        c = join_small(c, axes[d].select(d, F.col("pos").alias(name)), d, "left")
        lost = F.raise_error(F.concat(F.lit(f"not on the {d} axis: "), F.coalesce(F.col(d).cast("string"), F.lit("null"))))
        c = c.withColumn(name, F.coalesce(F.col(name), lost.cast("int")))
    cell = F.struct((F.col("_py") * F.lit(nx) + F.col("_px")).alias("i"), *[F.col(v) for v in cube.data_vars])
    g = c.groupBy(*keys).agg(F.collect_list(cell).alias("_cells"))
    g = g.select(*keys, F.array_sort("_cells", lambda a, b: a["i"] - b["i"]).alias("_cells"))

    def dense(value, empty):
        """The values of the cells with ``empty`` before, between and behind."""
        def gap(of, upto):
            return F.array_repeat(empty, upto - of - 1)
        cells = F.col("_cells")
        runs = F.transform(cells, lambda e, k: F.concat(
            F.array(value(e)), gap(e["i"], F.coalesce(F.get(cells, k + 1)["i"], F.lit(ny * nx)))))
        return F.flatten(F.concat(F.array(gap(F.lit(-1), F.get(cells, F.lit(0))["i"])), runs))

    types = dict(cube.cells.dtypes)
    return g.select(*keys, *[dense(lambda e, v=v: e[v], F.lit(None).cast(types[v])).alias(v) for v in cube.data_vars],
                    dense(lambda e: F.lit(True), F.lit(False)).alias(PRESENT))


def unpack_chunks(chunks: DataFrame, dims, data_vars, grid, index, types) -> DataFrame:
    """Inverse of ``pack_chunks``: one row per grid point that has a cell, also
    where all its variables are missing or dropped. In stores without
    ``_present``, points where every variable is NULL count as absent."""
    gy, gx = grid
    keys = [d for d in dims if d not in grid]
    nx = len(index[gx])
    marked = PRESENT in chunks.columns
    columns = [*data_vars, *([PRESENT] if marked else [])]
    ex = chunks.select(*keys, F.posexplode(F.arrays_zip(*[F.col(v) for v in columns])).alias("_i", "_v"))
    there = F.col(f"_v.{PRESENT}") if marked else F.coalesce(*[F.col(f"_v.{v}").isNotNull() for v in data_vars]) \
        if len(data_vars) == 1 else F.greatest(*[F.col(f"_v.{v}").isNotNull() for v in data_vars])
    ex = ex.filter(there).select(*keys, F.floor(F.col("_i") / F.lit(nx)).cast("int").alias("_py"),
                                 (F.col("_i") % F.lit(nx)).cast("int").alias("_px"),
                                 *[F.col(f"_v.{v}").alias(v) for v in data_vars])
    for d, name in ((gy, "_py"), (gx, "_px")):
        rows = [(v, i) for i, v in enumerate(index[d])]
        kind = types.get(d) or chunks.sparkSession.createDataFrame(rows[:1], [d, name]).dtypes[0][1]
        ex = join_small(ex, mark_small(chunks.sparkSession.createDataFrame(rows, f"{d} {kind}, {name} int")), name)
    return ex.select(*dims, *data_vars)
