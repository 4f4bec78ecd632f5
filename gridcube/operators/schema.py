"""Projection and schema operators. None of these runs a job: they only
reshape the lazy plan and the driver-side metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcube.model import Axes, Coord, GridCube, ensure_list


class SchemaError(Exception):
    pass


def _rename_map(d: Mapping, m: Mapping[str, str]) -> dict:
    return {m.get(k, k): v for k, v in d.items()}


def rename(cube: GridCube, mapping: Mapping[str, str]) -> GridCube:
    """Provider -> standard names; absent names and identities are skipped."""
    present = set(cube.variables)
    m = {a: b for a, b in mapping.items() if a in present and a != b}
    if not m:
        return cube

    def r(n: str) -> str:
        return m.get(n, n)

    coords = {}
    for name, c in cube.coords.items():
        table = c.table
        if table is not None:
            table = table.withColumnsRenamed({k: v for k, v in m.items() if k in table.columns})
        expr = c.expr
        requires = c.requires
        if expr is not None and any(d in m for d in (*c.dims, *c.requires)):
            # expressions refer to columns by name: rebind through the table form
            if c.requires:
                table = cube.coord_frame(name).select(*c.dims, name).distinct()
            else:
                table = cube.cells.select(*c.dims).distinct().withColumn(name, expr)
            table = table.withColumnsRenamed({k: v for k, v in m.items() if k in c.dims or k == name})
            expr, requires = None, ()
        coords[r(name)] = Coord(tuple(r(d) for d in c.dims), expr, table,
                                tuple(r(e) for e in c.extra), tuple(r(q) for q in requires))
    return cube.replace(
        cells=cube.cells.withColumnsRenamed({k: v for k, v in m.items() if k in cube.cells.columns}),
        dims=tuple(r(d) for d in cube.dims),
        data_vars=tuple(r(v) for v in cube.data_vars),
        coords=coords,
        attrs=_rename_map(cube.attrs, m),
        encodings=_rename_map(cube.encodings, m),
        descending=frozenset(r(d) for d in cube.descending),
        bare_dims=frozenset(r(d) for d in cube.bare_dims),
        index={r(d): v for d, v in cube.index.items()},
    )


def select_data_vars(cube: GridCube, names: str | Iterable[str]) -> GridCube:
    """Keep only the listed data variables (dims and coords stay)."""
    keep = ensure_list(names)
    missing = [n for n in keep if n not in cube.data_vars]
    if missing:
        raise KeyError(f"data variables {missing} not found in {list(cube.data_vars)}")
    return cube.with_values(cube.cells.select(*cube.dims, *keep), data_vars=tuple(keep))


def drop_coords(cube: GridCube, names: str | Iterable[str]) -> GridCube:
    """Drop listed variables or coordinates; an unknown name is an error."""
    drop = ensure_list(names)
    unknown = [n for n in drop if n not in cube.variables]
    if unknown:
        raise KeyError(f"{unknown} not found in the cube")
    if any(n in cube.dims for n in drop):
        raise SchemaError(f"cannot drop dimension coordinates {[n for n in drop if n in cube.dims]}")
    cells_drop = [n for n in drop if n in cube.cells.columns]
    return cube.with_values(
        cells=cube.cells.drop(*cells_drop),
        data_vars=tuple(v for v in cube.data_vars if v not in drop),
        coords={k: c for k, c in cube.coords.items() if k not in drop},
        attrs={k: v for k, v in cube.attrs.items() if k not in drop},
    )


def set_aux_coords(cube: GridCube, names: str | Iterable[str],
                   dims: Mapping[str, Iterable[str]]) -> GridCube:
    """Reclassify data variables as coordinates keyed by their own dims, so
    they are not expanded along time. ``dims[name]`` names those dims."""
    coords = dict(cube.coords)
    for name in ensure_list(names):
        if name not in cube.data_vars:
            raise KeyError(f"{name} is not a data variable")
        own = tuple(dims[name])
        table = cube.cells.select(*own, name).dropDuplicates(list(own))
        coords[name] = Coord(own, table=table)
    moved = set(ensure_list(names))
    return cube.with_values(
        cells=cube.cells.drop(*moved),
        data_vars=tuple(v for v in cube.data_vars if v not in moved),
        coords=coords,
    )


def expand_coords(cube: GridCube, names: str | Iterable[str], dim: str = Axes.INGEST_TIME) -> GridCube:
    """Coordinates that vary with time: ``c`` becomes ``c_expanded`` keyed by
    ``dim`` as well, ``c`` is dropped, and a ``bounds`` attr naming ``c`` is
    repointed."""
    coords = dict(cube.coords)
    attrs = {k: dict(v) for k, v in cube.attrs.items()}
    for c in ensure_list(names):
        if c not in coords:
            raise KeyError(f"{c} is not a coordinate")
        old = coords.pop(c)
        new_name = f"{c}_expanded"
        new_dims = (dim, *[d for d in old.dims if d != dim])
        if not old.dims and old.table is not None:
            # a scalar coordinate held as a one-row table: it is one value
            old = Coord((), expr=F.lit(old.table.select(c).first()[0]))
        if old.expr is not None and not old.requires:
            coords[new_name] = Coord(new_dims, expr=old.expr)
        else:
            keys = cube.cells.select(*new_dims).distinct()
            base = cube.coord_frame(c) if old.table is None else old.table.select(*old.dims, c)
            table = keys.join(base, list(old.dims), "inner")
            coords[new_name] = Coord(new_dims, table=table.withColumnRenamed(c, new_name))
        if c in attrs:
            attrs[new_name] = attrs.pop(c)
        for a in attrs.values():
            if a.get("bounds") == c:
                a["bounds"] = new_name
    return cube.replace(coords=coords, attrs=attrs)


def drop_scalar_coords(cube: GridCube) -> GridCube:
    """Drop coordinates without dimensions."""
    return cube.replace(coords={k: c for k, c in cube.coords.items() if c.dims})


def narrow_float(cube: GridCube) -> GridCube:
    """float64 data variables -> float32; coordinates untouched."""
    types = dict(cube.cells.dtypes)
    cols = [F.col(c).cast("float").alias(c) if c in cube.data_vars and types[c] == "double"
            else F.col(c) for c in cube.cells.columns]
    return cube.with_values(cube.cells.select(*cols))


def drop_non_std(cube: GridCube, standard_attrs: Mapping[str, Mapping[str, str]],
                 bare_dims: Iterable[str]) -> GridCube:
    """Drop every variable not declared; a dimension whose coordinate is not
    declared becomes bare (positions). Errors: no data variable left; a
    dimension neither declared nor bare."""
    original = list(cube.data_vars)
    bare = set(bare_dims)
    keep_vars = tuple(v for v in cube.data_vars if v in standard_attrs)
    if not keep_vars:
        raise SchemaError(f"no data variable of {original} is declared")
    non_std = [d for d in cube.dims if d not in bare and d not in standard_attrs]
    if non_std:
        raise SchemaError(f"dimensions {non_std} are neither declared nor bare")
    out = cube
    # dimension coordinates that are not declared are dropped: the dim keeps positions
    for d in cube.dims:
        if d not in standard_attrs and d not in cube.bare_dims:
            from gridcube.operators.harmonize import axis_position
            out = axis_position(out, d)
            out = out.replace(bare_dims=out.bare_dims | {d})
    return out.with_values(
        cells=out.cells.select(*out.dims, *keep_vars),
        data_vars=keep_vars,
        coords={k: c for k, c in out.coords.items() if k in standard_attrs},
        attrs={k: v for k, v in out.attrs.items() if k in standard_attrs},
    )


def standardize_attrs(cube: GridCube, da_attrs: Mapping[str, Mapping[str, str]],
                      ds_attrs: Mapping[str, str],
                      encodings: Mapping[str, Mapping[str, str]]) -> GridCube:
    """Replace every coordinate's and data variable's attrs by the declared
    ones (undeclared target coordinates get empty attrs); set declared
    encodings; dataset attrs lose ``GRIB*`` keys and gain ours (ours win)."""
    names = [d for d in cube.dims if d not in cube.bare_dims] + list(cube.coords) + list(cube.data_vars)
    attrs = {}
    enc = {k: dict(v) for k, v in cube.encodings.items()}
    for name in names:
        if name in da_attrs:
            attrs[name] = dict(da_attrs[name])
        elif name in (Axes.target, Axes.target_bnds):
            attrs[name] = {}
        else:
            raise KeyError(name)
        if name in encodings:
            enc[name] = dict(encodings[name])
    new_ds = {k: v for k, v in cube.ds_attrs.items() if not k.startswith("GRIB")}
    new_ds.update(ds_attrs)
    return cube.replace(attrs=attrs, ds_attrs=new_ds, encodings=enc)


def filter_attrs(attrs: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Drop attrs whose value contains a double quote, and ignored keys
    (e.g. ``history``, ``source`` when comparing snapshots)."""
    out = attrs.filter(~F.col("value").contains('"'))
    ignore = list(ignore)
    if ignore:
        out = out.filter(~F.col("key").isin(ignore))
    return out


def coordinates_attr(cube: GridCube) -> GridCube:
    """For each data variable: ``coordinates`` = its existing words plus
    ``target`` and ``target_bnds`` when it has dim S (sorted, space joined)."""
    attrs = {k: dict(v) for k, v in cube.attrs.items()}
    for v in cube.data_vars:
        a = attrs.setdefault(v, {})
        words = set(a.get("coordinates", "").split())
        if Axes.S in cube.dims:
            words |= {Axes.target, Axes.target_bnds}
        if words:
            a["coordinates"] = " ".join(sorted(words))
    return cube.replace(attrs=attrs)


def coordinates_attr_col(existing, has_s):
    """Column form of ``coordinates_attr`` for attrs stored as a table."""
    words = F.filter(F.split(F.coalesce(existing, F.lit("")), r"\s+"), lambda w: w != "")
    extra = F.array(F.lit(Axes.target), F.lit(Axes.target_bnds))
    merged = F.array_sort(F.when(has_s, F.array_union(words, extra)).otherwise(F.array_distinct(words)))
    return F.when(F.size(merged) > 0, F.array_join(merged, " "))


def describe_cube(cube: GridCube, with_sizes: bool = True) -> DataFrame:
    """Export schema: one row per variable (name, role, dims, dtype, attrs),
    datetime coordinates also show their encoding ``units``/``calendar``;
    with ``with_sizes`` the dimension sizes are counted from the data."""
    types = dict(cube.cells.dtypes)
    rows = []
    for d in cube.dims:
        a = dict(cube.var_attrs(d))
        if types.get(d, "").startswith("timestamp"):
            e = cube.encodings.get(d, {})
            for k in ("units", "calendar"):
                if k in e:
                    a[k] = e[k]
        rows.append((d, "dim", ["/" + d], types.get(d, "int"), a))
    for name, c in cube.coords.items():
        if c.dims:
            rows.append((name, "coord", ["/" + x for x in c.dims], "", dict(cube.var_attrs(name))))
    for v in cube.data_vars:
        rows.append((v, "grid", ["/" + d for d in cube.dims], types[v], dict(cube.var_attrs(v))))
    schema = T.StructType([
        T.StructField("name", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("dims", T.ArrayType(T.StringType()), False),
        T.StructField("dtype", T.StringType(), False),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType()), False),
    ])
    out = cube.spark.createDataFrame(rows, schema)
    if with_sizes:
        from gridcube.operators.quality import cube_shape
        sizes = cube_shape(cube).withColumnRenamed("dim", "name")
        out = out.join(sizes, "name", "left")
    return out
