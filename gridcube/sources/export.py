"""Export sink: a selected cube prepared the way a data request is served.

The preparation follows the reference's response adapter: every data
variable gets its ``coordinates`` attr, scalar coordinates and dataset attrs
containing a double quote are dropped, one element is probed so a broken
source fails before anything is written, coordinates become columns, and
time dimensions are CF-encoded (other timestamps such as ``target`` stay
TIMESTAMP_NTZ). The result is written with any Spark file format; variable
attrs travel in the column metadata (Parquet keeps it) and the dataset
attrs in a small ``attrs`` table next to the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcube.functions.cf import cf_encode
from gridcube.model import GridCube
from gridcube.operators.schema import coordinates_attr, drop_scalar_coords
from gridcube.operators.select import probe_first


def prepare_export(cube: GridCube, probe: bool = True) -> GridCube:
    out = coordinates_attr(cube)
    out = drop_scalar_coords(out)
    out = out.replace(ds_attrs={k: v for k, v in out.ds_attrs.items()
                                if not isinstance(v, str) or '"' not in v})
    if probe and out.data_vars:
        probe_first(out).collect()  # raises here if the source is broken
    # coordinates are computed from the decoded dims, then the dims are encoded
    if out.coords:
        out = out.replace(cells=out.with_coords(), coords={})
    return cf_encode(out)


def export_cube(cube: GridCube, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                probe: bool = True) -> GridCube:
    """Write the prepared cube (cells with its coordinates as columns) to ``path``."""
    out = prepare_export(cube, probe)
    cols = [F.col(c).alias(c, metadata={"attrs": dict(out.var_attrs(c))}) for c in out.cells.columns]
    out.cells.select(*cols).write.mode(mode).format(fmt).save(f"{path}/data")
    out.attrs_frame().filter(F.col("var") == "").write.mode(mode).parquet(f"{path}/attrs")
    return out
