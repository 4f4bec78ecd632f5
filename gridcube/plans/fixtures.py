"""Forecast-shaped views of the driver's tables.

* ``cube``: a 5-D forecast cube (S, M, L, Y, X; tas, prate) aggregated from
  lineitem joined with orders. Start = month of the order, member and grid
  point from supplier/part keys, lead from the line number.
* ``listing``: a file listing with one "file" per order, named
  ``/data/run<orderkey>/fc_<yyyy-mm>_m<member>.nc``.
* ``file contents``: the lines of each order are that file's grid points.

Every view is a lazy plan over the parquet tables, so its work grows with them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcube.functions.calendar import month_start
from gridcube.model import GridCube
from gridcube.session import shared_dir
from gridcube.sources.decode import _uri

PROVIDER_NAMES = {"S": "init_time", "M": "number", "L": "step", "Y": "latitude", "X": "longitude"}
STANDARD_NAMES = {v: k for k, v in PROVIDER_NAMES.items()} | {"prate": "prcp"}

LISTING_PATTERN = r"fc_(?P<year>\d{4})-(?P<month>\d{2})_m(?P<member>\d+)\.nc$"
LISTING_PATTERN_ABBREV = r"fc_(?P<year>\d{4})-(?P<month>[A-Za-z]{3})_m(?P<member>\d+)\.nc$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _grid_cols(partkey: str = "l_partkey") -> dict:
    pk = F.col(partkey)
    return {
        "Y": (F.lit(90) - F.lit(45) * (pk % 5)).cast("double"),
        "X": (F.lit(90) * (F.expr(f"{partkey} div 5") % 4)).cast("double"),
    }


# Beside the line numbers (int) a cell can hold.
_NO_LINE = 1 << 31


def _cell() -> Column:
    """What decides a line's cell, as one number: the remainders of its part (six
    bits) and its supplier (three bits), then its line number; nulls count as well."""
    part = F.coalesce(F.col("l_partkey") % 20 + 20, F.lit(0))
    supplier = F.coalesce(F.col("l_suppkey") % 4 + 4, F.lit(0))
    line = F.coalesce(F.col("l_linenumber").cast("bigint"), F.lit(_NO_LINE))
    return line * 512 + supplier * 64 + part


def _of_cell(cell: str) -> dict:
    """The parts of a :func:`_cell`, each of the remainder that decides its labels."""
    part, supplier = F.col(cell).bitwiseAND(F.lit(63)), F.shiftright(cell, 6).bitwiseAND(F.lit(7))
    line = F.shiftright(cell, 9)
    return {
        "l_partkey": F.when(part > 0, part - 20),
        "l_suppkey": F.when(supplier > 0, supplier - 4),
        "l_linenumber": F.when(line != _NO_LINE, line.cast("int")),
    }


def cube_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture cube with standard names (S, M, L, Y, X, tas, prate).

    The join shuffles every line, so a line brings its key, its cell as one
    number and two values, and an order its month; labels are made from the
    cells once the lines are grouped."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", _cell().alias("cell"), "l_quantity", "l_discount")
    o = table(spark, sf_dir, "orders").select("o_orderkey", month_start(F.col("o_orderdate")).alias("S"))
    cells = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
               .groupBy("S", "cell")
               .agg((F.lit(250) + F.avg("l_quantity")).alias("tas"),
                    (F.max("l_discount") / F.lit(864000.0)).alias("prate")))
    g = _grid_cols()
    return cells.withColumns(_of_cell("cell")).select(
        "S",
        (F.col("l_suppkey") + 1).alias("M"),
        (F.col("l_linenumber") - 1).alias("L"),
        g["Y"].alias("Y"),
        g["X"].alias("X"),
        "tas", "prate")


RAW_ATTRS = {
    "tas": {"units": "K", "comment": "250 plus the mean quantity", "GRIB_level": "surface"},
    "prate": {"units": "kg m-2 s-1", "comment": "largest discount a day"},
    "latitude": {"units": "degrees_north"},
    "longitude": {"units": "degrees_east"},
    "init_time": {},
    "number": {},
    "step": {},
}
RAW_DS_ATTRS = {
    "GRIB_packing": "simple",
    "Conventions": "none",
    "title": "orders and their lines as forecasts",
    "history": "aggregated from lineitem",
}


def standard_cube(spark: SparkSession, sf_dir: str) -> GridCube:
    """The fixture cube with standard names and units K / kg m-2 s-1."""
    return GridCube(
        cells=cube_cells(spark, sf_dir),
        dims=("S", "M", "L", "Y", "X"),
        data_vars=("tas", "prate"),
        attrs={"tas": {"units": "K"}, "prate": {"units": "kg m-2 s-1"},
               "Y": {"units": "degree_north"}, "X": {"units": "degree_east"}},
        descending=frozenset({"Y"}),
    )


def computed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: written once, read by every pass
    over it, where each would scan, join and shuffle the driver's tables again."""
    path = shared_dir(df.sparkSession, "tables", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_cube(spark: SparkSession, sf_dir: str) -> GridCube:
    """:func:`standard_cube` for queries that pass over its cells more than once."""
    cube = standard_cube(spark, sf_dir)
    return cube.replace(cells=computed(cube.cells, "cube"))


def raw_cube(spark: SparkSession, sf_dir: str) -> GridCube:
    """The fixture cube as a provider delivers it (provider names, GRIB attrs)."""
    cells = cube_cells(spark, sf_dir).withColumnsRenamed(PROVIDER_NAMES)
    return GridCube(
        cells=cells,
        dims=tuple(PROVIDER_NAMES[d] for d in ("S", "M", "L", "Y", "X")),
        data_vars=("tas", "prate"),
        attrs=RAW_ATTRS,
        ds_attrs=RAW_DS_ATTRS,
        descending=frozenset({"latitude"}),
    )


# The harmonisation config of the fixture ensemble.
DA_ATTRS = {
    "S": {"axis": "T", "comment": "month of the order"},
    "L": {"comment": "months after the start, by line number"},
    "M": {"axis": "E", "comment": "supplier class"},
    "Y": {"axis": "Y", "units": "degree_north"},
    "X": {"axis": "X", "units": "degree_east"},
    "tas": {"units": "degree_Celsius", "comment": "from quantities"},
    "prcp": {"units": "mm/day", "comment": "from discounts"},
}
ENCODINGS = {"S": {"units": "hours since 1960-01-01", "calendar": "standard", "dtype": "int32"}}
DS_ATTRS = {"Conventions": "CF-1.11", "title": "harmonised orders"}


def ensemble_config(y_increasing: bool | None = None, lead_is_month: bool = True):
    from gridcube.operators.harmonize import DatasetConfig
    return DatasetConfig(da_attrs=DA_ATTRS, ds_attrs=DS_ATTRS, encodings=ENCODINGS,
                         bare_dims=(), lead_is_month=lead_is_month, y_increasing=y_increasing)


def listing(spark: SparkSession, sf_dir: str, month_names: bool = False) -> DataFrame:
    """One file per order: ``path``, ``modificationTime`` (plus the order key).
    800 orders share a member, ten of them a month: the newest counts, so one
    file in ten is read, however many orders there are."""
    o = table(spark, sf_dir, "orders")
    month = (F.date_format("o_orderdate", "yyyy-MMM") if month_names
             else F.substring(F.col("o_orderdate").cast("string"), 1, 7))
    path = F.concat(F.lit("/data/run"), F.col("o_orderkey").cast("string"), F.lit("/fc_"),
                    month, F.lit("_m"), F.expr("o_orderkey div 800 + 1").cast("string"), F.lit(".nc"))
    return o.select(path.alias("path"), F.col("o_orderdate").alias("modificationTime"),
                    F.col("o_orderkey"))


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded contents of every listed file: its grid points and values.

    Keyed by the file's order key; ``time`` is the file-internal start.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")
    g = _grid_cols()
    return li.select(
        F.col("l_orderkey").alias("o_orderkey"),
        (F.col("l_linenumber") - 1).alias("step"),
        g["Y"].alias("latitude"), g["X"].alias("longitude"),
        (F.lit(250) + F.col("l_quantity")).alias("tas"),
        (F.col("l_discount") / F.lit(864000.0)).alias("prate"),
    )


#: Files of one delivery (at least those of one start): a file stream keeps some
#: kilobytes for each file of its folder on the driver.
FILES_AT_ONCE = 30_000


def delivery_bounds(files: DataFrame) -> list:
    """The first start of every delivery but the first: a provider delivers the
    ``files`` in the order of their starts ``t``, as many starts at once as
    have ``FILES_AT_ONCE`` files."""
    bounds, held = [], 0
    for r in files.groupBy("t").agg(F.count("*").alias("n")).orderBy("t").collect():
        if held and held + r["n"] > FILES_AT_ONCE:
            bounds.append(r["t"])
            held = 0
        held += r["n"]
    return bounds


def delivery(start: Column, bounds: list) -> Column:
    """The number of the delivery, from 0, that the files of a start come with."""
    return sum((F.when(start >= F.lit(b).cast("timestamp_ntz"), 1).otherwise(0) for b in bounds), F.lit(0))


def write_files(cells: DataFrame, folder: str) -> None:
    """The rows of every ``file`` as a Parquet file of that name in ``folder``;
    a name may have folders of its own.
    A task writes its files one after the other (again, if it is run again):
    each costs a millisecond or two, where Spark's partitioned write makes a
    folder, a checksum and a rename for it."""
    spark = cells.sparkSession
    uri, columns = _uri(folder), [c for c in cells.columns if c != "file"]

    def write(table: pa.Table) -> pa.Table:
        import pyarrow as pa
        from pyarrow import fs, parquet
        name = table["file"][0].as_py()
        filesystem, root = fs.FileSystem.from_uri(uri)
        filesystem.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        with filesystem.open_output_stream(f"{root}/{name}") as out:
            parquet.write_table(table.select(columns), out)
        return pa.table({"rows": pa.array([len(table)], pa.int64())})

    # by number: adaptive execution would merge so few bytes into one task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    cells.repartition(tasks, "file").groupBy("file").applyInArrow(write, "rows bigint").agg(F.sum("rows")).first()


def listing_with_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing plus one ``.nc.idx`` index sidecar per file (never matched)."""
    base = listing(spark, sf_dir)
    side = base.withColumn("path", F.concat(F.col("path"), F.lit(".idx")))
    return base.unionByName(side)


def descriptor(pattern: str = LISTING_PATTERN, parse_match=None, name: str = "tas"):
    from gridcube.sources.listing import FileSetDescriptor
    return FileSetDescriptor(name=name, dir="/data", pattern=pattern, parse_match=parse_match)


def comparison_cube(spark: SparkSession, sf_dir: str, shift: bool = True, of: GridCube | None = None) -> GridCube:
    """The fixture cube (or ``of``, where it is computed already) as another
    service would return it: every tas off by 1e-9, the 1997-01-01 start off by
    1, latitudes off by 1e-9 (``shift``)."""
    c = of or standard_cube(spark, sf_dir)
    bump = F.when(F.col("S") == F.lit("1997-01-01").cast("timestamp_ntz"), F.lit(1.0)).otherwise(F.lit(0.0))
    cols = {"tas": F.col("tas") + F.lit(1e-9) + bump}
    if shift:
        cols["Y"] = F.col("Y") + F.lit(1e-9)
    return c.replace(cells=c.cells.withColumns(cols))


def decode_fixture_files(spark: SparkSession, sf_dir: str):
    """Decoder of the fixture file set: a file's contents are its order's lines."""
    contents = file_contents(spark, sf_dir)

    def decode(files: DataFrame) -> DataFrame:
        keyed = files.select("path", F.regexp_extract("path", r"/data/run(\d+)/", 1)
                             .cast("bigint").alias("o_orderkey"))
        from gridcube.plans.strategy import join_small
        return (join_small(contents, keyed, "o_orderkey")
                .drop("o_orderkey").withColumn("error", F.lit(None).cast("string")))
    return decode


def fixture_catalog(spark: SparkSession, sf_dir: str):
    """A three-level harmonised catalogue over the fixture cube:
    / (adds a distributor attr) -> ens (standardize) -> model (rename) ->
    hindcast (opens the provider cube, one variable per store)."""
    from gridcube.operators import harmonize as H
    from gridcube.operators.schema import rename, select_data_vars
    from gridcube.sources.catalog import Catalog

    def add_distributor(c):
        return c.replace(ds_attrs={**c.ds_attrs, "Distributor": "gridcube.example"})

    store_names = {"tas": "tas", "prcp": "prate"}
    return (Catalog(add_distributor)
            .register("/ens", transform=lambda c: H.standardize(c, ensemble_config()))
            .register("/ens/model", transform=lambda c: rename(c, STANDARD_NAMES))
            .register("/ens/model/hindcast", open=lambda v: select_data_vars(raw_cube(spark, sf_dir), store_names[v]),
                      list_vars=lambda: list(store_names))
            .register("/ens/scratch", hidden=True))
