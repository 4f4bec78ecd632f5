"""The stored coordinate index, and the packed layout by the stored axes."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridcube.model import Coord, GridCube
from gridcube.operators.align import align_to
from gridcube.operators.harmonize import axis_position, standardize_y
from gridcube.operators.quality import cube_shape
from gridcube.operators.schema import describe_cube, rename
from gridcube.operators.select import probe_first
from gridcube.sources import store as ST
from gridcube.sources.index import AxisMismatch, fingerprint

DAYS = [dt.datetime(2001, m, 1) for m in (1, 2, 3)]
SCHEMA = "S timestamp_ntz, Y double, X int, tas double, pr float"


def cube_of(spark, points, **more):
    rows = [(DAYS[s], float(y), x, None if v is None else float(v), None if v is None else v / 2) for s, y, x, v in points]
    return GridCube(cells=spark.createDataFrame(rows, SCHEMA), dims=("S", "Y", "X"), data_vars=("tas", "pr"), **more)


class Jobs:
    """Counts Spark jobs and refuses scans of cells."""

    def __init__(self, spark):
        self.tracker, self.sc = spark.sparkContext.statusTracker(), spark.sparkContext

    def __enter__(self):
        self.group = f"jobs-{id(self)}"
        self.sc.setJobGroup(self.group, "counted")
        return self

    def __exit__(self, *_):
        self.n = len(self.tracker.getJobIdsForGroup(self.group))
        self.sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def store(spark, tmp_path):
    points = [(s, y, x, 100 * s + 10 * y + x) for s in range(2) for y in (5, 1, 3) for x in (7, 9)]
    cube = cube_of(spark, points).with_index(Y=[5.0, 1.0, 3.0], X=[7, 8, 9])
    ST.write_cube(cube, f"{tmp_path}/s", mode="overwrite")
    return f"{tmp_path}/s"


def test_stored_order_survives(spark, store):
    cube = ST.read_cube(spark, store)
    assert cube.index == {"S": tuple(DAYS[:2]), "Y": (5.0, 1.0, 3.0), "X": (7, 8, 9)}
    assert [tuple(r) for r in cube.axis("Y").orderBy("pos").collect()] == [(5.0, 0), (1.0, 1), (3.0, 2)]
    assert {r["pos"] for r in cube.axis("X").collect()} == {0, 1, 2}
    assert cube.sizes() == {"S": 2, "Y": 3, "X": 3}


def test_a_store_is_sliced_without_a_job_over_cells(spark, store):
    cube = ST.read_cube(spark, store)
    with Jobs(spark) as jobs:
        part = cube.isel(S=0, Y=slice(0, 2), X=[2, 0])
        probe = probe_first(cube)
        described = describe_cube(cube, with_sizes=False)
        flipped = standardize_y(rename(cube, {"X": "lon"}), True)
        numbered = axis_position(cube, "Y")
    assert jobs.n == 0
    assert part.index == {"Y": (5.0, 1.0), "X": (9, 7)} and part.dims == ("Y", "X")
    assert sorted((r.Y, r.X, r.tas) for r in part.cells.collect()) == [(1.0, 7, 17.0), (1.0, 9, 19.0), (5.0, 7, 57.0), (5.0, 9, 59.0)]
    assert tuple(probe.first()) == (DAYS[0], 5.0, 7, 57.0)
    assert described.count() == 5
    assert flipped.index["Y"] == (3.0, 1.0, 5.0) and flipped.index["lon"] == (7, 8, 9)
    assert {r.Y for r in numbered.cells.where("tas IN (57, 17, 37)").collect()} == {0, 1, 2}
    scans = describe_cube(cube)._jdf.queryExecution().optimizedPlan().toString()
    assert "cells" not in scans and {r.name: r.size for r in describe_cube(cube).collect() if r.role == "dim"} == {"S": 2, "Y": 3, "X": 3}
    assert "InMemory" not in scans and [r.size for r in cube_shape(cube).collect()] == [2, 3, 3]


def test_isel_in_stored_order_equals_a_list(spark, store):
    cube = ST.read_cube(spark, store)
    labels = list(cube.index["Y"])
    for sel in (slice(None, None, -1), slice(1, None), slice(None, None, 2), slice(0, 1), slice(3, 9), [2, 2 - 3], [-1]):
        want = [labels[i] for i in sel] if isinstance(sel, list) else labels[sel]
        got = cube.isel(Y=sel)
        assert list(got.index["Y"]) == want
        assert {r.Y for r in got.cells.select("Y").distinct().collect()} == set(want)
    with pytest.raises(IndexError):
        cube.isel(Y=7)


def test_labels_are_looked_up_in_the_index(spark, store):
    cube = ST.read_cube(spark, store)
    assert cube.sel(X=8).cells.count() == 0  # a label without cells is a label
    assert cube.sel(Y=[3, 5]).index["Y"] == (5.0, 3.0)
    assert cube.sel(Y=slice(1, 3)).index["Y"] == (1.0, 3.0)
    assert cube.sel(S=slice("2001-02-01", None)).index["S"] == (DAYS[1],)
    for wrong in ({"X": 6}, {"Y": [5, 2]}, {"S": "2001-09-01"}):
        with pytest.raises(KeyError, match="not found"):
            cube.sel(**wrong)
        with pytest.raises(KeyError, match="not found"):
            cube.replace(index={}).sel(**wrong)
    other = cube.sel(S=DAYS[1])
    assert align_to(cube, other).index["S"] == (DAYS[1],)
    with pytest.raises(KeyError):
        align_to(other, cube, strict=True)


def test_index_follows_the_cells_or_goes(spark, store):
    cube = ST.read_cube(spark, store)
    assert cube.replace(cells=cube.cells.where("Y > 2")).index == {}
    assert cube.replace(descending=cube.descending ^ {"Y"}).index["Y"] == (3.0, 1.0, 5.0)
    for wrong in ([1.0, 1.0], [1.0, None]):
        with pytest.raises(ValueError, match="nulls or repeats"):
            cube.with_index(Y=wrong)
    with pytest.raises(KeyError):
        cube.with_index(Z=[1])


def test_appends_grow_the_starts_behind_the_old_ones(spark, store):
    more = cube_of(spark, [(2, 5, 9, 1.0), (2, 1, 7, 2.0)])
    ST.write_cube(more, store, mode="append", conform=("Y", "X"))
    assert ST.read_cube(spark, store).index == {"S": tuple(DAYS), "Y": (5.0, 1.0, 3.0), "X": (7, 8, 9)}
    strange = cube_of(spark, [(2, 5, 9, 1.0), (2, 6, 9, 1.0)])
    with pytest.raises(AxisMismatch, match="6.0"):
        ST.write_cube(strange, store, mode="append", conform=("Y", "X"))
    assert ST.read_cube(spark, store).index["Y"] == (5.0, 1.0, 3.0)
    assert ST.read_cube(spark, store).cells.count() == 14
    ST.write_cube(strange, store, mode="append")
    assert ST.read_cube(spark, store).index["Y"] == (5.0, 1.0, 3.0, 6.0)


def test_a_lost_index_is_found_again(spark, store):
    ST.remove_path(spark, f"{store}/index")
    cube = ST.read_cube(spark, store)
    assert cube.index == {"S": tuple(DAYS[:2]), "Y": (5.0, 3.0, 1.0), "X": (7, 9)}  # in the stored direction
    assert fingerprint((1.0, 2.0)) != fingerprint((2.0, 1.0))


def test_coordinates_are_stored_with_the_cube(spark, tmp_path):
    cube = cube_of(spark, [(s, y, 7, 1.0) for s in range(2) for y in (1, 2)])
    area = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "Y double, area double")
    late = cube.replace(coords={"area": Coord(("Y",), table=area), "next": Coord(("S",), expr=F.add_months("S", 1).cast("timestamp_ntz"))})
    ST.write_cube(late, f"{tmp_path}/c", mode="overwrite")
    more = cube_of(spark, [(1, 1, 7, 3.0), (2, 1, 7, 3.0)])
    more = more.replace(coords={"next": Coord(("S",), expr=F.add_months("S", 2).cast("timestamp_ntz"))})
    ST.write_cube(more, f"{tmp_path}/c", mode="append")
    back = ST.read_cube(spark, f"{tmp_path}/c")
    assert sorted(tuple(r) for r in back.coord_frame("area").collect()) == [(1.0, 10.0), (2.0, 20.0)]
    assert sorted(tuple(r) for r in back.coord_frame("next").collect()) == [
        (DAYS[0], DAYS[1]), (DAYS[1], dt.datetime(2001, 4, 1)), (DAYS[2], dt.datetime(2001, 5, 1))]


def cells_of(cube):
    return sorted((tuple(r) for r in cube.cells.collect()), key=str)


def test_packed_store_keeps_absent_and_missing_apart(spark, tmp_path):
    cube = cube_of(spark, [(0, 1, 7, 1.5), (0, 1, 9, None), (0, 3, 8, 2.5), (1, 3, 9, 3.5)])
    ST.write_cube(cube, f"{tmp_path}/p", mode="overwrite", layout="packed")
    chunk = spark.read.parquet(f"{tmp_path}/p/chunks").where("S = '2001-01-01'").first()
    assert chunk["tas"] == [1.5, None, None, None, 2.5, None] and chunk["_present"] == [True, False, True, False, True, False]
    back = ST.read_cube(spark, f"{tmp_path}/p")
    assert cells_of(back) == cells_of(cube) and dict(back.cells.dtypes)["tas"] == "double"
    assert ST.read_cube(spark, f"{tmp_path}/p", drop_variables=["tas"]).cells.count() == 4


def test_packed_append_is_laid_out_by_the_stored_axes(spark, tmp_path):
    first = cube_of(spark, [(0, y, x, 1.0) for y in (0, 1) for x in (0, 1)])
    ST.write_cube(first, f"{tmp_path}/p", mode="overwrite", layout="packed")
    ST.write_cube(cube_of(spark, [(1, 1, 1, 9.0)]), f"{tmp_path}/p", mode="append")
    back = ST.read_cube(spark, f"{tmp_path}/p")
    assert [tuple(r)[:4] for r in back.cells.where("tas = 9").collect()] == [(DAYS[1], 1.0, 1, 9.0)]
    assert back.index["S"] == tuple(DAYS[:2])
    with pytest.raises(AxisMismatch):
        ST.write_cube(cube_of(spark, [(2, 4, 1, 9.0)]), f"{tmp_path}/p", mode="append")
    assert ST.read_cube(spark, f"{tmp_path}/p").cells.count() == 5


def test_packing_grows_with_the_grid(spark):
    """A chunk of 65,160 points; by the square of the grid it would take minutes."""
    cells = spark.range(65_160).select(F.lit(DAYS[0]).cast("timestamp_ntz").alias("S"), (F.col("id") / 360).cast("int").alias("Y"),
                                       (F.col("id") % 360).cast("int").alias("X"), F.col("id").cast("float").alias("tas"))
    cube = GridCube(cells=cells.where("id % 3 != 1"), dims=("S", "Y", "X"), data_vars=("tas",)).with_index(Y=range(181), X=range(360))
    row = ST.pack_chunks(cube, ("Y", "X")).first()
    assert row["tas"] == [None if i % 3 == 1 else float(i) for i in range(65_160)] and sum(row["_present"]) == 43_440


def test_shared_folder_without_a_setting(tmp_path):
    """Only the context's folder is set: the key of a running session cannot be."""
    from gridcube import session

    class Context:
        master, folder = "local[2]", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("CANNOT_MODIFY_CONFIG")

    class Session:
        sparkContext, conf = Context(), Conf()

    assert session.ensure_checkpoint_dir(Session()) == Session.sparkContext.folder
