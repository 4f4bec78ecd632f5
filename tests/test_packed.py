"""Chunks that stay chunks, snapshots by fingerprints, running failures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridcube.operators import harmonize as H
from gridcube.operators import quality as QL
from gridcube.operators import schema as SC
from gridcube.sources import store as ST
from gridcube.sources.decode import _uri


def rows(cube):
    return sorted(tuple(r) for r in cube.cells.select(*sorted(cube.cells.columns)).collect())


@pytest.fixture
def stored(spark, make_cube, tmp_path):
    """The same sparse cube from a packed store and from memory, Y from north to south."""
    cube = make_cube("tas", "K", starts=3, leads=2, lats=(-5.0, 0.0, 5.0), lons=(10.0, 20.0, 30.0, 40.0))
    hole = F.when(F.col("tas") % 7 != 3, F.col("tas"))
    cube = cube.replace(cells=cube.cells.where("CAST(tas AS INT) % 5 <> 2").withColumn("tas", hole), descending=frozenset({"Y"}))
    ST.write_cube(cube, f"{tmp_path}/packed", layout="packed")
    plain = cube.with_index(**{d: [r[d] for r in cube.axis(d).orderBy("pos").collect()] for d in cube.dims})
    return ST.read_cube(spark, f"{tmp_path}/packed"), plain


SELECTIONS = [{"Y": slice(0, 2)}, {"X": [3, 0]}, {"Y": slice(None, None, -1), "X": slice(1, None, 2)}, {"Y": [2, 0], "S": slice(1, None)},
              {"S": [2, 0], "L": slice(1, 2), "X": slice(0, 0)}, {"L": slice(None, None, -1), "Y": slice(1, 3)}]


@pytest.mark.parametrize("selection", SELECTIONS, ids=str)
def test_slices_of_chunks_equal_slices_of_cells(stored, selection):
    packed, plain = (c.isel(**selection) for c in stored)
    assert packed.packed is not None and packed.index == plain.index and packed.descending == plain.descending
    assert rows(packed) == rows(plain)
    assert "Generate" not in packed.packed.frame._jdf.queryExecution().optimizedPlan().toString()


def test_labels_and_units_on_chunks(spark, stored, tmp_path):
    out = []
    for c in stored:
        c = c.sel(Y=slice(0.0, None), X=[40.0, 10.0]).sel(L=1)
        out.append(H.convert_units(c.isel(X=slice(None, None, -1)), {"tas": {"units": "degree_Celsius"}}))
    packed, plain = out
    assert packed.packed is not None and packed.attrs["tas"] == {"units": "degree_Celsius"}
    assert rows(packed) == rows(plain) and packed.index == plain.index
    ST.write_cube(packed, f"{tmp_path}/again", layout="packed")
    again = ST.read_cube(spark, f"{tmp_path}/again")
    assert rows(again) == rows(plain) and again.index == plain.index
    with pytest.raises(KeyError):
        stored[0].sel(X=99.0)


def test_chunks_go_where_cells_change(stored):
    cube = stored[0]
    assert cube.replace(attrs={}).packed is not None
    for other in (cube.isel(Y=0), SC.rename(cube, {"tas": "t"}), H.standardize_y(cube, True), cube.replace(cells=cube.cells.limit(1))):
        assert other.packed is None
    assert rows(H.standardize_y(cube, True)) == rows(cube) and rows(cube.isel(S=0, X=1)) == rows(stored[1].isel(S=0, X=1))


def test_fill_values_are_masked_in_chunks(spark, make_cube, tmp_path):
    cube = make_cube(starts=1, leads=2)
    cube = cube.replace(cells=cube.cells.withColumn("prcp", F.col("prcp").cast("int")),
                        attrs={"prcp": {"_FillValue": 2, "scale_factor": 0.5}})
    ST.write_cube(cube, f"{tmp_path}/p", layout="packed")
    back = ST.read_cube(spark, f"{tmp_path}/p")
    assert back.packed is not None
    assert sorted(r.prcp for r in back.cells.where("prcp IS NOT NULL").collect()) == [k / 2 for k in (0, 1, 3, 4, 5, 6, 7)]
    assert back.cells.count() == 8


def test_snapshots_differ_as_multisets(spark):
    rng = random.Random(5)
    for _ in range(3):
        sides = [[(rng.randrange(4) or None, rng.choice([0.5, 1.5, math.nan, None])) for _ in range(12)] for _ in range(2)]
        sides[1] += [r for r in sides[0] if r[0] == 1]
        a, b = (spark.createDataFrame(s, "k int, v double") for s in sides)
        want = (a.exceptAll(b).count(), b.exceptAll(a).count())
        for by in (None, "k"):
            got = QL.snapshot_identical(a, b, by=by).first()
            assert (got.n_only_a, got.n_only_b) == want and got.identical == (want == (0, 0))
    same = QL.snapshot_identical(a, a.orderBy("v"), by="k").first()
    assert (same.n_only_a, same.n_only_b, same.identical) == (0, 0, True)


def test_running_failures_over_many_ranges(spark):
    rng = random.Random(9)
    failed = [rng.random() < 0.07 for _ in range(400)]
    failed[0] = False
    df = spark.createDataFrame([(k // 20, k % 20, "bad" if f else None) for k, f in enumerate(failed)], "t int, m int, error string")
    got = {(r.t, r.m): (r.n_done, r.n_failed) for r in QL.running_failures(df.repartition(7), ["t", "m"]).collect()}
    want = {(k // 20, k % 20): (k + 1, sum(failed[:k + 1])) for k in range(400)}
    assert got == want
    first = next((v for _, v in sorted(want.items()) if v[1] / v[0] > 0.1), None)
    assert QL.first_failing_prefix(df, ["t", "m"]) == first
    assert QL.first_failing_prefix(df.limit(0), ["t", "m"]) is None


@pytest.mark.parametrize("path, uri", [
    ("/a b/c.nc", "file:///a%20b/c.nc"), ("file:/a b", "file:///a%20b"), ("file:///x%20y", "file:///x%2520y"),
    ("s3a://bucket/a b", "s3://bucket/a%20b"), ("hdfs://host:9000/p", "hdfs://host:9000/p"), ("/time=10:00/f", "file:///time=10:00/f")])
def test_paths_as_uris(path, uri):
    assert _uri(path) == uri
