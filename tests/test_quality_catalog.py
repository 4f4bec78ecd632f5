"""Comparison operators, selection, densify and catalogues."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridcube.functions.compare import allclose
from gridcube.operators import align as AL
from gridcube.operators import quality as QL
from gridcube.operators import select as SL
from gridcube.sources.catalog import Catalog, CatalogError, RawCatalog


def test_allclose_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-9), (None, None), (float("nan"), None),
                                (1.0, None), (1.0, 1.1)], "a double, b double")
    got = [r[0] for r in df.select(allclose(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, True, False, False]


def test_max_diff_first_position_wins_ties(spark, make_cube):
    a = make_cube(starts=2, leads=2)
    b = a.replace(cells=a.cells.withColumn("prcp", F.col("prcp") + F.when(F.col("L") == 1, 2.0).otherwise(0.0)))
    r = QL.max_diff(AL.align_positional(a, b, "prcp"), list(a.dims)).first()
    assert r["max_diff"] == 2.0
    assert (r["S"], r["L"], r["Y"], r["X"]) == (dt.datetime(1991, 1, 1), 1, -5.0, 100.0)


def test_compare_cubes_report(spark, make_cube):
    a = make_cube(starts=5, leads=2)
    same = QL.compare_cubes(a, a, "prcp")
    assert all(r["same"] for r in same.collect())
    b = a.replace(cells=a.cells.filter(F.col("L") == 0))
    rep = QL.compare_cubes(a, b, "prcp").collect()
    assert [r["check"] for r in rep] == ["shape"] * 4 and not all(r["same"] for r in rep)


def test_compare_coords_absent_coordinate(spark, make_cube):
    a = make_cube()
    b = a.replace(cells=a.cells.drop("X").dropDuplicates(["S", "L", "Y"]), dims=("S", "L", "Y"))
    rows = {r["coord"]: r["same"] for r in QL.compare_coords(a, b).collect()}
    assert rows["X"] is False and rows["S"] is True


def test_snapshot_identical_counts(spark, make_cube):
    a = make_cube()
    r = QL.snapshot_identical(a.cells, a.cells, a.attrs_frame(), a.attrs_frame()).collect()
    assert all(x["identical"] for x in r)
    b = a.cells.limit(3)
    r = QL.snapshot_identical(a.cells, b).first()
    assert (r["n_only_a"], r["n_only_b"], r["identical"]) == (a.cells.count() - 3, 0, False)


def test_pair_lines(spark):
    text = "# header\n\nurl1\nurl2\r\n  url3  \n\t#skip\nurl4\nurl1\nurl5\nodd"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got = {(r["url1"], r["url2"]) for r in QL.pair_lines(df, "id").collect()}
    assert got == {("url1", "url5"), ("url3", "url4")}


def test_isel_sel_probe(spark, make_cube):
    c = make_cube(starts=6, leads=3)
    out = SL.isel(c, S=slice(1, None, 2), L=-1)
    assert "L" not in out.dims and out.coords["L"].expr is not None
    assert sorted({r["S"].month for r in out.cells.collect()}) == [2, 4, 6]
    rev = SL.isel(c, Y=slice(None, None, -1))
    assert "Y" in rev.descending
    with pytest.raises(KeyError):
        SL.sel(c, L=9)
    assert SL.sel(c, L=[0, 2], S=slice("1991-02-01", "1991-03-01")).cells.count() == 2 * 2 * 4
    p = SL.probe_first(c).first()
    assert (p["S"], p["L"], p["Y"], p["X"]) == (dt.datetime(1991, 1, 1), 0, -5.0, 100.0)


def test_densify_count_is_product_of_axes(spark):
    rng = random.Random(7)
    for _ in range(3):
        ms, ls = rng.randint(1, 4), rng.randint(1, 5)
        rows = [(m, l, y, 1.0) for m in range(ms) for l in range(ls) for y in (0.0, 1.0)
                if rng.random() < 0.6]
        rows.append((ms - 1, ls - 1, 0.0, 2.0))
        rows.append((0, 0, 1.0, 2.0))
        df = spark.createDataFrame(rows, "M int, L int, Y double, v double").dropDuplicates(["M", "L", "Y"])
        from gridcube.model import GridCube
        c = GridCube(cells=df, dims=("M", "L", "Y"), data_vars=("v",))
        dense = AL.densify(c, df.select("Y").distinct(), {"M": c.axis("M"), "L": c.axis("L")})
        assert dense.cells.count() == ms * ls * 2
        assert dense.cells.filter(F.col("v").isNotNull()).count() == df.count()


def test_check_region_errors(spark):
    slices = spark.createDataFrame([("f1", 1, 0), ("f1", 1, 2), ("f2", 5, 0)], "path string, M int, L int")
    axes = {"M": spark.createDataFrame([(1, 0), (2, 1)], "M int, pos int"),
            "L": spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "L int, pos int")}
    v = {(r["path"], r["dim"], r["error"]) for r in AL.check_region(slices, axes).collect()}
    assert v == {("f2", "M", "KeyError"), ("f1", "L", "ValueError")}
    with pytest.raises(KeyError):
        AL.raise_on_region_errors(AL.check_region(slices.filter("path = 'f2'"), axes))
    with pytest.raises(AL.RegionError):
        AL.raise_on_region_errors(AL.check_region(slices.filter("path = 'f1'"), axes))


def _catalog(make_cube):
    def opener(v):
        return make_cube(v)

    def note(key):
        return lambda c: c.replace(ds_attrs={**c.ds_attrs, key: "1", "last": key})

    cat = Catalog(note("root")).register("/a", transform=note("a"), open=opener, list_vars=lambda: ["b", "own"])
    cat.register("/a/leaf", open=opener, list_vars=lambda: ["prcp", "b"])
    cat.register("/a/b")  # a dataset shadows the variable of the same path
    return cat.register("/a/secret", hidden=True, open=opener, list_vars=lambda: ["x"])


def test_catalog_open_and_list(make_cube):
    cat = _catalog(make_cube)
    c = cat.open_variable("/a/leaf/prcp")
    assert c.ds_attrs == {"root": "1", "a": "1", "last": "root"}
    assert cat.open_variable("/a/own") is not None and cat.open_variable("/") is None
    assert cat.open_variable("/a/leaf/") is None
    assert cat.open_variable("/a/leaf/nope") is None
    assert cat.open_variable("/a/b") is None
    assert cat.open_variable("/a/secret/x") is not None
    with pytest.raises(CatalogError, match="Absolute"):
        cat.open_variable("a/leaf/prcp")
    d = cat.open_dataset("/a/")
    assert d.subdatasets == ["leaf", "b"] and d.variables == ["b", "own"]
    assert cat.open_dataset("/a/leaf/").variables == ["prcp", "b"]
    assert cat.open_dataset("/a") is None and cat.open_dataset("/zz/") is None


def test_catalog_listing_frame(spark, make_cube):
    cat = _catalog(make_cube)
    rows = sorted(tuple(r) for r in cat.listing(spark, "/").collect())
    assert rows == [("dataset", "a")]


def test_transform_returning_none_is_an_error(make_cube):
    cat = Catalog(lambda c: None).register("leaf", open=lambda v: make_cube(), list_vars=lambda: ["prcp"])
    with pytest.raises(CatalogError, match="returned NoneType"):
        cat.open_variable("/leaf/prcp")


def test_raw_catalog_entries(spark):
    rc = RawCatalog({"ens/model": {"dir": "model", "pattern": r"(?P<year>\d{4})(?P<month>\d{2})",
                                   "vars": {"tas": {"dir": "model/tas"}, "pr": {"data_vars": ["pr"]}}}},
                    data_root="/data")
    d, path = rc.get_entry("ens/model/tas")
    assert d.dir == "/data/model/tas" and d.name == "tas" and path == "ens/model/tas"
    d2, _ = rc.get_entry("ens/model/pr")
    assert d2.dir == "/data/model" and d2.data_vars == ["pr"]
    assert rc.list_all() == ["ens/model/tas", "ens/model/pr"]
    assert rc.frame(spark).count() == 2
    with pytest.raises(KeyError):
        rc.get_entry("ens/model/zg")


def test_schema_error_paths(make_cube):
    from gridcube.operators import schema as SC
    c = make_cube()
    with pytest.raises(KeyError):
        SC.drop_coords(c, ["nope"])
    with pytest.raises(SC.SchemaError):
        SC.drop_coords(c, ["S"])
    with pytest.raises(KeyError):
        SC.select_data_vars(c, "nope")
    assert SC.drop_coords(c, "prcp").data_vars == ()


def test_cf_encode_decode_round_trip(spark, make_cube):
    from gridcube.functions.cf import cf_decode, cf_encode
    c = make_cube().replace(encodings={"S": {"units": "days since 1960-01-01", "calendar": "standard"}})
    enc = cf_encode(c)
    assert dict(enc.cells.dtypes)["S"] == "int" and enc.attrs["S"]["units"].startswith("days")
    assert enc.cells.agg(F.min("S")).first()[0] == 11323
    back = cf_decode(enc)
    assert sorted(tuple(r) for r in back.cells.collect()) == sorted(tuple(r) for r in c.cells.collect())


def test_convert_calendar_drops_impossible_dates(spark):
    from gridcube.functions.calendar import convert_calendar
    from gridcube.model import GridCube
    days = list(range(0, 720))  # two 360-day years: 1960 (leap) and 1961
    df = spark.createDataFrame([(d, 1.0) for d in days], "S int, v double")
    c = GridCube(cells=df, dims=("S",), data_vars=("v",), encodings={"S": {"calendar": "360"}})
    out = convert_calendar(c)
    # every 360-day month has 30 days: only 30 Feb 1960, 29 and 30 Feb 1961 do not exist
    assert out.cells.count() == 720 - 1 - 2
    assert out.cells.filter(F.col("S") == F.lit("1961-03-30").cast("timestamp_ntz")).count() == 1
    assert out.encodings["S"]["calendar"] == "standard"


def test_compare_datasets_checks_variables(spark, make_cube):
    a = make_cube()
    assert all(r["same"] for r in QL.compare_datasets(a, a).collect())
    two = a.replace(cells=a.cells.withColumn("x", F.lit(1.0)), data_vars=("prcp", "x"))
    with pytest.raises(ValueError, match="target_bnds"):
        QL.compare_datasets(a, two)


def test_read_cube_unpacks_cf(spark, make_cube, tmp_path):
    from gridcube.sources import store as ST
    c = make_cube()
    packed = c.replace(cells=c.cells.withColumn("prcp", F.col("prcp").cast("int")),
                       attrs={"prcp": {"_FillValue": 3, "scale_factor": 0.5, "add_offset": 10.0}})
    ST.write_cube(packed, str(tmp_path / "p"), mode="overwrite")
    out = ST.read_cube(spark, str(tmp_path / "p"))
    vals = sorted((r["prcp"] is None, r["prcp"]) for r in out.cells.collect())
    assert vals[0] == (False, 10.0) and sum(1 for v in vals if v[0]) == 1
    assert "_FillValue" not in out.attrs["prcp"]
    raw = ST.read_cube(spark, str(tmp_path / "p"), decode_cf=False)
    assert raw.cells.filter(F.col("prcp").isNull()).count() == 0


def test_method_forms(make_cube):
    c = make_cube(starts=4, leads=3)
    assert c.sizes() == {"S": 4, "L": 3, "Y": 2, "X": 2}
    out = c.rename({"prcp": "pr"}).isel(S=slice(0, 2)).sel(L=[0, 1])
    assert out.data_vars == ("pr",) and out.cells.count() == 2 * 2 * 4
    assert c.drop_vars("prcp").data_vars == ()
    assert c.transform(lambda x: x.isel(L=0)).dims == ("S", "Y", "X")
    with pytest.raises(TypeError):
        c.transform(lambda x: None)


def test_isel_positions_refer_to_the_whole_cube(spark):
    from gridcube.model import GridCube
    # L = 2 only exists at the second start: after selecting S=0 it would be
    # missing, but position 1 of L still means L = 2 (not the next label)
    rows = [(0, 0, 1.0), (0, 5, 2.0), (1, 0, 3.0), (1, 2, 4.0), (1, 5, 5.0)]
    c = GridCube(cells=spark.createDataFrame(rows, "S int, L int, v double"), dims=("S", "L"), data_vars=("v",))
    out = SL.isel(c, S=[0], L=[1])
    assert out.cells.count() == 0
    assert SL.isel(c, S=[1], L=[1]).cells.first()["v"] == 4.0


def test_compare_coords_includes_aux_coords(spark, make_cube):
    from gridcube.operators import harmonize as H
    a = H.add_target_monthly(make_cube(starts=2, leads=2))
    rows = {r["coord"]: r["same"] for r in QL.compare_coords(a, a).collect()}
    assert rows == {"S": True, "L": True, "Y": True, "X": True, "target_bnds": True}
    b = a.replace(coords={"target": a.coords["target"]})
    rows = {r["coord"]: (r["same"], r["b"]) for r in QL.compare_coords(a, b).collect()}
    assert rows["target_bnds"] == (False, "absent")


def test_compare_data_details(spark, make_cube):
    a = make_cube(starts=3, leads=2)
    b = a.replace(cells=a.cells.withColumn("prcp", F.col("prcp") + F.when(
        (F.col("L") == 1) & (F.col("Y") == 5.0), 0.5).otherwise(0.0)))
    rows = {r["S"].month: r for r in QL.compare_data(a, b, "prcp", full=True, details=True).collect()}
    assert not rows[1]["same"] and rows[1]["max_diff"] == 0.5
    assert (rows[1]["L_pos"], rows[1]["Y_pos"], rows[1]["X_pos"]) == (1, 1, 0)
    assert rows[1]["b"] - rows[1]["a"] == 0.5


def test_large_dimension_is_numbered_on_the_cluster(spark, monkeypatch):
    import gridcube.model as M
    monkeypatch.setattr(M, "MAX_AXIS_LABELS", 3)
    df = spark.range(20).selectExpr("CAST(id * 7 % 20 AS INT) AS k", "1.0 AS v")
    c = M.GridCube(cells=df, dims=("k",), data_vars=("v",), descending=frozenset({"k"}))
    ax = c.axis("k")
    got = sorted((r["pos"], r["k"]) for r in ax.collect())
    assert got == [(i, 19 - i) for i in range(20)]


def test_align_to_strict(spark, make_cube):
    a, b = make_cube(starts=4), make_cube(starts=2)
    assert AL.align_to(a, b).cells.count() == b.cells.count()
    assert AL.align_to(a, b, strict=True).cells.count() == b.cells.count()
    with pytest.raises(KeyError):
        AL.align_to(b, a, strict=True)


def test_cf_pack_round_trip(spark):
    from gridcube.functions.cf import mask_and_scale, pack
    attrs = {"_FillValue": -1, "scale_factor": 0.5, "add_offset": 10.0}
    df = spark.createDataFrame([(10.0,), (12.5,), (None,), (float("nan"),)], "v double")
    packed = df.select(pack(F.col("v"), attrs).alias("p"))
    assert [r[0] for r in packed.collect()] == [0, 5, -1, -1]
    back = packed.select(mask_and_scale(F.col("p"), attrs).alias("v"))
    assert [r[0] for r in back.collect()] == [10.0, 12.5, None, None]
