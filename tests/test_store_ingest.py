"""Stores, decoding, the batch update, the stream and their error paths."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcube.operators.quality import TooManyFailures, error_rate_gate
from gridcube.sources import decode as DC
from gridcube.sources import listing as LS
from gridcube.sources import store as ST
from gridcube.sources.ingest import IngestError, append_times, concat_slices, promote_time_dim
from gridcube.streaming import ingest as SI

GRID_SCHEMA = T.StructType([T.StructField("Y", T.DoubleType()), T.StructField("X", T.DoubleType()),
                            T.StructField("tas", T.DoubleType())])


def test_store_round_trip_cells_and_packed(spark, make_cube, tmp_path):
    c = make_cube(starts=3, leads=2).replace(encodings={"S": {"units": "hours since 1960-01-01"}},
                                        descending=frozenset({"Y"}))
    for layout in ("cells", "packed"):
        root = str(tmp_path / layout)
        ST.write_cube(c, root, mode="overwrite", layout=layout)
        back = ST.read_cube(spark, root)
        assert back.descending == frozenset({"Y"})
        a = sorted(tuple(r) for r in c.cells.collect())
        b = sorted(tuple(r) for r in back.cells.select(*c.cells.columns).collect())
        assert a == b
    enc = ST.read_cube(spark, str(tmp_path / "cells"), decode_times=False)
    assert dict(enc.cells.dtypes)["S"] == "int"
    assert enc.cells.agg(F.min("S")).first()[0] == 271752  # hours from 1960 to 1991


def test_read_missing_store(spark, tmp_path):
    with pytest.raises(ST.StoreError):
        ST.read_cube(spark, str(tmp_path / "nothing"))


def _write_files(tmp_path, n_starts=4, members=(1, 2), broken=()):
    d = tmp_path / "files"
    d.mkdir(exist_ok=True)
    for i in range(n_starts):
        for m in members:
            name = d / f"fc_{2000 + i}01_m{m}.parquet"
            if (i, m) in broken:
                name.write_bytes(b"not parquet")
                continue
            pdf = pd.DataFrame({"Y": [0.0, 0.0, 1.0, 1.0], "X": [10.0, 11.0, 10.0, 11.0],
                                "tas": [float(i * 10 + m)] * 4})
            pdf.to_parquet(name)
    return str(d)


def _update(spark, tmp_path, store, **kw):
    d = LS.FileSetDescriptor(name="tas", dir=str(tmp_path / "files"),
                             pattern=r"fc_(?P<year>\d{4})(?P<month>\d{2})_m(?P<member>\d)\.parquet$")
    listing = LS.list_files(spark, d.dir)

    def decode(files):
        return DC.decode_files(spark, files, DC.parquet_decoder(), GRID_SCHEMA)
    return SI.update(spark, d, store, listing, decode, data_vars=["tas"], grid_dims=["Y", "X"], **kw)


def test_update_is_incremental_and_idempotent(spark, tmp_path):
    _write_files(tmp_path, n_starts=4)
    store = str(tmp_path / "store")
    assert _update(spark, tmp_path, store, limit=2)
    assert ST.read_cube(spark, store).cells.select("init_time").distinct().count() == 2
    assert _update(spark, tmp_path, store)
    assert not _update(spark, tmp_path, store)
    cells = ST.read_cube(spark, store).cells
    assert cells.count() == 4 * 2 * 4
    assert cells.filter((F.col("number") == 2) & (F.year("init_time") == 2003)).first()["tas"] == 32.0


def test_update_initial_slice_is_densified(spark, tmp_path):
    d = _write_files(tmp_path, n_starts=2, members=(1, 2))
    os.remove(os.path.join(d, "fc_200001_m2.parquet"))
    store = str(tmp_path / "store")
    assert _update(spark, tmp_path, store)
    first = ST.read_cube(spark, store).cells.filter(F.year("init_time") == 2000)
    assert first.count() == 8 and first.filter(F.col("tas").isNull()).count() == 4


def test_update_error_gate(spark, tmp_path):
    _write_files(tmp_path, n_starts=4, members=(1, 2), broken={(2, 1)})
    store = str(tmp_path / "store")
    assert _update(spark, tmp_path, store, limit=2)
    with pytest.raises(TooManyFailures):  # 1 of 4 files failed > 10 %
        _update(spark, tmp_path, store)


def test_update_rejects_start_before_stored(spark, tmp_path):
    _write_files(tmp_path, n_starts=3)
    store = str(tmp_path / "store")
    assert _update(spark, tmp_path, store, first="2001-01-01")
    d = tmp_path / "files"
    pd.DataFrame({"Y": [0.0], "X": [10.0], "tas": [1.0]}).to_parquet(d / "fc_200001_m9.parquet")
    os.remove(d / "fc_200001_m1.parquet")
    os.remove(d / "fc_200001_m2.parquet")
    with pytest.raises(SI.LateStartError):
        _update(spark, tmp_path, store)


def test_update_region_check_unknown_member(spark, tmp_path):
    _write_files(tmp_path, n_starts=2, members=(1, 2))
    store = str(tmp_path / "store")
    assert _update(spark, tmp_path, store, limit=1)
    pd.DataFrame({"Y": [0.0], "X": [10.0], "tas": [1.0]}).to_parquet(tmp_path / "files" / "fc_200101_m7.parquet")
    with pytest.raises(KeyError, match="number"):
        _update(spark, tmp_path, store)


def test_error_rate_gate_threshold(spark):
    rows = [("a", None)] * 9 + [("b", "boom")]
    df = spark.createDataFrame(rows, "path string, error string")
    assert error_rate_gate(df).count() == 9  # exactly 10 % is tolerated
    with pytest.raises(TooManyFailures):
        error_rate_gate(df.unionByName(spark.createDataFrame([("c", "x")], "path string, error string")))


def test_decode_records_errors_per_file(spark, tmp_path):
    d = _write_files(tmp_path, n_starts=1, members=(1,), broken={(0, 1)})
    pd.DataFrame({"Y": [0.0], "X": [1.0], "tas": [2.0]}).to_parquet(os.path.join(d, "ok.parquet"))
    out = DC.decode_files(spark, d, DC.parquet_decoder(), GRID_SCHEMA)
    errs = {os.path.basename(r["path"]): r["error"] for r in DC.file_errors(out).collect()}
    assert errs["ok.parquet"] is None and "cannot be decoded" in errs["fc_200001_m1.parquet"]


def test_promote_time_dim_requires_one_start_per_file(spark):
    files = spark.createDataFrame([("f1", dt.datetime(2000, 1, 1), 1)], "path string, t timestamp_ntz, m int")
    ok = spark.createDataFrame([("f1", dt.datetime(2000, 1, 3), 1.0)], "path string, time timestamp_ntz, v double")
    out = promote_time_dim(ok, files, "time").first()
    assert out["init_time"] == dt.datetime(2000, 1, 1) and out["time"] == dt.datetime(2000, 1, 3)
    two = ok.unionByName(spark.createDataFrame([("f1", dt.datetime(2000, 1, 4), 2.0)], ok.schema))
    with pytest.raises(IngestError, match="multiple initializations"):
        promote_time_dim(two, files, "time")
    with pytest.raises(IngestError, match="no dimension"):
        promote_time_dim(ok, files, "valid_time")


def test_append_times_and_concat_guards(spark):
    a = spark.createDataFrame([(dt.datetime(2000, 2, 1), 1.0)], "init_time timestamp_ntz, v double")
    b = spark.createDataFrame([(dt.datetime(2000, 1, 1), 1.0)], a.schema)
    with pytest.raises(IngestError, match="prior"):
        append_times(a, b)
    assert append_times(b, a).count() == 2
    with pytest.raises(IngestError):
        concat_slices([a, a.withColumn("w", F.lit(1))], ["init_time"])


def test_stream_ingest_diverts_late_starts(spark, make_cube, tmp_path):
    c = make_cube(starts=4, leads=1)
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    early = c.cells.filter(F.month("S") <= 2)
    late_rows = c.cells.filter(F.month("S") == 3)
    c.cells.filter(F.month("S") == 4).write.parquet(src)
    q = SI.ingest_stream(spark, src, c.cells.schema, store, str(tmp_path / "ck"), c.dims, c.data_vars,
                         time_col="S", on_late="divert", late_dir=str(tmp_path / "late"))
    q.awaitTermination()
    early.write.mode("append").parquet(src)
    late_rows.write.mode("append").parquet(src)
    q = SI.ingest_stream(spark, src, c.cells.schema, store, str(tmp_path / "ck"), c.dims, c.data_vars,
                         time_col="S", on_late="divert", late_dir=str(tmp_path / "late"))
    q.awaitTermination()
    assert ST.read_cube(spark, store).cells.count() == 4
    assert spark.read.parquet(str(tmp_path / "late")).count() == 12


def test_append_replaces_whole_starts(spark, make_cube, tmp_path):
    c = make_cube(starts=3, leads=2)
    root = str(tmp_path / "s")
    first = c.replace(cells=c.cells.filter(F.month("S") == 1))
    ST.write_cube(first, root, mode="overwrite")
    rest = c.replace(cells=c.cells.filter(F.month("S") > 1))
    ST.write_cube(rest, root, mode="append")
    ST.write_cube(rest, root, mode="append")  # a repeated load replaces, never duplicates
    assert ST.read_cube(spark, root).cells.count() == c.cells.count()
    assert sorted(r[0].month for r in ST.stored_times(spark, root).collect()) == [1, 2, 3]


def test_update_applies_descriptor_options(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    for i in range(2):
        pd.DataFrame({"Y": [0.0, 1.0], "X": [10.0, 10.0], "tas": [1.0, 2.0], "junk": [0, 0],
                      "time": pd.to_datetime([f"200{i}-01-03"] * 2)}).to_parquet(d / f"fc_200{i}01_m1.parquet")
    schema = T.StructType([*GRID_SCHEMA.fields, T.StructField("junk", T.LongType()),
                           T.StructField("time", T.TimestampNTZType())])
    desc = LS.FileSetDescriptor(name="tas", dir=str(d), data_vars="tas", drop_vars="junk",
                                original_time_dim="time",
                                pattern=r"fc_(?P<year>\d{4})(?P<month>\d{2})_m(?P<member>\d)\.parquet$")
    assert desc.drop_coords == ["junk"] and desc.data_vars == ["tas"]

    def decode(files):
        return DC.decode_files(spark, files, DC.parquet_decoder(), schema)
    store = str(tmp_path / "store")
    assert SI.update(spark, desc, store, LS.list_files(spark, str(d)), decode, None, ["Y", "X"])
    out = ST.read_cube(spark, store)
    assert out.data_vars == ("tas",) and dict(out.cells.dtypes)["tas"] == "float"
    assert sorted(r[0].year for r in ST.stored_times(spark, store).collect()) == [2000, 2001]
    bad = LS.FileSetDescriptor(name="tas", dir=str(d), data_vars="tas", drop_coords="nope",
                               pattern=desc.pattern)
    with pytest.raises(IngestError, match="cannot drop"):
        SI.update(spark, bad, str(tmp_path / "s2"), LS.list_files(spark, str(d)), decode, None, ["Y", "X"])


def test_file_stream_incremental_and_late(spark, tmp_path):
    d = _write_files(tmp_path, n_starts=2, members=(1, 2))
    desc = LS.FileSetDescriptor(name="tas", dir=d,
                                pattern=r"fc_(?P<year>\d{4})(?P<month>\d{2})_m(?P<member>\d)\.parquet$")
    store, ck = str(tmp_path / "store"), str(tmp_path / "ck")

    def run():
        SI.ingest_file_stream(spark, desc, DC.parquet_decoder(), GRID_SCHEMA, store, ck, ["Y", "X"],
                              ["tas"], on_late="divert", late_dir=str(tmp_path / "late")).awaitTermination()
    run()
    assert ST.read_cube(spark, store).cells.count() == 2 * 2 * 4
    _write_files(tmp_path, n_starts=3, members=(1, 2))  # adds the 2002 start (older files rewritten)
    pd.DataFrame({"Y": [0.0], "X": [10.0], "tas": [1.0]}).to_parquet(os.path.join(d, "fc_199901_m1.parquet"))
    run()
    cells = ST.read_cube(spark, store).cells
    assert sorted(r[0].year for r in ST.stored_times(spark, store).collect()) == [2000, 2001, 2002]
    assert cells.count() == 3 * 2 * 4
    assert dict(cells.dtypes)["tas"] == "float"
    assert spark.read.parquet(str(tmp_path / "late")).count() == 1


def test_update_refill_reloads_starts_with_missing_files(spark, tmp_path):
    d = _write_files(tmp_path, n_starts=3, members=(1, 2))
    late_file = os.path.join(d, "fc_200101_m2.parquet")
    content = open(late_file, "rb").read()
    os.remove(late_file)
    store = str(tmp_path / "store")
    assert _update(spark, tmp_path, store)
    assert ST.read_cube(spark, store).cells.count() == 5 * 4  # a later start: nothing densified
    open(late_file, "wb").write(content)  # the missing file arrives later
    assert not _update(spark, tmp_path, store)  # default: a stored start is not revisited
    assert _update(spark, tmp_path, store, refill=True)
    cells = ST.read_cube(spark, store).cells
    assert cells.count() == 6 * 4
    assert cells.filter((F.year("init_time") == 2001) & (F.col("number") == 2)).first()["tas"] == 12.0
    assert not _update(spark, tmp_path, store, refill=True)


def test_update_keeps_aux_and_expanded_coords(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    for i in range(2):
        pd.DataFrame({"Y": [0.0, 1.0], "X": [10.0, 10.0], "tas": [1.0, 2.0], "area": [5.0, 6.0],
                      "valid": [float(i), float(i)]}).to_parquet(d / f"fc_200{i}01_m1.parquet")
    schema = T.StructType([*GRID_SCHEMA.fields, T.StructField("area", T.DoubleType()),
                           T.StructField("valid", T.DoubleType())])
    desc = LS.FileSetDescriptor(name="tas", dir=str(d), data_vars="tas", aux_coords="area",
                                expand_coords="valid",
                                pattern=r"fc_(?P<year>\d{4})(?P<month>\d{2})_m(?P<member>\d)\.parquet$")

    def decode(files):
        return DC.decode_files(spark, files, DC.parquet_decoder(), schema)
    store = str(tmp_path / "store")
    assert SI.update(spark, desc, store, LS.list_files(spark, str(d)), decode, None, ["Y", "X"])
    cube = ST.read_cube(spark, store)
    assert set(cube.coords) == {"area", "valid_expanded"}
    assert cube.cells.columns == ["init_time", "number", "Y", "X", "tas"]
    assert sorted(r["area"] for r in cube.coord_frame("area").collect()) == [5.0, 6.0]
    v = {(r["init_time"].year, r["valid_expanded"]) for r in cube.coord_frame("valid_expanded").collect()}
    assert v == {(2000, 0.0), (2001, 1.0)}


def test_stored_times_from_partition_names(spark, make_cube, tmp_path):
    from gridcube.plans.strategy import is_small
    c = make_cube(starts=14, leads=1)
    c = c.replace(cells=c.cells.withColumn("S", F.col("S") + F.expr("INTERVAL 6 HOURS 30 SECONDS")))
    root = str(tmp_path / "s")
    ST.write_cube(c, root, mode="overwrite")
    t = ST.stored_times(spark, root)
    assert is_small(t)
    want = sorted(r[0] for r in c.cells.select("S").distinct().collect())
    assert sorted(r[0] for r in t.collect()) == want


def test_update_empty_listing_and_late_first(spark, tmp_path):
    _write_files(tmp_path, n_starts=1)
    with pytest.raises(IngestError, match="at or after"):
        _update(spark, tmp_path, str(tmp_path / "s1"), first="2030-01-01")
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "readme.txt").write_text("no data")
    d = LS.FileSetDescriptor(name="tas", dir=str(tmp_path / "empty"),
                             pattern=r"fc_(?P<year>\d{4})(?P<month>\d{2})_m(?P<member>\d)\.parquet$")
    with pytest.raises(IngestError, match="no files match"):
        SI.update(spark, d, str(tmp_path / "s2"), LS.list_files(spark, d.dir),
                  lambda f: f, ["tas"], ["Y", "X"])


def test_running_error_gate_aborts_on_early_failures(spark):
    from gridcube.operators.quality import first_failing_prefix
    # 1 failure among 20 loads (5 %): fine overall, but it is the 3rd load,
    # so the running rate after 3 completions is 33 %
    rows = [(i, "boom" if i == 2 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, error string").repartition(4)
    assert error_rate_gate(df).count() == 19
    assert first_failing_prefix(df, ["k"]) == (3, 1)
    with pytest.raises(TooManyFailures, match="first 3"):
        error_rate_gate(df, order=["k"])
    late = spark.createDataFrame([(i, "boom" if i == 19 else None) for i in range(20)], df.schema)
    assert first_failing_prefix(late, ["k"]) is None


def test_update_eager_gate(spark, tmp_path):
    # 1 broken file of 20: under 10 % for the batch, but it is the first load
    _write_files(tmp_path, n_starts=10, members=(1, 2), broken={(1, 1)})
    store = str(tmp_path / "store")
    assert _update(spark, tmp_path, store, limit=1)
    assert _update(spark, tmp_path, str(tmp_path / "relaxed"))
    with pytest.raises(TooManyFailures):
        _update(spark, tmp_path, store, eager_gate=True)
