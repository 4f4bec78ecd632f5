"""Data must not get lost or mislabelled in ordinary use."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridcube.functions.units import unit_table
from gridcube.model import Axes, Coord, GridCube
from gridcube.operators import harmonize as H
from gridcube.operators.schema import rename
from gridcube.sources import store as ST
from gridcube.streaming.ingest import ingest_stream

DAY = dt.datetime(2001, 5, 1)


def test_members_of_a_start_in_several_batches_all_arrive(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "S timestamp_ntz, M int, tas double"
    for m, start in ((1, 0), (2, 0), (1, 1), (3, 0), (2, 1)):
        spark.createDataFrame([(DAY + dt.timedelta(days=start), m, float(m))], schema).coalesce(1).write.mode("append").parquet(source)
    types = spark.createDataFrame([], schema).schema

    def run(checkpoint):
        ingest_stream(spark, source, types, f"{tmp_path}/store", f"{tmp_path}/{checkpoint}", ("S", "M"), ("tas",),
                      time_col="S", max_files_per_trigger=1).awaitTermination()
        return sorted((r.S.day, r.M, r.tas) for r in ST.read_cells(spark, f"{tmp_path}/store").collect())

    want = [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 1.0), (2, 2, 2.0)]
    assert run("first") == want
    assert run("again") == want      # the same files once more change nothing


def test_append_keeps_starts_of_any_type(spark, tmp_path):
    for s in (0, 1):
        cells = spark.createDataFrame([(s, 1.5)], "S int, tas double")
        ST.write_cube(GridCube(cells=cells, dims=("S",), data_vars=("tas",)), f"{tmp_path}/x", mode="append")
    got = ST.read_cells(spark, f"{tmp_path}/x")
    assert sorted(r.S for r in got.collect()) == [0, 1] and dict(got.dtypes)["S"] == "int"


def test_only_a_missing_folder_means_no_store(spark, tmp_path):
    assert not ST.store_exists(spark, f"{tmp_path}/none")
    spark.createDataFrame([], "value string").write.text(f"{tmp_path}/half/meta")
    with pytest.raises(RuntimeError, match="half written"):
        ST.store_exists(spark, f"{tmp_path}/half")


def test_units_of_every_row_are_kept_or_refused(spark):
    schema = "value double, from_units string, units string"
    df = spark.createDataFrame([(300.0, "K", "degree_Celsius"), (2.0, "m", "m"), (5.0, "anything", None)], schema)
    assert sorted(round(r.value, 6) for r in H.convert_units_long(df, unit_table(spark)).collect()) == [2.0, 5.0, 26.85]
    for bad in (("furlong", "m"), (None, "m")):
        with pytest.raises(Exception, match="no conversion from"):
            H.convert_units_long(spark.createDataFrame([(1.0, *bad)], schema), unit_table(spark)).collect()


def _daily(spark, leads):
    rows = [(DAY + dt.timedelta(days=s), lead, 1.0, DAY + dt.timedelta(days=s, hours=h)) for s, lead, h in leads]
    df = spark.createDataFrame(rows, "S timestamp_ntz, L int, tas double, target timestamp_ntz")
    return GridCube(cells=df.select("S", "L", "tas"), dims=("S", "L"), data_vars=("tas",),
                    coords={Axes.target: Coord(("S", "L"), table=df.select("S", "L", "target"))})


def test_leads_within_a_day_stay_apart(spark):
    out = H.add_target_daily(_daily(spark, [(0, 0, 6), (0, 1, 12), (1, 0, 6), (1, 1, 12)]))
    assert sorted(r.L for r in out.cells.collect()) == [0.25, 0.25, 0.5, 0.5]
    whole = H.add_target_daily(_daily(spark, [(0, 7, 24), (0, 8, 48)]))
    assert sorted(r.L for r in whole.cells.collect()) == [1, 2] and dict(whole.cells.dtypes)["L"] == "int"


def test_a_lead_unknown_to_the_first_start_is_an_error(spark):
    with pytest.raises(Exception, match="no target for lead 9"):
        H.add_target_daily(_daily(spark, [(0, 0, 24), (1, 0, 24), (1, 9, 48)])).cells.collect()


def test_rename_after_daily_targets(spark):
    out = rename(H.add_target_daily(_daily(spark, [(0, 0, 24), (0, 1, 48)])), {"S": "start", "target": "valid"})
    bounds = out.coord_frame(Axes.target_bnds)
    assert {"start", "L"} <= set(bounds.columns) and bounds.count() == 2
    assert out.coord_frame("valid").where(F.col("valid").isNotNull()).count() == 2
