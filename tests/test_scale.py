"""Steps that are computed once, or handed over together, however large the input."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcube.plans import fixtures as FX
from gridcube.plans.queries import QUERIES
from gridcube.plans.strategy import settled
from gridcube.sources import decode as DC
from gridcube.sources import index as IX
from gridcube.streaming import ingest as SI
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("max_rows", [2, 100])
def test_settled_table_reads_its_source_no_more(spark, tmp_path, max_rows):
    rows = spark.range(10).select("id", F.expr("uuid()").alias("drawn"))
    kept = settled(rows, str(tmp_path / "t"), max_rows)
    assert sorted(kept.collect()) == sorted(kept.collect()) and kept.count() == 10
    assert bool(kept.inputFiles()) == (max_rows == 2)


def test_update_parses_a_large_listing_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(SI, "settled", lambda df, path: made.append(path) or settled(df, path, 1))
    listing = spark.createDataFrame([(f"/d/fc_1999-0{k}_m1.nc", k) for k in (1, 2, 3)], "path string, modificationTime int") \
        .withColumn("modificationTime", F.col("modificationTime").cast("timestamp"))

    def decode(files):
        assert files.inputFiles() and all("listing-" in f for f in files.inputFiles())
        return files.select("path", F.lit(1.0).alias("Y"), F.lit(2.0).alias("v"), F.lit(None).cast("string").alias("error"))

    store = str(tmp_path / "store")
    assert SI.update(spark, FX.descriptor(), store, listing, decode, ["v"], ["Y"])
    assert SI.read_cells(spark, store).count() == 3
    assert len(made) == 1 and not list((tmp_path / "store_staging").glob("listing-*"))


def test_an_axis_is_fingerprinted_once(spark, tmp_path, monkeypatch):
    taken, real = [], IX.fingerprint
    monkeypatch.setattr(IX, "fingerprint", lambda labels: taken.append(labels) or real(labels))
    IX.save_index(spark, str(tmp_path), {"M": tuple(range(50)), "X": (1.0, 2.0)}, {"M": "int", "X": "double"})
    assert len(taken) == 2
    assert IX.load_index(spark, str(tmp_path), {"M": "int", "X": "double"}) == {"M": tuple(range(50)), "X": (1.0, 2.0)}


def test_small_files_are_handed_over_together():
    frames = [pd.DataFrame({"path": [str(k)], "v": [float(k)], "error": [None]}) for k in range(1000)]
    out = list(DC._together(iter(frames)))
    assert len(out) == 1 and list(out[0]["v"]) == [f["v"][0] for f in frames]


def test_small_files_of_other_types_stay_apart():
    frames = [pd.DataFrame({"v": [1]}), pd.DataFrame({"v": [None]}), pd.DataFrame({"v": []}), pd.DataFrame({"v": [2]})]
    assert [list(f["v"]) for f in DC._together(iter(frames))] == [[1], [None], [2]]


def test_written_files_hold_the_rows_of_their_name(spark, tmp_path):
    rows = [("b.nc", 2, 1.5), ("a.nc", 1, None), ("b.nc", None, 2.5)]
    cells = spark.createDataFrame(rows, "file string, step int, tas double")
    FX.write_files(cells, str(tmp_path / "raw"))
    schema = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("tas", T.DoubleType())])
    read = DC.decode_files(spark, str(tmp_path / "raw"), DC.parquet_decoder(["step", "tas"]), schema)
    got = {(r.path.rsplit("/", 1)[1], r.step, r.tas, r.error) for r in read.collect()}
    assert got == {(f, s, t, None) for f, s, t in rows}


def test_a_backlog_of_files_is_loaded_delivery_by_delivery(spark, monkeypatch):
    """No stream lists more files than a delivery has; all are loaded and in the ledger."""
    from gridcube.plans.queries import _assigned
    assigned = _assigned(spark, SF_SMALL)
    files = assigned.select("path").distinct().count()
    starts = assigned.select("path", "init_time").distinct().groupBy("init_time").count().agg(F.max("count")).first()[0]
    most = max(starts, -(-files * 2 // 3))
    monkeypatch.setattr(FX, "FILES_AT_ONCE", most, raising=False)
    met, stores, load = [], set(), SI.FileLoader._load

    def recorded(self, raw, batch, gated):
        met.append((batch, raw.select("path").count()))
        stores.add(self.store)
        return load(self, raw, batch, gated)

    monkeypatch.setattr(SI.FileLoader, "_load", recorded)
    got = QUERIES["ingest_file_stream"](spark, SF_SMALL)
    want = assigned.select("init_time", "number", "step", "latitude", "longitude", F.col("tas").cast("float").alias("tas"))
    got = got.select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(met) > 1 and max(n for _, n in met) <= most and sum(n for _, n in met) == files
    ledger = SI.read_ledger(spark, *stores)
    assert ledger.where("status = 'loaded'").count() == files and ledger.select("batch").distinct().count() == len(met)


def test_deliveries_hold_whole_starts_in_order(spark, monkeypatch):
    monkeypatch.setattr(FX, "FILES_AT_ONCE", 5)
    at = [datetime.datetime(2000, m, 1) for m in range(1, 8)]
    counts = [2, 3, 1, 9, 4, 1, 1]
    files = spark.createDataFrame([(t,) for t, n in zip(at, counts) for _ in range(n)], "t timestamp_ntz")
    bounds = FX.delivery_bounds(files)
    assert bounds == [at[2], at[3], at[4], at[6]] and FX.delivery_bounds(files.limit(0)) == []
    got = files.distinct().select("t", FX.delivery(F.col("t"), bounds).alias("k")).orderBy("t").collect()
    assert [r["k"] for r in got] == [0, 0, 1, 2, 3, 3, 4]
    assert files.select(FX.delivery(F.col("t"), []).alias("k")).distinct().collect()[0]["k"] == 0


@pytest.mark.parametrize("name", ["compare_coords", "align_positional", "max_diff", "compare_cubes", "check_region"])
def test_the_cube_is_computed_once(spark, monkeypatch, name):
    made, real = [], FX.cube_cells
    monkeypatch.setattr(FX, "cube_cells", lambda *a: made.append(a) or real(*a))
    out = QUERIES[name](spark, SF_SMALL)
    assert len(made) == 1
    assert not any("lineitem" in f for f in out.inputFiles())


def test_a_line_takes_one_number_for_its_cell_through_the_join(spark):
    """A line's part, supplier and line number are not shuffled beside its key and values."""
    left = FX.cube_cells(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "l_partkey#" in left and " AS cell#" in left
    made = next(x for x in left.splitlines() if "Project [" in x)
    assert made.count(" AS ") == 1 and "l_orderkey#" in made and "l_quantity#" in made and "l_discount#" in made


def test_cells_of_negative_null_and_large_keys(spark, tmp_path):
    """Against the plain grouping; every part remainder, supplier remainder and line number is a cell of its own."""
    numbers = [None, -2**31 + 1, -3, 0, 1, 7, 2**31 - 1]
    keys = [(p, s, n) for p in [None, *range(-43, 44), 2**62, -2**62] for s in (None, -5, -3, 0, 2, 7, 2**61 + 3) for n in numbers]
    rows = [(k % 5 or None, *key, float(k % 50), None if k % 7 == 0 else k % 11 / 100) for k, key in enumerate(keys)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    dates = [(k, datetime.datetime(1995, k, 3)) for k in (1, 2, 3)] + [(4, None), (1, datetime.datetime(1995, 1, 9)), (None, None)]
    spark.createDataFrame(dates, "o_orderkey bigint, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    li, o = (FX.table(spark, str(tmp_path), n) for n in ("lineitem", "orders"))
    want = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("S"), (F.col("l_suppkey") % 4 + 1).alias("M"),
        (F.col("l_linenumber") - 1).alias("L"), (90 - 45 * (F.col("l_partkey") % 5)).cast("double").alias("Y"),
        (90 * (F.expr("l_partkey div 5") % 4)).cast("double").alias("X")
    ).agg((250 + F.avg("l_quantity")).alias("tas"), (F.max("l_discount") / 864000.0).alias("prate"))
    got = FX.cube_cells(spark, str(tmp_path))
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
