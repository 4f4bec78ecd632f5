"""Physical-plan properties the design relies on at scale."""

import re

from pyspark.sql import functions as F

from gridcube.operators import quality as QL
from gridcube.plans import fixtures as FX
from gridcube.plans import queries as Q
from gridcube.plans.strategy import is_small, join_small, localize
from gridcube.sources import store as ST

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_one_shuffle(spark):
    p = plan(Q.QUERIES["standardize"](spark, SF_SMALL))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    # only the six used lineitem columns are read
    assert re.search(r"FileScan parquet \[l_orderkey#\d+L,l_partkey#\d+L,l_suppkey#\d+L,"
                     r"l_linenumber#\d+,l_quantity#\d+,l_discount#\d+\]", p)


def test_store_selection_prunes_partitions_and_pushes_filters(spark, tmp_path):
    root = str(tmp_path / "s")
    ST.write_cube(FX.standard_cube(spark, SF_SMALL), root, mode="overwrite")
    c = ST.read_cube(spark, root, drop_variables=["prate"])
    p = plan(c.sel(S=slice("1996-01-01", "1996-06-01"), M=[1, 3]).cells)
    assert re.search(r"PartitionFilters: \[.*S#\d+ >= 1996-01-01", p)
    assert "PushedFilters: [In(M, [1,3])]" in p
    assert re.search(r"FileScan parquet \[[^\]]*\]", p) and "prate" not in re.search(r"FileScan parquet \[[^\]]*\]", p).group(0)
    p2 = plan(c.isel(S=slice(-2, None), L=[0]).cells)
    assert "PartitionFilters: []" not in p2 and "EqualTo(L,0)" in p2


def test_join_small_broadcasts_only_bounded_tables(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 10)
    small = spark.range(10).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan(join_small(big, localize(small), "k"))
    assert "BroadcastHashJoin" in plan(join_small(big, small, "k", max_rows=100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        over = join_small(big, spark.range(500).withColumnRenamed("id", "k"), "k", max_rows=100)
        assert "BroadcastHashJoin" not in plan(over) or "SortMergeJoin" in plan(over)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_localize_keeps_large_tables_distributed(spark):
    assert is_small(localize(spark.range(5)))
    assert not is_small(localize(spark.range(50), max_rows=10))


def test_pair_lines_needs_no_window(spark):
    df = FX.table(spark, SF_SMALL, "documents")
    p = plan(QL.pair_lines(df, "doc_id"))
    assert "Window" not in p
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1


def test_axes_are_local_and_shared(spark):
    c = FX.standard_cube(spark, SF_SMALL)
    axes = c.axes()
    assert all(is_small(a) for a in axes.values())
    assert c.axes(["S"])["S"].count() == axes["S"].count()
