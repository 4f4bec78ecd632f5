import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gridcube.model import GridCube  # noqa: E402
from gridcube.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return get_spark("local[*]", 8, app_name="gridcube-tests")


@pytest.fixture
def make_cube(spark):
    """Builds whole cubes (S, L, Y, X) on Spark. Each cell is one id of a
    range: the id is its value, and its digits, in the mixed base of the axis
    sizes, pick its labels. Starts are the months from January 1991 on."""
    def build(var="prcp", units="mm/day", *, starts=3, leads=4, lats=(-5.0, 5.0), lons=(100.0, 160.0)):
        def digit(below, size):
            return F.floor(F.col("id") / below).cast("int") % size

        def label(values, below):
            return F.get(F.array(*[F.lit(float(v)) for v in values]), digit(below, len(values)))

        rows, row = len(lats) * len(lons), len(lons)
        month = F.make_interval(months=digit(rows * leads, starts))
        cells = spark.range(starts * leads * rows).select(
            (F.lit("1991-01-01").cast("timestamp_ntz") + month).alias("S"), digit(rows, leads).alias("L"),
            label(lats, row).alias("Y"), label(lons, 1).alias("X"), F.col("id").cast("double").alias(var))
        return GridCube(cells, ("S", "L", "Y", "X"), (var,), attrs={var: {"units": units}} if units else {})
    return build
