"""Unit conversion as affine Column expressions.

The conversion is chosen on the driver from the variable's ``units`` attr and
applied as ``x * scale + offset`` inside the scan's codegen stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference's table for equal results):
# (original units, target units) -> (scale, offset), result = x * scale + offset;
# None = the unit is only spelled differently, values pass through untouched.
STANDARD_UNIT_CONVERSIONS: Mapping[tuple[str, str], tuple[float, float] | None] = MappingProxyType({
    ("degrees_north", "degree_north"): None,
    ("degrees_east", "degree_east"): None,
    ("degreeC", "degree_Celsius"): None,
    ("K", "degree_Celsius"): (1, -273.15),
    ("Kelvin", "degree_Celsius"): (1, -273.15),
    ("gpm", "m"): None,
    ("kg/m2", "mm"): None,
    ("kg m**-2 s**-1", "mm/day"): (1000 * 60 * 60 * 24 / 1000, 0),
    ("kg m-2 s-1", "mm/day"): (1000 * 60 * 60 * 24 / 1000, 0),
    ("kg m^-2 s^-1", "mm/day"): (1000 * 60 * 60 * 24 / 1000, 0),
    ("mm/s", "mm/day"): (60 * 60 * 24, 0),
    ("m/s", "mm/day"): (1000 * 60 * 60 * 24, 0),
    ("m s**-1", "mm/day"): (1000 * 60 * 60 * 24, 0),
    ("m/s", "m s-1"): None,
    ("m s**-1", "m/s"): None,
    ("hPa", "Pa"): (100, 0),
    ("watt/m^2", "mm/day"): (1000 * 60 * 60 * 24 / 2453e6, 0),
})

# A conversion: an affine (scale, offset), None for another spelling of the
# same unit, or (in own tables) any function of a Column.
Conversion = tuple[float, float] | None | Callable[[Column], Column]


class UnitError(Exception):
    pass


def apply_conversion(col: Column, conversion: Conversion, float32: bool = False) -> Column:
    """``col`` in the new unit; with ``float32`` the constants are single
    precision, so that a FloatType column keeps its type."""
    if conversion is None:
        return col
    if callable(conversion):
        return conversion(col)
    scale, offset = (F.lit(x).cast("float") if float32 else F.lit(x) for x in conversion)
    return col * scale + offset


def convert_units_col(col: Column, original: str | None, new: str | None,
                      conversions: Mapping = STANDARD_UNIT_CONVERSIONS,
                      float32: bool = False) -> tuple[Column, str | None]:
    """(column in the new units, its ``units`` attr). Values stay where the
    units are equal or the new ones are None. Unknown original units are a
    ``UnitError``, a pair that the table lacks is a KeyError."""
    if new is None or new == original:
        return col, new
    if original is None:
        raise UnitError(f"values without units cannot be converted to {new}")
    try:
        conversion = conversions[original, new]
    except KeyError:
        raise KeyError(f"no conversion from {original} to {new}") from None
    return apply_conversion(col, conversion, float32), new


def unit_table(spark: SparkSession,
               conversions: Mapping = STANDARD_UNIT_CONVERSIONS) -> DataFrame:
    """The conversion table as a DataFrame ``(from_units, to_units, scale, offset)``
    for converting long tables whose rows carry mixed units."""
    rows = []
    for (a, b), conv in conversions.items():
        if callable(conv):
            continue
        scale, offset = conv if conv is not None else (1, 0)
        rows.append((a, b, float(scale), float(offset)))
    schema = T.StructType([
        T.StructField("from_units", T.StringType(), False),
        T.StructField("to_units", T.StringType(), False),
        T.StructField("scale", T.DoubleType(), False),
        T.StructField("offset", T.DoubleType(), False),
    ])
    return spark.createDataFrame(rows, schema)
