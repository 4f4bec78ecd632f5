"""gridcube: labelled forecast cubes as long Spark tables.

A cube is one long ``cells`` DataFrame (one row per grid point, one column per
dimension and per data variable) plus small driver-side metadata: the
dimension order, per-variable attributes, dataset attributes and encodings.
Every operator returns a new cube whose ``cells`` is a lazy plan, so chains
of operators fuse into one Catalyst plan.
"""

from gridcube.model import Coord, GridCube, Axes
from gridcube.session import get_spark, shared_dir

__all__ = ["Axes", "Coord", "GridCube", "get_spark", "shared_dir"]
