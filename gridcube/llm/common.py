"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridcube.session import ensure_checkpoint_dir, shared_dir


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, with its lineage
    cut there, so that a lost executor costs no recomputation of earlier steps."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame, keep=cut, **totals: Column) -> tuple[DataFrame, dict]:
    """``df`` computed once by ``keep``, with its number of rows ``n`` and other
    ``totals``, taken on the way: counting afterwards is a query of its own, and
    every query leaves threads, classes and plans on the driver."""
    seen = Observation()
    kept = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *[total.alias(name) for name, total in totals.items()]))
    return kept, seen.get


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of tables that are computed and gone.
    Its cleaner learns of them when the driver's JVM collects garbage, which one
    whose queries leave little of it does too seldom for steps of many shuffles.
    Python's collector, which lets go of the tables in the JVM, comes first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again:
    like :func:`cut` for wide tables, compressed and column-pruned on reading."""
    path = shared_dir(df.sparkSession, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def need(df: DataFrame, *columns: str) -> None:
    """Fail early, by name, when an input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names made from ``stems`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out
