"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source, targets are the water-filling of the weights
under a ceiling per source, and each document is emitted floor(rate) times
plus one hash-seeded Bernoulli copy for the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcube.llm.common import cut, fresh, need
from gridcube.plans.strategy import join_small

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def targets(sized: DataFrame, *, source: str = "source", size: str = "size", cycle: int = 3,
            ceiling: int = 3) -> DataFrame:
    """(source, source_size, weight, target), one row per source.

    Sources weigh 1..``cycle``, repeating, in code-point order, null last.
    Together the targets make up the size of all sources; none exceeds
    ``ceiling`` times its source: with sources ordered by the level at which
    they reach their ceiling, the level at which the others share is the first
    one they do not reach. The windows run over one row per source (weights
    are given per source, so this is a table of configuration size), after
    the partial sums of the documents.
    """
    per_source = sized.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(F.col(f"`{size}`")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per_source.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1)
    full = F.col("source_size") * ceiling
    fills = Window.orderBy((full / F.col("weight")), F.col("source").asc_nulls_last())
    before, after = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0)))
             / F.sum("weight").over(after))
    levelled = weighed.withColumn("level", level).withColumn(
        "shared", F.max(F.when(full >= F.col("level") * F.col("weight"), F.col("level"))).over(fills.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
    # from the first source that is not full, the level only falls
    return levelled.select("source", "source_size", "weight",
                           F.least(full.cast("double"), F.col("shared") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", size: str = "size",
        content: str | None = None, cycle: int = 3, ceiling: int = 3, seed: int = 42, prefix: str = "") -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies`` (names after
    ``prefix``): how often the mix takes each document.

    ``size`` is a column of word counts (:func:`words`). The rate of a source
    is target / size, at most ``ceiling``; a document is taken floor(rate)
    times and once more when the hash of its id falls below the fraction, so
    reruns agree and the order of rows does not matter.

    Defined cases: a null source is a source of its own, last in order; a null
    size counts as 0; a source of size 0 is taken 0 times; repeated rows with
    one id get the same number; in place of a null id the column ``content``
    (a text or a hash of it) is hashed, so that rows without an id do not
    share one draw, without such a column the empty id; an empty table gives
    an empty result. Other columns pass through; existing columns
    with the result's names are replaced.
    """
    need(docs, id_col, source, size, *([content] if content else []))
    names = [prefix + n for n in ("source_size", "target", "copies")]
    docs = docs.drop(*names)
    key, rate = fresh(docs, "mix_source", "mix_rate")
    sized = docs.select(F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).alias("size"))
    rates = cut(targets(sized, cycle=cycle, ceiling=ceiling)).select(
        F.col("source").alias(key), F.col("source_size").alias(names[0]), F.col("target").alias(names[1]),
        F.least(F.lit(float(ceiling)), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).alias(rate))
    joined = join_small(docs, rates, F.col(f"`{source}`").eqNullSafe(F.col(key)), max_rows=100_000)
    whole = F.floor(rate)
    drawn_by = [F.col(f"`{c}`").cast("string") for c in (id_col, content) if c]
    chance = _uniform(seed, F.coalesce(*drawn_by, F.lit("")))
    return joined.withColumn(names[2], whole + F.when(chance < F.col(rate) - whole, 1).otherwise(0)).drop(key, rate)


def emit(mixed: DataFrame, *, copies: str = "copies", number: str = "copy") -> DataFrame:
    """Each row ``copies`` times, numbered from 1 in column ``number``."""
    return mixed.where(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
