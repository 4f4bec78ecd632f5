"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``d`` bits share a variant within d/2 bits of each.
Every distinct fingerprint is sent to the buckets (variant prefixes) that its
variants fall into; a bucket enumerates the variants that start with its
prefix and links the fingerprints that meet in one. The shuffle so carries a
fingerprint once per prefix and not once per variant. Exact copies share a
fingerprint and are collapsed before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import cut, need, stage, utf8
from gridcube.llm.components import connected_components, spanning_links

#: Variants that a task lays out at once (8 bytes each, with a few copies).
VARIANTS_AT_ONCE = 2_000_000
#: Fingerprints in one bucket; a fuller one is dealt by further bits first.
BUCKET_ROWS = 200_000

_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes. Eight byte-wide counters
    run in one word, emptied before the 256th hash."""
    counts = np.zeros(64, np.int64)
    cuts = np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & _LANES
        counts[bit::8] = np.add.reduceat(lanes, cuts).astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(counts * 2 > len(hashes))))


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of the text's word shingles; 0 without words."""
    words = (text or b"").lower().split()      # bytes: only A-Z, and white space 09-0D and 20
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    return majority(np.array(hashes, np.uint64))


def fingerprints(shingle: int):
    """Arrow UDF text -> signed 64-bit fingerprint."""
    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, shingle) for t in utf8(texts)], np.uint64).view(np.int64))
    return simhash


def _masks(bits: int, flips: int) -> np.ndarray:
    """All words with at most ``flips`` of the low ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(min(flips, bits) + 1) for c in combinations(range(bits), k)], np.uint64)


def meetings(prints: np.ndarray, left: np.ndarray, bits: int, odd: bool = False) -> Iterator[tuple[int, int]]:
    """Pairs of prints that meet in a variant, among those that agree above the
    low ``bits`` bits up to the flips already spent; ``left`` flips remain to
    each. Large sets are dealt by the next bits until they can be laid out.

    All who meet in a variant are paired with one of them, the lead. For an
    ``odd`` distance, twice the radius less one, that is one with flips to
    spare: it lies in reach of the others, two without need not. Two without
    differ in an even number of bits, so if they are in reach of each other
    they also meet in a variant where both have flips to spare."""
    if len(prints) < 2:
        return
    sizes = [len(_masks(bits, k)) for k in range(int(left.max()) + 1)]
    if bits and np.take(sizes, left).sum() > VARIANTS_AT_ONCE:
        step = min(4, bits)
        head = (prints >> np.uint64(bits - step)) & np.uint64((1 << step) - 1)
        for value in range(1 << step):
            spent = np.bitwise_count(head ^ np.uint64(value))
            here = spent <= left
            yield from meetings(prints[here], left[here] - spent[here], bits - step, odd)
        return
    low = np.uint64((1 << bits) - 1)
    variants, owners, spare = [], [], []
    for k in np.unique(left):
        own, masks = np.flatnonzero(left == k), _masks(bits, int(k))
        variants.append(((prints[own] & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
        spare.append(np.tile(np.bitwise_count(masks) < k, len(own)) if odd else np.ones(len(own) * len(masks), bool))
    variant, owner, spare = np.concatenate(variants), np.concatenate(owners), np.concatenate(spare)
    ordered = np.sort(variant)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    at = np.minimum(np.searchsorted(twice, variant), len(twice) - 1)
    met = np.flatnonzero(twice[at] == variant)
    met = met[np.lexsort((~spare[met], at[met])) if odd else np.argsort(at[met], kind="stable")]
    group, member = at[met], owner[met]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    leads = np.flatnonzero(first)[np.cumsum(first) - 1]
    led = ~first & spare[met][leads]
    pairs = np.unique(np.stack([member[leads][led], member[led]], 1), axis=0)
    yield from ((int(prints[a]), int(prints[b])) for a, b in pairs)


def _links(max_bits: int, bits: int):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        prints = rows["print"].to_numpy(np.int64).view(np.uint64)
        met = meetings(prints, rows["left"].to_numpy(np.int64), bits, max_bits % 2 == 1)
        near = ((a, b) for a, b in met if (a ^ b).bit_count() <= max_bits)   # verify
        out = np.array(spanning_links(near), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})
    return links


def near_prints(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) connecting the fingerprints (column ``print``, distinct)
    that reach each other in steps of at most ``max_bits`` bits."""
    radius = -(-max_bits // 2)
    n = distinct.count()
    ball = sum(math.comb(64, k) for k in range(radius + 1))
    bits = min(60, max(8, math.ceil(math.log2(max(1, n * ball / VARIANTS_AT_ONCE)))))

    def deal(rows: DataFrame, begin: int, width: int) -> DataFrame:
        """Each row once for every value of its next ``width`` bits in reach."""
        masks = [int(m) for m in _masks(width, radius)]
        spread = rows.select("*", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("flip"))
        head = F.shiftrightunsigned("print", 64 - begin - width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        return (spread.withColumn("left", F.col("left") - F.bit_count("flip")).where("left >= 0")
                .withColumn("bucket", F.shiftleft("bucket", width).bitwiseOR(head.bitwiseXOR(F.col("flip"))))
                .drop("flip"))

    rows = deal(distinct.select("print", F.lit(0).cast("bigint").alias("bucket"), F.lit(radius).alias("left")), 0, bits)
    links = []
    while True:
        full = cut(rows.groupBy("bucket").count().where(F.col("count") > BUCKET_ROWS).select("bucket"))
        split = bits < 60 and full.count() > 0
        light = rows.join(full, "bucket", "left_anti") if split else rows
        links.append(light.groupBy("bucket").applyInPandas(_links(max_bits, 64 - bits), "a bigint, b bigint"))
        if not split:
            break
        width = min(8, 64 - bits)
        rows = deal(rows.join(full, "bucket", "left_semi"), bits, width)
        bits += width
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5,
                       max_bits: int = 3) -> DataFrame:
    """One row per document: (id, fingerprint, component_id).

    Words are lower-cased (A-Z) runs without white space, features are
    ``shingle``-word shingles with repeats (all words of a shorter text),
    hashed with XXH64 (seed 42). Documents whose fingerprints differ in at most
    ``max_bits`` bits are linked; the component is the smallest id reachable.

    Defined cases: a null, empty or blank text has fingerprint 0 and is linked
    like any other; repeated rows give repeated result rows; a null id gets the
    smallest non-null id of its component, or null if there is none; an empty
    table gives an empty result. Only the two named columns are read.
    """
    need(docs, id_col, text)
    prints = stage(docs.select(F.col(f"`{id_col}`").alias("id"),
                               fingerprints(shingle)(F.col(f"`{text}`").cast("string")).alias("print")), "simhash")
    distinct = stage(prints.groupBy("print").agg(F.min("id").alias("low")), "simhash-distinct")
    linked = connected_components(near_prints(distinct.select("print"), max_bits))
    rooted = distinct.join(linked, distinct["print"] == linked["node"], "left").select(
        "print", "low", F.coalesce("component", "print").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("print", "component_id")
    return prints.join(named, "print").select(F.col("id").alias(id_col), F.col("print").alias("fingerprint"), "component_id")
