"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

Two words are one edit apart when their common prefix and common suffix
together reach the longer length less one. Words are dealt to blocks that agree
in all but one short part, so a pair can only lie in a block where that part
holds its edit; inside a block, padded code-point matrices are compared row
against row in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import cut, need, stage

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of the part that a block leaves open. With 90 letters a block holds
#: at most 90 * 90 + 90 words, however many words there are.
PART = 2
#: Most characters written as block keys of one word: words beyond some 700
#: letters have longer (and so fewer) parts.
KEY_CHARS = 1 << 19
#: Matrix cells compared at once.
TILE_CELLS = 1 << 22


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", run: str = RUN,
                rewrite: Callable[[Column, Column], Column] | None = None, shortest: int = 5,
                least: int = 3) -> DataFrame:
    """(word, n): every run of letters of the whole texts, with A-Z in lower
    case, that has ``shortest`` code points and occurs ``least`` times.
    ``rewrite(id, run)`` may replace a run before it is counted. A null id is
    the empty id; a null or empty text has no runs."""
    need(docs, id_col, text)
    word = F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(run), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), word.alias("run"))
    counted = rewrite(F.col("id"), F.col("run")) if rewrite else F.col("run")
    return (runs.select(counted.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            .where((F.length("word") >= shortest) & (F.col("n") >= least)))


def _width(longer: Column) -> Column:
    """Letters of an open part for pairs whose longer word has ``longer``."""
    return F.greatest(F.lit(PART), F.ceil(longer * longer / F.lit(KEY_CHARS))).cast("int")


def _blocks(words: DataFrame) -> DataFrame:
    """(longer, width, part, agreed, word, n): the word once for every part it
    may leave open, as the longer word of a pair (or one as long) and as the
    shorter. ``agreed`` hashes what stands before and behind the part, counted
    from either end; a chance meeting of hashes only costs a comparison."""
    size = F.length("word")
    open_at = F.transform(F.array(size, size + 1), lambda m: F.transform(
        F.sequence(F.lit(0), F.floor((m - 1) / _width(m)).cast("int")),
        lambda j: F.struct(m.alias("longer"), _width(m).alias("width"), j.alias("part"))))
    at = words.select("word", "n", F.explode(F.flatten(open_at)).alias("at")).select("word", "n", "at.*")
    before = F.col("part") * F.col("width")
    behind = F.greatest(F.col("longer") - before - F.col("width"), F.lit(0))
    agreed = F.xxhash64(F.substring("word", F.lit(1), before), F.substring("word", size - behind + 1, behind))
    return at.select("longer", "width", "part", agreed.alias("agreed"), "word", "n")


def _matrix(words: list[str], backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word in a row, padded with 0, and the lengths."""
    sizes = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(w[::-1] for w in words).encode("utf-32-le") if backwards
                         else "".join(words).encode("utf-32-le"), np.uint32)
    rows = np.zeros((len(words), max(1, sizes.max(initial=0))), np.uint32)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = flat
    return rows, sizes


def _agree(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of rows a and b (of different words)."""
    return np.argmax(rows[a] != rows[b], axis=1)


def near_in_blocks(longer: int, width: int, parts: np.ndarray, ends: np.ndarray,
                   words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b), a < b, of the near words of one length; row i belongs to
    a block of rows that ends before row ``ends[i]``. A pair counts only in the
    block whose open part holds the first letter that differs."""
    rows, sizes = _matrix(words, False)
    back, _ = _matrix(words, True)
    partners = ends - 1 - np.arange(len(words))
    most, found, i = max(1, TILE_CELLS // rows.shape[1]), [], 0
    upto = np.cumsum(partners)
    while i < len(words):
        # rows of a tile: as many as have ``most`` partners together, one at least
        k = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")))
        many = partners[i:k]
        a = np.repeat(np.arange(i, k), many)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        fits = np.maximum(sizes[a], sizes[b]) == longer
        a, b = a[fits], b[fits]
        for s in range(0, len(a), most):
            p, q = a[s:s + most], b[s:s + most]
            front = _agree(rows, p, q)
            near = (front + _agree(back, p, q) >= longer - 1) & (front // width == parts[p])
            found.append((p[near], q[near]))
        i = k
    return (np.concatenate([x[0] for x in found] or [[]]).astype(int),
            np.concatenate([x[1] for x in found] or [[]]).astype(int))


_KEY = ["longer", "width", "part", "agreed"]
_LINKS = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _links_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links, both ways, among whole blocks in key order."""
    keys = np.column_stack([rows[c].to_numpy().astype(np.int64) for c in _KEY])
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.array([], int)
    sizes = np.diff(np.append(starts, len(keys)))
    keep = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    if not len(keep):
        return
    rows, keys, sizes = rows.take(pa.array(keep)), keys[keep], sizes[sizes > 1]
    ends = np.repeat(np.cumsum(sizes), sizes)
    lengths = np.flatnonzero(np.concatenate(([True], keys[1:, 0] != keys[:-1, 0], [True])))
    for s, e in zip(lengths[:-1], lengths[1:]):
        words, n = rows["word"].slice(s, e - s).to_pylist(), rows["n"].slice(s, e - s).to_numpy()
        a, b = near_in_blocks(int(keys[s, 0]), int(keys[s, 1]), keys[s:e, 2], ends[s:e] - s, words)
        if len(a):
            at, other = np.concatenate([a, b]), np.concatenate([b, a])
            yield pa.record_batch([pa.array([words[i] for i in at], pa.string()), pa.array([words[i] for i in other], pa.string()),
                                   pa.array(n[other], pa.int64())], schema=_LINKS)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows in key order; the last block of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = lambda b, i: tuple(b.column(c)[i].as_py() for c in _KEY)
        if key(held[0], 0) == key(batch, batch.num_rows - 1):
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        last = np.column_stack([rows[c].to_numpy().astype(np.int64) for c in _KEY])
        first = len(last) - int(np.argmin(np.append((last[::-1] == last[-1]).all(axis=1), False)))
        yield from _links_of(rows.slice(0, first))
        held = rows.slice(first).to_batches()
    if held:
        yield from _links_of(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): every pair of the distinct ``words(word, n)``
    that differs by one inserted, deleted or replaced code point, both ways."""
    return (_blocks(words).repartition(*_KEY).sortWithinPartitions(*_KEY)
            .mapInArrow(_tiles, "word string, other string, other_n bigint"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: forms followed to the last one.
    Counts at least double with each step, so chains are short; every round
    doubles what has been followed."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = cut(now.join(step, F.col("root") == F.col("via"), "left")
                    .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")))
        if not moved.where("more").limit(1).count():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def spelling_variants(words: DataFrame, *, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct ``words(word, n)``.

    ``n_near`` counts the words one edit away. ``form`` is the one of these
    with the largest n (ties: first in code-point order) where that is at least
    ``ratio`` times the word's own, else null; ``root`` is where forms lead in
    the end, the word itself where there is none; ``form_n`` is the form's n.

    Defined cases: null words and words that are empty have no row; rows with
    one word count as one, their n added up; a null n counts as 0; an empty
    table gives an empty result; columns other than word and n are ignored.
    """
    need(words, "word", "n")
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could go round in circles")
    words = stage(words.where("word != ''").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n")), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("low"), "other")).alias("best"))
    large = -F.col("best.low")
    chosen = (large >= F.col("n") * ratio) & (large > 0)
    judged = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, large).alias("form_n")), "forms")
    roots = _roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
