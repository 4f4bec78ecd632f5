"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items form one automaton. A document is
normalised byte by byte (so positions stay aligned with the original), scanned
once, and every occurrence of a window marks its words; marked words are
reported as code-point spans of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import fresh, need, utf8

#: Most bytes of window text in one automaton (some 100 MB in each worker). A
#: larger benchmark is dealt into several automata, each scanned in turn.
AUTOMATON_BYTES = 2_000_000

_WORD_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(0x20 if b in _WORD_SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_HITS = ("struct<n_words:bigint,words:array<struct<start:int,end:int>>,items:array<string>>")
_ARROW_HITS = pa.struct([("n_words", pa.int64()),
                         ("words", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         ("items", pa.list_(pa.string()))])


def windows(text: bytes, size: int) -> list[bytes]:
    """The item's windows of ``size`` words, or its only, shorter one."""
    words = text.translate(_FOLD).split()
    return [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def build(patterns: dict[bytes, list[str]]) -> ahocorasick.Automaton | None:
    """Automaton over ' window ' strings; each carries its word count and items."""
    if not patterns:
        return None
    found = ahocorasick.Automaton()
    for window, items in patterns.items():
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    found.make_automaton()
    return found


def scan(text: bytes | None, automaton: ahocorasick.Automaton | None) -> dict:
    """Word count, spans of the hit words and the items found, of one text."""
    folded = (text or b"").translate(_FOLD)
    words = folded.split()
    out = {"n_words": len(words), "words": [], "items": []}
    if not words or automaton is None:
        return out
    line = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(line.decode("latin-1")))
    if not hits:
        return out
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    last = np.searchsorted(gaps, [end for end, _ in hits])          # one past the window's last word
    first = last - np.array([size for _, (size, _) in hits])
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    hit = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], np.frombuffer(folded, np.uint8) != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])               # word starts and ends, alternating
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    out["words"] = [{"start": int(a), "end": int(b)}
                    for a, b in zip(chars[edges[0::2][hit]], chars[edges[1::2][hit]])]
    out["items"] = sorted({item for _, (_, items) in hits for item in items})
    return out


def _scanner(shipped):
    @F.arrow_udf(_HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = build(shipped.value)
        for texts in batches:
            yield pa.array([scan(t, automaton) for t in utf8(texts)], type=_ARROW_HITS)
    return hits


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[dict[bytes, list[str]]]:
    """The benchmark's windows, dealt by item into blocks of bounded size. Only
    one block's items are ever on the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")) \
        .where(F.col("text").isNotNull())
    # a word of the item lies in up to ``size`` windows
    total = items.agg(F.sum(F.octet_length("text") + 2)).first()[0] or 0
    n = max(1, -(-total * size // AUTOMATON_BYTES))
    for k in range(n):
        block: dict[bytes, list[str]] = {}
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        for row in part.toLocalIterator():
            for window in windows(row.text.encode(), size):
                names = block.setdefault(window, [])
                if (name := "null" if row.item is None else row.item) not in names:
                    names.append(name)
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", size: int = 13, share: tuple[int, int] = (1, 20),
                  out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_words``, ``n_hit``, ``items``
    (ids of the found items as strings, sorted), ``words`` (code-point span in
    the original of every hit word) and ``contaminated``.

    Words are runs of digits, letters and non-ASCII characters after
    lower-casing A-Z. A window is ``size`` consecutive words of an item, or all
    of a shorter item. A document is contaminated when it has hit words and
    they are at least ``share`` (numerator, denominator) of its words.

    Defined cases: a null or empty text has no words and is clean; a null item
    text has no windows; an item without id is listed as ``null``; rows with
    the same item id count as one item; repeated document rows get equal
    results; an empty benchmark finds nothing. All other columns pass through
    untouched; an existing column named ``out`` is replaced.
    """
    need(docs, text)
    need(benchmark, item_id, item_text)
    docs, parts = docs.drop(out), []
    for block in _blocks(benchmark, item_id, item_text, size):
        parts += fresh(docs, f"{out}_part")
        shipped = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.withColumn(parts[-1], _scanner(shipped)(F.col(f"`{text}`").cast("string")))
    n_words = F.col(f"{parts[0]}.n_words")
    words, items = (F.col(f"{parts[0]}.{x}") for x in ("words", "items"))
    if len(parts) > 1:
        words, items = (F.array_sort(F.array_distinct(F.concat(*[F.col(f"{p}.{x}") for p in parts])))
                        for x in ("words", "items"))
    n_hit = F.size(words).cast("bigint")
    return docs.withColumn(out, F.struct(
        n_words.alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), words.alias("words"),
        ((n_hit > 0) & (n_hit * share[1] >= n_words * share[0])).alias("contaminated"))).drop(*parts)
