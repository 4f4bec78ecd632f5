"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable depth: contexts of two
symbols always, of three where they are frequent enough. Statistics are frozen
after training; a text is scored by its exact code length under each tree,
with escape probabilities (method C) to shorter contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import fresh, need, utf8

#: Byte values with a symbol of their own; the rest share the last symbol.
SYMBOLS = 96
#: Bytes scored at once in a task.
CHUNK = 1_000_000

_PAD = b"\n\n\n"
_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


@dataclass
class Trees:
    """Frozen code lengths in bits. ``row`` maps the three symbols before to a
    row of ``bits`` (context, symbol, language); ``symbol`` maps bytes."""
    languages: list[str]
    symbol: np.ndarray
    row: np.ndarray
    bits: np.ndarray


def _fold(text: bytes) -> bytes:
    return text.lower()      # A-Z only


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, four bytes as one number, count) of a batch of texts."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), utf8(batch.column("text"))
        for lang in sorted(set(langs)):
            own = [t for g, t in zip(langs, texts) if g == lang]
            data = np.frombuffer(b"".join(_PAD + _fold(t) for t in own), np.uint8).astype(np.uint32)
            code = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
            inside = np.ones(len(data), bool)       # the padding before a text only serves as context
            starts = np.cumsum([0] + [len(_PAD) + len(t) for t in own[:-1]])
            inside[(starts[:, None] + np.arange(len(_PAD))).ravel()] = False
            gram, n = np.unique(code[inside[3:]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["lang", "gram", "n"])


def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of the last axis: seen symbols by count, the escape mass
    (as many as there are distinct symbols) over the shorter context's."""
    total, distinct = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    seen = total + distinct
    with np.errstate(invalid="ignore", divide="ignore"):
        mixed = np.where(counts > 0, counts / seen, distinct / seen * shorter)
    return np.where(total > 0, mixed, shorter)


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, min_context: int = 24) -> Trees:
    """Trees from 4-gram counts. Three-symbol contexts seen at least
    ``min_context`` times in some language get rows of their own."""
    byte = np.stack([gram >> s & 0xFF for s in (24, 16, 8, 0)])
    frequent = np.argsort(-np.bincount(byte[3], n, 256), kind="stable")[:SYMBOLS - 1]
    symbol = np.full(256, SYMBOLS - 1, np.int64)
    symbol[frequent] = np.arange(SYMBOLS - 1)
    c0, c1, c2, c3 = symbol[byte]
    a, k = SYMBOLS, len(languages)
    deep = np.flatnonzero(np.max([np.bincount((c0 * a + c1)[lang == j] * a + c2[lang == j], n[lang == j], a ** 3)
                                  for j in range(k)], axis=0) >= min_context)
    row = np.tile(np.arange(a * a), a).astype(np.int32)
    row[deep] = a * a + np.arange(len(deep))
    bits = np.empty((a * a + len(deep), a, k), np.float32)
    for j in range(k):
        mine = lang == j
        w, ctx3 = n[mine], (c0[mine] * a + c1[mine]) * a + c2[mine]
        p0 = _blend(np.bincount(c3[mine], w, a), np.full(a, 1 / a))
        p1 = _blend(np.bincount(c2[mine] * a + c3[mine], w, a * a).reshape(a, a), p0)
        p2 = _blend(np.bincount((c1[mine] * a + c2[mine]) * a + c3[mine], w, a ** 3).reshape(a, a, a), p1[None])
        own = row[ctx3] >= a * a
        counts = np.bincount((row[ctx3[own]] - a * a) * a + c3[mine][own], w[own], len(deep) * a).reshape(len(deep), a)
        p3 = _blend(counts, p2.reshape(a * a, a)[deep % (a * a)])
        bits[:a * a, :, j] = -np.log2(p2.reshape(a * a, a))
        bits[a * a:, :, j] = -np.log2(p3)
    bits[:, a - 1] += np.log2(256 - (a - 1))     # which of the rare bytes
    return Trees(languages, symbol.astype(np.uint8), row, bits)


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang", max_bytes: int = 4_000_000) -> Trees | None:
    """Trees from rows with a text and a language. At most about ``max_bytes``
    of text per language are used, chosen by hash of the text; languages with
    less are used whole. None where there is nothing to learn from."""
    need(labelled, text, lang)
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")) \
        .where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] or 0 for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for g in languages for x in (g, min(1.0, max_bytes / max(1, sizes[g])))]), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30))
    grams = sample.mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    code = {g: k for k, g in enumerate(languages)}
    lang_code = np.array([code[g] for g in grams["lang"].to_pylist()], np.int64)
    return build(languages, lang_code, grams["gram"].to_numpy(), grams["n"].to_numpy().astype(np.float64))


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language, in chunks of bounded memory."""
    out = np.zeros((len(texts), len(trees.languages)))
    flat = trees.bits.reshape(-1, len(trees.languages))
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + len(_PAD)
            end += 1
        lengths = np.array([len(t) + len(_PAD) for t in texts[begin:end]])
        stream = _fold(b"".join(_PAD + t for t in texts[begin:end]))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for at in range(0, len(stream), CHUNK):
            piece = np.frombuffer(stream[max(0, at - 3):at + CHUNK], np.uint8)
            s = trees.symbol[piece].astype(np.int32)
            if len(s) <= 3:
                continue
            ctx = (s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]
            bits = flat[trees.row[ctx] * SYMBOLS + s[3:]]
            place = np.arange(max(0, at - 3) + 3, at + len(piece) - (at > 0) * 3)
            owner = np.searchsorted(starts, place, "right") - 1
            bits[place - starts[owner] < len(_PAD)] = 0          # the padding itself is free
            change = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[begin + owner[change]] += np.add.reduceat(bits, change, axis=0, dtype=np.float64)
        begin = end
    return out


def identify(docs: DataFrame, trees: Trees | None, *, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: ``lang_pred``, ``score`` (the
    posterior of the best language under equal priors) and ``bits_per_byte``.

    The whole text is scored and nothing but the text. A null text or one
    without any letter is ``und`` with score 0 and null bits, and so is every
    text if there are no trees. Equal code lengths go to the first language in
    order. Repeated rows get equal results; other columns pass through, an
    existing column ``out`` is replaced.
    """
    need(docs, text)
    docs = docs.drop(out)
    body = F.col(f"`{text}`").cast("string")
    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    if trees is None:
        return docs.withColumn(out, und)
    shipped = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        frozen = shipped.value
        for texts in batches:
            raw = [t or b"" for t in utf8(texts)]
            bits = code_lengths(frozen, raw)
            best = bits.argmin(axis=1) if len(raw) else np.zeros(0, np.int64)
            least = bits[np.arange(len(raw)), best]
            posterior = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
            yield pa.StructArray.from_arrays(
                [pa.array([frozen.languages[k] for k in best], pa.string()), pa.array(posterior),
                 pa.array(least / np.maximum([len(t) for t in raw], 1))], fields=list(_RESULT))

    result, = fresh(docs, f"{out}_scored")
    docs = docs.withColumn(result, score(body))
    return docs.withColumn(out, F.when(F.coalesce(body.rlike(r"\p{L}"), F.lit(False)), F.col(result)).otherwise(und)).drop(result)


def held_out(id_col: str = "doc_id"):
    """Documents kept from training: crc32 of the id as text leaves 1 by 3. A
    null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
