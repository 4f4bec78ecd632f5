import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from gridcube.llm import spelling
from gridcube.llm.queries import dropped_letter
from tests.llm.helpers import LONG, documents


def one_edit(a, b):
    """By the definition: one letter replaced, or one left out."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=2):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] and counts[best] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def ours(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df).collect()}


@pytest.mark.parametrize("tile, key_chars, part", [(1 << 22, 1 << 19, 2), (40, 60, 2), (1 << 22, 1 << 19, 1)])
def test_equals_all_pairs(spark, monkeypatch, tile, key_chars, part):
    """Also with tiles of a few rows, and with wide open parts."""
    for name, value in (("TILE_CELLS", tile), ("KEY_CHARS", key_chars), ("PART", part)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(3)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 5, 6, 9, 14])))
        for _ in range(rng.randrange(1, 8)):
            w, i = base, rng.randrange(len(base) + 1)
            kind = rng.randrange(4)
            w = [w, w[:i] + w[i + 1:], w[:i] + rng.choice("abéÿ𝔘") + w[i:], w[:i] + rng.choice("abz") + w[i + 1:]][kind]
            if w:
                counts[w] = rng.choice([0, 3, 3, 7, 20, 41, 90])
            base = w or base
    assert ours(spark, counts) == brute(counts)


def test_crowded_blocks_and_long_words(spark):
    """A block of many words alike but for two letters, and words of thousands of letters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {f"pre{x}{y}post": 3 + (ord(x) * 7 + ord(y)) % 50 for x in letters[:12] for y in letters[:12]}
    long = "abcdefgh" * 700
    counts |= {long: 50, long[:3000] + long[3001:]: 3, "x" + long: 4, long + "y": 5, long[:100] + "z" + long[101:]: 6}
    assert ours(spark, counts) == brute(counts)


def test_chains_of_forms_lead_to_one_root(spark):
    counts = {"a" * k + "stem": 2 ** (12 - k) for k in range(1, 12)}
    got = ours(spark, counts)
    assert {v[1] for v in got.values()} == {"astem"}


def test_blocks_across_batches():
    words = sorted({f"wo{a}{b}rd" for a in "abcdef" for b in "abcdef"})
    rows = [(6, 2, 1, 7, w, 3) for w in words] + [(6, 2, 1, 9, "other", 3)]
    schema = pa.schema([("longer", pa.int32()), ("width", pa.int32()), ("part", pa.int32()), ("agreed", pa.int64()),
                        ("word", pa.string()), ("n", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i:i + 5]], schema=schema) for i in range(0, len(rows), 5)]
    found = {(w, o) for b in spelling._tiles(iter(batches)) for w, o in zip(b["word"].to_pylist(), b["other"].to_pylist())}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b) and (a[:2], a[4:]) == (b[:2], b[4:])}


def test_words_of_documents_equal_plain_counting(spark):
    docs = [(k, t, "en", "s", 0) for k, t in enumerate(
        ["Hello hellO hello×x HELLO ÀÉß WORLDS worlds worlds", None, "", "naïve naïve Naïve a bb ccc", LONG[:5000]])] + [(None, "hello", None, None, 0)]
    rows = docs * 2
    want = Counter()
    for doc, text, *_ in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    got = spelling.count_words(documents(spark, rows, extra=["run", "word", "n", "id"]), rewrite=dropped_letter)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_awkward_rows(spark):
    df = spark.createDataFrame([(None, 3, "x"), ("", 9, "x"), ("abcde", 2, "x"), ("abcde", 2, "x"), ("abcdx", None, "x"), ("abcd", 1, "x")],
                               "word string, n bigint, form string")
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(df).collect()}
    assert got == {"abcde": (None, "abcde", 4, 2, None), "abcdx": ("abcde", "abcde", 0, 2, 4), "abcd": ("abcde", "abcde", 1, 2, 4)}
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        spelling.spelling_variants(df, ratio=1)
