import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridcube.llm import phrases
from tests.llm.helpers import AWKWARD, LONG, documents


def counts_of(rows):
    """Counter of (lang, words) for runs of one to three words, by definition."""
    found = Counter()
    for _, text, lang, *_ in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            w = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                found.update((lang if lang is not None else "und", *w[i:i + k]) for i in range(len(w) - k + 1))
    return found


def brute(rows, least, first):
    f = counts_of(rows)
    total, best = Counter(), {}
    for g, a in f.items():
        total[g[0]] += a * (len(g) == 2)
    often = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    most = Counter()
    for h, b in often.items():
        if len(h) == 4:
            for pair in (h[:3], (h[0], *h[2:])):
                most[pair] = max(most[pair], b)
    for g, a in often.items():
        lang, w = g[0], g[1:]
        if len(w) == 2 and g in most and 2 * most[g] >= a:
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in best.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:first]))


def random_rows(seed, n=120):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(n):
        words = [rng.choice(["a", "b", "Ça", "d", "e", "☃", "x y", "f.", "g,h", "\tI\t", "j\n", "hot pair " + rng.choice("uvwxyz")]) for _ in range(rng.randrange(60))]
        text = " ".join(words) + (" " + passage if i % 5 == 0 else "") + (" loop loop loop loop loop" if i % 7 == 0 else "")
        rows.append((i, text, rng.choice(["en", "de", None, ""]), "s", 0))
    return rows


@pytest.mark.parametrize("at_once, hot_share, text_bytes", [(1_000_000, 1e-3, 1 << 20), (50, 1.0, 16), (300, 0.01, 64)])
def test_equals_brute_force(spark, monkeypatch, at_once, hot_share, text_bytes):
    """Also with few edges and bytes at once, and with and without hot nodes."""
    monkeypatch.setattr(phrases, "EDGES_AT_ONCE", at_once)
    monkeypatch.setattr(phrases, "HOT_SHARE", hot_share)
    monkeypatch.setattr(phrases, "BYTES_AT_ONCE", text_bytes)
    monkeypatch.setattr(phrases, "SAMPLE", 2)
    monkeypatch.setattr(phrases, "ROWS_AT_ONCE", 1 if at_once == 50 else 700)
    rows = random_rows(4)
    got = phrases.top_phrases(documents(spark, rows, extra=["n", "edge", "x", "phrase", "rank"]), least=6, first=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 40)


def test_counts_follow_from_edges_and_piece_ends(spark):
    rows = random_rows(9, 60) + AWKWARD
    f = counts_of(rows)
    graph = phrases.build_graph(documents(spark, rows), least=3)
    assert {(r.lang, r.x): r.n for r in graph.words.collect()} == {g: a for g, a in f.items() if len(g) == 2}
    assert {(r.lang, r.x, r.y): r.n for r in graph.nodes.collect()} == {g: a for g, a in f.items() if len(g) == 3 and a >= 3}
    assert {(r.lang, r.x, r.y, r.z): r.n for r in graph.edges.collect()} == {g: a for g, a in f.items() if len(g) == 4 and a >= 3}


def test_passages_compact_unary_paths(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PASSAGE_EDGES", 8)
    line = [f"w{i}" for i in range(30)]
    rows = [("en", *line[i:i + 3], 10 + i) for i in range(28)]
    rows += [("en", "r", "s", "t", 10), ("en", "s", "t", "r", 10), ("en", "t", "r", "s", 10)]                     # a circle
    rows += [("en", "m", "n", "o", 10), ("en", "k", "n", "o", 11), ("en", "n", "o", "p", 21), ("de", *line[:3], 10)]  # a joint at (n, o)
    got = phrases.passages(spark.createDataFrame(rows, "lang string, x string, y string, z string, n bigint")).collect()
    edges = sorted((r.lang, *r.words[i:i + 3], n) for r in got for i, n in enumerate(r.counts))
    assert edges == sorted(rows) and all(len(r.words) == len(r.counts) + 2 for r in got)
    english = sorted(" ".join(r.words) for r in got if r.lang == "en")
    assert [p for p in english if p.startswith("w")] == sorted(" ".join(line[i:i + 10]) for i in range(0, 28, 8))
    assert [p for p in english if not p.startswith("w")] == ["k n o", "m n o", "n o p", "r s t", "s t r", "t r s"]


def test_scores_are_exact(spark):
    rows = [(3, 7, 11), (2 ** 40 + 1, 2 ** 41 + 3, 2 ** 42 + 5), (10 ** 14 + 7, 10 ** 15 - 1, 10 ** 14 + 9), (10 ** 15, 10 ** 15, 10 ** 15)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    got = df.select("*", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD * 10 + [(9, LONG.replace("of", "\t"), None, None, 1)] * 2)
    got = sorted(map(tuple, phrases.top_phrases(docs, first=100).collect()))
    assert got == brute([tuple(r) for r in docs.collect()], 10, 100)
    assert phrases.top_phrases(docs.limit(0)).count() == 0
    assert phrases.top_phrases(docs.where("text IS NULL")).count() == 0
