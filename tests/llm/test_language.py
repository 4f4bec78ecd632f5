import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridcube.llm import language as L
from tests.llm.helpers import DOC, documents

WORDS = {"en": "the of and that with house water", "fr": "le la être avec maison eau très", "de": "der und nicht Häuser wasser über"}


def sample(spark, n=60):
    rng = random.Random(7)
    rows = []
    for k in range(n):
        g = "en fr de".split()[k % 3]
        rows.append((k, " ".join(rng.choice(WORDS[g].split()) for _ in range(rng.randrange(3, 60))), g, "s", 0))
    return spark.createDataFrame(rows, DOC)


def plain_bits(texts, text, min_context=24):
    """PPM code length of ``text`` after ``texts``, symbol by symbol."""
    fold = lambda t: (b"\n\n\n" + t.encode().lower())
    counts = [{} for _ in range(4)]
    freq = {}
    for stream in map(fold, texts):
        for i in range(3, len(stream)):
            freq[stream[i]] = freq.get(stream[i], 0) + 1
            for o in range(4):
                c = counts[o].setdefault(stream[i - o:i], {})
                c[stream[i]] = c.get(stream[i], 0) + 1

    def p(o, ctx, s):
        if o < 0:
            return 1 / L.SYMBOLS
        c = counts[o].get(ctx[len(ctx) - o:], {})
        total = sum(c.values())
        if not total or o == 3 and total < min_context:
            return p(o - 1, ctx, s)
        return (c[s] if s in c else len(c) * p(o - 1, ctx, s)) / (total + len(c))

    data = fold(text)
    common = sorted(range(256), key=lambda b: (-freq.get(b, 0), b))[:L.SYMBOLS - 1]
    assert set(data[3:]) <= set(common), "the plain version knows frequent bytes only"
    return sum(-math.log2(p(3, data[i - 3:i], data[i])) for i in range(3, len(data)))


def test_code_lengths_equal_a_symbol_by_symbol_count(spark, monkeypatch):
    docs = sample(spark).where("lang = 'fr'")
    trees = L.learn(docs)
    texts = [r.text for r in docs.select("text").collect()]
    for chunk in (1_000_000, 17):       # also across chunk borders
        monkeypatch.setattr(L, "CHUNK", chunk)
        got = L.code_lengths(trees, ["la maison être".encode(), b"", "avec eau".encode()])
        assert abs(got[0, 0] - plain_bits(texts, "la maison être")) < 1e-2 and got[1, 0] == 0
        assert abs(got[2, 0] - plain_bits(texts, "avec eau")) < 1e-2


def test_held_out_accuracy(spark):
    docs = sample(spark, 150).withColumn("held", L.held_out())
    out = L.identify(docs, L.learn(docs.where("not held"))).where("held")
    assert out.count() > 20 and out.where("language.lang_pred = lang").count() >= 0.95 * out.count()


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, extra=["language", "lang_pred", "language_scored"])
    rows = L.identify(docs, L.learn(sample(spark))).collect()
    assert len(rows) == 8 and all(0 <= r.language.score <= 1 for r in rows)
    assert {r.doc_id: r.language.lang_pred for r in rows if r.doc_id in (1, 2, 3, 6)} == dict.fromkeys((1, 2, 3, 6), "und")
    assert L.learn(docs.limit(0)) is None
    assert {r.language.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(docs.limit(0), None).count() == 0
    assert np.isfinite(L.learn(docs.where(F.col("lang") == "en")).bits).all()
