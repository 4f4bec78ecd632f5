import random

import numpy as np

from gridcube.llm import quality as Q
from tests.llm.helpers import DOC, documents


def labelled(spark):
    rng = random.Random(8)
    good, bad = "story river evening walked quiet garden".split(), "BUY!! CLICK!! FREE!! WIN!!".split()
    rows, labels = [], []
    for k in range(400):
        ok = rng.random() < 0.6
        n = rng.randrange(20, 80) if ok else rng.randrange(5, 15)
        rows.append((k, " ".join(rng.choice(good if ok else bad) for _ in range(n)), "en", "blog" if ok else "ads", 0))
        if k % 4 == 0:
            labels.append((k, int(ok)))
    truth = {r[0]: r[3] == "blog" for r in rows}
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id bigint, quality int"), truth


def test_views_learn_and_agree_with_unseen_documents(spark):
    docs, labels, truth = labelled(spark)
    views = Q.learn(docs, labels)
    got = Q.score(docs, views).collect()
    right = sum(r.quality.keep == truth[r.doc_id] for r in got)
    assert right >= 0.97 * len(got) and all(0 <= r.quality.score <= 1 for r in got)


def test_words_of_long_texts_are_all_read(monkeypatch):
    text = b" ".join(b"w%d" % i for i in range(500))
    monkeypatch.setattr(Q, "SLICE", 37)
    assert list(Q._words(text)) == text.split()


def test_awkward_rows_and_clashing_columns(spark):
    docs, labels, _ = labelled(spark)
    odd = documents(spark, extra=["quality", "score", "quality_scored", "key"])
    for views in (Q.learn(docs, labels), None):
        rows = Q.score(odd, views).collect()
        assert len(rows) == 8 and not any(r.quality.keep for r in rows if r.doc_id in (1, 2, 3))
    assert Q.learn(docs, labels.limit(0)) is None and Q.learn(docs, labels.where("quality = 1")) is None
    assert Q.score(odd.limit(0), None).count() == 0


def test_rare_class_and_labels_that_disagree(spark):
    docs, labels, truth = labelled(spark)
    good, bad = ([k for k in truth if truth[k] == ok] for ok in (True, False))
    rare = spark.createDataFrame([(k, 1) for k in good[:150]] + [(k, 0) for k in bad[:2]], labels.schema)
    views = Q.learn(docs, rare, max_labelled=40)
    got = Q.score(docs, views).collect()
    assert sum(r.quality.keep == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    both = spark.createDataFrame([(k, c) for k in good[:50] for c in (0, 1)] + [(k, 1) for k in good[50:60]], labels.schema)
    assert Q.learn(docs, both) is None


def test_every_unlabelled_document_is_scored_and_the_surest_teach(spark):
    docs, labels, _ = labelled(spark)
    docs = docs.unionByName(docs.limit(100)).unionByName(docs.limit(3).withColumn("doc_id", docs.doc_id * 0 - 1).withColumn(
        "text", Q.F.lit(None).cast("string")))
    given = Q._Learning(docs, labels, "doc_id", "text", "source", "lang", "quality")
    rng = np.random.default_rng(3)
    weights = {"text": rng.normal(size=Q.TEXT_BUCKETS + 1), "meta": rng.normal(size=Q.META_BUCKETS + 1)}
    known = {r.doc_id for r in labels.collect()}
    want = {}
    for r in given.rows.collect():
        b, w = Q._text_row(r.text.encode())
        mb, mw = Q._meta_row(r.meta)
        odds = (weights["text"][b] @ np.array(w) + weights["text"][-1], weights["meta"][mb] @ np.array(mw) + weights["meta"][-1])
        want[r.key] = tuple(int(np.floor(np.clip(x, -30, 30) * 16)) for x in odds)
    got = given.pool(weights).collect()
    assert {r.key for r in got} == set(want) - known and len(got) == len(want) - len(known)
    assert all(abs(a - b) <= 1 for r in got for a, b in zip((r.text, r.meta), want[r.key]))


def test_surest_bins_equal_a_search_over_all_rows():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(-480, 481): rng.randrange(1, 50) for _ in range(rng.randrange(0, 30))}
        at, have = Q.surest(counts, 0.9, 0.1)
        rows = sorted((b for b, n in counts.items() for _ in range(n)), reverse=True)
        sure = [b for b in rows if b >= 16 * np.log(9)]
        fits = [b for b in set(sure) if b == max(sure) or sum(x >= b for x in rows) <= 0.1 * len(rows)]
        assert (at, have) == ((min(fits), sum(x >= min(fits) for x in rows)) if fits else (481, 0))
