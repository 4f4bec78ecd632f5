import random

from pyspark.sql import functions as F

from gridcube.llm import mixing
from tests.llm.helpers import documents


def water_fill(sizes, weights, ceiling=3):
    total, fixed = sum(sizes), {}
    while True:
        rest = [k for k in range(len(sizes)) if k not in fixed]
        share = total - sum(fixed.values())
        got = {k: share * weights[k] / sum(weights[j] for j in rest) for k in rest}
        over = [k for k in rest if got[k] > ceiling * sizes[k]]
        if not over:
            return [fixed.get(k, got.get(k)) for k in range(len(sizes))]
        fixed.update({k: ceiling * sizes[k] for k in over})


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(1)
    for _ in range(3):
        names = sorted(rng.sample("abcdefghijklmnop", rng.randrange(2, 12))) + [None]
        sizes = [rng.choice([0, 1, 5, 50, 4000]) for _ in names]
        if not any(sizes):
            continue
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, size bigint")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = water_fill(sizes, [k % 3 + 1 for k in range(len(names))])
        for name, t in zip(names, want):
            assert abs(got[name] - t) < 1e-6 * max(1, t)
        assert abs(sum(got.values()) - sum(sizes)) < 1e-6 * sum(sizes)


def test_taken_words_come_near_the_targets_and_agree_in_reruns(spark):
    rows = [(k, "w " * (k % 7 + 1), "en", "abcde"[min(4, k % 9)], 0) for k in range(6000)]
    sized = documents(spark, rows).withColumn("size", mixing.words(F.col("text")))
    mixed = mixing.mix(sized)
    per = mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r.n - r.t) < 0.06 * r.t for r in per)
    again = mixing.mix(sized.repartition(7))
    assert mixed.select("doc_id", "copies").exceptAll(again.select("doc_id", "copies")).count() == 0
    assert mixing.emit(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_rows_without_an_id_are_drawn_by_content(spark):
    rows = [(None, f"text {k} " + "w " * 8, "en", "a", 0) for k in range(400)] + [(k, "w " * 10, "en", "b", 0) for k in range(200)]
    sized = documents(spark, rows).withColumn("size", mixing.words(F.col("text")))
    per = mixing.mix(sized, content="text").groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n"))
    assert all(abs(r.n - r.t) < 0.15 * r.t for r in per.collect())


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, extra=["target", "copies", "mix_source", "mix_rate", "weight"])
    mixed = mixing.mix(docs.withColumn("size", mixing.words(F.col("text"))))
    rows = mixed.collect()
    assert len(rows) == 8 and all(r.mix_rate == "own mix_rate" and 0 <= r.copies <= 3 for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(docs.limit(0).withColumn("size", F.lit(0).cast("bigint"))).count() == 0
    null = mixing.mix(docs.withColumn("size", F.lit(None).cast("bigint")))
    assert {r.copies for r in null.collect()} == {0}
