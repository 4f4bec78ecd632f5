import numpy as np

from gridcube.llm import embeddings as E
from tests.llm.helpers import groups_of

SCHEMA = "vec_id bigint, embedding array<float>, label int, uid string, copies int"


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(40, 16))
        for _ in range(300):
            v = centres[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.6])
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], label, "x", 1))
    rows += [(len(rows) + k, rows[5][1], 0, "x", 1) for k in range(30)]
    return rows


def brute(rows, least):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, *_ in rows}
    label = {r[0]: r[2] for r in rows}
    return [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= least]


def test_links_equal_brute_force_within_and_across_shards(spark, monkeypatch):
    rows = vectors()
    pairs = brute(rows, 0.93)
    n = {r[0]: 0 for r in rows}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    for shard in (8192, 100):
        monkeypatch.setattr(E, "SHARD", shard)
        got = {r.vec_id: r for r in E.near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()}
        found = sum(r.n_links for r in got.values())
        assert 0.98 * 2 * len(pairs) <= found <= 2 * len(pairs) and all(got[i].n_links <= n[i] for i in n)
        want = groups_of(pairs, n)
        assert sum(got[i].component_id != want[i] for i in n) <= 0.02 * len(n)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_every_vector_can_be_reached():
    x = E._unit(np.random.default_rng(1).normal(size=(1500, 8)) ** 3).astype(np.float32)
    graph = E.Graph(x)
    found = np.zeros((len(x), len(x)), bool)
    for a, b in graph.within(x, 0.999999, 32):
        found[a, b] = True
    assert found.diagonal().mean() > 0.99


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0, "", 0), (2, [], 0, "", 0), (3, [0.0, 0.0], 0, "", 0), (4, [nan, 1.0], 0, "", 0), (5, [inf, 1.0], 0, "", 0),
            (6, [1.0, None], 0, "", 0), (7, [1.0, 0.0], None, "", 0), (8, [1.0, 0.0], 0, "", 0), (9, [2.0, 0.0], 0, "", 0),
            (9, [2.0, 0.0], 0, "", 0), (10, [1.0, 0.0, 0.0], 0, "", 0), (None, [1.0, 0.01], 0, "", 0), (11, [1.0, 0.0], 1, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_embeddings(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == [*[(k, 0, k, True) for k in range(1, 8)], (8, 3, 8, True), (9, 3, 8, False), (9, 3, 8, False),
                                    (10, 0, 10, True), (11, 0, 11, True), (None, 3, 8, False)]
    assert E.near_embeddings(df.limit(0)).count() == 0
