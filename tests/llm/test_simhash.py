import random

import numpy as np
import pytest
import xxhash

from gridcube.llm import simhash
from gridcube.llm.components import connected_components
from tests.llm.helpers import documents, groups_of


def plain(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_a_bit_by_bit_count():
    rng = random.Random(5)
    for n in (0, 1, 3, 4, 5, 254, 255, 256, 257, 1500):
        text = " ".join(rng.choice(["a", "B", "ç", "dé\t", "e\x0bf"]) for _ in range(n))
        assert simhash.fingerprint(text.encode(), 4) == plain(text, 4)


@pytest.mark.parametrize("max_bits", [1, 2, 3, 5])
def test_links_reach_whatever_is_near(max_bits):
    """Families spread round a centre, where some lie further from each other
    than from the centre: the groups equal those of all pairs."""
    rng = random.Random(max_bits)
    for _ in range(120):
        centre, family = rng.getrandbits(20), set()
        for _ in range(rng.randrange(2, 7)):
            p = rng.choice([centre, *family])
            for b in rng.sample(range(20), rng.randrange(0, max_bits + 2)):
                p ^= 1 << b
            family.add(p)
        family = sorted(family)
        prints = np.array(family, np.uint64)
        met = list(simhash.meetings(prints, np.full(len(family), -(-max_bits // 2)), 20, max_bits % 2 == 1))
        near = [(a, b) for a, b in met if (a ^ b).bit_count() <= max_bits]
        want = [(a, b) for a in family for b in family if (a ^ b).bit_count() <= max_bits]
        assert groups_of(near, family) == groups_of(want, family)


@pytest.mark.parametrize("at_once, bucket", [(2_000_000, 200_000), (3000, 40)])
def test_components_equal_all_pairs(spark, monkeypatch, at_once, bucket):
    """Also with tiny limits, which deal buckets again and lay out in parts."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1}
    for _ in range(160):
        p = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print bigint")
    found = {r.node: r.component for r in connected_components(simhash.near_prints(df, 4)).collect()}
    want = groups_of([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4], prints)
    ours = {}
    for p in prints:
        s = int(np.uint64(p).view(np.int64))
        ours.setdefault(found.get(s, s), set()).add(p)
    theirs = {}
    for p in prints:
        theirs.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, extra=["print", "id", "low", "root", "node", "component_id"])
    got = simhash.simhash_components(docs, shingle=4, max_bits=4)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = got.collect()
    assert len(rows) == 8
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in rows if r.doc_id == 4] == [4, 4]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
