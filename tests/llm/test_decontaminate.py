import random
import re

import pytest

from gridcube.llm import decontaminate as D
from tests.llm.helpers import DOC, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, size):
    words = [m.group() for m in WORD.finditer(fold(text))]
    spans = [m.span() for m in WORD.finditer(fold(text))]
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall(fold(body))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            window = w[k:k + size]
            for i in range(len(words) - len(window) + 1):
                if words[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add("null" if item is None else str(item))
    return len(words), [spans[i] for i in sorted(hit)], sorted(found)


@pytest.mark.parametrize("block_bytes", [2_000_000, 60])
def test_hits_spans_and_items_equal_a_direct_search(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "AUTOMATON_BYTES", block_bytes)   # 60: several automata
    rng = random.Random(3)
    vocabulary = ["ab", "Été", "x9", "zu", "q", "été"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 4, 7]))) for k in range(8)] + [(None, "q q q q"), (9, None), (10, "..."), (3, "zu zu zu ab")]
    rows = [(k, say(rng.randrange(0, 40)), "en", "s", 0) for k in range(30)] + [(99, None, None, None, None), (98, "", "", "", 0)]
    out = D.decontaminate(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id int, text string"), size=4)
    got = {r.doc_id: r.contamination for r in out.collect()}
    for doc_id, text, *_ in rows:
        n, spans, found = brute(text, items, 4)
        c = got[doc_id]
        assert (c.n_words, [tuple(w) for w in c["words"]], c["items"]) == (n, spans, found)
        assert c.n_hit == len(spans) and c.contaminated == (len(spans) > 0 and 20 * len(spans) >= n)


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, extra=["contamination", "contamination_part", "item_id", "n_hit"])
    bench = spark.createDataFrame([(1, "One two three four five six")], "item_id int, text string")
    out = D.decontaminate(docs, bench).orderBy("doc_id").collect()
    assert len(out) == 8 and out[0].contamination_part == "own contamination_part"
    assert [r.doc_id for r in out if r.contamination.contaminated] == [4, 4]
    assert D.decontaminate(docs, bench.limit(0)).where("contamination.n_hit > 0").count() == 0
    assert D.decontaminate(docs.limit(0), bench).count() == 0
