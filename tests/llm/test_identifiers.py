import re

from gridcube.llm import identifiers as I
from tests.llm.helpers import documents

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and I._luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_seeds_equal_the_plain_patterns():
    import random
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "@", ".", "-", "+", " ", "4111111111111111", "1", "22", "255", "256", "(", ")", "é", "_", "%", "x.org", "\n", "0"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))
        assert I.seeds(text) == plain(text), text
    assert I.seeds("a" * 200_000 + "1" * 100_000) == [] and not I._luhn("4111111111111112")


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    rows = [(k, f"Please call me at +1 (555) 010-{1000 + k} today", "en", "s", 0) for k in range(12)]
    rows += [(100, "please call me at 555 010 7777 today", "en", "s", 0), (101, "order number 555 010 8888 was sent", "en", "s", 0)]
    got = {r.doc_id: r for r in I.find_identifiers(documents(spark, rows)).collect()}
    assert [tuple(s) for s in got[100].added] == [(3, 18, 30)] and got[101].added == []
    assert all(len(got[k].seeds) == 1 and got[k].added == [] for k in range(12))


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, extra=["found", "row", "seeds", "kind"])
    rows = I.find_identifiers(docs).collect()
    assert len(rows) == 8 and all(r.added == [] for r in rows)
    assert I.find_identifiers(docs.limit(0)).count() == 0
    one = I.find_identifiers(documents(spark, [(1, "é a@b.co 1.2.3.4", "", "", 0)])).select(I.written(__import__("pyspark").sql.functions.col("seeds")).alias("w"))
    assert one.first().w == "email:2:8,ip:9:16"


def test_labelled_lines_and_line_starts_give_patterns(spark):
    rows = [(k, f"Some text\nPhone: +1 (555) 010-{1000 + k}\n+1 (555) 020-{1000 + k} office\nmore", "en", "s", 0) for k in range(12)]
    rows += [(100, "Other\nPhone: 555 010 7777\nmore", "en", "s", 0), (101, "Phone: 555 010 8888", "en", "s", 0),
             (102, "555 020 7777 office", "en", "s", 0), (103, "Order: 555 010 9999\n555 020 9999 pieces", "en", "s", 0),
             (104, "555 010 6666", "en", "s", 0)]
    got = {r.doc_id: [tuple(s) for s in r.added] for r in I.find_identifiers(documents(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if v} == {100: [(3, 13, 25)], 101: [(3, 7, 19)], 102: [(3, 0, 12)]}
