import random

import numpy as np
import public_tokenizers
import sentencepiece

from gridcube.llm import tokens
from tests.llm.helpers import AWKWARD, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    parts = list(" \n\t▁abehtnos") + ["  ", "é", "ﬁ", "Ａ", "😀", "<s>", "\0", "    ", "日本", "\r", "the", "tion"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 200))) for _ in range(400)]
    texts += [" " * 900, "a" * 900, "ab" * 500, "\n" * 50 + " " * 77, "</s><unk>"]
    want = [len(x) for x in lib.encode(texts)]
    with open(MODEL, "rb") as f:
        merges = tokens.Merges(f.read())
    assert tokens.Counter(merges).count([t.encode() for t in texts]) == want
    monkeypatch.setattr(tokens, "SLICE", 40)              # long texts in slices, memory emptied on the way
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    assert tokens.Counter(merges).count([t.encode() for t in texts]) == want


def test_awkward_rows_and_clashing_columns(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = tokens.count_tokens(documents(spark, extra=["n_tokens", "count"]), MODEL)
    got = sorted((r.doc_id or -1, r.n_tokens) for r in out.collect())
    assert got == sorted((d or -1, len(lib.encode(t or ""))) for d, t, *_ in AWKWARD)
    assert tokens.count_tokens(documents(spark).limit(0), MODEL).count() == 0


def test_long_pre_tokens_go_through_the_arrays():
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    few, many = "aabntheriso", "日本語の文章中国人一二三 漢字仮名ไทย".replace(" ", "")
    texts = ["".join(rng.choice(few) for _ in range(n)) for n in (49, 500, 5000, 30_000)]
    texts += ["".join(rng.choice(many) for _ in range(n)) for n in (49, 500, 5000, 30_000)]
    texts += ["ab" * 9000, "a" * 9001, "-" * 7777, "the" * 5000, "international" * 900, "\t" * 333 + "xyz" * 444]
    with open(MODEL, "rb") as f:
        merges = tokens.Merges(f.read())
    assert tokens.Counter(merges).count([t.encode() for t in texts]) == [len(x) for x in lib.encode(texts)]
    merges.longest += 5         # a longer reach than needed changes nothing
    assert tokens.Counter(merges).count([t.encode() for t in texts]) == [len(x) for x in lib.encode(texts)]


def test_window_least_equals_brute_force():
    rng = random.Random(2)
    values = np.array([rng.randrange(9) for _ in range(50)])
    for n, reach in ((50, 7), (49, 7), (3, 7), (1, 1), (20, 1)):
        want = [min(values[max(0, k - reach):min(k, n)], default=tokens._NEVER) for k in range(n)]
        assert tokens._window_least(values[:n], reach).tolist() == want
