"""Document quality by co-training two views.

One logistic classifier sees the words of a text, the other only what is known
about the document (source, language, size and layout). Over a few rounds each
labels the documents it is surest of for the other: Spark scores the whole
unlabelled table and a histogram of the scores tells from where on a view is
sure. Both are then calibrated on labelled documents kept aside and combined to
score everything.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import fresh, need, stage, utf8
from gridcube.plans.strategy import join_small

TEXT_BUCKETS, META_BUCKETS = 1 << 16, 1 << 12
#: Characters of a text taken apart at once.
SLICE = 1_000_000
#: Bins of a log-odds unit in which scores are counted, and the log odds of the last bins.
BINS, LAST = 16, 30


def _words(text: bytes) -> Iterator[bytes]:
    """Words of a text, taken apart in slices that end at white space."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= SLICE else at + SLICE
        while end < len(text) and text[end] not in b" \n\t\r":
            end += 1
        yield from text[at:end].split()
        at = end


def _shape(word: bytes) -> bytes:
    case = b"U" if word.isupper() else b"l" if word.islower() else b"T" if word[:1].isupper() else b"-"
    return b"\0" + case + (word[-1:] if not word[-1:].isalnum() and word[-1] < 128 else b"")


def _word_buckets(word: bytes) -> tuple[int, int]:
    return zlib.crc32(word.lower()) % TEXT_BUCKETS, zlib.crc32(_shape(word)) % TEXT_BUCKETS


def meta_features(text: str, source: str | None, lang: str | None) -> list[Column]:
    """Strings that describe a document without its words."""
    body = F.col(f"`{text}`")
    log = lambda c: F.floor(2 * F.log2(F.coalesce(c, F.lit(0)).cast("double") + 1)).cast("string")
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    out = [F.concat(F.lit("size "), log(F.length(body))), F.concat(F.lit("lines "), log(lines)),
           F.concat(F.lit("line length "), log(F.try_divide(F.length(body), lines)))]
    for name in (source, lang):
        if name:
            out.append(F.concat(F.lit(f"{name} "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("\0"))))
    return out


@dataclass
class Sparse:
    """Rows of (bucket, weight), each summing to 1."""
    start: np.ndarray
    bucket: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: pa.Array) -> "Sparse":
        """From an array of struct<bucket, weight>, no list empty or null."""
        bucket, weight = rows.field("bucket"), rows.field("weight")
        starts = bucket.offsets.to_numpy()
        return cls((starts[:-1] - starts[0]).astype(np.int64), bucket.flatten().to_numpy().astype(np.int64), weight.flatten().to_numpy())

    def rows(self, keep: np.ndarray) -> "Sparse":
        """The rows where ``keep`` is true."""
        sizes = np.diff(np.append(self.start, len(self.bucket)))
        entries = np.repeat(keep, sizes)
        return Sparse(np.concatenate(([0], np.cumsum(sizes[keep])))[:keep.sum()].astype(np.int64), self.bucket[entries], self.weight[entries])

    def plus(self, other: "Sparse") -> "Sparse":
        return Sparse(np.concatenate((self.start, other.start + len(self.bucket))), np.concatenate((self.bucket, other.bucket)),
                      np.concatenate((self.weight, other.weight)))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weight * weights[self.bucket], self.start) if len(self.start) else np.zeros(0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: Sparse, y: np.ndarray, buckets: int, steps: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last one is the constant), both classes counting
    the same, by gradient steps scaled per bucket (Adagrad)."""
    w, power = np.zeros(buckets + 1), np.full(buckets + 1, 1e-8)
    sizes = np.diff(np.append(x.start, len(x.bucket)))
    balance = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    for _ in range(steps):
        error = (_sigmoid(x.dot(w) + w[-1]) - y) * balance
        g = np.bincount(x.bucket, x.weight * np.repeat(error, sizes), buckets + 1) + ridge * w / max(1, len(y))
        g[-1] = error.sum()
        power += g * g
        w -= 0.5 * g / np.sqrt(power)
    return w


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a logistic curve over scores, by Newton steps on a
    lightly smoothed likelihood; the identity where one class is missing."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    goal = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    ab = np.array([1.0, 0.0])
    rows = np.stack([score, np.ones_like(score)], 1)
    for _ in range(50):
        p = _sigmoid(rows @ ab)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2), rows.T @ (p - goal) + 1e-3 * (ab - [1, 0]))
        ab -= np.clip(step, -2, 2)
    return max(float(ab[0]), 1e-3), float(ab[1])


@dataclass
class Views:
    """Weights and calibration (slope, constant) of both views, and how much
    each counts in the combination."""
    text: np.ndarray
    meta: np.ndarray
    text_curve: tuple[float, float]
    meta_curve: tuple[float, float]
    shares: tuple[float, float]


def combine(weights: dict[str, np.ndarray], data: dict[str, Sparse], y: np.ndarray, prior: float = 0.0) -> Views:
    """Views calibrated on labelled rows that the weights have not seen;
    ``prior`` is by how much log odds are higher where documents are scored."""
    scores = {v: x.dot(weights[v]) + weights[v][-1] for v, x in data.items()}
    curves = {v: calibrate(scores[v], y) for v in data}
    gains = []
    for v in data:      # bits of a label that the calibrated view explains
        p = np.clip(_sigmoid(scores[v] * curves[v][0] + curves[v][1]), 1e-6, 1 - 1e-6)
        base = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        entropy = -(base * math.log(base) + (1 - base) * math.log(1 - base))
        gains.append(max(1e-3, entropy + float(np.mean(np.where(y > 0.5, np.log(p), np.log(1 - p)))) if len(y) else 1e-3))
    curves = {v: (slope, constant + prior) for v, (slope, constant) in curves.items()}
    return Views(weights["text"], weights["meta"], curves["text"], curves["meta"],
                 (gains[0] / sum(gains), gains[1] / sum(gains)))


def frank(weights: np.ndarray, x: Sparse, y: np.ndarray) -> np.ndarray:
    """Weights scaled to what they are worth on labelled rows they have not
    seen, both classes counting the same, so that a view that knows nothing is
    sure of nothing."""
    slope, constant = calibrate(x.dot(weights) + weights[-1], y)
    out = weights * slope
    out[-1] += constant - math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return out


def surest(counts: dict[int, int], confident: float, most: float) -> tuple[int, int]:
    """From which bin of log odds on a view is sure of class 1: the lowest one
    of at least ``confident`` from which up there is no more than the share
    ``most`` of all rows, or else the highest; and how many rows these are."""
    total, have, at = sum(counts.values()), 0, BINS * LAST + 1
    for b in sorted(counts, reverse=True):
        if b < BINS * math.log(confident / (1 - confident)) or have and have + counts[b] > most * total:
            break
        at, have = b, have + counts[b]
    return at, have


def _text_row(text: bytes | None) -> tuple[list[int], list[float]]:
    count: Counter = Counter()
    for word, n in Counter(_words(text or b"")).items():
        for b in _word_buckets(word):
            count[b] += n
    total = sum(count.values())
    return (list(count), [n / total for n in count.values()]) if total else ([0], [0.0])


def _meta_row(features: list[str]) -> tuple[list[int], list[float]]:
    return [zlib.crc32(f.encode()) % META_BUCKETS for f in features if f is not None], [1 / len(features)] * sum(f is not None for f in features)


_ROW = "struct<bucket:array<int>,weight:array<double>>"
_ARROW_ROW = pa.struct([("bucket", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))])


def _sparse_rows(rows: list[tuple[list[int], list[float]]]) -> pa.Array:
    return pa.array([dict(zip(("bucket", "weight"), r)) for r in rows], _ARROW_ROW)


def _featurise(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _sparse_rows([_text_row(t) for t in utf8(texts)])


def _log_odds(text: np.ndarray, meta: np.ndarray, batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What weights of both views say of (text, metadata strings), uncalibrated."""
    weights, memory = text.tolist(), {}
    for texts, metas in batches:
        of_text, of_meta = [], []
        for raw, strings in zip(utf8(texts), metas.to_pylist()):
            total = n = 0
            for word in _words(raw or b""):
                if (value := memory.get(word)) is None:
                    a, b = _word_buckets(word)
                    if len(memory) > 500_000:
                        memory.clear()
                    value = memory[word] = weights[a] + weights[b]
                total += value
                n += 2
            of_text.append((total / n if n else 0.0) + weights[-1])
            bucket, share = _meta_row(strings)
            of_meta.append(float(meta[bucket] @ np.array(share)) + meta[-1])
        yield np.array(of_text), np.array(of_meta)


def _bin(log_odds: str) -> Column:
    return F.floor(F.least(F.greatest(F.col(log_odds), F.lit(-LAST)), F.lit(LAST)) * BINS).cast("int")


class _Learning:
    """The documents that views learn from: one row for each id with a text, of
    several the one whose text has the smallest hash."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text: str, source: str | None, lang: str | None, label: str):
        self.rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"),
                                F.array(*meta_features(text, source, lang)).alias("meta")).where("key is not null and text is not null") \
            .withColumn("hash", F.xxhash64("text"))
        known = labels.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")) \
            .where("key is not null and label in (0, 1)").groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        self.labelled = stage(self.rows.select("key").join(known.where("label = other").select("key", "label"), "key").distinct(), "quality-labels")

    @staticmethod
    def draw(purpose: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(purpose), "key"), F.lit(1 << 30)) / F.lit(1 << 30)

    def sample(self, keys: DataFrame) -> tuple[pa.Table, dict[str, Sparse]]:
        """The columns of ``keys`` (one row an id, some thousands) and both views' features."""
        others = [c for c in keys.columns if c != "key"]
        one = join_small(self.rows, keys, "key").groupBy("key", *others).agg(F.min(F.struct("hash", "meta", "text")).alias("row"))
        got = one.select("key", *others, "row.meta", F.xxhash64(F.lit("fold"), "key").alias("fold"),
                         F.arrow_udf(_featurise, _ROW)("row.text").alias("text")).orderBy("fold", "key").toArrow().combine_chunks()
        whole = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
        return got, {"text": Sparse.of(whole(got["text"])), "meta": Sparse.of(_sparse_rows([_meta_row(m) for m in got["meta"].to_pylist()]))}

    def pool(self, weights: dict[str, np.ndarray]) -> DataFrame:
        """Bins (``text``, ``meta``) of every unlabelled document's log odds."""
        shipped = self.rows.sparkSession.sparkContext.broadcast(weights)
        kind = pa.struct([("text", pa.float64()), ("meta", pa.float64())])

        def say(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            w = shipped.value
            for both in _log_odds(w["text"], w["meta"], batches):
                yield pa.StructArray.from_arrays([pa.array(x) for x in both], fields=list(kind))

        say.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        said = self.rows.select("key", "hash", F.arrow_udf(say, "struct<text:double,meta:double>")("text", "meta").alias("said"))
        bins = said.select("key", F.struct("hash", _bin("said.text").alias("text"), _bin("said.meta").alias("meta")).alias("bins"))
        one = bins.groupBy("key").agg(F.min("bins").alias("bins")).join(self.labelled.select("key"), "key", "left_anti")
        return stage(one.select("key", "bins.text", "bins.meta"), "quality-pool")


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str | None = "source",
          lang: str | None = "lang", label: str = "quality", max_labelled: int = 4000, max_taught: int = 4000,
          rounds: int = 2, confident: float = 0.9, most: float = 0.1) -> Views | None:
    """Views fitted by co-training on ``docs`` and their ``labels`` (0 or 1).

    Weights are fitted on about ``max_labelled`` labelled documents, half of
    either class (all of a class that has fewer), drawn by hash of the id; a
    quarter of each class only calibrates. In every round all unlabelled
    documents are scored; of the ``most`` surest of either class (whole bins of
    the histogram of their calibrated log odds, ``confident`` at least) about
    ``max_taught`` / 2, drawn by hash, teach the other view. Only the features
    of drawn documents and the histograms reach the driver.

    Rows without an id or a text teach nothing; repeated ids count once (see
    _Learning); ids with both labels count as unlabelled. None if no document
    has a label of one of the classes, as with empty tables.
    """
    need(docs, id_col, text, *[c for c in (source, lang) if c])
    need(labels, id_col, label)
    given = _Learning(docs, labels, id_col, text, source, lang, label)
    n = {r.label: r["count"] for r in given.labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    rate = F.when(F.col("label") == 1, max_labelled / 2 / n[1]).otherwise(max_labelled / 2 / n[0])
    got, data = given.sample(given.labelled.where(given.draw("labelled") < rate))
    y = got["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        raise ValueError(f"max_labelled={max_labelled} draws no document of one class")
    aside = np.zeros(len(y), bool)
    for c in (0, 1):       # rows come in the order of another hash
        of_class = np.flatnonzero(y == c)
        aside[of_class[3::4]] = True
    taught = {v: (x.rows(~aside), y[~aside]) for v, x in data.items()}
    buckets, weights = {"text": TEXT_BUCKETS, "meta": META_BUCKETS}, {}
    for r in range(rounds + 1):
        weights = {v: fit(x, goal, buckets[v]) for v, (x, goal) in taught.items()}
        if r == rounds:
            break
        pool = given.pool({v: frank(weights[v], x.rows(aside), y[aside]) for v, x in data.items()})
        bins = pool.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("bin")) for v in data])).alias("x"))
        counts: dict[str, dict[int, int]] = {v: {} for v in data}
        for row in bins.groupBy("x.view", "x.bin").count().collect():      # at most 2 * (2 * BINS * LAST + 1) rows
            counts[row.view][row.bin] = row["count"]
        labels_of = {}
        for v in data:
            high, n_high = surest(counts[v], confident, most)
            low, n_low = surest({-1 - b: c for b, c in counts[v].items()}, confident, most)      # log odds of class 0
            share = lambda k: F.lit(max_taught / 2 / max(1, k))
            labels_of[v] = F.when((F.col(v) >= high) & (given.draw(f"{v} {r}") < share(n_high)), 1) \
                .when((-1 - F.col(v) >= low) & (given.draw(f"{v} {r}") < share(n_low)), 0)
        drawn = pool.select("key", *[c.alias(f"by_{v}") for v, c in labels_of.items()]).where("by_text is not null or by_meta is not null")
        got, found = given.sample(drawn)
        for v, other in (("text", "meta"), ("meta", "text")):
            told = got[f"by_{other}"].to_pandas().to_numpy(float, na_value=np.nan) if len(got) else np.zeros(0)
            use = ~np.isnan(told)
            taught[v] = data[v].rows(~aside).plus(found[v].rows(use)), np.concatenate((y[~aside], told[use]))
    prior = math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum()))     # classes were drawn alike
    return combine(weights, {v: x.rows(aside) for v, x in data.items()}, y[aside], prior)


def score(docs: DataFrame, views: Views | None, *, text: str = "text", source: str | None = "source", lang: str | None = "lang",
          keep_from: float = 0.5, out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: calibrated probabilities ``p_text``
    and ``p_meta``, their combination ``score`` (weighted mean of log odds) and
    ``keep`` (score at least ``keep_from``).

    The whole text is read. A null, empty or blank text has no text view: it
    scores 0 and is not kept. Without views (no labels) every other document
    scores 0.5 and is kept. Null sources and languages are values of their own.
    Repeated rows get equal results; other columns pass through, an existing
    ``out`` is replaced.
    """
    need(docs, text, *[c for c in (source, lang) if c])
    docs = docs.drop(out)
    kind = "struct<p_text:double,p_meta:double,score:double>"
    body = F.col(f"`{text}`").cast("string")
    blank = ~F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    held, = fresh(docs, f"{out}_scored")
    if views is None:
        scored = docs.withColumn(held, F.struct(*[F.lit(0.5).alias(x) for x in ("p_text", "p_meta", "score")]))
    else:
        shipped = docs.sparkSession.sparkContext.broadcast(views)

        def probabilities(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            v = shipped.value
            for t, m in _log_odds(v.text, v.meta, batches):
                t, m = (x * c[0] + c[1] for x, c in ((t, v.text_curve), (m, v.meta_curve)))
                both = t * v.shares[0] + m * v.shares[1]
                yield pa.StructArray.from_arrays([pa.array(_sigmoid(x)) for x in (t, m, both)], ["p_text", "p_meta", "score"])

        probabilities.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        scored = docs.withColumn(held, F.arrow_udf(probabilities, kind)(body, F.array(*meta_features(text, source, lang))))
    total = F.when(blank, 0.0).otherwise(F.col(f"{held}.score"))
    return scored.withColumn(out, F.struct(
        F.when(blank, 0.0).otherwise(F.col(f"{held}.p_text")).alias("p_text"), F.col(f"{held}.p_meta").alias("p_meta"),
        total.alias("score"), (~blank & (total >= keep_from)).alias("keep"))).drop(held)
