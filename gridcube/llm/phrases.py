"""Phrase collocations from a weighted de Bruijn graph of word triples.

Nodes are word pairs, edges are triples, weighted by how often they occur. Only
edges are counted in the texts, with the ends of pieces as edges to an end mark;
every shorter count follows: a pair occurs as often as its out-edges and its
piece ends together, a word as often as the pairs it starts and the pieces it
ends. Unary paths of frequent edges are compacted into passages, from which the
phrases and what they lie in are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcube.llm.common import cut, need, stage, utf8

#: Distinct edges that a task counts before it hands them on (some 160 MB).
EDGES_AT_ONCE = 1_000_000
#: Counts of tasks that are summed at once: so many rows or bytes.
ROWS_AT_ONCE, BYTES_REDUCED = 100_000, 16 << 20
#: Bytes of a text split at once, ended at the next piece end.
BYTES_AT_ONCE = 1 << 20
#: A node with this share of a sample's edges or more is hot; there are at most
#: 1 / HOT_SHARE of them. Its edges are dealt to SALTS tasks by their last word.
#: The sample only decides on the dealing, never on a count.
SAMPLE, HOT_SHARE, SALTS = 64, 1e-3, 32
#: Edges of a passage in one row; longer passages are cut.
PASSAGE_EDGES = 4_096

END = b"."
_FOLD = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_COUNTED = pa.schema([("edge", pa.string()), ("n", pa.int64())])


def edges_of(text: bytes) -> list[bytes]:
    """The edges of a text, each ``x y z``: three words in a row, two and the
    end mark where a piece ends, or a piece's only word between two end marks.
    No word holds the mark, a blank or a tab."""
    out: list[bytes] = []
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        stop = text.find(END, at + BYTES_AT_ONCE)
        stop = len(text) if stop < 0 else stop + 1
        words = text[at:stop].replace(END, b" . ").split()
        at = stop
        if not words:
            continue
        words = [END, *words, END]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        line = np.frombuffer(joined := b" ".join(words), np.uint8)
        mark = (sizes == 1) & (line[starts] == END[0])
        x, y, z = mark[:-2], mark[1:-1], mark[2:]
        take = np.flatnonzero(~y & (~x | z))
        out += [joined[s:e] for s, e in zip(starts[take].tolist(), ends[take + 2].tolist())]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges counted within the task, handed on whenever they are many."""
    counts: defaultdict[str, Counter] = defaultdict(Counter)

    def hand_on():
        for lang, found in counts.items():
            own = b" " + lang.encode()
            edges, many = [edge + own for edge in found], list(found.values())
            for s in range(0, len(edges), 100_000):
                yield pa.record_batch([pa.array(edges[s:s + 100_000], pa.binary()).cast(pa.string()),
                                       pa.array(many[s:s + 100_000], pa.int64())], schema=_COUNTED)
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            if text:
                counts[lang].update(edges_of(text))
                if sum(map(len, counts.values())) > EDGES_AT_ONCE:
                    yield from hand_on()
    yield from hand_on()


def _counted(docs: DataFrame) -> DataFrame:
    """(edge, n): edges ``x y z lang`` with the counts of single tasks."""
    return docs.mapInArrow(_count, "edge string, n bigint")


def _node(edge: Column) -> Column:
    return F.substring_index(edge, " ", 2)


def _last(edge: Column) -> Column:
    return F.split_part(edge, F.lit(" "), F.lit(3))


def _hot_nodes(docs: DataFrame) -> list[str]:
    """Nodes that hold a large share of a sample of the texts; see HOT_SHARE."""
    sample = _counted(docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0))
    nodes = stage(sample.groupBy(_node(F.col("edge")).alias("node")).agg(F.sum("n").alias("n")), "sampled-nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return [r.node for r in nodes.where(F.col("n") >= total * HOT_SHARE).select("node").collect()]


_FOUND = pa.schema([("lang", pa.string()), ("x", pa.string()), ("y", pa.string()), ("z", pa.string()), ("n", pa.int64())])


def _runs(names: pa.Array) -> np.ndarray:
    """Where runs of equal values start."""
    changed = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate(([True], changed)))


def _rows(parts: list, n: np.ndarray) -> pa.RecordBatch:
    """Counts of words, pairs or triples: language and one to three words."""
    none = pa.nulls(len(n), pa.string())
    return pa.record_batch([*parts, *[none] * (4 - len(parts)), pa.array(n, pa.int64())], schema=_FOUND)


def _grouped(names: dict[str, pa.Array], sums: dict[str, np.ndarray]) -> pa.Table:
    """Sums by names, in order of appearance."""
    table = pa.table({**names, **sums}).group_by(list(names), use_threads=False).aggregate([(c, "sum") for c in sums])
    return table.rename_columns([*names, *sums]).combine_chunks()


def _counts_of(nodes: pa.Table, least: int, hot: pa.Array) -> Iterator[pa.RecordBatch]:
    """What whole ``node, lang, n, ended`` rows count for: a node's first word
    by flow, its last by piece ends, and itself where frequent or hot."""
    lang, n, ended = nodes["lang"].combine_chunks(), nodes["n"].to_numpy(), nodes["ended"].to_numpy()
    parts = pc.split_pattern(nodes["node"].combine_chunks(), " ").flatten()
    x, y = (parts.take(pa.array(np.arange(k, len(parts), 2))) for k in range(2))
    word = pc.not_equal(x, ".").to_numpy(zero_copy_only=False)
    often = (n >= least) | pc.is_in(nodes["node"], hot).to_numpy()
    for at, name, many in ((np.flatnonzero(word), x, n), (np.flatnonzero(ended), y, ended)):
        at_rows = pa.array(at)
        found = _grouped({"lang": lang.take(at_rows), "name": name.take(at_rows)}, {"n": many[at]})
        yield _rows([found["lang"].combine_chunks(), found["name"].combine_chunks()], found["n"].to_numpy())
    keep = np.flatnonzero(word & often)
    yield _rows([c.take(pa.array(keep)) for c in (lang, x, y)], n[keep])


_EDGES = pa.schema([("edge", pa.string()), ("node", pa.string()), ("n", pa.int64())])
_NODES = pa.schema([("node", pa.string()), ("lang", pa.string()), ("n", pa.int64()), ("ended", pa.int64())])


def _reduce(least: int, hot_nodes: list[str]):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of ``edge, node, n`` rows in order of edges. Between batches
        only the last edge and the last node wait, as sums."""
        hot = pa.array(hot_nodes, pa.string())
        last_edge, last_node = _EDGES.empty_table(), _NODES.empty_table()

        def reduced(rows: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal last_edge, last_node
            edge, node = rows["edge"].combine_chunks(), rows["node"].combine_chunks()
            starts = _runs(edge)
            n = np.add.reduceat(rows["n"].to_numpy(), starts)
            edge, node = edge.take(pa.array(starts)), node.take(pa.array(starts))
            if not whole:
                last_edge = pa.table([edge.slice(len(n) - 1), node.slice(len(n) - 1), n[-1:]], schema=_EDGES)
                edge, node, n = edge.slice(0, len(n) - 1), node.slice(0, len(n) - 1), n[:-1]
            end = pc.match_substring(edge, " . ").to_numpy(zero_copy_only=False)
            often = np.flatnonzero(~end & (n >= least))
            if len(often):
                x, y, z, lang = (pc.split_pattern(edge.take(pa.array(often)), " ").flatten().take(
                    pa.array(np.arange(k, 4 * len(often), 4))) for k in range(4))
                yield _rows([lang, x, y, z], n[often])
            lang = pc.split_pattern(edge, " ", max_splits=1, reverse=True).flatten()
            lang = lang.take(pa.array(np.arange(1, len(lang), 2)))
            nodes = pa.concat_tables([last_node, pa.table([node, lang, n, np.where(end, n, 0)], schema=_NODES)]).combine_chunks()
            if not len(nodes):
                return
            nodes = _grouped({c: nodes[c] for c in ("node", "lang")}, {c: nodes[c] for c in ("n", "ended")})
            if not whole:
                waits = pc.equal(nodes["node"], nodes["node"][-1])
                last_node, nodes = nodes.filter(waits), nodes.filter(pc.invert(waits))
            if len(nodes):
                yield from _counts_of(nodes, least, hot)

        waiting, rows, size = [], 0, 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]).cast(_EDGES))
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= ROWS_AT_ONCE or size >= BYTES_REDUCED:
                yield from reduced(pa.concat_tables([last_edge, *waiting]).combine_chunks(), False)
                waiting, rows, size = [], 0, 0
        if rows or last_edge.num_rows:
            yield from reduced(pa.concat_tables([last_edge, *waiting]).combine_chunks(), True)
    return reduce


class Graph(NamedTuple):
    """Exact counts: ``words(lang, x, n)`` of every word, ``nodes(lang, x, y,
    n)`` and ``edges(lang, x, y, z, n)`` of the frequent pairs and triples."""

    words: DataFrame
    nodes: DataFrame
    edges: DataFrame


def build_graph(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10) -> Graph:
    """The graph of all texts, with pairs and triples that occur ``least`` times.

    Edges are counted in the task, then in one shuffle that deals them by node
    (hot nodes by last word as well) and sorts them, so that an edge's count, and
    that of a node that is not hot, is complete in its task. Rare nodes leave it only
    as their share of the counts of their words.
    """
    need(docs, text, lang)
    code = F.url_encode(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")))  # without blanks
    docs = docs.select(code.alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    hot, edge = _hot_nodes(docs), F.col("edge")
    salt = F.when(_node(edge).isin(hot), F.pmod(F.xxhash64(_last(edge)), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    dealt = _counted(docs).repartition(_node(edge), salt).sortWithinPartitions("edge")
    found = dealt.select("edge", _node(edge).alias("node"), "n").mapInArrow(
        _reduce(least, hot), "lang string, x string, y string, z string, n bigint")
    counts = stage(found.groupBy("lang", "x", "y", "z").agg(F.sum("n").alias("n"))
                   .withColumn("lang", F.url_decode("lang")), "phrase-counts")
    often = counts.where(F.col("n") >= least)
    return Graph(counts.where("y IS NULL").select("lang", "x", "n"),
                 often.where("y IS NOT NULL AND z IS NULL").select("lang", "x", "y", "n"), often.where("z IS NOT NULL"))


def passages(edges: DataFrame) -> DataFrame:
    """(lang, words, counts): the frequent ``edges(lang, x, y, z, n)`` with unary
    paths compacted; ``counts[i]`` belongs to the three words from ``words[i]``.

    An edge goes on in the next one where the node between them has no other
    frequent edge in or out. Pointers to the edge before are followed in
    doubling steps to the path's first edge. Each round the open edge nearest to
    a first edge arrives, so a round without arrivals leaves circles only; their
    edges stay passages of their own.
    """
    into = edges.groupBy("lang", F.col("y").alias("x"), F.col("z").alias("y")).agg(F.count("*").alias("ins"), F.max("x").alias("w"))
    outs = edges.groupBy("lang", "x", "y").agg(F.count("*").alias("outs"))
    unary = into.join(outs, ["lang", "x", "y"]).where("ins = 1 AND outs = 1").select("lang", "x", "y", "w")
    name = F.concat_ws(" ", "x", "y", "z")
    all_edges = cut(edges.join(unary, ["lang", "x", "y"], "left").select(
        "lang", name.alias("edge"), "x", "y", "z", "n", F.concat_ws(" ", F.col("w"), "x", "y").alias("before"), F.col("w").isNotNull().alias("goes_on")))
    now = cut(all_edges.select("lang", "edge", F.when(F.col("goes_on"), F.col("before")).otherwise(F.col("edge")).alias("to"),
                               F.col("goes_on").cast("bigint").alias("rank"), (~F.col("goes_on")).alias("there")))
    left = None
    while (many := now.where("not there").count()) and many != left:
        left = many
        via = now.select(F.col("lang").alias("l"), F.col("edge").alias("via"), F.col("to").alias("next"),
                         F.col("rank").alias("more"), F.col("there").alias("arrives"))
        open_ = now.where("not there")
        now = cut(now.where("there").unionByName(open_.join(via, (F.col("lang") == F.col("l")) & (F.col("to") == F.col("via"))).select(
            "lang", "edge", F.col("next").alias("to"), (F.col("rank") + F.col("more")).alias("rank"), F.col("arrives").alias("there"))))
    first, rank = (F.when(F.col("there"), F.col(c)).otherwise(o) for c, o in (("to", F.col("edge")), ("rank", F.lit(0))))
    rows = all_edges.join(now.select("lang", "edge", first.alias("to"), rank.alias("rank")), ["lang", "edge"])
    path = rows.groupBy("lang", "to", F.floor(F.col("rank") / PASSAGE_EDGES).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "x", "y", "z", "n"))).alias("e"))
    words = F.concat(F.array(F.get("e.x", F.lit(0)), F.get("e.y", F.lit(0))), F.col("e.z"))
    return path.select("lang", words.alias("words"), F.col("e.n").alias("counts"))


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) without rounding: 38 digits hold the
    products of counts up to 10 ** 15."""
    wide = [c.cast("decimal(19,0)") for c in (a, l, r)]
    product = lambda p, q: (p * q).cast("decimal(38,0)")
    top = (product(wide[0], wide[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, product(wide[1], wide[2])).cast("bigint")


def candidates(graph: Graph, found: DataFrame, *, least: int = 10, share: tuple[int, int] = (1, 2)) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every frequent pair and triple, but for
    pairs inside a frequent triple that has ``share`` of their count."""
    uses = found.select("lang", F.explode(F.transform(F.sequence(F.lit(0), F.size("counts")), lambda i: F.struct(
        F.get("words", i).alias("x"), F.get("words", i + 1).alias("y"),
        F.greatest(F.when(i > 0, F.get("counts", i - 1)), F.get("counts", i)).alias("most")))).alias("u"))
    inside = uses.select("lang", "u.*").groupBy("lang", "x", "y").agg(F.max("most").alias("most"))
    triples = found.select("lang", F.explode(F.transform("counts", lambda n, i: F.struct(
        F.get("words", i).alias("x"), F.get("words", i + 1).alias("y"), F.get("words", i + 2).alias("z"), n.alias("a")))).alias("t")).select("lang", "t.*")
    often = graph.words.where(F.col("n") >= least)  # as are the parts of whatever is frequent
    word = lambda name, n: often.select("lang", F.col("x").alias(name), F.col("n").alias(n))
    pair = lambda p, q, n: graph.nodes.select("lang", F.col("x").alias(p), F.col("y").alias(q), F.col("n").alias(n))
    free = graph.nodes.withColumnRenamed("n", "a").join(inside, ["lang", "x", "y"], "left") \
        .where(F.coalesce(F.col("most"), F.lit(0)) * share[1] < F.col("a") * share[0])
    pairs = free.join(word("x", "l"), ["lang", "x"]).join(word("y", "r"), ["lang", "y"]) \
        .select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    cuts = (triples.join(pair("x", "y", "xy"), ["lang", "x", "y"]).join(pair("y", "z", "yz"), ["lang", "y", "z"])
            .join(word("x", "fx"), ["lang", "x"]).join(word("z", "fz"), ["lang", "z"]))
    low = F.least(*[F.struct(score(F.col("a"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
                    for k, l, r in ((1, "fx", "yz"), (2, "xy", "fz"))])
    longer = cuts.withColumn("low", low).select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", "low.l", "low.r", "low.score")
    return pairs.unionByName(longer)


def top_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, first: int = 2000,
                share: tuple[int, int] = (1, 2)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases
    of two or three words by score, count, then phrase in byte order.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line
    ends, and into words at blanks and tabs. A phrase occurs ``least`` times
    (``a``) within pieces; ``l`` and ``r`` count the parts of the cut with the
    lowest score floor(1000000 a a / (l r)), ties to the earlier cut; ``n`` counts
    the words of the language. A pair is left out where a frequent triple that
    holds it has ``share`` of its count.

    Defined cases: a null or empty text has no words; a null language counts as
    ``und``; repeated rows count each; an empty table gives an empty result;
    other columns are ignored. A language is ranked in SALTS parts first, so no
    task sorts all its phrases.
    """
    graph = build_graph(docs, text=text, lang=lang, least=least)
    scored = stage(candidates(graph, passages(graph.edges), least=least, share=share), "phrase-scores")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)
    total = graph.words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
