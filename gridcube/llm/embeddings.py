"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Distinct vectors of a class (label and dimension) are dealt by hash into
shards; every shard builds a graph, every vector queries every shard of its
class with a beam that widens while it is full of links and until an audit
against brute force passes. Found pairs are verified in double precision, and
links are united to components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import need, stage
from gridcube.llm.components import connected_components
from gridcube.plans.strategy import join_small

#: Vectors in one graph, links of a vector in each layer (twice as many in the
#: lowest), beam while building, beam of the first search.
SHARD, LINKS, BUILD_BEAM, FIRST_BEAM = 8192, 12, 48, 32
#: Queries searched together, and candidates held for them at once.
TOGETHER, HELD = 256, 1 << 18
#: Sampled queries of a task that are audited, and the share of their links to find.
AUDITED, RECALL = 256, 0.99


def _select(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Neighbours for each row of candidates (sorted, best first, -1 for none):
    those closer to the node than to any neighbour chosen before, then the best
    of the rest."""
    rows, n = ids.shape
    x = vectors[np.maximum(ids, 0)]
    among = np.einsum("rid,rjd->rij", x, x)
    chosen = np.zeros((rows, n), bool)
    nearest = np.full((rows, n), -np.inf, np.float32)
    for j in range(n):
        take = (ids[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (chosen.sum(1) < most)
        chosen[:, j] = take
        nearest = np.where(take[:, None], np.maximum(nearest, among[:, j]), nearest)
    order = np.argsort(~chosen * (2 * n) + np.arange(n) + (ids < 0) * (4 * n), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """Layered graph over unit vectors; built and searched in batches."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.layers: list[np.ndarray] = []       # from the top; (vector, link), -1 for none
        n = len(vectors)
        # levels from a fixed generator: the same vectors give the same graph
        level = np.floor(-np.log(1 - np.random.default_rng(42).random(n)) / np.log(LINKS)).astype(int) if n else np.zeros(0, int)
        order = np.lexsort((np.arange(n), -level))
        self.entry = int(order[0]) if n else 0
        for layer in range(int(level.max(initial=0)), -1, -1):
            members = order[level[order] >= layer]
            self._build(members, LINKS * (2 if layer == 0 else 1))
        if n:
            self._connect()

    def _connect(self) -> None:
        """Gives every vector that pruning has cut off a link from the nearest
        one that can be reached: no beam finds it otherwise."""
        table = self.layers[-1]
        seen, edge = np.zeros(len(table), bool), np.array([self.entry])
        while len(edge):
            seen[edge] = True
            edge = np.unique(table[edge])
            edge = edge[(edge >= 0)]
            edge = edge[~seen[edge]]
        lost, there = np.flatnonzero(~seen), np.flatnonzero(seen)
        if not len(lost):
            return
        near = np.concatenate([there[(self.vectors[lost[k:k + TOGETHER]] @ self.vectors[there].T).argmax(1)]
                               for k in range(0, len(lost), TOGETHER)])
        by = np.argsort(near, kind="stable")
        near, lost = near[by], lost[by]
        first = np.searchsorted(near, near)
        extra = np.full((len(table), int((np.arange(len(near)) - first).max()) + 1), -1, np.int32)
        extra[near, np.arange(len(near)) - first] = lost
        self.layers[-1] = np.concatenate((table, extra), 1)

    def _build(self, members: np.ndarray, links: int) -> None:
        table = np.full((len(self.vectors), links), -1, np.int32)
        self.layers.append(table)
        done = 1
        while done < len(members):
            batch = members[done:done + min(TOGETHER, done)]
            q = self.vectors[batch]
            ids, sims = self._beam(q, self._descend(q, len(self.layers) - 1), table, BUILD_BEAM)
            near = q @ q.T                       # the batch does not see itself in the graph yet
            np.fill_diagonal(near, -np.inf)
            few = min(LINKS, len(batch) - 1)
            if few > 0:
                top = np.argpartition(-near, few - 1, axis=1)[:, :few]
                ids = np.concatenate((ids, batch[top].astype(np.int32)), 1)
                sims = np.concatenate((sims, np.take_along_axis(near, top, 1)), 1)
                best = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            table[batch] = _select(sims, ids, self.vectors, links)
            self._link_back(table, batch)
            done += len(batch)

    def _link_back(self, table: np.ndarray, batch: np.ndarray) -> None:
        """Each new vector also becomes a neighbour of its neighbours."""
        links = table.shape[1]
        source, target = np.repeat(batch, links), table[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(nodes), TOGETHER):
            part = slice(at, at + TOGETHER)
            wide = int(count[part].max())
            place = first[part][:, None] + np.arange(wide)
            new = np.where(np.arange(wide) < count[part][:, None], source[np.minimum(place, len(source) - 1)], -1)
            ids = np.concatenate((table[nodes[part]], new), 1)
            ids = np.sort(ids, 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1          # named from both sides
            sims = np.einsum("rid,rd->ri", self.vectors[np.maximum(ids, 0)], self.vectors[nodes[part]])
            sims[ids < 0] = -np.inf
            best = np.argsort(-sims, axis=1, kind="stable")[:, :links + 32]
            table[nodes[part]] = _select(np.take_along_axis(sims, best, 1), np.take_along_axis(ids, best, 1), self.vectors, links)

    def _descend(self, q: np.ndarray, layers: int) -> np.ndarray:
        at = np.full((len(q), 1), self.entry, np.int32)
        for table in self.layers[:layers]:
            at = self._beam(q, at, table, 4)[0][:, :1]
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best vectors reached from ``start`` by always expanding the best
        unexpanded ones of a beam: (ids, similarities), best first."""
        rows, lines = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((rows, len(self.vectors)), bool)
        ids = np.full((rows, width), -1, np.int32)
        sims = np.full((rows, width), -np.inf, np.float32)
        ids[:, :1], sims[:, 0] = start[:, :1], np.einsum("rd,rd->r", self.vectors[start[:, 0]], q)
        seen[lines, start[:, :1]] = True
        expanded = ids < 0
        several = max(1, min(4, width // 8))
        active = np.arange(rows)
        while len(active):
            i, s, e = ids[active], sims[active], expanded[active]
            pick = np.argsort(e, axis=1, kind="stable")[:, :several]         # the best that are not expanded
            fresh = ~np.take_along_axis(e, pick, 1)
            np.put_along_axis(e, pick, True, 1)
            nodes = np.where(fresh, np.take_along_axis(i, pick, 1), -1)
            near = np.where(nodes[:, :, None] >= 0, table[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
            own = active[:, None]
            near = np.where((near >= 0) & ~seen[own, np.maximum(near, 0)], near, -1)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            rr, cc = np.nonzero(near >= 0)
            seen[active[rr], near[rr, cc]] = True
            ns = np.full(near.shape, -np.inf, np.float32)
            ns[rr, cc] = np.einsum("nd,nd->n", self.vectors[near[rr, cc]], q[active[rr]])
            every, alls = np.concatenate((i, near), 1), np.concatenate((s, ns), 1)
            flags = np.concatenate((e, near < 0), 1)
            best = np.argsort(-alls, axis=1, kind="stable")[:, :width]
            ids[active], sims[active] = np.take_along_axis(every, best, 1), np.take_along_axis(alls, best, 1)
            expanded[active] = np.take_along_axis(flags, best, 1)
            active = active[~expanded[active].all(1)]
        return ids, sims

    def within(self, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, vector) of similarity at least ``least``; a beam that is full
        of them is doubled until it holds something farther."""
        waiting = [(np.arange(len(queries)), min(beam, max(1, len(self.vectors))))]
        while waiting:
            rows, width = waiting.pop()
            again = []
            for at in range(0, len(rows), max(1, min(TOGETHER, HELD // width))):
                part = rows[at:at + max(1, min(TOGETHER, HELD // width))]
                q = queries[part]
                ids, sims = self._beam(q, self._descend(q, len(self.layers) - 1), self.layers[-1], width)
                full = (sims[:, -1] >= least) & (width < len(self.vectors))
                again.append(part[full])
                r, c = np.nonzero((sims >= least) & ~full[:, None])
                yield part[r], ids[r, c]
            again = np.concatenate(again) if again else rows[:0]
            if len(again):
                waiting.append((again, min(2 * width, len(self.vectors))))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """(query, vector) -> whether a verified link was found, as one byte each
    (two shards at most), searched with ever wider beams until the audit of a
    sample of the queries against all vectors passes."""
    q32 = queries.astype(np.float32)
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    truth = np.zeros((len(sample), len(exact)), bool)
    for k, row in enumerate(sample):
        near = np.flatnonzero(graph.vectors @ q32[row] >= least - 1e-4)
        truth[k, near[exact[near] @ queries[row] >= least]] = True
    beam = FIRST_BEAM
    while True:
        out = np.zeros((len(queries), len(exact)), bool)
        for a, b in graph.within(q32, least - 1e-4, beam):
            out[a, b] = np.einsum("nd,nd->n", queries[a], exact[b]) >= least
        if (out[sample] & truth).sum() >= RECALL * truth.sum() or beam >= len(exact):
            return out
        beam *= 2


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(uid, uid) pairs that connect what the links between left and right
    (the same vectors, if it is one shard) connect, each vector reached once."""
    one = left is right
    new_a, new_b = np.ones(len(left), bool), np.ones(len(right), bool)
    if one:
        new_b = new_a
    out = []
    for root in np.flatnonzero(links.any(1)):
        if not new_a[root]:
            continue
        new_a[root] = False
        queue = [(0, root)]
        while queue:
            side, k = queue.pop()
            row, new, names = (links[k], new_b, right) if side == 0 or one else (links[:, k], new_a, left)
            reached = np.flatnonzero(row & new)
            new[reached] = False
            out += [(int(left[root]), int(u)) for u in names[reached]]
            queue += [(0 if one else 1 - side, r) for r in reached]
    return out


def _graph(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("uid")
    exact = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    graph = Graph(_unit(exact).astype(np.float32))
    blob = pickle.dumps((rows["uid"].to_numpy(), rows["copies"].to_numpy(), exact, graph), protocol=5)
    return pd.DataFrame({"label": [rows["label"].iloc[0]], "dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]],
                         "shards": [rows["shards"].iloc[0]], "blob": [blob]})


def _meet(least: float):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between two shards (or within one): for every vector the number
        of vectors linked, and a forest that connects what they connect."""
        sides = [pickle.loads(b) for b in rows.sort_values("shard")["blob"]]
        (uid_a, copies_a, exact_a, graph_a), (uid_b, copies_b, exact_b, graph_b) = sides[0], sides[-1]
        unit_a, unit_b = _unit(exact_a), _unit(exact_b)
        met = linked(graph_b, unit_b, unit_a, least)
        if len(sides) == 1:
            met |= met.T
            np.fill_diagonal(met, False)
            uid_b = uid_a
        else:
            met |= linked(graph_a, unit_a, unit_b, least).T
        counts = [(uid_a, np.array([copies_b[row].sum() for row in met]))]
        if len(sides) == 2:
            counts.append((uid_b, np.array([copies_a[row].sum() for row in met.T])))
        forest = np.array(_forest(met, uid_a, uid_b), np.int64).reshape(-1, 2)
        uid = np.concatenate([u[n > 0] for u, n in counts] + [forest[:, 1]])
        n = np.concatenate([n[n > 0] for _, n in counts] + [np.zeros(len(forest))]).astype(np.int64)
        to = pd.array(np.concatenate((np.zeros(len(uid) - len(forest), np.int64), forest[:, 0])), dtype="Int64")
        to[:len(uid) - len(forest)] = pd.NA
        return pd.DataFrame({"uid": uid, "n": n, "to": to})
    return links


def near_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    least: float = 0.93) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    Vectors with equal, non-null labels and equal lengths are linked when their
    cosine is at least ``least``; ``n_links`` counts the other vectors linked
    directly, the component is the smallest id reachable and ``kept`` marks it.

    Defined cases: a vector that is null, empty, zero or holds null or
    non-finite components, or whose label is null, links with nothing and is
    its own component; exact copies are searched once and all counted; repeated
    rows are vectors of their own; a null id takes the smallest non-null id of
    its component; an empty table gives an empty result. Other columns are not
    read. Pairs are missed at most as the audits allow (``RECALL``).
    """
    need(vectors, id_col, vector, label)
    v = F.col("embedding")
    usable = v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"),
                          F.col(f"`{label}`").alias("label")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    distinct = rows.where("usable").groupBy("label", "embedding").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    distinct = stage(distinct.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vectors")
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    dealt = join_small(distinct, sizes, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("uid"), F.col("shards")))
    columns = dealt.select("label", "dim", "shard", "shards", "uid", "copies", "embedding")
    kind = f"label {dict(dealt.dtypes)['label']}, dim int, shard bigint, shards bigint, blob binary"
    graphs = stage(columns.groupBy("label", "dim", "shard", "shards").applyInPandas(_graph, kind), "graphs")
    pairs = graphs.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1))) \
        .withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other"))
    found = stage(pairs.groupBy("label", "dim", "low", "high").applyInPandas(_meet(least), "uid bigint, n bigint, to bigint"), "vector-links")
    counted = found.where("to is null").groupBy("uid").agg(F.sum("n").alias("n"))
    linked = connected_components(found.where("to is not null").select(F.col("uid").alias("a"), F.col("to").alias("b"))) \
        .withColumnRenamed("node", "uid")
    rooted = distinct.join(linked, "uid", "left").join(counted, "uid", "left").withColumn("root", F.coalesce("component", "uid"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select(
        "label", "embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.where("usable").join(named, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
