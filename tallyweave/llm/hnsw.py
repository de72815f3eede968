"""Approximate nearest neighbours by Euclidean distance.

Rows are dealt to shards by a hash of their id; each shard's task builds a hierarchical navigable small-world graph of
its distinct vectors and stores it as flat neighbour arrays in the shared folder. Queries, in blocks, visit every
shard, and Spark merges the shards' results. Scores are computed from the original vectors in double precision.

Equal vectors are one node with all its ids, so no number of copies breaks a graph or hides an id. An id names one
vector: of rows that repeat it with different vectors the least counts.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; fewer
candidates than k are all returned; ties go to the smaller id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import blocked, for_each, matrix, merged, sharded, spread, usable

#: Links of a node (twice as many on the ground layer), breadth of the search while building and asking, rows a shard.
LINKS, BUILD, ASK, SHARD_ROWS = 12, 60, 100, 8192


class Graph:
    """points (n x d); ground (n x 2*LINKS) and, for each higher layer, its nodes and their links, -1 where none."""

    def __init__(self, points: np.ndarray, ground: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.points, self.ground, self.layers = points, ground, layers
        self.row = [{int(v): i for i, v in enumerate(nodes)} for nodes, _ in layers]
        self.mark, self.turn = np.zeros(len(points), np.int64), 0

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 1) -> Graph:
        n = len(points)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
        layers = [(np.flatnonzero(levels >= h), np.full((int((levels >= h).sum()), LINKS), -1, np.int32)) for h in range(1, levels.max() + 1)]
        graph = cls(points, np.full((n, 2 * LINKS), -1, np.int32), layers)
        top, entry = int(levels[0]), 0
        for v in range(1, n):
            height, near = int(levels[v]), [(graph._distance(points[v], entry), entry)]
            for h in range(top, height, -1):
                near = graph._search(points[v], near, 1, h)
            for h in range(min(top, height), -1, -1):
                near = graph._search(points[v], near, BUILD, h)
                chosen = graph._diverse(near, LINKS)
                graph._links(v, h)[: len(chosen)] = chosen
                for u in chosen:
                    graph._link(u, v, h)
            if height > top:
                top, entry = height, v
        graph.entry = entry
        return graph

    def _links(self, v: int, h: int) -> np.ndarray:
        return self.ground[v] if h == 0 else self.layers[h - 1][1][self.row[h - 1][v]]

    def _distance(self, q: np.ndarray, v: int) -> float:
        return float(((self.points[v] - q) ** 2).sum())

    def _diverse(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """Nearest first, each nearer to the new point than to any chosen before it; then the nearest of the rest."""
        ids = [v for _, v in near]
        if len(ids) <= m:
            return ids
        x = self.points[ids]
        squares = (x * x).sum(1)
        apart = squares[:, None] + squares - 2 * x @ x.T
        chosen: list[int] = []
        spare: list[int] = []
        closest = np.full(len(ids), np.inf)
        for i, (d, _) in enumerate(near):
            if len(chosen) == m:
                break
            if d < closest[i]:
                chosen.append(i)
                np.minimum(closest, apart[i], out=closest)
            else:
                spare.append(i)
        return [ids[i] for i in (chosen + spare)[:m]]

    def _link(self, u: int, v: int, h: int) -> None:
        links = self._links(u, h)
        free = np.flatnonzero(links < 0)
        if len(free):
            links[free[0]] = v
            return
        ids = np.append(links, v)
        d = ((self.points[ids] - self.points[u]) ** 2).sum(1)
        order = np.argsort(d, kind="stable")
        chosen = self._diverse([(float(d[i]), int(ids[i])) for i in order], len(links))
        links[: len(chosen)] = chosen

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], breadth: int, h: int) -> list[tuple[float, int]]:
        """The `breadth` nearest nodes found on layer h from start, nearest first."""
        self.turn += 1
        mark, turn = self.mark, self.turn
        mark[[v for _, v in start]] = turn
        open_, kept = list(start), [(-d, v) for d, v in start]
        heapq.heapify(open_)
        heapq.heapify(kept)
        while len(kept) > breadth:
            heapq.heappop(kept)
        while open_:
            d, v = heapq.heappop(open_)
            if len(kept) >= breadth and d > -kept[0][0]:
                break
            near = self._links(v, h)
            near = near[near >= 0]
            near = near[mark[near] != turn]
            if not len(near):
                continue
            mark[near] = turn
            apart = self.points[near] - q
            for d, u in zip(np.einsum("ij,ij->i", apart, apart).tolist(), near.tolist()):
                if len(kept) < breadth:
                    heapq.heappush(kept, (-d, u))
                elif d < -kept[0][0]:
                    heapq.heapreplace(kept, (-d, u))
                else:
                    continue
                heapq.heappush(open_, (d, u))
        return sorted((-d, v) for d, v in kept)

    def nearest(self, q: np.ndarray, breadth: int) -> list[tuple[float, int]]:
        near = [(self._distance(q, self.entry), self.entry)]
        for h in range(len(self.layers), 0, -1):
            if self.entry in self.row[h - 1]:
                near = self._search(q, near, 1, h)
        return self._search(q, near, breadth, 0)


INDEX = "shard int, dim int, entry int, points binary, ids binary, ends binary, ground binary, nodes binary, links binary, heights binary"


def _build_shard(rows: pa.Table) -> pa.Table:
    x, ids = matrix(rows), rows.column("id").to_numpy()
    points, node = np.unique(x, axis=0, return_inverse=True)
    mixed = np.random.default_rng(0).permutation(len(points))  # np.unique sorts; graphs want a random order
    place = np.empty_like(mixed)
    place[mixed] = np.arange(len(mixed))
    points, node = points[mixed], place[node.ravel()]
    pairs = np.unique(np.stack([node, ids], 1), axis=0)
    graph = Graph.build(points)
    nodes = [v for v, _ in graph.layers]
    row = {
        "shard": rows.column("shard")[0].as_py(), "dim": x.shape[1], "entry": int(graph.entry), "points": points.tobytes(),
        "ids": pairs[:, 1].astype(np.int64).tobytes(), "ends": np.cumsum(np.bincount(pairs[:, 0], minlength=len(points))).tobytes(),
        "ground": graph.ground.tobytes(), "nodes": b"".join(v.astype(np.int32).tobytes() for v in nodes),
        "links": b"".join(links.tobytes() for _, links in graph.layers), "heights": np.array([len(v) for v in nodes], np.int32).tobytes(),
    }
    kinds = {"shard": pa.int32(), "dim": pa.int32(), "entry": pa.int32()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """One row per shard and length of rows (shard, dim, id, vector): the graph as flat arrays."""
    return materialize(spread(rows, shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(_build_shard, INDEX))


def _load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    points = np.frombuffer(row["points"]).reshape(-1, row["dim"])
    layers, at = [], 0
    nodes, links = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["links"], np.int32).reshape(-1, LINKS)
    for n in np.frombuffer(row["heights"], np.int32):
        layers.append((nodes[at : at + n], links[at : at + n]))
        at += n
    graph = Graph(points, np.frombuffer(row["ground"], np.int32).reshape(-1, 2 * LINKS), layers)
    graph.entry = row["entry"]
    return graph, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int, breadth: int = ASK) -> DataFrame:
    """query_id, rank, vec_id, score for queries (id, vector, dim) against all shards of index; a query's own id is
    no candidate."""

    def ask(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if shard.num_rows and block.num_rows:
            graph, ids, ends = _load(shard.to_pylist()[0])
            for query, q in zip(block.column("id").to_pylist(), matrix(block)):
                found: list[tuple[float, int]] = []
                # nodes at equal distance share a rank; ids of a node are in order, so k + 1 of them are enough
                for _, v in graph.nearest(q, max(breadth, k + 1)):
                    score = float(np.sqrt(((q - graph.points[v]) ** 2).sum()))
                    found += [(score, i) for i in ids[ends[v - 1] if v else 0 : ends[v]][: k + 1].tolist() if i != query]
                for score, i in heapq.nsmallest(k, found):
                    for column, value in zip(out, (query, i, score)):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    asked, blocks = blocked(queries)
    keys = ("shard", "block", "dim")
    kept, asked = (spread(x, shards * blocks, *keys) for x in (for_each(index, "block", blocks), for_each(asked, "shard", shards)))
    found = kept.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(ask, "query_id long, vec_id long, score double")
    return merged(found, k, best_first=False)


def nearest_neighbours(vectors: DataFrame, k: int, query_step: int, id_column: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest found for every row whose id is divisible by query_step, against all rows of vectors."""
    rows, shards = sharded(materialize(usable(vectors, id_column, column, zero=False)), shard_rows)
    index = build_index(rows, shards)
    queries = rows.drop("shard").filter(F.col("id") % query_step == 0)
    return search_index(index, shards, queries, k)

