"""Exact top-k search by inner product over cover trees of the data and of the queries.

Data are dealt to shards and queries to blocks. The tree of each shard and of each block is built once and stored as
flat arrays in the shared folder; then each pair of them meets in one task, which descends the two trees together. For
a query node (centre p, covering radius s) and a data node (centre c, radius r) no inner product exceeds
p.c + s|c| + r|p| + s r, so a pair whose bound lies below the worst kth score of the node's queries is left out whole.
Spark merges the shards' exact results.

Vectors are whole numbers (the floor of a scale times each component, held to 64 bits), so products are exact: in
doubles where no sum can pass 2^42, else from parts of 21 bits whose products are summed up as whole numbers. Scores
beyond 64 bits are held to them, and tie there.

Defined cases: an id names one vector: of rows that repeat it with different vectors the least counts; vectors that are
null, empty or hold null or non-finite components take no part; fewer candidates than k are all returned; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import blocked, for_each, matrix, merged, sharded, spread, usable

#: Points of a leaf, points whose products are taken at once, and rows of a shard.
LEAF, TAKEN, SHARD_ROWS = 64, 256, 4096
#: A node of queries that would fall into children of fewer points each, on average, stays one group: queries that far
#: apart share no useful bound, and bounds for each alone cost more than the products that they save.
THIN = 4
EXACT = float(1 << 42)
#: Slack of the bound for the rounding of radii, norms and products.
SLACK = 1e-9
PART = 21


class CoverTree:
    """Nodes over points in the order of their ids in `ids`: node i covers placed[low[i]:high[i]], all within radius[i]
    of its centre, and its children, nodes first[i] to first[i] + fan[i], have centres more than half its scale apart."""

    KEPT = {"placed": np.float64, "ids": np.int64, "centre": np.int64, "radius": np.float64, "low": np.int64, "high": np.int64, "first": np.int64, "fan": np.int64}

    def __init__(self, **arrays: np.ndarray):
        for name, kind in self.KEPT.items():
            setattr(self, name, np.asarray(arrays[name], kind))
        self.centres = self.placed[self.centre]
        self.norms = np.sqrt((self.centres**2).sum(1))
        self.leaf = self.fan == 0
        self.children = [np.arange(a, a + n) for a, n in zip(self.first.tolist(), self.fan.tolist())]
        self.slices = [slice(a, b) for a, b in zip(self.low.tolist(), self.high.tolist())]
        self.largest = float(np.abs(self.placed).max(initial=0))

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, thin: int = 1) -> CoverTree:
        apart_from = lambda c, rows: np.sqrt(((points[rows] - points[c]) ** 2).sum(1))
        centre, radius, low, high, first, fan = ([] for _ in range(6))

        def node(at: int, start: int, rows: np.ndarray, apart: np.ndarray) -> tuple:
            for column, value in zip((centre, radius, low, high, first, fan), (at, float(apart.max()), start, start + len(rows), 0, 0)):
                column.append(value)
            return len(centre) - 1, rows, apart

        members, final = np.arange(len(points)), np.empty(len(points), np.int64)
        waiting = [node(0, 0, members, apart_from(0, members))]
        while waiting:
            i, members, apart = waiting.pop()
            scale, at = radius[i], low[i]
            if len(members) <= LEAF or scale == 0:
                final[at : high[i]] = members
                continue
            near, parts, left = centre[i], [], members
            while len(left) and len(parts) * thin <= len(members):
                inside = apart <= scale / 2
                parts.append((near, left[inside], apart[inside]))
                left = left[~inside]
                if len(left):
                    near = int(left[0])
                    apart = apart_from(near, left)
            if len(parts) * thin > len(members):
                final[at : high[i]] = members
                continue
            first[i], fan[i] = len(centre), len(parts)
            for near, rows, apart in parts:
                waiting.append(node(near, at, rows, apart))
                at += len(rows)
        where = np.empty(len(points), np.int64)
        where[final] = np.arange(len(points))
        return cls(placed=points[final], ids=ids[final], centre=where[centre], radius=radius, low=low, high=high, first=first, fan=fan)

    def row(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in self.KEPT}

    @classmethod
    def of_row(cls, row: dict) -> CoverTree:
        arrays = {name: np.frombuffer(row[name], kind) for name, kind in cls.KEPT.items()}
        return cls(**arrays | {"placed": arrays["placed"].reshape(-1, row["dim"])})


def products(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held to 64 bits."""
    parts = []
    for m in (y, x):
        high = np.floor(m / 2.0 ** (2 * PART))
        rest = m - high * 2.0 ** (2 * PART)
        middle = np.floor(rest / 2.0**PART)
        parts.append((rest - middle * 2.0**PART, middle, high))
    total: np.ndarray | int = 0
    for at in range(0, y.shape[1], 1 << 11):  # no sum of products of two parts passes 2^53
        columns = slice(at, at + (1 << 11))
        for i, a in enumerate(parts[0]):
            for j, b in enumerate(parts[1]):
                total = total + np.rint(a[:, columns] @ b[:, columns].T).astype(np.int64).astype(object) * (1 << PART * (i + j))
    return np.minimum(np.maximum(total, -(1 << 63)), (1 << 63) - 1)


def dual_search(data: CoverTree, queries: CoverTree, k: int, seen: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k highest inner products; a query's own id is no candidate. The number of
    products taken is added to seen."""
    n, ids, asked = len(queries.ids), data.ids, queries.ids
    small = data.largest * queries.largest * data.placed.shape[1] < EXACT
    by_id = np.argsort(ids, kind="stable")
    turns = np.empty(len(by_id), np.int64)
    turns[by_id] = np.arange(len(by_id))
    span = 1 << 20  # more than a shard's rows: score and id in one number, so that ties go to the smaller id
    none = int(np.iinfo(np.int64).min) if small else -(1 << 90)
    best = np.full((n, k), none, np.int64 if small else object)  # ascending in each row

    def bounds(q: np.ndarray | int, d: np.ndarray | int) -> np.ndarray:
        flat = (queries.centres[q] * data.centres[d]).sum(-1)
        s, r, p, c = queries.radius[q], data.radius[d], queries.norms[q], data.norms[d]
        return np.maximum(flat + (s * c + r * p + s * r) * (1 + SLACK) + SLACK * (p * c + 1), -(2.0**63))

    def hopeless(bound: np.ndarray | float, q: int) -> np.ndarray | bool:
        worst = best[queries.slices[q], 0].min()
        return bound < float(worst // span) if worst != none else bound != bound

    def take(q: int, at: np.ndarray) -> None:
        """The products of q's queries with the points at these places."""
        mine = queries.slices[q]
        y, x = queries.placed[mine], data.placed[at]
        if seen is not None:
            seen[0] += len(y) * len(x)
        score = np.rint(y @ x.T).astype(np.int64) if small else products(y, x)
        key = score * span + (span - 1 - turns[at])
        key[asked[mine, None] == ids[None, at]] = none
        both = np.concatenate([best[mine], key], 1)
        best[mine] = np.sort(np.partition(both, both.shape[1] - k, 1)[:, -k:] if small else both, 1)[:, -k:]

    def take_leaves(q: int, leaves: np.ndarray, bound: np.ndarray) -> None:
        """Leaves by falling bound, some at a time, while any can still help."""
        order = np.argsort(-bound, kind="stable")
        sizes = np.cumsum([data.high[d] - data.low[d] for d in leaves[order]])
        first = 0
        while first < len(order) and not hopeless(bound[order[first]], q):
            last = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + TAKEN)) + 1
            take(q, np.concatenate([np.arange(data.low[d], data.high[d]) for d in leaves[order[first:last]]]))
            first = last

    pairs = [(float(bounds(0, 0)), 0, 0)]
    while pairs:
        bound, q, d = pairs.pop()
        if hopeless(bound, q):
            continue
        if data.leaf[d] and queries.leaf[q]:
            take_leaves(q, np.array([d]), np.array([bound]))
            continue
        below = data.children[d]
        if queries.leaf[q] or (not data.leaf[d] and data.radius[d] >= queries.radius[q] and not data.leaf[below].any()):
            found = bounds(q, below)
            keep = ~hopeless(found, q)
            ends = keep & data.leaf[below] & queries.leaf[q]
            if ends.any():
                take_leaves(q, below[ends], found[ends])
            keep &= ~ends
            new = [(float(b), q, int(x)) for b, x in zip(found[keep], below[keep])]
        else:
            nodes = queries.children[q]
            new = [(float(b), int(x), d) for b, x in zip(bounds(nodes, d), nodes)]
        pairs += sorted(new)  # the most promising pair is taken next
    rows, columns = np.nonzero(best != none)
    keys = best[rows, columns]
    winners = ids[by_id[(span - 1 - keys % span).astype(np.int64)]]
    return list(zip(asked[rows].tolist(), winners.tolist(), (keys // span).tolist()))


TREE = "shard int, dim int, " + ", ".join(f"{name} binary" for name in CoverTree.KEPT)


def build_trees(rows: DataFrame, shards: int, thin: int = 1) -> DataFrame:
    """One row per shard and length of rows (shard, dim, id, vector): the tree as flat arrays."""

    def build(group: pa.Table) -> pa.Table:
        tree = CoverTree.build(matrix(group), group.column("id").to_numpy(), thin)
        row = {"shard": group.column("shard")[0].as_py(), "dim": group.column("dim")[0].as_py()} | tree.row()
        return pa.table({c: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for c, v in row.items()})

    return materialize(spread(rows, shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(build, TREE))


def top_inner_products(vectors: DataFrame, k: int, query_step: int, scale: int = 64, id_column: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) for every row whose id is
    divisible by query_step, against all rows of vectors."""
    rows = usable(vectors, id_column, column, zero=True)
    rows, shards = sharded(materialize(rows.withColumn("vector", F.transform("vector", lambda x: F.floor(scale * x).cast("double")))), shard_rows)
    queries, blocks = blocked(rows.drop("shard").filter(F.col("id") % query_step == 0))

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if shard.num_rows and block.num_rows:
            found = dual_search(*(CoverTree.of_row(side.to_pylist()[0]) for side in (shard, block)), k)
        columns = zip(*found) if found else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    trees = for_each(build_trees(rows, shards), "block", blocks)
    asked = for_each(build_trees(queries.withColumnRenamed("block", "shard"), blocks, THIN).withColumnRenamed("shard", "block"), "shard", shards)
    keys = ("shard", "block", "dim")
    trees, asked = (spread(x, shards * blocks, *keys) for x in (trees, asked))
    found = trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    return merged(found, k, best_first=True)
