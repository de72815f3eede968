"""Near-duplicate documents by b-bit MinHash.

Each distinct set of word shingles gets minima of many hash functions. Bands of full minima deal sets to buckets;
beside them travels the packed signature of each minimum's low bits, whose agreeing places tell which pairs may pass.
A bucket proposes not all its pairs but the strongest spanning forest of those that may pass, and proposals are
confirmed on the full sets.
Every pair that may pass lies in one tree of some forest; where confirmed links leave a tree in several components,
the documents between those are compared on their full sets within tasks, which give only links that join components.
Equal sets are one node from the start.

Large buckets and trees are cut into blocks that meet pairwise in different tasks, so none is ever held by one.

The bands and the cut of agreeing places follow from the similarity asked for: a pair at the threshold meets in no
band, or agrees in fewer places than the cut, with a probability of at most MISS each. The sum of both is 9.5e-9 at
0.85 (28 bands of 4, 73 of 112 places) and 1.1e-8 at 0.8 (36 bands of 4, 88 of 144 places).

A shingle stands as a 64-bit hash in the full sets that confirm a link: two different shingles of a pair of n in all
are taken for one with a probability of about n^2 / 2^65, some 1e-11 for texts of 20,000 words.

Defined cases: a null or empty text has no shingles and is linked with nothing; a text of fewer words than a shingle
is one shingle; equal rows are copies; rows with equal id and different text are separate documents; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hmm import split_words

#: Low bits of a minimum in the signature, and the probability with which the bands, and likewise the cut, may miss a
#: pair at the threshold.
BITS, MISS = 4, 1e-8
#: Words remembered by a task, rows of a bucket's block, and tasks that share a hub's neighbours.
REMEMBERED, BLOCK, SALTS = 200_000, 512, 8

MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray, turn: int = 0) -> np.ndarray:
    h = h * MIX[turn % 3]
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Shape:
    """bands of `band` minima each, and the agreeing places from which a pair is confirmed on its full sets."""

    bands: int
    band: int
    least: int

    @property
    def hashes(self) -> int:
        return self.bands * self.band


@cache
def shape_of(similarity: float) -> Shape:
    """The fewest bands, and for them the highest cut, that each miss a pair of this similarity with at most MISS."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    band = 4 if similarity >= 0.75 else 3 if similarity >= 0.5 else 2 if similarity >= 0.25 else 1
    unmet = -similarity**band
    bands = 1 if unmet == -1 else math.ceil(math.log(MISS) / math.log1p(unmet))
    while bands * band * BITS % 64:  # signatures are read as whole 64-bit words
        bands += 1
    least = 0
    while least < bands * band and tail(bands * band, similarity, least + 1) <= MISS:
        least += 1
    return Shape(bands, band, least)


def tail(hashes: int, similarity: float, least: int) -> float:
    """The probability that a pair agrees in fewer than `least` places."""
    agree = similarity + (1 - similarity) * 2.0**-BITS
    return math.fsum(math.comb(hashes, i) * agree**i * (1 - agree) ** (hashes - i) for i in range(least))


@cache
def _odd(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20).integers(0, 1 << 32, (2, hashes), np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


class Sketcher:
    """Shingle sets and their minima; remembers the hashes of words it has met."""

    def __init__(self, shingle: int, shape: Shape | None = None):
        self.shingle, self.shape = shingle, shape
        self.words: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self.words) < REMEMBERED:
            self.words[word] = value
        return value

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles of text as sorted 64-bit hashes."""
        words = split_words(text or "")
        known = self.words
        h = np.fromiter([known.get(w) or self._hash(w) for w in words], np.uint64, len(words))
        if not len(h):
            return h
        size = min(self.shingle, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = _mixed(out + h[i : len(h) - size + 1 + i], i)
        return np.unique(out)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = _mixed(shingles, 1).astype(np.uint32)
        times, plus = _odd(self.shape.hashes)
        least = np.full(self.shape.hashes, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 1024):
            np.minimum(least, (times[:, None] * low[i : i + 1024] + plus[:, None]).min(1), out=least)
        return least

    @staticmethod
    def packed(minima: np.ndarray) -> bytes:
        """The low bits of each (mixed) minimum, two to a byte."""
        low = (_mixed(minima.astype(np.uint64), 2) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        return (low[::2] << BITS | low[1::2]).tobytes()

    def bands(self, minima: np.ndarray) -> np.ndarray:
        keys = np.arange(self.shape.bands, dtype=np.uint64)
        for column in minima.reshape(self.shape.bands, self.shape.band).T:
            keys = _mixed(keys + column, 0)
        return keys.view(np.int64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places of packed signatures (rows of 64-bit words) agree."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return 64 // BITS * x.shape[-1] - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1).astype(np.int64)


SKETCH = "doc_id long, n_shingles long, content binary, signature binary, bands array<long>"


def sketch(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """One row per row of docs: the size of its set, a digest of the set (null if empty), signature and band keys, and
    the mark of the row if docs have one."""
    also, shape = [c for c in docs.columns if c == "mark"], shape_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle, shape)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                n, content, signature, bands = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = sketcher.shingles(text)
                    least = sketcher.minima(s)
                    n.append(len(s))
                    content.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signature.append(sketcher.packed(least))
                    bands.append(sketcher.bands(least))
                columns = [pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                columns += [part.column(c) for c in also]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_shingles", "content", "signature", "bands", *also])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also).mapInArrow(run, SKETCH + "".join(f", {c} binary" for c in also))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """content and the full set (sorted 64-bit hashes) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sets = [sketcher.shingles(t).tobytes() for t in part.column("text").to_pylist()]
                content = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(sets, pa.binary())], names=["content", "shingles"])

    return docs.select("text").mapInArrow(run, "content binary, shingles binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """Rows (bucket, size, content, n, signature) of the buckets that hold several of nodes."""
    keyed = nodes.select("content", "n", "signature", F.explode("bands").alias("bucket"))
    several = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return keyed.join(several, "bucket")


def proposals(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of members (bucket, size, content, n, signature): the strongest spanning forest of each bucket's
    pairs that may pass."""
    cut = in_blocks(members, "bucket").select("group", "across", "side", "content", "n", "signature")
    cut = grouped(cut)

    def pairs_of(group: dict[str, np.ndarray | list]) -> Iterator[tuple[bytes, bytes]]:
        content = group["content"]
        for a, b in forest(hopeful(group, similarity)):
            yield min(content[a], content[b]), max(content[a], content[b])

    return by_group(cut, pairs_of).distinct()


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, size, content) dealt to groups: up to BLOCK rows of a key are one; more are cut into blocks, and
    each two blocks are a group in which only pairs across count."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = rows.withColumn("side", F.pmod(F.xxhash64("content"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return cut.withColumn("across", F.col("side") != F.col("other")).withColumn("group", F.xxhash64(key, F.least("side", "other"), F.greatest("side", "other")))


def grouped(rows: DataFrame) -> DataFrame:
    """rows dealt by group to as many partitions as the session shuffles to (a number, so that AQE does not put rows of
    little size and much work into a few tasks), sorted by group in each."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "group").sortWithinPartitions("group", "content")


def hopeful(group: dict[str, np.ndarray | list], similarity: float) -> np.ndarray:
    """Agreeing places of those pairs of a group that may pass by set sizes and the cut; 0 for the others."""
    signature, n = group["signature"], group["n"]
    allowed = 100 * np.minimum(n[:, None], n) >= similarity * 100 * np.maximum(n[:, None], n)
    if group["across"][0]:
        allowed &= group["side"][:, None] != group["side"]
    np.fill_diagonal(allowed, False)
    if not allowed.any():
        return np.zeros(allowed.shape, np.int64)
    agree = np.stack([agreeing(signature, row) for row in signature])
    return np.where(allowed & (agree >= max(shape_of(similarity).least, 1)), agree, 0)


def by_group(rows: DataFrame, pairs_of) -> DataFrame:
    """The pairs (a, b) that pairs_of finds in each group of rows, which are sorted by group within partitions."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict | None = None
        for batch in _with_end(batches):
            out: list[tuple[bytes, bytes]] = []
            new = _arrays(batch, names) if batch is not None else None
            held = new if waiting is None else waiting if new is None else {k: waiting[k] + new[k] if isinstance(new[k], list) else np.concatenate([waiting[k], new[k]]) for k in new}
            if held is not None and len(held["group"]):
                ends = np.append(np.flatnonzero(np.diff(held["group"])) + 1, len(held["group"]))
                last = len(ends) - (batch is not None)  # the last group may go on in the next batch
                start = 0
                for end in ends[:last]:
                    if end - start > 1:
                        out += pairs_of({k: v[start:end] for k, v in held.items()})
                    start = int(end)
                waiting = {k: v[start:] for k, v in held.items()}
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _arrays(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray | list]:
    out: dict[str, np.ndarray | list] = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "across", "side", "n")}
    signatures = b"".join(batch.column("signature").to_pylist())
    out["signature"] = np.frombuffer(signatures, np.uint64).reshape(batch.num_rows, -1)
    return out | {c: batch.column(c).to_pylist() for c in names if c not in out}


def forest(weight: np.ndarray) -> list[tuple[int, int]]:
    """The edges of a maximum spanning forest of a symmetric matrix; 0 is no edge."""
    n = len(weight)
    outside, best, parent = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    edges = []
    for _ in range(n):
        v = int(np.argmax(np.where(outside, best, -1)))
        if best[v] > 0:
            edges.append((int(parent[v]), v))
        outside[v] = False
        better = outside & (weight[v] > best)
        best[better], parent[better] = weight[v][better], v
    return edges


def sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The full set of each of wanted (content); only documents that hold one are read again."""
    readers = nodes.join(wanted, "content").select(F.col("doc_id").alias("reader"))
    texts = docs.join(readers, F.col("doc_id").cast("long").eqNullSafe(F.col("reader")), "left_semi")
    return materialize(shingle_sets(texts, shingle).join(wanted, "content", "left_semi").dropDuplicates(["content"]))


def passes(same: np.ndarray | int, n: int, m: np.ndarray | int, similarity: float) -> np.ndarray | bool:
    return 100 * same >= round(similarity * 100) * (n + m - same)


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs whose full sets are at least so similar."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct(), docs, nodes, shingle)
    side = lambda c: sets.select(F.col("content").alias(c), F.col("shingles").alias(f"of_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(bool(passes(same, len(x), len(y), similarity)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def joining_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members (tree, size, content, n, signature, component, shingles) of one tree that join
    different components. Pairs are compared in the task that holds their blocks; those whose components it has
    already joined are passed over, which leaves the components as they would be."""
    columns = ("group", "across", "side", "content", "n", "signature", "component", "shingles")
    cut = grouped(in_blocks(members, "tree").select(*columns))

    def links_of(group: dict[str, np.ndarray | list]) -> Iterator[tuple[bytes, bytes]]:
        content = group["content"]
        _, part = np.unique(np.array([c.hex() for c in group["component"]]), return_inverse=True)
        if part.max() == 0:
            return
        weight = hopeful(group, similarity)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        left = np.ones(len(sets), bool)
        for x in np.argsort(np.bincount(part)[part], kind="stable"):  # those of small components first
            left[x] = False
            near = np.flatnonzero((weight[x] > 0) & left & (part != part[x]))
            if not len(near):
                continue
            flat, sizes = np.concatenate([sets[y] for y in near]), np.array([len(sets[y]) for y in near])
            mine = sets[x]
            met = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            same = np.add.reduceat(met, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            for y in near[passes(same, len(mine), sizes, similarity)]:
                if part[y] != part[x]:
                    part[part == part[y]] = part[x]
                    yield min(content[x], content[y]), max(content[x], content[y])

    return by_group(cut, links_of).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) can reach. Stars are formed about ever smaller
    nodes, by turns with all neighbours and with the smaller ones, until nothing changes; the number of rounds grows
    with the logarithm of the longest path."""
    stars = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        facts = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if facts == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = facts
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub's neighbours are dealt to SALTS tasks, and what they meet there is repeated as often
        salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = both.filter("v > u").withColumn("salt", salt).join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = materialize(small.filter("u <> v").distinct())


def groups(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(sketches, found): one row per row of docs, with its mark if docs have one; and content, component (a content)
    and component_id (the least doc_id) of each set that has copies or links."""
    sketches = materialize(sketch(docs, shingle, similarity))
    # equal sets have equal signatures and bands, so any of them stands for its copies
    nodes = sketches.filter("content is not null").groupBy("content").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    nodes = materialize(nodes)
    members = materialize(buckets(nodes))

    tried = materialize(proposals(members, similarity))
    links = materialize(confirmed(tried, docs, nodes, shingle, similarity))
    found = materialize(components(links))

    # trees of proposals that confirmed links leave in several components; a pair alone has been tried
    trees = components(tried).select(F.col("node").alias("content"), F.col("component").alias("tree"))
    trees = materialize(trees.join(found.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("component", "content")))
    several = trees.groupBy("tree").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    apart = materialize(trees.join(several.filter("low < high and size > 2").select("tree", "size"), "tree"))
    if not apart.isEmpty():
        sets = sets_of(apart.select("content"), docs, nodes, shingle)
        held = apart.join(nodes.select("content", "n", "signature"), "content").join(sets, "content")
        more = materialize(joining_links(held, similarity))
        found = materialize(components(links.unionByName(more)))

    # a set without copies and links keeps its own id; groups are joined as written tables, so that hot ones are split
    of_node = nodes.select("content", "copies", F.col("doc_id").alias("least")).join(found.withColumnRenamed("node", "content"), "content", "left")
    of_node = materialize(of_node.filter("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "content")))
    least = materialize(of_node.groupBy("component").agg(F.min("least").alias("component_id")))
    return sketches, of_node.join(least, "component").select("content", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that can be reached) and kept (whether that is its own)."""
    sketches, of_node = groups(docs.select("doc_id", "text"), shingle, similarity)
    of_node = of_node.select("content", "component_id")
    out = sketches.select("doc_id", "n_shingles", "content").join(of_node, "content", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group, that of the least id (null last), then content, then text; the columns are
    those of docs. Rows, not ids, are decided on: of rows that repeat an id and a text one stays at most, and rows
    that share just the id are apart. Rows without words belong to no group and stay."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("mark"), F.struct(*docs.columns).alias("row"))
    sketches, of_node = groups(keyed.drop("row"), shingle, similarity)
    # rows of equal id and text are one candidate; the least candidate of a component is kept
    held = sketches.filter("content is not null").join(of_node.select("content", "component"), "content")
    held = materialize(held.groupBy("component", "doc_id", "content", "mark").agg(F.count(F.lit(1)).alias("rows")))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content", "mark")
    best = held.groupBy("component").agg(F.min(rank).alias("best"))
    # a mark has one content, so a candidate that is dropped is the best of no other component
    judged = held.join(best, "component").withColumn("kept", rank == F.col("best"))
    judged = materialize(judged.filter("not kept or rows > 1").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "kept"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    alone = keyed.join(judged, same, "left_anti").select("row.*")
    repeated = judged.filter("kept")
    if repeated.isEmpty():
        return alone
    one = keyed.join(repeated, same, "left_semi").groupBy("doc_id", "mark").agg(F.min("row").alias("row"))
    return alone.unionByName(one.select("row.*"))
