"""Passages of many words that stand in an earlier document too, found by suffix automata and removed.

A word goes if a window of `window` consecutive words covers it that also starts in a document of a smaller id. Suffix
automata of reference shards tell: each state knows the least id of the documents that its strings end in, documents are
walked through an automaton word by word, and where the statistic of the matching suffix is `window` or more the state
of its last `window` words tells who had them first.

An automaton of every shard sent to every document would cost the square of the input, so a window only meets the one
shard that can hold it. Of the runs of ANCHOR words in a window the one of the least hash is its anchor: equal windows
have equal anchors. Anchors that two documents share are found first, from packed arrays of hashes; only stretches
around those go on, as words, to the shard of their anchor, where the distinct ones make up the automaton. Windows of an
anchor that more than HOT documents share are dealt one by one, by their own hash, so that no shard grows with a
frequent phrase; equal stretches of a block of documents travel once.

All rows are packed arrays for each block of documents and shard; the texts are shuffled once, to their blocks, and
that exchange is read again by each step. Words are compared as they are; hashes only deal them out.

Defined cases: a null text has no words; texts shorter than a window keep all; a document without id keeps all and is
no reference; rows that share an id do not count as earlier than each other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of an anchor (fewer, if a window is shorter); documents that share a frequent one.
ANCHOR, HOT = 5, 1000
#: Bytes of text of a block of documents, and of text for each shard.
BLOCK_BYTES, SHARD_BYTES = 4_000_000, 2_000_000
#: Words hashed at a time.
TOGETHER = 200_000
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * ODD[0]
    h ^= h >> np.uint64(32)
    h *= ODD[1]
    return h ^ (h >> np.uint64(29))


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of every `width` neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = least(values[:-step], values[step:])
        have += step
    return values


class Words:
    """The words of a block of texts: where they stand, their hashes, and the windows that one text holds whole."""

    def __init__(self, texts: list[str | None], window: int):
        self.window = window
        parts = [(t or "").encode().split() for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        # one space before every word and one at the end, so a stretch of words is a slice
        self.data = b" " + b" ".join(b" ".join(p) for p in parts if p) + b" "
        flat = np.frombuffer(self.data, np.uint8)
        self.starts = np.flatnonzero(flat == 32) + 1
        self.n = int(self.first[-1])
        self.document = np.repeat(np.arange(len(parts)), self.sizes)
        last = max(self.n - window + 1, 0)
        self.whole = self.document[:last] == self.document[window - 1 :]

    def hashes(self) -> np.ndarray:
        """A hash of each word: its bytes, and the space behind it, each weighted by its place."""
        flat, size = np.frombuffer(self.data, np.uint8), np.diff(self.starts)
        weights = mixed(np.arange(1, int(size.max()) + 1, dtype=np.uint64))
        out = np.zeros(self.n, np.uint64)
        for i in range(0, self.n, TOGETHER):
            at, long = self.starts[i : i + TOGETHER][: self.n - i], size[i : i + TOGETHER][: self.n - i]
            low = int(at[0])
            places = np.arange(low, low + int(long.sum())) - np.repeat(at, long)
            terms = (flat[low : low + len(places)].astype(np.uint64) + np.uint64(1)) * weights[places]
            out[i : i + len(at)] = mixed(np.add.reduceat(terms, at - low))
        return out

    def runs(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of `size` words, never 0."""
        out = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
        for i in range(size):
            out = mixed(out + hashes[i : i + len(out)])
        return out | np.uint64(1)

    def anchors(self, hashes: np.ndarray) -> np.ndarray:
        """The hash of each window's anchor; 0 for windows across texts."""
        size = min(ANCHOR, self.window)
        if not len(self.whole):
            return np.zeros(0, np.uint64)
        return np.where(self.whole, sliding(self.runs(hashes, size), self.window - size + 1, np.minimum), np.uint64(0))

    def stretch(self, start: int, words: int) -> bytes:
        return self.data[self.starts[start] : self.starts[start + words] - 1]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def pieces(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal values in sorted keys."""
    if len(keys):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(keys[a]), slice(a, b)


def joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays one after the other, and the row that each value comes from."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate([*parts, np.zeros(0, kind)]), np.repeat(np.arange(len(parts)), np.array([len(p) for p in parts], np.int64))


class Automaton:
    """A suffix automaton of sequences of numbers; each state knows the least document that one of its strings ends in."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 62]

    def _copy(self, state: int, length: int) -> int:
        self.next.append(self.next[state].copy())
        self.link.append(self.link[state])
        self.length.append(length)
        self.first.append(1 << 62)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the string of p and word, parted from the longer strings of q."""
        length = self.length[p] + 1
        if self.length[q] == length:
            return q
        new = self._copy(q, length)
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words: list[int], document: int) -> None:
        last, following, links, lengths, first = 0, self.next, self.link, self.length, self.first
        for word in words:
            q = following[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new = len(following)
                following.append({})
                links.append(0)
                lengths.append(lengths[last] + 1)
                first.append(1 << 62)
                p = last
                while p >= 0 and word not in following[p]:
                    following[p][word] = new
                    p = links[p]
                if p >= 0:
                    links[new] = self._split(p, word, following[p][word])
                last = new
            if document < first[last]:
                first[last] = document

    def finish(self) -> None:
        """Tell every state of the documents that its longer strings end in."""
        first, links = self.first, self.link
        for state in np.argsort(-np.array(self.length), kind="stable").tolist()[:-1]:
            if first[state] < first[links[state]]:
                first[links[state]] = first[state]

    def first_of_windows(self, words: list[int], window: int) -> list[int]:
        """For each window of words the least document that holds it. The state is kept at the shortest suffix that is
        still as long as a window; the matching statistic tells how much of the words before ends there."""
        following, links, lengths = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in following[state]:
                state = links[state]
                matched = lengths[state]
            if word in following[state]:
                state, matched = following[state][word], matched + 1
            while links[state] >= 0 and lengths[links[state]] >= window:
                state = links[state]
                matched = lengths[state]
            if i + 1 >= window:
                out.append(self.first[state] if matched >= window else 1 << 62)
        return out


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt to blocks by a hash of the id, or of the text where there is none, and the number of
    shards for so much text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, shards = (int(max(1, -(-size // n))) for n in (BLOCK_BYTES, SHARD_BYTES))
    block = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))), F.lit(blocks)).cast("int")
    return dealt(docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "block"), shards


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key to as many partitions as the session shuffles to: a number, so that AQE does not put rows of
    little size and much work into a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """The ids (0 for null), which are not null, and the texts of a block's rows, in an order that their content sets:
    a row's place in it is the same whenever the block is read."""
    ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
    place = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or "", texts[i] is None))
    return np.array([ids[i] or 0 for i in place], np.int64), np.array([ids[i] is not None for i in place], bool), [texts[i] for i in place]


def anchor_rows(blocks: DataFrame, shards: int, window: int) -> DataFrame:
    """Rows (shard, block, anchor, low, high, times): each block's anchors, the least and the greatest id of its
    documents that have them, and how often they stand there, packed by shard."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids, valid, texts = ordered(rows)
        words = Words(texts, window)
        anchor = words.anchors(words.hashes())
        at = np.flatnonzero((anchor != 0) & valid[words.document[: len(anchor)]])
        anchor, document = anchor[at], words.document[at]
        new = (np.diff(anchor, prepend=np.uint64(0)) != 0) | (np.diff(document, prepend=-1) != 0)
        anchor, id_ = anchor[new], ids[document[new]]
        order = np.lexsort((id_, anchor, shard_of(anchor, shards)))
        anchor, id_ = anchor[order], id_[order]
        first = np.flatnonzero(np.diff(anchor, prepend=np.uint64(0)))
        size = np.diff(np.append(first, len(anchor)))
        anchor, low, high = anchor[first], id_[first], id_[first + size - 1]
        out = [(shard, anchor[p].tobytes(), low[p].tobytes(), high[p].tobytes(), size[p].astype(np.int32).tobytes()) for shard, p in pieces(shard_of(anchor, shards))]
        columns = [pa.array([x[i] for x in out], pa.int32() if i == 0 else pa.binary()) for i in range(5)]
        return pa.Table.from_arrays([columns[0], pa.array([key[0].as_py()] * len(out), pa.int32()), *columns[1:]], names=["shard", "block", "anchor", "low", "high", "times"])

    return blocks.groupBy("block").applyInArrow(run, "shard int, block int, anchor binary, low binary, high binary, times binary")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """Rows (block, anchor, hot): the anchors of each block that several ids have, and whether they stand in more than HOT places."""

    def run(rows: pa.Table) -> pa.Table:
        anchor, row = joined(rows.column("anchor"), np.uint64)
        low, high, size = (joined(rows.column(c), kind)[0] for c, kind in (("low", np.int64), ("high", np.int64), ("times", np.int32)))
        order = np.argsort(anchor, kind="stable")
        first = np.flatnonzero(np.diff(anchor[order], prepend=np.uint64(0)))
        times = np.diff(np.append(first, len(order)))
        several = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
        hot = np.add.reduceat(size[order].astype(np.int64), first) > HOT
        keep, is_hot = np.zeros(len(order), bool), np.zeros(len(order), bool)
        keep[order], is_hot[order] = np.repeat(several, times), np.repeat(hot, times)
        blocks = rows.column("block").to_pylist()
        out = [(blocks[r], anchor[p][keep[p]].tobytes(), is_hot[p][keep[p]].tobytes()) for r, p in pieces(row) if keep[p].any()]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int32() if i == 0 else pa.binary()) for i in range(3)], names=["block", "anchor", "hot"])

    return dealt(rows, "shard").groupBy("shard").applyInArrow(run, "block int, anchor binary, hot binary")


def stretches(blocks: DataFrame, shared: DataFrame, shards: int, window: int) -> DataFrame:
    """Rows (shard, block, texts, which, id, row, place): each block's stretches of words whose windows have a shared
    anchor, the distinct ones as lines of words, and for each stretch its line, its document's id and row, and its first
    word."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        names = ["shard", "block", "texts", "which", "id", "row", "place"]
        anchors = joined(found.column("anchor"), np.uint64)[0]
        ids, valid, texts = ordered(rows)
        words = Words(texts, window)
        hashes = words.hashes()
        anchor = words.anchors(hashes)
        if not len(anchors) or not len(anchor):
            return pa.Table.from_arrays([pa.array([], pa.int32())] * 2 + [pa.array([], pa.binary())] * 5, names=names)
        order = np.argsort(anchors)
        anchors, hot = anchors[order], joined(found.column("hot"), np.bool_)[0][order]
        near = np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)
        at = np.flatnonzero((anchors[near] == anchor) & valid[words.document[: len(anchor)]])
        # windows of one anchor that follow one another go together, but each of a hot one on its own, by its own hash
        of_hot = hot[near[at]]
        deal = np.where(of_hot, words.runs(hashes, window)[at], anchor[at])
        new = of_hot | (np.diff(at, prepend=-2) != 1) | (np.diff(anchor[at], prepend=np.uint64(0)) != 0) | (np.diff(words.document[at], prepend=-1) != 0)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at))) + window - 1
        place, deal = at[begin], deal[begin]
        order = np.argsort(shard_of(deal, shards), kind="stable")
        place, size, shard = place[order], size[order], shard_of(deal, shards)[order]
        document = words.document[place]
        id_, within = ids[document], place - words.first[document]
        out = []
        for s, p in pieces(shard):
            lines: dict[bytes, int] = {}
            which = [lines.setdefault(words.stretch(a, n), len(lines)) for a, n in zip(place[p].tolist(), size[p].tolist())]
            out.append((s, b"\n".join(lines), np.array(which, np.int32).tobytes(), id_[p].tobytes(), document[p].astype(np.int32).tobytes(), within[p].astype(np.int32).tobytes()))
        columns = [pa.array([x[i] for x in out], pa.int32() if i == 0 else pa.binary()) for i in range(6)]
        return pa.Table.from_arrays([columns[0], pa.array([key[0].as_py()] * len(out), pa.int32()), *columns[1:]], names=names)

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, "shard int, block int, texts binary, which binary, id binary, row binary, place binary")


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """Rows (block, row, place, words): where in each block's rows a window of an earlier document starts, runs of such
    windows as the words they cover."""

    def run(rows: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        lines: dict[bytes, int] = {}
        where = [np.array([lines.setdefault(line, len(lines)) for line in texts.as_py().split(b"\n")], np.int64) for texts in rows.column("texts")]
        which, source = joined(rows.column("which"), np.int32)
        id_, row, place = (joined(rows.column(c), kind)[0] for c, kind in (("id", np.int64), ("row", np.int32), ("place", np.int32)))
        line = np.concatenate([where[r][which[p]] for r, p in pieces(source)])
        least = np.full(len(lines), 1 << 62)
        np.minimum.at(least, line, id_)
        coded = [[numbers.setdefault(w, len(numbers)) for w in text.split(b" ")] for text in lines]
        automaton = Automaton()
        for words, document in zip(coded, least.tolist()):
            automaton.add(words, document)
        automaton.finish()
        firsts = [automaton.first_of_windows(words, window) for words in coded]
        width = np.array([len(f) for f in firsts])
        flat, begin = np.array([f for first in firsts for f in first], np.int64), np.concatenate([[0], np.cumsum(width)])
        # every stretch of every document once more, window by window
        times = width[line]
        of = np.repeat(np.arange(len(line)), times)
        step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        gone = flat[begin[line[of]] + step] < id_[of]
        of, start, step = of[gone], place[of[gone]] + step[gone], step[gone]
        new = (np.diff(of, prepend=-1) != 0) | (np.diff(step, prepend=-2) != 1)
        head = np.flatnonzero(new)
        words = (np.diff(np.append(head, len(of))) + window - 1).astype(np.int32)
        of, start = of[head], start[head].astype(np.int32)
        blocks = rows.column("block").to_pylist()
        out = [(blocks[r], row[of[p]].tobytes(), start[p].tobytes(), words[p].tobytes()) for r, p in pieces(source[of])]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int32() if i == 0 else pa.binary()) for i in range(4)], names=["block", "row", "place", "words"])

    return dealt(rows, "shard").groupBy("shard").applyInArrow(run, "block int, row binary, place binary, words binary")


SPANS = "spans array<struct<start:int,end:int>>"


def cut(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (what is left, words with one space between) and the maximal spans of words
    removed, for every row of blocks."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        ids, valid, texts = ordered(rows)
        row, place, words = (joined(found.column(c), np.int32)[0] for c in ("row", "place", "words"))
        order = np.lexsort((place, row))
        row, place, end = row[order], place[order], (place + words)[order]
        of = dict(pieces(row))
        total, removed, kept, spans = [], [], [], []
        for i, text in enumerate(texts):
            parts, gone, left, upto = (text or "").encode().split(), [], [], 0
            for a, b in zip(place[of[i]].tolist(), end[of[i]].tolist()) if i in of else ():
                if gone and a <= gone[-1]["end"]:
                    gone[-1]["end"] = max(gone[-1]["end"], b)
                else:
                    gone.append({"start": a, "end": b})
            for g in gone:
                left += parts[upto : g["start"]]
                upto = g["end"]
            left += parts[upto:]
            total.append(len(parts))
            removed.append(len(parts) - len(left))
            kept.append(b" ".join(left).decode())
            spans.append(gone)
        columns = [pa.array(ids, pa.int64(), mask=~valid), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(run, f"doc_id long, n_words long, n_removed long, kept string, {SPANS}")


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept and spans (words from start to end) of every row of docs (doc_id, text), without
    the words that a window of an earlier document covers."""
    blocks, shards = in_blocks(docs)
    shared = shared_anchors(anchor_rows(blocks, shards, window))
    repeated = repeated_windows(stretches(blocks, shared, shards, window), window)
    return cut(blocks, repeated)
