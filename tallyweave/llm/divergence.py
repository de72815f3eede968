"""How the sources of a language differ in their terms, by chunk factorization.

Documents are cut at white space into chunks, and chunks are counted, by document first, then by task. Each chunk that
occurs anywhere is cut into terms once, and its terms are joined back to its counts; whatever is said of terms
(occurrences in a source, distinct documents of a language) is added up from chunks. A term is kept for a language if
`least` of its documents hold it. For that no list of documents grows: `least` of them are enough, and then the name
just counts as held by many.

Counts travel as packed arrays: tasks send each shard of chunks one row, shards of chunks send each shard of terms one
row, and both add up what comes in as it comes, so that a frequent chunk costs a shard no more than its sources.

Kept terms' smoothed shares are compared as whole numbers, between each source and its language and between sources:
every shard of terms is one matrix a language, of which the sums of pairs and the `top` terms of each source go on.

Defined cases: null text, language and source count as empty; a document is told by its id, so rows that repeat one
count once for `least`, and rows without id are told apart by their text; occurrences count for every row; a source
without terms has a count of 0 for each kept term; sources of a language without kept terms are 0 apart; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A term is a maximal run of letters A to Z and characters beyond ASCII (bytes of 128 and more in UTF-8).
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
SCALE = 1_000_000_000
#: Words a task gathers before it adds them up, and entries a shard does; cells of a matrix worked on at a time.
GATHERED, PENDING, CELLS = 800_000, 500_000, 500_000
#: Bytes of text for each shard.
SHARD_BYTES = 8_000_000


class Codes(dict):
    """Numbers for values in the order in which they are first asked for."""

    def __missing__(self, value) -> int:
        self[value] = code = len(self)
        return code


def pairs(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """One number for each pair; b is less than size."""
    return a * max(size, 1) + b


def heads(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values of keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


class Tally:
    """Names with their occurrences by home (language and source), and the documents of a language that hold them, as
    far as `least`."""

    def __init__(self, least: int):
        self.least, self.pending = least, 0
        self.names, self.homes, self.langs = Codes(), Codes(), Codes()
        none = np.zeros(0, np.int64)
        self.counts, self.held, self.many = [(none, none, none)], [(none, none, none)], [(none, none)]

    def add(self, counts: tuple, held: tuple, many: tuple) -> None:
        """Add arrays (name, home, n), (name, lang, document) and (name, lang) in this tally's numbers."""
        self.counts.append(counts)
        self.held.append(held)
        self.many.append(many)
        self.pending += len(counts[0]) + len(held[0])
        if self.pending > PENDING:
            self.settle()

    def settle(self) -> None:
        """Equal entries become one."""
        homes, langs = len(self.homes), len(self.langs)
        name, home, n = (np.concatenate(x) for x in zip(*self.counts))
        key = pairs(name, home, homes)
        order = np.argsort(key, kind="stable")
        first = heads(key[order])
        self.counts = [(name[order][first], home[order][first], np.add.reduceat(n[order], first) if len(first) else n)]
        sure = np.unique(pairs(*(np.concatenate(x) for x in zip(*self.many)), langs))
        name, lang, document = (np.concatenate(x) for x in zip(*self.held))
        key = pairs(name, lang, langs)
        open_ = ~np.isin(key, sure)
        key, document = key[open_], document[open_]
        order = np.lexsort((document, key))
        key, document = key[order], document[order]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (document[1:] != document[:-1])]) if len(key) else np.zeros(0, bool)
        key, document = key[once], document[once]
        first = heads(key)
        size = np.diff(np.append(first, len(key)))
        few = np.repeat(size < self.least, size)
        sure = np.concatenate([sure, key[first[size >= self.least]]])
        self.held, self.many = [(key[few] // max(langs, 1), key[few] % max(langs, 1), document[few])], [(sure // max(langs, 1), sure % max(langs, 1))]
        self.pending = 0

    def packed(self, shards: int) -> Iterator[tuple]:
        """One row for each shard of names."""
        self.settle()
        names, homes, langs = list(self.names), list(self.homes), list(self.langs)
        shard = np.array([crc32(x) % shards for x in names], np.int64)
        place = np.zeros(len(names), np.int64)  # of a name within its shard
        by_shard = np.argsort(shard, kind="stable")
        first = heads(shard[by_shard])
        place[by_shard] = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
        sorted_ = [tuple(x[order] for x in arrays) for arrays in (self.counts[0], self.held[0], self.many[0]) for order in [np.argsort(shard[arrays[0]], kind="stable")]]
        bounds = [np.searchsorted(shard[arrays[0]], np.arange(shards + 1)) for arrays in sorted_]
        for start, end in zip(first.tolist(), np.append(first[1:], len(names)).tolist()):
            s = int(shard[by_shard[start]])
            part = [tuple(x[b[s] : b[s + 1]] for x in arrays) for arrays, b in zip(sorted_, bounds)]
            used, home = np.unique(part[0][1], return_inverse=True)
            lists = [[homes[h][0] for h in used], [homes[h][1] for h in used], langs]
            small = lambda x: x.astype(np.int32).tobytes()
            yield (
                s, b"\n".join([names[i] for i in by_shard[start:end]]), *lists, small(place[part[0][0]]), small(home), part[0][2].tobytes(),
                small(place[part[1][0]]), small(part[1][1]), part[1][2].tobytes(), small(place[part[2][0]]), small(part[2][1]),
            )

    def take(self, row: dict) -> None:
        """Add a row of packed()."""
        name = np.array([self.names[x] for x in row["names"].split(b"\n")], np.int64)
        home = np.array([self.homes[x] for x in zip(row["home_lang"], row["home_source"])], np.int64)
        lang = np.array([self.langs[x] for x in row["langs"]], np.int64)
        of = lambda c, kind=np.int32: np.frombuffer(row[c], kind)
        self.add((name[of("name")], home[of("home")], of("n", np.int64)), (name[of("held")], lang[of("held_lang")], of("document", np.int64)), (name[of("many")], lang[of("many_lang")]))

    def of_terms(self) -> Tally:
        """The same of the terms that the names hold: each name is cut once."""
        self.settle()
        out = Tally(self.least)
        out.homes, out.langs = self.homes, self.langs
        found = [[out.names[t] for t in TERM.findall(name.lower())] for name in self.names]
        size = np.array([len(f) for f in found], np.int64)
        terms, begin = np.array([t for f in found for t in f], np.int64), np.cumsum(size) - size

        def joined(arrays: tuple) -> tuple:
            times = size[arrays[0]]
            at = np.repeat(np.arange(len(times)), times)
            step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            return terms[begin[arrays[0]][at] + step], *(x[at] for x in arrays[1:])

        out.add(joined(self.counts[0]), joined(self.held[0]), joined(self.many[0]))
        return out

    def kept(self) -> Iterator[tuple]:
        """(lang, terms, sources, term, source, n): for each language the names that many documents hold."""
        self.settle()
        names, homes = list(self.names), list(self.homes)
        home_lang = np.array([self.langs[lang] for lang, _ in homes], np.int64)
        sure = np.unique(pairs(*self.many[0], len(self.langs)))
        name, home, n = self.counts[0]
        key = pairs(name, home_lang[home], len(self.langs))
        known = np.isin(key, sure)
        name, home, n = name[known], home[known], n[known]
        for code, lang in enumerate(list(self.langs)):
            mine = home_lang[home] == code
            if mine.any():
                used, term = np.unique(name[mine], return_inverse=True)
                sources, source = np.unique(home[mine], return_inverse=True)
                yield lang, b"\n".join([names[i] for i in used]), [homes[h][1] for h in sources], term.astype(np.int32).tobytes(), source.astype(np.int32).tobytes(), n[mine].tobytes()


COLUMNS = {
    "shard": pa.int32(), "names": pa.binary(), "home_lang": pa.list_(pa.string()), "home_source": pa.list_(pa.string()), "langs": pa.list_(pa.string()), "name": pa.binary(), "home": pa.binary(), "n": pa.binary(),
    "held": pa.binary(), "held_lang": pa.binary(), "document": pa.binary(), "many": pa.binary(), "many_lang": pa.binary(),
}
KEPT = {"lang": pa.string(), "terms": pa.binary(), "sources": pa.list_(pa.string()), "term": pa.binary(), "source": pa.binary(), "n": pa.binary()}
KINDS = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.string()): "array<string>"}


def batch_of(rows: list[tuple], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())], names=list(columns))


def ddl(columns: dict) -> str:
    return ", ".join(f"{name} {KINDS[kind]}" for name, kind in columns.items())


def chunk_tallies(docs: DataFrame, least: int, shards: int) -> DataFrame:
    """The chunks of docs (doc, lang, source, text), tallied within tasks and packed by shard."""

    def tallied(words: list[np.ndarray], chunks: Codes, places: list[tuple]) -> pa.RecordBatch:
        tally = Tally(least)
        tally.names = chunks
        home = np.array([tally.homes[lang, source] for _, lang, source in places], np.int64)
        lang = np.array([tally.langs[lang] for _, lang, _ in places], np.int64)
        document = np.array([doc for doc, _, _ in places], np.int64)
        # a document's chunks are counted before anything else
        each, times = np.unique(np.concatenate(words), return_counts=True)
        words.clear()
        place, chunk = each >> 32, each & 0xFFFFFFFF
        none = np.zeros(0, np.int64)
        tally.add((chunk, home[place], times), (chunk, lang[place], document[place]), (none, none))
        return batch_of(list(tally.packed(shards)), COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunks, places, n = [], Codes(), [], 0
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                for doc, lang, source, text in zip(*(part.column(c).to_pylist() for c in ("doc", "lang", "source", "text"))):
                    found = text.encode().split()
                    if found:
                        words.append(np.fromiter(map(chunks.__getitem__, found), np.int64, len(found)) | len(places) << 32)
                        places.append((doc, lang, source))
                        n += len(found)
                if n >= GATHERED:
                    yield tallied(words, chunks, places)
                    words, chunks, places, n = [], Codes(), [], 0
        if words:
            yield tallied(words, chunks, places)

    return docs.mapInArrow(run, ddl(COLUMNS))


def by_shard(rows: DataFrame, least: int, finish: Callable[[Tally], Iterator[tuple]], columns: dict) -> DataFrame:
    """What finish gives of each shard's tally, which is added up row by row."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tally = None, Tally(least)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["shard"] != shard:
                    if shard is not None:
                        yield batch_of(list(finish(tally)), columns)
                    shard, tally = row["shard"], Tally(least)
                tally.take(row)
        if shard is not None:
            yield batch_of(list(finish(tally)), columns)

    return rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, ddl(columns))


def kept_terms(docs: DataFrame, least: int = 10) -> DataFrame:
    """Rows (lang, terms, sources, term, source, n): the terms that `least` documents of a language hold and how often
    each of its sources has them, shard by shard, packed."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = int(max(1, -(-size // SHARD_BYTES)))
    told = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("doc"), text("lang"), text("source"), text("text"))
    terms = by_shard(chunk_tallies(told, least, shards), least, lambda tally: tally.of_terms().packed(shards), COLUMNS)
    return materialize(by_shard(terms, least, lambda tally: tally.kept(), KEPT))


def sums_of(kept: DataFrame) -> DataFrame:
    """(lang, source, total, kept): the occurrences of each source, and in a row without source the number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                source, n = np.frombuffer(row["source"], np.int32), np.frombuffer(row["n"], np.int64)
                total = np.zeros(len(row["sources"]), np.int64)
                np.add.at(total, source, n)
                out += [(row["lang"], s, int(t), 0) for s, t in zip(row["sources"], total)]
                out.append((row["lang"], None, 0, row["terms"].count(b"\n") + 1))
            yield batch_of(out, {"lang": pa.string(), "source": pa.string(), "total": pa.int64(), "kept": pa.int64()})

    return kept.mapInArrow(run, "lang string, source string, total long, kept long").groupBy("lang", "source").agg(F.sum("total").alias("total"), F.sum("kept").alias("kept"))


def shares(n: np.ndarray, total, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly."""
    exact = n.astype(object) if n.max(initial=0) > 9_000_000_000 else n
    return (1 + SCALE * (exact + 2) // (total + 2 * kept)).astype(np.int64)


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compared(rows: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value) of rows (lang, kept, homes and the columns of kept_terms, null where a language
    keeps no term): sums of the terms at hand for pairs of sources, and each source's `top` terms among them."""
    columns = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}

    def of_row(row: dict) -> Iterator[tuple]:
        lang, V = row["lang"], row["kept"]
        homes = sorted((h["source"], h["total"]) for h in row["homes"])
        names, totals = [s for s, _ in homes], np.array([t for _, t in homes])[:, None]
        apart = np.zeros((len(names), len(names)), np.int64)
        if row["terms"] is not None:
            terms = row["terms"].split(b"\n")
            at = {s: i for i, s in enumerate(names)}
            line = np.array([at[s] for s in row["sources"]])[np.frombuffer(row["source"], np.int32)]
            term, n = np.frombuffer(row["term"], np.int32), np.frombuffer(row["n"], np.int64)
            order = np.argsort(term, kind="stable")
            line, term, n = line[order], term[order], n[order]
            best: list[list[tuple]] = [[] for _ in names]
            width = max(1, CELLS // len(names))
            for low in range(0, len(terms), width):
                cell = slice(*np.searchsorted(term, [low, low + width]))
                counts = np.zeros((len(names), min(width, len(terms) - low)), np.int64)
                counts[line[cell], term[cell] - low] = n[cell]
                p, q = shares(counts, totals, V), shares(counts.sum(0), int(totals.sum()), V)
                for i in range(len(names)):
                    apart[i] += far(p[i], p).sum(1)
                    more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                    value = far(p[i][more], q[more])
                    if len(more) > top:  # ties with the last one stay
                        more = more[value >= np.partition(value, -top)[-top]]
                        value = far(p[i][more], q[more])
                    best[i] = sorted(best[i] + [(-int(v), terms[low + j]) for v, j in zip(value, more.tolist())])[:top]
            for source, found in zip(names, best):
                yield from ((lang, source, "term", t.decode(), -v) for v, t in found)
        for source, values in zip(names, apart):
            yield from ((lang, source, "pair", other, int(v)) for other, v in zip(names, values) if other != source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch_of(list(of_row(batch.slice(i, 1).to_pylist()[0])), columns)

    return rows.mapInArrow(run, ddl(columns))


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value and rank. Part `pair`: how far each source of a language is from each other one;
    part `term`: the `top` terms that a source has more of than its language."""
    kept = kept_terms(docs, least)
    sums = materialize(sums_of(kept))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    homes = docs.select(text("lang"), text("source")).distinct().join(sums.filter("source is not null").drop("kept"), ["lang", "source"], "left").fillna(0, ["total"])
    vocabulary = sums.filter("source is null").select("lang", "kept")
    langs = homes.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("homes")).join(vocabulary, "lang", "left").fillna(0, ["kept"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = langs.join(kept, "lang", "left").repartition(parts, "lang", "terms")
    found = compared(rows, top).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return found.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
