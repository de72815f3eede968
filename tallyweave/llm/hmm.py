"""A hidden Markov language model over whole documents.

The most frequent words are symbols of their own and all others fall into a fixed number of classes by hash; the
model is a Markov chain of latent states that emit symbols, and a word of a class is emitted with its add-one share of
the class. Baum-Welch passes run over every training document, each one chain from its first token to its end: tasks
add up expected counts, Spark sums them by symbol, and the driver turns the sums (a table of fixed size) into the next
model. A document's likelihood is exact: a forward recursion over its whole sequence, scaled at each step, and the
class shares of its rare words.

Defined cases: a null or empty text is the end token alone; without training documents every word is unknown and the
states emit symbols evenly; equal rows give equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import Packed, alike
from .common import WORD, ascii_lower, materialize

#: Frequent words, classes of rare ones, and latent states.
WORDS, CLASSES, STATES, PASSES = 24_000, 1_000, 6, 4
#: Tokens gathered in a task before numpy works on them, and tokens of chains of similar length walked together.
GATHERED, TOGETHER = 4_000_000, 500_000
#: Strength of the symbol frequencies that smooth each state's emissions, and how often a state stays at first.
SMOOTH, STAY = 20.0, 0.9
#: What str.split also takes for white space.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(text: str) -> list[str]:
    """The words of text, A to Z lower-cased."""
    text = text.encode().lower().decode()
    return re.findall(WORD, text) if ODD.search(text) else text.split()


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word stands in docs (text)."""
    words = F.explode(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"))
    return docs.select(words.alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def most_frequent(counts: DataFrame, words: int) -> DataFrame:
    """The `words` most frequent of counts (word, c), ties by word. A histogram of the logarithms of c tells first below
    which count none can be among them, so that no partition sends its own `words` rows."""
    step = F.floor(F.log2("c") * 8)
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, n = 0, 0
    for least, more in sizes:
        n += more
        if n >= words:
            break
    return counts.filter(step >= least).orderBy(F.col("c").desc(), "word").limit(words)


class Model:
    """start (K), move (K x K) and emit (symbols x K); symbol 0 is the end, then frequent words, then classes."""

    def __init__(self, frequent: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.frequency, self.start, self.move, self.emit = frequent, start, move, emit

    @classmethod
    def first(cls, frequency: np.ndarray, states: int, seed: int = 7) -> Model:
        """Sticky states whose emissions are the corpus frequencies bent at random, so that passes can part them."""
        random = np.random.default_rng(seed)
        emit = (frequency / frequency.sum())[:, None] * (0.2 + random.random((len(frequency), states)) ** 2)
        move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
        np.fill_diagonal(move, STAY if states > 1 else 1.0)
        return cls(frequency, np.full(states, 1 / states), move, emit / emit.sum(0))

    def next(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        prior = self.frequency / self.frequency.sum()
        emit = emit + SMOOTH * len(prior) ** 0.5 * prior[:, None]
        return Model(self.frequency, (start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))

    def expected(self, chains: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over chains, by the scaled forward-backward recursion."""
        k, symbols, steps = len(self.start), chains.values, chains.steps()
        emit, move, ones = self.emit.astype(np.float32), self.move.astype(np.float32), np.ones((len(self.start), 1), np.float32)
        shown, start, tiny = emit[symbols], self.start.astype(np.float32), np.float32(1e-30)
        forward = np.empty_like(shown)
        for t, a, b in steps:
            now = shown[a:b] * (forward[last : last + b - a] @ move if t else start)
            now /= now @ ones + tiny
            forward[a:b] = now
            last = a
        moves, back = np.zeros((k, k)), np.ones((len(chains.order), k), np.float32)
        for t, a, b in reversed(steps):
            told = shown[a:b] * back[: b - a]
            here = forward[a:b] * back[: b - a]
            forward[a:b] = here / (here @ ones + tiny)
            if t:
                before = forward[chains.begin[t - 1] : chains.begin[t - 1] + b - a]
                reach = told @ move.T
                moves += move * ((before / ((before * reach) @ ones + tiny)).T @ told)
                back[: b - a] = reach / (reach @ ones + tiny)
        emitted = np.stack([np.bincount(symbols, forward[:, j], len(self.frequency)) for j in range(k)], 1)
        return forward[: len(chains.order)].sum(0, dtype=np.float64), moves, emitted

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Of each whole sequence: the logarithms of the forward recursion's scales, added up."""
        chains = Packed(sequences)
        total, now = np.zeros(len(sequences)), np.broadcast_to(self.start, (len(sequences), len(self.start)))
        for _, a, b in chains.steps():
            now = now[: b - a] * self.emit[chains.values[a:b]]
            scale = now.sum(1)
            total[: b - a] += np.log10(scale)
            now = (now / scale[:, None]) @ self.move
        out = np.empty(len(sequences))
        out[chains.order] = total
        return out


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, log_known double, symbols binary, rare array<string>"


def encode_symbols(docs: DataFrame, frequent: list[tuple[str, int]], end_count: int, words: int, classes: int) -> DataFrame:
    """docs (doc_id, held_out, text) as symbol sequences of 16 bits, with the words that are no symbol of their own.
    known and log_known are the count and sum of log10(c + 1) over the tokens that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = {w: i + 1 for i, (w, _) in enumerate(frequent)}
        logs = np.log10(np.array([end_count, *[c for _, c in frequent], *[0] * (words + classes - len(frequent))]) + 1.0)
        classed: dict[str, int] = {}

        def rare_symbol(word: str) -> int:
            if len(classed) > 100_000:
                classed.clear()
            out = classed[word] = words + 1 + zlib.crc32(word.encode()) % classes
            return out

        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for text in part.column("text").to_pylist():
                    tokens = split_words(text or "")
                    ids = [symbol.get(w) or classed.get(w) or rare_symbol(w) for w in tokens]
                    ids.append(0)
                    ids = np.array(ids, np.uint16)
                    rows.append((len(ids), logs[ids].sum(), ids.tobytes(), [tokens[i] for i in np.flatnonzero(ids > words)]))
                known = [n - len(rare) - (end_count == 0) for n, _, _, rare in rows]
                n, log, symbols, rare = zip(*rows)
                columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(log, pa.float64()), pa.array(symbols, pa.binary()), pa.array(rare, pa.list_(pa.string()))]
                kept = [part.column(c) for c in ("rid", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=["rid", "doc_id", "held_out", "n_tokens", "known", "log_known", "symbols", "rare"])

    return docs.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "held_out", "text").mapInArrow(run, ENCODED)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Row ids and sequences of similar length, about TOGETHER tokens at a time."""

    def grouped() -> Iterator[tuple[list, list[np.ndarray]]]:
        for group in alike(sequences, TOGETHER):
            yield [ids[i] for i in group], [sequences[i] for i in group]

    ids, sequences, n = [], [], 0
    for batch in batches:
        for rid, raw in zip(batch.column("rid").to_pylist(), batch.column("symbols").to_pylist()):
            ids.append(rid)
            sequences.append(np.frombuffer(raw, np.uint16))
            n += len(sequences[-1])
            if n >= GATHERED:
                yield from grouped()
                ids, sequences, n = [], [], 0
    yield from grouped()


def baum_welch(encoded: DataFrame, model: Model) -> Model:
    """One pass over every sequence of encoded. A task's expected counts leave it as one row per symbol it met; Spark
    sums them, and the sums, as many as the model has symbols, make the next model on the driver."""
    k, size = len(model.start), len(model.frequency)
    names = [f"s{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
        for _, sequences in _gathered(batches):
            for sums, new in zip((start, moves, emitted), model.expected(Packed(sequences))):
                sums += new
        met = np.flatnonzero(emitted.sum(1))
        symbol = np.concatenate([met, -1 - np.arange(k + 1)]).astype(np.int32)
        rows = np.concatenate([emitted[met], moves, start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(symbol), *[pa.array(rows[:, j]) for j in range(k)]], names=["symbol", *names])

    sums = encoded.select("rid", "symbols").mapInArrow(run, "symbol int, " + ", ".join(f"{c} double" for c in names))
    found = sums.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    table = np.zeros((size + k + 1, k))
    table[found["symbol"].to_numpy()] = found[names].to_numpy()  # negative symbols count from the end
    return model.next(table[-1 - k], np.stack([table[-1 - i] for i in range(k)]), table[:size])


def sequence_scores(encoded: DataFrame, model: Model) -> DataFrame:
    """rid and log10 of the exact probability of its symbol sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sequences in _gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.log10_likelihood(sequences))], names=["rid", "chain"])

    return encoded.select("rid", "symbols").mapInArrow(run, "rid long, chain double")


def score_documents(docs: DataFrame, words: int = WORDS, classes: int = CLASSES, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """docs (doc_id, held_out, text): scored by a model learnt from those that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    train = docs.filter(~F.col("held_out"))
    counts = materialize(word_counts(train))
    spark, ends = docs.sparkSession, train.count()
    frequent = [(r["word"], r["c"]) for r in most_frequent(counts, words).collect()]
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, types = n_words + ends, n_types + (1 if ends else 0)

    # shares of rare words in their classes
    known = spark.createDataFrame([(w,) for w, _ in frequent], "word string")
    rare = counts.join(F.broadcast(known), "word", "left_anti") if frequent else counts
    class_of = lambda w: (F.crc32(F.col(w).cast("binary")) % classes).cast("int")
    sizes = {r["class"]: (r["n"], r["v"]) for r in rare.groupBy(class_of("word").alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    of_class = [sizes.get(i, (0, 0)) for i in range(classes)]

    encoded = materialize(encode_symbols(docs, frequent, ends, words, classes))
    frequency = np.array([ends, *[c for _, c in frequent], *[0] * (words - len(frequent)), *[n for n, _ in of_class]]) + 0.5
    model = Model.first(frequency, states)
    for _ in range(passes if ends else 0):
        model = baum_welch(encoded.filter(~F.col("held_out")), model)

    heads = spark.createDataFrame([(i, float(n + v + 1)) for i, (n, v) in enumerate(of_class)], "class int, room double")
    met = encoded.select("rid", F.explode("rare").alias("word")).withColumn("class", class_of("word"))
    met = met.join(F.broadcast(heads), "class").join(rare, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10(F.col("c") + 1.0)
    met = met.groupBy("rid").agg(F.sum((F.col("c") > 0).cast("long")).alias("n_rare"), F.sum(log).alias("log_rare"), F.sum(log - F.log10("room")).alias("share"))

    out = encoded.drop("symbols", "rare").join(sequence_scores(encoded, model), "rid").join(met, "rid", "left").fillna(0, ["n_rare", "log_rare", "share"])
    base = F.col("log_known") + F.col("log_rare") - F.col("n_tokens") * F.lit(float(np.log10(total + types + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("n_rare")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("chain") + F.col("share")).alias("score"),
    )
