"""Toxic spans by a linear-chain conditional random field.

A bounded sample of labelled documents teaches three things: which tokens go with toxic documents (by a lower
confidence limit of their log odds), a two-state chain over tokens whose features are the grades of a token and its
neighbours, and how a document's marginals combine to a score. Token labels follow from the documents': in a toxic
document the graded tokens are offending, elsewhere none is. Every document is one chain, in fitting and in scoring:
forward-backward marginals of all its tokens give its score, and tokens likelier offending than not give offsets.

Tokens are runs of letters with A to Z lower-cased, so that offsets are those of the text itself.

Defined cases: a null or empty text has no tokens and gets the score of no evidence; without labels of both kinds, or
without a token that tells them apart, nothing is known to offend and every score is low; repeated labels of a document count once, as toxic if any is; equal
rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import Packed, alike

TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled documents of each kind that the model is fitted on, at most; each is drawn by a hash of its id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 4000
#: Documents of the sample that the chain's 18 weights are fitted on, at most, drawn likewise; grades and the document
#: score are fitted on all.
CHAINS = 1200
#: Standard errors below the log odds, and the limits that part its grades; only graded tokens are kept.
ERRORS, GRADES = 2.0, (0.3, 1.0, 2.0)
LEVELS = len(GRADES) + 1
#: Parts of the sample; a document meets the grades that the other parts gave, so that chance finds earn no weight.
FOLDS = 4
#: Evidence that varies less than this is not blown up to a standard deviation of 1.
LEAST_SPREAD = 0.05
#: Tokens within which offending ones count together: a passage, however long its document is.
PASSAGES = (32, 64, 128)
#: Columns of the evidence that a document score may look at; cross-validation over the training sample picks one form.
FORMS = ((0, 1, 2, 5), (0, 1, 3, 5), (0, 1, 4, 5), (0, 1, 5), (0, 1, 3))
#: Tokens whose chains are walked together.
TOGETHER = 200_000


def features(grades: np.ndarray) -> np.ndarray:
    """One number for each token from the grades of the one before it, itself and the one after it; beyond a
    document's ends stand ordinary tokens. It is 0 where none of the three is graded."""
    before, after = np.zeros_like(grades), np.zeros_like(grades)
    before[1:], after[:-1] = grades[:-1], grades[1:]
    return (before.astype(np.int16) * LEVELS + grades) * LEVELS + after


@dataclass
class Field:
    """grade of each kept token; weights of a token's, its left and its right neighbour's grade for state 1; the
    chain's transition and start weights; and the document score's weights."""

    grades: dict[str, int]
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    move: np.ndarray
    start: np.ndarray
    document: np.ndarray

    @classmethod
    def blank(cls, grades: dict[str, int]) -> Field:
        """A field in which offending tokens are rare everywhere."""
        return cls(grades, *[np.zeros(LEVELS) for _ in range(3)], np.array([[0.0, -4.0], [0.0, -4.0]]), np.array([0.0, -4.0]), np.array([-4.0] + [0.0] * (len(PASSAGES) + 2)))

    def potentials(self) -> np.ndarray:
        """exp of the weight of state 1 for every feature."""
        f = np.arange(LEVELS**3)
        return np.exp(self.left[f // LEVELS**2] + self.own[f // LEVELS % LEVELS] + self.right[f % LEVELS])

    def marginals(self, chains: Packed, weight: np.ndarray | None = None):
        """Probability of state 1 at every token of chains, packed. With a weight for each chain (in their packed order)
        also the weighted sum of the expected transitions."""
        shown = np.ones((len(chains.values), 2))
        shown[:, 1] = self.potentials()[chains.values]
        move, start, steps = np.exp(self.move), np.exp(self.start), chains.steps()
        ahead, told, pairs = np.empty_like(shown), np.empty_like(shown), np.zeros((2, 2))
        for t, a, b in steps:
            now = shown[a:b] * (start if t == 0 else ahead[last : last + b - a] @ move)
            ahead[a:b] = now / (now[:, :1] + now[:, 1:])
            last = a
        back = np.ones((len(chains.order), 2))
        for t, a, b in reversed(steps):
            told[a:b] = back[: b - a]
            here = shown[a:b] * back[: b - a]
            if t and weight is not None:
                before = ahead[chains.begin[t - 1] : chains.begin[t - 1] + b - a]
                share = weight[: b - a] / np.einsum("ni,ij,nj->n", before, move, here)
                pairs += move * ((before * share[:, None]).T @ here)
            new = here @ move.T
            back[: b - a] = new / (new[:, :1] + new[:, 1:])
        both = ahead * told
        out = both[:, 1] / both.sum(1)
        return out if weight is None else (out, pairs)

    def of_documents(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The marginals of every token of each sequence of features."""
        out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
        for group in alike(sequences, TOGETHER):
            chains = Packed([sequences[i] for i in group])
            for i, p in zip(group, chains.unpacked(self.marginals(chains))):
                out[i] = p
        return out

    def evidence(self, p: np.ndarray) -> np.ndarray:
        """What a document's score may look at: its surest token, the offending tokens expected in its worst passage of
        each length, and their density. Only tokens likelier offending than not are summed: the small marginals of plain
        tokens, and finds far apart, would add up over a very long text."""
        sums = np.concatenate([[0.0], np.cumsum(np.where(p >= 0.5, p, 0.0))])
        worst = [(sums[n:] - sums[: len(sums) - n]).max() for n in (min(passage, len(p)) for passage in PASSAGES)]
        return np.array([1.0, p.max(initial=0.0), *np.log1p(worst), np.log1p(100 * sums[-1] / max(len(p), 1))])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.document, -30, 30)))


class Judge:
    """Marginals and scores of texts. Documents without a graded token differ only in their length, so each length is
    worked out once and remembered as its evidence; their tokens are all likelier not offending."""

    def __init__(self, field: Field):
        self.field, self.plain = field, {}

    def judged(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """The evidence of each sequence, and its marginals where it has a graded token."""
        odd = [bool(s.any()) for s in sequences]
        new = sorted({len(s) for s, o in zip(sequences, odd) if not o} - self.plain.keys())
        marginals = self.field.of_documents([np.zeros(n, np.int16) for n in new] + [s for s, o in zip(sequences, odd) if o])
        self.plain |= {n: self.field.evidence(p) for n, p in zip(new, marginals)}
        rest = iter(marginals[len(new) :])
        found = [next(rest) if o else None for o in odd]
        return np.array([self.plain[len(s)] if p is None else self.field.evidence(p) for s, p in zip(sequences, found)]), found


def lowered(text: str | None) -> str:
    """text with A to Z lower-cased, character for character."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(lowered(text))


def graded(tokens: list[str], grades: dict[str, int]) -> np.ndarray:
    return np.frombuffer(bytes([grades.get(w, 0) for w in tokens]), np.uint8)


def labelled_sample(labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> DataFrame:
    """doc_id and toxic of at most so many documents of each kind, with the weight that restores their shares."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("weight", F.lit(max(1.0, count.get(t, 0) / n))) for t, n in ((1, toxic), (0, clean))]
    return parts[0].unionByName(parts[1])


def token_grades(sample: DataFrame) -> tuple[list[dict[str, int]], int, int]:
    """Grades of the tokens of sample (text, toxic, fold), and its toxic and clean documents: for each fold those that
    the other folds tell, and last those of all. A token counts once a document, and once for all documents where it
    stands between the same two others: those are copies of one passage."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: set[tuple[str, int, int, int]] = set()
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                tokens = ["", *tokens_of(text), ""]
                first = dict(zip(reversed(tokens[1:-1]), range(len(tokens) - 2, 0, -1)))
                met.update((w, toxic, crc32(f"{tokens[i - 1]} {tokens[i + 1]}".encode()), fold) for w, i in first.items())
            columns = zip(*met) if met else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int32()))], names=["word", "toxic", "context", "fold"])

    totals = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    of = lambda toxic, without: sum(n for (t, f), n in totals.items() if t == toxic and f != without)
    places = sample.select("text", "toxic", "fold").mapInArrow(count, "word string, toxic int, context long, fold int")
    places = places.groupBy("word", "toxic", "context").agg(F.min("fold").alias("fold"))
    seen = lambda toxic, without: F.count_if((F.col("toxic") == toxic) & (F.col("fold") != without))
    counts = places.groupBy("word").agg(*[seen(t, f).alias(f"c{t}_{f}") for t in (0, 1) for f in range(FOLDS + 1)])

    def low(without: int):
        t, n = F.col(f"c1_{without}") + 0.5, F.col(f"c0_{without}") + 0.5
        return F.log(t / (of(1, without) + 1.0)) - F.log(n / (of(0, without) + 1.0)) - ERRORS * F.sqrt(1 / t + 1 / n)

    lows = counts.select("word", *[low(f).alias(f"low{f}") for f in range(FOLDS + 1)])
    kept = lows.filter(F.greatest(*[f"low{f}" for f in range(FOLDS + 1)]) >= GRADES[0]).collect()
    grades = [{r["word"]: int(np.searchsorted(GRADES, r[f"low{f}"], "right")) for r in kept if r[f"low{f}"] >= GRADES[0]} for f in range(FOLDS + 1)]
    return grades, of(1, FOLDS), of(0, FOLDS)


def fit(docs: DataFrame, sample: DataFrame, rounds: int = 60) -> Field:
    """The model from the documents of sample (doc_id, toxic, weight), of bounded number; equal texts count once."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("of")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.max("weight").alias("weight"))
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("of"), F.lit(FOLDS)).cast("int")).cache()
    grades, bad, good = token_grades(chosen)

    def shortened(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [features(graded(tokens_of(t), grades[f])) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]

    def chains_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [x.tobytes() for x in shortened(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.binary()), batch.column("toxic"), pa.array([crc32(x) for x in short], pa.int64())], names=["features", "toxic", "drawn"])

    told = chosen.select("text", "toxic", "weight", "fold")
    drawn = told.mapInArrow(chains_of, "features binary, toxic int, drawn long").orderBy("drawn", "toxic", "features").limit(CHAINS).collect()
    field = Field.blank(grades[-1])
    if not (bad and good and grades[-1]):
        chosen.unpersist()
        return field
    # equal chains of equal labels, as those without graded tokens often are, once
    times = Counter((r["toxic"], bytes(r["features"])) for r in drawn)
    unique = sorted((t, x, n) for (t, x), n in times.items() if x)
    if unique:
        sequences = [np.frombuffer(x, np.int16) for _, x, _ in unique]
        _ascend(field, Packed(sequences), np.array([t for t, _, _ in unique]), np.array([n for _, _, n in unique], float), rounds)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(field)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                evidence = judge.judged(shortened(part))[0]
                yield pa.RecordBatch.from_arrays([pa.array(list(evidence), pa.list_(pa.float64())), *(part.column(c) for c in ("toxic", "weight", "fold"))], names=["evidence", "toxic", "weight", "fold"])

    # a few numbers a document of the sample
    rows = sorted(told.mapInArrow(weighed, "evidence array<double>, toxic int, weight double, fold int").collect(), key=tuple)
    chosen.unpersist()
    evidence, toxic, weight, fold = (np.array([r[c] for r in rows], float) for c in ("evidence", "toxic", "weight", "fold"))
    field.document = document_weights(evidence, toxic, weight, fold)
    return field


def document_weights(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Weights of the form of FORMS that cross-validation over the folds of the sample prefers, 0 for other columns: each
    fold is judged by what the others teach, and the form of the greatest likelihood is fitted on all."""

    def likelihood(columns: list[int]) -> float:
        total = 0.0
        for f in range(FOLDS):
            rest, own = fold != f, fold == f
            if own.any() and len(set(toxic[rest])) == 2:
                z = evidence[own][:, columns] @ logistic(evidence[rest][:, columns], toxic[rest], weight[rest])
                total += float((weight[own] * (toxic[own] * z - np.logaddexp(0, z))).sum())
        return total

    form = list(max(FORMS, key=lambda columns: likelihood(list(columns))))
    out = np.zeros(evidence.shape[1])
    out[form] = logistic(evidence[:, form], toxic, weight)
    return out


def logistic(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Weights of a penalised logistic regression (evidence has a column of ones first). Columns are standardised, and
    each Newton step is halved until the penalised log likelihood rises, so nearly separable evidence cannot diverge."""
    centre, spread = evidence[:, 1:].mean(0), np.maximum(evidence[:, 1:].std(0), LEAST_SPREAD)
    x = np.concatenate([evidence[:, :1], (evidence[:, 1:] - centre) / spread], 1)

    def likelihood(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (toxic * z - np.logaddexp(0, z))).sum() - penalty / 2 * (w**2).sum())

    w = np.zeros(x.shape[1])
    now = likelihood(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (toxic - p)) - penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        while (new := likelihood(w + step)) < now and np.abs(step).max() > 1e-9:
            step = step / 2
        if new <= now + 1e-9:
            break
        w, now = w + step, new
    raw = np.append(w[0] - (w[1:] * centre / spread).sum(), w[1:] / spread)
    return raw


def _ascend(field: Field, chains: Packed, toxic: np.ndarray, times: np.ndarray, rounds: int) -> None:
    """Gradient ascent (with adapted steps) on the penalised log likelihood of the states of whole chains: in toxic
    ones the graded tokens are offending."""
    values, weight = chains.values, times[chains.order] / times.sum()
    row = np.empty(len(values), np.int64)
    row[chains.place] = chains.row
    mass = weight[row]
    parts = {"left": values // LEVELS**2, "own": values // LEVELS % LEVELS, "right": values % LEVELS}
    state = (parts["own"] > 0) & (toxic[chains.order][row] == 1)
    first_tokens = chains.active[0] if len(chains.active) else 0

    def gather(p: np.ndarray, pairs: np.ndarray) -> dict[str, np.ndarray]:
        sums = {name: np.bincount(x, p * mass, LEVELS) for name, x in parts.items()}
        starts = (p[:first_tokens] * mass[:first_tokens]).sum()
        return sums | {"move": pairs, "start": np.array([mass[:first_tokens].sum() - starts, starts])}

    seen = np.zeros((2, 2))
    for t, a, b in chains.steps()[1:]:
        before = state[chains.begin[t - 1] : chains.begin[t - 1] + b - a]
        seen += np.bincount(2 * before + state[a:b], mass[a:b], 4).reshape(2, 2)
    want = gather(state.astype(float), seen)
    first, second = ({k: np.zeros_like(v) for k, v in want.items()} for _ in range(2))
    for turn in range(1, rounds + 1):
        have = gather(*field.marginals(chains, weight))
        for name in want:
            value = getattr(field, name)
            slope = want[name] - have[name] - 1e-4 * value
            first[name] = 0.9 * first[name] + 0.1 * slope
            second[name] = 0.99 * second[name] + 0.01 * slope**2
            setattr(field, name, value + 0.2 * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.99**turn)) + 1e-8))


SCORED = "score double, spans array<struct<start:int,end:int,probability:double>>"


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """docs (any columns with text) with score and the spans (start, end, probability) of offending tokens."""
    from pyspark.sql import types as T

    plain = docs.drop("score", "spans")
    schema = T.StructType([*plain.schema.fields, *T._parse_datatype_string(SCORED).fields])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(field)
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                texts = [lowered(t) for t in part.column("text").to_pylist()]
                evidence, marginals = judge.judged([features(graded(TOKEN.findall(t), field.grades)) for t in texts])
                spans = []
                for text, p in zip(texts, marginals):
                    hit = set(np.flatnonzero(p >= 0.5).tolist()) if p is not None else set()
                    spans.append([{"start": m.start(), "end": m.end(), "probability": float(p[i])} for i, m in enumerate(TOKEN.finditer(text)) if i in hit] if hit else [])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(field.score(evidence), pa.float64()), pa.array(spans, spans_type)], names=[*part.schema.names, "score", "spans"])

    return plain.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs whose score stays below threshold, by a model fitted on labels; the columns are those of docs."""
    field = fit(docs, labelled_sample(labels))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names).withColumnRenamed(names[at], "text")
    names[at] = "text"
    return score_documents(plain, field).filter(F.col("score") < threshold).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
