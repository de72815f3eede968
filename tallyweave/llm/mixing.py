"""Mixing sources to target weights.

Documents are cut into blocks of a fixed number of words. The slots of all output shards are dealt to the sources by
one pseudorandom permutation of the slots, in which each source owns a stretch as long as its need: so each shard's
source counts are the multinomial draw of its slots under the condition that all shards together meet the targets
(drawn one after the other without replacement). A slot's place in its source's stretch then goes through that source's
own permutation of block numbers, and slots and blocks meet in a join by block number. No source is ever sorted,
collected or held by one task.

Facts of sources are one row each (some 100 bytes) and are ranked and summed up in one task: meant for up to some
millions of sources.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own and comes
last; rows with equal source, id and size are interchangeable and keep one result row each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Documents packed into one run of blocks, and runs summed together in one step of the block numbering.
RUN_DOCS, RUN_GROUP = 128, 1024
#: Slots of an output shard that one row of the plan writes.
CHUNK = 4096
#: Cells of the grid that finds a slot's source, at least, and steps of the walk that keeps a permutation inside its range.
CELLS, WALK = 1024, 16


@dataclass
class Mix:
    """pieces: the part of each document in each block; slots: the source and block in each slot i of each output
    shard, in the shard's order."""

    sizes: DataFrame
    sources: DataFrame
    pieces: DataFrame
    slots: DataFrame


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row per source: its rank by code point (null last), size, documents, weight and target in words.

    share times all words are dealt in proportion to the weights; a source stops at epochs times its own words, and
    what it leaves goes to the others by weight. With the sources ordered by words per unit of weight those that stop
    come first, so running sums find them without repeated passes.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(by_name).cast("long") - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    spent, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    dealt = F.sum("source_size").over(whole) * F.lit(float(share))
    stops = F.col("cap") * (F.sum("weight").over(whole) - used) <= (dealt - spent) * F.col("weight")
    marked = ranked.withColumn("dealt", dealt).withColumn("stops", stops)
    rest = F.col("dealt") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("stops"), F.lit(0.0)).otherwise(F.col("weight"))).over(whole)
    level = F.col("weight") * F.try_divide(rest, open_weight)
    return marked.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(level)).select("source", "rank", "source_size", "docs", "weight", "target")


def permuted(position: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, chosen by key: a two-round Feistel network over an a x b grid just
    larger than n, walked again while it lands outside. Fewer than one cell in b is outside, so WALK steps leave
    less than one position in 10^19 unmoved, and none where the grid has no more spare cells than steps."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(v: Column) -> Column:
        x, y = F.floor(v / b).cast("long"), v % b
        for turn in (1, 2):
            x = (x + F.pmod(F.xxhash64(y, key, F.lit(turn)), a)) % a
            y = (y + F.pmod(F.xxhash64(x, key, F.lit(-turn)), b)) % b
        return x * b + y

    found = step(position)
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), found, lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return F.when(found < n, found).otherwise(walked)


def _earlier(window, value: str) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    block_words: int = 64,
    shard_slots: int = 1 << 16,
    seed: int = 42,
) -> Mix:
    """Plan the mix of docs (doc_id, source, text) as blocks of block_words words in shards of shard_slots slots.

    A source's need is its target in blocks, rounded, and at most epochs times its blocks. The same seed gives the same
    mix.
    """
    sizes = materialize(document_sizes(docs))
    sources = materialize(source_targets(sizes, weights, share, epochs))

    known = sources.filter("source_size > 0").select(F.col("source").alias("of"), "rank", "docs")
    order = F.xxhash64("doc_id", "size", F.lit(seed))
    packed = sizes.filter("size > 0").join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    packed = packed.withColumn("run", F.pmod(order, F.ceil(F.col("docs") / RUN_DOCS))).withColumn("order", order)

    runs = packed.groupBy("rank", "run").agg(F.ceil(F.sum("size") / block_words).cast("long").alias("blocks"))
    runs = materialize(runs.withColumn("group", F.floor(F.col("run") / RUN_GROUP)))
    groups = runs.groupBy("rank", "group").agg(F.sum("blocks").alias("blocks"))
    groups = groups.select("rank", "group", _earlier(Window.partitionBy("rank").orderBy("group"), "blocks").alias("skip"))
    within = _earlier(Window.partitionBy("rank", "group").orderBy("run"), "blocks")
    starts = runs.withColumn("within", within).join(groups, ["rank", "group"]).select("rank", "run", (F.col("skip") + F.col("within")).alias("base"))

    at = _earlier(Window.partitionBy("rank", "run").orderBy("order", "doc_id", "size"), "size")
    placed = packed.select("doc_id", "source", "size", "rank", "run", "order").withColumn("at", at).join(starts, ["rank", "run"])
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    pieces = placed.withColumn("local", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("local") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("local") + 1) * block_words)
    pieces = pieces.select(
        "doc_id", "source", "size", "rank", "run", "at", (F.col("base") + F.col("local")).alias("block"),
        (begin - F.col("at")).alias("first_word"), (end - begin).alias("words"),
    )

    stock = runs.groupBy("rank").agg(F.sum("blocks").alias("blocks"))
    asked = sources.join(stock, "rank").withColumn("expected", F.col("target") * F.col("blocks") / F.col("source_size"))
    asked = asked.withColumn("need", F.least(F.round("expected").cast("long"), F.col("blocks") * epochs)).filter("need > 0")
    high = F.sum("need").over(Window.orderBy("rank")).cast("long")
    asked = materialize(asked.select("rank", "source", "blocks", "need", high.alias("high"), (high - F.col("need")).alias("low")))
    total, found = asked.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count(F.lit(1))).first()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a number of partitions, so that AQE does not put these few rows, each of which makes CHUNK slots, into one task
    plan = spark.range(0, -(-total // CHUNK), 1, min(parts, max(1, -(-total // CHUNK)))).withColumnRenamed("id", "chunk")
    slots = plan.select(F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.lit(total), (F.col("chunk") + 1) * CHUNK) - 1)).alias("slot"))
    slots = slots.withColumn("at", permuted(F.col("slot"), F.lit(total).cast("long"), F.lit(seed).cast("long")))
    cells = max(CELLS, 4 * found)
    cell = lambda c: F.floor(F.col(c) * F.lit(cells) / F.lit(max(total, 1)))
    stretches = asked.withColumn("last", F.col("high") - 1).withColumn("cell", F.explode(F.sequence(cell("low"), cell("last")))).drop("last")
    slots = slots.withColumn("cell", cell("at")).join(stretches, "cell").filter("at >= low and at < high")
    nth = F.col("at") - F.col("low")
    slots = slots.select("rank", "source", "slot", "blocks", nth.alias("nth"), F.floor(nth / F.col("blocks")).alias("epoch"))
    slots = slots.select(
        F.floor(F.col("slot") / shard_slots).alias("shard"), (F.col("slot") % shard_slots).alias("i"), "rank", "source", "epoch",
        permuted(F.col("nth") % F.col("blocks"), F.col("blocks"), F.xxhash64("rank", "epoch", F.lit(seed))).alias("block"),
    )
    return Mix(sizes, sources, pieces, slots)


def _times(mix: Mix) -> DataFrame:
    """How often each block is taken; as many rows as blocks taken, so never broadcast."""
    return mix.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).cast("int").alias("times")).hint("merge")


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: how many of its words the mix takes, repeats counted, and its source's size and target."""
    of_doc = mix.pieces.join(_times(mix), ["rank", "block"], "left").groupBy("rank", "run", "at", "doc_id", "size")
    taken = of_doc.agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    facts = mix.sources.select("rank", "source_size", "target")
    taken = taken.join(facts, "rank").select("doc_id", "size", "source_size", "target", "taken")
    facts = mix.sources.select(F.col("source").alias("of"), "source_size", "target")
    empty = mix.sizes.filter("size = 0").join(facts, F.col("source").eqNullSafe(F.col("of")))
    return taken.unionByName(empty.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def _by_row(mix: Mix, docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (rank, source, run, at, doc_id, size and more) with `row`, the row of docs that stands there. Rows of
    equal id, source and size are told apart by their texts."""
    nth = F.row_number().over(Window.partitionBy("rank", "doc_id", "size").orderBy("run", "at"))
    placed = placed.withColumn("nth", nth)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("of_doc"), F.col("source").cast("string").alias("of_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("of_size"), F.col("text").alias("of_text"), F.struct(*docs.columns).alias("row"),
    ).filter("of_size > 0")
    rows = rows.withColumn("of_nth", F.row_number().over(Window.partitionBy("of_doc", "of_source", "of_size").orderBy("of_text"))).drop("of_text")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")) & (F.col("nth") == F.col("of_nth"))
    return rows.join(placed, same).drop("of_doc", "of_source", "of_size", "of_nth")


def mixed_blocks(mix: Mix, docs: DataFrame) -> DataFrame:
    """The mix itself: one row per slot with its shard, position, source, epoch, block and words. A block has the fixed
    number of words, but for the last of each run of documents, which has what is left."""
    piece = F.struct("block", F.col("first_word").cast("int").alias("first_word"), F.col("words").cast("int").alias("words"))
    placed = mix.pieces.groupBy("rank", "run", "at", "doc_id", "source", "size").agg(F.collect_list(piece).alias("pieces"))
    rows = _by_row(mix, docs, placed).withColumn("all", F.regexp_extract_all(F.col("row")["text"], F.lit(WORD), 0))
    parts = rows.select("rank", "run", "at", "all", F.explode("pieces").alias("p"))
    parts = parts.select("rank", F.col("p.block").alias("block"), "at", F.slice("all", F.col("p.first_word") + 1, F.col("p.words")).alias("part"))
    blocks = parts.groupBy("rank", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("words"))
    out = mix.slots.join(blocks.hint("merge"), ["rank", "block"])
    return out.select("shard", F.col("i").alias("position"), "source", "epoch", "block", "words")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them, word for word; the columns are those of docs, with n_chars counted anew.

    A document of which nothing is taken goes. One whose words are all taken equally often comes as many times,
    unchanged. Any other comes as one row that holds just the words taken: its taken stretches in the order of the
    text, each on a new line, then those taken a second time, and so on. So the words of the result are those of
    the mix's slots. Rows of equal id, source and size are told apart by their texts."""
    mix = mix_sources(docs, **how)
    pieces = mix.pieces.join(_times(mix), ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    piece = F.struct(F.col("first_word").cast("int").alias("first"), F.col("words").cast("int").alias("words"), "times")
    placed = pieces.groupBy("rank", "run", "at", "doc_id", "source", "size").agg(
        F.min("times").alias("least"), F.max("times").alias("most"), F.collect_list(F.when(F.col("times") > 0, piece)).alias("pieces")
    )
    kept = _by_row(mix, docs, placed).filter("most > 0")
    even, text = F.col("least") == F.col("most"), F.col("row")["text"]
    new = F.when(even, text).otherwise(_taken_text(text, F.col("pieces"), F.col("most")))
    kept = kept.select("row", even.alias("even"), new.alias("new"), F.explode(F.sequence(F.lit(1), F.when(even, F.col("most")).otherwise(1))).alias("copy"))
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("even"), own["n_chars"]).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[own[c].alias(c) for c in docs.columns])


def _taken_text(text: Column, pieces: Column, most: Column) -> Column:
    """The words of pieces (first, words, times) as text: in each turn from 1 to most the pieces taken as often,
    neighbours joined as they stand in text."""
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    ordered = F.array_sort(pieces)

    def turn(words: Column, n: Column) -> Column:
        taken = F.filter(ordered, lambda p: p["times"] >= n)
        stretches = F.aggregate(
            taken,
            F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("parts")),
            lambda done, p: F.struct(
                (p["first"] + p["words"]).alias("end"),
                F.concat(
                    done["parts"],
                    F.when((done["end"] >= 0) & (done["end"] != p["first"]), F.array(F.lit("\n"))).otherwise(F.array().cast("array<string>")),
                    F.slice(words, p["first"] + 1, p["words"]),
                ).alias("parts"),
            ),
        )
        return F.rtrim(F.array_join(stretches["parts"], ""))

    # words are cut once a text, as the one element of an array
    return F.transform(F.array(words), lambda w: F.array_join(F.transform(F.sequence(F.lit(1), most), lambda n: turn(w, n)), "\n"))[0]
