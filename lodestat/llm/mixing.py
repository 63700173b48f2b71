"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source, its documents one after another in the order of a hash, are packed into blocks of
`block_words` (the last of a source may be shorter). Output shards of `shard_slots` slots each draw how many slots
every source gets from a multinomial distribution with the sources' target shares; what a source has drawn above its
quota of slots goes to sources below theirs, so that each source comes to its target to the word. The slots of a
source map to its blocks through pseudorandom permutations of the block indices, a new one for each pass over the
source, and are joined to the blocks by index. The last slot of a source may take a part of its block.

Targets: sources by code point, null last, weigh `weights`, repeating; they share the whole size, no target is above
`max_repeats` times its source's size, and the excess is shared again by weight.

Nulls: null texts have no words and are taken 0 times; the null source is a source. Repeated rows are documents of
their own. An empty table gives an empty result. Everything follows from hashes and seeds: reruns agree.
Very long texts have many blocks and are cut whole. Columns of the input with the names of the results are replaced.
The driver holds one row for each source (some hundred bytes), never one for a document; documents get what is known
of their source by a join, a broadcast one when the sources are few (BROADCAST_SOURCES).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running_offsets, saved

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
BLOCK_WORDS, SHARD_SLOTS, SEED = 256, 8192, 17
BROADCAST_SOURCES = 20_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> list[float]:
    """Words that each source should give, for sources in their order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [float(max_repeats * s) for s in sizes]
    out, open_ = list(caps), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = {i for i in open_ if unit * weight[i] >= caps[i]}
        if not over:
            for i in open_:
                out[i] = unit * weight[i]
            break
        left = max(0.0, left - sum(caps[i] for i in over))
        open_ -= over
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Where a pseudorandom permutation of 0..size-1, picked by the key, takes each index: a Feistel network over the
    next even number of bits, walked until the value is in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            mixed = (right + k + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


class Recipe:
    """Targets, quotas and slots of each source."""

    def __init__(self, names: list[str | None], sizes: list[int], block_words: int, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS):
        self.names, self.block = names, block_words
        self.size = np.array(sizes, np.int64)
        self.target = np.array(targets(sizes, weights, max_repeats), float)
        words = np.minimum(np.rint(self.target).astype(np.int64), max_repeats * self.size)
        size = np.maximum(self.size, 1)
        self.full, self.whole = self.size // block_words, -(-self.size // block_words)  # full blocks, and all of them
        self.passes, self.rest = words // size, words % size
        self.slots = self.passes * self.whole + -(-self.rest // block_words)

    def slot(self, source: np.ndarray, j: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words of the j-th slots of sources."""
        whole = np.maximum(self.whole[source], 1)
        turn, i = j // whole, j % whole
        last = turn >= self.passes[source]  # the pass that does not take the whole source
        turn = np.where(last, self.passes[source], turn)
        i = np.where(last, j - self.passes[source] * whole, i)
        over = np.where(last, self.full[source], whole)
        short = i >= over  # in the last pass the shorter block comes after all full ones
        block = np.where(short, i, permuted(np.where(short, 0, i), np.maximum(over, 1), (source * 1_000_003 + turn * 7919 + seed)))
        length = np.minimum(self.block, self.size[source] - block * self.block)
        words = np.where(last, np.minimum(length, self.rest[source] - i * self.block), length)
        return turn, block, words


def recipe(sized: DataFrame, source: str, block_words: int, **rules) -> Recipe:
    rows = sorted(sized.groupBy(source).agg(F.sum("size").alias("size")).collect(), key=lambda r: (r[0] is None, r[0] or ""))  # a row for each source
    return Recipe([r[0] for r in rows], [r[1] or 0 for r in rows], block_words, **rules)


def slot_blocks(spark, mix: Recipe, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """A row for each output slot: shard, src (number of the source), pass, block and words."""
    total = int(mix.slots.sum())
    shards = max(1, -(-total // shard_slots))
    share = mix.slots / max(1, total)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = min(shard_slots, total - int(shard) * shard_slots)
                counts = np.random.Generator(np.random.PCG64([seed, int(shard)])).multinomial(n, share)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": int(shard), "src": at, "n": counts[at]})

    if not total:
        return spark.createDataFrame([], "shard long, src long, pass long, block long, words long")
    drawn = saved(spark.range(0, shards, 1, min(shards, 1024)).mapInPandas(draw, "shard long, src long, n long"))
    sums = np.zeros(len(mix.slots), np.int64)
    for src, n in drawn.groupBy("src").agg(F.sum("n")).collect():  # one row for each source
        sums[src] = n
    # Slots that a source has drawn above its quota are dealt, in order, to the sources below theirs.
    extra, lack = np.maximum(sums - mix.slots, 0), np.maximum(mix.slots - sums, 0)
    extra_from, lack_to = np.cumsum(extra) - extra, np.cumsum(lack)
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = firsts.select("shard", "src", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            src, j = batch["src"].to_numpy(np.int64).copy(), batch["j"].to_numpy(np.int64).copy()
            over = np.flatnonzero(j >= mix.slots[src])
            rank = extra_from[src[over]] + j[over] - mix.slots[src[over]]
            to = np.searchsorted(lack_to, rank, "right")
            src[over], j[over] = to, mix.slots[to] - (lack_to[to] - rank)
            turn, block, words = mix.slot(src, j, seed)
            yield pd.DataFrame({"shard": batch["shard"], "src": src, "pass": turn, "block": block, "words": words})

    return rows.mapInPandas(place, "shard long, src long, pass long, block long, words long")


def _with_sources(docs: DataFrame, mix: Recipe, source: str) -> DataFrame:
    """The rows with src, source_size and target of their source in the recipe."""
    known = pd.DataFrame({"_of": pd.Series(mix.names, dtype=object), "src": np.arange(len(mix.names)), "source_size": mix.size, "target": mix.target})
    sources = docs.sparkSession.createDataFrame(list(known.itertuples(index=False, name=None)), "_of string, src long, source_size long, target double")
    sources = F.broadcast(sources) if len(known) <= BROADCAST_SOURCES else sources
    return docs.drop("src", "source_size", "target").join(sources, F.col(source).eqNullSafe(F.col("_of"))).drop("_of")


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """Each document's stretches of blocks: src, block, lo and hi within the block; first, the words before the stretch."""
    blocks = F.sequence(F.floor(F.col("off") / block_words), F.floor((F.col("off") + F.col("size") - 1) / block_words))
    cut = placed.where("size > 0").select("src", "off", "size", F.explode(blocks).alias("block"))
    lo = F.greatest(F.col("off") - F.col("block") * block_words, F.lit(0))
    hi = F.least(F.col("off") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    return cut.select("src", "off", "block", lo.alias("lo"), hi.alias("hi"), (F.col("block") * block_words + lo - F.col("off")).alias("first"))


def _planned(docs: DataFrame, source: str, text: str, order: list[Column], block_words: int, **rules) -> tuple[DataFrame, Recipe]:
    """The documents with size, src and off, the words of the source before theirs, saved; and the recipe."""
    sized = saved(docs.select("*", n_words(F.col(text)).alias("size")).drop(text))
    mix = recipe(sized, source, block_words, **rules)
    return saved(running_offsets(_with_sources(sized, mix, source), ["src"], order, F.col("size"), "off")), mix


def mix_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS, **rules) -> DataFrame:
    """A row for each document: id, source, size, source_size, target (its source's) and taken."""
    whole = docs.select(F.col(id_column), F.col(source), F.xxhash64(text).alias("text_hash"), F.col(text))
    placed, mix = _planned(whole, source, text, [F.col(id_column), F.col("text_hash")], block_words, **rules)
    slots = slot_blocks(docs.sparkSession, mix)
    blocks = slots.groupBy("src", "block").agg(F.sum((F.col("words") == block_words).cast("long")).alias("wholes"), F.collect_list(F.when(F.col("words") < block_words, F.col("words"))).alias("parts"))
    pieces = _pieces(placed, block_words).join(blocks.hint("merge"), ["src", "block"])
    part = F.aggregate("parts", F.lit(0).cast("long"), lambda s, w: s + F.greatest(F.least(w, F.col("hi")) - F.col("lo"), F.lit(0)))
    taken = pieces.groupBy("src", "off").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("wholes") + part).alias("_taken")).withColumnsRenamed({"src": "_src", "off": "_off"})
    out = placed.join(taken, (F.col("src") == F.col("_src")) & (F.col("off") == F.col("_off")) & (F.col("size") > 0), "left")
    return out.select(id_column, source, "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"))


def cut(text: str, stretches: list[tuple[int, int, int]]) -> list[str]:
    """A text for each pass: its taken words, each run of neighbouring words as it stands in the text.

    stretches: (pass, first word, end) in order. A pass that takes every word gives the text unchanged.
    """
    spans: list[tuple[int, int]] = []
    at, inside = 0, False
    for i, c in enumerate(text):
        white = c in " \t\n\x0b\x0c\r"
        if inside and white:
            spans.append((at, i))
        elif not inside and not white:
            at = i
        inside = not white
    if inside:
        spans.append((at, len(text)))
    out: dict[int, list[list[int]]] = {}
    for turn, a, b in stretches:
        runs = out.setdefault(turn, [])
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return [text if runs == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs) for _, runs in sorted(out.items())]


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", block_words: int = BLOCK_WORDS, **rules) -> DataFrame:
    """The mix as documents: for each pass over a source, each document with the words that the pass takes of it.

    Columns are those of the input; n_chars, if there is such a column, is that of the new text. Documents that no
    pass takes a word of are left out.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keys = [F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text, F.col(id_column).isNull(), F.col(source)).alias("_hash")]
    copy = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))
    whole = docs.select(row, *keys)
    narrow = docs.select(*keys, F.col(source), F.col(text))
    placed, mix = _planned(narrow, source, text, [F.col("_id"), F.col("_hash")], block_words, **rules)
    slots = slot_blocks(docs.sparkSession, mix)
    pieces = _pieces(placed, block_words).join(slots.select("src", "block", "pass", "words").hint("merge"), ["src", "block"]).where("words > lo")
    stretch = F.struct(F.col("pass"), F.col("first").alias("a"), (F.col("first") + F.least("hi", "words") - F.col("lo")).alias("b"))
    taken = pieces.groupBy("src", "off").agg(F.sort_array(F.collect_list(stretch)).alias("_cuts")).withColumnsRenamed({"src": "_src", "off": "_off"})
    plan = placed.join(taken, (F.col("src") == F.col("_src")) & (F.col("off") == F.col("_off")) & (F.col("size") > 0))
    number = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("src", "off"))
    plan = plan.select("_id", "_hash", "_cuts", number.alias("_copy"), "src", "off").drop("src", "off")
    if placed.count() > placed.select("_id", "_hash").distinct().count():
        chosen = whole.withColumn("_copy", copy).join(plan, ["_id", "_hash", "_copy"])
    else:
        chosen = whole.join(plan.hint("shuffle_hash"), ["_id", "_hash"])

    @F.pandas_udf("array<string>")
    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for whole_texts, cuts in batches:
            yield pd.Series([cut(t, [(c["pass"], c["a"], c["b"]) for c in cs]) for t, cs in zip(whole_texts, cuts)])

    out = chosen.withColumn("_new", F.explode(texts(F.col(f"_row.{text}"), F.col("_cuts"))))
    columns = []
    for c in docs.columns:
        new = F.col("_new") if c == text else F.length("_new").cast(docs.schema[c].dataType) if c == n_chars else F.col(f"_row.`{c}`")
        columns.append(new.alias(c))
    return out.select(*columns)
