"""Language-model scores of documents: a smoothed unigram base and a log-bilinear neural model.

Words are counted over all training documents. Every word has a class: the HEAD most frequent ones their own, the
other words of the table one of BANDS classes of neighbouring counts and equal weight, all other words one together;
the end of a text has a class too. The neural model gives the probability of a token's class after the two classes
before it; within a class of several words a word has its part (count + 0.5) of the class's, with 0.5 for the words
that training has not seen.

Texts are read twice: to count, and to write each text's classes, from which the model learns and scores. Training
documents are dealt by a hash of id and text to parts, whose number grows with the square root of the tokens. Each
part takes the model of the round before through its documents, in the order of their hash, with noise-contrastive
estimation; the parts' models are averaged in order, weighted by tokens. Every part is in one of ROUNDS rounds. So
neither model nor scores depend on how the rows are spread over tasks.

Counts of the most frequent words, some TABLE_WORDS, go to the tasks as a table (a bound on what is broadcast; of
words of one count, those of least hash are taken when not all find room); tokens of other words are joined to their
counts by a shuffle, so scores take the counts of all words.

Nulls: a null text is empty and has one token, the end; a null id is read as empty text and so trains. Repeated rows
are documents of their own. With no training documents, all words are unknown. An empty table gives an empty result.
Very long texts are read whole; a task holds the classes of one text, two bytes a word. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .neural_kernel import CONTEXT, LogBilinear

END, END_CLASS, RARE_CLASS, FIRST_HEAD = b"\n", 0, 1, 2
HEAD, BANDS = 2000, 46
TABLE_WORDS, ROUNDS = 50_000, 2
#: Parts that training documents are dealt to, for each square root of a million tokens.
PARTS = 4
#: Distinct words that a counting task holds, and tokens that a model is trained on or scores at once.
COUNTED_WORDS, TRAIN_TOKENS, SCORE_TOKENS = 300_000, 250_000, 500_000
FOLDS, HELD_OUT = 5, 1


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(id_column: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column text; the end of a text is the word of one line feed. Saved."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words(text))
                if len(seen) > COUNTED_WORDS:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen = Counter()
            seen[END] += len(batch)
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return saved(texts.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Lexicon:
    """Counts and classes of the most frequent words, and the weight of every class."""

    def __init__(self, counts: DataFrame, head: int = HEAD, bands: int = BANDS, table_words: int = TABLE_WORDS):
        end = F.col("word") == F.lit(END)
        tokens, types, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(end, F.col("n")))).first()
        self.tokens, self.types, self.ends = tokens or 0, types, ends or 0
        top = self._frequent(counts.where(~end), table_words)
        self.index = {w: i for i, (w, _) in enumerate(top)}
        numbers = np.array([n for _, n in top], float) + 0.5
        self.logs = np.log10(numbers)
        rest = numbers[head:]
        bands = min(bands, len(rest))
        band = np.minimum(np.floor((np.cumsum(rest) - rest) / max(rest.sum(), 1) * bands), bands - 1).astype(np.int16)
        self.classes = np.concatenate([np.arange(FIRST_HEAD, FIRST_HEAD + len(top[:head])), FIRST_HEAD + head + band]).astype(np.int16)
        #: Class: the counts of all its words and a half for each; a half for the words that training has not seen.
        self.weight = np.zeros(FIRST_HEAD + len(top[:head]) + bands)
        np.add.at(self.weight, self.classes, numbers)
        self.weight[END_CLASS] = self.ends + 0.5
        unlisted = self.tokens - self.ends - (numbers - 0.5).sum()
        self.weight[RARE_CLASS] = unlisted + 0.5 * (self.types - (self.ends > 0) - len(top)) + 0.5
        self.weight = np.maximum(self.weight, 0.5)
        #: What a word of the table has of its class; 0 for words with a class of their own.
        self.inside = np.where(np.arange(len(top)) < head, 0.0, self.logs - np.log10(self.weight[self.classes]))
        self.rare_log = float(np.log10(self.weight[RARE_CLASS]))
        self.end_log = float(np.log10(self.ends + 0.5))

    @staticmethod
    def _frequent(counts: DataFrame, room: int) -> list[tuple[bytes, int]]:
        """The words of highest count, some `room` of them, the most frequent first; of the last count, those of least hash."""
        levels = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(room).collect()
        least, share = None, 1.0
        for n, many in levels:
            least, share = n, min(1.0, room / many)
            room -= many
            if room <= 0:
                break
        if least is None:
            return []
        hashed = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
        found = counts.where((F.col("n") > least) | ((F.col("n") == least) & hashed)).collect()
        return sorted(((bytes(w), n) for w, n in found), key=lambda x: (-x[1], x[0]))

    def placed(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Place in the table (-1: none) and class of each word, and the words that are not in the table."""
        at = np.fromiter((self.index.get(w, -1) for w in tokens), np.int32, len(tokens))
        none = np.flatnonzero(at < 0)
        kind = self.classes[at] if len(self.classes) else np.full(len(at), RARE_CLASS, np.int16)
        kind[none] = RARE_CLASS
        return at, kind, [tokens[i] for i in none.tolist()]


def grouped(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of texts, each with its end; before a text stand ends."""
    pad = np.full(CONTEXT, END_CLASS, np.int16)
    line = np.concatenate([x for c in classes for x in (pad, c, pad[:1])])
    stops = np.cumsum([len(c) + CONTEXT + 1 for c in classes])
    real = np.ones(len(line), bool)
    for k in range(CONTEXT):
        real[np.r_[0, stops[:-1]] + k] = False
    at = np.flatnonzero(real)
    return np.stack([line[at - k - 1] for k in range(CONTEXT)], 1), line[at]


def classed(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, fold and hash of each row of (doc_id, text, fold), its classes, and what it gets beside the model. Saved."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                at, kind, rare = lex.placed(words(text))
                listed = at[at >= 0]
                logs, inside = (lex.logs[listed].sum(), lex.inside[listed].sum()) if len(listed) else (0.0, 0.0)
                out.append((len(at) + 1, len(listed) + (lex.ends > 0), logs + lex.end_log, inside - len(rare) * lex.rare_log, kind.tobytes(), rare))
            frame = pd.DataFrame(out, columns=["n_tokens", "known", "base", "inside", "classes", "rare"])
            yield pd.concat([batch[["doc_id", "fold", "hash"]].reset_index(drop=True), frame], axis=1)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    hashed = rows.select("doc_id", "fold", F.xxhash64("doc_id", "text").alias("hash"), "text")
    return saved(hashed.mapInPandas(read, f"doc_id {id_type}, fold long, hash long, n_tokens long, known long, base double, inside double, classes binary, rare array<binary>").withColumn("_row", F.monotonically_increasing_id()))


def train(learning: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> LogBilinear:
    """The model, from the columns hash and classes of all training documents."""
    model = LogBilinear(lexicon.weight)
    parts = max(rounds, math.ceil(PARTS * math.sqrt(lexicon.tokens / 1e6)))
    dealt = learning.select(F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(parts)).alias("part"), "hash", "classes")
    for turn in range(rounds):
        now = model

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, of, seen, waiting, size = None, None, 0, [], 0

            def learnt() -> pd.DataFrame:
                if waiting:
                    own.train(*grouped(waiting), draw, squares)
                return pd.DataFrame({"part": [of], "tokens": [seen + size], "model": [own.flat().astype(np.float64)]})

            for batch in batches:
                for part, packed in zip(batch["part"].tolist(), batch["classes"]):
                    if part != of:
                        if own is not None:
                            yield learnt()
                        own = LogBilinear(now.noise)
                        own.load(now.flat())
                        squares, draw = [np.zeros_like(p) for p in own.parts], np.random.Generator(np.random.PCG64([turn, part]))
                        of, seen, waiting, size = part, 0, [], 0
                    waiting.append(np.frombuffer(packed, np.int16))
                    size += len(waiting[-1]) + 1
                    if size >= TRAIN_TOKENS:
                        own.train(*grouped(waiting), draw, squares)
                        seen, waiting, size = seen + size, [], 0
            if own is not None:
                yield learnt()

        mine = dealt.where(F.pmod("part", F.lit(rounds)) == turn)
        fitted = mine.repartitionByRange(-(-parts // rounds), "part").sortWithinPartitions("part", "hash").mapInPandas(fit, "part long, tokens long, model array<double>")
        at = fitted.select("part", "tokens", F.posexplode("model")).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("part", "tokens", "col"))).alias("all"))
        in_order = lambda value: F.aggregate("all", F.lit(0.0), lambda s, x: s + value(x))
        rows = at.select("pos", (in_order(lambda x: x["col"] * x["tokens"]) / in_order(lambda x: x["tokens"].cast("double"))).alias("mean")).collect()  # the parameters of one model
        if rows:
            flat = np.zeros(len(model.flat()))
            flat[[r[0] for r in rows]] = [r[1] for r in rows]
            model = LogBilinear(now.noise)
            model.load(flat)
    return model


def score_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; sizes are Lexicon's."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), fold(id_column).alias("fold"))
    held_out = F.pmod("fold", F.lit(FOLDS)) == HELD_OUT
    counts = word_counts(rows.where(~held_out))
    lexicon = Lexicon(counts, **sizes)
    noted = classed(rows, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(train(noted.where(~held_out), lexicon))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for batch in batches:
            at, n = 0, len(batch)
            packed, sums = batch["classes"].tolist(), []
            while at < n:
                classes, size = [], 0
                while at < n and size < SCORE_TOKENS:
                    classes.append(np.frombuffer(packed[at], np.int16))
                    size += len(classes[-1]) + 1
                    at += 1
                starts = np.cumsum([0, *(len(c) + 1 for c in classes[:-1])])
                sums.append(np.add.reduceat(net.log10(*grouped(classes)), starts))
            if n:
                yield batch.drop(columns="classes").assign(inside=batch["inside"] + np.concatenate(sums))

    id_type = docs.schema[id_column].dataType.simpleString()
    scored = noted.select("_row", "doc_id", held_out.alias("held_out"), "n_tokens", "known", "base", "inside", F.size("rare").alias("others"), "classes")
    scored = scored.mapInPandas(score, f"_row long, doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, inside double, others int")
    rare = noted.select("_row", F.explode("rare").alias("word")).join(counts.hint("merge"), "word")
    logs = rare.groupBy("_row").agg(F.sum(F.log10(F.col("n") + 0.5)).alias("logs"), F.count("*").alias("more"))
    out = scored.join(logs, "_row", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    out = out.withColumn("logs", F.coalesce("logs", F.lit(0.0)) + (F.col("others") - F.col("more")) * float(np.log10(0.5)))
    whole = float(np.log10(lexicon.tokens + 0.5 * (lexicon.types + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("logs") - F.col("n_tokens") * whole).alias("base_score"), (F.col("inside") + F.col("logs")).alias("score"))
