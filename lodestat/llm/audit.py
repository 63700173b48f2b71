"""Filter interaction audit: what each of five filters removes, in every order and in every part of the corpus.

Each row fails some of the filters A to E. Rows are dealt to ranges of their ids; a range has, for each part and filter,
the sorted list of the ids that fail it (a posting list), once over all rows, once over those of good quality and once
over toxic ones. The sizes of all 31 unions come from galloping k-way merges of these lists, what only one filter
catches from a galloping difference. Ranges do not overlap, so their sizes add up; the figures of all 120 orders follow
from the sums, of which a part has 32 for each family.

Nulls: a null text is empty; a null part is the part of the empty string; a row with a null id is a row like any other,
but is no copy of a smaller id, nor is any row a copy of it. Labels are taken by id: an id with several labels is good
(toxic) if one of them says so, labels without an id count for nothing. Repeated rows are rows of their own and no
copies of each other, as their ids are equal. Very long texts are read whole, each by one task. An empty table gives no
rows. Other columns are not looked at. A task holds BLOCK rows of a range at a time, a few numbers each.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Ids of a range, tasks over which its rows are dealt (one id may repeat without end), and rows that a task holds at once.
RANGE_IDS, SALTS, BLOCK = 1 << 18, 16, 1 << 17
FAMILIES = ("all", "good", "toxic")
SUBSETS = 1 << len(FILTERS)


def text_failures(text: str | None) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    few = len(words) < MIN_WORDS
    dull = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MAX_CAPITALS_PERCENT * len(text or "")
    odd = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | dull << 1 | loud << 2 | odd << 3


@F.pandas_udf(T.IntegerType())
def failures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([text_failures(t) for t in texts], dtype="int32")


def gallop(ids: list[int], key: int, low: int) -> int:
    """The first place from `low` on whose id is not below the key: steps are doubled, then the last one is halved."""
    step, high = 1, low
    while high < len(ids) and ids[high] < key:
        low, high, step = high + 1, high + step, 2 * step
    return bisect_left(ids, key, low, min(high, len(ids)))


def union_size(lists: list[list[int]]) -> int:
    """The number of distinct ids in sorted lists: the list with the least head is galloped up to the next head."""
    heads = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heads)
    size, last = 0, None
    while heads:
        head, i, at = heads[0]
        ids = lists[i]
        if len(heads) == 1:
            return size + len(ids) - at - (head == last)
        other = min(heads[1:3])[0]  # the next least is a child of the root
        stop = gallop(ids, other, at) if head < other else at + 1
        size += stop - at - (head == last)
        last = ids[stop - 1]
        if stop < len(ids):
            heapq.heapreplace(heads, (ids[stop], i, stop))
        else:
            heapq.heappop(heads)
    return size


def difference_size(ids: list[int], others: list[list[int]]) -> int:
    """The number of ids that are in none of the other lists, all sorted."""
    places, size = [0] * len(others), 0
    for key in ids:
        alone = True
        for j, other in enumerate(others):
            places[j] = at = gallop(other, key, places[j])
            if at < len(other) and other[at] == key:
                alone = False
                break
        size += alone
    return size


def interactions(ids: np.ndarray, masks: np.ndarray) -> tuple[list[int], list[int]]:
    """The size of every union of posting lists, by bits of the filters, and of what each filter alone catches."""
    order = np.argsort(ids, kind="stable")
    ids, masks = ids[order], masks[order]
    lists = [ids[masks >> f & 1 == 1].tolist() for f in range(len(FILTERS))]
    unions = [union_size([x for f, x in enumerate(lists) if s >> f & 1]) for s in range(SUBSETS)]
    return unions, [difference_size(x, [y for g, y in enumerate(lists) if g != f]) for f, x in enumerate(lists)]


def _of_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, family, n, unions, alone) of stretches of rows that are sorted by range and id."""

    def sums(block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for part, mine in block.groupby("part", sort=True):
            for family in FAMILIES:
                some = mine if family == "all" else mine[mine[family]]
                if len(some):
                    rows.append((part, family, len(some), *interactions(some["row"].to_numpy(), some["mask"].to_numpy())))
        return pd.DataFrame(rows, columns=["part", "family", "n", "unions", "alone"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= BLOCK:
            yield sums(pd.concat(held))
            held, size = [], 0
    if size:
        yield sums(pd.concat(held))


def failing_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """row (a number of its own), id, part, mask of failed filters, good and toxic, of every row. Saved.

    Texts are the same if their SHA-256 is; only texts that stand under two ids or more are joined back to rows.
    """
    judged = saved(docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        failures(F.col(text)).alias("mask"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"),
    ))
    copied = judged.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("hash", "first")
    with_copies = judged.join(copied, "hash", "left").withColumn("mask", F.col("mask") + F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0))
    flags = labels.groupBy(F.col(id_column).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    told = with_copies.join(flags, "id", "left")
    return saved(told.select(F.monotonically_increasing_id().alias("row"), "id", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))))


def set_sizes(rows: DataFrame) -> DataFrame:
    """part, family, n, sizes of the 32 unions, and of what only one filter catches, from rows of `failing_rows`."""
    dealt = rows.withColumn("range", F.floor(F.coalesce(F.col("id"), F.col("row")) / RANGE_IDS))
    dealt = dealt.repartition("part", "range", F.pmod("row", F.lit(SALTS))).sortWithinPartitions("range", "row")
    found = dealt.select("row", "part", "mask", "good", "toxic").mapInPandas(_of_ranges, "part string, family string, n long, unions array<long>, alone array<long>")
    added = lambda column, n: F.array(*(F.sum(F.col(column)[i]) for i in range(n))).alias(column)
    return found.groupBy("part", "family").agg(F.sum("n").alias("n"), added("unions", SUBSETS), added("alone", len(FILTERS)))


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sizes = set_sizes(failing_rows(docs, labels, id_column, text, part))
    none = F.array(*[F.lit(0).cast("long")] * SUBSETS)
    of = lambda family, column: F.max(F.when(F.col("family") == family, F.col(column)))
    parts = sizes.groupBy("part").agg(of("all", "n").alias("n"), of("all", "unions").alias("u"), of("all", "alone").alias("alone"), *(F.coalesce(of(f, "unions"), none).alias(f) for f in FAMILIES[1:]))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(FILTERS) + 1)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = lambda x: F.element_at(F.array(*(F.lit(1 << f) for f in range(len(FILTERS)))), F.instr(F.lit(FILTERS), x))
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda s, i: s + F.when(i > 0, bit(F.substring("filter_order", i, F.lit(1)))).otherwise(0))
    steps = steps.withColumns({"letter": letter, "was": before}).withColumn("now", F.col("was") + bit(F.col("letter")))
    lost = lambda unions: F.col(unions)[F.col("now")] - F.col(unions)[F.col("was")]
    out = steps.select(
        "part", "filter_order", "step", "letter", (F.col("n") - F.col("u")[F.col("now")]).alias("kept"), lost("u").alias("removed"),
        (F.col("u")[bit(F.col("letter"))] - lost("u")).alias("redundant"), F.col("alone")[F.instr(F.lit(FILTERS), F.col("letter")) - 1].alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")
