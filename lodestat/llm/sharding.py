"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

The whole table is the root. A node that stands for several shards is cut in two along its widest dimension, at the
weighted quantile of bytes that leaves each side its part of the shards, until every leaf stands for one shard and so
holds the target bytes. Dimensions: the id, scaled to its range, and hashes of source and language, each widened by a
hash of the row, so that a cut may fall within rows of equal metadata: one source with a third of all rows is no
obstacle. Widths are relative to the root's.

The quantile is found by radix search over all rows: bytes by node and leading digit of the coordinate, then, within
the digit where the quantile falls, by the next digit, until that holds little. A step yields a row for each node.

Nulls: a null text has no bytes and crc32 0; null metadata have a place of their own. Rows that are equal throughout
differ in the last bits of the row's hash, which count the rows as they are read, so a cut may fall among them too.
Fewer rows than shards leave shards empty, and an empty table has none. Texts count by their size alone, however long.
Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offsets, saved

SHARDS = 24
#: Bits of a coordinate: those of the metadata, those of the row's hash; bits of a digit.
META_BITS, HASH_BITS, DIGIT_BITS = 20, 32, 13
#: Of the hash's bits, those that tell equal rows apart.
COPY_BITS = 10
#: A cut is near enough when what is left between the two possible cuts is this part of a shard.
NEAR_ENOUGH = 0.0005
DIMENSIONS = ("by_id", "by_source", "by_lang")


@dataclass
class Node:
    """`shards` leaves from number `first` on; once cut, `low` holds coordinates of `dim` below `cut`, `high` the rest."""

    number: int
    first: int
    shards: int
    dim: str = ""
    cut: int = 0
    low: Node | None = None
    high: Node | None = None


def _place(node: Node, leaf) -> Column:
    """leaf(node) of the leaf that a row is in."""
    if node.low is None:
        return F.lit(leaf(node))
    return F.when(F.col(node.dim) < F.lit(node.cut), _place(node.low, leaf)).otherwise(_place(node.high, leaf))


def coordinates(docs: DataFrame, id_column: str, text: str, source: str, lang: str) -> DataFrame:
    """id, size, text_crc32 and the dimensions of each document; saves the table."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    hashed = lambda name: F.pmod(F.xxhash64(F.col(name)), F.lit(1 << META_BITS))
    rows = saved(docs.select(F.col(id_column).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), hashed(source).alias("_s"), hashed(lang).alias("_l"), (F.shiftleft(F.pmod(F.xxhash64(id_column, text), F.lit(1 << (HASH_BITS - COPY_BITS))), COPY_BITS) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << COPY_BITS))).alias("_row")))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, width = low or 0, (high or 0) - (low or 0) + 1
    scaled = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(float(width)) * ((1 << META_BITS) - 1)), F.lit(0))
    spread = lambda meta: F.shiftleft(meta.cast("long"), HASH_BITS) + F.col("_row")
    return rows.select("doc_id", "size", "text_crc32", spread(scaled).alias("by_id"), spread(F.col("_s")).alias("by_source"), spread(F.col("_l")).alias("by_lang"))


def _cut_all(rows: DataFrame, root: Node, open_: list[Node], widths: dict[str, float], enough: float) -> None:
    """Finds dimension and cut of each of these nodes, all at once."""
    placed = rows.withColumn("node", _place(root, lambda n: n.number))
    by_number = {n.number: n for n in open_}
    inside = placed.where(F.col("node").isin(list(by_number)))
    spans = [F.max(d) - F.min(d) for d in DIMENSIONS]
    goals, prefix, below = {}, {}, {}
    for row in inside.groupBy("node").agg(F.sum("size").alias("bytes"), *(s.alias(d) for s, d in zip(spans, DIMENSIONS))).collect():  # a row for each node
        node = by_number[row["node"]]
        node.dim = max(DIMENSIONS, key=lambda d: row[d] / widths[d])
        goals[node.number] = row["bytes"] * (node.shards // 2) / node.shards
        prefix[node.number], below[node.number] = 0, 0
    for node in open_:
        node.dim = node.dim or DIMENSIONS[0]
    shift, search = META_BITS + HASH_BITS, dict(goals)
    while search and shift > 0:
        step = min(DIGIT_BITS, shift)
        shift -= step
        table = F.create_map(*(F.lit(x) for n in search for x in (n, prefix[n])))
        bases = F.create_map(*(F.lit(x) for n in search for x in (n, float(search[n] - below[n]))))
        coordinate = F.coalesce(*(F.when(F.col("node") == n, F.col(by_number[n].dim)) for n in search))
        digits = inside.where(F.col("node").isin(list(search))).select("node", "size", coordinate.alias("c"))
        digits = digits.where(F.shiftright("c", shift + step) == table[F.col("node")])
        sums = digits.groupBy("node", F.shiftright("c", shift).alias("d")).agg(F.sum("size").alias("w"))
        along = Window.partitionBy("node").orderBy("d")
        sums = sums.withColumn("upto", F.sum("w").over(along)).where((F.col("upto") >= bases[F.col("node")]))
        crossing = sums.groupBy("node").agg(F.min_by(F.struct("d", "w", "upto"), "d").alias("x")).select("node", "x.*")
        for row in crossing.collect():  # a row for each node
            n, node = row["node"], by_number[row["node"]]
            before, after = below[n] + row["upto"] - row["w"], below[n] + row["upto"]
            prefix[n], below[n] = row["d"], before
            if row["w"] <= enough or shift == 0:
                node.cut = (row["d"] if goals[n] - before <= after - goals[n] else row["d"] + 1) << shift
                del search[n]


def kd_tree(rows: DataFrame, shards: int = SHARDS) -> Node:
    """The tree over saved coordinates."""
    whole = rows.agg(F.sum("size").alias("bytes"), *((F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS)).first()
    widths = {d: max(1.0, float(whole[d] or 0)) for d in DIMENSIONS}
    root, made = Node(0, 0, shards), 1
    open_ = [root] if shards > 1 else []
    while open_:
        _cut_all(rows, root, open_, widths, NEAR_ENOUGH * (whole["bytes"] or 0) / shards)
        for node in open_:
            half = node.shards // 2
            node.low, node.high = Node(made, node.first, half), Node(made + 1, node.first + half, node.shards - half)
            made += 2
        open_ = [x for n in open_ for x in (n.low, n.high) if x.shards > 1]
    return root


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, shard and slot, its place in the shard."""
    rows = coordinates(docs, id_column, text, source, lang)
    placed = rows.withColumn("shard", _place(kd_tree(rows, shards), lambda n: n.first).cast("int"))
    order = [F.col("doc_id"), *(F.col(d) for d in DIMENSIONS)]
    return running_offsets(placed, ["shard"], order, F.lit(1), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
