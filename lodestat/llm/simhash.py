"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint has two 32-bit segments. Two fingerprints that differ in three bits or fewer differ in one bit
at most in one of them, so each fingerprint looks up every value within one bit of each of its segments in the table
of segments, and the whole distance of what it finds is verified. A pair whose segments differ in one bit is found
from the side that has the bit set, which saves half the look-ups.

A segment value that very many fingerprints share (HOT_BUCKET) is not paired all against all. There, the other
segments must differ in 3 (2 across values) bits at most: each fingerprint is dealt to the values within one bit and
within two bits of its other segment, where any that meet, one of them within one bit, are near for certain, and is
linked to the least of those. This finds the same components, in proportion to the fingerprints of the value.

Nulls: a null, empty or wordless text has fingerprint zero and links like any other. Ties in doc_id are fine; null
ids count as no id (component_id is null when a component has no other). Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .components import components
from .fingerprints_kernel import simhash

MAX_BITS = 3
HOT_BUCKET = 128
LOW = 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The SimHash of a text as a signed 64-bit number."""
    for texts in batches:
        yield pd.Series([h - (1 << 64) if h >> 63 else h for h in map(simhash, texts)], dtype="int64")


def _segments(prints: DataFrame) -> DataFrame:
    """fp -> (seg, v, rest, fp) for both segments."""
    high, low = F.expr(f"shiftrightunsigned(fp, 32) & {LOW}L"), F.expr(f"fp & {LOW}L")
    return prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("v"), low.alias("rest")), F.struct(F.lit(1).alias("seg"), low.alias("v"), high.alias("rest")))).alias("s")).select("s.*", "fp")


def links(prints: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints (column fp, distinct) within MAX_BITS of each other.

    Between values that hot_bucket fingerprints share at most, an edge for every pair; beyond, enough of the pairs for
    the same components.
    """
    table = saved(_segments(prints))
    one_bit = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    cleared = F.filter(F.transform(one_bit, lambda m: F.struct((F.col("v").bitwiseAND(F.bitwise_not(m))).alias("at"), F.lit(1).alias("flip"))), lambda x: x["at"] != F.col("v"))
    probes = table.select("seg", "rest", "fp", F.explode(F.concat(F.array(F.struct(F.col("v").alias("at"), F.lit(0).alias("flip"))), cleared)).alias("p")).select("seg", F.col("p.at").alias("v"), "p.flip", "rest", "fp")
    hot = saved(table.groupBy("seg", "v").count().where(F.col("count") > hot_bucket).select("seg", "v"))
    no_hot = hot.isEmpty()
    found = table if no_hot else table.join(hot, ["seg", "v"], "left_anti")
    found = found.select("seg", "v", F.col("fp").alias("b"))
    pairs = probes.withColumnRenamed("fp", "a").join(found.hint("shuffle_hash"), ["seg", "v"])
    edges = pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    if not no_hot:
        edges = edges.union(_hot_links(probes.join(hot, ["seg", "v"], "left_semi")))
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _hot_links(probes: DataFrame) -> DataFrame:
    """Edges to the least fingerprint at each value that some fingerprint of the bucket has within one bit."""
    ball = lambda most: F.array(*(F.lit(sum(1 << i for i in bits)).cast("long") for n in range(most + 1) for bits in combinations(range(32), n)))
    near, wide = ball(1), ball(2)
    masks = F.when(F.col("flip") == 0, wide).otherwise(near)
    dealt = probes.select("seg", "v", "flip", "fp", "rest", F.explode(masks).alias("m")).select("seg", "v", F.col("rest").bitwiseXOR(F.col("m")).alias("at"), "fp", ((F.col("flip") == 0) & (F.bit_count("m") <= 1)).alias("core"))
    least = dealt.where("core").groupBy("seg", "v", "at").agg(F.min("fp").alias("b"))
    return dealt.join(least, ["seg", "v", "at"]).where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """A row for each document: id, text_hash, fp, root (the component's least fingerprint) and component_id (its least id)."""
    prints = saved(docs.select(F.col(id_column), F.xxhash64(text).alias("text_hash"), fingerprint(F.col(text)).alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min(id_column).alias("least"))
    roots = components(links(distinct.select("fp"), hot_bucket)).withColumnRenamed("node", "fp")
    placed = saved(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(ids, "root").select("fp", "root", "component_id"), "fp")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the least id, with the columns it came with."""
    return least_of_each(docs, near_duplicates(docs, id_column, text), id_column, text)


def least_of_each(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component (found: id, text_hash, root and component_id of every document) the document with the least id."""
    keys = lambda of, hashed: [F.coalesce(of.cast("string"), F.lit("")).alias("_id"), F.xxhash64(hashed, of.isNull()).alias("_h")]
    keep = found.where(F.col(id_column).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct(id_column, "text_hash")).alias("k"), F.count("*").alias("n"))
    keep = saved(keep.select(*keys(F.col(f"k.{id_column}"), F.col("k.text_hash")), "n"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *keys(F.col(id_column), F.xxhash64(text)))
    kept = whole.join(keep.select("_id", "_h"), ["_id", "_h"], "left_semi")
    if not keep.where("n > 1").isEmpty():  # rows of one id, some of which may be equal
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.lit(1)))).where("_n = 1")
    return kept.select("_row.*")
