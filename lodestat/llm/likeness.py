"""SimHash near-duplicates from a likeness (Jaccard of word-shingle sets) on, by multi-index hashing.

Texts of equal shingle sets are one node. Two sets of likeness J differ in a known share of SimHash bits on average,
whatever their number, so the fingerprint here is as long as the corpus needs: with n texts a segment has about log2 n
bits, which keeps what a look-up meets by chance in proportion to n, and there are as many segments as it takes for a
pair just at the limit to be within one bit in one of them with probability RECALL; likelier pairs are missed less.

Each fingerprint looks up every value within one bit of each of its segments in the table of segments (a pair that
differs in one bit is found from the side that has it set). What it finds is held against the first 64 bits, then
against the whole fingerprint, then verified on the whole shingle sets: links are exact. In each of a few rounds
(ROUNDS) each node's partner of least distance is verified; pairs that those links put in one component need no
verification, all others get it.

A segment value of many fingerprints (HOT_BUCKET) is not paired all against all: those that look it up are held
against one of its nodes first, for each value another one, as texts of a group that are unlike one of its members are
like others. Then pairs that still lie in different components are held against each other, by their fingerprints and
then, where they meet, by their shingles: what two sets have in common follows from the shingles in which each differs
from what most of their group has, which are few, and the same for all pairs of a node. So pairs that are not alike do
not come out of that join, however large the group. A value of few fingerprints that many look up, as a value of many
is within one bit (HOT_LOOKS), is treated likewise, as each of its fingerprints would be paired with the whole group.

Before that, pairs go that cannot be alike as too many shingles of theirs occur in one of the texts in question only:
an edited copy has many of them, and need not be held against its whole group. This bound is exact. It is taken for texts with a near partner only, as most texts that
look up a value of many fingerprints are not near to any of them.

Nulls: a null, empty or wordless text has the empty set (node zero), and those are equal. Ties, null ids and repeated
rows are as in `simhash`. Very long texts are read whole, each by one task. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components
from .fingerprints_kernel import jaccard, set_hash, shingle_set, wide_simhash
from .simhash import least_of_each

#: Words of a shingle, and the likeness from which two texts are near duplicates.
WIDTH, SIMILARITY = 5, 0.8
#: Probability that a pair just at the limit shares a look-up, and how many deviations its distance may be above its mean:
#: in the first 64 bits, and in the whole fingerprint.
RECALL, DEVIATIONS, WHOLE_DEVIATIONS = 0.995, 3.3, 4.0
LEAST_SEGMENT, HOT_BUCKET, HOT_LOOKS = 12, 4, 16
#: Lanes of 64 bits of a whole fingerprint, if the segments do not need more: the longer, the fewer pairs below the limit stay.
LEAST_LANES = 8
#: Nodes whose ids are broadcast at most (some 3 MB), to pick their texts before these are moved; more are joined by a shuffle.
BROADCAST_NODES = 200_000
#: Look-ups of one value that a task holds against its entries.
SALTED_ROWS = 2000
#: Rounds that verify each node's nearest partner only, before all pairs that are still apart.
ROUNDS = 2


@dataclass(frozen=True)
class Index:
    """Bits of a segment, number of segments, and the most bits that may differ of the first 64 and of all."""

    bits: int
    segments: int
    most_first: int
    most: int

    @property
    def lanes(self) -> int:
        return max(LEAST_LANES, -(-self.bits * self.segments // 64))

    @staticmethod
    def of(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> Index:
        """For n texts. At likeness J two sets of equal size have cosine 2J / (1 + J), and bits differ by the angle's share."""
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        bits = max(LEAST_SEGMENT, math.ceil(math.log2(max(n, 2))))
        within_one = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
        segments = math.ceil(math.log(1 - recall) / math.log(1 - within_one))
        most = lambda k, deviations: math.ceil(k * p + deviations * math.sqrt(k * p * (1 - p)))
        return Index(bits, segments, most(64, DEVIATIONS), most(64 * max(LEAST_LANES, -(-bits * segments // 64)), WHOLE_DEVIATIONS))

    def keys(self, prints: Column) -> Column:
        """An array of (number of the segment, its value) as one number each."""

        def key(k: int) -> Column:
            lane, shift = divmod(k * self.bits, 64)
            value = F.shiftrightunsigned(prints[lane], shift)
            if shift + self.bits > 64:
                value = value.bitwiseOR(F.shiftleft(prints[lane + 1], 64 - shift))
            return value.bitwiseAND(F.lit((1 << self.bits) - 1)).bitwiseOR(F.lit(k << self.bits))

        return F.array(*map(key, range(self.segments)))

    def first_met(self, a: Column, b: Column) -> Column:
        """Number of the first segment in which two fingerprints are within one bit; -1 if there is none."""
        return F.array_position(F.zip_with(self.keys(a), self.keys(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)) <= 1), True) - 1


def _noted(docs: DataFrame, id_column: str, text: str, width: int, lanes: int) -> DataFrame:
    """id, text_hash, node and fingerprint of every document."""

    @F.pandas_udf("node long, prints array<long>")
    def noted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, width) for t in texts]
            yield pd.DataFrame({"node": pd.Series([set_hash(s) for s in sets], dtype="int64"), "prints": pd.Series([wide_simhash(s, lanes) for s in sets], dtype=object)})

    return docs.select(F.col(id_column), F.xxhash64(text).alias("text_hash"), noted(F.col(text)).alias("n")).select(id_column, "text_hash", "n.*")


def _differ(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _probes(table: DataFrame, bits: int) -> DataFrame:
    """Look-ups of the table (key, node, first): its own keys, and those with one bit of the segment cleared."""
    cleared = table.withColumn("m", F.explode(F.array(*(F.lit(1 << i).cast("long") for i in range(bits))))).where(F.col("key").bitwiseAND(F.col("m")) != 0)
    cleared = cleared.select(F.col("key").bitwiseXOR(F.col("m")).alias("key"), "node", "first", F.lit(True).alias("cleared"))
    return table.select("key", "node", "first", F.lit(False).alias("cleared")).union(cleared)


def _met(probes: DataFrame, table: DataFrame, most_first: int) -> DataFrame:
    """Pairs (a > b) of a look-up and what the table has there, near in the first 64 bits."""
    entries = table.select("key", F.col("node").alias("x"), F.col("first").alias("first_x"))
    on = (probes["key"] == entries["key"]) & (F.col("node") != F.col("x")) & (F.col("cleared") | (F.col("node") > F.col("x"))) & (_differ("first", "first_x") <= most_first)
    return probes.join(entries, on).select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b"))


def _distance(a: str, b: str, index: Index) -> Column:
    return sum((_differ(F.col(a)[i], F.col(b)[i]) for i in range(index.lanes)), F.lit(0))


def _close(pairs: DataFrame, nodes: DataFrame, index: Index) -> DataFrame:
    """Those of the pairs whose whole fingerprints are near, each once, with their distance."""
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("prints").alias(f"prints_{n}"))
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").withColumn("distance", _distance("prints_a", "prints_b", index)).where(F.col("distance") <= index.most).select("a", "b", "distance")


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs, each once. Saved."""
    return saved(pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct())


def _picked(frame: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """Joins rows with texts to saved narrow ones that say which of them are wanted: these go to the texts if they are few."""
    return frame.join(F.broadcast(few) if few.count() <= BROADCAST_NODES else few, on)


def _texts_of(docs: DataFrame, text: str, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted nodes. Saved."""
    wanted = saved(nodes.join(wanted, "node", "left_semi").select("node", "text_hash"))
    found = _picked(docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")), wanted, "text_hash")
    return saved(found.groupBy("node").agg(F.first("text").alias("text")))


def _alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of saved pairs (a, b) of nodes whose shingle sets are alike. Saved."""

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            seen: dict[str, object] = {}
            whole = lambda t: seen[t] if t in seen else seen.setdefault(t, shingle_set(t, width))  # noqa: B023, E731
            yield pd.Series([jaccard(whole(x), whole(y)) >= similarity for x, y in zip(left, right)], dtype=bool)

    texts = _picked(texts, _ends(pairs), "node")
    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return saved(both.where(alike("text_a", "text_b")).select("a", "b"))


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs that the edges leave in different components."""
    roots = saved(components(edges))
    side = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    placed = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return placed.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, distance) that are alike, but for some within a component of the others."""
    edges = None
    for _ in range(ROUNDS):
        nearest = saved(pairs.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("n")).select("a", "n.b"))
        found = _alike(nearest, texts, width, similarity)
        edges = found if edges is None else edges.union(found)
        pairs = saved(_apart(pairs.join(nearest, ["a", "b"], "left_anti"), edges))
    return edges.union(_alike(pairs, texts, width, similarity))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """node and hashes of its shingles. Saved."""

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([shingle_set(t, width).view("int64") for t in part], dtype=object)

    return saved(texts.select("node", hashes("text").alias("hashes")))


def _shared(sets: DataFrame) -> DataFrame:
    """node, size (distinct shingles) and shared (those of them that occur in another of the sets too)."""
    each = sets.select("node", F.explode("hashes").alias("h"))
    own = each.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("_node")).where("n = 1").groupBy("_node").agg(F.count("*").alias("own"))
    size = F.size("hashes").cast("long")
    return sets.join(own, F.col("node") == F.col("_node"), "left").select("node", size.alias("size"), (size - F.coalesce("own", F.lit(0))).alias("shared"))


def _enough(left: str, right: str, similarity: float) -> Column:
    """Whether two sets could be alike if they had all shingles in common that they share with any text."""
    common = F.least(f"shared{left}", f"shared{right}")
    return (1 + similarity) * common >= similarity * (F.col(f"size{left}") + F.col(f"size{right}")) - 1e-6


def _differences(wanted: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """node, most (of `wanted`) and differs: the shingles that only one has of the node's set and of what over half of the
    sets of the component `most` have. `wanted` is of distinct rows; those of a node or component without sets are left out."""
    groups = sets.join(roots, F.col("node") == F.col("_node"), "left").select(F.coalesce("root", "node").alias("most"), "hashes")
    groups = groups.join(wanted.select("most").distinct(), "most", "left_semi")
    often = groups.select("most", F.explode("hashes").alias("h")).groupBy("most", "h").agg(F.count("*").alias("n"))
    often = often.join(groups.groupBy("most").agg(F.count("*").alias("sets")), "most").where(2 * F.col("n") > F.col("sets"))
    common = saved(often.groupBy("most").agg(F.collect_list("h").alias("common")))
    differs = F.concat(F.array_except("hashes", "common"), F.array_except("common", "hashes"))
    return wanted.join(common, "most").join(sets, "node").select("node", "most", differs.alias("differs"))


def _near_sets(left: str, right: str, similarity: float) -> Column:
    """Whether two sets are alike, by what they differ in from one and the same set (with a margin for rounding)."""
    apart = F.size(f"differs{left}") + F.size(f"differs{right}") - 2 * F.size(F.array_intersect(f"differs{left}", f"differs{right}"))
    return (1 + similarity) * apart <= (1 - similarity) * (F.col(f"size{left}") + F.col(f"size{right}")) + 1e-6


def _hot_apart(members: DataFrame, edges: DataFrame, sets: DataFrame, shared: DataFrame, index: Index, similarity: float) -> DataFrame:
    """Pairs (a > b, distance) of a look-up and an entry of one hot value that lie in different components and may be alike.

    `sets` and `shared` are of the nodes for which they were taken; pairs of two of these come out if they are alike. A pair is taken from the first segment in which
    it is within one bit (where that value is not hot, `_met` has the pair). The pairs' fingerprints are near, and the
    shingles that both share with others would do for the likeness. One node of such a pair lies outside of the component
    that has most nodes of the value. Look-ups of a value are dealt to tasks, SALTED_ROWS or so to each, that all get the
    value's entries.
    """
    roots = saved(components(edges).withColumnRenamed("node", "_node"))
    placed = members.join(shared, "node", "left").join(roots, F.col("node") == F.col("_node"), "left")
    placed = saved(placed.select("key", "node", "prints", "cleared", "size", "shared", F.coalesce("root", "node").alias("root")))
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("count"), F.count_distinct("node").alias("nodes"))
    most = counts.groupBy("key").agg(F.max(F.struct("nodes", "root")).alias("m"), F.count("*").alias("n"), F.sum("count").alias("rows")).where("n > 1")
    mixed = saved(placed.join(most.select("key", F.col("m.root").alias("most"), F.ceil(F.col("rows") / SALTED_ROWS).cast("int").alias("salts")), "key"))
    differences = _differences(mixed.where("size IS NOT NULL").select("node", "most").distinct(), sets, roots)
    mixed = saved(mixed.join(differences, ["node", "most"], "left"))
    outside = mixed.where("root != most")
    entry = lambda frame: frame.where("NOT cleared").select(F.col("key").alias("key_x"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt_x"), F.col("node").alias("x"), F.col("prints").alias("prints_x"), F.col("root").alias("root_x"), F.col("size").alias("size_x"), F.col("shared").alias("shared_x"), F.col("differs").alias("differs_x"))
    distance = _distance("prints", "prints_x", index)
    once = (F.col("cleared") | (F.col("node") > F.col("x"))) & F.coalesce(_enough("", "_x", similarity), F.lit(True)) & (distance <= index.most) & (index.first_met(F.col("prints"), F.col("prints_x")) == F.shiftright("key", index.bits))
    once = once & F.coalesce(_near_sets("", "_x", similarity), F.lit(True))
    dealt = lambda looks: looks.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    near = lambda looks, entries: dealt(looks).join(entries, (F.col("key") == F.col("key_x")) & (F.col("salt") == F.col("salt_x")) & (F.col("root") != F.col("root_x")) & once)
    pairs = near(outside, entry(mixed)).union(near(mixed.where("root = most"), entry(outside)))
    return saved(pairs.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b"), distance.alias("distance")).distinct())


def _stars(members: DataFrame, index: Index) -> DataFrame:
    """Pairs (a > b, distance) of every look-up of a hot value and one of its nodes, for each value another one; the
    fingerprints are near."""
    middle = members.where("NOT cleared").groupBy("key").agg(F.min_by(F.struct("node", "prints"), F.xxhash64("key", "node")).alias("m"))
    middle = middle.select(F.col("key").alias("key_x"), F.col("m.node").alias("x"), F.col("m.prints").alias("prints_x"))
    distance = _distance("prints", "prints_x", index)
    first = _differ(F.col("prints")[0], F.col("prints_x")[0]) <= index.most_first
    near = members.join(middle, (F.col("key") == F.col("key_x")) & (F.col("node") != F.col("x")) & first & (distance <= index.most))
    return near.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b"), distance.alias("distance")).distinct()


def _hot(table: DataFrame, index: Index, hot_bucket: int) -> DataFrame:
    """key and many of the hot values: those of more than `hot_bucket` fingerprints (many), and others that have some and
    that more than HOT_LOOKS fingerprints of the first look up. Saved."""
    many = saved(table.groupBy("key").count().where(F.col("count") > hot_bucket))
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(index.bits)))
    cleared = many.withColumn("m", F.explode(bits)).where(F.col("key").bitwiseAND(F.col("m")) != 0).select(F.col("key").bitwiseXOR(F.col("m")).alias("key"), "count")
    looked_up = saved(cleared.groupBy("key").agg(F.sum("count").alias("looks")).where(F.col("looks") > HOT_LOOKS).select("key").join(many, "key", "left_anti"))
    looked_up = table.join(looked_up, "key", "left_semi").select("key").distinct()
    return saved(many.select("key", F.lit(True).alias("many")).union(looked_up.select("key", F.lit(False))))


def _links(docs: DataFrame, nodes: DataFrame, index: Index, text: str, width: int, similarity: float, hot_bucket: int) -> DataFrame:
    """Verified edges (a, b) that give the components."""
    table = saved(nodes.select(F.explode(index.keys(F.col("prints"))).alias("key"), "node", F.col("prints")[0].alias("first")))
    probes = _probes(table, index.bits)
    hot = _hot(table, index, hot_bucket)
    no_hot = hot.isEmpty()
    close = _close(_met(probes, table if no_hot else table.join(hot, "key", "left_anti"), index.most_first), nodes, index)
    if not no_hot:
        members = saved(probes.join(hot, "key").select("key", "node", "cleared", "many").join(nodes.select("node", "prints"), "node"))
        close = close.union(_stars(members.where("many"), index))
    close = saved(close.distinct())
    ends = _ends(close)
    texts = _texts_of(docs, text, nodes, ends)
    sets = _sets(texts, width)
    shared = saved(_shared(sets))
    side = lambda n: shared.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("shared").alias(f"shared_{n}"))
    close = saved(close.join(side("a"), "a").join(side("b"), "b").where(_enough("_a", "_b", similarity)).select("a", "b", "distance"))
    edges = _verified(close, texts, width, similarity)
    if no_hot:
        return edges
    apart = _hot_apart(members, edges, sets, shared, index, similarity)
    return edges.union(_alike(apart, _texts_of(docs, text, nodes, _ends(apart)), width, similarity))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """A row for each document: id, text_hash, root (the component's least node) and component_id (its least id)."""
    index = Index.of(docs.count(), similarity)
    noted = saved(_noted(docs, id_column, text, width, index.lanes))
    nodes = saved(noted.groupBy("node").agg(F.min(id_column).alias("least"), F.min("text_hash").alias("text_hash"), F.first("prints").alias("prints")))
    roots = components(_links(docs, nodes.where("node != 0"), index, text, width, similarity, hot_bucket)).withColumnRenamed("node", "_node")
    rooted = saved(nodes.select("node", "least").join(roots, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return noted.select(id_column, "text_hash", "node").join(rooted.join(ids, "root").select("node", "root", "component_id").hint("merge"), "node").drop("node")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component, that with the least id, with the columns it came with."""
    return least_of_each(docs, near_duplicates(docs, id_column, text, width, similarity), id_column, text)
