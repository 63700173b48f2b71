"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is the set of its paragraphs' 64-bit hashes; a paragraph is a line, and a long line is cut at the ends of its
sentences into pieces of LEAST_PIECE to PIECE code points, so that a change moves no cut far from it. A sketch has
CELLS cells in three parts; each hash goes to one cell of each part, which keeps a count, the exclusive or of the
hashes and that of their check hashes. Sketches of two versions subtract cell by cell; what is left is peeled: a cell
that holds one hash gives it away, it is taken out of its other cells, and so on. When cells are left over, the hashes
are dealt into four times as many sketches by another hash, and these are subtracted and peeled, until all succeed:
work grows with the difference. The recovered hashes that differ give the likeness (Jaccard) of the two sets.

Nulls: a null text is empty; two empty texts have likeness 1. Repeated paragraphs count once. Documents of equal id
and text are one document in the order, and get equal rows. Null ids come last. Very long texts have many paragraphs and
retries; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEAST_PIECE, PIECE = 100, 400
PARAGRAPH = f"[^\\n]{{{LEAST_PIECE},{PIECE}}}?[.!?]+(?=[ \\t\\r\\n])|[^\\n]{{1,{PIECE}}}"
PART = 8
ROUNDS = 12
MAX_LEVEL = 16
KEY = ["_id", "_h"]


def digests(text: Column) -> Column:
    """Distinct hashes of the paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(99))


def _places(x: Column) -> list[Column]:
    """The cells of a hash, one in each part."""
    return [(F.pmod(F.xxhash64(x, F.lit(j)), F.lit(PART)) + j * PART).cast("int") for j in range(3)]


def in_cells(hashes: DataFrame, keys: list[str], sides: list[tuple[str, Column]]) -> DataFrame:
    """Sketches of the hashes x of every key: keys, at, and n, k, c of each side, where its condition holds.

    A row for each cell that any side has a hash in. Rows of a key that lie in one task are summed there.
    """
    spread = hashes.withColumn("at", F.explode(F.array(*_places(F.col("x")))))
    sums = []
    for name, when in sides:
        sums += [F.count(F.when(when, F.lit(1))).cast("int").alias(f"n_{name}"), F.coalesce(F.bit_xor(F.when(when, F.col("x"))), F.lit(0)).alias(f"k_{name}"), F.coalesce(F.bit_xor(F.when(when, _check(F.col("x")))), F.lit(0)).alias(f"c_{name}")]
    return spread.groupBy(*keys, "at").agg(*sums)


def minus(a: str, b: str) -> Column:
    """A cell of one sketch less that of another."""
    return F.struct("at", (F.col(f"n_{a}") - F.col(f"n_{b}")).alias("n"), F.col(f"k_{a}").bitwiseXOR(F.col(f"k_{b}")).alias("k"), F.col(f"c_{a}").bitwiseXOR(F.col(f"c_{b}")).alias("c"))


def _take_out(cell: Column, entries: Column) -> Column:
    """The cell without those entries that are in it."""
    hit = lambda e: (e["p0"] == cell["at"]) | (e["p1"] == cell["at"]) | (e["p2"] == cell["at"])
    less = lambda s, e: F.struct(s["at"].alias("at"), (s["n"] - e["n"]).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c"))
    return F.aggregate(entries, cell, lambda s, e: F.when(hit(e), less(s, e)).otherwise(s))


def peel(cells: Column) -> Column:
    """(cells, found, more): what is left of the cells, the hashes k that came out (n is 1 for those of the first set, -1 for
    the second's), and whether the last turn found any."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<n:int,k:bigint>>").alias("found"), F.lit(True).alias("more"))

    def turn(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"])))
        got = F.array_distinct(F.transform(single, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["c"].alias("c"), *(p.alias(f"p{j}") for j, p in enumerate(_places(c["k"]))))))
        without = lambda g: F.struct(F.transform(state["cells"], lambda c: _take_out(c, g)).alias("cells"), F.concat(state["found"], F.transform(g, lambda e: F.struct(e["n"].alias("n"), e["k"].alias("k")))).alias("found"), (F.size(g) > 0).alias("more"))
        return F.when(state["more"], F.transform(F.array(got), without)[0]).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def recovered(cells: Column) -> Column:
    """The hashes (n, k) in one of two subtracted sets only; null when the cells don't peel."""
    done = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))
    return F.transform(F.array(peel(cells)), lambda s: F.when(done(s), s["found"]))[0]


def differing(cells: Column) -> Column:
    """Number of the recovered hashes; null when the cells don't peel."""
    found = recovered(cells)
    return F.transform(F.array(found), lambda f: F.when(f.isNotNull(), F.size(f).cast("long")))[0]


def likeness(differ: Column, a: Column, b: Column) -> Column:
    """Of two sets with so many hashes, and so many in one of them only."""
    both = a + b
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))


def as_text(cells: Column) -> Column:
    """A sketch as hexadecimal text: place, count (four digits or more), hash and half of the check hash of each cell that is in use."""
    part = lambda c, field, n: F.when(F.length(F.hex(c[field])) < n, F.lpad(F.hex(c[field]), n, "0")).otherwise(F.hex(c[field]))
    used = F.array_sort(F.filter(cells, lambda c: c["n"] != 0))
    return F.lower(F.array_join(F.transform(used, lambda c: F.concat(part(c, "at", 2), part(c, "n", 4), part(c, "k", 16), F.lpad(F.hex(c["c"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ""))


def _tagged(sets: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, side (place in names) and x, a row for each hash of the arrays."""
    tag = lambda i, name: F.transform(name, lambda x: F.struct(F.lit(i).alias("side"), x.alias("x")))
    return sets.select(*keys, F.explode(F.concat(*(tag(i, n) for i, n in enumerate(names)))).alias("e")).select(*keys, "e.*")


def _by_key(frame: DataFrame) -> DataFrame:
    """Dealt by KEY, so that what is then grouped or joined by it is not moved again."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)


def first_try(sets: DataFrame) -> DataFrame:
    """KEY and failed: an array of (which, differ, a, b) for own and changed (which 0), own and next (1).

    Where the sketch was too small, differ is null and a and b are the sets; they are null where it was not.
    """
    dealt = _by_key(sets.select(*KEY, "own", "changed", "next"))
    sides = [(name, F.col("side") == i) for i, name in enumerate(("own", "changed", "next"))]
    cells = in_cells(_tagged(dealt, KEY, ["own", "changed", "next"]), KEY, sides)
    whole = cells.groupBy(*KEY).agg(F.collect_list(minus("own", "changed")).alias("c0"), F.collect_list(minus("own", "next")).alias("c1"))
    found = whole.select(*KEY, differing(F.col("c0")).alias("d0"), differing(F.col("c1")).alias("d1"))
    tried = lambda which, d, other: F.struct(F.lit(which).alias("which"), F.col(d).alias("differ"), *(F.when(F.col(d).isNull(), F.col(c)).alias(n) for n, c in (("a", "own"), ("b", other))))
    return saved(dealt.join(found, KEY).select(*KEY, F.array(tried(0, "d0", "changed"), tried(1, "d1", "next")).alias("tries")))


def compare(tried: DataFrame) -> DataFrame:
    """KEY, which and differ, all of them found: what has not peeled is dealt to four times as many sketches."""
    now = tried.select(*KEY, F.explode("tries").alias("t")).select(*KEY, "t.*")
    done, level = now.where("differ IS NOT NULL").select(*KEY, "which", "differ"), 0
    left = now.where("differ IS NULL").select(*KEY, "which", "a", "b")
    keys = [*KEY, "which", "g"]
    while not left.isEmpty():
        level += 1
        if level > MAX_LEVEL:
            raise RuntimeError("sketches do not peel")
        dealt = _by_key(left)
        parts = _tagged(dealt, [*KEY, "which"], ["a", "b"]).withColumn("g", F.pmod(F.xxhash64("x", F.lit(1000 + level)), F.lit(4**level)))
        cells = in_cells(parts, keys, [("a", F.col("side") == 0), ("b", F.col("side") == 1)])
        peeled = cells.groupBy(*keys).agg(F.collect_list(minus("a", "b")).alias("cells")).select(*KEY, "which", differing(F.col("cells")).alias("d"))
        found = peeled.groupBy(*KEY, "which").agg(F.when(F.count("d") == F.count("*"), F.sum("d")).alias("differ"))
        again = [F.when(F.col("differ").isNull(), F.col(c)).alias(c) for c in ("a", "b")]
        now = saved(dealt.join(found, [*KEY, "which"]).select(*KEY, "which", "differ", *again))
        done = done.union(now.where("differ IS NOT NULL").select(*KEY, "which", "differ"))
        left = now.where("differ IS NULL").select(*KEY, "which", "a", "b")
    return done


def in_order(docs: DataFrame) -> DataFrame:
    """Distinct documents (_id, _h, absent, n_chars) with pos, from 0 on by descending id, nulls last; then by hash."""
    order = [F.col("absent"), F.col("_id").desc(), F.col("_h")]
    ranged = saved(docs.select("_id", "_h", "absent", "n_chars").distinct().repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").count()
    starts = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return saved(ranged.withColumn("_r", row).join(F.broadcast(starts), "_p").select("_id", "_h", "absent", "n_chars", (F.col("_start") + F.col("_r")).alias("pos")))


def version_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of an edited version of it, whose last third comes from the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    whole = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = whole.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("absent"), F.xxhash64("text", F.col("doc_id").isNull()).alias("_h"))
    ordered = in_order(whole.withColumn("n_chars", F.length("text")))
    n = ordered.count()
    repeats = docs.count() > n
    before = ordered.select(F.pmod(F.col("pos") + 1, F.lit(max(n, 1))).alias("pos"), F.col("_id").alias("_to_id"), F.col("_h").alias("_to_h"), F.col("absent").alias("_absent"), F.floor(F.col("n_chars") / 3).cast("int").alias("_need"))
    gives = ordered.join(before, "pos").select("_id", "_h", "_to_id", "_to_h", "_absent", "_need")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = whole.select("text", *KEY).repartition(parts, *KEY)  # the same columns for both uses, so that one exchange serves both
    given = texts.join(gives.hint("shuffle_hash"), KEY).select("_to_id", "_to_h", "_absent", F.substring("text", F.lit(1), F.col("_need")).alias("_given"), digests(F.col("text")).alias("next"))
    given = given.withColumnsRenamed({"_to_id": "_id", "_to_h": "_h"})
    given = given.dropDuplicates(KEY) if repeats else given
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.col("_given"))
    both = texts.join(given, KEY).select(F.when(~F.col("_absent"), F.col("_id")).alias("doc_id"), *KEY, F.length("text").cast("long").alias("n_chars"), digests(F.col("text")).alias("own"), "next", edited.alias("_edited"))
    sets = saved(both.select("doc_id", *KEY, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "own", digests(F.col("_edited")).alias("changed"), "next"))
    unique = sets.dropDuplicates(KEY) if repeats else sets
    differ = compare(first_try(unique)).groupBy(*KEY).agg(*(F.max(F.when(F.col("which") == i, F.col("differ"))).alias(name) for i, name in enumerate(("d_edited", "d_next"))))
    sides = [(name, F.col("side") == i) for i, name in enumerate(("own", "changed"))]
    cell = lambda name: F.struct("at", F.col(f"n_{name}").alias("n"), F.col(f"k_{name}").alias("k"), F.col(f"c_{name}").alias("c"))
    cells = in_cells(_tagged(_by_key(unique.select(*KEY, "own", "changed")), KEY, ["own", "changed"]), KEY, sides)
    prints = cells.groupBy(*KEY).agg(*(F.collect_list(cell(n)).alias(f"cells_{n}") for n, _ in sides)).select(*KEY, *(as_text(F.col(f"cells_{n}")).alias(f"fp_{n}") for n, _ in sides))
    sizes = [F.size(n).alias(f"size_{n}") for n in ("own", "changed", "next")]
    out = sets.select("doc_id", *KEY, "n_chars", "edited_sha256", *sizes).join(prints, KEY, "left").join(differ, KEY, "left")
    found = lambda name: F.coalesce(F.col(name), F.lit(0))
    return out.select("doc_id", "n_chars", "edited_sha256", F.coalesce("fp_own", F.lit("")).alias("fingerprint"), F.coalesce("fp_changed", F.lit("")).alias("edited_fingerprint"), likeness(found("d_edited"), F.col("size_own"), F.col("size_changed")).alias("near_edited"), likeness(found("d_next"), F.col("size_own"), F.col("size_next")).alias("near_next"))
