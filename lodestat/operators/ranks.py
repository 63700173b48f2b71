"""Row numbers, average ranks and exact percentiles within groups, without sorting a group in one task.

Values are dealt to ranges (RANGES of them for each doubling of the absolute value). Rows are counted by group and
range; only those counts are summed along, and rows are sorted within their range. Ranges follow from the values alone,
so repeated tasks agree. Rows of one range, equal values above all, are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def range_of(value: str) -> Column:
    """The range of a number: larger values have no lower one; null for null, that of NaN is above all, infinity too."""
    x = F.col(value).cast("double")
    size = F.when(F.abs(x) == float("inf"), F.lit(3000.0)).otherwise(1100 + F.log2(F.abs(x)))
    return F.when(F.isnan(x), F.lit(1 << 40)).when(x == 0, F.lit(0)).otherwise(F.floor(F.signum(x) * size * RANGES)).cast("long")


def _ranged(rows: DataFrame, value: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with _range, and for each group and range its rows, those of lower ranges and those of the group."""
    dealt = rows.withColumn("_range", range_of(value))
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_in"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    lower = F.coalesce(F.sum("_in").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt, counts.select("*", lower.alias("_lower"), F.sum("_in").over(group).alias("_count"))


def _met(dealt: DataFrame, counts: DataFrame, by: list[str], columns: list[str], how: str = "inner", hint: str | None = "merge") -> DataFrame:
    keys = [*by, "_range"]
    known = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *columns)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & dealt[k].eqNullSafe(known[f"_k{i}"])
    return dealt.join(known.hint(hint) if hint else known, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def numbered(rows: DataFrame, value: str, by: list[str], then: list[Column] | None = None) -> DataFrame:
    """Adds _n, the row's number from 1 on within its group by value, then by the columns given, and _count, the group's rows."""
    dealt, counts = _ranged(rows, value, by)
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(F.col(value), *(then or [])))
    return _met(dealt, counts, by, ["_lower", "_count"]).withColumn("_n", F.col("_lower") + inside).drop("_range", "_lower")


def average_ranks(rows: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Adds the rank of the value within its group; equal values share the mean of their ranks."""
    dealt, counts = _ranged(rows, value, by)
    part = Window.partitionBy(*by, "_range")
    rank = F.rank().over(part.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, "_range", value)) - 1) / 2
    return _met(dealt, counts, by, ["_lower"]).withColumn(out, F.col("_lower") + rank).drop("_range", "_lower")


def percentiles(rows: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """Exact percentiles by linear interpolation for each group that has values, under the names given.

    Rows are counted by range; then only those of the ranges in which a wanted row lies are moved, counted by value and
    sorted. NaN is above all numbers. Nothing runs before the result is asked for.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    dealt, counts = _ranged(known, "_v", by)
    place = lambda p: (F.col("_count") - 1) * F.lit(float(p))
    sides = F.array(*(F.struct(F.lit(name).alias("name"), side(place(p)).cast("long").alias("k"), share.alias("share")) for name, p in at.items() for side, share in ((F.floor, 1 - (place(p) - F.floor(place(p)))), (F.ceil, place(p) - F.floor(place(p))))))
    here = F.filter(sides, lambda s: (s["share"] > 0) & (s["k"] >= F.col("_lower")) & (s["k"] < F.col("_lower") + F.col("_in")))
    wanted = counts.withColumn("_w", here).where(F.size("_w") > 0)
    met = _met(dealt, wanted, by, ["_lower", "_w"], hint=None)  # a few ranges of each group: Spark sees at run time whether they are small
    values = met.groupBy(*by, "_range", "_v").agg(F.count("*").alias("_t"), F.any_value("_lower").alias("_lower"), F.any_value("_w").alias("_w"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = values.withColumn("_n", F.col("_lower") + before).select(*by, "_v", "_n", "_t", F.explode("_w").alias("s")).where("s.k >= _n AND s.k < _n + _t")
    return picked.groupBy(*by).agg(*(F.sum(F.when(F.col("s.name") == name, F.col("_v") * F.col("s.share"))).alias(name) for name in at))
