"""Charts, counts, inventories and glucose profiles over cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import QUARTILES, with_percentiles


def box_plot(rows: DataFrame, var: str, label: Column) -> DataFrame:
    labelled = rows.select(F.coalesce(label, F.lit("unknown")).alias("label"), var)
    out = labelled.groupBy("label").agg(F.count(var).alias("n"), F.min(var).alias("least"), F.max(var).alias("most"))
    return with_percentiles(out, labelled, var, ["label"], QUARTILES)


def trend(rows: DataFrame, var: str, month: Column) -> DataFrame:
    monthly = rows.select(month.alias("month"), var)
    return with_percentiles(monthly.groupBy("month").agg(F.count(var).alias("n"), F.avg(var).alias("mean")), monthly, var, ["month"], QUARTILES)


def since(rows: DataFrame, now: str, days: int, time: str = "ts") -> DataFrame:
    """Rows of the last so many days before a stated time, that day included; rows without a time are left out."""
    return rows.where(F.col(time) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def binned_2d(pairs: DataFrame, width_x: float, width_y: float, k: int = 5) -> DataFrame:
    """Counts of pairs by cells of a grid, for a heat map in place of points; small counts are hidden."""
    cells = pairs.groupBy(F.floor(F.col("x") / width_x).alias("bx"), F.floor(F.col("y") / width_y).alias("by")).agg(F.count("*").alias("n"))
    return cells.select("bx", "by", F.when(F.col("n") >= k, F.col("n")).alias("n"), (F.col("n") < k).alias("suppressed"))


def measure_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pid", F.col("concept").alias("code")).agg(F.count("*").alias("n"))


def with_measures(people: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """People with their total of measures, those with `least` or more; 0 keeps everybody."""
    totals = counts.groupBy("pid").agg(F.sum("n").alias("total"))
    return people.join(totals, "pid", "left").withColumn("total", F.coalesce("total", F.lit(0))).where(F.col("total") >= least)


def preview(people: DataFrame, counts: DataFrame, least: int, most_rows: int = 5000) -> DataFrame:
    """The people with the largest totals, and whether they would be kept."""
    totals = with_measures(people, counts, 0)
    return totals.withColumn("kept", F.col("total") >= least).orderBy(F.desc("total"), "pid").limit(most_rows)


def kept_concepts(previewed: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows and patients by concept over the people that a preview keeps (pid, kept)."""
    kept = counts.join(previewed.where("kept").select("pid"), "pid", "left_semi")
    return kept.groupBy("code").agg(F.sum("n").alias("n"), F.count_distinct("pid").alias("patients"))


def added_counts(parts: DataFrame) -> DataFrame:
    """(pid, code, n) of several sources, some of them counted already, added; a truncated part marks its sums."""
    return parts.groupBy("pid", "code").agg(F.sum("n").alias("n"), F.max(F.coalesce("truncated", F.lit(False))).alias("truncated"))


def inventory(rows: DataFrame) -> DataFrame:
    """What each source holds."""
    return rows.groupBy("source").agg(F.count("*").alias("observations"), F.count_distinct("pid").alias("patients"), F.count_distinct("concept").alias("concepts"))


def concept_inventory(by_source: DataFrame) -> DataFrame:
    """Concepts over all sources from (source, concept, unit, n): who holds them, how many, in which units."""
    units = by_source.groupBy("concept", "unit").agg(F.sum("n").alias("n"), F.collect_set("source").alias("held"))
    out = units.groupBy("concept").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("held")))), ",").alias("held_by"), F.sum("n").alias("observations"), F.count("unit").alias("n_units"))
    return out.withColumn("unit_disagreement", F.col("n_units") > 1)


def merged_maps(rows: DataFrame, by: list[str], counts: str) -> DataFrame:
    """The maps of counts of each of `by` merged by addition; a null or empty map adds nothing, a null count is 0."""
    each = rows.select(*by, F.explode_outer(counts).alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum(F.coalesce("_v", F.lit(0))).alias("_v"))
    held = F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", F.col("_v").cast("bigint"))))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(held)).alias(counts))


def merged_concepts(answers: DataFrame, names: tuple[str, ...] = ("display", "guid")) -> DataFrame:
    """What all sources say of their concepts: (place, source, concept, names, n, units), place being that of the source in
    the registry. A row for each concept: held_by, observations, each name as the first source says it that has one, the
    merged map of units, whether units disagree, and its number by observations, the most observed first."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place")))
    found = answers.where(F.col("concept").isNotNull()).groupBy("concept").agg(F.array_sort(F.collect_set("source")).alias("held_by"), F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("observations"), *(first(c).alias(c) for c in names))
    units = merged_maps(answers.where(F.col("concept").isNotNull()), ["concept"], "units")
    out = found.join(units, "concept").withColumn("unit_disagreement", F.size("units") > 1)
    return out.withColumn("number", F.row_number().over(Window.orderBy(F.desc("observations"), "concept")))  # a row for each concept


def federated_counts(counts: DataFrame) -> DataFrame:
    """Sums by key of what sources that answered have counted; (source, key, n)."""
    return counts.where(F.col("n").isNotNull()).groupBy("key").agg(F.sum("n").alias("n"), F.count_distinct("source").alias("sources"))


def answering(counts: DataFrame) -> DataFrame:
    """One row on (source, key, n), n null where a source did not answer for a key: how many sources answered at all, how
    many did not, and whether the counts are complete, degraded (most answered) or an error."""
    each = counts.groupBy("source").agg(F.max(F.col("n").isNotNull()).alias("ok")).agg(F.count_if("ok").alias("answered"), F.count_if(~F.col("ok")).alias("missing"))
    mode = F.when(F.col("answered") <= F.col("missing"), "error").when(F.col("missing") == 0, "complete").otherwise("degraded")
    return each.withColumn("mode", mode)


#: Names and shares of the percentiles of an hour.
BANDS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def epoch_points(points: DataFrame, seconds: str = "epoch") -> DataFrame:
    """Raw points (pid, seconds since 1970, value) as rows with seq, ts and value; points without a value or time are left out."""
    known = points.where(F.col(seconds).isNotNull() & F.col("value").isNotNull())
    return known.select("*", F.timestamp_seconds(seconds).alias("ts"), F.xxhash64("pid", seconds, "value").alias("seq"))


def glucose_hours(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, mean and percentiles of the values of each hour of day, with a row for each of the 24 hours."""
    hourly = rows.select(*by, F.hour("ts").alias("hour"), "value")
    hours = hourly.groupBy(*by, "hour").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    hours = with_percentiles(hours, hourly, "value", [*by, "hour"], BANDS)
    every = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    spine = every.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spine.join(hours, [*by, "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def glucose_summary(rows: DataFrame, by: list[str], low: float = 3.9, high: float = 10.0) -> DataFrame:
    """n, mean, population sd, coefficient of variation and percent of values in, below and above range."""
    share = lambda test: F.avg(F.when(test, 100.0).otherwise(0.0))
    v = F.col("value")
    out = rows.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), share((v >= low) & (v <= high)).alias("tir"), share(v < low).alias("tbr"), share(v > high).alias("tar"))
    return out.withColumn("cv", 100 * F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0)))


def merged_hours(hours: DataFrame) -> DataFrame:
    """Hours of all sources: percentiles and mean weighted by n."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("n")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), F.lit(0))).alias(c)
    return hours.groupBy("hour").agg(F.sum("n").alias("n"), *(weighted(c) for c in ("p5", "p25", "p50", "p75", "p95", "mean")))


def hypo_events(rows: DataFrame, threshold: float = 3.9, gap: int = 6) -> DataFrame:
    """Number of events of each patient: a low value starts one unless another was within the `gap` values before."""
    by = Window.partitionBy("pid").orderBy("ts", "seq")
    low = rows.where("value IS NOT NULL").withColumn("_n", F.row_number().over(by)).where(F.col("value") < threshold)
    before = F.lag("_n").over(Window.partitionBy("pid").orderBy("_n"))
    starts = low.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_n") - F.col("_b") > gap))
    return starts.groupBy("pid").agg(F.count("*").alias("events"))
