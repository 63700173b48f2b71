"""Mergeable statistics: sums by source first, the whole from those sums."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import average_ranks, numbered, percentiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the module


def moments(frame: DataFrame, var: str, by: list[str]) -> DataFrame:
    """n, missing, mean and m2 (the sum of squares about the mean) of a variable for each of `by`: what a source hands
    over. NaN is missing."""
    x = F.when(~F.isnan(var), F.col(var).cast("double"))
    return frame.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The moments of the union of parts; squares are taken about the mean of one part, so that large means do not cancel.
    A key has a part for each source."""
    held = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("mean").alias("_c"), F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "m2"))).alias("_p"))
    shift = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["n"] * (p["mean"] - F.col("_c"))) / F.nullif("n", F.lit(0))
    about = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - F.col("_c")) * (p["mean"] - F.col("_c")))
    out = held.withColumns({"_d": shift, "_s": about})
    some = lambda c: F.when(F.col("n") > 0, c)
    return out.select(*by, "n", "missing", some(F.col("_c") + F.col("_d")).alias("mean"), some(F.greatest(F.col("_s") - F.col("n") * F.col("_d") * F.col("_d"), F.lit(0.0))).alias("m2"))


def mean_and_sd(parts: DataFrame) -> DataFrame:
    """Adds the sample standard deviation to moments."""
    return parts.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0)))))


def per_source_and_pooled(parts: DataFrame, by: list[str], may_pool: DataFrame | None = None) -> DataFrame:
    """The parts by source and, as source 'pooled', their sum over the sources that may be pooled."""
    pooling = parts if may_pool is None else parts.join(may_pool.where("may_pool").select("source"), "source", "left_semi")
    return parts.unionByName(merged(pooling, by).withColumn("source", F.lit("pooled")))


def edges(low: float, high: float, width: float) -> list[float]:
    """Edges of bins of one width from low on; the last may lie beyond high."""
    import math

    return [low + i * width for i in range(math.ceil((high - low) / width) + 1)]


def histogram(frame: DataFrame, var: str, at: list[float], by: list[str]) -> DataFrame:
    """Counts of the half-open bins between edges, -1 below, number of bins above, null missing; every bin has a row."""
    x = F.when(~F.isnan(var), F.col(var)).cast("double")
    bounds = F.array(*(F.lit(float(e)) for e in at))
    even = all(abs((b - a) - (at[1] - at[0])) < 1e-9 * abs(at[1] - at[0]) for a, b in zip(at, at[1:]))
    if even:  # a guess from the range, which rounding may put beside the bin: the edges decide
        guess = (F.width_bucket(x, F.lit(float(at[0])), F.lit(float(at[-1])), F.lit(len(at) - 1)) - 1).cast("int")
        search = F.when(x < F.get(bounds, guess), guess - 1).when(x >= F.get(bounds, guess + 1), guess + 1).otherwise(guess)
    else:
        search = F.size(F.filter(bounds, lambda e: e <= x)) - 1
    counts = frame.groupBy(*by, F.when(x.isNotNull(), search.cast("int")).alias("bin")).agg(F.count("*").alias("n"))
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("bin", F.lit(-2)).alias("b"), "n"))).alias("_m"))  # a few bins
    spread = held.select(*by, "_m", F.explode(F.concat(F.array(F.lit(-2)), F.sequence(F.lit(-1), F.lit(len(at) - 1)))).alias("b"))
    inside = F.col("b").between(0, len(at) - 2)
    return spread.select(*by, F.when(F.col("b") > -2, F.col("b")).alias("bin"), F.coalesce(F.col("_m")[F.col("b")], F.when(inside, F.lit(0))).cast("long").alias("n")).where("n IS NOT NULL")


def frequency(frame: DataFrame, var: str, by: list[str]) -> DataFrame:
    """Counts by level; null is the level (missing)."""
    return frame.groupBy(*by, F.coalesce(F.col(var).cast("string"), F.lit("(missing)")).alias("level")).agg(F.count("*").alias("n"))


def observation_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many patients have how many observations."""
    each = rows.groupBy(*dict.fromkeys((*by, "source", "pid"))).agg(F.count("*").alias("observations"))
    return each.groupBy(*by, "observations").agg(F.count("*").alias("n"))


def missingness(frame: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """var, missing and present of each variable: one pass for all."""
    told = frame.groupBy(*by).agg(*(f.alias(f"{c}{i}") for i, v in enumerate(names) for c, f in (("m", F.count_if(F.col(v).isNull())), ("p", F.count(v)))))
    cells = F.array(*(F.struct(F.lit(v).alias("var"), F.col(f"m{i}").alias("missing"), F.col(f"p{i}").alias("present")) for i, v in enumerate(names)))
    return told.select(*by, F.explode(cells).alias("x")).select(*by, "x.*")


def rows_by_organisation(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows by organisation; null is one that is not recorded."""
    return rows.groupBy(*by, F.coalesce("org", F.lit("(not recorded)")).alias("org")).agg(F.count("*").alias("n"))


def crosstab(frame: DataFrame, row: str, col: str) -> DataFrame:
    return frame.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias(a) for c, a in ((row, "row"), (col, "col")))).agg(F.count("*").alias("n"))


def chi_square(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """chi2 (uncorrected) and dof of a table of row, col, n for each of `by`; null for fewer than two rows or columns.

    The sum of (n - e)^2 / e over the grid is t * sum(n^2 / (row total * column total)) - t, which needs no empty cells.
    """
    by = by or []
    margins = cells.select(*by, "row", "col", "n", *(F.sum("n").over(Window.partitionBy(*by, k)).alias(f"{k}_total") for k in ("row", "col")))
    found = margins.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n") / (F.col("row_total") * F.col("col_total"))).alias("s"), F.count_distinct("row").alias("r"), F.count_distinct("col").alias("c"))
    enough = (F.col("r") > 1) & (F.col("c") > 1)
    return found.select(*by, *([F.col("t").alias("n")] if by else []), F.when(enough, F.col("t") * F.col("s") - F.col("t")).alias("chi2"), F.when(enough, (F.col("r") - 1) * (F.col("c") - 1)).alias("dof"))


def pearson(frame: DataFrame, pairs: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """n and r of each pair over rows that have both; r is null for n < 3 or no variance."""
    sums = []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
        sums += [F.count(a).alias(f"n{i}"), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{i}"), F.min(a).alias(f"la{i}"), F.max(a).alias(f"ha{i}"), F.min(b).alias(f"lb{i}"), F.max(b).alias(f"hb{i}")]
    whole = frame.groupBy(*by).agg(*sums)  # one pass for all pairs
    varies = lambda i: (F.col(f"ha{i}") > F.col(f"la{i}")) & (F.col(f"hb{i}") > F.col(f"lb{i}"))
    found = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n{i}").alias("n"), F.when((F.col(f"n{i}") >= 3) & varies(i), F.nanvl(F.col(f"r{i}"), F.lit(None).cast("double"))).alias("r")) for i, (x, y) in enumerate(pairs)))
    return whole.select(*by, F.explode(found).alias("_f")).select(*by, "_f.*")


def spearman(frame: DataFrame, x: str, y: str, by: str = "source") -> DataFrame:
    """n and rho of each of `by`, with average ranks."""
    both = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both.select(by, x, y), x, [by], "rx"), y, [by], "ry")
    return pearson(ranked, [("rx", "ry")], [by]).select(by, "n", F.col("r").alias("rho"))


def weighted_mean(parts: DataFrame, value: str, weight: str) -> DataFrame:
    known = parts.where(F.col(value).isNotNull())
    return known.agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))).alias(value), F.sum(weight).alias(weight))


def welch(summary: DataFrame, group: str = "group", by: list[str] | None = None) -> DataFrame:
    """Every pair of groups a < b of summary rows (group, n, mean, sd), within each of `by`: b - a, standardised
    difference, t and dof; with `by` also n, that of the smaller group, and the standard error. Summary rows are few."""
    by = by or []
    names = ("n", "mean", "sd")
    a = summary.select(*by, F.col(group).alias("a"), *(F.col(c).alias(f"{c}_a") for c in names))
    b = summary.select(*(F.col(c).alias(f"_{c}") for c in by), F.col(group).alias("b"), *(F.col(c).alias(f"{c}_b") for c in names))
    on = F.col("a") < F.col("b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    pairs = a.join(F.broadcast(b), on)  # a row for each group on both sides
    pairs = pairs.withColumns({"va": F.expr("sd_a * sd_a / n_a"), "vb": F.expr("sd_b * sd_b / n_b"), "diff": F.expr("mean_b - mean_a")})
    pooled = F.sqrt(F.expr("((n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b) / nullif(n_a + n_b - 2, 0)"))
    dof = F.expr("(va + vb) * (va + vb) / nullif(va * va / nullif(n_a - 1, 0) + vb * vb / nullif(n_b - 1, 0), 0)")
    more = [F.least("n_a", "n_b").alias("n"), F.sqrt(F.col("va") + F.col("vb")).alias("error")] if by else []
    return pairs.select(*by, *more, "a", "b", "diff", (F.col("diff") / F.nullif(pooled, F.lit(0.0))).alias("smd"), (F.col("diff") / F.nullif(F.sqrt(F.col("va") + F.col("vb")), F.lit(0.0))).alias("t"), dof.alias("dof"))


def over_time(points: DataFrame, bin_days: int, low: int, high: int, by: list[str]) -> DataFrame:
    """n, mean and sd of values by bins of days from the index on, with a row for every bin; days outside are left out."""
    inside = points.where((F.col("day_offset") >= low) & (F.col("day_offset") < high))
    place = F.floor((F.col("day_offset") - low) / bin_days).cast("int")
    parts = moments(inside.withColumn("bin", place), "value", [*by, "bin"])
    bins = points.select(*by).distinct() if by else points.sparkSession.range(1).select()
    spine = bins.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit((high - low - 1) // bin_days))))
    full = spine.join(parts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return mean_and_sd(full).withColumn("day_from", F.lit(low) + F.col("bin") * bin_days)


def normal_equations(frame: DataFrame, outcome: str, predictors: list[str]) -> DataFrame:
    """(i, j, value) of X'X, X'y (j = p) and y'y (i = j = p), over complete rows; column 0 is the intercept."""
    complete = frame.select(outcome, *predictors).na.drop()
    columns = [F.lit(1.0), *(F.col(p).cast("double") for p in predictors), F.col(outcome).cast("double")]
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = complete.agg(*(F.sum(columns[i] * columns[j]).alias(f"s_{i}_{j}") for i, j in cells))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("value")) for i, j in cells))).alias("c")).select("c.*")


def solve(cells: list[tuple[int, int, float]]) -> dict | None:
    """Coefficients, n and residual sd from the collected normal equations; None when they are singular."""
    import numpy as np

    p = max(j for _, j, _ in cells)
    whole = np.zeros((p + 1, p + 1))
    for i, j, value in cells:
        whole[i, j] = whole[j, i] = value
    xtx, xty, n = whole[:p, :p], whole[:p, p], whole[0, 0]
    scale = np.sqrt(np.maximum(np.diag(xtx), 1e-300))
    if np.linalg.matrix_rank(xtx / np.outer(scale, scale), tol=1e-10) < p:
        return None
    beta = np.linalg.solve(xtx, xty)
    rest = max(0.0, whole[p, p] - beta @ xty)
    return {"coefficients": beta.tolist(), "n": int(n), "residual_sd": float(np.sqrt(rest / (n - p))) if n > p else None}


def coefficients(frame: DataFrame, outcome: str, predictors: list[str], by: str, k: int) -> DataFrame:
    """by, intercept, a column for each predictor, and n: least squares over the complete rows of each of `by`, from its
    means and covariances; null for fewer than max(k, p + 2) rows or when predictors depend on each other."""
    import numpy as np
    import pandas as pd

    complete = frame.select(by, *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*predictors, outcome]))).na.drop()
    p = len(predictors)
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = complete.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(f"_{i}").alias(f"m{i}") for i in range(p + 1)), *(F.covar_pop(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i, j in cells))
    least = max(k, p + 2)

    def one(batches):  # a row for each group
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                told = [None] * (p + 1)
                cov = np.zeros((p + 1, p + 1))
                for i, j in cells:
                    cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
                scale = np.sqrt(np.diag(cov)[:p])
                if r["n"] >= least and (scale > 0).all() and np.linalg.matrix_rank(cov[:p, :p] / np.outer(scale, scale), tol=1e-9) == p:
                    beta = np.linalg.solve(cov[:p, :p] / np.outer(scale, scale), cov[:p, p] / scale) / scale
                    told = [r[f"m{p}"] - sum(b * r[f"m{i}"] for i, b in enumerate(beta)), *beta]
                rows.append((r[by], *told, r["n"]))
            yield pd.DataFrame(rows, columns=[by, "intercept", *predictors, "n"])

    kind = frame.schema[by].dataType.simpleString()
    return sums.mapInPandas(one, f"`{by}` {kind}, intercept double, " + "".join(f"`{c}` double, " for c in predictors) + "n long")


def hide_thin(curve: DataFrame, k: float) -> DataFrame:
    """A survival curve with the figures of periods of fewer than k at risk hidden; what comes after them stays."""
    thin = F.col("at_risk") < k
    return curve.withColumn("suppressed", thin).withColumns({c: F.when(~thin, F.col(c)) for c in ("events", "at_risk", "survival")})


def kaplan_meier(periods: DataFrame) -> DataFrame:
    """The survival curve from period, events, at_risk rows; periods with nobody at risk are left out."""
    sums = periods.groupBy("period").agg(F.sum("events").alias("events"), F.sum("at_risk").alias("at_risk")).where("at_risk > 0")
    sofar = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each period
    over = F.max(F.when(F.col("events") >= F.col("at_risk"), 1).otherwise(0)).over(sofar) == 1
    logs = F.sum(F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)).over(sofar)
    return sums.withColumn("survival", F.when(over, F.lit(0.0)).otherwise(F.exp(logs)))


def protected_sketch(rows: DataFrame, var: str, k: int, by: list[str], order: str = "seq", most: int = 200) -> DataFrame:
    """Centroids (mean, weight), each of k values or more, of neighbouring values; `most` or so for each of `by`."""
    ranked = numbered(rows.where(F.col(var).isNotNull()).select(*by, var, order), var, by, [F.col(order)])
    step = F.greatest(F.lit(k), F.ceil(F.col("_count") / most))
    group = F.least(F.floor((F.col("_n") - 1) / step), F.greatest(F.floor(F.col("_count") / step) - 1, F.lit(0)))
    return ranked.groupBy(*by, group.alias("g")).agg(F.avg(var).alias("mean"), F.count("*").alias("weight"))


def sketch_quantiles(centroids: DataFrame, qs: dict[str, float], by: list[str]) -> DataFrame:
    """Named quantiles of the union of centroids for each of `by`, by interpolation, with n, the weight of all."""
    order = Window.partitionBy(*by).orderBy("mean", "weight")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("weight").over(Window.partitionBy(*by))
    placed = centroids.select(*by, "mean", "weight", upto.alias("cum"), whole.alias("tot"), F.lag("mean").over(order).alias("prev"))

    def quantile(q: float) -> Column:
        value = F.coalesce(F.col("prev") + (F.col("mean") - F.col("prev")) * ((q * F.col("tot") - (F.col("cum") - F.col("weight"))) / F.col("weight")), F.col("mean"))
        reached = F.col("cum") >= q * F.col("tot")
        return F.min_by(F.when(reached, value), F.when(reached, F.col("cum")))

    return placed.groupBy(*by).agg(F.max("tot").alias("n"), *(quantile(q).alias(name) for name, q in qs.items()))


def sketch_quantile(centroids: DataFrame, q: float) -> DataFrame:
    """A quantile of the union of centroids, by interpolation; there are few of them."""
    order = Window.orderBy("mean", "weight")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    placed = centroids.select("mean", "weight", upto.alias("cum"), whole.alias("tot"), F.lag("mean").over(order).alias("prev"))
    value = F.coalesce(F.col("prev") + (F.col("mean") - F.col("prev")) * ((q * F.col("tot") - (F.col("cum") - F.col("weight"))) / F.col("weight")), F.col("mean"))
    return placed.where(F.col("cum") >= q * F.col("tot")).orderBy("cum").limit(1).select(value.alias("quantile"))


def summary(rows: DataFrame, var: str, by: list[str]) -> DataFrame:
    """n, least, most, mean, population sd and exact quartiles."""
    out = rows.groupBy(*by).agg(F.count(var).alias("n"), F.min(var).alias("least"), F.max(var).alias("most"), F.avg(var).alias("mean"), F.stddev_pop(var).alias("sd"))
    return with_percentiles(out, rows, var, by, QUARTILES)


#: Names and shares of the quartiles.
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def with_percentiles(out: DataFrame, rows: DataFrame, var: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """The summary rows of each of `by` with exact percentiles of the variable; null where there are no values."""
    found = percentiles(rows, var, by, at).withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.join(found, on, "left").drop(*(f"_{c}" for c in by))


def equal_width(rows: DataFrame, var: str, by: list[str], buckets: int = 20) -> DataFrame:
    """bucket, lo, hi and n of equally wide buckets between the least and the largest value of each of `by`."""
    known = rows.where(F.col(var).isNotNull()).select(*by, var)
    spans = known.groupBy(*by).agg(F.min(var).alias("mn"), F.max(var).alias("mx"))  # a row for each of `by`
    ends = known.join(spans, by) if by else known.crossJoin(F.broadcast(spans))
    width = (F.col("mx") - F.col("mn")) / buckets
    bucket = F.when(F.col("mx") > F.col("mn"), F.least(F.floor((F.col(var) - F.col("mn")) / F.nullif(width, F.lit(0.0))), F.lit(buckets - 1))).otherwise(0).cast("int")
    counts = ends.groupBy(*by, bucket.alias("bucket"), "mn", "mx").agg(F.count("*").alias("n"))
    return counts.select(*by, "bucket", (F.col("mn") + F.col("bucket") * width).alias("lo"), F.when(F.col("bucket") == buckets - 1, F.col("mx") + 1e-9).otherwise(F.col("mn") + (F.col("bucket") + 1) * width).alias("hi"), "mn", "mx", "n")


def rebucketed(parts: DataFrame, buckets: int = 20) -> DataFrame:
    """Buckets over the whole range from the buckets of sources, each at its middle; there are few of them."""
    whole = Window.partitionBy(F.lit(0))
    ends = parts.select("lo", "hi", "n", F.min("mn").over(whole).alias("g0"), F.max("mx").over(whole).alias("g1"))
    width = (F.col("g1") - F.col("g0")) / buckets
    middle = (F.col("lo") + F.col("hi")) / 2
    bucket = F.least(F.greatest(F.floor((middle - F.col("g0")) / F.nullif(width, F.lit(0.0))), F.lit(0)), F.lit(buckets - 1))
    return ends.groupBy(F.coalesce(bucket, F.lit(0)).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))


def combined(parts: DataFrame) -> DataFrame:
    """n, mean and population sd of the whole from those of its parts."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    second = F.sum(F.col("n") * (F.col("sd") * F.col("sd") + F.col("mean") * F.col("mean"))) / F.sum("n")
    return parts.agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("sd"))


def bucket_text(text: Column) -> list[Column]:
    """lo, hi and n of '[lo,hi):n'; null for other text."""
    form = r"^\[([^,]+),([^)]+)\):(\d+)$"
    return [F.regexp_extract(text, form, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate((("lo", "double"), ("hi", "double"), ("n", "bigint")), 1)]
