"""Tests and models beyond sums: rank sums, exact tables, several tests at once, risk differences, logistic regression.

Each is built on counts or sums by source, so what leaves a task never grows with its rows.
"""

from __future__ import annotations

import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import tails

from .ranks import range_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the module


def same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Rows of both sides that agree in `by`, nulls too."""
    other = right.withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(other, on, how).drop(*(f"_{c}" for c in by))


def rank_sums(rows: DataFrame, var: str, group: str, pair: tuple[str, str], by: list[str]) -> DataFrame:
    """The Mann-Whitney test of two groups for each of `by`: n_a, n_b, u (of the first group), z and p.

    Rows are counted by value first, so equal values are one row; values are dealt to ranges, and only sums of ranges
    are added up along the whole. Ties share the mean of their ranks, and the variance is corrected for them; z has no
    continuity correction and is null when all values are equal. Rows without a value (null, NaN) or of other groups
    are left out; so are members of `by` without rows of both groups.
    """
    x = F.col(var).cast("double")
    known = rows.where(x.isNotNull() & ~F.isnan(x) & F.col(group).isin(*pair)).select(*by, x.alias("_x"), F.col(group).alias("_g"))
    values = known.groupBy(*by, "_x").agg(F.count_if(F.col("_g") == pair[0]).alias("_a"), F.count("*").alias("_t")).withColumn("_range", range_of("_x"))
    ranges = values.groupBy(*by, "_range").agg(F.sum("_t").alias("_in"))
    along = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lower = ranges.select(*by, "_range", F.coalesce(F.sum("_in").over(along), F.lit(0)).alias("_lower"))
    inside = Window.partitionBy(*by, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = same(values.withColumn("_before", F.coalesce(F.sum("_t").over(inside), F.lit(0))), lower, [*by, "_range"])
    rank = F.col("_lower") + F.col("_before") + (F.col("_t") + 1) / 2
    t = F.col("_t").cast("double")
    sums = placed.groupBy(*by).agg(F.sum("_a").alias("n_a"), F.sum(F.col("_t") - F.col("_a")).alias("n_b"), F.sum(F.col("_a") * rank).alias("_r"), F.sum(t * t * t - t).alias("_ties")).where("n_a > 0 AND n_b > 0")
    u = F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    spread = F.col("n_a").cast("double") * F.col("n_b") / 12 * (n + 1 - F.coalesce(F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0)), F.lit(0.0)))
    z = (u - F.col("n_a") * F.col("n_b") / 2) / F.sqrt(F.nullif(F.greatest(spread, F.lit(0.0)), F.lit(0.0)))
    found = sums.select(*by, "n_a", "n_b", u.alias("u"), z.alias("z"))
    return found.withColumn("p", tails.chi_square_tail(F.col("z") * F.col("z"), F.when(F.col("z").isNotNull(), F.lit(1))))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a table of two by two: all tables of its margins that are no likelier than it.

    Log-probabilities follow from one cell to the next, so no factorial is taken. Tables of large margins are looked at
    within 60 standard deviations of the likeliest one and as far as the table itself; what lies beyond has a
    probability below any double.
    """
    row, col, whole = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - whole), min(row, col)
    if low == high:
        return 1.0
    spread = 60 * np.sqrt(row * col / whole * (whole - row) / whole * (whole - col) / max(whole - 1, 1)) + 60
    middle = row * col / whole
    low, high = max(low, min(a, int(middle - spread))), min(high, max(a, int(middle + spread) + 1))
    x = np.arange(low, high, dtype=float)
    steps = np.log(row - x) + np.log(col - x) - np.log(x + 1) - np.log(whole - row - col + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    shares = np.exp(logs - logs.max())
    return float(min(1.0, shares[shares <= shares[a - low] * (1 + 1e-7)].sum() / shares.sum()))


def fisher_exact(tables: DataFrame, cells: tuple[str, str, str, str] = ("a", "b", "c", "d")) -> DataFrame:
    """Adds p, Fisher's exact two-sided p of the table in each row, and odds, the ratio ad / bc; null for null cells."""

    @F.pandas_udf("double")
    def find(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in r) else fisher_p(*map(int, r)) for r in zip(a, b, c, d)], dtype="float64")

    a, b, c, d = (F.col(x).cast("double") for x in cells)
    return tables.withColumns({"p": find(*(F.col(x) for x in cells)), "odds": a * d / F.nullif(b * c, F.lit(0.0))})


def holm(tests: DataFrame, p: str = "p", family: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Adds the p adjusted by Holm's step-down within each family of tests: the running maximum of (m - i + 1) times the
    i-th smallest p, 1 at most. Null p are no tests and stay null. A family has a row for each test, and so is small."""
    family = family or []
    known = F.col(p).isNotNull()
    whole = Window.partitionBy(*family, known)
    order = whole.orderBy(p)
    stepped = tests.withColumn("_step", F.col(p) * (F.count("*").over(whole) - F.row_number().over(order) + 1))
    sofar = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn(out, F.when(known, F.least(F.lit(1.0), sofar))).drop("_step")


def wilson(events, n, level: float = 0.95):
    """Low and high of the score interval of a share."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    n, share = n.cast("double"), events / F.nullif(n, F.lit(0))
    middle, reach = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (middle - reach) / (1 + z * z / n), (middle + reach) / (1 + z * z / n)


def risk_differences(counts: DataFrame, group: str, by: list[str], k: int, level: float = 0.95) -> DataFrame:
    """Every pair of groups a < b within each of `by`, from a row (n, events) for each group: the risk of b less that of
    a, with the interval of Newcombe's score method. A pair is hidden when either group has fewer than k members, or 1
    to k - 1 with the event or without it."""
    few = lambda c: (c > 0) & (c < k)
    low, high = wilson(F.col("events"), F.col("n"), level)
    hide = (F.col("n") < k) | few(F.col("events")) | few(F.col("n") - F.col("events"))
    told = counts.select(*by, F.col(group).alias("g"), "n", (F.col("events") / F.nullif("n", F.lit(0))).alias("risk"), low.alias("low"), high.alias("high"), hide.alias("hide"))
    one, other = (told.withColumnsRenamed({c: f"{c}_{side}" for c in ("n", "risk", "low", "high", "hide")} | {"g": side}) for side in "ab")
    pairs = same(one, other, by).where("a < b")  # a row for each group on both sides
    diff = F.col("risk_b") - F.col("risk_a")
    square = lambda x: x * x
    down = F.sqrt(square(F.col("risk_b") - F.col("low_b")) + square(F.col("high_a") - F.col("risk_a")))
    up = F.sqrt(square(F.col("high_b") - F.col("risk_b")) + square(F.col("risk_a") - F.col("low_a")))
    gone = F.col("hide_a") | F.col("hide_b")
    shown = lambda c: F.when(~gone, c)
    return pairs.select(*by, "a", "b", shown(F.least("n_a", "n_b")).alias("n"), shown(diff).alias("diff"), shown(diff - down).alias("low"), shown(diff + up).alias("high"), gone.alias("suppressed"))


#: A fit has not settled, as groups are separated, when a step moves a fitted log-odds of a standard unit further than this.
FARTHEST = 30.0


def logistic(frame: DataFrame, outcome: str, predictors: list[str], by: str, k: int, steps: int = 25, close: float = 1e-10, pooling: DataFrame | None = None) -> DataFrame:
    """Logistic regression of a 0/1 outcome for each of `by` and, with `pooling` (rows of `by` that may be pooled), for
    'pooled' as well: by, intercept, a column for each predictor, n, events, iterations and status.

    Newton's method on sums: each iteration is one aggregate over the rows, the score X'(y - p) and the information
    X'WX of each source; the whole takes the sums of its sources with coefficients of its own. Only complete rows count.
    Status is ok; suppressed for fewer than max(k, p + 2) rows or 1 to k - 1 with either outcome; constant when all
    outcomes agree; singular when predictors depend on each other; separated when the coefficients run away, or do not
    settle within the steps. Without ok there are no coefficients.
    """
    complete = frame.select(F.col(by).cast("string").alias("_by"), F.col(outcome).cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(predictors))).na.drop()
    if pooling is not None:
        whole = complete.join(F.broadcast(pooling.select(F.col(by).cast("string").alias("_by")).distinct()), "_by", "left_semi").withColumn("_by", F.lit("pooled"))
        complete = complete.unionByName(whole)
    p = len(predictors) + 1
    complete = complete.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = complete.groupBy("_by").agg(F.count("*").alias("n"), F.sum("_y").alias("events"), *(f(f"_x{i}").alias(f"{name}{i}") for i in range(p - 1) for name, f in (("mean", F.avg), ("sd", F.stddev_pop)))).collect()  # a row for each source
        fits, going = {}, {}
        for r in sums:
            n, events = r.n, int(r.events)
            low = min(events, n - events)
            status = "suppressed" if n < max(k, p + 1) or 0 < low < k else "constant" if not low else "singular" if any(not r[f"sd{i}"] > 0 for i in range(p - 1)) else None
            fits[r._by] = {"n": n, "events": events, "iterations": 0, "status": status, "beta": None}
            if status is None:
                going[r._by] = np.zeros(p)
                fits[r._by] |= {"mean": np.array([r[f"mean{i}"] for i in range(p - 1)]), "sd": np.array([r[f"sd{i}"] for i in range(p - 1)])}
        for turn in range(1, steps + 1):
            if not going:
                break
            for name, (score, information) in _slopes(complete, going, fits, p).items():
                fit = fits[name]
                fit["iterations"] = turn
                scale = np.sqrt(np.maximum(np.diag(information), 1e-300))
                if np.linalg.matrix_rank(information / np.outer(scale, scale), tol=1e-9) < p:
                    fit["status"] = "singular" if turn == 1 else "separated"
                    del going[name]
                    continue
                step = np.linalg.solve(information, score)
                going[name] = going[name] + step
                if np.abs(going[name]).max() > FARTHEST:
                    fit["status"] = "separated"
                    del going[name]
                elif np.abs(step).max() < close:
                    fit["status"], fit["beta"] = "ok", going.pop(name)
    finally:
        complete.unpersist()
    rows = []
    for name, fit in fits.items():
        coefficients = [None] * p
        if fit["beta"] is not None:
            slopes = fit["beta"][1:] / fit["sd"]
            coefficients = [float(fit["beta"][0] - slopes @ fit["mean"]), *map(float, slopes)]
        hide = fit["status"] == "suppressed"
        rows.append((name, *coefficients, None if hide else fit["n"], None if hide else fit["events"], fit["iterations"], fit["status"] or "separated"))
    kinds = f"`{by}` string, intercept double, " + "".join(f"`{c}` double, " for c in predictors) + "n long, events long, iterations int, status string"
    return frame.sparkSession.createDataFrame(rows, kinds)


def _slopes(complete: DataFrame, going: dict[str, np.ndarray], fits: dict[str, dict], p: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Score and information of each source that is still going, in standardised predictors: one aggregate."""
    known = complete.sparkSession.createDataFrame([(name, [float(x) for x in beta], [float(x) for x in fits[name]["mean"]], [float(x) for x in fits[name]["sd"]]) for name, beta in going.items()], "_by string, _b array<double>, _m array<double>, _s array<double>")
    rows = complete.join(F.broadcast(known), "_by")  # a row for each source
    x = [F.lit(1.0), *((F.col(f"_x{i}") - F.col("_m")[i]) / F.col("_s")[i] for i in range(p - 1))]
    rows = rows.select("_by", "_y", "_b", *(c.alias(f"_z{i}") for i, c in enumerate(x)))
    odds = sum((F.col("_b")[i] * F.col(f"_z{i}") for i in range(p)), F.lit(0.0))
    share = rows.withColumn("_p", 1 / (1 + F.exp(-odds)))
    rest, weight = F.col("_y") - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    told = share.groupBy("_by").agg(*(F.sum(rest * F.col(f"_z{i}")).alias(f"g{i}") for i in range(p)), *(F.sum(weight * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"h{i}_{j}") for i, j in cells)).collect()
    out = {}
    for r in told:
        information = np.zeros((p, p))
        for i, j in cells:
            information[i, j] = information[j, i] = r[f"h{i}_{j}"]
        out[r["_by"]] = np.array([r[f"g{i}"] for i in range(p)]), information
    return out
