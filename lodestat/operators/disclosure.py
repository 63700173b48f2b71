"""Disclosure control: what may be said about few patients."""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import percentiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the module


@dataclass(frozen=True)
class Policy:
    """Thresholds; k_min may not be below the floor."""

    k_min: int = 5
    floor: int = 5
    min_correlation: int = 10
    low: float = 0.05
    high: float = 0.95
    rounding: int = 0

    def __post_init__(self):
        if self.k_min < self.floor:
            raise ValueError(f"k_min {self.k_min} is below the floor {self.floor}")

    def stricter(self, other: Policy) -> Policy:
        return replace(self, **{field: (max if most else min)(getattr(self, field), getattr(other, field)) for field, most in STRICTER.items()})


#: Which of two thresholds is the stricter one: the larger (true) or the smaller.
STRICTER = {"k_min": True, "floor": True, "min_correlation": True, "low": True, "high": False, "rounding": True}


def hidden(n: Column, k: int) -> Column:
    """Whether a count may not be told; zero may."""
    return (n > 0) & (n < k)


def suppressed(frame: DataFrame, k: int, count: str = "n", also: tuple[str, ...] = ()) -> DataFrame:
    """The count, and figures that rest on it, null where it is hidden; and a column that says so."""
    hide = hidden(F.col(count), k)
    out = frame.withColumn("suppressed", hide)
    return out.withColumns({c: F.when(~F.col("suppressed"), F.col(c)) for c in (count, *also)})


def safe_range(rows: DataFrame, var: str, by: list[str], policy: Policy) -> DataFrame:
    """Percentiles in place of least and largest; null for fewer than k."""
    out = rows.groupBy(*by).agg(F.count(var).alias("n"))
    ends = percentiles(rows, var, by, {"_low": policy.low, "_high": policy.high}).withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    enough = F.col("n") >= policy.k_min
    return out.join(ends, on, "left").select(*by, F.when(enough, F.col("_low")).alias("low"), F.when(enough, F.col("_high")).alias("high"))


def strictest(policies: DataFrame) -> DataFrame:
    """One row: the strictest of policies (k_min, floor, min_correlation, low, high, rounding), as `Policy.stricter` merges two."""
    return policies.agg(*((F.max if most else F.min)(field).alias(field) for field, most in STRICTER.items()))


def patients_by_source(rows: DataFrame, k: int) -> DataFrame:
    """source, n and suppressed: the patients of each source, hidden where they are few; what an audit may say."""
    return suppressed(rows.groupBy("source").agg(F.count_distinct("pid").alias("n")), k)


def rounded(value: Column, step: int) -> Column:
    """To the nearest multiple of a step, halves to even ones."""
    return (F.bround(value / step) * step).cast("long") if step else value


def merge_small_bins(bins: list[tuple[str, int]], k: int) -> list[tuple[str, int | None]]:
    """Bins with counts of 1 to k-1 joined to the next, the last to the one before; a lone one has no count."""
    out: list[tuple[str, int | None]] = []
    for label, n in bins:
        if out and 0 < out[-1][1] < k:
            out[-1] = (f"{out[-1][0]}+{label}", out[-1][1] + n)
        else:
            out.append((label, n))
    while len(out) > 1 and 0 < out[-1][1] < k:
        label, n = out.pop()
        out[-1] = (f"{out[-1][0]}+{label}", out[-1][1] + n)
    return [(label, None if 0 < n < k else n) for label, n in out]


def suppress_table(cells: dict[tuple[str, str], int], rows: list[str], cols: list[str], k: int, margins: bool = True) -> set[tuple[str, str]]:
    """The cells of a grid to hide: small ones, and in each line with just one hidden cell another, so that margins do
    not give it away. Lines are gone through until none is left; a complement is the cell whose other line already has
    a hidden cell, then the smallest."""
    gone = {c for c in ((r, x) for r in rows for x in cols) if 0 < cells.get(c, 0) < k}
    if not margins:
        return gone
    lines = [[(r, x) for x in cols] for r in rows] + [[(r, x) for r in rows] for x in cols]
    changed = True
    while changed:
        changed = False
        for i, line in enumerate(lines):
            shut = [c for c in line if c in gone]
            free = [c for c in line if c not in gone and cells.get(c, 0) > 0] or [c for c in line if c not in gone]
            if len(shut) != 1 or not free:
                continue
            across = lambda c, by_row=i < len(rows): any(g[1] == c[1] if by_row else g[0] == c[0] for g in gone)
            gone.add(min(free, key=lambda c: (not across(c), cells.get(c, 0))))
            changed = True
    return gone


#: Cells of a grid, empty ones too, that one task holds; a larger table is an error, never cut short.
MAX_CELLS = 1_000_000


def safe_grids(cells: DataFrame, k: int, by: str = "source") -> DataFrame:
    """by, row, col, n and gone for every cell of each grid: empty cells have 0, gone says what primary or
    complementary suppression hides. A grid is merged already and has levels times levels cells."""

    def one(grid: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(grid["row"])), sorted(set(grid["col"]))
        if len(rows) * len(cols) > MAX_CELLS:
            raise ValueError(f"a table of {len(rows)} by {len(cols)} levels is too large to be protected")
        counts = {(r, c): int(n) for r, c, n in zip(grid["row"], grid["col"], grid["n"])}
        gone = suppress_table(counts, rows, cols, k)
        whole = [(grid[by].iloc[0], r, c, counts.get((r, c), 0), (r, c) in gone) for r in rows for c in cols]
        return pd.DataFrame(whole, columns=[by, "row", "col", "n", "gone"])

    return cells.select(by, "row", "col", F.col("n").cast("long").alias("n")).groupBy(by).applyInPandas(one, f"{by} string, row string, col string, n long, gone boolean")


def safe_bins(bins: DataFrame, k: int, by: str = "source") -> DataFrame:
    """by, label and n of each histogram (columns at, label, n; in order of at), small bins merged with the next; a
    lone small one has no count. There are as many rows as the histogram has bins."""

    def one(histogram: pd.DataFrame) -> pd.DataFrame:
        ordered = histogram.sort_values("at")
        merged = merge_small_bins([(label, int(n)) for label, n in zip(ordered["label"], ordered["n"])], k)
        out = pd.DataFrame({by: histogram[by].iloc[0], "label": [m[0] for m in merged]})
        return out.assign(n=pd.Series([m[1] for m in merged], dtype="Int64"))

    return bins.select(by, "at", "label", F.col("n").cast("long").alias("n")).groupBy(by).applyInPandas(one, f"{by} string, label string, n long")


def symmetric_differences(history: DataFrame, cohort: DataFrame, key: str = "pid") -> DataFrame:
    """cohort_no and the number of patients in just one of an earlier cohort and this one; history: cohort_no, key.

    |A| + |B| - 2 |A and B|: patients meet on their key, cohorts are only counted.
    """
    size = cohort.select(key).distinct().agg(F.count("*").alias("size_b"))
    both = history.distinct().join(cohort.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    counts = both.groupBy("cohort_no").agg(F.count("*").alias("size_a"), F.count("_in").alias("common"))
    return counts.join(F.broadcast(size)).select("cohort_no", (F.col("size_a") + F.col("size_b") - 2 * F.col("common")).alias("differ"))


def differencing_verdicts(differences: DataFrame, k: int) -> DataFrame:
    """Whether asking about the cohort would tell of fewer than k patients beside an earlier one."""
    return differences.withColumn("probe", hidden(F.col("differ"), k))


def guarded(history: DataFrame, cohort: DataFrame, owner: str, recipe: str, k: int, hard: bool = False, near: int = 2) -> DataFrame:
    """A verdict for each of the owner's earlier cohorts (history: owner, cohort_no, recipe, pid): differ, and `verdict`.

    ok; exempt for the same recipe; warn (refuse, if hard) where a difference of 1 to k-1 patients would be told of;
    near for less than `near` times k.
    """
    mine = history.where(F.col("owner") == owner)
    recipes = mine.groupBy("cohort_no").agg(F.min("recipe").alias("recipe"))
    found = symmetric_differences(mine.select("cohort_no", "pid"), cohort).join(recipes, "cohort_no")
    verdict = F.when(F.col("recipe") == recipe, "exempt").when(hidden(F.col("differ"), k), "refuse" if hard else "warn")
    return found.select("cohort_no", "differ", verdict.when(hidden(F.col("differ"), near * k), "near").otherwise("ok").alias("verdict"))


#: Shapes that no output may hold; a deployment adds its own.
IDENTIFIERS = {
    "guid": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "personnummer": r"\b(?:19|20)?\d{6}[-+]?\d{4}\b",
    "private_key": r"BEGIN [A-Z ]*PRIVATE KEY",
}


def texts_in(column: Column, kind: T.DataType, path: str) -> list[tuple[str, Column]]:
    """(path, array of texts) for every place of a value that holds text, at any depth: fields of structs (a.b), elements
    of arrays (a[]), keys (a.<key>) and values (a{}) of maps, and whole variants as JSON."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return [(path, F.array(column.cast("string")))]
    if isinstance(kind, T.VariantType):
        return [(path, F.array(F.to_json(column)))]
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in texts_in(column.getField(f.name), f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        inside = [sub for sub, _ in texts_in(F.lit(None).cast(kind.elementType), kind.elementType, "")]
        of = lambda i: lambda e: texts_in(e, kind.elementType, "")[i][1]
        return [(f"{path}[]{sub}", F.flatten(F.transform(F.coalesce(column, F.array().cast(kind)), of(i)))) for i, sub in enumerate(inside)]
    if isinstance(kind, T.MapType):
        keys = texts_in(F.map_keys(column), T.ArrayType(kind.keyType), "")
        values = texts_in(F.map_values(column), T.ArrayType(kind.valueType), "")
        return [(f"{path}.<key>{sub.removeprefix('[]')}", texts) for sub, texts in keys] + [(path + "{}" + sub.removeprefix("[]"), texts) for sub, texts in values]
    return []


def identifier_scan(frame: DataFrame, shapes: dict[str, str] = IDENTIFIERS) -> DataFrame:
    """finding, column and number of rows that hold it, for every shape and every place in the schema that holds text."""
    places = [x for f in frame.schema.fields for x in texts_in(F.col(f"`{f.name}`"), f.dataType, f.name)]
    if not places:
        return frame.sparkSession.createDataFrame([], "finding string, column string, n bigint")
    held = frame.select(*(texts.alias(f"t{i}") for i, (_, texts) in enumerate(places)))
    like = lambda form: lambda t: F.coalesce(t.rlike(form), F.lit(False))
    counts = held.agg(*(F.count_if(F.exists(f"t{i}", like(form))).alias(f"{name}|{i}") for i in range(len(places)) for name, form in shapes.items()))
    cells = F.array(*(F.struct(F.lit(name).alias("finding"), F.lit(path).alias("column"), F.col(f"`{name}|{i}`").alias("n")) for i, (path, _) in enumerate(places) for name in shapes))
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def checked(frame: DataFrame, shapes: dict[str, str] = IDENTIFIERS) -> DataFrame:
    """The frame, or an error that names every finding."""
    found = [f"{r['finding']} in {r['column']}" for r in identifier_scan(frame, shapes).where("n > 0").collect()]  # a row for each shape and place
    if found:
        raise PermissionError("identifiers in the result: " + ", ".join(sorted(found)))
    return frame
