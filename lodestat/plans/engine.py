"""Runs a spec over long observations: one lazy plan for each analysis, tidy rows as the result.

Rows of the result: analysis (its number in the spec), kind, source ('pooled' for all that may pool), var, key, n, value
and suppressed. Both grains go through disclosure control. Policies are checked before anything is read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import tails
from lodestat.functions.distributions import t_quantile
from lodestat.operators import digests, disclosure, frame, statistics
from lodestat.operators.frame import Variable

from .spec import NAMES, AnalysisSpec

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
RESULT = ["analysis", "kind", "source", "var", "key", "n", "value", "suppressed"]
FLAT = {"demographics.sex": "sex", "meta.author_org": "org"}


@dataclass(frozen=True)
class SourcePolicy:
    """What a source allows."""

    source: str
    purposes: tuple[str, ...] = ()
    analyses: tuple[str, ...] | None = None
    k_min: int = 5
    may_pool: bool = True
    own_org_only: str | None = None


class Refused(PermissionError):
    """A source's policy does not allow the spec."""


def admit(spec: AnalysisSpec, policies: list[SourcePolicy]) -> disclosure.Policy:
    """The strictest thresholds of the spec's sources, or Refused."""
    known = {p.source: p for p in policies}
    if missing := [s for s in spec.sources if s not in known]:
        raise Refused("no policy for " + ", ".join(missing))
    strict = disclosure.Policy()
    for name in spec.sources:
        p = known[name]
        if spec.purpose not in p.purposes:
            raise Refused(f"{name} does not answer for {spec.purpose}")
        if p.analyses is not None and (kinds := sorted({a["kind"] for a in spec.analyses} - set(p.analyses))):
            raise Refused(f"{name} does not answer {', '.join(kinds)}")
        strict = strict.stricter(disclosure.Policy(k_min=p.k_min))
    return strict


def prepared(rows: DataFrame, spec: AnalysisSpec, policies: list[SourcePolicy]) -> DataFrame:
    """The cohort members' rows of the spec's sources, with day offsets, that each source may use."""
    chosen = rows.where(F.col("source").isin(list(spec.sources)))
    for p in policies:
        if p.own_org_only is not None:
            chosen = chosen.where((F.col("source") != p.source) | (F.col("org") == p.own_org_only))
    dated = frame.with_day_offset(chosen, spec.index_event)
    criteria = [(c["observation"], NAMES.get(c["op"], c["op"]), float(c["value"])) for c in spec.include]
    return dated.join(frame.members(dated, criteria), frame.PATIENT, "left_semi")


def patients(rows: DataFrame, spec: AnalysisSpec) -> DataFrame:
    series = [Variable(v["name"], v["from"], v["agg"], tuple(v["window_days"]) if v.get("window_days") else None) for v in spec.variables if v["from"] not in FLAT]
    flat = {v["name"]: FLAT[v["from"]] for v in spec.variables if v["from"] in FLAT}
    made = frame.patient_frame(rows, series, tuple(dict.fromkeys(flat.values())))
    return made.withColumns({name: F.col(c) for name, c in flat.items()})


def _tidy(out: DataFrame, number: int, kind: str, k: int, var, key, value: str | None) -> DataFrame:
    """Result rows of figures with a count n; where a column gone is true, the figure is hidden whatever its count."""
    text = lambda x: x if not isinstance(x, str) else F.lit(x)
    figure = (F.col(value) if value else F.lit(None)).cast("double")
    columns = [("analysis", F.lit(number)), ("kind", F.lit(kind)), ("source", F.col("source")), ("var", text(var)), ("key", text(key).cast("string")), ("n", F.col("n").cast("long")), ("value", figure)]
    shown = out.select(*(c.alias(a) for a, c in columns))
    if "gone" not in out.columns:
        return disclosure.suppressed(shown, k, "n", ("value",)).select(*RESULT)
    shown = out.select("gone", *(c.alias(a) for a, c in columns))
    hide = F.coalesce(F.col("gone"), F.lit(False)) | F.coalesce(disclosure.hidden(F.col("n"), k), F.lit(False))
    shown = shown.withColumn("suppressed", hide)
    return shown.withColumns({c: F.when(~F.col("suppressed"), F.col(c)) for c in ("n", "value")}).select(*RESULT)


def _figures(summary: DataFrame, names: list[str]) -> DataFrame:
    """A row for each of these columns: its name as figure, its value as told; the summary is computed once."""
    return summary.withColumn("_f", F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("told")) for c in names)))).select("*", "_f.*")


def _edges(pooled: DataFrame, var: str, span: list[float] | None, width: float | None, k: int) -> list[float]:
    """Edges of a histogram: of the range asked for, else of the inner 98 % by a digest whose centroids describe k patients
    or more, rounded outward to whole widths. Without a width it is 1, 2 or 5 times a power of ten. No edge is a
    patient's value; with fewer than k patients there is one bin from 0 on."""
    if span:
        low, high = span
    else:
        sketch = digests.merged(digests.digests(pooled, var, ["source"], k).select("digest"), [], k)
        found = sketch.select(digests.quantiles(F.col("digest"), [0.01, 0.99]).alias("q")).first()
        low, high = (found.q if found else None) or (0.0, 0.0)
    if not width:
        rough = max((high - low) / 20, 1e-9) if high > low else 1.0
        power = 10.0 ** math.floor(math.log10(rough))
        width = power * next(step for step in (1, 2, 5, 10) if step * power >= rough * (1 - 1e-9))
    if not span:
        low, high = math.floor(low / width) * width, math.ceil(high / width) * width
    return statistics.edges(low, high if high > low else low + width, width)


def _both_grains(counts: DataFrame, by: list[str], pooling: DataFrame) -> DataFrame:
    whole = counts.join(F.broadcast(pooling), "source", "left_semi").groupBy(*by).agg(F.sum("n").alias("n"))
    return counts.select("source", *by, "n").unionByName(whole.withColumn("source", F.lit("pooled")))


def run_spec(rows: DataFrame, spec: AnalysisSpec, policies: list[SourcePolicy], held: list[DataFrame] | None = None) -> DataFrame:
    """All figures of the spec; refused before a plan is built where a policy says so.

    The cohort's rows and the patient frame, which every analysis reads, are kept in memory or on disk by Spark (lost
    parts are computed again). They are appended to `held`, so that a caller who has read the result can unpersist just
    these. Quartiles come from a sketch without single patients'
    values. Group means are told for all groups of a source or for none.
    """
    limits = admit(spec, policies)
    k = limits.k_min
    pooling = rows.sparkSession.createDataFrame([(p.source, p.may_pool) for p in policies], "source string, may_pool boolean").where("may_pool")
    long = prepared(rows, spec, policies).persist(StorageLevel.MEMORY_AND_DISK)
    wide = patients(long, spec).persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held += [long, wide]
    kinds = dict(wide.dtypes)
    parts = []
    for number, a in enumerate(spec.analyses):
        kind = a["kind"]
        add = lambda out, var, key, value=None, number=number, kind=kind: parts.append(_tidy(out, number, kind, k, var, key, value))
        if kind in ("describe", "frequency"):
            for var in a["vars"]:
                if kind == "frequency" or kinds[var] == "string":
                    add(_both_grains(statistics.frequency(wide, var, ["source"]), ["level"], pooling), var, F.col("level"))
                    continue
                sums = statistics.moments(wide, var, ["source"])
                both = tails.with_interval(statistics.mean_and_sd(statistics.per_source_and_pooled(sums, [], pooling)))
                add(_figures(both, ["mean", "sd", "low", "high"]), var, F.col("figure"), "told")
                centroids = statistics.protected_sketch(wide, var, k, ["source"], "pid").select("source", "mean", "weight")
                whole = centroids.join(F.broadcast(pooling), "source", "left_semi").withColumn("source", F.lit("pooled"))
                quartiles = statistics.sketch_quantiles(centroids.unionByName(whole), QUARTILES, ["source"])
                add(_figures(quartiles, list(QUARTILES)), var, F.col("figure"), "told")
                add(both.select("source", F.col("missing").alias("n")), var, "missing")
        elif kind == "histogram":
            bins = a.get("bins") or {}
            at = _edges(wide.join(F.broadcast(pooling), "source", "left_semi"), a["var"], bins.get("range"), bins.get("width"), k)
            counts = _both_grains(statistics.histogram(wide, a["var"], at, ["source"]), ["bin"], pooling)
            inside = F.col("bin").between(0, len(at) - 2)
            labels = F.array(*(F.lit(f"{x:g}–{y:g}") for x, y in zip(at, at[1:])))
            add(disclosure.safe_bins(counts.where(inside).select("source", F.col("bin").alias("at"), F.get(labels, "bin").alias("label"), "n"), k), a["var"], F.col("label"))
            beside = F.when(F.col("bin").isNull(), "(missing)").when(F.col("bin") < 0, "(below)").otherwise("(above)")
            add(counts.where(F.col("bin").isNull() | ~inside), a["var"], beside)
        elif kind == "crosstab":
            cells = wide.groupBy("source", *(F.coalesce(F.col(a[c]).cast("string"), F.lit("(missing)")).alias(c) for c in ("row", "col"))).agg(F.count("*").alias("n"))
            both = _both_grains(cells, ["row", "col"], pooling)
            add(disclosure.safe_grids(both, k), f"{a['row']}|{a['col']}", F.concat_ws("|", "row", "col"))
            tested = statistics.chi_square(both, ["source"])
            tested = tested.withColumn("p", tails.chi_square_tail(F.col("chi2"), F.col("dof")))
            add(_figures(tested, ["chi2", "dof", "p"]), f"{a['row']}|{a['col']}", F.col("figure"), "told")
        elif kind == "correlation":
            pairs = [(x, y) for i, x in enumerate(a["vars"]) for y in a["vars"][i + 1 :]]
            pooled_rows = wide.join(F.broadcast(pooling), "source", "left_semi")
            if a.get("method", "pearson") == "spearman":
                for x, y in pairs:
                    by_source = statistics.spearman(wide, x, y)
                    whole = statistics.weighted_mean(by_source.join(F.broadcast(pooling), "source", "left_semi"), "rho", "n")
                    out = by_source.unionByName(whole.withColumn("source", F.lit("pooled")))
                    add(out.withColumn("rho", F.when(F.col("n") >= limits.min_correlation, F.col("rho"))), f"{x}|{y}", "rho", "rho")
            else:
                out = statistics.pearson(wide, pairs, ["source"]).unionByName(statistics.pearson(pooled_rows.withColumn("source", F.lit("pooled")), pairs, ["source"]))
                add(out.withColumn("r", F.when(F.col("n") >= limits.min_correlation, F.col("r"))), F.concat_ws("|", "x", "y"), "r", "r")
        elif kind == "compare_groups":
            where = {g["name"]: [(v, op, x) for v, ops in g["where"].items() for op, x in ops.items()] for g in spec.groups}
            members = frame.grouped(wide, where, spec.allow_overlapping_groups)
            for var in a["vars"]:
                sums = statistics.moments(members, var, ["source", "group"])
                both = statistics.mean_and_sd(statistics.per_source_and_pooled(sums, ["group"], pooling))
                every = Window.partitionBy("source")  # a row for each group; all groups are told of, or none
                safe = (F.min("n").over(every) >= k) & (F.count("*").over(every) == len(where))
                both = both.withColumn("gone", ~safe)
                add(_figures(both, ["mean", "sd"]), var, F.concat_ws(" ", "group", "figure"), "told")
                pairs = statistics.welch(both.where("NOT gone"), "group", ["source"])
                reach = tails.t_quantile(0.975, F.col("dof")) * F.col("error")
                pairs = pairs.withColumns({"p": tails.t_two_sided(F.col("t"), F.col("dof")), "low": F.col("diff") - reach, "high": F.col("diff") + reach})
                figures = _figures(pairs, ["diff", "smd", "t", "dof", "p", "low", "high"])
                add(figures, var, F.concat(F.col("b"), F.lit(" - "), F.col("a"), F.lit(" "), F.col("figure")), "told")
        elif kind == "over_time":
            declared = next(v for v in spec.variables if v["name"] == a["var"])
            low, high = a["range_days"]
            points = frame.series(long, declared["from"])
            pooled_points = points.join(F.broadcast(pooling), "source", "left_semi").withColumn("source", F.lit("pooled"))
            both = statistics.over_time(points.unionByName(pooled_points), a["bin_days"], low, high, ["source"])
            both = tails.with_interval(both)
            day = [F.lit("day "), F.col("day_from").cast("string"), F.lit("–"), (F.col("day_from") + a["bin_days"] - 1).cast("string"), F.lit(" "), F.col("figure")]
            add(_figures(both, ["mean", "low", "high"]), a["var"], F.concat(*day), "told")
        elif kind == "completeness":
            add(_both_grains(statistics.observation_counts(long, ["source"]), ["observations"], pooling), "observations per patient", F.col("observations"))
            names = [v["name"] for v in spec.variables]
            if names:
                told = statistics.missingness(wide, names, ["source"]).unpivot(["source", "var"], ["missing", "present"], "key", "n")
                add(_both_grains(told, ["var", "key"], pooling), F.col("var"), F.col("key"))
            add(_both_grains(statistics.rows_by_organisation(long, ["source"]), ["org"], pooling), "rows by organisation", F.col("org"))
        elif kind == "linear_regression":
            pooled_rows = wide.join(F.broadcast(pooling), "source", "left_semi").withColumn("source", F.lit("pooled"))
            fits = statistics.coefficients(wide.unionByName(pooled_rows), a["outcome"], a["predictors"], "source", k)
            names = ["intercept", *a["predictors"]]
            fits = fits.withColumn("gone", F.col("intercept").isNull())
            add(_figures(fits, names), a["outcome"], F.when(F.col("figure") == "intercept", "(intercept)").otherwise(F.col("figure")), "told")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def confidence_interval(mean: float, sd: float, n: int, level: float = 0.95) -> tuple[float, float]:
    """Of a mean, by Student's t; on the driver, for a merged figure."""
    half = t_quantile((1 + level) / 2, n - 1) * sd / n**0.5
    return mean - half, mean + half


def provenance(spec: AnalysisSpec, policies: list[SourcePolicy]) -> dict:
    """What a report says about where its figures come from."""
    return {"spec_hash": spec.digest(), "title": spec.title, "purpose": spec.purpose, "linkage": spec.linkage, "sources": [{"source": p.source, "k_min": p.k_min, "may_pool": p.may_pool} for p in policies if p.source in spec.sources]}
