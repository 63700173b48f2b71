"""Full figures of specs, kept cohorts, names, reports and the made-up population."""

import datetime
import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodestat.functions import distributions, tails
from lodestat.operators import cohorts, disclosure, statistics
from lodestat.plans import report
from lodestat.plans.engine import SourcePolicy, run_spec
from lodestat.plans.spec import AnalysisSpec
from lodestat.sources.synthetic import population

SPEC = {
    "title": "t", "purpose": "research", "sources": ["s0", "s1"], "index_event": {"observation": "x"}, "cohort": {"include": [{"observation": "x", "op": ">=", "value": 0}]},
    "variables": [{"name": "v", "from": "x", "agg": "mean"}, {"name": "n", "from": "x", "agg": "count"}],
    "groups": [{"name": "few", "where": {"n": {"lt": 4}}}, {"name": "many", "where": {"n": {"ge": 4}}}],
    "analyses": [{"kind": "describe", "vars": ["v"]}, {"kind": "compare_groups", "vars": ["v"]}, {"kind": "histogram", "var": "v", "bins": {"range": [30, 70], "width": 2}}],
}


def test_the_entry_imports_without_a_session():
    root = __file__.rsplit("/", 2)[0]
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 80"], cwd=root, capture_output=True).returncode == 0


def test_tails_as_columns(spark):
    rows = spark.createDataFrame([(2.0, 10.0), (None, 3.0), (1.0, 0.0)], "x double, dof double")
    found = rows.select(tails.t_two_sided(F.col("x"), F.col("dof")), tails.t_quantile(0.975, F.col("dof")), tails.chi_square_tail(F.col("x"), F.col("dof"))).collect()
    expected = (distributions.t_two_sided(2.0, 10.0), distributions.t_quantile(0.975, 10.0), distributions.chi_square_tail(2.0, 10.0))
    assert all(math.isclose(a, b) for a, b in zip(found[0], expected))
    assert found[1][0] is None and found[1][1] is not None and tuple(found[2]) == (None, None, None)


def test_grouped_sketch_quantiles_are_near_the_exact_ones(spark):
    rows = spark.range(6000).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("v"), F.col("id").alias("seq"))
    found = {r.source: r for r in statistics.sketch_quantiles(statistics.protected_sketch(rows, "v", 5, ["source"]), {"q1": 0.25, "q2": 0.5}, ["source"]).collect()}
    for r in rows.groupBy("source").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("q"), F.count("*").alias("n")).collect():
        assert found[r.source].n == r.n and all(abs(a - b) < 200 for a, b in zip(r.q, (found[r.source].q1, found[r.source].q2)))


def test_grids_and_bins_are_protected(spark):
    cells = spark.createDataFrame([("s", "a", "x", 3), ("s", "a", "y", 20), ("s", "b", "x", 9), ("s", "b", "y", 30), ("u", "a", "x", 7)], "source string, row string, col string, n long")
    found = {(r.source, r.row, r.col): r.gone for r in disclosure.safe_grids(cells, 5).collect()}
    assert found == {("s", "a", "x"): True, ("s", "a", "y"): True, ("s", "b", "x"): True, ("s", "b", "y"): True, ("u", "a", "x"): False}
    bins = spark.createDataFrame([("s", 0, "a", 2), ("s", 1, "b", 9), ("s", 2, "c", 0), ("s", 3, "d", 3), ("t", 0, "a", 1)], "source string, at int, label string, n long")
    merged = [(r.source, r.label, r.n) for r in disclosure.safe_bins(bins, 5).collect()]
    assert sorted(merged) == [("s", "a+b+c+d", 14), ("t", "a", None)]


def test_a_spec_tells_intervals_quartiles_and_tests(spark):
    rows, _ = population(spark, 2, 60, seed=3)
    rows = rows.withColumns({"sex": F.lit("u"), "org": F.lit(None).cast("string")})
    found = {(r.analysis, r.source, r.key): r for r in run_spec(rows, AnalysisSpec.parse(SPEC), [SourcePolicy(s, ("research",)) for s in SPEC["sources"]]).collect()}
    each = {r.pid: r for r in rows.groupBy("pid").agg(F.avg("value").alias("v"), F.count("*").alias("n")).collect()}
    values = [r.v for r in each.values()]
    n, mean = len(values), sum(values) / len(values)
    sd = math.sqrt(sum((x - mean) ** 2 for x in values) / (n - 1))
    half = distributions.t_quantile(0.975, n - 1) * sd / math.sqrt(n)
    told = lambda key, number=0: found[number, "pooled", key].value
    for key, expected in (("mean", mean), ("sd", sd), ("low", mean - half), ("high", mean + half)):
        assert math.isclose(told(key), expected, rel_tol=1e-9), key
    assert abs(told("median") - sorted(values)[n // 2]) < 2
    few, many = ([r.v for r in each.values() if (r.n < 4) == lot] for lot in (True, False))
    assert math.isclose(told("many - few diff", 1), sum(many) / len(many) - sum(few) / len(few), rel_tol=1e-9) and 0 <= told("many - few p", 1) <= 1
    assert sum(r.n or 0 for (a, s, _), r in found.items() if a == 2 and s == "pooled") == n


def test_groups_are_told_of_together_or_not_at_all(spark):
    rows, _ = population(spark, 2, 60, seed=3)
    rows = rows.withColumns({"sex": F.lit("u"), "org": F.lit(None).cast("string")})
    spec = SPEC | {"groups": [{"name": "most", "where": {"n": {"ge": 2}}}, {"name": "none", "where": {"n": {"gt": 99}}}], "analyses": [{"kind": "compare_groups", "vars": ["v"]}]}
    found = run_spec(rows, AnalysisSpec.parse(spec), [SourcePolicy(s, ("research",)) for s in SPEC["sources"]]).collect()
    assert found and all(r.suppressed and r.n is None and r.value is None for r in found)


def test_made_up_population(spark):
    rows, verdicts = population(spark, 3, 200, seed=1, blocked_fraction=0.1, least=2, most=5)
    sizes = [r.n for r in rows.groupBy("pid").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 600 and min(sizes) == 2 and max(sizes) == 5
    assert 30 <= verdicts.where("blocked").count() <= 90
    assert rows.exceptAll(population(spark, 3, 200, seed=1, blocked_fraction=0.1, least=2, most=5)[0].repartition(7)).isEmpty()
    assert not rows.exceptAll(population(spark, 3, 200, seed=2, least=2, most=5)[0]).isEmpty()


def test_kept_cohorts(spark, tmp_path):
    people = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "pid string")
    path = f"{tmp_path}/cohorts"
    for day, owner in ((1, "me"), (2, "me"), (3, "you")):
        cohorts.keep_cohort(people, path, f"c{day}", owner, "x > 1", datetime.datetime(2026, 1, day))
    assert [(r.cohort, r.n) for r in cohorts.cohorts_of(spark, path, "me").collect()] == [("c2", 3), ("c1", 3)]
    verdicts = spark.createDataFrame([("a", True), ("b", None)], "pid string, blocked boolean")
    assert [r.pid for r in cohorts.members_of(spark, path, "c1", verdicts).collect()] == ["c"]
    assert sorted(r.pid for r in cohorts.pinned(people.distinct(), ["a", "b"]).collect()) == ["a", "b"]
    with pytest.raises(LookupError, match="z"):
        cohorts.pinned(people, ["a", "z"])


def test_names_and_search(spark):
    rows = spark.createDataFrame([("a", None), ("b", "own"), ("q", None)], "concept string, display string")
    names = spark.createDataFrame([("a", "Alpha"), ("b", "Beta"), ("a", None)], "concept string, display string")
    assert {r.concept: r.display for r in cohorts.with_displays(rows, names).collect()} == {"a": "Alpha", "b": "own", "q": "q"}
    one, two = spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string"), spark.createDataFrame([(3, "x", 1.0)], "id int, kind string, more double")
    assert sorted((r.source, r.id) for r in cohorts.search({"a": one, "b": two}, {"kind": "x"}).collect()) == [("a", 1), ("b", 3)]


def test_reports(spark, tmp_path):
    spec = AnalysisSpec.parse(SPEC)
    schema = "analysis int, kind string, source string, var string, key string, n long, value double, suppressed boolean"
    result = spark.createDataFrame([(0, "describe", "s0", "v", "mean", 9, 1.25, False), (0, "frequency", "s0", "v", "k", 7, None, False), (0, "describe", "s1", "v", "mean", None, None, True)], schema)
    report.write_csv(result, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 3
    with pytest.raises(PermissionError, match="guid"):
        report.write_csv(result.withColumn("key", F.lit("0f8fad5b-d9cb-469f-a165-70867728950e")), f"{tmp_path}/bad")
    lines = [r[0] for r in result.select(report.sentence(result)).collect()]
    assert "1.25" in lines[0] and "7" in lines[1] and "not shown" in lines[2]
    report.keep_recipe(spark, f"{tmp_path}/recipes", "mine", spec)
    assert report.recipe(spark, f"{tmp_path}/recipes", "mine").digest() == spec.digest()
    with pytest.raises(LookupError):
        report.recipe(spark, f"{tmp_path}/recipes", "other")
    said = {r.about: r.value for r in report.provenance_rows(spark, spec, [SourcePolicy("s0", ("research",), k_min=7)]).collect()}
    assert said["spec_hash"] == spec.digest() and said["s0: k_min"] == "7"
