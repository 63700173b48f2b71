"""Digests, tests and models against plain computations, and what may not be told."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodestat.operators import digests, inference, statistics
from lodestat.plans.engine import SourcePolicy, run_spec
from lodestat.plans.spec import AnalysisSpec
from lodestat.sources.observations import read_sources


@pytest.mark.parametrize("seed", range(3))
def test_digests_in_any_order(seed):
    draw = np.random.Generator(np.random.PCG64(seed))
    values = draw.gamma(2, 10, 30_000)
    parts = [digests.packed(v, np.ones(len(v))) for v in np.array_split(values, 13)]
    orders = [list(range(13)), list(range(12, -1, -1)), draw.permutation(13).tolist()]
    for order in orders:
        means, weights = parts[order[0]]
        for i in order[1:]:
            means, weights = digests.packed(np.concatenate([means, parts[i][0]]), np.concatenate([weights, parts[i][1]]))
        assert len(means) <= digests.DELTA + 1 and weights.sum() == 30_000 and math.isclose((means * weights).sum() / 30_000, values.mean())
        means, weights = digests.protected(means, weights, 5)
        assert weights.min() >= 5 and weights.sum() == 30_000
        for q in (0.05, 0.25, 0.5, 0.75, 0.95):
            assert abs(np.interp(q * 30_000, np.cumsum(weights) - weights / 2, means) / np.quantile(values, q) - 1) < 0.02
    assert len(digests.protected(np.arange(4.0), np.ones(4), 5)[0]) == 0


def test_digests_of_frames(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.gauss(50, 9), None, float("nan"), 7.0])) for _ in range(3000)] + [("few", 1.0)] * 3
    frame = spark.createDataFrame(rows, "source string, x double").repartition(7)
    found = {r.source: r for r in digests.with_quantiles(digests.digests(frame, "x", ["source"], k=5), {"mid": 0.5}).collect()}
    for s in ("a", "b", None):
        mine = sorted(x for g, x in rows if g == s and x is not None and x == x)
        assert found[s].n == len(mine) and all(c.weight >= 5 for c in found[s].digest)
        assert abs(found[s].mid / np.median(mine) - 1) < 0.03
    assert found["few"].digest == [] and found["few"].mid is None and found["few"].n == 0
    whole = digests.merged(digests.digests(frame, "x", ["source"]).select("digest"), [], 5)
    assert digests.with_quantiles(whole, {"mid": 0.5}).first().n == sum(x is not None and x == x for _, x in rows)
    assert digests.digests(frame.where("false"), "x", ["source"]).count() == 0


def slow_rank_sum(a, b):
    n, m = len(a), len(b)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    counts = [(a + b).count(v) for v in set(a + b)]
    spread = n * m / 12 * (n + m + 1 - sum(t**3 - t for t in counts) / ((n + m) * (n + m - 1)))
    return u, (u - n * m / 2) / math.sqrt(spread) if spread > 0 else None


def test_rank_sums(spark):
    draw = random.Random(1)
    rows = [(g, draw.choice("abc"), draw.choice([0.0, 1.0, 2.5, draw.uniform(-9, 9), None, float("nan"), float("inf")])) for g in ("s", "t", None) for _ in range(120)]
    rows += [("same", "a", 3.0)] * 4 + [("same", "b", 3.0)] * 3 + [("one", "a", 1.0)] * 3
    found = {r.s: r for r in inference.rank_sums(spark.createDataFrame(rows, "s string, g string, v double"), "v", "g", ("a", "b"), ["s"]).collect()}
    assert set(found) == {"s", "t", None, "same"}
    for s, r in found.items():
        a, b = ([v for x, y, v in rows if x == s and y == g and v is not None and v == v] for g in "ab")
        u, z = slow_rank_sum(a, b)
        assert (r.n_a, r.n_b) == (len(a), len(b)) and r.u == u
        assert (r.z is None and r.p is None) if z is None else math.isclose(r.z, z, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r.p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)


def test_fisher_exact(spark):
    def slow(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        share = lambda x: math.comb(row, x) * math.comb(n - row, col - x) / math.comb(n, col)
        return min(1, sum(share(x) for x in range(max(0, row + col - n), min(row, col) + 1) if share(x) <= share(a) * (1 + 1e-7)))

    tables = list(itertools.product((0, 1, 3, 8), repeat=4)) + [(30, 2, 1, 40), (100, 120, 90, 80)]
    for t in tables:
        assert sum(t) == 0 or math.isclose(inference.fisher_p(*t), slow(*t), rel_tol=1e-7), t
    assert 0 < inference.fisher_p(10**6, 10**6 + 900, 10**6, 10**6) < 1 and inference.fisher_p(0, 10**5, 10**5, 0) < 1e-300
    odd = spark.createDataFrame([(1, 2, 3, 4), (0, 0, 0, 0), (None, 1, 1, 1)], "a int, b int, c int, d int")
    found = inference.fisher_exact(odd).collect()
    assert math.isclose(found[0].odds, 4 / 6) and found[1].p == 1 and found[2].p is None


def test_holm(spark):
    tests = [("x", 0.01), ("x", 0.04), ("x", 0.03), ("x", None), ("x", 0.03), ("y", 0.9), ("y", 0.6), (None, 0.2)]
    found = inference.holm(spark.createDataFrame([(i, *t) for i, t in enumerate(tests)], "i int, f string, p double"), family=["f"])
    told = {r.i: r.p_holm for r in found.collect()}
    expected = {0: 0.04, 1: 0.09, 2: 0.09, 3: None, 4: 0.09, 5: 1.0, 6: 1.0, 7: 0.2}
    assert all(told[i] is p if p is None else math.isclose(told[i], p) for i, p in expected.items())


def test_risk_differences_hide_few(spark):
    rows = [("s", "a", 56, 70), ("s", "b", 48, 80), ("s", "c", 4, 90), ("t", "a", 0, 20), ("t", "b", 20, 20), ("t", "d", 2, 4)]
    counts = spark.createDataFrame(rows, "source string, g string, events int, n int")
    found = {(r.source, r.a, r.b): r for r in inference.risk_differences(counts, "g", ["source"], 5).collect()}
    shown = found["s", "a", "b"]
    assert [round(-x, 4) for x in (shown["diff"], shown.high, shown.low)] == [0.2, 0.0524, 0.3339]  # published example, method 10
    assert found["s", "a", "c"].suppressed and found["s", "a", "c"]["diff"] is None and found["t", "a", "d"].suppressed
    assert found["t", "a", "b"]["diff"] == 1.0 and found["t", "a", "b"].high <= 1 + 1e-9 and len(found) == 6


def newton(y, x):
    x = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return beta


def test_logistic(spark):
    draw = np.random.Generator(np.random.PCG64(2))
    rows = []
    for source, n in (("a", 300), ("b", 200), ("nopool", 150)):
        x = draw.normal(1e6, 5, (n, 1)), draw.normal(0, 1, (n, 1))
        y = draw.random(n) < 1 / (1 + np.exp(-(0.3 * (x[0][:, 0] - 1e6) - x[1][:, 0])))
        rows += [(source, int(t), float(u), float(v)) for t, u, v in zip(y, *(c[:, 0] for c in x))]
    rows += [("apart", int(i >= 20), float(i), 0.5 * (i % 3)) for i in range(40)] + [("flat", i % 2, 1.0, 2.0 * i) for i in range(30)]
    rows += [("twin", i % 3 % 2, float(i), 2.0 * i) for i in range(30)] + [("all", 1, float(i), float(i % 4)) for i in range(30)] + [("few", i % 2, float(i * i), float(i % 3)) for i in range(4)] + [("rare", int(i < 2), float(i % 7), float(i % 5)) for i in range(50)] + [("a", 1, None, 2.0)]
    frame = spark.createDataFrame(rows, "source string, y int, u double, v double").repartition(5)
    pooling = spark.createDataFrame([("a",), ("b",)], "source string")
    found = {r.source: r for r in inference.logistic(frame, "y", ["u", "v"], "source", 5, pooling=pooling).collect()}
    status = {s: r.status for s, r in found.items()}
    assert status == {"a": "ok", "b": "ok", "nopool": "ok", "pooled": "ok", "apart": "separated", "flat": "singular", "twin": "singular", "all": "constant", "few": "suppressed", "rare": "suppressed"}
    for name, of in (("a", ["a"]), ("b", ["b"]), ("nopool", ["nopool"]), ("pooled", ["a", "b"])):
        mine = np.array([r[1:] for r in rows if r[0] in of and r[2] is not None], float)
        beta = newton(mine[:, 0], mine[:, 1:] - [1e6, 0])
        assert math.isclose(found[name].u, beta[1], rel_tol=1e-6) and math.isclose(found[name].v, beta[2], rel_tol=1e-6) and found[name].n == len(mine)
    assert found["rare"].n is None and found["apart"].u is None
    assert inference.logistic(frame.where("false"), "y", ["u"], "source", 5).count() == 0


# What was wrong


def test_spread_of_large_values(spark):
    rows = spark.createDataFrame([("a", 1e9), ("a", 1e9 + 1), ("b", 1e9 + 2), ("b", 1e9 + 3), ("c", None)], "source string, x double")
    found = {r.source: r for r in statistics.mean_and_sd(statistics.per_source_and_pooled(statistics.moments(rows, "x", ["source"]), [])).collect()}
    assert math.isclose(found["pooled"].sd, math.sqrt(5 / 3), rel_tol=1e-9) and found["pooled"].n == 4 and found["c"]["mean"] is None
    line = spark.createDataFrame([("g", 1e9 + i, 5e8 + 3.0 * i) for i in range(20)], "g string, x double, y double")
    fit = statistics.coefficients(line, "y", ["x"], "g", 5).first()
    assert math.isclose(fit.x, 3.0, rel_tol=1e-9)


def test_edges_decide_on_bins(spark):
    at = statistics.edges(0, 1, 0.1)
    values = [0.3, 0.6, 0.7, 0.1 + 0.2, 0.8, 0.9, 0.0, 1.0, at[-1], -1e-12, 0.15, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    found = {r.bin: r.n for r in statistics.histogram(rows, "x", at, []).collect()}
    expected = [None if v is None else sum(e <= v for e in at) - 1 for v in values]
    assert found == {b: expected.count(b) for b in (None, -1, *range(len(at)))if b in expected or b is not None and 0 <= b < len(at) - 1}
    uneven = statistics.histogram(rows, "x", [*at, 5.0], [])
    assert {r.bin: r.n for r in uneven.where("bin < 9").collect()} == {b: n for b, n in found.items() if b is not None and b < 9}


SPEC = {
    "title": "t", "purpose": "research", "sources": ["a", "b"], "index_event": {"observation": "start"}, "cohort": {"include": [{"observation": "start", "op": ">=", "value": 0}]},
    "variables": [{"name": v, "from": v, "agg": "mean"} for v in ("y", "p", "q", "r", "s", "t")],
    "analyses": [{"kind": "histogram", "var": "y"}, {"kind": "linear_regression", "outcome": "y", "predictors": ["p", "q", "r", "s", "t"]}, {"kind": "linear_regression", "outcome": "y", "predictors": ["p"]}],
}


def people(spark, n, exact):
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [(f"u{i}", c, float(exact[i] if c == "y" else 1 if c == "start" else (i * k * k) % 11), day, "b" if i % 2 else "a", "f", "o", 10 * i + k) for i in range(n) for k, c in enumerate(("start", "y", "p", "q", "r", "s", "t"))]
    return spark.createDataFrame(rows, "pid string, concept string, value double, d date, source string, sex string, org string, seq long").withColumn("ts", F.col("d").cast("timestamp"))


def test_no_edge_is_a_patients_value(spark):
    exact = [15.24, 47.62, 20.1, 33.3, 29.9, 41.7, 18.8, 22.2]
    found = run_spec(people(spark, 8, exact), AnalysisSpec.parse(json.dumps(SPEC)), [SourcePolicy(s, ("research",)) for s in "ab"]).collect()
    edges = {float(x) for r in found if r.kind == "histogram" and "–" in r.key for part in r.key.split("+") for x in part.split("–")}
    assert edges and all(abs(x / 0.1 - round(x / 0.1)) < 1e-6 for x in edges)
    assert not any(abs(x - v) < 0.02 for x in edges for v in exact)
    few = run_spec(people(spark, 4, exact), AnalysisSpec.parse(json.dumps(SPEC)), [SourcePolicy(s, ("research",)) for s in "ab"]).collect()
    assert {r.key for r in few if r.kind == "histogram" and "–" in r.key} <= {"0–1"}


def test_regression_of_few_patients_is_not_told(spark):
    exact = [15.24, 47.62, 20.1, 33.3, 29.9, 41.7]
    found = run_spec(people(spark, 6, exact), AnalysisSpec.parse(json.dumps(SPEC)), [SourcePolicy(s, ("research",)) for s in "ab"]).collect()
    told = {(r.analysis, r.source): r for r in found if r.kind == "linear_regression" and r.value is not None}
    assert {k for k in told} == {(2, "pooled")}  # six patients: one predictor may be told, five may not
    assert all(r.suppressed for r in found if r.kind == "linear_regression" and r.value is None)


def test_registry_of_sources(spark):
    paths = {"b": f"{SMALL}/nation.parquet", "a": f"{SMALL}/region.parquet", "gone": "/nowhere"}
    rows, status = read_sources(spark, {k: paths[k] for k in ("a",)})
    assert rows.count() == 5
    _, status = read_sources(spark, {"one": f"{SMALL}/region.parquet", "two": f"{SMALL}/region.parquet", "gone": "/nowhere"}, only=["gone", "two"])
    assert [s["source"] for s in status] == ["two", "gone"]
    with pytest.raises(ValueError, match="not registered"):
        read_sources(spark, paths, only=["x"])


# Series, imports, nested results


def slow_lttb(points, target):
    """(x, y) in order: which places are kept."""
    n = len(points)
    if target >= n or target < 3:
        return list(range(n))
    size, kept = (n - 2) / (target - 2), [0]
    cut = lambda j: 1 + int(j * size)
    for j in range(target - 2):
        after = points[cut(j + 1) : min(cut(j + 2), n)]
        mx, my = sum(p[0] for p in after) / len(after), sum(p[1] for p in after) / len(after)
        ax, ay = points[kept[-1]]
        kept.append(max(range(cut(j), cut(j + 1)), key=lambda i: (abs((ax - mx) * (points[i][1] - ay) - (ax - points[i][0]) * (my - ay)), -i)))
    return [*kept, n - 1]


@pytest.mark.parametrize("target", [2, 3, 12, 40])
def test_downsampling_without_a_series_in_one_task(spark, target):
    import datetime

    from lodestat.operators.series import downsample, hull

    draw = random.Random(target)
    start, rows, series = datetime.datetime(2024, 1, 1), [], {}
    for name, n in (("long", 900), ("short", 12), ("one", 1), ("flat", 50), (None, 200)):
        at = sorted(draw.randrange(10**6) for _ in range(n))
        values = [3.0 if name == "flat" else math.sin(i / 20) * 9 + draw.choice([0, 0, draw.gauss(0, 5)]) for i in range(n)]
        mine = [(start + datetime.timedelta(seconds=s), i, v) for i, (s, v) in enumerate(zip(at, values))]
        series[name] = [(s - at[0], v) for s, v in zip(at, values)]
        rows += [(name, *r) for r in mine]
    rows += [("long", None, 1, 2.0), ("long", start, 2, None)]
    frame = spark.createDataFrame(rows, "pid string, ts timestamp, seq long, value double").repartition(6)
    found = {}
    for r in downsample(frame, target, ["pid"]).collect():
        found.setdefault(r.pid, []).append((r.seq, r.ts, r.value))
    for name, points in series.items():
        assert [x[0] for x in sorted(found[name], key=lambda x: (x[1], x[0]))] == slow_lttb(points, target), name
    for _ in range(50):
        x = np.sort(np.array([float(draw.randrange(30)) for _ in range(40)]))
        y = np.array([draw.gauss(0, 1) for _ in range(40)])
        corners = hull(x, y)
        for _ in range(20):
            a, b, c = draw.gauss(0, 1), draw.gauss(0, 1), draw.gauss(0, 1)
            assert math.isclose(np.abs(a * x + b * y + c).max(), np.abs(a * x + b * y + c)[corners].max())


def test_import_of_lines(spark):
    from lodestat.sources.observations import imported

    lines = ['{"id": "a", "n": 1}', '{"id": "a", "n": 2}', '{"id": "b"}', '{"n": 3}', "{broken", "", "  ", "[1]", '"text"', '{"id": null}', '{"id": "c", "n": "no number"}', '{"id": "d", "extra": {"x": [1]}}']
    frame = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")
    rows, told = imported(frame, "id string, n long", "id")
    assert {(r.id, r.n) for r in rows.collect()} == {("a", 1), ("b", None), ("d", None)} and rows.columns == ["id", "n"]
    assert told.first().asDict() == {"added": 3, "skipped": 1, "malformed": 6}
    again, told = imported(frame, "id string, n long", "id", rows)
    assert again.count() == 0 and told.first().asDict() == {"added": 0, "skipped": 4, "malformed": 6}
    assert imported(frame.where("false"), "id string", "id")[1].first().asDict() == {"added": 0, "skipped": 0, "malformed": 0}


def test_flattening(spark):
    from lodestat.plans.report import flattened

    nested = {"a": {"b": [{"c": 1}, {"c": [True, None]}, 2.5]}, "e": {}, "f": [], "g": "x.y", "h": [[1], [[2]]]}
    rows = spark.createDataFrame([(1, json.dumps(nested)), (2, "7"), (3, None), (4, '{"a": 0}')], "id int, doc string")
    found = {(r.id, r.path): r.value for r in flattened(rows, ["id"], "doc").collect()}
    assert found == {(1, "a.b[0].c"): "1", (1, "a.b[1].c[0]"): "true", (1, "a.b[1].c[1]"): None, (1, "a.b[2]"): "2.5", (1, "g"): "x.y", (1, "h[0][0]"): "1", (1, "h[1][0][0]"): "2", (2, ""): "7", (4, "a"): "0"}


def test_scan_of_every_place(spark):
    from lodestat.operators import disclosure

    guid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    schema = "plain string, n int, s struct<x: string, y: array<string>>, m map<string, array<struct<z: string>>>, aa array<array<string>>, mm map<string, map<string, string>>"
    clean = ("ok", 1, ("a", ["b", None]), {"k": [("v",)]}, [["q"], None], {"k": {"j": "w"}})
    assert disclosure.identifier_scan(spark.createDataFrame([clean, (None,) * 6], schema)).where("n > 0").count() == 0
    planted = [("s.x", ("ok", 1, (guid, []), None, None, None)), ("s.y[]", ("ok", 1, (None, ["a", guid]), None, None, None)), ("m.<key>", ("", 1, None, {guid: []}, None, None)), ("m{}[].z", ("", 1, None, {"k": [("a",), (guid,)]}, None, None)), ("aa[][]", ("", 1, None, None, [["a"], [guid]], None)), ("mm{}.<key>", ("", 1, None, None, None, {"k": {guid: "v"}})), ("mm{}{}", ("", 1, None, None, None, {"k": {"j": guid}})), ("mm.<key>", ("", 1, None, None, None, {guid: {}})), ("plain", (guid, 1, None, None, None, None))]
    frame = spark.createDataFrame([row for _, row in planted], schema)
    found = {(r.finding, r.column): r.n for r in disclosure.identifier_scan(frame).where("n > 0").collect()}
    assert found == {("guid", place): 1 for place, _ in planted}
    with pytest.raises(PermissionError) as error:
        disclosure.checked(frame)
    assert all(f"guid in {place}" in str(error.value) for place, _ in planted)
    assert disclosure.identifier_scan(spark.range(2)).count() == 0


def test_merging_of_maps(spark):
    from lodestat.operators import exploration

    rows = spark.createDataFrame([("c", {"u": 2, "v": 1}), ("c", {"u": 3}), ("c", None), ("d", {}), ("e", {"w": None}), (None, {"u": 1})], "concept string, units map<string, long>")
    assert {r.concept: r.units for r in exploration.merged_maps(rows, ["concept"], "units").collect()} == {"c": {"u": 5, "v": 1}, "d": {}, "e": {"w": 0}, None: {"u": 1}}
    answers = [(2, "s2", "c", None, "g2", 4, {"u": 4}), (1, "s1", "c", "one", None, 3, {"u": 2, "v": 1}), (3, "s3", "c", "three", "g3", None, None), (1, "s1", "d", None, None, 9, {"u": 9}), (1, "s1", None, "x", "x", 99, {})]
    found = {r.concept: r for r in exploration.merged_concepts(spark.createDataFrame(answers, "place int, source string, concept string, display string, guid string, n long, units map<string, long>")).collect()}
    c, d = found["c"], found["d"]
    assert (c.held_by, c.observations, c.display, c.guid, c.units, c.unit_disagreement, c.number) == (["s1", "s2", "s3"], 7, "one", "g2", {"u": 6, "v": 1}, True, 2)
    assert (d.observations, d.display, d.units, d.unit_disagreement, d.number) == (9, None, {"u": 9}, False, 1) and len(found) == 2


def test_modes_of_answers(spark):
    from lodestat.operators.exploration import answering

    def said(*answers):
        return answering(spark.createDataFrame([(s, "k", n) for s, n in answers], "source string, key string, n long")).first().mode

    assert [said(("a", 1), ("b", 2)), said(("a", 1), ("b", None), ("c", 0)), said(("a", 1), ("b", None)), said(("a", None))] == ["complete", "degraded", "error", "error"]


def test_audit_of_runs_and_reads(spark, tmp_path):
    import datetime

    from lodestat.plans.audit import record_read, record_run

    spec, now = AnalysisSpec.parse(json.dumps(SPEC)), datetime.datetime(2026, 1, 2)
    rows = people(spark, 11, [float(i) for i in range(11)])
    result = run_spec(rows, spec, [SourcePolicy(s, ("research",)) for s in "ab"])
    record_run(result, spec, "me", f"{tmp_path}/runs", now, rows, k=6)
    told = {r.source: (r.patients, r.patients_suppressed) for r in spark.read.parquet(f"{tmp_path}/runs").collect()}
    assert told["a"] == (6, False) and told["b"] == (None, True) and told["pooled"] == (None, None)
    record_read(f"{tmp_path}/reads", spark, "me", "cohort c1", "research", 42, now)
    assert tuple(spark.read.parquet(f"{tmp_path}/reads").first()) == ("me", "cohort c1", "research", 42, now)


def test_exports_with_line_ends(spark, tmp_path):
    from lodestat.plans import report

    rows = spark.createDataFrame([("p1", "o", 'two\nlines "and" quotes', 1.5), ("p2", None, "d", 2.0)], "subject string, org string, concept string, value double")
    report.write_export(rows, str(tmp_path / "csv"), str(tmp_path / "audit"), "c1", "me")
    assert tuple(spark.read.parquet(str(tmp_path / "audit")).first()) == ("c1", "me", 2, 2)


# Pages, coarse records, questions, sentences


def test_reading_by_pages(spark):
    from lodestat.sources.paged import PagedObservations, TruncatedRead, read_whole

    asked = []

    def store(rows):
        def search(patients, concept, limit):
            asked.append(patients)
            return [r for r in rows if r[0] in patients and r[1] == concept][:limit]

        return search

    draw = random.Random(3)
    rows = [(f"p{i}", c, k, float(k)) for i in range(20) for c in "xy" for k in range(draw.randrange(9))]
    whole = tuple(f"p{i}" for i in range(20))
    assert sorted(read_whole(store(rows), whole, "x", 10)) == sorted(r for r in rows if r[1] == "x") and len(asked) > 5
    with pytest.raises(TruncatedRead, match="p1 "):
        list(read_whole(store([("p1", "x", i, 0.0) for i in range(10)]), ("p0", "p1", "p2"), "x", 10))
    asked.clear()
    assert list(read_whole(store(rows), whole, "z", 10)) == [] and len(asked) == 1  # one answer that is not full is enough
    spark.dataSource.register(PagedObservations)
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    cohort = [str(r.user_id) for r in events.select("user_id").distinct().collect()][:40]
    flat = events.where(F.col("user_id").cast("string").isin(cohort) & F.col("event_type").isin("click", "view")).select(F.col("user_id").cast("string"), "event_type", "event_id", "value")
    reader = spark.read.format("paged_observations").option("path", f"{SMALL}/events.parquet").option("patients", json.dumps(cohort)).option("concepts", '["click", "view"]').option("batch", 7)
    most = max(r["count"] for r in flat.groupBy("user_id", "event_type").count().collect())
    assert sorted(map(tuple, reader.option("page", most + 1).load().collect())) == sorted(map(tuple, flat.collect()))
    with pytest.raises(Exception, match="full page"):
        reader.option("page", most).load().collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = reader.option("page", most + 1).option("push", "true").load().where(F.col("pid").isin(cohort[:3]) & (F.col("concept") == "view"))
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, flat.where(F.col("user_id").cast("string").isin(cohort[:3]) & (F.col("event_type") == "view")).collect()))
        assert some.rdd.getNumPartitions() == 1  # nobody else is asked for
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("paged_observations").option("path", f"{SMALL}/events.parquet").option("patients", "[]").option("concepts", "[]").load().count() == 0


def test_pages_of_a_person(spark):
    from lodestat.sources.observations import MOST_ROWS, person_page

    rows = {"seen": spark.range(1200).select(F.lit("s").alias("source"), F.when(F.col("id") < 1100, "p").otherwise("q").alias("pid"), "id")}
    page = lambda *a, **k: [r.id for r in person_page(rows, "seen", *a, **k).collect()]
    assert sorted(page("p", [F.col("id")], 3, 2)) == [2, 3, 4] and len(page("p", [F.col("id")], 9999)) == MOST_ROWS and page("x", [F.col("id")]) == []
    for wrong, error in ((("gone", "p"), LookupError), (("seen", ""), ValueError)):
        with pytest.raises(error):
            person_page(rows, *wrong, [F.col("id")])
    with pytest.raises(ValueError):
        page("p", [F.col("id")], 0)


def test_coarse_records(spark):
    from lodestat.operators.frame import coarsened

    rows = spark.createDataFrame([(0, "2024-03-05"), (4, None), (89, "2023-12-31"), (90, None), (None, None)], "age int, day string").select("age", F.col("day").cast("date").alias("d"), F.lit("1990-01-01").alias("dob"))
    assert [tuple(r) for r in coarsened(rows).collect()] == [("0-4", "2024-03"), ("0-4", None), ("85-89", "2023-12"), ("90+", None), (None, None)]
    dated = coarsened(rows.withColumn("day_offset", F.lit(3)))
    assert dated.columns == ["day_offset", "age_band"]
    with pytest.raises(Exception, match="below zero"):
        coarsened(spark.createDataFrame([(-1,)], "age int")).collect()
    with pytest.raises(ValueError):
        coarsened(rows, "day")


def test_questions_and_purposes():
    from lodestat.plans import questions
    from lodestat.plans.spec import SpecError, declared

    kinds = questions.kinds_of({"a": "double", "b": "bigint", "sex": "string"})
    assert kinds == {"a": "number", "b": "number", "sex": "category"}
    assert questions.applicable(kinds) == ["summary", "spread", "shares", "together", "course", "gaps"]
    assert questions.applicable({"sex": "category"}, True) == ["summary", "shares", "groups", "gaps"] and questions.applicable({}) == ["summary", "gaps"]
    assert questions.analyses("together", kinds) == [{"kind": "correlation", "vars": ["a", "b"]}] and questions.analyses("shares", kinds) == [{"kind": "frequency", "vars": ["sex"]}]
    with pytest.raises(ValueError):
        questions.analyses("table", kinds)
    assert declared("statistics") == ("statistics", []) and declared("research", [" a ", "b", "a", ""]) == ("research", ["a", "b"])
    for wrong in (("research", None), ("research", [" "]), (None, ["a"]), ("care", ["a"])):
        with pytest.raises(SpecError):
            declared(*wrong)


def test_sentences_in_two_languages(spark):
    from lodestat.plans import report

    rows = spark.createDataFrame([("describe", "s", "x", "mean", 20, 3.14159, False), ("frequency", "s", "sex", "f", 9, None, False), ("describe", "s", "x", "mean", None, None, True), ("compare_groups", "s", "x", "hi - lo diff", 9, -2.0, False), ("correlation", "pooled", "x|y", "r", 50, -0.8, False)], "kind string, source string, var string, key string, n long, value double, suppressed boolean")
    said = {lang: [r.s for r in rows.select(report.sentence(rows, lang).alias("s")).collect()] for lang in ("en", "sv")}
    assert said["en"][0] == "In s, mean of x is 3.14 (n = 20)." and "not shown" in said["en"][2] and "strongly, in the opposite direction (r = -0.8, n = 50)" in said["en"][4] and "difference of two groups" in said["en"][3]
    assert all(a != b and a and b for a, b in zip(said["en"], said["sv"])) and "starkt, i motsatt riktning" in said["sv"][4]
    words = " ".join(x for lang in said.values() for x in lang) + " ".join(w for lang in report.WORDS.values() for w in lang.values())
    assert not any(w in words.lower() for w in ("effect", "effekt", "cause", "orsak", "beror på", "leads to"))
    spec = AnalysisSpec.parse(json.dumps(SPEC))
    assert len(report.caveats(spec, 5)) == 2 and report.caveats(AnalysisSpec.parse(json.dumps(SPEC | {"linkage": "none"})), 5, "sv")[2].startswith("En patient")


def test_reading_by_pages_from_buckets(spark, tmp_path, monkeypatch):
    """Every bucket is read once for a concept, however many requests its patients take, and the cohort is not an option."""
    from lodestat.sources import paged

    spark.dataSource.register(paged.PagedObservations)
    rows = [(f"p{i}", c, 100 * i + k, float(k)) for i in range(60) for c in "xy" for k in range(i % 7)] + [(None, "x", 1, 1.0)]
    frame = spark.createDataFrame(rows, paged.SCHEMA)
    cohort = spark.createDataFrame([(f"p{i}",) for i in range(5, 70)] + [("p5",), (None,)], "pid string")
    monkeypatch.setattr(paged, "BUCKET_PATIENTS", 20)
    store = paged.stored(frame, cohort, str(tmp_path / "store"))
    assert store["buckets"] == "4" and len(store) == 2
    reader = spark.read.format("paged_observations").options(**store).option("concepts", '["x", "y", "z"]').option("batch", 3)
    expected = sorted(r for r in rows if r[0] and int(r[0][1:]) >= 5)
    assert sorted(map(tuple, reader.option("page", 7).load().collect())) == expected
    assert reader.load().rdd.getNumPartitions() == 12
    with pytest.raises(Exception, match="full page"):
        reader.option("page", 6).load().collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = reader.option("page", 7).option("push", "true").load().where(F.col("pid").isin("p6", "p9", "p1") & (F.col("concept") == "x"))
        assert sorted(map(tuple, some.collect())) == [r for r in expected if r[0] in ("p6", "p9") and r[1] == "x"] and some.rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    nobody = paged.stored(frame.limit(0), cohort.limit(0), str(tmp_path / "nobody"))
    assert spark.read.format("paged_observations").options(**nobody).option("concepts", '["x"]').load().count() == 0


def test_downsampling_of_many_series_in_one_task(spark):
    """Series that cross batches, nulls among their keys: each as by itself; no group of its own for every series."""
    import datetime

    from lodestat.operators.series import downsample

    draw, start = random.Random(8), datetime.datetime(2024, 1, 1)
    series = {(s, p): [(60 * i, draw.gauss(0, 3)) for i in range(draw.randrange(3, 90))] for s in ("a", None) for p in ("p", "q", None, "r")}
    rows = [(s, p, start + datetime.timedelta(seconds=t), i, v) for (s, p), points in series.items() for i, (t, v) in enumerate(points)]
    frame = spark.createDataFrame(rows, "source string, pid string, ts timestamp, seq long, value double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = downsample(frame, 12, ["source", "pid"])
        found = {}
        for r in cut.collect():
            found.setdefault((r.source, r.pid), []).append((r.ts, r.seq))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in cut._jdf.queryExecution().toString()
    for key, points in series.items():
        assert [n for _, n in sorted(found[key])] == [n for n in slow_lttb(points, 12)], key
