"""Operators of the analytics engine on small fixtures with known answers."""

import itertools
import math
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lodestat.functions import columns as fn
from lodestat.functions.distributions import chi_square_tail, t_quantile, t_two_sided
from lodestat.operators import disclosure, exploration, frame, series, statistics
from lodestat.operators.frame import Variable
from lodestat.sources.observations import FHIR_BUNDLE, flatten_fhir, new_rows, read_sources, union_tagged

OBS = "source string, pid string, concept string, value double, d date, seq long"


def obs(spark, rows):
    import datetime

    return spark.createDataFrame([(s, p, c, v, d and datetime.date.fromisoformat(d), i) for i, (s, p, c, v, d) in enumerate(rows)], OBS)


def test_day_offsets_follow_each_patients_own_index(spark):
    rows = obs(spark, [("s", "a", "x", 1.0, "2026-05-11"), ("s", "a", "y", 1.0, "2026-05-01"), ("s", "a", "y", 1.0, "2026-05-21"), ("s", "b", "y", 1.0, "2026-05-01"), ("s", "a", "y", 2.0, None)])
    found = [(r.pid, r.day_offset) for r in frame.with_day_offset(rows, "x").orderBy("seq").collect()]
    assert found == [("a", 0), ("a", -10), ("a", 10), ("b", None), ("a", None)]
    assert [r.day_offset for r in frame.with_day_offset(rows).orderBy("seq").collect()] == [10, 0, 20, 0, None]


def test_frame_aggregates(spark):
    days = ["2026-01-01", "2026-01-06", None, "2026-01-06"]
    rows = frame.with_day_offset(obs(spark, [("s", "a", "v", v, d) for v, d in zip([0.0, 10.0, 99.0, 7.0], days)] + [("s", "b", "w", 1.0, days[0])]))
    made = [Variable(a, "v", a) for a in ("first", "last", "mean", "min", "max", "count", "slope", "time_to_first_event")] + [Variable("early", "v", "count", (0, 4))]
    a, b = frame.patient_frame(rows, made).orderBy("pid").collect()
    assert (a["first"], a["last"], a["mean"], a["min"], a["max"], a["count"], a["early"]) == (0.0, 99.0, 29.0, 0.0, 99.0, 4, 1)  # an undated row is last
    assert math.isclose(a["slope"], 1.7) and a["time_to_first_event"] == 0
    assert (b["first"], b["count"], b["mean"], b["slope"]) == (None, 0, None, None)


def test_first_and_last_keep_nulls_and_ties_keep_arrival_order(spark):
    rows = frame.with_day_offset(obs(spark, [("s", "a", "v", None, "2026-01-01"), ("s", "a", "v", 5.0, "2026-01-01"), ("s", "a", "v", 6.0, "2026-01-01")]))
    row = frame.patient_frame(rows, [Variable("f", "v", "first"), Variable("l", "v", "last")]).first()
    assert (row.f, row.l) == (None, 6.0)


def test_cohort_criteria_hold_when_any_observation_does(spark):
    rows = obs(spark, [("s", "a", "t", 9.0, None), ("s", "b", "t", 2.0, None), ("s", "c", "t", 5.0, None), ("s", "b", "t", 7.0, None)])
    for op, expected in ((">=", {"a", "b", "c"}), (">", {"a", "b"}), ("<=", {"b", "c"}), ("<", {"b"}), ("==", {"c"}), ("!=", {"a", "b"})):
        assert {r.pid for r in frame.members(rows, [("t", op, 5.0)]).collect()} == expected
    assert {r.pid for r in frame.members(rows, [("t", ">", 5.0), ("t", "<", 5.0)]).collect()} == {"b"}


def test_groups_may_not_overlap_and_need_every_operand(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 9.0)], "pid string, x double")
    assert {(r.group, r.pid) for r in frame.grouped(rows, {"lo": [("x", "<", 5.0)], "hi": [("x", ">=", 5.0)]}).collect()} == {("lo", "a"), ("hi", "c")}
    both = {"lo": [("x", "<", 5.0)], "all": [("x", ">", 0.0)]}
    assert frame.grouped(rows, both, overlapping=True).count() == 3
    with pytest.raises(Exception, match="more than one group"):
        frame.grouped(rows, both).collect()


def test_blocks_and_lifts(spark):
    rows = obs(spark, [("s", "a", "v", 1.0, "2026-01-02"), ("s", "a", "w", 1.0, "2026-01-02"), ("s", "a", "v", 1.0, "2025-01-01"), ("s", "b", "v", 1.0, "2026-01-02")]).withColumn("org", F.lit("o"))
    blocks = spark.createDataFrame([(1, "a", "o", True, ["v"], "2026-01-01"), (2, "b", "other", True, None, None), (3, "b", "o", False, None, None)], "block_id long, pid string, org string, is_active boolean, lift_concepts array<string>, lift_from string")
    blocks = blocks.withColumns({"lift_from": F.col("lift_from").cast("date"), "lift_until": F.lit(None).cast("date")})
    assert {r.seq for r in frame.without_blocked_rows(rows, blocks).collect()} == {0, 3}
    assert [(r.seq, r.block_id) for r in frame.exposures(rows, blocks).collect()] == [(0, 1)]
    verdicts = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "pid string, blocked boolean")
    assert {r.pid for r in frame.not_blocked(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "pid string"), verdicts).collect()} == {"c", "d"}


def test_projection_refuses_identifiers(spark):
    with pytest.raises(ValueError, match="patient_guid"):
        frame.project(spark.range(1).withColumn("patient_guid", F.lit(1)), ["patient_guid"])


@pytest.mark.parametrize("sources", [1, 2, 5])
def test_pooled_figures_do_not_depend_on_how_rows_are_spread(spark, sources):
    draw = random.Random(sources)
    values = [draw.gauss(50, 9) for _ in range(400)] + [None] * 7
    rows = spark.createDataFrame([(f"s{draw.randrange(sources)}", v) for v in values], "source string, x double")
    pooled = statistics.mean_and_sd(statistics.per_source_and_pooled(statistics.moments(rows, "x", ["source"]), [])).where("source = 'pooled'").first()
    known = [v for v in values if v is not None]
    mean = sum(known) / len(known)
    assert pooled.n == 400 and pooled.missing == 7 and math.isclose(pooled["mean"], mean, rel_tol=1e-9)
    assert math.isclose(pooled.sd, math.sqrt(sum((v - mean) ** 2 for v in known) / 399), rel_tol=1e-7)
    exact = sorted(known)
    cents = statistics.protected_sketch(rows.withColumn("seq", F.monotonically_increasing_id()), "x", 5, ["source"])
    assert cents.agg(F.min("weight")).first()[0] >= 5
    assert math.isclose(statistics.sketch_quantile(cents, 0.5).first()[0], (exact[199] + exact[200]) / 2, rel_tol=0.02)


def test_histogram_bins_are_half_open(spark):
    rows = spark.createDataFrame([("s", v) for v in (-5.0, 0.0, 1.0, 2.0, 9.99, 10.0, 50.0, None, float("nan"))], "source string, x double")
    found = {r.bin: r.n for r in statistics.histogram(rows, "x", statistics.edges(0, 10, 2), ["source"]).collect()}
    assert found == {-1: 1, 0: 2, 1: 1, 2: 0, 3: 0, 4: 1, 5: 2, None: 2}


def test_chi_square_and_correlation(spark):
    cells = spark.createDataFrame([("a", "x", 30), ("a", "y", 20), ("b", "x", 15), ("b", "y", 35)], '"row" string, col string, n long'.replace('"', "`"))
    found = statistics.chi_square(cells).first()
    assert math.isclose(found.chi2, 9.090909, abs_tol=1e-5) and found.dof == 1
    assert statistics.chi_square(cells.where("col = 'x'")).first().chi2 is None
    flat = spark.createDataFrame([("s", 1.0, 2.0)] * 5, "source string, x double, y double")
    assert statistics.pearson(flat, [("x", "y")], ["source"]).first().r is None


def test_regression_and_survival(spark):
    draw = random.Random(4)
    rows = [(a := draw.random(), b := draw.random(), 2 + 3 * a - 1.5 * b + draw.gauss(0, 0.01)) for _ in range(200)]
    cells = statistics.normal_equations(spark.createDataFrame(rows, "a double, b double, y double"), "y", ["a", "b"]).collect()
    fit = statistics.solve([tuple(c) for c in cells])
    assert all(abs(x - y) < 0.05 for x, y in zip(fit["coefficients"], (2, 3, -1.5))) and fit["n"] == 200
    same = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(20)], "a double, b double, y double")
    assert statistics.solve([tuple(c) for c in statistics.normal_equations(same, "y", ["a", "b"]).collect()]) is None
    periods = spark.createDataFrame([(1, 2, 50), (2, 3, 48), (1, 1, 40), (2, 2, 39), (3, 5, 5), (4, 0, 0)], "period int, events int, at_risk int")
    curve = statistics.kaplan_meier(periods).orderBy("period").collect()
    assert (curve[0].events, curve[0].at_risk) == (3, 90) and math.isclose(curve[0].survival, 1 - 3 / 90) and curve[2].survival == 0 and len(curve) == 3


def test_distribution_tails():
    assert math.isclose(t_quantile(0.975, 10), 2.2281388, rel_tol=1e-6)
    assert math.isclose(t_two_sided(2.0, 5), 0.1019395, rel_tol=1e-5)
    assert math.isclose(chi_square_tail(3.841459, 1), 0.05, rel_tol=1e-5)


def test_small_bins_merge():
    merge = disclosure.merge_small_bins
    assert merge([("a", 5), ("b", 2), ("c", 30)], 5) == [("a", 5), ("b+c", 32)]
    assert merge([("a", 20), ("b", 1)], 5) == [("a+b", 21)]
    assert merge([("a", 1), ("b", 2), ("c", 1), ("d", 30)], 5) == [("a+b+c+d", 34)]
    assert merge([("a", 3)], 5) == [("a", None)]
    draw = random.Random(2)
    for _ in range(300):
        bins = [(str(i), draw.choice([0, 1, 3, 5, 9])) for i in range(draw.randrange(1, 12))]
        out = merge(bins, 5)
        assert all(n is None or n == 0 or n >= 5 for _, n in out)
        assert sum(n or 0 for _, n in out) in (sum(n for _, n in bins), 0) or out[-1][1] is None


def test_secondary_suppression_hides_what_margins_would_tell():
    grid = [[10, 2, 8], [7, 9, 3]]
    cells = {(str(i), str(j)): n for i, line in enumerate(grid) for j, n in enumerate(line)}
    assert disclosure.suppress_table(cells, ["0", "1"], ["0", "1", "2"], 5) == {("0", "1"), ("0", "2"), ("1", "1"), ("1", "2")}
    assert disclosure.suppress_table(cells, ["0", "1"], ["0", "1", "2"], 5, margins=False) == {("0", "1"), ("1", "2")}
    draw = random.Random(7)
    for _ in range(60):
        rows, cols = [str(i) for i in range(draw.randrange(2, 5))], [str(i) for i in range(draw.randrange(2, 5))]
        cells = {(r, c): draw.randrange(0, 20) for r in rows for c in cols}
        gone = disclosure.suppress_table(cells, rows, cols, 5)
        lines = [[(r, c) for c in cols] for r in rows] + [[(r, c) for r in rows] for c in cols]
        assert all(sum(c in gone for c in line) != 1 for line in lines)


def test_policies_and_differences(spark):
    assert disclosure.Policy().stricter(disclosure.Policy(k_min=12, floor=12)).k_min == 12
    with pytest.raises(ValueError):
        disclosure.Policy(k_min=2)
    history = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(100, 120)], "cohort_no int, pid int")
    now = spark.createDataFrame([(i,) for i in range(49)], "pid int")
    found = {r.cohort_no: (r.differ, r.probe) for r in disclosure.differencing_verdicts(disclosure.symmetric_differences(history, now), 5).collect()}
    assert found == {1: (1, True), 2: (69, False)}


def test_column_functions(spark):
    import hmac

    dates = ["2026-05-01T08:00:00Z", "2026-05-01T23:59:59-11:00", "2026-05-01", "2026-05", "x", None]
    found = [str(r.d) for r in spark.createDataFrame([(x,) for x in dates], "t string").select(fn.effective_date(F.col("t")).alias("d")).collect()]
    assert found == ["2026-05-01"] * 3 + ["None"] * 3
    numbers = [r.n for r in spark.createDataFrame([(x,) for x in ("9", " 1.5 ", "1.5d", "x", None)], "t string").select(fn.number(F.col("t")).alias("n")).collect()]
    assert numbers == [9.0, 1.5, None, None, None]
    bands = [r.b for r in spark.createDataFrame([(a,) for a in (0, 37, 64, 89, 90, 103, -1)], "a int").select(fn.age_band(F.col("a")).alias("b")).collect()]
    assert bands == ["0-4", "35-39", "60-64", "85-89", "90+", "90+", None]
    key = bytes(range(40))
    assert spark.createDataFrame([("åsa",)], "p string").select(fn.pseudonym(F.col("p"), key)).first()[0] == hmac.new(key, "åsa".encode(), "sha256").hexdigest()[:16]
    guid = "64928BFF-9A46-472A-BBF1-DCFC694F945B"
    codes = [(f"urn:x:concept/{guid}", guid.lower()), (f"https://x.org/api/v1/concepts/{guid}", guid.lower()), ("urn:x:concept/not-a-guid", None), (f"urn:x:concept/{guid} ", None), (f"urn:x:concept/{guid}/x", None), ("", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(c,) for c, _ in codes], "c string").select(fn.concept_guid(F.col("c"))).collect()] == [g for _, g in codes]
    with pytest.raises(ValueError):
        fn.calendar(F.lit("2026-01-01"), "day")


def test_sources(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "y")], "x int, y string")
    assert {tuple(r) for r in union_tagged({"a": a, "b": b}).select("source", "x", "y").collect()} == {("a", 1, None), ("b", 2, "y")}
    rows, status = read_sources(spark, {"good": f"{SMALL}/region.parquet", "gone": "/nowhere"})
    assert rows.count() == 5 and [s["ok"] for s in status] == [True, False]
    with pytest.raises(RuntimeError, match="no source"):
        read_sources(spark, {"gone": "/nowhere"})
    assert new_rows(spark.range(5), spark.range(3), "id").count() == 2
    bundle = '{"entry": [{"resource": {"subject": {"reference": "Patient/p1"}, "code": {"coding": [{"system": "http://l", "code": "L"}, {"system": "urn:x:concept", "code": "G"}]}, "valueString": "positive", "effectivePeriod": {"start": "2026-01-01"}}}]}'
    found = flatten_fhir(spark.createDataFrame([(bundle,)], "j string").select(F.from_json("j", FHIR_BUNDLE).alias("b")).select("b.entry")).first()
    assert tuple(found) == ("p1", "G", "positive", None, "2026-01-01", None)


def test_downsampling_keeps_ends(spark):
    rows = spark.range(100).select(F.lit("p").alias("pid"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 10).cast("double").alias("value"))
    found = series.downsample(rows, 12, ["pid"]).orderBy("seq").collect()
    assert len(found) == 12 and found[0].seq == 0 and found[-1].seq == 99


def test_stream_sums_match_batch_sums(spark, tmp_path):
    from lodestat.sources.observations import observations
    from lodestat.streaming.partials import windowed_moments

    rows = observations(spark, SMALL).select("source", "concept", "value", "ts")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_moments(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("sums").start()
    run.processAllAvailable()
    run.stop()
    streamed = {(r.source, r.concept): r.n for r in spark.sql("SELECT source, concept, sum(n) AS n FROM sums GROUP BY 1, 2").collect()}
    assert streamed == {(r.source, r.concept): r["count"] for r in rows.groupBy("source", "concept").count().collect()}


def test_percentiles_and_ranks_by_ranges(spark):
    import math
    import random

    from lodestat.operators import ranks

    draw = random.Random(3)
    values = [draw.choice([0.0, -1.5, draw.uniform(-1e6, 1e6), draw.uniform(36, 38), 7.0, None]) for _ in range(900)]
    rows = spark.createDataFrame([(f"g{i % 3}" if i % 3 else None, i, v) for i, v in enumerate(values)], "g string, seq long, v double")
    at = {"low": 0.05, "mid": 0.5, "high": 0.97}
    key = lambda r: str(r.g)
    some = sorted(ranks.percentiles(rows, "v", ["g"], at).collect(), key=key)
    exact = lambda frame: frame.agg(F.percentile("v", F.array(*map(F.lit, at.values()))).alias("p"))
    many = sorted(exact(rows.groupBy("g")).collect(), key=key)
    assert len(some) == 3 and all(math.isclose(a[k], b.p[i]) and a.g == b.g for a, b in zip(some, many) for i, k in enumerate(at))
    whole = ranks.percentiles(rows, "v", [], at).first()
    assert all(math.isclose(whole[k], exact(rows).first().p[i]) for i, k in enumerate(at))
    assert ranks.percentiles(rows.where("false"), "v", ["g"], at).count() == 0
    ends = spark.createDataFrame([(v,) for v in (float("inf"), float("-inf"), float("nan"), 1.0, float("inf"), 0.0)], "v double")
    assert [str(r.v) for r in sorted(ranks.numbered(ends, "v", []).collect(), key=lambda r: r["_n"])] == ["-inf", "0.0", "1.0", "inf", "inf", "nan"]
    assert [ranks.percentiles(ends, "v", [], {"p": p}).first().p for p in (0.0, 0.4, 0.8)] == [float("-inf"), 1.0, float("inf")]
    known = rows.where("v IS NOT NULL")
    found = ranks.average_ranks(ranks.numbered(known, "v", ["g"], [F.col("seq")]), "v", ["g"], "rank").collect()
    for g in ("g1", "g2", None):
        mine = sorted((r for r in found if r.g == g), key=lambda r: (r.v, r.seq))
        assert [r["_n"] for r in mine] == list(range(1, len(mine) + 1)) and {r["_count"] for r in mine} == {len(mine)}
        for r in mine:
            same = [i for i, x in enumerate(mine, 1) if x.v == r.v]
            assert r.rank == sum(same) / len(same)


def test_rows_of_strangers_are_an_error(spark):
    import pytest

    from lodestat.operators import frame as patient_frames

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "pid string, n int")
    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "pid string")
    assert sorted(r.n for r in patient_frames.only_asked(rows, asked).collect()) == [1, 2]
    with pytest.raises(Exception, match="not asked for"):
        patient_frames.only_asked(rows, asked.where("pid = 'a'")).collect()


def test_registry_scopes(spark):
    from lodestat.operators import frame as patient_frames

    people = spark.createDataFrame([(30, "f", "o1"), (50, "m", "o2"), (None, "f", None)], "age int, sex string, org string")
    count = lambda **k: patient_frames.registry(people, **k).count()
    assert (count(), count(orgs=[]), count(orgs=["o1"]), count(low=40), count(high=40, sex="f")) == (3, 0, 1, 1, 1)


def test_verdict_of_sources():
    from lodestat.sources.observations import verdict

    said = lambda *oks: verdict([{"ok": ok} for ok in oks])
    assert (said(True, True), said(True, True, False), said(True, False, False), said(False)) == ("complete", "degraded", "error", "error")
    assert (said(True, False), said(True, True, False, False), said()) == ("error", "error", "error")  # most must answer


def test_export_and_receipt(spark, tmp_path):
    from lodestat.plans import report

    rows = spark.createDataFrame([("p1", "o", "c", 1.5), ("p1", "o", "c", None), ("p2", None, "d", 2.0)], "subject string, org string, concept string, value double")
    report.write_export(rows, str(tmp_path / "csv"), str(tmp_path / "audit"), "c1", "me")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == list(report.EXPORT)
    assert tuple(spark.read.parquet(str(tmp_path / "audit")).first()) == ("c1", "me", 3, 2)


def test_equal_observations_of_a_day_stay_one_row_each(spark, tmp_path):
    from lodestat.plans.catalog import QUERIES

    for name in ("customer", "nation"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    events = spark.read.parquet(f"{SMALL}/events.parquet").limit(3)
    twice = events.unionByName(events.withColumn("event_id", F.col("event_id") + 1000)).unionByName(events.withColumn("event_id", F.col("event_id") + 2000).withColumn("value", F.lit(None).cast("double")))
    twice.write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["fhir_flatten"](spark, str(tmp_path)).collect()
    assert len(found) == 9 and len({r.seq for r in found}) == 9 and sum(r.value is None for r in found) == 3


def test_means_at_an_edge_in_any_order(spark):
    values = [71.33, 18.65, 92.11, 54.27, 66.02, 42.29, 75.33]
    assert round(sum(values), 2) == 420
    orders = list(itertools.islice(itertools.permutations(values), 0, 5040, 40))
    rows = [("s", f"p{i}", "x", i * 10 + k, v, 0) for i, vs in enumerate(orders) for k, v in enumerate(vs)]
    rows += [("s", "null", "x", 1, None, 0), ("s", "nan", "x", 1, float("nan"), 0), ("s", "large", "x", 1, 1e300, 0), ("s", "large", "x", 2, 1.0, 0), ("s", "small", "x", 1, 3e-200, 0), ("s", "none", "y", 1, 1.0, 0)]
    frame_ = spark.createDataFrame(rows, "source string, pid string, concept string, seq long, value double, day_offset int").coalesce(1)
    found = {r.pid: r.m for r in frame.patient_frame(frame_, [frame.Variable("m", "x", "mean")]).collect()}
    assert {found[f"p{i}"] for i in range(len(orders))} == {60.0}
    assert found["null"] is None and found["none"] is None and found["nan"] != found["nan"] and found["large"] == 5e299 and found["small"] == 3e-200


@pytest.mark.parametrize("query", ["histogram_fixed", "merge_small_bins"])
def test_bins_of_means_at_an_edge(spark, tmp_path, query):
    """Patients whose purchases state a mean of 60, in many orders: one bin has them all."""
    import datetime

    from lodestat.plans.catalog import QUERIES

    orders = list(itertools.islice(itertools.permutations([71.33, 18.65, 92.11, 54.27, 66.02, 42.29, 75.33]), 0, 5040, 100))
    start = datetime.datetime(2024, 1, 1)
    events = [(1000 * i + k, start + datetime.timedelta(hours=k), i, "signup" if k == 0 else "purchase", v) for i, vs in enumerate(orders) for k, v in enumerate((1.0, *vs))]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(i, 0, "M") for i in range(len(orders))], "c_custkey long, c_nationkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, 0)], "n_nationkey long, n_regionkey long").write.parquet(str(tmp_path / "nation.parquet"))
    found = {(r.bin if query == "histogram_fixed" else r.label): r.n for r in QUERIES[query](spark, str(tmp_path)).collect() if r.n}
    assert found == {6 if query == "histogram_fixed" else "60-65": len(orders)}
