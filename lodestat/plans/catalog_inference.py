"""Registered queries of tests, models and digests, each beside the SQL that gives the same rows.

DuckDB has no tails of Student's t, chi-square or the normal distribution, so the SQL integrates their densities by
Simpson's rule, and finds quantiles by Newton's method from there.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestat.functions import columns as fn
from lodestat.functions import tails
from lodestat.operators import digests, exploration, frame, inference, ranks, statistics
from lodestat.sources import observations as observations_module
from lodestat.sources.observations import observations, read
from lodestat.sources.folders import shared_folder
from lodestat.sources.paged import PagedObservations, stored

from . import report
from .catalog import FRAME, OBS, patients, query, rounded

PANELS = 2000


def simpson(density: str, upto: str) -> str:
    """SQL for the integral from 0 to `upto` of a density of x."""
    x = f"(i * ({upto}) / {PANELS})"
    weight = f"(CASE WHEN i IN (0, {PANELS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(list_sum(list_transform(range(0, {PANELS + 1}), lambda i: {weight} * ({density.replace('$x', x)}))) * ({upto}) / {3 * PANELS})"


def t_density(x: str, dof: str) -> str:
    return f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2) - 0.5 * ln(pi() * {dof}) - ({dof} + 1) / 2 * ln(1 + {x} * {x} / {dof}))"


def t_tail(t: str, dof: str) -> str:
    return f"greatest(0, 1 - 2 * {simpson(t_density('$x', dof), f'abs({t})')})"


def chi_tail(x: str, dof: str) -> str:
    """By u * u in place of x, whose density has no pole."""
    density = f"(CASE WHEN $x = 0 THEN (CASE WHEN {dof} = 1 THEN 2 * exp(-lgamma(0.5) - 0.5 * ln(2)) ELSE 0 END) ELSE 2 * exp(({dof} - 1) * ln($x) - $x * $x / 2 - lgamma({dof} / 2) - {dof} / 2 * ln(2)) END)"
    return f"greatest(0, 1 - {simpson(density, f'sqrt({x})')})"


def t_quantiles(table: str, turns: int = 7) -> str:
    """CTEs q0 to q<turns> over a table with a column dof: the 97.5 % quantile of Student's t, as tq."""
    out = f"q0 AS (SELECT *, 1.96 + 2.4 / dof AS tq FROM {table})"
    for i in range(turns):
        out += f", q{i + 1} AS (SELECT * REPLACE (tq + (0.475 - {simpson(t_density('$x', 'dof'), 'tq')}) / {t_density('tq', 'dof')} AS tq) FROM q{i})"
    return out


# Digests


@query(f"WITH {OBS} SELECT coalesce(source, 'pooled') AS source, count(*) AS n, round(avg(value), 6) AS mean, true AS p25_close, true AS p50_close, true AS p75_close, true AS protected FROM obs GROUP BY GROUPING SETS ((source), ())")
def digest_quantiles(spark, sf_dir):
    """Whether quartiles from digests, by source and merged, are within 2 % of the exact ones, and no centroid tells of fewer than 5."""
    rows, at = observations(spark, sf_dir).select("source", "value"), statistics.QUARTILES
    by_source = digests.digests(rows, "value", ["source"], k=5)
    pooled = digests.merged(by_source.select(F.lit("pooled").alias("source"), "digest"), ["source"], k=5)
    found = digests.with_quantiles(by_source.unionByName(pooled), at)
    exact = ranks.percentiles(rows, "value", ["source"], at).unionByName(ranks.percentiles(rows, "value", [], at).withColumn("source", F.lit("pooled"))).withColumnsRenamed({c: f"_{c}" for c in at})
    mean = F.aggregate("digest", F.lit(0.0), lambda s, c: s + c["mean"] * c["weight"]) / F.col("n")
    close = lambda c: (F.abs(F.col(c) - F.col(f"_{c}")) <= 0.02 * F.abs(F.col(f"_{c}"))).alias(f"{c}_close")
    return found.join(exact, "source").select("source", "n", F.round(mean, 6).alias("mean"), *map(close, at), F.forall("digest", lambda c: c["weight"] >= 5).alias("protected"))


# Models


def newton_sql(turns: int) -> str:
    """CTEs of Newton's method for one predictor, by group g of rows r(g, y, x)."""
    out = "b0 AS (SELECT g, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM r GROUP BY g HAVING min(y) < max(y))"
    for i in range(turns):
        out += f""", s{i} AS (SELECT r.g, any_value(b) AS b, any_value(c) AS c, sum(y - p) AS u, sum((y - p) * x) AS v, sum(p * (1 - p)) AS h, sum(p * (1 - p) * x) AS k, sum(p * (1 - p) * x * x) AS l
  FROM (SELECT r.*, b, c, 1 / (1 + exp(-(b + c * x))) AS p FROM r JOIN b{i} ON b{i}.g = r.g) r GROUP BY r.g),
 b{i + 1} AS MATERIALIZED (SELECT g, b + (l * u - k * v) / (h * l - k * k) AS b, c + (h * v - k * u) / (h * l - k * k) AS c FROM s{i})"""
    return out


@query(f"""WITH lines AS (SELECT l_linestatus AS g, (l_returnflag = 'R')::INT::DOUBLE AS y, (l_quantity / 50)::DOUBLE AS x FROM lineitem), r AS (SELECT * FROM lines UNION ALL SELECT 'pooled', y, x FROM lines), {newton_sql(9)}
SELECT r.g AS "group", round(any_value(b), 6) AS intercept, round(any_value(c), 6) AS slope, count(*) AS n, sum(y)::BIGINT AS events, CASE WHEN min(y) = max(y) THEN 'constant' ELSE 'ok' END AS status FROM r LEFT JOIN b9 ON b9.g = r.g GROUP BY r.g""")
def logistic_regression(spark, sf_dir):
    """Returned or not by quantity, by line status and pooled."""
    lines = read(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_quantity") / 50).alias("slope"))
    pooling = lines.select("l_linestatus").distinct()
    found = inference.logistic(lines, "returned", ["slope"], "l_linestatus", 5, pooling=pooling)
    return rounded(found.select(F.col("l_linestatus").alias("group"), "intercept", "slope", "n", "events", "status"))


@query(f"WITH {FRAME}, lines AS (SELECT source AS g, CASE WHEN purchase >= 50 THEN 1.0 ELSE 0.0 END AS y, click / 100 AS x FROM f WHERE click IS NOT NULL AND purchase IS NOT NULL), r AS (SELECT * FROM lines UNION ALL SELECT 'pooled', y, x FROM lines WHERE g <> 'cdr3'), {newton_sql(12)} SELECT r.g AS source, round(any_value(b), 5) AS intercept, round(any_value(c), 5) AS click, count(*) AS n, sum(y)::BIGINT AS events FROM r JOIN b12 ON b12.g = r.g GROUP BY r.g HAVING least(sum(y), count(*) - sum(y)) >= 5")
def logistic_federated(spark, sf_dir):
    """Large purchases by clicks, by source and over the sources that may be pooled."""
    rows = patients(spark, sf_dir).select("source", (F.col("purchase") >= 50).cast("int").alias("large"), (F.col("click") / 100).alias("click"))
    pooling = rows.select("source").distinct().where("source <> 'cdr3'")
    return inference.logistic(rows, "large", ["click"], "source", 5, pooling=pooling).where("status = 'ok'").select("source", F.round("intercept", 5).alias("intercept"), F.round("click", 5).alias("click"), "n", "events")


# Tests


@query(f"""WITH {OBS}, v AS (SELECT source, sex, value FROM obs WHERE concept = 'purchase' AND sex IN ('BUILDING', 'MACHINERY') AND value IS NOT NULL),
 w AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY value) + (count(*) OVER (PARTITION BY source, value) - 1) / 2.0 AS r FROM v),
 t AS (SELECT source, sum(c * c * c - c) AS ties FROM (SELECT source, count(*)::DOUBLE AS c FROM v GROUP BY source, value) GROUP BY source),
 s AS (SELECT source, count_if(sex = 'BUILDING')::BIGINT AS n_a, count_if(sex = 'MACHINERY')::BIGINT AS n_b, sum(CASE WHEN sex = 'BUILDING' THEN r ELSE 0 END) AS ra, count(*)::DOUBLE AS n FROM w GROUP BY source),
 u AS (SELECT s.source, n_a, n_b, ra - n_a * (n_a + 1) / 2.0 AS u, (ra - n_a * (n_a + 1) / 2.0 - n_a * n_b / 2.0) / sqrt(n_a * n_b / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS z FROM s JOIN t ON t.source = s.source)
 SELECT source, n_a, n_b, u::DOUBLE AS u, round(z, 6) AS z, round({chi_tail('z * z', '1')}, 6) AS p FROM u""")
def mann_whitney(spark, sf_dir):
    """Purchases of two segments, by source."""
    rows = observations(spark, sf_dir).where("concept = 'purchase'")
    return rounded(inference.rank_sums(rows, "value", "sex", ("BUILDING", "MACHINERY"), ["source"]))


@query("""WITH v AS (SELECT l_quantity AS x, l_linestatus = 'F' AS a FROM lineitem), c AS (SELECT x, count(*) AS t, count_if(a) AS k, sum(count(*)) OVER (ORDER BY x) - count(*) AS before FROM v GROUP BY x),
 s AS (SELECT sum(k) AS n_a, sum(t - k) AS n_b, sum(k * (before + (t + 1) / 2.0)) AS ra, sum(t::DOUBLE * t * t - t) AS ties FROM c)
 SELECT n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, (ra - n_a * (n_a + 1) / 2.0)::DOUBLE AS u, round((ra - n_a * (n_a + 1) / 2.0 - n_a * n_b / 2.0) / sqrt(n_a::DOUBLE * n_b / 12.0 * (n_a + n_b + 1 - ties / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))), 6) AS z FROM s""")
def mann_whitney_ties(spark, sf_dir):
    """Quantities, nearly all of them tied, of open and finished lines."""
    return rounded(inference.rank_sums(read(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus", ("F", "O"), []).drop("p"))


TABLES = """k AS (SELECT c_nationkey AS nation, count_if(c_acctbal < 0 AND c_mktsegment = 'BUILDING')::BIGINT AS a, count_if(c_acctbal < 0 AND c_mktsegment <> 'BUILDING')::BIGINT AS b, count_if(c_acctbal >= 0 AND c_mktsegment = 'BUILDING')::BIGINT AS c, count_if(c_acctbal >= 0 AND c_mktsegment <> 'BUILDING')::BIGINT AS d FROM customer GROUP BY 1),
 lp AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM k),
 pr AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p FROM lp),
 fi AS (SELECT nation, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, least(1, sum(CASE WHEN p <= own * (1 + 1e-7) THEN p ELSE 0 END)) AS p FROM (SELECT *, max(CASE WHEN x = a THEN p END) OVER (PARTITION BY nation) AS own FROM pr) GROUP BY nation)"""


def _tables(spark, sf_dir):
    people = read(spark, sf_dir, "customer")
    debt, building = F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING"
    return people.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_if(debt & building).alias("a"), F.count_if(debt & ~building).alias("b"), F.count_if(~debt & building).alias("c"), F.count_if(~debt & ~building).alias("d"))


@query(f"WITH {TABLES} SELECT nation, a, b, c, d, round(p, 6) AS p, round(a * d * 1.0 / nullif(b * c, 0), 6) AS odds FROM fi")
def fisher_exact(spark, sf_dir):
    """Debt by segment: a table of two by two for each nation."""
    return rounded(inference.fisher_exact(_tables(spark, sf_dir)))


@query(f"WITH {TABLES}, m AS (SELECT nation, p, p * (count(*) OVER () - row_number() OVER (ORDER BY p, nation) + 1) AS step FROM fi) SELECT nation, round(p, 6) AS p, round(least(1, max(step) OVER (ORDER BY p, nation ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM m")
def fisher_holm(spark, sf_dir):
    """The nations' tests as one family."""
    return rounded(inference.holm(inference.fisher_exact(_tables(spark, sf_dir))).select("nation", "p", "p_holm"))


PAIRS = """g AS (SELECT sex, count(click)::DOUBLE n, avg(click) m, var_samp(click) v FROM f GROUP BY sex),
 w AS (SELECT a.sex AS a, b.sex AS b, b.m - a.m AS diff, sqrt(a.v / a.n + b.v / b.n) AS error, power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS dof FROM g a JOIN g b ON a.sex < b.sex)"""


def _welch(spark, sf_dir):
    summary = statistics.mean_and_sd(statistics.moments(patients(spark, sf_dir), "click", ["sex"])).withColumn("all", F.lit(0))
    pairs = statistics.welch(summary, "sex", ["all"])
    return pairs.withColumn("p", tails.t_two_sided(F.col("t"), F.col("dof")))


@query(f"WITH {FRAME}, {PAIRS}, pv AS (SELECT a, b, {t_tail('diff / error', 'dof')} AS p FROM w), m AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) AS step FROM pv) SELECT a, b, round(p, 6) AS p, round(least(1, max(step) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM m")
def welch_holm(spark, sf_dir):
    """All pairs of segments, adjusted as one family."""
    return rounded(inference.holm(_welch(spark, sf_dir)).select("a", "b", "p", "p_holm"))


@query(f"WITH {FRAME}, {PAIRS}, {t_quantiles('w')} SELECT a, b, round(diff, 6) AS diff, round(diff - tq * error, 5) AS low, round(diff + tq * error, 5) AS high FROM q7")
def welch_interval(spark, sf_dir):
    """The 95 % interval of each pair's difference."""
    reach = tails.t_quantile(0.975, F.col("dof")) * F.col("error")
    return _welch(spark, sf_dir).select("a", "b", F.round("diff", 6).alias("diff"), F.round(F.col("diff") - reach, 5).alias("low"), F.round(F.col("diff") + reach, 5).alias("high"))


@query(f"WITH {FRAME}, w AS (SELECT coalesce(source, 'pooled') AS source, count(purchase) AS n, avg(purchase) AS m, stddev_samp(purchase) AS s, count(purchase)::DOUBLE - 1 AS dof FROM f GROUP BY GROUPING SETS ((source), ())), {t_quantiles('w')} SELECT source, n, round(m, 6) AS mean, round(m - tq * s / sqrt(n), 5) AS low, round(m + tq * s / sqrt(n), 5) AS high FROM q7")
def describe_interval(spark, sf_dir):
    """Means with their 95 % interval, by source and pooled."""
    parts = statistics.moments(patients(spark, sf_dir), "purchase", ["source"])
    found = tails.with_interval(statistics.mean_and_sd(statistics.per_source_and_pooled(parts, [])))
    return found.select("source", "n", F.round("mean", 6).alias("mean"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(f"""WITH k AS (SELECT o_orderstatus AS source, l_returnflag AS r, l_shipmode AS c, count(*)::DOUBLE AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
 m AS (SELECT *, sum(n) OVER (PARTITION BY source, r) AS rt, sum(n) OVER (PARTITION BY source, c) AS ct, sum(n) OVER (PARTITION BY source) AS t FROM k),
 x AS (SELECT source, any_value(t) * sum(n * n / (rt * ct)) - any_value(t) AS chi2, ((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1))::DOUBLE AS dof FROM m GROUP BY source HAVING count(DISTINCT r) > 1)
 SELECT source, round(chi2, 5) AS chi2, dof::BIGINT AS dof, round({chi_tail('chi2', 'dof')}, 6) AS p FROM x""".replace("l_shipmode", "l_linenumber % 5"))
def chi_square_p(spark, sf_dir):
    """Return flag by line number, for each order status."""
    lines = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    cells = lines.groupBy(F.col("o_orderstatus").alias("source"), F.col("l_returnflag").alias("row"), (F.col("l_linenumber") % 5).cast("string").alias("col")).agg(F.count("*").alias("n"))
    found = statistics.chi_square(cells, ["source"]).where("dof IS NOT NULL")
    return found.select("source", F.round("chi2", 5).alias("chi2"), "dof", F.round(tails.chi_square_tail(F.col("chi2"), F.col("dof")), 6).alias("p"))


@query(f"""WITH {FRAME}, c AS (SELECT source, sex, count(*) AS n, count_if(errors >= 5) AS e FROM f GROUP BY 1, 2), k AS (SELECT *, e * 1.0::DOUBLE / n AS p, 1.959963984540054::DOUBLE AS z, n < 5 OR (e > 0 AND e < 5) OR (n - e > 0 AND n - e < 5) AS hide FROM c),
 i AS (SELECT *, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS lo, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n) AS hi FROM k),
 d AS (SELECT a.source, a.sex AS a, b.sex AS b, least(a.n, b.n) AS n, b.p - a.p AS diff, b.p - a.p - sqrt(power(b.p - b.lo, 2) + power(a.hi - a.p, 2)) AS low, b.p - a.p + sqrt(power(b.hi - b.p, 2) + power(a.p - a.lo, 2)) AS high, a.hide OR b.hide AS suppressed FROM i a JOIN i b ON a.source = b.source AND a.sex < b.sex)
 SELECT source, a, b, CASE WHEN NOT suppressed THEN n END AS n, CASE WHEN NOT suppressed THEN round(diff, 6) END AS diff, CASE WHEN NOT suppressed THEN round(low, 6) END AS low, CASE WHEN NOT suppressed THEN round(high, 6) END AS high, suppressed FROM d""")
def risk_difference(spark, sf_dir):
    """Many errors, between segments of each source."""
    counts = patients(spark, sf_dir).groupBy("source", "sex").agg(F.count("*").alias("n"), F.count_if(F.col("errors") >= 5).alias("events"))
    return rounded(inference.risk_differences(counts, "sex", ["source"], 5))


# Coarse records, codes, pages


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 90 THEN '90+' ELSE (floor(l_quantity * 2 / 5) * 5)::INT || '-' || ((floor(l_quantity * 2 / 5) * 5)::INT + 4) END AS age_band, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS calendar FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def coarsen_records(spark, sf_dir):
    """Quantities as ages: bands and months in place of ages and days, and no birth date."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.to_date("o_orderdate")
    return frame.coarsened(rows.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).cast("int").alias("age"), day.alias("d"), day.alias("birth_date")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'plan_concept' ELSE 'external_code' END AS class FROM customer")
def code_classes(spark, sf_dir):
    """Concepts of the plan and codes from outside, some without any."""
    digest = F.md5("c_name")
    guid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    code = F.when(F.col("c_custkey") % 4 == 0, " ").when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("urn:x:concept/"), guid)).when(F.col("c_custkey") % 4 == 2, "http://loinc.org/1234-5").otherwise(guid)
    return read(spark, sf_dir, "customer").select("c_custkey", fn.code_class(code).alias("class"))


@query(f"WITH {OBS} SELECT source, hour(ts)::INT AS hour, count(value)::DOUBLE AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS p50 FROM obs GROUP BY 1, 2")
def profile_parameters(spark, sf_dir):
    """Hours of the day of each source as FHIR Parameters, read back from their JSON; hours without values have no mean there."""
    hours = rounded(exploration.glucose_hours(observations(spark, sf_dir), ["source"]), 9)
    said = report.profile_parameters(hours, ["source"], ["n", "mean", "p50"])
    back = said.select("source", F.explode(F.from_json("resource", "resourceType string, parameter array<struct<name: string, part: array<struct<name: string, valueDecimal: double>>>>")["parameter"]).alias("p"))
    part = lambda name: F.filter(F.col("p.part"), lambda x: x["name"] == name)[0]["valueDecimal"].alias(name)
    return back.select("source", F.substring("p.name", 6, 2).cast("int").alias("hour"), part("n"), F.get(F.filter(F.col("p.part"), lambda x: x["name"] == "mean"), F.lit(0))["valueDecimal"].alias("mean"), F.get(F.filter(F.col("p.part"), lambda x: x["name"] == "p50"), F.lit(0))["valueDecimal"].alias("p50")).where("n > 0")


@query(f"WITH {OBS} SELECT source, seq, concept FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM obs WHERE pid = '7') WHERE n BETWEEN 6 AND 25")
def person_page(spark, sf_dir):
    return observations_module.person_page({"observations": observations(spark, sf_dir)}, "observations", "7", [F.col("seq")], 20, 5).select("source", "seq", "concept")


@query("SELECT CAST(user_id AS VARCHAR) AS pid, event_type AS concept, event_id AS seq, round(value, 6) AS value FROM events WHERE event_type IN ('purchase', 'click') AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def paged_read(spark, sf_dir):
    """A cohort's rows from a store that gives pages of 320 rows at most, 25 patients at a time."""
    spark.dataSource.register(PagedObservations)
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("pid"), F.col("event_type").alias("concept"), F.col("event_id").alias("seq"), "value")
    cohort = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("pid"))
    store = stored(events, cohort, shared_folder(spark))
    pages = spark.read.format("paged_observations").options(**store).option("concepts", json.dumps(["purchase", "click"])).option("page", 320).option("batch", 25).load()
    return rounded(pages.where(F.col("concept").isin("purchase", "click")))


@query(f"WITH {FRAME}, c AS (SELECT source, count(*) AS n, corr(click, view) AS r FROM f WHERE click IS NOT NULL AND view IS NOT NULL GROUP BY source) SELECT source, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength, CASE WHEN r > 0 THEN 'same' ELSE 'opposite' END AS direction FROM c")
def corr_direction(spark, sf_dir):
    found = statistics.pearson(patients(spark, sf_dir), [("click", "view")], ["source"])
    return found.select("source", fn.strength(F.col("r")).alias("strength"), fn.direction(F.col("r")).alias("direction"))
