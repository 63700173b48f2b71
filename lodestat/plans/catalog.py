"""Every registered query over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestat.functions import columns as fn
from lodestat.operators import cohorts, disclosure, exploration, frame, ranks, series, statistics
from lodestat.operators.frame import Variable
from lodestat.sources.observations import FHIR_BUNDLE, cohort_read, flatten_fhir, imported, new_rows, observations, page_of_each, read, union_tagged

from . import report
from .engine import SourcePolicy, run_spec
from .spec import AnalysisSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OBS = """obs AS (SELECT e.event_id AS seq, CAST(e.user_id AS VARCHAR) AS pid, e.event_type AS concept, e.value, e.ts, CAST(e.ts AS DATE) AS d,
  'cdr' || n.n_regionkey AS source, c.c_mktsegment AS sex, 'org-' || c.c_nationkey AS org
  FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey)"""
DAYS = OBS + """, days AS (SELECT *, date_diff('day', min(CASE WHEN concept = 'signup' THEN d END) OVER (PARTITION BY source, pid), d) AS day_offset FROM obs)"""
FRAME = DAYS + """, f AS (SELECT source, pid, avg(CASE WHEN concept = 'purchase' AND day_offset BETWEEN 0 AND 28 THEN value END) AS purchase,
  avg(CASE WHEN concept = 'click' THEN value END) AS click, avg(CASE WHEN concept = 'view' THEN value END) AS view,
  count(CASE WHEN concept = 'error' THEN 1 END)::BIGINT AS errors, min(sex) AS sex, min(org) AS org FROM days GROUP BY source, pid)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(frame_: DataFrame, digits: int = 6) -> DataFrame:
    return frame_.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in frame_.dtypes))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.with_day_offset(observations(spark, sf_dir), "signup")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [Variable("purchase", "purchase", "mean", (0, 28)), Variable("click", "click", "mean"), Variable("view", "view", "mean"), Variable("errors", "error", "count")]
    return frame.patient_frame(days(spark, sf_dir), wanted, ("sex", "org"))


# Scans and sources


@query(f"WITH {OBS} SELECT seq, pid, concept, round(value, 6) AS value FROM obs WHERE concept IN ('purchase', 'click') AND pid IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')")
def scan_cohort_read(spark, sf_dir):
    people = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("pid"))
    return rounded(cohort_read(observations(spark, sf_dir), people, ["purchase", "click"]).select("seq", "pid", "concept", "value"))


@query("SELECT source, count(*) AS n, round(sum(amount), 4) AS amount FROM (SELECT 'orders' AS source, o_totalprice AS amount FROM orders UNION ALL SELECT 'lineitem', l_extendedprice FROM lineitem) GROUP BY source")
def union_tagged_sources(spark, sf_dir):
    parts = {"orders": read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("amount")), "lineitem": read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("amount"))}
    return union_tagged(parts).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("amount"))


@query(f"WITH {OBS} SELECT source, seq, concept FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM obs) WHERE n BETWEEN 11 AND 30")
def canonical_page(spark, sf_dir):
    return page_of_each(observations(spark, sf_dir), "source", [F.col("seq")], 20, 10).select("source", "seq", "concept")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def idempotent_append(spark, sf_dir):
    known = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return new_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), known, "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment = 'MACHINERY' AND c_nationkey IN (1, 2, 3, 8, 20)")
def registry_search(spark, sf_dir):
    people = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("age"), F.col("c_mktsegment").alias("sex"), F.col("c_nationkey").alias("org"))
    return frame.registry(people, 1000, 5000, "MACHINERY", [1, 2, 3, 8, 20]).select("c_custkey")


@query(f"WITH {OBS} SELECT seq, pid, 'urn:x:concept' AS unused, concept, CAST(value AS VARCHAR) AS value, CAST(d AS VARCHAR) AS effective_at, org FROM obs".replace(" 'urn:x:concept' AS unused,", "").replace("CAST(value AS VARCHAR)", "round(value, 6)"))
def fhir_flatten(spark, sf_dir):
    """Observations as bundles of one patient's FHIR resources, and back."""
    rows = observations(spark, sf_dir)
    resource = F.struct(
        F.struct(F.concat(F.lit("Patient/"), F.col("pid")).alias("reference"), F.struct(F.lit(None).cast("string").alias("value")).alias("identifier")).alias("subject"),
        F.struct(F.array(F.struct(F.lit("http://loinc.org").alias("system"), F.lit("x").alias("code")), F.struct(F.lit("urn:x:concept").alias("system"), F.col("concept").alias("code"))).alias("coding")).alias("code"),
        F.col("d").cast("string").alias("effectiveDateTime"), F.struct(F.lit(None).cast("string").alias("start")).alias("effectivePeriod"), F.lit(None).cast("string").alias("issued"),
        F.struct("value", F.lit("u").alias("unit"), F.lit(None).cast("string").alias("code")).alias("valueQuantity"), F.lit(None).cast("long").alias("valueInteger"), F.lit(None).cast("string").alias("valueString"), F.lit(None).cast("boolean").alias("valueBoolean"),
        F.array(F.struct(F.struct(F.lit(None).cast("string").alias("value")).alias("identifier"), F.concat(F.lit("Organization/"), F.col("org")).alias("reference"))).alias("performer"),
    )
    bundles = rows.select("seq", F.array(F.struct(resource.alias("resource"))).alias("entry"))
    bundles = bundles.select(F.from_json(F.to_json(F.struct("entry")), FHIR_BUNDLE).alias("b"), "seq").select("b.entry", "seq")
    flat = frame.only_asked(flatten_fhir(bundles, keep=("seq",)), rows)
    return flat.select("seq", "pid", "concept", F.round(F.col("value").try_cast("double"), 6).alias("value"), "effective_at", "org")


@query(f"WITH {OBS} SELECT source, pid, concept, strftime(ts, '%Y-%m') AS month, round(value, 6) AS value FROM obs WHERE concept = 'purchase' AND pid IN (SELECT pid FROM obs WHERE concept = 'signup')")
def cohort_export_rows(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return rounded(cohort_read(rows, rows.where("concept = 'signup'"), ["purchase"]).select("source", "pid", "concept", fn.calendar(F.col("ts"), "month").alias("month"), "value"))


@query(f"WITH {OBS} SELECT pid AS subject, org, concept, CAST(NULL AS VARCHAR) AS source_code, CAST(d AS VARCHAR) AS effective_at, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS run FROM obs WHERE concept IN ('purchase', 'click') AND pid IN (SELECT pid FROM obs WHERE concept = 'signup')")
def export_columns(spark, sf_dir):
    """The eight columns of a cohort's export."""
    rows = observations(spark, sf_dir)
    chosen = cohort_read(rows, rows.where("concept = 'signup'"), ["purchase", "click"])
    return rounded(report.export_rows(chosen.select(F.col("pid").alias("subject"), "org", "concept", F.col("d").cast("string").alias("effective_at"), "value")))


@query(f"WITH {OBS} SELECT 'c1' AS cohort, 'me' AS actor, count(*) AS rows, count(DISTINCT pid) AS subjects FROM obs WHERE concept IN ('purchase', 'click') AND pid IN (SELECT pid FROM obs WHERE concept = 'signup')".replace("AS rows", 'AS "rows"'))
def export_receipt(spark, sf_dir):
    return report.receipt(export_columns(spark, sf_dir), "c1", "me")


@query(f"WITH {OBS} SELECT source, 'Parameters' AS resource, round(count(value), 6)::DOUBLE AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50 FROM obs WHERE concept = 'purchase' GROUP BY source")
def stats_parameters(spark, sf_dir):
    """Figures of each source as a FHIR Parameters resource, read back from its JSON."""
    figures = rounded(statistics.summary(observations(spark, sf_dir).where("concept = 'purchase'"), "value", ["source"]))
    said = figures.select("source", F.from_json(report.as_parameters(figures, ["n", "mean", "p50"]), "resourceType string, parameter array<struct<name: string, valueDecimal: double>>").alias("r"))
    return said.select("source", F.col("r.resourceType").alias("resource"), *(F.col("r.parameter")[i]["valueDecimal"].alias(c) for i, c in enumerate(("n", "mean", "p50"))))


# Projections, predicates, joins


@query(f"WITH {OBS} SELECT seq, source, concept, sex FROM obs")
def allowlist_projection(spark, sf_dir):
    return frame.project(observations(spark, sf_dir), ["seq", "source", "concept", "sex"])


KEY = bytes(range(32))


@query("""SELECT c_custkey, substr(sha256(unhex('""" + bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex() + """') || unhex(sha256(unhex('""" + bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex() + """') || encode(c_name)))), 1, 16) AS pseudonym FROM customer""")
def pseudonymise(spark, sf_dir):
    """The key is a fixture; a deployment reads its own from the environment."""
    return read(spark, sf_dir, "customer").select("c_custkey", fn.pseudonym(F.col("c_name"), KEY).alias("pseudonym"))


@query(f"WITH {FRAME} SELECT 'high' AS \"group\", pid FROM f WHERE purchase >= 60 UNION ALL SELECT 'low', pid FROM f WHERE purchase < 60 AND errors >= 5")
def group_membership(spark, sf_dir):
    groups = {"high": [("purchase", ">=", 60.0)], "low": [("purchase", "<", 60.0), ("errors", ">=", 5)]}
    return frame.grouped(patients(spark, sf_dir), groups).select("group", "pid")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2024-06-30' - INTERVAL 28 YEAR AND CAST(o_orderdate AS DATE) > DATE '2024-06-30' - INTERVAL 30 YEAR")
def age_predicate(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(fn.born_for_age(F.to_date("o_orderdate"), "2024-06-30", 28, 29)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', 'F') OR o_orderstatus IN ('1-URGENT', 'F')")
def array_any_match(spark, sf_dir):
    """Orders by what they refer to: by an identifier, or by the tail of a reference."""
    references = F.array(F.struct(F.col("o_orderpriority").alias("identifier"), F.concat(F.lit("Request/"), F.col("o_orderstatus")).alias("reference")))
    return frame.refers_to(read(spark, sf_dir, "orders").withColumn("based_on", references), "based_on", ["1-URGENT", "F"]).select("o_orderkey")


@query(f"WITH {OBS} SELECT concept, count(*) AS n FROM obs WHERE pid IN (SELECT pid FROM obs WHERE concept = 'error' AND value > 90) GROUP BY concept")
def member_semi_join(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return rows.join(rows.where("concept = 'error' AND value > 90").select("pid").distinct(), "pid", "left_semi").groupBy("concept").agg(F.count("*").alias("n"))


VERDICTS = "v AS (SELECT CAST(c_custkey AS VARCHAR) AS pid, CASE WHEN c_acctbal < 0 THEN true WHEN c_acctbal < 5000 THEN false END AS blocked FROM customer)"


@query(f"WITH {OBS}, {VERDICTS} SELECT DISTINCT pid FROM obs WHERE pid NOT IN (SELECT pid FROM v WHERE coalesce(blocked, true))")
def block_anti_join(spark, sf_dir):
    verdicts = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pid"), F.when(F.col("c_acctbal") < 0, True).when(F.col("c_acctbal") < 5000, False).alias("blocked"))
    return frame.not_blocked(observations(spark, sf_dir).select("pid").distinct(), verdicts)


@query("SELECT coalesce(reason, 'not registered') AS reason, count(*) AS n FROM customer c LEFT JOIN (SELECT c_custkey AS k, c_acctbal >= 0 AS allowed, CASE WHEN c_acctbal < -500 THEN 'opted out' WHEN c_acctbal < 0 THEN 'expired' END AS reason FROM customer WHERE c_mktsegment <> 'FURNITURE') x ON x.k = c.c_custkey WHERE NOT coalesce(allowed, false) GROUP BY 1")
def consent_filter_summary(spark, sf_dir):
    people = read(spark, sf_dir, "customer")
    reason = F.when(F.col("c_acctbal") < -500, "opted out").when(F.col("c_acctbal") < 0, "expired")
    consents = people.where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("pid"), (F.col("c_acctbal") >= 0).alias("allowed"), reason.alias("reason"))
    return frame.consenting(people.select(F.col("c_custkey").alias("pid")), consents)[1]


@query(f"WITH {DAYS} SELECT seq, day_offset FROM days")
def day_offset(spark, sf_dir):
    return days(spark, sf_dir).select("seq", F.col("day_offset").cast("long").alias("day_offset"))


@query(f"WITH {DAYS} SELECT source, sum(CASE WHEN day_offset IS NULL THEN 1 ELSE 0 END)::BIGINT AS undated_rows, count(DISTINCT CASE WHEN day_offset IS NULL THEN pid END) AS patients_with_undated FROM days GROUP BY source")
def undated_count(spark, sf_dir):
    return frame.undated(days(spark, sf_dir))


def _blocks(spark, sf_dir):
    people = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return people.select(
        F.col("c_custkey").alias("block_id"), F.col("c_custkey").cast("string").alias("pid"), F.concat(F.lit("org-"), F.col("c_nationkey")).alias("org"), (F.col("c_custkey") % 2 == 0).alias("is_active"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("view"), F.lit("click"))).alias("lift_concepts"), F.lit("2024-01-05").cast("date").alias("lift_from"), F.lit(None).cast("date").alias("lift_until"),
    )


HIDDEN = """b AS (SELECT c_custkey AS block_id, CAST(c_custkey AS VARCHAR) AS bpid, 'org-' || c_nationkey AS borg, c_custkey % 4 = 0 AS has_lift FROM customer WHERE c_custkey % 6 = 0),
 x AS (SELECT obs.*, block_id, has_lift AND concept IN ('view', 'click') AND d >= DATE '2024-01-05' AS lifted FROM obs JOIN b ON pid = bpid AND org = borg)"""


@query(f"WITH {OBS}, {HIDDEN} SELECT seq FROM obs WHERE seq NOT IN (SELECT seq FROM x WHERE NOT lifted)")
def block_with_lift(spark, sf_dir):
    return frame.without_blocked_rows(observations(spark, sf_dir), _blocks(spark, sf_dir)).select("seq")


@query(f"WITH {OBS}, {HIDDEN} SELECT seq, pid, concept, block_id FROM x WHERE lifted")
def lift_exposures(spark, sf_dir):
    return frame.exposures(observations(spark, sf_dir), _blocks(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, 'https://x.org/' || l_returnflag || '/' || l_linestatus AS code FROM lineitem")
def canonical_codes(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.canonical_code(F.concat(F.lit("https://x.org/"), F.col("l_returnflag"), F.lit("//")), F.col("l_linestatus")).alias("code"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) END AS guid FROM customer""")
def concept_urn_parse(spark, sf_dir):
    digest = F.md5("c_name")
    guid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    form = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("urn:x:concept/"), F.upper(guid))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("https://x.org/api/v1/concepts/"), guid)).otherwise(F.concat(F.lit("urn:x:concept/"), guid, F.lit("/x")))
    return read(spark, sf_dir, "customer").select("c_custkey", fn.concept_guid(form).alias("guid"))


# Patient frame


@query(f"WITH {FRAME} SELECT source, pid, sex, org, round(purchase, 6) AS purchase, round(click, 6) AS click, round(view, 6) AS view, errors FROM f")
def patient_frame(spark, sf_dir):
    return rounded(patients(spark, sf_dir).select("source", "pid", "sex", "org", "purchase", "click", "view", "errors"))


def _one(spark, sf_dir, *variables: Variable) -> DataFrame:
    return rounded(frame.patient_frame(days(spark, sf_dir), list(variables)))


@query(f"WITH {DAYS} SELECT source, pid, round(arg_min_null(value, row(day_offset IS NULL, coalesce(day_offset, 0), seq)) FILTER (WHERE concept = 'view'), 6) AS first_view FROM days GROUP BY source, pid")
def agg_first(spark, sf_dir):
    return _one(spark, sf_dir, Variable("first_view", "view", "first"))


@query(f"WITH {DAYS} SELECT source, pid, round(arg_max_null(value, row(day_offset IS NULL, coalesce(day_offset, 0), seq)) FILTER (WHERE concept = 'view'), 6) AS last_view FROM days GROUP BY source, pid")
def agg_last(spark, sf_dir):
    return _one(spark, sf_dir, Variable("last_view", "view", "last"))


@query(f"WITH {DAYS} SELECT source, pid, round(avg(value) FILTER (WHERE concept = 'click'), 6) AS mean_click, round(min(value) FILTER (WHERE concept = 'click'), 6) AS min_click, round(max(value) FILTER (WHERE concept = 'click'), 6) AS max_click FROM days GROUP BY source, pid")
def agg_mean_min_max(spark, sf_dir):
    return _one(spark, sf_dir, *(Variable(f"{a}_click", "click", a) for a in ("mean", "min", "max")))


@query(f"WITH {DAYS} SELECT source, pid, count(*) FILTER (WHERE concept = 'click' AND day_offset BETWEEN -5 AND 5) AS n_click FROM days GROUP BY source, pid")
def agg_count_window(spark, sf_dir):
    return _one(spark, sf_dir, Variable("n_click", "click", "count", (-5, 5)))


@query(f"WITH {DAYS} SELECT source, pid, round(CASE WHEN count(day_offset) FILTER (WHERE concept = 'error') >= 2 AND var_pop(day_offset) FILTER (WHERE concept = 'error') > 0 THEN regr_slope(value, day_offset) FILTER (WHERE concept = 'error') END, 6) AS slope_error FROM days GROUP BY source, pid")
def agg_slope(spark, sf_dir):
    return _one(spark, sf_dir, Variable("slope_error", "error", "slope"))


@query(f"WITH {DAYS} SELECT source, pid, arg_min_null(day_offset, row(day_offset IS NULL, coalesce(day_offset, 0), seq)) FILTER (WHERE concept = 'purchase')::BIGINT AS days_to_purchase FROM days GROUP BY source, pid".replace("FILTER (WHERE concept = 'purchase')::BIGINT", "FILTER (WHERE concept = 'purchase')"))
def time_to_first_event(spark, sf_dir):
    return _one(spark, sf_dir, Variable("days_to_purchase", "purchase", "time_to_first_event")).withColumn("days_to_purchase", F.col("days_to_purchase").cast("long"))


@query(f"WITH {DAYS} SELECT source, pid, day_offset, round(value, 6) AS value FROM days WHERE concept = 'purchase' AND day_offset BETWEEN 0 AND 10")
def series_extract(spark, sf_dir):
    return rounded(frame.series(days(spark, sf_dir), "purchase", (0, 10)).withColumn("day_offset", F.col("day_offset").cast("long")))


@query(f"WITH {OBS} SELECT source, pid FROM obs GROUP BY source, pid HAVING bool_or(concept = 'purchase' AND value >= 90) AND bool_or(concept = 'error' AND value < 10)")
def cohort_criteria(spark, sf_dir):
    return frame.members(observations(spark, sf_dir), [("purchase", ">=", 90.0), ("error", "<", 10.0)])


@query(f"WITH {OBS} SELECT pid FROM obs WHERE concept = 'purchase' AND value > 80 INTERSECT SELECT pid FROM obs WHERE concept = 'view' AND value < 5 INTERSECT SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0")
def intersect_predicates(spark, sf_dir):
    rows = observations(spark, sf_dir)
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("pid"))
    return frame.intersection([rows.where("concept = 'purchase' AND value > 80").select("pid"), rows.where("concept = 'view' AND value < 5").select("pid"), rich])


@query(f"WITH {OBS}, {VERDICTS} SELECT pid, count(*) AS rows_kept FROM obs WHERE pid IN (SELECT pid FROM obs WHERE concept = 'purchase' AND value > 80 INTERSECT SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0) AND pid NOT IN (SELECT pid FROM v WHERE coalesce(blocked, true)) GROUP BY pid")
def cohort_resolve(spark, sf_dir):
    rows, people = observations(spark, sf_dir), read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pid"), "c_acctbal")
    verdicts = people.select("pid", F.when(F.col("c_acctbal") < 0, True).when(F.col("c_acctbal") < 5000, False).alias("blocked"))
    cohort = frame.not_blocked(frame.intersection([rows.where("concept = 'purchase' AND value > 80").select("pid"), people.where("c_acctbal > 0").select("pid")]), verdicts)
    return rows.join(cohort, "pid", "left_semi").groupBy("pid").agg(F.count("*").alias("rows_kept"))


@query("SELECT count(*) AS not_returned FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def not_returned_count(spark, sf_dir):
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return frame.not_returned(people, read(spark, sf_dir, "events"), "user_id")


# Statistics

MOMENTS = """m AS (SELECT source, count(purchase) AS n, count(*) - count(purchase) AS missing, sum(purchase) AS total, sum(purchase * purchase) AS squares FROM f GROUP BY source),
 a AS (SELECT * FROM m UNION ALL SELECT 'pooled', sum(n), sum(missing), sum(total), sum(squares) FROM m{where})"""
SHOW = "round(total / nullif(n, 0), 6) AS mean, round(CASE WHEN n > 1 THEN sqrt(greatest(squares - n * (total / n) * (total / n), 0) / (n - 1)) END, 6) AS sd"


@query(f"WITH {FRAME}, {MOMENTS.format(where='')} SELECT source, n::BIGINT AS n, missing::BIGINT AS missing, {SHOW} FROM a")
def describe_continuous(spark, sf_dir):
    parts = statistics.moments(patients(spark, sf_dir), "purchase", ["source"])
    return rounded(statistics.mean_and_sd(statistics.per_source_and_pooled(parts, [])).select("source", "n", "missing", "mean", "sd"))


@query(f"WITH {FRAME}, {MOMENTS.format(where=chr(32) + 'WHERE source NOT IN (' + chr(39) + 'cdr3' + chr(39) + ')')} SELECT source, n::BIGINT AS n, missing::BIGINT AS missing, {SHOW} FROM a")
def pooled_excludes_nopool(spark, sf_dir):
    rows = patients(spark, sf_dir)
    policies = rows.select("source").distinct().withColumn("may_pool", F.col("source") != "cdr3")
    parts = statistics.per_source_and_pooled(statistics.moments(rows, "purchase", ["source"]), [], policies)
    return rounded(statistics.mean_and_sd(parts).select("source", "n", "missing", "mean", "sd"))


@query(f"WITH {FRAME} SELECT coalesce(source, 'pooled') AS source, sex AS level, CASE WHEN count(*) >= 5 THEN count(*) END AS n, count(*) < 5 AS suppressed FROM f GROUP BY GROUPING SETS ((source, sex), (sex))")
def describe_categorical(spark, sf_dir):
    by_source = statistics.frequency(patients(spark, sf_dir), "sex", ["source"])
    pooled = by_source.groupBy("level").agg(F.sum("n").alias("n")).withColumn("source", F.lit("pooled"))
    return disclosure.suppressed(by_source.unionByName(pooled), 5).select("source", "level", "n", "suppressed")


@query(f"WITH {FRAME}, b AS (SELECT source, unnest(range(0, 10)) AS bin FROM (SELECT DISTINCT source FROM f)), h AS (SELECT source, CASE WHEN purchase < 0 THEN -1 WHEN purchase >= 100 THEN 10 ELSE floor(purchase / 10) END AS bin, count(*) AS n FROM f GROUP BY 1, 2) SELECT source, bin::INT AS bin, n FROM h WHERE bin IS NULL OR bin NOT BETWEEN 0 AND 9 UNION ALL SELECT b.source, b.bin::INT, coalesce(n, 0) FROM b LEFT JOIN h ON h.source = b.source AND h.bin = b.bin")
def histogram_fixed(spark, sf_dir):
    return statistics.histogram(patients(spark, sf_dir), "purchase", statistics.edges(0, 100, 10), ["source"])


@query("WITH b AS (SELECT unnest(range(0, 10)) AS bin), h AS (SELECT l_linestatus, len(list_filter(range(0, 11), lambda i: i * 0.01::DOUBLE <= l_discount)) - 1 AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT DISTINCT l_linestatus FROM lineitem) SELECT s.l_linestatus, b.bin::INT AS bin, coalesce(n, 0) AS n FROM s, b LEFT JOIN h ON h.l_linestatus = s.l_linestatus AND h.bin = b.bin UNION ALL SELECT l_linestatus, bin::INT, n FROM h WHERE bin < 0 OR bin > 9")
def histogram_hundredths(spark, sf_dir):
    """Values that lie on edges which binary fractions do not meet: the edges decide."""
    return statistics.histogram(read(spark, sf_dir, "lineitem"), "l_discount", statistics.edges(0, 0.1, 0.01), ["l_linestatus"])


@query("WITH q AS (SELECT floor(quantile_cont(value, 0.01) / 5) * 5 AS lo, ceil(quantile_cont(value, 0.99) / 5) * 5 AS hi FROM events) SELECT event_type, CASE WHEN value < lo THEN -1 WHEN value >= hi THEN (hi - lo) / 5 ELSE floor((value - lo) / 5) END::INT AS bin, count(*) AS n FROM events, q GROUP BY 1, 2")
def histogram_auto(spark, sf_dir):
    """Bins from the inner 98 percent of a first pass; those without values have no row here."""
    rows = read(spark, sf_dir, "events")
    low, high = ranks.percentiles(rows, "value", [], {"low": 0.01, "high": 0.99}).first()
    low, high = low // 5 * 5, -(-high // 5) * 5
    return statistics.histogram(rows, "value", statistics.edges(low, high, 5), ["event_type"]).where("n > 0").withColumn("bin", F.col("bin").cast("int"))


@query("SELECT event_type AS level, count(*) AS n FROM events GROUP BY 1")
def frequency_1d(spark, sf_dir):
    return statistics.frequency(read(spark, sf_dir, "events"), "event_type", [])


@query("SELECT l_returnflag AS row, l_linestatus AS col, count(*) AS n FROM lineitem GROUP BY 1, 2".replace("AS row", 'AS "row"'))
def crosstab(spark, sf_dir):
    return statistics.crosstab(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("WITH c AS (SELECT quality r, toxic k, count(*) n FROM labels GROUP BY 1, 2), g AS (SELECT r, k, n, sum(n) OVER (PARTITION BY r) rt, sum(n) OVER (PARTITION BY k) ct, sum(n) OVER () t FROM c) SELECT round(sum(power(n - rt * ct * 1.0 / t, 2) / (rt * ct * 1.0 / t)), 6) AS chi2, ((count(DISTINCT r) - 1) * (count(DISTINCT k) - 1))::BIGINT AS dof FROM g")
def chi_square(spark, sf_dir):
    return rounded(statistics.chi_square(statistics.crosstab(read(spark, sf_dir, "labels"), "quality", "toxic")))


PAIR = "SELECT {s} AS source, '{x}' AS x, '{y}' AS y, count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS n, CASE WHEN count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) >= 3 AND NOT isnan(corr({x}, {y})) THEN round(corr({x}, {y}), 6) END AS r FROM f GROUP BY {g}"


@query(f"WITH {FRAME} " + " UNION ALL ".join(PAIR.format(s="source", g="source", x=x, y=y) for x, y in (("click", "purchase"), ("click", "view"))))
def pearson_matrix(spark, sf_dir):
    return rounded(statistics.pearson(patients(spark, sf_dir), [("click", "purchase"), ("click", "view")], ["source"]))


RHO = """p AS (SELECT source, click x, view y FROM f WHERE click IS NOT NULL AND view IS NOT NULL),
 r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY x) + (count(*) OVER (PARTITION BY source, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY source ORDER BY y) + (count(*) OVER (PARTITION BY source, y) - 1) / 2.0 AS ry FROM p),
 s AS (SELECT source, count(*) n, CASE WHEN count(*) >= 3 AND NOT isnan(corr(rx, ry)) THEN corr(rx, ry) END rho FROM r GROUP BY source)"""


@query(f"WITH {FRAME}, {RHO} SELECT source, n, round(rho, 6) AS rho FROM s")
def spearman_by_source(spark, sf_dir):
    return rounded(statistics.spearman(patients(spark, sf_dir), "click", "view"))


@query(f"WITH {FRAME}, {RHO} SELECT round(sum(rho * n) / sum(n), 6) AS rho, sum(n)::BIGINT AS n FROM s WHERE rho IS NOT NULL")
def spearman_weighted(spark, sf_dir):
    return rounded(statistics.weighted_mean(statistics.spearman(patients(spark, sf_dir), "click", "view"), "rho", "n"))


@query(f"WITH {FRAME}, m AS (SELECT purchase < 60 AS low, 'x' AS k, * FROM f WHERE purchase IS NOT NULL) SELECT CASE WHEN low THEN 'low' ELSE 'high' END AS \"group\", count(click) AS n, round(avg(click), 6) AS mean, round(stddev_samp(click), 6) AS sd FROM m GROUP BY low")
def compare_groups(spark, sf_dir):
    groups = frame.grouped(patients(spark, sf_dir), {"high": [("purchase", ">=", 60.0)], "low": [("purchase", "<", 60.0)]})
    return rounded(statistics.mean_and_sd(statistics.moments(groups, "click", ["group"])).select("group", "n", "mean", "sd"))


WELCH = """g AS (SELECT sex, count(click) n, avg(click) m, var_samp(click) v FROM f GROUP BY sex)
 SELECT a.sex AS a, b.sex AS b, round(b.m - a.m, 6) AS diff, round((b.m - a.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS smd,
 round((b.m - a.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) AS dof
 FROM g a JOIN g b ON a.sex < b.sex"""


@query(f"WITH {FRAME}, {WELCH}")
def welch_t(spark, sf_dir):
    summary = statistics.mean_and_sd(statistics.moments(patients(spark, sf_dir), "click", ["sex"]))
    return rounded(statistics.welch(summary, "sex")).withColumn("dof", F.round("dof", 4))


@query(f"WITH {DAYS}, s AS (SELECT DISTINCT source FROM days WHERE concept = 'purchase' AND day_offset IS NOT NULL), b AS (SELECT source, unnest(range(0, 4)) AS bin FROM s), p AS (SELECT source, (day_offset // 7) AS bin, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM days WHERE concept = 'purchase' AND day_offset >= 0 AND day_offset < 28 GROUP BY 1, 2) SELECT b.source, b.bin::INT AS bin, (b.bin * 7)::INT AS day_from, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM b LEFT JOIN p ON p.source = b.source AND p.bin = b.bin")
def over_time(spark, sf_dir):
    points = frame.series(days(spark, sf_dir), "purchase")
    return rounded(statistics.over_time(points, 7, 0, 28, ["source"]).select("source", "bin", "day_from", "n", "mean", "sd"))


@query(f"WITH {OBS} SELECT observations, count(*) AS patients FROM (SELECT source, pid, count(*) AS observations FROM obs GROUP BY source, pid) GROUP BY observations")
def completeness_obs_dist(spark, sf_dir):
    return statistics.observation_counts(observations(spark, sf_dir), []).withColumnRenamed("n", "patients")


@query(f"WITH {FRAME} " + " UNION ALL ".join(f"SELECT '{v}' AS variable, count(*) FILTER (WHERE {v} IS NULL) AS missing, count({v}) AS present FROM f" for v in ("purchase", "click", "view")))
def completeness_missing(spark, sf_dir):
    return statistics.missingness(patients(spark, sf_dir), ["purchase", "click", "view"], []).withColumnRenamed("var", "variable")


@query(f"WITH {OBS} SELECT org, count(*) AS n FROM obs GROUP BY org")
def rows_by_org(spark, sf_dir):
    return statistics.rows_by_organisation(observations(spark, sf_dir), [])


@query("WITH c AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem), x AS (SELECT count(*)::DOUBLE s00, sum(a) s01, sum(b) s02, sum(y) s03, sum(a*a) s11, sum(a*b) s12, sum(a*y) s13, sum(b*b) s22, sum(b*y) s23, sum(y*y) s33 FROM c) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(s{i}{j} / s33, 9) AS value FROM x" for i in range(4) for j in range(i, 4)))
def linreg_normal_eq(spark, sf_dir):
    cells = statistics.normal_equations(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    whole = F.max(F.when((F.col("i") == 3) & (F.col("j") == 3), F.col("value"))).over(Window.partitionBy(F.lit(0)))
    return cells.select("i", "j", F.round(F.col("value") / whole, 9).alias("value"))


@query("SELECT l_linestatus AS \"group\", round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, count(*) AS n FROM lineitem GROUP BY 1")
def linreg_coefficients(spark, sf_dir):
    """Coefficients from the normal equations of each group; a group of fewer than max(k, p + 2) rows has none."""
    return rounded(statistics.coefficients(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], "l_linestatus", 5).select(F.col("l_linestatus").alias("group"), F.round("intercept", 4).alias("intercept"), F.col("l_quantity").alias("slope"), "n"))


KM = "km AS (SELECT floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 180)::BIGINT AS period, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS events, count(*) * 3 AS at_risk FROM orders GROUP BY 1)"


@query(f"WITH {KM}, k AS (SELECT period, sum(events) d, sum(at_risk) n FROM km GROUP BY period HAVING sum(at_risk) > 0) SELECT period, d::BIGINT AS events, n::BIGINT AS at_risk, round(exp(sum(ln(1 - d * 1.0 / n)) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING)), 6) AS survival FROM k")
def kaplan_meier(spark, sf_dir):
    period = F.floor(F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) / 180)
    rows = read(spark, sf_dir, "orders").groupBy(period.alias("period")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("events"), (F.count("*") * 3).alias("at_risk"))
    return rounded(statistics.kaplan_meier(rows))


@query(f"WITH {KM}, k AS (SELECT period, sum(events) d, sum(at_risk) n FROM km GROUP BY period HAVING sum(at_risk) > 0), c AS (SELECT *, exp(sum(ln(1 - d * 1.0 / n)) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING)) AS s, (SELECT avg(n) FROM k) AS thin FROM k) SELECT period, CASE WHEN n >= thin THEN round(s, 6) END AS survival, n < thin AS suppressed FROM c")
def kaplan_meier_hidden(spark, sf_dir):
    """Periods with few at risk are hidden; the curve goes on behind them."""
    period = F.floor(F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) / 180)
    rows = read(spark, sf_dir, "orders").groupBy(period.alias("period")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("events"), (F.count("*") * 3).alias("at_risk"))
    thin = rows.agg(F.avg("at_risk")).first()[0]
    return rounded(statistics.hide_thin(statistics.kaplan_meier(rows), thin).select("period", "survival", "suppressed"))


CENTROIDS = """v AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY value, seq) rn, count(*) OVER (PARTITION BY source) c FROM obs),
 z AS (SELECT *, greatest(5, ceil(c / 200.0)) step FROM v),
 cen AS (SELECT source, least(floor((rn - 1) / step), greatest(floor(c / step) - 1, 0)) g, avg(value) mean, count(*) weight FROM z GROUP BY 1, 2)"""


@query(f"WITH {OBS}, {CENTROIDS} SELECT source, g::BIGINT AS g, round(mean, 6) AS mean, weight FROM cen")
def protected_sketch(spark, sf_dir):
    return rounded(statistics.protected_sketch(observations(spark, sf_dir), "value", 5, ["source"])).withColumn("g", F.col("g").cast("long"))


@query(f"WITH {OBS}, {CENTROIDS}, o AS (SELECT mean, weight w, sum(weight) OVER (ORDER BY mean, weight ROWS UNBOUNDED PRECEDING) cum, sum(weight) OVER () tot, lag(mean) OVER (ORDER BY mean, weight) prev FROM cen) SELECT round(coalesce(prev + (mean - prev) * ((0.5 * tot - (cum - w)) / w), mean), 6) AS quantile FROM o WHERE cum >= 0.5 * tot ORDER BY cum LIMIT 1")
def sketch_merge_quantile(spark, sf_dir):
    return rounded(statistics.sketch_quantile(statistics.protected_sketch(observations(spark, sf_dir), "value", 5, ["source"]), 0.5))


# Exploration

SUMMARY = "count(value) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75"


@query(f"WITH {OBS} SELECT source, {SUMMARY} FROM obs WHERE concept = 'purchase' GROUP BY source")
def stats_per_source(spark, sf_dir):
    return rounded(statistics.summary(observations(spark, sf_dir).where("concept = 'purchase'"), "value", ["source"]))


BUCKETS = """m AS (SELECT source, min(value) mn, max(value) mx FROM obs GROUP BY source),
 pb AS (SELECT o.source, least(floor((o.value - m.mn) / ((m.mx - m.mn) / 20)), 19)::INT AS bucket, mn, mx, count(*) n FROM obs o JOIN m ON m.source = o.source GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {OBS}, {BUCKETS} SELECT source, bucket, n FROM pb")
def histogram_equiwidth(spark, sf_dir):
    return statistics.equal_width(observations(spark, sf_dir), "value", ["source"]).select("source", "bucket", "n")


@query(f"WITH {OBS}, {BUCKETS}, mid AS (SELECT n, ((mn + bucket * ((mx - mn) / 20)) + CASE WHEN bucket = 19 THEN mx + 1e-9 ELSE mn + (bucket + 1) * ((mx - mn) / 20) END) / 2 AS x FROM pb), gl AS (SELECT min(mn) g0, max(mx) g1 FROM m) SELECT least(greatest(floor((x - g0) / ((g1 - g0) / 20)), 0), 19)::INT AS bucket, sum(n)::BIGINT AS n FROM mid, gl GROUP BY 1")
def histogram_rebucket_merge(spark, sf_dir):
    return statistics.rebucketed(statistics.equal_width(observations(spark, sf_dir), "value", ["source"]))


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events")
def chan_merge(spark, sf_dir):
    return rounded(statistics.combined(statistics.summary(observations(spark, sf_dir), "value", ["source"])))


@query("SELECT c_custkey, c_custkey::DOUBLE AS lo, (c_custkey + 10)::DOUBLE AS hi, c_nationkey::BIGINT AS n FROM customer")
def parse_bucket_text(spark, sf_dir):
    text = F.format_string("[%s,%s):%s", "c_custkey", F.col("c_custkey") + 10, "c_nationkey")
    return read(spark, sf_dir, "customer").select("c_custkey", *statistics.bucket_text(text))


@query("SELECT o_orderpriority AS label, count(*) AS n, round(min(o_totalprice), 6) AS least, round(max(o_totalprice), 6) AS most, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.75), 6) AS p75 FROM orders GROUP BY 1")
def boxplot_by_group(spark, sf_dir):
    return rounded(exploration.box_plot(read(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderpriority")))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.75), 6) AS p75 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def trend_month(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(exploration.trend(rows, "l_quantity", fn.calendar(F.col("l_shipdate"), "month")))


LATEST = "l AS (SELECT *, row_number() OVER (PARTITION BY pid, concept ORDER BY ts DESC, seq) AS rn FROM obs), xy AS (SELECT a.pid, a.source, a.value AS x, b.value AS y FROM l a JOIN l b ON a.pid = b.pid WHERE a.rn = 1 AND b.rn = 1 AND a.concept = 'purchase' AND b.concept = 'error')"


@query(f"WITH {OBS}, {LATEST} SELECT pid, source, round(x, 6) AS x, round(y, 6) AS y FROM xy")
def scatter_latest(spark, sf_dir):
    return rounded(frame.paired_latest(observations(spark, sf_dir), "purchase", "error").select("pid", "source", "x", "y"))


@query(f"WITH {OBS}, {LATEST.replace('purchase', 'view').replace('error', 'click')} SELECT pid, source, round(x, 6) AS x, round(y, 6) AS y FROM xy WHERE x IS NOT NULL AND y IS NOT NULL")
def scatter_pairs(spark, sf_dir):
    return rounded(frame.paired_latest(observations(spark, sf_dir), "view", "click").where("x IS NOT NULL AND y IS NOT NULL").select("pid", "source", "x", "y"))


@query(f"WITH {OBS}, {LATEST} SELECT floor(x / 20)::BIGINT AS bx, floor(y / 20)::BIGINT AS \"by\", CASE WHEN count(*) >= 5 THEN count(*) END AS n, count(*) < 5 AS suppressed FROM xy GROUP BY 1, 2")
def binned_pairs(spark, sf_dir):
    return exploration.binned_2d(frame.paired_latest(observations(spark, sf_dir), "purchase", "error"), 20, 20)


@query(f"WITH {OBS} SELECT source, seq FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS n, greatest(ceil(count(*) OVER (PARTITION BY source) / 100.0), 1) AS stride FROM obs) WHERE (n - 1) % stride = 0")
def stride_sample(spark, sf_dir):
    return frame.every_nth(observations(spark, sf_dir), [F.col("seq")], 100, ["source"]).select("source", "seq")


PCT = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95))
PCT9 = PCT.replace(", 6)", ", 9)")  # averages of few decimals end in a 5 at six digits too often


@query(f"WITH {OBS}, s AS (SELECT source, unnest(range(0, 24)) AS hour FROM (SELECT DISTINCT source FROM obs)), h AS (SELECT source, hour(ts) AS hour, count(value) AS n, round(avg(value), 9) AS mean, {PCT9} FROM obs GROUP BY 1, 2) SELECT s.source, s.hour::INT AS hour, coalesce(n, 0) AS n, mean, p5, p25, p50, p75, p95 FROM s LEFT JOIN h ON h.source = s.source AND h.hour = s.hour")
def agp_hourly(spark, sf_dir):
    return rounded(exploration.glucose_hours(observations(spark, sf_dir), ["source"]), 9)


@query(f"WITH {OBS} SELECT source, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(100 * stddev_pop(value) / avg(value), 6) AS cv, round(avg(CASE WHEN value BETWEEN 3.9 AND 10 THEN 100.0 ELSE 0 END), 6) AS tir, round(avg(CASE WHEN value < 3.9 THEN 100.0 ELSE 0 END), 6) AS tbr, round(avg(CASE WHEN value > 10 THEN 100.0 ELSE 0 END), 6) AS tar FROM obs GROUP BY source")
def agp_summary(spark, sf_dir):
    return rounded(exploration.glucose_summary(observations(spark, sf_dir), ["source"]))


WEIGHTED = ", ".join(f"round(sum({c} * n) / sum(n), 9) AS {c}" for c in ("p5", "p25", "p50", "p75", "p95", "mean"))


@query(f"WITH {OBS}, h AS (SELECT source, hour(ts) AS hour, count(value) AS n, avg(value) AS mean, {PCT.replace('round(', '').replace(', 6)', '')} FROM obs GROUP BY 1, 2) SELECT hour::INT AS hour, sum(n)::BIGINT AS n, {WEIGHTED} FROM h GROUP BY 1")
def agp_merge_weighted(spark, sf_dir):
    return rounded(exploration.merged_hours(exploration.glucose_hours(observations(spark, sf_dir), ["source"])), 9)


@query(f"WITH {OBS}, a AS (SELECT pid, value, row_number() OVER (PARTITION BY pid ORDER BY ts, seq) rn FROM obs), b AS (SELECT pid, rn, lag(rn) OVER (PARTITION BY pid ORDER BY rn) pr FROM a WHERE value < 3.9) SELECT pid, count(*) AS events FROM b WHERE pr IS NULL OR rn - pr > 6 GROUP BY pid")
def hypo_events(spark, sf_dir):
    return exploration.hypo_events(observations(spark, sf_dir))


def lttb_sql(points: int, by: str) -> str:
    """By recursion, a bucket a step: what the one before has kept decides."""
    last = points - 2
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by.split(", "))
    return f"""WITH RECURSIVE {OBS}, p AS (SELECT {by}, seq, ts, value, epoch_us(ts)::DOUBLE AS x, row_number() OVER (PARTITION BY {by} ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM obs WHERE value IS NOT NULL),
 b AS MATERIALIZED (SELECT *, CASE WHEN i = 0 THEN -1 WHEN i = n - 1 THEN {last} ELSE len(list_filter(range(0, {last}), lambda j: 1 + floor(j * ((n - 2)::DOUBLE / {last})) <= i)) - 1 END AS b FROM p WHERE n > {points}),
 m AS MATERIALIZED (SELECT {by}, b, avg(x) AS mx, avg(value) AS my FROM b GROUP BY {by}, b),
 w AS (SELECT {by}, b, {{'area': 0.0::DOUBLE, 'back': 0::BIGINT, 'seq': seq, 'x': x, 'y': value}} AS k FROM b WHERE b = -1
  UNION ALL SELECT {", ".join(f"w.{c}" for c in by.split(", "))}, w.b + 1, max({{'area': abs((w.k.x - mx) * (q.value - w.k.y) - (w.k.x - q.x) * (my - w.k.y)), 'back': -q.i, 'seq': q.seq, 'x': q.x, 'y': q.value}})
   FROM w JOIN b q ON {on("q", "w")} AND q.b = w.b + 1 JOIN m ON {on("m", "w")} AND m.b = w.b + 2 GROUP BY {", ".join(f"w.{c}" for c in by.split(", "))}, w.b)
 SELECT {by}, seq, ts, value FROM p WHERE n <= {points} OR i = n - 1 OR seq IN (SELECT k.seq FROM w)"""


@query(lttb_sql(20, "source, pid"))
def lttb(spark, sf_dir):
    return series.downsample(observations(spark, sf_dir), 20, ["source", "pid"])


@query(lttb_sql(60, "source"))
def lttb_long(spark, sf_dir):
    """A source's observations as one long series each."""
    return series.downsample(observations(spark, sf_dir), 60, ["source"])


@query("SELECT key, sum(n)::BIGINT AS n, count(DISTINCT source) AS sources FROM (SELECT 'cdr' || n_regionkey AS source, c_mktsegment AS key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY key")
def federated_counts(spark, sf_dir):
    people = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = people.groupBy(F.concat(F.lit("cdr"), F.col("n_regionkey")).alias("source"), F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n"))
    return exploration.federated_counts(counts)


@query(f"WITH {OBS} SELECT source, count(*) AS observations, count(DISTINCT pid) AS patients, count(DISTINCT concept) AS concepts FROM obs GROUP BY source")
def inventory_by_source(spark, sf_dir):
    return exploration.inventory(observations(spark, sf_dir))


@query(f"WITH {OBS}, u AS (SELECT source, concept, CASE WHEN source = 'cdr0' AND concept = 'view' THEN 'v' ELSE 'u' END AS unit FROM obs) SELECT concept, string_agg(DISTINCT source, ',' ORDER BY source) AS held_by, count(*) AS observations, count(DISTINCT unit) AS n_units, count(DISTINCT unit) > 1 AS unit_disagreement FROM u GROUP BY concept")
def concept_inventory(spark, sf_dir):
    unit = F.when((F.col("source") == "cdr0") & (F.col("concept") == "view"), "v").otherwise("u")
    return exploration.concept_inventory(observations(spark, sf_dir).groupBy("source", "concept", unit.alias("unit")).agg(F.count("*").alias("n")))


@query(f"""WITH {OBS}, u AS (SELECT source, CASE WHEN seq % 97 <> 0 THEN concept END AS concept, CASE WHEN seq % 5 = 0 THEN NULL WHEN source = 'cdr0' THEN 'v' ELSE 'u' END AS unit FROM obs),
 k AS (SELECT concept, string_agg(DISTINCT source, ',' ORDER BY source) AS held_by, count(*) AS observations, count(DISTINCT unit) > 1 AS unit_disagreement FROM u WHERE concept IS NOT NULL GROUP BY concept),
 n AS (SELECT concept, string_agg(unit || ':' || c, ',' ORDER BY unit) AS units FROM (SELECT concept, unit, count(*) AS c FROM u WHERE unit IS NOT NULL GROUP BY 1, 2) GROUP BY concept)
 SELECT k.concept, held_by, observations, CASE WHEN held_by LIKE '%cdr3%' THEN 'name of cdr3' WHEN held_by LIKE '%cdr1%' THEN 'name of cdr1' END AS display, units, unit_disagreement, row_number() OVER (ORDER BY observations DESC, k.concept)::INT AS number FROM k JOIN n ON n.concept = k.concept""")
def concept_units(spark, sf_dir):
    """Concepts with their units merged by addition and the first source's display, in the registry's order 4 to 0."""
    rows = observations(spark, sf_dir).select("source", F.when(F.col("seq") % 97 != 0, F.col("concept")).alias("concept"), F.when(F.col("seq") % 5 == 0, None).when(F.col("source") == "cdr0", "v").otherwise("u").alias("unit"))
    counts = rows.groupBy("source", "concept", "unit").agg(F.count("*").alias("n"))
    told = counts.groupBy("source", "concept").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("unit", "n")))).alias("units"))
    named = F.when(F.col("source").isin("cdr1", "cdr3"), F.concat(F.lit("name of "), F.col("source")))
    answers = told.withColumns({"place": 4 - F.substring("source", 4, 1).cast("int"), "display": named})
    entries = F.transform(F.map_entries("units"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return exploration.merged_concepts(answers, ("display",)).select("concept", F.array_join("held_by", ",").alias("held_by"), "observations", "display", F.array_join(entries, ",").alias("units"), "unit_disagreement", "number")


@query("WITH c AS (SELECT 'cdr' || n_regionkey AS source, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT count_if(source <> 'cdr2')::BIGINT AS answered, count_if(source = 'cdr2')::BIGINT AS missing, 'degraded' AS mode FROM c")
def federated_mode(spark, sf_dir):
    """One source has not answered: its counts are null."""
    people = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = people.groupBy(F.concat(F.lit("cdr"), F.col("n_regionkey")).alias("source"), F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n"))
    return exploration.answering(counts.withColumn("n", F.when(F.col("source") != "cdr2", F.col("n"))))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), v AS (SELECT k, 1 + (k % 5 = 0)::INT AS lines FROM o WHERE k % 7 <> 0 AND k % 11 <> 0), t(run, known) AS (VALUES ('first', false), ('again', true))
 SELECT run, CASE WHEN known THEN 0 ELSE (SELECT count(*) FROM v) END::BIGINT AS added, CASE WHEN known THEN (SELECT sum(lines) FROM v) ELSE (SELECT sum(lines) - count(*) FROM v) END::BIGINT AS skipped, (SELECT count(*) FROM o WHERE k % 7 = 0 OR k % 11 = 0) + (SELECT count(*) FROM o WHERE k % 5 = 0 AND (k % 7 = 0 OR k % 11 = 0)) AS malformed FROM t""")
def import_lines(spark, sf_dir):
    """JSON lines of orders, some cut short, some without a key, some twice: imported, and imported again."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    whole = F.to_json(F.struct(F.when(F.col("id") % 11 != 0, F.col("id")).alias("id"), "status"))
    lines = orders.select(F.when(F.col("id") % 7 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value"), "id")
    lines = lines.union(lines.where("id % 5 = 0")).select("value").union(spark.createDataFrame([(" ",), ("",)], "value string"))
    rows, first = imported(lines, "id long, status string", "id")
    _, again = imported(lines, "id long, status string", "id", rows)
    return first.withColumn("run", F.lit("first")).unionByName(again.withColumn("run", F.lit("again")))


@query(f"""WITH {OBS}, c AS (SELECT source, concept, count(*) AS n, min(seq) AS least, max(seq) AS most FROM obs GROUP BY 1, 2),
 j AS (SELECT source, json_object('n', sum(n)::BIGINT, 'none', NULL, 'empty', json_array(), 'by', json_object('concept', to_json(list({{'code': concept, 'seq': [least, most]}} ORDER BY concept)))) AS j FROM c GROUP BY source)
 SELECT source, replace(fullkey, '$.', '') AS path, atom ->> '$' AS value FROM j, json_tree(j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""".replace("'none', NULL, ", ""))
def flatten_results(spark, sf_dir):
    """Nested results of each source as (path, value) rows."""
    each = observations(spark, sf_dir).groupBy("source", "concept").agg(F.count("*").alias("n"), F.min("seq").alias("least"), F.max("seq").alias("most"))
    held = F.array_sort(F.collect_list(F.struct(F.col("concept").alias("code"), F.array("least", "most").alias("seq"))))
    nested = each.groupBy("source").agg(F.sum("n").alias("n"), held.alias("concept")).select("source", F.to_json(F.struct("n", F.array().alias("empty"), F.struct("concept").alias("by"))).alias("nested"))
    return report.flattened(nested, ["source"], "nested")


@query("""WITH s AS (SELECT c_custkey % 9 = 0 AS g, c_custkey % 4 = 0 AS p, c_custkey % 10 = 0 AS k, c_custkey % 6 = 0 AS v FROM customer), f(finding, "column") AS (SELECT f, c FROM (VALUES ('guid'), ('personnummer'), ('private_key')) a(f), (VALUES ('name'), ('deep.list[].note'), ('deep.tags.<key>'), ('deep.tags{}')) b(c))
 SELECT finding, "column", sum(CASE WHEN (finding, "column") = ('guid', 'deep.list[].note') THEN g WHEN (finding, "column") = ('personnummer', 'deep.tags.<key>') THEN p WHEN (finding, "column") = ('private_key', 'deep.tags{}') THEN k WHEN (finding, "column") = ('personnummer', 'name') THEN v ELSE false END::INT)::BIGINT AS n FROM s, f GROUP BY f."column", finding""")
def nested_scan(spark, sf_dir):
    """Identifiers planted at every depth: in a text, an array of structs, keys and values of a map."""
    key = F.col("c_custkey")
    guid, person = F.lit("of 0f8fad5b-d9cb-469f-a165-70867728950e."), F.lit("19121212-1212")
    notes = F.array(F.struct(F.lit("plain").alias("note")), F.struct(F.when(key % 9 == 0, guid).alias("note")))
    tags = F.create_map(F.when(key % 4 == 0, person).otherwise("tag"), F.when(key % 10 == 0, "-----BEGIN RSA PRIVATE KEY-----"))
    name = F.when(key % 6 == 0, F.concat(F.lit("nr "), person)).otherwise("somebody")
    return disclosure.identifier_scan(read(spark, sf_dir, "customer").select(name.alias("name"), F.struct(notes.alias("list"), tags.alias("tags"), key.alias("n")).alias("deep")))


@query(f"WITH {OBS} SELECT hour(ts)::INT AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM obs WHERE pid IS NOT NULL AND value IS NOT NULL GROUP BY 1")
def agp_epoch(spark, sf_dir):
    """Hours of day of raw points whose time is in seconds since 1970."""
    rows = observations(spark, sf_dir)
    points = exploration.epoch_points(rows.select("pid", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"), "value"))
    return rounded(exploration.glucose_hours(points, []).where("n > 0").select("hour", "n", "mean"))


@query(f"WITH {OBS} SELECT seq, pid FROM obs WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def since_window(spark, sf_dir):
    return exploration.since(observations(spark, sf_dir), "2024-01-30 00:00:00", 7).select("seq", "pid")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def code_predicates(spark, sf_dir):
    """Customers with an order of some priorities and one of a status."""
    return frame.with_codes(read(spark, sf_dir, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["P"]}, "o_custkey")


@query(f"WITH {OBS}, t AS (SELECT pid, count(*) AS total FROM obs GROUP BY 1) SELECT concept AS code, count(*) AS n, count(DISTINCT obs.pid) AS patients FROM obs JOIN t ON t.pid = obs.pid WHERE total >= 60 AND obs.pid IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY 1")
def preview_concepts(spark, sf_dir):
    """Rows and patients by concept over the people that a preview keeps."""
    counts = exploration.measure_counts(observations(spark, sf_dir))
    kept = exploration.with_measures(_people(spark, sf_dir), counts, 0).withColumn("kept", F.col("total") >= 60)
    return exploration.kept_concepts(kept, counts)


@query(f"WITH {OBS}, a AS (SELECT pid, concept AS code, count(*) AS n, source = 'cdr1' AS cut FROM obs GROUP BY 1, 2, 4) SELECT pid, code, sum(n * 2)::BIGINT AS n, bool_or(cut) AS truncated FROM a GROUP BY 1, 2")
def measure_counts_added(spark, sf_dir):
    """Counts of sources that have counted already and of one that sends rows, one source cut short."""
    rows = observations(spark, sf_dir)
    counted = rows.groupBy("source", "pid", F.col("concept").alias("code")).agg(F.count("*").alias("n")).withColumn("truncated", F.col("source") == "cdr1").drop("source")
    return exploration.added_counts(counted.unionByName(exploration.measure_counts(rows), allowMissingColumns=True))


@query(f"WITH {OBS} SELECT pid, concept AS code, count(*) AS n FROM obs GROUP BY 1, 2")
def measure_counts(spark, sf_dir):
    return exploration.measure_counts(observations(spark, sf_dir))


PEOPLE = "SELECT CAST(c_custkey AS VARCHAR) AS pid FROM customer"


@query(f"WITH {OBS}, t AS (SELECT pid, count(*) AS total FROM obs GROUP BY 1) SELECT p.pid, coalesce(total, 0) AS total FROM ({PEOPLE}) p LEFT JOIN t ON t.pid = p.pid WHERE coalesce(total, 0) >= 60")
def min_measures(spark, sf_dir):
    return exploration.with_measures(_people(spark, sf_dir), exploration.measure_counts(observations(spark, sf_dir)), 60)


@query(f"WITH {OBS}, t AS (SELECT pid, count(*) AS total FROM obs GROUP BY 1) SELECT p.pid, coalesce(total, 0) AS total, coalesce(total, 0) >= 60 AS kept FROM ({PEOPLE}) p LEFT JOIN t ON t.pid = p.pid ORDER BY 2 DESC, 1 LIMIT 100")
def cohort_preview(spark, sf_dir):
    return exploration.preview(_people(spark, sf_dir), exploration.measure_counts(observations(spark, sf_dir)), 60, 100)


def _people(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pid"))


# Disclosure


@query("SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) >= 12 THEN count(*) END AS n, count(*) < 12 AS suppressed FROM customer GROUP BY 1, 2")
def suppress_counts(spark, sf_dir):
    return disclosure.suppressed(read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")), 12)


@query("SELECT max(CASE WHEN n_regionkey = 3 THEN 12 ELSE 5 END)::INT AS k_min, max(10 + n_regionkey)::INT AS min_correlation, max(0.05 + n_regionkey / 100.0)::DOUBLE AS low FROM nation".replace("max(0.05 + n_regionkey / 100.0)::DOUBLE", "round(max(0.05 + n_regionkey / 100.0), 6)::DOUBLE"))
def strictest_policy(spark, sf_dir):
    low = F.lit(0.05) + F.col("n_regionkey") / 100
    policies = read(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") == 3, 12).otherwise(5).alias("k_min"), F.lit(5).alias("floor"), (F.col("n_regionkey") + 10).alias("min_correlation"), low.alias("low"), F.lit(0.95).alias("high"), F.lit(0).alias("rounding"))
    return rounded(disclosure.strictest(policies).select(F.col("k_min").cast("int").alias("k_min"), F.col("min_correlation").cast("int").alias("min_correlation"), "low"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.05), 6) AS low, round(quantile_cont(o_totalprice, 0.95), 6) AS high FROM orders GROUP BY 1")
def safe_range(spark, sf_dir):
    return rounded(disclosure.safe_range(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], disclosure.Policy()))


@query("SELECT c_nationkey, (round_even(count(*) / 5.0, 0) * 5)::BIGINT AS n FROM customer GROUP BY 1")
def round_public(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).select("c_nationkey", disclosure.rounded(F.col("n"), 5).alias("n"))


@query("WITH h AS (SELECT c_nationkey AS cohort_no, c_custkey AS pid FROM customer UNION ALL SELECT 100, c_custkey FROM customer WHERE c_acctbal > 3), b AS (SELECT c_custkey AS pid FROM customer WHERE c_acctbal > 0) SELECT cohort_no, (count(*) + (SELECT count(*) FROM b) - 2 * count(b.pid))::BIGINT AS differ FROM h LEFT JOIN b ON b.pid = h.pid GROUP BY cohort_no")
def differencing_symdiff(spark, sf_dir):
    people = read(spark, sf_dir, "customer")
    history = people.select(F.col("c_nationkey").alias("cohort_no"), F.col("c_custkey").alias("pid")).union(people.where("c_acctbal > 3").select(F.lit(100), "c_custkey"))
    return disclosure.symmetric_differences(history, people.where("c_acctbal > 0").select(F.col("c_custkey").alias("pid")))


@query("SELECT l_quantity::INT AS age, CASE WHEN l_quantity >= 40 THEN '40+' ELSE (floor(l_quantity / 5) * 5)::INT || '-' || (floor(l_quantity / 5) * 5 + 4)::INT END AS band, count(*) AS n FROM lineitem GROUP BY 1, 2")
def age_band(spark, sf_dir):
    age = F.col("l_quantity").cast("int")
    return read(spark, sf_dir, "lineitem").groupBy(age.alias("age"), fn.age_band(age, 5, 40).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def calendar_coarsen(spark, sf_dir):
    day = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").groupBy(fn.calendar(day, "year").alias("year"), fn.calendar(day, "month").alias("month")).agg(F.count("*").alias("n"))


@query(f"WITH {FRAME}, r AS (SELECT source, CASE WHEN count(*) FILTER (WHERE click IS NOT NULL AND purchase IS NOT NULL) >= 3 THEN corr(click, purchase) END AS r FROM f GROUP BY source) SELECT source, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' WHEN r IS NOT NULL THEN 'strong' END AS strength FROM r")
def corr_strength(spark, sf_dir):
    found = statistics.pearson(patients(spark, sf_dir), [("click", "purchase")], ["source"])
    return found.select("source", fn.strength(F.col("r")).alias("strength"))


@query("SELECT finding, 'text' AS column, count(*) FILTER (WHERE regexp_matches(text, form)) AS n FROM documents, (VALUES ('guid', '(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b'), ('personnummer', '\\b(?:19|20)?\\d{6}[-+]?\\d{4}\\b'), ('sentinel', '\\bFORBIDDEN-[A-Z]+\\b|\\bSURPRISE-PII\\b|\\bTEST-[A-Z0-9]+\\b'), ('key_material', '[A-Z]+_PROJECT_KEY_[A-Z0-9_]+|BEGIN [A-Z ]*PRIVATE KEY')) AS p(finding, form) GROUP BY finding".replace("AS column", 'AS "column"'))
def identifier_scan(spark, sf_dir):
    more = {"sentinel": r"\bFORBIDDEN-[A-Z]+\b|\bSURPRISE-PII\b|\bTEST-[A-Z0-9]+\b", "key_material": r"[A-Z]+_PROJECT_KEY_[A-Z0-9_]+|BEGIN [A-Z ]*PRIVATE KEY"}
    shapes = {name: form for name, form in disclosure.IDENTIFIERS.items() if name != "private_key"}
    return disclosure.identifier_scan(read(spark, sf_dir, "documents").select("text"), shapes | more)


MERGED_BINS = f"""WITH RECURSIVE {FRAME[FRAME.index("obs AS"):]}, b AS (SELECT source, floor(purchase / 5) * 5 AS lo, count(*) AS n FROM f WHERE purchase IS NOT NULL GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lo) AS i FROM b),
  r AS (SELECT source, i, 1 AS g, n AS upto FROM o WHERE i = 1 UNION ALL SELECT o.source, o.i, CASE WHEN upto < 5 THEN g ELSE g + 1 END, CASE WHEN upto < 5 THEN upto + o.n ELSE o.n END FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1),
  t AS (SELECT source, g, sum(n) AS n, max(g) OVER (PARTITION BY source) AS last FROM (SELECT r.source, r.g, o.n FROM r JOIN o ON o.source = r.source AND o.i = r.i) GROUP BY source, g),
  j AS (SELECT source, g, CASE WHEN g = last AND n < 5 AND g > 1 THEN g - 1 ELSE g END AS to_g FROM t)
SELECT j.source, string_agg(CAST(CAST(o.lo AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(o.lo + 5 AS BIGINT) AS VARCHAR), '+' ORDER BY o.i) AS label, CASE WHEN sum(o.n) >= 5 THEN sum(o.n)::BIGINT END AS n
FROM r JOIN o ON o.source = r.source AND o.i = r.i JOIN j ON j.source = r.source AND j.g = r.g GROUP BY j.source, j.to_g"""


@query(MERGED_BINS)
def merge_small_bins(spark, sf_dir):
    """Bins of patients' mean purchase by source, small ones merged with the next."""
    low = (F.floor(F.col("purchase") / 5) * 5).cast("long")
    bins = patients(spark, sf_dir).where("purchase IS NOT NULL").groupBy("source", low.alias("at")).agg(F.count("*").alias("n"))
    return disclosure.safe_bins(bins.withColumn("label", F.concat_ws("-", "at", F.col("at") + 5)), 5)


@query("""WITH h AS (SELECT c_nationkey AS cohort_no, c_custkey AS pid FROM customer UNION ALL SELECT 100, c_custkey FROM customer WHERE c_acctbal > 3 UNION ALL SELECT 101, c_custkey FROM customer WHERE c_acctbal > -1 OR c_custkey <= 3),
  b AS (SELECT c_custkey AS pid FROM customer WHERE c_acctbal > 0), s AS (SELECT cohort_no, count(*) + (SELECT count(*) FROM b) - 2 * count(b.pid) AS differ FROM h LEFT JOIN b ON b.pid = h.pid GROUP BY cohort_no)
  SELECT cohort_no, differ::BIGINT AS differ, CASE WHEN cohort_no % 5 = 0 THEN 'exempt' WHEN differ > 0 AND differ < 40 THEN 'warn' WHEN differ > 0 AND differ < 80 THEN 'near' ELSE 'ok' END AS verdict FROM s""")
def differencing_guard(spark, sf_dir):
    """Verdicts on a cohort against all that its owner has asked about before."""
    people = read(spark, sf_dir, "customer")
    history = people.select(F.col("c_nationkey").cast("int").alias("cohort_no"), F.col("c_custkey").alias("pid")).union(people.where("c_acctbal > 3").select(F.lit(100), "c_custkey")).union(people.where("c_acctbal > -1 OR c_custkey <= 3").select(F.lit(101), "c_custkey"))
    history = history.select(F.lit("me").alias("owner"), "cohort_no", F.concat(F.lit("r"), F.col("cohort_no") % 5).alias("recipe"), "pid")
    others = history.withColumn("owner", F.lit("other"))
    return disclosure.guarded(history.union(others), people.where("c_acctbal > 0").select(F.col("c_custkey").alias("pid")), "me", "r0", 40)


@query(f"WITH {OBS} SELECT source, CASE WHEN count(DISTINCT pid) >= 300 THEN count(DISTINCT pid) END AS n, count(DISTINCT pid) < 300 AS suppressed FROM obs WHERE concept = 'signup' GROUP BY source")
def audit_counts(spark, sf_dir):
    """What an audit row says of each source: its number of patients, hidden where it is small."""
    return disclosure.patients_by_source(observations(spark, sf_dir).where("concept = 'signup'"), 300)


@query()
def table_suppression(spark, sf_dir):
    """A grid by source whose small cells are hidden, with complements, so that margins don't give them away."""
    cells = patients(spark, sf_dir).groupBy("source", F.col("sex").alias("row"), F.col("org").alias("col")).agg(F.count("*").alias("n"))
    return disclosure.safe_grids(cells, 5)


@query("SELECT l_partkey, coalesce(p_name, l_partkey::VARCHAR) AS display, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) ON l_partkey = p_partkey GROUP BY 1, 2")
def concept_display(spark, sf_dir):
    """Counts by code with its name; a third of the codes have none and keep the code."""
    names = read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("display"))
    counts = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return cohorts.with_displays(counts, names, "l_partkey")


@query("SELECT 'orders' AS source, o_orderkey AS id, o_orderstatus AS archetype FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'lineitem', l_orderkey, l_linestatus FROM lineitem WHERE l_linestatus = 'F'")
def composition_search(spark, sf_dir):
    """Rows of one kind in several stores."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("archetype"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("archetype"))
    return cohorts.search({"orders": orders, "lineitem": lines}, {"archetype": "F"}).select("source", "id", "archetype")


SPEC = {
    "title": "Who buys", "purpose": "research", "sources": [f"cdr{i}" for i in range(5)], "cohort": {"include": [{"observation": "purchase", "op": "ge", "value": 20}]},
    "variables": [{"name": "clicks", "from": "click", "agg": "count"}, {"name": "bought", "from": "purchase", "agg": "mean"}, {"name": "sex", "from": "demographics.sex"}],
    "analyses": [{"kind": "frequency", "vars": ["sex"]}, {"kind": "correlation", "vars": ["clicks", "bought"]}, {"kind": "completeness"}],
}
SPEC_SQL = f"""WITH {OBS}, m AS (SELECT source, pid FROM obs GROUP BY 1, 2 HAVING bool_or(concept = 'purchase' AND value >= 20)),
  l AS (SELECT obs.* FROM obs JOIN m ON m.source = obs.source AND m.pid = obs.pid),
  lg AS (SELECT source AS grain, * FROM l UNION ALL SELECT 'pooled', * FROM l WHERE source <> 'cdr4'),
  f AS (SELECT grain, source, pid, count(*) FILTER (WHERE concept = 'click') AS clicks, avg(value) FILTER (WHERE concept = 'purchase') AS bought, min(sex) AS sex, count(*) AS rows_each FROM lg GROUP BY 1, 2, 3),
  x AS (SELECT 0 AS analysis, 'frequency' AS kind, grain AS source, 'sex' AS var, sex AS key, count(*) AS n, NULL::DOUBLE AS value FROM f GROUP BY grain, sex
    UNION ALL SELECT 1, 'correlation', grain, 'clicks|bought', 'r', count(*), CASE WHEN count(*) >= 10 THEN round(corr(clicks, bought), 6) END FROM f WHERE clicks IS NOT NULL AND bought IS NOT NULL GROUP BY grain
    UNION ALL SELECT 2, 'completeness', grain, 'observations per patient', rows_each::VARCHAR, count(*), NULL FROM f GROUP BY grain, rows_each
    UNION ALL SELECT 2, 'completeness', grain, v, k, n, NULL FROM (SELECT grain, unnest(['clicks', 'clicks', 'bought', 'bought', 'sex', 'sex']) AS v, unnest(['missing', 'present', 'missing', 'present', 'missing', 'present']) AS k,
      unnest([count(*) - count(clicks), count(clicks), count(*) - count(bought), count(bought), count(*) - count(sex), count(sex)]) AS n FROM f GROUP BY grain)
    UNION ALL SELECT 2, 'completeness', grain, 'rows by organisation', org, count(*), NULL FROM lg GROUP BY grain, org)
SELECT analysis, kind, source, var, key, CASE WHEN n = 0 OR n >= 5 THEN n END AS n, CASE WHEN n = 0 OR n >= 5 THEN value END AS value, n > 0 AND n < 5 AS suppressed FROM x"""


@query(SPEC_SQL)
def spec_run(spark, sf_dir):
    """A whole spec over all sources, one of which may not be pooled."""
    spec = AnalysisSpec.parse(SPEC)
    return rounded(run_spec(observations(spark, sf_dir), spec, [SourcePolicy(s, ("research",), may_pool=s != "cdr4") for s in spec.sources]))
