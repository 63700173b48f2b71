"""From long observations to one row for each patient, cohorts and groups."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import columns

from .ranks import numbered

PATIENT = ["source", "pid"]
COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "==": operator.eq, "!=": operator.ne}
#: Fields that no projection may carry.
NEVER = frozenset({
    "name", "given_name", "family_name", "full_name", "personnummer", "pnr", "ssn", "national_id", "address", "street", "postal_code", "city", "phone", "telephone", "mobile", "email", "e_mail",
    "free_text", "note", "notes", "comment", "narrative", "text", "patient_guid", "birth_date", "date_of_birth", "dob",
})


def with_day_offset(rows: DataFrame, index_concept: str | None = None) -> DataFrame:
    """Adds day_offset: days since the patient's earliest dated row of the index concept (of any, where none is named).

    Null for undated rows and for all rows of a patient without such a row.
    """
    day = F.col("d") if index_concept is None else F.when(F.col("concept") == index_concept, F.col("d"))
    return rows.withColumn("day_offset", F.date_diff("d", F.min(day).over(Window.partitionBy(*PATIENT))))


#: Columns that are never given, at whatever grain.
BIRTH = ("birth_date", "date_of_birth", "dob")


def coarsened(rows: DataFrame, grain: str = "month", width: int = 5, age: str = "age", day: str = "d") -> DataFrame:
    """Rows as they may be given: age as a band, the date as days from the index event (where the rows have day_offset)
    or by month or year, and no birth date. A negative age is an error; a null one has no band."""
    out = rows.drop(*BIRTH)
    if age in out.columns:
        whole = F.when(F.col(age) < 0, F.raise_error(F.lit("an age below zero")).cast("string")).otherwise(columns.age_band(F.col(age), width))
        out = out.withColumn("age_band", whole).drop(age)
    if day in out.columns:
        out = out.drop(day) if "day_offset" in out.columns else out.withColumn("calendar", columns.calendar(F.col(day), grain)).drop(day)
    return out


def undated(rows: DataFrame) -> DataFrame:
    """Rows and patients without a day offset, by source."""
    missing = F.col("day_offset").isNull()
    return rows.groupBy("source").agg(F.count_if(missing).alias("undated_rows"), F.count_distinct(F.when(missing, F.col("pid"))).alias("patients_with_undated"))


def exact_mean(value: Column) -> Column:
    """The mean of numbers, the same in whatever order rows come, so that a mean at an edge does not move past it.

    Numbers of 18 decimal places or fewer, below 10^10, are summed as the decimals they state; if any is not of these,
    all are summed as floating point.
    """
    value = value.cast("double")
    stated = F.when(F.abs(value) < 1e10, value.try_cast("decimal(38,18)"))
    exact = value.isNull() | F.coalesce(stated.cast("double") == value, F.lit(False))
    total = F.try_sum(stated).cast("double")
    return F.coalesce(F.when(F.bool_and(exact), total / F.nullif(F.count(value), F.lit(0))), F.avg(value))


@dataclass(frozen=True)
class Variable:
    """A column of the patient frame: an aggregate of a concept's rows, within a window of days if there is one."""

    name: str
    concept: str
    agg: str
    window: tuple[int, int] | None = None

    def column(self) -> Column:
        chosen = F.col("concept") == self.concept
        if self.window:
            chosen = chosen & F.col("day_offset").between(*self.window)
        when = lambda x: F.when(chosen, x)
        undated = F.col("day_offset").isNull()
        place = F.struct(undated.alias("u"), F.coalesce("day_offset", F.lit(0)).alias("o"), F.col("seq").alias("s"))
        value, day = F.col("value"), F.col("day_offset").cast("double")
        if self.agg == "slope":
            dated = when(F.when(value.isNotNull() & day.isNotNull(), day))
            n, x, y = F.count(dated), F.sum(dated), F.sum(when(F.when(day.isNotNull(), value)))
            xx, xy = F.sum(dated * dated), F.sum(dated * value)
            return F.when((n >= 2) & (n * xx - x * x > 0), (n * xy - x * y) / F.nullif(n * xx - x * x, F.lit(0.0)))
        made = {
            "first": lambda: F.min_by(value, when(place)),
            "last": lambda: F.max_by(value, when(place)),
            "mean": lambda: exact_mean(when(value)),
            "min": lambda: F.min(when(value)),
            "max": lambda: F.max(when(value)),
            "count": lambda: F.count(when(F.lit(1))),
            "time_to_first_event": lambda: F.min_by(F.col("day_offset"), when(place)),
        }
        if self.agg not in made:
            raise ValueError(f"unknown aggregate {self.agg}")
        return made[self.agg]()


def patient_frame(rows: DataFrame, variables: list[Variable], flat: tuple[str, ...] = ()) -> DataFrame:
    """A row for each patient with any row: the variables, null where no row qualifies (count: 0), and flat fields."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in flat]
    return rows.groupBy(*PATIENT).agg(*firsts, *(v.column().alias(v.name) for v in variables))


def series(rows: DataFrame, concept: str, window: tuple[int, int] | None = None) -> DataFrame:
    """The dated values of a concept: source, pid, day_offset, value."""
    found = rows.where((F.col("concept") == concept) & F.col("day_offset").isNotNull() & F.col("value").isNotNull())
    return (found.where(F.col("day_offset").between(*window)) if window else found).select(*PATIENT, "day_offset", "value")


def members(rows: DataFrame, criteria: list[tuple[str, str, float]]) -> DataFrame:
    """Patients for whom, for every criterion (concept, comparison, number), some observation satisfies it."""
    if not criteria:
        raise ValueError("a cohort has one criterion or more")
    holds = lambda c: F.coalesce(F.bool_or((F.col("concept") == c[0]) & COMPARE[c[1]](F.col("value"), c[2])), F.lit(False))
    marked = rows.groupBy(*PATIENT).agg(*(holds(c).alias(f"c{i}") for i, c in enumerate(criteria)))
    return marked.where(reduce(operator.and_, (F.col(f"c{i}") for i in range(len(criteria))))).select(*PATIENT)


def grouped(frame: DataFrame, groups: dict[str, list[tuple[str, str, float]]], overlapping: bool = False) -> DataFrame:
    """A row for each group and patient in it; a null operand puts a patient in no group. Without `overlapping` a
    patient in two groups is an error."""
    tests = [F.when(reduce(operator.and_, (COMPARE[op](F.col(v), x) for v, op, x in where)), F.lit(name)) for name, where in groups.items()]
    found = frame.withColumn("_groups", F.array_compact(F.array(*tests)))
    if not overlapping:
        too_many = F.raise_error(F.lit("a patient is in more than one group")).cast("array<string>")
        found = found.withColumn("_groups", F.when(F.size("_groups") > 1, too_many).otherwise(F.col("_groups")))
    return found.withColumn("group", F.explode("_groups")).drop("_groups")


def project(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Exactly the allowed fields."""
    if forbidden := sorted(NEVER & set(allowed)):
        raise ValueError("never projected: " + ", ".join(forbidden))
    return rows.select(*(F.col(f"`{c}`") for c in allowed))


def not_returned(people: DataFrame, rows: DataFrame, key: str = "pid") -> DataFrame:
    """How many of the people asked for have no row at all."""
    return people.join(rows.select(key), key, "left_anti").agg(F.count("*").alias("not_returned"))


def not_blocked(people: DataFrame, verdicts: DataFrame, key: str = "pid") -> DataFrame:
    """People without a verdict of blocked, or a verdict that is missing its answer."""
    return people.join(verdicts.where(F.coalesce("blocked", F.lit(True))).select(key), key, "left_anti")


def consenting(people: DataFrame, consents: DataFrame, key: str = "pid") -> tuple[DataFrame, DataFrame]:
    """Those allowed, and how many are not, by reason (not registered: no consent row)."""
    joined = people.join(consents, key, "left")
    out = joined.where(~F.coalesce("allowed", F.lit(False)))
    return joined.where("allowed").select(*people.columns), out.groupBy(F.coalesce("reason", F.lit("not registered")).alias("reason")).agg(F.count("*").alias("n"))


def _lifted(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with each block of their organisation, and whether that block's lift lets the row through."""
    lift = F.array_contains("lift_concepts", F.col("concept")) & (F.col("d") >= F.coalesce("lift_from", F.col("d"))) & (F.col("d") <= F.coalesce("lift_until", F.col("d")))
    active = blocks.where("is_active").withColumnsRenamed({"pid": "_pid", "org": "_org"})
    return rows.join(active, (F.col("pid") == F.col("_pid")) & (F.col("org") == F.col("_org"))).withColumn("lifted", F.coalesce(lift, F.lit(False)))


def without_blocked_rows(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows that no active block of their patient and organisation hides: one that has no lift for them hides them."""
    hidden = _lifted(rows, blocks).where("NOT lifted").select("seq").distinct()
    return rows.join(hidden, "seq", "left_anti")


def exposures(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows that are seen through a lift, with the first block (by block_id) that lets them through."""
    seen = _lifted(rows, blocks).where("lifted")
    return seen.withColumn("_n", F.row_number().over(Window.partitionBy("seq").orderBy("block_id"))).where("_n = 1").select("seq", "pid", "concept", "block_id")


def intersection(parts: list[DataFrame], key: str = "pid") -> DataFrame:
    """Keys that all parts have; with no part, nobody."""
    if not parts:
        raise ValueError("no predicate: the cohort is empty")
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), parts[1:], parts[0].select(key).distinct())


def latest_each(rows: DataFrame, concept: str, time: str = "ts") -> DataFrame:
    """Each patient's latest row of a concept; ties keep the row that came first."""
    order = Window.partitionBy("pid").orderBy(F.col(time).desc_nulls_last(), "seq")
    return rows.where(F.col("concept") == concept).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def paired_latest(rows: DataFrame, x: str, y: str) -> DataFrame:
    """pid, source, x and y: the latest values of two concepts, where a patient has both."""
    a = latest_each(rows, x).where("value IS NOT NULL").select("pid", "source", F.col("value").alias("x"))
    return a.join(latest_each(rows, y).where("value IS NOT NULL").select("pid", F.col("value").alias("y")), "pid")


def every_nth(rows: DataFrame, order: list[Column], most: int, by: list[str] | None = None) -> DataFrame:
    """A systematic sample of `most` rows or fewer: every stride-th in order (first by a number), within each of `by` if given."""
    number, *then = order
    ranked = numbered(rows.withColumn("_order", number), "_order", by or [], then)
    return ranked.where((F.col("_n") - 1) % F.greatest(F.ceil(F.col("_count") / most), F.lit(1)) == 0).drop("_count", "_n", "_order")


def with_codes(rows: DataFrame, wanted: dict[str, list[str]], key: str = "pid") -> DataFrame:
    """Who has, for every kind of code named (a column), a row with one of its codes: a semi join for each kind."""
    return intersection([rows.where(F.col(kind).isin(codes)).select(key) for kind, codes in wanted.items()], key)


def refers_to(rows: DataFrame, references: str, ids: list[str]) -> DataFrame:
    """Rows of which some reference (array of identifier, reference) is one of the ids, by its identifier or its tail."""
    known = F.array(*map(F.lit, ids))
    tail = lambda r: F.element_at(F.split(r["reference"], "/"), -1)
    return rows.where(F.coalesce(F.exists(references, lambda r: F.coalesce(F.array_contains(known, r["identifier"]), F.lit(False)) | F.coalesce(F.array_contains(known, tail(r)), F.lit(False))), F.lit(False)))


def registry(people: DataFrame, low: float | None = None, high: float | None = None, sex: str | None = None, orgs: list | None = None) -> DataFrame:
    """People (age, sex, org) of an age range, a sex and organisations: None is no limit, an empty list nobody."""
    if low is not None:
        people = people.where(F.col("age") >= low)
    if high is not None:
        people = people.where(F.col("age") <= high)
    if sex is not None:
        people = people.where(F.col("sex") == sex)
    return people if orgs is None else people.where(F.col("org").isin(orgs) if orgs else F.lit(False))


def only_asked(rows: DataFrame, asked: DataFrame, key: str = "pid") -> DataFrame:
    """The rows, each of a patient who was asked for; a row of another is an error when it is read."""
    known = rows.join(asked.select(F.col(key).alias("_asked")).distinct(), F.col(key) == F.col("_asked"), "left")
    stranger = F.raise_error(F.concat(F.lit("a row of a patient who was not asked for: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return known.withColumn(key, F.when(F.col("_asked").isNull(), stranger.cast(rows.schema[key].dataType)).otherwise(F.col(key))).drop("_asked")
