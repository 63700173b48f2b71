"""Kept cohorts, pinned lists of patients, and names for concepts."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that are sent to every task at most (some 10 MB); more are joined by a shuffle.
MAX_NAMES = 100_000
COHORT = "cohort string, owner string, predicates string, at timestamp, pid string"


def pinned(people: DataFrame, ids: Iterable[str], key: str = "pid") -> DataFrame:
    """The people of a stated list; an error names those that are not known, as unresolved is not the same as empty."""
    wanted = sorted(set(ids))
    named = people.sparkSession.createDataFrame([(i,) for i in wanted], f"{key} string")
    unknown = [r[0] for r in named.join(people.select(key), key, "left_anti").collect()]  # of a stated list
    if unknown:
        raise LookupError("unknown: " + ", ".join(sorted(unknown)[:20]))
    return people.join(named, key, "left_semi")


def keep_cohort(members: DataFrame, path: str, cohort: str, owner: str, predicates: str, at: datetime.datetime, key: str = "pid") -> None:
    """Appends a cohort with its members, each once."""
    said = {"cohort": cohort, "owner": owner, "predicates": predicates}
    rows = members.select(F.col(key).alias("pid")).distinct()
    rows.select(*(F.lit(v).alias(k) for k, v in said.items()), F.lit(at).cast("timestamp").alias("at"), "pid").write.mode("append").parquet(path)


def cohorts_of(spark: SparkSession, path: str, owner: str, most: int = 200) -> DataFrame:
    """An owner's newest cohorts and their sizes."""
    rows = spark.read.schema(COHORT).parquet(path).where(F.col("owner") == owner)
    return rows.groupBy("cohort", "predicates", "at").agg(F.count("*").alias("n")).orderBy(F.desc("at"), "cohort").limit(most)


def members_of(spark: SparkSession, path: str, cohort: str, verdicts: DataFrame | None = None, consents: DataFrame | None = None) -> DataFrame:
    """Who is in a kept cohort now: blocks and consent are asked again at each reading, and no verdict excludes."""
    from .frame import consenting, not_blocked

    people = spark.read.schema(COHORT).parquet(path).where(F.col("cohort") == cohort).select("pid").distinct()
    people = people if verdicts is None else not_blocked(people, verdicts)
    return people if consents is None else consenting(people, consents)[0]


def with_displays(rows: DataFrame, names: DataFrame, code: str = "concept", display: str = "display") -> DataFrame:
    """Adds a name to each row: its own where it has one, else that of the table of names (code, display), else the code."""
    known = names.select(F.col(code).alias("_code"), F.col(display).alias("_display")).groupBy("_code").agg(F.min("_display").alias("_display"))
    known = F.broadcast(known) if names.limit(MAX_NAMES + 1).count() <= MAX_NAMES else known
    own = [F.col(display)] if display in rows.columns else []
    return rows.join(known, F.col(code) == F.col("_code"), "left").withColumn(display, F.coalesce(*own, "_display", F.col(code).cast("string"))).drop("_code", "_display")


def search(parts: dict[str, DataFrame], equal: dict[str, object]) -> DataFrame:
    """The rows of several sources, tagged, whose columns have these values; the filters reach each scan."""
    from lodestat.sources.observations import union_tagged

    found = union_tagged(parts)
    for name, value in equal.items():
        found = found.where(F.col(name) == F.lit(value))
    return found
