"""A made-up population for trying things out: several sources with patients of their own, and who is blocked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def population(spark: SparkSession, sources: int = 3, patients: int = 2000, seed: int = 0, blocked_fraction: float = 0.02, least: int = 1, most: int = 12, concept: str = "x") -> tuple[DataFrame, DataFrame]:
    """Observations (source, pid, concept, value, d, seq) and verdicts (pid, blocked).

    Everything follows from hashes of the patient and the seed, so reruns and any number of partitions agree. Each
    patient has `least` to `most` weekly observations around a level of their own. Patients of sources are disjoint.
    """
    if not 0 <= blocked_fraction <= 1 or least < 0 or most < least:
        raise ValueError("a fraction from 0 to 1 and least <= most are needed")
    share = lambda salt, *of: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))
    people = spark.range(sources * patients).select(F.col("id"), F.concat(F.lit("s"), F.floor(F.col("id") / patients).cast("string")).alias("source"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("pid"))
    visits = (F.lit(least) + F.floor(share(1, F.col("id")) * (most - least + 1))).cast("int")
    weeks = people.withColumn("visits", visits).where("visits > 0").withColumn("week", F.explode(F.sequence(F.lit(0), F.col("visits") - 1)))
    value = F.round(50 + 20 * (share(2, F.col("id")) - 0.5) + 10 * (share(3, F.col("id"), F.col("week")) - 0.5), 3)
    rows = weeks.select("source", "pid", F.lit(concept).alias("concept"), value.alias("value"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("week") * 7).alias("d"), (F.col("id") * max(most, 1) + F.col("week")).alias("seq"))
    return rows, people.select("pid", (share(4, F.col("id")) < blocked_fraction).alias("blocked"))
