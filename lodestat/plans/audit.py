"""An append-only table of runs: which spec, by whom, and what its sources were told."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators.disclosure import patients_by_source

from .spec import AnalysisSpec

SCHEMA = "spec_hash string, title string, purpose string, actor string, at timestamp, source string, figures long, suppressed long, patients long, patients_suppressed boolean"

READS = "actor string, what string, purpose string, n_rows long, at timestamp"


def record_run(result: DataFrame, spec: AnalysisSpec, actor: str, path: str, at: datetime.datetime, rows: DataFrame | None = None, k: int = 5) -> None:
    """Appends a row for each source of a result: how many figures it has, how many of them are hidden, and, where the
    rows that it was made from are given, how many patients they have, hidden where these are fewer than k."""
    told = result.groupBy("source").agg(F.count("*").alias("figures"), F.count_if("suppressed").alias("suppressed"))
    if rows is not None:
        people = patients_by_source(rows, k).select("source", F.col("n").alias("patients"), F.col("suppressed").alias("patients_suppressed"))
        told = told.join(people, "source", "left")
    else:
        told = told.withColumns({"patients": F.lit(None).cast("long"), "patients_suppressed": F.lit(None).cast("boolean")})
    said = {"spec_hash": spec.digest(), "title": spec.title, "purpose": spec.purpose, "actor": actor}
    told = told.select(*(F.lit(v).alias(c) for c, v in said.items()), F.lit(at).cast("timestamp").alias("at"), "source", "figures", "suppressed", "patients", "patients_suppressed")
    told.write.mode("append").parquet(path)


def record_read(path: str, spark: SparkSession, actor: str, what: str, purpose: str, n_rows: int, at: datetime.datetime) -> None:
    """Appends who has read what, for which purpose, and how many rows came back."""
    spark.createDataFrame([(actor, what, purpose, n_rows, at)], READS).write.mode("append").parquet(path)


def runs_of(spark: SparkSession, path: str, spec: AnalysisSpec) -> DataFrame:
    """The rows of a spec's runs, newest first; the filter reaches the scan."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("spec_hash") == spec.digest()).orderBy(F.desc("at"), "source")
