"""What the operators of this package share: reading tables, saving intermediate ones, running sums."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestat.sources.folders import shared_folder

#: ASCII white space: a word is a maximal run of other characters.
SPACES = " \t\n\x0b\x0c\r"
#: Sub-groups into which each group of a running sum is dealt; at 10^10 rows the largest holds some 10^7 narrow ones.
SUBGROUPS = 1024
#: Rows that a Python worker gets at once, and their bytes, where the session has not been told otherwise.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def ready(spark: SparkSession) -> None:
    """Makes sure that Python workers can import this package and get few documents at once, as these may be long."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64MB", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(frame: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: later work starts from the files."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def running_offsets(frame: DataFrame, group: list[str], order: list[Column], weight: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows of the same group that stand before this one.

    Rows of a group stand in the order of a hash of `order`, then of `order`. The hash deals each group into
    SUBGROUPS sub-groups, so that a group with a third of all rows is summed by many tasks.
    """
    dealt = frame.withColumns({"_h": F.xxhash64(*order), "_w": weight.cast("long")})
    dealt = dealt.withColumn("_b", F.pmod(F.col("_h"), F.lit(SUBGROUPS)).cast("int"))
    keys = [*group, "_b"]
    sums = dealt.groupBy(*keys).agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for part in same[1:]:
        on = on & part
    return ranked.join(starts, on).withColumn(out, F.col("_start") + F.col("_in")).drop("_h", "_w", "_b", "_in", "_start", *(f"_k{i}" for i in range(len(keys))))


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
