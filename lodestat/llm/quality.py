"""Quality rules with host verdicts.

Every document is held against the base rules; failures are summed by host (any label column), each host's failure
rate is shrunk towards all hosts by a beta prior fitted to the hosts themselves, and hosts whose shrunken rate is
above a limit lose all their documents.

Nulls: a null text has no words and fails; a null host is a host of its own. Empty tables give empty results.
Repeated rows count as often as they stand there. Very long texts are read whole, each by one task. Other columns pass through; names of new columns are parameters
of none, so a clashing column of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, saved

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: A host goes when its shrunken failure rate is above this: only hosts that are junk nearly throughout.
MAX_HOST_RATE = 0.9
#: Rejected hosts that are broadcast at most (some 10 MB); more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Documents that the prior may weigh at most.
MAX_PRIOR = 1e6


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    v = len(ids)
    _, keys = np.unique(w[:-2] * v + w[1:-1], return_inverse=True)
    _, at, count = np.unique(keys * v + w[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def metrics_of(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in METRICS]))
def text_metrics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([metrics_of(x) for x in texts], columns=METRICS)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the metrics and base_failed."""
    out = docs.withColumn("_m", text_metrics(F.col(text)))
    out = out.withColumns({c: F.col(f"_m.{c}") for c in METRICS}).drop("_m")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """A row for each host: n_docs, n_failed and host_rate, shrunk by a beta prior.

    The prior has the mean of all documents and, by moments, the spread of the hosts' own rates (weighted by
    documents) without what chance alone spreads them. Hosts that do not differ get a strong prior, MAX_PRIOR documents
    at most.
    """
    hosts = saved(judged.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")))
    mean = F.sum("n_failed") / F.sum("n_docs")
    chance = mean * (1 - mean) * F.count("*") / F.sum("n_docs")
    whole = hosts.agg(mean.alias("mean"), (F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")) / F.sum("n_docs") - mean * mean - chance).alias("spread")).first()
    rate, spread = whole["mean"] or 0.0, whole["spread"] or 0.0
    weight = min(MAX_PRIOR, max(1.0, rate * (1 - rate) / spread - 1)) if spread > 1e-12 else MAX_PRIOR
    return hosts.withColumn("host_rate", (F.col("n_failed") + F.lit(rate * weight)) / (F.col("n_docs") + F.lit(weight)))


def _to_hosts(frame: DataFrame, hosts: DataFrame, host: str, how: str) -> DataFrame:
    """Joins host rows to documents: by broadcast when there are few, else by a shuffle."""
    right = hosts.withColumnRenamed(host, "_host")
    right = F.broadcast(right) if right.count() <= BROADCAST_HOSTS else right
    return frame.join(right, F.col(host).eqNullSafe(F.col("_host")), how).drop("_host")


def quality_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """A row for each document: its id, host, metrics, base_failed, host_rate and kept."""
    judged = saved(base_rules(docs.select(F.col(id_column), F.col(text).alias("_text"), F.col(host)), "_text").drop("_text"))
    rates = saved(host_rates(judged, host)).select(host, "host_rate")
    return _to_hosts(judged, rates, host, "inner").withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The texts are held against the rules twice: for the hosts' rates, of which only the rejected hosts are kept, and for
    the documents themselves. That takes less than to write and read the texts in between.
    """
    judged = base_rules(docs.select(F.col(text).alias("_text"), F.col(host).alias("_of")), "_text").select("_of", "base_failed")
    rejected = saved(host_rates(judged, "_of").where(F.col("host_rate") > max_host_rate).select("_of"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    passed = base_rules(docs.select(row, F.col(text).alias("_text"), F.col(host).alias("_of")), "_text").where(~F.col("base_failed"))
    return _to_hosts(passed, rejected, "_of", "left_anti").select("_row.*")
