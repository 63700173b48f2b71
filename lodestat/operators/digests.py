"""Quantile digests as values: built in every task, merged in a tree, protected before they leave a source.

A digest is an array of centroids (mean, weight), ordered by mean. The arcsine scale says how large a centroid may be:
from one unit of the scale to the next, so that centroids at the ends are small and those in the middle hold up to some
pi / DELTA of all weight. Rows are never ranked or shuffled: a task keeps BUFFER values of a group at most and hands over
one digest for each group, of DELTA centroids or so. Quantiles are approximate, and so are those of merged digests, in
whichever order they were merged; sums of weights, and the mean, are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the module

#: Units of the scale; values that a task keeps for a group before it packs them; digests that one task merges.
DELTA, BUFFER, FAN_IN = 200, 20_000, 128
DIGEST = "array<struct<mean:double,weight:double>>"


def packed(means: np.ndarray, weights: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of weighted values: neighbours whose middles lie in one unit of the scale are joined."""
    if not len(means):
        return means, weights
    order = np.lexsort((weights, means))
    means, weights = means[order], weights[order]
    shares = (np.cumsum(weights) - weights / 2) / weights.sum()
    unit = np.floor(delta * (np.arcsin(np.clip(2 * shares - 1, -1, 1)) / np.pi + 0.5))
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    joined = np.add.reduceat(weights, first)
    return np.add.reduceat(means * weights, first) / joined, joined


def protected(means: np.ndarray, weights: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours joined until every centroid weighs k at least; a group of fewer values has no centroid at all."""
    cuts, held = [0], 0.0
    for i, weight in enumerate(weights):
        held += weight
        if held >= k:
            cuts.append(i + 1)
            held = 0.0
    if len(cuts) == 1:
        return means[:0], weights[:0]
    starts = np.array(cuts[:-1])  # what is left at the end belongs to the last centroid
    joined = np.add.reduceat(weights, starts)
    return np.add.reduceat(means * weights, starts) / joined, joined


def _told(means: np.ndarray, weights: np.ndarray) -> list[dict]:
    return [{"mean": float(m), "weight": float(w)} for m, w in zip(means, weights)]


def _read(digests: Iterator) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(c["mean"], c["weight"]) for d in digests for c in d]
    both = np.array(pairs, float).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def digests(rows: DataFrame, var: str, by: list[str], k: int = 0, delta: float = DELTA) -> DataFrame:
    """by and `digest` of the variable's values for each group; nulls and NaN are no values. With k, every centroid
    describes k values or more, and groups of fewer than k have an empty digest."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def packed_up(parts: list) -> list:
            return [packed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), delta)]

        for batch in batches:
            for key, mine in batch.groupby(by, dropna=False, sort=False)["_value"] if by else [((), batch["_value"])]:
                values = mine.to_numpy(float)
                key = key if isinstance(key, tuple) else (key,)
                parts = held.setdefault(key, [])
                parts.append((values, np.ones(len(values))))
                if sum(len(p[0]) for p in parts) > BUFFER:
                    held[key] = packed_up(parts)
        out = [(*(None if pd.isna(x) else x for x in key), _told(*packed_up(parts)[0])) for key, parts in held.items()]
        yield pd.DataFrame(out, columns=[*by, "digest"]).astype({"digest": object})

    known = rows.where(F.col(var).isNotNull() & ~F.isnan(F.col(var).cast("double"))).select(*by, F.col(var).cast("double").alias("_value"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*by).schema), f"digest {DIGEST}"])
    return merged(known.mapInPandas(build, kinds), by, k, delta, levels=2)


def merged(parts: DataFrame, by: list[str], k: int = 0, delta: float = DELTA, levels: int = 1) -> DataFrame:
    """One digest for each of `by` from those of its parts, FAN_IN of them at a time, protected at the end."""
    keep = parts.select(*by, "digest")
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.select(*by).schema), f"digest {DIGEST}"])

    def one(last: bool):
        def join(mine: pd.DataFrame) -> pd.DataFrame:
            means, weights = packed(*_read(mine["digest"]), delta)
            if last and k:
                means, weights = protected(means, weights, k)
            return mine[by].iloc[:1].assign(digest=pd.Series([_told(means, weights)], dtype=object, index=mine.index[:1]))

        return join

    for level in range(levels, 0, -1):
        dealt = keep.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN ** (level - 1))))
        keep = dealt.groupBy(*by, "_part").applyInPandas(one(level == 1), kinds)
    return keep


def quantiles(digest: Column, at: list[float]) -> Column:
    """The quantiles of a digest, by straight lines between the middles of its centroids; null for an empty digest."""

    @F.pandas_udf("array<double>")
    def find(column: pd.Series) -> pd.Series:
        out = []
        for held in column:
            means, weights = _read([held if held is not None else []])
            middles = np.cumsum(weights) - weights / 2
            out.append(np.interp(np.array(at) * weights.sum(), middles, means).tolist() if len(means) else None)
        return pd.Series(out, dtype=object)

    return find(digest)


def with_quantiles(frame: DataFrame, at: dict[str, float]) -> DataFrame:
    """Adds n, the weight of the digest, and the named quantiles."""
    found = frame.withColumn("_q", quantiles(F.col("digest"), list(at.values())))
    n = F.aggregate("digest", F.lit(0.0), lambda s, c: s + c["weight"])
    return found.withColumns({"n": n.cast("long")} | {name: F.col("_q")[i] for i, name in enumerate(at)}).drop("_q")
