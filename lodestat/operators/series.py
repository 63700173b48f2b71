"""Series cut down to a number of points that keep their shape, without holding a series in one task."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the module

#: Points of a bucket in one batch that go on as they are, as finding their hull takes longer than it saves.
FEW = 32


def hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the corners of the convex hull of points in order of x, and of the first of those at either end."""
    out = {0, int(np.searchsorted(x, x[-1]))}
    order = np.lexsort((np.arange(len(x)), y, x)).tolist()  # of equal points the first
    for way in (1, -1):
        corners: list[int] = []
        for i in order if way == 1 else order[::-1]:
            while len(corners) > 1:
                a, b = corners[-2], corners[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                corners.pop()
            corners.append(i)
        out.update(corners)
    return sorted(out)


def _groups(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    """A number for each row's group; nulls are values of theirs."""
    return frame.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(frame), int)


def _corners(by: list[str]):
    """A function over batches that leaves, of each bucket of each series, the corners of its points; the first of these
    has the number of the points (n) and their sums (sx, sy)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            group = _groups(batch, [*by, "_bucket"])
            order = np.lexsort((batch["_n"].to_numpy(), group))
            batch, group = batch.iloc[order], group[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            x, y = batch["_x"].to_numpy(float), batch["value"].to_numpy(float)
            n, sx, sy, keep = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x)), np.ones(len(x), bool)
            n[starts], sy[starts] = sizes, np.add.reduceat(y, starts)
            sx[starts] = np.add.reduceat(x - np.repeat(x[starts], sizes), starts) + sizes * x[starts]
            for i in np.flatnonzero(sizes > FEW):
                at = slice(starts[i], starts[i] + sizes[i])
                keep[at] = False
                keep[starts[i] + np.array(hull(x[at], y[at]))] = True
            yield batch.assign(n=n, sx=sx, sy=sy)[keep]

    return find


def _walks(by: list[str]):
    """A function over batches in order of series, bucket and place that leaves the points that each series keeps."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        group, bucket = _groups(rows, by), rows["_bucket"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1])])
        x, y = rows["_x"].to_numpy(float), rows["value"].to_numpy(float)
        n, sx, sy = (np.add.reduceat(rows[c].to_numpy(), starts) for c in ("n", "sx", "sy"))
        my, ends, owner, kept = sy / n, np.r_[starts[1:], len(rows)], group[starts], []
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for first, after in zip(heads.tolist(), [*heads[1:].tolist(), len(starts)]):
            at = int(starts[first])
            base, ax, ay = x[at], 0.0, y[at]
            mx = sx[first:after] / n[first:after] - base
            kept.append(at)
            for i in range(first + 1, after - 1):
                low, high = starts[i], ends[i]
                ux, uy = mx[i + 1 - first], my[i + 1]
                at = int(low + np.argmax(np.abs((ax - ux) * (y[low:high] - ay) - (ax - (x[low:high] - base)) * (uy - ay))))  # of equal ones the first
                ax, ay = x[at] - base, y[at]
                kept.append(at)
            kept.append(int(starts[after - 1]))
        return rows.iloc[kept][[*by, "seq", "_x", "value"]]

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of one series
        for batch in batches:
            if not len(batch):
                continue
            group = _groups(batch, by)
            others = np.flatnonzero(group != group[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if not cut and held and _groups(pd.concat([held[-1].tail(1), batch.head(1)]), by)[1]:
                yield walk(pd.concat(held))
                held = []
            if cut:
                yield walk(pd.concat([*held, batch.iloc[:cut]]))
                held = []
            held.append(batch.iloc[cut:])
        if held:
            yield walk(pd.concat(held))

    return walks


def downsample(rows: DataFrame, points: int, by: list[str]) -> DataFrame:
    """Largest-triangle-three-buckets of each series (columns seq, ts, value): `points` rows that keep its shape.

    A bucket keeps the point that makes the largest triangle with the point kept before and the mean of the bucket after.
    That area is the size of a linear function of the point, so it is largest at a corner of the convex hull of the
    bucket's points. Tasks find sums and corners of the stretches of buckets that they have (FEW points go on as they
    are). Only these, some for each bucket, go through a series in order; a task takes many series one after another. Rows without a time or a value are left
    out; a series of no more than `points` rows stays as it is, and so do all if `points` is below 3.
    """
    known = rows.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    known = known.select(*by, "seq", "ts", F.col("value").cast("double").alias("value"))
    if points < 3:
        return known
    placed = numbered(known.withColumn("_x", F.unix_micros(F.col("ts").cast("timestamp")).cast("double")), "_x", by, [F.col("seq")])
    whole = placed.where(F.col("_count") <= points).select(*known.columns)
    size = (F.col("_count") - 2).cast("double") / (points - 2)
    first = lambda j: 1 + F.floor(j * size)  # noqa: E731  the place of a bucket's first row, counted from 0
    place = F.col("_n") - 1
    guess = F.floor((place - 1) / size)
    bucket = F.when(place < first(guess), guess - 1).when(place >= first(guess + 1), guess + 1).otherwise(guess)
    dealt = placed.where(F.col("_count") > points).withColumn("_bucket", F.when(place == 0, -1).when(place == F.col("_count") - 1, points - 2).otherwise(bucket).cast("int"))
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in known.select(*by).schema)
    seq = known.schema["seq"].dataType.simpleString()
    parts = dealt.select(*by, "seq", "value", "_x", "_n", "_bucket").mapInPandas(_corners(by), f"{keys}seq {seq}, value double, _x double, _n bigint, _bucket int, n bigint, sx double, sy double")
    series = parts.repartition(*by) if by else parts.repartition(1)
    cut = series.sortWithinPartitions(*by, "_bucket", "_n").mapInPandas(_walks(by), f"{keys}seq {seq}, _x double, value double")
    return cut.select(*by, "seq", F.timestamp_micros(F.col("_x").cast("bigint")).cast(known.schema["ts"].dataType).alias("ts"), "value").unionByName(whole)
