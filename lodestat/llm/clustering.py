"""Centroid clustering of integer vectors: exact rounds of assignment by a threshold algorithm.

For every dimension there is a list of the centroids sorted by their value in it. For a vector each list is entered at
the vector's own value and walked outward, nearest value first. A centroid that turns up in any list gets its exact
distance. The walk ends when the sum of the squared distances at the frontiers of all lists strictly exceeds the best
exact distance: what has not turned up yet is at least as far as that sum, so neither a nearer centroid nor one as near
is left. Tasks assign the vectors of a batch side by side and hand over one sum of components for each centroid.

Rows are kept if their vector has exactly DIMENSIONS components, none null, NaN or infinite; others, null vectors too,
have no row in the result. Equal distances go to the centroid of the smaller number; centroids without vectors stay as
they are. The first centroids are the kept vectors whose ids hash least; a null id hashes as an empty text, rows of one
id stand in order of their vectors. Fewer vectors than centroids wanted give as many centroids as vectors; an empty
table gives an empty result. Repeated rows are vectors of their own. Other columns are not looked at. A component whose
integer is beyond LARGEST is an error, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: The largest integer of a component: 64 squares of twice as much fit a long.
LARGEST = 1 << 27
#: Vectors that walk their lists side by side.
BATCH = 2000


class Nearest:
    """The nearest of some centroids, by the threshold algorithm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # centroids by dimension, least value first
        self.values = np.take_along_axis(centroids, self.order.T, axis=0).T

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number and squared distance of each vector's nearest centroid, and how many exact distances it took."""
        n, k = len(vectors), len(self.centroids)
        best = np.full(n, np.iinfo(np.int64).max)
        which = np.full(n, k)
        seen = np.zeros((n, k), bool)
        above = np.stack([np.searchsorted(v, x) for v, x in zip(self.values, vectors.T)], 1)  # next to take on either side
        below = above - 1
        active, dims, far = np.arange(n), np.arange(vectors.shape[1]), np.iinfo(np.int64).max // 4
        for _ in range(k):
            x = vectors[active]
            down = np.where(below >= 0, x - self.values[dims, below.clip(min=0)], far)
            up = np.where(above < k, self.values[dims, above.clip(max=k - 1)] - x, far)
            lower = down <= up
            taken = self.order[dims, np.where(lower, below, above)]
            below -= lower
            above += ~lower
            new = np.zeros((len(active), k), bool)
            np.put_along_axis(new, taken, True, axis=1)
            new &= ~seen[active]
            rows, found = np.nonzero(new)  # by row, then by number
            seen[active] |= new
            gaps = x[rows] - self.centroids[found]
            exact = np.einsum("ij,ij->i", gaps, gaps)
            np.minimum.at(best, active[rows], exact)
            nearest = exact == best[active[rows]]
            # a centroid of an earlier step may be as near: the smaller number stays
            least = np.full(n, k)
            np.minimum.at(least, active[rows[nearest]], found[nearest])
            changed = np.unique(active[rows[nearest]])
            held = np.where(which[changed] < k, self._distance(vectors, which, changed), np.iinfo(np.int64).max)
            which[changed] = np.where(held == best[changed], np.minimum(which[changed], least[changed]), least[changed])
            frontier = np.minimum(down, up)
            on = (frontier * frontier).sum(1) <= best[active]
            active, below, above = active[on], below[on], above[on]
            if not len(active):
                break
        return which, best, int(seen.sum())

    def _distance(self, vectors: np.ndarray, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        gaps = vectors[rows] - self.centroids[which[rows].clip(max=len(self.centroids) - 1)]
        return np.einsum("ij,ij->i", gaps, gaps)


def kept_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id and integer components of the rows whose vector is whole. Saved."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = rows.select(F.col(id_column).alias("id"), F.when(F.coalesce((F.size(x) == dimensions) & finite, F.lit(False)), x).alias("x")).where("x IS NOT NULL")
    integer = F.transform("x", lambda c: F.floor(c * scale))
    too_large = F.exists("x", lambda c: F.abs(c * scale) > LARGEST)
    return saved(whole.select("id", F.when(too_large, F.raise_error(F.lit(f"a component is beyond {LARGEST}"))).otherwise(integer).alias("v")))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids hash least."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select("v", hashed.alias("h")).orderBy("h", "v").limit(k).collect()], np.int64)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and squared distance of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = Nearest(shared.value)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                which, best, _ = nearest.of(np.stack(part["v"].to_list()).astype(np.int64))
                yield pd.DataFrame({"id": part["id"], "cluster": which, "distance": best})

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInPandas(find, f"id {kind}, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors, component by component."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = Nearest(shared.value)
        total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                v = np.stack(batch["v"].iloc[at : at + BATCH].to_list()).astype(np.int64)
                which, _, _ = nearest.of(v)
                np.add.at(total, which, v)
                count += np.bincount(which, minlength=len(count))
        yield pd.DataFrame({"cluster": np.arange(len(count)), "n": count, "total": list(total)})

    parts = vectors.select("v").mapInPandas(sums, "cluster int, n long, total array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])))
    out = centroids.copy()
    for row in whole.collect():  # one row for each centroid
        if row.n:
            out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(centroids.shape[1])]
    return out


def fitted(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after all rounds."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def cluster_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """The id, cluster and squared distance of every kept vector, the sums of the distances of its cluster and of all,
    and the hash of its centroid."""
    vectors = kept_vectors(rows, id_column, vector)
    centroids = fitted(vectors, k, rounds, seed)
    if not len(centroids):
        empty = vectors.select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return empty.where("false")
    found = saved(assigned(vectors, centroids))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row for each centroid
    texts = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by_cluster = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return found.select(
        F.col("id").alias(id_column), "cluster", "distance", by_cluster([sums.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), by_cluster(texts).alias("centroid_sha256"),
    )
