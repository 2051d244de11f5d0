"""Centroid clustering with Elkan's bounds, exact in whole numbers.

Each vector keeps an upper bound of its distance to its own centroid and a lower
bound of its distance to every centroid.  When centroids move, bounds move by as
much; with the distances between centroids they show for most centroids that
they are farther away than the own one, and only the rest are computed.  Bounds
are rounded outward and a centroid is left out only if it is strictly farther,
so ties go to the smaller number as without bounds.  Distances that are computed
are squares in whole numbers.

The vectors and their bounds are a table that each round reads and writes anew in
the shared folder, batch by batch in Arrow workers, so a round can be done again
from there.  Of all vectors only sums leave a task: one row for each centroid.
The centroids, ``k`` rows, are all that the driver holds.

Defined results: vectors of another length, or with a null or non-finite
component, or with one beyond ``TOP`` after scaling (distances would not fit into
a long), are left out.  Each row is a vector of its own, also where ids repeat;
a null id is hashed last.  With fewer than ``k`` vectors each begins a centroid.
An empty table gives no rows.  Further columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inventra.llm.tables import dropped, stored

SCALE, TOP = 256, 1 << 27
STATE = "vec_id long, x array<int>, cluster int, upper float, lower array<float>"
#: Vectors that are compared at once.
ROWS = 4096


def whole(df: DataFrame, size: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x: the vectors that are kept, as whole numbers."""
    x = F.transform(F.col(embedding), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(float(SCALE)) * c.cast("double")) < TOP)
    fit = df.where((F.size(embedding) == size) & F.forall(F.col(embedding), good))
    return fit.select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<int>").alias("x"))


def begun(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose salted ids have the least hashes, in their order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _above(a: np.ndarray) -> np.ndarray:
    return np.nextafter(a.astype(np.float32), np.float32(np.inf))


def _below(a: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(a.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Round:
    """What all vectors of a round need to know of the centroids."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        d = centroids[:, None, :] - centroids[None, :, :]
        apart = np.sqrt((d * d).sum(-1))
        self.half = _below(apart / 2)
        other = self.half + np.where(np.eye(len(centroids), dtype=bool), np.float32(np.inf), np.float32(0))
        self.nearest = other.min(1) if len(centroids) > 1 else np.full(len(centroids), np.inf, np.float32)
        self.moved = None if before is None else _above(np.sqrt(((centroids - before) ** 2).sum(-1)))

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New centroids and bounds, and how many distances were computed."""
        if self.moved is not None:
            upper = _above(upper.astype(np.float64) + self.moved[own])
            lower = _below(lower.astype(np.float64) - self.moved)
        own, upper, lower, done = own.copy(), upper.copy(), lower.copy(), 0
        # Unless all others are farther from its centroid than twice its distance.
        at = np.flatnonzero(self.nearest[own] <= upper)
        exact = np.zeros(len(x), np.int64)
        known = np.zeros(len(x), bool)
        for c in range(len(self.centroids)):
            near = at[(own[at] != c) & (lower[at, c] <= upper[at]) & (self.half[own[at], c] <= upper[at])]
            if not len(near):
                continue
            # The own distance first: it may settle the rest.
            loose = near[~known[near]]
            if len(loose):
                exact[loose] = _squares(x[loose], self.centroids[own[loose]])
                known[loose] = True
                root = np.sqrt(exact[loose])
                upper[loose], lower[loose, own[loose]] = _above(root), _below(root)
                done += len(loose)
                near = near[(lower[near, c] <= upper[near]) & (self.half[own[near], c] <= upper[near])]
            found = _squares(x[near], self.centroids[c])
            lower[near, c] = _below(np.sqrt(found))
            done += len(near)
            better = (found < exact[near]) | ((found == exact[near]) & (c < own[near]))
            won = near[better]
            own[won], exact[won], upper[won] = c, found[better], _above(np.sqrt(found[better]))
        return own, upper, lower, done


def _columns(batch: pa.RecordBatch, dim: int, k: int, fresh: bool) -> tuple:
    x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
    if fresh:
        n = len(x)
        return x, np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
    lower = batch["lower"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return x, batch["cluster"].to_numpy(), batch["upper"].to_numpy(), lower


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1] or 1, dtype=np.int32)[: len(a) + 1]), pa.array(a.ravel()))


def _assigned(state: DataFrame, now: Round, dim: int, fresh: bool) -> DataFrame:
    k = len(now.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(a, ROWS)
                own, upper, lower, _ = now.assign(*_columns(batch, dim, k, fresh))
                arrays = [batch["vec_id"], batch["x"], pa.array(own, pa.int32()), pa.array(upper), _lists(lower)]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "x", "cluster", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors is the floor of their exact mean."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), batch["cluster"].to_numpy()
            order = np.argsort(own, kind="stable")
            held, first = np.unique(own[order], return_index=True)
            sums[held] += np.add.reduceat(x[order].astype(np.int64), first)
            n += np.bincount(own, minlength=k)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), _lists(sums[full])], names=["cluster", "n", "sums"])

    part = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, sums array<long>")
    # Sums over many tasks may pass a long; a decimal holds them.
    rows = part.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.i] = int(r.s) // r.n
    return out


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, salt: str = "2:", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared, to the final centroid), cluster_inertia,
    inertia, centroid (its components as decimal integers joined by commas)."""
    spark = df.sparkSession
    state = stored(whole(df, size, vec_id, embedding))
    centroids, before = begun(state, k, salt), None
    if not len(centroids):
        dropped(state)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid string")
    for step in range(rounds + 1):
        new = stored(_assigned(state, Round(centroids, before), size, step == 0))
        dropped(state)
        state = new
        if step < rounds:
            before, centroids = centroids, _moved(state, centroids)
    done = stored(_measured(state, centroids))
    dropped(state)
    held = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in held)
    rows = [(r.cluster, r.cluster_inertia, total, ",".join(map(str, centroids[r.cluster].tolist()))) for r in held]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string")
    # One row for each of the k centroids.
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array(_squares(x, centroids[batch["cluster"].to_numpy()]))], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "cluster", "x").mapInArrow(run, "vec_id long, cluster int, distance long")
