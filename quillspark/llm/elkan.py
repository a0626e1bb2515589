"""Operator 11: centroid clustering with Elkan's bounds, in exact integers.

Vectors become integers floor(SCALE * x). Each round assigns every vector to the nearest centroid (squared Euclidean
distance, ties to the smaller number) and replaces every non-empty centroid by the componentwise floor of its
vectors' mean. With each vector an upper bound of the distance to its own centroid and a lower bound of that to each
centroid are kept from round to round. After an update they are widened by how far the centroids moved. A distance
is computed only if neither a lower bound nor half the distance between two centroids shows the other centroid to
be strictly farther; so a tie is always computed. Bounds are rounded outwards (SLACK, then to single precision), so
rounding never skips a centroid that is as near. Distances themselves are integers.

Plan: a round is one map over the vectors beside their bounds, written to the shared folder, and one aggregation of
``k`` rows of sums with map-side combine. The centroids, k x dims numbers, and the k rows of sums are
all that passes the driver; they do not grow with the data. No shuffle moves a vector.

Range: components are held within +-LIMIT after scaling (|x| below 2**19 with SCALE 256), so that a squared distance fits
a long; farther ones count as that bound. Sums of distances that do not fit a long are given as its largest value.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out. With fewer vectors
than ``k`` there are as many centroids as vectors, with none no rows. Rows without an id come last in the choice of first
centroids; repeated rows are vectors of their own, also in that choice, where equal hashes go by components. Empty centroids stay.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import arrow, table

K, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
LIMIT = (1 << 27) - 1
#: Outward rounding of every step of double-precision arithmetic on bounds; a step's own error is below 2**-52.
SLACK = 2.0**-48
STATE = "vec_id long, v array<int>, cluster int, upper float, lower array<float>"


def _up(x):
    return x * (1 + SLACK)


def _down(x):
    return x * (1 - SLACK)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def _single(x: np.ndarray, towards: float) -> np.ndarray:
    """x in single precision, rounded towards +-infinity."""
    return np.nextafter(x.astype(np.float32), np.float32(towards))


class Step:
    """Assignment of one round, given the centroids now and before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        self.c = centroids
        self.half = _down(np.sqrt(np.array([_distances(np.broadcast_to(centroids[j], centroids.shape), centroids) for j in range(k)], float).reshape(k, k))) / 2
        self.moved = np.zeros(k) if before is None else _up(np.sqrt(_distances(centroids, before).astype(float)))
        apart = self.half + np.diag(np.full(k, np.inf))
        self.near = apart.min(1) if k > 1 else np.full(k, np.inf)
        self.computed = 0

    def __call__(self, v, a, upper, lower):
        """New (cluster, upper, lower) in double precision; upper infinite where nothing is known."""
        a, rows = a.astype(np.int64), np.arange(len(v))
        upper = _up(upper.astype(float) + self.moved[a])
        lower = _down(np.maximum(0, lower.astype(float) - self.moved))
        act = np.flatnonzero(~(upper < self.near[a]))  # the others have every other centroid strictly farther
        if not len(act):
            return a, upper, lower
        x, own, low = v[act], a[act], lower[act]
        best = _distances(x, self.c[own])
        self.computed += len(act)
        top = _up(np.sqrt(best.astype(float)))
        low[rows[: len(act)], own] = _down(np.sqrt(best.astype(float)))
        for j in range(len(self.c)):
            at = np.flatnonzero((own != j) & (low[:, j] <= top) & (self.half[own, j] <= top))
            if not len(at):
                continue
            d = _distances(x[at], self.c[j])
            self.computed += len(at)
            root = np.sqrt(d.astype(float))
            low[at, j] = _down(root)
            nearer = (d < best[at]) | (d == best[at]) & (j < own[at])
            won = at[nearer]
            best[won], own[won], top[won] = d[nearer], j, _up(root[nearer])
        a[act], upper[act], lower[act] = own, top, low
        return a, upper, lower


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _rows(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _round(step: Step, dims: int):
    k = len(step.c)

    def run(batches):
        for b in batches:
            v = _matrix(b.column(1), dims, np.int32)
            if b.num_columns == 2:
                a, upper, lower = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros((len(v), k))
            else:
                a, upper, lower = b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4), k, np.float32)
            a, upper, lower = step(v, a, upper, lower)
            lower = np.maximum(0, _single(lower, -np.inf))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(a.astype(np.int32)), pa.array(_single(upper, np.inf), pa.float32()), _rows(lower, pa.float32())], names=[x.split()[0] for x in STATE.split(", ")])

    return run


def _final(step: Step, dims: int):
    first = _round(step, dims)

    def run(batches):
        for b in first(batches):
            a = b.column(2).to_numpy()
            d = _distances(_matrix(b.column(1), dims, np.int32), step.c[a])
            yield pa.record_batch([b.column(0), b.column(2), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as integers."""
    one = lambda x: x.cast("double")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(one(x)) & (F.abs(one(x)) != float("inf")))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * one(x)))).cast("int")
    return vectors.where((F.size("embedding") == dims) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def first_centroids(ints: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in ints.select("v", h.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()], np.int64)


def _updated(state: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]
    new = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # at most k rows
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return new


def _total(c: Column) -> Column:
    return F.least(F.sum(c.cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: cluster, squared distance, the sums of distances, digest of the centroid."""
    spark = vectors.sparkSession
    ints = table(integers(vectors, dims, scale), "elkan-integers")
    centroids, before, state = first_centroids(ints, k, seed), None, ints
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        state = table(arrow(state, _round(Step(centroids, before), dims), STATE), "elkan-state")
        before, centroids = centroids, _updated(state, centroids, dims)
    out = table(arrow(state, _final(Step(centroids, before), dims), "vec_id long, cluster int, distance long"), "elkan-distances")
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    each = out.groupBy("cluster").agg(_total(F.col("distance")).alias("cluster_inertia"))
    few = each.crossJoin(F.broadcast(out.agg(_total(F.col("distance")).alias("inertia")))).join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return out.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """The same clustering by all distances, in DuckDB."""
    d = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v, sha256('2:' || CAST(vec_id AS VARCHAR)) h FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 j, v c FROM (SELECT * FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) vec_id, any_value(v) v, min(struct_pack(d := {d}, j := j)) b FROM (SELECT row_number() OVER () rid, vec_id, v FROM v) CROSS JOIN c{r} GROUP BY rid)")
        if r < rounds:
            parts.append(
                f"s{r} AS (SELECT j, i, CAST(floor_div(sum(x), count(*)) AS BIGINT) x FROM (SELECT b.j j, unnest(v) x, unnest(range(1, 65)) i FROM a{r}) GROUP BY j, i),"
                f" c{r + 1} AS MATERIALIZED (SELECT j, coalesce(n, c) c FROM c{r} LEFT JOIN (SELECT j, list(x ORDER BY i) n FROM s{r} GROUP BY j) USING (j))".replace("floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)")
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(b.j AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.j) AS BIGINT) cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) inertia, sha256(array_to_string(c, ',')) centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = b.j"""
