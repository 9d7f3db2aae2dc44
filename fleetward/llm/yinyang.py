"""Centroid clustering with Yinyang bounds, in whole numbers.

The centroids are put into groups once, by how near they stand to each other. A vector keeps
an upper bound of the distance to its own centroid and one lower bound for each group, of the
distance to the nearest centroid of the group that is not its own. When the centroids move,
bounds give way by how far they moved. A vector whose upper bound is below all lower bounds
stays (global filter); otherwise its own distance is measured, and only the groups whose
bound it still reaches are scanned, centroid by centroid. Distances are exact squares of
whole numbers and bounds give a margin for rounding, so the clusters are those of a full scan.

Vectors and bounds are written between rounds; a round is one pass of narrow tasks, and the
sums of a cluster are sums that Spark aggregates. The driver holds centroids only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from fleetward.llm.common import new_path, remove, written

K = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
#: Components up to here have sums and squared distances that fit 64 bits.
LARGEST = 1 << 27
#: Rows worked on at a time.
ROWS = 4096


def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of dims components, none of them null or non-finite, as whole numbers floor(scale * x)."""
    e = F.col("embedding")
    # get() and not e[0]: a filter that Spark moves must not fail on short vectors.
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    too_large = F.exists(e, lambda x: F.abs(x.cast("double")) * scale >= LARGEST)
    checked = F.when(too_large, F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}: its distances do not fit 64 bits"))).otherwise(whole)
    return vectors.select("vec_id", "embedding").where(e.isNotNull() & (F.size(e) == dims) & finite).select("vec_id", checked.cast("array<long>").alias("v"))


def seeds(rows: DataFrame, k: int, run: int = 1) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in their order (fewer if there are fewer): a bounded top list."""
    order = F.sha2(F.concat(F.lit(f"{run}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(order, "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each centroid, by a few rounds of k-means over the centroids alone."""
    t = min(groups, len(centroids))
    c = centroids.astype(np.float64)
    middle = c[:t].copy()
    of = np.zeros(len(c), dtype=np.int64)
    for _ in range(rounds):
        of = ((c[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(t):
            if (of == g).any():
                middle[g] = c[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a and b."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Assigns rows to centroids, by bounds of the round before where there are any."""

    def __init__(self, centroids: np.ndarray, of: np.ndarray, moved: np.ndarray | None) -> None:
        self.c, self.of, self.t = centroids, of, int(of.max(initial=-1)) + 1
        self.moved = np.zeros(len(centroids)) if moved is None else moved
        self.drift = np.array([self.moved[of == g].max() for g in range(self.t)])
        self.fresh = moved is None
        self.scanned = self.stayed = 0

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, exact squared distance and lower bounds (rows x groups) of each row."""
        if self.fresh:
            return self._full(v)
        lower = np.maximum(lower - self.drift, 0)
        upper = upper + self.moved[own]
        own, best = own.copy(), _apart(v, self.c[own])
        # Global filter: the moved bound first, then the distance itself.
        open_ = np.flatnonzero(self._reaches(upper, lower.min(axis=1)))
        open_ = open_[self._reaches(np.sqrt(best[open_].astype(np.float64)), lower[open_].min(axis=1))]
        self.stayed += len(v) - len(open_)
        was, was_best = own[open_].copy(), best[open_].copy()
        near = np.full((len(open_), self.t), np.nan)
        second = near.copy()
        for g in range(self.t):
            at = np.flatnonzero(self._reaches(np.sqrt(best[open_].astype(np.float64)), lower[open_, g]))
            rows = open_[at]
            members = np.flatnonzero(self.of == g)
            self.scanned += len(rows) * len(members)
            near[at, g] = second[at, g] = np.inf
            for j in members:
                d = _apart(v[rows], np.broadcast_to(self.c[j], v[rows].shape))
                x = np.sqrt(d.astype(np.float64))
                second[at, g] = np.minimum(second[at, g], np.maximum(near[at, g], x))
                near[at, g] = np.minimum(near[at, g], x)
                wins = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
                own[rows] = np.where(wins, j, own[rows])
                best[rows] = np.where(wins, d, best[rows])
        # A bound is of the group's centroids but the row's own: where that is in the group, it is the nearest and the second counts.
        found = np.where(np.arange(self.t) == self.of[own[open_]][:, None], second, near)
        lower[open_] = np.where(np.isnan(near), lower[open_], found)
        # A centroid that was left is one of the others from now on, its group scanned or not.
        changed = own[open_] != was
        left, group = open_[changed], self.of[was[changed]]
        lower[left, group] = np.minimum(lower[left, group], np.sqrt(was_best[changed].astype(np.float64)))
        return own, best, lower

    def _full(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.stack([_apart(v, np.broadcast_to(c, v.shape)) for c in self.c], axis=1)
        own = d.argmin(axis=1)
        best = d[np.arange(len(v)), own]
        self.scanned += d.size
        far = np.sqrt(d.astype(np.float64))
        far[np.arange(len(v)), own] = np.inf
        lower = np.stack([far[:, self.of == g].min(axis=1) for g in range(self.t)], axis=1)
        return own, best, lower

    @staticmethod
    def _reaches(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Whether a centroid at the lower bound could be as near: rounding errors count as near."""
        return ~(lower > upper * (1 + 1e-9) + 1e-6)


def _round(centroids: np.ndarray, of: np.ndarray, moved: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                column = b.column("v")
                v = column.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                bounds = Bounds(centroids, of, moved)
                if moved is None:
                    own, best, lower = bounds.assign(v, np.empty(0, int), np.empty(0), np.empty((0, 0)))
                else:
                    distance = b.column("distance").to_numpy(zero_copy_only=False)
                    lower = b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    own, best, lower = bounds.assign(v, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), np.sqrt(distance.astype(np.float64)), lower.copy())
                cuts = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * lower.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), column, pa.array(own.astype(np.int32)), pa.array(best.astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(lower.reshape(-1)))],
                    names=["vec_id", "v", "cluster", "distance", "lower"],
                )

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The clusters' exact floor(sum / count); an empty cluster's centroid stays. One row a cluster."""
    n = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("v")[j]) for j in range(n))).alias("s")).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, groups: int | None = None) -> DataFrame:
    """One row for each vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors: vec_id, embedding. Vectors that are null, of another length or with a component that is null, NaN or
    infinite are left out; fewer than k vectors make fewer clusters; none make no rows. Repeated rows count each;
    seeds with equal ids follow by their components, null ids count as empty text. Ties go to the smaller number.
    A component whose whole number is 2^27 or more raises an error, since distances would not fit 64 bits. Other
    columns are left out. groups: of centroids, a quarter as many unless given.
    """
    spark = vectors.sparkSession
    path = new_path(spark, "yinyang-vectors")
    state = written(kept(vectors, dims, scale), path)
    centroids = seeds(state, k)
    id_type = vectors.schema["vec_id"].dataType
    if not len(centroids):
        return state.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    of = grouped(centroids, groups or max(1, len(centroids) // 4))
    schema = StructType([StructField("vec_id", id_type), StructField("v", ArrayType(LongType())), StructField("cluster", IntegerType()), StructField("distance", LongType()), StructField("lower", ArrayType(DoubleType()))])
    moved = None
    for r in range(rounds + 1):
        old, path = path, new_path(spark, "yinyang-state")
        state = written(state.mapInArrow(_round(centroids, of, moved), schema), path)
        remove(spark, old)
        if r < rounds:
            new = _means(state, centroids)
            moved = np.sqrt(_apart(new, centroids).astype(np.float64)) * (1 + 1e-12)
            centroids = new
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    return state.select("vec_id", "cluster", "distance", *_digests(centroids, sums))


def _digests(centroids: np.ndarray, sums: dict[int, int]) -> list[Column]:
    """Each cluster's sum, the sum of all and the digest of its centroid: one entry a centroid."""
    at = F.col("cluster") + 1
    own = F.array(*(F.lit(int(sums.get(j, 0))).cast("long") for j in range(len(centroids))))
    sha = F.array(*(F.lit(sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids))
    return [F.element_at(own, at).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.element_at(sha, at).alias("centroid_sha256")]


def oracle_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same by full scans in DuckDB's SQL."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) <= {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.r, c{n}.c, CAST(list_sum(list_transform(list_zip(v.v, c{n}.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{n}) GROUP BY r)"""
        )
        if n < rounds:
            parts.append(f"u{n} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT a{n}.c, unnest(v.v) AS x, unnest(range({dims})) AS j FROM a{n} JOIN v USING (r)) GROUP BY c, j)")
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(w.m, c{n}.m) AS m FROM c{n} LEFT JOIN (
  SELECT c, list(CAST(CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END AS BIGINT) ORDER BY j) AS m FROM u{n} GROUP BY c) w USING (c))"""
            )
    steps = ",\n".join(parts)
    return f"""WITH {steps}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} m ON m.c = a.c
"""
