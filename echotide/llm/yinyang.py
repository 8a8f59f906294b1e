"""Centroid clustering in whole numbers, by Lloyd's rounds with Yinyang bounds.

Vectors become whole numbers, floor(scale * x); centroids are whole-numbered means, rounded down. All squared distances are exact, so results
don't depend on how rows are dealt, and ties go to the smaller number. Centroids are clustered into groups once. Each
vector carries an upper bound on the distance to its centroid and a lower bound per group on the distance to the group's
other centroids; after a round, bounds move by how far centroids moved. A vector whose upper bound is below all lower
bounds keeps its centroid without any distance; one that isn't after its upper bound is made exact has the
centroids of those groups scanned whose lower bound it reaches. Bounds are compared with a margin, so no tie is lost.

Centroids (k x components) are broadcast; vectors and bounds are a table a round, the one before is dropped; sums of clusters meet by
cluster and component, at most k x components rows a task.

Cases: vectors with another number of components, or with a null or non-finite one, are left out; a null vec_id is
clustered, but comes last among those that start as centroids; repeated rows count each; of rows with equal vec_id the one with
the smaller vector starts first; fewer vectors than k give fewer centroids; an empty table gives an empty
result; other columns are ignored. Whole numbers beyond what doubles hold exactly are handled as Python's, slowly;
what doesn't fit a long ends with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, table

#: Centroids, rounds of means, components, scale, what is put before an id when it is hashed; centroids a group.
K, ROUNDS, DIMS, SCALE, SEED, PER_GROUP = 40, 5, 64, 256, "2:", 10
#: Bounds are compared with this relative margin, far above what a few roundings make of them.
MARGIN = 1e-9
#: Rows handled at a time.
ROWS = 8192


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q) of the vectors that are kept, q as whole numbers."""
    x = F.col("v").cast("array<double>")
    ends = F.lit(float("inf"))
    fine = (F.size(x) == dims) & F.forall(x, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < ends), F.lit(False)))
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.coalesce(fine, F.lit(False)))
    floor = lambda e: F.when(F.abs(e * scale) < float(1 << 63), F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component doesn't fit a long")).cast("long"))
    return plain.select("vec_id", F.transform(x, floor).alias("q"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order: each task sends k rows at most."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return _whole([r["q"] for r in rows])


def _whole(rows: list) -> np.ndarray:
    """Rows of whole numbers as an array: of doubles where squared distances are exact in them, of Python's numbers otherwise."""
    a = np.array(rows, dtype=object)
    return a.astype(float) if _exact(a) else a


def _exact(a: np.ndarray) -> bool:
    return a.size == 0 or 4 * a.shape[-1] * int(max(-a.min(), a.max())) ** 2 < 1 << 53


def groups_of(centroids: np.ndarray, per_group: int = PER_GROUP, rounds: int = 5) -> list[np.ndarray]:
    """Numbers of the centroids of each group: these few rows are clustered on the driver, once."""
    c = centroids.astype(float)
    seeds = c[::per_group]
    for _ in range(rounds):
        near = ((c[:, None] - seeds) ** 2).sum(2).argmin(1)
        seeds = np.array([c[near == g].mean(0) if (near == g).any() else s for g, s in enumerate(seeds)])
    near = ((c[:, None] - seeds) ** 2).sum(2).argmin(1)
    return [np.flatnonzero(near == g) for g in range(len(seeds)) if (near == g).any()]


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if q.dtype == object or c.dtype == object:
        return np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in q], dtype=object).reshape(len(q), len(c))
    return (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)


def own_squared(q: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own centroid."""
    if q.dtype == object or c.dtype == object:
        return np.array([sum((int(a) - int(b)) ** 2 for a, b in zip(x, c[k])) for x, k in zip(q, cluster)], dtype=object)
    d = q - c[cluster]
    return (d * d).sum(1)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(float))


def first_round(q: np.ndarray, c: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bound per group) from all distances."""
    d = squared(q, c)
    cluster = d.argmin(1) if len(d) else np.zeros(0, np.int64)
    rest, at = _root(d), np.arange(len(q))
    upper = rest[at, cluster]
    rest[at, cluster] = np.inf
    return cluster, upper, np.stack([rest[:, g].min(1) for g in groups], 1)


def next_round(q: np.ndarray, before: np.ndarray, c: np.ndarray, groups: list[np.ndarray], cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids moved from before to c, and how many distances that took."""
    moved = _root(own_squared(before, c, np.arange(len(c))))
    cluster, upper, lower = cluster.copy(), upper + moved[cluster], lower - np.array([moved[g].max() for g in groups])
    reached = lambda up, low: ~(up * (1 + MARGIN) < low * (1 - MARGIN))
    rows = np.flatnonzero(reached(upper, lower.min(1)))
    own = own_squared(q[rows], c, cluster[rows])
    upper[rows] = _root(own)
    still = reached(upper[rows], lower[rows].min(1))
    count, rows, own = len(rows), rows[still], own[still]
    old, best, scanned = cluster[rows], own.copy(), []
    new = old.copy()
    for k, g in enumerate(groups):
        pick = np.flatnonzero(reached(upper[rows], lower[rows, k]))
        d = squared(q[rows[pick]], c[g])
        count += d.size
        scanned.append((pick, d))
        if len(pick):
            at = d.argmin(1)
            low = d[np.arange(len(pick)), at]
            better = (low < best[pick]) | ((low == best[pick]) & (g[at] < new[pick]))
            best[pick[better]], new[pick[better]] = low[better], g[at[better]]
    for k, (g, (pick, d)) in enumerate(zip(groups, scanned)):
        # A group that wasn't scanned may now hold the centroid that the vector left.
        left = np.isin(old, g) & (new != old)
        lower[rows[left], k] = np.minimum(lower[rows[left], k], _root(own[left]))
        if len(pick):
            rest = _root(d)
            rest[new[pick][:, None] == g] = np.inf
            lower[rows[pick], k] = rest.min(1)
    cluster[rows], upper[rows] = new, _root(best)
    return cluster, upper, lower, count


def _grid(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


_SCHEMA = "vec_id long, q array<long>, cluster int, upper double, lower array<double>, distance long"


def _assigned(state: DataFrame, before: np.ndarray | None, c: np.ndarray, groups: list[np.ndarray]) -> DataFrame:
    """Every vector with its centroid, bounds and exact squared distance."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                q = _grid(b.column("q"), c.shape[1])
                q = q.astype(float) if _exact(q) and c.dtype != object else q.astype(object)
                if before is None:
                    cluster, upper, lower = first_round(q, c, groups)
                else:
                    cluster, upper, lower, _ = next_round(q, before, c, groups, b.column("cluster").to_numpy(), b.column("upper").to_numpy(), _grid(b.column("lower"), len(groups)))
                distance = own_squared(q, c, cluster).astype(np.int64)
                lows = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * len(groups)), pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(cluster.astype(np.int32)), pa.array(upper), lows, pa.array(distance)], names=["vec_id", "q", "cluster", "upper", "lower", "distance"])

    return arrow_map(state, rows, _SCHEMA)


def _means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster; an empty one stays."""
    k, dims = c.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python's numbers where a sum of a batch could leave a long.
        total, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for b in batches:
            q, cluster = _grid(b.column("q"), dims), b.column("cluster").to_numpy()
            part = np.zeros((k, dims), np.int64 if q.size == 0 or int(np.abs(q.astype(float)).max()) * len(q) < 1 << 62 else object)
            np.add.at(part, cluster, q)
            total, n = total + part.astype(object), n + np.bincount(cluster, minlength=k)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(seen, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(seen)), pa.int32()), pa.array([int(x) for x in total[seen].ravel()], pa.int64()), pa.array(np.repeat(n[seen], dims))], names=["cluster", "at", "total", "n"])

    parts = arrow_map(state.select("q", "cluster"), rows, "cluster int, at int, total long, n long")
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = c.astype(object)
    for r in sums.collect():  # k x components rows at most
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return _whole([[int(x) for x in row] for row in out])


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED, per_group: int = PER_GROUP) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, q, cluster, distance), centroids) after so many rounds of means and one more assignment. vectors: as of whole_vectors."""
    kept = materialize(vectors, "vectors")
    c = first_centroids(kept, k, seed)
    if not len(c):
        return kept.selectExpr("vec_id", "q", "cast(null as int) as cluster", "cast(null as long) as distance"), c
    groups, before, state = groups_of(c, per_group), None, kept
    for turn in range(rounds + 1):
        old, state = state, materialize(_assigned(state, before, c, groups), f"round{turn}")
        discard(old)
        if turn < rounds:
            before, c = c, _means(state, c)
            if before.dtype != c.dtype:
                before, c = before.astype(object), c.astype(object)
    return state.select("vec_id", "q", "cluster", "distance"), c


def centroid_digest(row: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest()


def op13(spark, sf_dir: str) -> DataFrame:
    found, c = cluster(whole_vectors(table(spark, sf_dir, "embeddings")))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(n, sums.get(n, 0), sum(sums.values()), centroid_digest(x)) for n, x in enumerate(c)]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.drop("q").join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    """Assignments to centroids c{n}, and where more follow, their means c{n + 1}."""
    near = f"""d{n} AS (SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{n} c USING (i) GROUP BY v.r, c.k),
a{n} AS (SELECT r, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)"""
    if n == ROUNDS:
        return near
    return near + f""",
s{n} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM v JOIN a{n} USING (r) GROUP BY k, i),
c{n + 1} AS (SELECT c.k, c.i, CASE WHEN s IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} c LEFT JOIN s{n} USING (k, i))"""


ORACLE = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
v AS MATERIALIZED (SELECT r, i, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS x FROM e, (SELECT unnest(range(1, {DIMS} + 1)) AS i)),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}' || vec_id::VARCHAR)) - 1 AS k FROM e QUALIFY k < {K}),
c0 AS (SELECT k::INT AS k, i, x FROM f JOIN v USING (r)),
{", ".join(_round_sql(n) for n in range(ROUNDS + 1))},
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN e USING (r) JOIN h USING (k)
"""
