"""Centroid clustering by balls, over whole numbers.

Each cluster is a ball around its centroid. Only clusters whose centroids are
nearer than twice a ball's radius can take a member from it: its neighbours. Members
nearer to their centroid than half the way to the nearest neighbour are the stable
core and stay without a comparison; the others lie in annuli, and those of the m-th
annulus are compared exactly with the m nearest neighbours only.

A round is one job over the vectors: a task takes its vectors batch by batch, makes
the balls of the members that it has, and writes each vector with its new cluster, and
one row of sums for each cluster. The sums, cut to one row for each cluster and
component, are all that comes to the driver. No vectors are shuffled, so a vector that
a third of all rows hold is no hot key.

Distances are exact whole numbers, so that ties are ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove_scratch, scratch_tables, stored

_STATE = "vec_id long, v array<int>, cluster int, distance long, n long, sums array<long>"


def bound(dim: int) -> int:
    """The largest component whose squared distances over `dim` components fit a long by far."""
    return 1 << ((60 - dim.bit_length()) // 2)


def whole_vectors(table: DataFrame, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v of rows whose vector has exactly dim components, none null or non-finite: floor(scale * x), held within bound(dim)."""
    x, most = F.col(vec_col), float(bound(dim))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    as_int = lambda c: F.floor(F.greatest(F.least(F.lit(float(scale)) * c, F.lit(most)), F.lit(-most))).cast("int")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))
    return rows.where((F.size("x") == dim) & F.forall("x", finite)).select("vec_id", F.transform("x", as_int).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str = "2:") -> np.ndarray:
    """The k vectors with the smallest SHA-256 of the seed and their id, in its order; of rows with one id those with smaller components first."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact: in doubles where these hold the numbers, else in 64-bit integers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    kind = np.float64 if x.shape[1] * (2 * most) ** 2 < 1 << 52 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def assign_all(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals) and distance, by comparing with all."""
    d = _distances(x, c)
    own = d.argmin(1)
    return own, d[np.arange(len(x)), own]


def assign_balls(x: np.ndarray, before: np.ndarray, c: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the clusters before and the squared gaps between centroids; also how many comparisons with other centroids it took."""
    own, dist, compared = before.copy(), np.zeros(len(x), np.int64), 0
    order = np.argsort(before, kind="stable")
    cuts = np.searchsorted(before[order], np.arange(len(c) + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        members = order[cuts[i] : cuts[i + 1]]
        d = _distances(x[members], c[i : i + 1])[:, 0]
        dist[members] = d
        # With d(x, j) <= d(x, i) the gap between i and j is at most twice d(x, i); all are squares.
        neighbours = np.flatnonzero(gaps[i] <= 4 * d.max())
        neighbours = neighbours[neighbours != i]
        neighbours = neighbours[np.argsort(gaps[i][neighbours], kind="stable")]
        annulus = np.searchsorted(gaps[i][neighbours], 4 * d, "right")  # 0: the stable core
        for m in np.unique(annulus[annulus > 0]):
            rows = np.flatnonzero(annulus == m)
            near = np.sort(np.append(neighbours[:m], i))
            e = _distances(x[members[rows]], c[near])
            best = e.argmin(1)
            own[members[rows]], dist[members[rows]] = near[best], e[np.arange(len(rows)), best]
            compared += len(rows) * int(m)
    return own, dist, compared


def _round(c: np.ndarray, known: bool):
    """Rows of a round's table: vectors with clusters and distances, and behind them one row of sums for each cluster of the task."""
    gaps = _distances(c, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = c.shape
        n, total, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dim), np.int64)
        for b in batches:
            v = b.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(b), dim)
            wide = x.astype(np.int64)
            own, dist = assign_balls(wide, b.column(2).to_numpy().astype(np.int64), c, gaps)[:2] if known else assign_all(wide, c)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(k + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                rows = order[cuts[i] : cuts[i + 1]]
                n[i] += len(rows)
                sums[i] += wide[rows].sum(0)
                total[i] += int(dist[rows].sum())
            none = lambda kind: pa.nulls(len(b), kind)
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(own, pa.int32()), pa.array(dist), none(pa.int64()), none(pa.list_(pa.int64()))], names=_NAMES)
        some = np.flatnonzero(n)
        # The distance of a row of sums is the sum of its distances.
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.list_(pa.int32())), pa.array(some, pa.int32()), pa.array([total[i] for i in some], pa.int64()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=_NAMES,
        )

    return run


_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _moved(table: DataFrame, c: np.ndarray) -> np.ndarray:
    """Centroids at the floors of their members' means; one without members stays."""
    parts = table.where("n IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
    means = parts.groupBy("cluster", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = c.copy()
    for r in means.collect():  # one row for each cluster and component
        out[r.cluster, r.pos] = int(r.s) // r.n
    return out


def _text_digest(row: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()


def ball_kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:") -> tuple[DataFrame, DataFrame]:
    """(vec_id, v, cluster, distance) for every row of vectors(vec_id, v), and (cluster, centroid, members, inertia) for every cluster.

    `rounds` times all vectors go to their nearest centroids, which then move, and
    once more at the end. Distances are squared; of equal ones the smaller cluster
    number wins. Repeated rows, and rows that share an id or have none, each count
    and each get their row; with fewer than k vectors each is a centroid; with none
    there are no rows. Clusters may be empty (0 members, inertia 0). The result is a
    scratch table; that of a round goes when the next is written.
    """
    spark = vectors.sparkSession
    c = first_centroids(vectors, k, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, v array<int>, cluster int, distance long"), spark.createDataFrame([], "cluster int, centroid array<long>, members long, inertia long")
    state = stored(vectors.mapInArrow(_round(c, False), _STATE), "balls")
    for _ in range(rounds):
        c = _moved(state, c)
        older = scratch_tables()[-1]
        state = stored(state.where("n IS NULL").select("vec_id", "v", "cluster").mapInArrow(_round(c, True), _STATE), "balls")
        remove_scratch(spark, [older])
    parts = state.where("n IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("long").alias("d")).collect()
    found = {r.cluster: (r.n, r.d) for r in parts}
    clusters = [(i, row.tolist(), *found.get(i, (0, 0))) for i, row in enumerate(c)]
    return state.where("n IS NULL").select("vec_id", "v", "cluster", "distance"), spark.createDataFrame(clusters, "cluster int, centroid array<long>, members long, inertia long")


def cluster_digest(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """ball_kmeans's rows with the inertia of their cluster and of all, and the digest of their centroid; clusters has k rows and is sent to the tasks."""
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    every = clusters.agg(F.sum(F.col("inertia").cast("decimal(38,0)")).try_cast("long")).first()[0]
    side = clusters.select(F.col("cluster").alias("__c"), F.col("inertia").alias("cluster_inertia"), digest.alias("centroid_sha256"))
    out = rows.join(F.broadcast(side), F.col("cluster") == F.col("__c"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(every).cast("long").alias("inertia"), "centroid_sha256")


def nearest(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """vec_id, cluster and distance of other vectors, of the clusters' dimension, to the nearest centroid."""
    rows = clusters.orderBy("cluster").collect()
    c = np.array([r.centroid for r in rows], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), c.shape[1]).astype(np.int64)
            own, dist = assign_all(x, c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def _sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    def assign(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT rid, vec_id, e.v, c, list_sum(list_transform(range(1, {dim + 1}), lambda j: (e.v[j] - m.v[j]) * (e.v[j] - m.v[j])))::BIGINT AS d FROM e, m{i} AS m) GROUP BY rid)"""

    def move(i: int) -> str:
        floor = "(s - ((s % n) + n) % n) // n"
        return f"""m{i + 1} AS MATERIALIZED (SELECT m{i}.c, coalesce(w.v, m{i}.v) AS v FROM m{i} LEFT JOIN (
  SELECT c, list(({floor})::BIGINT ORDER BY j) AS v FROM (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {dim + 1})) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) w USING (c))"""

    steps = ",\n".join(f"{assign(i)},\n{move(i)}" for i in range(rounds))
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
m0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM e) WHERE c < {k}),
{steps},
{assign(rounds)}
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN m{rounds} USING (c)"""


SQL = _sql()
