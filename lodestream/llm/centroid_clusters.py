"""Centroid clusters by ball k-means, in whole numbers.

A cluster is a ball: its centroid and the distance of its farthest member. Another centroid can take members only if
it is nearer than twice that radius: such centroids are the ball's neighbours. A member nearer to its own centroid than half
the way to the nearest neighbour is in the stable core and is not compared at all; the rest of the ball falls into annuli by the half ways to
the second, third, ... neighbour, and an annulus is compared with just as many neighbours. All of this is decided in whole numbers (a neighbour is skipped only if
its squared distance from the centroid is over four times the member's), so assignments are those of a full comparison, ties included.

Vectors are packed into written blocks with their clusters. A round sums its blocks' components in Spark (clusters x
components rows reach the driver, whatever the data), moves the centroids there and writes the next blocks; the ones
before are removed. A lost executor costs its blocks of one round. Rounds end early once no centroid moves, as nothing could change any more.

Defined results: rows whose vector is null, has another number of components than ``dim`` or a component that is null or not finite are
left out; a null id is assigned but never starts a centroid; rows that repeat an id are vectors of their own; with fewer
vectors than clusters each vector starts one; an empty table gives no rows. Components so large that squared distances may pass
a long stop the job. Columns other than the id and the vector are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.vectors import finite, whole
from lodestream.session import forget, written

CLUSTERS, ROUNDS, SCALE, DIM = 8, 10, 1024, 64
STATE = "ids array<long>, vectors binary, clusters binary, distances binary, stats array<long>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) by full comparison; ties go to the smaller number."""
    best, far = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    for j, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(1)
        closer = d < far
        best[closer], far[closer] = j, d[closer]
    return best, far


def neighbours(centroids: np.ndarray, radii: list[int]) -> list[list[tuple[int, int]]]:
    """For each ball the centroids that may take members of it, nearest first, with their squared distance. radii: upper bounds."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2).tolist()
    return [sorted((d, j) for j, d in enumerate(row) if j != i and d <= 4 * radii[i] ** 2) for i, row in enumerate(apart)]


def reassigned(x: np.ndarray, clusters: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """nearest(), knowing the clusters before and the balls' neighbours."""
    own = ((x - centroids[clusters]) ** 2).sum(1)
    best, far = clusters.copy(), own.copy()
    for i, around in enumerate(near):
        ring = np.flatnonzero(clusters == i)
        for apart, j in around:
            ring = ring[4 * own[ring] >= apart]  # without the core, then annulus by annulus
            if not len(ring):
                break
            d = ((x[ring] - centroids[j]) ** 2).sum(1)
            takes = (d < far[ring]) | ((d == far[ring]) & (j < best[ring]))
            best[ring[takes]], far[ring[takes]] = j, d[takes]
    return best, far


def _state(ids: list[int | None], x: np.ndarray, clusters: np.ndarray, distances: np.ndarray, k: int) -> tuple:
    """A block with its sums: for each cluster (members, distance, farthest, sum of each component)."""
    stats = np.zeros((k, 3 + x.shape[1]), np.int64)
    for i in range(k):
        own = clusters == i
        if own.any():
            stats[i] = [own.sum(), distances[own].sum(), distances[own].max(), *x[own].sum(0)]
    small = np.abs(x).max(initial=0) < 1 << 15
    return ids, x.astype(np.int16 if small else np.int32).tobytes(), clusters.astype(np.int32).tobytes(), distances.tobytes(), stats.ravel().tolist()


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], [c.split()[0] for c in STATE.split(", ")])


def _vectors(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dim else np.int32).reshape(n, dim).astype(np.int64)


def _first(rows: DataFrame, centroids: np.ndarray, scale: int, dim: int) -> DataFrame:
    """Blocks of vectors, each assigned by full comparison."""
    limit = math.isqrt((1 << 61) // dim) // 2  # four times a squared distance stays a long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch["vector"], scale, dim)
            if np.abs(x).max(initial=0) >= limit:
                raise ValueError(f"components from {limit} on (after scaling) have distances that no long holds")
            yield _record([_state(batch["id"].to_pylist(), x, *nearest(x, centroids), len(centroids))])

    return rows.mapInArrow(run, STATE)


def _next(state: DataFrame, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, before in zip(*(batch[c].to_pylist() for c in ("ids", "vectors", "clusters")), strict=True):
                x = _vectors(raw, len(ids), centroids.shape[1])
                yield _record([_state(ids, x, *reassigned(x, np.frombuffer(before, np.int32), centroids, near), len(centroids))])

    return state.select("ids", "vectors", "clusters").mapInArrow(run, STATE)


def _summed(state: DataFrame, k: int, dim: int) -> list[tuple[int, int, int, list[int]]]:
    """(members, inertia, farthest squared distance, sums) of each cluster."""
    cells = state.select(F.posexplode("stats").alias("cell", "x")).groupBy("cell").agg(F.sum("x").alias("total"), F.max("x").alias("most"))
    width, found = 3 + dim, {r.cell: (r.total, r.most) for r in cells.collect()}  # clusters x (components + 3) rows
    return [(found[i * width][0], found[i * width + 1][0], found[i * width + 2][1], [found[i * width + 3 + c][0] for c in range(dim)]) for i in range(k)]


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, salt: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of dim components; centroids start as the
    k vectors with the smallest sha256 of ``salt:vec_id``."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where((F.size("vector") == dim) & finite("vector"))
    seeds = rows.where("id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)).orderBy("hash", "vector").limit(k)
    seeds = seeds.toArrow()
    if not len(seeds):
        return df.sparkSession.createDataFrame([], RESULT)
    centroids = whole(seeds["vector"].combine_chunks(), scale, dim)
    k = len(centroids)

    state = written(_first(rows, centroids, scale, dim), "balls")
    stats = _summed(state, k, dim)
    for _ in range(rounds):
        moved = np.array([[s // n for s in sums] if n else old.tolist() for (n, _, _, sums), old in zip(stats, centroids, strict=True)], np.int64)
        if (moved == centroids).all():
            break
        # a member's new distance is at most its old one and the centroid's move
        moves = ((moved - centroids) ** 2).sum(1).tolist()
        radii = [math.isqrt(far) + 1 + math.isqrt(move) + 1 for (_, _, far, _), move in zip(stats, moves, strict=True)]
        last, state, centroids = state, written(_next(state, moved, neighbours(moved, radii)), "balls"), moved
        stats = _summed(state, k, dim)
        forget(last)

    inertia = [s[1] for s in stats]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, far in zip(*(batch[c].to_pylist() for c in ("ids", "clusters", "distances")), strict=True):
                c = np.frombuffer(own, np.int32)
                columns = [pa.array(ids, pa.int64()), pa.array(c), pa.array(np.frombuffer(far, np.int64)), pa.array(np.array(inertia, np.int64)[c]), pa.array([sum(inertia)] * len(c), pa.int64()), pa.array([names[i] for i in c], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])

    return state.select("ids", "clusters", "distances").mapInArrow(run, RESULT)


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, salt: str = "3") -> str:
    """DuckDB SQL by full comparison in every round."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
            WHERE len(embedding) = {dim} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dim})""",
        "cells AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept)",
        f"seeds AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{salt}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS d FROM seeds)",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, c, distance FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS distance FROM cells JOIN c{r} USING (d) GROUP BY vec_id, c)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, d, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{r}
                LEFT JOIN (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{r} JOIN cells USING (vec_id) GROUP BY c, d) USING (c, d))""")
    return f"""WITH {", ".join(ctes)}, names AS (SELECT c, sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN names USING (c)"""
