"""Operator 12: k-means over integer vectors with clusters as balls.

Components become integers, so distances, sums and means are exact and results don't depend on how rows are dealt out. In a round a
vector still belongs to the cluster of the round before. A task takes each cluster's members in a batch as a ball about the
new centroid, of the radius of its farthest member. A centroid no farther than twice the radius is a neighbour; all others lie beyond every
member. Neighbours in the order of their distances bound annuli: a member closer than half the way to the nearest
neighbour is in the stable core and stays; one in annulus m is compared exactly with the m nearest neighbours alone.
All bounds are compared as squared integers (gap <= 4 * distance), which keeps ties, and ties go to the smaller number.

A round is one pass that maps batches to sums for each cluster; Spark adds them up and at most k rows reach the driver. Labels aren't stored:
a pass walks the centroids of the rounds so far, so a lost task is simply run again. After CARRY rounds
vectors and labels are written to the checkpoint folder, so that the work of many rounds doesn't grow with their square.

Defined results: vectors that are null, of another length, hold a null or a non-finite component, or one so large that squared distances
don't fit a long (over 2**27 in size after scaling) are left out; repeated rows are vectors of their own; a null vec_id is clustered
but isn't one of the starts; with fewer vectors than k all that have an id are starts, and with none of these nor any vectors there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import checkpoint, map_arrow

SCALE, DIMENSIONS, CLUSTERS, ROUNDS = 256, 64, 40, 5
#: Size of the largest component, so that a squared distance in 64 dimensions is a long.
MOST = 1 << 27
CARRY = 8


def integer_vectors(df: DataFrame, scale: int = SCALE, dimensions: int = DIMENSIONS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that are kept."""
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c * scale) <= MOST))  # NaN is larger than any number
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dimensions) & finite).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def squared(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: in doubles where all terms are below 2**53, else in 64-bit integers."""
    most = max(np.abs(x).max(initial=0), np.abs(others).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    a, b = x.astype(kind), others.astype(kind)
    return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)


class Balls:
    """Centroids of a round, the gaps between them, and each one's others by distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.gaps = squared(centroids, centroids)
        self.order = np.argsort(self.gaps, axis=1, kind="stable")
        self.compared = 0  # distances to neighbours that were worked out

    def move(self, x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids of members of the balls ``labels``, and the squared distances to them."""
        labels, distance = labels.copy(), np.empty(len(x), np.int64)
        by_ball = np.argsort(labels, kind="stable")
        bounds = np.flatnonzero(np.diff(labels[by_ball])) + 1
        for members in np.split(by_ball, bounds):
            if len(members):
                self._move_ball(int(labels[members[0]]), members, x, labels, distance)
        return labels, distance

    def _move_ball(self, own: int, members: np.ndarray, x: np.ndarray, labels: np.ndarray, distance: np.ndarray) -> None:
        away = distance[members] = squared(x[members], self.centroids[own : own + 1])[:, 0]
        others = self.order[own][self.order[own] != own]
        gaps = self.gaps[own][others]
        near = np.searchsorted(gaps, 4 * away.max(), side="right")  # neighbours of the ball
        annulus = np.searchsorted(gaps[:near], 4 * away, side="right")  # neighbours that a member may be nearer to; 0: the stable core
        for m in np.unique(annulus[annulus > 0]):
            at = members[annulus == m]
            candidates = np.sort(np.append(others[:m], own))  # so that the first of equals has the smaller number
            found = squared(x[at], self.centroids[candidates])
            self.compared += len(at) * int(m)
            best = found.argmin(1)
            labels[at], distance[at] = candidates[best], found[np.arange(len(at)), best]


def _walk(history: list[Balls], x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distance = np.zeros(len(x), np.int64)
    for balls in history:
        labels, distance = balls.move(x, labels)
    return labels, distance


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def starts(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ids' digests are smallest, in that order; vectors of one id in the order of their components. At most ``clusters`` rows."""
    named = vectors.where(F.col("vec_id").isNotNull()).withColumn("digest", F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256))
    return np.array([r["x"] for r in named.orderBy("digest", "x").limit(clusters).collect()], np.int64)


def _assigned(rows: DataFrame, history: list[np.ndarray], keep: bool) -> DataFrame:
    """(vec_id, cluster, distance) of each of ``rows`` (vec_id, x, cluster), with x too if it is to be kept."""

    def make():
        balls = [Balls(c) for c in history]

        def step(batch: pa.RecordBatch):
            x = _matrix(batch.column(1), batch.num_rows)
            labels, distance = _walk(balls, x, batch.column(2).to_numpy().astype(np.int64))
            return [batch.column(0), *([batch.column(1)] if keep else []), labels, distance]

        return step

    return map_arrow(rows.select("vec_id", "x", "cluster"), make, "vec_id long, " + "x array<long>, " * keep + "cluster int, distance long")


def _means(rows: DataFrame, history: list[np.ndarray]) -> np.ndarray:
    """The next centroids: floors of the means of what is assigned to the last ones; a centroid without vectors stays."""
    centroids = history[-1]
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(c) for c in history]
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), batch.num_rows)
            labels, _ = _walk(balls, x, batch.column(1).to_numpy().astype(np.int64))
            np.add.at(total, labels, x)
            count += np.bincount(labels, minlength=k)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(full, pa.int32()), "count": pa.array(count[full]), "total": pa.array(total[full].tolist(), pa.list_(pa.int64()))})

    parts = rows.select("x", "cluster").mapInArrow(sums, "cluster int, count long, total array<long>")
    found = parts.groupBy("cluster").agg(F.sum("count").alias("count"), *(F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions))).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["count"] for i in range(dimensions)]
    return out


def cluster(vectors: DataFrame, first: np.ndarray, rounds: int = ROUNDS, carry: int = CARRY) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each of ``vectors`` (vec_id, x), the final centroids) after so many rounds from the centroids ``first``."""
    rows, history = vectors.withColumn("cluster", F.lit(0)), [first]
    if not len(first):
        return rows.where("false").select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), first
    for _ in range(rounds):
        if len(history) > carry:
            rows, history = checkpoint(_assigned(rows, history[:-1], True)), history[-1:]
        history.append(_means(rows, history))
    return _assigned(rows, history, False), history[-1]


def digests(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per vector also the inertia of its cluster and of all, and its centroid's digest. At most a row for each centroid is joined."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    found = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(total.alias("inertia")).collect()}
    spark = assigned.sparkSession
    fits = lambda n: n if n < 1 << 63 else None
    names = spark.createDataFrame([(k, fits(v), fits(sum(found.values())), ",".join(map(str, centroids[k].tolist()))) for k, v in found.items()], "of int, cluster_inertia long, inertia long, centroid string")
    return assigned.join(F.broadcast(names), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _sql(rounds: int) -> str:
    parts = [
        f"""k as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::double)::bigint) as x from embeddings
        where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda c: c is null or not isfinite(c) or abs({SCALE} * c::double) > {MOST})) = 0)""",
        "cells as materialized (select r, unnest(x) as v, generate_subscripts(x, 1) as i from k)",
        f"c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), x) - 1 as c, x from k where vec_id is not null qualify c < {CLUSTERS})",
    ]
    distance = "list_sum(list_transform(list_zip(k.x, z.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for t in range(rounds + 1):
        parts.append(f"a{t} as materialized (select r, arg_min(c, (d, c)) as c, min(d) as d from (select r, c, {distance} as d from k cross join c{t} z) group by r)")
        if t < rounds:
            parts.append(f"m{t} as materialized (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from (select c, i, sum(v) as s, count(*) as n from cells join a{t} using (r) group by c, i) group by c)")
            parts.append(f"c{t + 1} as materialized (select c, coalesce(m{t}.x, c{t}.x) as x from c{t} left join m{t} using (c))")
    return f"""with {", ".join(parts)}
    select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(z.x, ',')) as centroid_sha256
    from a{rounds} join k using (r) join c{rounds} z using (c)"""


ORACLE_SQL = _sql(ROUNDS)
