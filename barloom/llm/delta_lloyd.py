"""k-means by delta Lloyd rounds in whole numbers (operator 13).

Vectors become whole numbers once. Every vector's owner (its nearest centroid) and its distance are
kept in a written table, the sums and counts of all clusters as whole numbers on the driver. In a round
a vector whose owner did not move is compared with the centroids that moved only, as nothing else can
have come nearer; a vector whose owner moved is compared with all. Vectors that change their owner are
signed transfers, minus for the old and plus for the new cluster, which Spark aggregates; the sums move
by them. So late rounds compare and transfer little, and a round in which no centroid moves is free.
The driver holds k (size + 1) numbers.

Rows that take part: those with exactly `size` components, none null or not finite. (Components beyond
2^26 after scaling, whose squared distances would not fit a long, take no part either.) Starts are the
k rows with the smallest hash, ties by the vector, null vec_ids after all others; with fewer rows there
are fewer centroids. Ties go to the smaller centroid; a centroid without vectors stays where it is.
Repeated rows are vectors like others. No rows give an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE, BOUND = 1024, 1 << 26
STATE = "vec_id long, v array<int>, owner int, before int, distance long"


def whole_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id, v: the rows that take part, as floor(1024 x)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fit = (F.size("embedding") == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < BOUND / SCALE))
    return vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * SCALE).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in vectors.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()], np.int64)


def _assigner(centroids: np.ndarray, moved: np.ndarray):
    """Owners and distances anew, where `moved` says which centroids are not where they were."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = dict(zip(batch.schema.names, batch.columns))
            v = table["v"].flatten().to_numpy().reshape(n, -1).astype(np.int64)
            old = table["owner"].to_numpy(zero_copy_only=False)
            stale = (old < 0) | moved[np.maximum(old, 0)]
            owner = np.where(stale, len(centroids), old)
            best = np.where(stale, np.iinfo(np.int64).max, table["distance"].to_numpy(zero_copy_only=False))
            for c in range(len(centroids)):
                rows = np.arange(n) if moved[c] else np.flatnonzero(stale)
                d = ((v[rows] - centroids[c]) ** 2).sum(axis=1)
                nearer = (d < best[rows]) | ((d == best[rows]) & (c < owner[rows]))
                owner[rows[nearer]], best[rows[nearer]] = c, d[nearer]
            yield pa.RecordBatch.from_arrays([table["vec_id"], table["v"].cast(pa.list_(pa.int32())), pa.array(owner, pa.int32()), pa.array(old, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "v", "owner", "before", "distance"])

    return assign


def _transfers(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What the clusters' sums and counts change by, as (k, size) and (k,) of Python's whole numbers."""
    sums, counts = np.zeros((k, size), object), np.zeros(k, object)
    sign = lambda cluster, n: F.struct(F.col(cluster).alias("cluster"), F.lit(n).cast("long").alias("sign"))
    moves = state.where("owner <> before").select("v", F.explode(F.array(sign("owner", 1), sign("before", -1))).alias("m")).where("m.cluster >= 0")
    totals = moves.groupBy("m.cluster").agg(F.sum("m.sign"), *[F.sum(F.col("m.sign") * F.get("v", F.lit(i))) for i in range(size)])
    for cluster, n, *parts in totals.collect():  # k rows at most
        counts[cluster], sums[cluster] = n, parts
    return sums, counts


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lloyd")
    whole = scratch.keep(whole_vectors(vectors, size), "vectors")
    centroids = starts(whole, k, seed)
    state = whole.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(-1).alias("before"), F.lit(0).cast("long").alias("distance"))
    if not len(centroids):
        none = F.lit(0).cast("long")
        return state.select("vec_id", F.col("owner").alias("cluster"), "distance", none.alias("cluster_inertia"), none.alias("inertia"), F.lit("").alias("centroid_sha256"))
    n = len(centroids)
    moved, sums, counts = np.ones(n, bool), np.zeros((n, size), object), np.zeros(n, object)
    for turn in range(rounds + 1):
        if not moved.any():
            break
        state = scratch.keep(state.mapInArrow(_assigner(centroids, moved), STATE), f"round-{turn}")
        scratch.only(f"round-{turn}")
        if turn == rounds:
            break
        more, came = _transfers(state, n, size)
        sums, counts = sums + more, counts + came
        new = np.array([[s // c for s in sums[i]] if c else centroids[i] for i, c in enumerate(counts)], np.int64)
        centroids, moved = new, (new != centroids).any(axis=1)
    inertia = {r.owner: r.d for r in state.groupBy("owner").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    ends = F.broadcast(spark.createDataFrame(rows, "owner int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return state.join(ends, "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
