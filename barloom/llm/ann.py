"""Approximate nearest neighbours by learned partitions (operator 10).

On a bounded sample of the vectors a graph of nearest neighbours is made and cut into equal parts by
repeated bisection: a smoothed random field on the graph is split at its median, and pairs are
exchanged while that saves edges. A small softmax network learns which parts a vector's neighbours
lie in. It then puts every row in its most probable part, and sends each query to its most probable
parts, where all candidates are compared by exact cosine in double precision. A query visits parts
until their probabilities reach a sum that, on sample rows kept back from learning, reached the part
of `recall` of the nearest neighbours; vectors without structure so visit most parts, and clustered
ones few.

Equal vectors are searched once: of each, the `k + 1` smallest ids stand for all, which loses no
result as ties go to smaller ids. A part that holds more than `block_rows` rows is dealt out in
blocks, and every query of the part visits each block, so no task grows with the largest part.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than most of the sample. Rows that repeat a vec_id count as one with the first of
its vectors. Fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The `degree` nearest rows of each row, found exactly in blocks."""
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def bisect(graph: np.ndarray, members: np.ndarray, rng: np.random.Generator, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of `members` with few graph edges between them."""
    place = np.full(len(graph), -1)
    place[members] = np.arange(len(members))
    near = place[graph[members]]
    inside = near >= 0
    degree = np.maximum(1, inside.sum(axis=1))
    field = rng.standard_normal(len(members))
    for _ in range(rounds):
        pulled = np.where(inside, field[near], 0).sum(axis=1) / degree
        back = np.bincount(near[inside], np.repeat(field / degree, inside.sum(axis=1)), len(members))
        field = field + pulled + back
        field -= field.mean()
        field /= max(np.abs(field).max(), 1e-300)
    side = np.zeros(len(members), bool)
    side[np.argsort(field, kind="stable")[len(members) // 2 :]] = True
    for _ in range(8):  # exchange the best pairs while both gain
        other = np.where(inside, side[near] != side[:, None], False).sum(axis=1) + np.bincount(near[inside], (np.repeat(side, inside.sum(axis=1)) != side[near[inside]]), len(members))
        total = inside.sum(axis=1) + np.bincount(near[inside], minlength=len(members))
        gain = 2 * other - total
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        swap = np.flatnonzero((gain[a[:n]] > 0) & (gain[b[:n]] > 0))[: max(1, n // 8)]
        if not len(swap):
            break
        side[a[swap]], side[b[swap]] = False, True
    return members[~side], members[side]


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part number for each node; `parts` is a power of two and sizes differ by one a halving."""
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(graph, g, rng)]
    out = np.empty(len(graph), np.int64)
    for number, g in enumerate(groups):
        out[g] = number
    return out


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 12, batch: int = 256, rate: float = 3e-3):
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden), np.zeros(p)]
        scale = np.sqrt(d)  # components of a unit vector are small
        self.scale = scale
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                a = np.maximum(0, x[rows] * scale @ self.w[0] + self.w[1])
                err = (self._softmax(a @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (err @ self.w[2].T) * (a > 0)
                grads = [(x[rows] * scale).T @ back, back.sum(axis=0), a.T @ err, err.sum(axis=0)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(0, _unit(x) * self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])

    def calibrate(self, x: np.ndarray, found: np.ndarray, recall: float) -> None:
        """Sets `mass`: found has the parts of each row's neighbours."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.empty_like(p)  # the sum of the parts that are more probable
        ranked = np.take_along_axis(p, order, axis=1)
        np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
        self.mass = float(np.quantile(np.take_along_axis(before, found, axis=1), recall))

    def visits(self, x: np.ndarray) -> list[list[int]]:
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        counts = np.maximum(1, (np.cumsum(ranked, axis=1) - ranked <= self.mass).sum(axis=1))
        return [row[:n].tolist() for row, n in zip(order, counts, strict=True)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and its vector in double precision (x, eight bytes a component), of what takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, sizes = [], [], []
            for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if key is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(key)
                    out.append(x.astype("<f8").tobytes())
                    sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())], names=["vec_id", "x", "d"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, x binary, d int")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Each distinct vector with the `keep` smallest ids that have it: (h, x, vec_id), a row an id.

    Batches are thinned first, so that one vector in very many rows does not travel with all of them.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas().sort_values("vec_id")
            frame = frame[frame.groupby("h").cumcount() < keep]
            yield pa.RecordBatch.from_pandas(frame, schema=batch.schema, preserve_index=False)

    thinned = rows.select("h", "vec_id", "x").mapInArrow(thin, "h string, vec_id long, x binary")
    order = Window.partitionBy("h").orderBy("vec_id")
    return thinned.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n")


def nearest(vectors: DataFrame, k: int = 5, query_every: int = 50, sample_rows: int = 8192, rows_a_part: int = 1024, recall: float = 0.97, most_parts: int = 256, block_rows: int = 4096, degree: int = 12, seed: int = 7) -> DataFrame:
    """The k nearest rows found for each row whose vec_id is divisible by `query_every`.

    query_id, rank (from 1), vec_id, score (cosine in double precision). The sample that the
    partitions are learned from holds at most `sample_rows` distinct vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable(vectors)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy("x"))).where("n = 1").drop("n")
    rows = scratch.keep(rows.withColumn("h", F.sha2("x", 256)), "rows")
    all_distinct = scratch.keep(distinct_vectors(rows, k + 1), "distinct")
    sample = all_distinct.groupBy("h").agg(F.min("x").alias("x")).orderBy("h").limit(sample_rows).select("x").toPandas()["x"].tolist()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    d = 8 * int(np.bincount([len(x) // 8 for x in sample]).argmax())
    x = _unit(np.stack([np.frombuffer(v, "<f8") for v in sample if len(v) == d]))
    kept = all_distinct.where(F.length("x") == d)
    count = kept.count()
    parts = 1
    while parts < most_parts and parts * rows_a_part < count and parts * 16 < len(x):
        parts *= 2
    rng = np.random.default_rng(seed)
    if parts > 1:
        graph = neighbour_graph(x, min(degree, len(x) - 1))
        cut = balanced_parts(graph, parts, rng)
        target = np.eye(parts)[np.concatenate([cut[:, None], cut[graph]], axis=1)].mean(axis=1)
        back = rng.permutation(len(x)) < len(x) // 6
        router = Router(x[~back], target[~back], rng)
        nearest_five = neighbour_graph(x, min(k, len(x) - 1))[back]
        router.calibrate(x[back], router.probabilities(x).argmax(axis=1)[nearest_five], recall)
    else:
        router = None
    shared = spark.sparkContext.broadcast(router)

    def route(several: bool):
        @F.pandas_udf("array<int>")
        def chosen(batch: pd.Series) -> pd.Series:
            if shared.value is None or not len(batch):
                return pd.Series([[0]] * len(batch))
            vectors = np.stack([np.frombuffer(v, "<f8") for v in batch])
            return pd.Series(shared.value.visits(vectors) if several else shared.value.probabilities(vectors).argmax(axis=1)[:, None].tolist())

        return chosen

    placed = scratch.keep(kept.withColumn("part", route(False)("x")[0]), "placed")
    blocks = {r["part"]: -(-r["count"] // block_rows) for r in placed.groupBy("part").count().collect()}  # a row a part
    of_part = F.create_map(*[F.lit(y) for part, n in blocks.items() for y in (part, n)])
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("h", "vec_id"), of_part[F.col("part")]).cast("int"))
    queries = rows.where((F.col("vec_id") % query_every == 0) & (F.length("x") == d)).select(F.col("vec_id").alias("query_id"), "h", "x")
    asked = queries.groupBy("h").agg(F.min("x").alias("x")).withColumn("part", F.explode(route(True)("x")))
    asked = asked.where(of_part[F.col("part")].isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0), of_part[F.col("part")] - 1)))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        q, c = queries.column("h").to_pylist(), candidates.column("vec_id").to_numpy()
        out: list[tuple] = []
        if len(q) and len(c):
            y = np.stack([np.frombuffer(v, "<f8") for v in candidates.column("x").to_pylist()])
            order = np.argsort(c, kind="stable")
            c, y = c[order], y[order]
            norm = np.sqrt((y * y).sum(axis=1))
            blobs = queries.column("x").to_pylist()
            for at in range(0, len(q), 128):
                a = np.stack([np.frombuffer(v, "<f8") for v in blobs[at : at + 128]])
                near = (a @ y.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * norm)
                best = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]
                # the kept ones are scored alone, so that a score doesn't depend on the block around it
                for i, row in enumerate(best):
                    exact = (a[i] * y[row]).sum(axis=1) / (np.sqrt((a[i] * a[i]).sum()) * norm[row])
                    out += [(q[at + i], int(c[j]), float(s)) for j, s in zip(row, exact, strict=True)]
        names = ["h", "vec_id", "score"]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, (pa.string(), pa.int64(), pa.float64()), strict=True))})

    found = asked.groupBy("part", "block").cogroup(dealt.select("part", "block", "vec_id", "x").groupBy("part", "block")).applyInArrow(search, "h string, vec_id long, score double")
    best = Window.partitionBy("h").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    # a query's own row is among its k + 1 best or in none of them
    lists = found.groupBy("h").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("best"))
    pairs = queries.select("query_id", "h").join(scratch.keep(lists, "found"), "h")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return pairs.select("query_id", F.posexplode(others).alias("place", "b")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))
