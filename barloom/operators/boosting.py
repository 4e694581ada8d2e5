"""Boosted quantile trees from histograms.

Columns are binned once by their quantiles, a missing value having a bin of its own, and the bins are
written with the targets. All models, one for each target and quantile, grow their trees side by side. A
level is one Spark job: tasks sum gradients by (model, open leaf, column, bin), an aggregation merges the
sums, a window runs over the bins, and of each open leaf the best split alone comes to the driver. The
leaves with the largest gains are split first, until a tree has as many as it may have. A leaf's value is
the quantile of its residuals, one more aggregation a tree. Predictions so far are written with the bins
every few trees, so a job applies a bounded number of trees.

The driver holds edges, trees and a row an open leaf; tasks hold a batch and one histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stages
from . import quantiles

MISSING = 0


@dataclass
class Tree:
    """Nodes by number: an inner one has a column, the last bin that goes left, where missing ones go, and two children."""

    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, cut: int, missing_left: bool) -> list[int]:
        """The numbers of the two new leaves."""
        self.column[node], self.cut[node], self.missing_left[node], self.left[node] = column, cut, missing_left, len(self.column)
        for _ in range(2):
            for held, empty in ((self.column, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.value, 0.0)):
                held.append(empty)
        return [self.left[node], self.left[node] + 1]

    @property
    def leaves(self) -> int:
        return sum(c < 0 for c in self.column)

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        column, cut, missing, left = (np.array(x) for x in (self.column, self.cut, self.missing_left, self.left))
        while (inner := np.flatnonzero(column[at] >= 0)).size:
            here = at[inner]
            found = bins[inner, column[here]]
            goes = np.where(found == MISSING, missing[here], found <= cut[here])
            at[inner] = left[here] + ~goes
        return at


@dataclass
class Boosted:
    columns: tuple[str, ...]
    models: tuple[tuple[str, float], ...]
    edges: list[np.ndarray]
    base: np.ndarray
    rate: float
    trees: list[list[Tree]] = field(default_factory=list)  # by round and model

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins from 1; NaN has bin 0."""
        out = np.empty(x.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), MISSING, 1 + np.searchsorted(edges, x[:, j], side="left"))
        return out

    def grown(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from round `first` on add, by row and model."""
        out = np.zeros((len(bins), len(self.models)))
        for trees in self.trees[first:]:
            for m, tree in enumerate(trees):
                out[:, m] += self.rate * np.array(tree.value)[tree.node_of(bins)]
        return out

    def predict(self, rows: DataFrame, name: str = "predicted") -> DataFrame:
        """The rows with an array of predictions, in the order of the models."""
        columns = self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = self.base + self.grown(self.binned(_matrix(batch, columns)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(made), pa.list_(pa.float64()))], [*batch.schema.names, name])

        cast = rows.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c) for c in rows.columns])
        return cast.mapInArrow(run, cast.withColumn(name, F.array(F.lit(0.0))).schema)


def _matrix(batch: pa.RecordBatch, columns) -> np.ndarray:
    held = dict(zip(batch.schema.names, batch.columns))
    return np.stack([held[c].to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) if batch.num_rows else np.empty((0, len(columns)))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _gradients(y: np.ndarray, p: np.ndarray, model: Boosted, names: list[str]) -> np.ndarray:
    """The loss's slopes by row and model; NaN where the target is missing."""
    of = [names.index(t) for t, _ in model.models]
    q = np.array([q for _, q in model.models])
    truth = y[:, of]
    return np.where(np.isnan(truth), np.nan, np.where(p >= truth, 1 - q, -q))


def _state(table: DataFrame, width: int, models: int, targets: int, made):
    """Runs `made(bins, y, p)` over the batches of the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch: pa.RecordBatch):
            held = dict(zip(batch.schema.names, batch.columns))
            bins = np.frombuffer(b"".join(held["b"].to_pylist()), np.uint8).reshape(-1, width)
            return bins, _lists(held["y"], targets).astype(float), _lists(held["p"], models)

        yield from made(read(b) for b in batches if b.num_rows)

    return run


def _best_splits(table: DataFrame, model: Boosted, names: list[str], done: int, trees: list[Tree], leaves: list[list[int]], bins: int, l2: float, least: int) -> list:
    """A row an open leaf that has a split: model, node, column, bin, missing_left, gain. One Spark job."""
    width, count = len(model.columns), len(model.models)

    def sums(batches):
        n = sum(map(len, leaves))
        totals = np.zeros((2, n * width * (bins + 1)))
        starts = np.cumsum([0, *map(len, leaves)])
        for b, y, p in batches:
            g = _gradients(y, p + model.grown(b, done), model, names)
            for m, tree in enumerate(trees):
                if not leaves[m]:
                    continue
                place = np.full(len(tree.column), -1)
                place[leaves[m]] = starts[m] + np.arange(len(leaves[m]))
                at = place[tree.node_of(b)]
                rows = np.flatnonzero((at >= 0) & ~np.isnan(g[:, m]))
                key = ((at[rows, None] * width + np.arange(width)) * (bins + 1) + b[rows]).ravel()
                for k, weight in enumerate((np.repeat(g[rows, m], width), None)):
                    totals[k] += np.bincount(key, weight, totals.shape[1])
        used = np.flatnonzero(totals[1])
        node = used // (bins + 1) // width
        of_model = np.searchsorted(starts, node, side="right") - 1
        flat = np.array([leaf for held in leaves for leaf in held], np.int64)
        arrays = [of_model, flat[node], used // (bins + 1) % width, used % (bins + 1), totals[0][used], totals[1][used].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["model", "node", "column", "bin", "g", "n"])

    found = table.mapInArrow(_state(table, width, count, len(names), sums), "model long, node long, column long, bin long, g double, n long")
    merged = found.groupBy("model", "node", "column", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    of_column = Window.partitionBy("model", "node", "column")
    run = of_column.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    gone = lambda c: F.sum(F.when(F.col("bin") == MISSING, F.col(c)).otherwise(0)).over(of_column)
    seen = lambda c: F.sum(F.when(F.col("bin") > MISSING, F.col(c)).otherwise(0)).over(run)
    cuts = merged.select("*", F.sum("g").over(of_column).alias("all_g"), F.sum("n").over(of_column).alias("all_n"), gone("g").alias("gone_g"), gone("n").alias("gone_n"), seen("g").alias("left_g"), seen("n").alias("left_n")).where(F.col("bin") > MISSING)
    ways = F.explode(F.array(*[F.struct(F.lit(side).alias("missing_left"), (F.col("left_g") + F.lit(int(side)) * F.col("gone_g")).alias("g"), (F.col("left_n") + F.lit(int(side)) * F.col("gone_n")).alias("n")) for side in (False, True)])).alias("w")
    score = lambda g, n: g * g / (n + l2)
    tried = cuts.select("model", "node", "column", "bin", "all_g", "all_n", ways)
    right_g, right_n = F.col("all_g") - F.col("w.g"), F.col("all_n") - F.col("w.n")
    tried = tried.where((F.col("w.n") >= least) & (right_n >= least)).withColumn("gain", score(F.col("w.g"), F.col("w.n")) + score(right_g, right_n) - score(F.col("all_g"), F.col("all_n")))
    best = F.max_by(F.struct("column", "bin", "w.missing_left", "gain"), F.struct(F.round("gain", 9), -F.col("column"), -F.col("bin"), F.col("w.missing_left"))).alias("s")
    return tried.where(F.col("gain") > 1e-9).groupBy("model", "node").agg(best).select("model", "node", "s.*").collect()


def _leaf_values(table: DataFrame, model: Boosted, names: list[str], done: int, trees: list[Tree]) -> None:
    """Sets each leaf to the quantile of its residuals, by a sketch that merges."""
    width, count = len(model.columns), len(model.models)
    of = [names.index(t) for t, _ in model.models]

    def residuals(batches):
        for b, y, p in batches:
            left = y[:, of] - p - model.grown(b, done)
            for m, tree in enumerate(trees):
                known = np.flatnonzero(~np.isnan(left[:, m]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), m)), pa.array(tree.node_of(b)[known]), pa.array(left[known, m])], ["model", "leaf", "x"])

    found = table.mapInArrow(_state(table, width, count, len(names), residuals), "model long, leaf long, x double")
    shares = sorted({q for _, q in model.models})
    for r in found.groupBy("model", "leaf").agg(F.percentile_approx("x", shares, 20000).alias("q")).collect():  # a row a leaf
        trees[r["model"]].value[r["leaf"]] = float(r["q"][shares.index(model.models[r["model"]][1])])


def fit(train: DataFrame, columns: list[str], targets: list[str], shares: tuple[float, ...], rounds: int = 200, rate: float = 0.05, leaves: int = 31, bins: int = 255, l2: float = 1.0, least: int = 20, keep_every: int = 8) -> Boosted | None:
    """A model for each target and share; rows without a target play no part in its models. None where a target has no rows."""
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in [*columns, *targets]])
    edges = rows.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), [i / bins for i in range(1, bins)], 20000).alias(c) for c in columns]).first()
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(t).alias("x")) for t in targets])).alias("y")).select("y.t", F.col("y").getField("x").alias("x"))
    ends = {r["t"]: list(r["q"]) for r in quantiles.exact(long, ["t"], "x", shares).collect()}
    if set(ends) != set(targets):
        return None
    models = tuple((t, q) for t in targets for q in shares)
    model = Boosted(tuple(columns), models, [np.unique(edges[c] or []) for c in columns], np.array([ends[t][shares.index(q)] for t, q in models]), rate)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, y = model.binned(_matrix(batch, columns)), _matrix(batch, targets)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), pa.array(list(y), pa.list_(pa.float64())), pa.array([model.base] * len(b), pa.list_(pa.float64()))], ["b", "y", "p"])

    schema = "b binary, y array<double>, p array<double>"
    table, done = stages.written(rows.mapInArrow(placed, schema), "boosting"), 0
    for turn in range(rounds):
        trees, open_leaves = [Tree() for _ in models], [[0] for _ in models]
        while any(open_leaves):
            found = _best_splits(table, model, targets, done, trees, open_leaves, bins, l2, least)
            open_leaves = [[] for _ in models]
            for r in sorted(found, key=lambda r: (-r["gain"], r["model"], r["node"])):
                if trees[r["model"]].leaves < leaves:
                    open_leaves[r["model"]] += trees[r["model"]].split(r["node"], r["column"], r["bin"], r["missing_left"])
            open_leaves = [held if tree.leaves < leaves else [] for tree, held in zip(trees, open_leaves, strict=True)]
        _leaf_values(table, model, targets, done, trees)
        model.trees.append(trees)
        if (turn + 1) % keep_every == 0 and turn + 1 < rounds:
            since = done

            def moved(batches, since=since):
                for b, y, p in batches:
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), pa.array(list(y), pa.list_(pa.float64())), pa.array(list(p + model.grown(b, since)), pa.list_(pa.float64()))], ["b", "y", "p"])

            table = stages.written(table.mapInArrow(_state(table, len(columns), len(models), len(targets), moved), schema), "boosting")
            done = turn + 1
    return model
