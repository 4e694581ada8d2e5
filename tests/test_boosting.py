"""Boosted quantile trees against a plain version on one machine."""

import numpy as np
import pytest

from barloom.operators import boosting

SHARES = (0.1, 0.5, 0.9)


def table(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4))
    x[rng.random((n, 4)) < 0.1] = np.nan
    y = np.where(np.isnan(x[:, 0]), 2.0, np.abs(np.nan_to_num(x[:, 0]))) + 0.5 * np.nan_to_num(x[:, 1]) + (0.2 + (np.nan_to_num(x[:, 2]) > 0)) * rng.standard_normal(n) * 0.3
    return x, y


def frame(spark, x, y, gaps=False):
    rows = [(*[None if np.isnan(v) else float(v) for v in r], None if gaps and i % 9 == 0 else float(t), float(-t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, z double").repartition(3)


def pinball(y, p, q):
    return float(np.mean(np.maximum(q * (y - p), (q - 1) * (y - p))))


def plain_tree(bins, g, leaves, l2, least):
    """The leaf of each row, split by level and gain, by brute force over all cuts."""
    tree, at = boosting.Tree(), np.zeros(len(bins), int)
    open_leaves = [0]
    while open_leaves:
        found = []
        for leaf in open_leaves:
            rows = at == leaf
            score = lambda s: g[s].sum() ** 2 / (s.sum() + l2)
            best = None
            for c in range(bins.shape[1]):
                for cut in np.unique(bins[rows, c]):
                    for side in (False, True):
                        left = rows & np.where(bins[:, c] == 0, side, bins[:, c] <= cut)
                        right = rows & ~left
                        if cut and left.sum() >= least and right.sum() >= least:
                            key = (round(score(left) + score(right) - score(rows), 9), -c, -int(cut), side)
                            best = max(best, key) if best else key
            if best and best[0] > 1e-9:
                found.append((-best[0], leaf, -best[1], -best[2], best[3]))
        open_leaves = []
        for _, leaf, c, cut, side in sorted(found):
            if tree.leaves < leaves:
                open_leaves += tree.split(leaf, c, cut, side)
        at = tree.node_of(bins)
        if tree.leaves >= leaves:
            break
    return at


def test_trees_equal_plain_ones(spark):
    x, y = table(400, 1)
    got = boosting.fit(frame(spark, x, y), ["a", "b", "c", "d"], ["y"], SHARES, rounds=2, rate=0.3, leaves=6, bins=12, least=15)
    bins = got.binned(x)
    for m, q in enumerate(SHARES):
        assert got.base[m] == pytest.approx(np.quantile(y, q))
        p = np.full(len(y), got.base[m])
        for trees in got.trees:
            leaf = plain_tree(bins, np.where(p >= y, 1 - q, -q), 6, 1.0, 15)
            assert (trees[m].node_of(bins) == leaf).all() and 2 <= trees[m].leaves <= 6
            for one in np.unique(leaf):
                left = np.sort((y - p)[leaf == one])
                assert np.abs(left - trees[m].value[one]).min() < 1e-9 and abs(np.searchsorted(left, trees[m].value[one] - 1e-9) - q * len(left)) <= 1.01
            p = p + 0.3 * np.array(trees[m].value)[leaf]


def test_forecasts_of_other_rows(spark):
    """Less loss than constants by far, nominal coverage, targets with gaps, and predictions kept between trees."""
    x, y = table(3000, 2)
    fit = boosting.fit(frame(spark, x, y, gaps=True), ["a", "b", "c", "d"], ["y", "z"], SHARES, rounds=12, rate=0.3, leaves=8, bins=32, keep_every=5)
    x2, y2 = table(1500, 3)
    rows = fit.predict(frame(spark, x2, y2)).collect()
    truth = np.array([[r.y] * 3 + [r.z] * 3 for r in rows])
    made = np.array([r.predicted for r in rows])
    for m, (_, q) in enumerate(fit.models):
        assert pinball(truth[:, m], made[:, m], q) < 0.6 * pinball(truth[:, m], fit.base[m], q)
    assert 0.7 < np.mean((truth[:, 0] >= made[:, 0]) & (truth[:, 0] <= made[:, 2])) < 0.9
    assert boosting.fit(frame(spark, x, y).where("false"), ["a"], ["y"], (0.5,)) is None
