"""Extremely randomised trees against a plain recursion over the same drawn thresholds, and their error on held-out cells."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspan.operators import trees


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(12):
        fade, warm = rng.uniform(0.001, 0.003), rng.uniform(0, 1)
        for k in range(1, 81):
            soh = 1 - fade * k
            rows.append((f"c{i:02d}", float(k), 1 + 2 * (1 - soh) + rng.normal(0, 0.02), warm + rng.normal(0, 0.05), None if k % 9 == 0 else 3.5 + 0.5 * soh + rng.normal(0, 0.01), soh))
    return pd.DataFrame(rows, columns=["cell", "k", "R0", "T_rise", "V_mean", "soh"])


X = ["k", "R0", "T_rise", "V_mean"]


def test_held_out_cells(spark, table):
    got = trees.tree_cv(spark.createDataFrame(table).replace(float("nan"), None), X, "soh").toPandas()
    assert len(got) == len(table) and got.pred.notna().all()
    assert np.sqrt(np.mean((got.pred - got.soh) ** 2)) < 0.03 < table.soh.std()


def test_every_split_is_the_best_of_those_drawn(spark, table):
    data = spark.createDataFrame(table.assign(fold=pd.factorize(table.cell)[0] % 3)).repartition(5)
    data = data.withColumns({c: F.nanvl(c, F.lit(None)) for c in X}).persist()
    fills = {f: [1.0, 2.0, 0.5, 3.7] for f in range(3)}
    seen = []
    real = np.random.default_rng

    class Kept:
        def __init__(self, seed):
            self.rng = real(seed)

        def random(self, shape):
            seen.append(self.rng.random(shape))
            return seen[-1]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(trees.np.random, "default_rng", Kept)
        forest = trees.extra_trees(data, X, "soh", fills, trees=4, depth=3, least=5)
    pdf = data.toPandas()
    low, high = pdf[X].min().to_numpy(), pdf[X].max().to_numpy()
    for t, f in enumerate(forest.fold):
        part = pdf[pdf.fold != f]
        x, y = trees.filled(part[X].to_numpy(float), fills[f]), part.soh.to_numpy()

        def check(node, level, rows, lo, hi, t=t, x=x, y=y):
            assert forest.value[t, node] == pytest.approx(y[rows].mean())
            if level == 3:
                return
            cuts = lo + seen[level][t, node - (1 << level) + 1] * (hi - lo)
            gains = {}
            for j, c in enumerate(cuts):
                side = x[rows, j] <= c
                if min(side.sum(), (~side).sum()) >= 5:
                    gains[j] = y[rows].var() * len(rows) - sum(y[rows][s].var() * s.sum() for s in (side, ~side))
            if not gains or max(gains.values()) <= 1e-12:
                assert forest.feature[t, node] == -1
                return
            j = forest.feature[t, node]
            assert gains[j] == pytest.approx(max(gains.values())) and forest.threshold[t, node] == pytest.approx(cuts[j])
            side = x[rows, j] <= cuts[j]
            for child, s, bound in ((2 * node + 1, side, (lo, np.where(np.arange(4) == j, cuts[j], hi))), (2 * node + 2, ~side, (np.where(np.arange(4) == j, cuts[j], lo), hi))):
                check(child, level + 1, rows[s], *bound)

        check(0, 0, np.arange(len(x)), low, high)


def test_few_rows(spark):
    empty = spark.createDataFrame([], "cell string, a double, y double")
    assert trees.tree_cv(empty, ["a"], "y").count() == 0
    one = spark.createDataFrame([("a", None, 1.0), ("a", 2.0, 3.0), ("b", 2.0, None)], empty.schema)
    assert len(trees.tree_cv(one, ["a"], "y", trees=3).collect()) == 2
    two = trees.tree_cv(spark.createDataFrame([("a", None, 1.0), ("b", float("nan"), 3.0)], empty.schema), ["a"], "y", trees=3).collect()
    assert {r["cell"]: r["pred"] for r in two} == {"a": 3.0, "b": 1.0}


def test_sums_of_sides_by_patterns_equal_plain_sums():
    """Also with more features than a pattern has bits, rows that rest in leaves above, and no thresholds at the last level."""
    rng = np.random.default_rng(4)
    x = [f"x{i}" for i in range(12)]
    pdf = pd.DataFrame(rng.random((500, 12)), columns=x).assign(y=rng.normal(size=500), fold=rng.integers(0, 2, 500))
    forest = trees.Forest(np.array([0, 1]), np.full((2, 31), -1, np.int16), np.zeros((2, 31)), np.zeros((2, 31)))
    forest.feature[:, [0, 1, 2, 4, 5, 9]] = rng.integers(0, 12, (2, 6))
    forest.threshold[:] = rng.random((2, 31))
    fills = {0: [0.5] * 12, 1: [0.5] * 12}
    drawn = rng.random((2, 8, 12))
    got = trees.side_sums(iter([pdf[:200], pdf[200:]]), x, "y", forest, fills, drawn, 3)
    last = trees.side_sums(iter([pdf]), x, "y", forest, fills, None, 3)
    assert last.shape == (2, 8, 2) and np.allclose(last, got[:, :, :2])
    want = np.zeros((2, 8, 26))
    for t in (0, 1):
        for row in pdf[pdf.fold != t].itertuples():
            v, at = np.array(row[1:13]), 0
            for _ in range(3):
                if forest.feature[t, at] >= 0:
                    at = 2 * at + 1 + int(v[forest.feature[t, at]] > forest.threshold[t, at])
            if at >= 7:
                low = v <= drawn[t, at - 7]
                want[t, at - 7] += np.concatenate([[1, row.y], low, low * row.y])
    assert np.allclose(got, want)
