"""Boosting over histograms against plain boosting on sorted values, its search against a search one by one, and its error."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspan.operators import boosting, datasets, learning

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 260
    a, b, c = rng.normal(size=n), rng.uniform(size=n).round(1), rng.normal(size=n)
    y = np.sin(2 * a) + (b > 0.5) * a + rng.normal(0, 0.1, n)
    c[rng.random(n) < 0.2] = np.nan
    return pd.DataFrame({"cell": [f"c{i:02d}" for i in rng.integers(0, 13, n)], "a": a, "b": b, "c": c, "y": y})


def plain(x, y, test, rate, leaves, rounds, least):
    """Least-squares boosting, leaves best first, cuts half-way between neighbouring values of all training rows."""
    grids = [(np.unique(v)[1:] + np.unique(v)[:-1]) / 2 for v in x.T]
    score, out = np.full(len(y), y.mean()), np.full(len(test), y.mean())
    for _ in range(rounds):
        r = y - score

        def best(rows, r=r):
            found = (0.0, None, None)
            for j, grid in enumerate(grids):
                for cut in grid:
                    low = rows[x[rows, j] <= cut]
                    high = rows[x[rows, j] > cut]
                    if min(len(low), len(high)) >= least:
                        gain = r[low].sum() ** 2 / len(low) + r[high].sum() ** 2 / len(high) - r[rows].sum() ** 2 / len(rows)
                        if gain > found[0] + 1e-9:
                            found = (gain, j, cut)
            return found

        parts = [(np.arange(len(y)), np.arange(len(test)))]
        splits = [best(parts[0][0])]
        while len(parts) < leaves and max(s[0] for s in splits) > 0:
            i = int(np.argmax([s[0] for s in splits]))
            (rows, held), (_, j, cut) = parts.pop(i), splits.pop(i)
            for side in (0, 1):
                parts.append((rows[(x[rows, j] > cut) == side], held[(test[held, j] > cut) == side]))
                splits.append(best(parts[-1][0]))
        for rows, held in parts:
            step = rate * r[rows].mean()
            score[rows] += step
            out[held] += step
    return out


def filled(train, test):
    medians = train[X].round(learning.ROUND).median()
    return train[X].fillna(medians).to_numpy(), test[X].fillna(medians).to_numpy()


def test_equals_plain_boosting(spark, table):
    df = spark.createDataFrame(table).repartition(5)
    got = boosting.boosted_cv(df, X, "y", n=3, rate=0.3, leaves=6, rounds=12, least=8).toPandas()
    assert len(got) == len(table) and got.fold.nunique() == 3
    for f in range(3):
        train, test = got[got.fold != f], got[got.fold == f]
        x, held = filled(train, test)
        want = plain(x, train.y.to_numpy(), held, 0.3, 6, 12, 8)
        assert np.abs(test.pred - want).max() < 1e-4
    again = boosting.boosted_cv(df.repartition(2, "a"), X, "y", n=3, rate=0.3, leaves=6, rounds=12, least=8).toPandas()
    key = ["cell", "a", "b", "y"]
    assert (got.sort_values(key).pred.to_numpy() == again.sort_values(key).pred.to_numpy()).all()


def test_search_equals_one_by_one(spark, table):
    df = spark.createDataFrame(table)
    grid = ((0.02, 2), (0.3, 5))
    got = boosting.boosted_cv(df, X, "y", n=3, rounds=8, least=8, tune=True, grid=grid).toPandas()
    d = learning.folded(df, 3)
    inner = learning.inner_folds(d.persist()).toPandas()
    for f in range(3):
        train, test = got[got.fold != f], got[got.fold == f]
        part = train.merge(inner[inner.outer == f], on="cell")
        errors = []
        for rate, leaves in grid:
            one = []
            for g in range(3):
                a, b = part[part.inner != g], part[part.inner == g]
                x, held = filled(a, b)
                one.append(np.sqrt(np.mean((plain(x, a.y.to_numpy(), held, rate, leaves, 8, 8) - b.y) ** 2)))
            errors.append(np.mean(one))
        rate, leaves = grid[int(np.argmin(errors))]
        assert set(zip(test.rate, test.leaves, strict=True)) == {(rate, leaves)}
        x, held = filled(train, test)
        assert np.abs(test.pred - plain(x, train.y.to_numpy(), held, rate, leaves, 8, 8)).max() < 1e-4


def test_fade_of_held_out_cells(spark):
    rng, rows = np.random.default_rng(11), []
    for i in range(10):
        loss, current = float(rng.uniform(0.0008, 0.0025)), float(rng.choice([1.0, 2.0, 4.0]))
        for k in range(1, 121):
            soh = 1 - loss * k * (1 + 0.1 * current) + float(rng.normal(0, 0.002))
            rows.append((f"c{i}", "g", k, soh, False, current, 24.0, 0.05 + 0.1 * (1 - soh), 0.08))
    table = spark.createDataFrame(rows, "cell string, grp string, k int, soh double, outlier boolean, I_mean double, ambient double, R0 double, Rct_ohm double")
    got = boosting.boosted_cv(datasets.fade_dataset(table), list(datasets.FADE_FEATURES), "target", rounds=40)
    error = got.agg(F.sqrt(F.avg((F.col("soh_now") - F.col("pred") * F.col("horizon") / 100 - F.col("soh_future")) ** 2))).first()[0]
    assert error < 0.06


def test_more_values_than_bins(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"cell": [f"c{i % 6}" for i in range(3000)], "a": x, "y": np.where(x > 0.3, 2.0, -1.0)}))
    got = boosting.boosted_cv(df, ["a"], "y", n=2, rounds=30, rate=0.3, leaves=4).toPandas()
    assert np.sqrt(np.mean((got.pred - got.y) ** 2)) < 0.2


def test_few_rows(spark):
    empty = spark.createDataFrame([], "cell string, a double, y double")
    assert boosting.boosted_cv(empty, ["a"], "y").count() == 0
    one = spark.createDataFrame([("a", None, 1.0), ("a", 2.0, 3.0), ("b", 2.0, None), ("c", 2.0, float("nan"))], empty.schema)
    assert {r["pred"] for r in boosting.boosted_cv(one, ["a"], "y", rounds=2).collect()} == {None}
    two = spark.createDataFrame([("a", None, 1.0), ("b", float("nan"), 3.0)], empty.schema)
    assert {r["cell"]: r["pred"] for r in boosting.boosted_cv(two, ["a"], "y", rounds=2, tune=True).collect()} == {"a": 3.0, "b": 1.0}
