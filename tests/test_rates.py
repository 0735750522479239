"""Rate normalisation against plain reweighted least squares by cell, short and long cells alike."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspan.operators import rates

COLUMNS = ["cell", "k", "cap", "I_mean", "ambient", "outlier"]


def plain(pdf: pd.DataFrame, rounds: int = 20):
    """Capacity at reference and facts of one cell: dense design, direct least squares."""
    k, cap = pdf["k"].to_numpy(float), pdf["cap"].to_numpy(float)
    level_i, level_t = np.rint(pdf["I_mean"].to_numpy(float) / 0.5) * 0.5, np.rint(pdf["ambient"].to_numpy(float))
    with np.errstate(invalid="ignore"):
        ok = ~pdf["outlier"].to_numpy(bool) & (cap > 0) & ~np.isnan(level_i)
    count = lambda v: {x: int((v[ok] == x).sum()) for x in sorted(set(v[ok])) if not math.isnan(x)}
    n_i, n_t = count(level_i), count(level_t)
    i_ref = 2.0 if 2.0 in n_i or not n_i else max(n_i, key=lambda x: (n_i[x], -x))
    t_ref = max(n_t, key=lambda x: (n_t[x], -x)) if n_t else 24.0
    effects = [("I", x) for x in n_i if n_i[x] >= 5 and x != i_ref] + [("T", x) for x in n_t if n_t[x] >= 5 and x != t_ref]
    if not effects or ok.sum() < 10:
        return cap, False, i_ref, t_ref, 0.0
    dummies = np.stack([(level_i if kind == "I" else level_t) == x for kind, x in effects], 1).astype(float)
    z = (k[ok] - k[ok].min()) / max(np.ptp(k[ok]), 1)
    design = np.column_stack([np.ones_like(z), z] + [np.clip(z - q, 0, None) for q in np.quantile(z, (0.2, 0.4, 0.6, 0.8))] + [dummies[ok]])
    y, w = np.log(cap[ok]), np.ones(ok.sum())
    for _ in range(rounds + 1):
        b = np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        r = y - design @ b
        cut = 1.345 * (1.4826 * np.median(np.abs(r - np.median(r))) + 1e-9)
        w = np.where(np.abs(r) <= cut, 1, cut / np.maximum(np.abs(r), cut))
    b = b[6:]
    d = [(x - i_ref, v) for (kind, x), v in zip(effects, b, strict=True) if kind == "I"]
    return cap * np.exp(-dummies @ b), True, i_ref, t_ref, sum(x * v for x, v in d) / sum(x * x for x, _ in d) if d else 0.0


def cells(rng, n, sizes=(1, 150)):
    out = []
    for c in range(n):
        m = int(rng.integers(*sizes))
        k = np.sort(rng.choice(np.arange(1, 4 * m + 2), m, replace=False))
        current = rng.choice([1.0, 2.0, 4.0, 2.24, 3.0][: rng.integers(1, 6)] if c % 3 else [1.0, 4.0], m) + rng.normal(0, 0.05, m)
        ambient = rng.choice([24.0, 4.0, 43.0][: rng.integers(1, 4)], m)
        cap = (1.9 - 0.5 * (k / k.max()) ** 2) * np.exp(-0.03 * (current - 2) + 0.001 * (ambient - 24)) + rng.normal(0, 0.004, m)
        cap[rng.random(m) < 0.05] *= 0.6
        pdf = pd.DataFrame({"cell": f"c{c}", "k": k, "cap": cap, "I_mean": current, "ambient": ambient, "outlier": rng.random(m) < 0.03})
        for column, share in (("cap", 0.02), ("I_mean", 0.03), ("ambient", 0.03)):
            pdf.loc[rng.random(m) < share, column] = np.nan
        out.append(pdf)
    return pd.concat(out)


@pytest.mark.parametrize("n, block, sizes, rounds", [(200, rates.BLOCK, (1, 150), 20), (3, 64, (150, 250), 3)])
def test_equals_direct_fits(spark, n, block, sizes, rounds):
    data = cells(np.random.default_rng(n), n, sizes)
    got = rates.normalise_rate(spark.createDataFrame(data).withColumn("salt", F.lit("x")), block=block, rounds=rounds).toPandas()
    assert len(got) == len(data) and "salt" in got
    for cell, pdf in data.groupby("cell"):
        own = got[got["cell"] == cell].sort_values("k")
        cap, done, i_ref, t_ref, coef = plain(pdf.sort_values("k"), rounds)
        assert (own["normalised"] == done).all() and (own["i_ref"] == i_ref).all() and (own["t_ref"] == t_ref).all()
        np.testing.assert_allclose(own["cap_norm"].to_numpy(float), cap, rtol=2e-6)
        assert own["rate_coef"].iloc[0] == pytest.approx(coef, abs=2e-6)


def test_known_truth(spark):
    k = np.arange(1, 151)
    current = np.array([(2.0, 4.0, 1.0)[(i - 1) // 8 % 3] for i in k])
    true = 1.9 - 0.002 * k
    cap = true * np.exp(np.select([current == 4, current == 1], [-0.07, 0.01], 0.0)) + np.random.default_rng(1).normal(0, 0.003, 150)
    got = rates.normalise_rate(spark.createDataFrame(pd.DataFrame({"cell": "a", "k": k, "cap": cap, "I_mean": current, "ambient": 24.0, "outlier": False}))).toPandas().sort_values("k")
    assert got["normalised"].all() and set(got["offsets"].iloc[0]) == {"I=1", "I=4"}
    assert np.sqrt(np.mean((got["cap_norm"] - true) ** 2)) < 0.006 < 0.05 < np.sqrt(np.mean((cap - true) ** 2))


def test_order_statistics(spark):
    rng = np.random.default_rng(4)
    values = {"a": np.round(rng.normal(size=5000), 2), "b": rng.lognormal(sigma=4, size=3000), "c": np.zeros(7), "d": np.array([5.0])}
    df = spark.createDataFrame([(c, float(x)) for c, v in values.items() for x in v], "cell string, v double")
    ranks = [(c, j, int(r)) for c, v in values.items() for j, r in enumerate({0, len(v) // 3, len(v) // 2, len(v) - 1})]
    got = {(r["cell"], r["which"]): r["value"] for r in rates.order_statistics(df, spark.createDataFrame(ranks, "cell string, which int, rank long")).collect()}
    assert len(got) == len(ranks)
    for c, j, rank in ranks:
        assert got[c, j] == pytest.approx(np.sort(values[c])[rank], rel=1e-9, abs=np.ptp(values[c]) / rates.BINS**3)


def test_empty(spark):
    df = spark.createDataFrame([], "cell string, k long, cap double, I_mean double, ambient double, outlier boolean")
    assert rates.normalise_rate(df).count() == 0
    one = spark.createDataFrame([(None, 1, None, None, None, None), ("a", 1, float("nan"), 2.0, 24.0, False)], df.schema)
    assert sorted(r["normalised"] is True for r in rates.normalise_rate(one).collect()) == [False, False]


def test_short_cells_are_fitted_together(monkeypatch):
    rng = np.random.default_rng(8)
    cells = []
    for c in range(300):
        n = int(rng.integers(12, 90))
        level = rng.choice([1.0, 2.0, 4.0][: 2 + c % 2], n)
        cells.append((np.sort(rng.choice(np.arange(500.0), n, replace=False)), rng.normal(size=n), level, np.where(rng.random(n) < 0.1, np.nan, 24.0), [("I", 1.0), ("I", 4.0)][: 1 + c % 2]))
    calls, inverse = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda *a, **b: calls.append(1) or inverse(*a, **b))
    together = rates._gathered(cells, 5)
    assert len(calls) < 30  # not a call for each cell and round
    for got, c in zip(together, cells, strict=True):
        np.testing.assert_allclose(got, rates._gathered([c], 5)[0], rtol=1e-8, atol=1e-10)
