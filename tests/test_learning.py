"""Training tables and models against brute force on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspan.operators import curves, datasets, indicators, learning


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(9):
        for k in range(1, 31 + i):
            a, b = rng.normal(0, 1, 2)
            out.append((f"c{i}", k, float(a), None if k % 7 == 0 else float(b), 0.9 - 0.002 * k + 0.03 * a - 0.02 * b + float(rng.normal(0, 0.005))))
    return pd.DataFrame(out, columns=["cell", "k", "a", "b", "soh"])


@pytest.fixture(scope="module")
def df(spark, rows):
    df = spark.createDataFrame(rows, "cell string, k int, a double, b double, soh double")
    return df.withColumn("b", F.when(~F.isnan("b"), F.col("b"))).persist()


def folds_of(sizes, n):
    load, out = [0] * n, {}
    for name, size in sorted(sizes.items(), key=lambda v: (-v[1], v[0])):
        f = load.index(min(load))
        load[f] += size
        out[name] = f
    return out


def test_dealing_equals_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        sizes = {f"g{i:03d}": int(rng.choice([1, 1, 2, 3, 7, 50])) for i in range(int(rng.integers(n, 60)))}
        want, load, got = folds_of(sizes, n), [0] * n, {}
        for size in sorted(set(sizes.values()), reverse=True):
            names = sorted(k for k, v in sizes.items() if v == size)
            segments = learning._dealt(load, size, len(names))
            for (at, turn), end in zip(segments, [*(s[0] for s in segments[1:]), len(names)], strict=True):
                for i in range(at, end):
                    got[names[i]] = turn[(i - at) % len(turn)]
        assert got == want


def test_group_folds(df, rows):
    got = {r["cell"]: r["fold"] for r in learning.group_folds(df, 4).collect()}
    assert got == folds_of(rows.groupby("cell").size().to_dict(), 4)


def ridge(x, y, alpha):
    m, s, my, sy = x.mean(0), x.std(0), y.mean(), y.std()
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - my))
    return lambda q: my + (q - m) / s @ w


def test_grouped_cv_with_gaps(df, rows):
    folds = folds_of(rows.groupby("cell").size().to_dict(), 5)
    d = rows.assign(fold=rows.cell.map(folds))
    want = {}
    for f in range(5):
        filled = d.assign(b=d.b.fillna(d[d.fold != f].b.dropna().round(4).median()))  # the training rows' median, for all rows
        rest, own = filled[filled.fold != f], filled[filled.fold == f]
        p = ridge(rest[["a", "b"]].to_numpy(), rest.soh.to_numpy(), 0.5)(own[["a", "b"]].to_numpy())
        want |= dict(zip(zip(own.cell, own.k, strict=True), p, strict=True))
    got = learning.grouped_cv(df, ["a", "b"], "soh", alpha=0.5).toPandas()
    assert len(got) == len(rows) and all(r.pred == pytest.approx(want[r.cell, r.k], abs=1e-9) for r in got.itertuples())
    assert 0.8 < learning.cv_summary(got_df(df, got), "soh").first()["coverage90"] <= 1


def test_held_out_values_teach_nothing(df, rows):
    """Other values in the held-out fold leave its model, and so what it predicts of like rows, as they were."""
    folds = folds_of(rows.groupby("cell").size().to_dict(), 5)
    cells = [c for c, f in folds.items() if f == 0]
    changed = df.withColumn("b", F.when(F.col("cell").isin(cells) & F.col("b").isNotNull(), 1000.0).otherwise(F.col("b")))
    own = F.col("cell").isin(cells) & (F.col("k") % 7 == 0)
    for cv in (lambda t: learning.grouped_cv(t, ["a", "b"], "soh", alpha=0.5), lambda t: learning.tuned_cv(t, ["a", "b"], "soh")):
        before, after = (sorted(map(tuple, cv(t).where(own).select("cell", "k", F.round("pred", 6)).collect())) for t in (df, changed))
        assert before == after and before
    fade = lambda t: t.select("cell", F.col("k").alias("k0"), "a", "b", F.col("soh").alias("target"), F.lit(1.0).alias("soh_now"), F.lit(1.0).alias("soh_future"), F.lit(25).alias("horizon"))
    one = F.col("cell") == "c3"
    changed = df.withColumn("b", F.when(one & F.col("b").isNotNull(), 1000.0).otherwise(F.col("b")))
    before, after = (sorted(map(tuple, learning.backtest(fade(t), ["a", "b"], alpha=0.5).where(one).join(t.where("b IS NULL").select("cell", F.col("k").alias("k0")), ["cell", "k0"]).select("k0", F.round("rate_pred", 6)).collect())) for t in (df, changed))
    assert before == after and before


def test_medians_of_all_others(spark):
    rng = np.random.default_rng(8)
    for turn in range(3):
        cells = rng.integers(0, 6, 60)
        table = pd.DataFrame({"cell": [f"c{i}" for i in cells], "a": rng.integers(0, 5 if turn else 10**6, 60).astype(float), "b": np.where(cells == 2, rng.normal(size=60), np.nan)})
        got = {r["cell"]: r["fill"] for r in learning.medians_without(spark.createDataFrame(table).replace(float("nan"), None), ["a", "b"], "cell").collect()}
        for c in table.cell.unique():
            rest = table[table.cell != c]
            assert got[c] == pytest.approx([rest.a.median(), rest.b.round(4).median() if rest.b.notna().any() else 0.0])


def got_df(df, pdf):
    return df.sparkSession.createDataFrame(pdf[["cell", "soh", "pred", "std"]])


def test_nested_tuning_takes_the_best_shape(df, rows):
    from cellspan.functions.numeric import bayesian_ridge

    def fit(t, shape):
        m, s, my, sy = t[["a", "b"]].mean().to_numpy(), t[["a", "b"]].std(ddof=0).to_numpy(), t.soh.mean(), t.soh.std(ddof=0)
        z, v = (t[["a", "b"]].to_numpy() - m) / s, (t.soh.to_numpy() - my) / sy
        w = bayesian_ridge(z.T @ z, z.T @ v, float(v @ v), len(t), shape)[0]
        return lambda q: my + (q[["a", "b"]].to_numpy() - m) / s @ w * sy

    filled = lambda t, by: t.assign(b=t.b.fillna(by.b.dropna().round(4).median()))
    shapes = (1e-6, 200.0)  # far apart, so that the choice shows
    d = rows.assign(fold=rows.cell.map(folds_of(rows.groupby("cell").size().to_dict(), 5)))
    want, chosen = {}, {}
    for f in range(5):
        rest, own = d[d.fold != f], d[d.fold == f]
        inner = rest.cell.map(folds_of(rest.groupby("cell").size().to_dict(), 3))
        score = {a: 0.0 for a in shapes}
        for g in range(3):
            tr, te = rest[inner != g], rest[inner == g]
            for a in shapes:
                score[a] += np.sqrt(np.mean((fit(filled(tr, tr), a)(filled(te, tr)) - te.soh) ** 2))
        chosen[f] = min(shapes, key=score.get)
        want |= dict(zip(zip(own.cell, own.k, strict=True), fit(filled(rest, rest), chosen[f])(filled(own, rest)), strict=True))
    got = learning.tuned_cv(df, ["a", "b"], "soh", shapes=shapes).toPandas()
    assert dict(zip(got.fold, got["shape"], strict=True)) == chosen
    assert len(got) == len(rows) and all(r.pred == pytest.approx(want[r.cell, r.k], abs=1e-9) for r in got.itertuples())


def test_permutation_importance(df, rows):
    numbered = df.fillna({"b": 0.0}).withColumn("__id", F.monotonically_increasing_id()).persist()
    dealt = learning.dealt_anew(numbered, ["a", "b"], 3, bucket=50).toPandas()
    assert len(dealt) == 6 * len(rows) and dealt.groupby(["feature", "repeat"])[["cell"]].count().cell.eq(len(rows)).all()
    for _, part in dealt.groupby(["feature", "repeat"]):
        assert sorted(part.old) == sorted(part.new)
    a = dealt[dealt.feature == "a"]
    assert (a.old == a.new).mean() < 0.1 and len({tuple(p.sort_values("__id").new) for _, p in a.groupby("repeat")}) == 3
    got = {r["feature"]: r["increase"] for r in learning.permutation_importance(df, ["a", "b", "k"], "soh").collect()}
    assert got["a"] > got["b"] > 0 and got["a"] > 0.005


def test_importance_equals_predicting_anew(df, monkeypatch):
    kept = {}
    monkeypatch.setattr(learning, "dealt_anew", lambda t, x, n, real=learning.dealt_anew: kept.setdefault("rows", real(t, x, n).persist()))
    got = {r["feature"]: r["increase"] for r in learning.permutation_importance(df, ["a", "b"], "soh").collect()}
    moved = kept["rows"].toPandas()
    assert set(moved["repeat"]) == set(range(5)) and set(moved.fold) == {0}
    for c, part in moved.groupby("feature"):
        w, sd = np.array(part.w.iloc[0]), np.array(part.sd.iloc[0])
        i = ["a", "b"].index(c)
        rises = [np.sqrt(np.mean((p.soh - p.pred - w[i] / sd[i] * sd[2] * (p.new - p.old)) ** 2)) - np.sqrt(np.mean((p.soh - p.pred) ** 2)) for _, p in part.groupby("repeat")]
        assert got[c] == pytest.approx(np.mean(rises))


def test_gaussian_process(df):
    spread = df.agg(F.stddev_pop("soh")).first()[0]
    for rows in (learning.gaussian_process_cv(df, ["a", "b", "k"], "soh", n=2, most=100),):
        assert rows.count() == df.count() and rows.agg(F.sqrt(F.avg(F.pow(F.col("soh") - F.col("pred"), 2)))).first()[0] < spread


def test_regression_with_confounding(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 40)
    d = pd.DataFrame({"x": x, "near": x + rng.normal(0, 0.1, 40), "flat": 1.0, "fade_rate": 2 * x + rng.normal(0, 0.2, 40)})
    table, facts = learning.stress_regression(spark.createDataFrame(d), ["x", "near", "flat"])
    assert facts["n"] == 40 and facts["power"] == "adequate" and facts["confounding"] == [f"x ~ near (r={np.corrcoef(d.x, d.near)[0, 1]:+.2f})"] and table.confounded.all()
    z = np.column_stack([np.ones(40), (d.x - d.x.mean()) / d.x.std(ddof=0), (d.near - d.near.mean()) / d.near.std(ddof=0)])
    beta = np.linalg.lstsq(z, d.fade_rate, rcond=None)[0]
    res = d.fade_rate - z @ beta
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * (res @ res) / 37)
    assert table.coef.tolist() == pytest.approx(beta[1:].tolist(), rel=1e-5) and table.se.tolist() == pytest.approx(se[1:].tolist(), rel=1e-4)
    assert learning.stress_regression(spark.createDataFrame(d.head(3)), ["x", "near"])[1]["power"] == "not estimable"


def test_pca_tells_health(df):
    scores, loadings, shares, corr = learning.pca(df, ["a", "b"], against="soh")
    assert shares.sum() == pytest.approx(1) and abs(corr) > 0.3 and scores.count() == df.dropna().count() and loadings.shape == (2, 2)


def test_relative_and_even_rows(spark):
    d = spark.createDataFrame([("a", k, v) for k, v in enumerate([None, 2.0, 4.0, None, 6.0, 8.0])] + [("b", 0, None)], "cell string, k int, x double")
    got = {(r["cell"], r["k"]): r["x"] for r in datasets.relative(d, ["x"]).collect()}
    assert got == {("a", 0): None, ("a", 1): 0.5, ("a", 2): 1.0, ("a", 3): None, ("a", 4): 1.5, ("a", 5): 2.0, ("b", 0): None}
    assert sorted(r["k"] for r in datasets.evenly(d.where("cell = 'a'"), 3).collect()) == [0, 2, 5]
    assert [r["k"] for r in datasets.of_cell(d, "a", [1, 4]).orderBy("k").collect()] == [1, 4]


def test_population_prior_falls_back(spark):
    d = spark.createDataFrame([("a", k, 1.0 - 0.001 * k) for k in range(20)], "cell string, k int, soh double")
    r = datasets.population_prior(d).first()
    assert (r["n_cells"], r["mu1"]) == (1, -0.12) and r["cov00"] == pytest.approx(1e-4)


def test_median_slope_of_long_and_short_histories(spark):
    rng = np.random.default_rng(8)
    rows = [("long", float(k), float(-0.01 * k + rng.normal(0, 0.3))) for k in range(700)] + [("even", float(k), float(v)) for k, v in enumerate(rng.normal(0, 1, 12))] + [("flat", float(k), 1.0) for k in range(11)] + [("few", 0.0, 1.0), ("few", 1.0, 2.0), ("ties", 0.0, 5.0)] + [("ties", 1.0, float(k)) for k in range(10)]
    got = {r["cell"]: r["slope"] for r in indicators.theil_sen(spark.createDataFrame(rows, "cell string, k double, cap double"), block=64).collect()}
    for cell in ("long", "even", "flat", "ties"):
        x, y = (np.array([r[i] for r in rows if r[0] == cell]) for i in (1, 2))
        i, j = np.nonzero(x[None, :] > x[:, None])
        assert got[cell] == pytest.approx(float(np.median((y[j] - y[i]) / (x[j] - x[i]))), abs=1e-12)
    assert got["few"] is None


def test_indicator_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(8):
        m = (3, 7, 8, 30, 40, 25, 50, 33)[i]
        for k in range(1, m + 1):
            noise = rng.normal(0, 0.3, 2)
            rows.append((f"c{i}", k, 1 + k / 20 + float(noise[0]) if rng.random() > 0.1 else None, 5.0 if i in (3, 4) else 2 - k / 30 + float(noise[1]), 1.0 if i == 5 and k < 10 else None))
    pdf = pd.DataFrame(rows, columns=["cell", "k", "a", "b", "rare"])
    got = {r["hi"]: r for r in indicators.scores(spark.createDataFrame(rows, "cell string, k int, a double, b double, rare double"), ["a", "b", "rare"]).collect()}
    assert set(got) == {"a", "b"}
    for c in ("a", "b"):
        mono, trend, first, last = [], [], [], []
        for _, g in pdf.groupby("cell"):
            g = g.dropna(subset=[c])
            if len(g) < 8 or g[c].nunique() < 2:
                continue
            s = g[c].rolling(5, center=True, min_periods=1).median().to_numpy()
            mono.append(abs(np.sign(np.diff(s)).sum()) / (len(s) - 1))
            trend.append(abs(np.corrcoef(g.k.rank(), g[c].rank())[0, 1]))
            first.append(s[:3].mean())
            last.append(s[-3:].mean())
        prog = np.exp(-np.std(last) / (np.mean(np.abs(np.subtract(last, first))) + 1e-12))
        want = (len(mono), np.mean(mono), np.mean(trend), prog, np.mean([np.mean(mono), np.mean(trend), prog]))
        assert tuple(got[c])[1:] == pytest.approx(want)


def test_long_curves_are_resampled(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c, m in ((1, 300), (2, 61), (3, 60), (4, 7)):
        t = np.cumsum(rng.uniform(0.5, 30, m))
        i = np.where(rng.random(m) < 0.2, 0.0, -rng.uniform(0.2, 2, m))
        i[:2] = i[-1:] = 0.0
        rows += [("B0001", c, "discharge", float(a), float(4.2 - 0.001 * a), float(b)) for a, b in zip(t, i, strict=True)]
    got = curves.curves(spark.createDataFrame(rows, "Cell_ID string, Cycle_Index long, Cycle_Type string, Time_s double, Voltage_V double, Current_A double")).collect()
    assert len(got) == 4 or sum(r[1] == 4 and r[5] != 0 for r in rows) < 5
    for r in got:
        t, v, i = (np.array([x[k] for x in rows if x[1] == r["Cycle_Index"]]) for k in (3, 4, 5))
        on = np.flatnonzero(np.abs(i) > 0.1)
        t, v, i = (x[on[0] : on[-1] + 1] for x in (t, v, i))
        a = np.abs(i)
        q = np.concatenate([[0], np.cumsum(np.diff(t) * (a[1:] + a[:-1]) / 2 / 3600)])
        if len(t) > 60:
            g = np.linspace(t[0], t[-1], 60)
            t, v, i, q = g, np.interp(g, t, v), np.interp(g, t, i), np.interp(g, t, q)
        for c, want in (("t", t - t[0]), ("v", v), ("i", np.abs(i)), ("q", q)):
            np.testing.assert_allclose(r[c], want, atol=1e-9)


def test_delta_qv_refers_to_the_third_good_cycle(spark):
    v = np.linspace(4.1, 3.0, 50)
    listed = [("a", c, v.tolist(), (np.linspace(0, 1, 50) * (2 - 0.1 * c)).tolist()) for c in range(1, 7)]
    df = spark.createDataFrame(listed, "Cell_ID string, Cycle_Index long, v array<double>, q array<double>")
    good = df.where("Cycle_Index <> 2")
    got = {r["Cycle_Index"]: r["dq_mean"] for r in curves.delta_qv(df, good).collect()}
    assert set(got) == {1, 3, 4, 5, 6} and got[4] == pytest.approx(0) and got[1] > 0 > got[6]
