"""Greedy choice of columns against plain loops over rows with gaps."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspan.functions.numeric import bayesian_ridge
from cellspan.operators import selection

COLUMNS = ["a", "b", "c", "flat", "rare"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for i in range(9):
        for k in range(20 + 3 * i):
            a, b, c = rng.normal(1, 1, 3)
            y = 0.9 + 0.03 * a - 0.02 * b + 0.004 * c + float(rng.normal(0, 0.004))
            gaps = np.nan if k % 7 == 0 else b, np.nan if i == 2 or k % 5 == 1 else c, 3.0 if i < 8 else 3.5, c if k % 9 == 0 else np.nan
            out.append((f"c{i}", a, *gaps, np.nan if k == 11 else y))
    return pd.DataFrame(out, columns=["cell", *COLUMNS, "soh"])


@pytest.fixture(scope="module")
def df(spark, rows):
    nulls = rows.astype(object).where(rows.notna(), None)
    odd = [(None, 1.0, 1.0, 1.0, 1.0, 1.0, 0.9), ("c0", 1.0, float("nan"), None, None, None, None)]
    schema = "cell string, " + ", ".join(f"{c} double" for c in (*COLUMNS, "soh"))
    return spark.createDataFrame([*map(tuple, nulls.to_numpy().tolist()), *odd], schema).repartition(5).persist()


def left_out(rows, columns, alpha=1e-3):
    d = rows[["cell", "soh", *columns]].dropna()
    errors = []
    for cell in d.cell.unique():
        x, y = d[d.cell != cell][columns].to_numpy(), d[d.cell != cell].soh.to_numpy()
        m, sd = x.mean(0), x.std(0) + 1e-12
        full = np.column_stack([np.ones(len(x)), (x - m) / sd])
        beta = np.linalg.solve(full.T @ full + alpha * np.eye(full.shape[1]), full.T @ y)
        own = d[d.cell == cell]
        errors.append(np.sqrt(np.mean((beta[0] + (own[columns].to_numpy() - m) / sd @ beta[1:] - own.soh.to_numpy()) ** 2)))
    return float(np.mean(errors)) if len(errors) >= 3 else None


def held_out(rows, columns, n=5):
    d = rows[["cell", "soh", *columns]].dropna()
    sizes = d.groupby("cell").size()
    if len(sizes) < 3:
        return None
    load, fold = [0] * min(n, len(sizes)), {}
    for cell, size in sorted(sizes.items(), key=lambda v: (-v[1], v[0])):
        fold[cell] = load.index(min(load))
        load[fold[cell]] += size
    f, x, y = d.cell.map(fold).to_numpy(), d[columns].to_numpy(), d.soh.to_numpy()
    pred = np.full(len(d), np.nan)
    for i in range(len(load)):
        t = f != i
        m, sd, ym, ysd = x[t].mean(0), x[t].std(0), y[t].mean(), y[t].std()
        sd = np.where(sd < 1e-9, 1.0, sd)
        z, v = (x[t] - m) / sd, (y[t] - ym) / ysd
        w = bayesian_ridge(z.T @ z, z.T @ v, v @ v, len(v), 1e-6)[0]
        pred[~t] = (x[~t] - m) / sd @ np.array(w) * ysd + ym
    return float(np.sqrt(np.mean((pred - y) ** 2)))


def path_of(candidates, error):
    chosen, left, best = [], list(candidates), np.inf
    while left:
        scored = {c: e for c in left if (e := error([*(n for n, _ in chosen), c])) is not None}
        if not scored or min(scored.values()) > best * 0.97:
            break
        c = min(scored, key=scored.get)
        best = scored[c]
        chosen.append((c, best))
        left.remove(c)
    return chosen


def test_every_set_is_judged_on_its_own_rows(df, rows):
    table = selection.gap_table(df, COLUMNS, "soh").persist()
    totals = selection._totals(table, len(COLUMNS) + 1)
    sets = [s for m in (1, 2, 3) for s in itertools.combinations(range(len(COLUMNS)), m)]
    for s, got in zip(sets, selection.left_out_errors(table, totals, sets), strict=True):
        assert got == pytest.approx(left_out(rows, [COLUMNS[i] for i in s]), rel=1e-8), s
    for s, (got, _) in zip(sets, selection.held_out_errors(table, len(COLUMNS) + 1, sets), strict=True):
        assert got == pytest.approx(held_out(rows, [COLUMNS[i] for i in s]), rel=1e-7), s


def test_indicator_path(df, rows):
    path, verdict = selection.select_indicators(df, [*COLUMNS, "soh"], exclude=("soh",))
    want = path_of(COLUMNS[:4], lambda cols: left_out(rows, cols))  # `rare` is known too seldom
    assert verdict == "several" and [c for c, _ in path] == [c for c, _ in want] and len(path) >= 2
    assert [e for _, e in path] == pytest.approx([e for _, e in want])


def test_measurement_path(df, rows):
    groups = {"rare": ["rare"], "pair": ["b", "c"], "first": ["a"], "none": ["zz"]}
    single, path = selection.rank_measurements(df, groups)
    want = {name: held_out(rows, groups[name]) for name in ("pair", "first")}
    assert [s[0] for s in single] == sorted(want, key=want.get) and [s[1] for s in single] == pytest.approx(sorted(want.values()))
    assert {s[0]: s[2] for s in single} == {"pair": 8, "first": 9}  # one cell knows no c
    spread = df.agg(F.stddev_pop("soh")).first()[0]
    assert [s[3] for s in single] == pytest.approx([1 - s[1] / spread for s in single])
    steps = path_of(["pair", "first"], lambda names: held_out(rows, [c for n in names for c in groups[n]]))
    assert [n for n, _ in path] == [n for n, _ in steps] and [e for _, e in path] == pytest.approx([e for _, e in steps])


def test_few_cells_and_empty_tables(df):
    two = df.where("cell IN ('c0', 'c1')")
    assert selection.select_indicators(two, ["a"]) == ([], "undetermined")
    assert selection.rank_measurements(two, {"first": ["a"]})[0] == [("first", None, 2, None)]
    assert selection.select_indicators(df.limit(0), ["a", "b"]) == ([], "undetermined")
    assert selection.rank_measurements(df.limit(0), {"first": ["a"]}) == ([], [])


def test_folds_of_each_key_are_those_of_its_rows(df):
    """Cells of equal sizes too."""
    from cellspan.operators import learning

    sizes = df.where("cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("size")).withColumn("set", F.lit(0))
    both = sizes.unionByName(sizes.withColumns({"set": F.lit(1), "size": F.lit(10).cast("long")}))
    got = {(r["set"], r["cell"]): r["fold"] for r in learning.dealt_folds(both, 4, by=("set",)).collect()}
    for s in (0, 1):
        alone = {(s, r["cell"]): r["fold"] for r in learning.dealt_folds(both.where(F.col("set") == s).drop("set"), 4).collect()}
        assert alone == {k: v for k, v in got.items() if k[0] == s}
