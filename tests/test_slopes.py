"""Median slopes of many short histories: no table of bins, bounded arrays, the same numbers as of long ones."""

import numpy as np
import pytest

from cellspan.operators import indicators


def test_short_histories_need_no_bins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"c{i:03d}", float(k if i % 3 else k // 2), float(rng.normal(0, 1))) for i in range(60) for k in range(9 + i % 5)] + [("null", 0.0, None)]
    df = spark.createDataFrame(rows, "cell string, k double, cap double")
    long = {r["cell"]: r["slope"] for r in indicators.theil_sen(df, block=4).collect()}

    def bins(*_):
        raise AssertionError("a table of bins for histories of one block")

    monkeypatch.setattr(indicators, "_slope_bins", bins)
    short = {r["cell"]: r["slope"] for r in indicators.theil_sen(df).collect()}
    assert len(short) == 60 and short == pytest.approx(long, abs=1e-15)
    assert all((v is None) == (sum(r[0] == c for r in rows) < 10) for c, v in short.items())
