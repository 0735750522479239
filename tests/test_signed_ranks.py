"""Signed-rank tests against enumeration of all signs and against the normal limit from sorted differences."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspan.functions import metrics as M
from cellspan.operators import study


def ranks(d):
    size = np.abs(d)
    return np.array([(size < v).sum() + ((size == v).sum() + 1) / 2 for v in size])


def enumerated(d):
    w, whole = ranks(d)[d > 0].sum(), len(d) * (len(d) + 1) / 2
    sums = [sum(r for r, up in zip(range(1, len(d) + 1), signs, strict=True) if up) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * np.mean(np.array(sums) <= min(w, whole - w)))


def limit(d):
    d = d[d != 0]
    n, r = len(d), ranks(d)
    _, c = np.unique(np.abs(d), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (c**3 - c).sum() / 48
    return math.erfc(abs(r[d > 0].sum() - n * (n + 1) / 4) / math.sqrt(2 * var))


def test_tests_by_key(spark):
    rng = np.random.default_rng(4)
    cases = {f"exact {n}": rng.normal(0.3, 1, n) for n in (1, 2, 5, 11)}
    cases |= {"ties": rng.integers(1, 4, 20) * rng.choice([-1.0, 1.0], 20), "zeros": np.append(rng.normal(0.2, 1, 15), [0.0, 0.0]), "long": rng.normal(0.02, 1, 3000), "many ties": rng.integers(-3, 5, 400).astype(float), "one above": rng.normal(0.5, 1, 51)}
    rows = pd.DataFrame([(k, float(v)) for k, d in cases.items() for v in d] + [("none", 0.0), ("none", 0.0)], columns=["key", "d"])
    df = spark.createDataFrame(rows).unionByName(spark.createDataFrame([("long", None), ("long", float("nan")), ("unknown", None)], "key string, d double"))
    got = {r["key"]: r for r in study.signed_ranks(df.repartition(5), ["key"]).collect()}
    for k, d in cases.items():
        want = enumerated(d) if k.startswith("exact") else limit(d.round(12))
        assert got[k]["m"] == (d != 0).sum() and got[k]["p"] == pytest.approx(want, rel=1e-9), k
    assert (got["none"]["m"], got["none"]["p"]) == (0, None) and "unknown" not in got


def test_fifty_are_exact(spark):
    df = spark.range(1, 51).select(F.lit("a").alias("key"), F.col("id").cast("double").alias("d"))
    assert study.signed_ranks(df, ["key"]).first()["p"] == pytest.approx(2 / 2**50)


def test_erfc(spark):
    x = [0.0, 0.1, 1.0, 1.99, 2.0, 2.01, 3.5, 6.0, 20.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", M.erfc(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == pytest.approx([math.erfc(r["x"]) for r in got], rel=1e-9)


def test_no_rows(spark):
    assert study.signed_ranks(spark.createDataFrame([], "key string, d double"), ["key"]).count() == 0
