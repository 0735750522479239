"""The study weighs forecasts in the row of their origin: the long logs' numbers, and few rows a task."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan import learning_queries
from cellspan.operators import forecasts
from cellspan.plans import cohort

DIR = "/root/testdata/sf0.001"
MODELS = ("persistence", "trailing mean", "linear trend")


def plan_of(df) -> str:
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        df.explain()
    return held.getvalue()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(c, "G", int(k), None if rng.random() < gaps else float(1 - 0.002 * k + 0.05 * rng.normal())) for c, n, gaps in (("a", 700, 0.1), ("b", 60, 0.7), ("c", 5, 0.0), ("d", 9, 1.0)) for k in np.flatnonzero(rng.random(n) < 0.9) + 1]
    rows += [("e", "G", k, 1 - 0.01 * k) for k in range(1, 41)]  # the mean of the last rows is far worse than the others
    return spark.createDataFrame(rows, "cell string, grp string, k int, soh_clean double").withColumn("eol_soh", F.lit(0.7))


def near(df, *columns):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*columns).collect())


def test_rows_have_the_numbers_of_long_logs(spark, table):
    out = cohort.run(table.repartition(3, "cell"))
    obs = cohort.observations(table)
    known = obs.where("held IS NOT NULL")
    logs = forecasts.persistence(known, "held", width=0.05).unionByName(forecasts.trailing_mean(known, "held", width=0.05)).unionByName(forecasts.linear_trend(known, "held", width=0.05))
    single = forecasts.resolve(logs, obs, "soh")
    weights = forecasts.ensemble_weights(forecasts.ewma_error(single))
    keys = ["cell", "model", "k0"]
    assert near(out["weights"], *keys, "weight") == near(weights, *keys, "weight") and weights.where("weight = 0").count() > 0
    both = single.unionByName(forecasts.resolve(forecasts.combined(logs, weights), obs, "soh"))
    columns = [*keys, "grp", "h", "k_target", "pred", "now", "actual"]
    assert near(out["forecasts"], *columns) == near(both, *columns)
    lo, hi, calibrated = forecasts.band(F.col("radius"), F.col("pred"), F.col("lo"), F.col("hi"))
    want = forecasts.conformal(both).withColumns({"lo": lo, "hi": hi, "calibrated": calibrated})
    assert near(out["forecasts"], *keys, "h", "lo", "hi", "calibrated") == near(want, *keys, "h", "lo", "hi", "calibrated")
    metrics = out["metrics"]
    assert near(metrics.where("status = 'ok'"), "cell", "model", "h", "rmse", "coverage") == near(forecasts.accuracy(want), "cell", "model", "h", "rmse", "coverage")
    assert {r["cell"] for r in metrics.where("status <> 'ok'").collect()} >= {"d"}


def test_a_task_reads_and_sorts_its_rows_once(spark, table):
    plan = plan_of(cohort.run(table.repartition(3, "cell"))["forecasts"])
    assert "Union" not in plan and plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Sort [") <= 4


def test_parts_of_the_study_follow_its_rows(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(learning_queries, "STUDY_ROWS", 100)
    monkeypatch.setattr(cohort, "run", lambda t: tables.append(t) or {"metrics": t})
    learning_queries.cohort_metrics(spark, DIR)
    events = spark.read.parquet(f"{DIR}/events.parquet").count()
    assert tables[0].rdd.getNumPartitions() == -(-events // 100) > 4
