"""Plans and kernels that the larger tables need: no shuffle of logs and paths, bounded parts, the same numbers as plainer ways."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan import learning_queries  # noqa: F401 - adds its queries
from cellspan.operators import forecasts, quality
from cellspan.queries import QUERIES
from cellspan.sources import samples

DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        df.explain()
    return held.getvalue()


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = [(c, "G", int(k), None if rng.random() < 0.1 else float(rng.normal())) for c, n in (("a", 700), ("b", 30), ("c", 5)) for k in np.flatnonzero(rng.random(n) < 0.9) + 1]
    return spark.createDataFrame(rows, "cell string, grp string, k int, cap double")


def test_log_of_a_series_is_resolved_without_a_join(spark, series):
    log = forecasts.persistence(series).unionByName(forecasts.trailing_mean(series))
    names = ["cell", "grp", "model", "k0", "h", "k_target", "pred", "now", "lo", "hi", "actual"]
    want, got = (sorted(map(str, df.select(*names).collect())) for df in (forecasts.resolve(log, series), forecasts.resolved_log(series)))
    assert got == want
    for name in ("forecast_accuracy", "conformal_radii", "rul_crossings"):
        assert plan_of(QUERIES[name](spark, DIR)).count("Exchange hashpartitioning") == 1, name


def test_radii_of_long_series_over_batches(spark, series):
    log = forecasts.resolved_log(series)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {(r["model"], r["h"], r["cell"], r["k0"]): (r["n_seen"], r["radius"], r["calibrated"]) for r in forecasts.conformal(log).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = log.toPandas()
    assert len(got) == len(pdf)
    for (m, h, c), part in pdf.groupby(["model", "h", "cell"]):
        part = part.sort_values("k0").assign(err=lambda t: (t.actual - t.pred).abs())
        for r in part.itertuples():
            seen = part[(part.k_target <= r.k0) & part.err.notna()].err.to_numpy()[-200:]
            n, radius, calibrated = got[m, h, c, r.k0]
            assert n == len(seen) and calibrated == (n >= 8)
            if calibrated:
                assert radius == pytest.approx(np.quantile(seen, min(np.ceil((n + 1) * (1 - 0.1)) / n, 1.0)), abs=1e-12)
            else:
                assert radius is None


def test_crossing_of_a_path_in_a_row(spark):
    grid = [5, 10, 15, 20]
    paths = [("late", [2.0, 1.9, 1.5, 1.0]), ("first", [1.0, 2.0, 1.0, 1.0]), ("never", [2.0, 2.0, 2.0, 2.0]), ("unknown", [None, None, None, None])]
    df = spark.createDataFrame(paths, "cell string, y array<double>")
    got = {r["cell"]: r["c"] for r in df.select("cell", forecasts.path_crossing(F.array(*map(F.lit, grid)), F.col("y"), 1.4).alias("c")).collect()}
    long = df.select("cell", F.posexplode("y").alias("i", "y")).withColumn("h", F.get(F.array(*map(F.lit, grid)), F.col("i")))
    assert got == {r["cell"]: r["crossing"] for r in forecasts.crossings(long, 1.4, ["cell"]).collect()}
    assert got["late"] == pytest.approx(16.0) and got["first"] == 5.0 and got["never"] is None


def test_rolling_median_and_begin_of_life_beside_the_rows(spark, series):
    w = quality.Window.partitionBy("cell").orderBy("k")
    both = series.withColumns({"got": quality.rolling_median(F.col("cap"), w, 7), "want": F.percentile("cap", F.lit(0.5)).over(w.rowsBetween(-7, 7))})
    assert both.where("got IS DISTINCT FROM want").count() == 0
    flagged = quality.hampel(series.withColumn("cap", 1.5 + 0.3 * F.col("cap")))
    beside = {(r["cell"], r["bol"], r["crash"]) for r in quality.with_bol(flagged).select("cell", "bol", "crash").distinct().collect()}
    assert beside == {tuple(r) for r in quality.robust_bol(flagged).collect()}
    assert quality.with_bol(flagged).columns == [*flagged.columns, "bol", "crash"]


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(samples, "PART_ROWS", 100)
    assert samples.parted(spark.range(1001), "id").rdd.getNumPartitions() == 11
    assert samples.parted(spark.range(10), "id").rdd.getNumPartitions() == 4
    assert plan_of(QUERIES["soh_dataset"](spark, DIR)).count("Exchange hashpartitioning") == 1


def test_ids_of_whole_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (0, 7, 999, 9999, 10000, -1, -999, -1000, 10**15 - 1, 10**15, -(10**15), 2**63 - 1, -(2**63), None)], "id long")
    assert df.select(samples.cell_of(df, "id").alias("got"), samples.cell_id("id").alias("want")).where("got IS DISTINCT FROM want").count() == 0
    assert "regexp" not in plan_of(df.select(samples.cell_of(df, "id")))


def test_study_is_resolved_where_rows_lie(spark, series):
    from cellspan.plans import cohort

    table = series.repartition(3, "cell").withColumns({"soh_clean": F.col("cap"), "eol_soh": F.lit(0.7)})
    logs = forecasts.persistence(series.where("cap IS NOT NULL"), width=0.05)
    out = cohort.run(table, ("persistence", "trailing mean"))
    assert plan_of(out["forecasts"]).count("Exchange hashpartitioning") == plan_of(out["forecasts"]).count("REPARTITION_BY_NUM") > 0
    columns = ["cell", "k0", "h", "pred", "actual"]
    held = series.where("cap IS NOT NULL")
    both = held.select("cell", "k").intersect(logs.select("cell", F.col("k0").alias("k")))
    want = forecasts.resolve(logs, series).join(both.withColumnRenamed("k", "k0"), ["cell", "k0"]).select(*columns)
    got = out["forecasts"].where("model = 'persistence'").join(both.withColumnRenamed("k", "k0"), ["cell", "k0"]).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    single = out["forecasts"].where("model <> 'ensemble'")
    ens = forecasts.resolve(forecasts.combined(single.drop("actual"), out["weights"]), series).select(*columns)
    near = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert near(out["forecasts"].where("model = 'ensemble'").select(*columns)) == near(ens)
