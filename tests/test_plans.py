"""Cycle table, as-of join and study plans on small inputs with known results."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellspan.operators import forecasts, indicators, learning, quality, study
from cellspan.operators.asof import asof_fill
from cellspan.plans import cohort, cycles
from cellspan.sources import registry
from cellspan.sources import samples as S
from cellspan.streaming import windows
from tests import fleet as synthetic


def test_ids(spark):
    df = spark.createDataFrame([("5",), ("b0049",), (" B7 ",), ("S001",), ("inf",), (None,)], "c string")
    assert [r[0] for r in df.select(S.cell_id("c")).collect()] == ["B0005", "B0049", "B0007", "S001", "inf", None]


def test_normalise_checks_columns(spark):
    with pytest.raises(ValueError, match="lack"):
        S.normalise_samples(spark.createDataFrame([(1,)], "Cell_ID int"))


def test_asof_takes_whole_row(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 2)], "Cell_ID string, Cycle_Index long")
    right = spark.createDataFrame([("a", 3, 1.0, None), ("a", 5, None, 2.0), ("a", 8, 4.0, None)], "Cell_ID string, Cycle_Index int, x double, y double")
    got = {(r["Cell_ID"], r["Cycle_Index"]): (r["x"], r["y"]) for r in asof_fill(left, right, ["x", "y"]).collect()}
    assert got == {("a", 1): (1.0, None), ("a", 5): (None, 2.0), ("a", 9): (4.0, None), ("b", 2): (None, None)}


def test_hampel_finds_dip(spark):
    x = np.linspace(1.9, 1.6, 100)
    x[40] -= 0.25
    df = spark.createDataFrame(pd.DataFrame({"cell": "a", "k": np.arange(100), "cap": x}))
    flags = [r["k"] for r in quality.hampel(df).where("outlier").collect()]
    assert 40 in flags and len(flags) <= 2


def test_eol_needs_three(spark):
    caps = [1.6, 1.55, 1.38, 1.5, 1.45, 1.39, 1.38, 1.37, 1.36, 1.35]
    rows = [("a", k + 1, c, False) for k, c in enumerate(caps)] + [("b", k + 1, c + 0.2, False) for k, c in enumerate(caps)] + [("c", 1, 1.0, False)]
    df = spark.createDataFrame(rows, "cell string, k int, cap double, outlier boolean")
    got = {r["cell"]: (r["eol_k"], r["eol_status"]) for r in quality.detect_eol(df).collect()}
    assert got == {"a": (6, "reached"), "b": (None, "EOL not reachable in data"), "c": (None, "insufficient data")}


def test_bol_ignores_crash(spark):
    caps = [2.6, 0.4, 2.45, 0.2, 2.5, *np.linspace(1.88, 1.7, 40)]
    df = spark.createDataFrame([("a", k, float(c), False) for k, c in enumerate(caps)], "cell string, k int, cap double, outlier boolean")
    r = quality.robust_bol(df).first()
    assert r["crash"] and abs(r["bol"] - 1.87) < 0.03


def test_empty_tables(spark):
    df = spark.createDataFrame([], "cell string, k int, cap double, outlier boolean")
    assert quality.robust_bol(df).count() == 0 and quality.detect_eol(df).count() == 0


@pytest.fixture(scope="module")
def built(spark):
    s, imp, truth = synthetic.fleet(spark, ("reference", "cold", "pulsed", "crash"), cycles=60)
    s, imp = S.load(spark, s, imp)
    table, summary = cycles.build(s, imp, synthetic.registry(spark, ("reference", "cold", "pulsed", "crash")), eol_ah=1.5)
    return table.cache(), summary.toPandas(), truth.toPandas()


def test_cycle_table(built):
    table, summary, truth = built
    pdf = table.toPandas()
    assert len(pdf) == 240 and pdf["Re_ohm"].notna().all()
    assert bool(summary.set_index("cell").loc["S003", "pulsed"]) and bool(summary.set_index("cell").loc["S004", "crash"])
    both = pdf[pdf.cell == "S001"].merge(truth, left_on=["cell", "k"], right_on=["Cell_ID", "k"])
    assert np.sqrt(((both.soh_clean - both.soh_true) ** 2).mean()) < 0.02
    assert summary["eol_status"].notna().all()


def test_cohort(built, tmp_path):
    table, _, _ = built
    out = cohort.run(table)
    metrics = out["metrics"].toPandas()
    one = metrics[(metrics.cell == "S001") & (metrics.h == 1)]
    assert (one.rmse < 0.03).all() and set(metrics.model) == {"persistence", "trailing mean", "linear trend", "ensemble"}
    assert out["estimation"].where("rmse > 0.05 AND cell = 'S001'").count() == 0
    freq = cohort.update_frequency(table, (1, 10), 10)
    rates = {r["interval"]: r["rmse"] for r in freq.collect()}
    assert set(rates) == {1, 10} and rates[1] <= rates[10] * 1.2
    ranking = table.sparkSession.createDataFrame([("cap_norm", 0.9), ("energy_Wh", 0.95), ("R0", 0.5)], "hi string, score double")
    ledger = table.sparkSession.createDataFrame([("2 A", 1.0), ("4 A", 3.0)], "policy string, profit double")
    said = cohort.answers(out["metrics"], freq, ranking, [("resistance", 0.01, 9, 0.5)], ledger)
    assert said["best indicator"].startswith("R0") and said["best policy"].startswith("4 A") and "50% below" in said["best measurement"] and "update interval" in said
    board = study.leaderboard(out["metrics"], 10)
    cohort.export(str(tmp_path), "study", said, {"leaderboard": board}, (cohort.bars("error", {"a": 1.0, "b": 2.0}),))
    page = (tmp_path / "report.html").read_text()
    assert page.startswith("<!doctype html>") and "<svg" in page
    cohort.write_csv({"board": board}, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv" / "board").glob("*.csv"))) == 1


def test_answers_on_evidence(spark):
    """Selection, stress, significance and calibration, with nothing to say too."""
    metrics = spark.createDataFrame([(f"c{i}", "g", m, 10, 9, e, "ok") for i in range(7) for m, e in (("a", 0.1), ("b", 0.2), ("c", 0.3))], "cell string, grp string, model string, h int, n long, rmse double, status string")
    metrics = metrics.withColumns({c: F.lit(0.5) for c in ("mae", "r2", "coverage", "fade_skill")})
    comparisons = spark.createDataFrame([("a", "b", 7, 0.01), ("a", "c", 7, 0.4), ("b", "c", 7, 0.01)], "model_a string, model_b string, n long, p_holm double")
    rates = spark.createDataFrame([(f"c{i}", 1.0 + 0.5 * (i % 5) + 0.01 * (i % 3), float(i % 5), 0.5 * (i % 2), None) for i in range(30)], "cell string, fade_rate double, I_mean double, ambient double, cutoff_V double")
    stress = learning.stress_regression(rates, ["I_mean", "ambient", "cutoff_V"])
    assert list(stress[0].factor) == ["I_mean", "ambient"]  # nothing is known of the cut-off
    plants = spark.createDataFrame([("c0", "own history", "default"), ("c1", "own history", "own history")], "cell string, fade_source string, resistance_source string")
    said = cohort.answers(metrics, selection=([("R0", 0.02), ("k", 0.01)], "several"), stress=stress, comparisons=comparisons, plants=plants)
    assert said["one or several indicators"] == "several: R0, k, error 0.02 to 0.01 on left-out cells"
    assert said["stress factors"].startswith("p < 0.05 for I_mean (+") and "30 cells" in said["stress factors"]
    assert said["significance"] == "1 of 2 other models differ from it after correction (low evidence)"
    assert said["calibration"] == "fade: own history for 2 cells; resistance: default for 1 cells; resistance: own history for 1 cells"
    bare = cohort.answers(metrics.limit(0), selection=([], "undetermined"), stress=learning.stress_regression(rates.limit(0), ["I_mean"]), comparisons=comparisons, plants=plants.limit(0))
    assert bare["one or several indicators"] == "undetermined" and bare["calibration"] == "no plant is calibrated" and "too few cells" in bare["stress factors"]


def test_stress_factors_of_good_rows(spark):
    rows = [("a", k, 1 - 0.002 * k, k == 5, 24.0 if k % 2 else 25.0, 2.0, k % 4 == 0) for k in range(1, 22)] + [("b", k, 1.0, False, 24.0, 1.0, True) for k in range(9)] + [("a", 30, None, False, 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "cell string, k int, soh double, outlier boolean, ambient double, I_mean double, pulsed boolean")
    out = indicators.stress_table(df).collect()
    assert len(out) == 1 and out[0]["cell"] == "a" and out[0]["n"] == 20 and out[0]["fade_rate"] == pytest.approx(0.2)
    assert (out[0]["ambient"], out[0]["I_mean"], out[0]["pulsed"]) == (24.5, 2.0, 0.25) and "T_rise" not in out[0].asDict()
    assert indicators.stress_table(df.limit(0)).count() == 0


def test_results_are_cached_by_data_and_arguments(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    df = spark.range(5)
    h = S.data_hash(df)
    assert h == S.data_hash(df.orderBy(F.desc("id")).repartition(3)) != S.data_hash(spark.range(6))
    for _ in range(2):
        assert cohort.cached(spark, str(tmp_path), "x", make, data=h, every=2).count() == 3
    cohort.cached(spark, str(tmp_path), "x", make, data=h, every=3)
    assert len(made) == 2
    cohort.require("0.1.0")
    with pytest.raises(RuntimeError, match="needed"):
        cohort.require("99.0")


def test_streaming_windows(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(hours=i), i % 2, "view", float(i)) for i in range(48)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = windows.deduplicated(windows.event_stream(spark, str(tmp_path / "e")))
    q = windows.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("tumbled").collect()) == [24, 24]


def test_static_join_and_accuracy_on_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(hours=i), i % 2, "signup" if i % 5 == 0 else "view", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    static = windows.in_force(df.where("event_type = 'signup'").withColumnRenamed("value", "quota")).persist()
    at = str(tmp_path / "e")
    df.coalesce(1).write.parquet(at)
    stream = spark.readStream.schema(df.schema).parquet(at)
    q = windows.asof_static(stream, static, "quota").select("event_id", "quota").writeStream.format("memory").queryName("joined_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r[0]: max([s for s in range(0, r[0] + 1, 5) if s % 2 == r[2]], default=None) for r in rows}
    assert {r["event_id"]: None if r["quota"] is None else int(r["quota"]) for r in spark.table("joined_out").collect()} == want
    log = spark.createDataFrame([("a", 1, float(i), i + 0.5, i - 1.0, i + 1.0) for i in range(10)] + [("a", 1, 1.0, None, 0.0, 2.0)], "model string, h int, pred double, actual double, lo double, hi double")
    log.coalesce(1).write.parquet(str(tmp_path / "l"))
    q = forecasts.live_accuracy(spark.readStream.schema(log.schema).parquet(str(tmp_path / "l"))).writeStream.format("memory").queryName("accuracy_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("accuracy_out").first()
    assert (r["n"], r["rmse"], r["coverage"]) == (10, 0.5, 1.0)


def test_registry(spark):
    cells = registry.cells(spark)
    assert cells.count() == 34 and {r[0] for r in cells.where(registry.is_pulsed()).select("Cell_ID").collect()} == {f"B00{n}" for n in range(25, 29)}
    more = spark.createDataFrame([("S001", "own", [10.0], "pulsed", 2.5, None), ("B0005", "moved", [24.0], "2.0", 2.7, 1.4)], registry.SCHEMA)
    both = registry.cells(spark, more)
    assert both.count() == 35 and both.where("Cell_ID = 'B0005'").first()["grp"] == "moved"
    df = spark.createDataFrame([("S001", 1), ("zz", 2)], "cell string, k int")
    assert {(r["cell"], r["grp"], r["declared_pulsed"]) for r in registry.with_cells(df, both).collect()} == {("S001", "own", True), ("zz", "Unknown", False)}


def test_holm_equals_the_textbook(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(0, 1, 300), rng.uniform(0, 1e-4, 100), [0.0, 1.0, 1e-300, 0.5, 0.5]])
    got = {r["model_a"]: r["p_holm"] for r in study.holm(spark.createDataFrame([(f"a{i:03d}", "b", float(v)) for i, v in enumerate(p)], "model_a string, model_b string, p double")).collect()}
    order = np.argsort(p, kind="stable")
    want = np.maximum.accumulate(np.minimum(1, (len(p) - np.arange(len(p))) * p[order]))
    assert [got[f"a{i:03d}"] for i in order] == pytest.approx(want.tolist())


def test_common_cells_and_holm(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", "G1" if i < 8 else "G2", m, 10, 20, float(e + rng.normal(0, 0.0005)), 0.5, 0.9, 0.1, "ok") for i in range(12) for m, e in (("A", 0.01), ("B", 0.02))]
    rows.append(("c0", "G1", "C", 10, 0, None, None, None, None, "invalid"))
    m = spark.createDataFrame(rows, "cell string, grp string, model string, h int, n int, rmse double, r2 double, coverage double, fade_skill double, status string")
    assert study.common_cells(m, 10).count() == 0
    two = m.where("model != 'C'")
    assert study.common_cells(two, 10).count() == 12
    p = study.pairwise(two, 10).first()
    assert p["n"] == 12 and p["p_holm"] < 0.01 and p["a_better"] == 12
