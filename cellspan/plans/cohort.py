"""Cohort study: forecasts of all cells by several models, metrics, comparisons, answers, caching and exports."""

from __future__ import annotations

import hashlib
import html
import io
import json
import re
import zipfile
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import cellspan
from cellspan.config import RUL_GRID
from cellspan.operators import forecasts, study
from cellspan.operators.datasets import measured_every
from cellspan.sources.staging import staged

MODELS = tuple(forecasts.WITHIN)


def observations(table: DataFrame, every: int = 1) -> DataFrame:
    """cell, grp, k, soh (good values), held (the last value that was measured, each `every` cycles), eol of a cycle table."""
    w = Window.partitionBy("cell").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    d = measured_every(table.withColumn("known", F.col("soh_clean")), ["known"], every)
    return d.select("cell", "grp", "k", F.col("soh_clean").alias("soh"), F.last("known", ignorenulls=True).over(w).alias("held"), F.col("eol_soh").alias("eol"))


def run(table: DataFrame, models=MODELS, every: int = 1, width: float = 0.05) -> dict[str, DataFrame]:
    """metrics, forecasts, estimates, weights, rul, estimation; a cell and model without forecasts is a row with a status."""
    obs = observations(table, every)
    known = obs.where("held IS NOT NULL")
    origins = forecasts.weighed(obs, tuple(models))
    weights = forecasts.weights_of(origins, tuple(models))
    both = forecasts.logs_of(origins, tuple(models), width)
    radii = forecasts.conformal(both)
    lo, hi, calibrated = forecasts.band(F.col("radius"), F.col("pred"), F.col("lo"), F.col("hi"))
    resolved = radii.withColumns({"lo": lo, "hi": hi, "calibrated": calibrated}).drop("radius", "n_seen")
    metrics = staged(forecasts.accuracy(resolved).withColumn("status", F.lit("ok")), "metrics")
    names = F.explode(F.array(*map(F.lit, (*models, "ensemble")))).alias("model")
    missing = obs.select("cell", "grp").distinct().select("cell", "grp", names).join(metrics.select("cell", "model").distinct(), ["cell", "model"], "left_anti").withColumn("status", F.lit("no forecasts"))
    k = F.col("k").cast("double")
    w = Window.partitionBy("cell").orderBy("k").rowsBetween(-19, 0)
    line = known.withColumns({"b": F.regr_slope("held", k).over(w), "a": F.regr_intercept("held", k).over(w)})
    fit = F.coalesce(F.col("a") + F.col("b") * k, F.col("held"))
    ahead = F.when(fit <= F.col("eol"), 0.0).when(F.col("b") < 0, (F.col("eol") - fit) / F.col("b"))
    est = line.select("cell", "k", F.lit("linear trend").alias("model"), fit.alias("soh"), F.col("soh").alias("measured"))
    rul = line.select("cell", F.lit("linear trend").alias("model"), F.col("k").alias("k0"), F.when(ahead <= max(RUL_GRID), F.col("k") + ahead).alias("eol_pred"))
    return {"metrics": metrics.unionByName(missing, allowMissingColumns=True), "forecasts": resolved, "estimates": est, "weights": weights, "rul": rul, "estimation": study.estimation_accuracy(est)}


def update_frequency(table: DataFrame, intervals=(1, 2, 5, 10, 20), h: int = 25, models=("linear trend",)) -> DataFrame:
    """Median error and coverage by how often a measurement is taken."""
    out = None
    for n in intervals:
        m = run(table, models, n)["metrics"].where((F.col("h") == h) & (F.col("model") != "ensemble"))
        part = m.groupBy("model").agg(F.percentile("rmse", F.lit(0.5)).alias("rmse"), F.avg("coverage").alias("coverage")).withColumn("interval", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def strength(n: int) -> str:
    """Of evidence from n cells (fixed limits)."""
    return "insufficient" if n < 6 else "low" if n < 10 else "adequate"


def answers(metrics: DataFrame, frequency: DataFrame | None = None, ranking: DataFrame | None = None, measurements: list | None = None, ledger: DataFrame | None = None, h: int = 10, selection: tuple | None = None, stress: tuple | None = None, comparisons: DataFrame | None = None, plants: DataFrame | None = None) -> dict[str, str]:
    """Plain answers from a few collected rows: the best model and how often to update it; the best indicator that is not
    capacity or energy itself and the best measurement; the best policy; whether one or several indicators are better (selection: of
    select_indicators), what the loss depends on (stress: of stress_regression), how many models differ from the best one
    (comparisons: of pairwise), where the plants' parameters come from (plants: of calibrate)."""
    board = study.leaderboard(metrics, h).orderBy("mean_rank", "model").limit(2).collect()
    out = {"best model": "no model is valid on common cells"}
    if board:
        n = board[0]["n_cells"]
        out["best model"] = f"{board[0]['model']} at {h} cycles: median error {board[0]['rmse_median']:.4g} over {n} common cells ({strength(n)} evidence)"
    if frequency is not None:
        rows = sorted((r["interval"], r["rmse"]) for r in frequency.groupBy("interval").agg(F.percentile("rmse", F.lit(0.5)).alias("rmse")).collect() if r["rmse"] is not None)
        if rows:
            fine = [i for i, e in rows if e <= 1.10 * rows[0][1]]
            out["update interval"] = f"every {max(fine)} cycles costs at most 10 % more error than every {rows[0][0]}"
    if ranking is not None:
        top = ranking.where(not_capacity("hi")).orderBy(F.desc("score"), "hi").limit(1).collect()
        out["best indicator"] = f"{top[0]['hi']}: score {top[0]['score']:.3f}" if top else "no indicator varies enough"
    if measurements:
        name, error, _, gain = measurements[0]
        out["best measurement"] = f"{name}: error {error:.4g}, {gain:.0%} below the mean" if error is not None else "no measurement is known in enough rows"
    if ledger is not None:
        top = ledger.orderBy(F.desc("profit"), "policy").limit(1).collect()
        out["best policy"] = f"{top[0]['policy']}: profit {top[0]['profit']:.4g}" if top else "no policy was tried"
    if selection is not None:
        path, verdict = selection
        falls = f": {', '.join(c for c, _ in path)}, error {path[0][1]:.3g} to {path[-1][1]:.3g} on left-out cells" if path else ""
        out["one or several indicators"] = verdict + falls
    if stress is not None:
        coefficients, facts = stress
        clear = [f"{r.factor} ({r.coef:+.2g})" for r in coefficients.itertuples() if r.p < 0.05]
        confounded = f"; confounding: {', '.join(facts['confounding'])}" if facts["confounding"] else ""
        found = f"p < 0.05 for {', '.join(clear)}" if clear else "no factor reaches p < 0.05" if len(coefficients) else "too few cells for the factors"
        out["stress factors"] = f"{found} ({facts['power']}, {facts['n']} cells){confounded}"
    if comparisons is not None and board:
        mine = comparisons.where((F.col("model_a") == board[0]["model"]) | (F.col("model_b") == board[0]["model"]))
        tests = mine.agg(F.count("*").alias("n"), F.count(F.when(F.col("p_holm") < 0.05, 1)).alias("differ"), F.max("n").alias("cells")).first()
        out["significance"] = f"{tests['differ']} of {tests['n']} other models differ from it after correction" + (f" ({strength(tests['cells'])} evidence)" if tests["n"] else "")
    if plants is not None:
        kinds = [c for c in ("fade_source", "resistance_source", "alpha_source") if c in plants.columns]
        pairs = plants.select(F.inline(F.array(*(F.struct(F.lit(c.removesuffix("_source")).alias("what"), F.col(c).alias("source")) for c in kinds))))
        counted = pairs.groupBy("what", "source").count().orderBy("what", "source").collect()
        out["calibration"] = "; ".join(f"{r['what']}: {r['source']} for {r['count']} cells" for r in counted) or "no plant is calibrated"
    return out


def not_capacity(name: str):
    """Names without capacity or energy in them, in any case."""
    return ~F.col(name).rlike("(?i)capacity|energy|^cap")


def cached(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], *, data: str, **arguments) -> DataFrame:
    """The table of that name for these data (a data_hash), arguments and version of the library: read, or made and written."""
    said = json.dumps([cellspan.__version__, data, arguments], sort_keys=True, default=str)
    at = f"{folder}/{name}-{hashlib.sha1(said.encode()).hexdigest()[:16]}"
    try:
        return spark.read.parquet(at)
    except AnalysisException:
        make().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)


def require(version: str) -> None:
    """Raises unless the library is at least of that version."""
    number = lambda v: tuple(int(x) for x in re.findall(r"\d+", v)[:3])
    if number(cellspan.__version__) < number(version):
        raise RuntimeError(f"version {version} is needed, this is {cellspan.__version__}")


def write_csv(tables: dict[str, DataFrame], out: str, single: bool = True) -> None:
    """A folder of CSV a table, with one file in it where result tables are small (`single`); nested columns as JSON."""
    for name, df in tables.items():
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in df.dtypes))
        (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")


def csv_zip(tables: dict[str, pd.DataFrame]) -> bytes:
    """A zip of CSV files of small result tables."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, pdf in tables.items():
            z.writestr(f"{name}.csv", pdf.to_csv(index=False))
    return held.getvalue()


def bars(title: str, values: dict[str, float], width: int = 480) -> str:
    """A bar chart as SVG."""
    top = max([abs(v) for v in values.values()], default=0) or 1
    rows = [f"<text x='0' y='{24 * i + 40}'>{html.escape(k)}</text><rect x='160' y='{24 * i + 28}' height='14' width='{abs(v) / top * (width - 240):.1f}'/><text x='{width - 70}' y='{24 * i + 40}'>{v:.4g}</text>" for i, (k, v) in enumerate(values.items())]
    return f"<svg width='{width}' height='{24 * len(values) + 40}' font-size='12'><text x='0' y='14'>{html.escape(title)}</text>{''.join(rows)}</svg>"


def html_report(title: str, said: dict[str, str], tables: dict[str, pd.DataFrame], figures: tuple[str, ...] = ()) -> str:
    parts = [f"<h1>{html.escape(title)}</h1>", "<ul>", *(f"<li><b>{html.escape(k)}</b>: {html.escape(v)}</li>" for k, v in said.items()), "</ul>", *figures]
    for name, pdf in tables.items():
        parts += [f"<h2>{html.escape(name)}</h2>", pdf.to_html(index=False, float_format=lambda v: f"{v:.4g}", border=0)]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{''.join(parts)}</body></html>"


def markdown(title: str, said: dict[str, str], board: pd.DataFrame) -> str:
    head = "| " + " | ".join(board.columns) + " |\n|" + "-|" * len(board.columns)
    rows = ["| " + " | ".join(f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in board.itertuples(index=False)]
    return "\n".join([f"# {title}", "", *(f"- **{k}**: {v}" for k, v in said.items()), "", head, *rows, ""])


def export(out: str, title: str, said: dict[str, str], tables: dict[str, DataFrame], figures: tuple[str, ...] = ()) -> None:
    """Driver-side files of a study's small results."""
    small = {k: v.toPandas() for k, v in tables.items()}
    at = Path(out)
    at.mkdir(parents=True, exist_ok=True)
    (at / "report.html").write_text(html_report(title, said, small, figures))
    (at / "tables.zip").write_bytes(csv_zip(small))
    (at / "summary.md").write_text(markdown(title, said, next(iter(small.values()))))
