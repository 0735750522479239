"""Forecast logs: resolving against what came, accuracy, conformal radii, end-of-life crossings, ensembles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellspan.config import BAND_ALPHA, HORIZONS
from cellspan.functions import metrics as M


def persistence(df: DataFrame, x: str = "cap", horizons=(1, *HORIZONS), width: float = 0.3) -> DataFrame:
    """Forecast log of the last value; one row per origin and horizon."""
    h = F.explode(F.array(*map(F.lit, horizons)))
    return df.select("cell", "grp", F.lit("persistence").alias("model"), F.col("k").alias("k0"), F.col(x).alias("pred"), F.col(x).alias("now"), h.alias("h")).withColumn("k_target", F.col("k0") + F.col("h")).withColumn("lo", F.col("pred") - width).withColumn("hi", F.col("pred") + width)


def trailing_mean(df: DataFrame, x: str = "cap", horizons=(1, *HORIZONS), rows: int = 10, width: float = 0.25) -> DataFrame:
    """Forecast log of the mean of the last rows."""
    w = Window.partitionBy("cell").orderBy("k").rowsBetween(-(rows - 1), 0)
    d = df.withColumn("m", F.avg(x).over(w))
    h = F.explode(F.array(*map(F.lit, horizons)))
    return d.select("cell", "grp", F.lit("trailing mean").alias("model"), F.col("k").alias("k0"), F.col("m").alias("pred"), F.col(x).alias("now"), h.alias("h")).withColumn("k_target", F.col("k0") + F.col("h")).withColumn("lo", F.col("pred") - width).withColumn("hi", F.col("pred") + width)


def resolve(forecasts: DataFrame, truth: DataFrame, x: str = "cap") -> DataFrame:
    """forecasts with `actual`: an equi-join on cell and target cycle; not yet reached targets stay null."""
    t = truth.select("cell", F.col("k").alias("k_target"), F.col(x).alias("actual"))
    return forecasts.join(t, ["cell", "k_target"], "left")


def with_mean(df: DataFrame, x: str = "cap", rows: int = 10) -> DataFrame:
    """df with the mean of the last rows, which wide_log and resolved_log read."""
    return df.withColumn("__mean", F.avg(x).over(Window.partitionBy("cell").orderBy("k").rowsBetween(-(rows - 1), 0)))


def _two_models(x: str) -> list[tuple[str, Column, float]]:
    return [("persistence", F.col(x), 0.3), ("trailing mean", F.col("__mean"), 0.25)]


def wide_log(df: DataFrame, x: str = "cap", horizons=(1, *HORIZONS)) -> DataFrame:
    """The logs of persistence and trailing_mean of a table with_mean and times, a row for all horizons: row by row, so of streams too."""
    each = [F.struct(F.lit(m).alias("model"), p.alias("pred"), (p - width).alias("lo"), (p + width).alias("hi")) for m, p, width in _two_models(x)]
    return df.select("cell", F.array(*map(F.lit, horizons)).alias("h"), F.col("k").alias("k0"), "ts", F.inline(F.array(*each)))


def resolved_log(df: DataFrame, x: str = "cap", horizons=(1, *HORIZONS), rows: int = 10) -> DataFrame:
    """resolve of the logs of persistence and trailing_mean against the series itself: a row's values ahead are frames of one
    cycle, so neither the log nor the series is shuffled once rows lie by cell. A cycle is one row."""
    w = Window.partitionBy("cell").orderBy("k")
    d = with_mean(df, x, rows).withColumns({f"__{h}": F.when(F.col("cell").isNotNull(), F.first(x).over(w.rangeBetween(h, h))) for h in horizons})
    each = [F.struct(F.lit(m).alias("model"), p.alias("pred"), F.lit(h).alias("h"), (F.col("k") + h).alias("k_target"), (p - width).alias("lo"), (p + width).alias("hi"), F.col(f"__{h}").alias("actual")) for m, p, width in _two_models(x) for h in horizons]
    return d.select("cell", "grp", F.col("k").alias("k0"), F.col(x).alias("now"), F.inline(F.array(*each)))


def accuracy(resolved: DataFrame, keys=("cell", "grp", "model", "h")) -> DataFrame:
    """One aggregation: n, rmse, mae, r2, coverage, fade_skill."""
    y, p = F.col("actual"), F.col("pred")
    return resolved.where(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(F.count("*").cast("int").alias("n"), M.rmse(y, p).alias("rmse"), M.mae(y, p).alias("mae"), M.r2(y, p).alias("r2"), M.coverage(y, F.col("lo"), F.col("hi")).alias("coverage"), M.fade_skill(F.col("now"), y, p).alias("fade_skill"))


def interpolated(sorted_values: Column, level: Column) -> Column:
    """Linear quantile of a sorted array at a level that may differ by row."""
    at = level * (F.size(sorted_values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (at - low) * (b - a)


def _last_quantiles(errors: np.ndarray, end: np.ndarray, n: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """For each row the conformal quantile of the n errors before `end`; NaN below `least`."""
    out = np.full(len(n), np.nan)
    at = np.flatnonzero(n >= max(least, 1))
    if len(at):
        n, width = n[at], int(n[at].max())
        place = end[at][:, None] + np.arange(-width, 0)
        s = np.sort(np.where(place >= (end[at] - n)[:, None], errors[np.maximum(place, 0)], -1.0), axis=1)  # errors are not below 0
        pos = np.minimum(np.ceil((n + 1) * (1 - alpha)) / n, 1.0) * (n - 1)
        low = np.floor(pos).astype(np.int64)
        row = np.arange(len(n))
        a, b = s[row, width - n + low], s[row, width - n + np.minimum(low + 1, n - 1)]
        out[at] = a + (pos - low) * (b - a)
    return out


def conformal(resolved: DataFrame, alpha: float = BAND_ALPHA, least: int = 8, rows: int = 200) -> DataFrame:
    """radius: quantile of the last |actual - pred| of the same cell, model and horizon that were known at the origin.

    The level is min(ceil((n + 1)(1 - alpha)) / n, 1); below `least` residuals there is none and `calibrated` is false. A
    residual of origin k is known at k + h. Rows are streamed in order of their origins; of a series that a batch ends in, only
    the last `rows` known residuals and those not yet known are kept.
    """
    order = ["cell", "model", "h", "k0"]
    new = F.row_number().over(Window.partitionBy(*order[:3]).orderBy("k0")) == 1
    numbers = [new.alias("__new"), F.col("k0").cast("long").alias("__k0"), F.col("k_target").cast("long").alias("__due"), F.abs(F.col("actual") - F.col("pred")).cast("double").alias("__err")]
    d = resolved.select("*", *numbers).sortWithinPartitions(*order)
    kept = [f for f in d.schema.fields if not f.name.startswith("__")]

    def run(batches):
        due, err = np.zeros(0, np.int64), np.zeros(0)  # of the series that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            series = np.cumsum(column("__new").to_numpy(zero_copy_only=False))
            known = column("__err").is_valid().to_numpy(zero_copy_only=False) & column("__due").is_valid().to_numpy(zero_copy_only=False)
            k0 = column("__k0").fill_null(np.iinfo(np.int64).min // 4).to_numpy(zero_copy_only=False)
            of = np.concatenate([np.zeros(len(due), np.int64), series[known]])
            due = np.concatenate([due, column("__due").fill_null(0).to_numpy(zero_copy_only=False)[known]])
            err = np.concatenate([err, column("__err").fill_null(0.0).to_numpy(zero_copy_only=False)[known]])
            begin = np.searchsorted(of, series)
            # residuals of earlier series, and those of the own one that are due by the origin
            low, high = min(due.min(initial=0), 0) - 1, max(due.max(initial=0), 0) + 1
            end = np.searchsorted(of * (high - low + 1) + (due - low), series * (high - low + 1) + np.clip(k0 - low, 0, high - low), side="right")
            n = np.minimum(end - begin, rows)
            radius = _last_quantiles(err, end, n, alpha, least)
            columns = [column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(radius, pa.float64(), mask=n < least), pa.array(n >= least)], [*(f.name for f in kept), "n_seen", "radius", "calibrated"])
            keep = max(begin[-1], end[-1] - rows)
            due, err = due[keep:], err[keep:]

    return d.mapInArrow(run, StructType([*kept, *StructType.fromDDL("n_seen int, radius double, calibrated boolean").fields]))


def path_crossing(h: Column, y: Column, threshold: float) -> Column:
    """crossings of one path that is a row's array y over the grid h, in its order."""
    first = F.array_position(F.transform(y, lambda v: v < threshold), True)
    at = lambda c, i: F.get(c, (first - i).cast("int"))
    between = at(h, 2) + (at(y, 2) - threshold) / (at(y, 2) - at(y, 1) + 1e-12) * (at(h, 1) - at(h, 2))
    return F.when(first == 1, at(h, 1).cast("double")).when(first > 1, between)


def crossings(paths: DataFrame, threshold: float, by: list[str], h: str = "h", y: str = "y") -> DataFrame:
    """Where a path first falls below the threshold, between grid points by a line; null if it doesn't."""
    w = Window.partitionBy(*by).orderBy(h)
    d = paths.withColumn("y0", F.lag(y).over(w)).withColumn("h0", F.lag(h).over(w))
    hit = d.groupBy(*by).agg(F.min_by(F.when(F.col(y) < threshold, F.struct("h0", "y0", F.col(h).alias("h1"), F.col(y).alias("y1"))), F.when(F.col(y) < threshold, F.col(h))).alias("c"))
    c = F.col("c")
    return hit.select(*by, F.when(c["h0"].isNull(), c["h1"].cast("double")).otherwise(c["h0"] + (c["y0"] - threshold) / (c["y0"] - c["y1"] + 1e-12) * (c["h1"] - c["h0"])).alias("crossing"))


def band(radius: Column, pred: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """lo, hi and whether they are calibrated: pred and the conformal radius where there is one, else the model's own."""
    known = radius.isNotNull()
    return F.when(known, pred - radius).otherwise(lo), F.when(known, pred + radius).otherwise(hi), known


def fan(resolved: DataFrame, steps: int = 60, horizons=(1, *HORIZONS)) -> DataFrame:
    """cell, model, h, pred, lo, hi for each step ahead of the last origin: the radius lies on lines between the horizons
    that were calibrated at that origin."""
    last = conformal(resolved).groupBy("cell", "model", "h").agg(F.max_by(F.struct("k0", "pred", "radius"), "k0").alias("x"))
    at = last.where(F.col("x.radius").isNotNull()).groupBy("cell", "model").agg(F.max_by("x.pred", "x.k0").alias("pred"), F.sort_array(F.collect_list(F.struct(F.col("h"), F.col("x.radius").alias("r")))).alias("rs"))  # one entry a horizon
    each = at.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    below, above = F.filter("rs", lambda p: p["h"] <= F.col("h")), F.filter("rs", lambda p: p["h"] >= F.col("h"))
    a, b = F.get(F.reverse(below), F.lit(0)), F.get(above, F.lit(0))
    share = F.try_divide(F.col("h") - a["h"], b["h"] - a["h"])
    radius = F.when(a.isNull(), b["r"]).when(b.isNull() | (a["h"] == b["h"]), a["r"]).otherwise(a["r"] + share * (b["r"] - a["r"]))
    return each.select("cell", "model", "h", "pred", (F.col("pred") - radius).alias("lo"), (F.col("pred") + radius).alias("hi"))


def linear_trend(df: DataFrame, x: str = "cap", horizons=(1, *HORIZONS), rows: int = 20, width: float = 0.3) -> DataFrame:
    """Forecast log of the line through the last rows (the last value where there are fewer than three)."""
    w = Window.partitionBy("cell").orderBy("k").rowsBetween(-(rows - 1), 0)
    k = F.col("k").cast("double")
    lines = df.withColumns({"__n": F.count(x).over(w), "__b": F.regr_slope(x, k).over(w), "__a": F.regr_intercept(x, k).over(w)})
    d = lines.withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    pred = F.when(F.col("__n") >= 3, F.col("__a") + F.col("__b") * (F.col("k") + F.col("h"))).otherwise(F.col(x))
    return d.select("cell", "grp", F.lit("linear trend").alias("model"), F.col("k").alias("k0"), pred.alias("pred"), F.col(x).alias("now"), "h").withColumn("k_target", F.col("k0") + F.col("h")).withColumn("lo", F.col("pred") - width).withColumn("hi", F.col("pred") + width)


def live_accuracy(resolved: DataFrame) -> DataFrame:
    """n, rmse, mae, coverage by model and horizon of what has been resolved so far; on a stream, in update mode."""
    y, p = F.col("actual"), F.col("pred")
    return resolved.where(y.isNotNull() & p.isNotNull()).groupBy("model", "h").agg(F.count("*").alias("n"), M.rmse(y, p).alias("rmse"), M.mae(y, p).alias("mae"), M.coverage(y, F.col("lo"), F.col("hi")).alias("coverage"))


#: Of a model whose errors are not known yet.
UNKNOWN_WEIGHT = 1e-9


def combined(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """Forecasts of the ensemble: weighted means over the models of an origin (equal weights where none is known yet)."""
    w = forecasts.join(weights.select("cell", "k0", "model", "weight"), ["cell", "k0", "model"], "left").withColumn("weight", F.coalesce("weight", F.lit(UNKNOWN_WEIGHT)))
    mean = lambda c: (F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c)
    out = w.where("weight > 0").groupBy("cell", "grp", "k0", "h", "k_target").agg(mean("pred"), F.first("now").alias("now"), mean("lo"), mean("hi"))
    return out.withColumn("model", F.lit("ensemble"))


#: Origins whose errors count: the weight of an older one is below 1e-36.
EWMA_ROWS = 512


def ewma_error(resolved: DataFrame, decay: float = 0.85) -> DataFrame:
    """Exponentially weighted squared error after each resolved one-step forecast; the first one starts it."""
    w = Window.partitionBy("cell", "model").orderBy("k0")
    d = resolved.where((F.col("h") == 1) & F.col("actual").isNotNull()).withColumn("e2", F.pow(F.col("actual") - F.col("pred"), 2))
    d = d.withColumns({"n": F.row_number().over(w), "recent": F.collect_list("e2").over(w.rowsBetween(-(EWMA_ROWS - 1), 0))})
    fold = F.aggregate(F.slice("recent", 2, EWMA_ROWS), F.element_at("recent", 1), lambda a, v: a * decay + v * (1 - decay))
    return d.withColumn("err", fold).drop("recent")


def ensemble_weights(errors: DataFrame, warm_up: int = 5, limit: float = 9.0) -> DataFrame:
    """weight by (cell, k0, model): inverse error; models far worse than the median get none."""
    w = Window.partitionBy("cell", "k0")
    ready = F.col("n") >= warm_up
    d = errors.withColumn("median", F.percentile(F.when(ready, F.col("err")), F.lit(0.5)).over(w))
    raw = F.when(F.col("median").isNull(), 1.0).when(~ready, 1 / (F.col("median") + 1e-6)).when(F.col("err") > limit * F.col("median"), 0.0).otherwise(1 / (F.col("err") + 1e-6))
    return d.withColumn("raw", raw).withColumn("weight", F.try_divide(F.col("raw"), F.sum("raw").over(w))).drop("raw", "median")


def _last_rows(rows: int):
    return Window.partitionBy("cell").orderBy("k").rowsBetween(-(rows - 1), 0)


def _line(x: str, rows: int = 20) -> dict[str, Column]:
    k, w = F.col("k").cast("double"), _last_rows(rows)
    return {"__n": F.count(x).over(w), "__b": F.regr_slope(x, k).over(w), "__a": F.regr_intercept(x, k).over(w)}


#: What persistence, trailing_mean and linear_trend read of the rows before, and the forecast h cycles ahead from that.
WITHIN = {
    "persistence": (lambda x: {}, lambda x, h: F.col(x)),
    "trailing mean": (lambda x: {"__m": F.avg(x).over(_last_rows(10))}, lambda x, h: F.col("__m")),
    "linear trend": (_line, lambda x, h: F.when(F.col("__n") >= 3, F.col("__a") + F.col("__b") * (F.col("k") + h)).otherwise(F.col(x))),
}


def weighed(df: DataFrame, models: tuple[str, ...], x: str = "held", y: str = "soh", horizons=(1, *HORIZONS), decay: float = 0.85, warm_up: int = 5, limit: float = 9.0) -> DataFrame:
    """df, where x is known, with __actual (y so many cycles ahead, by horizon), __pred (the forecasts from x, by model and
    horizon), __known and __weight (ensemble_weights of ewma_error, by model): what a study needs of an origin is in its row, so
    that rows are sorted before and not after there is one for each model and horizon. A cycle is one row."""
    w = Window.partitionBy("cell").orderBy("k")
    ahead = F.array(*(F.when(F.col("cell").isNotNull(), F.first(y).over(w.rangeBetween(h, h))) for h in horizons))
    d = df.withColumn("__actual", ahead).where(F.col(x).isNotNull())
    for m in models:
        d = d.withColumns(WITHIN[m][0](x))
    pred = F.array(*(F.array(*(WITHIN[m][1](x, F.lit(h)).cast("double") for h in horizons)) for m in models))
    d = d.withColumn("__pred", pred).drop("__m", "__n", "__b", "__a")
    one = list(horizons).index(1)
    actual = F.get("__actual", F.lit(one))
    d = d.withColumn("__known", actual.isNotNull())
    w = Window.partitionBy("cell", "__known").orderBy("k")
    recent = [F.collect_list(F.pow(actual - F.get(F.get("__pred", F.lit(i)), F.lit(one)), 2)).over(w.rowsBetween(-(EWMA_ROWS - 1), 0)) for i in range(len(models))]
    d = d.withColumns({"__n": F.row_number().over(w), **{f"__e{i}": c for i, c in enumerate(recent)}})
    fold = lambda c: F.aggregate(F.slice(c, 2, EWMA_ROWS), F.get(c, F.lit(0)), lambda a, v: a * decay + v * (1 - decay))
    d = d.withColumn("__err", F.array(*(F.when(F.col("__known"), fold(f"__e{i}")) for i in range(len(models))))).drop(*(f"__e{i}" for i in range(len(models))))
    some = F.sort_array(F.filter("__err", lambda e: e.isNotNull()))
    at = lambda i: F.get("__some", F.floor(i / 2).cast("int"))
    d = d.withColumn("__some", some).withColumn("__median", F.when(F.col("__n") >= warm_up, 0.5 * at(F.size("__some") - 1) + 0.5 * at(F.size("__some"))))
    raw = F.transform("__err", lambda e: F.when(F.col("__median").isNull(), 1.0).when(e > limit * F.col("__median"), 0.0).otherwise(1 / (e + 1e-6)))
    d = d.withColumn("__raw", raw).withColumn("__sum", F.aggregate("__raw", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))))
    weight = F.when(F.col("__known"), F.transform("__raw", lambda v: F.try_divide(v, F.col("__sum"))))
    return d.withColumn("__weight", weight).drop("__n", "__err", "__some", "__median", "__raw", "__sum")


def weights_of(d: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """cell, k0, model, weight of a table that is weighed."""
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.get("__weight", F.lit(i)).alias("weight")) for i, m in enumerate(models)))
    return d.where("__known").select("cell", F.col("k").alias("k0"), F.inline(each))


def logs_of(d: DataFrame, models: tuple[str, ...], width: float, x: str = "held", horizons=(1, *HORIZONS)) -> DataFrame:
    """The resolved log of the models and their ensemble (as combined has it), of a table that is weighed."""
    weight = {m: F.coalesce(F.get("__weight", F.lit(i)), F.lit(UNKNOWN_WEIGHT)) for i, m in enumerate(models)}
    d = d.withColumn("__used", F.array(*(F.when(weight[m] > 0, weight[m]) for m in sorted(models))))
    d = d.withColumn("__all", F.aggregate("__used", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))))
    place = {m: i for i, m in enumerate(models)}

    def row(m: str, j: int, h: int, pred: Column, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit(m).alias("model"), F.col("k").alias("k0"), pred.alias("pred"), F.col(x).alias("now"), F.lit(h).alias("h"), (F.col("k") + h).alias("k_target"), lo.alias("lo"), hi.alias("hi"), F.get("__actual", F.lit(j)).alias("actual"))

    def mean(j: int, shift: float) -> Column:
        parts = [F.get("__used", F.lit(i)) * (F.get(F.get("__pred", F.lit(place[m])), F.lit(j)) + shift) for i, m in enumerate(sorted(models))]
        total = F.lit(0.0)
        for p in parts:
            total = total + F.coalesce(p, F.lit(0.0))
        return F.when(F.coalesce(*parts).isNotNull(), total / F.col("__all"))

    rows = []
    for j, h in enumerate(horizons):
        for m in models:
            pred = F.get(F.get("__pred", F.lit(place[m])), F.lit(j))
            rows.append(row(m, j, h, pred, pred - width, pred + width))
        rows.append(F.when(F.col("__all") > 0, row("ensemble", j, h, mean(j, 0.0), mean(j, -width), mean(j, width))))
    return d.select("cell", "grp", F.inline(F.array_compact(F.array(*rows))))
