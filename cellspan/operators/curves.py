"""Curves of single cycles and what is read off them: resampling, Q(V), incremental capacity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.config import CURVE_POINTS, LOADED_A
from cellspan.functions.numeric import savgol
from cellspan.operators.features import running_charge


def curve_rows(samples: DataFrame, n: int = CURVE_POINTS) -> DataFrame:
    """Cell_ID, Cycle_Index, j, t, v, i, q: discharge cycles from their first to their last loaded sample, idle ones between them
    included, with time and charge counted from the first; none of fewer than five loaded samples. Longer cycles have n points
    evenly in time, on lines between samples: a sample knows the next one, so it gives the grid points up to that."""
    by = Window.partitionBy("Cell_ID", "Cycle_Index")
    order = by.orderBy("Time_s")
    loaded = F.abs("Current_A") > LOADED_A
    d = running_charge(samples.where(F.col("Cycle_Type") == "discharge")).withColumn("p", F.row_number().over(order))
    d = d.withColumns({"p0": F.min(F.when(loaded, F.col("p"))).over(by), "p1": F.max(F.when(loaded, F.col("p"))).over(by), "m": F.count(F.when(loaded, 1)).over(by)})
    d = d.where((F.col("m") >= 5) & F.col("p").between(F.col("p0"), F.col("p1")))
    first, last = F.min_by(F.struct("Time_s", "q"), "p").over(by), F.max("Time_s").over(by)
    d = d.select("Cell_ID", "Cycle_Index", "p", F.count("*").over(by).alias("size"), (F.col("p") - F.col("p0")).alias("j"), (F.col("Time_s") - first["Time_s"]).alias("t"), F.col("Voltage_V").alias("v"), F.col("Current_A").alias("i"), (F.col("q") - first["q"]).alias("q"), ((last - first["Time_s"]) / (n - 1)).alias("step"))
    whole = d.where(F.col("size") <= n).select("Cell_ID", "Cycle_Index", "j", "t", "v", F.abs("i").alias("i"), "q")
    lead = {f"{c}_next": F.lead(c).over(by.orderBy("p")) for c in "tviq"}
    place = lambda t: F.ceil(t / F.col("step") - 1e-9)
    until = F.coalesce(place(F.col("t_next")), F.lit(n)) - 1
    begin = place(F.col("t"))
    grid = d.where(F.col("size") > n).withColumns(lead).withColumn("j", F.explode(F.when(until >= begin, F.sequence(begin, until)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("j") * F.col("step")
    share = F.coalesce(F.try_divide(at - F.col("t"), F.col("t_next") - F.col("t")), F.lit(0.0))
    on = lambda c: F.col(c) + share * F.coalesce(F.col(f"{c}_next") - F.col(c), F.lit(0.0))
    return whole.unionByName(grid.select("Cell_ID", "Cycle_Index", F.col("j").cast("int").alias("j"), at.alias("t"), on("v").alias("v"), F.abs(on("i")).alias("i"), on("q").alias("q")))


def curves(samples: DataFrame, n: int = CURVE_POINTS) -> DataFrame:
    """The same as arrays t, v, i, q of a cycle, of at most n points."""
    listed = curve_rows(samples, n).groupBy("Cell_ID", "Cycle_Index").agg(F.sort_array(F.collect_list(F.struct("j", "t", "v", "i", "q"))).alias("s"))
    return listed.select("Cell_ID", "Cycle_Index", *(F.col(f"s.{c}").alias(c) for c in "tviq"))


def q_of_v(q: np.ndarray, v: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Charge at voltages: on the falling envelope; NaN outside."""
    env = np.minimum.accumulate(v)
    order = np.argsort(env, kind="stable")
    return np.interp(grid, env[order], q[order], left=np.nan, right=np.nan)


def incremental(q: np.ndarray, v: np.ndarray, n: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Voltage grid and -dQ/dV, smoothed; empty where less than 0.2 V lies between the margins."""
    if len(v) < 5 or np.ptp(v) - 0.04 < 0.2:
        return np.zeros(0), np.zeros(0)
    grid = np.linspace(v.min() + 0.02, v.max() - 0.02, n)
    return grid, -savgol(np.gradient(q_of_v(q, v, grid), grid), 9, 2)


def differential(q: np.ndarray, v: np.ndarray, n: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Charge grid and dV/dQ."""
    if len(q) < 5 or q[-1] <= 0.1:
        return np.zeros(0), np.zeros(0)
    grid = np.linspace(0.02 * q[-1], 0.98 * q[-1], n)
    return grid, savgol(np.gradient(np.interp(grid, q, v), grid), 9, 2)


#: Cycles whose points leave a task together.
CYCLES = 500


def _long(df: DataFrame, f, names: str) -> DataFrame:
    x, y = names.split()

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), CYCLES):  # one frame for so many cycles
                part = pdf.iloc[at : at + CYCLES]
                points = [f(np.asarray(q, float), np.asarray(v, float)) for q, v in zip(part["q"], part["v"], strict=True)]
                of = np.repeat(np.arange(len(part)), [len(a) for a, _ in points])
                yield pd.DataFrame({"Cell_ID": part["Cell_ID"].to_numpy(object)[of], "Cycle_Index": part["Cycle_Index"].to_numpy()[of], x: np.concatenate([a for a, _ in points]), y: np.concatenate([b for _, b in points])})

    return df.mapInPandas(run, f"Cell_ID string, Cycle_Index long, {x} double, {y} double")


def ica(df: DataFrame) -> DataFrame:
    return _long(df, incremental, "V dQdV")


def dva(df: DataFrame) -> DataFrame:
    return _long(df, differential, "Q dVdQ")


def ica_peak(df: DataFrame) -> DataFrame:
    return ica(df).groupBy("Cell_ID", "Cycle_Index").agg(F.max_by("V", "dQdV").alias("V_peak"), F.max("dQdV").alias("height"))


def delta_qv(df: DataFrame, good: DataFrame | None = None, lo: float = 3.3, hi: float = 3.9, n: int = 60) -> DataFrame:
    """Statistics of Q(V) of each cycle against the curve of the cell's third cycle (or the last where it has fewer): a join with
    one reference row per cell. good: Cell_ID, Cycle_Index of the cycles that count, such as those that are no outliers of
    cells that are not pulsed; without it all that have a curve."""
    cycles = df.select("Cell_ID", "Cycle_Index") if good is None else good.select("Cell_ID", "Cycle_Index")
    place = Window.partitionBy("Cell_ID").orderBy("Cycle_Index")
    third = cycles.withColumn("p", F.row_number().over(place)).where("p <= 3").groupBy("Cell_ID").agg(F.max("Cycle_Index").alias("Cycle_Index"))
    df = df if good is None else df.join(cycles, ["Cell_ID", "Cycle_Index"], "left_semi")
    ref = df.join(third, ["Cell_ID", "Cycle_Index"]).select("Cell_ID", F.struct("q", "v").alias("ref"))
    both = df.select("Cell_ID", "Cycle_Index", "q", "v").join(ref, "Cell_ID").select("Cell_ID", "Cycle_Index", "q", "v", F.col("ref.q").alias("rq"), F.col("ref.v").alias("rv"))
    grid = np.linspace(lo, hi, n)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                d = q_of_v(np.asarray(r.q), np.asarray(r.v), grid) - q_of_v(np.asarray(r.rq), np.asarray(r.rv), grid)
                d = d[np.isfinite(d)]
                ok = len(d) >= 10
                out.append((r.Cell_ID, r.Cycle_Index, float(np.log10(d.var() + 1e-12)) if ok else None, float(d.min()) if ok else None, float(d.mean()) if ok else None))
            yield pd.DataFrame(out, columns=["Cell_ID", "Cycle_Index", "dq_logvar", "dq_min", "dq_mean"])

    return both.mapInPandas(run, "Cell_ID string, Cycle_Index long, dq_logvar double, dq_min double, dq_mean double")
