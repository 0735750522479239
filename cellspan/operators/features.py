"""Features of discharge and charge cycles from ordered samples: one window sort and one aggregation by (cell, cycle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.config import CV_VOLT, LOADED_A

KEYS = ["Cell_ID", "Cycle_Index"]


def trapezoid(y, x, w):
    """One step of the trapezoid rule against the row before in window w (null at the first)."""
    return (y + F.lag(y).over(w)) / 2 * (x - F.lag(x).over(w))


def running_charge(samples: DataFrame) -> DataFrame:
    """q: charge in Ah so far within the cycle, steps clipped at 0."""
    w = Window.partitionBy(*KEYS).orderBy("Time_s")
    step = F.greatest(trapezoid(F.abs("Current_A"), F.col("Time_s"), w) / 3600, F.lit(0.0))
    stepped = samples.withColumn("dq", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("q", F.sum("dq").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("dq")


def discharge_features(samples: DataFrame) -> DataFrame:
    """One row per discharge cycle with at least three loaded samples.

    Integrals run over loaded samples only, so they bridge idle gaps by a trapezoid.
    """
    d = samples.where(F.col("Cycle_Type") == "discharge")
    if "Ambient_C" not in d.columns:
        d = d.withColumn("Ambient_C", F.lit(None).cast("double"))
    a = F.abs("Current_A")
    loaded = F.coalesce(a > LOADED_A, F.lit(False))
    w = Window.partitionBy(*KEYS).orderBy("Time_s")
    whole = Window.partitionBy(*KEYS)
    d = d.withColumn("a", a).withColumn("on", loaded).withColumn("i", F.row_number().over(w))
    d = d.withColumn("p", F.min(F.when(F.col("on"), F.col("i"))).over(whole)).withColumn("q", F.max(F.when(F.col("on"), F.col("i"))).over(whole))
    # the loaded sample before this one, as values carried forward
    before = F.last(F.when(F.col("on"), F.struct("Time_s", "a", (F.abs(F.col("Voltage_V") * F.col("Current_A"))).alias("w"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("b", before)
    dt = F.col("Time_s") - F.col("b.Time_s")
    ah = F.when(F.col("on"), (F.col("a") + F.col("b.a")) / 2 * dt / 3600)
    wh = F.when(F.col("on"), (F.abs(F.col("Voltage_V") * F.col("Current_A")) + F.col("b.w")) / 2 * dt / 3600)
    within = (F.col("i") >= F.col("p")) & (F.col("i") <= F.col("q"))
    on = F.col("on")
    agg = d.groupBy(*KEYS).agg(
        F.sum(on.cast("int")).alias("n_on"),
        F.max("Capacity_Ah").alias("recorded"),
        F.sum(F.greatest(ah, F.lit(0.0))).alias("integrated"),
        F.avg(F.when(on, F.col("a"))).alias("I_mean"),
        F.sqrt(F.avg(F.when(within, F.col("Current_A") * F.col("Current_A")))).alias("I_rms"),
        (1 - F.sum(on.cast("int")) / (F.max("q") - F.max("p") + 1) > 0.25).alias("pulsed"),
        F.min_by("Temp_C", "Time_s").alias("T_start"),
        F.avg("Temp_C").alias("T_mean"),
        F.max("Temp_C").alias("T_max"),
        F.avg(F.when(on, F.col("Voltage_V"))).alias("V_mean"),
        F.min(F.when(on, F.col("Voltage_V"))).alias("V_min"),
        (F.max(F.when(on, F.col("Time_s"))) - F.min(F.when(on, F.col("Time_s")))).alias("duration_s"),
        F.sum(wh).alias("energy_Wh"),
        F.max(F.when(F.col("i") < F.col("p"), F.col("Voltage_V"))).alias("v0"),
        F.max(F.when(F.col("i") == F.col("p"), F.col("Voltage_V"))).alias("v1"),
        F.max(F.when(F.col("i") == F.col("p"), F.col("a"))).alias("a1"),
        F.avg("Ambient_C").alias("ambient_obs"),
    )
    r0 = F.when(F.col("a1") > 0.5, (F.col("v0") - F.col("v1")) / F.col("a1"))
    capacity = F.when((F.col("recorded") > 0) & (F.col("recorded") < float("inf")), F.col("recorded")).otherwise(F.col("integrated"))
    return agg.where("n_on >= 3").select(*KEYS, capacity.alias("capacity"), "I_mean", "I_rms", "pulsed", "T_start", "T_mean", "T_max", (F.col("T_max") - F.col("T_start")).alias("T_rise"), "V_mean", "V_min", "duration_s", "energy_Wh", F.when((r0 > 0) & (r0 < 1), r0).alias("R0"), "ambient_obs")


def charge_features(samples: DataFrame) -> DataFrame:
    """Time to the first sample at the constant-voltage limit, and from there to the end, per charge cycle of 3+ samples."""
    c = samples.where(F.col("Cycle_Type") == "charge").groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min("Time_s").alias("t0"), F.max("Time_s").alias("t1"), F.min(F.when(F.col("Voltage_V") >= CV_VOLT, F.col("Time_s"))).alias("hit")
    )
    return c.where("n >= 3").select(*KEYS, (F.col("hit") - F.col("t0")).alias("cc_time_s"), (F.col("t1") - F.col("hit")).alias("cv_time_s"))
