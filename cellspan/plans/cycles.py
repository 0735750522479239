"""The cycle table: one row per cell and discharge cycle, from raw samples to state of health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.config import EOL_AH
from cellspan.operators import features, quality, rates
from cellspan.operators.asof import asof_fill
from cellspan.sources.registry import is_pulsed


def build(samples: DataFrame, impedance: DataFrame, registry: DataFrame, eol_ah: float = EOL_AH) -> tuple[DataFrame, DataFrame]:
    """(cycle table, summary by cell). Samples are normalised; cells that the registry lacks are in group Unknown."""
    table = features.discharge_features(samples)
    table = asof_fill(table, features.charge_features(samples), ["cc_time_s", "cv_time_s"])
    table = asof_fill(table, impedance, ["Re_ohm", "Rct_ohm"])
    declared = registry if "declared_pulsed" in registry.columns else registry.withColumn("declared_pulsed", is_pulsed())
    table = table.join(declared.select("Cell_ID", "grp", "ambients", "declared_pulsed"), "Cell_ID", "left")
    table = table.withColumn("grp", F.coalesce("grp", F.lit("Unknown"))).withColumn("k", F.row_number().over(Window.partitionBy("Cell_ID").orderBy("Cycle_Index")))
    table = table.withColumn("ambient", F.coalesce("ambient_obs", quality.nearest(F.col("ambients"), F.col("T_start")))).withColumnRenamed("Cell_ID", "cell")
    ok = quality.plausible(F.col("capacity"))
    table = quality.hampel(table.withColumn("masked", F.when(ok, F.col("capacity"))), "masked").drop("med", "scale", "masked", "ambients")
    table = table.withColumn("outlier", F.col("outlier") | ~ok).withColumnRenamed("capacity", "cap")
    table = rates.normalise_rate(table)
    bol = quality.robust_bol(table, "cap_norm")
    table = table.join(bol, "cell")
    early = F.col("crash") & (F.col("k") <= 20) & ((F.col("cap_norm") > 1.08 * F.col("bol")) | (F.col("cap_norm") < 0.85 * F.col("bol")))
    table = table.withColumn("outlier", F.col("outlier") | F.coalesce(early, F.lit(False))).withColumn("soh", F.col("cap_norm") / F.col("bol"))
    table = table.withColumn("soh_clean", F.when(~F.col("outlier"), F.col("soh"))).withColumn("eol_soh", eol_ah / F.col("bol"))
    pulsed = (F.avg(F.col("pulsed").cast("int")) > 0.5) | F.coalesce(F.max("declared_pulsed"), F.lit(False))
    extra = table.groupBy("cell").agg(F.first("bol").alias("bol"), F.first("crash").alias("crash"), pulsed.alias("pulsed"), F.max("normalised").alias("normalised"), F.max("rate_coef").alias("rate_coef"))
    summary = quality.cell_summary(table, "cap_norm").join(extra, "cell").join(quality.detect_eol(table, "cap_norm", threshold=eol_ah), "cell")
    return table, summary
