"""Outliers, beginning and end of life, by cell. All plans are windows and aggregations partitioned by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.config import BOL_CYCLES, EOL_AH, EOL_CONSECUTIVE, HAMPEL_FLOOR, HAMPEL_K, HAMPEL_WINDOW, PLAUSIBLE_AH


def rolling_median(x: Column, w, half: int) -> Column:
    """Of the known values in a frame of 2 * half + 1 rows, which are one short sorted array."""
    frame = F.array(F.sort_array(F.collect_list(x).over(w.rowsBetween(-half, half))))
    at = lambda s, i: F.get(s, F.floor(i / 2).cast("int"))
    return F.get(F.transform(frame, lambda s: 0.5 * at(s, F.size(s) - 1) + 0.5 * at(s, F.size(s))), F.lit(0))


def hampel(df: DataFrame, x: str = "cap", by: str = "cell", order: str = "k", half: int = HAMPEL_WINDOW, k: float = HAMPEL_K, floor: float = HAMPEL_FLOOR) -> DataFrame:
    """df with med, scale and outlier: |x - rolling median| > k * max(1.4826 * rolling MAD, floor * median |x|)."""
    w = Window.partitionBy(by).orderBy(order)
    out = df.withColumn("med", rolling_median(F.col(x), w, half)).withColumn("resid", F.abs(F.col(x) - F.col("med")))
    mad = 1.4826 * rolling_median(F.col("resid"), w, half)
    least = floor * F.percentile(F.abs(F.col(x)), F.lit(0.5)).over(Window.partitionBy(by))
    out = out.withColumn("scale", F.greatest(mad, least))
    return out.withColumn("outlier", F.coalesce(F.col("resid") > k * F.col("scale"), F.lit(False))).drop("resid")


def plausible(x: Column, limits=PLAUSIBLE_AH) -> Column:
    return F.coalesce(x.between(*limits), F.lit(False))


def _early_life(df: DataFrame, x: str, by: str, order: str, outlier: str, limits) -> tuple[DataFrame, dict[str, Column]]:
    """df with marks of a cell's first rows, and the aggregates over a cell that its begin of life follows from."""
    w = Window.partitionBy(by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first = df.withColumns({"__early": F.row_number().over(w) <= 20, "__fin": F.count(x).over(upto)})
    first = first.withColumn("__ok", F.col("__early") & plausible(F.col(x), limits) & ~F.col(outlier))
    ranked = first.withColumn("__j", F.sum(F.col("__ok").cast("int")).over(upto))
    some = lambda cond: F.percentile(F.when(cond, F.col(x)), F.lit(0.5))
    j, good = F.col("__j"), F.col("__ok")
    n = BOL_CYCLES
    return ranked, {
        "n_ok": F.sum(good.cast("int")),
        "first": some(good & (j <= n)),
        "later": some(good & (j > n) & (j <= n + 10)),
        "late": some(good & (j > n) & (j <= n + 15)),
        "any": some((F.col("__fin") <= 5) & F.col(x).isNotNull()),
        "bad": F.avg(F.when(F.col("__early"), (~plausible(F.col(x), limits)).cast("int"))),
    }


def _begin(prefix: str = "") -> tuple[Column, Column]:
    """bol and crash from the aggregates of _early_life."""
    c = lambda name: F.col(prefix + name)
    mismatch = F.coalesce((c("n_ok") >= BOL_CYCLES + 5) & (F.abs(c("first") / c("later") - 1) > 0.08), F.lit(False))
    bol = F.when(c("n_ok") == 0, c("any")).when(mismatch, c("late")).otherwise(c("first"))
    return bol, (c("n_ok") == 0) | mismatch | (c("bad") > 0.2)


def robust_bol(df: DataFrame, x: str = "cap", by: str = "cell", order: str = "k", outlier: str = "outlier", limits=PLAUSIBLE_AH) -> DataFrame:
    """bol and crash by cell, from its first 20 rows.

    Plausible good rows give the median of the first five; if the next ten differ by more than 8 %, the logging had crashed
    and the median of the fifteen after those five counts. Without a plausible row: the median of the first five values.
    """
    ranked, parts = _early_life(df, x, by, order, outlier, limits)
    bol, crash = _begin()
    return ranked.groupBy(by).agg(*(v.alias(c) for c, v in parts.items())).select(by, bol.alias("bol"), crash.alias("crash"))


def with_bol(df: DataFrame, x: str = "cap", by: str = "cell", order: str = "k", outlier: str = "outlier", limits=PLAUSIBLE_AH) -> DataFrame:
    """df with the bol and crash of its cell: robust_bol next to the rows, which are read and sorted once."""
    ranked, parts = _early_life(df, x, by, order, outlier, limits)
    bol, crash = _begin("__")
    out = ranked.withColumns({f"__{c}": v.over(Window.partitionBy(by)) for c, v in parts.items()}).withColumns({"bol": bol, "crash": crash})
    return out.drop("__early", "__fin", "__ok", "__j", *(f"__{c}" for c in parts))


def detect_eol(df: DataFrame, x: str = "cap", by: str = "cell", order: str = "k", outlier: str = "outlier", threshold: float = EOL_AH, n: int = EOL_CONSECUTIVE) -> DataFrame:
    """eol_k and eol_status by cell: the first of n good rows in a row below the threshold; outliers are taken out before."""
    good = F.col(x).isNotNull() & ~F.col(outlier)
    w = Window.partitionBy(by, "good").orderBy(order).rowsBetween(0, n - 1)
    run = df.withColumn("good", good).withColumn("run", F.sum((F.col(x) < threshold).cast("int")).over(w))
    agg = run.groupBy(by).agg(F.sum(F.col("good").cast("int")).alias("n"), F.min(F.when(F.col("good") & (F.col("run") == n), F.col(order))).alias("eol_k"))
    status = F.when(F.col("n") < n, "insufficient data").when(F.col("eol_k").isNotNull(), "reached").otherwise("EOL not reachable in data")
    return agg.select(by, F.when(F.col("n") >= n, F.col("eol_k")).alias("eol_k"), status.alias("eol_status"))


def level(x: Column, step: float) -> Column:
    """To the nearest step, halves to even."""
    return F.rint(x / step) * step


def level_mode(df: DataFrame, value: Column, by: str = "cell") -> DataFrame:
    """The most frequent level of each cell (the smallest of equally frequent ones) and the number of levels."""
    counts = df.where(value.isNotNull()).groupBy(by, value.alias("level")).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by("level", F.struct("n", -F.col("level"))).alias("mode"), F.count("*").alias("levels"))


def nearest(values: Column, to: Column) -> Column:
    """The element of an array nearest to `to`, the first of equally near ones."""
    each = F.transform(values, lambda v, i: F.struct(F.abs(v - to).alias("d"), i.alias("i"), v.alias("v")))
    return F.array_min(each)["v"]


def cell_summary(df: DataFrame, x: str = "cap", by: str = "cell") -> DataFrame:
    """One row per cell of a series with outlier flags: counts, last good value, medians, current levels."""
    good = ~F.col("outlier") & F.col(x).isNotNull()
    return df.groupBy(by, "grp").agg(
        F.count("*").cast("int").alias("n_cycles"),
        F.max_by(F.when(good, F.col(x)), F.when(good, F.col("k"))).alias("last_cap"),
        F.sum(F.col("outlier").cast("int")).alias("n_outliers"),
        F.percentile("ambient", F.lit(0.5)).alias("ambient"),
        F.percentile("I_mean", F.lit(0.5)).alias("I_mean"),
        F.countDistinct(level(F.col("I_mean"), 0.5)).cast("int").alias("I_levels"),
    )
