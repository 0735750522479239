"""Health-indicator scores: monotonicity, trendability, prognosability, leave-one-cell-out ridge, correlations, fade rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellspan.operators.quality import rolling_median
from cellspan.sources.staging import staged


def average_rank(x: str, by: list[str]) -> Column:
    """Rank of x within `by`; equal values share their mean rank."""
    w = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0


def unpivot(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Long form (keys, hi, x), so all indicators go through one plan."""
    return df.unpivot(keys, columns, "hi", "x")


def monotonicity(long: DataFrame, by: list[str], order: str = "k", x: str = "x") -> DataFrame:
    """|rises - falls| / (n - 1) of the smoothed series (rolling median of 5); null below 3 values."""
    w = Window.partitionBy(*by).orderBy(order)
    s = long.where(F.col(x).isNotNull()).withColumn("s", rolling_median(F.col(x), w, 2))
    d = s.withColumn("d", F.signum(F.col("s") - F.lag("s").over(w)))
    n = F.count("*")
    return d.groupBy(*by).agg(F.when(n >= 3, F.abs(F.sum("d")) / (n - 1)).alias("mono"), n.alias("n"))


def spearman(long: DataFrame, by: list[str], order: str = "k", x: str = "x") -> DataFrame:
    """Rank correlation of x with the order; null for a constant series."""
    r = long.where(F.col(x).isNotNull())
    r = r.withColumn("rx", average_rank(x, by)).withColumn("rk", average_rank(order, by))
    return r.groupBy(*by).agg(F.try_divide(F.covar_pop("rk", "rx"), F.stddev_pop("rk") * F.stddev_pop("rx")).alias("rho"))


#: What an indicator needs to be scored (fixed values): known rows overall, known rows of a cell with some spread, such cells.
LEAST_ROWS, LEAST_OWN, LEAST_CELLS = 10, 8, 2


def ends(long: DataFrame, by: list[str], order: str = "k", x: str = "x") -> DataFrame:
    """first, last: means of the first and last three values of the smoothed series (rolling median of 5); n, and whether the
    series has any spread."""
    w = Window.partitionBy(*by).orderBy(order)
    s = long.where(F.col(x).isNotNull()).withColumns({"s": rolling_median(F.col(x), w, 2), "i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*by))})
    return s.groupBy(*by).agg(F.avg(F.when(F.col("i") <= 3, F.col("s"))).alias("first"), F.avg(F.when(F.col("i") > F.col("n") - 3, F.col("s"))).alias("last"), F.count("*").alias("n"), (F.max(x) > F.min(x)).alias("spread"))


def prognosability(known: DataFrame, by: list[str]) -> DataFrame:
    """exp(-spread of the last values / mean range) over the cells of each indicator; known: rows of `ends`."""
    return known.groupBy(*by).agg(F.exp(-F.stddev_pop("last") / (F.avg(F.abs(F.col("last") - F.col("first"))) + 1e-12)).alias("prog"), F.count("*").alias("n_cells"))


def scores(df: DataFrame, columns: list[str], cell: str = "cell", order: str = "k") -> DataFrame:
    """hi, n_cells, mono, trend, prog, score: means over the cells that an indicator can be scored on; all indicators in one pass
    over the long form. Indicators with too few rows or cells are out; a missing score does not count in the mean."""
    long = unpivot(df, columns, [cell, order])
    each = ends(long, [cell, "hi"], order)
    enough = each.groupBy("hi").agg(F.sum("n").alias("rows")).where(F.col("rows") >= LEAST_ROWS).select("hi")
    known = each.where((F.col("n") >= LEAST_OWN) & F.col("spread")).join(F.broadcast(enough), "hi")  # a row for each column
    cells = known.select(cell, "hi")
    mono = monotonicity(long, [cell, "hi"], order).join(cells, [cell, "hi"]).groupBy("hi").agg(F.avg("mono").alias("mono"))
    trend = spearman(long, [cell, "hi"], order).join(cells, [cell, "hi"]).groupBy("hi").agg(F.avg(F.abs("rho")).alias("trend"))
    out = prognosability(known, ["hi"]).where(F.col("n_cells") >= LEAST_CELLS).join(mono, "hi", "left").join(trend, "hi", "left")
    three = [F.col(c) for c in ("mono", "trend", "prog")]
    score = sum((F.coalesce(c, F.lit(0.0)) for c in three), F.lit(0.0)) / sum((c.isNotNull().cast("int") for c in three), F.lit(0))
    return out.select("hi", "n_cells", "mono", "trend", "prog", score.alias("score"))


def first_baseline(df: DataFrame, columns: list[str], cell: str = "cell", order: str = "k", n: int = 3) -> DataFrame:
    """columns minus the mean of their first n known values in the cell."""
    out = df
    for c in columns:
        rank = F.sum(F.col(c).isNotNull().cast("int")).over(Window.partitionBy(cell).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("__rank", rank)
        base = F.avg(F.when((F.col("__rank") <= n) & F.col(c).isNotNull(), F.col(c))).over(Window.partitionBy(cell))
        out = out.withColumn(f"{c}_rel", F.col(c) - base).drop("__rank")
    return out


def loco_ridge(df: DataFrame, x: str, y: str, cell: str = "cell", alpha: float = 1e-3) -> DataFrame:
    """Error on each cell of a ridge line through all others.

    No cell is joined with the others: sums of all cells minus its own give the others' sums. x is standardised with the
    others' moments and the intercept is penalised as well.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    parts = {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(y), "syy": F.col(y) * F.col(y)}
    own = d.groupBy(cell).agg(*(F.sum(v).alias(k) for k, v in parts.items()))
    total = own.agg(*(F.sum(k).alias(f"t_{k}") for k in parts), F.count("*").alias("cells"))
    t = own.join(F.broadcast(total), F.col("cells") >= 3)  # the total is one row
    o = {k: F.col(f"t_{k}") - F.col(k) for k in parts}
    m = t.select(cell, *parts, *(v.alias(f"o_{k}") for k, v in o.items()))
    mu = F.col("o_sx") / F.col("o_n")
    sd = F.sqrt(F.greatest(F.col("o_sxx") / F.col("o_n") - mu * mu, F.lit(0.0))) + 1e-12
    m = m.withColumn("mu", mu).withColumn("sd", sd)
    szz = (F.col("o_sxx") - 2 * F.col("mu") * F.col("o_sx") + F.col("o_n") * F.col("mu") * F.col("mu")) / (F.col("sd") * F.col("sd"))
    szy = (F.col("o_sxy") - F.col("mu") * F.col("o_sy")) / F.col("sd")
    m = m.withColumn("b", szy / (szz + alpha)).withColumn("a", F.col("o_sy") / (F.col("o_n") + alpha))
    # sum of squared errors on the own cell from its sums, with slope b/sd and intercept a - b*mu/sd
    m = m.withColumn("s", F.col("b") / F.col("sd")).withColumn("c", F.col("a") - F.col("b") * F.col("mu") / F.col("sd"))
    sse = F.col("syy") + F.col("s") * F.col("s") * F.col("sxx") + F.col("n") * F.col("c") * F.col("c") - 2 * F.col("s") * F.col("sxy") - 2 * F.col("c") * F.col("sy") + 2 * F.col("s") * F.col("c") * F.col("sx")
    return m.select(cell, F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("rmse"))


def correlation_flags(df: DataFrame, columns: list[str], limit: float = 0.7) -> DataFrame:
    """a, b, r, flagged for every pair of columns, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(each).alias("p")).select("p.*").withColumn("flagged", F.coalesce(F.abs("r") > limit, F.lit(False)))


#: Widths of the three parts that a slope's 64 ordered bits are selected by.
_PARTS = (22, 21, 21)
#: Slopes that a task holds at once.
_SLOPES = 1 << 20


def _slopes(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Slopes from each (x, y) to each (u, v) right of it; all NaN alike."""
    dx = u[None, :] - x[:, None]
    ok = dx > 0
    out = (v[None, :] - y[:, None])[ok] / dx[ok] + 0.0
    return np.where(np.isnan(out), np.nan, out)


def _middle(slopes: np.ndarray) -> np.ndarray:
    """Medians of the last axis, NaN last in order."""
    n = slopes.shape[-1]
    at = [(n - 1) // 2, n // 2]
    two = np.partition(slopes, sorted(set(at)), axis=-1)[..., at]
    return (two[..., 0] + two[..., 1]) / 2


def _block_medians(blocks: DataFrame, by: str) -> DataFrame:
    """by, n, m: median slope of cells that are one block; cells of equal length in one array, at most _SLOPES of their pairs."""

    def run(frames):
        for pdf in frames:
            m = np.full(len(pdf), np.nan)
            known = np.zeros(len(pdf), bool)
            lengths = pdf["n"].to_numpy()
            for n in np.unique(lengths[lengths > 1]).tolist():
                i, j = np.triu_indices(n, 1)
                rows = np.flatnonzero(lengths == n)
                for part in np.array_split(rows, max(1, len(rows) * len(i) // _SLOPES)):
                    x, y = (np.stack([pdf[c].iat[r] for r in part]) for c in ("xs", "ys"))
                    plain = (x[:, 1:] > x[:, :-1]).all(axis=1)
                    if plain.any():
                        a, b = x[plain], y[plain]
                        m[part[plain]] = _middle((b[:, j] - b[:, i]) / (a[:, j] - a[:, i]))
                        known[part[plain]] = True
                    for r, a, b in zip(part[~plain], x[~plain], y[~plain], strict=True):
                        if len(s := _slopes(a, b, a, b)):
                            m[r], known[r] = _middle(s), True
            yield pd.DataFrame({by: pdf[by], "n": lengths, "m": pd.arrays.FloatingArray(m, ~known)})

    return blocks.select(by, "n", "xs", "ys").mapInPandas(run, f"{by} {blocks.schema[by].dataType.simpleString()}, n long, m double")


def _slope_bins(units: DataFrame, level: int, by: str) -> DataFrame:
    """by, which, bin, n: how many slopes of the units' pairs fall in each bin of a part of their ordered bits; from the
    second part on only slopes that begin with `prefix`."""
    shift = 64 - sum(_PARTS[: level + 1])

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                bits = _slopes(r.ax, r.ay, r.bx, r.by_).view(np.uint64)
                bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)) >> np.uint64(shift)
                if level:
                    bits = bits[bits >> np.uint64(_PARTS[level]) == np.uint64(r.prefix)] & np.uint64((1 << _PARTS[level]) - 1)
                bins, n = np.unique(bits, return_counts=True)
                yield pd.DataFrame({by: np.full(len(bins), getattr(r, by), object), "which": r.which, "bin": bins.astype(np.int64), "n": n})

    schema = f"{by} {units.schema[by].dataType.simpleString()}, which int, bin long, n long"
    return units.mapInPandas(run, schema).groupBy(by, "which", "bin").agg(F.sum("n").alias("n"))


def theil_sen(df: DataFrame, x: str = "k", y: str = "cap", by: str = "cell", least: int = 10, block: int = 256) -> DataFrame:
    """Median of the slopes between all pairs of a cell's rows with different x; null below `least` rows.

    Rows are gathered in blocks, staged once. A cell of one block has its median where it lies. Of a longer history a task takes
    pairs of blocks and only counts of slopes by bins leave it: the two middle slopes are selected exactly, part by part of their
    bits, in three passes. Both give the same numbers.
    """
    d = df.where(F.col(y).isNotNull()).select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    place = F.floor((F.row_number().over(Window.partitionBy(by).orderBy("x", "y")) - 1) / block)
    listed = d.withColumns({"i": place, "n": F.count("*").over(Window.partitionBy(by))}).groupBy(by, "n", "i").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("s"))
    blocks = staged(listed.select(by, "n", "i", F.col("s.x").alias("xs"), F.col("s.y").alias("ys")), "slopes")
    out = _block_medians(blocks.where(F.col("n") <= block), by)
    if not (long := blocks.where(F.col("n") > block)).isEmpty():
        out = out.unionByName(_long_medians(long, by))
    return out.select(by, F.when(F.col("n") >= least, F.col("m")).alias("slope"))


def _long_medians(blocks: DataFrame, by: str) -> DataFrame:
    """by, n, m: median slope of cells of many blocks."""
    right = blocks.select(F.col(by).alias("__by"), F.col("i").alias("j"), F.col("xs").alias("bx"), F.col("ys").alias("by_"))
    units = blocks.join(right, (F.col(by) == F.col("__by")) & (F.col("i") <= F.col("j"))).select(by, F.col("xs").alias("ax"), F.col("ys").alias("ay"), "bx", "by_")
    w = Window.partitionBy(by, "which").orderBy("bin")
    upto = lambda bins: bins.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(by, "which"))})
    first = upto(_slope_bins(units.withColumns({"which": F.lit(0), "prefix": F.lit(0).cast("long")}), 0, by))
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("all") + 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), (F.floor(F.col("all") / 2) + 1).alias("rank")))).alias("r")
    inside = (F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto"))
    found = first.select(by, "bin", "n", "upto", ranks).select(by, "bin", "n", "upto", "r.*").where(inside).select(by, "which", F.col("bin").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    for level in (1, 2):
        bins = upto(_slope_bins(units.join(found.drop("rank"), by), level, by)).join(found, [by, "which"])
        found = bins.where(inside).select(by, "which", F.shiftleft("prefix", _PARTS[level]).bitwiseOR(F.col("bin")).alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))

    def values(frames):
        for pdf in frames:
            bits = pdf["prefix"].to_numpy(np.int64).view(np.uint64)
            back = np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits)
            yield pd.DataFrame({by: pdf[by], "m": back.view(np.float64)})

    middle = found.select(by, "prefix").mapInPandas(values, f"{by} {blocks.schema[by].dataType.simpleString()}, m double").groupBy(by).agg(F.avg("m").alias("m"))
    return blocks.where("i = 0").select(by, "n").join(middle, by, "left").select(by, "n", "m")


def fade_rates(df: DataFrame, y: str = "cap", by: str = "cell", max_k: int | None = None) -> DataFrame:
    """Loss per 100 cycles by the robust slope."""
    d = df if max_k is None else df.where(F.col("k") <= max_k)
    return theil_sen(d, "k", y, by).select(by, (-100 * F.col("slope")).alias("fade_rate"))


#: What a cell's loss may depend on (fixed values).
STRESS_FACTORS = ("ambient", "I_mean", "cutoff_V", "pulsed", "T_rise")


def stress_table(df: DataFrame, by: str = "cell", max_k: int | None = None, least: int = 10) -> DataFrame:
    """by, n, fade_rate and the STRESS_FACTORS of cells with at least so many good rows: medians (of values rounded to four digits)
    over these, for flags the share of rows that have them; factors that df has no column for are left out.

    df: by, k, soh, outlier. Unknown values count in no median; a cell without any has a null.
    """
    good = df.where(~F.col("outlier") & F.col("soh").isNotNull())
    good = good if max_k is None else good.where(F.col("k") <= max_k)
    flag = lambda c: df.schema[c].dataType.typeName() == "boolean"
    value = lambda c: F.avg(F.col(c).cast("double")) if flag(c) else F.percentile(F.round(F.col(c).cast("double"), 4), F.lit(0.5))
    own = good.groupBy(by).agg(F.count("*").alias("n"), *(value(c).alias(c) for c in STRESS_FACTORS if c in df.columns))
    return own.where(F.col("n") >= least).join(fade_rates(good, "soh", by), by)
