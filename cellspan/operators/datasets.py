"""Training tables: cycles with indicators relative to a cell's early life, and origins with what was known then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inputs of health models; none is derived from capacity (fixed values).
SOH_FEATURES = ("k", "R0", "Re_ohm", "Rct_ohm", "T_rise", "T_mean", "cc_time_s", "cv_time_s", "V_mean", "I_mean", "ambient")
RELATIVE = ("R0", "Re_ohm", "Rct_ohm", "cc_time_s", "cv_time_s", "V_mean")
FADE_FEATURES = ("k0", "soh_now", "slope20", "curv40", "I_mean", "ambient", "cutoff_V", "dq_logvar", "dq_min", "dq_mean", "R0_rel", "Rct_rel")


def relative(df: DataFrame, columns, cell: str = "cell", order: str = "k", n: int = 3) -> DataFrame:
    """columns divided by the mean of their first n known values in the cell (null where there are none)."""
    w = Window.partitionBy(cell).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumns({f"__n_{c}": F.count(c).over(w) for c in columns})
    whole = Window.partitionBy(cell)
    base = {c: F.avg(F.when(F.col(f"__n_{c}") <= n, F.col(c))).over(whole) for c in columns}
    return ranked.withColumns({f"__b_{c}": v for c, v in base.items()}).withColumns({c: F.try_divide(F.col(c), F.col(f"__b_{c}")) for c in columns}).drop(*(f"__{x}_{c}" for x in "nb" for c in columns))


def soh_dataset(table: DataFrame) -> DataFrame:
    """cell, soh and SOH_FEATURES of the good rows of a cycle table; columns it lacks are null."""
    d = table.where(~F.col("outlier") & F.col("soh").isNotNull())
    d = d.withColumns({c: F.lit(None).cast("double") for c in SOH_FEATURES if c not in d.columns})
    out = relative(d, RELATIVE)
    return out.select("cell", *(F.col(c).cast("double").alias(c) for c in SOH_FEATURES), "soh")


def window_slope(pairs: Column) -> Column:
    """Median slope between all pairs of a short array of (x, y), as a rolling frame gives it."""
    slopes = F.flatten(F.transform(pairs, lambda p: F.transform(F.filter(pairs, lambda q: q["x"] > p["x"]), lambda q: (q["y"] - p["y"]) / (q["x"] - p["x"]))))
    s = F.array_sort(slopes)
    n = F.size(s)
    at = lambda i: F.element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def _origins(low: Column, high: Column, first: int, step: int) -> Column:
    """The origins first, first + step, ... within low..high."""
    begin = F.greatest(F.ceil((low - first) / step), F.lit(0)).cast("int")
    end = F.floor((high - first) / step).cast("int")
    return F.when(end >= begin, F.transform(F.sequence(begin, end), lambda i: i * step + first)).otherwise(F.array().cast("array<int>"))


def fade_dataset(table: DataFrame, horizon: int = 25, step: int = 10, first: int = 20, curves: DataFrame | None = None) -> DataFrame:
    """One row per cell and origin k0: FADE_FEATURES known at k0, and target, the loss per 100 cycles over the next `horizon`.

    table: cell, grp, k, soh, outlier, I_mean, ambient and, where there are any, R0, Rct_ohm, cutoff_V. curves: cell, k and
    statistics of Q(V) against the cell's first curve (dq_logvar, dq_min, dq_mean). Rows reach their origins by explode and
    equality, a row at most 40 / step of them; nothing wider than 40 cycles is gathered.
    """
    d = table.where(~F.col("outlier") & F.col("soh").isNotNull())
    d = d.withColumns({c: F.lit(None).cast("double") for c in ("R0", "Rct_ohm", "cutoff_V") if c not in d.columns})
    if curves is not None:
        d = d.join(curves.select("cell", "k", "dq_logvar", "dq_min", "dq_mean"), ["cell", "k"], "left")
    else:
        d = d.withColumns({c: F.lit(None).cast("double") for c in ("dq_logvar", "dq_min", "dq_mean")})
    w = Window.partitionBy("cell").orderBy("k")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("cell")
    d = d.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(whole), "k_max": F.max("k").over(whole), "next": F.lead("k").over(w)})
    d = d.where(F.col("n") >= first + horizon)
    d = d.withColumns({f"n_{c}": F.count(c).over(upto) for c in ("R0", "Rct_ohm")})
    base = lambda c: F.avg(F.when(F.col(f"n_{c}") <= 3, F.col(c))).over(upto)
    rel = lambda c: F.when(F.col(f"n_{c}") > 3, F.last(c, ignorenulls=True).over(upto) / base(c))
    d = d.withColumns({
        "s_now": F.percentile("soh", F.lit(0.5)).over(w.rowsBetween(-2, 0)), "I10": F.avg("I_mean").over(w.rowsBetween(-9, 0)), "A10": F.avg("ambient").over(w.rowsBetween(-9, 0)), "R0_rel": rel("R0"), "Rct_rel": rel("Rct_ohm"),
    })
    last = F.col("k_max") - horizon
    now = d.where("rn >= 10").select("cell", "grp", F.explode(_origins(F.col("k"), F.least(F.coalesce(F.col("next") - 1, last), last), first, step)).alias("k0"), F.col("s_now").alias("soh_now"), F.col("I10").alias("I_mean"), F.col("A10").alias("ambient"), "cutoff_V", "dq_logvar", "dq_min", "dq_mean", "R0_rel", "Rct_rel")
    near = d.select("cell", "k", "soh", F.explode(_origins(F.col("k"), F.least(F.col("k") + 39, last), first, step)).alias("k0")).withColumn("t", (F.col("k") - F.col("k0")).cast("double"))
    late = F.col("t") > -20
    power = lambda p, y=None: F.sum(F.pow("t", F.lit(float(p))) if y is None else F.pow("t", F.lit(float(p))) * F.col(y))
    sums = near.groupBy("cell", "k0").agg(F.count("*").alias("n"), F.count(F.when(late, 1)).alias("n20"), F.collect_list(F.when(late, F.struct(F.col("t").alias("x"), F.col("soh").alias("y")))).alias("p20"), *(power(p).alias(f"s{p}") for p in range(1, 5)), *(power(p, "soh").alias(f"y{p}") for p in range(3)))
    shapes = sums.select("cell", "k0", F.when(F.col("n20") > 4, 100 * window_slope(F.col("p20"))).alias("slope20"), F.when(F.col("n") > 8, 1e4 * quadratic(*(F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2")))[2]).alias("curv40"))
    low, high = F.col("k") - horizon - 1, F.col("k") - horizon + 1
    future = d.select("cell", "soh", F.explode(_origins(low, F.least(high, last), first, step)).alias("k0")).groupBy("cell", "k0").agg(F.percentile("soh", F.lit(0.5)).alias("soh_future"))
    out = now.join(shapes, ["cell", "k0"]).join(future, ["cell", "k0"])
    return out.select("cell", "grp", *FADE_FEATURES, ((F.col("soh_now") - F.col("soh_future")) / horizon * 100).alias("target"), "soh_future", F.lit(horizon).alias("horizon"))


def quadratic(n, s1, s2, s3, s4, y0, y1, y2) -> tuple[Column, Column, Column]:
    """Coefficients b0, b1, b2 of a least-squares parabola from sums of powers of x and of their products with y."""
    minor = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    whole = minor(n, s1, s2, s1, s2, s3, s2, s3, s4)
    return (
        F.try_divide(minor(y0, s1, s2, y1, s2, s3, y2, s3, s4), whole),
        F.try_divide(minor(n, y0, s2, s1, y1, s3, s2, y2, s4), whole),
        F.try_divide(minor(n, s1, y0, s1, s2, y1, s2, s3, y2), whole),
    )


def population_prior(df: DataFrame, x: str = "soh", cell: str = "cell", least: int = 10) -> DataFrame:
    """One row: mean and covariance (1.5 times that of the cells and a ridge) of the parabolas of cells over z = k / 100.

    From sums by cell; with fewer than three cells of `least` rows the default prior (fixed values).
    """
    z = F.col("k") / 100.0
    own = df.where(F.col(x).isNotNull()).groupBy(cell).agg(F.count("*").alias("n"), *(F.sum(F.pow(z, F.lit(float(p)))).alias(f"s{p}") for p in range(1, 5)), *(F.sum(F.pow(z, F.lit(float(p))) * F.col(x)).alias(f"y{p}") for p in range(3)))
    b = quadratic(*(F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2")))
    fits = own.where(F.col("n") >= least).select(*(v.alias(f"b{i}") for i, v in enumerate(b))).where("b2 IS NOT NULL")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    ridge, mu, sd = (1e-5, 1e-4, 1e-4), (1.0, -0.12, -0.02), (0.01, 0.08, 0.08)
    got = fits.agg(F.count("*").alias("n_cells"), *(F.avg(f"b{i}").alias(f"m{i}") for i in range(3)), *(F.covar_samp(f"b{i}", f"b{j}").alias(f"c{i}{j}") for i, j in pairs))
    enough = F.col("n_cells") >= 3
    means = [F.when(enough, F.col(f"m{i}")).otherwise(mu[i]).alias(f"mu{i}") for i in range(3)]
    covs = [F.when(enough, F.col(f"c{i}{j}") * 1.5 + (ridge[i] if i == j else 0.0)).otherwise(sd[i] ** 2 if i == j else 0.0).alias(f"cov{i}{j}") for i, j in pairs]
    return got.select("n_cells", *means, *covs)


def evenly(df: DataFrame, m: int, by: str = "cell", order: str = "k") -> DataFrame:
    """m rows of each group (or all, where it has fewer), evenly spaced from its first to its last."""
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(by))})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / max(1, m - 1)))
    return d.where(F.array_contains(wanted, F.col("__i").cast("bigint"))).drop("__i", "__n")


def measured_every(df: DataFrame, columns, every: int, order: str = "k") -> DataFrame:
    """columns as if they were measured in the first and then each so many-th cycle only; arrays become null as well."""
    return df.withColumns({c: F.when((F.col(order) - 1) % every == 0, F.col(c)) for c in columns})


def eligible(df: DataFrame, columns, least: int = 10, share: float = 0.5) -> DataFrame:
    """column, n, share, sd, ok: whether enough of a column is known and it varies; one aggregation over all columns."""
    row = df.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("s", F.stddev_samp))))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.try_divide(F.col(f"n_{c}"), F.col("n")).alias("share"), F.col(f"s_{c}").alias("sd")) for c in columns))
    ok = (F.col("n") >= least) & (F.col("share") > share) & (F.coalesce(F.col("sd"), F.lit(0.0)) > 0)
    return row.select(F.explode(each).alias("c")).select("c.*").withColumn("ok", ok)


def ordered(df: DataFrame, by, ties) -> DataFrame:
    """The whole table in order of `by`; rows that are equal in these keep the order of `ties`, such as the place in a file."""
    return df.orderBy(*by, *ties)


def of_cell(df: DataFrame, cell: str, cycles=None, kind: str | None = None, by: str = "cell", order: str = "k", kind_col: str = "Cycle_Type") -> DataFrame:
    """The rows of one cell, of some cycles and of one type where these are given."""
    out = df.where(F.col(by) == cell)
    out = out if cycles is None else out.where(F.col(order).isin(*cycles))
    return out if kind is None else out.where(F.col(kind_col) == kind)
