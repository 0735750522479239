"""Study tables over metrics: fair comparison, coverage, rollups, pivots, significance with step-down correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellspan.config import BAND_ALPHA
from cellspan.functions.metrics import erfc, wilson
from cellspan.operators.indicators import average_rank


def ok(metrics: DataFrame) -> DataFrame:
    return metrics.where((F.col("status") == "ok") & F.col("rmse").isNotNull())


def common_cells(metrics: DataFrame, h: int, scope: list[str] | None = None) -> DataFrame:
    """Cells with a valid metric of every model that occurs (in the scope): relational division by counting."""
    scope = scope or []
    m = metrics.where(F.col("h") == h)
    models = m.groupBy(*scope).agg(F.countDistinct("model").alias("models"))
    have = ok(m).groupBy(*scope, "cell").agg(F.countDistinct("model").alias("n"))
    joined = have.join(models, scope) if scope else have.join(F.broadcast(models))  # one row
    return joined.where("n = models").select(*scope, "cell")


def leaderboard(metrics: DataFrame, h: int, scope: list[str] | None = None) -> DataFrame:
    """Median and mean error and rank by model, over common cells only; not_ok counts failures of the model anywhere."""
    scope = scope or []
    m = ok(metrics.where(F.col("h") == h)).join(common_cells(metrics, h, scope), [*scope, "cell"], "left_semi")
    ranked = m.withColumn("rank", average_rank("rmse", [*scope, "cell"]))
    fails = metrics.where(F.col("status") != "ok").groupBy("model").agg(F.countDistinct("cell").alias("fails"))
    board = ranked.groupBy(*scope, "model").agg(
        F.percentile("rmse", F.lit(0.5)).alias("rmse_median"), F.avg("rmse").alias("rmse_mean"), F.percentile("r2", F.lit(0.5)).alias("r2_median"),
        F.avg("coverage").alias("coverage"), F.avg("fade_skill").alias("fade_skill"), F.countDistinct("cell").alias("n_cells"), F.avg("rank").alias("mean_rank"),
    )
    return board.join(fails, "model", "left").withColumn("not_ok", F.coalesce("fails", F.lit(0))).drop("fails")


def with_all(metrics: DataFrame) -> DataFrame:
    """Every row once under its group and once under All: common cells differ by scope, so no grouping sets."""
    return metrics.withColumn("scope", F.explode(F.array(F.lit("All"), F.col("grp"))))


def study_tables(metrics: DataFrame, h: int) -> DataFrame:
    return leaderboard(with_all(metrics), h, ["scope"])


def coverage_table(metrics: DataFrame, alpha: float = BAND_ALPHA) -> DataFrame:
    """Pooled coverage with its limits, and the mean over cells."""
    g = ok(metrics).groupBy("grp", "model", "h").agg(F.sum(F.col("coverage") * F.col("n")).alias("hits"), F.sum("n").alias("n"), F.avg("coverage").alias("mean_of_cells"))
    lo, hi = wilson(F.col("hits"), F.col("n").cast("double"))
    out = g.withColumn("coverage", F.try_divide(F.col("hits"), F.col("n"))).withColumn("lo", lo).withColumn("hi", hi)
    note = F.when(F.col("hi") < 1 - alpha, "below target").when(F.col("lo") > 1 - alpha, "above target").otherwise("on target")
    return out.withColumn("note", note).drop("hits")


def pivot_models(metrics: DataFrame, h: int, models: list[str]) -> DataFrame:
    """cell x model table of errors."""
    return ok(metrics.where(F.col("h") == h)).groupBy("cell").pivot("model", models).agg(F.avg("rmse"))


def holm(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """p_holm: step-down corrected; null p counts as 1, equal p are in order of their models; `by`: several studies.

    Ranks and running maxima are taken within narrow bins of log p and carried over from bin to bin, so no task sees more
    than a bin; at most some thousand bins reach the second step.
    """
    by = by or []
    d = tests.withColumn("__p", F.coalesce(F.col(p), F.lit(1.0))).withColumn("__bin", F.floor(-8 * F.log2(F.greatest("__p", F.lit(1e-300)))))
    bins = d.groupBy(*by, "__bin").agg(F.count("*").alias("__c"))
    over = Window.partitionBy(*by).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)  # small p are in high bins
    bins = bins.withColumns({"__before": F.coalesce(F.sum("__c").over(over), F.lit(0)), "__m": F.sum("__c").over(Window.partitionBy(*by))}).drop("__c")
    w = Window.partitionBy(*by, "__bin").orderBy("__p", "model_a", "model_b")
    ranked = d.join(bins, [*by, "__bin"]).withColumn("__r", F.col("__before") + F.row_number().over(w))
    stepped = ranked.withColumn("__s", F.least(F.lit(1.0), (F.col("__m") - F.col("__r") + 1) * F.col("__p")))
    top = stepped.groupBy(*by, "__bin").agg(F.max("__s").alias("__t")).withColumn("__top", F.coalesce(F.max("__t").over(over), F.lit(0.0))).drop("__t")
    out = stepped.join(top, [*by, "__bin"])
    return out.withColumn("p_holm", F.greatest("__top", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__p", "__bin", "__before", "__m", "__r", "__s", "__top")


EXACT_UP_TO = 50  # differences without ties and zeros have the exact null distribution up to this number (fixed value)


def signed_ranks(differences: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """by, m (differences other than 0), p: two-sided signed-rank tests; p is null where all differences are 0 or unknown.

    Exact without ties and zeros up to EXACT_UP_TO differences, else the normal limit with tie correction. Differences are
    rounded to 12 digits, so rounding errors make no ties of zeros. Equal sizes are counted first; ranks are taken within narrow
    bins of log size and carried over from bin to bin, so no task sees a whole test.
    """
    v = differences.withColumn("__d", F.round(F.col(d).cast("double"), 12)).where(F.abs("__d") < float("inf"))
    levels = v.groupBy(*by, F.abs("__d").alias("__v")).agg(F.count("*").alias("__c"), F.count(F.when(F.col("__d") > 0, 1)).alias("__up"))
    zeros = F.max(F.col("__v") == 0)
    some = levels.where("__v > 0").withColumn("__bin", F.floor(64 * F.log2("__v")))
    bins = some.groupBy(*by, "__bin").agg(F.sum("__c").alias("__n"))
    bins = bins.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__bin")) - F.col("__n")).drop("__n")
    upto = F.sum("__c").over(Window.partitionBy(*by, "__bin").orderBy("__v"))
    ranked = some.join(bins, [*by, "__bin"]).withColumn("__rank", F.col("__before") + upto - (F.col("__c") - 1) / 2)
    c = F.col("__c").cast("double")
    found = ranked.groupBy(*by).agg(F.sum("__c").alias("m"), F.sum(F.col("__up") * F.col("__rank")).alias("__w"), F.sum(c * c * c - c).alias("__ties"))
    out = levels.groupBy(*by).agg(zeros.alias("__zeros")).join(found, by, "left")
    m, w = F.col("m").cast("double"), F.col("__w")
    exact = (F.col("m") <= EXACT_UP_TO) & (F.col("__ties") == 0) & ~F.col("__zeros")
    low = F.least(w, m * (m + 1) / 2 - w).cast("int")
    # how many of the 2^m sets of ranks add up to 0, 1, ..., low: one rank after another
    none = F.transform(F.sequence(F.lit(0), low), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), none, lambda held, rank: F.transform(held, lambda x, i: x + F.coalesce(F.get(held, i - rank), F.lit(0.0))))
    tail = F.aggregate(ways, F.lit(0.0), lambda a, x: a + x)
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("__ties") / 48
    normal = F.when(variance > 0, erfc(F.abs(w - m * (m + 1) / 4) / F.sqrt(2 * variance))).otherwise(1.0)
    p = F.when(exact, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), m))).when(F.col("m").isNotNull(), normal)
    return out.select(*by, F.coalesce("m", F.lit(0).cast("long")).alias("m"), p.alias("p"))


def pairwise(metrics: DataFrame, h: int) -> DataFrame:
    """Signed-rank tests of every pair of models on the cells both have, step-down corrected."""
    m = ok(metrics.where(F.col("h") == h)).select("cell", "model", "rmse")
    a, b = m.select("cell", F.col("model").alias("model_a"), F.col("rmse").alias("ra")), m.select("cell", F.col("model").alias("model_b"), F.col("rmse").alias("rb"))
    pairs = a.join(b, "cell").where("model_a < model_b").select("model_a", "model_b", (F.col("ra") - F.col("rb")).alias("d"))
    by = ["model_a", "model_b"]
    facts = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("d", F.lit(0.5)).alias("median_diff"), F.count(F.when(F.col("d") < 0, 1)).alias("a_better"))
    return holm(facts.join(signed_ranks(pairs, by).drop("m"), by, "left"))


def estimation_accuracy(estimates: DataFrame) -> DataFrame:
    from cellspan.functions import metrics as M

    y, p = F.col("measured"), F.col("soh")
    return estimates.where(y.isNotNull() & p.isNotNull()).groupBy("cell", "model").agg(F.count("*").alias("n"), M.rmse(y, p).alias("rmse"), M.mae(y, p).alias("mae"))


def rul_accuracy(rul: DataFrame, truth: DataFrame) -> DataFrame:
    """Error of predicted end of life over origins before the true one; cells that did not reach it say so."""
    d = rul.join(truth.select("cell", "eol_k"), "cell", "left")
    before = F.col("k0") < F.col("eol_k")
    agg = d.groupBy("cell", "model").agg(F.max("eol_k").alias("eol_k"), F.count(F.when(before, 1)).alias("n"), F.avg(F.when(before, F.abs(F.col("eol_pred") - F.col("eol_k")))).alias("eol_mae"), F.avg(F.when(before, F.col("eol_pred").isNotNull().cast("int"))).alias("predicted"))
    status = F.when(F.col("eol_k").isNull(), "EOL not reached").when(F.col("n") == 0, "no origin before EOL").when(F.col("eol_mae").isNull(), "never predicted").otherwise("ok")
    return agg.withColumn("status", status)


def mechanism_shares(shares: DataFrame, names: list[str]) -> DataFrame:
    """Mean share of each mechanism by group and the largest."""
    g = shares.groupBy("grp").agg(*(F.avg(c).alias(c) for c in names))
    return g.withColumn("dominant", F.array_max(F.array(*(F.struct(F.col(c).alias("v"), F.lit(c).alias("n")) for c in names)))["n"])
