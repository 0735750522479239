"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Minimum-covariance-determinant estimates by group: from two starts (medians with interquartile scales, and plain moments)
concentration steps take the half of the rows with the least Mahalanobis distance and estimate mean and covariance anew;
until the determinants stand still; the start with the smaller determinant wins, is rescaled to the median distance and
reweighted once. A step is two aggregations with partial sums by (group, start), so a group may hold any share of the rows;
medians and the half's threshold come from exact counts in narrow bins, so rows that tie with the threshold's bin are all in
the half. Documents only meet their group's parameters by a salted join.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cellspan.llm.common import cut, small_batches, stage, table, texts
from cellspan.llm.statistics import SHAPE, base_counts, shape

LEAST_WORDS = 50
D = len(SHAPE)
HALF = 0.5
STEPS = 12  # at most
STILL = 0.02  # change of log determinants
SALTS = 32
#: Rows that an estimate needs (parameter of estimates): smaller groups are pooled with the other small groups of their
#: language, then of all languages; where even those are fewer, there is no estimate.
LEAST_ROWS = 20 * D
#: Languages and sources whose parameters are broadcast: some 600 bytes each.
MOST_GROUPS = 20_000
#: False-rejection rate: the share of normal data beyond the cut, which is the chi-squared quantile of the scaled distance.
RATE = 1e-6
#: Least standard deviation of a transformed statistic: groups with none, as of symbols, would have no covariance.
FLOOR = 0.03
VALUE_BIN = 1 / 512
DISTANCE_BIN = 1 / 32  # of log2
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, x array<double>"
PARAMS = "g1 string, g2 string, start int, mean array<double>, inverse array<double>, log_det double"


def base_rule(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > 50 * n_words


def chi_squared_quantile(p_z: float, df: int) -> float:
    """By the cube-root normal approximation; p_z is the normal quantile of the probability."""
    v = 2 / (9 * df)
    return df * (1 - v + p_z * math.sqrt(v)) ** 3


def cut_distance(rate: float = RATE) -> float:
    """The distance that this share of normal data exceeds."""
    return math.sqrt(chi_squared_quantile(NormalDist().inv_cdf(1 - rate), D))


#: The cut at RATE.
FAR = cut_distance()


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Counts and transformed statistics of each row; with `carry` the row itself goes along as the struct `row`."""
    at, field = (0, "text") if carry else (1, None)

    def run(batches):
        for batch in cut(batches, at, field=field):
            rows = [(c := base_counts(t), base_rule(c[0], c[4]), shape(t, c)) for t in texts(batch, at, field)]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
            found = [*(pa.array(counts[:, i]) for i in range(5)), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.columns if carry else (batch.column(0), *batch.columns[2:])), *found], names)

    measured = StructType.fromDDL(STATS)
    if not carry:
        names = measured.names
        inputs = [F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"))]
        return docs.select(*inputs).mapInArrow(run, measured)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    names = ["row", *measured.names[3:]]
    schema = StructType([StructField("row", docs.schema), *measured.fields[3:]])
    rows = docs.select(F.struct("*").alias("row")).mapInArrow(run, schema)
    return rows.withColumns({c: F.col(f"row.{c}").cast(t) for c, t in (("lang", "string"), ("source", "string"))})


def binned_quantiles(rows: DataFrame, keys: list[str], bin_col: str, shares: dict[str, float]) -> DataFrame:
    """For each named share the least bin at or below which that share of a key's rows lies; keys x bins rows are windowed."""
    counts = rows.groupBy(*keys, bin_col).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(bin_col))
    ranked = counts.select(*keys, bin_col, upto.alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= q * F.col("all"), F.col(bin_col))).alias(name) for name, q in shares.items()))


def _keys(stats: DataFrame, least: int) -> DataFrame:
    """l, s (language and source, '' for null), and the key (g1, g2) of the group that they are estimated in."""
    good = stats.where(~F.col("base_failed"))
    sizes = good.groupBy(F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s")).agg(F.count("*").alias("n"))
    small = F.col("n") < least
    rest = sizes.groupBy("l").agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("rest"))
    g1 = F.when(~small | (F.col("rest") >= least), F.col("l")).otherwise("*")
    keys = sizes.join(rest, "l").select("l", "s", "n", g1.alias("g1"), F.when(~small, F.col("s")).otherwise("*").alias("g2"))
    enough = keys.groupBy("g1", "g2").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
    return keys.join(enough, ["g1", "g2"]).select("l", "s", "g1", "g2")


def _placed(stats: DataFrame) -> DataFrame:
    return stats.withColumn("l", F.coalesce("lang", F.lit(""))).withColumn("s", F.coalesce("source", F.lit("")))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, sums and the upper triangle of the products of x by key."""
    x = [F.col("x")[i] for i in range(D)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("sums"), F.array(*(F.sum(x[i] * x[j]) for i in range(D) for j in range(i, D))).alias("products"))


def _parameters(moments: DataFrame) -> DataFrame:
    """Mean, inverse Cholesky factor and log determinant of each row of moments."""
    upper = np.triu_indices(D)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                mean = np.array(r.sums) / r.n
                cov = np.zeros((D, D))
                cov[upper] = np.array(r.products) / r.n
                cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
                c = np.linalg.cholesky(cov + np.eye(D) * FLOOR**2)
                out.append((r.g1, r.g2, r.start, mean.tolist(), np.linalg.inv(c).ravel().tolist(), 2 * float(np.log(np.diag(c)).sum())))
            yield pd.DataFrame(out, columns=["g1", "g2", "start", "mean", "inverse", "log_det"])

    return moments.mapInPandas(run, PARAMS)


def _distance():
    """Squared Mahalanobis distance of x from mean, as a Column over (x, mean, inverse)."""
    diff = [F.col("x")[i] - F.col("mean")[i] for i in range(D)]
    rows = [sum(F.col("inverse")[i * D + j] * diff[j] for j in range(i + 1)) for i in range(D)]
    return sum(r * r for r in rows)


def _bin(d2):
    """Narrow bins of the distance; the least holds everything up to 2**-30."""
    return F.ceil(F.log2(F.greatest(d2, F.lit(2.0**-30))) / DISTANCE_BIN)


def _salted(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the row of `small` for their keys. small has a row for each group (and start); it is repeated for each salt,
    so that a group with a large share of the rows is dealt to SALTS tasks and not to one."""
    salts = small.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salts, [*keys, "salt"], how).drop("salt")


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    return _salted(rows, params, ["g1", "g2"]).withColumn("d2", _distance())


def _step(rows: DataFrame, params: DataFrame, share: float = HALF) -> DataFrame:
    """One concentration step for every group and start."""
    keys = ["g1", "g2", "start"]
    near = _with_distance(rows, params).select(*keys, "x", _bin(F.col("d2")).alias("bin"))
    within = binned_quantiles(near, keys, "bin", {"edge": share})
    return stage(_parameters(_moments(_salted(near, within, keys).where("bin <= edge"), keys)), "mcd")


def estimates(stats: DataFrame, steps: int = STEPS, least: int = LEAST_ROWS) -> DataFrame:
    """l, s (language, source), mean, inverse, log_det, and scale: what a distance is divided by to be like that of normal
    data. Languages and sources whose group has no estimate have no row."""
    keys = stage(_keys(stats, least), "keys")
    rows = stage(_salted(_placed(stats.where(~F.col("base_failed"))), keys, ["l", "s"]).select("g1", "g2", "x"), "groups")
    bins = rows.select("g1", "g2", F.posexplode(F.transform("x", lambda v: F.rint(v / VALUE_BIN))).alias("i", "bin"))
    each = binned_quantiles(bins, ["g1", "g2", "i"], "bin", {"q0": 0.25, "q1": 0.5, "q2": 0.75})
    spread = F.greatest((F.col("q2") - F.col("q0")) * VALUE_BIN / 1.349, F.lit(FLOOR))
    ordered = each.groupBy("g1", "g2").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("q1") * VALUE_BIN).alias("m"), spread.alias("s")))).alias("a"))  # D entries
    first = ordered.select("g1", "g2", F.lit(0).alias("start"), F.transform("a", lambda v: v["m"]).alias("mean"), F.array(*(F.when(F.lit(i == j), 1 / F.col("a")[i]["s"]).otherwise(0.0) for i in range(D) for j in range(D))).alias("inverse"), F.lit(0.0).alias("log_det"))
    second = _parameters(_moments(rows.withColumn("start", F.lit(1)), ["g1", "g2", "start"]))
    params = stage(first.unionByName(second), "mcd")
    for _ in range(steps):
        before, params = params, _step(rows, params)
        old = before.select("g1", "g2", "start", F.col("log_det").alias("old"))
        moved = params.join(old, ["g1", "g2", "start"]).agg(F.max(F.abs(F.col("log_det") - F.col("old")))).first()[0]
        if moved is None or moved <= STILL:
            break
    best = stage(params.groupBy("g1", "g2").agg(F.min_by(F.struct("start", "mean", "inverse", "log_det"), F.struct("log_det", "start")).alias("p")).select("g1", "g2", "p.*"), "mcd")
    # scaled by the median distance, then reweighted: moments of the rows within the 97.5 % ellipse
    scaled = _rescale(rows, best)
    inside = _with_distance(rows, scaled).where(F.col("d2") <= F.col("scale") * chi_squared_quantile(1.96, D))
    final = stage(_parameters(_moments(inside, ["g1", "g2", "start"])), "mcd")
    return stage(_rescale(rows, final).join(keys, ["g1", "g2"]).select("l", "s", "mean", "inverse", "log_det", "scale"), "mcd")


def _rescale(rows: DataFrame, params: DataFrame) -> DataFrame:
    """params with scale; never below 1, which would divide the floor out of the covariance again."""
    middle = binned_quantiles(_with_distance(rows, params).select("g1", "g2", _bin(F.col("d2")).alias("bin")), ["g1", "g2"], "bin", {"edge": 0.5})
    return params.join(middle, ["g1", "g2"]).withColumn("scale", F.greatest(F.pow(2.0, F.col("edge") * DISTANCE_BIN) / chi_squared_quantile(0.0, D), F.lit(1.0))).drop("edge")


def verdicts(stats: DataFrame, params: DataFrame, rate: float = RATE) -> DataFrame:
    """stats with distance (null where there is no estimate, so that the base rules alone decide) and kept."""
    out = _salted(_placed(stats), params.select("l", "s", "mean", "inverse", "scale"), ["l", "s"], "left")
    out = out.withColumn("distance", F.sqrt(_distance() / F.col("scale"))).drop("mean", "inverse", "scale", "l", "s")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut_distance(rate)))


def judge(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, counts, base_failed, kept, distance of each row of docs (columns doc_id, text, lang, source are read).

    Null and empty texts have no words and fail the base rules. Null languages and sources are one group each; groups too
    small for an estimate are pooled (see LEAST_ROWS), and where even all of them together are too few, the base rules alone
    decide. Repeated rows count and are judged as often as they occur; long texts are read whole; an empty table gives no
    rows; other columns are not read, whatever their names.
    """
    stats = stage(statistics(docs), "statistics")
    return verdicts(stats, estimates(stats), rate).drop("lang", "source", "x")


def keep_good(docs: DataFrame, rate: float = RATE, most: int = MOST_GROUPS) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever their names; each case is that of judge.

    Up to `most` languages and sources, their parameters are broadcast and Arrow batches are filtered in place: statistics
    are computed a second time, but no row is carried along. With more, rows are written with their statistics and joined.
    """
    small_batches(docs.sparkSession)
    found = estimates(stage(statistics(docs), "statistics"))
    params = found.select("l", "s", "mean", "inverse", "scale").limit(most + 1).collect()
    if len(params) > most:
        return verdicts(stage(statistics(docs, carry=True), "statistics"), found, rate).where("kept").select("row.*")
    held = {(r["l"], r["s"]): (np.array(r["mean"]), np.array(r["inverse"]).reshape(D, D), r["scale"]) for r in params}
    shared, far = docs.sparkSession.sparkContext.broadcast(held), cut_distance(rate)
    at, lang, source = (docs.columns.index(c) for c in ("text", "lang", "source"))

    def good(text: bytes, lang, source) -> bool:
        counts = base_counts(text)
        if base_rule(counts[0], counts[4]):
            return False
        own = shared.value.get(("" if lang is None else str(lang), "" if source is None else str(source)))
        if own is None:
            return True
        mean, inverse, scale = own
        z = inverse @ (np.array(shape(text, counts)) - mean)
        return math.sqrt(float(z @ z) / scale) <= far

    def run(batches):
        for batch in cut(batches, at):
            keep = [good(*x) for x in zip(texts(batch, at), batch.column(lang).to_pylist(), batch.column(source).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return judge(table(spark, sf_dir, "documents"))
