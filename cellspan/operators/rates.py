"""Capacity at reference conditions: level effects of current and ambient next to a flexible trend, fitted robustly.

The log of capacity is a line with hinges at inner quantiles of the cycle number plus a step for each level of current or
ambient that differs from the cell's reference and has enough rows. Reweighted least squares need three things in a round:
weighted sums, the median residual and the median distance from it. Sums of long cells are taken by pairs of levels: from six
trend terms and the residuals' weights they give all normal equations of a cell, however many levels it has.

A cell of at most BLOCK rows is one bounded array and does its rounds in its task, next to others of like lengths. Longer cells are never gathered: their rows lie
in salted blocks and each round is a plan of aggregations, in which medians are selected by bins, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.sources.staging import staged

BLOCK = 4096  # rows of a cell that one task may gather
KNOTS = 4
ROUNDS = 20  # reweighted fits after the first
HUBER = 1.345
TO_SIGMA = 1.4826
LEAST_LEVEL, LEAST_ROWS = 5, 10
ENTRIES = 1 << 19  # of the designs that a task fits together
REF_CURRENT, REF_AMBIENT = 2.0, 24.0
CURRENT_STEP = 0.5
SALTS = 32
BINS = 1 << 16
TREND = KNOTS + 2
_UPPER = [(i, j) for i in range(TREND) for j in range(i, TREND)]


# --- the plan of a cell: references, levels with effects, knots --------------------------------------------------------


def rows_of(df: DataFrame, cap: str, current: str, ambient: str, bad: str) -> DataFrame:
    """cell, k, good, y (log of capacity), i and t (levels) next to all columns."""
    c, a = F.nanvl(F.col(cap).cast("double"), F.lit(None)), F.nanvl(F.col(ambient).cast("double"), F.lit(None))
    level = F.rint(F.nanvl(F.col(current).cast("double"), F.lit(None)) / CURRENT_STEP) * CURRENT_STEP + F.lit(0.0)
    good = ~F.coalesce(F.col(bad).cast("boolean"), F.lit(False)) & (c > 0) & level.isNotNull()
    return df.withColumns({"__good": F.coalesce(good, F.lit(False)), "__y": F.ln(c), "__i": level, "__t": F.rint(a) + F.lit(0.0), "__k": F.col("k").cast("double")})


def references(rows: DataFrame) -> DataFrame:
    """cell, n, i_ref, t_ref, k0, span and effects: an array of (kind, level) in order."""
    good = rows.where("__good")
    levels = good.select("cell", F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("level")) for kind, c in (("I", "__i"), ("T", "__t"))))))
    counts = levels.where("level IS NOT NULL").groupBy("cell", "kind", "level").agg(F.count("*").alias("times"))
    mode = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("level")), F.when(F.col("kind") == kind, F.struct("times", -F.col("level"))))
    chosen = counts.groupBy("cell").agg(mode("I").alias("i_mode"), F.max((F.col("kind") == "I") & (F.col("level") == REF_CURRENT)).alias("usual"), mode("T").alias("t_mode"), F.collect_list(F.struct("kind", "level", "times")).alias("all"))
    i_ref, t_ref = F.when(F.col("usual"), REF_CURRENT).otherwise(F.coalesce("i_mode", F.lit(REF_CURRENT))), F.coalesce("t_mode", F.lit(REF_AMBIENT))
    refs = chosen.select("cell", i_ref.alias("i_ref"), t_ref.alias("t_ref"), "all")
    kept = F.filter("all", lambda e: (e["times"] >= LEAST_LEVEL) & (e["level"] != F.when(e["kind"] == "I", F.col("i_ref")).otherwise(F.col("t_ref"))))
    refs = refs.withColumn("effects", F.transform(F.array_sort(kept), lambda e: F.struct(e["kind"].alias("kind"), e["level"].alias("level")))).drop("all")
    spans = rows.groupBy("cell").agg(F.count(F.when(F.col("__good"), 1)).alias("n"), F.min(F.when(F.col("__good"), F.col("__k"))).alias("k0"), F.max(F.when(F.col("__good"), F.col("__k"))).alias("k1"))
    out = spans.join(refs, "cell", "left").na.fill({"i_ref": REF_CURRENT, "t_ref": REF_AMBIENT})
    return out.select("cell", "n", "i_ref", "t_ref", "k0", F.greatest(F.col("k1") - F.col("k0"), F.lit(1.0)).alias("span"), F.coalesce("effects", F.array().cast("array<struct<kind:string,level:double>>")).alias("effects"))


# --- one fit from sums --------------------------------------------------------------------------------------------------


def solved(sums: list[tuple], effects: list[tuple[str, float]]) -> np.ndarray:
    """Coefficients (trend, then effects) from sums by (i, t): weight, trend sums, their products, with y, and sum of y.

    Each row has the six trend terms and at most one step of either kind, so a pair of levels adds its trend block, two border
    rows and three entries of the steps. Singular equations have their shortest solution.
    """
    at = {e: TREND + j for j, e in enumerate(effects)}
    g, b = np.zeros((TREND + len(effects),) * 2), np.zeros(TREND + len(effects))
    for i, t, weight, trend, products, with_y, y in sums:
        block = np.zeros((TREND, TREND))
        for (p, q), v in zip(_UPPER, products, strict=True):
            block[p, q] = block[q, p] = v
        g[:TREND, :TREND] += block
        b[:TREND] += with_y
        steps = [at[e] for e in (("I", i), ("T", t)) if e in at]
        for s in steps:
            g[s, :TREND] += trend
            g[:TREND, s] += trend
            b[s] += y
            for u in steps:
                g[s, u] += weight
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return np.linalg.pinv(g / np.outer(scale, scale), rcond=1e-13, hermitian=True) @ (b / scale) / scale


def _ordered(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Rows in order, what is not there last."""
    return np.sort(np.where(there, values, np.inf), axis=1)


def _quantile(ordered: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Linear quantiles of the first n of each row."""
    at = share * (n - 1)
    low = np.floor(at).astype(np.int64)
    a, b = (np.take_along_axis(ordered, np.minimum(j, n - 1)[:, None], 1)[:, 0] for j in (low, low + 1))
    return a + (at - low) * (b - a)


def _fitted(cells: list[tuple], rounds: int) -> np.ndarray:
    """All rounds on the good rows (k, y, i, t) of short cells with equally many effects: their offsets, a row a cell. A round is
    one stack of normal equations; what a shorter cell lacks has no weight."""
    n = np.array([len(c[0]) for c in cells])
    there = np.arange(n.max()) < n[:, None]

    def padded(j: int) -> np.ndarray:
        out = np.zeros(there.shape)
        out[there] = np.concatenate([c[j] for c in cells])
        return out

    k, y, level = padded(0), padded(1), {"I": padded(2), "T": padded(3)}
    ordered = _ordered(k, there)
    first = ordered[:, :1]
    z = np.where(there, (k - first) / np.maximum(np.take_along_axis(ordered, n[:, None] - 1, 1) - first, 1.0), 0.0)
    sorted_z = _ordered(z, there)
    x = np.zeros((*there.shape, TREND + len(cells[0][4])))
    x[..., 0], x[..., 1] = there, z
    for j in range(KNOTS):
        x[..., 2 + j] = np.clip(z - _quantile(sorted_z, n, (j + 1) / (KNOTS + 1))[:, None], 0, None) * there
    for j in range(len(cells[0][4])):
        kinds = np.array([c[4][j][0] for c in cells])
        value = np.array([c[4][j][1] for c in cells])[:, None]
        x[..., TREND + j] = (np.where((kinds == "I")[:, None], level["I"], level["T"]) == value) & there
    weight = there.astype(float)
    for turn in range(rounds + 1):
        own = (x * weight[..., None]).transpose(0, 2, 1)
        g, b = own @ x, (own @ y[..., None])[..., 0]
        scale = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 1e-300))
        inverse = np.linalg.pinv(g / (scale[:, :, None] * scale[:, None, :]), rcond=1e-13, hermitian=True)
        beta = (inverse @ (b / scale)[..., None])[..., 0] / scale
        if turn < rounds:
            rest = y - (x @ beta[..., None])[..., 0]
            middle = _quantile(_ordered(rest, there), n, 0.5)[:, None]
            limit = HUBER * (TO_SIGMA * _quantile(_ordered(np.abs(rest - middle), there), n, 0.5) + 1e-9)[:, None]
            weight = there * (limit / np.maximum(np.abs(rest), limit))
    return beta[:, TREND:]


def _gathered(cells: list[tuple], rounds: int) -> list[list[float]]:
    """Offsets of short cells (k, y, i, t, effects), fitted together where they have as many effects and like lengths."""
    out: list[list[float]] = [[]] * len(cells)
    order = sorted(range(len(cells)), key=lambda c: (len(cells[c][4]), len(cells[c][0])))
    at = 0
    while at < len(order):
        effects, end = len(cells[order[at]][4]), at + 1
        while end < len(order) and len(cells[order[end]][4]) == effects and (end + 1 - at) * len(cells[order[end]][0]) * (TREND + effects) <= ENTRIES:
            end += 1
        for c, own in zip(order[at:end], _fitted([cells[c] for c in order[at:end]], rounds).tolist(), strict=True):
            out[c] = own
        at = end
    return out


# --- long cells: rounds of aggregations ---------------------------------------------------------------------------------


def order_statistics(values: DataFrame, ranks: DataFrame, levels: int = 3) -> DataFrame:
    """cell, which, value: the value of each rank (0 is the least) among a cell's values `v`; values: cell, v; ranks: cell, which,
    rank. Bins between the bounds of a level pick the next level's bounds, which are values: where these agree the value is
    exact, else it lies within (range / BINS ** levels) of it. A cell's rows at a level are at most BINS for each rank."""
    bounds = values.groupBy("cell").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = ranks.join(bounds, "cell")
    salted = values.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    for _ in range(levels):
        spread = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        inside = salted.join(spread, ["cell", "salt"]).where("v >= low AND v <= high")
        place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy("cell", "which", F.coalesce(F.when(F.col("high") > F.col("low"), place), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        listed = bins.groupBy("cell", "which").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "a", "b"))).alias("bins"))  # at most BINS
        both = wanted.select("cell", "which", "rank").join(listed, ["cell", "which"])
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("rest"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
        here = lambda s, x: s["rest"].isNull() & (F.col("rank") < s["upto"] + x["n"])
        found = F.aggregate("bins", start, lambda s, x: F.struct(
            (s["upto"] + x["n"]).alias("upto"), F.when(here(s, x), F.col("rank") - s["upto"]).otherwise(s["rest"]).alias("rest"),
            F.when(here(s, x), x["a"]).otherwise(s["a"]).alias("a"), F.when(here(s, x), x["b"]).otherwise(s["b"]).alias("b")))
        wanted = both.withColumn("f", found).select("cell", "which", F.col("f.rest").alias("rank"), F.col("f.a").alias("low"), F.col("f.b").alias("high"))
    return wanted.select("cell", "which", ((F.col("low") + F.col("high")) / 2).alias("value"))


def quantiles(values: DataFrame, sizes: DataFrame, shares: list[float], levels: int = 2) -> DataFrame:
    """cell, q: array of linear quantiles; sizes: cell, n."""
    each = F.inline(F.array(*(F.struct(F.lit(2 * j + s).alias("which"), F.least(F.floor(F.lit(p) * (F.col("n") - 1)) + s, F.col("n") - 1).alias("rank")) for j, p in enumerate(shares) for s in (0, 1))))
    got = order_statistics(values, sizes.select("cell", each), levels).groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("which", "value"))).alias("m"))
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    q = [F.element_at("m", F.lit(2 * j)) + (at(p) - F.floor(at(p))) * (F.element_at("m", F.lit(2 * j + 1)) - F.element_at("m", F.lit(2 * j))) for j, p in enumerate(shares)]
    return got.join(sizes, "cell").select("cell", F.array(*q).alias("q"))


def _long_offsets(rows: DataFrame, plans: DataFrame, rounds: int) -> DataFrame:
    """cell, offsets (array in order of effects) of long cells."""
    big = rows.where("__good").select("cell", "__k", "__y", "__i", "__t").join(plans.select("cell"), "cell", "left_semi")
    big = staged(big, "rates-long")
    sizes = plans.select("cell", "n")
    knots = staged(plans.join(quantiles(big.select("cell", F.col("__k").alias("v")), sizes, [(j + 1) / (KNOTS + 1) for j in range(KNOTS)]), "cell"), "rates-plan")
    salt = F.pmod(F.xxhash64("__k", "__y"), F.lit(SALTS)).cast("int")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    z = (F.col("__k") - F.col("k0")) / F.col("span")
    hinge = [F.greatest(z - (F.get("q", F.lit(j)) - F.col("k0")) / F.col("span"), F.lit(0.0)) for j in range(KNOTS)]
    known = lambda kind, c: F.when(F.array_contains("effects", F.struct(F.lit(kind).alias("kind"), F.col(c).alias("level"))), F.col(c))
    # the salt stays with the rows, so a round's models meet them without a shuffle of the rows
    data = big.withColumn("salt", salt).join(salted(knots), ["cell", "salt"])
    data = staged(data.select("cell", "salt", F.col("__y").alias("y"), known("I", "__i").alias("i"), known("T", "__t").alias("t"), F.array(F.lit(1.0), z, *hinge).alias("x")).repartition("cell", "salt"), "rates-rows")
    x = [F.get("x", F.lit(j)) for j in range(TREND)]
    steps = [F.coalesce(F.try_element_at(F.col(m), F.col(c)), F.lit(0.0)) for m, c in (("by_i", "i"), ("by_t", "t"))]
    fit = sum((F.get("beta", F.lit(j)) * x[j] for j in range(TREND)), steps[0] + steps[1])
    limits = None
    for turn in range(rounds + 1):
        if turn:
            own = salted(betas.join(limits, "cell"))  # noqa: F821 - of the round before
            weighted = data.join(own, ["cell", "salt"]).withColumn("w", F.col("limit") / F.greatest(F.abs(F.col("y") - fit), F.col("limit")))
        else:
            weighted = data.withColumn("w", F.lit(1.0))
        w, y = F.col("w"), F.col("y")
        parts = {"weight": F.sum(w), **{f"x{j}": F.sum(w * x[j]) for j in range(TREND)}, **{f"p{p}{q}": F.sum(w * x[p] * x[q]) for p, q in _UPPER}, **{f"y{j}": F.sum(w * x[j] * y) for j in range(TREND)}, "sum_y": F.sum(w * y)}
        sums = weighted.groupBy("cell", "i", "t").agg(*(v.alias(k) for k, v in parts.items()))
        packed = F.struct("i", "t", "weight", F.array(*(f"x{j}" for j in range(TREND))).alias("trend"), F.array(*(f"p{p}{q}" for p, q in _UPPER)).alias("products"), F.array(*(f"y{j}" for j in range(TREND))).alias("with_y"), "sum_y")
        cells = sums.groupBy("cell").agg(F.collect_list(packed).alias("sums")).join(knots.select("cell", "effects"), "cell")  # a pair of levels is an entry

        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for r in pdf.itertuples():
                    effects = [(e["kind"], e["level"]) for e in r.effects]
                    beta = solved([(s["i"], s["t"], s["weight"], np.array(s["trend"]), s["products"], np.array(s["with_y"]), s["sum_y"]) for s in r.sums], effects)
                    of = lambda kind: {v: float(b) for (e, v), b in zip(effects, beta[TREND:], strict=True) if e == kind}  # noqa: B023, E731
                    out.append((r.cell, beta.tolist(), of("I"), of("T")))
                yield pd.DataFrame(out, columns=["cell", "beta", "by_i", "by_t"])

        betas = staged(cells.mapInPandas(solve, "cell string, beta array<double>, by_i map<double,double>, by_t map<double,double>"), "rates-beta")
        if turn == rounds:
            break
        residual = staged(data.join(salted(betas), ["cell", "salt"]).select("cell", "salt", (F.col("y") - fit).alias("v")), "rates-residual")
        middle = staged(quantiles(residual.select("cell", "v"), sizes, [0.5]).select("cell", F.get("q", F.lit(0)).alias("m")), "rates-middle")
        distance = residual.join(salted(middle), ["cell", "salt"]).select("cell", F.abs(F.col("v") - F.col("m")).alias("v"))
        limits = staged(quantiles(distance, sizes, [0.5]).select("cell", (HUBER * (TO_SIGMA * F.get("q", F.lit(0)) + 1e-9)).alias("limit")), "rates-limit")
    return betas.select("cell", F.slice("beta", TREND + 1, F.greatest(F.size("beta") - TREND, F.lit(1))).alias("offsets"))


# --- the operator -------------------------------------------------------------------------------------------------------


def normalise_rate(df: DataFrame, cap: str = "cap", current: str = "I_mean", ambient: str = "ambient", bad: str = "outlier", block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """df with cap_norm, normalised, i_ref, t_ref, rate_coef and offsets (map of a level's name to its effect on the log).

    Cells without levels besides their references, or with fewer than LEAST_ROWS good rows, keep their capacity; null and NaN
    values are no good rows; rows of levels without an effect are as they were; an empty table stays empty.
    """
    rows = rows_of(df, cap, current, ambient, bad)
    plans = staged(references(rows), "rates-references")
    fit = plans.where((F.size("effects") > 0) & (F.col("n") >= LEAST_ROWS))
    short = rows.where("__good").join(fit.where(F.col("n") <= block).select("cell", "effects"), "cell")
    listed = short.groupBy("cell").agg(*(F.collect_list(F.coalesce(c, F.lit(float("nan")))).alias(c) for c in ("__k", "__y", "__i", "__t")), F.first("effects").alias("effects"))  # at most `block` rows

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cells = [(*(np.asarray(v, float) for v in values), [(e["kind"], e["level"]) for e in effects]) for _, *values, effects in pdf.itertuples(index=False)]
            yield pd.DataFrame({"cell": pdf["cell"], "offsets": _gathered(cells, rounds)})

    found = listed.mapInPandas(gathered, "cell string, offsets array<double>")
    long = fit.where(F.col("n") > block)
    if not long.isEmpty():
        found = found.unionByName(_long_offsets(rows, long, rounds))
    known = F.col("b").isNotNull()
    plans = plans.join(found.withColumnRenamed("offsets", "b"), "cell", "left")
    steps = F.arrays_zip("effects", "b")
    pairs = F.filter(steps, lambda e: e["effects"]["kind"] == "I")
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, e: a + f(e["effects"]["level"] - F.col("i_ref"), e["b"]))
    name = lambda e: F.concat(e["effects"]["kind"], F.lit("="), F.regexp_replace(e["effects"]["level"].cast("string"), r"\.0$", ""))
    facts = plans.select(
        "cell", "i_ref", "t_ref", known.alias("normalised"), F.coalesce(F.when(known, F.try_divide(total(lambda d, b: d * b), total(lambda d, b: d * d))), F.lit(0.0)).alias("rate_coef"),
        F.when(known, F.map_from_entries(F.transform(steps, lambda e: F.struct(name(e), e["b"])))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("offsets"),
        F.when(known, F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["effects"]["level"], e["b"])))).alias("__by_i"),
        F.when(known, F.map_from_entries(F.transform(F.filter(steps, lambda e: e["effects"]["kind"] == "T"), lambda e: F.struct(e["effects"]["level"], e["b"])))).alias("__by_t"),
    )
    salt = F.pmod(F.xxhash64("__k"), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("__salt", F.coalesce(salt, F.lit(0))).join(facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cell", "__salt"], "left")
    step = F.coalesce(F.try_element_at("__by_i", F.col("__i")), F.lit(0.0)) + F.coalesce(F.try_element_at("__by_t", F.col("__t")), F.lit(0.0))
    return joined.withColumn("cap_norm", F.col(cap).cast("double") * F.exp(-step)).select(*df.columns, "cap_norm", "normalised", "i_ref", "t_ref", "rate_coef", "offsets")
