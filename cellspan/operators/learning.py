"""Models over tables of cycles with whole cells held out: folds, imputation, ridge from sums, importance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from cellspan.functions import metrics as M
from cellspan.functions.numeric import bayesian_ridge, t_two_sided
from cellspan.sources.staging import staged

ROUND = 4  # digits of values that medians are taken of, which bounds what an aggregation holds


def _dealt(load: list[int], size: int, m: int) -> list[tuple[int, list[int]]]:
    """How m groups of equal size go to the lightest fold one by one, as (first, folds in turn) segments; updates load."""
    out, at = [], 0
    while at < m:
        order = sorted(range(len(load)), key=lambda f: (load[f], f))
        level = load[order[0]]
        turn = [f for f in order if load[f] - level < size]  # these take turns until another fold is as light
        others = order[len(turn) :]
        rounds = m if not others else max(1, (load[others[0]] - max(load[f] for f in turn)) // size)
        take = min(m - at, rounds * len(turn))
        out.append((at, turn))
        for i in range(len(turn)):
            load[turn[i]] += size * ((take - i + len(turn) - 1) // len(turn) if take > i else 0)
        at += take
    return out


def group_folds(df: DataFrame, n: int = 5, group: str = "cell") -> DataFrame:
    """group, fold: whole groups, the largest first (of equal ones by name) into the lightest fold.

    Groups of equal size are dealt in turns, so the driver sees one row for each size (fewer than the root of twice the
    rows) and makes a few segments of it; groups find their segment by their number among those of their size.
    """
    return dealt_folds(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size")), n, group)


def dealt_folds(sizes: DataFrame, n: int = 5, group: str = "cell", by: tuple[str, ...] = ()) -> DataFrame:
    """The folds of groups whose sizes are known, dealt for each key of `by` on its own; the driver sees a row for each key and size."""
    counts: dict[tuple, list] = {}
    for r in sizes.groupBy(*by, "size").agg(F.count("*").alias("m")).orderBy(F.desc("size")).collect():
        counts.setdefault(tuple(r[c] for c in by), []).append(r)
    rows = []
    for key, own in counts.items():
        load = [0] * min(n, sum(r["m"] for r in own))
        rows += [(*key, r["size"], at, turn) for r in own for at, turn in _dealt(load, r["size"], r["m"])]
    schema = StructType([*(sizes.schema[c] for c in by), *StructType.fromDDL("size long, at long, turn array<int>").fields])
    of_size = Window.partitionBy(*by, "size")
    segments = sizes.sparkSession.createDataFrame(rows, schema).withColumn("until", F.lead("at").over(of_size.orderBy("at")))
    numbered = sizes.withColumn("i", F.row_number().over(of_size.orderBy(group)) - 1)
    joined = numbered.join(segments, [*by, "size"]).where((F.col("i") >= F.col("at")) & (F.col("until").isNull() | (F.col("i") < F.col("until"))))
    return joined.select(*by, group, F.get("turn", ((F.col("i") - F.col("at")) % F.size("turn")).cast("int")).alias("fold"))


def folded(df: DataFrame, n: int = 5, group: str = "cell") -> DataFrame:
    return df.join(group_folds(df, n, group), group)


def fold_medians(df: DataFrame, columns, by: str = "fold") -> DataFrame:
    """by, fill: the medians of the columns' known values over all other folds' rows, 0 for columns without any."""
    folds = df.select(by).distinct().withColumnRenamed(by, "__to")
    others = df.select(by, *columns).join(F.broadcast(folds), F.col(by) != F.col("__to"))  # as many rows as folds
    fill = F.array(*(F.coalesce(F.percentile(F.round(c, ROUND), F.lit(0.5)), F.lit(0.0)) for c in columns))
    return others.groupBy(F.col("__to").alias(by)).agg(fill.alias("fill"))


def imputed(df: DataFrame, columns, by: str = "fold") -> DataFrame:
    """Each row's gaps filled as a row held out: with the median of the other folds' known values (0 for columns without any).
    Training rows of a model are filled by `filled_sums` with that model's own medians."""
    out = df.join(F.broadcast(fold_medians(df, columns, by)), by, "left")  # as many rows as folds
    return out.withColumns({c: F.coalesce(c, F.get("fill", F.lit(i)), F.lit(0.0)) for i, c in enumerate(columns)}).drop("fill")


def gap_sums(df: DataFrame, x: list[str], y: str, *by: str) -> DataFrame:
    """n, sums of known values (0 in a gap), of gap flags and of y, and the upper triangle of all their products, by key. Whatever
    the gaps are filled with later, the sums of the filled rows follow from these. Batches are added up in the tasks, so what is
    shuffled is a row for each batch and key."""
    size = 2 * len(x) + 1
    upper = np.triu_indices(size)
    keys = [df.schema[c] for c in by]

    def run(frames):
        for pdf in frames:
            known = pdf[x].to_numpy(float)
            gaps = np.isnan(known)
            v = np.column_stack([np.where(gaps, 0.0, known), gaps, pdf[y].to_numpy(float)])
            rows = []
            for key, at in pdf.groupby(list(by), sort=False).indices.items():
                part = v[at]
                rows.append((*(key if isinstance(key, tuple) else (key,)), len(at), np.concatenate([part.sum(0), (part.T @ part)[upper]]).tolist()))
            yield pd.DataFrame(rows, columns=[*by, "n", "v"])

    parts = df.where(F.col(y).isNotNull()).select(*by, *(F.col(c).cast("double").alias(c) for c in (*x, y))).mapInPandas(run, StructType([*keys, *StructType.fromDDL("n long, v array<double>").fields]))
    added = lambda a, b: F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(a, b)))
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), added(0, size).alias("s"), added(size, size + len(upper[0])).alias("p"))


def filled_sums(s, p, fill) -> tuple[np.ndarray, np.ndarray]:
    """Sums and the upper triangle of products of (x, y) when gaps are filled: x = v + fill * g."""
    d = len(fill)
    t = np.zeros((d + 1, 2 * d + 1))
    t[:d, :d], t[:d, d : 2 * d], t[d, 2 * d] = np.eye(d), np.diag(fill), 1.0
    return t @ np.array(s), (t @ _square(p, 2 * d + 1) @ t.T)[np.triu_indices(d + 1)]


def sums(df: DataFrame, x: list[str], y: str, *by: str) -> DataFrame:
    """n, sums and the upper triangle of the products of (x, y) by key, in one aggregation; rows with a gap don't count."""
    cols = [F.col(c).cast("double") for c in (*x, y)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.dropna(subset=[*x, y]).groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.sum(c) for c in cols)).alias("s"), F.array(*(F.sum(cols[i] * cols[j]) for i, j in pairs)).alias("p"))


def _square(p, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = p
    return out + np.triu(out, 1).T


def total_less_own(own: DataFrame, by: str) -> DataFrame:
    """The same sums over all other keys; the total is one row."""
    d = own.select(by, F.col("n").cast("double").alias("n"), "s", "p")
    flat = d.select(F.posexplode(F.concat(F.array("n"), "s", "p")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    total = flat.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("t"))  # one entry a sum
    both = d.withColumn("o", F.concat(F.array("n"), "s", "p")).crossJoin(F.broadcast(total))
    rest = both.withColumn("r", F.zip_with("t", "o", lambda a, b: a - b)).withColumn("d", F.size("s"))
    return rest.select(by, F.element_at("r", 1).alias("n"), F.slice(F.col("r"), F.lit(2), F.col("d")).alias("s"), F.slice(F.col("r"), F.col("d") + 2, F.size("p")).alias("p"))


MODEL = "w array<double>, m array<double>, sd array<double>, wc array<double>, noise double"


def _solve(n: float, s, p, alpha: float | None, shape: float = 1e-6):
    """Standardised ridge from sums: weights, means, scales, covariance of the weights, noise. alpha: a fixed penalty; None:
    Bayesian, from the data, with `shape` of the noise precision's prior."""
    s = np.array(s)
    d = len(s)
    m = s / n
    square = _square(p, d) / n
    cov = square - np.outer(m, m)
    flat = np.diag(cov) <= np.maximum(1e-13 * np.diag(square), 1e-18)  # what is left of a constant is rounding
    cov[flat], cov[:, flat] = 0.0, 0.0
    sd = np.where(flat, 1.0, np.sqrt(np.abs(np.diag(cov))))
    c = cov / np.outer(sd, sd) * n
    if alpha is None:
        w, wc, noise = bayesian_ridge(c[:-1, :-1], c[:-1, -1], c[-1, -1], n, shape)
    else:
        inverse = np.linalg.inv(c[:-1, :-1] + alpha * np.eye(d - 1))
        w = inverse @ c[:-1, -1]
        noise = max(float(c[-1, -1] - 2 * w @ c[:-1, -1] + w @ c[:-1, :-1] @ w) / max(n - d, 1), 0.0)
        wc = inverse * noise
    return w.tolist(), m.tolist(), sd.tolist(), wc.ravel().tolist(), float(noise)


def fitted(rest: DataFrame, by: str, alpha: float | None = None, least: int = 3, intercept: bool = False) -> DataFrame:
    """A ridge for each row of sums (by, n, s, p); none from fewer than `least` rows. intercept: it is penalised as well. With a
    column `fill` the sums are those of gap_sums and the gaps are filled with it."""
    key = rest.schema[by]

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                if r.n >= least:
                    w, m, *more = _solve(r.n, *(filled_sums(r.s, r.p, r.fill) if "fill" in pdf else (r.s, r.p)), alpha)
                    m[-1] *= r.n / (r.n + alpha) if intercept else 1
                    rows.append((getattr(r, by), w, m, *more))
            yield pd.DataFrame(rows, columns=[by, "w", "m", "sd", "wc", "noise"])

    return rest.mapInPandas(run, StructType([key, *StructType.fromDDL(MODEL).fields]))


def predicted(df: DataFrame, models: DataFrame, x: list[str], by: str) -> DataFrame:
    """df with pred and std of the model of its key, in Column arithmetic; null where a feature or the model is missing."""
    d = len(x)
    z = F.array(*((F.col(c).cast("double") - F.get("m", F.lit(i))) / F.get("sd", F.lit(i)) for i, c in enumerate(x)))
    known = df.join(models, by, "left").withColumn("z", z)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    line = dot(F.col("z"), F.col("w"))
    spread = F.aggregate(F.transform("z", lambda v, i: v * dot(F.slice("wc", i * d + 1, d), F.col("z"))), F.lit(0.0), lambda s, v: s + v)
    scale = F.get("sd", F.lit(d))
    out = known.withColumns({"pred": line * scale + F.get("m", F.lit(d)), "std": F.sqrt(F.greatest(spread + F.col("noise"), F.lit(0.0))) * scale})
    return out.drop("w", "m", "sd", "wc", "noise", "z")


def grouped_cv(df: DataFrame, x: list[str], y: str, group: str = "cell", n: int = 5, alpha: float | None = None) -> DataFrame:
    """df rows with fold, pred, std of a ridge trained on the other folds' cells; gaps of training and held-out rows alike are
    filled with the medians of that model's training rows.

    The training sums of a fold are the total less its own.
    """
    d = staged(folded(df.where(F.col(y).isNotNull()), n, group), "folds")
    rest = total_less_own(gap_sums(d, x, y, "fold"), "fold").join(fold_medians(d, x), "fold")
    return predicted(imputed(d, x), fitted(rest, "fold", alpha), x, "fold")


#: The grid of the noise prior's shape that tuning chooses from, and the inner folds it is judged by (fixed values).
SHAPES = (1e-6, 1e-3)
INNER = 3


def inner_folds(d: DataFrame, n: int = INNER, group: str = "cell") -> DataFrame:
    """fold, group, inner: the training cells of each outer fold dealt into inner folds."""
    cells = d.groupBy(group, "fold").agg(F.count("*").alias("times")).persist()
    out = None
    for r in d.select("fold").distinct().orderBy("fold").collect():
        rest = cells.where(F.col("fold") != r["fold"])
        part = group_folds(rest.withColumn("__one", F.explode(F.sequence(F.lit(1), F.col("times")))), n, group)
        part = part.select(F.lit(r["fold"]).cast("int").alias("outer"), group, F.col("fold").alias("inner"))
        out = part if out is None else out.unionByName(part)
    return out


def tuned_cv(df: DataFrame, x: list[str], y: str, group: str = "cell", n: int = 5, shapes=SHAPES, inner: int = INNER) -> DataFrame:
    """The same with a Bayesian ridge, nested: each fold's model has the shape of the noise prior with the least mean error over
    inner folds of its training cells (the first of equal ones; the first of all where fewer than `inner` cells train).

    One table of sums by outer and inner fold gives all inner models, what they err on their held-out cells, and the outer
    ones: gaps are filled with the medians of each model's own training rows. The table has outer times inner rows, medians as
    many; both go to the driver, no row does.
    """
    d = staged(folded(df.where(F.col(y).isNotNull()), n, group), "folds")
    if d.isEmpty():
        return predicted(imputed(d, x), df.sparkSession.createDataFrame([], f"fold int, shape double, {MODEL}"), x, "fold")
    levels = staged(inner_folds(d, inner, group), "inner-folds")
    rows = d.join(levels, group)
    table = {(r["outer"], r["inner"]): (float(r["n"]), np.array(r["s"]), np.array(r["p"])) for r in gap_sums(rows, x, y, "outer", "inner").collect()}
    held = F.broadcast(df.sparkSession.range(inner).select(F.col("id").cast("int").alias("held")))
    fill = F.array(*(F.coalesce(F.percentile(F.round(c, ROUND), F.lit(0.5)), F.lit(0.0)) for c in x))
    fills = {(r["outer"], r["held"]): r["fill"] for r in rows.join(held, F.col("held") != F.col("inner")).groupBy("outer", "held").agg(fill.alias("fill")).collect()}
    whole_fill = {r["fold"]: r["fill"] for r in fold_medians(d, x).collect()}
    models = []
    for f, medians in sorted(whole_fill.items()):
        parts = {g: v for (o, g), v in table.items() if o == f}
        whole = [sum(v[i] for v in parts.values()) for i in range(3)]
        if whole[0] < 3:
            continue
        errors = dict.fromkeys(shapes, 0.0)
        for g, own in parts.items() if len(parts) == inner else ():
            rest = [whole[i] - own[i] for i in range(3)]
            training, test = (filled_sums(v[1], v[2], fills[f, g]) for v in (rest, own))
            for a in shapes:
                errors[a] += np.sqrt(max(_squared_error(_solve(rest[0], *training, None, a), own[0], *test), 0.0) / own[0])
        best = min(shapes, key=lambda a: errors[a])  # noqa: B023
        models.append((f, float(best), *_solve(whole[0], *filled_sums(whole[1], whole[2], medians), None, best)))
    known = df.sparkSession.createDataFrame(models, f"fold int, shape double, {MODEL}")
    return predicted(imputed(d, x), known, x, "fold")


def cv_summary(predicted_rows: DataFrame, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, rmse, mae, r2 and the share within 1.645 standard deviations, overall or by key (such as cell)."""
    a, p, s = F.col(y), F.col("pred"), F.col("std")
    return predicted_rows.where(p.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), M.rmse(a, p).alias("rmse"), M.mae(a, p).alias("mae"), M.r2(a, p).alias("r2"), M.coverage(a, p - 1.645 * s, p + 1.645 * s).alias("coverage90"))


def medians_without(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, fill: medians of the columns' known values over the rows of all other keys (0 for columns without any).

    The r-th value of the others is a value of the whole: that of rank r plus the number of own rows before it, which are those
    with at most r values of others below. So a key needs its own rows' places in the whole and two values by rank, not the
    others' rows. Values are rounded to ROUND digits, places are taken of distinct ones.
    """
    long = df.select(key, F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.round(F.col(c).cast("double"), ROUND).alias("v")) for i, c in enumerate(columns))))).where("v IS NOT NULL")
    own = long.groupBy(key, "i", "v").agg(F.count("*").alias("c"))
    whole = own.groupBy("i", "v").agg(F.sum("c").alias("n"))
    place = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = whole.withColumn("below", F.sum("n").over(place) - F.col("n"))
    all_rows = whole.groupBy("i").agg(F.sum("n").alias("all"))
    before = Window.partitionBy(key, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.join(whole, ["i", "v"]).withColumn("free", F.col("below") - (F.sum("c").over(before) - F.col("c")))
    sizes = df.select(key).distinct().join(F.broadcast(all_rows)).join(own.groupBy(key, "i").agg(F.sum("c").alias("mine")), [key, "i"], "left").na.fill(0, ["mine"])  # a row for each column
    rest = F.col("all") - F.col("mine")
    wanted = sizes.where(rest > 0).select(key, "i", F.explode(F.array(F.floor((rest - 1) / 2), F.floor(rest / 2))).alias("r"), F.monotonically_increasing_id().alias("id"))
    met = wanted.join(placed.select(key, "i", "c", "free"), [key, "i"], "left").groupBy(key, "i", "id", "r").agg(F.sum(F.when(F.col("free") <= F.col("r"), F.col("c")).otherwise(0)).alias("t"))
    asked = met.select("i", (F.col("r") + F.col("t")).alias("at"), F.lit(1).alias("o"), F.col(key).alias("__key"), F.lit(None).cast("double").alias("v"))
    both = asked.unionByName(whole.select("i", F.col("below").alias("at"), F.lit(0).alias("o"), F.lit(None).cast(df.schema[key].dataType).alias("__key"), "v"))
    value = F.last("v", ignorenulls=True).over(Window.partitionBy("i").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("v", value).where("o = 1").groupBy("__key", "i").agg(F.avg("v").alias("m"))
    fill = F.array(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col("m"))), F.lit(0.0)) for i in range(len(columns))))
    filled = found.groupBy(F.col("__key").alias(key)).agg(fill.alias("fill"))
    return df.select(key).distinct().join(filled, key, "left").select(key, F.coalesce("fill", F.array_repeat(F.lit(0.0), len(columns))).alias("fill"))


def backtest(fade: DataFrame, x: list[str], alpha: float | None = None, cell: str = "cell") -> DataFrame:
    """Each origin's health `horizon` cycles ahead by a model of the loss that all other cells have taught; gaps, those of the
    cell itself too, are filled with the others' medians. Cells with fewer than three others get no forecast."""
    fade = staged(fade, "backtest")
    fills = staged(medians_without(fade, x, cell), "backtest-medians")
    own = gap_sums(fade, x, "target", cell)
    models = fitted(total_less_own(own, cell).join(fills, cell), cell, alpha)
    enough = own.agg((F.count("*") > 3).alias("enough"))
    d = fade.join(fills, cell).withColumns({c: F.coalesce(F.col(c).cast("double"), F.get("fill", F.lit(i))) for i, c in enumerate(x)}).drop("fill")
    out = predicted(d, models, x, cell).crossJoin(F.broadcast(enough)).where("enough")
    ahead = F.col("horizon") / 100
    return out.select(cell, "k0", "soh_now", "soh_future", "target", "horizon", F.col("pred").alias("rate_pred"), (F.col("soh_now") - F.col("pred") * ahead).alias("soh_pred"), (F.col("std") * ahead).alias("soh_std"))


def _squared_error(model, n: float, s, p) -> float:
    """Of a model on rows with these sums, as a quadratic form in (1, x, y)."""
    w, m, sd, _, _ = model
    beta = np.array(w) * sd[-1] / np.array(sd[:-1])
    const = m[-1] - beta @ np.array(m[:-1])
    v = np.append(-beta, 1.0)
    return float(v @ _square(p, len(m)) @ v - 2 * const * v @ np.array(s) + n * const * const)


def gaussian_process_cv(df: DataFrame, x: list[str], y: str, group: str = "cell", n: int = 5, most: int = 700, seed: int = 7) -> DataFrame:
    """grouped_cv with a Gaussian process on at most `most` training rows a fold (a parameter of the model); a task per fold."""
    d = imputed(folded(df.where(F.col(y).isNotNull()), n, group), x)
    folds = [r["fold"] for r in d.select("fold").distinct().collect()]
    train = d.select("fold", *x, y).withColumn("r", F.xxhash64("fold", *x, F.lit(seed))).orderBy("r").limit(most * len(folds)).toPandas()

    def run(frames):
        models = {}
        for pdf in frames:
            pred, std = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            for f in pdf["fold"].unique():
                if f not in models:
                    t = train[train["fold"] != f].head(most)
                    xs, ys = t[x].to_numpy(float), t[y].to_numpy(float)
                    m, s = xs.mean(0), xs.std(0) + 1e-9
                    z, ym, ysd = (xs - m) / s, ys.mean(), ys.std() + 1e-9
                    d2 = ((z[:, None] - z[None]) ** 2).sum(-1)
                    scale = np.median(d2[d2 > 0]) if (d2 > 0).any() else 1.0
                    k = np.exp(-d2 / scale) + 0.05 * np.eye(len(z))
                    low = np.linalg.cholesky(k)
                    models[f] = (z, m, s, scale, low, np.linalg.solve(low.T, np.linalg.solve(low, (ys - ym) / ysd)), ym, ysd)
                z, m, s, scale, low, a, ym, ysd = models[f]
                on = (pdf["fold"] == f).to_numpy()
                q = (pdf.loc[on, x].to_numpy(float) - m) / s
                k = np.exp(-((q[:, None] - z[None]) ** 2).sum(-1) / scale)
                v = np.linalg.solve(low, k.T)
                pred[on] = k @ a * ysd + ym
                std[on] = np.sqrt(np.maximum(1.05 - (v * v).sum(0), 1e-9)) * ysd
            yield pdf.assign(pred=pred, std=std)

    return d.mapInPandas(run, StructType([*d.schema.fields, *StructType.fromDDL("pred double, std double").fields]))


def dealt_anew(rows: DataFrame, columns: list[str], repeats: int, seed: int = 7, bucket: int = 1000) -> DataFrame:
    """rows for each column and repeat, with `feature`, `repeat`, `old` and `new`: the column's values dealt out anew at random.
    Rows are gathered once in random buckets of about so many; within a bucket each column and repeat has its values in a random
    order of its own, so only the rows themselves are shuffled. rows: with a key `__id`."""
    counted = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__all"))))  # one row
    own = F.struct("__id", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.struct(*rows.columns).alias("row"))
    held = counted.select(F.pmod(F.xxhash64("__id", F.lit(seed)), F.greatest(F.ceil(F.col("__all") / bucket), F.lit(1))).alias("__b"), own.alias("own"))
    held = held.groupBy("__b").agg(F.sort_array(F.collect_list("own")).alias("own"))  # about `bucket` rows
    names = F.array(*map(F.lit, columns))
    each = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1)))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = lambda r: F.struct(F.xxhash64(r["__id"], F.col("i"), F.col("repeat"), F.lit(seed)).alias("at"), r["__id"].alias("id"), F.get(r["x"], F.col("i")).alias("v"))
    turned = each.withColumn("news", F.sort_array(F.transform("own", order)))
    flat = turned.select("i", "repeat", "news", F.posexplode("own").alias("at", "o"))
    return flat.select("o.row.*", F.get(names, F.col("i")).alias("feature"), "repeat", F.get("o.x", F.col("i")).alias("old"), F.get("news", F.col("at"))["v"].alias("new"))


def permutation_importance(df: DataFrame, x: list[str], y: str, group: str = "cell", repeats: int = 5, n: int = 4) -> DataFrame:
    """feature, increase: mean rise of the error on the cells of one held-out fold (of n) when a feature's values are dealt out
    anew among its rows. A row's prediction moves by its weight times the change, so rows are predicted once."""
    d = staged(folded(df.where(F.col(y).isNotNull()), n, group), "folds")
    rest = gap_sums(d.where("fold <> 0"), x, y, "fold").groupBy().agg(F.lit(0).alias("fold"), F.sum("n").alias("n"), *(F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(size))).alias(c) for c, size in (("s", 2 * len(x) + 1), ("p", (2 * len(x) + 1) * (len(x) + 1)))))
    models = fitted(rest.join(fold_medians(d, x).where("fold = 0"), "fold"), "fold")
    test = predicted(imputed(d, x).where("fold = 0"), models, x, "fold").join(F.broadcast(models.select("fold", "w", "sd")), "fold")  # one row
    test = staged(test.where(F.col("pred").isNotNull()).withColumn("__id", F.monotonically_increasing_id()), "importance")
    weight = F.coalesce(*(F.when(F.col("feature") == c, F.get("w", F.lit(i)) / F.get("sd", F.lit(i)) * F.get("sd", F.lit(len(x)))) for i, c in enumerate(x)))
    moved = dealt_anew(test, x, repeats).withColumn("moved", F.col("pred") + weight * (F.col("new") - F.col("old")))
    rises = moved.groupBy("feature", "repeat").agg((M.rmse(F.col(y), F.col("moved")) - M.rmse(F.col(y), F.col("pred"))).alias("rise"))
    return rises.groupBy("feature").agg(F.avg("rise").alias("increase"))


def _moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and covariance (over n) of complete rows, from one aggregation."""
    r = sums(df.withColumn("__all", F.lit(0)), columns[:-1], columns[-1], "__all").first()
    if r is None:
        return 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
    m = np.array(r["s"]) / r["n"]
    return r["n"], m, _square(r["p"], len(columns)) / r["n"] - np.outer(m, m)


def pca(df: DataFrame, columns: list[str], n: int = 2, against: str | None = None) -> tuple[DataFrame, pd.DataFrame, np.ndarray, float | None]:
    """Scores, loadings, explained shares, and the correlation of the first component with `against`; from moments. The
    largest loading of a component is positive."""
    d = df.dropna(subset=[*columns, *([against] if against else [])])
    _, m, cov = _moments(d, columns)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))])
    z = [(F.col(c) - float(a)) / float(b) for c, a, b in zip(columns, m, sd, strict=True)]
    scores = d.withColumns({f"PC{j + 1}": sum(float(vectors[i, j]) * z[i] for i in range(len(columns))) for j in range(n)})
    loadings = pd.DataFrame(vectors[:, :n], index=columns, columns=[f"PC{j + 1}" for j in range(n)])
    corr = scores.agg(F.corr("PC1", against)).first()[0] if against else None
    return scores, loadings, values / values.sum(), corr


def power_label(dof: int) -> str:
    """How much a regression with so many degrees of freedom can show (fixed values)."""
    return "not estimable" if dof < 3 else "very low power" if dof < 10 else "low power" if dof < 25 else "adequate"


def stress_regression(rates: DataFrame, factors: list[str], y: str = "fade_rate") -> tuple[pd.DataFrame, dict]:
    """Standardised coefficients of a regression over cells with errors, p, inflation and whether they are confounded; and
    n, r2, adj_r2, power and the pairs of factors that go together (|r| > 0.7). All from moments of the cells' rows."""
    spread = rates.agg(*(F.stddev_pop(c).alias(c) for c in factors)).first()
    factors = [c for c in factors if spread[c]]  # those that nothing is known of would leave no complete row
    n, m, cov = _moments(rates, [*factors, y])
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    keep = [i for i in range(len(factors)) if sd[i] > 1e-12]
    p, dof = len(keep), n - len(keep) - 1
    facts = {"n": n, "power": power_label(dof), "confounding": [], "r2": None, "adj_r2": None}
    if p == 0 or dof < 2 or sd[-1] <= 0:
        return pd.DataFrame(columns=["factor", "coef", "se", "t", "p", "vif", "confounded"]), facts
    corr = cov[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep])
    inverse = np.linalg.pinv(corr)
    with_y = cov[keep, -1] / sd[keep]
    beta = inverse @ with_y
    sse = n * max(float(cov[-1, -1] - with_y @ beta), 0.0)
    se = np.sqrt(sse / dof * np.diag(inverse) / n)
    t = beta / np.where(se > 0, se, np.inf)
    vif = np.maximum(np.diag(inverse), 1.0)
    r2 = 1 - sse / (n * float(cov[-1, -1]))
    names = [factors[i] for i in keep]
    facts |= {"r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / dof, "confounding": [f"{names[i]} ~ {names[j]} (r={corr[i, j]:+.2f})" for i in range(p) for j in range(i + 1, p) if abs(corr[i, j]) > 0.7]}
    return pd.DataFrame({"factor": names, "coef": beta, "se": se, "t": t, "p": [t_two_sided(float(v), dof) for v in t], "vif": vif, "confounded": vif > 5}), facts


