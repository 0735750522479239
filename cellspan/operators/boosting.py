"""Gradient boosting over histograms with whole cells held out: all models of all folds (and of a search) grow together.

Features become quantile bins once for each set of training rows, a byte a value. A pass over the rows adds up residuals and
counts by model, leaf, feature and bin; the tasks that add them up choose each leaf's best split, so the driver sees a row for
each leaf and no histogram. Leaves split best first: a pass asks for all leaves that the order so far would split, and the
order is final once every split leaf's children are known. Residuals are added up as whole numbers, so trees depend neither
on the rows' order nor on tasks that ran twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellspan.operators.learning import INNER, ROUND, folded, inner_folds
from cellspan.sources.staging import staged

BINS = 256
UNIT = 2.0**-24  # residuals are whole numbers of this share of the target's range
REFRESH = 10  # rounds after which rows are written again with what the trees so far add up to
TRAINS, TESTS, OUT = 0, 1, 2

#: Rates and numbers of leaves that a search chooses from, and the defaults without one (fixed values).
GRID = tuple((rate, leaves) for rate in (0.05, 0.15) for leaves in (8, 24))
DEFAULT = (0.1, 31)
ROUNDS, LEAST = 200, 20


@dataclass
class Model:
    split: int  # which rows train and test it: a place in their `role`
    rate: float
    leaves: int


@dataclass
class Tree:
    """Node i goes on to left[i] where the bin of feature[i] is at most cut[i], else to left[i] + 1; feature -1: a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (live := self.feature[at] >= 0).any():
            at = np.where(live, self.left[at] + (bins[rows, self.feature[at]] > self.cut[at]), at)
        return at


@dataclass
class Growing:
    """A tree whose leaves are split best first, `leaves` of them at most."""

    leaves: int
    least: int
    rows: list = field(default_factory=lambda: [None])
    total: list = field(default_factory=lambda: [None])
    best: list = field(default_factory=lambda: [None])  # (gain, feature, cut, rows below, total below); False: no split
    left: list = field(default_factory=lambda: [-1])

    def tell(self, node: int, rows: int, total: int, best) -> None:
        self.rows[node], self.total[node], self.best[node] = rows, total, best

    def order(self) -> list[int]:
        """Nodes to split, the largest gain first, as far as gains are known."""
        heap = [(-self.best[0][0], 0)] if self.best[0] else []
        out = []
        while heap and len(out) < self.leaves - 1:
            _, node = heapq.heappop(heap)
            out.append(node)
            for child in (self.left[node], self.left[node] + 1) if self.left[node] >= 0 else ():
                if self.best[child]:
                    heapq.heappush(heap, (-self.best[child][0], child))
        return out

    def wanted(self) -> list[int]:
        """Nodes whose best split must be known next; none when the order is final. Children of the last split stay leaves."""
        if self.best[0] is None:
            return [0]
        out = []
        for place, node in enumerate(self.order()):
            if self.left[node] < 0:
                _, _, _, rows, total = self.best[node]
                self.left[node] = len(self.rows)
                for n, s in ((rows, total), (self.rows[node] - rows, self.total[node] - total)):
                    self.rows.append(n)
                    self.total.append(s)
                    self.best.append(None if n >= 2 * self.least else False)
                    self.left.append(-1)
            if place < self.leaves - 2:
                out += [c for c in (self.left[node], self.left[node] + 1) if self.best[c] is None]
        return out

    def tree(self, scale: float, split: list[int] | None = None) -> Tree:
        """The tree as it stands, or with these nodes split only; values are means of residuals times `scale`."""
        inner = {i for i in range(len(self.left)) if self.left[i] >= 0} if split is None else set(split)
        n = len(self.left)
        feature, cut = np.full(n, -1, np.int16), np.zeros(n, np.int16)
        for i in inner:
            feature[i], cut[i] = self.best[i][1], self.best[i][2]
        value = np.array([scale * s / r if r else 0.0 for r, s in zip(self.rows, self.total, strict=True)]) if split is not None else np.zeros(n)
        return Tree(feature, cut, np.array(self.left), value)


def best_split(counts: np.ndarray, totals: np.ndarray, least: int):
    """(gain, feature, cut, rows below, total below) from (feature, bin) histograms of a leaf; None if no cut leaves `least` rows
    on both sides or gains anything. Of equal gains the first feature's and the lowest cut."""
    low, below = counts.cumsum(axis=1), totals.cumsum(axis=1)
    n, s = low[0, -1], below[0, -1]
    high, above = n - low, s - below
    fits = (low >= least) & (high >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = below.astype(float) ** 2 / low + above.astype(float) ** 2 / high - float(s) ** 2 / n
    gain = np.where(fits, gain, -1.0)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    # a constant leaf has gains from rounding alone
    if gain[f, b] <= 1e-12 * float(np.abs(below).max()) ** 2:
        return None
    return float(gain[f, b]), int(f), int(b), int(low[f, b]), int(below[f, b])


def edges(data: DataFrame, x: list[str], y: str, splits: int) -> dict[int, tuple]:
    """split: (fill of each feature, bounds of bins of each, mean of y, range of y about it) over the split's training rows.

    Bounds lie half-way between neighbouring quantiles, so features of at most BINS values have a bin for each. Quantiles come
    from sketches of bounded size, medians of values rounded to ROUND digits.
    """
    trains = F.filter(F.transform("role", lambda v, i: F.when(v == TRAINS, i)), lambda i: i.isNotNull())
    long = data.select(*x, y, F.explode(trains).alias("split"))
    levels = [i / (BINS - 1) for i in range(BINS)]
    known = {c: F.nanvl(c, F.lit(None)) for c in x}
    found = long.groupBy("split").agg(
        F.array(*(F.coalesce(F.percentile(F.round(v, ROUND), F.lit(0.5)), F.lit(0.0)) for v in known.values())).alias("fill"), F.round(F.avg(y), 12).alias("mean"), F.min(y).alias("low"), F.max(y).alias("high"),
        *(F.percentile_approx(v, levels, F.lit(20000)).alias(f"q{i}") for i, v in enumerate(known.values())), F.array(*(F.count_if(v.isNull()) for v in known.values())).alias("gaps"),
    )
    out = {}
    for r in found.collect():  # a row for each split
        bounds = []
        for i, fill in enumerate(r["fill"]):
            v = np.unique([*(r[f"q{i}"] or []), *([fill] if r["gaps"][i] else [])])
            v = v if len(v) <= BINS else np.delete(v, np.searchsorted(v, fill))
            bounds.append((v[:-1] + v[1:]) / 2)
        out[r["split"]] = (list(r["fill"]), bounds, r["mean"], max(r["high"] - r["mean"], r["mean"] - r["low"]) or 1.0)
    return out


def binned(raw: np.ndarray, known: tuple) -> np.ndarray:
    fill, bounds, _, _ = known
    full = np.where(np.isnan(raw), np.asarray(fill, float), raw)
    return np.stack([np.searchsorted(b, full[:, j], side="left") for j, b in enumerate(bounds)], axis=1).astype(np.uint8)


def _rows(pdf: pd.DataFrame, splits: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bins (row, split, feature), role (row, split), y, score (row, model) of a batch."""
    n = len(pdf)
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(n, splits, d)
    role = np.frombuffer(b"".join(pdf["role"]), np.int8).reshape(n, splits)
    return bins, role, pdf["y"].to_numpy(float), np.frombuffer(b"".join(pdf["score"]), float).reshape(n, -1).copy()


def _raise(score: np.ndarray, bins: np.ndarray, models: list[Model], rounds: list[list[Tree]]) -> None:
    for grown in rounds:
        for m, tree in enumerate(grown):
            score[:, m] += tree.value[tree.leaf(bins[:, models[m].split])]


ROW = "y double, role binary, bins binary, score binary"


def boost(data: DataFrame, x: list[str], y: str, models: list[Model], rounds: int = ROUNDS, least: int = LEAST) -> tuple[list[list[Tree]], dict[int, tuple], DataFrame]:
    """Trees (round, model), what `edges` found, and the training rows with the scores of all models.

    data: x, y (without null) and role, an array with TRAINS, TESTS or OUT for each split. Splits without a training row have
    no entry in the second result; their models predict nothing.
    """
    splits, d = 1 + max(m.split for m in models), len(x)
    known = edges(data, x, y, splits)
    if not known:
        return [], known, data.sparkSession.createDataFrame([], ROW)

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raw = pdf[x].to_numpy(float)
            bins = np.stack([binned(raw, known[s]) if s in known else np.zeros(raw.shape, np.uint8) for s in range(splits)], axis=1)
            score = np.tile([known[m.split][2] if m.split in known else np.nan for m in models], (len(pdf), 1))
            role = np.stack(pdf["role"].to_list()).astype(np.int8) if len(pdf) else np.zeros((0, splits), np.int8)
            yield pd.DataFrame({"y": pdf[y], "role": [v.tobytes() for v in role], "bins": [v.tobytes() for v in bins], "score": [v.tobytes() for v in score]})

    rows = staged(data.select(*x, y, "role").hint("rebalance").mapInPandas(start, ROW), "boosting")  # a pass is a job: few small tasks
    scale = [known[m.split][3] * UNIT if m.split in known else 1.0 for m in models]
    trees: list[list[Tree]] = []
    behind: list[list[Tree]] = []
    for _ in range(rounds):
        growing = [Growing(m.leaves, least) for m in models]
        for m, model in enumerate(models):
            if model.split not in known:
                growing[m].tell(0, 0, 0, False)
        while wanted := {m: w for m, g in enumerate(growing) if (w := g.wanted())}:
            for r in _splits(rows, models, behind, {m: growing[m].tree(0.0) for m in wanted}, wanted, scale, splits, d, least):
                growing[r["model"]].tell(r["node"], r["n"], r["total"], (r["gain"], r["feature"], r["cut"], r["below"], r["total_below"]) if r["feature"] >= 0 else False)
            for m, nodes in wanted.items():  # none is asked for twice
                for node in nodes:
                    if growing[m].best[node] is None:
                        growing[m].tell(node, growing[m].rows[node] or 0, growing[m].total[node] or 0, False)
        grown = [g.tree(models[m].rate * scale[m], g.order()) for m, g in enumerate(growing)]
        trees.append(grown)
        behind.append(grown)
        if len(behind) == REFRESH or len(trees) == rounds:
            rows = staged(_raised(rows, models, behind, splits, d), "boosting")
            behind = []
        if all((t.feature < 0).all() for t in grown):
            break  # nothing is left to gain, and later rounds would see the same
    return trees, known, rows if not behind else _raised(rows, models, behind, splits, d)


def _raised(rows: DataFrame, models: list[Model], behind: list[list[Tree]], splits: int, d: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bins, _, _, score = _rows(pdf, splits, d)
            _raise(score, bins, models, behind)
            yield pdf.assign(score=[v.tobytes() for v in score])

    return rows.mapInPandas(run, ROW)


def _splits(rows: DataFrame, models: list[Model], behind: list[list[Tree]], partial: dict[int, Tree], wanted: dict[int, list[int]], scale: list[float], splits: int, d: int, least: int) -> list:
    """model, node, n, total, gain, feature, cut, below, total_below of the wanted nodes that have rows, from one pass."""
    size = d * BINS

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {m: np.zeros((2, len(nodes), size), np.int64) for m, nodes in wanted.items()}
        offset = np.arange(d) * BINS
        for pdf in frames:
            bins, role, target, score = _rows(pdf, splits, d)
            _raise(score, bins, models, behind)
            for m, nodes in wanted.items():
                slot = np.full(len(partial[m].feature), -1)
                slot[nodes] = np.arange(len(nodes))
                own = np.flatnonzero(role[:, models[m].split] == TRAINS)
                b = bins[own, models[m].split]
                at = slot[partial[m].leaf(b)]
                live = at >= 0
                place = (at[live, None] * size + offset + b[live]).ravel()
                residual = np.rint((target[own[live]] - score[own[live], m]) / scale[m])
                shape = (len(nodes), size)
                held[m][0] += np.bincount(place, minlength=shape[0] * size).reshape(shape)
                held[m][1] += np.rint(np.bincount(place, np.repeat(residual, d), shape[0] * size)).astype(np.int64).reshape(shape)
        for m, nodes in wanted.items():
            for i, node in enumerate(nodes):
                if held[m][0, i].any():
                    yield pd.DataFrame({"model": [m], "node": [node], "sums": [held[m][:, i].tobytes()]})

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for m, node, sums in zip(pdf["model"], pdf["node"], pdf["sums"], strict=True):
                v = np.frombuffer(sums, np.int64)
                held[m, node] = held[m, node] + v if (m, node) in held else v
        for (m, node), v in held.items():
            counts, totals = v.reshape(2, d, BINS)
            best = best_split(counts, totals, least) or (-1.0, -1, -1, 0, 0)
            yield pd.DataFrame([(m, node, counts[0].sum(), totals[0].sum(), *best)], columns=["model", "node", "n", "total", "gain", "feature", "cut", "below", "total_below"])

    parts = rows.mapInPandas(gathered, "model int, node int, sums binary").repartition("model", "node")
    return parts.mapInPandas(chosen, "model int, node int, n long, total long, gain double, feature int, cut int, below long, total_below long").collect()  # at most a row for each leaf of each model


def boosted_cv(df: DataFrame, x: list[str], y: str, group: str = "cell", n: int = 5, rate: float = DEFAULT[0], leaves: int = DEFAULT[1], rounds: int = ROUNDS, least: int = LEAST, tune: bool = False, grid=GRID, inner: int = INNER) -> DataFrame:
    """df rows (those with y) with fold, pred, rate and leaves: a boosted model of squared error that the other folds' cells have
    taught. Null and NaN are gaps, filled with the median over the model's training rows; with fewer than two folds there is no
    prediction. There is no early stopping.

    tune: rate and leaves come from `grid` by the least mean error over inner folds of the training cells (the first of equal
    ones; where fewer than `inner` cells train, the first of the grid). All models of the search grow in the same passes.
    """
    d = staged(folded(df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))), n, group), "folds")
    folds = [r["fold"] for r in d.select("fold").distinct().orderBy("fold").collect()]  # at most n
    options = list(grid) if tune else [(rate, leaves)]
    models = [Model(s, *o) for s in range(len(folds)) for o in options]
    role: list[Column] = [F.when(F.col("fold") == f, TESTS).otherwise(TRAINS) for f in folds]
    data = d
    if tune and len(folds) > 1:
        deep = inner_folds(d, inner, group).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("outer", "inner"))).alias("__inner"))  # an entry a fold
        data = d.join(deep, group)
        for f in folds:
            for g in range(inner):
                models += [Model(len(role), *o) for o in options]
                role.append(F.when(F.col("fold") == f, OUT).when(F.try_element_at("__inner", F.lit(f)) == g, TESTS).otherwise(TRAINS))
    best = dict.fromkeys(range(len(folds)), 0)
    trees: list[list[Tree]] = []
    known: dict[int, tuple] = {}
    if len(folds) > 1:
        data = data.select(*(F.col(c).cast("double").alias(c) for c in x), F.col(y).cast("double").alias("__y"), F.array(*(v.cast("tinyint") for v in role)).alias("role"))
        trees, known, rows = boost(data, x, "__y", models, rounds, least)
        if tune:
            best = _least_error(rows, models, len(folds), len(options), inner, len(role), len(x))
    final = {f: (s * len(options) + best[s]) for s, f in enumerate(folds)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raw, fold = pdf[x].to_numpy(float), pdf["fold"].to_numpy()
            pred = np.full(len(pdf), np.nan)
            for f, m in final.items():
                own = np.flatnonzero(fold == f)
                if len(own) and models[m].split in known:
                    bins = binned(raw[own], known[models[m].split])
                    pred[own] = known[models[m].split][2]
                    for grown in trees:
                        pred[own] += grown[m].value[grown[m].leaf(bins)]
            yield pdf.assign(pred=pred, rate=[models[final[f]].rate for f in fold], leaves=[models[final[f]].leaves for f in fold])

    out = d.mapInPandas(run, StructType([*d.schema.fields, *StructType.fromDDL("pred double, rate double, leaves int").fields]))
    return out.withColumn("pred", F.nanvl("pred", F.lit(None).cast("double")))


def _least_error(rows: DataFrame, models: list[Model], folds: int, options: int, inner: int, splits: int, d: int) -> dict[int, int]:
    """Outer split: place in the grid of the least mean error over its inner folds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            _, role, target, score = _rows(pdf, splits, d)
            tests = role[:, [m.split for m in models]] == TESTS
            error = np.where(tests, (target[:, None] - score) ** 2, 0.0)
            yield pd.DataFrame({"model": np.arange(len(models), dtype=np.int32), "n": tests.sum(axis=0), "sse": error.sum(axis=0)})

    sums = {r["model"]: (r["n"], r["sse"]) for r in rows.mapInPandas(run, "model int, n long, sse double").groupBy("model").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse")).collect()}
    out = {}
    for s in range(folds):
        base = (folds + s * inner) * options
        table = [[sums[base + g * options + o] for g in range(inner)] for o in range(options)]
        full = all(n for row in table for n, _ in row)
        errors = [float(np.mean([np.sqrt(e / n) for n, e in row])) if full else 0.0 for row in table]
        out[s] = int(np.nanargmin(errors)) if np.isfinite(errors).any() else 0
    return out
