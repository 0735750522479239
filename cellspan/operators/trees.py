"""Extremely randomised trees with whole cells held out, grown level by level.

All trees of all folds grow at once: a level is one aggregation. Each node draws a random threshold for each feature within the
box that its ancestors' splits leave of the feature's range; tasks walk their rows down the trees so far and add up counts and
sums on the lower side of every drawn threshold; the split that lowers the squared error most is taken. Trees are arrays in heap
order, so with `depth` and the number of trees their size is bounded whatever the number of rows: that is what is broadcast
and what the driver sees of a level. No row leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellspan.operators.learning import fold_medians, folded
from cellspan.sources.staging import staged

TREES = 200  # of a fold


@dataclass
class Forest:
    """Trees of all folds: tree number = fold * trees + number within the fold; node i has the children 2i + 1 and 2i + 2."""

    fold: np.ndarray  # of each tree
    feature: np.ndarray  # (tree, node); -1 at leaves
    threshold: np.ndarray
    value: np.ndarray  # mean of the node's rows

    def nodes(self, tree: int, x: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has come to after so many levels; x: (feature, row)."""
        n = x.shape[1]
        flat, start = x.ravel(), np.arange(n)
        feature, threshold = self.feature[tree].astype(np.int64), self.threshold[tree]
        # a leaf's test is of the first feature and against nothing: its rows stay
        inner = feature >= 0
        offset, step = np.where(inner, feature, 0) * n, np.where(inner, np.arange(len(feature)) + 1, 0)
        at = np.zeros(n, np.int64)
        for i in range(levels):
            if i == 0:
                if not inner[0]:
                    break
                at = 1 + (x[feature[0]] > threshold[0])
                continue
            right = flat.take(offset.take(at) + start) > threshold.take(at)
            right &= inner.take(at)
            at += step.take(at)
            at += right
        return at


def filled(x: np.ndarray, fill) -> np.ndarray:
    return np.where(np.isnan(x), np.asarray(fill, float), x)


#: Rows whose places in a tree are looked at together.
ROWS = 1 << 15


def gathered(frames: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """Frames of about so many rows."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def side_sums(frames: Iterator[pd.DataFrame], x: list[str], y: str, forest: Forest, fills: dict, drawn: np.ndarray | None, level: int) -> np.ndarray:
    """(tree, node of the level, 2 + 2 features): rows, sum of y, and of each feature the rows and the sum at or below the node's
    drawn threshold, over the training rows of each tree; without thresholds the first two.

    A row has one bit for each feature, so rows and sums are counted by node and pattern of bits once, and a feature's side is
    the patterns that have its bit.
    """
    width, d = 1 << level, 0 if drawn is None else len(x)
    some = min(10, max(1, 13 - level))  # bits of a pattern; few enough that its counts stay in the cache
    groups = [range(i, min(i + some, d)) for i in range(0, d, some)] or [range(0)]
    out = np.zeros((len(forest.fold), width, 2 + 2 * d))
    for pdf in gathered(frames):
        raw, target, fold = pdf[x].to_numpy(float), pdf[y].to_numpy(float), pdf["fold"].to_numpy()
        for f, fill in fills.items():
            rows = fold != f
            part, own = np.ascontiguousarray(filled(raw[rows], fill).T), target[rows]
            for t in np.flatnonzero(forest.fold == f).tolist():
                node, v, p = forest.nodes(t, part, level), own, part
                node -= width - 1
                if len(node) and node.min() < 0:  # others rest in leaves above
                    live = node >= 0
                    node, v, p = node[live], v[live], p[:, live]
                for g, bits in enumerate(groups):
                    size = 1 << len(bits)
                    code = node * size
                    for i, j in enumerate(bits):
                        code += (p[j] <= np.ascontiguousarray(drawn[t, :, j]).take(node)) * np.int64(1 << i)
                    n, total = (np.bincount(code, w, width * size).reshape(width, size) for w in (None, v))
                    has = (np.arange(size)[:, None] >> np.arange(len(bits)) & 1).astype(float)
                    if g == 0:
                        out[t, :, 0] += n.sum(axis=1)
                        out[t, :, 1] += total.sum(axis=1)
                    if len(bits):
                        out[t, :, 2 + bits[0] : 3 + bits[-1]] += n @ has
                        out[t, :, 2 + d + bits[0] : 3 + d + bits[-1]] += total @ has
    return out


def extra_trees(data: DataFrame, x: list[str], y: str, fills: dict[int, list[float]], trees: int = TREES, depth: int = 7, least: int = 2, share: float = 1.0, seed: int = 7) -> Forest:
    """Trees of the folds in `fills` (fold: what gaps are filled with), each from all rows of the other folds.

    data: fold, x, y. least: rows of a leaf; share: of the features that a node draws thresholds for.
    """
    d, folds = len(x), sorted(fills)
    n, size = trees * len(folds), (1 << (depth + 1)) - 1
    forest = Forest(np.repeat(folds, trees), np.full((n, size), -1, np.int16), np.zeros((n, size)), np.zeros((n, size)))
    bounds = data.agg(*(g(F.nanvl(c, F.lit(None))) for c in x for g in (F.min, F.max))).first()
    low, high = (np.array([0.0 if v is None else v for v in bounds[i::2]]) for i in (0, 1))
    boxes = np.empty((n, 1, d, 2))
    boxes[..., 0], boxes[..., 1] = low, high
    rng = np.random.default_rng(seed)
    for level in range(depth + 1):
        width = 1 << level
        drawn = boxes[..., 0] + rng.random((n, width, d)) * (boxes[..., 1] - boxes[..., 0]) if level < depth else None  # the last has no splits

        def partial(frames, level=level, drawn=drawn):
            sums = side_sums(frames, x, y, forest, fills, drawn, level)
            for t in np.flatnonzero(sums[:, :, 0].any(axis=1)).tolist():
                yield pd.DataFrame({"tree": [t], "sums": [sums[t].ravel()]})

        def added(frames):
            held: dict[int, np.ndarray] = {}
            for pdf in frames:
                for t, v in zip(pdf["tree"], pdf["sums"], strict=True):
                    held[t] = held[t] + v if t in held else np.array(v)
            for t, v in held.items():
                yield pd.DataFrame({"tree": [t], "sums": [v]})

        schema = "tree int, sums array<double>"
        found = np.zeros((n, width, 2 if drawn is None else 2 + 2 * d))
        for r in data.select("fold", *x, y).mapInPandas(partial, schema).repartition("tree").mapInPandas(added, schema).toLocalIterator():  # at most n rows
            found[r["tree"]] = np.array(r["sums"]).reshape(width, -1)
        rows, total, rows_low, total_low = found[..., 0:1], found[..., 1:2], found[..., 2 : 2 + d], found[..., 2 + d :]
        at = slice(width - 1, 2 * width - 1)
        parents = forest.value[:, (np.arange(width - 1, 2 * width - 1) - 1) // 2] if level else np.zeros((n, width))
        forest.value[:, at] = np.where(rows[..., 0] > 0, total[..., 0] / np.maximum(rows[..., 0], 1), parents)
        if level == depth:
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = total_low**2 / rows_low + (total - total_low) ** 2 / (rows - rows_low) - total**2 / rows
        fits = (rows_low >= least) & (rows - rows_low >= least)
        if share < 1:  # at random, at least one
            order = rng.random((n, width, d)).argsort(axis=-1).argsort(axis=-1)
            fits &= order < max(1, round(share * d))
        gain = np.where(fits & np.isfinite(gain), gain, -1.0)
        best = gain.argmax(axis=-1)
        split = np.take_along_axis(gain, best[..., None], -1)[..., 0] > 1e-12
        cut = np.take_along_axis(drawn, best[..., None], -1)[..., 0]
        forest.feature[:, at] = np.where(split, best, -1)
        forest.threshold[:, at] = np.where(split, cut, 0.0)
        both = np.repeat(boxes, 2, axis=1)
        t, w = np.nonzero(split)
        both[t, 2 * w, best[t, w], 1] = cut[t, w]
        both[t, 2 * w + 1, best[t, w], 0] = cut[t, w]
        boxes = both
        if not split.any():
            break
    return forest


def tree_cv(df: DataFrame, x: list[str], y: str, group: str = "cell", n: int = 5, **options) -> DataFrame:
    """df rows (those with y) with fold and pred: the mean over the trees of the row's fold, which the other folds' cells have
    taught. Null and NaN are gaps and filled with the median over the training rows; with fewer than two folds there is no
    prediction."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism  # a row goes down all trees, so few bytes are much work
    d = staged(folded(df.where(F.col(y).isNotNull()), n, group).repartition(tasks), "folds")
    medians = fold_medians(d.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in x}), x)
    fills = {r["fold"]: list(r["fill"]) for r in medians.collect()}  # a row for each fold
    data = d.withColumns({c: F.col(c).cast("double") for c in (*x, y)})
    forest = extra_trees(data, x, y, fills, **options) if fills else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in gathered(frames):
            raw, fold, pred = pdf[x].to_numpy(float), pdf["fold"].to_numpy(), np.full(len(pdf), np.nan)
            for f, fill in fills.items():
                own = np.flatnonzero(fold == f)
                if len(own):
                    part = np.ascontiguousarray(filled(raw[own], fill).T)
                    trees = np.flatnonzero(forest.fold == f).tolist()
                    pred[own] = np.mean([forest.value[t, forest.nodes(t, part, forest.feature.shape[1].bit_length() - 1)] for t in trees], axis=0)
            yield pdf.assign(pred=pred)

    out = d.mapInPandas(run, StructType([*d.schema.fields, *StructType.fromDDL("pred double").fields]))
    return out.withColumn("pred", F.nanvl("pred", F.lit(None).cast("double")))
