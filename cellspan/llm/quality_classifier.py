"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each task adds up counts, sums and outer products of its labelled rows by class; Spark adds those up, so 2 * (1 + d + d*d)
numbers reach the driver however many labels there are. Class covariances are shrunk towards the pooled one and towards a
multiple of the identity, factored once (Cholesky), and the cached factors score every document: the difference of the
classes' log densities plus the log odds of the classes, through the logistic function.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, fold, small_batches, stage, table, texts
from cellspan.llm.statistics import SHAPE, share, base_counts, shape

POOLED = 0.2  # share of the pooled covariance
ROUND = 0.02  # share of the identity times the mean variance
FOLDS, HELD_OUT = 4, 2
CUT = 0.7

NAMES = (*SHAPE, "log_words", "distinct", "short_words", "once")


def features(text: bytes) -> list[float]:
    """Statistics of a text; of an empty one all are 0."""
    counts = base_counts(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    return [
        *shape(text, counts),
        math.log1p(n),
        math.log(len(set(words))) - 0.9 * math.log(n),
        share(sum(len(w) <= 3 for w in words), n),
        share(sum(n == 1 for n in Counter(words).values()), n),
    ]


@dataclass
class Discriminant:
    """Means and Cholesky factors of the scaled statistics by class; None where a class has too few rows."""

    centre: np.ndarray
    scale: np.ndarray
    log_odds: float
    means: tuple[np.ndarray, np.ndarray] | None
    inverse_factors: tuple[np.ndarray, np.ndarray] | None
    log_dets: tuple[float, float] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        margin = np.full(len(x), self.log_odds)
        if self.means is not None:
            z = (x - self.centre) / self.scale
            for sign, mean, inverse, log_det in zip((-1, 1), self.means, self.inverse_factors, self.log_dets, strict=True):
                d = (z - mean) @ inverse.T
                margin += sign * -0.5 * ((d * d).sum(axis=1) + log_det)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(n: np.ndarray, sums: np.ndarray, outers: np.ndarray, pooled: float = POOLED, round_: float = ROUND) -> Discriminant:
    """From counts, sums and outer products of classes 0 and 1."""
    d = sums.shape[1]
    odds = math.log((n[1] + 1) / (n[0] + 1))
    if min(n) < 2:
        return Discriminant(np.zeros(d), np.ones(d), odds, None, None, None)
    total = n.sum()
    centre = sums.sum(axis=0) / total
    var = np.diag(outers.sum(axis=0)) / total - centre**2
    scale = np.sqrt(np.maximum(var, 1e-8))
    means = (sums / n[:, None] - centre) / scale
    cov = np.stack([(outers[k] / n[k] - np.outer(sums[k], sums[k]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)])
    within = (n[:, None, None] * cov).sum(axis=0) / total
    factors, log_dets = [], []
    for k in (0, 1):
        s = (1 - pooled) * cov[k] + pooled * within
        s = (1 - round_) * s + round_ * np.eye(d) * max(np.trace(s) / d, 1e-3)
        c = np.linalg.cholesky((s + s.T) / 2)
        factors.append(np.linalg.inv(c))
        log_dets.append(2 * float(np.log(np.diag(c)).sum()))
    return Discriminant(centre, scale, odds, (means[0], means[1]), (factors[0], factors[1]), (log_dets[0], log_dets[1]))


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row; lang, source and other columns are not read."""

    def run(batches):
        for batch in cut(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in texts(batch)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def sufficient(labelled: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and outer products by class of rows (y, x)."""

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), int)
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        k, i = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(i.ravel()), pa.array(total.ravel())], ["k", "i", "v"])

    out = np.zeros((2, 1 + d + d * d))
    for r in labelled.select("y", "x").mapInArrow(run, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        out[r["k"], r["i"]] = r["v"]
    return out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Rows of labels teach unless their doc_id is in the held-out fold, null, or their quality isn't 0 or 1; a doc_id with
    several labels teaches with each. With fewer than two rows of a class every document gets the share of class 1
    (0.5 without labels). Null texts are empty texts, long ones are read whole; repeated rows teach and are scored as often
    as they occur; an empty table gives no rows; other columns are not read, whatever their names. A null doc_id is not held
    out and teaches nothing.
    """
    x = stage(with_features(docs), "features")
    y = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    model = fit(*sufficient(x.join(y, "doc_id"), len(NAMES)))

    def run(batches):
        for batch in batches:
            values = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(values))], ["doc_id", "score"])

    out = x.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
