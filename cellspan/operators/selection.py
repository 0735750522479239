"""Greedy choice of indicators and measurements by errors on cells left out, from sums by pattern of gaps.

A set of columns is judged on the rows that know all of them, so every set has rows of its own. The rows are read once: they
become sums of values and products by cell and pattern of known columns (`gap_table`). The sums of any set over its own rows
are those of the patterns that contain it, so a round of the greedy choice weighs all candidates in one pass over the cells'
sums, no row is predicted, and the driver sees a row for each pattern, candidate and fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.operators.learning import _solve, _square, _squared_error, dealt_folds
from cellspan.sources.staging import staged

GAIN = 0.03  # an addition must lower the error by more than this share (fixed value)


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def _added(n: int, column: str) -> Column:
    return F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(n))).alias(column)


def gap_table(df: DataFrame, columns: list[str], y: str, cell: str = "cell") -> DataFrame:
    """cell, parts: for each pattern of known columns (bit i: column i) among a cell's rows with a known y the number of rows,
    the sums of (columns, y) with 0 in gaps and the upper triangle of their products. Rows without a cell are left out; there are
    at most as many parts as patterns, however long the cell."""
    pattern = sum((F.when(_known(c), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0)).alias("pattern")
    values = [F.when(_known(c), F.col(c).cast("double")).otherwise(0.0).alias(f"__v{i}") for i, c in enumerate((*columns, y))]
    v = [F.col(f"__v{i}") for i in range(len(values))]
    products = F.array(*(F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))))
    rows = df.where(F.col(cell).isNotNull() & _known(y)).select(F.col(cell).alias("cell"), pattern, *values)
    own = rows.groupBy("cell", "pattern").agg(F.count("*").alias("n"), F.array(*map(F.sum, v)).alias("s"), products.alias("p"))
    return own.groupBy("cell").agg(F.collect_list(F.struct("pattern", "n", "s", "p")).alias("parts"))


def _parts(pdf: pd.DataFrame, size: int) -> tuple[np.ndarray, ...]:
    """The parts of all cells of a batch: whose they are, pattern, n, sums and square products."""
    flat = [(i, p["pattern"], p["n"], p["s"], p["p"]) for i, parts in enumerate(pdf["parts"]) for p in parts]
    owner, pattern, n, s, p = zip(*flat, strict=True)
    square = np.zeros((len(flat), size, size))
    a, b = np.triu_indices(size)
    square[:, a, b] = square[:, b, a] = np.array([list(v) for v in p])
    return np.array(owner), np.array(pattern), np.array(n, float), np.array([list(v) for v in s]), square


def _of_set(parts: tuple[np.ndarray, ...], columns: tuple[int, ...], m: int) -> tuple[np.ndarray, ...]:
    """n, sums and products of (columns, y) over the m cells' rows that know all of the columns."""
    owner, pattern, n, s, p = parts
    mask = sum(1 << i for i in columns)
    on = (pattern & mask) == mask
    at = np.array([*columns, s.shape[1] - 1])
    out = np.zeros(m), np.zeros((m, len(at))), np.zeros((m, len(at), len(at)))
    for total, part in zip(out, (n[on], s[on][:, at], p[on][:, at[:, None], at]), strict=True):
        np.add.at(total, owner[on], part)
    return out


def _totals(table: DataFrame, size: int) -> tuple[np.ndarray, ...]:
    """The sums of all cells: a row for each pattern, in the layout of `_parts` with one owner."""
    each = table.select(F.explode("parts").alias("part")).select("part.*").groupBy("pattern")
    rows = each.agg(F.sum("n").alias("n"), _added(size, "s"), _added(size * (size + 1) // 2, "p")).collect()
    return _parts(pd.DataFrame({"parts": [rows]}), size) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros((0, size)), np.zeros((0, size, size)))


def cell_errors(own: tuple[np.ndarray, ...], whole: tuple[np.ndarray, ...], alpha: float) -> np.ndarray:
    """Root mean squared error on each cell's rows of a ridge that the rest of the whole has taught: standardised by the rest,
    the intercept penalised as well; a column that does not vary in the rest has no weight."""
    n, s, p = own
    rest, rs, rp = whole[0] - n, whole[1] - s, whole[2] - p
    mean = rs / rest[:, None]
    cov = rp / rest[:, None, None] - mean[:, :, None] * mean[:, None, :]
    var = np.einsum("bii->bi", cov)[:, :-1]
    varies = var > 1e-13 * np.einsum("bii->bi", rp)[:, :-1] / rest[:, None]
    sd = np.where(varies, np.sqrt(np.where(varies, var, 1.0)), np.inf)
    d = sd.shape[1]
    left = rest[:, None, None] * cov[:, :d, :d] / (sd[:, :, None] * sd[:, None, :]) + alpha * np.eye(d)
    beta = np.linalg.solve(left, (rest[:, None] * cov[:, :d, d] / sd)[..., None])[..., 0] / sd
    const = mean[:, d] * rest / (rest + alpha) - np.einsum("bi,bi->b", beta, mean[:, :d])
    v = np.concatenate([-beta, np.ones((len(n), 1))], axis=1)
    sse = np.einsum("bi,bij,bj->b", v, p, v) - 2 * const * np.einsum("bi,bi->b", v, s) + n * const**2
    return np.sqrt(np.maximum(sse, 0.0) / n)


def left_out_errors(table: DataFrame, totals: tuple[np.ndarray, ...], sets: list[tuple[int, ...]], alpha: float = 1e-3) -> list[float | None]:
    """For each set of columns the mean over cells of the error when the cell is left out; None with fewer than three cells."""
    size = totals[3].shape[1]

    def run(frames):
        for pdf in frames:
            if len(pdf):
                parts, rows = _parts(pdf, size), []
                for i, columns in enumerate(sets):
                    own = _of_set(parts, columns, len(pdf))
                    whole = tuple(v[0] for v in _of_set(totals, columns, 1))
                    judged = (own[0] > 0) & (own[0] < whole[0])
                    errors = cell_errors(tuple(v[judged] for v in own), whole, alpha)
                    rows.append((i, float(errors.sum()), int(judged.sum())))
                yield pd.DataFrame(rows, columns=["set", "e", "n"])

    got = table.select("parts").mapInPandas(run, "set int, e double, n long").groupBy("set").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    means = {r["set"]: r["e"] / r["n"] for r in got.collect() if r["n"] >= 3}
    return [means.get(i) for i in range(len(sets))]


def held_out_errors(table: DataFrame, size: int, sets: list[tuple[int, ...]], folds: int = 5) -> list[tuple[float | None, int]]:
    """For each set of columns the error of a Bayesian ridge over all rows that know them, each predicted while its fold of
    whole cells is held out, and the number of such cells; None with fewer than three. Folds are dealt for each set anew, by the
    cells' numbers of such rows. size: number of columns and y."""
    masks = [sum(1 << i for i in columns) for columns in sets]
    count = lambda mask: F.aggregate(F.filter("parts", lambda q: q["pattern"].bitwiseAND(F.lit(mask)) == mask), F.lit(0).cast("long"), lambda a, q: a + q["n"])
    sizes = table.select("cell", F.inline(F.array(*(F.struct(F.lit(i).alias("set"), count(mask).alias("size")) for i, mask in enumerate(masks))))).where("size > 0")
    dealt = dealt_folds(sizes, folds, by=("set",)).groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("set", "fold"))).alias("folds"))  # an entry a set

    def run(frames):
        for pdf in frames:
            if len(pdf):
                parts, rows = _parts(pdf, size), []
                for i, columns in enumerate(sets):
                    own, fold = _of_set(parts, columns, len(pdf)), np.array([dict(f).get(i, -1) for f in pdf["folds"]])
                    for f in np.unique(fold[fold >= 0]):
                        n, s, p = (v[fold == f].sum(0) for v in own)
                        rows.append((i, int(f), int((fold == f).sum()), float(n), s.tolist(), p[np.triu_indices(len(s))].tolist()))
                yield pd.DataFrame(rows, columns=["set", "fold", "cells", "n", "s", "p"])

    parts = table.join(dealt, "cell").mapInPandas(run, "set int, fold int, cells long, n double, s array<double>, p array<double>")
    longest = max(len(c) for c in sets) + 1  # shorter sets' sums beyond their own are null
    summed = parts.groupBy("set", "fold").agg(F.sum("cells").alias("cells"), F.sum("n").alias("n"), _added(longest, "s"), _added(longest * (longest + 1) // 2, "p")).collect()
    out = []
    for i, columns in enumerate(sets):
        d = len(columns) + 1
        own = [(r["n"], np.array(r["s"][:d], float), np.array(r["p"][: d * (d + 1) // 2], float)) for r in summed if r["set"] == i]
        cells = sum(r["cells"] for r in summed if r["set"] == i)
        if cells < 3:
            out.append((None, cells))
            continue
        total = [sum(v[j] for v in own) for j in range(3)]
        sse = sum(_squared_error(_solve(*(total[j] - v[j] for j in range(3)), None), *v) for v in own)
        out.append((float(np.sqrt(max(sse, 0.0) / total[0])), cells))
    return out


def greedy(candidates: list, errors, gain: float = GAIN) -> list[tuple]:
    """Candidates chosen one by one, with the error of the set, while it falls by more than `gain`; of equal ones the first.
    errors: list of tuples of candidates -> list of numbers, None where a set can't be judged."""
    chosen: list[tuple] = []
    left, best = list(candidates), float("inf")
    while left:
        found = errors([(*(n for n, _ in chosen), c) for c in left])
        scored = [(e, i) for i, e in enumerate(found) if e is not None and np.isfinite(e)]
        if not scored or min(scored)[0] > best * (1 - gain):
            break
        best, i = min(scored)
        chosen.append((left.pop(i), best))
    return chosen


#: Indicators that measure capacity itself (fixed values); they are no candidates unless asked for.
CAPACITY_LIKE = ("cap_norm", "energy_Wh")


def _shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(F.count("*").alias("__n"), *(F.count(F.when(_known(c), 1)).alias(c) for c in columns)).first()
    return {c: row[c] / row["__n"] if row["__n"] else 0.0 for c in columns}


def select_indicators(df: DataFrame, columns: list[str], y: str = "soh", share: float = 0.5, exclude=CAPACITY_LIKE, alpha: float = 1e-3) -> tuple[list[tuple[str, float]], str]:
    """Indicators chosen greedily by their mean error on cells left out one by one, and whether one or several are better.
    Candidates are known in more than `share` of the rows. An empty table leaves it undetermined."""
    shares = _shares(df, [c for c in columns if c not in exclude])
    good = [c for c, v in shares.items() if v > share]
    if not good:
        return [], "undetermined"
    table = staged(gap_table(df, good, y), "selection")
    totals = _totals(table, len(good) + 1)
    path = greedy(list(range(len(good))), lambda sets: left_out_errors(table, totals, sets, alpha))
    return [(good[i], e) for i, e in path], "undetermined" if not path else "several" if len(path) > 1 else "one"


#: Groups of measurements (fixed values).
MEASUREMENTS = {"resistance": ["R0"], "impedance": ["Re_ohm", "Rct_ohm"], "temperature rise": ["T_rise"], "charge times": ["cc_time_s", "cv_time_s"], "discharge voltage": ["V_mean"], "cycle count": ["k"]}


def rank_measurements(df: DataFrame, groups: dict[str, list[str]] | None = None, y: str = "soh", share: float = 0.3, folds: int = 5) -> tuple[list[tuple[str, float | None, int, float | None]], list[tuple[str, float]]]:
    """(measurement, error, cells, gain over the mean), least error first, and those that are worth adding greedily.

    Error: of a Bayesian ridge with whole cells held out, on the rows that have the measurement; None with fewer than three
    cells. Columns known in at most `share` of the rows don't count; an empty table ranks nothing.
    """
    groups = groups or MEASUREMENTS
    shares = _shares(df, sorted({c for v in groups.values() for c in v if c in df.columns}))
    every = [c for c, v in shares.items() if v > share]
    have = {name: cols for name, group in groups.items() if (cols := tuple(every.index(c) for c in group if c in every))}
    if not have:
        return [], []
    table = staged(gap_table(df, every, y), "measurements")
    spread = df.agg(F.stddev_pop(F.when(_known(y), F.col(y)))).first()[0]
    judged: dict[tuple[int, ...], tuple[float | None, int]] = {}

    def errors(sets):
        columns = [tuple(sorted({i for name in names for i in have[name]})) for names in sets]
        todo = sorted(set(columns) - judged.keys())
        judged.update(zip(todo, held_out_errors(table, len(every) + 1, todo, folds), strict=True) if todo else ())
        return [judged[c][0] for c in columns]

    single = []
    for name, e in zip(have, errors([(name,) for name in have]), strict=True):
        single.append((name, e, judged[tuple(sorted(have[name]))][1], 1 - e / spread if e is not None and spread else None))
    return sorted(single, key=lambda v: (v[1] is None, v[1] or 0.0)), greedy(list(have), errors)
