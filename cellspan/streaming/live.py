"""Forecasts and measurements as two streams: resolved, scored and calibrated as they arrive.

State is kept by slots of cells, since a call of the engine by key costs more than the rows of a short series; in a slot each
cell's state is packed by itself, and within it each model and horizon has a track of its own. A track goes from cycle to
cycle: at a cycle its measurement resolves the forecast that aims at it and the residual enters a ring of the last ones; then
the forecast made at that cycle gets its band from the ring. A cycle is taken when its forecast and its measurement are
there, in whatever order they came; when the watermark has passed what waits, the missing part never comes and is skipped.
State is therefore bounded by the ring, the horizon and what the watermark's delay lets wait. Nothing is emitted twice:
the state is part of the query's checkpoint.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cellspan.config import BAND_ALPHA
from cellspan.sources.staging import removed, shared_folder

_TABLES = {"ahead": ("k", "value", "at"), "made": ("k", "pred", "lo", "hi", "at"), "open": ("k", "pred", "at")}
STATE = "cells binary"  # pickled: when a cell of the slot is due, and pickled what each (model, horizon) of it has saved
SLOTS = 512
FRAME_ROWS = 20_000  # rows that are made a frame of, about
EVENTS = (
    "cell string, model string, h int, what string, k0 bigint, k_target bigint, pred double, actual double, n bigint, err double, n_seen int, radius double, lo double, hi double, calibrated boolean"
)
NAMES = [c.split()[0] for c in EVENTS.split(", ")]


class Track:
    """One cell, model and horizon: `ahead` are measurements and `made` forecasts of cycles not taken yet, `open` forecasts by
    the cycle they aim at."""

    def __init__(self, h: int, saved: tuple | None, alpha: float, least: int, rows: int, decay: float):
        self.h, self.alpha, self.least, self.rows, self.decay = h, alpha, least, rows, decay
        self.taken, self.n, self.err, self.ring = (None, 0, math.nan, []) if saved is None else (*saved[:3], list(saved[3]))
        self.tables: dict[str, dict[int, tuple]] = {}
        i = 4
        for t, columns in _TABLES.items():
            part = [[] if saved is None else list(x) for x in (saved[i : i + len(columns)] if saved else [()] * len(columns))]
            self.tables[t] = {k: tuple(rest) for k, *rest in zip(*part, strict=True)}
            i += len(columns)
        self.out: list[tuple] = []

    def saved(self) -> tuple:
        flat = []
        for t, columns in _TABLES.items():
            rows = [(k, *rest) for k, rest in sorted(self.tables[t].items())]
            flat += [[r[i] for r in rows] for i in range(len(columns))]
        return (self.taken, self.n, self.err, self.ring, *flat)

    def radius(self) -> float | None:
        """The same quantile of the last residuals as in the batch operator."""
        n = len(self.ring)
        if n < self.least:
            return None
        s = sorted(self.ring)
        at = min(math.ceil((n + 1) * (1 - self.alpha)) / n, 1.0) * (n - 1)
        low = math.floor(at)
        return s[low] + (at - low) * (s[min(low + 1, n - 1)] - s[low])

    def resolve(self, target: int, value: float) -> None:
        pred, _ = self.tables["open"].pop(target)
        if not math.isnan(value) and not math.isnan(pred):
            self.ring = [*self.ring, abs(value - pred)][-self.rows :]
            e2 = (value - pred) ** 2
            self.err = e2 if self.n == 0 else self.err * self.decay + e2 * (1 - self.decay)
            self.n += 1
        self.out.append(("resolved", target - self.h, target, pred, value, self.n, self.err, None, None, None, None, None))

    def take(self, k: int) -> None:
        """Cycle k with what is there of it; what aims at skipped cycles stays without an actual value."""
        while (target := next(iter(self.tables["open"]), k)) < k:  # they are in order of the cycles they aim at
            self.resolve(target, math.nan)
        value, _ = self.tables["ahead"].pop(k, (math.nan, 0))
        if k in self.tables["open"]:
            self.resolve(k, value)
        if made := self.tables["made"].pop(k, None):
            pred, lo, hi, at = made
            r = self.radius()
            low, high = (lo, hi) if r is None else (pred - r, pred + r)
            self.out.append(("band", k, k + self.h, pred, math.nan, self.n, self.err, len(self.ring), r, low, high, r is not None))
            self.tables["open"][k + self.h] = (pred, at)
        self.taken = k

    def advance(self, watermark: int, first: int, wait: int) -> None:
        ahead, made = self.tables["ahead"], self.tables["made"]
        for k in sorted(ahead.keys() | made.keys()):
            follows = k == (first if self.taken is None else self.taken + 1)
            if not (follows and k in ahead and k in made) and max(t[k][-1] for t in (ahead, made) if k in t) > watermark:
                break
            self.take(k)
        for target in sorted(t for t, (_, at) in self.tables["open"].items() if at + wait <= watermark):
            self.resolve(target, math.nan)

    def due(self, wait: int) -> int | None:
        """When the watermark decides something."""
        times = [r[-1] for t in ("ahead", "made") for r in self.tables[t].values()] + [at + wait for _, at in self.tables["open"].values()]
        return min(times, default=None)


def frame(cell: str | list[str], parts: list[tuple[str, int, list[tuple]]]) -> pd.DataFrame:
    """EVENTS of rows by model and horizon of a cell, or of the cells that stand for each part, column by column: each has its
    type at once."""
    rows = [r for _, _, own in parts for r in own]
    sizes = [len(own) for _, _, own in parts]
    cells = [cell] * len(parts) if isinstance(cell, str) else cell
    what, k0, target, pred, actual, n, err, seen, radius, lo, hi, calibrated = zip(*rows, strict=True)
    missing = np.array([v is None for v in seen])
    whole = lambda c, kind: np.where(missing, 0, np.array(c, object)).astype(kind)
    numbers = {"pred": pred, "actual": actual, "err": err, "radius": radius, "lo": lo, "hi": hi}
    columns = {
        "cell": np.repeat(np.array(cells, object), sizes), "model": np.repeat(np.array([m for m, _, _ in parts], object), sizes), "h": np.repeat(np.array([h for _, h, _ in parts], np.int32), sizes), "what": np.array(what, object), "k0": np.array(k0, np.int64), "k_target": np.array(target, np.int64),
        "n": np.array(n, np.int64), "n_seen": pd.arrays.IntegerArray(whole(seen, np.int32), missing), "calibrated": pd.arrays.BooleanArray(whole(calibrated, bool), missing),
    } | {c: np.array(v, float) for c, v in numbers.items()}
    return pd.DataFrame({c: columns[c] for c in NAMES}, copy=False)


def live(
    forecasts: DataFrame, measurements: DataFrame, models: list[tuple[str, int]], delay: str = "1 day", wait: str = "60 days", first: int = 1,
    alpha: float = BAND_ALPHA, least: int = 8, rows: int = 200, decay: float = 0.85, what: tuple[str, ...] = ("band", "resolved"), slots: int = SLOTS,
) -> DataFrame:
    """EVENTS from two streams: forecasts (cell, model, h, k0, pred, lo, hi, ts) and measurements (cell, k, value, ts). h is a
    horizon, or an array of the horizons that a forecast holds for.

    `band`: a forecast as it is made, with n_seen residuals, the conformal radius and its limits (the model's own below `least`
    residuals). `resolved`: a forecast and what came, with n and the exponentially weighted squared error so far (for horizon 1
    what `ensemble_weights` takes); without an actual value where its cycle was measured as null, was skipped, or `wait`
    passed. `what` names the kinds of events that are wanted, `models` the (model, horizon) pairs that measurements are for. Rows
    without a cell, model or cycle are no forecasts (they may carry the time on); repeated rows are one; rows of cycles already
    taken are late and dropped. A slot's state is written anew whenever a cell of it has news: more `slots` make that less, and
    calls of the engine more.
    """
    slot, ms = F.pmod(F.xxhash64("cell"), F.lit(slots)).cast("int").alias("slot"), F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at")
    horizons = F.col("h") if isinstance(forecasts.schema["h"].dataType, ArrayType) else F.array("h")
    made = forecasts.withWatermark("ts", delay).select(slot, "cell", "model", horizons.cast("array<int>").alias("h"), F.lit("made").alias("kind"), F.col("k0").cast("long").alias("k"), F.col("pred").alias("value"), "lo", "hi", ms, "ts")
    none = lambda t: F.lit(None).cast(t)
    seen = measurements.withWatermark("ts", delay).select(slot, "cell", none("string").alias("model"), none("array<int>").alias("h"), F.lit("ahead").alias("kind"), F.col("k").cast("long").alias("k"), "value", none("double").alias("lo"), none("double").alias("hi"), ms, "ts")
    interval = forecasts.sparkSession.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {wait}) - unix_millis(TIMESTAMP '1970-01-01 00:00:00') AS bigint)").first()[0]
    pairs = [(m, int(h)) for m, h in models]
    number = lambda v: math.nan if v is None else v

    def read(pdf: pd.DataFrame, arrived: dict) -> None:
        for cell, model, h, kind, k, value, lo, hi, at in zip(*(pdf[c].tolist() for c in ("cell", "model", "h", "kind", "k", "value", "lo", "hi", "at")), strict=True):
            if cell is None or k is None or k != k:
                continue
            if kind == "ahead":
                arrived.setdefault(cell, []).append((pairs, kind, int(k), (number(value), int(at))))
            elif model is not None and h is not None:
                arrived.setdefault(cell, []).append(([(model, int(x)) for x in h if x is not None and x == x], kind, int(k), (number(value), number(lo), number(hi), int(at))))

    def step(key, frames: Iterator[pd.DataFrame], state):
        saved = pickle.loads(state.get[0]) if state.exists else {}
        arrived: dict[str, list[tuple]] = {}
        for pdf in () if state.hasTimedOut else frames:
            read(pdf, arrived)
        watermark = state.getCurrentWatermarkMs()
        for cell, (due, _) in saved.items():
            if due is not None and due <= watermark:
                arrived.setdefault(cell, [])
        out, cells, parts, held = [], [], [], 0
        for cell, own in arrived.items():
            kept = pickle.loads(saved[cell][1]) if cell in saved else {}
            tracks = {pair: Track(pair[1], of, alpha, least, rows, decay) for pair, of in kept.items()}
            for some, kind, k, row in own:
                for pair in some:
                    if (track := tracks.get(pair)) is None:
                        track = tracks[pair] = Track(pair[1], None, alpha, least, rows, decay)
                    if track.taken is None or k > track.taken:
                        track.tables[kind].setdefault(k, row)
            for track in tracks.values():
                track.advance(watermark, first, interval)
            times = [due for track in tracks.values() if (due := track.due(interval)) is not None]
            saved[cell] = (min(times, default=None), pickle.dumps({pair: track.saved() for pair, track in tracks.items()}))
            for pair, track in tracks.items():
                if wanted := track.out if len(what) > 1 else [r for r in track.out if r[0] in what]:
                    cells.append(cell)
                    parts.append((*pair, wanted))
                    held += len(wanted)
            if held >= FRAME_ROWS:
                out.append(frame(cells, parts))
                cells, parts, held = [], [], 0
        if parts:
            out.append(frame(cells, parts))
        if saved:
            state.update((pickle.dumps(saved),))
            if times := [due for due, _ in saved.values() if due is not None]:
                state.setTimeoutTimestamp(max(min(times), watermark) + 1)
        yield from out

    out = made.unionByName(seen).groupBy("slot").applyInPandasWithState(step, EVENTS, STATE, "append", "EventTimeTimeout")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("pred", "actual", "err", "radius", "lo", "hi")})


Rows = Callable[[DataFrame], DataFrame]


def replay(forecasts: DataFrame | Rows, measurements: DataFrame | Rows, models: list[tuple[str, int]], source: DataFrame | None = None, parts: int = 1, columns: tuple[str, ...] = ("*",), **options) -> DataFrame:
    """EVENTS (or these columns of them) of two tables that are written as files, read as streams to their ends, and gathered in
    a table. With a `source` that both follow from row by row, `forecasts` and `measurements` make them of it, and it alone is
    written.

    Cells are dealt out into `parts` that are replayed one after another, each as streams of its own; the files, checkpoint and
    state of a part go when it has ended, so of a larger table only the events take more disk. A watermark behind the whole
    table's time lets no row come late. A last file of each part holds a row without a cell whose time lies beyond every delay,
    so that what is still open ends.
    """
    tables = {"made": forecasts, "seen": measurements} if source is None else {"rows": source}
    spark = next(iter(tables.values())).sparkSession
    at = shared_folder(spark, "live")
    part = F.pmod(F.hash("cell"), F.lit(parts)).alias("part")
    for name, df in tables.items():
        df.select("*", part).write.partitionBy("part").parquet(f"{at}/{name}")
    times = reduce(DataFrame.unionAll, [spark.read.schema(df.schema).parquet(f"{at}/{name}").select("ts") for name, df in tables.items()])
    ends = times.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if ends["a"] is None:
        return spark.createDataFrame([], EVENTS).select(*columns)
    span = (ends["b"] - ends["a"]).days + 1
    last = ends["b"] + timedelta(days=3 * span + 1)
    for name, df in tables.items():
        beat = spark.range(parts).select(*((F.lit(last) if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes), F.col("id").cast("int").alias("part"))
        beat.coalesce(1).write.mode("append").partitionBy("part").parquet(f"{at}/{name}")
    done = []
    for i in range(parts):
        stream = lambda name: spark.readStream.schema(tables[name].schema).parquet(f"{at}/{name}/part={i}")  # noqa: B023, E731
        both = (stream("made"), stream("seen")) if source is None else (forecasts(stream("rows")), measurements(stream("rows")))
        out = live(*both, models, delay=f"{span} days", wait=f"{span} days", **options).select(*columns)
        query = out.writeStream.format("parquet").option("path", f"{at}/out/{i}").option("checkpointLocation", f"{at}/checkpoint/{i}").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        removed(spark, f"{at}/checkpoint/{i}", *(f"{at}/{name}/part={i}" for name in tables))
        done.append(spark.read.schema(out.schema).parquet(f"{at}/out/{i}"))
    removed(spark, f"{at}/checkpoint", *(f"{at}/{name}" for name in tables))
    return reduce(DataFrame.unionAll, done)
