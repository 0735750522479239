"""Streams of forecasts and measurements: batch results whatever the order, restarts, gaps."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspan.operators import forecasts
from cellspan.streaming import live

START = datetime.datetime(2024, 1, 1)
FORECASTS = "cell string, model string, h int, k0 long, pred double, lo double, hi double, ts timestamp"
SERIES = "cell string, k long, value double, ts timestamp"


def track(h, rows=200):
    return live.Track(h, None, 0.1, 8, rows, 0.85)


def fed(t, seen, made, watermark=-1, wait=10**9):
    t.tables["ahead"] |= {k: (v, k) for k, v in seen.items()}
    t.tables["made"] |= {k: (p, p - 1, p + 1, k) for k, p in made.items()}
    t.advance(watermark, 1, wait)
    return t


def test_order_of_arrival_does_not_matter():
    rnd = random.Random(1)
    values = {k: math.sin(k) for k in range(1, 60)}
    made = {k: values[k] + 0.1 * math.cos(3 * k) for k in values}
    whole = fed(track(5), values, made)
    events = [("ahead", k) for k in values] + [("made", k) for k in made]
    rnd.shuffle(events)
    t, seen = track(5), []
    for i in range(0, len(events), 7):
        part = events[i : i + 7]
        t = live.Track(5, t.saved(), 0.1, 8, 200, 0.85)
        fed(t, {k: values[k] for w, k in part if w == "ahead"}, {k: made[k] for w, k in part if w == "made"})
        seen += t.out
    assert str(seen) == str(whole.out) and t.taken == 59


def test_bands_and_scores_equal_plain_loops():
    rng = np.random.default_rng(2)
    values, preds = rng.normal(size=300), rng.normal(size=300)
    out = fed(track(3, rows=50), dict(enumerate(values, 1)), dict(enumerate(preds, 1))).out
    bands = {r[1]: r for r in out if r[0] == "band"}
    done = [r for r in out if r[0] == "resolved"]
    assert len(bands) == 300 and len(done) == 297
    err = None
    for r in done:
        e2 = (values[r[2] - 1] - preds[r[1] - 1]) ** 2
        err = e2 if err is None else err * 0.85 + e2 * 0.15
        assert r[4] == values[r[2] - 1] and r[6] == pytest.approx(err)
    for k in (1, 11, 12, 60, 300):
        known = np.abs(values[3 : k] - preds[: max(0, k - 3)])[-50:]
        assert bands[k][7] == len(known)
        if len(known) < 8:
            assert bands[k][8] is None and not bands[k][11]
        else:
            level = min(math.ceil((len(known) + 1) * 0.9) / len(known), 1)
            assert bands[k][8] == pytest.approx(np.quantile(known, level)) and bands[k][11]


def test_gaps_wait_for_the_watermark():
    t = fed(track(1), {1: 1.0, 3: 3.0}, {1: 0.5, 3: 2.5})
    assert t.taken == 1 and t.due(100) == 3
    fed(t, {}, {}, watermark=2)
    assert t.taken == 1
    fed(t, {}, {}, watermark=3)
    assert t.taken == 3
    lost = [r for r in t.out if r[0] == "resolved"]
    assert [(r[1], r[2]) for r in lost] == [(1, 2)] and math.isnan(lost[0][4]) and t.n == 0
    fed(t, {}, {}, watermark=103, wait=100)
    assert not t.tables["open"] and t.due(100) is None


def test_restart_from_the_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(3)
    at = lambda k: START + datetime.timedelta(hours=int(k))
    series = [(c, k, None if (c, k) == ("b", 20) else float(rng.normal()), at(k)) for c in "ab" for k in range(1, 41)]
    log = [(c, "m", h, k, (v or 0.0) + float(rng.normal()) / 9, -1.0, 1.0, t) for c, k, v, t in series for h in (1, 5)]
    beat = at(10**4)
    made, seen = str(tmp_path / "made"), str(tmp_path / "seen")
    rows = lambda data, schema: spark.createDataFrame(data, schema).coalesce(1)

    def run():
        stream = live.live(spark.readStream.schema(FORECASTS).parquet(made), spark.readStream.schema(SERIES).parquet(seen), [("m", 1), ("m", 5)], delay="100 days", wait="10 days")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(live.EVENTS).parquet(str(tmp_path / "out"))

    # first part: measurements run ahead, cell b has no forecasts yet; then the rest, repeated rows and rows without keys
    rows([r for r in series if r[1] <= 25], SERIES).write.parquet(seen)
    rows([r for r in log if r[3] <= 18 and r[0] == "a"], FORECASTS).write.parquet(made)
    first = run()
    assert {r["cell"] for r in first.select("cell").distinct().collect()} == {"a"} and first.where("what = 'band'").count() == 36
    rows([r for r in series if r[1] > 20] + [(None, None, None, at(30)), ("a", None, 1.0, at(3))], SERIES).write.mode("append").parquet(seen)
    rows([r for r in log if r[3] > 18 or r[0] == "b"] + [(None, None, None, None, None, None, None, at(4))], FORECASTS).write.mode("append").parquet(made)
    run()
    rows([(None, None, None, beat)], SERIES).write.mode("append").parquet(seen)
    rows([(None, None, None, None, None, None, None, beat)], FORECASTS).write.mode("append").parquet(made)
    out = run()
    whole = forecasts.resolve(spark.createDataFrame(log, FORECASTS).withColumn("k_target", F.col("k0") + F.col("h")), spark.createDataFrame(series, SERIES), "value")
    plain = lambda df, *c: sorted(str([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in df.select("cell", "model", "h", "k0", *c).collect())
    assert plain(out.where("what = 'resolved'"), "k_target", "pred", "actual") == plain(whole, "k_target", "pred", "actual")
    assert plain(out.where("what = 'band'"), "n_seen", "radius") == plain(forecasts.conformal(whole), "n_seen", "radius")
    ends = out.where("what = 'resolved' AND h = 1 AND actual IS NOT NULL").select("cell", "model", "h", "k0", F.round("err", 9).alias("err"), "n")
    errors = forecasts.ewma_error(whole).select("cell", "model", "h", "k0", F.round("err", 9).alias("err"), "n")
    assert plain(ends, "err", "n") == plain(errors, "err", "n")


def test_empty_streams(spark):
    assert live.replay(spark.createDataFrame([], FORECASTS), spark.createDataFrame([], SERIES), [("m", 1)]).count() == 0
