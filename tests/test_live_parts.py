"""A replay in parts: the same events, one row an origin on disk, and nothing left of a part but its events."""

import datetime
import glob
import os

from pyspark.sql import functions as F

from cellspan import queries
from cellspan.operators import forecasts
from cellspan.streaming import live

DIR = "/root/testdata/sf0.001"


def files(at: str) -> set[str]:
    return {os.path.relpath(f, at).split("/")[0] for f in glob.glob(f"{at}/**/*.parquet", recursive=True)}


def test_only_events_stay_on_disk(spark, monkeypatch):
    monkeypatch.setattr(queries, "LIVE_ROWS", 300)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before, written, removed = set(glob.glob(f"{root}/live-*")), [], live.removed

    def watched(session, *folders):
        written.extend(session.read.parquet(f).count() for f in folders if "/rows/part=" in f)
        removed(session, *folders)

    monkeypatch.setattr(live, "removed", watched)
    names = ["cell", "model", "h", "k0", "n_seen", "radius"]
    got = queries.QUERIES["live_radii"](spark, DIR).select(*names)
    (at,) = set(glob.glob(f"{root}/live-*")) - before
    events = spark.read.parquet(f"{DIR}/events.parquet").count()
    assert len(written) == -(-events // 300) > 2 and sum(written) == events + len(written)  # and a row that carries the time on
    assert files(at) == {"out"} and not os.path.exists(f"{at}/checkpoint") and len(os.listdir(f"{at}/out")) == len(written)
    assert sorted(map(str, got.collect())) == sorted(map(str, queries.QUERIES["conformal_radii"](spark, DIR).select(*names).collect()))


def test_a_forecast_of_several_horizons(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(c, k, float(k * k % 17) if (c, k) != ("b", 9) else None, start + datetime.timedelta(hours=k)) for c in ("a", "b", "c", None) for k in range(1, 40) if (c, k) != ("c", 20)]
    table = forecasts.with_mean(spark.createDataFrame(rows, "cell string, k long, cap double, ts timestamp"))
    seen = table.select("cell", "k", F.col("cap").alias("value"), "ts")
    pairs = [(m, h) for m in ("persistence", "trailing mean") for h in (1, 10)]
    wide = forecasts.wide_log(table, horizons=(1, 10))
    plain = lambda df: sorted(map(str, df.select(*live.NAMES).collect()))
    want = plain(live.replay(wide.withColumn("h", F.explode("h")), seen, pairs))
    assert plain(live.replay(wide, seen, pairs, parts=3)) == want and len(want) == 2 * 2 * 2 * (39 + 39 + 38)
    assert plain(live.replay(wide, seen, pairs, what=("band",))) == [r for r in want if "what='band'" in r]
