"""What a key of the stream costs follows its cycles, and its rows keep their types."""

import math
import time

from cellspan.streaming import live


def test_many_waiting_cycles_take_linear_time():
    t = live.Track(50, None, 0.1, 8, 200, 0.85)
    n = 30_000
    t.tables["ahead"] = {k: (math.sin(k), k) for k in range(n, 0, -1)}
    t.tables["made"] = {k: (math.cos(k), 0.0, 1.0, k) for k in range(n, 0, -1)}
    began = time.process_time()
    t.advance(-1, 1, 10**9)
    assert time.process_time() - began < 8  # the square of n took minutes
    assert t.taken == n and len(t.out) == 2 * n - 50


def test_frame_of_a_key():
    rows = [("resolved", 1, 2, 0.5, math.nan, 0, math.nan, None, None, None, None, None), ("band", 2, 3, 0.5, math.nan, 9, 0.1, 9, None, 0.0, 1.0, False)]
    got = live.frame("c", [("m", 1, rows)])
    assert list(got.columns) == live.NAMES and got.n_seen.isna().tolist() == [True, False] and got.calibrated.isna().tolist() == [True, False]
    assert got.k_target.tolist() == [2, 3] and got.n_seen[1] == 9 and not got.calibrated[1] and got.radius.isna().all() and got.hi[1] == 1.0
