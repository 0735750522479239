"""Points of many cycles leave a task in few frames."""

import numpy as np
import pandas as pd

from cellspan.operators import curves


def test_points_of_many_cycles_are_one_frame():
    class Held:
        def mapInPandas(self, run, schema):
            self.run = run
            return self

    rng = np.random.default_rng(2)
    cycles = [(f"c{i % 3}", i, np.cumsum(rng.random(20)), np.linspace(4.1, 3.0, 20)) for i in range(40)] + [("short", 99, np.array([0.0, 1.0]), np.array([4.0, 3.9]))]
    pdf = pd.DataFrame(cycles, columns=["Cell_ID", "Cycle_Index", "q", "v"])
    for f, names in ((curves.incremental, ["V", "dQdV"]), (curves.differential, ["Q", "dVdQ"])):
        frames = list(curves._long(Held(), f, " ".join(names)).run(iter([pdf])))
        assert len(frames) == 1
        got = frames[0].set_index(["Cell_ID", "Cycle_Index"])
        for cell, k, q, v in cycles[:-1]:
            assert np.array_equal(got.loc[[(cell, k)], names].to_numpy().T, np.array(f(q, v)))
        assert ("short", 99) not in got.index
    assert len(list(curves._long(Held(), curves.incremental, "V dQdV").run(iter([pdf.iloc[40:]])))[0]) == 0
