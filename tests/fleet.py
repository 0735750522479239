"""A small invented fleet with known health: straight discharge curves that shorten from cycle to cycle."""

import numpy as np
import pandas as pd

from cellspan.sources.registry import SCHEMA

#: kind: current in A, ambient in degrees, share of health lost in a cycle.
KINDS = {"reference": (2.0, 24.0, 0.002), "cold": (2.0, 4.0, 0.004), "pulsed": (4.0, 24.0, 0.003), "crash": (2.0, 24.0, 0.002)}
CHARGE, POINTS = 1.5, 60


def registry(spark, kinds=tuple(KINDS)):
    return spark.createDataFrame([(f"S{i + 1:03d}", kind, [KINDS[kind][1]], "pulsed" if kind == "pulsed" else str(KINDS[kind][0]), 2.7, None) for i, kind in enumerate(kinds)], SCHEMA)


def fleet(spark, kinds=tuple(KINDS), cycles=60):
    """samples, impedance, truth (Cell_ID, k, soh_true)."""
    rng, samples, impedance, truth = np.random.default_rng(7), [], [], []
    for n, kind in enumerate(kinds):
        cell, (current, ambient, loss) = f"S{n + 1:03d}", KINDS[kind]
        for k in range(1, cycles + 1):
            soh = 1 - loss * k
            capacity = 1.9 * soh + rng.normal(0, 0.002)
            if kind == "crash" and k <= 8:
                capacity *= rng.choice([0.2, 1.6])
            t = np.linspace(0, capacity / current * 3600, POINTS)
            i = np.full(POINTS, -current)
            if kind == "pulsed":
                i[1:-1:2] = 0.0
            for j in range(POINTS):
                samples.append((cell, 2 * k, "discharge", float(t[j]), 4.1 - 1.2 * j / POINTS - 0.08 * current, float(i[j]), ambient + 0.1 * j, float(capacity)))
            for j in range(12):
                samples.append((cell, 2 * k + 1, "charge", 300.0 * j, min(4.2, 3.6 + 0.1 * j), CHARGE, ambient, float("nan")))
            if k % 10 == 1:
                impedance.append((cell, 2 * k, 0.05 + 0.0005 * k, 0.08))
            truth.append((cell, k, soh))
    names = ["Cell_ID", "Cycle_Index", "Cycle_Type", "Time_s", "Voltage_V", "Current_A", "Temp_C", "Capacity_Ah"]
    frame = lambda rows, columns: spark.createDataFrame(pd.DataFrame(rows, columns=columns))
    return frame(samples, names), frame(impedance, ["Cell_ID", "Cycle_Index", "Re_ohm", "Rct_ohm"]), frame(truth, ["Cell_ID", "k", "soh_true"])
