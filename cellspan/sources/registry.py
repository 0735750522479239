"""Dimension of cells: test conditions and groups of the laboratory's cells, and cells added at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "Cell_ID string, grp string, ambients array<double>, load string, cutoff_V double, stop_Ah double"
#: Cells by test: group, first and last number, ambient temperatures, load in A (or pulsed), cut-off voltages in turn, and
#: the capacity that ends the test (fixed values of the published data set).
TESTS = (
    ("Reference", (5, 6, 7), (24.0,), "2.0", (2.7, 2.5, 2.2), 1.4),
    ("Reference", (18,), (24.0,), "2.0", (2.5,), 1.4),
    ("Pulsed load", (25, 26, 27, 28), (24.0,), "pulsed", (2.0, 2.2, 2.5, 2.7), None),
    ("Hot", (29, 30, 31, 32), (43.0,), "4.0", (2.0, 2.2, 2.5, 2.7), None),
    ("High current", (33, 34), (24.0,), "4.0", (2.0, 2.2), 1.6),
    ("Reference", (36,), (24.0,), "2.0", (2.7,), 1.6),
    ("Mixed conditions", (38, 39, 40), (24.0, 44.0), "1.0 2.0 4.0", (2.2, 2.5, 2.7), 1.6),
    ("Cold", (41, 42, 43, 44), (4.0,), "4.0 1.0", (2.0, 2.2, 2.5, 2.7), 1.4),
    ("Cold", (45, 46, 47, 48), (4.0,), "1.0", (2.0, 2.2, 2.5, 2.7), 1.4),
    ("Corrupted logging", (49, 50, 51, 52), (4.0,), "2.0", (2.0, 2.2, 2.5, 2.7), None),
    ("Cold", (53, 54, 55, 56), (4.0,), "2.0", (2.0, 2.2, 2.5, 2.7), 1.4),
)


def cells(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """One row per known cell; rows of `more` (same columns) replace those of their Cell_ID."""
    rows = [(f"B{n:04d}", group, list(ambients), load, cutoff, stop) for group, numbers, ambients, load, cutoffs, stop in TESTS for n, cutoff in zip(numbers, cutoffs, strict=True)]
    known = spark.createDataFrame(rows, SCHEMA)
    if more is None:
        return known
    return known.join(F.broadcast(more.select("Cell_ID")) if more.isLocal() else more.select("Cell_ID"), "Cell_ID", "left_anti").unionByName(more)


def is_pulsed(load: Column | str = "load") -> Column:
    return F.coalesce((F.col(load) if isinstance(load, str) else load) == "pulsed", F.lit(False))


def with_cells(df: DataFrame, registry: DataFrame, by: str = "cell") -> DataFrame:
    """df with grp, ambients, cutoff_V and declared_pulsed of its cells; cells that the registry lacks are in group Unknown."""
    own = registry.select(F.col("Cell_ID").alias(by), "grp", "ambients", "cutoff_V", is_pulsed().alias("declared_pulsed"))
    out = df.drop("grp").join(own, by, "left")
    return out.withColumn("grp", F.coalesce("grp", F.lit("Unknown"))).withColumn("declared_pulsed", F.coalesce("declared_pulsed", F.lit(False)))
