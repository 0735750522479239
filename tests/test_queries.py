"""Every query with SQL gives the SQL's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cellspan import learning_queries  # noqa: F401 - adds its queries
from cellspan.queries import QUERIES, SQL, flagship
from cellspan.sources.samples import event_cycles

DIR = "/root/testdata/sf0.001"


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("NULL" if pd.isna(x) else f"{x + 0.0:.5g}" if isinstance(x, float) else str(x) for x in r) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["cohort_metrics", "grouped_cv_ridge", "pca_scores", "stress_regression"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    assert flagship(spark, DIR).count() == 15


def test_every_origin_and_horizon(spark):
    events = sorted(map(tuple, event_cycles(spark, DIR).select("cell", "k").collect()))
    assert sorted(map(tuple, QUERIES["rul_crossings"](spark, DIR).select("cell", "k").collect())) == events
    radii = QUERIES["conformal_radii"](spark, DIR).select("h", "cell", "k0").distinct().collect()
    assert sorted(map(tuple, radii)) == sorted((h, *e) for h in (1, 10, 25, 50) for e in events)
