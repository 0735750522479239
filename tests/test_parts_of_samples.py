"""Curves and slopes are dealt out into as many parts as the rows need, so a task's memory does not follow the table."""

import pytest
from pyspark.sql import functions as F

from cellspan.operators import curves
from cellspan.sources import samples
from tests.test_larger_tables import DIR


@pytest.mark.parametrize("make", [samples.lineitem_samples, samples.event_cycles, lambda s, d: curves.curve_rows(samples.lineitem_samples(s, d), 4)])
def test_rows_of_a_task_are_bounded(spark, monkeypatch, make):
    monkeypatch.setattr(samples, "PART_ROWS", 100)
    rows = make(spark, DIR).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(rows) > 4  # the session's shuffle partitions
