"""As-of join: backward match, then each still missing column from the forward match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_fill(left: DataFrame, right: DataFrame, columns: list[str], by: str = "Cell_ID", on: str = "Cycle_Index", tie: list[str] | None = None) -> DataFrame:
    """left with `columns` of right: all of the last right row at or before `on`, nulls then from the first at or after it.

    One union and one window pass over (by, on): no range join. Right rows that share a key are reduced before: the last by
    `tie` counts backward, the first forward (without `tie` by their values).
    """
    order = [F.col(c) for c in (tie or columns)]
    packed = F.struct(*columns)
    ends = right.groupBy(by, on).agg(F.max_by(packed, F.struct(*order)).alias("b"), F.min_by(packed, F.struct(*order)).alias("f"))
    kinds = dict(left.dtypes)
    l = left.select(by, on, F.struct(*left.columns).alias("row"))
    r = ends.select(by, F.col(on).cast(kinds[on]).alias(on), "b", "f")
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(on)
    back = F.last("b", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    forth = F.first("f", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    out = both.select("row", back.alias("b"), forth.alias("f")).where("row is not null")
    return out.select("row.*", *(F.coalesce(F.col(f"b.{c}"), F.col(f"f.{c}")).alias(c) for c in columns))
