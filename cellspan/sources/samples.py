"""Raw samples: scan, checks, coercion, and the adapters from the driver's tables."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

REQUIRED = ("Cell_ID", "Cycle_Index", "Cycle_Type", "Time_s", "Voltage_V", "Current_A", "Temp_C", "Capacity_Ah")
NUMBERS = ("Time_s", "Voltage_V", "Current_A", "Temp_C", "Capacity_Ah", "Ambient_C")
IMPEDANCE = "Cell_ID string, Cycle_Index bigint, Re_ohm double, Rct_ohm double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task of a keyed stage gets, about.
PART_ROWS = 200_000


def parted(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt out by keys into as many parts as its rows need (a count from the files' footers), so that what a task sorts does
    not grow with the table; windows and aggregations by these keys, and finer ones, follow without another shuffle. `rows`: of a
    part, fewer where each becomes many."""
    parts = -(-df.count() // (rows or PART_ROWS))
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def number(c: Column | str) -> Column:
    """To double; what is no number, and NaN, become null."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("string").try_cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def index(c: Column | str) -> Column:
    """To a whole number, halves to even."""
    return F.rint(number(c)).cast("bigint")


def cell_id(c: Column | str) -> Column:
    """B%04d of a number with or without a leading B; anything else stays, trimmed."""
    c = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    bare = F.regexp_replace(F.upper(F.trim(c)), "^B", "").try_cast("double")
    whole = F.when(~F.isnan(bare) & (F.abs(bare) < 1e15), bare.cast("bigint"))
    return F.when(whole < 0, F.format_string("B-%03d", F.abs(whole))).when(whole >= 0, F.format_string("B%04d", whole)).otherwise(F.trim(c))


def cell_of(df: DataFrame, c: str) -> Column:
    """cell_id of a column; of whole numbers without a detour through patterns, which cost more than the rest of a scan."""
    if not isinstance(df.schema[c].dataType, IntegralType):
        return cell_id(c)
    n = F.col(c).cast("bigint")
    said, padded = n.cast("string"), lambda v, width: F.when(F.length(v) < width, F.lpad(v, width, "0")).otherwise(v)
    named = F.when(n < 0, F.concat(F.lit("B-"), padded(F.substring(said, 2, 20), 3))).otherwise(F.concat(F.lit("B"), padded(said, 4)))
    return F.when(F.abs(n.cast("double")) < 1e15, named).otherwise(said)


def in_range(c: Column, low: float, high: float) -> Column:
    """c where low < c <= high, else null."""
    return F.when((c > low) & (c <= high), c)


def normalise_samples(df: DataFrame) -> DataFrame:
    """Checked and coerced samples. Missing columns raise ValueError; a sample without a cycle index is an error."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"samples lack columns: {', '.join(missing)}")
    out = df.withColumns({c: number(c) for c in NUMBERS if c in df.columns})
    checked = F.coalesce(index("Cycle_Index"), F.raise_error(F.lit("a sample has no cycle index")).cast("bigint"))
    return out.withColumns({"Cell_ID": cell_id("Cell_ID"), "Cycle_Index": checked, "Cycle_Type": F.lower(F.trim(F.col("Cycle_Type").cast("string")))})


def normalise_impedance(df: DataFrame | None, spark: SparkSession) -> DataFrame:
    """Coerced impedance rows; without the key columns an empty table."""
    if df is None or not {"Cell_ID", "Cycle_Index"} <= set(df.columns):
        return spark.createDataFrame([], IMPEDANCE)
    value = lambda c: in_range(number(c), 0, 5) if c in df.columns else F.lit(None).cast("double")
    return df.select(cell_id("Cell_ID").alias("Cell_ID"), index("Cycle_Index").alias("Cycle_Index"), value("Re_ohm").alias("Re_ohm"), value("Rct_ohm").alias("Rct_ohm"))


def read(spark: SparkSession, source) -> DataFrame:
    """A path, a DataFrame, a pandas frame, or the bytes of a Parquet file (read through Arrow)."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, bytes):
        import io

        import pyarrow.parquet as pq

        return spark.createDataFrame(pq.read_table(io.BytesIO(source)))
    if isinstance(source, str):
        return spark.read.parquet(source)
    return spark.createDataFrame(source)


def load(spark: SparkSession, samples=None, impedance=None) -> tuple[DataFrame, DataFrame]:
    """Samples and impedance, normalised; without a source those named by CELLSPAN_SAMPLES and CELLSPAN_IMPEDANCE."""
    samples = samples if samples is not None else os.environ["CELLSPAN_SAMPLES"]
    impedance = impedance if impedance is not None else os.environ.get("CELLSPAN_IMPEDANCE")
    return normalise_samples(read(spark, samples)), normalise_impedance(None if impedance is None else read(spark, impedance), spark)


def data_hash(*frames: DataFrame) -> str:
    """16 hex digits that depend on the rows but not on their order or partitioning."""
    parts = []
    for df in frames:
        row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
        parts.append(f"{','.join(df.columns)}:{row['n']}:{row['h']}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


# --- adapters from the driver's tables -------------------------------------------------------------------------------

CURRENT = {"signup": 1.0, "click": 2.0, "view": 2.0, "error": 4.0, "purchase": 4.0}


def health_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_cycles with indicators made from the events (some unknown in some kinds of event), soh and outlier flags. One
    shuffle by cell serves all of it; rows without a cell are left out."""
    from cellspan.operators import quality

    d = quality.with_bol(quality.hampel(_numbered_events(spark, sf_dir).where(F.col("cell").isNotNull())))
    c, i, kind, u = F.col("cap"), F.col("I_mean"), F.col("event_type"), F.pmod(F.col("event_id") * 7919, F.lit(1009)) / 1009.0
    return d.select(
        "cell", "grp", "k", "cap", "I_mean", "ambient", "outlier", "bol", (c / F.col("bol")).alias("soh"), "event_type",
        F.when(kind != "signup", 0.09 - 0.01 * c + 0.002 * u).alias("R0"), F.when(kind.isin("click", "view"), 0.06 - 0.005 * c + 0.004 * u).alias("Re_ohm"), F.when(kind.isin("click", "view"), 0.08 + 0.01 * u).alias("Rct_ohm"),
        (2.0 + 0.5 * i - 0.3 * c + u).alias("T_rise"), (F.col("ambient") + i).alias("T_mean"), (3.3 + 0.1 * c - 0.02 * i + 0.05 * u).alias("V_mean"),
    )


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = parted(e.withColumn("cell", cell_of(e, "user_id")), "cell")
    current = F.coalesce(*(F.when(F.col("event_type") == t, v) for t, v in CURRENT.items()))
    return e.select(
        "cell",
        "event_id",
        F.row_number().over(Window.partitionBy("cell").orderBy("event_id")).alias("k"),  # by cell, as all that follows
        (0.6 + 2.0 * (F.col("value") / (F.col("value") + 50.0))).alias("cap"),
        current.alias("I_mean"),
        F.when(F.hour("ts") < 12, 24.0).otherwise(4.0).alias("ambient"),
        F.concat(F.lit("G"), (F.col("user_id") % 7).cast("string")).alias("grp"),
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
    )


def event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a cycle series: one row per user and event, in order of event_id."""
    return _numbered_events(spark, sf_dir).drop("event_id", "ts")


def timed_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_cycles with their times, as watermarks need them."""
    return _numbered_events(spark, sf_dir).drop("event_id")


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples: a supplier is a cell, a quarter a cycle."""
    cycle = 4 * F.year("l_shipdate") + F.quarter("l_shipdate")
    li = table(spark, sf_dir, "lineitem")
    li = li.withColumns({"Cell_ID": cell_of(li, "l_suppkey"), "Cycle_Index": cycle.cast("bigint")})
    li = parted(li, "Cell_ID", "Cycle_Index")
    w = Window.partitionBy("Cell_ID", "Cycle_Index").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.select(
        "Cell_ID",
        "Cycle_Index",
        F.when(F.col("Cycle_Index") % 3 == 0, "charge").otherwise("discharge").alias("Cycle_Type"),
        (10.0 * F.row_number().over(w)).alias("Time_s"),
        (2.0 + 2.2 * F.col("l_quantity") / 50.0).alias("Voltage_V"),
        (-40.0 * F.col("l_discount")).alias("Current_A"),
        (20.0 + 100.0 * F.col("l_tax")).alias("Temp_C"),
        (F.col("l_extendedprice") / 50000.0).alias("Capacity_Ah"),
    )


E_SQL = """
ev AS (
  SELECT printf('B%04d', user_id) AS cell, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS k,
    0.6::DOUBLE + 2.0::DOUBLE * (value / (value + 50.0::DOUBLE)) AS cap,
    CASE event_type WHEN 'signup' THEN 1.0::DOUBLE WHEN 'click' THEN 2.0::DOUBLE WHEN 'view' THEN 2.0::DOUBLE WHEN 'error' THEN 4.0::DOUBLE WHEN 'purchase' THEN 4.0::DOUBLE END AS I_mean,
    CASE WHEN hour(ts) < 12 THEN 24.0::DOUBLE ELSE 4.0::DOUBLE END AS ambient,
    'G' || CAST(user_id % 7 AS VARCHAR) AS grp, event_type
  FROM events
)"""
#: After E_SQL with outlier flags (hp) and beginnings of life (bol).
H_SQL = """
uu AS (SELECT printf('B%04d', user_id) AS cell, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS k, ((event_id * 7919) % 1009) / 1009.0::DOUBLE AS u FROM events),
ht AS (SELECT cell, grp, k, cap, I_mean, ambient, outlier, bol, cap / bol AS soh, event_type,
  CASE WHEN event_type <> 'signup' THEN 0.09::DOUBLE - 0.01::DOUBLE * cap + 0.002::DOUBLE * u END AS R0, CASE WHEN event_type IN ('click', 'view') THEN 0.06::DOUBLE - 0.005::DOUBLE * cap + 0.004::DOUBLE * u END AS Re_ohm,
  CASE WHEN event_type IN ('click', 'view') THEN 0.08::DOUBLE + 0.01::DOUBLE * u END AS Rct_ohm, 2.0::DOUBLE + 0.5::DOUBLE * I_mean - 0.3::DOUBLE * cap + u AS T_rise, ambient + I_mean AS T_mean, 3.3::DOUBLE + 0.1::DOUBLE * cap - 0.02::DOUBLE * I_mean + 0.05::DOUBLE * u AS V_mean
  FROM hp JOIN uu USING (cell, k) JOIN bol USING (cell))"""
L_SQL = """
li AS (SELECT *, 4 * year(l_shipdate) + quarter(l_shipdate) AS ci FROM lineitem),
smp AS (
  SELECT printf('B%04d', l_suppkey) AS Cell_ID, CAST(ci AS BIGINT) AS Cycle_Index, CASE WHEN ci % 3 = 0 THEN 'charge' ELSE 'discharge' END AS Cycle_Type,
    10.0::DOUBLE * row_number() OVER (PARTITION BY l_suppkey, ci ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS Time_s,
    2.0::DOUBLE + 2.2::DOUBLE * l_quantity / 50.0::DOUBLE AS Voltage_V, -40.0::DOUBLE * l_discount AS Current_A, 20.0::DOUBLE + 100.0::DOUBLE * l_tax AS Temp_C, l_extendedprice / 50000.0::DOUBLE AS Capacity_Ah
  FROM li
)"""
