"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: \x20 and \x09-\x0D, what bytes.split() splits at.
SPACES = b" \t\n\r\x0b\x0c"
#: bytes.translate table: A-Z to lower case; every ASCII byte outside 0-9 and a-z to a space.
WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
#: Rows and bytes that cross to Python at once; a batch is cut further by the bytes of its texts (see cut).
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 4 << 20
BYTES_PER_CUT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts are large rows: bound the Arrow batches that cross to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and everything runs in one
    process, as in tests, a folder of our own; on a cluster a local folder would not be shared, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cellspan-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage with files every executor can read."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fold(doc_id, n: int):
    """crc32 of the decimal text of doc_id, modulo n, as a Column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def is_fold(doc_ids: Iterable[int | None], n: int, r: int) -> list[bool]:
    """The same on the Python side; a null id is in no fold."""
    return [x is not None and crc32(str(x).encode()) % n == r for x in doc_ids]


def cut(batches: Iterable[pa.RecordBatch], column: int = 1, size: int = BYTES_PER_CUT, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `size` bytes in `column` (or its `field`), or one row where that alone is longer."""
    for batch in batches:
        values = batch.column(column) if field is None else pc.struct_field(batch.column(column), field)
        total = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
    _release()


def _release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def texts(batch: pa.RecordBatch, column: int = 1, field: str | None = None) -> list[bytes]:
    """UTF-8 bytes of a text column, or of a field of a column of structs; null is the empty text."""
    values = batch.column(column)
    values = values if field is None else pc.struct_field(values, field)
    return [b"" if x is None else x for x in values.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_to_rows(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 within each run: [2, 3] -> [0, 1, 0, 1, 2]."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
