"""Packing by power-of-two decomposition.

A document of n ids becomes whole pieces of `width` ids, then one piece for each binary digit of the rest, longest first.
Pieces of equal length form a bucket; each piece is a sequence of its own, so no sequence crosses documents and none needs
padding. Every document is cut alone: there is no shuffle, and a hot source or a long text only adds pieces. Within a
partition pieces lie bucket by bucket, and their sequences are numbered in that order, so a reader forms batches of equal
shape from neighbouring rows; `write_buckets` gives each bucket a folder.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, small_batches, table
from cellspan.llm.tokens import encoder, with_end

VOCABULARY = "byte_bpe_50k.json"
WIDTH = 1024
END = 0


def piece_lengths(n: int, width: int = WIDTH) -> list[int]:
    """Binary lengths that add up to n: width as often as it fits, then falling powers of two."""
    return [width] * (n // width) + [1 << b for b in range(width.bit_length() - 2, -1, -1) if (n % width) >> b & 1]


def pack(docs: DataFrame, path: str, width: int = WIDTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian uint32), bucket, sequence_id, offset.

    Only id and text are read, so other columns can have any name. Null and empty texts have the end id alone; a null
    doc_id stays null; repeated rows are packed as often as they occur; long texts are whole pieces and a rest; an empty
    table gives no rows. `bucket` is the binary logarithm of the length; sequence_id is unique within the result.
    """
    if width & (width - 1):
        raise ValueError("width must be a power of two")

    def run(batches):
        for batch in cut(batches, size=4 << 20):
            ids, counts = encoder(path).batch(batch.column(1))
            ids, counts = with_end(ids, counts, end)
            pieces = [piece_lengths(n, width) for n in counts.tolist()]
            per_doc = np.fromiter(map(len, pieces), np.int64, len(pieces))
            lengths = np.array([x for p in pieces for x in p], np.int64)
            ends = np.cumsum(lengths)
            doc = np.repeat(np.arange(len(pieces)), per_doc)
            starts = ends - lengths - (np.cumsum(counts) - counts)[doc]
            offsets = np.concatenate([[0], ends * 4]).astype("<i4")
            data = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(starts), pa.array(lengths), pa.array(counts[doc]), data],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, ids binary"
    )
    bucketed = out.withColumn("bucket", F.round(F.log2("length")).cast("int")).sortWithinPartitions("bucket")
    return bucketed.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each bucket, so that a reader forms batches of equal shape without padding."""
    pieces.write.partitionBy("bucket").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
