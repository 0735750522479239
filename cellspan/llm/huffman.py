"""Token ids in canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints.

Documents are dealt out by ranges of doc_id and tokenized once, in order, into segments of whole documents. Global counts
of the ids (at most one row per vocabulary entry reaches the driver) give one code; each segment becomes one block row of
the file, which can be decoded alone, and within a block from any checkpoint. Files are Parquet in a folder all executors
share: `blocks` and a one-row `codebook` with the code lengths, from which the canonical code follows.
"""

from __future__ import annotations

import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, shared_dir, small_batches, stage, table
from cellspan.llm.tokens import encoder, with_end

VOCABULARY = "word_bpe_49k.json"
END = 1
LONGEST = 18
SEGMENT = 1 << 17
STEP = 256
SEGMENTS = "part int, seg long, first long, n_ids long, doc_ids array<bigint>, lens array<bigint>, ids binary"
BLOCKS = "part int, seg long, first long, n_ids long, doc_ids array<bigint>, lens array<bigint>, bits long, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids do not fit in codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, levels = leaves, []
    for _ in range(longest - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        row = both[by]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    out[order[:take]] += 1
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), as the lengths alone define them."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        lens = lengths[order].astype(np.int64)
        top = int(lens[-1])
        steps = np.left_shift(1, top - lens)  # in units of the longest code
        codes[order] = ((np.cumsum(steps) - steps) >> (top - lens)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of an index, and for each index the id and the length of the code it begins with."""
    top = max(1, int(lengths.max(initial=0)))
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, top - lengths[order].astype(np.int64))
    ids, lens = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    n = int(spans.sum())
    ids[:n], lens[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    assert not len(order) or int(codes[order[0]]) == 0
    return top, ids, lens


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[int, bytes, bytes]:
    """Bits, payload of big-endian 32-bit words, and the bit offset of every step-th id."""
    lens = lengths[ids].astype(np.int64)
    ends = np.cumsum(lens)
    at = ends - lens
    bits = int(ends[-1]) if len(ends) else 0
    shifted = codes[ids] << (64 - (at & 31) - lens).astype(np.uint64)
    words = bits // 32 + 2
    word = at >> 5
    # codes do not overlap, so sums below 2**32 put them together; doubles hold them exactly
    total = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return bits, total.astype(">u4").tobytes(), at[::step].astype("<u8").tobytes()


def decode_blocks(blocks: list[tuple[int, bytes, bytes]], tables, step: int = STEP) -> list[np.ndarray]:
    """Ids of blocks (n_ids, payload, checkpoints); all stretches between checkpoints are decoded in step."""
    top, table_ids, table_lens = tables
    words, at, counts, base = [], [], [], 0
    for n, payload, checkpoints in blocks:
        words.append(np.frombuffer(payload, ">u4").astype(np.uint64))
        points = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        at.append(points + base * 32)
        counts.append(np.minimum(step, n - step * np.arange(len(points))))
        base += len(words[-1])
    if not at or not sum(map(len, at)):
        return [np.zeros(0, np.uint32) for _ in blocks]
    words = np.concatenate([*words, np.zeros(2, np.uint64)])
    pos, left = np.concatenate(at), np.concatenate(counts)
    out = np.zeros((len(pos), step), np.uint32)
    last = len(words) - 2
    for i in range(int(left.max())):
        word = np.minimum(pos >> 5, last)
        window = (words[word] << np.uint64(32)) | words[word + 1]
        index = (window >> (64 - top - (pos & 31)).astype(np.uint64)) & np.uint64((1 << top) - 1)
        index = index.astype(np.int64)
        out[:, i] = table_ids[index]
        pos = pos + table_lens[index]
    flat = out[np.arange(step) < left[:, None]]
    return np.split(flat, np.cumsum([n for n, _, _ in blocks])[:-1])


def segments(docs: DataFrame, path: str, end: int, parts: int, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT) -> DataFrame:
    """Ids of whole documents in ascending order of doc_id (equal ones by a hash of the text), cut into segments."""

    def run(batches):
        part, seg, first = TaskContext.get().partitionId(), 0, 0
        held: list = []
        for batch in cut(batches, size=4 << 20):
            ids, counts = encoder(path).batch(batch.column(1))
            ids, counts = with_end(ids, counts, end)
            doc_ids, at = batch.column(0).to_pylist(), 0
            bounds = np.cumsum(counts)
            while at < len(counts):
                base = int(bounds[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(bounds, base + size, side="right")))
                held = [doc_ids[at:stop], counts[at:stop].tolist(), ids[base : int(bounds[stop - 1])]]
                n = len(held[2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seg]), pa.array([first]), pa.array([n]), pa.array([held[0]], pa.list_(pa.int64())), pa.array([held[1]], pa.list_(pa.int64())), pa.array([held[2].astype("<u2" if n == 0 or int(held[2].max()) < 65536 else "<u4").tobytes()], pa.binary())],
                    ["part", "seg", "first", "n_ids", "doc_ids", "lens", "ids"],
                )
                seg, first, at = seg + 1, first + n, stop

    tie = F.xxhash64("text")
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(parts, "doc_id", tie)
    return ordered.sortWithinPartitions("doc_id", tie).mapInArrow(run, SEGMENTS)


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def id_counts(segs: DataFrame, vocabulary: int) -> np.ndarray:
    """Global counts of the ids; each task adds up its own first."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(_ids(raw, n), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = segs.select("ids", "n_ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_ids(docs: DataFrame, path: str, out: str, end: int = END, parts: int | None = None, longest: int = LONGEST) -> None:
    """Write the ids of docs to `out`. Null and empty texts have the end id alone; no documents give no blocks."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = max(encoder(path).tokenizer.get_vocab_size(), end + 1)
    segs = stage(segments(docs, path, end, parts), "ids")
    lengths = code_lengths(id_counts(segs, vocabulary), longest)
    packed = lengths.tobytes()

    def run(batches):
        lengths = np.frombuffer(packed, np.uint8)
        codes = canonical(lengths)
        for batch in batches:
            coded = [encode_block(_ids(raw, n), codes, lengths) for raw, n in zip(batch.column(6).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            bits, payload, points = zip(*coded, strict=True) if coded else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(bits, pa.int64()), pa.array(payload, pa.binary()), pa.array(points, pa.binary())], ["part", "seg", "first", "n_ids", "doc_ids", "lens", "bits", "payload", "checkpoints"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # a row is a whole segment
    try:
        segs.mapInArrow(run, BLOCKS).write.parquet(f"{out}/blocks")
    finally:
        small_batches(spark)
    spark.createDataFrame([(bytearray(packed), STEP)], "lengths binary, step int").coalesce(1).write.parquet(f"{out}/codebook")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian uint32), from the files alone."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    book = spark.read.parquet(f"{out}/codebook").first()
    packed, step = bytes(book["lengths"]), book["step"]
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each writing task
    before, total = {}, 0
    for r in sizes:
        before[r["part"]], total = total, total + r["n"]

    def run(batches):
        tables = decode_table(np.frombuffer(packed, np.uint8))
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                b = batch.slice(at, 16).to_pydict()
                ids = decode_blocks(list(zip(b["n_ids"], b["payload"], b["checkpoints"], strict=True)), tables, step)
                for part, first, doc_ids, lens, block in zip(b["part"], b["first"], b["doc_ids"], b["lens"], ids, strict=True):
                    ends = np.cumsum(np.array(lens, np.int64))
                    offsets = np.concatenate([[0], ends * 4]).astype("<i4")
                    data = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(block.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before[part] + first + ends - np.array(lens, np.int64)), data], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def op6_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = f"{shared_dir(spark)}/huffman-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), out)
    return read_ids(spark, out).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
