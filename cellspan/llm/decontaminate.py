"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of `window` consecutive item words (an item of fewer words is one window). For the windows of one
length, a shift table indexed by a block of two words tells how far the search may jump; where it says 0, the bucket of
the suffix block's hash holds the windows to compare directly. Many lanes of a batch's word stream advance together, so
the search runs in numpy. Items reach the workers in blocks of a bounded number of window words (`block_words`), one
broadcast and one pass over the documents for each block, however large the benchmark is; a block is dropped before the
next is read. Documents are never shuffled for one block; with several, only the hits are added up by document.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import WORD_TABLE, cut, small_batches, stage, table, texts

WINDOW = 13
BLOCK_WORDS = 4_000_000
HASH_BITS = 18
HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class WuManber:
    """Searches windows that all have m words. Words are numbered from 1; 0 is any word that no window has."""

    def __init__(self, windows: np.ndarray):
        self.windows = windows
        n, m = windows.shape
        self.m, self.block = m, min(2, m)
        reach = m - self.block + 1
        self.shift = np.full(1 << HASH_BITS, reach, np.int32)
        for j in range(reach):  # blocks that end j words before the window's end
            np.minimum.at(self.shift, self.hash(windows, np.full(n, m - 1 - j), np.arange(n)), j)
        suffix = self.hash(windows, np.full(n, m - 1), np.arange(n))
        self.order = np.argsort(suffix, kind="stable")
        self.counts = np.bincount(suffix, minlength=1 << HASH_BITS)
        self.begins = np.cumsum(self.counts) - self.counts

    def hash(self, words: np.ndarray, at: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
        """Of the block that ends at `at`."""
        last = words[at] if row is None else words[row, at]
        h = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.block == 2:
            before = words[at - 1] if row is None else words[row, at - 1]
            h = (h ^ (before.astype(np.uint64) + np.uint64(1))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def search(self, words: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(last word's position, number of the window) of every occurrence."""
        n, m = len(words), self.m
        pos = np.arange(m - 1, n, lane)
        end = np.minimum(pos + lane, n)
        stops = []
        while len(pos):
            jump = self.shift[self.hash(words, pos)]
            stops.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            on = pos < end
            pos, end = pos[on], end[on]
        stops = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        found_at, found = [], []
        for at in range(0, len(stops), 50_000):
            stop = stops[at : at + 50_000]
            h = self.hash(words, stop)
            each = self.counts[h]
            where = np.repeat(stop, each)
            which = self.order[np.repeat(self.begins[h] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
            for k in range(m - 1, -1, -1):  # direct comparison, from the end
                same = words[where - (m - 1 - k)] == self.windows[which, k]
                where, which = where[same], which[same]
            found_at.append(where)
            found.append(which)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_at]), np.concatenate([none, *found])


class Patterns:
    """The windows of some items, ready to search."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1):
                by_length[m][tuple(ids[i : i + m])].add(item)
        self.searches = [(WuManber(np.array(list(w), np.int32)), list(w.values())) for w in by_length.values()]

    def hits(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """For each document, a mask of its hit words and the items found."""
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        get = self.number.get
        stream = np.zeros(int(lens.sum()) + len(docs), np.int64)  # a 0 after each document
        starts = np.cumsum(lens + 1) - (lens + 1)
        for s, words in zip(starts.tolist(), docs, strict=True):
            stream[s : s + len(words)] = [get(w, 0) for w in words]
        edge = np.zeros(len(stream) + 1, np.int64)
        items: list[set[str]] = [set() for _ in docs]
        for search, owners in self.searches:
            at, which = search.search(stream)
            np.add.at(edge, at - search.m + 1, 1)
            np.add.at(edge, at + 1, -1)
            for d, w in zip((np.searchsorted(starts, at, side="right") - 1).tolist(), which.tolist(), strict=True):
                items[d] |= owners[w]
        mask = np.cumsum(edge[:-1]) > 0
        return [(mask[s : s + n], found) for s, n, found in zip(starts.tolist(), lens.tolist(), items, strict=True)]


def item_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of items with at most about block_words window words; items are read one by one, never all at once."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if words:
            block.append((row[0] or "", words))
            size += len(words) * window
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _rule(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


RAW = "h long, n_words long, mask binary, items array<string>"


def _result(ids, n_words, n_hit, items) -> pa.RecordBatch:
    shas = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    bad = [_rule(h, n) for h, n in zip(n_hit, n_words, strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas, pa.string()), pa.array(bad, pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _hits_by_block(docs: DataFrame, blocks, window: int) -> DataFrame:
    """h (hash of doc_id and text), n_words, mask, items of the documents with hits, over all blocks."""
    out, sc = None, docs.sparkSession.sparkContext
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))
    for block in blocks:
        shared = sc.broadcast(block)

        def run(batches, shared=shared):
            patterns = Patterns(shared.value, window)
            for batch in cut(batches):
                words = [words_of(t) for t in texts(batch)]
                found = patterns.hits(words)
                on = [i for i, (mask, _) in enumerate(found) if mask.any()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on, pa.int64())), pa.array([len(words[i]) for i in on], pa.int64()), pa.array([np.packbits(found[i][0]).tobytes() for i in on], pa.binary()), pa.array([sorted(found[i][1]) for i in on], pa.list_(pa.string()))], ["h", "n_words", "mask", "items"])

        own = stage(rows.mapInArrow(run, RAW), "hits")
        shared.destroy()
        out = own if out is None else out.unionByName(own)
    return out


def _added_up(raw: DataFrame) -> DataFrame:
    """h, n_hit, items: the masks of a document (one a block, and one a repeated row) put together, streamed in sorted order."""

    def run(batches):
        key, mask, items = None, None, set()

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([int(np.unpackbits(mask).sum())]), pa.array([sorted(items)], pa.list_(pa.string()))], ["h", "n_hit", "items"])

        for batch in batches:
            for h, own, more in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                bits = np.frombuffer(own, np.uint8)
                if key is not None and h != key:
                    yield row()
                if h != key:
                    key, mask, items = h, bits, set()
                mask, items = mask | bits, items | set(more)
        if key is not None:
            yield row()

    return raw.distinct().repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, n_hit long, items array<string>")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs; other columns are not read.

    Null and empty texts have no words and are never contaminated; items without words are ignored, equal items count
    once for each item_id, a null item_id is the empty string; an empty benchmark hits nothing, an empty table gives no rows;
    repeated rows are judged as often as they occur; long texts are searched whole.
    """
    blocks = item_blocks(benchmark, window, block_words)
    first, second = next(blocks, []), next(blocks, None)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches):
            patterns = Patterns(shared.value, window)
            for batch in cut(batches):
                words = [words_of(t) for t in texts(batch)]
                found = patterns.hits(words)
                yield _result(batch.column(0), [len(w) for w in words], [int(mask.sum()) for mask, _ in found], [x for _, x in found])

        return own.mapInArrow(run, HITS)
    hits = stage(_added_up(_hits_by_block(docs, chain([first, second], blocks), window)), "hits")

    def finish(batches):
        for batch in cut(batches):
            n_hit, items = ([x or empty for x in batch.column(i).to_pylist()] for i, empty in ((2, 0), (3, [])))
            yield _result(batch.column(0), [len(words_of(t)) for t in texts(batch)], n_hit, items)

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    joined = hashed.join(hits, "h", "left").select("doc_id", "text", "n_hit", "items")
    return joined.mapInArrow(finish, HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names.

    Each case is that of find_hits. The rule is about all items together, so with several blocks of items rows are told apart
    by a hash of doc_id and text, and those with hits are counted before they go.
    """
    blocks = item_blocks(benchmark, window, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        shared, at = docs.sparkSession.sparkContext.broadcast(first), docs.columns.index("text")

        def run(batches):
            patterns = Patterns(shared.value, window)
            for batch in cut(batches, at):
                words = [words_of(t) for t in texts(batch, at)]
                yield batch.filter(pa.array([not _rule(int(mask.sum()), len(w)) for w, (mask, _) in zip(words, patterns.hits(words), strict=True)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    raw = _hits_by_block(docs, chain([first, second], blocks), window)
    bad = _added_up(raw).join(raw.select("h", "n_words").distinct(), "h").where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("h").alias("__hit"))
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["__hit"], "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words by splitting after every other character became a space; windows of 13 words (or a whole shorter item) as lists.
OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM pat
), dwin AS (
  SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT r, m, w, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, lens WHERE len(w) >= m)
), hit AS (SELECT d.r, d.i, d.m, p.item_id FROM dwin d JOIN pat p ON d.m = p.m AND d.win = p.win
), pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r
), its AS (SELECT r, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
