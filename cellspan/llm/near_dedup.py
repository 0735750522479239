"""Near-duplicates by DartMinHash over weighted word shingles.

A text is the multiset of its five-word shingles. Darts are points of a Poisson process over (shingle, weight, rank) that
all texts share through hashing: unit cells of weight x rank get a hashed number of darts at hashed places, a text keeps
those below its shingles' weights, and in each coordinate (a hash of the dart) the dart of least rank is the signature.
Two texts agree in a coordinate with the probability of their weighted Jaccard similarity. Bands of the signature are
joined; equal word sequences meet before that, so copies count once.

Within a bucket each text is compared with the bucket's leader only, exactly, on its whole shingles. Links then form
classes. Where a bucket still holds several classes, its members outside the largest one are compared with other members of
that, and at last members of different classes with one another where prefix filtering over their shingles (exact for
this similarity) leaves a pair possible. No bucket is collected anywhere, and links are only left out where both texts are
in one class already.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cellspan.llm.common import WORD_TABLE, cut, mix64, small_batches, spans_to_rows, stage, table, texts

SHINGLE = 5
LEAST = 0.8
ROUNDS = 2
BANDS, ROWS = 42, 7  # a pair at 0.8 is missed with probability (1 - 0.8**7)**42, below 1e-4
SALTS = 32  # of a text that many others are compared with
ELEMENT_SALTS = 8  # of a shingle that many texts have
MOST_TEXTS = (1 << 14) - 1  # at once in shingles(), which packs their number into 14 bits
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def _u64(x) -> np.ndarray:
    return np.asarray(x).astype(np.uint64)


def shingles(docs: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted; a text with fewer words than `size` is one shingle, one without words none."""
    if len(docs) > MOST_TEXTS:
        parts = [(at, *shingles(docs[at : at + MOST_TEXTS], size)) for at in range(0, len(docs), MOST_TEXTS)]
        return np.concatenate([d + at for at, d, _, _ in parts]), np.concatenate([s for _, _, s, _ in parts]), np.concatenate([n for _, _, _, n in parts])
    plain = [t.translate(WORD_TABLE) for t in docs]
    data = np.frombuffer(b" ".join([b"", *plain, b""]), np.uint8)
    word = data != 32
    begins = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    none = np.zeros(0, np.int64)
    if not len(begins):
        return none, _u64(none), none
    lens = ends - begins
    place = spans_to_rows(lens)
    powers = np.cumprod(np.full(int(lens.max()), 0x100000001B3, np.uint64))
    letters = (data[word].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mix64(np.add.reduceat(letters, np.cumsum(lens) - lens) ^ _u64(lens))
    doc_begin = np.cumsum([1, *(len(t) + 1 for t in plain)])
    doc = np.searchsorted(doc_begin, begins, side="right") - 1
    counts = np.bincount(doc, minlength=len(docs))
    rolled = np.zeros(len(hashes), np.uint64)
    for i in range(size):
        rolled = rolled * np.uint64(0xD1B54A32D192ED03) + np.concatenate([hashes[i:], np.zeros(min(i, len(hashes)), np.uint64)])
    left = counts[doc] - spans_to_rows(counts[counts > 0])  # words from here to the text's end
    whole = left >= size
    d, s = doc[whole], mix64(rolled[whole])
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        own = hashes[doc == i]
        h = _u64([len(own)])
        for x in own:
            h = mix64(h * _GOLDEN + x)
        d, s = np.append(d, i), np.append(s, h)
    key = (_u64(d) << np.uint64(50)) | (s >> np.uint64(14))
    key, n = np.unique(key, return_counts=True)
    return (key >> np.uint64(50)).astype(np.int64), key & np.uint64((1 << 50) - 1), n


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = BANDS * ROWS) -> np.ndarray:
    """n_docs x k fingerprints of the least dart of each coordinate; rows of documents without elements stay 0."""
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    reach = np.zeros(n_docs)
    todo = total > 0
    reach[todo] = k * (math.log(k) + 3) / total[todo]
    while todo.any():
        on = todo[doc]
        keys, ranks, prints = _darts(doc[on], element[on], weight[on].astype(float), reach, k)
        order = np.argsort(-ranks, kind="stable")  # the least rank is written last
        flat = out.reshape(-1)
        filled = np.zeros(n_docs * k, bool)
        filled[keys] = True
        flat[keys[order]] = prints[order]
        todo &= ~filled.reshape(n_docs, k).all(axis=1)
        reach *= 2  # some coordinate got no dart: look at higher ranks; the least darts found so far stay the least
    return out


def _darts(doc, element, weight, reach, k):
    """(document * k + coordinate, rank, fingerprint) of all darts below weight and reach."""
    keys, ranks, prints = [], [], []
    level, low, width = 0, 0.0, 1.0
    while True:
        on = np.flatnonzero(weight > low)
        if not len(on):
            break
        cells = np.ceil(reach[doc[on]] * width).astype(np.int64)  # cells are `width` wide and 1/width high
        own = np.repeat(on, cells)
        row = spans_to_rows(cells)
        cell = mix64(element[own] * _GOLDEN + mix64(_u64(row) * np.uint64(64) + np.uint64(level + 1)))
        n = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(float) * 2.0**-53, side="right")
        own, row, cell = np.repeat(own, n), np.repeat(row, n), np.repeat(cell, n)
        first = mix64(cell + _u64(spans_to_rows(n) + 1) * _GOLDEN)
        second = mix64(first ^ np.uint64(0xA0761D6478BD642F))
        at = low + width * ((first & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32)
        rank = (row + (second >> np.uint64(11)).astype(float) * 2.0**-53) / width
        ok = (at < weight[own]) & (rank < reach[doc[own]])
        keys.append(doc[own[ok]] * k + ((first[ok] >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
        ranks.append(rank[ok])
        prints.append(second[ok])
        level += 1
        low, width = (1.0, 1.0) if level == 1 else (2.0 ** (level - 1), 2.0 ** (level - 1))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (ranks, float), (prints, np.uint64)))


def fingerprint(text: bytes) -> bytes:
    """Of the word sequence."""
    return hashlib.sha256(b" ".join(text.translate(WORD_TABLE).split())).digest()[:16]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (of the word sequence), size (words or shingles), bands (hashes; none for texts without words)."""

    def run(batches):
        for batch in cut(batches, size=1 << 18):  # a text has some thousand darts
            own = texts(batch)
            doc, element, count = shingles(own)
            sig = dart_signatures(doc, element, count, len(own))
            bands = np.zeros((len(own), BANDS), np.uint64)
            for j in range(ROWS):
                bands = mix64(bands * _GOLDEN + sig.reshape(len(own), BANDS, ROWS)[:, :, j] + _u64(np.arange(BANDS)))
            size = np.bincount(doc, weights=count, minlength=len(own)).astype(np.int64)
            listed = [b if n else [] for b, n in zip(bands.view(np.int64).tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in own], pa.binary()), pa.array(size), pa.array(listed, pa.list_(pa.int64()))], ["doc_id", "node", "size", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, node binary, size long, bands array<bigint>")


def _elements(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set: the shingles of one text of each of the nodes (node, doc_id), as sorted uint64 of shingle and occurrence."""

    def run(batches):
        for batch in cut(batches):
            own = texts(batch)
            doc, element, count = shingles(own)
            each = np.repeat(np.arange(len(doc)), count)
            value = mix64(element[each] + _u64(spans_to_rows(count)) * _GOLDEN)
            edges = np.searchsorted(doc[each], np.arange(len(own) + 1))
            sets, nodes = [], [fingerprint(t) for t in own]
            for i in range(len(own)):
                sets.append(np.sort(value[edges[i] : edges[i + 1]]).tobytes() if nodes[i] == batch.column(0)[i].as_py() else None)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])
            yield out.filter(out.column(1).is_valid())

    wanted = nodes.select("node", F.col("doc_id").alias("wanted"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["wanted"])).select("node", "text")
    return joined.mapInArrow(run, "node binary, set binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact similarity.

    The pairs of a text `a` are dealt into SALTS groups; each is streamed with the set of `a` once at its head, so it is
    neither repeated for every pair nor compared in one task. A repeated doc_id gives a node several equal sets: one counts.
    """

    def run(batches):
        head, own, last = None, None, None
        for batch in cut(batches, 3):
            a, b, sims = [], [], []
            for x, salt, y, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                values = np.frombuffer(raw, np.uint64)
                if y is None:
                    head, own, last = (x, salt), values, None
                elif head == (x, salt) and y != last:
                    both = len(np.intersect1d(own, values, assume_unique=True))
                    a.append(x)
                    b.append(y)
                    sims.append(both / (len(own) + len(values) - both))
                    last = y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    heads = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), "set"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "set")
    tails = salted.join(sets.select(F.col("node").alias("b"), "set"), "b").select("a", "salt", "b", "set")
    dealt = heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a binary, b binary, sim double")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for the nodes of edges (a, b), by large and small stars."""
    now = stage(edges.select("a", "b"), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()  # each node below one that its neighbours have in common
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        seen = Observation()
        now = stage(small.where("a != b").distinct().observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")), "edges")
        mark = seen.get
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes, with their class so far."""
    placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    return placed.join(mixed, "key", "left_semi")


def _possible(apart: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of rows (node, root, set) of different roots that can reach the similarity, by prefix filtering.

    Elements are put in one order, rare ones first. Two sets that are similar enough share one of the first
    n - ceil(least * n) + 1 elements of each, and from their first common one on enough elements are left in both. Their
    sizes differ by that factor at most, so they lie in the same or neighbouring classes of size.
    """

    def run(batches):
        for batch in batches:
            for node, root, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(raw, np.int64)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([node] * n, pa.binary()), pa.array([root] * n, pa.binary()), pa.array(np.full(n, n)), pa.array(values)], ["node", "root", "n", "e"])

    elements = stage(apart.select("node", "root", "set").mapInArrow(run, "node binary, root binary, n long, e long"), "elements")
    counts = elements.groupBy("e").agg(F.count("*").alias("df")).where("df > 1").withColumn("salt", F.explode(F.array(*map(F.lit, range(ELEMENT_SALTS)))))
    salted = elements.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(ELEMENT_SALTS)).cast("int"))
    listed = salted.join(counts, ["e", "salt"], "left").withColumn("df", F.coalesce("df", F.lit(1))).groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("l"))  # one text's elements
    first = F.slice("l", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    head = stage(listed.select("node", "root", "n", F.posexplode(first).alias("i", "x")).where("x.df > 1").select("node", "root", "n", (F.col("n") - F.col("i")).alias("left"), F.col("x.e").alias("e")), "heads")
    x, y = (head.select("e", F.floor(F.log("n") / -math.log(least)).alias("size"), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "n", "left"))) for s in "xy")
    x = x.withColumn("size", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)))
    need = F.ceil((F.col("n_x") + F.col("n_y")) * (least / (1 + least)) - 1e-9)
    near = (F.col("root_x") < F.col("root_y")) & (F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y")) & (F.least("left_x", "left_y") >= need)
    return x.join(y, ["e", "size"]).where(near).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after links (a, b): components of the graph of classes only."""
    own = lambda c: F.coalesce(f"r{c}", c)
    ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    between = links.join(ra, "a", "left").join(rb, "b", "left").select(own("a").alias("a"), own("b").alias("b")).where("a != b").distinct()
    new = components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = new.select(F.col("root").alias("node"), F.col("to").alias("root")).join(roots.select("node"), "node", "left_anti")
    return stage(old.unionByName(fresh), "roots")


def classes(docs: DataFrame, least: float = LEAST, signatures: DataFrame | None = None) -> DataFrame:
    """node, class_id (least doc_id of the class), class_node (the node of that document) for every word sequence in docs.

    Null texts are empty texts; texts without words are one class; shorter texts than a shingle are near only to equal ones.
    A null doc_id is a class_id only where the class has no other.
    """
    spark = docs.sparkSession
    rows = signatures if signatures is not None else stage(signed(docs), "signed")
    nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    members = nodes.select("node", "size", F.explode("bands").alias("key")).withColumn("r", F.xxhash64("key", "node"))
    leaders = members.groupBy("key").agg(F.min_by("node", "r").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    buckets = stage(members.select("key", "node", "size").join(leaders, "key"), "buckets")
    pairs = stage(buckets.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stage(_elements(docs, nodes.join(wanted, "node", "left_semi")), "sets")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")  # two shingle sets a row
    try:
        first = stage(_compared(pairs, sets), "compared")
        roots = stage(components(first.where(F.col("sim") >= least)), "roots")
        # members of mixed buckets against another member of the bucket's largest class
        for t in range(ROUNDS):
            left = stage(_open(buckets.select("key", "node"), roots), "open")
            sizes = left.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("key", "node", F.lit(t))).alias("leader"))
            tops = sizes.groupBy("key").agg(F.max_by(F.struct("root", "leader"), F.struct("n", "root")).alias("top"))
            next_ = left.join(tops, "key").where(F.col("root") != F.col("top.root")).select(F.col("top.leader").alias("a"), F.col("node").alias("b")).distinct()
            links = stage(_compared(next_, sets).where(F.col("sim") >= least), "compared")
            if not links.take(1):
                break
            roots = _merged(roots, links)
        # what is still apart, exactly
        apart = _open(buckets.select("key", "node"), roots).select("node", "root").distinct()
        links = stage(_compared(stage(_possible(apart.join(sets.dropDuplicates(["node"]), "node"), least), "pairs"), sets).where(F.col("sim") >= least), "compared")
        if links.take(1):
            roots = _merged(roots, links)
    finally:
        small_batches(spark)
    rooted = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_of = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.coalesce(F.min_by("node", "doc_id"), F.min("node")).alias("class_node"))
    return stage(rooted.join(least_of, "root").select("node", "class_id", "class_node"), "classes")


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id, kept (the class is named after this document) for each row of docs.

    Null and empty texts and others without words are one class, shorter texts than a shingle are near to equal ones only,
    repeated rows are in one class, of equal doc_ids every row is marked as kept; long texts are compared whole; an empty
    table gives no rows. Only doc_id and text are read, so other columns can have any name.
    """
    small_batches(docs.sparkSession)
    rows = stage(signed(docs), "signed")
    return rows.select("doc_id", "node").join(classes(docs, least, rows), "node").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each class, with all its columns, whatever their names: that of the least doc_id (of repeated rows, any).

    Each case is that of near_duplicates; a null doc_id is kept only where its class has no other.
    """
    small_batches(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    rows = stage(signed(docs), "signed")
    kept = classes(docs, least, rows).where(F.col("node") == F.col("class_node")).select(F.col("node").alias("n"), F.col("class_id").alias("c"))
    rowed = docs.select(F.struct("*").alias("row"))

    def run(batches):
        for batch in cut(batches, 0, field="text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in texts(batch, 0, "text")], pa.binary())], ["row", "node"])

    whole = rowed.mapInArrow(run, StructType([*rowed.schema.fields, StructField("node", BinaryType())]))
    same = (whole["node"] == kept["n"]) & F.col("row.doc_id").cast("long").eqNullSafe(kept["c"])
    return whole.join(kept, same, "left_semi").dropDuplicates(["node"]).select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
