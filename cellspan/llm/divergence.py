"""Audit of how sources diverge in their words, over an inverted index with corrections of a common baseline.

A source gives every kept term of its language a smoothed share p, in units of a billionth; the divergence of source g from
source h is the sum over the terms of floor((p_g - p_h)^2 / p_h). Most terms are missing in most sources, so each pair
starts at V times the value f0 that two zero counts give. What is left are corrections:

* of a term that g alone (or h alone) has, the correction depends on p and the other's zero share only: a histogram of each
  source's p serves all its partners;
* of a term that both have, the postings of the term emit the rest, f(p_g, p_h) - f(p_g, 0_h) - f(0_g, p_h) + f0, added up
  in blocks of bounded size inside the tasks, so no pair of postings becomes a row.

All of it is exact integer arithmetic; shares are divided digit by digit, so counts may reach 9e15. Term counts are added up
inside the tasks before the only shuffle of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellspan.llm.common import cut, small_batches, stage, table, texts

#: bytes.translate table: A-Z to lower case; every ASCII byte that is no letter to a space.
TERM_TABLE = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
LEAST_DOCS = 3
SHARES = 1_000_000_000
TOP_TERMS = 200
#: Distinct (source, term) entries that a task holds before it hands them on.
ENTRIES = 300_000
#: Pairs of postings computed at once.
BLOCK = 1 << 20
SALTS = 64


def share(count: Column, total: Column) -> Column:
    """1 + floor(SHARES * count / total) for 0 < count <= total, three digits at a time."""
    out, rest = F.expr("0L"), count
    for i in range(4):
        if i:
            out, rest = out * 1000, rest * 1000
        out, rest = out + F.call_function("div", rest, total), rest % total
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def occurrences(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term), added up as far as a task's memory holds."""

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    def run(batches):
        held: dict = {}
        for batch in cut(batches, column=2):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, 2), strict=True):
                words = text.translate(TERM_TABLE).split()
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                d.update(set(words))
            if sum(len(n) for n, _ in held.values()) >= ENTRIES:
                yield from emit(held)
        yield from emit(held)

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.withColumn("term", F.col("term").cast("string"))


def both_sided(postings: DataFrame) -> DataFrame:
    """lang, source, item, delta from rows (lang, list of (source, p, p0)): corrections of terms that both sources have."""

    def run(batches):
        for batch in batches:
            at = batch.column(1)
            lang = batch.column(0).dictionary_encode()
            sizes = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            fields = at.flatten()
            names = fields.field(0).dictionary_encode()
            # a source is told from the same name in another language
            who = names.indices.to_numpy().astype(np.int64) + np.repeat(lang.indices.to_numpy().astype(np.int64), sizes) * len(names.dictionary)
            p, zero = (fields.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            begin = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            width = len(names.dictionary) * len(lang.dictionary)
            partners = np.cumsum(sizes[row])  # each posting meets all postings of its term
            a = 0
            while a < len(row):
                b = max(a + 1, int(np.searchsorted(partners, (partners[a - 1] if a else 0) + BLOCK, side="right")))
                each = sizes[row[a:b]]
                g = np.repeat(np.arange(a, b), each)
                ends = np.cumsum(each)
                h = np.arange(int(ends[-1])) - np.repeat(ends - each, each) + np.repeat(begin[row[a:b]], each)
                g, h = g[g != h], h[g != h]
                d = (p[g] - p[h]) ** 2 // p[h] - (p[g] - zero[h]) ** 2 // zero[h] - (zero[g] - p[h]) ** 2 // p[h] + (zero[g] - zero[h]) ** 2 // zero[h]
                codes, slot = np.unique(who[g] * width + who[h], return_inverse=True)
                total = np.zeros(len(codes), np.int64)
                np.add.at(total, slot, d)
                first, second = codes // width, codes % width
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(first // len(names.dictionary))),
                        names.dictionary.take(pa.array(first % len(names.dictionary))),
                        names.dictionary.take(pa.array(second % len(names.dictionary))),
                        pa.array(total),
                    ],
                    ["lang", "source", "item", "delta"],
                )
                a = b

    return postings.select("lang", "list").mapInArrow(run, "lang string, source string, item string, delta long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    Null lang, source and text are '': a null and an empty source are one group. Repeated rows are documents of their own;
    long texts are read whole; a language without kept terms has pairs of value 0 and no terms; a language of one source has
    no pairs; an empty table gives no rows. Ties rank by the item's UTF-8. Only lang, source and text are read, so other
    columns can have any name. Postings of a term are as many as its language has sources, pairs as many as their square:
    that is the size of the result.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    by_term = occurrences(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = by_term.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("list")).where(F.col("docs") >= least_docs)
    index = stage(index.select("lang", "term", "all_n", "list"), "divergence-index")
    flat = index.select("lang", "term", "all_n", F.inline("list"))

    langs = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "all_total"])
    size = F.col("total") + F.col("v")
    groups = stage(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(1).cast("long"), size)).otherwise(1)), "divergence-groups")

    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shares = flat.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
    shares = shares.select(
        "lang", "source", "term", "p0", share(F.col("n") + 1, size).alias("p"), share(F.col("all_n") + 1, F.col("all_total") + F.col("v")).alias("q")
    )
    shares = stage(shares, "divergence-shares")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    both = both_sided(shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("list")))
    counts = shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("times")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    other = salted.select("lang", F.col("source").alias("other"), F.col("p0").alias("other0"), "salt")
    met = counts.join(other, ["lang", "salt"]).where("source <> other")
    p, mine, theirs, times = F.col("p"), F.col("p0"), F.col("other0"), F.col("times")
    one = met.select(
        "lang",
        F.inline(
            F.array(
                F.struct(F.col("source"), F.col("other").alias("item"), (times * (gap(p, theirs) - gap(mine, theirs))).alias("delta")),
                F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (times * (gap(theirs, p) - gap(theirs, mine))).alias("delta")),
            )
        ),
    )
    base = groups.select("lang", "source", "v", "p0").join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source <> item")
    base = base.select("lang", "source", "item", (F.col("v") * gap(F.col("p0"), F.col("q0"))).alias("delta"))
    pairs = base.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("delta").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce("text", ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS all_total FROM kept GROUP BY lang),
cells AS (SELECT w.lang, w.source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN cells USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SHARES}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p,
         1 + {SHARES}::HUGEINT * (k.all_n + 1) // (l.all_total + l.v) AS q
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
