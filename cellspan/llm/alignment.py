"""Alignment of two tokenizations of the same texts by byte-owner arrays.

A is byte-level BPE of a space and the text, B is BPE of pieces with byte fallback, whose first piece has that space. Each
byte has an owner in A and one in B (np.repeat of token numbers over their byte lengths). Consecutive distinct owner pairs are
the overlaps of tokens; where both owners change at once, both tokens end, which cuts the tokens into groups and links the
two that end there. Both tokenizers start afresh at a space that no white space precedes, so texts are cut there, each
distinct stretch is aligned once a worker, and its groups are those of the whole text.

Links are counted for the whole corpus by pairs of ids, once a batch; the counts a batch needs come back to it by a join on
the pair, so a frequent pair has a row for a batch, not for a document. Nothing is broadcast but the best count of each id
of B, as many as its vocabulary has.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellspan.llm.common import cut, small_batches, stage, table
from cellspan.llm.tokens import byte_letters

PATH_A = "byte_bpe_50k.json"
PATH_B = "piece_bpe_32k.model"
BYTES = 4 << 20  # of text in a batch
LOT = 1 << 18  # bytes of distinct stretches aligned at once
FIGURES = 4  # numbers of a stretch before its links
#: Last bytes and those before them of UTF-8 white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029,
#: U+202F, U+205F, U+3000 (fixed values of Unicode White_Space).
WHITE_ENDS = np.array([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], np.uint8)
WHITE_MIDDLES = np.array([0xC2, 0x9A, 0x80, 0x81], np.uint8)
LATIN = "\u0370"
#: A pair of ids is one number: a * 2**32 + b.
SHIFT = 32


def owners(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token of A and the token of B that each byte belongs to."""
    return np.repeat(np.arange(len(lengths_a)), lengths_a), np.repeat(np.arange(len(lengths_b)), lengths_b)


def overlaps_and_cuts(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and of B that share bytes, pair by pair in order, and which of these pairs end together."""
    own_a, own_b = owners(lengths_a, lengths_b)
    new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    last = np.append(np.flatnonzero(new_a | new_b), len(own_a) - 1) if len(own_a) else np.zeros(0, np.int64)
    both = np.append(new_a & new_b, True)[last] if len(own_a) else np.zeros(0, bool)
    return own_a[last], own_b[last], both


def _joined(strings: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    """Neighbouring strings joined, so many each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), strings), by)


class Aligner:
    """Aligned stretches, memoised over two generations of `bound` entries at most."""

    def __init__(self, path_a: str, path_b: str, bound: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        number = {c: x for x, c in byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(number.__getitem__, token)) if all(c in number for c in token) else token.encode()
        b = self.b
        self.bytes_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())
        ]
        self.space = b.piece_to_id("▁")
        # the same vocabulary by ranks: ids are in the order of the merges
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.bytes_a[i]: i for token, i in vocabulary.items() if token not in special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.names = pa.array(list(map(str, range(max(len(self.bytes_a), len(self.bytes_b))))), pa.string())
        self.bound = bound
        self.memo: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.elder: dict[bytes, tuple[bytes, bytes] | None] = {}

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for strings that start with a space, which B adds itself.

        A's ids come from its ranks where all characters are below LATIN, whose categories all versions of Unicode agree on, and
        from the tokenizer itself elsewhere: the two libraries may know different versions.
        """
        other = [i for i, t in enumerate(texts) if not t.isascii() and max(t) >= LATIN]
        coded = [self.ranked.encode_ordinary(t) if t.isascii() or max(t) < LATIN else [] for t in texts]
        for i, e in zip(other, self.a.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
            coded[i] = e.ids
        return coded, [x or [self.space] for x in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def _faithful(self, texts: list[bytes], coded_a: list[list[int]], coded_b: list[list[int]]) -> list[int]:
        """Numbers of the texts whose tokens' bytes are theirs in A and in B; whole lots are compared at once."""
        whole, ends = b"".join(texts), np.cumsum(list(map(len, texts)))
        for coded, known, size in ((coded_a, self.bytes_a, self.size_a), (coded_b, self.bytes_b, self.size_b)):
            flat = list(chain.from_iterable(coded))
            upto = np.cumsum(list(map(len, coded)))
            reached = np.concatenate([[0], np.cumsum(size[flat])])[upto]
            if not np.array_equal(reached, ends) or b"".join(map(known.__getitem__, flat)) != whole:
                break
        else:
            return list(range(len(texts)))
        return [
            i for i, t in enumerate(texts)
            if b"".join(map(self.bytes_a.__getitem__, coded_a[i])) == t and b"".join(map(self.bytes_b.__getitem__, coded_b[i])) == t
        ]

    def align(self, texts: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """Of strings that start with a space: the groups, and as int64 the tokens of A, those of B, the groups, the overlaps and
        the linked pairs of ids; None where the tokens' bytes are not the string's."""
        coded_a, coded_b = self.ids([t.decode() for t in texts])
        good = self._faithful(texts, coded_a, coded_b)
        out: list = [None] * len(texts)
        if not good:
            return out
        if len(good) < len(texts):
            coded_a, coded_b = ([c[i] for i in good] for c in (coded_a, coded_b))
        n_a, n_b = (np.array(list(map(len, c)), np.int64) for c in (coded_a, coded_b))
        ids_a, ids_b = (np.array(list(chain.from_iterable(c)), np.int64) for c in (coded_a, coded_b))
        over_a, over_b, both = overlaps_and_cuts(self.size_a[ids_a], self.size_b[ids_b])
        end_a, end_b = over_a[both], over_b[both]  # a group's last tokens
        text_of = np.repeat(np.arange(len(good)), n_a)
        n_groups = np.bincount(text_of[end_a], minlength=len(good))
        n_overlaps = np.bincount(text_of[over_a], minlength=len(good))
        left = _joined(self.names.take(pa.array(ids_a)), np.diff(end_a, prepend=-1), ",")
        right = _joined(self.names.take(pa.array(ids_b)), np.diff(end_b, prepend=-1), ",")
        groups = _joined(pc.binary_join_element_wise(left, right, "|"), n_groups, ";").cast(pa.binary()).to_pylist()
        ends = np.cumsum(n_groups + FIGURES)
        packed = np.empty(int(ends[-1]), np.int64)
        begin = ends - n_groups - FIGURES
        for k, figure in enumerate((n_a, n_b, n_groups, n_overlaps)):
            packed[begin + k] = figure
        link = np.ones(len(packed), bool)
        link[(begin[:, None] + np.arange(FIGURES)).ravel()] = False
        packed[link] = (ids_a[end_a] << SHIFT) + ids_b[end_b]
        data = packed.tobytes()
        for i, text_groups, x, y in zip(good, groups, (begin * 8).tolist(), (ends * 8).tolist(), strict=True):
            out[i] = (text_groups, data[x:y])
        return out

    def stretches(self, texts: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """The same of distinct strings through the memo."""
        if len(self.memo) + len(texts) > self.bound:
            self.elder, self.memo = self.memo, {}
        out = [self.memo.get(t, 0) for t in texts]
        out = [self.elder.get(t, 0) if x == 0 else x for t, x in zip(texts, out, strict=True)]
        # what is missing in small lots, so that the owner arrays stay small
        missing = [i for i, x in enumerate(out) if x == 0]
        sizes = np.cumsum([len(texts[i]) for i in missing]) // LOT
        for lot in np.split(np.array(missing, np.int64), np.flatnonzero(np.diff(sizes)) + 1) if missing else ():
            for i, x in zip(lot.tolist(), self.align([texts[i] for i in lot.tolist()]), strict=True):
                out[i] = x
        if room := self.bound - len(self.memo):
            self.memo.update((t, x) for t, x in zip(texts[:room], out[:room], strict=True) if len(t) < 200)
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner a worker process."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def cut_points(text: np.ndarray) -> np.ndarray:
    """Where in UTF-8 text a space begins white space: there both tokenizers start afresh. After bytes that may end other white
    space than ASCII's there is no cut, which only leaves a longer stretch."""
    before = text[:-1]
    rest = np.isin(before, WHITE_ENDS) & (np.isin(np.append(np.uint8(0), before[:-1]), WHITE_MIDDLES))
    return np.flatnonzero((text[1:] == 32) & (before != 32) & ~((before >= 9) & (before <= 13)) & ~((before >= 28) & (before <= 31)) & ~rest) + 1


_BATCH = (
    "doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_overlaps array<bigint>, shas array<string>, keys array<bigint>, times array<bigint>, "
    "entries array<bigint>, which binary, often binary"
)


def align_batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per batch of documents: their figures, the batch's distinct pairs with their links, and which pair each document
    has how often (`entries` pairs each, numbers and times as int32)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in cut(batches, size=BYTES):
            texts = [b" " + t if t else b"" for t in batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()]
            data = b"".join(texts)
            ends = np.cumsum(list(map(len, texts)))
            filled = np.flatnonzero(np.diff(ends, prepend=0))
            begins = np.zeros(len(data), bool)
            begins[cut_points(np.frombuffer(data, np.uint8))] = True
            begins[(ends - list(map(len, texts)))[filled]] = True
            starts = np.flatnonzero(begins)
            buffers = [None, pa.py_buffer(np.append(starts, len(data)).astype("<i8")), pa.py_buffer(data)]
            coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
            known = tool.stretches(coded.dictionary.to_pylist())
            codes = coded.indices.to_numpy()
            upto = np.searchsorted(starts, ends)  # stretches of the texts so far
            odd = np.array([x is None for x in known], bool)[codes] if None in known else np.zeros(0, bool)
            known = [x or (b"", bytes(8 * FIGURES)) for x in known]
            groups, packed = zip(*known, strict=True) if known else ((), ())
            pool = np.frombuffer(b"".join(packed), np.int64)
            sizes = np.array(list(map(len, packed)), np.int64) // 8
            begin = np.cumsum(sizes) - sizes
            spread = np.array([pool[begin + k] for k in range(FIGURES)], np.int64).reshape(FIGURES, -1)[:, codes]
            figures = np.diff(np.concatenate([np.zeros((FIGURES, 1), np.int64), np.cumsum(spread, axis=1)], axis=1)[:, np.append(0, upto)], axis=1)
            each = sizes[codes] - FIGURES
            links = pool[np.repeat(begin[codes] + FIGURES - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
            doc = np.repeat(np.arange(len(texts)), figures[2])
            listed = list(map(groups.__getitem__, codes.tolist()))
            shas = [hashlib.sha256(b";".join(listed[a:b])).hexdigest() if b > a else "" for a, b in zip([0, *upto.tolist()], upto.tolist(), strict=False)]
            # a stretch differs from its tokens, so the whole text decides
            for i in np.unique(np.searchsorted(upto, np.flatnonzero(odd), side="right")).tolist():
                whole = tool.align([texts[i]])[0]
                numbers = np.frombuffer(whole[1], np.int64) if whole else np.zeros(FIGURES, np.int64)
                links, doc = (np.concatenate([x[doc != i], y]) for x, y in ((links, numbers[FIGURES:]), (doc, np.full(len(numbers) - FIGURES, i))))
                figures[:, i] = numbers[:FIGURES]
                shas[i] = hashlib.sha256(whole[0]).hexdigest() if whole else ""
            keys, slot, times = np.unique(links, return_inverse=True, return_counts=True)
            own, often = np.unique(doc * max(1, len(keys)) + slot, return_counts=True)
            entries = np.bincount(own // max(1, len(keys)), minlength=len(texts))
            n_a, n_b, n_groups, n_overlaps = figures
            columns = [batch.column(0).to_pylist(), n_a, n_b, n_groups, n_overlaps, shas, keys, times, entries]
            kinds = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 3
            row = [pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]
            row += [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (own % max(1, len(keys)), often)]
            yield pa.RecordBatch.from_arrays(row, ["doc_ids", "n_a", "n_b", "n_groups", "n_overlaps", "shas", "keys", "times", "entries", "which", "often"])

    return docs.mapInArrow(run, _BATCH)


def link_counts(batches: DataFrame) -> DataFrame:
    """key, n (links in the corpus), best (whether n is the highest of the pair's id of B)."""
    counts = stage(batches.select(F.inline(F.arrays_zip("keys", "times"))).groupBy(F.col("keys").alias("key")).agg(F.sum("times").alias("n")), "alignment-counts")
    b = F.col("key").bitwiseAND((1 << SHIFT) - 1)
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most B's vocabulary
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps.

    Null and empty texts, and texts that B does not give back (those with U+2581), have zeros and the empty string. Ties for
    the highest count all are best. Repeated rows are documents of their own and count as often as they occur; a null doc_id
    stays null; long texts are aligned whole; an empty table gives no rows. Only doc_id and text are read, so other columns
    can have any name.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    batches = stage(align_batches(docs, path_a, path_b).withColumn("batch", F.monotonically_increasing_id()), "alignment")
    asked = batches.select("batch", F.posexplode("keys").alias("at", "key"))
    given = asked.join(link_counts(batches), "key").groupBy("batch").agg(F.collect_list(F.struct("at", "n", "best")).alias("counts"))
    rows = batches.drop("keys", "times").join(given, "batch", "left")

    def run(parts):
        for part in parts:
            for i in range(part.num_rows):
                row = {name: part.column(name)[i] for name in part.schema.names}
                figures = [row[name].values for name in ("doc_ids", "n_a", "n_b", "n_groups")]
                entries = row["entries"].values.to_numpy()
                which, often = (np.frombuffer(row[name].as_py(), "<i4") for name in ("which", "often"))
                n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if row["counts"].is_valid:
                    counts = row["counts"].values
                    at = counts.field("at").to_numpy()
                    n, best = (np.empty(len(at), np.int64) for _ in range(2))
                    n[at] = counts.field("n").to_numpy()
                    best[at] = counts.field("best").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(entries)), entries)
                sums = [np.zeros(len(entries), np.int64) for _ in range(2)]
                np.add.at(sums[0], doc, best[which] * often)
                np.add.at(sums[1], doc, n[which] * often)
                yield pa.RecordBatch.from_arrays(
                    [*figures, figures[3], *map(pa.array, sums), row["shas"].values, row["n_overlaps"].values],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"],
                )

    return rows.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(PATH_A), public_tokenizers.path(PATH_B))
