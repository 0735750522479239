"""Language-model scores by online logistic context mixing over bits.

A text is its tokens: lower-cased words in order and one end. Frequent words and the end have Huffman codes from the counts
of the corpus; any other word is an escape followed by its bytes and a space in a second Huffman code. Each bit is predicted
by several hashed contexts: for words the document's most frequent common word so far, the last common word, the words
before and what closed the token before; for bytes the bytes before in the word, the word so far and that common word. A mixer adds their logits with weights chosen by a
gate (place of the bit, number of contexts that have been seen) and goes on learning within a document, block by block of
its tokens in order. A last table refines the result by what bits followed such predictions.

Three passes learn, all over whole texts of training documents: exact counts of all words (a shuffle of the distinct words
of each batch); bit counts of all contexts, added up from tasks block by block; and weights with the refining table from the
documents of one training fold, which the bit counts leave out, so that they fit texts the tables have not seen. Those
documents are dealt into batches by a hash and summed in whole numbers, so nothing depends on how the input is partitioned.
Scoring is one map over the documents. Only words without a code are shuffled for their exact counts, once a batch.

Sizes: codes and counts of at most VOCABULARY words and the tables (their slots follow the number of distinct words up to
2 ** TOP each, hashed without a check of collisions, since their weights sink where collisions spoil a gate) are broadcast;
the counts of words grow with the corpus and stay distributed.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, fold, is_fold, small_batches, spans_to_rows, stage, table, texts
from cellspan.llm.huffman import canonical, code_lengths

FOLDS, HELD_OUT, TUNING = 7, 2, 3
#: Most frequent words with codes of their own.
VOCABULARY = 1 << 17
LONGEST, LETTER_LONGEST = 24, 12
COMMON, NEAR = 32, 1024
#: Beyond this depth of a code only the first two contexts are asked.
DEEP = 12
INPUTS = 5
#: Tables have 2 ** TOP slots at most, and by input 2 ** that less these.
TOP, FEWER = 21, {"word": (0, 0, 1, 1, 1), "letter": (2, 1, 1, 0, 0)}
PLACES = {"word": 12, "letter": 6}
GATES = {k: v * (INPUTS + 1) for k, v in PLACES.items()}
BLOCK = 1 << 13
DELTA, DOUBT = 0.15, 1.5
STEPS = 33
ROUND = 32  # tokens of a document between two corrections of its weights
STRENGTH = {"word": 100.0, "letter": 300.0}  # curvature that the learned weights count for when a document begins
TUNING_TOKENS = 500_000  # of a batch
TUNING_ROUND = 2_000
FIXED = 1 << 20  # sums of weights are whole multiples of 1 / FIXED
LEAST_P = 1e-6
END = b"\n"  # no word has white space
GATHER, CHUNK = 12 << 20, 1 << 19
KEY_BYTES = 32
#: Kind of a token by its last byte: 1 letter or digit, 2 sentence end, 3 comma and the like, 4 other mark.
_KIND = np.array([2 if b in b".!?" else 3 if b in b",;:" else 1 if chr(b).isalnum() or b >= 0x80 else 4 for b in range(256)], np.int64)


#: White space between words.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def key_of(word: bytes) -> bytes:
    """The word, or a digest where it is long."""
    return word if len(word) <= KEY_BYTES else b"\0" + hashlib.sha256(word).digest()


def _gathered(batches):
    """Batches of about GATHER bytes of text as (doc_ids, texts)."""
    ids, held, size = [], [], 0
    for batch in cut(batches):
        ids += batch.column(0).to_pylist()
        held += texts(batch)
        size += sum(map(len, held[-batch.num_rows :])) if batch.num_rows else 0
        if size >= GATHER:
            yield ids, held
            ids, held, size = [], [], 0
    if ids:
        yield ids, held


def _chunked(docs: list[bytes], size: int = CHUNK):
    """(first, last) of runs of documents of about that many bytes."""
    first, total = 0, 0
    for i, t in enumerate(docs):
        total += len(t)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(docs):
        yield first, len(docs)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Tokens:
    """Distinct words, the number of the word of each token, and the number of tokens of each document."""

    def __init__(self, docs: list[bytes]):
        # all texts in one array of bytes, an end after each; other white space only separates
        data = np.frombuffer(END.join([*docs, b""]).lower(), np.uint8)
        ends = np.zeros(len(data), bool)
        ends[np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1) - 1] = True
        kept = ends | ~_SPACE[data]
        begins = kept.copy()
        begins[1:] &= ends[1:] | ends[:-1] | ~kept[:-1]
        first = np.flatnonzero(begins[kept])
        self.lens = np.diff(np.flatnonzero(ends[begins]), prepend=-1)
        offsets = np.append(first, np.count_nonzero(kept)).astype("<i4")
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]).dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.each = coded.indices.to_numpy().astype(np.int64)
        last = np.frombuffer(b"".join(w[-1:] for w in self.words), np.uint8)
        self.kinds = _KIND[last]
        self._symbols: tuple = (None, None)

    def symbols(self, code: Code) -> np.ndarray:
        """The code's symbols of the distinct words, looked up once."""
        if self._symbols[0] is not code:
            self._symbols = (code, code.symbols(self.words))
        return self._symbols[1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lens)), self.lens)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its key), n: occurrences in training documents; each batch adds up its own first."""

    def run(batches):
        for ids, own in _gathered(batches):
            train = [t for t, out in zip(own, is_fold(ids, FOLDS, HELD_OUT), strict=True) if not out]
            if not train:
                continue
            tokens = Tokens(train)
            n = np.bincount(tokens.each, minlength=len(tokens.words))
            for at in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(map(key_of, tokens.words[at : at + 100_000]), pa.binary()), pa.array(n[at : at + 100_000])], ["word", "n"])

    return _texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tree:
    """A canonical prefix code as paths of numbered inner nodes."""

    def __init__(self, weights: np.ndarray, longest: int, order: np.ndarray | None = None):
        """`order`: the symbols in the order that equally long codes take."""
        lengths = code_lengths(weights, longest)
        order = np.arange(len(weights)) if order is None else order
        self.length = lengths.astype(np.int64)
        self.code = np.zeros(len(weights), np.int64)
        self.code[order] = canonical(lengths[order]).astype(np.int64)
        top = int(self.length.max())
        leaves = np.bincount(self.length, minlength=top + 1)
        closed = np.zeros(top + 1, np.int64)  # prefixes of each depth that lie at or below a leaf
        for d in range(1, top + 1):
            closed[d] = 2 * closed[d - 1] + leaves[d]
        inner = (1 << np.arange(top + 1)) - closed
        self.first = np.cumsum(inner) - inner - closed

    def path(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all bits of all symbols: which symbol (by place), depth, node and bit."""
        lens = self.length[symbols]
        own, depth = np.repeat(np.arange(len(symbols)), lens), spans_to_rows(lens)
        code, left = np.repeat(self.code[symbols], lens), np.repeat(lens, lens)
        left -= depth
        node = self.first.take(depth)
        node += code >> left
        left -= 1
        code >>= left
        code &= 1
        return own, depth, node, code


class Code:
    """Symbols 0 (escape), 1 (end) and the coded words by falling count, and the code of bytes."""

    def __init__(self, words: list[bytes], counts: list[int], others: int, ends: int):
        self.words, self.counts, self.ends = words, np.array([0, ends, *counts], np.int64), ends
        self.once = self.counts == 1
        self.once[:2] = False
        self.tree = Tree(np.array([max(1, others + int(self.once.sum())), max(1, ends), *counts], np.int64), LONGEST, self._order())
        letters = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        self.letters = Tree(np.bincount(letters, minlength=256) + 1, LETTER_LONGEST)
        self._index: dict[bytes, int] | None = None

    def _order(self) -> np.ndarray:
        """By spelling: words of one language and kind begin alike, so a context can choose among whole subtrees."""
        return np.array([0, 1, *(i + 2 for i in sorted(range(len(self.words)), key=lambda i: self.words[i]))])

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    def symbols(self, words: list[bytes]) -> np.ndarray:
        if self._index is None:
            self._index = {END: 1} | {w: i + 2 for i, w in enumerate(self.words)}
        get = self._index.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))  # a coded word is its own key


def _hashed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def _spread(node: np.ndarray) -> np.ndarray:
    return node.astype(np.uint32) * np.uint32(0x85EBCA77)


@dataclass
class Stream:
    """Bits in the order they are predicted in: by block, document, token."""

    bit: np.ndarray
    place: np.ndarray
    lane: np.ndarray
    edges: np.ndarray  # of blocks
    slots: list[np.ndarray]


def slot_bits(words: int, kind: str) -> list[int]:
    """Bits of the number of slots of each input for a corpus of so many distinct words."""
    top = min(TOP, max(14, words.bit_length() + 1))
    return [top - x for x in FEWER[kind]]


class Coder:
    """Turns documents into bits with their contexts' slots."""

    def __init__(self, code: Code, distinct: int):
        self.code = code
        self.bits = {k: slot_bits(distinct, k) for k in FEWER}
        self.bits["word"][0] = max(1, len(code.counts) - 1).bit_length()  # a slot a node

    def slots(self, kind: str) -> list[int]:
        return [1 << b for b in self.bits[kind]]

    def _slot(self, kind: str, i: int, spread: np.ndarray, context: np.ndarray) -> np.ndarray:
        """spread: the nodes as _spread has them; context is overwritten."""
        h = context
        h ^= spread
        h *= np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x27D4EB2F)
        h >>= np.uint32(32 - self.bits[kind][i])
        return h.astype(np.int64)

    def _topics(self, tokens: Tokens, rank: np.ndarray, common: np.ndarray) -> np.ndarray:
        """For each token the common word that was most frequent in the document's earlier blocks, or else the last one."""
        blocks = -(-tokens.lens // ROUND)
        first = np.cumsum(blocks) - blocks
        of = np.repeat(first, tokens.lens) + _blocks(tokens)
        known = (rank >= 0) & (rank < COMMON)
        counts = np.bincount(of[known] * COMMON + rank[known], minlength=int(blocks.sum()) * COMMON).reshape(-1, COMMON)
        upto = np.cumsum(counts, axis=0) - counts
        upto -= np.repeat(upto[first], blocks, axis=0)
        best = np.where(upto.any(axis=1), upto.argmax(axis=1) + COMMON + 1, 0)[of]
        return np.where(best > 0, best, common)

    def streams(self, tokens: Tokens, lane: np.ndarray, block: np.ndarray, new: bool = False, only: np.ndarray | None = None) -> dict[str, Stream]:
        """lane and block of each token; blocks are predicted one after the other.

        `new`: words that occur once in the training documents are spelled, as if they had not been seen; `only`: numbers
        of the tokens whose bits are wanted.
        """
        symbol_of = tokens.symbols(self.code)
        sym = symbol_of[tokens.each]
        if new:
            symbol_of = np.where(self.code.once[symbol_of], 0, symbol_of)
        coded = symbol_of[tokens.each]
        n = len(sym)
        here, start = np.arange(n), np.repeat(np.cumsum(tokens.lens) - tokens.lens, tokens.lens)
        kind = tokens.kinds[tokens.each]
        rank = sym - 2
        seen = np.maximum.accumulate(np.where((rank >= 0) & (rank < COMMON), here, -1))
        before = np.concatenate([[-1], seen[:-1]])
        inside = before >= start
        common = np.where(inside, rank[before] + 1, 0)
        topic = self._topics(tokens, rank, common)
        near = np.where((rank >= 0) & (rank < NEAR), rank + 8, kind)
        p1, p2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        p1[1:], p2[2:] = near[:-1], near[:-2]
        p1[here == start] = 0
        p2[here - start < 2] = 0
        order = np.argsort(block, kind="stable") if only is None else only[np.argsort(block[only], kind="stable")]
        last = int(block.max(initial=0)) + 1
        # words
        own, depth, node, bit = self.code.tree.path(coded[order])
        lens = self.code.tree.length[coded[order]]
        of_bits = lambda values: np.repeat(values[order], lens)
        contexts = [_hashed(topic), _hashed(common), _hashed(p1), _hashed(p1, p2)]
        spread = _spread(node)
        slots = [node, *(self._slot("word", i + 1, spread, of_bits(c)) for i, c in enumerate(contexts))]
        deep = np.flatnonzero(depth >= DEEP)
        for s in slots[2:]:
            s[deep] = 0
        bits_before = np.append(0, np.cumsum(lens))
        word = Stream(bit, np.minimum(depth, PLACES["word"] - 1), of_bits(lane), bits_before[np.searchsorted(block[order], np.arange(last + 1))], slots)
        # spelled words: contexts by letter of the distinct words, then laid out for the tokens
        odd = np.flatnonzero(symbol_of == 0)
        spelled = [tokens.words[i] + b" " for i in odd.tolist()]
        lens = np.fromiter(map(len, spelled), np.int64, len(spelled))
        data = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint32)
        place = spans_to_rows(lens)
        backs = []
        for k in range(1, 5):
            b = np.zeros(len(data), np.uint32)
            b[k:] = data[:-k] + np.uint32(1)
            backs.append(np.where(place >= k, b, np.uint32(0)))
        terms = (data + np.uint32(1)) * np.cumprod(np.full(int(lens.max(initial=1)), 0x01000193, np.uint32), dtype=np.uint32)[place]
        upto = np.cumsum(terms, dtype=np.uint32) - terms
        begins = np.cumsum(lens) - lens
        prefix = upto - np.repeat(upto[begins] if len(begins) else upto, lens) + place.astype(np.uint32)
        number = np.zeros(len(tokens.words), np.int64)
        number[odd] = np.arange(len(odd))
        who = order[coded[order] == 0]
        which = number[tokens.each[who]]
        many = lens[which]
        letter = np.repeat(begins[which], many) + spans_to_rows(many)
        token = np.repeat(who, many)
        own, _, node, bit = self.code.letters.path(data[letter].astype(np.int64))
        of, at = letter[own], token[own]
        spread = _spread(node)
        about = topic[token]
        by_letter = [_hashed(about, backs[0][letter]), _hashed(about, _hashed(*backs[:2])[letter]), _hashed(about, _hashed(*backs[:3])[letter]), _hashed(*backs)[letter], _hashed(prefix[letter], np.where(place[letter] < 4, about, 0))]
        slots = [self._slot("letter", i, spread, c[own]) for i, c in enumerate(by_letter)]
        letters = Stream(bit, np.minimum(place[of], PLACES["letter"] - 1), lane[at], np.searchsorted(block[at], np.arange(last + 1)), slots)
        return {"word": word, "letter": letters}


@dataclass
class Model:
    """All that scoring needs: the coder, logits by slot, weights by gate and the refining tables."""

    coder: Coder
    logits: dict[str, list[np.ndarray]]
    weights: dict[str, np.ndarray]
    refine: dict[str, np.ndarray]


@dataclass
class Shared:
    """A model whose large parts are broadcasts."""

    coder: object
    logits: object
    weights: dict[str, np.ndarray]
    refine: dict[str, np.ndarray]

    def open(self) -> Model:
        return Model(self.coder.value, self.logits.value, self.weights, self.refine)


def _summed(blocks: DataFrame) -> DataFrame:
    """Sums of equally long arrays of whole numbers by block, streamed in sorted order, so one sum is held at a time."""

    def run(batches):
        key, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

        for batch in batches:
            for b, size, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(raw, f"<u{size}")
                if b != key:
                    if key is not None:
                        yield row()
                    key, total = b, np.zeros(len(values), np.int64)
                total += values.astype(np.int64)
        if key is not None:
            yield row()

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, sums binary")


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """The narrowest unsigned integers that hold the counts."""
    size = next(s for s in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << (8 * s))
    return size, values.astype(f"<u{size}").tobytes()


def bit_logits(docs: DataFrame, coder) -> dict[str, list[np.ndarray]]:
    """Logits of the counts of zeros and ones in each slot over the training documents outside the tuning fold; coder is a
    broadcast. The driver gets one block of counts at a time.

    A coded word that occurs once counts as a word and as a new one, so that new words get the share of those.
    """
    layout = [(k, i, n) for k in FEWER for i, n in enumerate(coder.value.slots(k))]

    def run(batches):
        c = coder.value
        totals = {(k, i): np.zeros(2 * n, np.uint32) for k, i, n in layout}
        for ids, own in _gathered(batches):
            skip = [a or b for a, b in zip(is_fold(ids, FOLDS, HELD_OUT), is_fold(ids, FOLDS, TUNING), strict=True)]
            train = [t for t, out in zip(own, skip, strict=True) if not out]
            for a, b in _chunked(train):
                tokens = Tokens(train[a:b])
                none = np.zeros(len(tokens.each), np.int64)
                once = np.flatnonzero(c.code.once[tokens.symbols(c.code)][tokens.each])
                streams = [c.streams(tokens, none, none), *([c.streams(tokens, none, none, True, once)] if len(once) else ())]
                for k, s in ((k, s) for x in streams for k, s in x.items()):
                    for i, slot in enumerate(s.slots):
                        np.add.at(totals[k, i], slot * 2 + s.bit, np.uint32(1))
        first = 0
        for k, i, n in layout:
            own = totals[k, i]
            if k == "word" and 2 <= i:
                own[:2] = 0  # where deep bits went
            for b in range(0, 2 * n, 2 * BLOCK):
                part = own[b : b + 2 * BLOCK]
                if part.any():
                    size, raw = _packed(part)
                    yield pa.RecordBatch.from_arrays([pa.array([first + b // (2 * BLOCK)], pa.int32()), pa.array([size], pa.int8()), pa.array([raw], pa.binary())], ["block", "size", "sums"])
            first += -(-n // BLOCK)

    out = {(k, i): np.zeros(n, np.float32) for k, i, n in layout}
    where = [(k, i, b) for k, i, n in layout for b in range(0, n, BLOCK)]
    for r in _summed(_texts(docs).mapInArrow(run, "block int, size tinyint, sums binary")).toLocalIterator():
        k, i, b = where[r["block"]]
        values = np.frombuffer(r["sums"], np.int64).reshape(-1, 2)
        out[k, i][b : b + len(values)] = logits_of(values)
    return {k: [out[k, i] for i in range(INPUTS)] for k in FEWER}


def logits_of(counts: np.ndarray) -> np.ndarray:
    """What a slot says: nothing (0) where it has seen nothing, more as it has seen more."""
    n0, n1 = counts[:, 0], counts[:, 1]
    n = n0 + n1
    return (np.log((n1 + DELTA) / (n0 + DELTA)) * (n / (n + DOUBT))).astype(np.float32)


def mix(stream: Stream, logits: list[np.ndarray], weights: np.ndarray, strength, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed logit and gate of each bit, and the weights (lanes x gates x INPUTS) and curvature after the last block.

    Each lane starts with `weights`; after each block its weights move along the gradient, less as curvature adds up.
    """
    gates = len(weights)
    x = [t.take(s) for t, s in zip(logits, stream.slots, strict=True)]
    seen = np.zeros(len(stream.bit), np.uint8)
    for v in x:
        seen += v != 0
    gate = stream.place * (INPUTS + 1) + seen
    cell = stream.lane * gates + gate
    own = [np.tile(weights[:, i].astype(np.float32), lanes) for i in range(INPUTS)]
    curve = np.broadcast_to(np.asarray(strength, np.float32), gates if np.ndim(strength) else (gates,))
    curve = np.tile(curve, lanes)
    z = np.zeros(len(stream.bit), np.float32)
    for a, b in zip(stream.edges[:-1].tolist(), stream.edges[1:].tolist(), strict=True):
        if a == b:
            continue
        c = cell[a:b]
        parts = [v[a:b] for v in x]
        total = parts[0] * own[0].take(c)
        for p, w in zip(parts[1:], own[1:], strict=True):
            total += p * w.take(c)
        np.minimum(np.maximum(total, np.float32(-14), out=total), np.float32(14), out=total)
        z[a:b] = total
        chance = 1 / (1 + np.exp(-total))
        error = stream.bit[a:b] - chance
        squares = parts[0] * parts[0]
        for p in parts[1:]:
            squares += p * p
        # cells of this block only: lanes that have ended cost nothing
        low, high = int(c.min()), int(c.max()) + 1
        c = c - low
        curve[low:high] += np.bincount(c, weights=chance * (1 - chance) * squares, minlength=high - low)
        steep = np.maximum(curve[low:high], 1e-3)
        for p, w in zip(parts, own, strict=True):
            w[low:high] += (np.bincount(c, weights=error * p, minlength=high - low) / steep).astype(np.float32)
    return z, gate, np.stack(own, axis=1).reshape(lanes, gates, INPUTS), curve.reshape(lanes, gates)


def _step(z: np.ndarray) -> np.ndarray:
    """Steps of half a logit from -8 to 8."""
    return np.clip(np.rint(2 * z) + STEPS // 2, 0, STEPS - 1).astype(np.int64)


def _blocks(tokens: Tokens, size: int = ROUND) -> np.ndarray:
    return spans_to_rows(tokens.lens) // size


def mixed_streams(model: Model, docs: list[bytes], new: bool = False) -> tuple[Tokens, dict[str, tuple[Stream, np.ndarray, np.ndarray]]]:
    """Bits of some documents with their mixed logits and gates; every document adapts the weights on its own."""
    tokens = Tokens(docs)
    out = {}
    for k, s in model.coder.streams(tokens, tokens.doc, _blocks(tokens), new).items():
        z, gate, _, _ = mix(s, model.logits[k], model.weights[k], STRENGTH[k], len(docs))
        out[k] = (s, z, gate)
    return tokens, out


def log_probabilities(model: Model, docs: list[bytes]) -> tuple[Tokens, np.ndarray]:
    """log10 of the model's probability of each document."""
    tokens, mixed = mixed_streams(model, docs)
    out = np.zeros(len(docs))
    for k, (s, z, gate) in mixed.items():
        p = 1 / (1 + np.exp(-z))
        p += model.refine[k].ravel().take(gate * STEPS + _step(z)).astype(np.float32)
        p *= np.float32(0.5)
        p -= s.bit == 0  # the chance of what came
        np.abs(p, out=p)
        out += np.bincount(s.lane, weights=np.log(np.maximum(p, np.float32(LEAST_P))), minlength=len(docs))
    return tokens, out / math.log(10)


def _of_fold(docs: DataFrame, batches: int) -> DataFrame:
    """The tuning documents, dealt into batches by a hash and in a fixed order within each."""
    own = _texts(docs).where(F.coalesce(fold(F.col("doc_id"), FOLDS) == TUNING, F.lit(False)))
    keyed = own.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("batch", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(batches)))
    return keyed.repartition("batch").sortWithinPartitions("batch", "h").select("doc_id", "text", "batch")


def _by_batch(batches):
    """(number of the batch, documents) in runs of about CHUNK bytes."""
    for part in cut(batches, size=CHUNK):
        keys = part.column(2).to_numpy()
        own = texts(part)
        edges = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True):
            if b > a:
                yield int(keys[a]), own[a:b]


def _sum_cells(rows: DataFrame) -> dict[str, np.ndarray]:
    """Sums of whole numbers by (kind, cell), from tasks' (kind, cells)."""
    out = {}
    parts = rows.select("kind", F.posexplode("cells").alias("i", "v")).groupBy("kind", "i").agg(F.sum("v").alias("v"))
    for kind, values in ((r["kind"], r["v"]) for r in parts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v")).collect()):
        out[kind] = np.array([x["v"] for x in values], float)  # one entry a gate and input, or gate and step
    return out


def learn_weights(tuning: DataFrame, model: Shared) -> dict[str, np.ndarray]:
    """Each batch learns online from its documents in order; the averages of batches count by the bits each gate has seen."""

    def run(batches):
        m, key, state, totals = model.open(), None, {}, {}

        def close():
            for k, (w, seen) in state.items():
                cells = np.concatenate([np.rint(w * seen[:, None] * FIXED).ravel(), seen]).astype(np.int64)
                totals[k] = totals.get(k, 0) + cells

        for batch, own in _by_batch(batches):
            if batch != key:
                close()
                key, state = batch, {k: (m.weights[k], np.zeros(GATES[k])) for k in FEWER}
                curves = dict.fromkeys(FEWER, 1.0)
            tokens = Tokens(own)
            none = np.zeros(len(tokens.each), np.int64)
            for k, s in m.coder.streams(tokens, none, np.arange(len(tokens.each)) // TUNING_ROUND, True).items():
                w, seen = state[k]
                _, gate, after, curve = mix(s, m.logits[k], w, curves[k], 1)
                curves[k] = curve[0]
                state[k] = (after[0].astype(float), seen + np.bincount(gate, minlength=GATES[k]))
        close()
        for k, cells in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([cells], pa.list_(pa.int64()))], ["kind", "cells"])

    sums = _sum_cells(tuning.mapInArrow(run, "kind string, cells array<bigint>"))
    out = {}
    for k, before in model.weights.items():
        w, seen = np.split(sums.get(k, np.zeros(GATES[k] * (INPUTS + 1))), [GATES[k] * INPUTS])
        out[k] = np.where(seen[:, None] > 0, w.reshape(-1, INPUTS) / FIXED / np.maximum(seen, 1)[:, None], before)
    return out


def refine_tables(tuning: DataFrame, model: Shared) -> dict[str, np.ndarray]:
    """The chance of a 1 by gate and step of the mixed logit, from what followed the predictions of the final weights."""

    def run(batches):
        m, totals = model.open(), {k: np.zeros((2, GATES[k] * STEPS), np.int64) for k in FEWER}
        for _, own in _by_batch(batches):
            for k, (s, z, gate) in mixed_streams(m, own, True)[1].items():
                cell = gate * STEPS + _step(z)
                totals[k] += np.stack([np.bincount(cell[s.bit == b], minlength=GATES[k] * STEPS) for b in (0, 1)])
        for k, cells in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([cells.ravel()], pa.list_(pa.int64()))], ["kind", "cells"])

    sums = _sum_cells(tuning.mapInArrow(run, "kind string, cells array<bigint>"))
    usual = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
    out = {}
    for k in FEWER:
        n0, n1 = sums.get(k, np.zeros(2 * GATES[k] * STEPS)).reshape(2, GATES[k], STEPS)
        out[k] = (n1 + 16 * usual) / (n0 + n1 + 16)
    return out


def learned(docs: DataFrame, counts: DataFrame, n: int, v: int) -> Shared:
    """The model of the training documents; counts: their words' counts, n and v: tokens and distinct words."""
    sc = docs.sparkSession.sparkContext
    top = counts.where((F.col("word") != F.lit(END)) & (F.length("word") <= KEY_BYTES)).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    ends = next((r["n"] for r in counts.where(F.col("word") == F.lit(END)).collect()), 0)
    words, own = [bytes(r["word"]) for r in top], [r["n"] for r in top]
    coder = sc.broadcast(Coder(Code(words, own, n - ends - sum(own), ends), v))
    logits = sc.broadcast(bit_logits(docs, coder))
    tuning = stage(_of_fold(docs, max(1, n // FOLDS // TUNING_TOKENS)), "tuning")
    tuning = tuning.repartition("batch").sortWithinPartitions("batch", F.xxhash64("doc_id", "text"))
    weights = learn_weights(tuning, Shared(coder, logits, {k: np.full((GATES[k], INPUTS), 0.3) for k in FEWER}, {}))
    return Shared(coder, logits, weights, refine_tables(tuning, Shared(coder, logits, weights, {})))


FACTS = ("doc_id", "none", "n_tokens", "n_bytes", "n_known", "base", "score")


def scored(docs: DataFrame, model: Shared, n: int, v: int) -> DataFrame:
    """For each batch of documents one row with its FACTS, as far as coded words go, and for each other word in it a row
    with the documents that have it, once an occurrence."""
    names = ["batch", "word", "docs", "facts"]

    def run(batches):
        m = model.open()
        part = TaskContext.get().partitionId() << 32
        for number, (ids, own) in enumerate(_gathered(batches)):
            batch, facts, odd_words, odd_docs = part + number, [], [], []
            for a, b in _chunked(own):
                tokens, score = log_probabilities(m, own[a:b])
                doc, sym = tokens.doc, tokens.symbols(m.coder.code)[tokens.each]
                c = m.coder.code.counts[sym]
                coded = sym > 0
                base = np.log10((c + 1) / (n + v + 1))
                size = np.fromiter(map(len, tokens.words), np.int64, len(tokens.words))[tokens.each] + 1
                some = b - a
                facts.append(np.stack([np.bincount(doc, minlength=some), np.bincount(doc, weights=size, minlength=some), np.bincount(doc[coded & (c > 0)], minlength=some), np.bincount(doc, weights=np.where(coded, base, 0), minlength=some), score]))
                odd = np.flatnonzero(~coded)
                odd_words.append(pa.array(tokens.words, pa.binary()).take(pa.array(tokens.each[odd])))
                odd_docs.append(doc[odd] + a)
            coded = pa.chunked_array(odd_words, pa.binary()).combine_chunks().dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            words, each, where = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.concatenate(odd_docs)
            order = np.argsort(each, kind="stable")
            edges = np.searchsorted(each[order], np.arange(len(words) + 1))
            listed = where[order].astype("<u4")
            for at in range(0, len(words), 50_000):
                upto = min(at + 50_000, len(words))
                offsets = ((edges[at : upto + 1] - edges[at]) * 4).astype("<i4")
                lists = pa.Array.from_buffers(pa.binary(), upto - at, [None, pa.py_buffer(offsets), pa.py_buffer(listed[edges[at] : edges[upto]])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(upto - at, batch)), pa.array(map(key_of, words[at:upto]), pa.binary()), lists, pa.nulls(upto - at, pa.binary())], names)
            head = np.array([[0 if i is None else i for i in ids], [i is None for i in ids]], "<i8")
            rest = np.concatenate(facts, axis=1).astype("<f8")
            yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([head.tobytes() + rest.tobytes()], pa.binary())], names)

    return _texts(docs).mapInArrow(run, "batch long, word binary, docs binary, facts binary")


def _completed(rows: DataFrame, n: int, v: int) -> DataFrame:
    """A row for each document from (batch, docs, c, facts), sorted by batch: what words without a code add is added up."""

    def finish(facts, known, base):
        docs = len(facts) // 8 // len(FACTS)
        head, rest = np.frombuffer(facts[: 16 * docs], "<i8").reshape(2, -1), np.frombuffer(facts[16 * docs :], "<f8").reshape(5, -1)
        known, base = (np.concatenate([x, np.zeros(docs)])[:docs] for x in (known, base))
        whole = [pa.array(x.astype(np.int64)) for x in (rest[0], rest[1], rest[2] + known)]
        return pa.RecordBatch.from_arrays([pa.array(head[0], mask=head[1].astype(bool)), *whole, pa.array(rest[3] + base), pa.array(rest[4])], ["doc_id", "n_tokens", "n_bytes", "n_known", "base_score", "score"])

    def run(batches):
        key, facts, known, base = None, None, np.zeros(0), np.zeros(0)
        for part in batches:
            keys = part.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if first == last:
                    continue
                if (batch := int(keys[first])) != key:
                    if key is not None:
                        yield finish(facts, known, base)
                    key, facts, known, base = batch, None, np.zeros(0), np.zeros(0)
                docs, c, raw = (part.column(i).slice(first, last - first) for i in (1, 2, 3))
                if raw.null_count < len(raw):
                    facts = raw.drop_null()[0].as_py()
                # all words' documents of the batch at once, each with its word's count
                at = np.frombuffer(b"".join(docs.drop_null().to_pylist()), "<u4")
                c = np.repeat(c.to_numpy(), pc.fill_null(pc.binary_length(docs), 0).to_numpy(zero_copy_only=False) // 4)
                if len(at):
                    many = max(len(known), int(at.max()) + 1)
                    known, base = (np.concatenate([x, np.zeros(many - len(x))]) for x in (known, base))
                    known += np.bincount(at, weights=c > 0, minlength=many)
                    base += np.bincount(at, weights=np.log10((c + 1) / (n + v + 1)), minlength=many)
        if key is not None:
            yield finish(facts, known, base)

    return rows.repartition("batch").sortWithinPartitions("batch", "c").mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, n_known long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs.

    Null and empty texts have the end alone. Repeated rows teach and are scored as often as they occur. A null doc_id is
    not held out. Very long texts are one lane of blocks. Without training documents every count is 0 and the model is that
    of untrained predictors; an empty table gives no rows. Only doc_id and text are read, so other columns can have any name.
    """
    counts = stage(word_counts(docs), "words")
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = known["n"], known["v"]
    rows = scored(docs, learned(docs, counts, n, v), n, v)
    rows = rows.join(counts.withColumnRenamed("n", "c"), "word", "left").select("batch", "docs", F.coalesce("c", F.lit(0)).alias("c"), "facts")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    bits = -F.col("score") / (math.log10(2) * F.col("n_bytes"))
    return _completed(rows, n, v).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return score(table(spark, sf_dir, "documents"))
