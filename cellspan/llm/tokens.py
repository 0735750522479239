"""Token ids of whole texts with the public tokenizers, memoised over stretches that are tokenized alike anywhere.

Both vocabularies pre-tokenize with patterns that never join a non-space character with the white space after it. A text
can therefore be cut before each run of white space, and the ids of the whole text are those of its stretches in order.
Stretches repeat, so Arrow gathers the distinct ones of a batch, a worker encodes each new one once (its memo is bounded)
and numpy lays the stored ids out again.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: UTF-8 of the white space of the pre-tokenizers' patterns besides space and line end (fixed values: Unicode White_Space).
_OTHER = rb"[\t\x0b-\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_ODD = re.compile(_OTHER)
_RUN = re.compile(rb"(?:[ \n]|" + _OTHER + rb")+")
#: A word of Latin letters, then perhaps marks that no pattern joins with a letter before them.
_WORD = re.compile(r"([ ]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)((?:[.,!|&%$*#;:?][^']*)?)\Z")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """Ids equal to Tokenizer.encode(text, add_special_tokens=False).ids, which reads the strings of special tokens as these.

    The memo has two generations of `bound` entries at most: when the younger is full it becomes the elder and the elder is
    forgotten, so what goes on being used stays.
    """

    def __init__(self, path: str, bound: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None  # of the two, the one with word ends drops case and spaces
        self.letters = byte_letters()
        self.bound = bound
        self.memo: dict[bytes, bytes] = {}
        self.elder: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _plain(self, s: str) -> bytes:
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def _kept(self, s: str, ids: bytes) -> bytes:
        """ids, remembered for s; words and marks share a bound."""
        if len(self.words) >= max(1, self.bound // 4):
            self.words.clear()
        self.words[s] = ids
        return ids

    def _word(self, s: str) -> bytes:
        """One pre-token: the model alone gives the same ids without the overhead of the whole tokenizer."""
        out = self.words.get(s)
        if out is None:
            mapped = s.replace(" ", "Ġ") if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
            out = self._kept(s, array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes())
        return out

    def stretch(self, s: str) -> bytes:
        """Ids, as little-endian uint32, of a stretch of text."""
        if m := _WORD.match(s):
            space, word, marks = m.groups()
            head = self._word(word.lower() if self.lower else space + word)
            if not marks:
                return head
            tail = self.words.get(marks)
            if tail is None:
                tail = self._kept(marks, self._plain(marks))
            return head + tail
        return self._plain(s)

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column one after the other, and how many each text has; a null text has none."""
        column = pa.array(column.cast(pa.large_string()).fill_null("").to_pylist(), pa.large_binary()) if column.offset or column.null_count else column.cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], "<i8")[: n + 1]
        total = int(offsets[-1])
        if not total:
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        data = column.buffers()[2]
        text = np.frombuffer(data, np.uint8)[:total]
        space = (text == 32) | (text == 10)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        whole = memoryview(data)[:total]
        # the first bytes of other white space; where one occurs, the text is looked at more closely
        odd = ((text >= 9) & (text <= 13) & (text != 10)) | (text == 0xC2) | ((text >= 0xE1) & (text <= 0xE3))
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1).tolist():
            a, b = int(offsets[i]), int(offsets[i + 1])
            if _ODD.search(whole[a:b]):
                begins[a:b] = False
                begins[[a + m.start() for m in _RUN.finditer(whole[a:b])]] = True
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[filled] = True
        starts = np.flatnonzero(begins)
        cuts = np.append(starts, total).astype("<i8")
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), data]).dictionary_encode()
        ends = np.frombuffer(coded.dictionary.buffers()[1], "<i8")[: len(coded.dictionary) + 1].tolist()
        pieces = coded.dictionary.buffers()[2].to_pybytes()
        keys = [pieces[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        parts = list(map(self.memo.get, keys))
        for i, part in enumerate(parts):
            if part is None:
                k = keys[i]
                old = self.elder.get(k)
                if len(self.memo) >= self.bound:
                    self.elder, self.memo = self.memo, {}
                parts[i] = self.memo[k] = self.stretch(k.decode()) if old is None else old
        lens = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        code = coded.indices.to_numpy()
        each = lens[code]
        at = np.concatenate([[0], np.cumsum(lens)])[code]
        ends = np.cumsum(each)
        ids = pool[np.repeat(at - (ends - each), each) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with id `end` after each text's ids."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1
