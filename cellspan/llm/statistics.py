"""Statistics of a whole text, computed from its UTF-8 bytes with C-speed byte operations."""

from __future__ import annotations

import math
from collections import Counter

from cellspan.llm.common import SPACES

#: The contract's [#*$%&|<>].
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
UPPER = bytes(range(0x41, 0x5B))
ENDS = b".,;:!?"
CONTINUATION = bytes(range(0x80, 0xC0))


def _n(text: bytes, of: bytes) -> int:
    """How many bytes of the text are in `of`."""
    return len(text) - len(text.translate(None, of))


def repeated_windows(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of `size` words that occurs twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(i, upto)
            upto = i + size
    return total


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text) - _n(text, CONTINUATION) - _n(text, SPACES)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(words), chars, _n(text, SYMBOLS), len(lines) - len(set(lines)), repeated_windows(words)


def share(k: float, n: float) -> float:
    """Arcsine root of a share: its variance hardly depends on the share."""
    return math.asin(math.sqrt(min(1.0, k / n))) if n > 0 else 0.0


#: Repeated words come in passages: so many words are about one independent draw.
PASSAGE_WORDS = 10
#: Two-sided 95 % normal quantile.
Z = 1.96


def share_beyond_chance(k: float, n: float, draws: float) -> float:
    """Lower 95 % bound of a share seen in so many independent draws; it nears share(k, n) as the text grows."""
    return max(0.0, share(k, n) - Z / (2 * math.sqrt(draws))) if draws > 0 else 0.0


#: Names of shape(): none depends on the length of a text as such.
SHAPE = ("word_length", "symbols", "upper", "digits", "marks", "repeats", "dup_lines", "same_as_before")


def shape(text: bytes, counts: tuple[int, int, int, int, int] | None = None) -> list[float]:
    """Transformed shares of a text; an empty text has zeros."""
    n_words, chars, symbols, dup_lines, repeats = counts or base_counts(text)
    words = text.split()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = sum(1 for x in text.split(b"\n") if x.strip(SPACES))
    return [
        math.log1p(chars / n_words) if n_words else 0.0,
        share(symbols, chars),
        share(_n(text, UPPER), chars),
        share(_n(text, DIGITS), chars),
        share(_n(text, ENDS), chars),
        share_beyond_chance(repeats, n_words, n_words / PASSAGE_WORDS),
        share_beyond_chance(dup_lines, lines, lines),
        share(same, n_words),
    ]
