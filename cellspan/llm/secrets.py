"""Secret scan with a battery of randomness tests.

Fixed patterns give the base spans. Besides, every run of LEAST token characters or more is a candidate: its encoding is
inferred (digits, hex, letters, base32, base64, base64url, alphanumeric) and three tests judge it over that alphabet:
chi-squared uniformity, runs above and below the middle symbol (of letters: vowels and others), and lag-1 serial
correlation. A candidate that one of them rejects as random is out. For the rest the statistics are held against what
structured text of the same length would give: the chi-squared statistic against a noncentral law whose centre grows with
the length, and of letters alone the runs against the alternation of vowels and consonants in words; Fisher's sum puts the
two together. So short strings can't look significant by chance. Benjamini-Hochberg control then runs within strata of encoding and
length over the whole corpus: only a histogram of p-values (at most STRATA * BINS rows) reaches the driver, and its thresholds
decide which candidates become spans. Texts are read once; nothing is shuffled but the histogram.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, small_batches, stage, table

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Characters of a candidate: below that no encoding can be told from words (parameter of the method).
LEAST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
KINDS = ("assign", "access", "hex", "random")

_LOW, _HIGH = "aeiouybcdfghjklmnpqrstvwxz", "AEIOUYBCDFGHJKLMNPQRSTVWXZ"  # vowels first
#: (name, alphabet in order of value); the first that holds all characters is inferred.
ALPHABETS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", _LOW),
    ("upper", _HIGH),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_VALUES = [(i, name, {c: j for j, c in enumerate(a)}) for i, (name, a) in enumerate(ALPHABETS)]
#: Chance that two symbols of structured text agree: about that of letters in running text; of digits and hex by themselves.
AGREE = {"digits": 0.13, "hex": 0.1, "HEX": 0.1}
AGREE_TEXT = 0.065
#: Chance that a letter of a word and the next are a vowel and a consonant.
ALTERNATE = 0.7
VOWELS = 6
REJECT = 1e-3  # by one of the randomness tests
RATE = 0.01  # of false discoveries within a stratum
BINS, BIN = 400, 0.05  # of -log10 p
LENGTHS = 8
STRATA = LENGTHS * len(ALPHABETS)


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_sf(x: float, df: float) -> float:
    """Upper tail by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * df)
    return _normal_sf(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def noncentral_cdf(x: float, df: float, centre: float) -> float:
    """Lower tail of the noncentral law, by a scaled chi-squared with the same mean and variance."""
    scale = (df + 2 * centre) / (df + centre)
    return 1 - chi_squared_sf(x / scale, (df + centre) ** 2 / (df + 2 * centre)) if x > 0 else 0.0


def _tests(x: list[int], size: int, low: int) -> tuple[float, float, float, int, int]:
    """p of uniformity, runs and serial correlation, the chi-squared statistic and the number of runs; values below `low`
    are one side of the runs."""
    n = len(x)
    counts = [0] * size
    for v in x:
        counts[v] += 1
    even = n / size
    statistic = sum((c - even) ** 2 for c in counts) / even
    high = [v >= low for v in x]
    n1 = sum(high)
    n0 = n - n1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    if n0 and n1:
        mean = 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _normal_sf(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:  # all on one side
        p_runs = max(low / size, 1 - low / size) ** n
    centre = sum(x) / n
    spread = sum((v - centre) ** 2 for v in x)
    serial = sum((a - centre) * (b - centre) for a, b in zip(x, x[1:], strict=False)) / spread if spread else 1.0
    return chi_squared_sf(statistic, size - 1), p_runs, 2 * _normal_sf(abs(serial + 1 / n) * math.sqrt(n)), statistic, runs


def battery(token: str) -> tuple[int, float, float] | None:
    """(number of the encoding, least p of the three randomness tests, p of such statistics under structured text), or None
    where no encoding has all characters."""
    s = token.rstrip("=")
    found = next((v for v in _VALUES if all(c in v[2] for c in s)), None)
    if found is None or not s:
        return None
    number, name, values = found
    size, n = len(values), len(s)
    words = name in ("lower", "upper")
    p_uniform, p_runs, p_serial, statistic, runs = _tests([values[c] for c in s], size, VOWELS if words else size // 2)
    p_text = noncentral_cdf(statistic, size - 1, max(0.0, n * (size * AGREE.get(name, AGREE_TEXT) - 1)))
    if words:  # words alternate more than random letters do
        usual = 1 + (n - 1) * ALTERNATE
        p_words = 1 - _normal_sf((runs - usual) / math.sqrt((n - 1) * ALTERNATE * (1 - ALTERNATE)))
        both = math.log(max(p_text, 1e-150)) + math.log(max(p_words, 1e-150))
        p_text = math.exp(both) * (1 - both)
    return number, min(p_uniform, p_runs, p_serial), max(p_text, 10 ** -(BINS * BIN))


def stratum(encoding: int, length: int) -> int:
    """Of an encoding and a doubling of the length."""
    return encoding * LENGTHS + min(LENGTHS - 1, max(0, length.bit_length() - 5))


def p_bin(p: float) -> int:
    """Bins of p from the smallest on; a bin's largest p is 10 ** -(BIN * bin)."""
    return min(BINS, int(-math.log10(p) / BIN))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def outside(a: int, b: int, spans: list[tuple[str, int, int]], least: int = LEAST) -> list[tuple[int, int]]:
    """What spans leave of a..b, in parts of `least` characters or more."""
    out = []
    for x, y in sorted((x, y) for _, x, y in spans if x < b and a < y):
        out.append((a, x))
        a = max(a, y)
    return [(p, q) for p, q in [*out, (a, b)] if q - p >= least]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<string>, at array<bigint>, until array<bigint>, strata array<bigint>, bins array<bigint>"


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: base spans, and the candidates that pass the randomness tests with their strata and bins of p."""

    def run(batches):
        for batch in cut(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text or "")
                more = []
                for m in CANDIDATE.finditer(text or ""):
                    for a, b in outside(*m.span(), base):
                        if (judged := battery(text[a:b])) and judged[1] >= REJECT:
                            more.append((a, b, stratum(judged[0], b - a), p_bin(judged[2])))
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc_id, *n[:3], [f"{k}:{a}:{b}" for k, a, b in base], *([x[i] for x in more] for i in range(4))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.list_(pa.string())] + [pa.list_(pa.int64())] * 4, strict=True)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "at", "until", "strata", "bins"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def least_bins(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Benjamini-Hochberg within each stratum: the lowest bin whose candidates are discoveries (none: no entry)."""
    pairs = found.select(F.explode(F.arrays_zip("strata", "bins")).alias("c")).groupBy("c.strata", "c.bins").count().collect()
    out: dict[int, int] = {}
    for s in {r["strata"] for r in pairs}:
        own = sorted(((r["bins"], r["count"]) for r in pairs if r["strata"] == s), reverse=True)
        total, so_far = sum(n for _, n in own), 0
        for b, n in own:
            so_far += n
            if total * 10 ** -(BIN * b) <= rate * so_far:
                out[s] = b
    return out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row; null and empty texts have no spans.

    Repeated rows are scanned as often as they occur, and count so in the control of false discoveries; long texts are read
    whole; an empty table gives no rows; only doc_id and text are read, so other columns can have any name. Of candidates
    that overlap base spans the parts outside these are tested.
    """
    found = stage(candidates(docs), "secrets")
    least = least_bins(found, rate)

    def run(batches):
        for batch in batches:
            b = batch.to_pydict()
            shas, spans = [], []
            for base, at, until, strata, bins in zip(b["base"], b["at"], b["until"], b["strata"], b["bins"], strict=True):
                own = [(k, int(x), int(y)) for k, x, y in (s.split(":") for s in base)]
                shas.append(hashlib.sha256(_joined(own).encode()).hexdigest())
                spans.append(_joined(own + [("random", x, y) for x, y, s, p in zip(at, until, strata, bins, strict=True) if s in least and p >= least[s]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return find_secrets(table(spark, sf_dir, "documents"))
