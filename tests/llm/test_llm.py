"""Training-data operators against brute force, exact round trips, held-out accuracy, and edge cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from cellspan.llm import chat, decontaminate, huffman, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, secrets, statistics, tokens
from cellspan.llm.common import small_batches
from tokenizers import Tokenizer

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, row string, mask string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "two words"), (5, "é 日本語 ok"), (6, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark)
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    small_batches(spark)
    return spark.createDataFrame([(i, t, None, None, 0, "x", "y", "z") for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, str(r[key]), str(r)))


# --- tokens ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memoised_ids_equal_the_tokenizer(name):
    e = tokens.TextEncoder(public_tokenizers.path(name), bound=50)
    rnd = np.random.default_rng(1)
    letters = ["a", "B", "é", " ", "  ", "\n", ".", ",", "'s", "'", "1", "_", "\t", "́", "!", "|", "日", " ", "Σ", "\x1c", "\x85", "<|endoftext|>"]
    odd = ["".join(rnd.choice(letters, rnd.integers(0, 12))) for _ in range(3000)] + ["<|endoftext|> x", "don't  stop's"]
    ids, counts = e.batch(pa.array([*odd, None, ""], pa.string()))
    want = [x.ids for x in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(odd, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] + [0, 0] and ids.tolist() == [i for w in want for i in w]


def encoded(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


# --- packing -----------------------------------------------------------------------------------------------------------


def test_packing(edge, empty):
    path = public_tokenizers.path(packing.VOCABULARY)
    got = packing.pack(edge, path).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and len(r["ids"]) == 4 * r["length"]
        by[r["doc_id"]].append(r)
    for doc, text in EDGE:
        want = encoded(packing.VOCABULARY, text, 0)
        own = sorted(by[doc], key=lambda r: r["start"])[:: 2 if doc == 4 else 1]
        assert b"".join(bytes(r["ids"]) for r in own) == want.tobytes() and own[0]["doc_tokens"] == len(want)
    assert packing.pack(empty, path).count() == 0
    special = edge.sparkSession.createDataFrame([(1, "a <|endoftext|> b<|endoftext|>")], "doc_id long, text string")
    assert b"".join(bytes(r["ids"]) for r in sorted(packing.pack(special, path).collect(), key=lambda r: r["start"])) == encoded(packing.VOCABULARY, "a <|endoftext|> b<|endoftext|>", 0).tobytes()
    assert packing.piece_lengths(2500) == [1024, 1024, 256, 128, 64, 4]


def test_pieces_lie_bucket_by_bucket(spark, docs, tmp_path):
    pieces = packing.pack(docs.limit(100), public_tokenizers.path(packing.VOCABULARY)).select("*", F.spark_partition_id().alias("part"))
    rows_ = sorted(((r["part"], r["sequence_id"], r["bucket"], r["length"]) for r in pieces.collect()))
    assert all(2**b == n for _, _, b, n in rows_) and len({b for _, _, b, _ in rows_}) > 5
    for p in {r[0] for r in rows_}:
        own = [b for part, _, b, _ in rows_ if part == p]
        assert own == sorted(own)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets" / "bucket=10"))
    assert back.count() == sum(b == 10 for _, _, b, _ in rows_) and back.where("length <> 1024").count() == 0


# --- Huffman -----------------------------------------------------------------------------------------------------------


def test_code_is_optimal_and_limited():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert int((huffman.code_lengths(counts, 32) * counts).sum()) == 363 - 0 and huffman.code_lengths(counts, 4).max() == 4
    n = huffman.code_lengths(counts, 4)
    assert sum(2.0**-int(x) for x in n if x) == pytest.approx(1)
    assert huffman.code_lengths(np.array([0, 7]))[1] == 1


def test_block_round_trip():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 5000) % 3000
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3000))
    bits, payload, points = huffman.encode_block(ids, huffman.canonical(lengths), lengths)
    out = huffman.decode_blocks([(len(ids), payload, points), (0, b"\0" * 8, b""), (len(ids), payload, points)], huffman.decode_table(lengths))
    assert [len(o) for o in out] == [5000, 0, 5000] and (out[0] == ids).all() and (out[2] == ids).all()


def test_files_round_trip(spark, edge, empty, tmp_path):
    path = public_tokenizers.path(huffman.VOCABULARY)
    huffman.write_ids(edge, path, str(tmp_path / "a"))
    got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in huffman.read_ids(spark, str(tmp_path / "a")).collect())
    at = 0
    for (start, doc, ids), want_doc in zip(got, [None, 1, 2, 3, 4, 4, 5, 6], strict=True):
        assert (start, doc) == (at, want_doc) and ids == encoded(huffman.VOCABULARY, dict(EDGE)[doc], 1).tobytes()
        at += len(ids) // 4
    huffman.write_ids(empty, path, str(tmp_path / "b"))
    assert huffman.read_ids(spark, str(tmp_path / "b")).count() == 0


# --- decontamination ---------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items, window=13):
    w = words(text)
    mask, found = [False] * len(w), set()
    for item, t in items:
        b = words(t)
        m = min(window, len(b))
        for i in range(len(b) - m + 1) if b else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    mask[j : j + m] = [True] * m
                    found.add(str(item))
    return len(w), sum(mask), sorted(found)


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_decontamination(spark, empty, block_words):
    items = [(1, "A b c d e f g h i j k l m n o"), (2, "x Y"), (3, ""), (None, "q q q"), (10, "z1 z2 z3 z4 z5 z6 z7 z8 z9 z10 z11 z12 z13 z14")]
    base = "b c d e f g h i j k l m n"
    ds = [(1, f"pad {base} pad x-y"), (2, "X, y!"), (3, None), (4, ""), (5, "q q q q"), (5, "q q q q"), (6, LONG + " " + base), (7, "z1 z2 z3 z4 z5 z6 z7 z8 z9 z10 z11 z12 z13 z14 z1 x"), (8, "clean text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, "x") for i, t in ds], "doc_id long, text string, items string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.find_hits(d, bench, block_words=block_words).collect()]
    want = []
    for i, t in ds:
        n, h, f = hits(t, [("" if k is None else k, x) for k, x in items])
        want.append((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(d, bench, block_words=block_words)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])
    assert decontaminate.find_hits(empty, bench).count() == 0
    assert decontaminate.find_hits(d, bench.limit(0)).where("n_hit > 0").count() == 0


# --- quality -----------------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_base_counts(texts):
    for t in [*(t for _, t in texts), *(t for _, t in EDGE), "a b c a b c a b", "x\n\nx\n \nx"]:
        assert statistics.base_counts((t or "").encode()) == brute_counts(t)


def test_quality_rules(docs, texts, edge, empty, spark):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = [r for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert [r["kept"] for r in quality_rules.judge(edge).where("doc_id < 6").collect()] == [False] * 6
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_good(edge).columns == edge.columns


def test_junk_with_some_symbols_is_rejected(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(3000)]

    def prose():
        return "\n".join(" ".join(rng.choice(vocabulary, 10)).capitalize() + "." for _ in range(12))

    clean = [(i, prose(), "en", "a") for i in range(600)]
    junk = []
    for i in range(30):  # 8-12 % of the characters other than white space
        t = prose()
        n = len("".join(t.split()))
        share = (0.08, 0.1, 0.12)[i % 3]
        marks = round(n * share / (1 - share))
        w = t.split(" ")
        for m in range(marks):
            w[m % len(w)] += "#*$%&|<>"[m % 8]
        junk.append((1000 + i, " ".join(w), "en", "a"))
    # fixed allowances would forgive both: 40 repeated words of 84, 3 equal lines of 4 of their kind
    passage = " ".join(rng.choice(vocabulary, 20))
    repeating = [(2000, f"{passage} {' '.join(rng.choice(vocabulary, 44))}. {passage}", "en", "a"), (2001, "\n".join(["a b"] * 4 + [" ".join(rng.choice(vocabulary, 60))]), "en", "a")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(clean + junk + repeating, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [i for i, r in got.items() if i >= 1000 and r["kept"]] == []
    assert sum(r["kept"] for i, r in got.items() if i < 1000) >= 0.99 * len(clean)
    assert quality_rules.cut_distance(0.025) ** 2 == pytest.approx(17.53, rel=0.01)


def test_mcd_resists_outliers(spark):
    rng = np.random.default_rng(5)
    d = quality_rules.D
    x = np.vstack([rng.normal(0.3, 0.05, (700, d)), rng.normal(1.2, 0.02, (300, d))])
    stats = spark.createDataFrame([(i, "en", "s", 100, 500, 0, 0, 0, False, v.tolist()) for i, v in enumerate(x)], quality_rules.STATS)
    p = quality_rules.estimates(stats).first()
    assert np.allclose(p["mean"], 0.3, atol=0.02)
    far = quality_rules.verdicts(stats, quality_rules.estimates(stats)).where("doc_id >= 700").agg(F.min("distance")).first()[0]
    assert far > quality_rules.FAR


def test_too_few_documents_for_an_estimate(spark, edge):
    rows_ = [(i, " ".join(f"word{j}" for j in range(60 + i)) + "#" * (200 if i == 2 else 0), "en", "s") for i in range(3)]
    few = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string")
    assert [(r["kept"], r["distance"]) for r in quality_rules.judge(few).collect()] == [(True, None)] * 3
    assert quality_rules.keep_good(few).count() == 3 and quality_rules.keep_good(edge.limit(0)).count() == 0


def test_kept_rows_are_those_of_the_verdicts_either_way(docs):
    kept = sorted(r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect())
    for most in (quality_rules.MOST_GROUPS, 0):
        got = quality_rules.keep_good(docs, most=most)
        assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.select("doc_id").collect()) == kept


def test_classifier_equals_the_formulas(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows_ = docs.select("doc_id", "text").collect()
    x = np.array([quality_classifier.features((r["text"] or "").encode()) for r in rows_])
    cls = np.array([y[r["doc_id"]] if r["doc_id"] in y and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 else -1 for r in rows_])
    own = x[cls >= 0]
    z = (x - own.mean(0)) / np.sqrt(np.maximum(own.var(0), 1e-8))
    n = [int((cls == k).sum()) for k in (0, 1)]
    cov = [np.cov(z[cls == k].T, bias=True) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    margin = np.full(len(x), math.log((n[1] + 1) / (n[0] + 1)))
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * pooled
        c = 0.98 * c + 0.02 * np.eye(len(c)) * np.trace(c) / len(c)
        d = z - z[cls == k].mean(0)
        margin += (1 if k else -1) * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1])
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, labels).collect()}
    assert all(got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, m)))), abs=1e-6) for r, m in zip(rows_, margin, strict=True))


def test_classifier(spark, edge, empty):
    small_batches(spark)
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = quality_classifier.op1_quality(spark, at).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    lone = labels.where("quality = 1")
    out = quality_classifier.score(edge, lone).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.score(empty, labels).count() == 0


# --- chat --------------------------------------------------------------------------------------------------------------


def test_escape_is_reversible():
    rnd = np.random.default_rng(2)
    parts = ["\\", "<", "s>", "</s>", "<s>", "[INST]", "[/INST]", "[SYS ", "[/SYS]", "[", "a", " "]
    for _ in range(3000):
        t = "".join(rnd.choice(parts, rnd.integers(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS ", "[/SYS]"))
        r = chat.Renderer(chat.instruct).add("assistant", t)
        assert chat.unescape(r.added[r.begin : r.end]) == t and not r.rewrote


def rendered(template, texts_, **options):
    r = chat.Renderer(template, **options)
    turns = [r.add(("user", "assistant")[i % 2], t) for i, t in enumerate(texts_)]
    r.close()
    return r, turns


def test_long_conversations_are_judged_by_their_whole_history():
    said = [f"text {i} " + "y" * 40 for i in range(120)]
    whole = lambda t: t([{"role": ("user", "assistant")[i % 2], "content": x} for i, x in enumerate(said)])
    numbered = lambda ms: "".join(f"{i}. {m['content']}\n" for i, m in enumerate(ms))
    first = lambda ms: "".join(f"[{ms[0]['role']}] {m['content']}\n" for m in ms)
    for template in (chat.instruct, numbered, first):  # limits within, before and behind the conversation
        for window in (100, 2000, 10**6):
            r, turns = rendered(template, said, window=window)
            assert not r.rewrites and r.checked == len(said) and "".join(t.added for t in turns) == whole(template)
            assert [t.added[t.begin : t.end] for t in turns] == said
    # rewrites what lies ten turns back, once the output is long
    far = lambda ms: "".join(("..." if len(ms) > 80 and i < len(ms) - 10 else m["content"]) + ";" for i, m in enumerate(ms))
    for window in (100, 2000, 10**6):
        assert rendered(far, said, window=window)[0].rewrites and not rendered(far, said[:60], window=window)[0].rewrites
    r, turns = rendered(chat.instruct, said, window=100, held=1500)  # more than may be held: the rest is not checked
    assert 0 < r.checked < len(said) and not r.rewrites and "".join(t.added for t in turns) == whole(chat.instruct)


def test_renderer_detects_rewriting():
    r = chat.Renderer(lambda ms: "".join(f"{m['role']}:{m['content'] if i == len(ms) - 1 else '...'};" for i, m in enumerate(ms)))
    r.add("user", "first")
    assert r.add("assistant", "second").rewrote


def test_chat(spark, tmp_path):
    small_batches(spark)
    rows_ = [(1, 1, "assistant", "</s>[INST]\\"), (1, 0, "user", "hi"), (2, 0, "tool use", None), (2, 1, None, "x"), (None, 0, "user", "n"), (3, 0, "user", "a")] + [(9, i, ("user", "assistant")[i % 2], f"turn {i} " + "z" * 500) for i in range(1500)]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")
    f = chat.format_conversations(df, piece=50_000)
    assert not f.where("rewrites").count() and f.where("conv_id = 9").count() > 1
    got = {r["conv_id"]: r for r in chat.digests(f).collect()}
    for c in {r[0] for r in rows_}:
        own = sorted(r[1:] for r in rows_ if r[0] == c)
        said = [t or "" for _, role, t in own if role == "assistant"]
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(map(len, said)) and got[c]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    cut_off = lambda ms: "".join(m["content"][: 5 if len(ms) > 3 else 50] + ";" for m in ms)
    told = {r["conv_id"]: r["rewrites"] for r in chat.rewriting(chat.format_conversations(df, cut_off, piece=1000)).collect()}
    assert told[9] and not told[1]


# --- language model ----------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, texts, edge, empty):
    got = {r["doc_id"]: r for r in mixing.score(docs).collect()}
    counts = collections.Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        w = [*(t or "").encode().lower().split(), b"\n"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0
    assert 0 < np.mean([r["bits_per_byte"] for r in got.values()]) < 4
    other = {r["doc_id"]: r["score"] for r in mixing.score(docs.repartition(7)).collect()}
    assert all(other[i] == pytest.approx(r["score"], rel=1e-6) for i, r in got.items())  # however documents are dealt
    assert sorted(str(r["doc_id"]) for r in mixing.score(edge).collect()) == sorted(str(i) for i, _ in EDGE)
    assert mixing.score(empty).count() == 0


@pytest.fixture(scope="module")
def prose(spark):
    """Two invented languages with words that follow one another."""
    rng = np.random.default_rng(12)
    words_ = [["".join(rng.choice(list("abcdefghij" if k else "klmnopqrst"), rng.integers(2, 8))) for _ in range(300)] for k in (0, 1)]
    follow = [rng.integers(0, 300, (300, 4)) for _ in (0, 1)]
    out = []
    for i in range(500):
        k, at, said = i % 2, int(rng.integers(300)), []
        for _ in range(150):
            said.append(words_[k][at])
            at = int(follow[k][at][rng.integers(4)]) if rng.random() < 0.9 else int(rng.integers(300))
        out.append((i, " ".join(said)))
    return spark.createDataFrame(out, "doc_id long, text string").persist()


def test_held_out_scores_beat_the_base(prose):
    held = mixing.score(prose).where("held_out").collect()
    assert len(held) > 40 and np.mean([r["score"] > r["base_score"] for r in held]) > 0.95
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


@pytest.fixture(scope="module")
def model(prose):
    small_batches(prose.sparkSession)
    counts = mixing.word_counts(prose).persist()
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    return mixing.learned(prose, counts, n, v).open()


def test_codes_are_complete(model):
    for tree in (model.coder.code.tree, model.coder.code.letters):
        used = tree.length[tree.length > 0]
        assert sum(2.0 ** -int(x) for x in used) == pytest.approx(1)
        _, depth, node, _ = tree.path(np.flatnonzero(tree.length))
        assert len({(d, x) for d, x in zip(depth.tolist(), node.tolist(), strict=True)}) == len(used) - 1 == int(node.max()) + 1


def test_mixing_equals_one_bit_after_the_other(model, prose):
    own = [r["text"].encode() for r in prose.limit(3).collect()] + [b"zzz unseen kl.", b""]
    tokens, got = mixing.log_probabilities(model, own)
    sig = lambda x: 1 / (1 + math.exp(-x))
    for d, text in enumerate(own):
        alone = mixing.Tokens([text])
        streams = model.coder.streams(alone, alone.doc, mixing._blocks(alone))
        total = 0.0
        for k, s in streams.items():
            weights = {g: model.weights[k][g].astype(float).copy() for g in range(mixing.GATES[k])}
            curve = dict.fromkeys(weights, mixing.STRENGTH[k])
            for a, b in zip(s.edges[:-1].tolist(), s.edges[1:].tolist(), strict=True):
                gradient, more = collections.defaultdict(lambda: np.zeros(mixing.INPUTS)), collections.Counter()
                for j in range(a, b):
                    x = np.array([float(model.logits[k][i][s.slots[i][j]]) for i in range(mixing.INPUTS)])
                    g = int(s.place[j]) * (mixing.INPUTS + 1) + int((x != 0).sum())
                    z = max(-14.0, min(14.0, float(x @ weights[g])))
                    p = (sig(z) + model.refine[k][g, max(0, min(mixing.STEPS - 1, round(2 * z) + mixing.STEPS // 2))]) / 2
                    total += math.log10(max(p if s.bit[j] else 1 - p, mixing.LEAST_P))
                    gradient[g] += (s.bit[j] - sig(z)) * x
                    more[g] += sig(z) * (1 - sig(z)) * float(x @ x)
                for g in gradient:
                    curve[g] += more[g]
                    weights[g] = weights[g] + gradient[g] / curve[g]
        assert got[d] == pytest.approx(total, rel=2e-3)


def test_contexts_look_back_in_the_text(model):
    def slots(text, kind, token):
        t = mixing.Tokens([text])
        s = model.coder.streams(t, t.doc, np.arange(len(t.each)))[kind]
        return [tuple(x[s.edges[token] : s.edges[token + 1]].tolist()) for x in s.slots]

    w = model.coder.code.words
    common, rare = w[0].decode(), w[200].decode()
    a, b = slots(f"{common} {rare} {w[1].decode()}".encode(), "word", 2), slots(f"{w[2].decode()} {rare} {w[1].decode()}".encode(), "word", 2)
    assert a[0] == b[0] and a[3] == b[3] and a[1] != b[1] and a[2] != b[2] and a[4] != b[4]
    c, d = slots(b"qqabcd", "letter", 0), slots(b"rrabcd", "letter", 0)
    assert c[1][-3:] == d[1][-3:] and c[3][-3:] == d[3][-3:] and c[4][-3:] != d[4][-3:]


def test_counts_beyond_small_integers():
    size, raw = mixing._packed(np.array([0, 1 << 33], np.int64))
    assert size == 8 and np.frombuffer(raw, "<u8").tolist() == [0, 1 << 33] and mixing._packed(np.array([255]))[0] == 1


# --- near duplicates ---------------------------------------------------------------------------------------------------


def brute_classes(texts, least=0.8):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)]))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both and both >= least * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                parent[find(i)] = find(j)
    out = collections.defaultdict(list)
    for i in range(len(sets)):
        out[find(i)].append(i)
    return sorted(sorted(str(texts[i][0]) for i in c) for c in out.values())


def test_dart_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    a = {i: float(x) for i, x in enumerate(rng.uniform(0.2, 6, 300))}
    b = {i: (x if i < 200 else float(rng.uniform(0.2, 6))) for i, x in a.items()}
    true = sum(min(a[i], b[i]) for i in a) / sum(max(a[i], b[i]) for i in a)
    doc, element, weight = np.repeat([0, 1], 300), np.tile(np.arange(300).astype(np.uint64), 2), np.array([*a.values(), *b.values()])
    s = near_dedup.dart_signatures(doc, near_dedup.mix64(element), weight, 2, k=3000)
    assert abs((s[0] == s[1]).mean() - true) < 0.03


def test_near_duplicates(spark, texts, edge, empty):
    rng = np.random.default_rng(6)
    base = [f"t{i}" for i in range(150)]
    near = []
    for i in range(60):  # a family with every degree of change
        w = list(base)
        for j in rng.choice(150, i % 12, replace=False):
            w[j] = f"n{i}x{j}"
        near.append((1000 + i, " ".join(w)))
    every = [*texts[:120], *near, (5000, near[0][1]), (5001, "a b"), (5002, "A  b!"), (5003, None), (5004, "")]
    df = spark.createDataFrame(every, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in near_dedup.near_duplicates(df).collect():
        got[r["class_id"]].append(str(r["doc_id"]))
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    assert sorted(map(sorted, got.values())) == brute_classes(every)
    one = near_dedup.keep_one(edge)
    assert one.columns == edge.columns and one.count() == 5
    assert near_dedup.near_duplicates(empty).count() == 0


def test_many_short_texts_at_once():
    many = [f"a{i} b c d e f".encode() for i in range(20_000)]
    doc, element, count = near_dedup.shingles(many)
    assert np.bincount(doc).tolist() == [2] * 20_000 and len(set(element.tolist())) == 20_001 and set(count.tolist()) == {1}


def test_a_large_group_of_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(100))
    n = 30_000
    group = spark.range(n).select(F.col("id").alias("doc_id"), F.replace(F.concat(F.lit(base), F.lit(" ")), F.concat(F.lit("w"), (F.col("id") % 100).cast("string"), F.lit(" ")), F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(" "))).alias("text"))
    other = spark.range(10).select((F.col("id") + n).alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"x{i}y"), F.col("id").cast("string")) for i in range(40))).alias("text"))
    got = near_dedup.near_duplicates(group.unionByName(other)).groupBy("class_id").count().collect()
    assert sorted((r["class_id"], r["count"]) for r in got) == [(0, n), *((n + i, 1) for i in range(10))]


# --- secrets -----------------------------------------------------------------------------------------------------------


def test_secrets(spark, empty):
    rng = np.random.default_rng(8)
    pick = lambda a, n: "".join(rng.choice(list(a), n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key, blob = pick("0123456789abcdef", 40), pick(letters, 64)
    natural = "thequickbrownfoxjumpsoverthelazydog1andrunsaway2thequickbrownfox"
    ds = [(1, f'Token = "{key}" x'), (2, f"see {blob} end"), (3, f"see {natural} end"), (4, None), (5, "AKIA" + "A1" * 9), (6, "password: abc"), (7, "api_key=abcdef."), (8, "1234567890123456789012345678901234567890")]
    df = spark.createDataFrame([(i, t, "x") for i, t in ds], "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in secrets.find_secrets(df).collect()}
    assert got[1]["spans"] == "assign:0:49,hex:9:49" and (got[1]["n_assign"], got[1]["n_hex"]) == (1, 1)
    assert got[2]["spans"] == "random:4:68" and got[3]["spans"] == "" and got[4]["spans"] == ""
    assert got[5]["n_access"] == 1 and got[6]["n_assign"] == 0 and got[7]["spans"] == "assign:0:15"
    assert got[8]["spans"] in ("", "hex:0:40")
    for r in got.values():
        base = ",".join(s for s in r["spans"].split(",") if s and not s.startswith("random"))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert secrets.find_secrets(empty).count() == 0


KINDS = {
    "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def test_planted_tokens_are_found_and_structured_ones_are_not(spark):
    rng = np.random.default_rng(21)
    planted, plain = {}, []
    for kind, alphabet in KINDS.items():
        for _ in range(40):
            i = len(planted)
            planted[i] = (kind, "".join(rng.choice(list(alphabet), 64 if kind in ("lower", "upper", "base32") else 40)))
    syllables = ["ta", "re", "mi", "lo", "con", "ver", "sa", "tion", "ment", "er", "ing", "pro", "de", "in", "ble"]
    for i in range(200):
        parts = ["".join(rng.choice(syllables, 3)) for _ in range(6)]
        plain.append((1000 + i, ["".join(parts), "_".join(parts[:4]) + "_count", "/usr/share/" + "/".join(parts[:3]), "get" + "".join(p.capitalize() for p in parts[:3]) + "Value2", f"https://www.{parts[0]}.org/{parts[1]}/{parts[2]}-index"][i % 5]))
    df = spark.createDataFrame([(i, f"see {t} here") for i, (_, t) in planted.items()] + [(i, f"see {t} here") for i, t in plain], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(df).collect()}
    for kind in KINDS:
        own = [i for i, (k, _) in planted.items() if k == kind]
        assert np.mean([bool(got[i]) for i in own]) >= 0.9, kind
    assert sum(bool(got[i]) for i, _ in plain) <= 3


def test_base_spans_equal_plain_patterns(spark, texts):
    plain = (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))
    odd = [(9001, 'Api_Key : "abc.def=" token=short TOKEN=sixsix AKIA' + "Z" * 16 + " " + "0f" * 12 + "é" + "a" * 23), (9002, None), (9003, "x" * 100_000 + " secret=abcdef")]
    rows_ = [*texts, *odd, odd[0]]
    want = sorted((str(i), ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(plain) for m in re.finditer(p, t or "") if ok(m)))) for i, t in rows_)
    got = secrets.find_secrets(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    base = sorted((str(r["doc_id"]), ",".join(x for x in r["spans"].split(",") if x and not x.startswith("random"))) for r in got)
    assert base == want
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == [(i, hashlib.sha256(x.encode()).hexdigest()) for i, x in want]


def test_false_discovery_control_equals_the_step_up_rule(spark):
    rng = np.random.default_rng(9)
    bins = np.concatenate([rng.integers(0, 40, 500), rng.integers(60, 120, 30)])
    found = spark.createDataFrame([(i, [3], [int(b)]) for i, b in enumerate(bins)], "doc_id long, strata array<bigint>, bins array<bigint>")
    p = np.sort(10 ** -(secrets.BIN * bins.astype(float)))
    passed = [i for i in range(len(p)) if p[i] <= 0.01 * (i + 1) / len(p)]
    assert sum(bins >= secrets.least_bins(found)[3]) == max(passed) + 1


# --- personal data -----------------------------------------------------------------------------------------------------


def test_pii(spark, empty):
    long = "x " * 50_000 + "call 555-123-4567"
    ds = [(1, "Mail Jo.78@a.example.org or jo.78@A.example.org; call +1 (243) 555-5526 or +1-243-555-5526."), (2, "Card 4111111111111111 and 4111-1111-1111-1111."), (3, "IP 83.229.25.121 and 10.1.2.3"), (4, "Frau Anna Schmidt, Mr. John Smith, Госпожа Иванова"), (5, None), (6, ""), (7, "plain 12"), (8, "jo.78@a.example.org"), (8, "jo.78@a.example.org"), (None, "jo.78@a.example.org"), (9, long)]
    df = spark.createDataFrame([(i, t, 3, "keep", "p", "n") for i, t in ds], "doc_id long, text string, n_chars long, row string, parts string, new string")
    out = pii.replace_pii(df, "k")
    rows_ = out.collect()
    got = {r["doc_id"]: r for r in rows_}
    assert out.columns == df.columns and len(rows_) == len(ds) and all(r["row"] == "keep" and r["parts"] == "p" for r in rows_)
    assert got[5]["text"] is None and got[6]["text"] == "" and got[7]["text"] == "plain 12" and got[9]["text"].startswith("x x ") and len(got[9]["text"]) == len(long) and "555-123-4567" not in got[9]["text"]
    mails = re.findall(r"\S+@[\w.]+\w", got[1]["text"])
    assert len(set(mails)) == 1 and mails[0] == got[8]["text"] == got[None]["text"] and mails[0].endswith(".example.org")
    a, b = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1-\d{3}-\d{3}-\d{4}", got[1]["text"])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "12435555526"
    c, d = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", got[2]["text"])
    digits = [int(x) for x in c]
    assert d.replace("-", "") == c != "4111111111111111" and sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"IP (\d+\.){3}\d+ and 10\.\d+\.\d+\.\d+", got[3]["text"]) and "83.229" not in got[3]["text"]
    assert re.fullmatch(r"Frau \w+na \w+, Mr\. \w+nd \w+, Госпожа [А-Яа-я]+", got[4]["text"]) and got[4]["n_chars"] == len(got[4]["text"])
    assert pii.replace_pii(empty, "k").count() == 0
    assert pii.replace_pii(df, "other").where("doc_id = 8").first()["text"] != got[8]["text"]
    with pytest.raises(ValueError, match="key"):
        pii.replace_pii(df, "")


def test_persons_stay_themselves(spark):
    ds = [(1, "Mr. John Smith met Dr. Ana Kovac. John Smith, SMITH and Mrs. Ana Kovac left; Smith's hat. John too."), (2, "Prof. Smith of nowhere. smith lower"), (3, "John and Smith without a title")]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(ds, "doc_id long, text string"), "k").collect()}
    m = re.fullmatch(r"Mr\. (\w+nd) (\w+) met Dr\. (\w+na) (\w+)\. (\w+) (\w+), (\w+) and Mrs\. (\w+) (\w+) left; (\w+)'s hat\. (\w+) too\.", got[1])
    john, smith, ana, kovac = m.groups()[:4]
    assert m.groups()[4:] == (john, smith, smith.upper(), ana, kovac, smith, john) and len({john, smith, ana, kovac}) == 4
    assert got[2] == f"Prof. {smith} of nowhere. smith lower" and got[3] == ds[2][1]


def test_every_entity_goes_and_all_else_stays(spark, docs):
    import regex

    pattern = regex.compile("|".join(f"(?:{p})" for p in pii.KINDS.values()))
    before = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    after = {r["doc_id"]: r["text"] or "" for r in pii.replace_pii(docs.select("doc_id", "text"), "k").collect()}
    seen = {}
    for i, text in before.items():
        if regex.search(pii.PERSON, text):
            continue
        found = [m[0] for m in pattern.finditer(text)]
        gaps = pattern.split(text)
        new = regex.fullmatch("(.*?)".join(map(regex.escape, gaps)), after[i], regex.DOTALL)
        assert new is not None and len(new.groups()) == len(found)
        for old, own in zip(found, new.groups(), strict=True):
            assert old.lower() != own.lower() and seen.setdefault(old, own) == own
    assert len(seen) > 10 and len(set(seen.values())) == len(seen)


def test_numbers_are_permuted(spark):
    c = lambda s: F.col("id").cast("string") if s is None else F.lpad(F.col("id").cast("string"), s, "0")
    for made, keep in ((lambda: pii._permuted(c(4), "k", "ssn"), r"\d{4}"), (lambda: pii._phone(F.concat(F.lit("+49"), c(4)), "k"), r"\+49\d{4}"), (lambda: pii._card(F.concat(F.lit("4"), c(4), F.lit("7")), "k"), r"4\d{5}")):
        out = [r[0] for r in spark.range(10_000).select(made()).collect()]
        assert len(set(out)) == 10_000 and all(re.fullmatch(keep, x) for x in out)
    ips = spark.range(1 << 16).select(F.concat(F.lit("192.168."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("ip"))
    out = ips.select("ip", pii._ip(F.col("ip"), "k").alias("o")).collect()  # every address of the range is taken
    assert len({r["o"] for r in out}) == 1 << 16 and all(r["o"].startswith("192.168.") and r["o"] != r["ip"] for r in out)
    for ip, own in (("172.20.1.1", lambda a: a[0] == 172 and 16 <= a[1] < 32), ("8.8.8.8", lambda a: 0 < a[0] < 224 and a[0] not in (10, 127)), ("127.0.0.1", lambda a: a[0] == 127)):
        new = spark.range(1).select(pii._ip(F.lit(ip), "k")).first()[0]
        assert new != ip and own([int(x) for x in new.split(".")])


def test_accounts_keep_valid_check_digits(spark):
    valid = lambda iban: int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1
    for iban in ("GB82WEST12345698765432", "DE89370400440532013000", "DE00370400440532013000"):
        new = spark.range(1).select(pii._iban(F.lit(iban), "k")).first()[0]
        assert new[:2] == iban[:2] and new != iban and len(new) == len(iban) and valid(new) == valid(iban) and [ch.isdigit() for ch in new] == [ch.isdigit() for ch in iban]


def test_pii_names_are_the_same_in_all_documents(spark):
    """Titles that differ between documents: one ending, that of neither gender where both are told."""
    import regex

    texts = ["Dr. Ana Kovac came.", "Mrs. Ana Kovac came.", "Mr. Kim Olsen came.", "Ms. Kim Olsen came.", "Mr. Bo Olsen came.", "Mr. Olsen and Mrs. Ana went.", None, ""]
    got = [r["text"] for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    names = [regex.findall(r"\p{Lu}\p{L}{5,}", t or "") for t in got]
    assert names[0] == names[1] and names[0][0].endswith("na") and len(names[0][0]) == 14
    assert names[2] == names[3] and names[2][0].endswith("nt") and names[4][0].endswith("nd")
    assert names[2][1] == names[4][1] == names[5][0] and names[5][1] == "".join(names[0][:1])
    assert got[6] is None and got[7] == "" and len({names[0][0], names[0][1], names[2][0], names[2][1], names[4][0]}) == 5


def test_pii_collisions_are_resolved(spark, monkeypatch):
    plain = pii._hash
    # with one value of the hash for first attempts, these must clash
    monkeypatch.setattr(pii, "_hash", lambda key, *parts: F.when(parts[-1] == "0", F.sha2(F.lit("same"), 512)).otherwise(plain(key, *parts)))
    df = spark.createDataFrame([(i, f"Mr. Name{'abcde'[i % 5]} wrote p{i % 5}@x.org") for i in range(20)], "doc_id long, text string")
    out = [r["text"] for r in pii.replace_pii(df, "k").orderBy("doc_id").collect()]
    assert len(set(out)) == 5 and out[:5] * 4 == out and not any("Name" in t or re.search(r"p\d@", t) for t in out)
    assert len({t.split()[1] for t in out}) == 5 and len({t.split()[3] for t in out}) == 5


# --- pipeline and SQL --------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    small_batches(spark)
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    a = cp.quality(spark, docs, DIR)
    assert {r["doc_id"] for r in a.collect()} == kept and a.columns == docs.columns
    out = cp.run(spark, DIR)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids and ids <= kept
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "packing"]


def test_pipeline_stages_on_odd_rows(spark, edge, tmp_path):
    import corpus_pipeline as cp

    good = " ".join(f"clean{i}" for i in range(80))
    own = spark.createDataFrame([(20, good, None, "s", 1, "a", "b", "c"), (20, good, None, "s", 1, "a", "b", "c"), (None, good + " more", "en", None, 2, None, None, None)], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs_ in (edge.unionByName(own), edge.limit(0)):
        now, counts = docs_, []
        for name, function in cp.STAGES[:-1]:
            now = function(spark, now, str(tmp_path))
            assert now.columns == docs_.columns, name
            counts.append(now.count())
        last = cp.STAGES[-1][1](spark, now, str(tmp_path))
        assert counts == ([3, 1, 1, 1] if docs_.count() else [0, 0, 0, 0])  # two equal rows and a near one
        assert [r["doc_id"] for r in last.select("doc_id").distinct().collect()] == ([20] if counts[0] else [])


@pytest.mark.parametrize("name", ["op3_decontaminate", "op7_chat"])
def test_sql(spark, name):
    from cellspan.llm.registry import QUERIES, SQL

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), c.sql(SQL[name]).df()[list(QUERIES[name](spark, DIR).columns)]
    key = got.columns[0]
    assert (got.sort_values(key).astype(str).to_numpy() == want.sort_values(key).astype(str).to_numpy()).all()
