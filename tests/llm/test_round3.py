"""Divergence of sources, alignment of tokenizers, main text of pages: against SQL, brute force, plain parsing, edge cases."""

import collections
import hashlib
import html
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest

from cellspan.llm import alignment, divergence, main_text, secrets, tokens
from cellspan.llm.common import small_batches

DIR = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(p) for p in (alignment.PATH_A, alignment.PATH_B)]
#: Extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, p long, q long, term string, salt int, batch long, keys string, key string, item string"
LONG = " ".join(f"w{chr(97 + i % 23)}{chr(97 + i % 19)}" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    small_batches(spark)
    rnd = random.Random(3)
    cases = [
        ("aa Bb aa bb cc", "x", "s"), ("aa Bb aa bb cc", "x", "s"), (None, "x", None), ("", "x", ""), ("aa é日 aa", "x", "t"), ("é日 cc", None, "t"), (LONG, "x", "u"), ("12 34 !", "z", "only"),
        ("É é Äa", "x", "t"), ("aa", "", "t"), (" <|endoftext|> <s> ▁x", "x", "t"), ("▁", "y", "t"), ("a  b\n c\t\x00d", "y", "é"), (" ", "y", "t"), ("\n", "y", "t"),
    ]
    cases += [(" ".join(rnd.choices(["aa", "bb", "Cc", "dd", "Ee", "ff"], k=9)), rnd.choice("xyz"), rnd.choice("stuv")) for _ in range(60)]
    return spark.createDataFrame([(i if i else None, t, lang, source, 1, 2, "t", 3, 4, "k", "l", "m") for i, (t, lang, source) in enumerate(cases)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_divergence_equals_sql(odd, none, spark):
    con = duckdb.connect()
    documents = odd.select("text", "lang", "source").toPandas()  # noqa: F841 - read by DuckDB
    want = sorted(con.sql(divergence.OP11_SQL).fetchall())
    got = divergence.divergence(odd).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == want
    assert ("z", "only", "pair") not in {r[:3] for r in want if r[3] == "only"} and any(r[:2] == ("x", "") for r in want)
    assert divergence.divergence(none).count() == 0
    assert divergence.divergence(odd, least_docs=10**6).where("value <> 0 OR part = 'term'").count() == 0


def test_divergence_in_small_blocks(odd, monkeypatch):
    want = sorted(map(tuple, divergence.divergence(odd).collect()))
    listed = [("l", [("a", 5, 1), ("b", 9, 2), ("c", 3, 1)]), ("l", [("b", 7, 2), ("c", 8, 1)])]
    spark = odd.sparkSession
    brute = collections.Counter()
    for lang, postings in listed:
        for g, pg, zg in postings:
            for h, ph, zh in postings:
                if g != h:
                    brute[lang, g, h] += (pg - ph) ** 2 // ph - (pg - zh) ** 2 // zh - (zg - ph) ** 2 // ph + (zg - zh) ** 2 // zh
    monkeypatch.setattr(divergence, "BLOCK", 1)
    found = divergence.both_sided(spark.createDataFrame(listed, "lang string, list array<struct<source: string, p: long, p0: long>>"))
    assert {tuple(r)[:3]: r["delta"] for r in found.groupBy("lang", "source", "item").sum("delta").withColumnRenamed("sum(delta)", "delta").collect()} == dict(brute)
    assert want


def test_shares_are_exact_for_large_counts(spark):
    pairs = [(1, 1), (1, 3), (2, 3), (10**14 + 7, 3 * 10**14), (8_999_999_999_999_999, 9 * 10**15), (5, 9 * 10**15)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(divergence.share(divergence.F.col("a"), divergence.F.col("b"))).collect()]
    assert got == [1 + 10**9 * a // b for a, b in pairs]


def whole(tool, text):
    """Groups and links of a text by the ends of its tokens, without owner arrays and stretches."""
    if not text:
        return None
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    bytes_a, bytes_b = [tool.bytes_a[i] for i in a], [tool.bytes_b[i] for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in t]).tolist() for t in (bytes_a, bytes_b))
    at_b = {e: i for e, i in zip(ends_b, b, strict=True)}
    groups, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    starts_a, starts_b = [0, *ends_a], [0, *ends_b]
    shared = sum(max(s, u) < min(e, v) for s, e in zip(starts_a, ends_a, strict=False) for u, v in zip(starts_b, ends_b, strict=False)) if len(a) < 500 else None
    return len(a), len(b), ";".join(groups), [(x, at_b[e]) for x, e in zip(a, ends_a, strict=True) if e in at_b], shared


def check_alignment(df, texts):
    tool = alignment.Aligner(*PATHS)
    found = {i: whole(tool, t) for i, t in texts.items()}
    counts = collections.Counter(x for r in found.values() if r for x in r[3])
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = {r["doc_id"]: r for r in df.collect()}
    assert rows.keys() == found.keys()
    for i, r in found.items():
        want = (0, 0, 0, 0, 0, 0, "") if r is None else (
            r[0], r[1], r[2].count(";") + 1, len(r[3]), sum(counts[x] == best[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(r[2].encode()).hexdigest())
        assert tuple(rows[i])[1:8] == want
        if r is None or r[4] is not None:
            assert rows[i]["n_overlaps"] == (r[4] if r else 0)


def test_alignment_of_documents(spark):
    small_batches(spark)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    check_alignment(alignment.op12_alignment(spark, DIR), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_alignment_of_odd_rows(spark, odd, none):
    check_alignment(alignment.align(odd, *PATHS), {r["doc_id"]: r["text"] for r in odd.collect()})
    assert alignment.align(none, *PATHS).count() == 0
    rows = alignment.align(spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string"), *PATHS).collect()
    assert sorted(tuple(r)[1:8] for r in rows) == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_stretches_give_the_groups_of_whole_texts():
    tool, rnd = alignment.Aligner(*PATHS, bound=300), random.Random(1)
    letters = ["a", "B", "é", " ", "  ", "\n", ".", ",", "'s", "1", "_", "\t", "́", "日", "\xa0", "Σ", "<|endoftext|>", "<s>", "<0x41>", "word", " the", "\r", "　", "🙂", "\x00", "\x85"]
    for _ in range(1500):
        text = "".join(rnd.choices(letters, k=rnd.randint(1, 30)))
        full = (" " + text).encode()
        at = [0, *alignment.cut_points(np.frombuffer(full, np.uint8)).tolist()]
        cut = [full[a:b] for a, b in zip(at, [*at[1:], len(full)], strict=True)]
        found = dict(zip(dict.fromkeys(cut), tool.stretches(list(dict.fromkeys(cut))), strict=True))
        want = whole(tool, text)
        assert b";".join(found[c][0] for c in cut).decode() == want[2]
        numbers = [np.frombuffer(found[c][1], np.int64) for c in cut]
        assert [sum(int(x[k]) for x in numbers) for k in (0, 1, 3)] == [want[0], want[1], want[4]]
        assert [(int(k) >> 32, int(k) & 0xFFFFFFFF) for x in numbers for k in x[4:]] == want[3]
        assert len(tool.memo) <= 300 and len(tool.elder) <= 300


def test_ranks_give_the_ids_of_the_tokenizer():
    tool, rnd = alignment.Aligner(*PATHS), random.Random(2)
    low = [chr(i) for i in range(0x370)]
    texts = [f" a{x}b{x} {x}{x} 1{x}" for x in low] + [" " + "".join(rnd.choices(low, k=8)) for _ in range(20_000)] + [" " + "".join(rnd.choices(" \n\t\x85\xa0\x1c'sa1.", k=8)) for _ in range(20_000)]
    texts += [" 日本  x", " <|endoftext|>", " ", " é\u0301"]
    assert tool.ids(texts)[0] == [e.ids for e in tool.a.encode_batch(texts, add_special_tokens=False)]


def test_owner_arrays():
    a, b, both = alignment.overlaps_and_cuts(np.array([2, 1, 3]), np.array([1, 2, 2, 1]))
    assert list(zip(a.tolist(), b.tolist(), both.tolist(), strict=True)) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, False), (2, 3, True)]
    assert all(len(x) == 0 for x in alignment.overlaps_and_cuts(np.zeros(0, int), np.zeros(0, int)))


def test_the_encoder_forgets():
    import pyarrow as pa

    tool = tokens.TextEncoder(PATHS[0], bound=1000)
    tool.batch(pa.array([" ".join(f"id:{i}" for i in range(20_000))]))
    tool.batch(pa.array([" ".join(f"id;{i}" for i in range(20_000))]))
    assert max(map(len, (tool.words, tool.memo, tool.elder))) <= 1000


def plain(page):
    """Main text of the tables' one layout, by its markup alone."""
    parts = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
    lines = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(filter(None, lines))


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").collect()
    got = {r["page_id"]: r for r in main_text.op13_main_text(spark, DIR).collect()}
    assert len(got) == len(pages)
    for r in pages:
        assert tuple(got[r["page_id"]]) == (r["page_id"], r["url"], plain(r["html"]), len(plain(r["html"])))


def words(n, word):
    return " ".join([word] * n)


#: Layouts that the labelled table does not have; m is main text, x is not.
HELD_OUT = {
    "theme": f"""<html><body class="single has-sidebar tag-ads"><header id=masthead class="site-header"><p>{words(8, "x")}</p><nav><ul><li><a href=/>x</a></ul></nav></header><div id=content class=site-content><main id=main>
<article id="post-5" class="post-5 post category-news tag-comments"><header class="entry-header"><h1 class="entry-title">m m m</h1><div class="entry-meta"><span>x x</span></div></header><div class="entry-content"><p>{words(50, "m")}<br>m</p>
<p>m</p><ul><li>m m<li>m <a href=x>m</a></ul><div class="sharedaddy sd-sharing"><a href=x>x</a></div><table><tr><td>m<td>m</table></div><footer>x x</footer></article><div id=comments class="comments-area"><h2>x</h2><ol><li>
<article class="comment-body"><p>{words(80, "x")}</p></article></ol><form><p>x</p><textarea>x</textarea></form></div></main></div><aside class="widget-area"><h2>x</h2><p>{words(40, "x")}</p></aside><footer>{words(20, "x")}</footer>""",
    "divs": f"""<div class=top><a href=/>x</a> | <a href=/>x x</a></div><div class=wrap><h1>m m m m</h1><p>{words(30, "m")}</p><p>m m</p><p>{words(60, "m")}</p></div><div class="cookie-banner">{words(30, "x")}</div>
<div class="reader-comments"><p>{words(40, "x")}</p></div><div id=footer>x x</div>""",
    "names": f"""<div class="l-header__inner">x x</div><div class="article__body"><p>{words(20, "m")}</p><div class="article__ad">x x x</div><p>m</p></div><div class="siteFooter">{words(20, "x")}</div>""",
    "roles": f"""<div role=navigation>x</div><div role=main><h1>m m</h1><section><h2>m</h2><p>{words(20, "m")}</p></section></div><div role=contentinfo>{words(9, "x")}</div>""",
    "header": f"""<article><header><p>x x</p><h1>m m</h1></header><p>{words(20, "m")}</p><section><p hidden>x</p><p>m</p></section></article>""",
}


@pytest.mark.parametrize("name", HELD_OUT)
def test_other_layouts(name):
    page = HELD_OUT[name]
    got = main_text.main_text(page, main_text.grow(*main_text.labelled())).split()
    assert set(got) == {"m"} and len(got) == len(re.findall(r"\bm\b", re.sub(r"<[^>]*>", " ", page)))


def test_blocks():
    page = "<p title='a>b'>one &amp; &nbsp; <b>two</b>three<!-- <p>no --> &copy four<br>five<p>six<script>var a='<p>no</p>';</script> seven<style>p{}</style><p>a < b<div class=x>eig"
    assert [b.text for b in main_text.blocks(page + "ht<p cla")] == ["one & twothree © four five", "six seven", "a < b", "eight"]
    assert [(b.words, b.linked) for b in main_text.blocks("<p>a <a href=x>b c</a> d<p><a name=y>e</a><li><a href=x>f<li>g</ul>")] == [(4, 2), (1, 0), (1, 1), (1, 0)]


def test_tree_splits_where_impurity_falls_most():
    tree = main_text.grow([(0.0, 1.0), (1.0, 1.0), (0.0, 3.0), (1.0, 3.0)], [0, 0, 1, 1])
    assert tree == (1, 2.0, 0, 1) and main_text.grow([(1.0,), (1.0,)], [0, 1]) == 1


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>{words(9, f'w{i}')}</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<<<>>>"), (3, "u", "<p"), (4, "u", long), (4, "u", long), (5, "u", "<script>" + "<" * 50_000), (6, "u", "<a " * 50_000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r["page_id"], r["url"]): r["text"] for r in main_text.extract(df).collect()}
    assert got[1, "u"] == got[2, None] == got[3, "u"] == got[5, "u"] == got[6, "u"] == "" and got[4, "u"].count("\n") == 29_999
    assert main_text.extract(df).count() == len(rows) and main_text.extract(df.limit(0)).count() == 0


def test_candidates_are_cut_at_base_spans(spark):
    assert secrets.outside(0, 100, [("hex", 30, 60), ("access", 50, 70)]) == [(0, 30), (70, 100)]
    assert secrets.outside(5, 40, [("assign", 0, 60)]) == [] and secrets.outside(5, 40, [("hex", 41, 50)]) == [(5, 40)] and secrets.outside(0, 40, [("hex", 10, 24)], 17) == []
    rnd = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    run = lambda n: "".join(rnd.choices(letters, k=n))
    rows = [(i, f"see {run(60)}AKIA{'Q2' * 9}/{run(60)} end") for i in range(300)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [[s for s in r["spans"].split(",") if s.startswith("random")] for r in got]
    assert all(r["n_access"] == 1 for r in got) and np.mean([len(f) for f in found]) > 1.5
