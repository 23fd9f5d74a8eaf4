"""Each operator against a plain version of itself, on fixtures and on tables with nulls, empty and long texts, ties, repeated rows, no rows, and extra columns whose names an operator might use itself."""

import hashlib
import html
import json
import random
import re
from collections import Counter

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import common, op1_html, op2_suffix, op3_decontaminate, op4_embeddings, op5_minhash, op6_langid, op7_urls, op8_tokens, op9_shards, op10_bpe, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = DOCS + ", i long, t string, key long, doc long, row string, bucket int, kind int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def odd_rows():
    r = random.Random(5)
    base = " ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(120))
    long = " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(4000))
    texts = [None, "", " ", "a", "x y", base, base, base + " tail", "head " + base, base.upper(), long, "é" * 300, "aaaa" * 200, "\x00\x01 \t\n", "line\n" * 60, base[:99], base[:100], "<|endoftext|> a", "😀 ü" * 40]
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[5], (5, "another text for the same id", "en", "s", 1), (None, base, "en", "s", 2), (None, None, None, None, None)]
    return [x + (1, "t", 2, 3, "row", 4, 5) for x in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name]))


def test_op1_articles(spark, duck):
    got = {r.page_id: r for r in queries.QUERIES["op1_html"](spark, SF).collect()}
    for i, page in duck.sql("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(p for p in parts if p)
        assert (got[i].text, got[i].n_chars) == (want, len(want))


def test_op1_odd_pages(spark, none):
    pages = [
        (1, "http://a.b/x", None),
        (2, None, ""),
        (3, "no scheme", "plain &lt;text&gt; <b>bold</b>\n more"),
        (4, "http://a.b/y", "<body><div id=sidebar>menu</div><p>a <b>c</b><span class='share'>x</span> d &amp; e&nbsp;f<ul><li>1<li>2</ul><main><header><h1>T</h1></header><p>one<br>two<p>three<section class=comments><p>hi</section></main><script>if(a<b)'</p>'</script>"),
        (5, "http://a.b/z", "<p>open <!-- never closed"),
        (6, "http://a.b/z", "<p>" + "long " * 50_000),
    ]
    df = spark.createDataFrame([p + ("h", "t") for p in pages], "page_id int, url string, html string, host string, t string")
    got = {r.page_id: r.text for r in op1_html.extract_text(df, keep=["page_id", "host"]).collect()}
    assert got == {1: "", 2: "", 3: "plain <text> bold more", 4: "a c\nd & e f\n1\n2\nT\none two\nthree", 5: "open", 6: ("long " * 50_000).strip()}
    assert op1_html.extract_text(df.limit(0)).count() == 0


def test_op1_names():
    def kept(page):
        return [t for _, noise, _, t in op1_html.blocks(page) if not noise]

    assert kept("<article><header class='article-header'><h1>T</h1></header><div class=commentList>c</div><p>x</p></article>") == ["T", "x"]
    assert kept("<div class='cookieBanner'>c</div><div class=header>h</div><div class=content>x</div><form>f</form><aside>s</aside>") == ["x"]


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "page-with-toc", "post no-comments", "row right-side"])
def test_op1_names_are_whole_tokens(name):
    assert [(noise, t) for _, noise, _, t in op1_html.blocks(f"<div class='{name}'><p>x</p></div>")] == [(0, "x")]


def test_op1_noise_names_still_count():
    for name in ("sidebar", "left-sidebar", "site-nav", "comment-list", "ad", "ad-1", "navbar", "side"):
        assert [noise > 0 for _, noise, _, _ in op1_html.blocks(f"<div class='{name}'>x</div>")] == [True], name


def test_op1_article_takes_names_back():
    def kept(page):
        return [t for _, noise, _, t in op1_html.blocks(page) if not noise]

    assert kept("<div class=overlay><article><p>x</p><div class=comments>c</div></article></div>") == ["x"]
    assert kept("<form id=f><div class=sidebar>s</div><div role=main>x</div></form>") == ["x"]
    assert kept("<aside><article>other</article></aside><div hidden><main>h</main></div>") == []


def test_op1_tree_removes_what_repeats(spark):
    rows = [(k, "http://h.com/p", f"<body><div class=x>same on all</div><div class=y>own text number {k} {hash(str(k))}</div></body>") for k in range(40)]
    got = [r.text for r in op1_html.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()]
    assert all(t.startswith("own text") and "same" not in t for t in got)


@pytest.mark.parametrize("pages, copies", [(1, 8), (2, 5), (3, 34)])
def test_op1_copies(spark, pages, copies):
    """Copies of a page are no evidence against its text, whatever their number."""
    rows = [(k, f"http://h.com/p?{k}", f"<body><script>var k={k}</script><div class=x><p>the text of page {k % pages}</p></div></body>") for k in range(pages * copies)]
    got = {r.page_id: r.text for r in op1_html.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {k: f"the text of page {k % pages}" for k in range(pages * copies)}


def texts_of(spark, rows):
    return {r.page_id: r.text for r in op1_html.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}


def test_op1_tags():
    def shown(page):
        return [t for _, noise, _, t in op1_html.blocks(page) if not noise]

    assert shown("<p>a<svg width=1 /> b</p><p>c<svg><path/></svg>d</p><math/><p>e") == ["a b", "cd", "e"]
    assert shown("<p>a <a href=\"x>b</a> c</p><p class=\"y\">d</p>") == ["a b c", "d"]
    assert shown("<p>a <a title='x>b</a> c</p><p>d") == ["a b c", "d"]
    assert shown("<p title=\"1 > 0\">a</p><p title='it is 0 < 1'>b") == ["a", "b"]
    assert shown("<div class='post-header'><h1>T</h1></div><p>x <b y") == ["T", "x"]


@pytest.mark.parametrize("piece", ["<a ", "<a href=\"", "<a href='x>", "<div>", "<b>", "</p>", "<li>", "<div><p>", "<!--", "<![CDATA[", "<ul><li><div>", "<div class=x>y", "<svg>", "&amp;<"])
def test_op1_long_broken_pages(piece):
    import time

    began = time.perf_counter()
    op1_html.blocks(piece * 60_000)
    assert time.perf_counter() - began < 20


def test_op1_named_wrapper(spark):
    """A site without article or main elements whose pages stand whole under a name: the name is outvoted, and a menu is not."""
    rows = [(k, f"http://h.com/{k}", f"<body><div class=sidebar><h1>Title {k}</h1><p>{'own words of page ' * 9}{k}</p></div><div class=menu><a href=x>menu {k}</a></div></body>") for k in range(12)]
    assert texts_of(spark, rows) == {k: f"Title {k}\n{'own words of page ' * 9}{k}" for k in range(12)}
    rows += [(99, "http://h.com/z", "<article>" + "elsewhere " * 3 + "</article>")]
    assert texts_of(spark, rows)[99] == ("elsewhere " * 3).strip()


def test_op1_without_article(spark):
    """Names of no meaning: what repeats goes, with its whole branch, and what differs stays, on hosts of any size above a few pages."""
    page = "<body><div class=a1><div><ul><li>Home<li>News<li>About</ul></div><div>Sign up for our letters</div></div><div class=b2><h2>Story {k}</h2><p>Words {w}</p><p>More {w} and {k}</p></div><div class=c3>All rights reserved</div></body>"
    rows = [(100 * n + k, f"http://h{n}.com/{k}", page.format(k=k, w=" ".join(f"w{k * 31 + j}" for j in range(9)))) for n in (6, 20) for k in range(n)]
    got = texts_of(spark, rows)
    for i, _, html_ in rows:
        k = i % 100
        w = " ".join(f"w{k * 31 + j}" for j in range(9))
        assert got[i] == f"Story {k}\nWords {w}\nMore {w} and {k}"


def test_op1_tree_plainly(spark):
    """Importance of every node against sums over plain dictionaries."""
    import math

    r = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for k in range(30):
        parts = "".join(f"<div class={r.choice('pq')}>{r.choice(words)}<p>{r.choice(words)} {r.choice(words)}</p></div>" for _ in range(r.randrange(1, 4)))
        rows.append((k, f"http://h{k % 2}.com/{k}", f"<body><div class=x>same</div>{parts}<article><p>{r.choice(words)}</article><div class=footer>{r.choice(words)}</div></body>"))
    rows += rows[:5]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {(r.host, r.node): r for r in op1_html.site_style_tree(op1_html.parsed(pages, op1_html.host_sql("url"), "html", ["page_id"])).collect()}
    want = {}
    for host in ("h0.com", "h1.com"):
        shown = {tuple(op1_html.blocks(h)) for _, u, h in rows if host in u}
        paths = {p[: k + 1]: None for page in shown for p, *_ in page for k in range(len(p))}
        info = {}
        for path in paths:
            texts, styles, n, mark, kept = Counter(), Counter(), 0, 0, False
            for page in shown:
                own = {t for p, _, _, t in page if p == path}
                texts.update(own)
                kids = []
                for p, m, a, t in page:
                    if p == path:
                        mark, kept = p[m - 1] if m else 0, a
                    if p[: len(path)] == path and len(p) > len(path) and (not kids or kids[-1] != p[len(path)]):
                        kids.append(p[len(path)])
                styles.update([tuple(kids)] if kids else [])
                n += any(p[: len(path)] == path for p, *_ in page)
            base = math.log(n + op1_html.DOUBT)
            volume = sum(c * len(t) for t, c in texts.items())
            content = sum(c * len(t) * (1 - math.log(c) / base) for t, c in texts.items())
            m = sum(styles.values())
            style = (math.log(m) - sum(c * math.log(c) for c in styles.values()) / m) / base if m else None
            info[path] = (volume, content, style, mark, kept)
        weighed = {}
        for path, (_, _, style, mark, kept) in info.items():
            inside = [v for p, v in info.items() if p[: len(path)] == path]
            value = sum(v[1] for v in inside) / sum(v[0] for v in inside)
            value = value if style is None else (value + style) / 2
            weighed[path] = value * op1_html.NOISE if mark else value ** (1 / 3) if kept else value
        for path in info:
            want[host, path[-1]] = max(v for p, v in weighed.items() if p[: len(path)] == path)
    assert set(got) == set(want)
    assert all(abs(got[k].branch - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("pages", [3, 20, 200, 1000])
def test_op1_keeps_the_article_whole(spark, pages):
    """Headings, bylines and captions that repeat over a host stay among paragraphs that differ, whatever the host's size; menus and notices that repeat go."""
    inner = "<h1>Title {k}</h1><p class=byline>By the editors</p><p>Words {w}</p><h2>Summary</h2><figure><img src=x><figcaption>Photo: agency</figcaption></figure><p>In short {w} and {k}</p>"
    wraps = {"article": "<article>{}</article>", "main": "<main><div class=x>{}</div></main>", "div": "<div class=content>{}</div>"}
    rest = "<div class=q1><ul><li>Home<li>News<li>About us</ul></div>{}<div class=q2>Sign up for our letters</div>"
    rows, want = [], {}
    for n, (name, wrap) in enumerate(wraps.items()):
        for k in range(pages):
            w = " ".join(f"w{k * 31 + j}" for j in range(9))
            i = n * pages + k
            rows.append((i, f"http://{name}.com/{k}", "<body>" + rest.format(wrap.format(inner.format(k=k, w=w))) + "</body>"))
            want[i] = f"Title {k}\nBy the editors\nWords {w}\nSummary\nPhoto: agency\nIn short {w} and {k}"
    got = texts_of(spark, rows)
    for i, text in want.items():
        assert text in got[i], (i, got[i])
        if pages >= 20:
            assert got[i] == text


def removed_plainly(docs, length=100):
    """docs: (order, text) sorted; bytes removed by the rule, over all strings."""
    seen, out = set(), {}
    for key, text in docs:
        b = (text or "").encode()
        gone, new = bytearray(len(b)), []
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("local, all_", [(32, 20_000), (1, 2)])
def test_op2_brute_force(spark, duck, monkeypatch, local, all_):
    monkeypatch.setattr(op2_suffix, "LOCAL_PHRASES", local)
    monkeypatch.setattr(op2_suffix, "ALL_PHRASES", all_)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op2_suffix_dedup"](spark, SF).collect()}
    assert got == removed_plainly(duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def test_op2_odd(spark, odd, none):
    rows = op2_suffix.without_repeats(odd, with_text=True, keep=["lang", "kind", "bucket"]).collect()
    assert len(rows) == len(odd_rows())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    plain = removed_plainly([(k, t) for k, t, *_ in odd_rows()[:19]])
    for k in [x for x in range(19) if x not in (5,)]:
        assert (by[k][0].n_bytes, by[k][0].n_removed, by[k][0].n_spans, by[k][0].kept_sha256) == plain[k], k
    assert sorted(r.n_removed for r in by[5])[:2] == [0, 0]
    assert {r.n_bytes for r in by[None]} == {0, len(odd_rows()[5][1])}
    assert op2_suffix.without_repeats(none).count() == 0


def test_op3_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, odd_rows()[5][1][40:400], 0), (2, None, 0), (3, "", 0), (4, "X y", 0), (None, odd_rows()[5][1][:200], 0)], "item_id long, text string, doc long")
    got = op3_decontaminate.contamination(odd, bench).collect()
    assert len(got) == len(odd_rows())
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[4, 2].n_hit == 2 and by[4, 2].n_items == 1 and by[0, 0].n_hit == 0
    assert by[5, 120].contaminated and by[9, 120].n_hit == by[5, 120].n_hit > 10
    assert op3_decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert op3_decontaminate.contamination(none, bench).count() == 0


def test_op3_near_matches(spark):
    docs = spark.createDataFrame([(1, "a1 b1 c1 d1 zz e1 f1 g1 h1 i1 j1"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1")], "item_id long, text string")
    exact, _ = op3_decontaminate.phrase_hits(docs, bench)
    near, _ = op3_decontaminate.phrase_hits(docs, bench, slop=2)
    assert exact.count() == 0 and {r.doc for r in near.where("NOT exact").collect()} <= {1}


def test_op3_without_broadcast(spark, duck, monkeypatch):
    """A benchmark beyond the size for a broadcast takes the same way, and a long text needs no row with all of its words."""
    monkeypatch.setattr(op3_decontaminate, "BROADCAST_BYTES", 0)
    same_rows(queries.QUERIES["op3_decontaminate"](spark, SF), duck.sql(op3_decontaminate.OP3_SQL))
    passage = " ".join(f"p{k}" for k in range(12))
    docs = spark.createDataFrame([(1, "x y " * 40_000 + passage + " z" * 40_000), (2, passage), (3, "x y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in op3_decontaminate.contamination(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert got == {1: (120_012, 12), 2: (12, 12), 3: (2, 0)}


def test_op3_proximity(spark):
    """The two rarest terms of a phrase, one word further apart than in the phrase."""
    docs = spark.createDataFrame([(1, "a b c rare1 zz rare2 d e f g h"), (2, "a b c d e f g h"), (3, "rare1 " + "a " * 30 + "rare2"), (4, "a b c d e f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c rare1 rare2 d e f g h")], "item_id long, text string")
    near, _ = op3_decontaminate.phrase_hits(docs, bench, slop=2)
    assert [(r.doc, r.start, r.exact) for r in near.collect()] == [(1, 0, False)]


def test_op4_odd(spark):
    v, w = [1.0, 0.0, 0.0, 1.0], [1.0, 0.01, 0.0, 1.0]
    rows = [(1, v, 1), (2, v, 1), (3, w, 1), (4, v, 2), (5, None, 1), (6, [0.0] * 4, 1), (7, [float("nan"), 0.0, 0.0, 1.0], 1), (8, v, None), (9, [None, 1.0, 0.0, 0.0], 1), (None, v, 1), (10, [2.0, 0.0, 0.0, 2.0], 1), (11, [1.0, 2.0], 1), (3, w, 1)]
    df = spark.createDataFrame([r + (0, 0) for r in rows], "vec_id long, embedding array<double>, label int, c int, cell int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op4_embeddings.linked_vectors(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[10] == (3, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 11))
    assert op4_embeddings.linked_vectors(df.limit(0)).count() == 0


def test_op4_recall(spark, duck):
    """Against all pairs of a label, at the threshold's own distance as well."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = rng.normal(size=(300, 64))
    step -= (step * base).sum(1)[:, None] * base
    step /= np.linalg.norm(step, axis=1)[:, None]
    near = 0.935 * base + np.sqrt(1 - 0.935**2) * step
    x = np.concatenate([base, near])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in op4_embeddings.linked_vectors(df).collect())
    true = int((x @ x.T >= 0.93).sum() - len(x))
    assert 0.9 * true <= found <= true


@pytest.mark.parametrize("power", [0.5, 1])
def test_op4_recall_skewed(spark, power):
    """Against all pairs, with deviations that fall over the dimensions and neighbours that follow them."""
    import numpy as np

    rng = np.random.default_rng(2)
    dev = rng.permutation(1 / np.arange(1, 65) ** power)
    base = rng.normal(size=(3000, 64)) * dev
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = rng.normal(size=(1000, 64)) * dev
    step -= (step * base[:1000]).sum(1)[:, None] * base[:1000]
    step /= np.linalg.norm(step, axis=1)[:, None]
    x = np.concatenate([base, 0.931 * base[:1000] + np.sqrt(1 - 0.931**2) * step])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in op4_embeddings.linked_vectors(df).collect())
    true = int((x @ x.T >= 0.93).sum() - len(x))
    assert 0.99 * true <= found <= true


@pytest.mark.parametrize("block, small", [(256, 200), (4, 4), (2, 2)])
def test_op5_paths(spark, duck, monkeypatch, block, small):
    monkeypatch.setattr(op5_minhash, "BLOCK", block)
    monkeypatch.setattr(op5_minhash, "SMALL", small)
    same_rows(queries.QUERIES["op5_minhash"](spark, SF), duck.sql(op5_minhash.OP5_SQL))


def test_op4_lengths_and_sizes(spark):
    """Vectors of any length link among themselves, and no square overflows or vanishes."""
    rows = [(1, [1.0, 0.0, 0.0, 1.0], 1), (2, [1.0, 0.0, 0.0, 1.0], 1), (3, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (5, [1e200, 1e200], 1), (6, [1e200, 1.1e200], 1), (7, [3e-200, 3.1e-200], 1), (8, [2.0], 1), (9, [5.0], 1), (10, [-1.0], 1), (11, [], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op4_embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (4, 3), 4: (4, 3), 5: (4, 3), 6: (4, 3), 7: (4, 3), 8: (1, 8), 9: (1, 8), 10: (0, 10), 11: (0, 11)}


def test_op4_ids_with_several_vectors(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (8, [0.01, 1.0], 1), (3, [1.0, 0.01], 1)]
    got = {(r.vec_id, r.n_links, r.component_id) for r in op4_embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {(5, 3, 3), (7, 2, 3), (8, 2, 3), (3, 1, 3)}


def test_op4_multi_sequence():
    """The traversal visits the cells that a full sort of the product would, and no others."""
    import numpy as np

    rng = np.random.default_rng(4)
    p, q = rng.dirichlet(np.full(23, 0.2), 60), rng.dirichlet(np.full(31, 0.2), 60)
    rows, cells = op4_embeddings.multi_sequence(p, q, 0.97)
    for r in range(60):
        product = np.outer(p[r], q[r]).ravel()
        order = np.argsort(-product)
        n = int(np.searchsorted(np.cumsum(product[order]), 0.97)) + 1
        assert sorted(cells[rows == r].tolist()) == sorted(order[:n].tolist())


def test_op4_recall_many(spark):
    """Against all pairs on 100,000 vectors, whose grid has grown beyond that of the small tests; blocks compare the planted rows with all others."""
    import numpy as np

    rng = np.random.default_rng(6)
    dev = 1 / np.arange(1, 33) ** 0.5
    base = rng.normal(size=(100_000, 32)) * dev
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = rng.normal(size=(600, 32)) * dev
    step -= (step * base[:600]).sum(1)[:, None] * base[:600]
    step /= np.linalg.norm(step, axis=1)[:, None]
    x = np.concatenate([base, 0.931 * base[:600] + np.sqrt(1 - 0.931**2) * step])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(16)
    found = {r.vec_id: r.n_links for r in op4_embeddings.linked_vectors(df).where("vec_id >= 100000").collect()}
    true = {100_000 + k: int((x @ x[100_000 + k] >= 0.93).sum()) - 1 for k in range(600)}
    assert sum(found.values()) >= 0.99 * sum(true.values()) and all(found[k] <= true[k] for k in true)


@pytest.mark.parametrize("limit", [1 << 60, 3000, 900])
def test_op5_block_pairs(monkeypatch, limit):
    """Every pair of which one is not near meets in some part, parts are bounded by bytes, and clusters need few parts."""
    import numpy as np

    monkeypatch.setattr(op5_minhash, "BLOCK_BYTES", limit)
    rng = np.random.default_rng(5)
    n = 300
    cluster, g, near, size, c = rng.integers(0, 60, n), rng.integers(0, 2, n), rng.random(n) < 0.3, rng.integers(1, 200, n), rng.permutation(n)
    size[7] = 5000
    pair = (cluster[:, None] == cluster[None]) | (rng.random((n, n)) < 0.0005)
    pair = (pair | pair.T) & (g[:, None] == g[None]) & ~(near[:, None] & near[None])
    np.fill_diagonal(pair, False)
    met, rows_out, parts = np.zeros((n, n), bool), 0, set()
    for q, k, rows, asks in op5_minhash.block_pairs(pair, g, c, near, size):
        assert (q, k) not in parts and not near[rows[asks]].any() and len(set(g[rows])) == 1
        parts.add((q, k))
        assert sum(size[rows]) <= 2 * limit or 7 in rows
        met[np.ix_(rows[asks], rows)] = True
        rows_out += len(rows)
    assert not (pair & ~(met | met.T)).any()
    assert rows_out < 12 * n and (limit < 1 << 60 or rows_out <= n)


def test_op5_large_texts(spark, monkeypatch):
    """Components and parts that have few documents and many bytes are compared in blocks of bytes."""
    r = random.Random(2)
    base = [r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(900)]
    rows = []
    for k in range(30):
        own = list(base)
        for j in range(k % 6 * 8):
            own[(97 * j + k) % 900] = f"x{k}x{j}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, op5_minhash.near_duplicates(df, shingle=3, percent=85).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(op5_minhash, "BLOCK_BYTES", 30_000)
    got = sorted(map(tuple, op5_minhash.near_duplicates(df, shingle=3, percent=85).select("doc_id", "component_id").collect()))
    assert got == want and len({c for _, c in got}) > 1


def test_op5_matrices(monkeypatch):
    import numpy as np

    monkeypatch.setattr(op5_minhash, "STRIPE", 7)
    rng = np.random.default_rng(9)
    sketch = rng.integers(0, 2, (30, 128)).astype(bool)
    sketch[10:20] = sketch[9] ^ (rng.random((10, 128)) < 0.1)
    got = op5_minhash.alike(np.packbits(sketch, axis=1), 0.6)
    assert (got == (1 - 2 * (sketch[:, None] != sketch[None]).mean(-1) >= 0.6)).all()
    rows = rng.integers(0, 3, (30, 128)).astype(np.uint8)
    assert (op5_minhash.alike_bytes(rows, 0.35) == ((rows[:, None] == rows[None]).mean(-1) >= 0.35)).all()
    ids = rng.permutation(30)
    a, b = np.nonzero(got)
    root = common.roots(30, ids[a], ids[b])
    assert (op5_minhash.smallest_joined(got, ids) == root[ids]).all()


@pytest.mark.parametrize("similar", [85, 90])
def test_op5_crowded_nodes(similar):
    """Pairs that branch on from DEPTH to LAST_DEPTH, as in nodes that stay crowded, still meet in some tree."""
    import numpy as np

    rng, n, size = np.random.default_rng(3), 400, 200
    both = size * 2 * similar // (100 + similar)
    sets = rng.integers(0, 1 << 63, (n, 2 * size - both), dtype=np.uint64)
    one, two = sets[:, :size], sets[:, size - both :]
    off = np.arange(n + 1) * size
    a, b = (op5_minhash.signatures(np.sort(x, 1).ravel(), off) for x in (one, two))
    found = np.zeros(n, bool)
    for t in range(op5_minhash.TREES):
        ends = []
        for sig in (a, b):
            rows, node = op5_minhash.branches(op5_minhash.path_keys(sig, t, op5_minhash.DEPTH), sig, op5_minhash.LAST_DEPTH - op5_minhash.DEPTH, 0.85)
            ends.append(set(zip(rows.tolist(), node.tolist(), strict=True)))
        found[[r for r, _ in ends[0] & ends[1]]] = True
    assert found.mean() >= 0.97


@pytest.mark.parametrize("small", [2048, 100])
def test_op5_crowd(spark, monkeypatch, small):
    """A crowd that branches on, of texts that share most but not enough of their words, with near copies in it."""
    monkeypatch.setattr(op5_minhash, "SMALL", small)
    r = random.Random(8)
    common = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(700):
        own = [f"x{k}y{j}" for j in range(28)]
        rows.append((2 * k, " ".join(common + own)))
        if k % 3 == 0:
            rows.append((2 * k + 1, " ".join(common + own[:-1] + [f"z{k}"])))
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in op5_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, percent=85).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def test_op5_odd(spark, odd, none):
    got = op5_minhash.near_duplicates(odd, shingle=3, percent=85).collect()
    assert len(got) == len(odd_rows())
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[0, 0].kept and by[1, 0].kept and by[3, 1].n_shingles == 1
    assert by[6, 118].component_id == 5 and by[7, 119].component_id == 5 and by[9, 118].component_id == 5
    assert by[None, 118].kept and by[None, 118].component_id is None
    assert op5_minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("ids", ["null", "same", "pairs"])
def test_op6_learns_every_language(spark, ids):
    """Whatever the ids of a language: null, one for all rows, or a few."""
    r = random.Random(8)
    de, en = "der die das und nicht ein ich haus strasse schön".split(), "the and not a house street of nice to is".split()
    rows = [(k, " ".join(r.choice(en) for _ in range(12)), "en") for k in range(3000)]
    rows += [({"null": None, "same": 7, "pairs": k % 2}[ids], " ".join(r.choice(de) for _ in range(12)), "de") for k in range(3000)]
    rows += [(None, "solo una riga in italiano per sempre", "it")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op6_langid.fit(df, sample=300)
    assert model["langs"] == ["de", "en", "it"]
    got = op6_langid.identify(df, model).groupBy("lang", "lang_pred").count().collect()
    right = {r.lang: r["count"] for r in got if r.lang == r.lang_pred}
    assert right["en"] > 2900 and right["de"] > 2900 and right["it"] == 500


def test_op6_grams_plainly():
    import numpy as np

    def plain(raw):
        b = b" " + bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in raw) + b" "
        out = []
        for k, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
            for j in range(len(b) - k + 1):
                g = int.from_bytes(b[j : j + k], "big")
                out.append((((((g * salt) ^ (g >> 15)) % 2**32) * 0x2C1B3C6D) % 2**32) >> 16)
        return sorted(out)

    rows = [b"", b"a", b"Ab\tc", "Grüße, 日本".encode(), b"x" * 50]
    off = np.cumsum([0, *map(len, rows)])
    bucket, at = op6_langid.grams(np.frombuffer(b"".join(rows), np.uint8), off)
    for k, raw in enumerate(rows):
        assert sorted(bucket[at[k] : at[k + 1]].tolist()) == plain(raw), raw


def test_op6_training_plainly(monkeypatch):
    """Mean, softmax step and temperature against loops over numbers."""
    import math

    import numpy as np

    monkeypatch.setattr(op6_langid, "BUCKETS", 12)
    monkeypatch.setattr(op6_langid, "DIM", 3)
    r = random.Random(1)
    docs = [({r.randrange(12): r.randrange(1, 5) for _ in range(4)}, r.choice("xyz")) for _ in range(12)]
    counts = [(np.array(sorted(d)), np.array([d[b] for b in sorted(d)])) for d, _ in docs]
    model = op6_langid.train(counts, [x for _, x in docs], steps=30)
    rng = np.random.default_rng(7)
    table = ((rng.random((12, 3), np.float32) - 0.5) / 3).tolist()
    weight = [[0.0] * 3 for _ in range(3)]
    learn = [k for k in range(12) if k % 4 != 3]
    epochs = max(4, -(-30 // len(learn)))

    def scores(d, rows):
        n = sum(d.values())
        return [sum(c / n * rows[b][j] for b, c in d.items()) for j in range(3)]

    def soft(z):
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    step = 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            d, label = docs[i]
            n, x = sum(d.values()), scores(d, table)
            g = soft([sum(x[a] * weight[a][j] for a in range(3)) for j in range(3)])
            g["xyz".index(label)] -= 1
            lr = 0.5 * (1 - step / (epochs * len(learn)))
            back = [sum(weight[a][j] * g[j] for j in range(3)) for a in range(3)]
            for a in range(3):
                for j in range(3):
                    weight[a][j] -= lr * x[a] * g[j]
            for b, c in d.items():
                for a in range(3):
                    table[b][a] -= lr * 20 * c / n * back[a]
            step += 1
    logits = [[sum(table[b][a] * weight[a][j] for a in range(3)) for j in range(3)] for b in range(12)]
    assert np.allclose(model["logits"], logits, atol=1e-3)
    check = [docs[k] for k in range(12) if k % 4 == 3]
    doubt, best = 1 / (len(check) + 2), None
    for t in np.geomspace(0.002, 20, 120):
        loss = 0.0
        for d, label in check:
            p = [math.log(v + 1e-12) for v in soft([v / t for v in scores(d, model["logits"].tolist())])]
            loss -= (1 - doubt) * p["xyz".index(label)] + doubt * sum(p) / 3
        best = min(best or (loss, t), (loss, t))
    assert abs(model["temperature"] - best[1]) < 1e-9
    text = [k for k in "ab c"]
    names, score = op6_langid.predict(model | {"logits": np.ones((1 << 16, 3), np.float32)}, op6_langid.pa.array(text))
    assert names == ["x", "x", "und", "x"] and np.allclose(score, [1 / 3, 1 / 3, 0, 1 / 3])


def test_op6(spark, odd, none):
    rows = [r for r in queries.QUERIES["op6_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()]
    assert sum(r.lang_pred == r.lang for r in rows if r.held_out) / sum(r.held_out for r in rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    model = op6_langid.fit(odd)
    got = {r.doc_id: r for r in op6_langid.identify(odd, model, keep=["doc_id", "row", "t"]).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[13].lang_pred == "und" and got[0].rejected
    assert got[11].lang_pred == "en"
    assert op6_langid.identify(odd, op6_langid.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert op6_langid.identify(none, model).count() == 0


def test_op6_long_labelled_texts(spark):
    """Labelled rows that together hold far more text than the driver would take are learned from whole."""
    rows = [(i, ("alpha beta gamma the of and " if i % 2 else "der die das und nicht ein ") * 1200, "en" if i % 2 else "de") for i in range(2200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op6_langid.fit(df)
    assert model["langs"] == ["de", "en"]
    assert op6_langid.identify(df, model).where("lang_pred <> lang OR rejected").count() == 0
    few = op6_langid.fit(df, entries=1)
    assert few["langs"] == ["de", "en"]


def test_op6_rare_language(spark):
    rows = [(i, "the house and the garden of the town" + " again" * (i % 7), "en") for i in range(4000)] + [(9000 + i, "zwölf boxkämpfer jagen viktor quer über den deich" + " noch" * i, "de") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op6_langid.identify(df, op6_langid.fit(df, sample=400))
    assert got.where("lang_pred <> lang").count() == 0


def test_op7_odd(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en", "http://a.net/es/1#z", "http://xnet/es/", "http://net/fr/a/b", "http://com", "https://b.example.com/en/?q", "http://example.com?u=http://net/es/", "http://a..com/x"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id int, url string, _host string, key string")
    rules = spark.createDataFrame(op7_urls.RULES, "host string, path string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op7_urls.judge_urls(df, rules).collect()}
    none = ("", "", None, "allow")
    assert [got[i] for i in range(4)] == [none] * 4
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5] == ("example.com", "/en", "com/", "allow")
    assert got[6] == ("a.net", "/es/1", "net/es/", "block") and got[7][2] is None
    assert got[8][2:] == ("net/fr/", "block") and got[9] == ("com", "", None, "allow")
    assert got[10][2:] == ("example.com/en/", "block") and got[11] == ("example.com", "", None, "allow")
    assert op7_urls.judge_urls(df.limit(0), rules).count() == 0
    assert op7_urls.judge_urls(df, rules.limit(0)).where("rule IS NOT NULL").count() == 0


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_op7_many_rules(spark, monkeypatch, rows):
    """Many rules of one host, nested in each other and in other hosts, against every rule for every url."""
    monkeypatch.setattr(op7_urls, "ROWS", rows)
    r = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "aa.com", "net", "x.net"]
    parts = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é", "/a/b/c"]
    rules = sorted({(r.choice(hosts), r.choice(parts) + r.choice(["", "/x", "/x/y", "z"])) for _ in range(90)})
    rules = [(h, p if p.startswith("/") or not p else "/" + p, r.choice(["allow", "block"])) for h, p in rules]
    rules = list({(h, p): (h, p, a) for h, p, a in rules}.values())
    urls = [f"http://{r.choice(['', 'www.', 'b.', 'q.b.'])}{r.choice([*hosts, 'other.org'])}{r.choice(parts)}{r.choice(['', '/x', '/x/y', 'z', '/x/y/z?q', '#f'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    for x in op7_urls.judge_urls(df, spark.createDataFrame(rules, "host string, path string, action string")).collect():
        fit = [(len(h), len(p), h + p, a) for h, p, a in rules if (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
        assert (x.rule, x.verdict) == (max(fit)[2:] if fit else (None, "allow")), urls[x.page_id]


def test_op7_one_path_of_many_hosts(spark, monkeypatch):
    """All home pages below a rule of com are one point of the sweep: no bucket has more than its share."""
    held, real = [], op7_urls.saved

    def saved(df, name, *more):
        out = real(df, name, *more)
        if name == "ranges":
            held.append(out)
        return out

    monkeypatch.setattr(op7_urls, "saved", saved)
    pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".com/")).alias("url"))
    rules = spark.createDataFrame([("com", "/", "block"), ("h7.com", "/", "allow"), ("com", "/x", "allow")], "host string, path string, action string")
    got = {tuple(r): n for *r, n in op7_urls.judge_urls(pages, rules).groupBy("rule", "verdict").count().collect()}
    assert got == {("com/", "block"): 39_999, ("h7.com/", "allow"): 1}
    for ranges in held:
        rows = [r["count"] for r in ranges.groupBy("bucket").count().collect()]
        assert max(rows) <= max(100, 3 * sum(rows) / len(rows))
    assert held[1].count() < 20


def test_op8_odd(spark, odd, none):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in op8_tokens.token_counts(odd).collect())
    assert got == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode())) for r in odd_rows())
    files, names = op8_tokens.token_files(odd.coalesce(1))
    got = sorted(r.n_tokens for r in names.join(op8_tokens.scan(files, size=7), ["file", "ordinal"]).collect())
    assert got == sorted(len((r[1] or "").encode()) for r in odd_rows())
    assert op8_tokens.token_counts(none).count() == 0


@pytest.mark.parametrize("ids, end", [("<u1", 255), ("<u2", 256), ("<u4", 70_000)])
def test_op8_flat_files(spark, tmp_path, monkeypatch, ids, end):
    import numpy as np

    monkeypatch.setattr(op8_tokens, "GROUP", 3)
    docs = [5, 0, 40, 1, 0, 17]
    tokens = np.concatenate([np.append(np.zeros(n, ids), np.array(end, ids)) for n in docs])[:-1].astype(ids)
    (tmp_path / "f.bin").write_bytes(tokens.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    for size in (1, 4, 16, 1000):
        got = op8_tokens.scan(op8_tokens.files_at(spark, str(tmp_path)), end, ids, size).orderBy("ordinal").collect()
        assert [r.n_tokens for r in got] == docs


def test_op8_rounds(spark, tmp_path, monkeypatch):
    """Token files of a part of the rows lie on disk at once, however few rows a file of the table has, and none stays."""
    from pathlib import Path

    sizes = lambda: sum(p.stat().st_size for p in Path(tmp_path).rglob("*.bin"))
    held, files_of = [], op8_tokens.token_files

    def watched(*a, **k):
        out = files_of(*a, **k)
        held.append(sizes())
        return out

    monkeypatch.setattr(op8_tokens, "token_files", watched)
    monkeypatch.setattr(op8_tokens, "folder", lambda spark, name: f"file://{tmp_path}/{name}-{len(held)}")
    spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), F.pmod("id", F.lit(50)).cast("int")).alias("text")).repartition(40).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = sorted(map(tuple, op8_tokens.token_counts(docs).collect()))
    assert got == [(k, 2 * (k % 50)) for k in range(400)]
    total = sum(n + 1 for _, n in got)
    assert sum(held) == total and max(held) < 0.7 * total and sizes() == 0


def test_op9_permutation():
    import numpy as np

    for n in (1, 2, 3, 10, 1000, 4097):
        p = op9_shards.feistel(np.arange(n), n, 9)
        assert sorted(p.tolist()) == list(range(n))
    assert op9_shards.feistel(np.arange(50), 50, 1).tolist() != op9_shards.feistel(np.arange(50), 50, 2).tolist()


def plain_feistel(x, n, key):
    """The permutation in whole numbers of Python."""
    m = (1 << 64) - 1

    def mix(v):
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & m
        v = (v ^ v >> 27) * 0x94D049BB133111EB & m
        return v ^ v >> 31

    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for r in range(1, op9_shards.ROUNDS + 1):
            left, right = right, left ^ (mix((right * int(common.GOLD) + mix((r * int(common.GOLD) + key) & m)) & m) & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


@pytest.mark.parametrize("unit, files_", [(1 << 20, 1), (4, 1), (3, 3)])
def test_op9_records(spark, odd, none, monkeypatch, tmp_path, unit, files_):
    monkeypatch.setattr(op9_shards, "UNIT", unit)
    monkeypatch.setattr(op9_shards, "GROUP", 2)
    odd.unionByName(odd.where("doc_id IN (5, 6)")).repartition(files_).write.parquet(f"file://{tmp_path}/docs")
    odd = spark.read.parquet(f"file://{tmp_path}/docs")
    files = op9_shards.shards(odd, length=64, per_shard=50, key=77)
    rows = op9_shards.read_records(files, length=64).collect()
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = sorted(op9_shards.record_of(t, k, s, 64) for k, t in texts for s in range((len((t or "").encode()) + 64) // 64))
    assert sorted(bytes(r.record) for r in rows) == want
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(r.shard == r.slot // 50 for r in rows)
    # slots against a plain order: files by group and name, and their rows
    order = odd.select(F.pmod(F.xxhash64(F.xxhash64("_metadata.file_path")), F.lit(2)), F.xxhash64("_metadata.file_path"), "_metadata.row_index", "doc_id", "text").collect()
    assert len({r[1] for r in order}) == files_
    plain = [(r.doc_id, s, r.text) for r in sorted(order, key=lambda r: r[:3]) for s in range((len((r.text or "").encode()) + 64) // 64)]
    slots = {plain_feistel(x, len(plain), 77): op9_shards.record_of(t, i, s, 64) for x, (i, s, t) in enumerate(plain)}
    assert {r.slot: bytes(r.record) for r in rows} == slots
    # a shard is a flat file: record r is at r * stride
    stride = op9_shards.HEADER.itemsize + 64
    for f in files.collect():
        raw = open(f.file.removeprefix("file://"), "rb").read()
        assert len(raw) == (f.last_slot - f.first_slot + 1) * stride
        assert raw[3 * stride : 4 * stride] == slots.get(f.first_slot + 3, b"")
    later = op9_shards.read_records(files, length=64, start=70).collect()
    assert {r.slot: bytes(r.record) for r in later} == {k: v for k, v in slots.items() if k >= 70}
    assert op9_shards.read_records(files, length=64, start=len(rows)).count() == 0
    assert op9_shards.read_records(op9_shards.shards(none)).count() == 0
    with pytest.raises(TypeError):
        op9_shards.shards(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_op9_partitions(spark, tmp_path):
    """The order does not depend on how files are cut into partitions, and a DataFrame without files has one as well."""
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"file://{tmp_path}/docs")
    docs, slots = spark.read.parquet(f"file://{tmp_path}/docs"), []
    for size in ("128m", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        slots.append({(r.slot, r.record_sha256) for r in op9_shards.digest(op9_shards.read_records(op9_shards.shards(docs))).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert slots[0] == slots[1] and len(slots[0]) > 500
    assert op9_shards.digest(op9_shards.read_records(op9_shards.shards(docs.repartition(2)))).count() == len(slots[0])


@pytest.mark.parametrize("how", ["filter", "sample", "explode", "join", "limit", "select", "union"])
def test_op9_any_table(spark, how):
    """What is made from a Parquet table has all its sequences, each once, in the permutation's order of the rows' places."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {
        "filter": lambda: docs.where("doc_id % 2 = 1"),
        "sample": lambda: docs.sample(0.5, seed=3),
        "explode": lambda: docs.select("doc_id", F.explode(F.split("text", " ")).alias("text")).where("length(text) > 6"),
        "join": lambda: docs.join(docs.where("doc_id < 50").select("doc_id", F.lit(1).alias("extra")), "doc_id"),
        "limit": lambda: docs.limit(20),
        "select": lambda: docs.select("text", (F.col("doc_id") + 1).alias("doc_id")),
        "union": lambda: docs.unionByName(docs),
    }[how]()
    got = op9_shards.read_records(op9_shards.shards(made, per_shard=64)).collect()
    want = Counter()
    for r in made.select("doc_id", "text").collect():
        want.update((r.doc_id, s, op9_shards.record_of(r.text, r.doc_id, s)) for s in range(len((r.text or "").encode()) // op9_shards.LENGTH + 1))
    assert Counter((r.doc_id, r.seq, bytes(r.record)) for r in got) == want
    assert sorted(r.slot for r in got) == list(range(len(got)))


def test_op10(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op10_bpe.vocabulary_path())
    docs = odd.select("doc_id", "text", "i", "t").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).cast("long").alias("i"), F.lit("x").alias("t")))
    got = op10_bpe.encode_documents(docs, op10_bpe.vocabulary_path(), with_ids=True).collect()
    want = [t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()]
    assert sorted(tuple(r.token_ids) for r in got) == sorted(map(tuple, want))
    for r in got:
        assert r.n_tokens == len(r.token_ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.token_ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(r.token_ids, skip_special_tokens=False).encode()).hexdigest()
    assert op10_bpe.encode_documents(none, op10_bpe.vocabulary_path()).count() == 0


def test_op10_long_words():
    from tokenizers import Tokenizer

    b = op10_bpe.ByteBPE(json.loads(open(op10_bpe.vocabulary_path(), encoding="utf-8").read()))
    t = Tokenizer.from_file(op10_bpe.vocabulary_path())
    for x in ("a" * 5000, "ab" * 3000, "\n" * 500, "日本語 ١٢٣ ²", "don't 'S I'VE", "a\x1cb \x85c", "x" + " " * 99 + "y"):
        ids, _ = b.encode_batch([x])[0]
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids
        assert b.decode(ids).decode() == x


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in {x for e in edges if e[0] != e[1] for x in e}}


def test_pipeline(spark, duck):
    """Each stage against a plain version of its decision, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op6_langid.fit(docs.where(~op6_langid.held_out(F.col("doc_id"))))
    rejected = {r.doc_id for r in op6_langid.identify(docs, model).where("rejected").collect()}
    one = common.saved(corpus_pipeline.language(spark, docs, SF), "one")
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - rejected
    two = common.saved(corpus_pipeline.near_duplicates(spark, one, SF), "two")
    sets = {}
    for r in one.collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode()))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in two.collect()} == {k for k in ids if find(k) == k}
    three = common.saved(corpus_pipeline.repeated_text(spark, two, SF), "three")
    plain = removed_plainly(sorted((r.doc_id, r.text) for r in two.collect()))
    assert {r.doc_id for r in three.collect()} == {k for k, v in plain.items() if v[0] == 0 or v[1] < v[0]}
    assert all(len(r.text.encode()) <= plain[r.doc_id][0] - plain[r.doc_id][1] and (plain[r.doc_id][1] or r.n_chars == len(r.text)) for r in three.collect())
    four = common.saved(corpus_pipeline.decontaminate(spark, three, SF), "four")
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()]
    windows = {" " + " ".join(w[k : k + 10]) + " " for w in bench for k in range(max(len(w) - 9, 1)) if w}
    clean = {r.doc_id for r in three.collect() if not any(x in " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))) + " " for x in windows)}
    assert {r.doc_id for r in four.collect()} == clean
    five = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in five.collect()} == clean and five.columns[:2] == ["doc_id", "n_tokens"]


def test_pipeline_odd(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.saved(stage(spark, docs, SF), name)
            assert out.columns == corpus_pipeline.COLUMNS
        assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()
