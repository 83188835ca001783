"""Fill-in-the-middle, page extraction and lexical search: against plain versions, on odd rows, and on long inputs."""

import hashlib
import html
import math
import random
import re
import time
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import duck, rows
from conftest import DATA
from shardloom.llm import fill_in_middle, html_extract, lexical_search
from shardloom.llm import queries as q
from shardloom.llm.html_pages import Page

FOLDER = f"{DATA}/sf0.001"
HARD = ["", " ", "\n \t", "a", " a", "a ", "a  b\n", "é 日本  語\x0b", "x <P> y", "<S>", "a <M", "a < b <S c <", "\x1c a b", "<", "word " * 3000]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_lexical_search"])
def test_queries_match_their_sql(spark, name):
    assert rows(q.QUERIES[name](spark, FOLDER).toPandas()) == rows(duck(FOLDER, q.ORACLE_SQL[name]))


# --- fill-in-the-middle ---


def plain_fim(text, doc_id):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_by_lists_of_units(spark):
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice(["a", "Bé", " ", "\n", "  ", "<", "<P", "S>", "日"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    given = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(5, None), (6, "twice here"), (6, "twice here")]
    docs = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in given], "doc_id long, text string, form string, n int, output string")
    made = fill_in_middle.fill_in_middle(docs)
    got = made.withColumn("text", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    want = sorted([(i, *plain_fim(t or "", i), t or "") for i, t in given], key=repr)
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_reads_long_texts_in_linear_time():
    for text in ("a " * 500_000, " " * 1_000_000, "a" * 1_000_000, "a" + " " * 1_000_000 + "b"):
        began = time.process_time()
        n = fill_in_middle.count_units(text)
        assert fill_in_middle.cut_places(text, 0, n) == (0, len(text)) and time.process_time() - began < 8


# --- lexical search ---


def plain_search(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tf = [(i, Counter(words(t))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    total, df = sum(n for _, _, n in tf), Counter(t for _, c, _ in tf for t in c)
    of = defaultdict(set)
    for i, t in items:
        of[i] |= set(words(t))
    out = []
    for item, terms in of.items():
        scored = []
        for i, c, n in tf:
            m = 50 + 50 * n * len(tf) // total
            w = lambda t: math.floor(1000 * math.log((2 * len(tf) + 2) / (2 * df[t] + 1)))
            s = sum(w(t) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,slice_bytes,cells", [(3, 16_000_000, 1 << 21), (50, 16_000_000, 7), (5, 200, 1 << 21), (1, 16_000_000, 50)])
def test_search_by_all_scores(spark, monkeypatch, k, slice_bytes, cells):
    """Few and many hits, ties, common terms; slices of items; parts of batches."""
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rng = random.Random(k)
    vocabulary = [f"w{x}" for x in range(60)] + ["É", "日本", "the", "The", "a-b", "x_y"]
    weights = [1 / (1 + x) for x in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice((1, 3, 10, 60)))) for _ in range(250)]
    docs = [(x, t) for x, t in enumerate(texts)] + [(300, None), (301, ""), (302, "-- !"), (None, texts[0]), (3, texts[3]), (303, texts[3]), (304, texts[3])]
    items = [(x, " ".join(rng.choices(vocabulary, k=rng.choice((1, 4, 12))))) for x in range(15)] + [(20, None), (21, ""), (22, "nowhere"), (None, "w1 the"), (1, "w50 w51"), (2, "w5 w5 W5")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted([tuple(r) for r in lexical_search.rank_documents(d, b, k).collect()], key=repr)
    assert got == plain_search(docs, items, k)


def test_search_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert lexical_search.rank_documents(d.limit(0), b).count() == 0
    assert lexical_search.rank_documents(d, b.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.rank_documents(d, b).select("item_id", "rank", "doc_id").collect()] == [("x", 1, 1)]


def test_tails_are_pruned_and_lose_nothing():
    import numpy as np

    terms = lexical_search.Terms([(0, b"a"), (0, b"b"), (0, b"c"), (1, b"a")], 2)
    plan = lexical_search.Plan(terms, np.array([1, 5, 100]), np.array([50, 0]))
    assert plan.tail_bound.tolist() == [6, 0]
    row, term, impact = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 0, 2, 2]), np.array([1, 5, 1, 80, 44])
    got = {(int(r), int(i), int(s)) for rr, ii, ss in plan.scores(row, term, impact, 3) for r, i, s in zip(rr, ii, ss)}
    assert got == {(0, 1, 1), (1, 0, 81), (1, 1, 1)}


# --- page extraction ---


def test_shipped_pages_give_their_articles(spark):
    got = q.QUERIES["op12_html_extraction"](spark, FOLDER).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{FOLDER}/pages.parquet")
    assert len(got) == len(pages)
    for i, url, source in zip(pages.page_id, pages.url, pages.html):
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in blocks if x)
        assert (got.text[i], got.url[i], got.n_chars[i]) == (want, url, len(want))


def sites(rng):
    """Pages of three hosts without a telling element: (host, html, text of the article)."""
    word = lambda: f"w{rng.randrange(10_000)}"
    said = lambda n: " ".join(word() for _ in range(n))
    out = []
    for k in range(12):
        body = [said(rng.randint(8, 30)) for _ in range(rng.randint(1, 5))]
        title = said(4)
        links = "".join(f'<li><a href="/{word()}">{said(3)}</a></li>' for _ in range(rng.randint(2, 9)))
        paragraphs = "".join(f"<p>{x}</p>" for x in body)
        long_notice = "This site is run by nobody in particular and its long standing rules are the same on every single page of it " * 3
        out.append(("one.example", f'<html><body><div class="c1"><ul>{links}</ul></div><div class="c2"><p>{long_notice}</p></div><div class="c3"><h1>{title}</h1>{paragraphs}</div><div class="c4">{said(3)}</div></body></html>', "\n".join([title, *body])))
        out.append(("two.example", f"<table><tr><td>{long_notice}<td><p>{'<p>'.join(body)}</table><div>{long_notice}</div>", "\n".join(body)))
    return out


def test_templates_are_told_from_articles(spark):
    """Long text that is alike on all pages of a host is its template's, though no element says so."""
    made = sites(random.Random(4))
    pages = spark.createDataFrame([(k, f"https://{h}/{k}", s) for k, (h, s, _) in enumerate(made)], "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    assert got == {k: t for k, (_, _, t) in enumerate(made)}


def test_classes_are_those_of_equal_occurrence_vectors(spark):
    made = sites(random.Random(6))
    pages = spark.createDataFrame([(k, f"https://{h}/{k}", s) for k, (h, s, _) in enumerate(made)], "page_id long, url string, html string").repartition(3)
    counted = defaultdict(dict)
    for k, (h, s, _) in enumerate(made):
        for key, n in Counter(Page(s).keys).items():
            counted[h, key][k] = n
    same = defaultdict(set)
    for (h, key), vector in counted.items():
        if len(vector) >= html_extract.LEAST_PAGES and len(vector) >= html_extract.SHARE * 12:
            same[h, tuple(sorted(vector.items()))].add(key)
    want = sorted(tuple(sorted(x)) for x in same.values() if len(x) > 1)
    got = html_extract.equivalence_classes(html_extract._with_site(pages)).collect()
    assert sorted(tuple(sorted(r["tokens"])) for r in got) == want and len(want) >= 4


def test_classes_that_cross_or_change_order_are_not_valid():
    t = html_extract.Template([[1, 2, 3], [7, 8]])
    assert t.lay([1, 7, 5, 8, 2, 7, 8, 3]) == ([(-2, -2), (-2, -2), (1, 1), (-2, -2), (-2, -2), (-2, -2), (-2, -2), (-2, -2)], set())
    assert t.lay([1, 7, 2, 8, 3])[1] == {1}
    assert t.lay([1, 3, 2])[1] == {0} and t.lay([7, 1, 2, 3])[1] == {1} and t.lay([8, 7])[1] == {1}


BODY = "<p>" + "real words of the article go on and on. " * 5 + "</p>"
TEXT = ("real words of the article go on and on. " * 5).strip()


@pytest.mark.parametrize(
    "source,want",
    [
        (f"<article>{BODY}</article>", TEXT),
        (f"<nav>menu</nav><header>top</header><article><header><h1>T</h1></header>{BODY}<aside>side</aside><form>name <input></form><footer>by me</footer></article><footer>x</footer>", f"T\n{TEXT}"),
        (f'<div class="cookie-notice">we use</div><main><h1>T</h1>{BODY}<section class="comments"><article class="comment">first!</article></section></main><div id="sidebar1">links</div>', f"T\n{TEXT}"),
        (f'<body class="has-sidebar ad-free"><div role="banner">x</div><div class="post">{BODY}<script>var a = "<p>no</p>";</script><style>p {{}}</style></div>', TEXT),
        ("<article><p>a&nbsp;&amp;  b<br>c</p>d<b>e</b> f<ul><li>g<li>h</ul>&lt;p&gt; &#233;&am</article>", "a & b c\nde f\ng\nh\n<p> é&am"),
        ("<article><p>one<!-- <p>no --><p>two <span class='ad'>buy <span>now</span></span> three</article>", "one\ntwo three"),
        ("<article>a < b <3 <>c</article>", "a < b <3 <>c"),
        ("<ARTICLE CLASS=x>Up<P>Case</ARTICLE>", "Up\nCase"),
        ("", ""), (None, ""), ("just text", "just text"), ("<nav>only</nav>", ""), ("<article><div hidden>x</div></article><p>y", "y"),
    ],
)
def test_elements(source, want):
    assert "\n".join(html_extract.main_blocks(Page(source or ""), html_extract.Template(None))) == want


def test_odd_pages(spark):
    """Null urls and pages, repeated rows, copies of one page, clashing columns, an empty table."""
    long = "<article>" + "<p>long page</p>" * 20_000 + "</article>"
    given = [(1, None, "<article>a</article>"), (2, "https://x.y/", None), (2, "https://x.y/", None), (None, "no url", "<p>p</p>"), (3, "http://u:p@Host:80/q", long)]
    given += [(10 + k, "https://copy.example/", f"<div class=c1><h1>same</h1>{BODY}</div>") for k in range(5)]
    schema = "page_id long, url string, html string, site int, text string, template string, key long"
    pages = spark.createDataFrame([(*g, 1, "t", "u", 2) for g in given], schema)
    got = sorted([tuple(r) for r in html_extract.extract_text(pages).collect()], key=repr)
    texts = {1: "a", 2: "", None: "p", 3: "\n".join(["long page"] * 20_000), **{10 + k: f"same\n{TEXT}" for k in range(5)}}
    assert got == sorted([(i, u, texts[i]) for i, u, _ in given], key=repr)
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_pages_are_read_in_linear_time():
    for source in ("<" * 400_000, "<a b=\"" * 100_000, "<!--" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<span class='ad'>" * 50_000 + "</span>" * 50_000, "&" * 400_000, "<script>" * 60_000, "<b" + " =" * 200_000, "<li>" * 100_000):
        began = time.process_time()
        Page(source)
        assert time.process_time() - began < 8
