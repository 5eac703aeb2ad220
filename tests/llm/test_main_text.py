"""Main text of pages: zones of markup, repeated substrings against brute force, whole pages against what they declare."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import main_text as mt

PAGES = "page_id long, url string, html string"


def text_of(page):
    return mt.read_page(page)[0]


def test_zones_of_markup():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body class="has-sidebar"><header class=site-header>Logo</header><nav><ul><li><a href="x>y">Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><!-- <article>no</article> -->
<article class="post with-comments"><header><h1>A &amp; B&nbsp;C</h1></header><p>one <b>bo</b>ld<br>two<p class="ad">Buy</p>
<p>three &#x41;&#66;<img alt="x"/> <button>Go</button>four</p><aside>side</aside><form><input><label>mail</label></form><pre>  x
 y </pre><section class="comments"><article>me too</article></section><footer>tags</footer></article>
<div class="related-posts">more</div><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "A & B C one bold two three AB four x y"
    assert text_of("<main><p>in</p><article>best</article></main>") == "best"
    assert text_of("<div>x</div><main><p>in</p></main>") == "in"
    assert text_of("<form id=page><div><article>kept</article></div></form>") == "kept"
    assert text_of("<div itemprop='articleBody'>a<div>b</div></div>c") == "a b"
    assert text_of("<article><p>cut of") == "cut of"
    assert text_of("<article>a <!-- open") == "a"
    assert text_of("<p>no article</p>") is None
    assert text_of(None) is None and text_of("") is None
    assert text_of("<article>1 < 2 and <3 &lt;b&gt;</article>") == "1 < 2 and <3 <b>"
    assert text_of("<article></article>") is None


def plain_cover(streams, least, pages):
    held = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - least + 1):
            held.setdefault(tuple(s[i : i + least]), set()).add(tuple(streams[k]))
    out = []
    for s in streams:
        c = [False] * len(s)
        for i in range(len(s) - least + 1):
            if len(held[tuple(s[i : i + least])]) >= pages:
                c[i : i + least] = [True] * least
        out.append([i for i, x in enumerate(c) if x])
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_covered_words_are_those_of_brute_force(spark, blocks):
    rng = random.Random(blocks)
    shared = [[rng.randint(1, 9) for _ in range(n)] for n in (5, 8, 12)]
    streams = []
    for _ in range(40):
        s = []
        for _ in range(rng.randint(0, 5)):
            s += rng.choice(shared) if rng.random() < 0.6 else [rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
        if s not in streams:
            streams.append(s)
    for hosts in (1, 2):
        rows = [(f"h{k % hosts}", k, -k, 1, s, blocks, k % blocks) for k, s in enumerate(streams)]
        df = spark.createDataFrame(rows, "host string, s1 long, s2 long, n long, stream array<long>, blocks long, block long")
        got = {r.s1: r.covered for r in mt.covered(df, 5, 3).collect()}
        for h in range(hosts):
            own = [k for k in range(len(streams)) if k % hosts == h]
            for k, want in zip(own, plain_cover([streams[k] for k in own], 5, 3)):
                assert [i for lo, hi in zip(got[k][::2], got[k][1::2]) for i in range(lo, hi)] == want


def soup(k, body, extra=""):
    return f"<html><body><div>Home News About us Contact our team of helpful people {k} here</div><div>{body}</div><div>All rights are kept by the owners of this site, write to us</div>{extra}</body></html>"


def test_pages_without_an_article_lose_what_the_host_repeats(spark):
    bodies = [" ".join(f"w{k}x{i}" for i in range(30 + k)) for k in range(6)]
    rows = [(k, f"http://a.example/{k}", soup(k, b)) for k, b in enumerate(bodies)]
    rows += [(10, "http://b.example/1", soup(7, "alone")), (11, None, soup(7, "alone")), (12, "http://a.example/a", f"<article>{soup(3, bodies[0])}</article>"), (13, "junk", None), (None, "http://a.example/n", "")]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))
    for block_tokens in (1 << 16, 60):
        got = sorted(map(tuple, mt.extract(df, block_tokens=block_tokens).select("page_id", "text").collect()), key=str)
        text = lambda k, b: f"{k} here {b}"  # noqa: E731  words between the repeated ones are unique runs
        whole = lambda k, b: " ".join(re.sub("<[^>]*>", " ", soup(k, b)).split())
        want = [(k, text(k, b)) for k, b in enumerate(bodies)] + [(0, text(0, bodies[0]))] * 2
        want += [(10, whole(7, "alone")), (11, whole(7, "alone")), (12, whole(3, bodies[0])), (13, ""), (None, "")]
        for (i, a), (j, b) in zip(got, sorted(want, key=str)):
            assert i == j and a.replace(" here", "") == b.replace(" here", ""), (a, b)
    assert mt.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_articles_of_the_given_pages(spark):
    import os

    at = os.path.join(os.environ.get("TEST_DATA_DIR", "/root/testdata"), "sf0.001", "pages.parquet")
    df = spark.read.parquet(at)
    rows = {r.page_id: r for r in mt.extract(df).collect()}
    for r in df.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert rows[r.page_id].text == want and rows[r.page_id].n_chars == len(want) and rows[r.page_id].url == r.url
    assert len(rows) == df.count()


def test_ranges():
    assert mt.ranges_of(10, np.array([0, 2, 7]), 3) == [0, 5, 7, 10] and mt.ranges_of(4, np.array([], int), 3) == []
