"""Template deduction: the fixture's pages without the marks that structure alone would go by; thinned counts; tags."""

import html
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import html_extract


def article(page):
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", "").replace("</b>", ""))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_slots_find_the_article_without_its_marks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = F.expr("replace(replace(replace(replace(html, '<article>', '<div class=x7>'), '</article>', '</div>'), 'class=\"ad\"', 'class=\"z9\"'), 'footer>', 'section>')")
    plain = pages.withColumn("html", bare)
    often = {r.host for r in html_extract.template(plain, min_pages=4).collect()}
    got = {r.page_id: r.text for r in html_extract.extracted(plain, min_pages=4).collect()}
    hosts = {r.page_id: r.host for r in pages.select("page_id", html_extract._host_of("url").alias("host")).collect()}
    compared = 0
    for r in pages.collect():
        if hosts[r.page_id] in often:
            compared += 1
            assert got[r.page_id] == article(r.html)
            assert html_extract.main_text(r.html.replace("<article>", "<div>").replace("class=\"ad\"", "")) != article(r.html)
    assert compared > 50


def test_an_article_keeps_what_its_pages_share(spark):
    page = "<html><body><nav>Menu</nav><article><h2>Intro</h2><p>{a}</p><h2>Method</h2><p>{b}</p><h2>Outro</h2></article><div>Foot note</div></body></html>"
    rows = [(i, f"http://h.com/{i}", page.format(a=f"first {i * 7}", b=f"second {i * 3}")) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Intro\n\nfirst 14\n\nMethod\n\nsecond 6\n\nOutro"


def test_thinned_counts_lose_no_template_token():
    rng = random.Random(4)
    often = np.arange(5, dtype=np.int64)
    for support in (0.5, 0.3):
        hitters = [html_extract.HeavyHitters(support / 2) for _ in range(3)]
        true: Counter = Counter()
        pages = 900
        for i in range(pages):
            page = np.array(sorted({*(t for t in often if rng.random() < support + 0.05), *(rng.randrange(100, 100_000) for _ in range(200))}), np.int64)
            true.update(page.tolist())
            hitters[i % 3].add(page)
        estimate: Counter = Counter()
        for x in hitters:
            x.thin()
            for k, n in zip(*x.parts[0], strict=True):
                estimate[int(k)] += n
        for token, n in true.items():
            assert n - support / 2 * pages <= estimate.get(token, 0) + 1e-6 and estimate.get(token, 0) <= n
        held = [t for t, n in estimate.items() if n >= support / 2 * pages]
        assert {t for t, n in true.items() if n >= support * pages} <= set(held) and len(held) < 50


def test_attributes_of_any_kind():
    text = html_extract.main_text
    assert text("<article><p data-x=it's>one</p><p>two</p><p>it's three</p><p>four</p></article>") == "one\n\ntwo\n\nit's three\n\nfour"
    assert text('<article><p title="a > b" x=\'"\'>one</p><p x=">two</p><p>three</p></article>').endswith("three")
    kept = "".join(f'<div class="{c}">{i}</div>' for i, c in enumerate(("side-by-side", "ad-hoc", "legal-notice", "commentary", "header-image")))
    gone = "".join(f'<div class="{c}">no</div>' for c in ("ad", "ad-slot", "cookie-notice", "share-buttons", "sidebar", "comments", "ads300"))
    assert text(f"<article>{kept}{gone}<a href=/x/>five</a></article>") == "\n\n".join("01234") + "\n\nfive"
    assert text("<div title=\"class=ad\">one</div>") == "one"


def test_deep_and_broken_pages():
    text = html_extract.main_text
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("</p></div><p>a</article>b<") == "a\n\nb<"
    assert text("<" * 500) == "<" * 500
