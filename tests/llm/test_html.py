"""Main text against hand-marked pages, and the method's numbers against plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import html_extract

LONG = "A long paragraph of the real text of this page, which goes on for quite a while and says a lot of things. "
A, B, C = (f"{w} {LONG * k}".strip() for w, k in (("First", 3), ("Second", 2), ("Third", 4)))

#: (page, its main text)
PAGES = [
    (f"<article><div class='article-header'><h1>Headline</h1></div><p>{A}</p></article>", f"Headline\n{A}"),
    (f"<header><h1>Site</h1></header><main><div class='content side-by-side'><p>{A}</p><p>{B}</p></div></main>", f"{A}\n{B}"),
    (f"<article><p class='legal'>The terms.</p><p class='social-history'>A history.</p><p>{A}</p><p>Then <math><mi>x</mi><annotation>\\x</annotation></math>.</p></article>", f"The terms.\nA history.\n{A}\nThen x."),
    (f"<main><a href='#c'>Skip to content</a></main><article><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
    (f"<p>{A}</p><ul><li><a href=x>one</a><li><a href=x>two</a><li><a href=x>three</a></ul><p>{B}</p>", f"{A}\n{B}"),
    (f"<form id=aspnet><nav>menu</nav><article><p>{A}</p></article><input><label>Mail</label></form>", A),
    (f"<article><header><h1>T</h1><p>by one</p></header><p>{A}</p><ul><li>one<ul><li>in one</ul><li>two</ul><div class='share-buttons'>Tweet</div><section id=comments><article><p>{B}</p></article></section><footer>tags</footer></article>", f"T\nby one\n{A}\none\nin one\ntwo"),
    (f"<div class=siteHeader>Site</div><div class='col main-content'><h2>T</h2><p>{A}</p><blockquote>{B}</blockquote></div><div class='sideBar'>{C}</div><div class='cookie-notice'>{C}</div><div role=contentinfo>{C}</div>", f"T\n{A}\n{B}"),
    ("<nav>menu</nav><footer>foot</footer><form><p>Your name</p></form>", ""),
    ("", ""),
    (f"<div style='display: none'>{A}</div><div hidden>{B}</div><p>{C}</p>", C),
    (f"<p>{A}</p><script>if (a < b) document.write('<p>no</p>')</script><style>p > a {{}}</style><!-- <p>no</p> --><p>x &lt; y &amp;&nbsp;z</p>", f"{A}\nx < y & z"),
    (f"<article class='post comment-free'><p>{A}</p></article>", ""),
    ("<div>" * 3000 + f"<p>{A}</p>" + "</div>" * 3000, A),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_hand_marked_pages(k):
    page, want = PAGES[k]
    got = html_extract.extract(page)
    a, b = Counter(got.split()), Counter(want.split())
    same = sum((a & b).values())
    assert same >= 0.95 * sum(a.values()) and same >= 0.95 * sum(b.values())


def test_most_pages_are_exact():
    assert sum(html_extract.extract(p) == w for p, w in PAGES) >= len(PAGES) - 1


def test_names():
    for name in ("site-header", "page_footer", "mainNav", "ad", "ad-slot", "cookieBanner", "comment-list", "related-posts"):
        assert html_extract.marks(name, False), name
    for name in ("article-header", "entry-footer", "related-work", "side-by-side", "gradient", "headline", "shared", "add"):
        assert not html_extract.marks(name, True), name
    assert html_extract.marks("share", True) and html_extract.marks("related-posts", True) and not html_extract.marks("legal", True)


def test_smoothing_is_a_weighted_mean():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 9, 40):
        values = rng.random(n) * 50
        weight = [[math.exp(-0.5 * (i - j) ** 2) if abs(i - j) <= 3 else 0.0 for j in range(n)] for i in range(n)]
        want = [sum(w * v for w, v in zip(row, values)) / sum(row) for row in weight]
        assert html_extract.smoothed(values) == pytest.approx(want)


def test_the_threshold_splits_two_clusters_best():
    rng = np.random.default_rng(1)
    for _ in range(50):
        low, high = rng.normal(1, 0.2, 12), rng.normal(4, 0.3, 9)
        cut = html_extract.threshold(rng.permutation(np.concatenate([low, high])))
        assert low.max() < cut < high.min()
        assert cut == pytest.approx((low.mean() + high.mean()) / 2)
    assert html_extract.threshold(np.array([2.0, 2.1, 2.2])) == -np.inf


def test_the_ratio_takes_lines_out():
    """A page without marks: lines of many tags and few letters go by the threshold alone."""
    links = "".join(f"<div><a href=x><b>{w}</b></a> <i>{w}</i> <a href=y>{w}</a></div>" for w in "abcdefghij")
    page = f"<body>{links}<div>{A}</div><div>{B}</div><div>{C}</div>{links}</body>"
    assert html_extract.extract(page) == f"{A}\n{B}\n{C}"
    parser = html_extract.Blocks()
    parser.feed(page)
    parser.close()
    assert len(parser.blocks) == 23 and not any(b[2] for b in parser.blocks)


def test_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", f"<p>{A}</p>"), (1, "u", f"<p>{A}</p>"), (None, None, f"<p>{B}</p>"), (2, "v", None), (3, "w", ""), (4, "x", "<p>" + "word " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1)).withColumn("_html", F.lit("clash"))
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages, keep=["url"]).collect())
    want = Counter((i, u, t := " ".join(re.sub("</?p>", "", h or "").split()), len(t)) for i, u, h in rows)
    assert got == want
