"""Main text against the known template of the pages, and minimum cuts against all labellings."""

import html
import random
import re
from itertools import product

from streetgrove.llm import html_text as h


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 8)
        costs = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 6)) for _ in range(rng.randint(0, 12))] if n else []

        def price(side, costs=costs, edges=edges):
            return sum(abs(c) for c, s in zip(costs, side, strict=True) if (c > 0) != s and c) + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(product([False, True], repeat=n), key=lambda s: (price(s), sum(s)))
        got = h.minimum_cut(costs, edges)
        assert price(got) == price(best) and sum(got) == sum(best)


def template(page):
    """The article of the synthetic pages, read by its known marks."""
    body = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = [html.unescape(re.sub(r"<[^>]+>", " ", x)) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_pages_of_the_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in h.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == template(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


LONG = "This sentence is long enough to look like the prose of an article, is it not."


def test_other_layouts():
    page = f"""<html><body class="with-sidebar comments-open"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
    <div class="cookie-notice">We use cookies. {LONG}</div>
    <div id="content"><div class="post-header"><h2>A title</h2></div><p>{LONG}</p><p>Short.</p><script>var a="<p>no</p>";</script>
    <p>Tom &amp; <b>Jerry</b>&nbsp;&#8212; done<br>now. {LONG}</p><div class="ad">Buy. {LONG}</div><p>{LONG}</p></div>
    <aside><p>{LONG}</p></aside><div class="sidebar"><ul><li><a href=x>{LONG}</a></li></ul></div>
    <form><label>Name</label><input><button>Send</button></form>
    <div id="comments"><p>Reader: {LONG}</p></div><footer>&copy; all. {LONG}</footer>"""
    assert h.main_text(page) == "\n".join(["A title", LONG, "Short.", f"Tom & Jerry — done now. {LONG}", LONG])
    page = f"<main><article><header><h1>Head</h1></header><p>One.<p>{LONG}<ul><li>x<li>y</ul><section class='comments'><article class=comment><p>{LONG}</p></article></section></article></main><div>{LONG}</div>"
    assert h.main_text(page) == "\n".join(["Head", "One.", LONG, "x", "y"])
    assert h.main_text("") == ""
    assert h.main_text("<div><p>" * 3000) == ""
    assert h.main_text("<!-- only --><script>x") == ""


def test_nulls_and_empty_table(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", f"<p>{LONG}</p>"), (2, "u", f"<p>{LONG}</p>")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = sorted([tuple(r) for r in h.extract(pages).collect()], key=str)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (None, "u", LONG, len(LONG)), (2, "u", LONG, len(LONG))], key=str)
    assert h.extract(pages.limit(0)).count() == 0


def test_unclosed_and_nested_elements_cut_nothing():
    said = "The street was planted with limes in spring, and all of them grew well over the summer."
    rest = f"<p>{said}</p><p>{said}</p>"
    for tag in ("button", "select", "object", "canvas", "noscript", "template", "svg"):
        assert h.main_text(f"<article><div><{tag}></div>{rest}</article>").count(said) == 2, tag
        assert h.main_text(f"<article><div><{tag}>Share</{tag}></div>{rest}<{tag}></article>") == f"{said}\n{said}", tag
    assert h.main_text(f"<article><p><svg>a<svg>b</svg>c</svg>{said}</p>{rest}</article>") == "\n".join([said] * 3)
    assert h.main_text(f"<article><p><math>x</math> is wide. {said}</p>{rest}</article>").startswith("x is wide. The")
