"""Main text of pages: planted layouts, odd markup, and the cut against all labellings."""

import itertools
import random
import time

import pytest

from panelwright.llm.html_text import extract, main_text
from panelwright.llm.mincut import settle

P1 = "The river rose during the night and by the morning it had covered the lower meadows, the mill and both of the bridges near the town."
P2 = "Nobody had expected so much water, though the older people said that they had seen worse when they were children and lived by the weir."
P3 = "A short end."


def cost(labels, pull, edges):
    return sum(max(p, 0) if not s else max(-p, 0) for p, s in zip(pull, labels)) + sum(c for i, j, c in edges if labels[i] != labels[j])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    pull = [r.randint(-6, 6) for _ in range(n)]
    edges = [(r.randrange(n), r.randrange(n), r.randint(0, 5)) for _ in range(r.randint(0, 14))]
    edges = [e for e in edges if e[0] != e[1]]
    every = [(cost(x, pull, edges), sum(x), x) for x in itertools.product([False, True], repeat=n)]
    best = min(every)
    got = settle(pull, edges)
    assert cost(got, pull, edges) == best[0] and sum(got) == best[1]


def test_cut_of_a_long_undecided_chain_ends():
    n = 30_000
    r = random.Random(1)
    t = time.time()
    settle([r.randint(-100, 100) for _ in range(n)], [(i, i + 1, 60) for i in range(n - 1)] + [(i, i + 2, 100) for i in range(n - 2)])
    assert time.time() - t < 60


def joined(*blocks):
    return "\n\n".join(blocks)


def test_semantic_page():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var x = "</p><article>";</script></head><body class="has-sidebar">
    <header><a href="/">Site</a><nav><ul><li><a href=/a>Home<li><a href=/b>News</ul></nav></header>
    <div class="cookie-notice" role=dialog>We use cookies to make this site better for all of our readers. <button>Accept all</button></div>
    <main><article><header><h1>Flood in&nbsp;town</h1></header><p>{P1}</p><div class="ad-slot"><p>{P2} Buy now.</p></div>
    <p>{P2}<p>{P3}<form><label>Mail</label><input name=q><p>Subscribe to our letter and read all of it every day of the week.</p></form>
    <section class="comments"><h2>Comments</h2><article class="comment"><p>{P1} I was there.</p></article></section></article></main>
    <aside><h3>Related</h3><p>{P1} Read this too.</p></aside><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
    assert main_text(page) == joined("Flood in town", P1, P2, P3)


def test_page_of_divs():
    page = f"""<body><div id="top"><a href=1>Home</a> <a href=2>World</a> <a href=3>Sport</a></div><div class="menu"><div><a href=4>More</a></div></div>
    <div id="page"><div><h1>Flood</h1><div>{P1}</div><div>{P2}</div><div>{P3}</div><div>{P1}</div></div></div>
    <div class="sidebar"><div>{P2} Elsewhere.</div></div><div id="footer">© Site</div></body>"""
    assert main_text(page) == joined("Flood", P1, P2, P3, P1)


def test_neighbours_decide_a_block_without_evidence():
    inside = f"<body><div><p>{P1}</p><p>Yes</p><p>{P2}</p></div></body>"
    outside = f"<body><div><p>{P1}</p></div><div><p><a href=1>One</a></p><p>Yes</p><p><a href=2>Two</a></p></div></body>"
    assert main_text(inside) == joined(P1, "Yes", P2)
    assert main_text(outside) == P1


def test_wrapper_named_like_a_menu_does_not_swallow_the_article():
    page = f"<body><div class='page with-sidebar'><div class=sidebar>{P2}</div><article><p>{P1}</p><p>{P3}</p></article></div></body>"
    assert main_text(page) == joined(P1, P3)


def test_inner_white_space_breaks_and_references():
    page = f"<article><p> a\n\t <b>b</b>c<br>d &amp;amp; &lt;p&gt; &#8364;&eacute; </p><pre>x\n  y</pre><p>{P1}<!-- no --></article>"
    assert main_text(page) == joined("a bc d &amp; <p> €é", "x y", P1)


def test_odd_markup():
    for page in (None, "", " ", "<", "<<<>>>", "</p></p>", "<script>never closed <p>x</p>", "<!-- open", "<p", "<a href='x", "&", "<style>"):
        assert isinstance(main_text(page), str)
    assert main_text(f"<article><p>{P1}<p>{P2}") == joined(P1, P2)
    assert main_text(f"<ARTICLE><P>{P1}</ARTICLE></div></div><P class='x>y'>") == P1
    assert main_text(f'<article><p title="a>b">{P1}</p><div hidden><p>{P2}</p></div><div style="display: none">{P2}</div></article>') == P1
    assert main_text(f"<article><p><b>{P1}<br><p>{P2}</p></article>") == joined(P1, P2)


def test_deep_long_and_hostile_pages_end():
    t = time.time()
    assert main_text("<div>" * 50_000 + P1 + "</span></x>" * 50_000).endswith("town.")
    long = "<article>" + f"<p>{P1}</p>" * 20_000 + "</article>"
    assert len(main_text(long)) == 20_000 * (len(P1) + 2) - 2
    main_text("<a href='" * 20_000)
    main_text("<p " * 50_000)
    main_text("<script " * 20_000)
    assert time.time() - t < 90


def test_rows_keep_ids_urls_and_length(spark):
    schema = "page_id long, url string, html string, text int, n_chars string, region double"
    page = f"<article><p>{P1} 😀</p></article>"
    rows = [(1, "u", page, 1, "x", 0.5), (1, "u", page, 1, "x", 0.5), (None, None, None, None, None, None), (2, "v", "", 1, "x", 0.5)]
    got = [tuple(r) for r in extract(spark.createDataFrame(rows, schema)).collect()]
    assert got.count((1, "u", f"{P1} 😀", len(P1) + 2)) == 2 and (None, None, "", 0) in got and (2, "v", "", 0) in got and len(got) == 4
    assert extract(spark.createDataFrame([], schema)).collect() == []
