from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from orthoplex.llm import htmltext as h

SEMANTIC = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-banner">We use cookies on this site to make it better.</div>
<main><article><h1>Caf&eacute; &amp; more</h1><p>First <b>para</b>graph,\n with   a <a href="x">link</a> in it.<br>And a line.<p>Second one, unclosed &#8212; fine.
<form><label>Search</label><input><button>Go</button></form><aside>Related: something else, with quite a few words in it.</aside><div class="ad-slot">Buy now, today only, everything must go at once.</div>
<ul><li>Point one of the list.</li><li>Point two of the list.</li></ul><p>   </p><blockquote>Somebody said this once.</blockquote></article></main>
<section id="comments"><article class="comment"><p>Great article, I have enjoyed it very much indeed.</p></article></section><footer>&copy; 2024 Site</footer></body></html>"""


def test_semantic_page():
    assert h.extract(SEMANTIC, h.PRIOR) == "\n\n".join([
        "Café & more", "First paragraph, with a link in it. And a line.", "Second one, unclosed — fine.", "Point one of the list.", "Point two of the list.", "Somebody said this once.",
    ])


def test_page_without_semantic_tags():
    page = "<div id=nav><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>Plain paragraph, that goes on for quite a while and then ends.</p><p>Another one, as long as the first of them, it ends here.</p></div><div>Copyright 2020</div>"
    assert h.extract(page, h.PRIOR).split("\n\n")[-2:] == ["Plain paragraph, that goes on for quite a while and then ends.", "Another one, as long as the first of them, it ends here."]


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<p>", "</p></div>", "<!-- never closed", "<script>never closed", "a < b", "<p <p>", "<" * 200, "&#xD800;&#0;"])
def test_odd_pages(page):
    assert isinstance(h.extract(page, h.PRIOR), str)


def test_long_pages_are_whole():
    page = "<article>" + "".join(f"<p>This is paragraph number {k}, with enough words to be one.</p>" for k in range(3000)) + "</article>"
    assert h.extract(page, h.PRIOR).count("\n\n") == 2999


@pytest.mark.parametrize("seed", range(30))
def test_cut_is_minimal(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    gain = rng.normal(size=n).tolist()
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.random(12), strict=True) if a != b]

    def cost(side):
        return sum(g if g > 0 and not s else -g if g < 0 and s else 0 for g, s in zip(gain, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])

    assert cost(h.minimum_cut(gain, edges)) == pytest.approx(min(cost(s) for s in product((False, True), repeat=n)))


def test_operator(spark):
    pages = spark.createDataFrame([(1, "u", SEMANTIC, "x"), (1, "u", SEMANTIC, "x"), (2, None, None, None), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = h.digest(h.main_text(pages)).collect()
    assert sorted((repr(r.page_id), r.n_chars) for r in got)[-2:] == [("2", 0), ("None", 0)] and all(r.n_chars == len(r.text) for r in got)
    assert got[0].text.startswith("Café & more")
    assert h.main_text(pages.limit(0)).count() == 0


def test_training_moves_from_the_prior():
    w = h.train([SEMANTIC] * 3)
    assert w.shape == h.PRIOR.shape and not np.allclose(w, h.PRIOR) and np.array_equal(h.train([]), h.PRIOR)


@pytest.mark.parametrize("start", ["<audio src=x/>", "<math display=block />", "<svg width=1>", "<select><option>", "<div><svg><path></div>", "<div><video></div><p>x</p><video></video>"])
def test_an_element_without_its_end_does_not_hide_the_rest(start):
    texts = [b.text for b in h.blocks_of(f"<body>{start}<article><p>The article stays.</p></article></body>")]
    assert "The article stays." in texts


def test_closed_unseen_elements_hide_their_content_only():
    page = "<p>before <svg><title>t</title><text>in</text></svg>after</p><template><div>a</div><p>b</p></template><p>end</p>"
    assert [b.text for b in h.blocks_of(page)] == ["before after", "end"]


KEPT = "This paragraph belongs to the article, and it has to stay where it is."


@pytest.mark.parametrize(
    "attributes",
    ['title="A hidden valley"', 'data-hidden="false"', 'alt="x id=nav"', 'data-class="nav"', 'class="legal-analysis"', 'class="story-notice"', "data-role=navigation", 'title="style=display:none"', 'class="national-parks"', 'id="searching-for-words"'],
)
def test_attributes_that_name_no_boilerplate(attributes):
    page = f"<body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>First paragraph of the article, long enough to be one.</p><div {attributes}><p>{KEPT}</p></div></article></body>"
    assert KEPT in h.extract(page, h.PRIOR)


@pytest.mark.parametrize("attributes", ["hidden", "hidden=hidden", 'style="display: none"', "aria-hidden=true", 'class="big cookie-notice"', "class=site-footer", "id=comments", 'class="post-comments"', "role=navigation", 'class="sidebar-left"', 'class="share-buttons"', 'title="a > b" class="ad-slot"'])
def test_attributes_that_do(attributes):
    page = f"<body><article><h1>Head</h1><p>First paragraph of the article, long enough to be one.</p><p>Second paragraph of the article, long enough to be one.</p></article><div {attributes}><p>Something else, which is not of the article.</p></div></body>"
    assert h.extract(page, h.PRIOR).endswith("to be one.")


def test_formulas_keep_their_text():
    assert h.extract("<article><p>Let <math><mi>n</mi></math> be a number, and let it be a prime.</p></article>", h.PRIOR) == "Let n be a number, and let it be a prime."


@pytest.mark.parametrize("piece", ["<a b", "<a '", '<a "x', "<div>", "<div>a", "</p>", "<b><div>x", "<font><h1>t", "<!--", "<head>", "<svg>", "<script>", "<a '>' ", "<li>", "<span><p>", "<", "<!", "&amp", "<a href=x>y", "<td>", "<p>x</p>"])
def test_odd_markup_takes_linear_time(piece):
    import time

    began = time.process_time()
    h.blocks_of(piece * ((1 << 19) // len(piece)))
    assert time.process_time() - began < 20


def test_repeated_ids_train_within_bounds(spark):
    pages = spark.createDataFrame([(None if k % 2 else 7, "u", SEMANTIC + f"<!-- {k} -->") for k in range(900)], "page_id long, url string, html string")
    got = h.main_text(pages).select("text").distinct().collect()
    assert [r.text[:11] for r in got] == ["Café & more"]
