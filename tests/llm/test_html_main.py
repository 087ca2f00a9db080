"""Pages of forms that the given tables do not have."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tidewell.llm import html_main as H
from tidewell.llm import queries as Q
from tidewell.llm.html_main import main_text

LONG = "This is a paragraph of the text, long enough to be taken for what it is, and it ends here."
OTHER = "Another paragraph comes after it; it is about as long as the first one, and says no more."
BODY = f"<h1>The title</h1><p>{LONG}</p><p>{OTHER}</p>"
TEXT = f"The title\n{LONG}\n{OTHER}"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content-with-sidebar'><article>{BODY}</article></div>",
        f"<div class='layout-sidebar-right'><article>{BODY}</article></div>",
        f"<div class='sidebar-layout'><main>{BODY}</main></div>",
        f"<div id='page-header'><div role='main'>{BODY}</div></div>",
        f"<article><header class='entry-header'><h1>The title</h1></header><p>{LONG}</p><p>{OTHER}</p></article>",
        f"<form id='all'><div class='post'>{BODY}</div><div class='comments'><p>{LONG}</p></div></form>",
        f"<form><article>{BODY}</article></form><nav><a>Home</a></nav>",
        f"<div class='widget'><div class='text'>{BODY}</div></div>",
    ],
)
def test_names_of_wrappers_do_not_drop_the_text(page):
    assert main_text(f"<html><body>{page}</body></html>") == TEXT


@pytest.mark.parametrize("name", ["sidebar-right", "related-posts", "comments", "cookie-notice", "share", "site-footer", "ad"])
def test_names_still_speak_against(name):
    for around in ("article", "div class='content'"):
        assert main_text(f"<{around}>{BODY}<div class='{name}'><p>{LONG} {LONG} {LONG}</p><p>{OTHER}</p></div></{around.split()[0]}>") == TEXT
    assert main_text(f"<article>{BODY}</article><div class='comments'><article class='comment-body'><p>{LONG}</p></article></div>") == TEXT


@pytest.mark.parametrize("mark", ["<svg class='i'/>", "<svg viewBox='0 0 1 1' />", "<math/>", *(f"<{tag} id='x'>" for tag in ("svg", "math", "object", "select", "video", "audio", "canvas", "template"))])
def test_skipped_elements_without_an_end(mark):
    assert main_text(f"<article><h1>The title{mark}</h1>{mark}<p>{LONG}</p>{mark}<p>{OTHER}</p></article>") == TEXT


def test_skipped_elements_with_an_end():
    icon = "<svg/>"
    for tag in ("svg", "math", "object", "select", "video", "audio", "canvas", "template", "iframe", "script"):
        assert main_text(f"<article><h1>The title</h1><p>{LONG}</p><{tag} a='/'>no text</{tag}><p>{OTHER}</p></article>") == TEXT
    assert main_text(f"<article><h1>The title</h1>{icon}<p>{LONG}</p><svg><text>no</text></svg><p>{OTHER}</p></article>") == TEXT
    assert main_text(f"<article><h1>The title</h1><p>{LONG}</p><p>{OTHER}</p><script>no</article>") == TEXT


LISTS = [
    ("<ul><li>Two eggs</li><li>Some flour</li><li>Salt</li></ul>", "Two eggs\nSome flour\nSalt"),
    ("<ol><li>One<li>Two<li>Three</ol>", "One\nTwo\nThree"),
    ("<table><tr><th>Year</th><th>Sum</th></tr><tr><td>1990</td><td>12</td></tr><tr><td>1991</td><td>15</td></tr></table>", "Year\nSum\n1990\n12\n1991\n15"),
    ("<dl><dt>Term</dt><dd>Its meaning</dd><dt>Word</dt><dd>Another</dd></dl>", "Term\nIts meaning\nWord\nAnother"),
    ("<ul><li>Fruit<ul><li>Apple</li><li>Pear</li></ul></li><li>Bread</li></ul>", "Fruit\nApple\nPear\nBread"),
    (f"<ul>{'<li>Two words</li>' * 40}</ul>", "\n".join(["Two words"] * 40)),
]


@pytest.mark.parametrize(("part", "text"), LISTS)
@pytest.mark.parametrize("around", ["<div class='post-content'>", "<div>", "<article>"])
def test_lists_and_tables_follow_the_text_around_them(around, part, text):
    links = "<ul><li><a>Home page</a></li><li><a>All news</a></li></ul>"
    end = f"</{around[1:].split()[0].rstrip('>')}>"
    assert main_text(f"<html><body>{links}{around}<p>{LONG}</p>{part}<p>{OTHER}</p>{end}{links}<footer>{part}<p>{LONG}</p></footer></body></html>") == f"{LONG}\n{text}\n{OTHER}"
    assert main_text(f"<html><body>{around}<p>{LONG}</p><p>{OTHER}</p>{part}{end}<div class='menu'>{part}</div></body></html>") == f"{LONG}\n{OTHER}\n{text}"


def test_lists_of_links_stay_out():
    links = "<ul><li><a>Home page</a></li><li><a>All news</a></li></ul>"
    assert main_text(f"<div class='content'><p>{LONG}</p><p>{OTHER}</p>{links}</div>") == f"{LONG}\n{OTHER}"


def test_large_tables_and_lists():
    rows = "".join(f"<tr><td>a</td><td>{LONG}</td></tr>" for _ in range(2000))
    assert main_text(f"<table>{rows}</table>").count("\n") == 3999
    items = f"<p>{LONG}</p><ul><li>a</li><li><a>b</a></li></ul>" * 1000
    assert main_text(f"<ul><li>a</li></ul><div>{items}</div>").count(LONG) == 1000


@pytest.mark.parametrize("page", [f"<article class='social-policy'>{BODY}</article>", f"<div class='post-header-text'>{BODY}</div>", f"<div class='share-holder-story'>{BODY}</div>", f"<p>{LONG}</p><video>"])
def test_pages_that_lost_their_text(page):
    assert main_text(page) == (TEXT if "title" in page else LONG)


def test_page_with_only_a_short_list():
    assert main_text("<ul><li>Milk</li><li>Two eggs</li></ul>") == main_text("<main><ul><li>Milk</li><li>Two eggs</li></ul></main>") == "Milk\nTwo eggs"


def test_cut_is_right_where_the_sign_is_wrong():
    """Short parts of an article are unlikely by themselves and stay; a fluent advert is likely and goes."""
    page = H.parsed(f"<article><h1>Title</h1><p>{LONG}</p><p>So</p><div>a b c</div><p>{OTHER}</p><div class='ad'><p>{LONG} {LONG}</p></div></article><footer><p>{OTHER} {LONG}</p></footer>")
    of_text = H.Scores()
    by_sign = [of_text[H.cell(b)] >= 0 for b in page.blocks]
    assert by_sign == [False, True, False, False, True, True, True]
    assert H.label(page, of_text) == [True, True, True, True, True, False, False]


def test_labels_against_all_labellings():
    """The labels of whole pages have the least cost of all labellings of blocks and elements."""
    rng = random.Random(2)
    of_text = H.Scores()
    for _ in range(25):
        parts = [rng.choice(["<p>{}</p>", "<div class='ad'><p>{}</p></div>", "<article><p>{}</p><p>So</p></article>", "<nav><ul><li><a>x</a></li></ul></nav>", "<ul><li>a</li><li>{}</li></ul>", "<div class='post'>{}</div>"]).format(rng.choice([LONG, "Two words", OTHER + LONG])) for _ in range(rng.randint(1, 3))]
        page = H.parsed(rng.choice(["{}", "<form>{}</form>", "<div class='content'>{}</div>"]).format("".join(parts)))
        scores, edges = H.network(page, of_text)

        def cost(lab, scores=scores, edges=edges):
            return sum(abs(s) for s, c in zip(scores, lab, strict=True) if (s > 0) != c) + sum((t if lab[a] else b_) for a, b, t, b_ in edges if lab[a] != lab[b])

        assert cost(H.minimum_cut(scores, edges)) == min(map(cost, itertools.product([False, True], repeat=len(scores))))


def test_training_on_the_given_pages(spark, sf):
    """The fitted weights are the optimum, and the cut mends labels that they alone get wrong."""
    pages = Q.table(spark, sf, "pages")
    weights = H.trained(pages)
    counts = {}
    changed = total = 0
    of_text = H.Scores(weights)
    for r in pages.collect():
        page = H.parsed(r["html"] or "")
        labels = H.label(page, of_text)
        for b, content in zip(page.blocks, labels, strict=True):
            total += 1
            changed += (of_text[H.cell(b)] >= 0) != content
            if b.sure:
                assert content == (b.sure > 0)
                counts.setdefault(H.cell(b), [0, 0])[b.sure < 0] += 1
    assert changed > 0.02 * total
    x, n = H.features(np.array(list(counts))), np.array(list(counts.values()), dtype=float) * H.WEIGHT / sum(map(sum, counts.values()))
    value = lambda w: (n[:, 0] * np.logaddexp(0, -x @ w) + n[:, 1] * np.logaddexp(0, x @ w)).sum() + 0.5 * (H.PRECISION * (w - H.PRIOR) ** 2).sum()
    rng = np.random.default_rng(0)
    assert all(value(weights + 0.01 * rng.standard_normal(7)) >= value(weights) for _ in range(200))
    assert np.array_equal(H.trained(pages.limit(0)), H.PRIOR)


def test_text_without_markup_notices_and_references():
    words = "Just some words without markup at all in this page."
    assert main_text(words) == words and main_text("<p") == ""
    notice = "<div><p>We use cookies to make this page better for you. Accept all.</p></div>"
    assert main_text(f"{notice}<article>{BODY}</article>") == main_text(f"{notice}<div>{BODY}</div>") == TEXT
    links = "<ul><li><a href='a'>First source of this</a></li><li><a href='b'>Second source</a></li></ul>"
    assert main_text(f"<article>{BODY}{links}</article>") == f"{TEXT}\nFirst source of this\nSecond source"


def test_the_classifier_decides(spark, sf):
    """Its log odds are the only terminal capacities: turned around, they turn all labels around."""
    weights, markup = H.classifier(Q.table(spark, sf, "pages"))
    of_text = H.Scores(weights, markup)
    same = total = 0
    for r in Q.table(spark, sf, "pages").collect():
        page = H.parsed(r["html"] or "")
        scores, edges = H.network(page, of_text)
        assert len(scores) == len(page.blocks)
        turned = H.minimum_cut([-s for s in scores], edges)
        same += sum(a == b for a, b in zip(H.minimum_cut(scores, edges), turned, strict=True))
        total += len(scores)
    assert same < 0.1 * total


def test_edges_mend_what_signs_get_wrong():
    page = H.parsed(f"<div><p>{LONG}</p><h2>Two words</h2><p>{OTHER}</p><p>So</p><p>{LONG}</p></div><div><div>x</div><div>y z</div></div>")
    scores, edges = H.network(page, H.Scores())
    assert H.minimum_cut(scores, []) == [True, False, True, False, True, False, False]
    assert H.minimum_cut(scores, edges) == [True, True, True, True, True, False, False]


def test_markup_is_fitted_given_the_text():
    cells = np.array([[5, 0, 0, 0], [20, 1, 0, 1]])
    yes, no = np.array([30.0, 10.0]), np.array([50.0, 0.0])
    both, kind = np.concatenate([cells, cells]), np.repeat([H.WHOLE, H.APART], 2)
    none = np.zeros(2)
    fitted = H.fit_markup(both, kind, np.concatenate([yes, none]), np.concatenate([none, no]), H.PRIOR)
    text, scale = np.clip(H.features(cells) @ H.PRIOR, -5, 5), H.WEIGHT / 90
    for k, n, sign in ((H.WHOLE, yes, 1), (H.APART, no, -1)):
        value = lambda w, k=k, n=n, sign=sign: (n * scale * np.logaddexp(0, -sign * (text + w))).sum() + 0.5 * H.MARKUP_PRECISION * (w - H.MARKUP[k]) ** 2
        assert all(value(fitted[k] + d) > value(fitted[k]) for d in (-0.01, 0.01))
    assert np.array_equal(H.fit_markup(cells[:0], np.zeros(0), none[:0], none[:0], H.PRIOR), H.MARKUP)
