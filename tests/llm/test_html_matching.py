"""Simple tree matching against a plain recursion, and template over whole hosts."""

import time
from functools import lru_cache

import numpy as np

from caseloom.llm import html_extract


def random_tree(rng, depth):
    node = html_extract.Node(str(rng.choice(["div", "p", "ul"])))
    if depth:
        node.kids = [random_tree(rng, depth - 1) for _ in range(rng.integers(0, 5))]
    return node


def plain_match(a, b):
    @lru_cache(None)
    def best(x, y):
        if x.tag != y.tag:
            return 0
        m = np.zeros((len(x.kids) + 1, len(y.kids) + 1), int)
        for i, p in enumerate(x.kids):
            for j, q in enumerate(y.kids):
                m[i + 1, j + 1] = max(m[i, j + 1], m[i + 1, j], m[i, j] + best(p, q))
        return 1 + m[-1, -1]

    return best(a, b)


def places(root):
    out, todo = {}, [(root, ())]
    while todo:
        node, at = todo.pop()
        out[id(node)] = at
        todo += [(k, (*at, n)) for n, k in enumerate(node.kids)]
    return out


def test_random_trees(monkeypatch):
    monkeypatch.setattr(html_extract, "STEP", 1)
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = random_tree(rng, 4), random_tree(rng, 4)
        score, pairs = html_extract.simple_tree_match(a, b)
        assert score == plain_match(a, b)
        if a.tag == b.tag:
            assert len(pairs) == score
        x, y = places(a), places(b)
        pairs = sorted((x[id(p)], y[id(q)]) for p, q in pairs)
        assert all(len(p) == len(q) for p, q in pairs)
        assert all(p1[:-1] != p2[:-1] or (q1[:-1] == q2[:-1] and q1 < q2) for (p1, q1), (p2, q2) in zip(pairs, pairs[1:]))


def test_deep_and_wide_pages_are_quick():
    for a, b in (("<div><b></b>" * 2000 + "x", "<div><i></i>" * 2000 + "y"), ("<p>a<ul></ul>" * 3000, "<p>a<b></b>" * 2500)):
        began = time.process_time()
        x, y = html_extract.parse(a), html_extract.parse(b)
        html_extract.simple_tree_match(x, y)
        html_extract.main_text(a, [html_extract.Reference(b)])
        assert time.process_time() - began < 5


def test_class_names_count_as_a_whole():
    page = """<body><article><section id="side-effects"><h2>Side effects</h2><p>None.</p></section><div class="social-policy"><p>Policy.</p></div>
    <div class="cookie-notice">x</div><div class="site-header">y</div><ul class="share"><li>z</ul><div id="comments">w</div></article></body>"""
    assert html_extract.main_text(page, []) == "Side effects\n\nNone.\n\nPolicy."


def test_a_form_around_the_page_is_kept():
    page = "<body><form><nav>m</nav><div><p>The text of this page is long enough.</p><p>More.</p></div></form><form><p>Subscribe</p><input></form></body>"
    assert html_extract.main_text(page, []) == "The text of this page is long enough.\n\nMore."


def test_template_inside_articles(spark):
    """A line that all pages of a host have goes; texts of copies stay."""
    rows = [(k, f"http://h.x/{k}", f"<article><h1>Title {k}</h1><p>{'word ' * 20}{k}</p><p class=x>Read more on our site</p></article>", 0) for k in range(6)]
    copied = "<p>" + "the same text " * 10 + "</p>"
    rows += [(10 + k, f"http://c.x/{k}", f"<div class=ad>{k}</div><article><h1>Copy</h1>{copied}</article>", 0) for k in range(5)]
    rows += [(20 + k, "http://r.x/", "<article><h1>Equal</h1><p>rows</p></article>", 0) for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, common int").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    for k in range(6):
        assert got[k] == f"Title {k}\n\n{'word ' * 20}{k}"
    for k in range(5):
        assert got[10 + k] == "Copy\n\n" + ("the same text " * 10).strip()
    assert all(got[20 + k] == "Equal\n\nrows" for k in range(3))


def test_pages_travel_compressed(spark):
    """What meets the references holds pages compressed (as plain html before), and gives the same texts back."""
    texts = [None, "", "plain é ▁ 😀", "<article><p>One &amp; two.</p></article>" * 50, "<article><p>One &amp; two.</p></article>" * 50]
    pages = spark.createDataFrame([(k, None if k == 2 else "http://a.org/x", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    found = html_extract.extract_main_text(pages)
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    shuffled = plan.children().head().output().mkString(",")
    assert "body" in shuffled and "html" not in shuffled
    got = {r.page_id: r.text for r in found.collect()}
    assert got == {0: "", 1: "", 2: "plain é ▁ 😀", 3: "\n\n".join(["One & two."] * 50), 4: "\n\n".join(["One & two."] * 50)}
