"""op4 on pages that are broken, deep, or whose class words mislead; its matcher against a plain one."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from quadspan.llm import html

said = lambda page: [text for _, text in html.outline(page)[3]]


@pytest.mark.parametrize("page", ["<![CDATA[" * 20_000, '<a "' * 20_000, "<a " * 20_000, '<a ">"' * 20_000 + "'", "<script " * 20_000, "</script" * 20_000, "<!--" * 20_000, "<p>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000, "<li><div>" * 10_000, "<div class='ad'>" * 20_000 + "text", "<article><div class='ad'>" * 5_000 + "text"])
def test_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    html.outline(page)
    assert time.perf_counter() - began < 5


def test_class_words_are_weak_evidence():
    assert said("<div class='content has-sidebar'><p>The whole article text.</p></div>") == ["The whole article text."]
    assert said("<div class='sidebar'><p>All of the text stands here.</p></div><p>x</p>") == ["All of the text stands here.", "x"]
    assert said("<div class='text'><p>All of the text stands here.</p></div><div class='sidebar'>menu</div>") == ["All of the text stands here."]


def test_inline_noise():
    assert said("<article><p>Some <b>bold</b> text <span class='ad'>BUY <span>NOW</span></span> goes on.</p><p>More</p></article>") == ["Some bold text goes on.", "More"]
    assert said("<article><p>One <span style='display:none'>hidden</span>two</p></article>") == ["One two"]
    assert said("<article><p>One <span class='promo'>never closed</p><p>Two</p></article>") == ["One", "Two"]


def test_deep_and_long_trees():
    n = 1500
    deep = ["<div>" * n + "<p>one</p>" + "</div>" * n, "<div>" * (n - 1) + "<p>one</p><p>two</p>" + "</div>" * (n - 1)]
    rows = lambda odd: "<table>" + "".join(f"<tr><td>{i}</td>{'<td>x</td>' if i % 3 == odd else ''}</tr>" for i in range(3000)) + "</table>"
    for pair in (deep, [rows(1), rows(2)]):
        began = time.perf_counter()
        assert html.evidence([html.outline(x)[:3] for x in pair])[0] >= 1
        assert time.perf_counter() - began < 8


def plain_match(a, b) -> int:
    """Simple tree matching of (label, children) by its definition."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_match(x, y))
    return m[-1][-1] + 1


def test_matcher_against_the_definition():
    dice = random.Random(4)

    def tree(depth: int):
        return dice.choice("ab"), [tree(depth - 1) for _ in range(dice.randint(0, 3))] if depth else []

    def flat(t, above=-1, parents=None, labels=None):
        parents, labels = ([], []) if parents is None else (parents, labels)
        parents.append(above)
        labels.append(ord(t[0]))
        at = len(parents) - 1
        for x in t[1]:
            flat(x, at, parents, labels)
        return parents, labels

    for _ in range(300):
        a, b = ("r", [tree(3), tree(3)]), ("r", [tree(3), tree(3)])
        matcher = html.Matcher()
        x, y = matcher.tree(*flat(a))[0][0], matcher.tree(*flat(b))[0][0]
        score, pairs = matcher.match(x, y)
        assert score == plain_match(a, b)
        assert score == 1 + sum(matcher.match(matcher.of[x][1][i], matcher.of[y][1][j])[0] for i, j in pairs)


def test_ambiguous_names_inside_an_article():
    assert said("<article><h1>T</h1><div class='related-work'><p>Related work ...</p></div><p>Body</p></article>") == ["T", "Related work ...", "Body"]
    assert said("<main><div class='post-discussion'><p>We discuss ...</p></div><p>More.</p></main>") == ["We discuss ...", "More."]
    assert said("<article><p>Body</p><div class='related-links'><p>x</p></div><div class='post-comments'>Nice</div><div class='ad-slot'>Buy</div></article>") == ["Body"]


def test_blocks_with_a_link():
    assert said("<p>see <a>one link only</a></p><p>Text</p>") == ["see one link only", "Text"]
    assert said("<p><a>Home</a> &middot; <a>About</a></p><p>Text</p>") == ["Text"]


def test_nested_doubts():
    """As many nested elements as one likes; of two in each other both are kept while they have most of the text."""
    assert said("<div class='ad'>" * 2000 + "<p>All of it</p>") == ["All of it"]
    assert said("<div class='sidebar'><p>Long text of the page.</p><div class='ad'>buy</div></div>") == ["Long text of the page."]
    assert said("<div class='sidebar'><article><p>Long text.</p></article><div class='ad'>more than half of the text of this page</div></div>") == ["Long text."]
    assert said("<div class='promo'><article>teaser</article></div><article>The text</article>") == ["The text"]


def test_long_lists_are_aligned_exactly():
    """Halved tables give the weight of one whole table."""
    dice = np.random.default_rng(5)
    whole = html.CELLS
    for _ in range(60):
        weight = dice.integers(0, 5, (6, 7))
        x, y = dice.integers(0, 6, dice.integers(1, 40)), dice.integers(0, 7, dice.integers(1, 40))
        try:
            want = html._heaviest(weight, x, y)[0]
            html.CELLS = 12
            total, pairs = html._heaviest(weight, x, y)
        finally:
            html.CELLS = whole
        assert total == want == sum(int(weight[x[i], y[j]]) for i, j in pairs)
        assert all(a[0] != b[0] and a[1] != b[1] for a in pairs for b in pairs if a is not b)
        assert [j for _, j in sorted(pairs)] == sorted(j for _, j in pairs)
