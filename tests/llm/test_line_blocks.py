"""Lines, surge and dive of HTML pages against plain versions."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import line_blocks as L


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 5, 15, 39, 40, 100]), max_size=25), st.integers(1, 4), st.integers(1, 120))
def test_bounds_equal_brute_force(weight, window, dense):
    dense_lines = set()
    for first in range(-window + 1, len(weight)):
        held = [i for i in range(first, first + window) if 0 <= i < len(weight)]
        if sum(weight[i] for i in held) >= dense:
            dense_lines.update(held)
    among = [i for i in (range(min(dense_lines), max(dense_lines) + 1) if dense_lines else range(len(weight))) if weight[i]]
    # A window behind the last line holds no more than the one that ends there.
    assert L.bounds(weight, window, dense) == ((among[0], among[-1]) if among else None) or not dense_lines


PROSE = "This is a sentence of the article with some words in it."


def page_of(draw):
    """A page of plain blocks and the text it must give."""
    head = [f"<div>{draw.choice(['Home | About | Contact', 'Example Site', 'News · Sport · Weather'])}</div>" for _ in range(draw.randint(0, 3))]
    menu = [f'<div><a href="/{k}">Entry {k}</a></div>' for k in range(draw.choice([0, 3, 60]))]
    title = draw.choice([[], ["A headline"], ['<a href="/">A linked headline</a>']])
    body = [draw.choice([PROSE, "Short.", "Words without an end", '<a href="/x">A link</a>', PROSE * 3]) for _ in range(draw.randint(0, 8))]
    body = [PROSE, *body, PROSE]
    more = [f'<p><a href="/m{k}">More {k}</a></p>' for k in range(draw.choice([0, 1, 2]))]
    foot = [f"<div>{draw.choice(['Copyright 2024 Example Ltd. All rights reserved.', '(c) 2024 Example Ltd', '© Example'])}</div>" for _ in range(draw.randint(1, 2))]
    tag = draw.choice(["p", "div"])
    html = [*head, *menu, *(f"<h1>{x}</h1>" for x in title), *(f"<{tag}>{x}</{tag}>" for x in body), *more, *foot]
    plain = [x.split(">")[1].split("<")[0] if x.startswith("<a") else x for x in [*title, *body]]
    plain += [f"More {k}" for k in range(len(more))]
    return "<html><body>" + "\n".join(html) + "</body></html>", "\n".join(plain)


@pytest.mark.parametrize("seed", range(60))
def test_plain_blocks_lose_menus_and_footers(seed):
    page, expected = page_of(random.Random(seed))
    assert L.main_text(page) == expected


def test_furniture_by_structure_before_names():
    page = (
        "<article><h1>T</h1><p class=legal>Law.</p><div class='related-work'>Work.</div><section id=feedback>Loops.</section><p><label>Label</label></p>"
        "<div class=ad>Buy</div><div class='share-bar'>Share</div><nav>Menu</nav><div class=comments>Nice</div><form><label>Name</label></form></article>"
    )
    assert L.main_text(page) == "T\nLaw.\nWork.\nLoops.\nLabel"


@pytest.mark.parametrize(
    "page",
    ["<a" * 100_000, "<x " * 100_000, "a<b<c<d" * 50_000, "<a '" * 100_000, "<a \"'>" * 60_000, "<!--" * 100_000, "<script>" * 50_000, "</p" * 100_000, "<p>" * 30_000, "<a href=\"x>y</a> " * 50_000],
)
def test_malformed_markup_takes_linear_time(page):
    start = time.process_time()
    L.main_text(page)
    assert time.process_time() - start < 3


def test_scan():
    page = """a<b c='>' d=">">e</b><!-- <i> --><script>if (a<b) "</p>"</script >f<![CDATA[ g ]]>h < i<br/>j<em k"""
    assert list(L.scan(page)) == [
        ("text", "", "a"), ("open", "b", """ c='>' d=">\""""), ("text", "", "e"), ("shut", "b", ""), ("text", "", "f"), ("text", "", "h "),
        ("text", "", "<"), ("text", "", " i"), ("open", "br", "/"), ("text", "", "j"),
    ]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_surge_of_a_named_article(tag):
    """A menu before the text goes, also where nothing but its lines marks it; a few links before it, and any behind it, stay."""
    def items(n):
        return "<ul>" + "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(n)) + "</ul>"

    body = f"<h1>T</h1><p>Text.</p>{items(4)}<p>More text.</p>"
    plain = "T\nText.\nLink 0\nLink 1\nLink 2\nLink 3\nMore text."
    links = "\n".join(f"Link {k}" for k in range(5))
    assert L.main_text(f"<{tag}>{items(5)}{body}</{tag}>") == plain
    assert L.main_text(f"<{tag}>{body}{items(5)}</{tag}>") == f"{plain}\n{links}"
    assert L.main_text(f"<{tag}>{items(2)}{body}</{tag}>") == f"Link 0\nLink 1\n{plain}"
    assert L.main_text(f"<{tag}>{items(5)}</{tag}>") == links
    divs = "".join(f'<div><a href="/{k}">Head {k}</a></div>' for k in range(4))
    assert L.main_text(f"<{tag}>{divs}{body}</{tag}>") == f"Head 0\nHead 1\nHead 2\nHead 3\n{plain}"
