"""Spans of table cells, visibility, and depth."""

import random
import time

import pytest

from twinspect.llm import htmltext


@pytest.mark.parametrize(
    "page,want",
    [
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
        ("<table><tr><td>x<td rowspan=3>B<td>y<tr><td>z<td>w<tr><td>q</table>", "x  B  y\nz     w\nq"),
        ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d</table>", "A  b\n   c\nd"),
        ("<table><tbody><tr><td rowspan=9>A<td>b<tbody><tr><td>d<td>e</table>", "A  b\nd  e"),
        ("<table><tr><td colspan=2>a wide one<td>z<tr><td>b<td>c<td>d</table>", "a wide one  z\nb  c        d"),
        ("<table><tr><td colspan=1000>a<td>b<tr><td colspan=1000>cc<td>d</table>", "a   b\ncc  d"),
        ("<table><tr><td rowspan=x>A<td colspan=0>b</table>", "A  b"),
        ('<p style="visibility:hidden">a <b style="visibility:visible">b</b> c<p>d', "b\n\nd"),
        ('<ul style="visibility:hidden"><li>a<li style="visibility:visible">b</ul>', "- b"),
        ('<p style="visibility:visible;visibility:hidden">a</p>b', "b"),
        ('<p hidden style="display:block">a<p hidden>b', "a"),
        ('<p style="display:none"><b style="display:inline">a</b></p>b', "b"),
        ("<div>" * 450 + "<div hidden>SECRET <b>SECRET</b></div>open" + "</div>" * 450 + "end", "open\nend"),
        ("<div>" * 450 + '<i style="visibility:hidden">SECRET <b style="visibility:visible">open</b> SECRET</i> on', "open on"),
        ("<div>" * 450 + "<table><tr><td>a<td>b<tr><td>c</table>", None),
    ],
)
def test_spans_and_visibility(page, want):
    got = htmltext.text_of(page)
    assert got == want if want is not None else got.split() == ["a", "b", "c"]


def test_spans_against_a_grid():
    """Every cell of one character stands at the place that a plain grid of columns gives it."""
    rng = random.Random(81)
    for _ in range(300):
        rows = [[(rng.choice((1, 1, 2, 3)), rng.choice((1, 1, 2, 3))) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 5))]
        taken, at, page, n = set(), {}, "", 0
        for y, row in enumerate(rows):
            page, x = page + "<tr>", 0
            for across, down in row:
                while (y, x) in taken:
                    x += 1
                at[n] = (y, x)
                page += f"<td colspan={across} rowspan={down}>{chr(0x100 + n)}"
                taken |= {(y + b, x + a) for a in range(across) for b in range(down)}
                x, n = x + across, n + 1
        lines = htmltext.text_of(f"<table>{page}</table>").split("\n")
        shown = {c: (y, x) for y, line in enumerate(lines) for x, c in enumerate(line) if c != " "}
        assert len(shown) == n and all(shown[chr(0x100 + k)][0] == y for k, (y, _) in at.items())
        order = lambda places: [[k for k, _ in sorted(places.items(), key=lambda p: p[1][1]) if places[k][0] == y] for y in range(len(rows))]
        assert order({k: shown[chr(0x100 + k)] for k in at}) == order(at)
        by_column = {}
        for k, (_, x) in at.items():
            by_column.setdefault(x, set()).add(shown[chr(0x100 + k)][1])
        assert all(len(v) == 1 for v in by_column.values())


def test_deep_pages_take_time_by_their_length():
    began = time.time()
    assert htmltext.text_of("<b>" * 100_000 + "<p>x<div>y" * 2_000).count("y") == 2_000
    assert htmltext.text_of("<table><tr><td>" * 3_000 + "x") == "x" and htmltext.text_of("<div hidden>" * 100_000 + "x") == ""
    assert time.time() - began < 30


@pytest.mark.parametrize("page,want", [
    ("<table><b>out</b><tr><td>in</table>", "out\n\nin"),
    ("<p>a</p><table>stray<tr><td>x<td>y</table>b", "a\n\nstray\n\nx  y\n\nb"),
    ("<details><summary>more</summary><p>unseen</p></details>end", "more\nend"),
    ("<details open><summary>more</summary>seen</details>end", "more\nseen\nend"),
    ("<details>unseen</details>end", "end"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=10><li>a<li value=5>b<li>c</ol>", "10. a\n5. b\n4. c"),
    ("<textarea>\n one\n two</textarea>", " one\n two"),
    ("<pre>\r\n one</pre>", " one"),
    ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
    ("<table><tr><td>e\u0301\u0301<td>x<tr><td>ab<td>y</table>", "e\u0301\u0301   x\nab  y"),
])
def test_layout_of_odd_places(page, want):
    assert htmltext.text_of(page) == want


def test_deep_nesting_is_linear():
    for part in ("<blockquote>x", "<table><tr><td>x", "<div>x", "<ul><li>x", "<span>x"):
        assert htmltext.text_of(part * 5000).count("x") == 5000
