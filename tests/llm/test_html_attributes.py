"""Tags with stray quotes, and the text of svg, math and xmp."""

import pytest

from twinspect.llm import htmltext


@pytest.mark.parametrize("page,want", [
    ('<p class="a"">hello</p><p id="b">rest</p>', "hello\n\nrest"),
    ("<p title=don't>hello</p><p>rest</p>", "hello\n\nrest"),
    ("<p don't>one</p><p can't>two</p>", "one\n\ntwo"),
    ("<p a='x>y' hidden>no</p><p a = \"x>y\">yes</p>", "yes"),
    ("<p a=><b = c==d>x</b>", "x"), ("<p a=\"never>x", ""), ("<a href=x/>in</a><br/>out", "in\nout"),
    ("</p class='>'>x", "x"), ("<p class=\"a\"hidden>no</p>x", "x"),
    ("a <svg><title/><defs><text>no</text></defs><g><path d='M0'/><text>drawn</text></g></svg> b", "a drawn b"),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
    ("<xmp><b>raw</b> &amp;</xmp>z", "<b>raw</b> &amp;\n\nz"),
])
def test_attributes_and_drawn_text(page, want):
    assert htmltext.text_of(page) == want
