"""Visible text that attribute values, missing end tags or loose table content must not hide."""

import pytest

from nightledger.llm import html_text


@pytest.mark.parametrize(
    "source, want",
    [
        ('<body title="a hidden gem"><p>yes</body>', "yes"),
        ('<div class="x hidden md:block">yes</div>', "yes"),
        ('<div style="overflow-x: hidden !important">yes</div>', "yes"),
        ("<div title='style=\"display:none\"'>yes</div>", "yes"),
        ('<div data-x="aria-hidden=true">yes</div>', "yes"),
        ('<p HIDDEN>no</p><p hidden="">no</p><p style="color:red;DISPLAY : none !important">no</p><p>yes', "yes"),
        ("<head><title>t</title><p>one</p>two", "one\n\ntwo"),
        ("<head><meta charset=x>words", "words"),
        ("<html><head><title>t</title></head><body><p>a</p><head>b", "a\n\nb"),
        ("<table><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<table><tbody><td>a</td><th>b</th></table>", "a  b"),
        ("<table>one<tr>two<td>a</td>three</tr></table>", "onetwothree\n\na"),
        ("<table><div>one</div><tr><td>a</table>", "one\n\na"),
        ("<table><form>one<tr><td>a</form></table>", "one\n\na"),
        ("<table><caption>c<colgroup><col><thead><tr><td>a</table>", "c\na"),
        ("<table><tr><td>a <table>x<td>b</table></table>", "a x b"),
        ("<p aria-hidden=true>seen</p>", "seen"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>", "wide cell  x\na  b  c"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
        ("<table><tr><td>one<td><table><tr><td>x<td>y<tr><td>z</table><td>two</table>", "one  x y z  two"),
        ("<table><tr><td>" * 2000 + "deep", "deep"),
        ("<p title=it's>hello world</p><p>second</p><p>don't stop</p>", "hello world\n\nsecond\n\ndon't stop"),
        ('<p class=a"b>one</p><p>two "three"</p>four', 'one\n\ntwo "three"\n\nfour'),
        ("<img alt=it's src=x>Shown <b>bold</b> we've", "it'sShown bold we've"),
        ("<p title = 'a > b' x=\">\" y>one</p>", "one"),
        ('<a href=x="y>one</a> "two" <b =z">three', 'one "two" three'),
        ('<p class="never closed>one</p>two', "one\n\ntwo"),
        ('<div style="visibility:hidden">a<span style="visibility:visible">b</span></div>', "b"),
        ('<table style="visibility:hidden"><tr><td>a<td style="visibility:visible">b<tr><td><i style="visibility:visible">c</i></table>', "   b\nc"),
        ('<pre style="visibility:hidden">a\n<b style="visibility:visible">b</b></pre>', "b"),
        ('<div style="display:none">a<span style="visibility:visible">b</span></div>c', "c"),
        ("<svg><title>t</title><defs><text>no</text></defs><path d=x /><g><text x=1>one <tspan>two</tspan></text></g><text>three</text></svg>four", "one two three four"),
        ("<p>x<math><mi>y</mi><mo>=</mo><mn>2</mn></math></p>", "xy=2"),
        ("<ul><li><p>one</p></li><li><div><p>two</p></div></li></ul>", "- one\n\n- two"),
        ("<ol><li><div>one</div><li><ul><li><p>two</ul><li></ol>", "1. one\n2.\n  - two\n\n3."),
        ("<ul><li><br>one<li><pre>two</pre></ul>", "- one\n-\n\ntwo"),
    ],
)
def test_visible_text(source, want):
    assert html_text.render(html_text.parse(source)) == want


def test_padding_does_not_outgrow_the_text():
    """One wide cell in each of many columns of a table with many short rows."""
    source = "<table>" + "".join("<tr>" + "".join(f"<td>{'w' * 300 if i == j else i}" for j in range(60)) for i in range(400)) + "</table>"
    text = html_text.render(html_text.parse(source))
    words = source.replace("<table>", " ").replace("</table>", " ").replace("<tr>", " ").replace("<td>", " ").split()
    assert text.split() == words and len(text) < 20 * sum(map(len, words))


def test_long_and_deep_pages_end():
    for source in ("<ul><li>" * 20_000 + "x", "<table><tr><td>a" * 3000, "<b " * 50_000, "<p>" + "word " * 300_000):
        html_text.render(html_text.parse(source))


def test_stray_end_tags_take_no_time():
    """Unclosed elements with as many end tags of others: the stack is not looked through for each."""
    import time

    source = "<b>" * 60_000 + "x</i></table></section>" * 60_000
    begin = time.monotonic()
    assert html_text.render(html_text.parse(source)) == "x" * 60_000
    assert time.monotonic() - begin < 20  # seconds; the square would be minutes
