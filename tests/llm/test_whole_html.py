"""Skipped elements end where HTML ends them: nothing of the page after them is lost."""

import random
from html.parser import HTMLParser

import pytest

from pixelloom.llm import html

CASES = [
    ("<html><head><title>t</title><body><article><p>One.</p>", ["One."]),
    ("<head><title>t</title><p>One.<p>Two.", ["One.", "Two."]),
    ("<head><title>t</title></head>One.", ["One."]),
    ("<head><meta charset=x>\n One. <p>Two.</p>", ["One.", "Two."]),
    ('<p>A <svg class="i"/> one.</p><p>Two.</p>', ["A one.", "Two."]),
    ('<p>A <svg class="i"/> one.</p><p>Two.</p><svg><text>x</text></svg><p>Three.</p>', ["A one.", "Two.", "Three."]),
    ("<p>One.</p><iframe src=x><p>Two.</p>", ["One.", "Two."]),
    ("<p>One.<svg><svg>x</svg>y</svg> Two.</p><noscript>Else.</noscript><p>Three.", ["One. Two.", "Else.", "Three."]),
    ("<p>One.</p><script>var a = '<p>x</p>';", ["One."]),
]


@pytest.mark.parametrize(("page", "texts"), CASES)
def test_blocks(page, texts):
    assert [t for _, t, _ in html.blocks(page)] == texts


def test_formulas_and_fallbacks_stay():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be so.</p><object><p>Shown instead.</p></object><p>An <canvas>old</canvas> end.</p><noscript><p>Without scripts.</p></noscript></article>"
    assert [t for _, t, _ in html.blocks(page)] == ["Let x=1 be so.", "Shown instead.", "An old end.", "Without scripts."]


class _Plain(HTMLParser):
    """Blocks of well-formed pages by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.off = [], [], 0

    def _end(self):
        t = " ".join("".join(self.text).split())
        self.out += [t] if t else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "svg"):
            self.off += 1
        elif self.off:
            pass
        elif tag == "br":
            self.text.append(" ")
        elif tag not in html.INLINE:
            self._end()

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style", "svg"):
            self.off -= 1
            self.text.append(" ")
        elif tag not in html.INLINE and not self.off:
            self._end()

    def handle_data(self, data):
        if not self.off:
            self.text.append(data)


def test_blocks_against_the_standard_parser():
    import pyarrow.parquet as pq

    r = random.Random(4)
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()[:120]
    inner = ["a &amp; b", "<b>c</b> d", "e<br>f", "<script>var a = '<p>no</p>';</script>", "g &lt;h&gt;", "<svg><text>no</text></svg>", "  ", "é\n\ti"]
    for _ in range(300):
        body = "".join(f"<{t}>{''.join(r.choices(inner, k=r.randint(0, 4)))}</{t}>" for t in r.choices(["p", "div", "section", "h2", "ul"], k=r.randint(0, 6)))
        pages.append(f"<html><head><title>t</title></head><body>{body}</body></html>")
    for page in pages:
        plain = _Plain()
        plain.feed(page)
        plain.close()
        plain._end()
        assert [t for _, t, _ in html.blocks(page)] == plain.out
