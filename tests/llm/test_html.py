"""Blocks, the network's gradients, and held-out pages."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import numpy as np

from casewright.llm import htmltext
from casewright.llm.htmlblocks import SKIP, SPLIT, VOID, blocks, made_page


def test_blocks():
    page = "<head><title>x</title></head><body><nav><a href=1>Home</a></nav><article><h1>A &amp; B</h1><p>one<br>two  <b>three</b><p>four<script>no()</script> five<!-- no --></article><div hidden>no</div>tail"
    assert [b[0] for b in blocks(page)] == ["Home", "A & B", "one two three", "four five", "tail"]
    for broken in ("", "<", "<p", "</p></p>", "<script>never closed", "a<b", "<!-- open", "<a href='x>y", "&#x41;&bogus;"):
        blocks(broken)


def test_a_head_ends_without_tags():
    for page in ("<head><title>x</title><meta charset=utf-8><p>text</p>", "<html><head><style>a</style><link rel=x>text", "<head><title>x</title></head><p>text", "<head><script>a</script><body>text", "<head><template><p>no</p></template><article>text</article>"):
        assert [b[0] for b in blocks(page)] == ["text"], page


def test_hidden_by_attributes_only():
    for shown in ('title="the hidden cost"', "class='a hidden b'", 'data-x="display: none"', "href=/hidden", 'aria-hidden="false"', 'alt="aria-hidden=\'true\'"'):
        assert [b[0] for b in blocks(f"<p {shown}>text</p>")] == ["text"], shown
    for hidden in ("hidden", 'class="a" HIDDEN=""', "hidden=until-found id=x", "aria-hidden=true", 'style="color: red; display :none"', "title=x hidden/"):
        assert not blocks(f"<div {hidden}>text</div>"), hidden


def test_quotes_count_only_as_values():
    assert [b[0] for b in blocks("<p title=it's>First</p><p>That's the second.</p>")] == ["First", "That's the second."]
    assert [b[0] for b in blocks('<p title="a > b" id=x>yes</p><p a\'b>no</p>')] == ["yes", "no"]
    assert blocks("<div title='class=menu' class=\"post\">x</div>")[0][1] == "div post"


def test_broken_markup_takes_linear_time():
    for unit in ('<p title="x>a</p> ', "<a x='", "<a b ", '<a x="<b>', '< = " '):
        began = time.process_time()
        blocks(unit * 20_000 + 'x=">"')
        assert time.process_time() - began < 5, unit


class Plain(HTMLParser):
    """Words of a well-formed page outside of skipped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.skipped = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SPLIT or tag == "br":
            self.text.append(" ")
        if tag in SKIP and tag not in VOID:
            self.skipped += 1

    def handle_endtag(self, tag):
        if tag in SPLIT:
            self.text.append(" ")
        if tag in SKIP:
            self.skipped -= 1

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)


def test_blocks_hold_the_words_of_a_plain_parser(spark, sf):
    pages = [r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").toLocalIterator()]
    rng = random.Random(77)
    pages += [made_page(rng)[0] for _ in range(100)]
    same = 0
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        same += " ".join(b[0] for b in blocks(page)).split() == "".join(plain.text).split()
    assert same == len(pages)


def test_long_pages_are_not_padded_together():
    net = htmltext.trained()
    pages = ["<p>short</p>"] * 63 + ["<p>one of many</p>" * 3000]
    assert htmltext.main_texts(pages, net) == [htmltext.main_texts([p], net)[0] for p in pages]


def test_text_elements_stay():
    page = "<article><p>so <math><mi>x</mi></math> is <object>an object</object> on <canvas>a canvas</canvas> or <button>a button</button>.</p></article>"
    assert [b[0] for b in blocks(page)] == ["so x is an object on a canvas or a button."]


def test_gradients():
    rng = np.random.default_rng(0)
    net = htmltext.Labeller(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.standard_normal((5, 3, htmltext.WIDTH)) * 0.3
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    y = (rng.random((5, 3)) > 0.5).astype(float)
    _, grad = net.gradients(x, mask, y)
    for name in net.p:
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        eps = 1e-4
        net.p[name][at] += eps
        up = net.gradients(x, mask, y)[0]
        net.p[name][at] -= 2 * eps
        down = net.gradients(x, mask, y)[0]
        net.p[name][at] += eps
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-4, name


def test_held_out_pages():
    net, rng, right, total = htmltext.trained(), random.Random(991), 0, 0
    for _ in range(150):
        page, labels = made_page(rng)
        found = blocks(page)
        if len(found) == len(labels):
            p = net.chances(*htmltext._padded([htmltext.vectors(found)]))[:, 0]
            right += int(((p >= 0.5) == (np.array(labels) == 1)).sum())
            total += len(labels)
    assert right / total > 0.96


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<html>", "x"), (4, "u", "<article><h1>Head</h1>" + "<p>Some words of an article that goes on for a while.</p>" * 30 + "</article>", None), (4, "u", "plain", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = [(r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).toLocalIterator()]
    assert len(out) == 5 and all(n == len(t) for _, t, n in out)
    assert {t for i, t, _ in out if i < 4} == {""}
    assert any(t.startswith("Head\nSome words") for i, t, _ in out if i == 4)
    assert htmltext.extract(pages.limit(0)).count() == 0
