import html
import random
import re

import numpy as np
import pytest

from payguard.llm import blocks as B
from payguard.llm.common import table

ODD = """<html><body><header class="site-header"><h1>The Daily</h1><nav><a href=/>Home</a> <a href=/n>News</a></nav></header>
<div class="cookie-bar"><p>This site uses cookies. By continuing you agree.</p><button>OK</button></div><div id="content"><h2>Storm hits the coast</h2>
<p>A big storm hit the coast on Monday, officials said, and thousands of people left their homes.</p><div class="ad"><p>Buy our new shoes today, they are very cheap.</p></div>
<p>Rescue teams went out with <a href="x">boats</a> &amp; heli<b>copters</b>.</p><script>var t = "<p>no</p>"</script></div><aside><h3>Popular</h3><ul><li><a>One thing</a></li></ul></aside>
<div id="comments"><div class="comment"><b>bob</b><p>I was there, and it was terrible to see all of it.</p></div></div><form action=/s><input name=q><p>Subscribe now</p></form><footer>&copy; 2020 The Daily</footer></body></html>"""


def main_text(page: str) -> str:
    """What the generated pages hold in their article, by pattern."""
    inside = re.search(r"(?s)<article>(.*)</article>", page)[1].replace("<br>", " ").replace("<b>", "")
    return " ".join(x for x in (" ".join(html.unescape(y).split()) for y in re.split(r"</?(?:p|h1)>", inside)) if x)


@pytest.fixture(scope="module")
def labeller(spark, sf):
    return B.train(table(spark, sf, "pages"), most_pages=60)


def texts(page, role=None):
    return [b[0] for b in B.blocks(page, role)]


def test_blocks_of_a_page():
    assert texts(None or "") == [] and texts("<p> \n</p><!-- a <p>b</p> -->") == []
    assert texts("<p>a<b>b</b> c<br>d &amp;&nbsp;e<p>f<div>g</div>h") == ["ab c d & e", "f", "g", "h"]
    assert texts("<ul><li>a<li>b</ul><script>x<p>y</p></script>z<style>q") == ["a", "b", "z"]
    assert texts("<title>t</title><textarea><p>u</textarea><select><option>v</select>w <!-- open") == ["w"]
    assert texts("<p title='a > b'>x</p><a b='>y") == ["x", "y"]
    assert texts("a < b</p></nothing>c") == ["a < b", "c"]
    assert B.blocks("<nav>m</nav><article>t<aside>s</aside><header>h</header></article>", B.own_role)[0][3] == 0
    assert [b[3] for b in B.blocks("u<nav>m</nav><article>t<aside>s</aside><header>h</header></article>", B.own_role)] == [None, 0, 1, 0, 1]
    assert [b[2] for b in B.blocks("<p><a>abc</a></p><p>abc<a>def</a></p>")] == [1.0, 0.5]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [len(b[1]) for b in B.blocks(deep)] == [B.OUTER + B.INNER + 1]


def test_every_text_of_the_tables_is_in_some_block(spark, sf):
    for row in table(spark, sf, "pages").limit(40).collect():
        assert main_text(row.html) == " ".join(b[0] for b in B.blocks(row.html, B.own_role) if b[3] == 1)


def test_gradient_is_that_of_the_loss():
    pages = [B.blocks(p, B.taught_role) for p in ("<p data-keep=1>a b</p><p data-keep=0>c</p><div class=x data-keep=1>d</div>", "<p data-keep=0>e f g.</p>", "<td data-keep=1>h</td><p data-keep=0>i</p>")]
    batch, net = B.Batch(pages, {}), B.Labeller(3)
    labels, weight = np.array([1.0, 0, 1, 0, 1, 0]), np.array([1.0, 1, 0.5, 1, 0, 2])
    _, g = net.gradient(batch, labels, weight)
    r = np.random.default_rng(1)
    for name, w in net.w.items():
        rows = batch.path if name == "path" else batch.word if name == "word" else None
        for _ in range(12):
            at = tuple(int(r.choice(rows)) if k == 0 and rows is not None else int(r.integers(n)) for k, n in enumerate(w.shape))
            old, step = w[at], 1e-5
            w[at] = old + step
            up = net.gradient(batch, labels, weight)[0]
            w[at] = old - step
            down = net.gradient(batch, labels, weight)[0]
            w[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 1e-6, name


def test_pages_are_read_alike_alone_and_together():
    pages = [B.blocks(p) for p in (ODD, "", "<p>one</p>", ODD[:700], "<p>a</p>" * 50)]
    net = B.Labeller(5)
    alone = np.concatenate([net.scores(B.Batch([p], {})) for p in pages])
    assert np.allclose(alone, net.scores(B.Batch(pages, {}, cached=3)))


def test_held_out_pages(spark, labeller):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r.page_id: main_text(r.html) for r in pages.collect()}
    got = B.extract(pages, labeller).collect()
    assert len(got) == len(want) and sum(r.text == want[r.page_id] for r in got) >= 0.99 * len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_other_layouts(spark, labeller):
    r = random.Random(17)
    day = ["The council met on Tuesday to talk about the bridge.", "Nobody knew, at first, what it would cost the town, or who should pay for it, so the meeting went on until late.", "In the end they put it off."]
    mains = [day, day[::-1], [x.replace("e", "ä") for x in day], day * 4]
    pages = [B.blocks(B.teaching_page(r, r.choice(mains), list(B.PHRASES)), B.taught_role) for _ in range(200)]
    got = labeller.scores(B.Batch(pages, {})) >= 0.5
    want = np.array([x[3] == 1 for p in pages for x in p])
    assert (got == want).mean() > 0.95


def test_odd_rows(spark, labeller):
    rows = [(1, "u", ODD), (1, "u", ODD), (2, None, None), (None, "v", ""), (3, "w", "Some words, without any markup. And more of them."), (4, "x", "<article><p>" + "long text, indeed. " * 100_000 + "</p></article>"), (5, "y", "<p" * 10_000)]
    df = spark.createDataFrame([(*x, "t", 1, 2) for x in rows], "page_id long, url string, html string, text string, blocks int, r int")
    got = B.extract(df, labeller, part=2).collect()
    assert [r.page_id for r in got] == [r[0] for r in rows] and got[0] == got[1]
    assert got[0].text == "Storm hits the coast A big storm hit the coast on Monday, officials said, and thousands of people left their homes. Rescue teams went out with boats & helicopters."
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0 and got[4].text == rows[4][2]
    assert got[5].n_chars == 19 * 100_000 - 1
    empty = df.limit(0)
    assert B.extract(empty, labeller).count() == 0
    assert B.train(empty, most_pages=5).scores(B.Batch([B.blocks("<nav><a>Home</a></nav>")], {}))[0] < 0.5
