import random

import numpy as np
from pyspark.sql import types as T

from corvane.llm import html_text as H

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.StringType())])


def test_blocks():
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='x>y'>A</a><li>B</ul></nav><script>var a='<p>no</p>'</script><article><h1>T &amp;\n U</h1><p>one <b>t</b>wo<br>three<p>four<!-- no --></article>tail &lt;"
    got = [(b.text, b.parent, b.tags - {"html", "body"}) for b in H.blocks(page)]
    assert got == [("A", "li", {"nav", "ul", "li"}), ("B", "li", {"nav", "ul", "li"}), ("T & U", "h1", {"article", "h1"}), ("one two three", "p", {"article", "p"}), ("four", "p", {"article", "p"}), ("tail <", "body", set())]


def text(page):
    return " ".join(b.text for b in H.blocks(page))


def test_nothing_but_the_listed_kinds_goes():
    assert text("<p>Let <math><mi>x</mi></math> be.") == "Let x be."
    assert text("<p>a <svg/> b <math/> c <button>d</button> <object>e</object> <noscript>f</noscript>g") == "a b c d e f g"
    assert text("<p title=don't stop>Hello <a href='x>y' title=\"a>b\">you</a>") == "Hello you"
    assert text("<head><title>t</title><p>no end of the head</p><select><option>a<option>b</select><textarea>c</textarea>") == "no end of the head a b c"
    assert text("<p>before<iframe>after <title>too") == "beforeafter too"
    assert text("1 < 2 </ 3 <p <b>x</b>y") == "1 < 2 </ 3 xy" and text("<p>a<!-- b") == "a" and text("a<script>b") == "a" and text("x<a y=\"z>w") == "xw"
    assert text("a</p bogus>b<?php c ?>d<!DOCTYPE e>f&amp;&#x41;&nbsp;g") == "a bdf&A g"


def test_hostile_pages_take_linear_time():
    import time

    n, field = 50_000, H.trained()
    for page in ("<a " * 350_000, "<div>" * n + "x", "<b>" * n + "x" + "</i>" * n, "<div>" + "<b>" * n + "<p>x</p>" * n, "<p>" + "<b>" * n + "<p>" * n, "<iframe>" * n, "<a x='" * n, "</" * n, "<!-" * n, "<li>" * n + "</ul>" * n):
        began = time.time()
        H.main_text(page, H.trained())
        assert time.time() - began < 2.5, page[:20]


def test_extraction_against_a_tree_parser():
    """Blocks against the standard library's parser over drawn pages: the same texts, in order."""
    from html.parser import HTMLParser

    class Texts(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.held, self.out = 0, [], []

        def cut(self):
            if t := " ".join("".join(self.held).split()):
                self.out.append(t)
            self.held = []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")
            self.held += [" "] if tag == "br" else []
            if tag in H.BLOCK:
                self.cut()

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")
            if tag in H.BLOCK:
                self.cut()

        def handle_data(self, data):
            self.held += [] if self.skip else [data]

    r = random.Random(99)
    for _ in range(150):
        page, _ = H.drawn_page(r)
        p = Texts()
        p.feed(page)
        p.close()
        p.cut()
        assert [b.text for b in H.blocks(page)] == p.out


def test_viterbi_and_marginals_against_enumeration():
    r = np.random.default_rng(0)
    f = H.Field()
    f.w, f.t = r.standard_normal(f.w.shape), r.standard_normal((2, 2))
    for n in (1, 2, 5):
        x = [r.integers(0, H.FEATURES, 3) for _ in range(n)]
        s = f.scores(x)
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        value = [sum(s[i, y[i]] for i in range(n)) + sum(f.t[a, b] for a, b in zip(y, y[1:], strict=False)) for y in paths]
        assert f.decode(x) == paths[int(np.argmax(value))]
        p = np.exp(value) / np.exp(value).sum()
        m, pairs = f.marginals(x)
        assert np.allclose(m[:, 1], sum(q * np.array(y) for q, y in zip(p, paths, strict=True)))
        assert np.isclose(pairs.sum(), n - 1)


def test_held_out_layouts():
    field, r = H.trained(), random.Random(1234)
    right = total = 0
    for _ in range(120):
        page, main = H.drawn_page(r)
        total += 1
        right += H.main_text(page, field) == " ".join(main)
    assert right / total > 0.85


def test_operator(spark):
    rows = [(1, "u", "<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>Body text, long enough.</p></article><footer>&copy; me</footer>", "", ""), (2, None, None, "", ""), (None, "v", "", "", ""), (3, "w", "<p", "", ""), (3, "w", "<article><p>" + "x " * 50000 + "</p></article>", "", "")]
    out = {(x["page_id"], x["n_chars"]): x for x in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1, 29]["text"] == "Title Body text, long enough." and out[2, 0]["text"] == "" and out[None, 0]["url"] == "v" and out[3, 99999]["text"].startswith("x x")
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_articles_of_the_test_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for p in pages.collect():
        s = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1]
        s = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", s))
        assert H.main_text(p["html"], H.trained()) == " ".join(html.unescape(s).split())


def test_form_parts_titles_and_short_pages():
    f = H.trained()
    body = "<article><h1>Title</h1><p>Body text of some length stands here, and it goes on.</p>{}<p>And more of it follows here.</p></article><footer>&copy; me</footer>"
    want = "Title Body text of some length stands here, and it goes on. And more of it follows here."
    for part in ("<select><option>pick</option><option>another</option></select>", "<button>Buy now</button>", "<textarea>type here</textarea>", "<form><label>Name</label><input><button>Go</button></form>"):
        assert H.main_text(body.format(part), f) == want, part
    for name in ("article-header", "entry-header", "post-header"):
        page = f"<nav><a href=/>Home</a></nav><div class='{name}'><h1>Title of the story</h1></div><div class='content'><p>Body text of some length stands here.</p></div><footer>&copy; me</footer>"
        assert H.main_text(page, f) == "Title of the story Body text of some length stands here.", name
        page = f"<nav><a href=/>Home</a></nav><article><header class='{name}'><h1>Title of the story</h1></header><p>Body text of some length stands here.</p></article>"
        assert H.main_text(page, f) == "Title of the story Body text of some length stands here.", name
    assert H.main_text("<p>One short page.</p><svg><path d='M0'/></svg><p>It has no menu at all.</p>", f) == "One short page. It has no menu at all."
    assert H.main_text("<p>A single line</p>", f) == "A single line"
