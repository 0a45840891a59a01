"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into blocks at block-level tags; each block carries features of its ancestors' tags, classes and ids and of
its text. The field has two states, main text and the rest; it is trained by stochastic gradient on labelled pages and
decoded by Viterbi. The labelled pages are drawn here, from a grammar of page layouts whose labels are known
(TRAINING_PAGES of them, fixed seed): the corpus has no labelled pages.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES, EPOCHS, SEED = 500, 4, 5
#: Hashed features of the field.
FEATURES = 1 << 14

#: A whole tag as most are written. No part of it can run past the next angle bracket, so trying it is linear.
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\s+[a-zA-Z_:@][-\w:.@]*(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+))?)*)\s*(/?)>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements whose content isn't text of the page. An unclosed script or style sheet runs to the page's end, as in browsers; of the others only the tag goes.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "title", "template", "iframe", "noframes", "noembed")}
#: Elements that begin and end blocks; all others, unknown ones too, lie within a line.
BLOCK = frozenset(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements out of which the closing tag of an element within a line doesn't reach.
SCOPES = frozenset("article main body nav footer aside header section".split())
#: An opening tag that ends open ones, up to a holder of them.
ENDS = {"p": ({"p"}, set()), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BLOCK_ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())


class Block:
    """A leaf's text; its parent's tag; the tags of block elements around it; the words of classes and ids around it; the outermost article or main; linked characters."""

    __slots__ = ("text", "parent", "tags", "names", "within", "linked")

    def __init__(self, text: str, parent: str, tags: frozenset[str], names: frozenset[str], within: str, linked: int):
        self.text, self.parent, self.tags, self.names, self.within, self.linked = text, parent, tags, names, within, linked


class Open:
    """The open elements. Each entry knows what holds for all around it, shared where it adds nothing; every step is O(1), amortised."""

    def __init__(self):
        self.entries: list[tuple[str, str, frozenset[str], frozenset[str], str]] = [("", "", frozenset(), frozenset(), "")]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def push(self, tag: str, names: list[str]) -> None:
        _, parent, tags, around, within = self.entries[-1]
        at = len(self.entries)
        if tag in BLOCK:
            parent, tags = tag, tags if tag in tags else tags | {tag}
            within = within or (tag if tag in ("article", "main") else "")
            self.blocks.append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        if names and not around.issuperset(names):
            around = around.union(names)
        self.places.setdefault(tag, []).append(at)
        self.entries.append((tag, parent, tags, around, within))

    def cut(self, at: int) -> None:
        """End all elements from a place on."""
        while len(self.entries) > at:
            tag = self.entries.pop()[0]
            self.places[tag].pop()
            for x in (self.blocks, self.scopes):
                if x and x[-1] == len(self.entries):
                    x.pop()

    def close(self, tag: str) -> None:
        at = self.places.get(tag)
        if at and (tag in BLOCK or not self.scopes or at[-1] > self.scopes[-1]):
            self.cut(at[-1])

    def make_room(self, tag: str) -> None:
        """End what an opening block tag ends by itself."""
        ended, holders = ENDS.get(tag) or ({"p"}, {"td", "li", "table"})
        while self.blocks:
            t = self.entries[self.blocks[-1]][0]
            if t in holders or t not in ended:
                return
            self.cut(self.blocks[-1])
            if tag not in ("tr", "dt", "dd", "li"):
                return


def _odd_tag(page: str, at: int, gone: set[str]) -> tuple[str, str, int]:
    """Name, attributes and end of an opening tag that isn't written like most: quoted values may hold anything, unquoted ones quotes. gone: quotes that don't occur any more."""
    name = NAME.match(page, at + 1)[0]
    i = at + 1 + len(name)
    start, n = i, len(page)
    while i < n and page[i] != ">":
        if page[i] == "=":
            i += 1
            while i < n and page[i].isspace():
                i += 1
            q = page[i : i + 1]
            if q in ("'", '"') and q not in gone:
                end = page.find(q, i + 1)
                if end >= 0:
                    i = end + 1
                    continue
                gone.add(q)
            while i < n and page[i] != ">" and not page[i].isspace():
                i += 1
        else:
            i += 1
    return name, page[start:i], min(i + 1, n)


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Character references are decoded, white space is one space. Linear in the page."""
    out: list[Block] = []
    held = Open()
    parts: list[str] = []
    linked = 0
    in_head = False
    gone: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, parent, tags, names, within = held.entries[-1]
                out.append(Block(text, parent, tags, names, within, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not in_head:
            parts.append(text)
            if held.places.get("a"):
                linked += len(text)

    at = 0
    while True:
        m = page.find("<", at)
        if m < 0:
            add(page[at:])
            break
        add(page[at:m])
        t = TAG.match(page, m)
        if t:
            close, tag, attributes, empty = t[1], t[2].lower(), t[3], bool(t[4])
            at = t.end()
        elif page.startswith("<!--", m):
            end = page.find("-->", m + 4)
            if end < 0:
                break
            at = end + 3
            continue
        elif page[m + 1 : m + 2] in ("!", "?") or page[m + 1 : m + 2] == "/":
            if page[m + 1] == "/" and not page[m + 2 : m + 3].strip():  # no tag
                add(page[m : m + 2])
                at = m + 2
                continue
            end = page.find(">", m)
            name = NAME.match(page, m + 2) if page[m + 1] == "/" else None
            at = end + 1 if end >= 0 else len(page)
            if not name or end < 0:
                continue
            close, tag, attributes, empty = "/", name[0].lower(), "", False
        elif NAME.match(page, m + 1):
            tag, attributes, at = _odd_tag(page, m, gone)
            close, tag, empty = "", tag.lower(), attributes.endswith("/")
        else:
            add("<")
            at = m + 1
            continue
        if close:
            if tag == "head":
                in_head = False
            if tag in BLOCK:
                flush()
            held.close(tag)
            continue
        if in_head and tag not in IN_HEAD:
            in_head = False
        if tag in RAW and not empty:
            end = None if tag in gone else RAW[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                break
            else:
                gone.add(tag)
            continue
        if tag == "head":
            flush()
            in_head = True
            continue
        if tag == "br":
            add(" ")
        elif tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS or tag in BLOCK_ENDS_P:
                held.make_room(tag)
        if empty and tag not in BLOCK:
            continue  # as svg and the like have it
        found: list[str] = []
        if attributes:
            for name, *value in ATTRIBUTE.findall(attributes):
                v = next((x for x in value if x), "")
                if name.lower() == "style":
                    found += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I) else []
                elif name.lower() == "hidden":
                    found.append("hidden")
                else:
                    found += [w.lower() for w in WORDS.findall(v)]
        held.push(tag, found)
    flush()
    return out


def _bucket(n: int) -> int:
    return min(n, 400).bit_length()


@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % FEATURES


def features(bs: list[Block]) -> list[np.ndarray]:
    """The hashed features that are on in each block."""
    out = []
    for k, b in enumerate(bs):
        n = b.text.count(" ") + 1
        dense = b.linked / max(1, len(b.text))
        on = ["bias", f"n{_bucket(n)}", f"link{min(4, int(dense * 5))}", f"parent={b.parent}", f"stop={b.text[-1] in '.!?…。'}{_bucket(n)}", "first" if k == 0 else "last" if k == len(bs) - 1 else "mid"]
        on += [f"has={t}" for t in b.tags]
        on += [f"name={w}" for w in b.names]
        named, tagged = not CHROME.isdisjoint(b.names), CHROME_TAGS & b.tags
        if named:
            on.append("chrome")
        elif not tagged:
            on.append("plain")
        on += [f"{b.within}>{t}" for t in tagged]
        out.append(np.array(sorted({_slot(x) for x in on}), np.int64))
    return out


#: Words in classes and ids by which authors name what isn't the article (fixed values, by kind).
CHROME_KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs pagination pager toc skip",
    "header": "header masthead topbar banner logo branding sitename",
    "footer": "footer colophon copyright legal imprint",
    "sidebar": "sidebar aside rail related recommended popular trending widget tags tagcloud archive archives more readmore",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay toast paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense banner dfp",
    "form": "form search searchbox login signup subscribe subscription newsletter register contact",
    "comments": "comment comments respond reply replies disqus discussion reader feedback",
    "share": "share sharing social follow",
}
CHROME = frozenset(w for x in CHROME_KINDS.values() for w in x.split())
CHROME_TAGS = frozenset("nav footer aside form header dialog".split())


class Field:
    """A linear-chain conditional random field of two states."""

    def __init__(self):
        self.w = np.zeros((FEATURES, 2))
        self.t = np.zeros((2, 2))

    def scores(self, x: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[i].sum(axis=0) for i in x])

    def decode(self, x: list[np.ndarray]) -> list[int]:
        if not x:
            return []
        s = self.scores(x)
        best, back = s[0], []
        for row in s[1:]:
            through = best[:, None] + self.t
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        y = [int(best.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]

    def marginals(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each block's state, and the sum over neighbours of each pair of states."""
        s, n = self.scores(x), len(x)
        e, t = np.exp(s - s.max(axis=1, keepdims=True)), np.exp(self.t)
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = e[0] / e[0].sum()
        for k in range(1, n):
            a[k] = (a[k - 1] @ t) * e[k]
            a[k] /= a[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = t @ (e[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        p = a * b
        p /= p.sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for k in range(n - 1):
            j = a[k][:, None] * t * (e[k + 1] * b[k + 1])[None, :]
            pairs += j / j.sum()
        return p, pairs

    def fit(self, pages: list[tuple[list[np.ndarray], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5) -> Field:
        r = random.Random(SEED)
        seen = np.full(self.w.shape, 1e-8)
        seen_t = np.full((2, 2), 1e-8)
        for _ in range(epochs):
            for k in r.sample(range(len(pages)), len(pages)):
                x, y = pages[k]
                if not x:
                    continue
                p, pairs = self.marginals(x)
                p = -p
                p[np.arange(len(y)), y] += 1
                at = np.concatenate(x)
                g = np.zeros((FEATURES, 2))
                np.add.at(g, at, np.repeat(p, [len(i) for i in x], axis=0))
                at = np.unique(at)
                g = g[at] - decay * self.w[at]
                seen[at] += g * g
                self.w[at] += rate * g / np.sqrt(seen[at])
                gt = -pairs
                np.add.at(gt, (y[:-1], y[1:]), 1)
                seen_t += gt * gt
                self.t += rate * gt / np.sqrt(seen_t)
        return self


def drawn_page(r: random.Random) -> tuple[str, list[str]]:
    """A page from the grammar of layouts, and the texts of its main blocks in order."""
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    word = lambda: "".join(r.choice(letters[: r.randint(8, 26)]) for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=3, b=25: words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?"])
    main: list[str] = []
    out: list[str] = ["<!DOCTYPE html><html><head><title>", words(2, 9), "</title><style>p{}</style><script>var a='<p>';</script></head><body", r.choice(["", ' class="home"', ' class="post page"']), ">"]

    def name(kind: str) -> str:
        w = r.choice(CHROME_KINDS[kind].split())
        w = r.choice([w, w, f"{w}-{r.choice(['box', 'wrap', 'inner', 'list', 'area', 'block', '1'])}", f"site-{w}", f"{r.choice(['main', 'top', 'page'])}_{w}"])
        return r.choice([f' class="{w}"', f' id="{w}"', f' class="{w} {word()}"'])

    def links(a: int, b: int) -> str:
        items = [f'<li><a href="/{word()}">{words(1, 4).capitalize()}</a></li>' for _ in range(r.randint(a, b))]
        return "<ul>" + "".join(items) + "</ul>"

    def chrome(kind: str) -> str:
        tags = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "dialog", "p"], "advert": ["div", "aside", "section", "p", "ins"], "form": ["form", "div"], "comments": ["div", "section", "ol"], "share": ["div", "ul", "p"]}[kind]
        tag = r.choice(tags)
        attr = "" if tag in ("nav", "footer", "aside", "form", "header", "dialog") and r.random() < 0.6 else name(kind)
        inner = {
            "menu": lambda: links(3, 9),
            "header": lambda: r.choice([f"<a href='/'>{words(1, 4)}</a>", f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>", f"<div>{words(1, 5)}</div>" + (links(2, 6) if r.random() < 0.5 else "")]),
            "footer": lambda: r.choice([f"&copy; {word()} &middot; {sentence()}", f"<p>&copy; {words(1, 5)}</p>" + links(2, 5), f"<p>{sentence()}</p><p>{sentence(5, 40)}</p>"]),
            "sidebar": lambda: f"<h{r.randint(2, 4)}>{words(1, 4)}</h{2}>" + r.choice([links(3, 8), f"<p>{sentence(5, 40)}</p>", "".join(f"<div><a href='#'>{words(3, 12)}</a><p>{sentence()}</p></div>" for _ in range(r.randint(1, 4)))]),
            "notice": lambda: f"<p>{sentence(5, 40)}</p>" + r.choice(["", "<button>OK</button>", f"<a href='#'>{words(1, 3)}</a>"]),
            "advert": lambda: r.choice([sentence(), f"<p>{sentence(3, 40)}</p>", f"<a href='#'>{words(2, 10)}</a><p>{sentence()}</p>"]),
            "form": lambda: f"<label>{words(1, 4)}</label><input name='q'>" + r.choice(["", f"<p>{sentence()}</p>"]) + "<button>Go</button>",
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(f"<div{r.choice(['', name('comments')])}><b>{word()}</b><p>{sentence(3, 60)}</p>{r.choice(['', '<p>' + sentence(3, 40) + '</p>'])}</div>" for _ in range(r.randint(1, 6))),
            "share": lambda: r.choice([links(2, 5), f"<span>{words(1, 5)}</span>"]),
        }[kind]()
        return f"<{tag}{attr}>{inner}</{tag}>"

    def keep(text: str) -> str:
        main.append(" ".join(text.split()))
        return text

    def article() -> str:
        got = []
        if r.random() < 0.85 and not main:
            got.append(r.choice([bare_title, bare_title, bare_title, lambda: f"<header>{bare_title()}</header>", headed_title])())
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            kind = r.random()
            text = " ".join(sentence(1, 25) for _ in range(r.choice([1, 1, 2, 4, 8])))
            if kind < 0.62:
                got.append(f"<p>{keep(text)}</p>" if r.random() < 0.8 else f"<p>{keep(text)}")
            elif kind < 0.7:
                got.append(f"<p><b>{keep(text)}<br><p>{keep(sentence())}</p>")
            elif kind < 0.78:
                got.append(f"<h{(h := r.randint(2, 4))}>{keep(words(1, 8))}</h{h}>")
            elif kind < 0.84:
                got.append("<ul>" + "".join(f"<li>{keep(sentence(1, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                got.append(f"<blockquote><p>{keep(text)}</p></blockquote>")
            elif kind < 0.92:
                got.append(f"<div>{keep(text)}</div>")
            elif kind < 0.95:
                got.append("<table><tr>" + "".join(f"<td>{keep(words(1, 4))}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>")
            else:
                got.append(f"<figure><figcaption>{keep(sentence())}</figcaption></figure>")
            if r.random() < 0.06:
                got.append(chrome(r.choice(["advert", "share", "sidebar", "form", "notice"])))
            if r.random() < 0.06:
                got.append(control())
        return "".join(got)

    def bare_title() -> str:
        return f"<h1>{keep(words(2, 12).capitalize())}</h1>"

    def headed_title() -> str:
        """A title in a header of the article, not of the page."""
        return f'<{(t := r.choice(["div", "header", "section"]))} class="{r.choice(["article", "entry", "post", "story"])}{r.choice(["-", "_", "__"])}{r.choice(["header", "header", "head", "title"])}">{bare_title()}</{t}>'

    def control() -> str:
        """Parts of a form that stand by themselves."""
        return r.choice([lambda: f"<button>{words(1, 3)}</button>", lambda: f"<p>{keep(sentence())} <button type='button'>{words(1, 2)}</button></p>", lambda: "<select>" + "".join(f"<option>{words(1, 3)}</option>" for _ in range(r.randint(1, 4))) + "</select>", lambda: f"<textarea>{words(1, 8)}</textarea>"])()

    if r.random() < 0.12:  # a short page of nothing but text
        drawing = r.choice(["", "", "<svg viewBox='0 0 1 1'><path d='M0'/></svg>", "<img src=x>"])
        line = lambda: keep(r.choice([sentence(1, 25), sentence(1, 25), words(1, 12)]))
        if r.random() < 0.2:
            out.append(r.choice([bare_title, headed_title])())
        for _ in range(r.randint(1, 3)):
            out += [r.choice([lambda: f"<p>{line()}</p>", lambda: f"<p>{line()}", lambda: f"<div>{line()}</div>"])(), drawing]
        return "".join(out) + r.choice(["", "</body></html>"]), main

    before = [k for k, p in (("notice", 0.2), ("header", 0.5), ("menu", 0.75), ("advert", 0.4), ("form", 0.2), ("sidebar", 0.15)) if r.random() < p]
    after = [k for k, p in (("share", 0.25), ("sidebar", 0.4), ("comments", 0.4), ("advert", 0.25), ("form", 0.15), ("menu", 0.15), ("notice", 0.1), ("footer", 0.8)) if r.random() < p]
    if r.random() < 0.3:
        r.shuffle(before)
    out += [chrome(k) for k in before]
    if r.random() < 0.1:
        out.append(headed_title())
    tag, attr = r.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", ' class="post-text"'), ("td", "")])
    wrap = r.choice(["", "", "<main>", '<div class="container">', '<div id="page">'])
    out += [wrap, f"<{tag}{attr}>", article()]
    inside = [k for k in after if k in ("share", "comments", "advert") and r.random() < 0.4]
    out += [chrome(k) for k in inside]
    out += [f"</{tag}>", {"": "", "<main>": "</main>"}.get(wrap, "</div>")]
    out += [chrome(k) for k in after if k not in inside]
    out.append(r.choice(["</body></html>", "</body></html>", ""]))
    return "".join(out), main


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Field:
    """The field, trained on drawn pages; the same every time."""
    r = random.Random(seed)
    data = []
    for _ in range(pages):
        page, main = drawn_page(r)
        bs = blocks(page)
        left, y = list(main), []
        for b in bs:  # main texts come in order
            hit = bool(left) and b.text == left[0]
            y.append(int(hit))
            if hit:
                left.pop(0)
        if not left:
            data.append((features(bs), y))
    return Field().fit(data)


def main_text(page: str | None, field: Field) -> str:
    """The main blocks, joined by a space; empty for a null or empty page or one without main text."""
    bs = blocks(page or "")
    return " ".join(b.text for b, y in zip(bs, field.decode(features(bs)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Null and empty pages, and pages without main text, have the empty text. Null ids and urls and repeated rows stay as
    they are. Text that is no markup at all is one block. An empty table gives no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(h.as_py(), sent.value) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
