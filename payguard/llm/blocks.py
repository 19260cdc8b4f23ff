"""HTML extraction: a recurrent network labels every block of a page as main text or not.

A page is cut into leaf blocks at its block-level tags. Each block has a vector: the sum of
hashed vectors of its tag path (tags, words of class and id), the mean of hashed vectors of its
words, and a few figures (length, share of links, punctuation). One LSTM reads the page's
blocks from the top, another from the bottom, so each block is judged with the whole page in
view; the blocks that pass make the text.

The network is trained here, in numpy: on a bounded sample of pages (``most_pages``) with the labels
that their own semantic tags and class names give, and on teaching pages, in which the sample's
texts are set in many other layouts whose main part is known. Pages are read in tasks, some
hundred at once; no page meets another.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

#: Elements that do not break a line of text; that have no end; whose content is no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title template noscript iframe noembed noframes object svg canvas textarea select datalist audio video xmp".split())
RAW = frozenset("script style title iframe noembed noframes textarea xmp".split())
#: What an open element of the key ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Names of elements, classes and ids that say what a part of a page is.
MAIN_NAMES = frozenset("article main content post entry story".split())
OTHER_NAMES = frozenset(
    "nav navbar navigation menu header footer aside sidebar form dialog cookie cookies consent notice banner ad ads advert advertisement adsbygoogle sponsored promo comment comments commentlist reply share social related breadcrumb breadcrumbs login search newsletter subscribe popup modal widget toolbar pagination".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PATHS, WORDS, OUTER, INNER = 1024, 2048, 4, 12

Role = Callable[[str, frozenset, str, "int | None"], "int | None"]


def own_role(tag: str, names: frozenset, rest: str, above: int | None) -> int | None:
    """1 in what calls itself the main part, 0 in what calls itself something else, None where nothing says."""
    if tag in OTHER_NAMES or names & OTHER_NAMES:
        return above if tag == "header" and above == 1 else 0
    if tag in MAIN_NAMES or names & MAIN_NAMES:
        return above if above == 0 else 1
    return above


def taught_role(tag: str, names: frozenset, rest: str, above: int | None) -> int | None:
    """What a teaching page says of its parts."""
    at = rest.find("data-keep=")
    return above if at < 0 else int(rest[at + 10])


def blocks(page: str, role: Role | None = None) -> list[tuple[str, list[int], float, int | None]]:
    """The leaf blocks of a page in order: text, hashed tag path, share of it in links, role.

    Of a path of more than 16 elements the 4 outermost and 12 innermost count; the text is whole.
    """
    out: list = []
    stack: list[tuple[str, bool, int | None]] = []
    path: list[tuple[str, tuple[int, ...]]] = []  # the open elements that break lines
    opened: Counter = Counter()
    buffer: list[str] = []
    linked = links = hidden = at = 0
    last = page.rfind(">")  # beyond it there is no tag

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                own = path if len(path) <= OUTER + INNER else path[:OUTER] + path[-INNER:]
                ids = [i for x in own for i in x[1]]
                ids.append(crc32(b"own:" + (own[-1][0].encode("utf-8", "replace") if own else b"")) % PATHS)
                out.append((text, ids, min(1.0, linked / len(text)), stack[-1][2] if stack else None))
            buffer.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, hidden
        while len(stack) > depth:
            tag, hides, _ = stack.pop()
            if tag not in INLINE:
                path.pop()
            opened[tag] -= 1
            links -= tag == "a"
            hidden -= hides

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            piece = unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if links:
                linked += len(piece)

    while at <= last and (m := _TAG.search(page, at)):
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ending, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        elif tag == "br" and not hidden:
            buffer.append(" ")
        if ending:
            if not opened[tag]:
                continue
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            for depth in range(len(stack) - 1, max(-1, len(stack) - 24), -1):  # a paragraph ends where a block begins
                above = stack[depth][0]
                if above == "p" or above in ENDS.get(tag, ()):
                    close(depth)
                    break
                if above not in INLINE:
                    break
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
        names = frozenset(w.lower() for x in _NAMES.findall(rest) for w in _NAME.findall(x)) if rest else frozenset()
        ids = () if tag in INLINE else tuple(crc32(w.encode("utf-8", "replace")) % PATHS for w in (tag, *sorted("." + n for n in names)))
        above = stack[-1][2] if stack else None
        links += tag == "a"
        opened[tag] += 1
        hides = tag in HIDDEN
        hidden += hides
        stack.append((tag, hides, role(tag, names, rest, above) if role else None))
        if tag not in INLINE:
            path.append((tag, ids))
    say(re.split(r"<[a-zA-Z/!?]", page[at:], maxsplit=1)[0])  # a tag without an end is no text
    flush()
    return out


def figures(text: str, n_words: int, link: float, nth: int, of: int) -> tuple[float, ...]:
    n = len(text)
    capitals, digits, stops = sum(map(str.isupper, text[:400])), sum(map(str.isdigit, text[:400])), text.count(".") + text.count(",")
    return (np.log1p(n_words) / 4, np.log1p(n) / 6, link, float(text[-1] in ".!?…。\"'”»"), capitals / min(n, 400), digits / min(n, 400), min(1.0, 4 * stops / max(n_words, 1)), float(text[0] in "©|»›"), nth / of, np.log1p(nth) / 4, np.log1p(of - nth) / 4, 1.0)


N_FIGURES, N_PATH, N_WORD, HIDDEN_SIZE = 12, 12, 6, 14


class Batch:
    """Blocks of some pages as arrays: hashed ids of paths and words with their first places, figures, pages' lengths."""

    def __init__(self, pages: list[list[tuple]], known: dict[str, int], cached: int = 500_000):
        path, word, fig, path_n, word_n, lengths = [], [], [], [], [], []
        for page in pages:
            lengths.append(len(page))
            for nth, (text, ids, link, _) in enumerate(page):
                path.extend(ids)
                path_n.append(len(ids))
                own = text.lower().split(" ")
                for w in own:
                    i = known.get(w)
                    if i is None:
                        if len(known) >= cached:
                            known.clear()
                        i = known[w] = crc32(w.encode("utf-8", "replace")) % WORDS
                    word.append(i)
                word_n.append(len(own))
                fig.append(figures(text, len(own), link, nth, len(page)))
        self.path, self.word = np.array(path, np.int64), np.array(word, np.int64)
        self.path_n, self.word_n = np.array(path_n, np.int64), np.array(word_n, np.int64)
        self.fig, self.lengths = np.array(fig, float).reshape(-1, N_FIGURES), np.array(lengths, np.int64)

    def steps(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By step, the places of the blocks that are read then, from the top and from the bottom; longest pages first."""
        order = np.argsort(-self.lengths, kind="stable")
        n = self.lengths[order]
        first = (np.cumsum(self.lengths) - self.lengths)[order]
        alive = [int(np.searchsorted(-n, -t, side="left")) for t in range(int(n[0]) if len(n) else 0)]
        return [first[:a] + t for t, a in enumerate(alive)], [first[:a] + n[:a] - 1 - t for t, a in enumerate(alive)]


def _sums(table: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[ids], np.cumsum(n) - n, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs over a page's blocks and a logistic layer over both and the block itself."""

    def __init__(self, seed: int = 7):
        r, d, h = np.random.default_rng(seed), N_PATH + N_WORD + N_FIGURES, HIDDEN_SIZE
        self.w = {"path": r.normal(0, 0.3, (PATHS, N_PATH)), "word": r.normal(0, 0.1, (WORDS, N_WORD)), "out": r.normal(0, 0.1, 2 * h + d), "bias": np.zeros(1)}
        for side in "tb":
            self.w |= {side + "x": r.normal(0, 0.25, (d, 4 * h)), side + "h": r.normal(0, 0.25, (h, 4 * h)), side + "0": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}

    def _read(self, side: str, x: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gates (in, keep, out, new), cells and states of all blocks."""
        h = HIDDEN_SIZE
        z = x @ self.w[side + "x"] + self.w[side + "0"]
        gates, cells, states = np.empty_like(z), np.empty((len(x), h)), np.empty((len(x), h))
        for t, at in enumerate(steps):
            g = z[at]
            if t:
                before = steps[t - 1][: len(at)]
                g = g + states[before] @ self.w[side + "h"]
            g = np.concatenate((_sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])), 1)
            c = g[:, :h] * g[:, 3 * h :]
            if t:
                c = c + g[:, h : 2 * h] * cells[before]
            gates[at], cells[at], states[at] = g, c, g[:, 2 * h : 3 * h] * np.tanh(c)
        return gates, cells, states

    def _vectors(self, b: Batch) -> np.ndarray:
        return np.concatenate((_sums(self.w["path"], b.path, b.path_n), _sums(self.w["word"], b.word, b.word_n) / b.word_n[:, None], b.fig), 1)

    def scores(self, b: Batch) -> np.ndarray:
        """The chance of each block to be main text."""
        if not len(b.fig):
            return np.zeros(0)
        x, (down, up) = self._vectors(b), b.steps()
        both = np.concatenate((self._read("t", x, down)[2], self._read("b", x, up)[2], x), 1)
        return _sigmoid(both @ self.w["out"] + self.w["bias"])

    def _back(self, side: str, x: np.ndarray, steps: list[np.ndarray], read: tuple, grown: np.ndarray, g: dict) -> np.ndarray:
        """Gradients of one LSTM through its steps, last first; returns that of the vectors."""
        h = HIDDEN_SIZE
        gates, cells, states = read
        dz, dh, dc = np.zeros((len(x), 4 * h)), np.zeros((len(steps[0]), h)), np.zeros((len(steps[0]), h))
        for t in range(len(steps) - 1, -1, -1):
            at, n = steps[t], len(steps[t])
            i, keep, out, new = (gates[at][:, k * h : (k + 1) * h] for k in range(4))
            total, tanh = grown[at] + dh[:n], np.tanh(cells[at])
            cell = dc[:n] + total * out * (1 - tanh**2)
            before = steps[t - 1][:n] if t else None
            last = cells[before] if t else 0.0
            d = np.concatenate((cell * new * i * (1 - i), cell * last * keep * (1 - keep), total * tanh * out * (1 - out), cell * i * (1 - new**2)), 1)
            dz[at] = d
            dh[:n], dc[:n] = d @ self.w[side + "h"].T, cell * keep
            if t:
                g[side + "h"] += states[before].T @ d
        g[side + "x"], g[side + "0"] = x.T @ dz, dz.sum(0)
        return dz @ self.w[side + "x"].T

    def gradient(self, b: Batch, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the weighted blocks and its gradient."""
        x, (down, up) = self._vectors(b), b.steps()
        top, bottom = self._read("t", x, down), self._read("b", x, up)
        both = np.concatenate((top[2], bottom[2], x), 1)
        p, weight = _sigmoid(both @ self.w["out"] + self.w["bias"]), weight / max(weight.sum(), 1e-9)
        loss = -(weight * np.where(labels > 0.5, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum()
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        e = weight * (p - labels)
        g["out"], g["bias"] = both.T @ e, np.array([e.sum()])
        grown, h = e[:, None] * self.w["out"], HIDDEN_SIZE
        dx = grown[:, 2 * h :] + self._back("t", x, down, top, grown[:, :h], g) + self._back("b", x, up, bottom, grown[:, h : 2 * h], g)
        np.add.at(g["path"], b.path, np.repeat(dx[:, :N_PATH], b.path_n, axis=0))
        np.add.at(g["word"], b.word, np.repeat(dx[:, N_PATH : N_PATH + N_WORD] / b.word_n[:, None], b.word_n, axis=0))
        return float(loss), g

    def fit(self, pages: list[list[tuple]], epochs: int = 12, size: int = 32, rate: float = 0.015, ridge: float = 1e-4, seed: int = 7) -> None:
        """Adam over pages in batches; blocks without a role count for context only."""
        r, known = np.random.default_rng(seed), {}
        pages = sorted((p for p in pages if any(x[3] is not None for x in p)), key=len)  # pages of a batch are about as long
        made = []
        for k in range(0, len(pages), size):
            some = pages[k : k + size]
            roles = [x[3] for p in some for x in p]
            made.append((Batch(some, known), np.array([float(x or 0) for x in roles]), np.array([float(x is not None) for x in roles])))
        m, v, n = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0
        for epoch in range(epochs):
            pace = rate * (1 - epoch / epochs) + rate / 20
            for i in r.permutation(len(made)):
                _, g = self.gradient(*made[i])
                n += 1
                for k, w in self.w.items():
                    d = g[k] + ridge * w
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    w -= pace * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)


#: What stands around articles, and the names that main parts go by.
PHRASES = (
    "Home", "About us", "Contact", "Log in", "Sign up", "Search", "News", "Archive", "Next", "Previous", "Read more", "Share this", "Tweet", "Impressum", "Datenschutz", "Accueil", "Inicio", "Kontakt", "Mentions légales",
    "All rights reserved.", "Terms of use", "Privacy policy", "Subscribe to our newsletter", "We use cookies to improve this site.", "Accept all cookies", "Leave a reply", "Comments", "Posted by", "Related articles", "Most read", "Advertisement", "Sponsored", "Your e-mail address", "Send", "Back to top", "Follow us", "Menu",
)
MAIN_PARTS = ("content", "main-content", "article-body", "post", "post-content", "entry", "entry-content", "story", "text", "page-body", "articleText", "main")
SYLLABLES = "an be co da el fi go ha in ju ka lo mi no or pe qu ra si te un va we xi yo zu".split()


def teaching_page(r: random.Random, main: list[str], scraps: list[str]) -> str:
    """A page of some layout around the texts of a main part; ``data-keep`` says what each part is."""
    phrase = lambda: r.choice(PHRASES) if r.random() < 0.6 else " ".join(r.choice(scraps).split()[: r.randrange(1, 5)])
    sentence = lambda: " ".join(r.choice(scraps if r.random() < 0.5 else main).split()[: r.randrange(3, 40)])

    def box(tags: str, inside: str, keep: int = 0) -> str:
        """``tag.class#id`` around something."""
        tag, *names = re.split(r"(?=[.#])", tags)
        attributes = "".join(f' {"class" if n[0] == "." else "id"}="{n[1:]}"' for n in names)
        return f"<{tag}{attributes} data-keep={keep}>{inside}</{tag}>"

    def menu(n: int) -> str:
        items = [f'<a href="/{i}">{phrase()}</a>' for i in range(n)]
        return r.choice(("<ul><li>" + "</li><li>".join(items) + "</li></ul>", " | ".join(items), "<p>" + "</p><p>".join(items) + "</p>", "<div>" + "</div><div>".join(items) + "</div>"))

    def comment() -> str:
        said = f"<p>{sentence()}</p>" if r.random() < 0.7 else f"<div>{sentence()}</div>"
        return box(r.choice(("div.comment", "li.comment", "article.comment", "div.reply", "div.comment-body")), f"<span>{phrase()}</span> {said}")

    parts = {
        "top": lambda: box(r.choice(("header", "div#header", "div.header", "div.top-bar", "header.site-header", "div")), f"<div>{phrase()}</div>" + menu(r.randrange(2, 7))),
        "menu": lambda: box(r.choice(("nav", "div.menu", "div#nav", "ul.navbar", "div.navigation", "div", "td")), menu(r.randrange(2, 9))),
        "crumbs": lambda: box(r.choice(("div.breadcrumb", "nav.breadcrumbs", "p")), " &raquo; ".join(f'<a href="#">{phrase()}</a>' for _ in range(3))),
        "side": lambda: box(r.choice(("aside", "div.sidebar", "div#sidebar", "section.widget", "div.right-column", "td.side")), f"<h3>{phrase()}</h3>" + (menu(4) if r.random() < 0.6 else f"<p>{sentence()}</p>")),
        "notice": lambda: box(r.choice(("div.cookie-notice", "div#cookie-banner", "div.notice", "div.alert", "section.consent", "dialog", "div.popup")), f"<p>{phrase() if r.random() < 0.5 else sentence()}</p><button>{phrase()}</button>"),
        "ad": lambda: box(r.choice(("div.ad", "div.ads", "div.advert", "div#ad-top", "ins.adsbygoogle", "div.sponsored", "aside.promo", "div.banner", "section.advertisement")), sentence() if r.random() < 0.7 else f"<p>{sentence()}</p>"),
        "form": lambda: box(r.choice(("form", "form.search", "div.newsletter", "form#login")), f"<label>{phrase()}</label><input type=text><p>{phrase()}</p><button>{phrase()}</button>"),
        "comments": lambda: box(r.choice(("section.comments", "div#comments", "div.comments", "ol.commentlist", "div.discussion")), f"<h3>{phrase()}</h3>" * (r.random() < 0.7) + "".join(comment() for _ in range(r.randrange(1, 6)))),
        "related": lambda: box(r.choice(("div.related", "section.related-posts", "div.more", "aside")), f"<h4>{phrase()}</h4>" + menu(4)),
        "foot": lambda: box(r.choice(("footer", "div.footer", "div#footer", "div", "p.copyright", "footer.site-footer")), f"&copy; {phrase()} &middot; {phrase()}" + (f"<br>{sentence()}" if r.random() < 0.4 else "") + (menu(3) if r.random() < 0.3 else "")),
    }
    some = lambda names, share: "".join(parts[x]() for x in r.sample(names, len(names)) if r.random() < share)
    own, inner = [], r.choice(("p", "p", "p", "div", "li", "mixed"))
    if r.random() < 0.1:  # many short paragraphs
        main = [" ".join(r.choice(main).split()[: r.randrange(1, 5)]) for _ in range(r.randrange(20, 90))]
    for i, text in enumerate(main):
        head = i == 0 and r.random() < 0.6
        tag = r.choice(("h1", "h1", "h2", "div")) if head else inner if inner != "mixed" else r.choice(("p", "p", "blockquote", "li", "pre", "td", "h2"))
        shown = " ".join(text.split()[: r.randrange(3, 12)]) if head else text
        if r.random() < 0.2:
            cut = shown.split(" ")
            cut.insert(r.randrange(len(cut) + 1), f'<a href="/x">{r.choice(cut)}</a>')
            shown = " ".join(cut)
        own.append(f"<{tag}>{shown}" + (f"</{tag}>" if r.random() < 0.9 or tag in ("div", "h1", "h2", "td") else ""))
        if r.random() < 0.12:
            own.append(parts[r.choice(("ad", "related", "form", "side"))]())
        if r.random() < 0.12:
            items = [" ".join(r.choice(main).split()[: r.randrange(1, 12)]) for _ in range(r.randrange(2, 7))]
            own.append(r.choice(("<ul><li>" + "</li><li>".join(items) + "</li></ul>", "<ol><li>" + "<li>".join(items) + "</ol>", "<table><tr><td>" + "</td><td>".join(items) + "</td></tr></table>")))
    body = "".join(own)
    kind = r.random()
    if kind < 0.4:
        tag = r.choice(("article", "main", "section.article", "article.post"))
        body = box(tag, (f"<header>{own[0]}</header>" + "".join(own[1:])) if r.random() < 0.2 else body, 1)
    elif kind < 0.75:
        body = box(r.choice(("div.", "div#", "section.", "td.")) + r.choice(MAIN_PARTS), body, 1)
    else:
        body = box(r.choice(("div", "div", "section", "td")), body, 1)
    if r.random() < 0.3:
        body = f"<div class={r.choice(('wrapper', 'container', 'row', 'col-8', 'page'))}>{body}</div>"
    if r.random() < 0.12:
        return f'<html data-keep=1><body>{"".join(own)}</body></html>' if r.random() < 0.7 else f"<p data-keep=1>{main[0]}</p>"
    before, after = some(["top", "menu", "crumbs", "notice", "ad", "form", "side"], 0.45), some(["comments", "related", "side", "ad", "form", "notice"], 0.4)
    return f"<!DOCTYPE html><html><head><title>{phrase()}</title></head><body data-keep=0>{before}{body}{after}{parts['foot']() if r.random() < 0.8 else ''}</body></html>"


def lessons(sample: list[str], layouts: int = 700, seed: int = 7) -> list[list[tuple]]:
    """The sampled pages under their own roles, and teaching pages of their texts in other layouts."""
    r, own = random.Random(seed), [blocks(page, own_role) for page in sample]
    own = [p for p in own if len(p) <= 400]
    invented = lambda n: " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(n)).capitalize() + "."
    mains = [m for m in ([x[0] for x in p if x[3] == 1][:12] for p in own) if m]
    scraps = [x[0] for p in own for x in p if x[3] == 0][:4000]
    mains += [[invented(r.randrange(2, 80)) for _ in range(r.randrange(1, 8))] for _ in range(max(40, len(mains) // 3))]
    scraps += [invented(r.randrange(1, 12)) for _ in range(200)]
    made = [teaching_page(r, [" ".join(t.split(" ")[:200]).replace("<", "").replace("&", "") or "." for t in r.choice(mains)], [s.replace("<", "").replace("&", "") or "." for s in scraps]) for _ in range(layouts)]
    return own + [blocks(page, taught_role) for page in made]


def train(pages: DataFrame, most_pages: int = 300, longest: int = 100_000) -> Labeller:
    """A labeller taught by about ``most_pages`` pages of up to ``longest`` characters, those whose hash is low.

    The share of hashes that is taken comes from the count of pages, so that what reaches the driver does not
    grow with them; twice ``most_pages`` is the most where very many pages are alike.
    """
    fit = pages.filter(F.length("html").between(1, longest)).select("page_id", "url", "html")
    share, steps = most_pages / max(1, fit.count()), 1 << 40
    low = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(steps)) < int(min(1.0, share) * steps)
    rows = fit.filter(low).select("html").limit(2 * most_pages).collect()
    labeller = Labeller()
    labeller.fit(lessons(sorted(r.html for r in rows)))
    return labeller


def extract(pages: DataFrame, labeller: Labeller, part: int = 200, sure: float = 0.5) -> DataFrame:
    """pages -> page_id, url, text, n_chars, blocks and kept_blocks (how many).

    A null or empty page has an empty text, as has one without any block of main text. Rows
    alike are read each.
    """
    model = pages.sparkSession.sparkContext.broadcast(labeller)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("blocks", T.IntegerType()), T.StructField("kept_blocks", T.IntegerType())]))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, known = model.value, {}
        for batch in batches:
            out = []
            for k in range(0, len(batch), part):
                some = [blocks(page) for page in batch.iloc[k : k + part]]
                keep, at = net.scores(Batch(some, known)) >= sure, 0
                for page in some:
                    texts = [x[0] for x, yes in zip(page, keep[at : at + len(page)]) if yes]
                    at += len(page)
                    out.append((" ".join(texts), len(page), len(texts)))
            yield pd.DataFrame(out, columns=["text", "blocks", "kept_blocks"])

    found = pages.select("page_id", "url", read(whole("html")).alias("r")).select("page_id", "url", "r.*")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "blocks", "kept_blocks")
