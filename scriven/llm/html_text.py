"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a row of tokens. A word's score is the log-odds, learned from labelled pages, that a word in such a
place is main text. The place is told by the open elements (their names, and the words of their class, id and
role) and by the block it stands in: its length, how much of it is links, whether it ends like a sentence. So a
paragraph counts without any class name that is known, and a name that is known counts where the text says little.
A tag's score is negative, by how much more often it stands outside main text. One linear scan finds the
contiguous region of highest total; a run of negative words (an advert, however long) costs it no more than HOLE. Inside the
region, words whose elements alone speak against them, were they an ordinary paragraph, are left out. Blocks keep page order.

The labelled pages are `labelled_pages()`: pages with random nesting, containers and junk, whose main text is marked,
filled with invented words; half of the containers bear no class or an invented one. A logistic regression over
them is fitted once per Python worker in about a second.

Defined cases: null or empty html, or a page without a positive word, gives the empty text; unclosed or crossing
tags, missing quotes and stray "<" are read as browsers roughly do; scripts, styles and the like are no
tokens; an unclosed head ends where the body starts, <svg/> and <math/> are empty, an unclosed script, style,
textarea, title or iframe takes the rest of the page, other unclosed elements of the kind are read as any element; repeated
rows give equal rows; other columns pass through `extracted`, text and n_chars are replaced.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text><?[^<]*)",
    re.I | re.S,
)
#: Skipped with all they hold up to their closing tag; of these, without one, what takes the rest of a page in browsers too.
_TO_END = frozenset("script style textarea title iframe".split())
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in (*_TO_END, *"noscript template select object svg math canvas head".split())}
_BODY = re.compile(r"<body(?=[\s>/])", re.I)
#: Tags that an unclosed head may hold; text or any other opening tag ends it.
_IN_HEAD = frozenset("base basefont bgsound html link meta noframes noscript template".split())
_ATTRS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of these closes an open element of the same set below it.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Opening a block closes an open paragraph.
_BARRIERS = frozenset("table td th li ul ol div article section body button".split())
#: What a run of negative words costs the region at most: it is stepped over if more than that lies beyond it.
HOLE = -1.0
#: Features of an ordinary paragraph, for the question whether a word's elements alone speak against it.
ORDINARY = ("#long", "#plain", "#sentence")
KEEP, DROP = "keep", "/keep"


#: In a name of several words each of these tells of the page's layout or of something beside or inside the element: has-sidebar, comments-open.
ABOUT = frozenset("has no not non with without open opened closed enabled disabled free layout is show hide".split())
#: Share of a page's words from which an element with the headline in it holds the page; words of sentences that may lie outside one that does.
WIDE, FEW = 0.15, 25
#: Share of a page's sentences under which what was found cannot be its main text.
LITTLE = 0.1


def _names(value: str) -> set[str]:
    """Features of a class, id or role: =whole-name of one of several words, and .word for its words, unless one of them says that it is about something else."""
    found = set()
    for name in value.split():
        words = _NAME_WORDS.findall(_HUMP.sub(r"\1-\2", name).lower())
        if len(words) > 1:
            found.add(f"={'-'.join(words)}")
        found |= {"=about"} if len(words) > 1 and not ABOUT.isdisjoint(words) else {f".{w}" for w in words}
    return found


class Page:
    """Tokens of a page: for each tag or text its words, its element and the features of its block; for each element its parent and features."""

    def __init__(self, source: str):
        self.kinds: list[str] = []  # a tag's name, or "" for text
        self.texts: list[str] = []
        self.nodes: list[int] = []
        self.blocks: list[tuple[str, ...]] = []
        self.linked: list[bool] = []
        self.labels: list[bool] = []
        # elements in the order in which they open; 0 stands for the page
        self.parents, self.own, self.named, self.in_link, self.heads = [0], [()], [()], [False], [False]
        stack: list[tuple[str, int]] = []
        places: dict[str, list[int]] = defaultdict(list)  # where an element of a name is open

        def shut(to: int) -> None:
            while len(stack) > to:
                places[stack.pop()[0]].pop()

        def last(names) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=-1)

        kept = in_head = False
        at, unclosed = 0, set()
        while at < len(source):
            m = _TOKEN.match(source, at)
            raw, at, tag = m[0], m.end(), (m["name"] or "").lower()
            if tag in _CLOSE and not m["end"]:
                if tag in ("svg", "math") and m["attrs"].endswith("/"):
                    continue
                close = None if tag in unclosed else _CLOSE[tag].search(source, at)
                if close and not (tag == "head" and _BODY.search(source, at, close.start())):
                    at = close.end()
                    continue
                unclosed.add(tag)
                if tag in _TO_END:
                    break
                if tag == "head":
                    in_head = True
                    continue
            if in_head and not raw.startswith("<!--"):
                if m["end"]:
                    in_head = tag not in ("head", "body", "html")
                    continue
                if tag in _IN_HEAD or not tag and not (m["text"] or "").strip():
                    continue
                in_head = False
            node = stack[-1][1] if stack else 0
            if (text := m["text"]) is not None:
                self._add("", html.unescape(text), node, kept)
            elif raw.startswith("<!--"):
                kept = {KEEP: True, DROP: False}.get(raw[4:-3], kept)
            elif tag:
                if m["end"]:
                    if places.get(tag):
                        shut(places[tag][-1])
                else:
                    open_ = last(CLOSES.get(tag, {"p"} if tag not in INLINE and tag not in VOID else ()))
                    if open_ >= 0 and open_ >= last(_BARRIERS):
                        shut(open_)
                    if tag not in VOID:
                        parent = stack[-1][1] if stack else 0
                        names = () if tag in ("html", "body") else tuple({f for v in _ATTRS.findall(m["attrs"]) for f in _names("".join(v))})
                        own = () if tag in INLINE else (f"<{tag}>", "article header") if tag == "header" and places.get("article") else (f"<{tag}>",)
                        places[tag].append(len(stack))
                        stack.append((tag, len(self.parents)))
                        self.parents.append(parent)
                        self.own.append(own)
                        self.named.append(names)
                        self.in_link.append(tag == "a" or self.in_link[parent])
                        self.heads.append(tag in ("h1", "main"))
                self._add(tag, "", node, kept)
        self._describe()
        self._widen()

    def _widen(self) -> None:
        """Names of an element that holds the page tell nothing: of one with the headline, <main> or the only <article> in it and a good part of the words,
        or with nearly all sentences."""
        count = len(self.parents)
        words, self.sentences, articles = [0] * count, [0] * count, [0] * count
        for node, text, kind, block in zip(self.nodes, self.texts, self.kinds, self.blocks):
            if not kind and not self.in_link[node]:
                n = len(text.split())
                words[node] += n
                self.sentences[node] += n * ("#sentence" in block)
        for node in range(count - 1, 0, -1):
            up = self.parents[node]
            words[up] += words[node]
            self.sentences[up] += self.sentences[node]
            articles[up] += articles[node] + (self.own[node] == ("<article>",))
            self.heads[up] |= self.heads[node]
        for node in range(1, count):
            most = 2 * words[node] >= words[0]
            alone = self.sentences[node] >= words[node] / 2 and self.sentences[0] - self.sentences[node] < FEW
            if self.heads[node] and words[node] >= WIDE * words[0] or most and (articles[node] == 1 or alone):
                self.named[node] = ()

    def without_names_of_most(self) -> None:
        """Also of elements with half of the sentences."""
        for node in range(1, len(self.parents)):
            if 2 * self.sentences[node] >= self.sentences[0]:
                self.named[node] = ()

    def summed(self, of) -> list[float]:
        """For each element the sum of of(feature) over what is open there, each feature once."""
        out, path, open_ = [0.0] * len(self.parents), [], Counter()
        for node in range(1, len(self.parents)):
            while path and path[-1] != self.parents[node]:
                for f in (*self.own[path[-1]], *self.named[path[-1]]):
                    open_[f] -= 1
                path.pop()
            path.append(node)
            out[node] = out[self.parents[node]]
            for f in (*self.own[node], *self.named[node]):
                if not open_[f]:
                    out[node] += of(f)
                open_[f] += 1
        return out

    def features(self, node: int) -> set[str]:
        """What is open at an element: for the few that are learned from."""
        found: set[str] = set()
        while node:
            found |= {*self.own[node], *self.named[node]}
            node = self.parents[node]
        return found

    def _add(self, kind: str, text: str, node: int, kept: bool) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.nodes.append(node)
        self.labels.append(kept)
        self.linked.append(self.in_link[node])

    def _describe(self) -> None:
        """The block features of each token: of its length, links and end."""
        self.blocks = [()] * len(self.kinds)
        block: list[int] = []

        def close() -> None:
            counts = [len(self.texts[i].split()) for i in block]
            if words := sum(counts):
                links = sum(n for i, n in zip(block, counts) if self.linked[i])
                end = next(t for i in reversed(block) if (t := self.texts[i].rstrip()))[-1]
                size = "#one" if words < 4 else "#short" if words < 10 else "#long" if words < 30 else "#longer"
                found = (size, "#plain" if not links else "#some" if 2 * links <= words else "#links", *(["#sentence"] if words > 3 and end in ".!?…:;\"”»。" else []))
                for i in block:
                    self.blocks[i] = found
            block.clear()

        for i, kind in enumerate(self.kinds):
            if not kind:
                block.append(i)
            elif kind not in INLINE:
                close()
        close()


def _filler(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8))) for _ in range(n))


#: Words of class, id and role: of containers of main text, of neutral ones, and of each kind of junk with its elements and filling.
#: A filling: {n} is about n invented words, {n.} a sentence, |...* what is repeated a few times.
_MAIN = "article post entry content story main text body page single blog news hentry".split()
_NEUTRAL = "container wrapper wrap row col grid inner outer layout site block box center left".split()
_JUNK = (
    ("nav div ul section", "menu nav navigation navbar topnav links breadcrumb breadcrumbs pagination toolbar submenu", ("|<li><a href=x>{1}</a></li>*", "<ul>|<li><a href=x>{2}</a></li>*</ul>", "|<a href=x>{1}</a> *", "|<a href=x>{2}</a><br>*")),
    ("header div", "header masthead branding logo topbar head banner", ("<a href=/>{2}</a>", "<h1>{2}</h1><p>{5}</p>", "<div>{3}</div>|<a href=x>{1}</a>*", "{4}")),
    ("footer div p", "footer copyright legal colophon bottom contentinfo imprint", ("{9.}", "<p>{12.}</p>", "&copy; {4} &middot; {6.}", "|<a href=x>{2}</a>*<p>{8}</p>")),
    ("aside div section", "sidebar side widget related trending popular recommended more teaser complementary secondary", ("<h3>{2}</h3>|<p>{9}</p>*", "<ul>|<li><a href=x>{6}</a></li>*</ul>", "{14.}", "<h3>{2}</h3><ul>|<li>{4}</li>*</ul>", "|<p>{20.}</p>*")),
    ("div section p", "notice cookie cookies consent alert warning disclaimer popup modal overlay paywall notification message", ("{12.}", "<p>{16.}</p><button>{1}</button>", "|<p>{9.}</p>*")),
    ("div aside section p ins", "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion promoted commercial", ("{9.}", "<p>{20.}</p>", "<a href=x>{5}</a>", "|<p>{14.}</p>*", "{30.}")),
    ("div ul", "share social sharing follow tags tools actions", ("|<a href=x>{1}</a> *", "|<li><a href=x>{1}</a></li>*", "{3}")),
    ("div section", "newsletter subscribe signup search login register contact poll survey", ("<form><p>{9.}</p><input name=x><button>{2}</button></form>", "<form role=search><label>{2}</label><input><button>{1}</button></form>", "<p>{12.}</p><form><input></form>")),
    ("form", "", ("<p>{8.}</p><label>{2}</label><input name=x><button>{2}</button>", "<select><option>{1}</option></select><button>{1}</button>")),
    ("section div ol ul", "comments comment replies reply responses response respond discussion disqus feedback reviews thread readers", ("|<p>{14.}</p>*", "<h3>{2}</h3>|<div class=comment><p>{18.}</p></div>*", "|<li><b>{2}</b><p>{25.}</p></li>*", "|<article><p>{16.}</p></article>*", "|<div>{12.}</div>*")),
)
_BLOCKS = ("<p>{40.}</p>", "<p>{25.}</p>", "<p>{60.}</p>", "<p>{30.}</p>", "<p>{3.}</p>", "<p>{1.}</p>", "<p>{8.}</p>", "<p>{20} <a href=x>{3}</a> {14.}</p>", "<p><b>{4}</b> {22.}</p>", "<p><b>{12.}<br><p>{30.}</p>", "<h2>{4}</h2>", "<h3>{2}</h3><p>{20.}</p>", "<ul>|<li>{8}</li>*</ul>", "<ol>|<li>{14.}</li>*</ol>", "<blockquote>{14.}</blockquote>", "<blockquote><p>{20.}</p></blockquote>", "<pre>{9}</pre>", "<figure><img src=x><figcaption>{7}</figcaption></figure>", "<table>|<tr><td>{3}</td><td>{2}</td></tr>*</table>", "{25.}<br><br>{30.}<br>", "<div>{35.}</div>", "<dl><dt>{2}</dt><dd>{12.}</dd></dl>")
_BARE = "nav header footer aside".split()
#: Second words of names of junk as of main text.
_PARTS = "left right top bottom fixed sticky page list area box inner wrapper main item".split()
#: What wrappers of main text say about the junk beside or inside them.
_ABOUT_JUNK = ("has-{}", "has-{}", "no-{}", "with-{}", "without-{}", "{}-open", "{}-closed", "{}-enabled", "{}-disabled", "{}-fixed", "{}-left", "{}-right", "{}-free", "{}-page", "sticky-{}", "layout-{}", "layout-{}-left", "is-{}", "show-{}", "hide-{}")


def labelled_pages(n: int = 600, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8)))

    def filled(part: str) -> str:
        part = re.sub(r"\|([^|*]*)\*", lambda m: m[1] * rng.randint(1, 6), part)

        def words(m: re.Match) -> str:
            said = [word() for _ in range(max(1, round(int(m[1]) * rng.uniform(0.4, 1.8))))]
            return " ".join(said).capitalize() + "." if m[2] and len(said) > 1 or m[2] and rng.random() < 0.5 else " ".join(said)

        return re.sub(r"\{(\d+)(\.?)\}", words, part)

    def named(name: str, names: list[str], sure: bool) -> str:
        """An opening tag: of the names one or two, invented ones, or none; `sure`: one of the names."""
        drawn = rng.random()
        if names and (sure or drawn < 0.3):
            said = [rng.choice(names)] + [rng.choice((word(), word(), rng.choice(_PARTS)))] * (rng.random() < 0.3)
        elif drawn < 0.6:
            said = [rng.choice(_NEUTRAL) if rng.random() < 0.4 else word()]
        else:
            return f"<{name}>"
        rng.shuffle(said)
        if sure and said[0] in ("navigation", "banner", "contentinfo", "complementary", "search"):
            return f"<{name} role={said[0]}>"
        return f"<{name} {rng.choice(('class', 'class', 'id'))}='{rng.choice((' ', '-')).join(said)}'>"

    def wrapper(name: str, names: list[str]) -> str:
        """An opening tag of what holds main text: one in three says something about junk."""
        if rng.random() > 0.35:
            return named(name, names, False)
        about = rng.choice(_ABOUT_JUNK).format(rng.choice([x for _, x, _ in _JUNK if x][rng.randrange(len(_JUNK) - 1)].split()))
        said = [about] + [rng.choice(names or _NEUTRAL)] * (rng.random() < 0.5)
        rng.shuffle(said)
        return f"<{name} class='{' '.join(said)}'>"

    def junk(kinds: tuple[int, ...]) -> str:
        tags, names, fillings = _JUNK[rng.choice(kinds)]
        filling = rng.choice(fillings)
        name = rng.choice([t for t in tags.split() if t not in ("p", "ins") or "<p>" not in filling])
        return f"{named(name, names.split(), name not in _BARE and name != 'form')}{filling}</{name}>"

    def content() -> str:
        wraps = rng.choice((["article"], ["article"], ["main", "article"], ["section"], ["div"], ["div"], ["div", "div"], ["main"], ["div", "article", "div"], ["main", "div"], ["table", "tr", "td"], []))
        head = rng.choice(("<h1>{7}</h1>", "<h1>{7}</h1>", "<h2>{5}</h2>", ""))
        if "article" in wraps and head and rng.random() < 0.3:
            head = f"<header>{head}</header>"
        body, inner = [head], rng.random() < 0.5
        for k in range(rng.randint(2, 8)):
            body.append(rng.choice(_BLOCKS[:4]) if k == 0 or rng.random() < 0.5 else rng.choice(_BLOCKS))
            if inner and k and rng.random() < 0.3:
                body.append(f"<!--{DROP}-->{junk((3, 4, 5, 5, 5, 6, 7))}<!--{KEEP}-->")
        tail = junk((6, 9, 9, 2, 3)) if rng.random() < 0.3 else ""
        opened = "".join(f"<{w}>" if w in ("table", "tr") else wrapper(w, _MAIN) for w in wraps)
        return f"{opened}<!--{KEEP}-->{''.join(body)}<!--{DROP}-->{tail}{''.join(f'</{w}>' for w in reversed(wraps))}"

    out = []
    for _ in range(n):
        before = "".join(junk((0, 0, 1, 1, 4, 5, 7, 8, 3)) for _ in range(rng.randint(0, 4)))
        after = "".join(junk((9, 9, 2, 2, 3, 5, 6, 7, 8)) for _ in range(rng.randint(0, 4)))
        around = rng.choice(("", "", "div"))
        page = before + content() + after
        out.append(f"<html><body>{filled(wrapper(around, []) + page + '</div>' if around else page)}</body></html>")
    return out


class Weights:
    """bias and per-feature log-odds of words; negative scores of tags."""

    def __init__(self, pages: list[str], turns: int = 15, ridge: float = 0.1):
        rows, labels, counts, tags, met = [], [], [], defaultdict(lambda: [1.0, 1.0]), Counter()
        totals = [1.0, 1.0]
        for page in map(Page, pages):
            for kind, text, node, block, kept in zip(page.kinds, page.texts, page.nodes, page.blocks, page.labels):
                if kind:
                    tags[kind][kept] += 1
                elif n := len(text.split()):
                    rows.append((*page.features(node), *block))
                    labels.append(kept)
                    counts.append(n**0.5)  # a short text that is judged wrongly is wrong too
                    totals[kept] += n
            met.update({f for fs in (*page.own, *page.named, *page.blocks) for f in fs})
        names = sorted(f for f, times in met.items() if times >= 4)  # most invented names are met on fewer pages
        place = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(rows), len(names) + 1))
        x[:, -1] = 1
        for i, r in enumerate(rows):
            x[i, [place[f] for f in r if f in place]] = 1
        y, n, w = np.array(labels, float), np.array(counts, float), np.zeros(len(names) + 1)
        n *= len(n) / n.sum()
        penalty = ridge * (np.arange(len(w)) < len(names))
        for _ in range(turns):  # Newton's steps
            p = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (n * (p - y)) + penalty * w)
        self.words, self.bias = dict(zip(names, w)), float(w[-1])
        #: what a tag costs: at least 0.1; rarer inside main text, more
        self.tags = {t: -max(0.1, 0.2 + 0.15 * float(np.log(out / totals[0] / (inside / totals[1])))) for t, (out, inside) in tags.items()}
        self.known = sorted((f[1:] for f in names if f[0] == "." and len(f) > 5), key=len, reverse=True)
        self.seen: dict[str, float] = {}

    def of(self, feature: str) -> float:
        """The weight of a feature. An unknown name that begins or ends with a known one (commentlist, subheader) counts as that."""
        if feature in self.words or feature[0] != ".":
            return self.words.get(feature, 0.0)
        if feature not in self.seen:
            if len(self.seen) > 100_000:
                self.seen = {}
            self.seen[feature] = next((self.words["." + k] for k in self.known if feature.startswith(k, 1) or feature.endswith(k)), 0.0)
        return self.seen[feature]

    def places(self, page: Page) -> list[float]:
        """What each element of a page says about a word in it."""
        return [self.bias + s for s in page.summed(self.of)]

    def block(self, features: tuple[str, ...]) -> float:
        return sum(self.words.get(f, 0.0) for f in features)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.2)


@lru_cache(maxsize=1)
def weights() -> Weights:
    return Weights(labelled_pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, stop) of the contiguous part of highest total, the first of equals; empty if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def priced(page: Page, w: Weights, places: list[float]) -> list[float]:
    """The scores for the scan: a word's times its words, a tag's; a run of negative words and their tags costs HOLE at most."""
    out, hole, since = [], 0.0, None
    for kind, text, node, block in zip(page.kinds, page.texts, page.nodes, page.blocks):
        if kind:
            s = w.tag(kind)
        else:
            n = len(text.split())
            s = (places[node] + w.block(block)) * n
            if s > 0:
                since = None
            elif n and since is None:
                since, hole = True, 0.0
        if since:
            s, hole = max(s, HOLE - hole), hole + max(s, HOLE - hole)
        out.append(s)
    return out


def main_text(source: str | None, w: Weights | None = None) -> str:
    w = w or weights()
    page = Page(source or "")
    places = w.places(page)
    start, stop = best_region(priced(page, w, places))
    if page.sentences[0] >= FEW and sum(len(t.split()) for t in page.texts[start:stop]) < LITTLE * page.sentences[0]:
        # a page has a main text: where hardly any was found, a name stood against it that means something else here
        page.without_names_of_most()
        places = w.places(page)
        start, stop = best_region(priced(page, w, places))
    ordinary = w.block(ORDINARY)
    blocks, block = [], []
    for i in range(start, stop):
        kind = page.kinds[i]
        if not kind:
            place = places[page.nodes[i]]
            # junk inside the region speaks against itself twice: by its elements, were it an ordinary paragraph, and as it is
            if place + ordinary > 0 or place + w.block(page.blocks[i]) > 0:
                block.append(page.texts[i])
        elif kind == "br":
            block.append(" ")
        elif kind not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extracted(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = weights()
        for batch in batches:
            yield batch.map(lambda s: main_text(s, w), na_action=None)

    text = F.pandas_udf(run, "string")
    out = pages.withColumn("text", text(F.coalesce(F.col("html").cast("string"), F.lit(""))))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
