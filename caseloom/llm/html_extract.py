"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import slices

#: Elements that break the flow of text (HTML standard, rendering of flow content). Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without content (HTML standard, void elements). Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no displayed text. Fixed values.
SILENT = frozenset("script style title noscript template iframe xmp noembed noframes svg math object canvas audio video head".split())
_RAW = frozenset("script style title noscript template iframe xmp noembed noframes textarea".split())
#: A start tag of the key ends an open element of the value (HTML standard, optional tags). Fixed values.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: What a tag may hold after its name, up to its end; quoted values may hold anything.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Block elements of a page in page order, and the runs of text in them.

    ``parent`` of the first node is -1. ``runs`` holds (node, text), a run ending
    wherever a block element begins or ends.
    """

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    keys: list[tuple[str, str]] = field(default_factory=list)  # tag and its telling attributes
    chars: list[int] = field(default_factory=list)  # of text in the node itself
    linked: list[int] = field(default_factory=list)  # of these, within links
    stops: list[int] = field(default_factory=list)  # ends of sentences in it
    runs: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: str) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.keys.append((tag, attributes))
        self.chars.append(0)
        self.linked.append(0)
        self.stops.append(0)
        return len(self.parent) - 1


class _Scanner:
    """Tags of a page in order, in one pass over it.

    A quote that never closes makes the rest of the page be read without quotes; what
    looks like a tag that never ends is text. Comments and declarations are passed over.
    """

    def __init__(self, page: str):
        self.page, self.at, self.quotes = page, 0, True
        self.unended: set[str] = set()

    def next(self) -> tuple[str, str, str, str]:
        """Text up to the next tag, "/" or "", its name in lower case, and the rest of it; without name at the end."""
        page, start, look = self.page, self.at, self.at
        while (at := page.find("<", look)) >= 0:
            look = at + 1
            m = _OPEN.match(page, at)
            if m is None:
                if page.startswith("<!--", at):
                    end = page.find("-->", at + 4)
                    self.at = len(page) if end < 0 else end + 3
                    return page[start:at], "", "!", ""
                if page[look : look + 1] not in ("!", "?"):
                    continue
            end = -1
            if m and self.quotes:
                end = _REST.match(page, m.end()).end()
                if page[end : end + 1] != ">":
                    self.quotes, end = False, -1
            if end < 0:
                end = page.find(">", at)
                if end < 0:
                    break
            self.at = end + 1
            return page[start:at], m[1] if m else "", m[2].lower() if m else "!", page[m.end() : end] if m else ""
        self.at = len(page)
        return page[start:], "", "", ""

    def raw(self, tag: str) -> str:
        """The content of an element that holds no markup; its end tag comes next."""
        start, end = self.at, None
        if tag not in self.unended:
            end = re.compile(rf"</{tag}\b", re.I).search(self.page, start)
            if end is None:
                self.unended.add(tag)
        self.at = end.start() if end else len(self.page)
        return self.page[start : self.at]


def _told(rest: str) -> str:
    """Words of the attributes that tell what an element is."""
    words = set()
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value:
            words.add("hidden")
        elif name != "aria-hidden":
            words.update(_NAME.findall(value))
    return " ".join(sorted(words))


def parse(page: str | None) -> Tree:
    """Block tree of a page, forgiving wrong and missing tags as browsers do; in linear time.

    The root is the body, which every page has, with or without its tags.
    """
    page = page or ""
    tree = Tree()
    stack: list[tuple[str, int]] = [("body", tree.add(-1, "body", ""))]  # open elements and their blocks
    places: dict[str, list[int]] = {"body": [0]}  # where in the stack the open elements of a name are
    silent = links = 0
    buffer: list[str] = []
    scanner = _Scanner(page)

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                tree.runs.append((stack[-1][1], text))

    def say(text: str) -> None:
        if text and not silent:
            buffer.append(text)
            block = stack[-1][1]
            tree.chars[block] += len(text)
            tree.stops[block] += text.count(". ") + text.count("? ") + text.count("! ") + text.rstrip().endswith((".", "!", "?", "\u2026", "\u3002"))
            if links:
                tree.linked[block] += len(text)

    def close(depth: int) -> None:
        nonlocal silent, links
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCKS:
                flush()
            stack.pop()
            places[tag].pop()
            silent -= tag in SILENT
            links -= tag == "a"

    def last(tags: Iterable[str], until: Iterable[str] = ()) -> int:
        """Where the innermost open element of ``tags`` is, if none of ``until`` is further in."""
        top = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
        k = top(tags)
        return k if k > top(until) else 0

    while True:
        text, closing, tag, rest = scanner.next()
        say(text)
        if not tag:
            break
        if tag == "!":
            continue
        if closing:
            if places.get(tag) and tag != "body":
                close(last((tag,)))
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
            if places.get("head"):
                close(last(("head",)))
            if tag in ENDS and (k := last(ENDS[tag], _SCOPES.get(tag, ()))):
                close(k)
            if places.get("p") and (k := last(("p",), ("button", "td", "th", "caption"))):
                close(k)
        elif tag == "br":
            say(" ")
        elif tag == "a" and places.get("a"):
            close(last(("a",)))
        if tag == "body" and places.get("head"):
            close(last(("head",)))
        if tag in VOID or tag in ("html", "body"):
            continue
        block = stack[-1][1]
        if tag in BLOCKS:
            block = tree.add(block, tag, _told(rest) if rest else "")
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, block))
        silent += tag in SILENT
        links += tag == "a"
        if tag in _RAW:
            content = scanner.raw(tag)
            if tag == "textarea":
                say(content)
    close(1)
    flush()
    return tree


def _bucket(n: int) -> int:
    return min(6, n.bit_length() // 2)


def contexts(tree: Tree) -> list[tuple]:
    """What surrounds each node, as a tuple that ``node_features`` spells out."""
    n = len(tree.parent)
    chars, linked, stops = list(tree.chars), list(tree.linked), list(tree.stops)
    for k in range(n - 1, 0, -1):  # children stand behind their parents
        p = tree.parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        stops[p] += stops[k]
    alike = Counter((tree.parent[k], *tree.keys[k]) for k in range(n) if tree.keys[k][1])
    main = any(tag in ("article", "main") for tag, _ in tree.keys)
    inside, out, met = [False] * n, [], False
    for k in range(n):
        tag, told = tree.keys[k]
        up = tree.parent[k]
        inside[k] = up >= 0 and inside[up] or tag in ("article", "main")
        place = "first" if tag == "article" and not met else "within" if inside[k] else "beside" if main else "alone"
        met = met or tag == "article"
        repeats = min(2, alike[(up, tag, told)] - 1) if told else 0
        share = lambda a, b: 0 if not b else 1 + (4 * a >= b) + (4 * a > 3 * b)
        out.append((tag, told, tree.keys[up][0] if up >= 0 else "", place, repeats, _bucket(tree.chars[k]), share(tree.linked[k], tree.chars[k]), _bucket(chars[k]), share(linked[k], chars[k]), min(2, tree.stops[k]), min(2, stops[k])))
    return out


def node_features(context: tuple) -> list[str]:
    """What the model sees of a node: tag, parent and place, telling names and their beginnings,
    repeated siblings, and the size, links and sentences of its own text and of all within it."""
    tag, told, up, place, repeats, chars, share, all_chars, all_share, stops, all_stops = context
    names = told.split()
    return [
        f"tag {tag}", f"in {up}", f"{tag} in {up}", f"place {place}", f"{tag} {place}", f"{tag} in {up} {place}", *[f"name {x}" for x in names], *{f"starts {x[:4]}" for x in names if len(x) >= 4}, f"named {bool(names)}",
        f"repeats {repeats}", f"chars {chars}", f"links {share}", f"all chars {all_chars}", f"all links {all_share}", f"stops {stops}", f"all stops {all_stops}", f"{tag} stops {stops}", f"{tag} links {all_share}",
    ]


@dataclass
class Model:
    weights: dict[str, float]
    pair: np.ndarray  # [parent's state][child's state], logarithms of potentials


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(unary: np.ndarray, parent: np.ndarray, depth: np.ndarray, pair: np.ndarray, edges: bool = False):
    """Sum-product over a forest: messages upward, then downward, level by level.

    ``unary`` is (nodes, 2) in logarithms; roots have parent -1. Gives the
    probability of state 1 of each node; with ``edges`` also the expected counts of
    (parent's state, child's state).
    """
    up = unary.copy()
    sent = np.zeros_like(unary)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth, minlength=1))[:-1])
    for level in reversed(levels[1:]):
        sent[level] = _lse(pair[None, :, :] + up[level][:, None, :], 2)
        np.add.at(up, parent[level], sent[level])
    full, joint = up.copy(), np.zeros((2, 2))
    for level in levels[1:]:
        rest = full[parent[level]] - sent[level]
        full[level] = up[level] + _lse(rest[:, :, None] + pair[None, :, :], 1)
        if edges:
            b = rest[:, :, None] + pair[None, :, :] + up[level][:, None, :]
            b = np.exp(b - b.max(axis=(1, 2), keepdims=True))
            joint += (b / b.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    p = 1.0 / (1.0 + np.exp(np.clip(full[:, 0] - full[:, 1], -50, 50)))
    return (p, joint) if edges else p


#: Names that pages give to what is no main text, by kind. Common usage on the Web.
AROUND = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav topbar tabs toolbar skip links pagination pager sitemap",
    "advert": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion partner commercial",
    "notice": "cookie cookies notice consent popup modal gdpr privacy overlay paywall alert notification message toast",
    "side": "sidebar side aside related widget trending popular recommended recommendations more latest teaser rail also read",
    "social": "social share sharing follow buttons like tweet",
    "form": "search newsletter subscribe subscription signup login form contact poll",
    "comments": "comments comment discussion responses replies reply respond reviews feedback reactions talkback disqus guestbook forum thread user",
    "frame": "disclaimer copyright meta byline tags header footer masthead legal credits imprint logo",
}
#: Names that pages give to what holds main text. Common usage on the Web.
MAIN = "content post entry article main story body text page single prose copy wrapper container column inner row section"


def labelled_pages(n: int = 600, seed: int = 5) -> list[str]:
    """Pages made up for training; block elements carry their labels as ``data-y``, 1 is main text
    or holds some.

    They vary what surrounds an article and how articles themselves are marked up, from
    one bare paragraph to nested wrappers. A good part of the names is made up or left out,
    so that tags, places, links, sentences and repetition must carry the decision.
    """
    r = random.Random(seed)
    syllables = "ka lo mi ren sto ba ti ver on ul das en per qui so la ther ing".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    text = lambda a, b: ". ".join(some(max(1, a // 2), max(2, b // 2)) for _ in range(r.randint(1, 3))) + r.choice((".", ".", ".", "?", "!"))
    link = lambda a, b: f'<a href="/{word()}">{some(a, b)}</a>'

    def block(tag: str, y: int, inner: str, names: str = "") -> str:
        return f'<{tag} data-y="{y}"{names and f" {names}"}>{inner}</{tag}>'

    def named(names: str, odd: float = 0.25) -> str:
        x = word() if r.random() < odd else r.choice(names.split())
        if r.random() < 0.2:
            x = f"{r.choice(names.split())}-{x}"
        return r.choice((f'class="{x}"', f'id="{x}"', f'class="{x} {word()}"', f'class="{word()}-{x}"'))

    def listing(y: int, linked: bool) -> str:
        return block(r.choice(("ul", "ul", "ol")), y, "".join(block("li", y, link(1, 6) if linked else text(3, 20)) for _ in range(r.randint(2, 8))))

    def comments() -> str:
        name, tag, box = named(AROUND["comments"]), r.choice(("div", "article", "li")), named(AROUND["comments"])
        item = lambda: block(tag, 0, r.choice(("", block("span", 0, some(1, 2)), block("h4", 0, some(1, 2)), f"<b>{some(1, 2)}</b>")).replace('span data-y="0"', "span") + block("p", 0, text(3, 50)), name)
        inner = "".join(item() for _ in range(r.randint(1, 6)))
        inner = block("ul", 0, inner) if tag == "li" else inner
        return block(r.choice(("section", "div", "aside")), 0, r.choice(("", block(r.choice(("h2", "h3")), 0, r.choice(("", "3 ")) + some(1, 2)))) + inner, box)

    def around() -> str:
        kind = r.randrange(10)
        if kind == 0:
            return block("nav", 0, listing(0, True), r.choice(("", named(AROUND["menu"]))))
        if kind == 1:
            return block("div", 0, r.choice((listing(0, True), " ".join(link(1, 2) for _ in range(r.randint(2, 9))))), named(AROUND["menu"]))
        if kind == 2:
            return block(r.choice(("div", "section", "aside")), 0, r.choice((text(4, 30), block("p", 0, text(4, 30)), link(2, 8))), named(AROUND["advert"], 0.1))
        if kind == 3:
            return block("div", 0, block("p", 0, text(8, 30)) + block("button", 0, some(1, 2)), named(AROUND["notice"], 0.1))
        if kind == 4:
            return block("aside", 0, block("h2", 0, some(1, 3)) + r.choice((listing(0, True), block("p", 0, text(5, 40)))), r.choice(("", named(AROUND["side"]))))
        if kind == 5:
            return block(r.choice(("div", "section")), 0, r.choice(("", block("h3", 0, some(1, 3)))) + r.choice((listing(0, True), listing(0, True), listing(0, False), text(3, 20))), named(AROUND["side"], 0.1))
        if kind == 6:
            return block("form", 0, r.choice(("", block("p", 0, text(3, 12)))) + "<label>" + some(1, 2) + '</label><input name="q">' + block("button", 0, word()), r.choice(("", named(AROUND["form"]))))
        if kind == 7:
            return comments()
        if kind == 8:
            return block("div", 0, r.choice((" ".join(link(1, 1) for _ in range(r.randint(2, 5))), some(1, 3))), named(AROUND["social"], 0.1))
        return block("div", 0, r.choice((some(2, 8), text(2, 12))), named(AROUND["frame"], 0.1))

    def article(most: int) -> str:
        parts = [block("h1", 1, some(3, 12))] if r.random() < 0.75 else []
        for _ in range(r.randint(1, most)):
            kind = r.random()
            if kind < 0.1:  # without the end of a sentence, of any length
                parts.append(block("p", 1, some(1, r.choice((10, 60, 300)))))
            elif kind < 0.7:
                parts.append(block("p", 1, r.choice(("", "<b>")) + text(1, 90) + r.choice(("", "", f" {link(1, 4)} {text(3, 20)}")), named(MAIN, 0.6) if r.random() < 0.08 else ""))
            elif kind < 0.78:
                parts.append(block(r.choice(("h2", "h3", "h4")), 1, some(1, 8)))
            elif kind < 0.84:
                parts.append(listing(1, False))
            elif kind < 0.88:
                parts.append(block("blockquote", 1, r.choice((text(5, 40), block("p", 1, text(5, 40))))))
            elif kind < 0.91:
                parts.append(block("pre", 1, some(3, 30)))
            elif kind < 0.94:
                parts.append(block("table", 1, "".join(block("tr", 1, block("td", 1, some(1, 4)) * 2) for _ in range(3))))
            elif kind < 0.96:
                parts.append(block("figure", 1, block("figcaption", 1, text(3, 15))))
            else:
                parts.append(around())
        return "".join(parts)

    pages = []
    for _ in range(n):
        shape, bare = r.randrange(10), r.random() < 0.25
        inner = article(r.choice((1, 2, 9)))
        if shape < 3:
            inner = block("article", 1, inner + (around() if r.random() < 0.25 else ""), r.choice(("", "", named(MAIN))))
        elif shape == 3:
            inner = block("main", 1, r.choice((inner, block("article", 1, inner))))
        elif shape == 4:
            inner = block("div", 1, inner, named(MAIN, 0.4))
        elif shape == 5:
            inner = block("div", 1, block("div", 1, inner, r.choice(("", named(MAIN, 0.4)))), r.choice(("", named(MAIN, 0.4))))
        elif shape == 6:
            inner = block("section", 1, inner, r.choice(("", named(MAIN, 0.4))))
        before = after = ""
        if not bare:
            before = "".join(around() for _ in range(r.randint(0, 3)))
            if r.random() < 0.5:
                before = block("header", 0, r.choice(("", block("h1", 0, link(1, 2)))) + some(1, 4) + before) if r.random() < 0.5 else block("header", 0, some(1, 4)) + before
            after = "".join(around() for _ in range(r.randint(0, 3))) + (block("footer", 0, r.choice(("", "&copy; ")) + text(2, 14) + r.choice(("", link(1, 2)))) if r.random() < 0.8 else "")
        whole = before + inner + after
        for _ in range(r.choice((0, 0, 1, 2))):  # wrappers that hold what surrounds the article too
            whole = block("div", 1, whole, r.choice(("", named(MAIN, 0.5), named("wrap wrapper page site layout container root app", 0.5))))
        pages.append(f"<html><head><title>{some(2, 5)}</title></head><body>{whole}</body></html>")
    for _ in range(n // 8):  # one or a few paragraphs and nothing else, or not even a tag
        plain = lambda: some(8, 60) + r.choice((".", "", ". " + text(3, 30)))
        body = "".join(block("p", 1, plain()) for _ in range(r.randint(1, 3)))
        body = r.choice((body, block("div", 1, body, r.choice(("", named(MAIN, 0.6))))))
        pages += [f"<html><body>{r.choice((body, plain()))}</body></html>", body, plain()]
    return pages


_LABEL = re.compile(r'<(\w+) data-y="([01])"')


def labels_of(page: str) -> list[int]:
    """The labels of a made-up page, of its body first: that always holds main text."""
    return [1, *[int(y) for tag, y in _LABEL.findall(page) if tag in BLOCKS]]


def fit(pages: list[str], rounds: int = 150) -> Model:
    """Maximum-likelihood fit of node weights and the parent-child potentials.

    ``pages`` mark block elements by ``data-y``.
    """
    features, parent, depth, labels = [], [], [], []
    for page in pages:
        tree, base = parse(page), len(parent)
        said = labels_of(page)
        parent += [p + base if p >= 0 else -1 for p in tree.parent]
        depth += tree.depth
        labels += said
        features += [node_features(c) for c in contexts(tree)]
        if len(labels) != len(parent):
            raise ValueError("a labelled page must label each of its blocks")
    names = {f: i for i, f in enumerate(sorted({f for fs in features for f in fs}))}
    who = np.array([k for k, fs in enumerate(features) for _ in fs])
    what = np.array([names[f] for fs in features for f in fs])
    y, parent, depth = np.array(labels), np.array(parent), np.array(depth)
    child = np.nonzero(parent >= 0)[0]
    counts = np.zeros((2, 2))
    np.add.at(counts, (y[parent[child]], y[child]), 1)
    theta, m, v = (np.zeros(len(names) + 4) for _ in range(3))
    for k in range(1, rounds + 1):
        unary = np.stack([np.zeros(len(y)), np.bincount(who, theta[what], len(y))], axis=1)
        p, joint = marginals(unary, parent, depth, theta[-4:].reshape(2, 2), edges=True)
        g = np.concatenate([np.bincount(what, (y - p)[who], len(names)), (counts - joint).ravel()]) - 0.3 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) * min(1.0, 3 * (1 - k / (rounds + 1)))
    return Model({f: float(theta[i]) for f, i in names.items()}, theta[-4:].reshape(2, 2).copy())


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The model of the made-up labelled pages."""
    return fit(labelled_pages())


def extract(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page: blocks whose element is more likely main text than not."""
    trees = [parse(p) for p in pages]
    known: dict[tuple, float] = {}
    score, parent, depth, base = [], [], [], []
    for t in trees:
        base.append(len(parent))
        b = base[-1]
        parent += [p + b if p >= 0 else -1 for p in t.parent]
        depth += t.depth
        for c in contexts(t):
            found = known.get(c)
            if found is None:
                found = known[c] = sum(model.weights.get(f, 0.0) for f in node_features(c))
            score.append(found)
    unary = np.stack([np.zeros(len(score)), np.array(score, float)], axis=1) if score else np.zeros((0, 2))
    main = marginals(unary, np.array(parent, int), np.array(depth, int), model.pair) >= 0.5
    return ["\n\n".join([text for node, text in t.runs if main[b + node]]) for t, b in zip(trees, base, strict=True)]


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages (page_id, url, html)``.

    The html is parsed whole. Block elements are the nodes of a graphical model with
    potentials of tags, names, text size and links for each node and of the states of
    parent and child; exact sum-product gives each node's probability of holding main
    text. Character references are decoded, white space in a block becomes one blank,
    blocks are trimmed and joined by two line feeds. Null and empty pages, and pages
    without main text, give the empty string. Repeated rows and nulls in page_id and
    url stay as they are; other columns are ignored.
    """
    model = model or default_model()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            text = extract(batch.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
