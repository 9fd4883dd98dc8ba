"""HTML main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A tolerant parser turns a page into leaf blocks: the text between two block boundaries, with its place in the tree of open elements.
It reads forward only, and what the features need of an element's ancestors is kept with the element; so its time and memory grow in
proportion to the page, however deep or unclosed its markup is.
Each block has binary features of its ancestors (tags, and words of their class, id and role), of its own text (length, links,
punctuation, set phrases) and of its place. The field has two labels, main text and rest, weights for (feature, label) and for
label pairs; it is trained by gradient ascent of the penalised log-likelihood, with forward-backward on labelled
pages, and decoded by Viterbi. The labelled pages come from ``training_pages``: page layouts composed from a rule with a fixed seed,
where the label of a block is known from how it was made. The model is small and of fixed size; each task gets a copy.

Script, style, template, form controls, head content and what stands in for media that are shown are markup and never become blocks.
Formulas and drawings keep their visible text; elements that HTML doesn't know are inline, as in browsers.

Defined cases: null and empty html give an empty text; unclosed and stray tags are closed as browsers do, roughly; a tag that never ends
is dropped with what follows it; unknown character references stay as written; nothing is dropped or cut for its length; equal pages
give equal texts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- parsing ----------------------------------------------------------------------------------------------

_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)>")
_TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r"""[>]|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?]")

VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Elements that stand for themselves, above and below their neighbours; all others are inline.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "listing main menu nav noframes ol p plaintext pre search section summary table tbody td tfoot th thead title tr ul xmp".split()
)
#: Inline elements that a block start closes where a page leaves them open.
FORMATTING = frozenset("b big code em font i nobr s small strike strong tt u".split())
#: Elements whose content is no text of the page; those of the second line take the place of a space.
SILENT = frozenset("script style noscript template head title noframes annotation annotation-xml".split()) | (
    _APART := frozenset("iframe object canvas audio video select option textarea button datalist".split())
)
_SILENT_DRAWING = frozenset("desc metadata defs symbol".split())
_FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style textarea title iframe noscript noframes xmp".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
#: Start tags that may stand in an open head; any other, and any text, closes it.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: A start tag of the key closes an open element of the value, unless one of the fences lies between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("tr", "thead")}
_FENCES = frozenset("ul ol dl table select div section article body html".split())
_FENCED_ENDS = frozenset("p li td th tr dt dd".split())


class Node:
    """An open element, with what features ask about it and its ancestors."""

    __slots__ = ("tag", "parent", "depth", "fence", "block", "tags", "kinds", "near", "hidden", "path")

    def __init__(self, tag: str, parent: Node | None, kinds: int, hidden: bool, path: int):
        self.tag, self.parent, self.path = tag, parent, path
        own = 1 << _TAG_BIT[tag] if tag in _TAG_BIT else 0
        if parent is None:
            self.depth = 0
            self.fence = 0 if tag in _FENCES else -1
            self.block, self.tags, self.kinds, self.near, self.hidden = tag if tag in BLOCK else "", own, kinds, (kinds, 0, 0), hidden
        else:
            self.depth = parent.depth + 1
            self.fence = self.depth if tag in _FENCES else parent.fence
            self.block = tag if tag in BLOCK else parent.block
            self.tags, self.kinds, self.hidden = parent.tags | own, parent.kinds | kinds, parent.hidden or hidden
            self.near = (kinds, parent.near[0], parent.near[1])


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None
    link_chars: int

    @property
    def tag(self) -> str:
        return self.node.block if self.node else ""


def _names(attributes: str) -> tuple[tuple, int, bool]:
    """The words of class, id and role; the kinds that they stand for; whether the element is hidden.

    Tags repeat on a site, so short ones are remembered; long ones (styles, inlined data) are read anew each time, so what is held is 4,096 short strings.
    """
    return _short_names(attributes) if len(attributes) <= 256 else _read_names(attributes)


def _read_names(attributes: str) -> tuple[tuple, int, bool]:
    found, hidden, seen = set(), False, set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in seen:  # the first of equal attributes counts
            continue
        seen.add(key)
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key in ("class", "id", "role"):
            found.update(_NAME.findall(value))
    kinds = 0
    for w in found:
        if w in _KIND:
            kinds |= 1 << _KIND_BIT[_KIND[w]]
    return (*sorted(found), "!hidden") if hidden else tuple(sorted(found)), kinds, hidden


_short_names = lru_cache(maxsize=4096)(_read_names)
_NO_NAMES: tuple[tuple, int, bool] = ((), 0, False)


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag, outside of quoted values; -1 if there is none."""
    while m := _TAG_STOP.search(page, at):
        if not m[1]:
            return m.start()
        at = page.find(m[1], m.end()) + 1
        if not at:
            return -1
    return -1


class _Parser:
    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[Node] = []
        self.open: dict[str, list[int]] = {}  # depths of the open elements of a tag
        self.paths: dict[tuple, int] = {}  # equal tags and names from the root on have one number
        self.parts: list[str] = []
        self.links = self.silent = self.foreign = 0
        self.quiet: list[bool] = []  # for each open element, whether it counts in silent

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", _html.unescape("".join(self.parts))).strip()
            if text:
                self.out.append(Block(text, self.stack[-1] if self.stack else None, self.links))
            self.parts.clear()
        self.links = 0

    def push(self, tag: str, attributes: str) -> None:
        names, kinds, hidden = _names(attributes) if attributes else _NO_NAMES
        parent = self.stack[-1] if self.stack else None
        path = self.paths.setdefault((parent.path if parent else -1, tag, names), len(self.paths))
        node = Node(tag, parent, kinds, hidden, path)
        self.stack.append(node)
        self.open.setdefault(tag, []).append(node.depth)
        quiet = tag in SILENT or (self.foreign > 0 and tag in _SILENT_DRAWING)
        self.quiet.append(quiet)
        self.silent += quiet
        self.foreign += tag in _FOREIGN

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.open[tag].pop()
        self.silent -= self.quiet.pop()
        self.foreign -= tag in _FOREIGN

    def close(self, tag: str, fenced: bool) -> None:
        depths = self.open.get(tag)
        if not depths:
            return
        depth = depths[-1]
        if fenced and self.stack[-1].fence > depth:
            return
        while len(self.stack) > depth:
            self.pop()

    def leave_head(self) -> None:
        if self.stack and self.stack[-1].tag == "head":
            self.pop()

    def text(self, piece: str) -> None:
        if self.silent and not piece.isspace():
            self.leave_head()
        if not self.silent:
            self.parts.append(piece)
            if self.open.get("a"):
                self.links += len(piece)

    def end_tag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK and not self.foreign:
            self.flush()
        self.close(tag, tag in _FENCED_ENDS)
        if (tag in _APART or (tag == "text" and self.foreign)) and not self.silent:
            self.parts.append(" ")

    def start_tag(self, tag: str, attributes: str) -> bool:
        """Whether the element's content is no markup."""
        if tag not in _IN_HEAD:
            self.leave_head()
        if tag == "br":
            self.parts.append(" ")
            return False
        if tag in BLOCK and not (self.foreign and tag == "title"):
            self.flush()
            self.close("p", True)
            while self.stack and self.stack[-1].tag in FORMATTING:
                self.pop()
            for old in _CLOSES.get(tag, ()):
                self.close(old, True)
            if tag == "body":
                self.close("head", False)
        elif (tag in _APART or (tag == "text" and self.foreign)) and not self.silent:
            self.parts.append(" ")
        if tag in VOID or (self.foreign and attributes.endswith("/")):
            return False
        self.push(tag, attributes)
        return tag in RAW and not self.foreign


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    parser, at, quotes = _Parser(), 0, True
    last = page.rfind(">")  # no tag ends after it
    while True:
        i = page.find("<", at)
        if i < 0 or i > last:
            break
        if i > at:
            parser.text(page[at:i])
        m = _PLAIN_TAG.match(page, i)
        attributes = ""
        if m:
            at = m.end()
        elif m := _TAG_START.match(page, i):
            end = _tag_end(page, m.end()) if quotes else -1
            if end < 0:  # quotes are out of step: from here on a tag ends at its first >
                quotes, end = False, page.find(">", m.end())
            attributes, at = page[m.end() : end], end + 1
        elif page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            if page.startswith((">", "->"), i + 4):  # an empty comment
                end = page.find(">", i) - 2
            at = end + 3 if end >= 0 else len(page)
            continue
        elif page[i + 1] in "!?/":
            at = page.find(">", i) + 1
            continue
        else:
            parser.text("<")
            at = i + 1
            continue
        tag = m[2].lower()
        if m[1]:
            parser.end_tag(tag)
        elif parser.start_tag(tag, attributes):  # its content is no markup: on from its end tag
            end = _RAW_END[tag].search(page, at)
            if tag == "xmp":
                parser.text(page[at : end.start() if end else len(page)].replace("&", "&amp;"))
            at = end.start() if end else len(page)  # never closed: the rest is its content
    rest = page[at:]
    if cut := _CUT_TAG.search(rest):
        rest = rest[: cut.start()]
    if rest:
        parser.text(rest)
    parser.flush()
    return parser.out


# --- features ---------------------------------------------------------------------------------------------

#: Words of class, id and role names that carry meaning in page layouts, by what they stand for (fixed values).
VOCABULARY = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toolbar pagination pager toc sitemap skip",
    "head": "header masthead banner branding logo topbar site",
    "foot": "footer foot copyright legal colophon bottom credits imprint",
    "side": "sidebar side aside widget rail complementary related recommended trending popular more also tags tag meta byline author share social sharing follow",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog banner toast newsletter subscribe subscription signup paywall promo",
    "advert": "ad ads adv advert advertisement adsense sponsor sponsored promoted promotion commercial dfp outbrain taboola",
    "form": "form login search searchbox input register contact",
    "comment": "comment comments commentlist reply replies respond disqus discussion response responses thread reader readers review reviews",
    "main": "article content main post entry story body text maincontent articlebody bodytext prose page paragraph",
}
_KIND = {w: kind for kind, words in VOCABULARY.items() for w in words.split()}
_KIND_BIT = {kind: i for i, kind in enumerate(VOCABULARY)}
_MAIN_BIT = 1 << _KIND_BIT["main"]
_TAGS = "article main nav header footer aside section div form p li ul ol dl dd dt td th table blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption body span a address fieldset details dialog".split()
_TAG_BIT = {t: i for i, t in enumerate(_TAGS)}
_PHRASES = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign up|log ?in|advert|sponsored|read more|click here|share|follow us|privacy|terms of|\breply\b|\bcomments?\b", re.I)
_END = re.compile(r"[.!?…。][\"'”’)]*$")

FEATURES = {name: i for i, name in enumerate(
    ["bias", *(f"tag={t}" for t in _TAGS), *(f"up={t}" for t in _TAGS), *(f"kind={k}" for k in VOCABULARY), *(f"near={k}" for k in VOCABULARY), "hidden", "in article", "in boilerplate tag", "no landmark", "plain article", "plain",
     *(f"words{k}" for k in range(6)), *(f"links{k}" for k in range(4)), "sentence end", "commas", "phrase", "phrase in plain article", "short in plain article", "first", "last", "early", "late", "same parent as before", "same path as before"]
)}
#: Pages whose names say nothing of their parts have weights of their own.
_UNNAMED = len(FEATURES)
FEATURES |= {f"{name}, unnamed page": i + _UNNAMED for name, i in FEATURES.items()}
_ARTICLE, _BOILER = ({"article", "main"}, {"nav", "header", "footer", "aside", "form", "address", "dialog"})
_IN_ARTICLE, _IN_BOILER = (sum(1 << _TAG_BIT[t] for t in tags) for tags in (_ARTICLE, _BOILER))


@lru_cache(maxsize=1 << 16)
def _of_path(tag: str, tags: int, kinds: int, near: int, hidden: bool) -> tuple[int, ...]:
    """The features of an element and its ancestors."""
    on = ["bias", f"tag={tag}", *(f"up={t}" for t, i in _TAG_BIT.items() if tags >> i & 1)]
    on += [f"kind={k}" for k, i in _KIND_BIT.items() if kinds >> i & 1] + [f"near={k}" for k, i in _KIND_BIT.items() if near >> i & 1]
    if hidden:
        on.append("hidden")
    if tags & _IN_ARTICLE:
        on.append("in article")
    if tags & _IN_BOILER:
        on.append("in boilerplate tag")
    if not tags & (_IN_ARTICLE | _IN_BOILER):
        on.append("no landmark")
    if not kinds & ~_MAIN_BIT and not tags & _IN_BOILER and not hidden:
        on.append("plain article" if tags & _IN_ARTICLE else "plain")
    return tuple(FEATURES[f] for f in on if f in FEATURES)


_IN_PLAIN = FEATURES["plain article"]
_ROOT = Node("", None, 0, False, -1)
_WORDS, _LINKS = ([FEATURES[f"{name}{k}"] for k in range(n)] for name, n in (("words", 6), ("links", 4)))
_SENTENCE, _COMMAS, _PHRASE, _OWN_PHRASE, _OWN_SHORT, _FIRST, _LAST, _EARLY, _LATE, _PARENT, _PATH = (
    FEATURES[f] for f in ("sentence end", "commas", "phrase", "phrase in plain article", "short in plain article", "first", "last", "early", "late", "same parent as before", "same path as before")
)


def features(found: list[Block]) -> Iterator[list[int]]:
    """The indexes of the features that hold, for each block."""
    before, n = None, len(found)
    named = any(b.node is not None and b.node.kinds & ~_MAIN_BIT for b in found)  # the page's names say what its parts are
    for i, b in enumerate(found):
        node, text = b.node or _ROOT, b.text
        on = [*_of_path(node.block, node.tags, node.kinds, node.near[0] | node.near[1] | node.near[2], node.hidden)]
        words = text.count(" ") + 1
        on.append(_WORDS[min(5, words.bit_length() - 1)])
        on.append(_LINKS[min(3, 4 * b.link_chars // len(text))])
        if _END.search(text, max(0, len(text) - 64)):
            on.append(_SENTENCE)
        if words > 8 and text.count(",") * 12 > words:
            on.append(_COMMAS)
        if words < 40 and _PHRASES.search(text):
            on.append(_PHRASE)
            if _IN_PLAIN in on:
                on.append(_OWN_PHRASE)
        if words < 4 and _IN_PLAIN in on:
            on.append(_OWN_SHORT)
        if i == 0:
            on.append(_FIRST)
        if i == n - 1:
            on.append(_LAST)
        if 5 * i < n:
            on.append(_EARLY)
        if 5 * (i + 1) > 4 * n:
            on.append(_LATE)
        if before is not None:
            if (node.parent or _ROOT).path == (before.parent or _ROOT).path:
                on.append(_PARENT)
            if node.path == before.path:
                on.append(_PATH)
        before = node
        yield on if named else [f + _UNNAMED for f in on]


# --- the field --------------------------------------------------------------------------------------------


@dataclass
class Field:
    weights: np.ndarray  # features, 2
    moves: np.ndarray  # 2, 2
    unnamed_moves: np.ndarray | None = None  # those of unnamed pages, if they have their own

    def scores(self, page: Iterable[list[int]]) -> np.ndarray:
        """A row of two for each block; each block has features."""
        rows = [np.empty((0, 2))]
        for part in batched(page, 8192):
            starts = np.cumsum([0, *map(len, part[:-1])])
            rows.append(np.add.reduceat(self.weights[[f for on in part for f in on]], starts))
        return np.concatenate(rows)

    def decode(self, page: Iterable[list[int]]) -> list[int]:
        """Viterbi: the most probable labels."""
        page = iter(page)
        first = next(page, None)
        if first is None:
            return []
        s, back = self.scores(chain([first], page)).tolist(), []
        own = self.moves if self.unnamed_moves is None or first[0] < _UNNAMED else self.unnamed_moves
        (m00, m01), (m10, m11) = own.tolist()
        v0, v1 = s[0]
        for a, b in s[1:]:
            x0, y0, x1, y1 = v0 + m00, v1 + m10, v0 + m01, v1 + m11
            back.append((y0 > x0, y1 > x1))
            v0, v1 = max(x0, y0) + a, max(x1, y1) + b
        labels = [int(v1 > v0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def _gradient(field: Field, page: list[list[int]], gold: list[int], gw: np.ndarray, gm: np.ndarray) -> float:
    """Adds the gradient of a page's log-likelihood; returns the log-likelihood. Forward-backward in log space."""
    s, n = field.scores(page), len(page)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = s[0]
    for i in range(1, n):
        alpha[i] = np.logaddexp(alpha[i - 1, 0] + field.moves[0], alpha[i - 1, 1] + field.moves[1]) + s[i]
    for i in range(n - 2, -1, -1):
        ahead = s[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(field.moves[:, 0] + ahead[0], field.moves[:, 1] + ahead[1])
    z = np.logaddexp(*alpha[-1])
    expected = np.exp(alpha + beta - z)
    total = 0.0
    for i in range(n):
        d = -expected[i]
        d[gold[i]] += 1
        gw[page[i]] += d
        total += s[i, gold[i]]
        if i:
            total += field.moves[gold[i - 1], gold[i]]
            gm[gold[i - 1], gold[i]] += 1
            gm -= np.exp(alpha[i - 1][:, None] + field.moves + (s[i] + beta[i])[None, :] - z)
    return total - z


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 60, rate: float = 0.5, penalty: float = 0.01) -> Field:
    """Adaptive gradient ascent over all pages."""
    field = Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    seen_w, seen_m = np.full_like(field.weights, 1e-6), np.full_like(field.moves, 1e-6)
    for _ in range(rounds):
        gw, gm = -penalty * len(pages) * field.weights, -penalty * len(pages) * field.moves
        for page, gold in pages:
            if page:
                _gradient(field, page, gold, gw, gm)
        seen_w += gw**2
        seen_m += gm**2
        field.weights += rate * gw / np.sqrt(seen_w)
        field.moves += rate * gm / np.sqrt(seen_m)
    return field


# --- labelled pages ---------------------------------------------------------------------------------------


def training_pages(n: int = 240, seed: int = 11, known_names: float = 1.0) -> list[tuple[str, str]]:
    """(html, main text) of pages composed from layout rules: each part is known to be main text or not.

    Of so many pages the classes and ids say what a part is; on the others they are made-up words.
    """
    rng = random.Random(seed)
    letters = "aeiourstnlmdpc"

    def word() -> str:
        return "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 6, 8, 11])))

    def sentence(k: int | None = None) -> str:
        words = [word() for _ in range(k or rng.choice([2, 4, 8, 12, 18, 30]))]
        if len(words) > 9 and rng.random() < 0.6:
            words[4] += ","
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(k: int | None = None) -> str:
        return " ".join(sentence() for _ in range(k or rng.choice([1, 1, 2, 4, 7, 12])))

    def link(text: str | None = None) -> str:
        return f'<a href="/{word()}">{text or " ".join(word() for _ in range(rng.choice([1, 1, 2, 5])))}</a>'

    def wrap(tag: str, inner: str, names: list[str] | None = None) -> str:
        name = (rng.choice(names) if known else word()) if names and rng.random() < 0.85 else ""
        attribute = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def items(k: int | None = None, inner=link) -> str:
        return "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(k or rng.randint(2, 8))) + "</ul>"

    def names(kind: str) -> list[str]:
        return VOCABULARY[kind].split()

    def boiler(kind: str) -> str:
        if kind == "menu":
            return wrap(rng.choice(["nav", "nav", "div", "ul"]), items(), names("menu"))
        if kind == "head":
            return wrap(rng.choice(["header", "div"]), rng.choice(["", wrap("p", sentence(4)), wrap("h1", sentence(2)), link()]) + rng.choice(["", items(3)]) + wrap("span", sentence(3)), names("head"))
        if kind == "foot":
            return wrap(rng.choice(["footer", "footer", "div"]), rng.choice([f"&copy; {word()} &middot; {sentence()}", wrap("p", f"Copyright {word()}. All rights reserved."), items(4), wrap("p", prose(2))]), names("foot"))
        if kind == "side":
            return wrap(rng.choice(["aside", "div", "section"]), wrap("h3", sentence(2)) + rng.choice([items(), items(3, lambda: link(sentence(6))), wrap("p", prose(2))]), names("side"))
        if kind == "notice":
            return wrap(rng.choice(["div", "section", "dialog"]), wrap(rng.choice(["p", "span"]), rng.choice(["We use cookies. ", "Subscribe to our newsletter. ", ""]) + prose(1)) + "<button>OK</button>", names("notice"))
        if kind == "advert":
            return wrap(rng.choice(["div", "div", "aside", "section"]), rng.choice([sentence(), wrap("p", prose(1)), link(sentence())]), names("advert"))
        if kind == "form":
            return wrap("form", f"<label>{sentence(2)}</label><input name=q>" + rng.choice(["", wrap("p", sentence())]) + "<button>Go</button>", names("form"))
        return wrap(rng.choice(["section", "div", "ol"]), wrap("h3", "Comments") + "".join(wrap(rng.choice(["div", "li", "article"]), wrap("p", prose(rng.choice([1, 2, 4]))) + link("Reply"), ["comment", "reply", "comment-body"]) for _ in range(rng.randint(1, 5))), names("comment")[:10])

    def main_part(texts: list[str]) -> str:
        kind = rng.choices(["p", "open", "h2", "list", "quote", "table", "div", "pre", "odd"], [12, 3, 2, 2, 1, 1, 1, 1, 3])[0]
        if kind == "odd":  # short lines and set phrases are main text too where they stand in the article
            texts.append(rng.choice([f"{word()}. |", word(), f"{word()} | {word()} |", "All rights reserved.", f"Copyright {word()}. Licensed under {word()}.", f"Read more on cookies, {word()}", f"{word()}@{word()}.org", f"Follow us, sign up, share: {sentence()}"]))
            return f"<p>{texts[-1]}</p>"
        if kind == "list":
            found = [sentence() for _ in range(rng.randint(1, 5))]
            texts.extend(found)
            return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>"
        if kind == "table":
            found = [sentence(2) for _ in range(4)]
            texts.extend(found)
            return "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in (found[:2], found[2:])) + "</table>"
        text = sentence(rng.randint(1, 6)) if kind == "h2" else prose()
        texts.append(text)
        shown = text
        if rng.random() < 0.2:
            cut = len(text) // 2
            shown = f"{text[:cut]}<b>{text[cut:]}</b>"
        elif rng.random() < 0.15:
            shown = f'<a href="#">{text[: len(text) // 3]}</a>{text[len(text) // 3 :]}'
        return {"p": f"<p>{shown}</p>", "open": f"<p><b>{text}<br>", "h2": f"<{(h := rng.choice(['h2', 'h3']))}>{shown}</{h}>", "quote": f"<blockquote>{shown}</blockquote>", "div": f"<div>{shown}</div>", "pre": f"<pre>{shown}</pre>"}[kind]

    out, known = [], True
    kinds = ["menu", "head", "side", "notice", "advert", "form"]
    for _ in range(n):
        texts: list[str] = []
        body, known = "", known_names >= 1 or rng.random() < known_names
        if rng.random() < 0.85:
            texts.append(sentence(rng.randint(1, 9)))
            body = f"<h1>{texts[0]}</h1>"
        for _ in range(rng.choice([0, 1, 2, 4, 7, 12])):
            body += main_part(texts)
            if rng.random() < 0.07:
                body += boiler(rng.choice(["advert", "side", "notice"]))
        if rng.random() < 0.1:
            body += boiler("comment")
        style = rng.random()
        if style < 0.5:
            body = wrap("article", body, names("main"))
        elif style < 0.65:
            body = wrap("main", body, names("main"))
        else:
            body = f'<div class="{rng.choice(names("main")[:9]) if known else word()}">{body}</div>'
        if rng.random() < 0.25:
            body = f"<div class=container>{body}</div>"
        before = "".join(boiler(k) for k in rng.sample(kinds, rng.randint(0, 4)))
        after = "".join(boiler(k) for k in rng.sample([*kinds[2:], "comment", "comment", "foot", "foot"], rng.randint(0, 4)))
        page = f"<!DOCTYPE html><html><head><title>{sentence(4)}</title><style>p{{margin:0}}</style></head><body>{before}{body}{after}" + rng.choice(["</body></html>", ""])
        out.append((page, texts))
    return [(page, "\x00".join(texts)) for page, texts in out]


def _labels(found: list[Block], texts: str) -> list[int]:
    """1 for the blocks that are, one after another, the main texts."""
    left, at, out = [_SPACE.sub(" ", t).strip() for t in texts.split("\x00")], 0, []
    for b in found:
        hit = at < len(left) and b.text == left[at]
        out.append(int(hit))
        at += hit
    return out


_fields: dict[tuple, Field] = {}


def default_field(named: int = 240, unnamed: int = 160, seed: int = 11) -> Field:
    """Trained on so many pages with telling names and so many without."""
    key = (named, unnamed, seed)
    if key not in _fields:
        sides: tuple[list, list] = ([], [])
        for page, texts in training_pages(named, seed) + training_pages(unnamed, seed + 1, known_names=0.0):
            found = blocks(page)
            on = [*features(found)]
            sides[bool(on) and on[0][0] >= _UNNAMED].append((on, _labels(found, texts)))
        a, b = (train(pages) for pages in sides)
        _fields[key] = Field(np.concatenate([a.weights[:_UNNAMED], b.weights[_UNNAMED:]]), a.moves, b.moves)
    return _fields[key]


def main_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, label in zip(found, field.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    learned = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, learned) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
