"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of open tags (and their
classes) above it. Per root-to-leaf path the text length and the punctuation of its blocks are
added up and divided by the number of blocks; both ratios are damped by the
share of the path's text inside links and taken as logarithms, so that one very
long paragraph does not drown the rest. Along the blocks in page order the
ratios are smoothed with Gaussian weights, times the share of their open
elements that two blocks have in common, so a heading takes part in the text
below it and a box beside the text does not. The smoothed ratios are fused by
multiplication; a path has the best score of its blocks, damped by its links
again. Paths that reach ``LEAST`` of the mean score (by text length) are
content, and every block on them is in the result.

Names play three small parts. Scripts, styles, form controls and the like are no
text. Containers that say by class or id that they hold reader comments are left
out before the ratios are made, since a well-written comment has the ratios of
an article, and so are forms, unless a form holds an ``article`` or ``main`` or
most of the page. What stands around a text by its own account has the scores of
its paths damped by ``DAMPED``: elements that HTML has for it (``nav``, ``aside``,
``footer``, a header outside the article) and containers with such a class or id,
unless they hold an ``article`` or ``main``. The threshold decides on them as on all
others, so a page that is all in a container with such a class is read like any
other, and menus without a name go by their ratios. Where no path has a ratio at all, as
all text is links, the blocks inside an ``article`` or ``main`` are the text.

Defined results: null, empty and markup-only pages give the empty text; markup
that is cut off ends with the page; unclosed elements end with their parent;
pages of any length and depth are read whole; repeated rows get equal results;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfloom.llm.common import add_columns, renamed

_PIECE = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[/a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")
_WORDS = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]+")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
NO_TEXT = frozenset(
    "button select menu dialog svg math object canvas audio video script style textarea title noscript template iframe head".split()
)
AROUND = frozenset("nav header footer aside".split())
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
AROUND_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs consent cookie cookies copyright footer form header login masthead menu "
    "nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)
#: What holds other blocks; a paragraph, a heading or a cell is not judged by its class.
CONTAINERS = frozenset("div section aside ul ol dl table fieldset figure details center header footer nav".split())
ROLES = {"navigation": "around", "banner": "around", "contentinfo": "around", "complementary": "around", "search": "form", "dialog": "out", "alert": "out", "form": "form", "menu": "around", "menubar": "around"}
#: Words that turn the next one round: ``no-comments`` is an article without any.
TURNS = frozenset("has with no without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes first, up to its container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: A path is content from this share of the page's mean score on.
LEAST = 0.1
#: What is left of the score of a path around the text.
DAMPED = 0.01
#: Gaussian weights of the neighbours on either side.
KERNEL = tuple((k, math.exp(-k * k / 2.0)) for k in (-2, -1, 1, 2))
#: Least affinity of blocks that are children of one element.
SIBLINGS = 0.5


class Element:
    """An open element. ``owner``: what its text counts for, the nearest block
    above, or itself if it alone is flagged. ``path`` numbers the steps of
    the open tags, ``depth`` counts the blocks below the body, ``form`` is the form
    that it is in."""

    __slots__ = ("article", "beside", "depth", "flag", "form", "link", "name", "out", "owner", "parent", "path", "tagged")

    def __init__(self, name: str, parent: Element | None, flag: str, path: int):
        self.name, self.parent, self.flag, self.path = name, parent, flag, path
        above = parent is not None
        self.link = name == "a" or (above and parent.link)
        self.article = name in ("article", "main") or (above and parent.article)
        self.form = self if flag == "form" else (parent.form if above else None)
        inline = name in INLINE
        self.depth = parent.depth + (not inline and name != "body") if above else 0
        self.owner = parent.owner if above and inline and not flag else self
        self.out = self.beside = self.tagged = None

    def _above(self, kept: str, flags: tuple[str, ...]) -> bool:
        """Whether this element or one above it has one of the flags; every element on the way remembers it as ``kept``."""
        chain, e = [], self
        while e is not None and getattr(e, kept) is None:
            chain.append(e)
            e = e.parent
        found = e is not None and getattr(e, kept)
        for e in reversed(chain):
            found = found or e.flag in flags
            setattr(e, kept, found)
        return found

    def around(self) -> int:
        """Whether it stands around the text: 2 by an element's tag or role, 1 by a word, 0 not."""
        return 2 if self._above("tagged", ("around",)) else int(self._above("beside", ("word",)))

    def boiler(self) -> bool:
        """Whether it is no text."""
        return self._above("out", ("out", "form", "comments"))


def _judged(name: str, attrs: str, article: bool) -> tuple[str, str]:
    """What an element is besides text: ``out``, a ``form``, ``comments``, ``around`` the text by its tag or a ``word``, or
    nothing; and its step of the path: name and class, numbers left out."""
    label = name
    if name in NO_TEXT:
        return "out", label
    flag = ""
    if name == "form":
        flag = "form"
    elif name in AROUND and not (name == "header" and article):  # an article's own header holds its title
        flag = "around"
    if name in ("html", "body", "article", "main") or not attrs.strip():
        return flag, label
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "class" and name not in INLINE:
            label = f"{name}.{_NUMBER.sub('', value)}"
        if key in ("class", "id") and name not in INLINE:
            for group in value.split():
                found = _WORDS.findall(group)
                words = {w for k, w in enumerate(found) if not (k and found[k - 1] in TURNS)} if name in CONTAINERS else set()
                if words & COMMENTS:
                    flag = "comments"
                elif words & AROUND_WORDS - ({"header"} if article else set()):
                    flag = flag or "word"
        if key == "role":
            flag = ROLES.get(value.strip(), flag)
        if key == "hidden" or key == "aria-hidden" and value == "true":
            flag = "out"
    return flag, label


def _nodes(page: str) -> list[tuple[Element, int, str, bool]]:
    """(owner, block number, text, inside a link) in page order."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("html", None, "", 0)
    stack, opened = [root], {"html": 1}
    out: list[tuple[Element, int, str, bool]] = []
    block, at, raw = 0, 0, None

    def text(piece: str) -> None:
        if piece:
            top = stack[-1]
            out.append((top.owner, block, html.unescape(piece), top.link))

    def cut(k: int) -> None:
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}[\s/>]", re.I).search(page, at)
            if end is None:
                break
            at, raw = end.start(), None
        m = _PIECE.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            out.append((stack[-1].owner, block, " ", False))
            continue
        if name not in INLINE:
            block += 1
        if m[1]:
            if name == "p" or name in INLINE:  # never reach out of the enclosing block
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        cut(k)
                        break
                    if stack[k].name not in INLINE and stack[k].name != "p":
                        break
            elif opened.get(name, 0) > (name == "html"):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                cut(k)
            continue
        if name in ("html", "body") and opened.get(name, 0):
            continue
        if name not in INLINE:  # a block ends an open paragraph and what is open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    cut(k)
                    break
                if stack[k].name not in INLINE:
                    break
        if name in CLOSES and any(opened.get(x) for x in CLOSES[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in HOLDS[name]:
                    break
                if stack[k].name in CLOSES[name]:
                    cut(k)
                    break
        attrs = m[3] or ""
        if name in VOID or attrs.endswith("/") and name not in RAW:
            continue
        top = stack[-1]
        flag, label = _judged(name, attrs, top.article)
        stack.append(Element(name, top, flag, paths.setdefault((top.path, label), len(paths) + 1)))
        opened[name] = opened.get(name, 0) + 1
        if name in ("article", "main"):
            while top is not None:
                top.flag = "" if top.flag in ("form", "comments", "word") else top.flag
                top = top.parent
        if name in RAW:
            raw = name
    return out


def affinity(a: Element, b: Element) -> float:
    """The share of their open blocks that two elements have in common; at
    least ``SIBLINGS`` for children of one element, and 1 for one element."""
    if a is b:
        return 1.0
    if a.parent is b.parent:
        least = SIBLINGS
    else:
        least = 0.0
    deep = max(a.depth, b.depth)
    chain = []
    while a is not b:
        if a.depth > b.depth or (a.depth == b.depth and b.parent is None):
            a = a.parent
        elif b.depth > a.depth or a.parent is None:
            b = b.parent
        else:
            chain.append(a)
            a, b = a.parent, b.parent
    return max(least, a.depth / deep if deep else 0.0)


class Block:
    """The text of one block that is no boilerplate."""

    __slots__ = ("around", "linked", "owner", "parts", "signs", "size")

    def __init__(self, owner: Element, around: int):
        self.around = around
        self.owner, self.parts, self.size, self.linked, self.signs = owner, [], 0, 0, 0

    def add(self, text: str, link: bool) -> None:
        self.parts.append(text)
        if not text.isspace():
            self.size += len(text)
            self.linked += len(text) if link else 0
            self.signs += len(_PUNCT.findall(text))


def _lift(nodes: list[tuple[Element, int, str, bool]]) -> None:
    """A form that holds more than half of the page's plain text is the page."""
    forms: dict[int, tuple[Element, int]] = {}
    total = 0
    for owner, _, text, link in nodes:
        size = 0 if link or text.isspace() else len(text)
        total += size
        form = owner.form
        while form is not None:
            forms[id(form)] = form, forms.get(id(form), (form, 0))[1] + size
            form = form.parent.form if form.parent is not None else None
    for form, size in forms.values():
        if 2 * size > total:
            form.flag = ""


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out: list[Block] = []
    last = None
    nodes = _nodes(page)
    _lift(nodes)
    for owner, number, text, link in nodes:
        if owner.boiler():
            continue
        if number != last:
            out.append(Block(owner, owner.around()))
            last = number
        out[-1].add(text, link)
    return [b for b in out if b.size]


def smoothed(values: list[float], blocks: list[Block]) -> list[float]:
    """Every block's value with those of its neighbours, by distance and
    affinity."""
    out = []
    for i, value in enumerate(values):
        total, weight = value, 1.0
        for step, w in KERNEL:
            k = i + step
            if 0 <= k < len(values):
                w *= affinity(blocks[i].owner, blocks[k].owner)
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def path_scores(blocks: list[Block]) -> tuple[dict[int, float], float]:
    """Fused score of every tag path, and the threshold."""
    length: dict[int, int] = {}
    count: dict[int, int] = {}
    signs: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in blocks:
        p = b.owner.path
        length[p] = length.get(p, 0) + b.size
        count[p] = count.get(p, 0) + 1
        signs[p] = signs.get(p, 0) + b.signs
        # a title that links to its own page is a title
        linked[p] = linked.get(p, 0) + (0 if b.owner.name in HEADINGS else b.linked)
    plain = {p: 1.0 - linked[p] / length[p] for p in length}
    by_text = smoothed([math.log1p(length[b.owner.path] / count[b.owner.path] * plain[b.owner.path]) for b in blocks], blocks)
    by_sign = smoothed([math.log1p(signs[b.owner.path] / count[b.owner.path] * plain[b.owner.path]) for b in blocks], blocks)
    score = dict.fromkeys(length, 0.0)
    for b, t, s in zip(blocks, by_text, by_sign, strict=True):
        p = b.owner.path
        score[p] = max(score[p], t * (1.0 + s) * plain[p] * (DAMPED if b.around else 1.0))
    # the mean of what does not stand around the text; if that has no score, of what does so by a word alone
    inner: set[int] = set()
    for level in (0, 1):
        inner = inner or {b.owner.path for b in blocks if b.around == level and score[b.owner.path]}
    if not inner:
        return score, math.inf
    return score, LEAST * sum(score[p] * length[p] for p in inner) / sum(length[p] for p in inner)


def extract(page: str | None) -> str:
    """The main text: the blocks on content paths, joined by line feeds."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    score, limit = path_scores(blocks)
    if not any(score.values()):
        blocks, score, limit = [b for b in blocks if b.owner.article], dict.fromkeys(score, 1.0), 0.0
    lines = (_SPACE.sub(" ", "".join(b.parts)).strip() for b in blocks if score[b.owner.path] >= limit and score[b.owner.path] > 0)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def factory():
        def one(page):
            text = extract(page)
            return text, len(text)

        return one

    return add_columns(pages, [html_col], out, factory)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    rows = renamed(pages, page_id="page_id", url="url", html="html")
    return main_text(rows).select("page_id", "url", "text", "n_chars")
