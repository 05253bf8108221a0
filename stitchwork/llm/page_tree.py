"""Web pages as trees of blocks, and the labelled pages that a page model learns from."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

from stitchwork.llm.common import ship

# Elements of HTML by the part they play.
KINDS = {
    "text": (), "page": ("body", "html"), "main": ("article", "main"), "nav": ("nav", "menu", "dir"), "header": ("header", "hgroup"),
    "footer": ("footer", "address"), "aside": ("aside", "dialog", "search"), "form": ("form", "fieldset", "legend", "label"),
    "section": ("section", "details", "summary"), "div": ("div", "center"), "p": ("p",), "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "list": ("ul", "ol", "dl"), "item": ("li", "dt", "dd"), "table": ("table", "tbody", "thead", "tfoot", "tr"),
    "cell": ("td", "th", "caption"), "quote": ("blockquote", "pre"), "figure": ("figure", "figcaption"),
}
#: Elements whose content is no text of the page; the first ones hold no markup either.
RAW = ("script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp")
HIDDEN = ("svg", "button", "select", "object", "template", "canvas", "audio", "video", "datalist")
#: Words of class, id and role attributes by what they hint at.
HINTS = {
    "content": "content article post entry story body main text prose blog page news",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination tabs topbar links toc",
    "header": "header masthead banner logo branding top hero",
    "footer": "footer copyright legal bottom colophon contentinfo imprint",
    "sidebar": "sidebar side widget widgets aside related recommended recommendations trending popular more complementary",
    "advert": "ad ads adv advert advertisement adverts sponsor sponsored promo promotion promoted adsense",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe subscription signup warning message dialog paywall",
    "comment": "comment comments reply replies respond disqus discussion reader responses commentlist",
    "share": "share sharing social meta tags tag byline author toolbar tools buttons rating print",
    "form": "form search login register contact feedback",
}

KIND_NAMES = tuple(KINDS)
HINT_NAMES = tuple(HINTS)
_KIND_OF = {tag: at for at, tags in enumerate(KINDS.values()) for tag in tags}
_HINT_OF = {word: at for at, words in enumerate(HINTS.values()) for word in words.split()}
#: A start tag of the key ends an open element of the values, unless one of the last ones lies between.
_ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
         "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}
#: Elements nested deeper than this are siblings there.
MOST_DEPTH = 256

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")
_ENDINGS = re.compile(r"[.!?;:…。！？](?=\s|$)|[。！？]")


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children, the root is node 0 and its own parent."""

    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [_KIND_OF["body"]])
    hints: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    endings: list[int] = field(default_factory=lambda: [0])
    rights: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, kind: int, hints: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.hints.append(hints)
        for counts in (self.chars, self.linked, self.endings, self.rights):
            counts.append(0)
        return len(self.parent) - 1


@lru_cache(maxsize=65_536)
def hints_of(attributes: str) -> int:
    """A bit per group of hints that the attributes' class, id and role words belong to."""
    found = 0
    for match in _NAMES.finditer(attributes[:4_096]):
        for word in re.findall("[a-z]+", _CAMEL.sub(r"\1 \2", next((x for x in match.groups() if x), "")).lower()):
            if word in _HINT_OF:
                found |= 1 << _HINT_OF[word]
    return found


class _Builder:
    def __init__(self) -> None:
        self.tree = Tree()
        self.open: list[tuple[str, int]] = [("body", 0)]
        self.counts: dict[str, int] = {}
        self.beyond: dict[str, int] = {}
        self.hidden: dict[str, int] = {}
        self.run: list[str] = []
        self.linked = 0
        self.link_depth = 0

    def text(self, piece: str) -> None:
        if piece and not self.hidden:
            piece = unescape(piece) if "&" in piece else piece
            self.run.append(piece)
            if self.link_depth:
                self.linked += len(piece.strip())

    def flush(self) -> None:
        """What was gathered since the last border of a block is a block."""
        text = " ".join("".join(self.run).split())
        if text:
            tree = self.tree
            node = tree.add(self.open[-1][1], 0)
            tree.chars[node], tree.linked[node] = len(text), min(self.linked, len(text))
            tree.endings[node] = len(_ENDINGS.findall(text))
            tree.rights[node] = int("©" in text[:200] or "all rights" in text[:400].lower())
            tree.blocks.append((node, text))
        self.run, self.linked = [], 0

    def leave(self, names: tuple[str, ...], unless: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of these names and all inside it."""
        if not any(self.counts.get(x) for x in names):
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name in names:
                self.flush()
                for closed, _ in self.open[at:]:
                    self.counts[closed] -= 1
                del self.open[at:]
                if self.link_depth > len(self.open):
                    self.link_depth = 0
                return
            if name in unless:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in HIDDEN:
            if not attributes.endswith("/"):
                self.hidden[name] = self.hidden.get(name, 0) + 1
        elif self.hidden:
            return
        elif name == "a":
            self.link_depth = len(self.open)
        elif name in ("br", "wbr", "img", "input"):
            self.run.append("" if name == "wbr" else " ")
        elif name == "hr":
            self.leave(("p",))
            self.flush()
        elif name in ("body", "html"):
            self.tree.hints[0] |= hints_of(attributes) & ~1
        elif name in _KIND_OF:
            self.flush()
            self.leave(("p",))
            if name in _ENDS:
                self.leave(*_ENDS[name])
            if len(self.open) >= MOST_DEPTH:
                self.beyond[name] = self.beyond.get(name, 0) + 1
                return
            self.open.append((name, self.tree.add(self.open[-1][1], _KIND_OF[name], hints_of(attributes))))
            self.counts[name] = self.counts.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name in HIDDEN:
            if self.hidden.get(name, 0) > 1:
                self.hidden[name] -= 1
            else:
                self.hidden.pop(name, None)
        elif self.hidden:
            return
        elif name == "a":
            self.link_depth = 0
        elif name in _KIND_OF:
            self.flush()
            if self.beyond.get(name):
                self.beyond[name] -= 1
            else:
                self.leave((name,))


def parse(html: str) -> Tree:
    """The blocks of a page. Malformed markup never fails; the work grows in proportion to the page.

    Elements that end implicitly (paragraphs, items, cells) do so. A comment,
    tag or script that never ends is markup to the page's end; a start tag of
    ``HIDDEN`` elements without an end tag hides nothing.
    """
    builder, at, last = _Builder(), 0, html.rfind(">")
    lowered: list[str] = []
    unclosed: set[str] = set()

    def end_of(name: str) -> int:
        """Where the element's end tag begins, from here on."""
        if name in unclosed:
            return -1
        if not lowered:
            lowered.append(re.sub("[A-Z]+", lambda m: m[0].lower(), html))
        found = lowered[0].find(f"</{name}", at)
        if found < 0:
            unclosed.add(name)
        return found

    while True:
        begin = html.find("<", at)
        if begin < 0 or begin > last:
            rest = html[at:] if begin < 0 else html[at:begin]
            tail = "" if begin < 0 else html[begin:]
            builder.text(rest)
            if tail and not re.match(r"<[/!?a-zA-Z]", tail):
                cut = re.search(r"<[/!?a-zA-Z]", tail)
                builder.text(tail[:cut.start()] if cut else tail)
            break
        following = html[begin + 1:begin + 2]
        if not (following.isascii() and (following.isalpha() or following in "/!?")):
            builder.text(html[at:begin + 1])
            at = begin + 1
            continue
        builder.text(html[at:begin])
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 2)
            if end < 0:
                break
            at = end + 3
            continue
        tag = _TAG.match(html, begin)
        if tag is None:  # an odd or broken tag
            at = html.find(">", begin) + 1
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            builder.end(name)
        elif name in RAW:
            end = end_of(name)
            if end < 0:
                break
            at = html.find(">", end) + 1 or len(html)
        elif name not in HIDDEN or name in builder.hidden or end_of(name) >= 0:
            builder.start(name, tag[3])
    builder.flush()
    return builder.tree


# ---- labelled pages ----------------------------------------------------------------------------

_SYLLABLES = "an ber co den el fir gam hol is jun kel lo mar nor os pel qui rot sal tur um ven wes yor zin".split()


class _Draw:
    """A fixed sequence of draws."""

    def __init__(self, seed: int) -> None:
        self.state = seed * 7_919 + 104_729

    def below(self, n: int) -> int:
        self.state = (self.state * 1_103_515_245 + 12_345) % 2**31
        return self.state // 2**8 % n

    def one(self, options):
        return options[self.below(len(options))]

    def words(self, n: int) -> str:
        return " ".join("".join(self.one(_SYLLABLES) for _ in range(1 + self.below(3))) for _ in range(n))

    def prose(self, n: int) -> str:
        out = []
        while n > 0:
            size = min(n, 3 + self.below(18))
            out.append(self.words(size).capitalize() + self.one((".", ".", ".", ";", "!", "?")))
            n -= size
        return " ".join(out)

    def odd(self, n: int) -> str:
        """Words with signs, in columns, or over and over."""
        sign = self.one(("%%%", "***", "$$$", " |", ",", " 12", "!!", ""))
        words = self.words(n).split()
        return " ".join(f"{x}{sign}" for x in (words[:3] * (1 + n // 3) if self.below(3) == 0 else words))


def _furniture(d: _Draw, part: str) -> str:
    """One of the parts around an article."""
    links = [f'<a href="/{d.words(1)}">{d.words(1 + d.below(4))}</a>' for _ in range(2 + d.below(9))]
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
    note = d.prose(3 + d.below(45))
    named = lambda words, inner, tags=("div",): (lambda t: f'<{t} {d.one(("class", "id"))}="{d.one(words)}">{inner}</{t}>')(d.one(tags))
    if part == "nav":
        return d.one((f"<nav>{listed}</nav>", f'<div role="navigation">{listed}</div>', " | ".join(links),
                      named(("menu", "main-menu", "navbar", "breadcrumbs", "topNav", "pagination"), d.one((listed, " ".join(links)))), listed))
    if part == "header":
        inner = d.one((f"<h2>{d.words(2)}</h2><p>{d.prose(6)}</p>", f"<a href='/'>{d.words(2)}</a> {d.words(4)}", f"<p>{note}</p>"))
        return d.one((f"<header>{inner}</header>", named(("header", "masthead", "site-header", "top-banner"), inner)))
    if part == "footer":
        inner = d.one((f"&copy; {note}", f"<p>&copy; {d.words(3)} {note}</p>", f"<p>{note}</p>", f"{note} {' '.join(links)}"))
        return d.one((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", named(("footer", "site-footer", "copyright", "legal"), inner)))
    if part == "aside":
        inner = d.one((f"<h3>{d.words(2)}</h3>{listed}", f"<h4>{d.words(2)}</h4><p>{note}</p>", f"<p>{note}</p><p>{d.prose(9)}</p>"))
        return d.one((f"<aside>{inner}</aside>", named(("sidebar", "widget", "related-posts", "side-bar", "recommended"), inner, ("div", "section"))))
    if part == "notice":
        inner = d.one((note, f"<p>{note}</p><button>OK</button>", f"<p>{note}</p>"))
        return named(("cookie-notice", "cookie-banner", "consent", "notice", "alert", "newsletter", "popup", "subscribe-box", "gdpr"), inner,
                     ("div", "div", "section"))
    if part == "ad":
        return named(("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo"), d.one((note, note, f"<p>{note}</p>")), ("div", "div", "section"))
    if part == "form":
        inner = f"<label>{d.words(2)}</label><input name=q>" + d.one(("", f"<p>{d.prose(5 + d.below(20))}</p>", f"<div>{d.words(5)}</div>"))
        return d.one((f"<form action='/s'>{inner}</form>", named(("search-form", "login", "contact"), f"<form>{inner}</form>")))
    if part == "share":
        return named(("share", "social", "tags", "post-meta", "byline", "author"), d.one((" ".join(links), d.words(4), listed)), ("div", "p", "ul"))
    shape = d.below(4)
    own = [d.prose(2 + d.below(70)) for _ in range(1 + d.below(5))]
    if shape == 0:
        inner = "".join(f'<div class="comment"><p class="author">{d.words(2)}</p><p>{x}</p></div>' for x in own)
    elif shape == 1:
        inner = "<ol>" + "".join(f"<li><b>{d.words(1)}</b><p>{x}</p>" for x in own) + "</ol>"
    elif shape == 2:
        inner = "".join(f'<article class="comment"><p>{x}</p></article>' for x in own)
    else:
        inner = "".join(f"<p>{x}</p>" for x in own)
    return named(("comments", "comment-list", "reader-comments", "replies", "discussion"), f"<h3>{d.words(2)}</h3>{inner}", ("div", "section", "section"))


def _article(d: _Draw) -> tuple[list[str], list[str]]:
    """Pieces of markup and the blocks of text in them."""
    markup, blocks = [], []

    def put(shape: str, *texts: str) -> None:
        markup.append(shape.format(*texts))
        blocks.extend(" ".join(x.split()) for x in texts)

    if d.below(4):
        put(d.one(("<h1>{}</h1>", "<h2 class='title'>{}</h2>")), d.words(2 + d.below(9)))
    for _ in range(1 + d.below(9)):
        shape, n = d.below(16), d.one((1, 2, 4, 12, 30, 60, 120))
        if shape == 0:
            put("<h2>{}</h2>", d.words(1 + d.below(5)))
        elif shape == 1:
            put("<ul><li>{}</li><li>{}<li>{}</ul>", *(d.prose(2 + d.below(12)) for _ in range(3)))
        elif shape == 2:
            put("<blockquote><p>{}</p></blockquote>", d.prose(n))
        elif shape == 3:
            put("<table><tr><td>{}</td><td>{}</td></tr></table>", d.words(2), d.words(3))
        elif shape == 4:
            put("<p>{}", d.words(n))
        elif shape == 5:
            a, b, c = d.prose(n), d.words(2), d.prose(4)
            markup.append(f"<p>{a} <a href='/x'>{b}</a> {c}</p>")
            blocks.append(f"{a} {b} {c}")
        elif shape == 6:
            put("<pre>{}</pre>", d.words(n))
        elif shape == 7:
            put("<div>{}</div>", d.prose(n))
        elif shape == 8:
            put("<p><b>{}<br>", d.one((d.prose, d.odd))(n))
        elif shape < 12:
            put("<p>{}</p>", d.odd(n))
        else:
            put("<p>{}</p>", d.prose(n))
    return markup, blocks


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, str]]:
    """n pages with the main text of each: articles in several kinds of containers, with parts around and inside them."""
    out = []
    for k in range(n):
        d = _Draw(seed * 100_003 + k)
        markup, blocks = _article(d)
        for _ in range(d.one((0, 0, 0, 1, 2))):  # parts inside the article
            markup.insert(1 + d.below(len(markup)), _furniture(d, d.one(("ad", "ad", "notice", "aside", "share", "nav"))))
        inner = "".join(markup)
        shape = d.one(("<article>{}</article>",) * 6 + ("<main>{}</main>", "<main><article>{}</article></main>", "<main><div class='row'>{}</div></main>",
                       "<div id='content'>{}</div>", "<div class='post'><div class='entry-content'>{}</div></div>", "<div class='articleBody'>{}</div>",
                       "<div class='wrapper'><div class='story'>{}</div></div>", "<section class='page-text'>{}</section>", "<div role='main'>{}</div>",
                       "<table><tr><td>{}</td></tr></table>", "<div><div>{}</div></div>", "{}", "<section>{}</section>"))
        after = _furniture(d, "comment") if d.below(3) == 0 else ""
        if after and d.below(2) and shape.endswith(">"):
            inner, after = inner + after, ""
        before = [_furniture(d, x) for x in ("header", "nav", "notice", "ad", "form") if d.below(5) < 2]
        behind = [_furniture(d, x) for x in ("share", "aside", "ad", "form", "notice", "footer", "footer") if d.below(5) < 2]
        body = "".join(before) + shape.replace("{}", inner) + after + "".join(behind)
        if d.below(4) == 0:
            body = f"<div class='{d.one(('wrapper', 'container', 'page', 'site'))}'>{body}</div>"
        out.append((f"<html><head><title>{d.words(4)}</title></head><body>{body}</body></html>", "\n\n".join(blocks)))
    return out


ship(__name__)
