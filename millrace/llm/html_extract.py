"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

A page is cut at block-level tags into leaf blocks. A block's features are the tags and the words of class
and id names it stands under, and the shape of its text (length, share of link text, punctuation, words
that notices are made of). The field labels every block main or other; neighbours inform each other. It is
trained on a small table of labelled pages made here, in many layouts.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.crf import FeatureIds, LinearChainCrf

#: Fixed values, from the HTML standard. Elements whose start or end ends a block:
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is text alone, and no text of the page; and those whose markup is not shown, if they end:
RAW = frozenset("script style textarea xmp iframe noembed noframes title".split())
HIDDEN = frozenset("template noscript".split())
#: Elements of drawings whose text stands by itself:
DRAWN = frozenset("text title desc".split())
#: Start tags that end an open element of these names:
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "thead"), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}

#: Where a tag, comment or declaration may start; a tag without a < inside; a tag's name; a tag with a quote too many.
START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)((?:[^<>"']++|"[^"<]*"|'[^'<]*')*+)>""")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ODD_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)[^<>]*+(>?)")
NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")


def closed_by_slash(attributes: str) -> bool:
    """Whether a start tag ends in a slash of its own, not in the slash of an unquoted value."""
    return attributes.endswith("/") and not UNQUOTED.search(attributes)


def raw_end(html: str, tag: str, at: int) -> int:
    """Where an element whose content is text alone ends: after its end tag, or with the page."""
    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
    return end.end() if end else len(html)


def hidden_end(html: str, tag: str, at: int) -> int:
    """Where a hidden element ends: after the end tag that matches, else after the next one; -1 without any."""
    depth, first = 1, -1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>?", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if m[1] and first < 0:
            first = m.end()
        if depth == 0 or (m[1] and tag == "noscript"):
            return m.end()
    return first


class TagEnds:
    """The > that ends a tag, not counting those in quotes, from any place of a page, in one pass from its end."""

    def __init__(self, html: str):
        found = [(m.start(), m[0]) for m in re.finditer("[>\"']", html)]
        self.places, self.ends = [p for p, _ in found], [-1] * (len(found) + 1)
        following: dict[str, int] = {}
        for k in range(len(found) - 1, -1, -1):
            place, c = found[k]
            self.ends[k] = place if c == ">" else self.ends[following[c] + 1] if c in following else -1
            following[c] = k

    def after(self, at: int) -> int:
        return self.ends[bisect_left(self.places, at)]


def tags_of(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """The page's tags in order: start, end, whether it is an end tag, name, attributes. Comments and declarations have
    no name. The reader may send the place to go on from. No character is passed more than a few times."""
    at, ends = 0, None
    while (start := START.search(html, at)) is not None:
        at = start.start()
        if start[0] == "<!--":
            end = html.find("-->", start.end())
            found = (at, end + 3 if end >= 0 else len(html), False, "", "")
        elif start[0][1] in "!?":
            end = html.find(">", start.end())
            found = (at, end + 1 if end >= 0 else len(html), False, "", "")
        elif (m := PLAIN_TAG.match(html, at)) is not None:
            found = (at, m.end(), m[1] == "/", m[2].lower(), m[3])
        else:
            ends = ends or TagEnds(html)
            name = TAG_NAME.match(html, at)
            end = ends.after(name.end())
            if end >= 0:
                found = (at, end + 1, name[1] == "/", name[2].lower(), html[name.end() : end])
            else:
                m = ODD_TAG.match(html, at)
                if not m[3] and m.end() < len(html):  # a < that starts nothing
                    at += 1
                    continue
                # at the end of the page a tag that is broken off, else one with a quote too many
                found = (at, m.end(), m[1] == "/", m[2].lower() if m[3] else "", "")
        at = (yield found) or found[1]


class Place:
    """An open element: its tag and what it and those around it tell, which inner elements share."""

    __slots__ = ("tag", "kinds", "near", "around")

    def __init__(self, tag: str, words: list[str], outer: "Place | None"):
        own = [KIND_OF[w] for w in words if w in KIND_OF]
        self.tag = tag
        self.kinds = (outer.kinds if outer else frozenset()).union(own) if own or not outer else outer.kinds
        # the innermost element whose name tells something says most
        self.near = own[-1] if own else outer.near if outer else "none"
        self.around = (outer.around if outer else frozenset()) | {tag} if tag in TAGS or not outer else outer.around


class Open:
    """The open block elements. Finding one by name, or the innermost that bounds a search, takes one step."""

    BOUNDS = frozenset("ul ol table dl div td th article section".split())

    def __init__(self):
        self.stack: list[Place] = []
        self.where: dict[str, list[int]] = {}
        self.bounds: list[int] = []

    def push(self, tag: str, words: list[str]) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in self.BOUNDS:
            self.bounds.append(len(self.stack))
        self.stack.append(Place(tag, words, self.stack[-1] if self.stack else None))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.stack.pop().tag
            self.where[tag].pop()
            if tag in self.BOUNDS:
                self.bounds.pop()

    def end(self, tag: str) -> None:
        if self.where.get(tag):
            self.cut(self.where[tag][-1])

    def start(self, tag: str) -> None:
        """A start tag of a block ends an open paragraph, and list items and cells end their like."""
        last = max((self.where[t][-1] for t in ("p", *CLOSES.get(tag, ())) if self.where.get(t)), default=-1)
        if last >= (self.bounds[-1] if self.bounds else 0):
            self.cut(last)


class Block:
    __slots__ = ("text", "place", "link")

    def __init__(self, text: str, place: Place, link: float):
        self.text, self.place, self.link = text, place, link


def leaf_blocks(html: str) -> list[Block]:
    """The page's blocks that have text, in page order, with white space as single spaces."""
    out: list[Block] = []
    opened, outside = Open(), Place("none", [], None)
    parts: list[str] = []
    linked = anchors = drawings = 0
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(text, opened.stack[-1] if opened.stack else outside, linked / max(1, sum(map(len, parts)))))
        parts.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if anchors:
            linked += len(piece)

    at, reader, go_on = 0, tags_of(html), None
    while True:
        try:
            start, end, ending, tag, attributes = reader.send(go_on)
        except StopIteration:
            put(html[at:])
            break
        go_on = None
        if start > at:
            put(html[at:start])
        at = end
        if not tag:
            continue
        if drawings and tag in DRAWN:
            parts.append(" ")
        elif ending:
            if tag == "a":
                anchors = 0
            elif tag == "svg":
                drawings = max(0, drawings - 1)
            elif tag in BLOCK:
                flush()
                opened.end(tag)
        elif tag in RAW:
            # in a drawing a slash ends such an element, elsewhere it says nothing
            if not (drawings and closed_by_slash(attributes)):
                at = go_on = raw_end(html, tag, at)
            if tag == "title":
                flush()
        elif tag in HIDDEN:
            past = -1 if tag in endless else hidden_end(html, tag, at)
            if past < 0:
                endless.add(tag)
            else:
                at = go_on = past
        elif tag == "svg":
            drawings += not closed_by_slash(attributes)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            anchors = 1
        elif tag in BLOCK:
            flush()
            if tag == "hr":
                continue
            opened.start(tag)
            words = []
            for key, *values in NAMES.findall(attributes):
                value = "".join(values)
                if key.lower() in ("hidden", "aria-hidden"):
                    words += [] if value.lower() == "false" else ["hidden"]
                else:
                    words += WORDS.findall(CAMEL.sub(" ", value).lower())
            opened.push(tag, words)
    flush()
    return out


#: Words of class and id names by what they tell, and words that notices and menus are made of.
NAME_WORDS = {
    "main": "article body content entry main page post story text prose copy markdown richtext headline".split(),
    "menu": "breadcrumb breadcrumbs crumb links menu nav navbar navigation pager pagination tabs toc toolbar topbar skip".split(),
    "side": "aside rail related recommended sidebar side trending widget more popular tags".split(),
    "head": "banner branding header masthead logo".split(),
    "foot": "bottom copyright footer foot legal colophon".split(),
    "advert": "ad ads adv advert advertisement adslot promo promotion sponsor sponsored teaser dfp outbrain taboola".split(),
    "notice": "alert banner consent cookie cookies gdpr modal newsletter notice overlay popup privacy subscribe paywall signup toast dialog".split(),
    "talk": "comment comments commentlist discussion disqus reply replies respond response responses reviews feedback".split(),
    "form": "form login search register field input".split(),
    "share": "share sharing social follow byline meta author".split(),
    "hidden": "hidden visually sr".split(),
}
KIND_OF = {w: kind for kind, words in reversed(NAME_WORDS.items()) for w in words}
NOTICE_TEXT = tuple(
    "cookie|subscribe|newsletter|sign up|log in|login|advert|sponsored|all rights reserved|©|copyright|terms of|privacy|skip to|read more|share this|share on|related|leave a comment|leave a reply|posted by|reply".split("|")
)
TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "dl", "figure", "blockquote", "pre", "menu", "select", "dialog", "details", "search")
#: Elements that mean another thing inside the text than outside it.
FURNITURE = ("nav", "header", "footer", "aside", "form", "section", "ul")
#: Characters of text for each word of NOTICE_TEXT up to which a block reads like a notice.
NOTICE_EVERY = 160


def block_features(blocks: list[Block], ids: FeatureIds) -> np.ndarray:
    """Feature ids (blocks, as many as the block with most has) from ancestor tags, names and the whole text."""
    found = []
    share = lambda b: "all" if b.link > 0.8 else "much" if b.link > 0.3 else "some" if b.link > 0 else "none"
    for b, after in zip(blocks, [*blocks[1:], None]):
        own, around = b.place.tag, b.place.around
        kinds = sorted(b.place.kinds)
        tags = [t for t in TAGS if t in around]
        ends = b.text[-1] in ".!?…:;\"”»)"
        link, following = share(b), share(after) if after else "end"
        within = "article" in around or "main" in around
        size = min(6, len(b.text).bit_length() // 2 + (len(b.text) > 1024))
        names = ["bias", f"own={own}", f"link={link}", f"size={size}", f"end={ends}", f"link={link} size={size}", f"within={within}"]
        names += [f"near={b.place.near}"] + [f"kind={x}" for x in kinds] + ["note"] * (NOTICE_EVERY * sum(map(b.text.lower().count, NOTICE_TEXT)) >= len(b.text))
        names += [f"in={t}" for t in tags] + [f"in={t} within={within}" for t in FURNITURE if t in around]
        if link == "none" and size < 4:
            names.append(f"short within={within} next={following}")
        if not kinds and not tags:
            names.append(f"bare own={own} end={ends}")
        found.append([ids(n) for n in names])
    rows = np.zeros((len(found), max(map(len, found), default=1)), np.int64)
    for row, own in zip(rows, found):
        row[: len(own)] = own
    return rows


_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an el in or ut".split()


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize() + rng.choice("...?!")


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """The training table: pages made of labelled blocks (1: main) in ``n`` layouts, with and without
    semantic elements and class names."""
    rng = random.Random(seed)
    out = []
    for page in range(n):
        tags: list[int] = []

        def block(html: str, main: int) -> str:
            tags.append(main)
            return html

        pick = rng.choice
        words = lambda a, b: _sentence(rng, a, b)
        name = lambda kind: pick(NAME_WORDS[kind])
        plain = rng.random() < 0.15  # no class names at all
        cls = lambda kind: "" if plain or rng.random() < 0.1 else f' {pick(("class", "id"))}="{pick(("", "site-", "page_", "js "))}{name(kind)}"'

        def links() -> str:
            return "<ul>" + "".join(block(f'<li><a href="/{k}">{words(1, 3)[:-1]}</a></li>', 0) for k in range(rng.randint(2, 7))) + "</ul>"

        def headed(tag: str, most: int) -> str:
            return block(f"<{tag}>{words(1, most)[:-1]}</{tag}>", 0)

        def wrap(tag: str, kind: str, inner: str) -> str:
            t = pick((tag, tag, "div" if not plain else tag))
            return f"<{t}{cls(kind) if t == tag else f' class={chr(34)}{name(kind)}{chr(34)}'}>{inner}</{t}>"

        def furniture(body: list[str]) -> None:
            """Menus, sidebars, footers, forms and notices inside the text, with and without names."""
            named = lambda kind: "" if rng.random() < 0.45 else cls(kind)
            said = lambda: "".join(block(f"<p>{words(2, 16)}</p>", 0) for _ in range(rng.randint(1, 2)))
            titled = lambda: headed(pick(("h2", "h3", "h4")), 3)
            div = lambda kind, inner: f'<div class="{name(kind)}{pick(("", "-box", " wide"))}">{inner}</div>'
            kinds = {
                "nav": lambda: f"<nav{named('menu')}>{links()}</nav>",
                "aside": lambda: f"<aside{named('side')}>" + (titled() if rng.random() < 0.5 else "") + (links() if rng.random() < 0.5 else said()) + "</aside>",
                "footer": lambda: f"<footer{named('foot')}>" + (said() if rng.random() < 0.6 else block(words(2, 7)[:-1], 0)) + "</footer>",
                "form": lambda: f"<form{named('form')}>" + block(f"<{pick(('label', 'span', 'p'))}>{words(1, 6)}</label></span>", 0) + (block(f"<div><button>{words(1, 2)[:-1]}</button></div>", 0) if rng.random() < 0.5 else "") + "</form>",
                "notice": lambda: div("notice", said() if rng.random() < 0.6 else block(words(3, 12), 0)),
                "advert": lambda: div("advert", said() if rng.random() < 0.6 else block(words(3, 12), 0)),
                "side": lambda: div("side", titled() + links()),
                "share": lambda: block(f'<p class="{name("share")}">{words(1, 4)[:-1]}</p>', 0),
            }
            for kind in rng.sample(sorted(kinds), rng.randint(1, 2)):
                # what stands here was made after the blocks of the text, so their labels follow
                at = rng.randint(0, len(body))
                before = len(tags)
                piece = kinds[kind]()
                new = tags[before:]
                del tags[before:]
                inner = sum(sizes(b) for b in body[:at])
                start = len(tags) - sum(sizes(b) for b in body) + inner
                tags[start:start] = new
                body.insert(at, piece)

        def sizes(html: str) -> int:
            return len(leaf_blocks(html))

        pick = rng.choice
        if rng.random() < 0.12:  # nothing but the text, as a page or as a fragment
            body = [block(f"<h1>{words(2, 9)}</h1>", 1)] * (rng.random() < 0.5) + [block(f"<p>{words(2, 20)[: pick((None, None, -1))]}" if rng.random() < 0.8 else f"<div>{words(2, 30)}</div>", 1) for _ in range(rng.randint(1, 4))]
            tags[:] = [1] * len(body)
            out.append(("<html><body>" + "".join(body) if rng.random() < 0.5 else "".join(body) if rng.random() < 0.8 else re.sub("<[^>]*>", "", body[-1]), tags))
            tags[:] = tags if "<" in out[-1][0] else tags[:1]
            continue
        parts = []
        if rng.random() < 0.3:
            parts.append(block(f'<div class="{name("notice")}">We use cookies. {words(3, 9)} <button>OK</button></div>', 0))
        if rng.random() < 0.5:
            parts.append(wrap("header", "head", block(f"<div>{words(1, 4)[:-1]}</div>", 0) + (block(f"<p>{words(2, 8)}</p>", 0) if rng.random() < 0.4 else "")))
        if rng.random() < 0.85:
            parts.append(wrap("nav", "menu", links()))
        if rng.random() < 0.5:
            parts.append(block(f'<div class="{name("advert")}">{words(3, 14)}</div>', 0))
        if rng.random() < 0.25:
            parts.append(f'<form class="{name("form")}">' + block(f"<label>{words(1, 3)[:-1]}</label>", 0) + "<input></form>")
        body = [block(f"<h1>{words(2, 12)}</h1>", 1)] if rng.random() < 0.9 else []
        if rng.random() < 0.1:
            body.append(block(f'<div class="{name("share")}">Share this: <a href="#">{words(1, 2)[:-1]}</a></div>', 0))
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            text = words(1, 5) if r < 0.2 else " ".join(words(4, 18) for _ in range(rng.randint(1, 6)))
            if rng.random() < 0.2:
                text += f' <a href="/x">{words(1, 3)}</a> {words(2, 6)}'
            if r < 0.72:
                body.append(block(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><b>{text}<br>", 1))
            elif r < 0.8:
                body.append(block(f"<{pick(('h2', 'h3'))}>{words(2, 6)[:-1]}</{pick(('h2', 'h3'))}>", 1))
            elif r < 0.88:
                body.append("<ul>" + "".join(block(f"<li>{words(2, 10)}</li>", 1) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif r < 0.94:
                body.append(f"<{pick(('blockquote', 'pre', 'section'))}>" + block(f"<p>{text}</p>", 1) + f"</{pick(('blockquote', 'pre', 'section'))}>")
            elif r < 0.97:
                body.append(f"<table><tr>" + "".join(block(f"<td>{words(1, 4)[:-1]}</td>", 1) for _ in range(rng.randint(2, 4))) + "</tr></table>")
            elif r < 0.98:
                body.append(f'<div class="{name("talk")}">' + "".join(block(f"<p>{words(3, 20)} {words(3, 20)}</p>", 0) for _ in range(rng.randint(1, 4))) + "</div>")
            else:
                body.append(block(f'<{pick(("div", "aside"))} class="{name("advert")}">{words(3, 12)}</div></aside>', 0))
        if body and rng.random() < 0.1:
            body[0] = f"<header>{body[0]}" + (block(f'<p class="{name("share")}">{words(1, 4)[:-1]}</p>', 0) if len(body) == 1 else "") + "</header>"
        if rng.random() < 0.5:
            furniture(body)
        main = "".join(body)
        where = rng.random()
        if where < 0.55:
            main = f"<article>{main}</article>"
        elif where < 0.75:
            main = f"<main><div{cls('main')}>{main}</div></main>"
        else:
            main = f'<div class="{name("main")}">{main}</div>'
        parts.append(main)
        tail = []
        if rng.random() < 0.2:
            tail.append(lambda: headed(pick(("p", "h2", "h3", "div")), 4) + links())
        if rng.random() < 0.4:
            tail.append(lambda: wrap("aside", "side", block(f"<h3>Related</h3>", 0) + links()))
        if rng.random() < 0.25:
            tail.append(lambda: wrap("aside", "side", block(f"<p>{words(4, 20)}</p>", 0)))
        if rng.random() < 0.4:
            tail.append(lambda: wrap("section", "talk", "".join(block(f'<{"div" if rng.random() < 0.5 else "p"} class="{name("talk")}">{words(3, 25)} {words(3, 20)}</p></div>', 0) for _ in range(rng.randint(1, 5)))))
        if rng.random() < 0.2:
            tail.append(lambda: f'<div class="{name("notice")}">' + block(f"<p>Subscribe to our newsletter. {words(2, 6)}</p>", 0) + "</div>")
        parts += [t() for t in tail]
        if rng.random() < 0.85:
            parts.append(wrap("footer", "foot", block(f"<p>&copy; {words(1, 3)} All rights reserved.</p>" if rng.random() < 0.4 else f"{words(2, 12)}", 0)))
        out.append((f"<html><head><title>{words(2, 5)}</title><script>var a='</p>';</script></head><body>{''.join(parts)}</body></html>", tags))
    return out


@lru_cache(maxsize=1)
def trained() -> tuple[FeatureIds, LinearChainCrf]:
    """Feature ids and the field, trained once per process on the labelled table."""
    ids = FeatureIds()
    rows, tags = [], []
    for html, gold in labelled_pages():
        blocks = leaf_blocks(html)
        if len(blocks) != len(gold):
            raise RuntimeError("a labelled page has other blocks than labels")
        rows.append(block_features(blocks, ids))
        tags.append(np.array(gold))
    ids.open = False
    return ids, LinearChainCrf(len(ids.ids) + 1, 2).fit(rows, tags)


def main_texts(pages: list[str | None], model: tuple[FeatureIds, LinearChainCrf]) -> list[str]:
    ids, crf = model
    blocks = [leaf_blocks(p or "") for p in pages]
    tags = crf.decode([block_features(b, ids) for b in blocks])
    return ["\n".join(b.text for b, t in zip(own, labels) if t) for own, labels in zip(blocks, tags)]


def extract_main_text(pages: DataFrame, *, html: str = "html", text: str = "text", batch: int = 128) -> DataFrame:
    """The columns of ``pages`` without ``html``, and ``text``: the main blocks joined by newlines.

    Character references are decoded, white space (as Python's ``str.split`` sees it) inside a block is one
    space. Formulas, drawings and what stands in for objects, audio, video and canvas are markup like any other;
    template and noscript are not shown, nor is the content of script, style, textarea, iframe and the page's title.
    Edge cases: null, empty and text-free pages give ``""``; pages that break off in a tag, a comment or an element
    of plain text (such as script) lose only that; a template or noscript without its end tag loses nothing;
    repeated rows are read each; blocks are never capped or dropped for their length; an empty table gives an
    empty table; a column named like the new one is replaced.
    """
    kept = [c for c in pages.columns if c not in (html, text)]
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = main_texts(part.column(len(kept)).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, text])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField(text, T.StringType())])
    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`")).mapInArrow(run, schema)
