"""A page's markup as tokens and runs of text, each in its place among the elements."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import xxhash

# How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements whose content is no markup: it ends at their end tag.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
FOREIGN = frozenset({"svg", "math"})
#: A start tag of these ends an open element of the second set, looked for up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: No end tag reaches through these.
PARAGRAPH = frozenset({"p"})
SCOPES = frozenset("html table td th caption template object button".split())

#: Elements that hold no main text, wherever they stand.
NO_TEXT = frozenset(
    "head title script style noscript template nav aside footer form menu dialog button select"
    " option textarea iframe noembed noframes xmp object embed svg canvas audio video label"
    " fieldset datalist".split()
)
NO_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu"
    " menubar toolbar status".split()
)
#: Parts of class names and ids of what surrounds a main text.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo"
    " promotion cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay"
    " newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb"
    " breadcrumbs sidebar sidebars widget widgets footer masthead toolbar pagination pager share"
    " sharing social related recommended recommendations comment comments commentlist disqus"
    " respond replies hidden copyright topbar".split()
)
#: The same, but part of an article if they stand in one, or are named after one.
AROUND_PAGE = frozenset({"header"})
OF_ARTICLE = frozenset("article entry post story content".split())
#: First parts of names of articles that are not the page's own.
NOT_THE_ARTICLE = frozenset("comment comments ad ads advert advertisement sponsored promo related".split())
#: Names of main texts, and ends of names that only lay things out.
MAIN_WORDS = frozenset("article content main post entry story body page".split())
LAYOUT = frozenset("wrap wrapper container layout inner".split())
FREE_OF = frozenset({"free"})
STATE = frozenset("has with no without".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)"
    r"(?P<attrs>(?:[^\"'>]++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+')*+)>"
    r"|<[!?/A-Za-z][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(
    r"(?<![^\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)"
    r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|\Z))",
    re.I,
)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

#: How an element stands to the main text.
OUT, PLAIN, MAIN, ARTICLE = -1, 0, 1, 2


def _around(name: str, within: int) -> bool:
    """Whether a class name or id is that of something around a main text."""
    parts = [p.lower() for p in re.split(r"[^A-Za-z]+", name) if p]
    words = set(parts) | {w.lower() for w in _CAMEL.findall(name)}
    of_page = within < MAIN and words & AROUND_PAGE and not words & OF_ARTICLE
    if not (words & AROUND or of_page) or parts[0] in STATE or parts[-1] in FREE_OF:
        return False
    return not (parts[-1] in LAYOUT and words & MAIN_WORDS)


def _standing(name: str, attrs: dict[str, str], within: int) -> int:
    """How an element stands to the main text, given how the one around it does."""
    role = attrs.get("role", "").lower()
    main = ARTICLE if name == "article" else MAIN if name == "main" else PLAIN
    if role in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower():
        main = max(main, MAIN if role == "main" else ARTICLE)
    if name in ("html", "body"):
        return within
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    if main == ARTICLE:
        around = any(re.split(r"[^a-z]+", n.lower())[0] in NOT_THE_ARTICLE for n in names)
    else:
        around = name != "main" and any(_around(n, within) for n in names)
    style = attrs.get("style", "").replace(" ", "").lower()
    if (
        name in NO_TEXT
        or role in NO_TEXT_ROLES
        or (name == "header" and within < MAIN)
        or "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or "display:none" in style
        or "visibility:hidden" in style
        or around
    ):
        return OUT
    return max(within, main)


class Run(NamedTuple):
    """Text between two tags: its token, block, standing, and whether it is in a link."""

    token: int
    block: int
    text: str
    standing: int
    linked: bool


@dataclass
class Page:
    """Tokens are 64-bit keys of tags and texts together with their path of elements."""

    tokens: list[int] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)


_NONE: dict[str, str] = {}


@lru_cache(maxsize=10_000)
def _attributes(given: str) -> dict[str, str]:
    """The attributes that tell how an element stands."""
    return {
        m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "")
        for m in _ATTR.finditer(given)
    }


def _key(parent: int, kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest((kind + value).encode("utf-8", "replace"), parent)


_tag_key = lru_cache(maxsize=100_000)(_key)


@lru_cache(maxsize=100_000)
def _element(name: str, given: str, within: int, path: int, form: bool) -> tuple:
    """An open element: name, standing, path, and whether a form is what puts it out."""
    attrs = _attributes(given) if given else _NONE
    if name not in INLINE:
        sign = f"{name} {attrs.get('class', '')} {attrs.get('id', '')}"
        path = _key(path, "<", _DIGITS.sub("0", sign))
    if within == OUT and form and name in ("article", "main"):
        within = PLAIN  # a form around the whole page
    standing = OUT if within == OUT else _standing(name, attrs, within)
    return name, standing, path, standing == OUT and (form if within == OUT else name == "form")


def parse(html: str | None) -> Page:
    """The tokens and runs of text of a page; none for null.

    Elements that are not closed, or closed out of turn, end where HTML ends them, with
    the exception that formatting elements are not opened again.
    """
    page = Page()
    html = html or ""
    # Open elements: name, standing, path, whether a form is what puts it out.
    stack: list[tuple[str, int, int, bool]] = [("", PLAIN, 0, False)]
    is_open: Counter[str] = Counter()  # what is not open need not be looked for
    block = 0
    at, n = 0, len(html)

    def pop(k: int) -> None:
        for name, *_ in stack[k:]:
            is_open[name] -= 1
        del stack[k:]

    def close(names: Collection[str], stops: Collection[str]) -> None:
        if not any(is_open[name] for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                pop(k)
                return
            if stack[k][0] in stops:
                return

    def text(raw: str) -> None:
        value = unescape(raw) if "&" in raw else raw
        said = " ".join(value.split())
        if said and stack[-1][0] == "head":
            pop(len(stack) - 1)
        _, standing, path, _ = stack[-1]
        if said:
            page.tokens.append(_key(path, "#", said))
        page.runs.append(Run(len(page.tokens) - 1, block, value, standing, is_open["a"] > 0))

    while at < n:
        tag = _TAG.search(html, at)
        if tag is None:
            text(html[at:])
            break
        if tag.start() > at:
            text(html[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if not inline or name == "br":
            block += 1
        if tag["end"]:
            if not inline:
                page.tokens.append(_tag_key(stack[-1][2], "/", name))
            for k in range(len(stack) - 1, 0, -1) if is_open[name] else ():
                if stack[k][0] == name:
                    pop(k)
                    break
                # An inline end tag stays within its block, a block's within its scope.
                if stack[k][0] in SCOPES or (inline and stack[k][0] not in INLINE):
                    break
            continue
        if is_open["head"] and stack[-1][0] == "head" and name not in HEAD:
            pop(len(stack) - 1)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if not inline and name not in VOID or name == "hr":
            close(PARAGRAPH, SCOPES)
        _, within, path, form = stack[-1]
        opened = _element(name, tag["attrs"].strip(), within, path, form)
        if not inline:
            page.tokens.append(opened[2])
        if name in VOID:
            continue
        if tag["attrs"].endswith("/") and (name in FOREIGN or any(is_open[f] for f in FOREIGN)):
            continue  # only there a start tag can close itself
        stack.append(opened)
        is_open[name] += 1
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else n
    return page


def joined(runs: list[Run]) -> str:
    """Texts of blocks, one space between them and for white space inside."""
    parts, block = [], None
    for run in runs:
        if run.block != block:
            parts.append(" ")
            block = run.block
        parts.append(run.text)
    return " ".join("".join(parts).split())
