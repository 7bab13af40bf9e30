"""HTML main text: flat text blocks judged by a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block has its
word count and link density, those of the blocks before and after it, the kind
of its tag, and how the page's running text lies around it: ``inside`` tells
whether it stands in the container that holds most of that text, ``branch``
what share of that container's text its own part of it has. Both come from word
counts and link densities alone. What tags, roles, classes and ids call a
container (``named``) is one feature more; text under a name that isn't main
text has no weight in the search for that container, so comments, notices and
sidebars may be longer than the article. A small decision tree, trained here
on the labelled table below, decides which blocks are main text.

Defined results: a null, empty or markup-only page has an empty text. Unclosed
tags end where their container does; an unclosed comment, script or style runs
to the end of the page, an unclosed button or the like up to the next tag; a ``<`` that opens no tag is text. Repeated rows give a
row each, null ids and urls stay null. Very long pages are handled one at a
time, in time linear in their length. An empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

HIDDEN = "script|style|title|textarea|iframe"
"""What is text up to its end tag, or the end of the page, whatever stands in it."""
UNSHOWN = frozenset("noscript template svg select button".split())
"""Left out up to their end tag, where they have one before the next of their kind; else only their first words are."""
TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<({HIDDEN})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl table details dialog body".split())
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form dialog menu".split())
GOOD_WORDS = frozenset("content main maincontent".split())
ARTICLE_WORDS = frozenset("article post entry story articlebody".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert advertisement banner cookie cookies notice consent gdpr promo "
    "promotion sponsor sponsored comment comments reply replies respond discussion disqus share sharing social related recommended "
    "widget subscribe subscription newsletter signup login search popup modal overlay breadcrumb breadcrumbs pagination pager "
    "toolbar copyright legal skip complementary contentinfo alert".split()
)
BAD_OUTSIDE = frozenset("header masthead topbar".split())  # within an article these hold its title
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("inside", "branch", "named", "kind", "words", "links", "words_before", "links_before", "words_after", "links_after")
# inside: 2 in the container of most running text, 1 no such container (the whole page is it), 0 outside of it
# branch: the share of that container's running text in the block's own part of it, 1 for blocks directly in it
# named: 1 inside an article or the like, -1 inside a menu, advert, notice or the like, 0 neither
# kind: 2 heading, 1 paragraph, 0 anything else; words are counted up to 60
LABELLED = (
    # (inside, branch, named, kind, words, links, words_before, links_before, words_after, links_after), main text
    # comments longer than the article: within it or after it, named, and after it without a name
    ((2, 0.0, -1, 1, 48, 0.0, 48, 0.0, 48, 0.0), 0),
    ((2, 0.0, -1, 1, 60, 0.0, 60, 0.1, 60, 0.0), 0),
    ((2, 1.0, -1, 1, 60, 0.0, 45, 0.0, 60, 0.0), 0),
    ((2, 0.6, -1, 1, 40, 0.0, 4, 0.0, 52, 0.0), 0),
    ((2, 1.0, -1, 2, 1, 0.0, 60, 0.0, 48, 0.0), 0),
    ((1, 1.0, -1, 1, 48, 0.0, 48, 0.0, 48, 0.0), 0),
    ((1, 0.0, -1, 1, 60, 0.0, 30, 0.0, 60, 0.0), 0),
    ((0, 0.0, 0, 1, 48, 0.0, 48, 0.0, 48, 0.0), 0),
    ((0, 0.0, 0, 1, 60, 0.0, 60, 0.0, 60, 0.0), 0),
    ((2, 1.0, 1, 2, 9, 0.0, 8, 0.0, 30, 0.0), 1),
    ((2, 1.0, 0, 2, 4, 0.0, 40, 0.0, 25, 0.0), 1),
    ((2, 1.0, 0, 2, 1, 0.0, 5, 0.0, 3, 0.0), 1),
    ((2, 1.0, 1, 1, 45, 0.0, 9, 0.0, 38, 0.0), 1),
    ((2, 1.0, 0, 1, 60, 0.1, 40, 0.0, 60, 0.1), 1),
    ((2, 1.0, 0, 1, 1, 0.0, 20, 0.0, 12, 0.0), 1),
    ((2, 1.0, 1, 1, 2, 0.0, 1, 0.0, 9, 0.0), 1),
    ((2, 1.0, 0, 1, 7, 0.0, 60, 0.0, 11, 0.0), 1),
    ((2, 1.0, 0, 1, 12, 0.3, 33, 0.0, 2, 1.0), 1),
    ((2, 1.0, 1, 1, 24, 0.5, 33, 0.0, 40, 0.0), 1),
    ((2, 1.0, 0, 0, 14, 0.0, 30, 0.0, 22, 0.0), 1),
    ((2, 0.3, 0, 0, 5, 0.0, 4, 0.0, 6, 0.0), 1),
    ((2, 0.2, 1, 0, 3, 0.0, 60, 0.0, 8, 0.0), 1),
    ((2, 1.0, 0, 1, 2, 0.0, 10, 0.0, 2, 1.0), 1),
    ((2, 1.0, 1, 1, 6, 0.0, 1, 0.0, 3, 0.9), 1),
    ((2, 0.1, 0, 0, 12, 0.0, 30, 0.0, 11, 0.0), 1),
    ((2, 0.6, 0, 1, 40, 0.0, 6, 0.0, 28, 0.0), 1),
    ((2, 0.4, 0, 1, 30, 0.1, 5, 0.0, 0, 0.0), 1),
    ((2, 0.4, 0, 2, 5, 0.0, 30, 0.0, 30, 0.0), 1),
    ((2, 0.1, 0, 1, 18, 0.0, 40, 0.0, 35, 0.0), 1),
    ((2, 0.05, 0, 0, 6, 0.0, 20, 0.0, 3, 0.0), 1),
    ((2, 0.03, 1, 0, 8, 0.0, 14, 0.0, 12, 0.0), 1),
    ((2, 0.03, 0, 1, 8, 0.0, 40, 0.0, 30, 0.0), 1),
    ((2, 0.06, 1, 0, 5, 0.2, 7, 0.0, 0, 0.0), 1),
    ((2, 1.0, 0, 2, 3, 0.0, 3, 1.0, 5, 1.0), 1),
    ((2, 1.0, 1, 1, 9, 0.4, 50, 0.0, 1, 0.0), 1),
    ((2, 1.0, 0, 1, 5, 0.5, 1, 0.0, 1, 0.0), 1),
    ((2, 1.0, 0, 1, 1, 0.0, 1, 0.0, 1, 0.0), 1),
    ((2, 0.0, 0, 0, 2, 1.0, 2, 1.0, 2, 1.0), 0),
    ((2, 0.0, 0, 0, 4, 1.0, 30, 0.0, 3, 1.0), 0),
    ((2, 0.0, 1, 0, 6, 0.9, 5, 1.0, 9, 0.0), 0),
    ((2, 1.0, 0, 1, 2, 1.0, 40, 0.0, 12, 0.0), 0),
    ((2, 1.0, 1, 1, 3, 1.0, 18, 0.1, 0, 0.0), 0),
    ((2, 0.0, 0, 0, 12, 0.8, 40, 0.0, 8, 0.9), 0),
    ((2, 0.05, -1, 0, 7, 0.0, 40, 0.0, 35, 0.0), 0),
    ((2, 0.05, -1, 1, 20, 0.0, 3, 1.0, 30, 0.0), 0),
    ((2, 0.2, -1, 1, 35, 0.0, 4, 0.0, 28, 0.0), 0),
    ((2, 0.2, -1, 2, 2, 0.0, 60, 0.0, 20, 0.0), 0),
    ((2, 0.1, -1, 0, 9, 0.0, 1, 1.0, 9, 0.0), 0),
    ((0, 0.0, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0), 0),
    ((0, 0.0, -1, 0, 3, 1.0, 0, 0.0, 2, 1.0), 0),
    ((0, 0.0, 0, 0, 9, 0.0, 1, 1.0, 9, 0.0), 0),
    ((0, 0.0, -1, 0, 20, 0.0, 4, 0.0, 30, 0.0), 0),
    ((0, 0.0, 0, 1, 15, 0.0, 12, 0.0, 8, 0.0), 0),
    ((0, 0.0, -1, 1, 60, 0.1, 60, 0.0, 44, 0.0), 0),
    ((0, 0.0, 0, 1, 6, 0.0, 60, 0.0, 0, 0.0), 0),
    ((0, 0.0, 0, 2, 2, 0.0, 60, 0.0, 20, 0.0), 0),
    ((0, 0.0, -1, 2, 5, 1.0, 3, 1.0, 40, 0.0), 0),
    ((0, 0.0, 0, 0, 11, 0.0, 30, 0.0, 0, 0.0), 0),
    ((0, 0.0, 0, 0, 3, 1.0, 2, 1.0, 4, 1.0), 0),
    ((0, 0.0, 0, 0, 8, 0.0, 2, 1.0, 9, 0.0), 0),
    ((0, 0.0, 0, 2, 4, 0.0, 0, 0.0, 3, 1.0), 0),
    ((0, 0.0, 0, 1, 12, 0.1, 40, 0.0, 10, 0.2), 0),
    ((0, 0.0, 0, 0, 60, 0.0, 4, 0.0, 0, 0.0), 0),
    ((0, 0.0, 0, 0, 30, 0.4, 60, 0.0, 0, 0.0), 0),
    ((1, 1.0, 0, 1, 60, 0.0, 8, 0.0, 45, 0.0), 1),
    ((1, 1.0, 0, 1, 40, 0.1, 60, 0.0, 60, 0.2), 1),
    ((1, 1.0, 0, 1, 25, 0.0, 3, 0.0, 40, 0.0), 1),
    ((1, 0.5, 1, 1, 18, 0.2, 50, 0.0, 4, 1.0), 1),
    ((1, 0.4, 0, 1, 16, 0.0, 6, 1.0, 3, 0.5), 1),
    ((1, 1.0, 0, 1, 32, 0.0, 50, 0.0, 1, 1.0), 1),
    ((1, 1.0, 1, 1, 60, 0.1, 60, 0.0, 2, 1.0), 1),
    ((1, 0.8, 0, 1, 19, 0.0, 24, 0.0, 3, 1.0), 1),
    ((1, 0.3, 0, 1, 40, 0.0, 30, 0.0, 35, 0.0), 1),
    ((1, 0.2, 0, 1, 25, 0.0, 5, 0.0, 38, 0.0), 1),
    ((1, 0.3, 1, 1, 12, 0.0, 30, 0.0, 26, 0.1), 1),
    ((1, 0.3, 0, 2, 5, 0.0, 40, 0.0, 30, 0.0), 1),
    ((1, 0.2, 1, 2, 3, 0.0, 12, 0.0, 34, 0.0), 1),
    ((1, 1.0, 0, 1, 8, 0.0, 40, 0.0, 30, 0.0), 1),
    ((1, 0.5, 1, 1, 5, 0.0, 30, 0.0, 45, 0.1), 1),
    ((1, 1.0, 0, 1, 3, 0.0, 25, 0.0, 14, 0.0), 1),
    ((1, 1.0, 0, 1, 4, 0.0, 2, 1.0, 2, 1.0), 0),
    ((1, 1.0, 0, 1, 6, 0.0, 3, 1.0, 4, 0.8), 0),
    ((1, 1.0, 0, 1, 9, 0.8, 30, 0.0, 20, 0.0), 0),
    ((1, 0.3, 0, 1, 20, 0.7, 3, 1.0, 5, 1.0), 0),
    ((1, 0.2, 0, 1, 12, 1.0, 12, 1.0, 11, 1.0), 0),
    ((1, 0.3, -1, 1, 30, 0.0, 5, 0.0, 40, 0.0), 0),
    ((1, 0.3, -1, 1, 12, 0.0, 30, 0.0, 20, 0.0), 0),
    ((1, 1.0, 0, 2, 7, 0.0, 3, 1.0, 50, 0.0), 1),
    ((1, 1.0, 0, 2, 4, 0.0, 40, 0.0, 32, 0.0), 1),
    ((1, 0.5, 1, 2, 3, 0.0, 2, 1.0, 24, 0.1), 1),
    ((1, 1.0, 0, 2, 3, 0.0, 2, 1.0, 3, 1.0), 0),
    ((1, 1.0, 0, 2, 2, 0.0, 30, 0.0, 2, 1.0), 0),
    ((1, 0.2, -1, 2, 2, 0.0, 30, 0.0, 20, 0.0), 0),
    ((1, 0.35, -1, 0, 15, 0.0, 3, 0.0, 0, 0.0), 0),
    ((1, 0.35, 0, 0, 15, 0.0, 4, 0.0, 0, 0.0), 0),
    ((1, 0.3, 0, 0, 9, 0.0, 1, 1.0, 3, 0.0), 0),
    ((1, 0.06, 0, 0, 6, 0.0, 1, 1.0, 9, 0.0), 0),
    ((1, 0.15, 0, 0, 10, 0.0, 1, 1.0, 7, 0.0), 0),
    ((1, 0.2, 0, 0, 13, 0.0, 12, 0.0, 5, 0.0), 0),
    ((1, 0.1, 0, 0, 8, 0.0, 30, 0.0, 12, 0.0), 0),
    ((1, 1.0, 0, 2, 4, 1.0, 1, 1.0, 20, 0.0), 0),
    ((1, 0.0, 0, 0, 2, 1.0, 1, 1.0, 1, 1.0), 0),
    ((1, 0.0, 0, 0, 6, 0.0, 2, 1.0, 3, 1.0), 0),
    ((1, 0.1, 0, 0, 9, 0.0, 60, 0.0, 0, 0.0), 0),
    ((1, 0.1, 0, 0, 8, 0.2, 12, 0.0, 2, 1.0), 0),
    ((1, 0.1, 0, 0, 5, 0.5, 40, 0.0, 40, 0.0), 0),
    ((1, 1.0, 0, 0, 30, 0.0, 25, 0.0, 40, 0.0), 1),
    ((1, 0.5, 0, 0, 60, 0.1, 8, 0.0, 35, 0.1), 1),
    ((1, 1.0, 0, 0, 22, 0.0, 3, 0.0, 26, 0.0), 1),
    ((1, 0.3, 0, 0, 45, 0.7, 4, 1.0, 6, 1.0), 0),
    ((1, 0.3, 0, 0, 26, 0.9, 30, 0.0, 3, 1.0), 0),
)
MOST = 0.65  # what share of the running text a part must hold for the search for its container to go into it
PARAGRAPH, TITLE = 3, 20  # the words that a paragraph and a main heading count for beside their own


@dataclass
class Block:
    text: str
    linked: int
    named: int
    kind: int
    title: bool
    holder: int
    words: int = 0
    inside: int = 0
    branch: float = 0.0


@dataclass(frozen=True)
class Hint:
    """What a container is called: ``bad`` by its tag (2) or its names (1), a page's ``head``, ``good`` as an article (2) or main part (1)."""

    bad: int = 0
    head: bool = False
    good: int = 0


def hint(tag: str, attributes: str) -> Hint:
    tokens: set[str] = set()
    if "=" in attributes and tag != "body":
        for a, b, c in NAMED.findall(attributes):
            tokens.update(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
    bad = 2 if tag in BAD_TAGS and tag != "form" else 1 if tag == "form" or tokens & BAD_WORDS else 0
    good = 2 if tag == "article" or tokens & ARTICLE_WORDS else 1 if tag == "main" or tokens & GOOD_WORDS else 0
    return Hint(bad, tag == "header" or bool(tokens & BAD_OUTSIDE), good)


def unshown_end(html: str, tag: str, at: int) -> int | None:
    """Where an element that isn't shown ends; None if its tag isn't closed before the next of its kind."""
    end = re.compile(rf"<(/?){tag}\b[^>]*>", re.I).search(html, at)
    return end.end() if end and end[1] else None


def blocks_of(html: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    found: list[Block] = []
    open_tags: list[tuple[str, int]] = [("", 0)]  # containers and their numbers
    open_count: Counter[str] = Counter()
    parents, hints = [0], [Hint()]
    parts: list[str] = []
    linked: list[str] = []
    kind, title, in_link, at, skipped = 0, False, False, 0, 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, len("".join(linked).split()), 0, kind, title, open_tags[-1][1]))
        parts.clear()
        linked.clear()

    def add(raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    for m in TOKEN.finditer(html):
        if m.start() < skipped:
            continue
        add(html[max(at, skipped) : m.start()])
        at = m.end()
        if m[1] is not None:
            if m[1].lower() in ("textarea", "iframe"):
                flush()
            continue
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in UNSHOWN:
            flush()
            if not closing and not attributes.endswith("/"):
                end = unshown_end(html, tag, at)
                following = html.find("<", at)
                skipped = end if end is not None else following if following >= 0 else len(html)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
                if closing:
                    linked.append(" ")
            elif tag in ("img", "input"):
                parts.append(" ")
            continue
        flush()
        in_link = False if tag != "br" else in_link
        if tag in CONTAINERS:
            if closing and open_count[tag]:
                while True:
                    name = open_tags.pop()[0]
                    open_count[name] -= 1
                    if name == tag:
                        break
            elif not closing and not attributes.endswith("/"):
                outer = open_tags[-1]
                open_tags.append((tag, len(parents)))
                open_count[tag] += 1
                parents.append(outer[1])
                hints.append(hint(tag, attributes))
            kind, title = 0, False
        elif tag != "br":
            kind = 0 if closing else 2 if tag in HEADINGS else 1 if tag == "p" else 0
            title = kind == 2 and tag == "h1"
    add(html[max(at, skipped) :])
    flush()
    strong = called(found, parents, hints)
    place(found, parents, strong)
    return found


def called(blocks: list[Block], parents: list[int], hints: list[Hint]) -> list[int]:
    """Set ``named`` of the blocks; which containers are, or lie within, an article (2) or a main part (1).

    What a container is called holds for all within it. A name isn't believed of a container with the page's main
    heading, unless it is its tag, and no name is if nothing else had running text.
    """
    with_title = [False] * len(parents)
    for b in blocks:
        if b.title:
            c = b.holder
            while c and not with_title[c]:
                with_title[c] = True
                c = parents[c]
    for trust in (True, False):
        named, strong = [0] * len(parents), [0] * len(parents)
        for c in range(1, len(parents)):
            up, own = parents[c], hints[c]
            bad = own.bad == 2 or trust and (own.bad == 1 and not with_title[c] or own.head and named[up] <= 0)
            named[c] = -1 if named[up] < 0 or bad else 1 if named[up] > 0 or own.good else 0
            strong[c] = max(strong[up], own.good) if named[c] >= 0 else 0
        if any(named[b.holder] >= 0 for b in blocks):
            break
    for b in blocks:
        b.named = named[b.holder]
    return strong


def running(b: Block) -> float:
    """How much running text a block has: its words outside links, short scraps counted half."""
    plain = b.words - min(b.linked, b.words)
    return (plain if b.kind or plain >= 10 else plain / 2) + (PARAGRAPH if b.kind == 1 and plain else TITLE if b.title and plain else 0)


def place(blocks: list[Block], parents: list[int], strong: list[int]) -> None:
    """Set words, ``inside`` and ``branch`` of the blocks; a container's number is greater than its parent's.

    Text under a name that isn't main text has no weight. Where there is an article, only its text weighs in the
    search for the container; where there is none but a main part, that.
    """
    mass = [0.0] * len(parents)
    weight = [[0.0] * len(parents) for _ in range(3)]
    for b in blocks:
        b.words = len(b.text.split())
        if b.named >= 0:
            mass[b.holder] += running(b)
            for level in range(1, strong[b.holder] + 1):
                weight[level][b.holder] += running(b)
    weight[0] = mass
    for one in weight:
        for c in range(len(parents) - 1, 0, -1):
            one[parents[c]] += one[c]
    search = next((one for one in weight[:0:-1] if one[0] > 0), mass)
    main = 0
    for c in range(1, len(parents)):  # in page order, so each step goes from a container to one within it
        if parents[c] == main and search[c] >= MOST * search[main] > 0:
            main = c
    part = [-1.0] * len(parents)
    part[main] = 1.0
    for c in range(main + 1, len(parents)):
        if parents[c] == main:
            part[c] = mass[c] / mass[main] if mass[main] else 0.0
        else:
            part[c] = part[parents[c]]
    alone = all(part[b.holder] >= 0 for b in blocks)  # a container around everything is no choice
    for b in blocks:
        own = part[b.holder]
        b.inside = 0 if own < 0 else 1 if alone else 2
        b.branch = max(own, 0.0)


def feature_rows(blocks: list[Block]) -> np.ndarray:
    words = np.array([0, *(min(b.words, 60) for b in blocks), 0], float)
    links = np.array([0, *(min(b.linked / b.words, 1.0) for b in blocks), 0], float)
    own = (np.array([getattr(b, f) for b in blocks], float) for f in ("inside", "branch", "named", "kind"))
    columns = (*own, words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:])
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Node:
    """An inner node (feature, limit, sides) or a leaf (keep)."""

    keep: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Node:
    """A tree by Gini impurity; the first best split holds."""
    keep = bool(y.mean() >= 0.5)
    if depth == 0 or y.min() == y.max():
        return Node(keep)
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, feature] <= limit
            cost = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-9:
                best = cost, feature, float(limit), low
    if best is None:
        return Node(keep)
    _, feature, limit, low = best
    return Node(keep, feature, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(1)
def tree() -> Node:
    return grow(np.array([x for x, _ in LABELLED], float), np.array([y for _, y in LABELLED], float))


def judge(node: Node, rows: np.ndarray) -> np.ndarray:
    """Which rows the tree keeps."""
    if node.feature < 0:
        return np.full(len(rows), node.keep)
    low = rows[:, node.feature] <= node.limit
    out = np.empty(len(rows), bool)
    out[low], out[~low] = judge(node.low, rows[low]), judge(node.high, rows[~low])
    return out


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    kept = judge(tree(), feature_rows(blocks))
    return " ".join(b.text for b, k in zip(blocks, kept.tolist(), strict=True) if k)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
        counts = pa.array([len(t) for t in texts], pa.int64())
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"]
        )

    plain = df.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return map_text(plain, step, "page_id long, url string, text string, n_chars long", column="html")
