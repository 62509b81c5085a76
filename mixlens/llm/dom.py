"""A forgiving HTML reader: the block-level tree of a page, its text blocks, and features of its nodes."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?)""", re.S)
_ATTRIBUTES = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page; what object, noscript, math and the like hold is.
SKIPPED = frozenset("script style template iframe title textarea".split())
#: Those of them that hold no elements; without an end tag they go on to the end of the page.
RAW = frozenset("script style textarea title".split())
_META = frozenset("base basefont bgsound link meta".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start of the key closes an open element among the values, unless one of the limits lies between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_LIMITS = {"td", "th", "table", "button", "html"}
_FREE_IN_P = {"button", "label", "select", "option"}

#: Kinds of attribute tokens.
TOKENS = (
    frozenset("article content post entry story text body main page prose copy read".split()),
    frozenset("nav menu navbar breadcrumb breadcrumbs pagination pager tabs topics toc navigation".split()),
    frozenset("ad ads adv advert advertisement sponsor sponsored promo promotion banner adsense outbrain taboola".split()),
    frozenset("sidebar aside side widget related recommend recommended rail trending popular more".split()),
    frozenset("footer foot copyright legal bottom contentinfo colophon".split()),
    frozenset("header head masthead topbar logo brand site top".split()),
    frozenset("comment comments reply replies discussion disqus respond thread reader".split()),
    frozenset("cookie consent notice alert modal popup gdpr newsletter subscribe signup overlay dialog privacy toast".split()),
    frozenset("share social follow tools actions buttons login search form".split()),
    frozenset("title headline byline author date lead summary caption quote".split()),
)
TAGS = (
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"div", "section", "center"}, {"article", "main"}, {"nav"},
    {"header"}, {"footer"}, {"aside"}, {"form", "button", "fieldset", "label", "select", "option"}, {"table", "tbody", "tr", "td", "th", "thead"}, {"blockquote", "pre", "figure", "figcaption"},
)
_TAG_KIND = {t: k for k, group in enumerate(TAGS) for t in group}
_TOKEN_KIND = {t: k for k, group in enumerate(TOKENS) for t in group}


@dataclass
class Page:
    """Nodes in page order; of each its tag, parent, attribute tokens and text: chars, in links, marks, words, blocks."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)


def _token_bits(attributes: str) -> int:
    bits = 0
    if "=" in attributes:
        for value in _ATTRIBUTES.findall(attributes):
            for part in _PARTS.findall(value.lower()):
                if part in _TOKEN_KIND:
                    bits |= 1 << _TOKEN_KIND[part]
    return bits


def _closed(text: str, name: str) -> dict[int, int]:
    """Ends of the elements of that name by the ends of their start tags; what has no end tag of its own is not in it."""
    token = re.compile(rf"""<(?:!--.*?(?:-->|\Z)|({'|'.join(RAW)})\b.*?(?:</\1|\Z)|(/?){name}(?![\w:-])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?)""", re.S | re.I)
    found, starts = {}, []
    for m in token.finditer(text):
        if m[2] is None or m[2] == "" and m[3].endswith("/"):
            continue
        if not m[2]:
            starts.append(m.end())
        elif starts:
            found[starts.pop()] = m.end()
    return found


def parse(source: str | None) -> Page:
    """Read a page. Markup errors never fail: what does not match is closed or passed over as browsers do in common cases."""
    text = source or ""
    page = Page(["html"], [-1], [0], [], [], [0])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; node -1 for inline ones
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name in the stack
    owners = [0]  # open nodes
    owner, linked = 0, 0
    pieces: list[str] = []
    closed: dict[str, dict[int, int]] = {}
    in_head = False

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            joined = "".join(pieces)
            if "&" in joined:
                joined = html.unescape(joined)
            joined = " ".join(joined.split())
            if joined:
                page.blocks.append((owner, joined))
                page.links.append(min(linked, len(joined)))
            pieces = []
        linked = 0

    def close(depth: int) -> None:
        """Close the open elements from that place on."""
        nonlocal owner
        if any(node >= 0 for _, node in stack[depth:]):
            flush()
        for name, node in stack[depth:]:
            places[name].pop()
            if node >= 0:
                owners.pop()
        del stack[depth:]
        owner = owners[-1]

    def nearest(names: set[str]) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((places[name][-1] for name in names if places[name]), default=0)

    at, size = 0, len(text)
    while at < size:
        found = _TOKEN.search(text, at)
        chunk = text[at : found.start()] if found else text[at:]
        if chunk:
            pieces.append(chunk)
            if places["a"]:
                linked += len(chunk.strip())
        if not found:
            break
        at = found.end()
        closing, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        if closing:
            in_head &= name != "head"
            if places[name]:
                close(places[name][-1])
            continue
        if name in SKIPPED:
            if not attributes.endswith("/"):
                if name in RAW:
                    end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(text, at)
                    at = end.end() if end else size
                else:
                    if name not in closed:
                        closed[name] = _closed(text, name)
                    at = closed[name].get(at, at)
            pieces.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in ("html", "head", "body"):
            in_head = name == "head"
            continue
        if in_head and name in _META:
            continue
        in_head = False  # </head> may be left out
        if name not in BLOCKS:
            page.inline[owner] += 1
            if name not in VOID and not attributes.endswith("/"):
                places[name].append(len(stack))
                stack.append((name, -1))
            continue
        closes, limits = _CLOSES.get(name, (set(), set()))
        if name not in _FREE_IN_P:
            closes, limits = closes | {"p"}, limits | _P_LIMITS
        if (depth := nearest(closes)) and depth >= nearest(limits):
            close(depth)
        flush()
        if name == "hr":
            continue
        page.tags.append(name)
        page.parents.append(owner)
        page.tokens.append(_token_bits(attributes))
        page.inline.append(0)
        if not attributes.endswith("/"):
            owner = len(page.tags) - 1
            owners.append(owner)
            places[name].append(len(stack))
            stack.append((name, owner))
    flush()
    return page


N_FEATURES = 19 + 2 * len(TOKENS) + 2 * len(TAGS)
_MARKS = re.compile(r"[.,;:!?]")


def features(page: Page) -> np.ndarray:
    """One row per node: subtree density, attribute tokens and tags of itself and of its ancestors, depth, siblings."""
    n = len(page.tags)
    parents = np.array(page.parents)
    chars, linked, marks, words, blocks = (np.zeros(n) for _ in range(5))
    before = np.full(n, -1.0)
    seen = 0
    for (owner, text), link in zip(page.blocks, page.links, strict=True):
        chars[owner] += len(text)
        linked[owner] += link
        marks[owner] += len(_MARKS.findall(text))
        words[owner] += text.count(" ") + 1
        blocks[owner] += 1
        node = owner
        while node >= 0 and before[node] < 0:
            before[node] = seen
            node = page.parents[node]
        seen += len(text)
    tags = np.ones(n) + np.array(page.inline)
    depth = np.zeros(n)
    kinds = np.zeros((n, len(TAGS)))
    for k, t in enumerate(page.tags):
        if t in _TAG_KIND:
            kinds[k, _TAG_KIND[t]] = 1
    bits = np.array(page.tokens)
    own = (bits[:, None] >> np.arange(len(TOKENS))) & 1
    above_tokens, above_kinds = np.zeros((n, len(TOKENS))), np.zeros((n, len(TAGS)))
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        p = page.parents[k]
        depth[k] = depth[p] + 1
        above_tokens[k] = np.maximum(above_tokens[p], own[p])
        above_kinds[k] = np.maximum(above_kinds[p], kinds[p])
        children[p].append(k)
    sums = np.stack([chars, linked, marks, words, blocks, tags])
    for k in range(n - 1, 0, -1):
        sums[:, page.parents[k]] += sums[:, k]
    chars, linked, marks, words, blocks, tags = sums
    # prose is text outside links in blocks of more than a few words; titles count in what holds them
    prose, titles = np.zeros(n), np.zeros(n)
    for (owner, text), link in zip(page.blocks, page.links, strict=True):
        prose[owner] += (len(text) - link) * (text.count(" ") > 5 or not text.isascii())
    for k in range(n - 1, 0, -1):
        prose[page.parents[k]] += prose[k]
        titles[page.parents[k]] += titles[k] + (page.tags[k] in ("h1", "h2"))
    siblings, place, mean = np.ones(n), np.zeros(n), chars.copy()
    for group in children:
        if group:
            siblings[group] = len(group)
            place[group] = np.arange(len(group)) / len(group)
            mean[group] = chars[group].mean()
    some = np.maximum(chars, 1)
    base = np.stack([
        np.log1p(chars), linked / some, np.log1p(chars / tags), depth, np.log1p(siblings), place, chars / np.maximum(chars[parents], 1),
        chars / np.maximum(mean, 1), marks / some, words / np.maximum(blocks, 1), np.maximum(before, 0) / max(seen, 1), np.log1p(blocks),
        chars / max(seen, 1), chars[parents] / max(seen, 1), (linked / some)[parents], prose / max(prose[0], 1), prose[parents] / max(prose[0], 1), np.minimum(titles, 3), np.minimum(titles[parents], 3),
    ], axis=1)
    return np.concatenate([base, own, above_tokens, kinds, above_kinds], axis=1)
