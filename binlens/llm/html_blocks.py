"""Leaf blocks of a web page: runs of text between block-level tags, with their ancestors.

Ancestors are nodes of two tries (tags, and words of class names), shared by all blocks, so a block costs the same at any
depth: 100,000 nested or unclosed elements are read in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Tags that flow inside a block; every other tag ends the block around it. (Fixed values: HTML's phrasing tags.)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br".split())
#: Tags without content. (Fixed values.)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is not shown as text. (Fixed values.)
UNSHOWN = frozenset("script style noscript template title svg math iframe object canvas audio video textarea select".split())
#: Opening one of these ends an open one of the listed tags. (Fixed values.)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
#: An end search does not pass these. (Fixed values.)
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|[^<]+|<""", re.S)
_UNSHOWN_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in UNSHOWN}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[A-Za-z]+")


def name_words(value: str) -> list[str]:
    """Words of a class or id: split at non-letters and at camel case."""
    return [w.lower() for part in _NAME.findall(value) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", part)]


class Chain:
    """A path of words from the outermost on, as a trie node. ``first``: its word is not on the path before."""

    __slots__ = ("word", "parent", "first", "last", "kids")

    def __init__(self, word: str = "", parent: Chain | None = None, first: bool = False, last: str = "body"):
        self.word, self.parent, self.first, self.last, self.kids = word, parent, first, last, {}

    def child(self, word: str, seen) -> Chain:
        """The path with one more word; ``seen`` counts the words of this path."""
        got = self.kids.get(word)
        if got is None:
            got = self.kids[word] = Chain(word, self, not seen[word], self.last if word in ("html", "body") else word)
        return got

    def words(self) -> tuple[str, ...]:
        out, at = [], self
        while at.parent is not None:
            out.append(at.word)
            at = at.parent
        return tuple(reversed(out))


@dataclass(slots=True)
class Block:
    text: str
    path: Chain                     # tags of the ancestors
    named: Chain                    # words of their classes, ids and roles
    linked: int                     # characters inside links
    parent: int                     # number of the element that holds the block

    @property
    def tags(self) -> tuple[str, ...]:
        """Tags of the ancestors, outermost first."""
        return self.path.words()

    @property
    def names(self) -> tuple[str, ...]:
        """Words of their classes, ids and roles."""
        return self.named.words()


class _Open:
    """An open element with what holds from it on inwards."""

    __slots__ = ("tag", "names", "number", "block", "path", "named", "holder", "holder_at")

    def __init__(self, tag: str, names: tuple[str, ...], number: int, block: bool):
        self.tag, self.names, self.number, self.block = tag, names, number, block


class _Stack:
    """Open elements, outermost first, with counts of their tags and names."""

    def __init__(self, roots: tuple[Chain, Chain]):
        self.roots, self.items, self.tags, self.names = roots, [], Counter(), Counter()

    def push(self, e: _Open):
        path, named, holder, at = self.state()
        e.path = path.child(e.tag, self.tags)
        self.tags[e.tag] += 1
        for n in e.names:
            named = named.child(n, self.names)
            self.names[n] += 1
        e.named = named
        e.holder, e.holder_at = (e.number, len(self.items)) if e.block else (holder, at)
        self.items.append(e)

    def state(self) -> tuple[Chain, Chain, int, int]:
        """(tags, names, number of the innermost block element or 0, its place or -1)."""
        if not self.items:
            return *self.roots, 0, -1
        e = self.items[-1]
        return e.path, e.named, e.holder, e.holder_at

    def cut(self, at: int) -> list[_Open]:
        """Close the elements from place ``at`` on."""
        gone = self.items[at:]
        del self.items[at:]
        for e in gone:
            self.tags[e.tag] -= 1
            for n in e.names:
                self.names[n] -= 1
        return gone

    def close(self, tag: str, inline: bool):
        """An end tag: closes the innermost such element and, unless it is inline, all inside it; inline ends don't close
        blocks opened since."""
        if not self.tags[tag]:
            return
        for i in range(len(self.items) - 1, -1, -1):
            if self.items[i].tag == tag:
                inside = self.cut(i)[1:]
                for e in inside if inline else ():
                    self.push(e)
                return
            if inline and self.items[i].block:
                return

    def make_room(self, tag: str):
        """What the start of a block element closes: a like item of its list or table, or an open paragraph."""
        if tag in ENDS:
            if any(self.tags[t] for t in ENDS[tag]):
                for i in range(len(self.items) - 1, -1, -1):
                    if self.items[i].tag in ENDS[tag]:
                        self.cut(i)
                        return
                    if self.items[i].tag in SCOPES.get(tag, ()):
                        return
            return
        at = self.state()[3]
        if at >= 0 and self.items[at].tag == "p":
            self.cut(at)


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    if "=" not in attributes and "hidden" not in attributes:
        return ()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true":
            out.append("hidden!")
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden!")
        else:
            out += name_words(value)
    return tuple(out)


def blocks(page: str, roots: tuple[Chain, Chain] | None = None) -> list[Block]:
    """The page's blocks in order; whitespace in each is single spaces, character references decoded.

    ``roots``: tries to share with other pages. Elements nested or left open to any depth, and end tags without a start,
    take constant time each; an inline end tag reopens the inline elements opened since.
    """
    out: list[Block] = []
    stack = _Stack(roots or (Chain(), Chain()))
    parts: list[str] = []
    linked = number = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                path, named, holder, _ = stack.state()
                out.append(Block(text, path, named, min(linked, len(text)), holder))
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        token = m[0]
        if token[0] != "<" or token == "<":
            text = html.unescape(token) if "&" in token else token
            parts.append(text)
            if stack.tags["a"]:
                linked += len(text.strip())
            continue
        name = m[2] or m[5]
        if not name:
            continue            # comment or declaration
        if m[5] and not m[7]:
            break               # the page ends inside a tag
        tag, closing = name.lower(), bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        inline = tag in INLINE
        if tag == "br":
            parts.append(" ")
            continue
        if not inline:
            flush()
        if closing:
            stack.close(tag, inline)
            continue
        if tag in UNSHOWN:
            if not attributes.rstrip().endswith("/"):
                stop = _UNSHOWN_END[tag].search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in VOID:
            continue
        if not inline:
            stack.make_room(tag)
        number += 1
        stack.push(_Open(tag, _names(attributes), number, not inline))
    flush()
    return out
