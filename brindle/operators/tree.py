"""A small document tree on the standard library's tokenizer: unclosed elements stay open until an ancestor closes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("name", "attrs", "items", "up")

    def __init__(self, name: str, attrs: dict | None = None, up: Node | None = None):
        self.name, self.attrs, self.items, self.up = name, {} if attrs is None else attrs, [], up

    def nodes(self) -> list[Node]:
        return [x for x in self.items if x.__class__ is Node]

    def walk(self) -> list[Node]:
        """All elements below, in document order."""
        out, stack = [], self.items[::-1]
        while stack:
            x = stack.pop()
            if x.__class__ is Node:
                out.append(x)
                if x.items:
                    stack += x.items[::-1]
        return out

    def all(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def own(self, *names: str) -> list[Node]:
        return [x for x in self.items if x.__class__ is Node and x.name in names]

    def strings(self) -> list[str]:
        out, stack = [], self.items[::-1]
        while stack:
            x = stack.pop()
            if x.__class__ is Node:
                if x.items:
                    stack += x.items[::-1]
            else:
                out.append(x)
        return out

    def text(self, between: str = "", bare: bool = True) -> str:
        """All strings, stripped and without empty ones if ``bare``."""
        return between.join(s for x in self.strings() if (s := x.strip() if bare else x) or not bare)

    def above(self) -> Iterator[Node]:
        n = self.up
        while n is not None:
            yield n
            n = n.up

    def classes(self) -> str:
        return self.attrs.get("class") or ""

    def drop(self) -> None:
        self.up.items = [x for x in self.up.items if x is not self]

    def swap(self, text: str) -> None:
        self.up.items = [text if x is self else x for x in self.up.items]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        first: dict = {}
        for k, v in attrs:
            first[k] = v if v is not None else ""
        n = Node(tag, first, self.at)
        self.at.items.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.top and n.name != tag:
            n = n.up
        if n is not self.top:
            self.at = n.up

    def handle_data(self, data):
        self.at.items.append(data)


#: A tag as most pages write them, and the text up to the next one. What an element of ``_RAW`` holds is no markup.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][-a-zA-Z0-9_:]*=(?:\"[^\"&<>]*\"|'[^'&<>]*'))*)>([^<&]*)")
_ATTRIBUTE = re.compile(r"\s+([^=\s]+)=(?:\"([^\"]*)\"|'([^']*)')")
_RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title plaintext".split())


def _plain(html: str) -> Node | None:
    """The tree of a page of plain tags, in one pass; none where the page needs the tokenizer."""
    at = html.find("<")
    found = _PLAIN.findall(html)
    if at < 0 or html.find("&", 0, at) >= 0 or at + sum([len(c) + len(n) + len(a) + len(t) + 2 for c, n, a, t in found]) != len(html):
        return None
    top = here = Node("")
    if at:
        top.items.append(html[:at])
    for close, name, attrs, text in found:
        name = name.lower()
        if close:
            if attrs:
                return None
            n = here
            while n is not top and n.name != name:
                n = n.up
            if n is not top:
                here = n.up
        else:
            if name in _RAW:
                return None
            first: dict = {}
            if attrs:
                for k, double, single in _ATTRIBUTE.findall(attrs):
                    first[k.lower()] = double or single
            n = Node(name, first, here)
            here.items.append(n)
            if name not in VOID:
                here = n
        if text:
            here.items.append(text)
    return top


def parse(html: str | None) -> Node:
    if html and (top := _plain(html)):
        return top
    b = _Builder()
    b.feed(html or "")
    b.close()
    top = b.top
    b.at = b.top = None
    return top


def fell(top: Node) -> None:
    """Parts a tree's elements from those above them: else its memory would come back by the collector alone."""
    for n in top.walk():
        n.up = None
