"""HTML to text: a light markdown of headings, paragraphs, items and table rows."""

from __future__ import annotations

from pyspark.sql import types as T

from .layout import by_slices
from .tree import fell, parse

_KEPT = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table")


def html_to_markdown(html: str | None) -> str:
    """Kept elements in document order, parted by empty lines; what nests is told again by each element around it."""
    top = parse(html)
    for n in top.all("script", "style"):
        n.drop()
    out: list[str] = []
    for n in top.all(*_KEPT):
        if n.name == "table":
            out += [" | ".join(c.text() for c in row.all("td", "th")) for row in n.all("tr")]
        else:
            mark = {"p": "", "li": "- "}.get(n.name) if n.name in ("p", "li") else "#" * int(n.name[1]) + " "
            out.append(mark + n.text())
    fell(top)
    return "\n\n".join(out)


clean_html = by_slices(html_to_markdown, T.StringType())


def upload_text(html: str | None) -> str:
    """For uploads that are kept whole: scripts and heads go, table rows read ``a | b``."""
    top = parse(html)
    for n in top.all("script", "style", "meta", "link"):
        n.drop()
    for row in top.all("tr"):
        row.items = ["\n" + " | ".join(c.text() for c in row.all("td", "th")) + "\n"]
    return "\n".join(s for x in top.strings() for y in x.split("\n") if (s := y.strip()))
