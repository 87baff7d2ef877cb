"""HTML books: chapters between headings, by the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Elements that open a chapter, elements that break a line, and elements without an end tag.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BLOCKS = frozenset(("p", "div", "li", "tr", "section", "article", "blockquote", "ul", "ol", "table", "pre"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def normalised(text: str) -> str:
    """Single blanks, no ideographic ones, no blank lines."""
    text = re.sub(r"[ \t]+", " ", text).replace("　", "")
    return re.sub(r"\n\s*\n+", "\n", text).strip()


class _Chapters(HTMLParser):
    """Collects a document's title and its chapters.

    A heading closes the open chapter if that one has content or if there is a
    chapter before it; so text before the first heading is a chapter of its own,
    and an empty section stays unless it is the last. Text of scripts and styles
    in the body counts; the head's doesn't.
    """

    def __init__(self, whole: str):
        super().__init__(convert_charrefs=True)
        self.whole = whole
        self.name: str | None = None
        self.found: list[tuple[str, str]] = []
        self.title: str | None = None
        self.parts: list[str] = []
        self.heading: list[str] | None = None
        self.in_title, self.in_head = False, False

    def handle_starttag(self, tag, attrs):
        if tag == "title" and self.name is None:
            self.in_title, self.name = True, ""
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif self.in_head:
            return
        elif tag in HEADINGS:
            self._close(last=False)
            self.heading = []
        elif tag == "br" or tag in BLOCKS:
            self._add("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False
        elif tag in HEADINGS and self.heading is not None:
            self.title, self.heading = "".join(self.heading).strip(), None
        elif tag in BLOCKS and not self.in_head:
            self._add("\n")

    def handle_data(self, data):
        if self.in_title:
            self.name += data
        elif not self.in_head:
            self._add(data)

    def _add(self, text: str) -> None:
        (self.parts if self.heading is None else self.heading).append(text)

    def _close(self, last: bool) -> None:
        content = normalised("".join(self.parts))
        if content or (self.found and not last):
            self.found.append((self.whole if self.title is None else self.title, content))
        self.title, self.parts = None, []


def parse(html: str, stem: str, whole: str = "全文") -> tuple[str, list[tuple[str, str]]]:
    """``(name, chapters)`` of an HTML text; a body without text is one empty chapter."""
    parser = _Chapters(whole)
    parser.feed(html)
    parser.close()
    parser._close(last=True)
    name = (parser.name or "").strip() or stem
    return name, parser.found or [(whole, "")]
