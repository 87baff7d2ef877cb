"""EPUB books: spine documents in reading order, from the zip's bytes."""

from __future__ import annotations

import html
import io
import posixpath
import re
import urllib.parse
import zipfile
import zlib
from xml.etree import ElementTree

_TAG = re.compile(r"(?s)<[^>]+>")


#: Elements that may hold a chapter's title, in the order in which they are tried.
TITLE_TAGS = ("h1", "h2", "h3", "title")


class EpubError(ValueError):
    """A file that is no readable EPUB."""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _named(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in root.iter() if _local(x.tag) == name]


def plain(text: str) -> str:
    return html.unescape(_TAG.sub("", text))


def to_text(source: str) -> str:
    """Lines of a chapter's HTML: no scripts, styles, heads or pictures, trimmed, blank ones dropped."""
    from folio.functions.text import HIDDEN_TAGS, LINE_TAGS

    for tag in HIDDEN_TAGS:
        source = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "", source)
    source = re.sub(rf"(?i)<\s*({LINE_TAGS})\b[^>]*>", "\n", source)
    lines = (x.strip() for x in plain(source).split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(source: str, path: str) -> str:
    """The first heading or title with text, of the first match of each; else the file's stem."""
    for tag in TITLE_TAGS:
        found = re.search(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", source)
        if found and (text := plain(found[1]).strip()):
            return text
    return posixpath.splitext(posixpath.basename(path))[0]


def _member(files: dict[str, bytes], part: str) -> str | None:
    """The first member by name that holds ``part``, regardless of case."""
    return min((n for n in files if part.lower() in n.lower()), default=None)


def decoded(data: bytes) -> str:
    """A chapter's text: by its mark, as UTF-8, or else as GB18030."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\x84\x31\x95\x33", "gb18030")):
        if data.startswith(mark):
            return data[len(mark) :].decode(charset, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace")


def _package_path(files: dict[str, bytes]) -> str:
    """The package document: where the container points, else the usual place, else any file of that name."""
    path = "OEBPS/content.opf"
    try:
        container = ElementTree.fromstring(files.get("META-INF/container.xml", b""))
        path = next((x.get("full-path") for x in _named(container, "rootfile") if x.get("full-path")), path)
    except ElementTree.ParseError:
        pass
    found = path if path in files else _member(files, "content.opf")
    if found is None:
        raise EpubError("no package document")
    return found


def parse(data: bytes) -> tuple[str, str, list[tuple[str, str]]]:
    """``(name, author, chapters)``; entries that repeat a path and title are dropped."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise EpubError("not a zip archive") from e
    files = {}
    for name in archive.namelist():
        try:
            files[name.removeprefix("/")] = archive.read(name)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error):
            continue  # a member that can't be read is as good as missing
    place = _package_path(files)
    try:
        package = ElementTree.fromstring(files[place])
    except ElementTree.ParseError as e:
        raise EpubError(f"broken package document: {e}") from e
    text = lambda name: next((plain(x.text).strip() for x in _named(package, name) if x.text and x.text.strip()), "")
    items = {x.get("id"): x for x in _named(package, "item")}
    folder = posixpath.dirname(place)
    chapters, seen = [], set()
    for ref in _named(package, "itemref"):
        item = items.get(ref.get("idref"))
        href = item.get("href", "") if item is not None else ""
        if item is None or ("html" not in item.get("media-type", "").lower() and ".htm" not in href.lower() and ".xhtml" not in href.lower()):
            continue
        href = urllib.parse.unquote(href.partition("#")[0])
        if not href:
            continue
        path = href[1:] if href.startswith("/") else posixpath.normpath(posixpath.join(folder, href))
        member = path if path in files else _member(files, posixpath.basename(path))
        if member is None or not files[member]:
            continue
        source = decoded(files[member])
        title, content = title_of(source, path), to_text(source)
        if not content or (path, title) in seen:
            continue
        seen.add((path, title))
        chapters.append((title, content))
    if not chapters:
        raise EpubError("no chapters")
    return text("title"), text("creator"), chapters
