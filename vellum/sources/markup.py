"""Parsers of XML, feeds and HTML. XML has one reader, which resolves no entity that a document declares."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.text import decode_entities, squeeze, unescape
from ..operators.detect import decoded
from ..plans.model import ConvertError, Document, Hints, emphasis, heading, link, paragraph, raw, strong, text
from .scan import html_markup, xml_markup

_TAG_NAME = re.compile(r"[^\s/>!?]+")
_ATTRIBUTE = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


@dataclass
class Node:
    """An element that has closed. ``text`` is its own and, after a space each, its children's."""

    path: tuple[str, ...]
    attributes: dict[str, str]
    text: str = ""
    own: str = ""
    children: int = 0

    @property
    def name(self) -> str:
        return self.path[-1]

    def under(self, name: str) -> bool:
        return name in self.path


def local(name: str) -> str:
    return name.rsplit(":", 1)[-1].lower()


def closed_elements(xml: str) -> Iterator[Node]:
    """Each element as it closes, children first. Unmatched end tags close what is open."""
    stack: list[Node] = []
    at = 0

    def close() -> Node:
        node = stack.pop()
        if stack:
            stack[-1].children += 1
            if node.text:
                stack[-1].text += " " + node.text
        return node

    empty = True
    for start, end, kind, said in xml_markup(xml):
        empty = False
        between = unescape(xml[at:start]) + (said if kind == "cdata" else "")
        at = end
        if stack and between:
            stack[-1].text += between
            stack[-1].own += between
        if kind == "close" and stack:
            yield close()
        elif kind in ("open", "empty"):
            name, attributes = _TAG_NAME.match(said)[0], {}
            for k, a, b in _ATTRIBUTE.findall(said, len(name)):
                attributes.setdefault(local(k), unescape(a or b))
            stack.append(Node((*(stack[-1].path if stack else ()), local(name)), attributes))
            if kind == "empty":
                yield close()
    if empty:
        raise ConvertError("malformed", "malformed xml: no element")
    while stack:
        yield close()


def parse_xml(data: bytes, hints: Hints, cx) -> Document:
    doc = Document()
    for node in closed_elements(decoded(data, hints)):
        own = squeeze(node.own)
        if own:
            doc.blocks.append(paragraph([strong(node.name), *text(f": {own}")]))
        elif node.attributes:
            doc.blocks.append(paragraph([strong(node.name), *text(" (" + ", ".join(f"{k}={v}" for k, v in node.attributes.items()) + ")")]))
    return doc


_FEED = {"title": "title", "link": "link", "pubdate": "date", "updated": "date", "published": "date", "date": "date", "description": "summary", "summary": "summary", "content": "summary", "encoded": "summary"}


def _feed_text(node: Node) -> str:
    said = node.text
    return squeeze(html_lib.unescape(re.sub(r"<[^>]*>", " ", said))) if "<" in said else squeeze(said)


def parse_feed(data: bytes, hints: Hints, cx) -> Document:
    doc, entry = Document(), {}
    for node in closed_elements(decoded(data, hints)):
        if node.name in ("item", "entry"):
            if entry.get("title") or entry.get("link") or entry.get("summary"):
                if entry.get("title"):
                    doc.blocks.append(heading(2, text(entry["title"])))
                if entry.get("link"):
                    doc.blocks.append(paragraph([link(entry["link"], entry["link"])]))
                if entry.get("date"):
                    doc.blocks.append(paragraph([emphasis(entry["date"])]))
                if entry.get("summary"):
                    doc.blocks.append(paragraph(text(entry["summary"])))
            entry = {}
        elif node.under("item") or node.under("entry"):
            kind = _FEED.get(node.name)
            if kind:
                said = node.attributes.get("href") or squeeze(node.text) if kind == "link" else _feed_text(node)
                entry[kind] = entry.get(kind) or said
        elif node.name == "title" and doc.title is None:
            doc.titled(squeeze(node.text))
    return doc


#: Regions that are no prose; one that never ends takes the rest.
STRIP = r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<head(?=[\s>/]).*?(?:</head>|\z)|<!--.*?(?:-->|\z)"
_STRIP = re.compile(STRIP.replace(r"\z", r"\Z"))


def html_title(page: str) -> str | None:
    m = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    return squeeze(decode_entities(m[1])) or None if m else None


def _value(tag: str, name: str) -> str | None:
    m = re.search(rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", tag)
    return next((x for x in m.groups() if x is not None), None) if m else None


def html_meta(page: str) -> list[tuple[str, str]]:
    found = []
    for tag in re.findall(r"(?is)<meta[^>]*>", page):
        name, content = _value(tag, "name") or _value(tag, "property"), _value(tag, "content")
        if name and content:
            found.append((name.lower(), squeeze(decode_entities(content))))
    return found


def strip_non_prose(page: str) -> str:
    return _STRIP.sub("", page)


_VALUES = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class _Markdown:
    """Markdown of a page's body."""

    BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "figure", "figcaption", "address", "dl", "dt", "dd", "body", "html", "fieldset", "details", "summary"}
    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}

    def __init__(self):
        self.out: list[str] = []  # finished blocks of the innermost container
        self.line: list[str] = []
        self.frames: list[tuple] = []
        self.lists: list[list] = []
        self.pre = 0
        self.links: list[str | None] = []
        self.rows: list[list[list[str]]] = []

    def feed(self, page: str, tick=None) -> None:
        at = 0
        for k, (start, end, name, closes, rest) in enumerate(html_markup(page)):
            if tick and k % 1024 == 0:
                tick()
            if start > at:
                self.handle_data(html_lib.unescape(page[at:start]))
            at = end
            if closes and name:
                self.handle_endtag(name)
            elif name:
                self.handle_starttag(name, [(x.lower(), html_lib.unescape(a or b or c)) for x, a, b, c in _VALUES.findall(rest)])
                if rest[-1:] == "/" and (len(rest) == 1 or rest[-2] in " \t\r\n\"'"):
                    self.handle_endtag(name)
        if page[at:]:
            self.handle_data(html_lib.unescape(page[at:]))

    def flush(self) -> None:
        said = "".join(self.line)
        said = said.strip("\n") if self.pre else re.sub(r" *\0 *", "  \n", re.sub(r" *\n *", "\n", re.sub(r"[ \t\r\f\v]+", " ", said))).strip()
        self.line = []
        if said and not re.fullmatch(r"[*\s]*", said):
            self.out.append(said)

    def _open(self, kind: str) -> None:
        self.flush()
        self.frames.append((kind, self.out))
        self.out = []

    def _close(self, kind: str) -> list[str] | None:
        if not any(f[0] == kind for f in self.frames):
            return None
        self.flush()
        while True:
            inner, (k, outer) = self.out, self.frames.pop()
            if k == kind:
                self.out = outer
                return inner
            self.out = outer + inner

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in self.BLOCKS or re.fullmatch("h[1-6]", tag):
            self.flush()
            if tag[0] == "h" and tag[1:].isdigit():
                self.line.append("#" * int(tag[1]) + " ")
        elif tag == "blockquote":
            self._open("blockquote")
        elif tag in ("ul", "ol"):
            self._open(tag)
            self.lists.append([tag, int(values.get("start") or 1) if str(values.get("start") or 1).isdigit() else 1])
        elif tag == "li":
            if self.frames and self.frames[-1][0] == "li":
                self.handle_endtag("li")
            self._open("li")
        elif tag == "br":
            self.line.append("\n" if self.pre else "\0")
        elif tag == "hr":
            self.flush()
            self.out.append("* * *")
        elif tag == "pre":
            self._open("pre")
            self.pre += 1
        elif tag == "table":
            self._open("table")
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in ("td", "th") and self.rows:
            if self.frames and self.frames[-1][0] == "cell":
                self.handle_endtag("td")
            self._open("cell")
        elif tag in self.MARKS:
            self.line.append(self.MARKS[tag])
        elif tag == "code" and not self.pre:
            self.line.append("`")
        elif tag == "a":
            self.links.append(values.get("href"))
            self.line.append("[" if values.get("href") else "")
        elif tag == "img" and values.get("src"):
            self.line.append(f"![{values.get('alt') or ''}]({values['src']})")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS or re.fullmatch("h[1-6]", tag):
            self.flush()
        elif tag == "blockquote" and (inner := self._close(tag)):
            self.out.append("\n".join(f"> {x}" if x else ">" for x in "\n\n".join(inner).split("\n")))
        elif tag == "li" and (inner := self._close(tag)) is not None:
            if self.lists:
                kind, n = self.lists[-1]
                mark = "*   " if kind == "ul" else f"{n}. ".ljust(4)
                self.lists[-1][1] += 1
                if not inner:
                    self.out.append(mark.rstrip())
                    return
                self.out.append(mark + re.sub(r"\n(?=[^\n])", "\n    ", "\n".join(inner) if len(inner) < 2 or inner[1][:1] in "*123456789" else "\n\n".join(inner)))
        elif tag in ("ul", "ol"):
            if self.frames and any(f[0] == "li" for f in self.frames) and self.frames[-1][0] == "li" and self.frames[-2:-1] and self.frames[-2][0] == tag:
                self.handle_endtag("li")
            inner = self._close(tag)
            if inner is not None:
                self.lists.pop()
                if inner:
                    self.out.append("\n".join(inner))
        elif tag == "pre" and (inner := self._close(tag)) is not None:
            self.pre -= 1
            self.out.append("```\n" + "\n".join(inner) + "\n```")
        elif tag in ("td", "th") and self.rows and (inner := self._close("cell")) is not None:
            if not self.rows[-1]:
                self.rows[-1].append([])
            self.rows[-1][-1].append(" ".join(" ".join(inner).split()).replace("|", "\\|"))
        elif tag == "table" and (self._close("table")) is not None:
            rows = [r for r in self.rows.pop() if r]
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                wide = [max(3, *(len(r[i]) for r in rows)) if any(len(r[i]) > 3 for r in rows) else max(len(r[i]) for r in rows) or 3 for i in range(width)]
                line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, wide)) + " |"
                self.out.append("\n".join([line(rows[0]), "| " + " | ".join("-" * w for w in wide) + " |", *map(line, rows[1:])]))
        elif tag in self.MARKS:
            self.line.append(self.MARKS[tag])
        elif tag == "code" and not self.pre:
            self.line.append("`")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.line.append(f"]({href})" if href else "")

    def handle_data(self, data):
        data = data.replace("\0", "\ufffd")
        self.line.append(data if self.pre else re.sub(r"\s+", " ", re.sub(r"[\\`*_\[\]]", r"\\\g<0>", data)))


def html_to_markdown(page: str, tick=None) -> str:
    """``tick`` is called now and then, and may raise."""
    parser = _Markdown()
    parser.feed(page, tick)
    for kind, _ in reversed(list(parser.frames)):
        if kind in ("li", "ul", "ol") and parser.frames and parser.frames[-1][0] == kind:
            parser.handle_endtag(kind)
    parser.flush()
    while parser.frames:
        parser.out = parser.frames.pop()[1] + parser.out
    return "\n\n".join(parser.out)


def parse_html(data: bytes, hints: Hints, cx) -> Document:
    page = decoded(data, hints)
    doc = Document().titled(html_title(page))
    for name, content in html_meta(page):
        if name == "author":
            doc.metadata.author = content
        elif name in ("description", "keywords"):
            doc.metadata.put(name, content)
    body = html_to_markdown(strip_non_prose(page), cx.budget.check_time).strip()
    if body:
        doc.blocks.append(raw(body))
    else:
        doc.warn("no_text_layer", "the page has no text")
    return doc
