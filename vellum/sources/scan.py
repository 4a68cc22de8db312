"""Scanners of markup that look at each character once, however the markup is broken."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_XML_NAME = re.compile(r"/?[^\s/>!?<]+")
_QUOTE_OR_END = re.compile(r"[>\"']")
_DOCTYPE_END = re.compile(r"[\[>]")
_SUBSET_END = re.compile(r"\]\s*>")


class _Tags:
    """Finds the ends of tags. A quote that is never closed is a character like others."""

    def __init__(self, source: str):
        self.source, self.last = source, {q: source.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place behind the tag that is open at ``at``, or -1 if it never ends."""
        while m := _QUOTE_OR_END.search(self.source, at):
            at = m.end()
            if m[0] == ">":
                return at
            if self.last[m[0]] >= at:
                at = self.source.index(m[0], at) + 1
        return -1


def html_markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag, and of comments and declarations, which have no
    name. A tag that never ends takes the rest of the page. What is sent is where to go on.
    """
    at, size, tags = 0, len(page), _Tags(page)
    while (at := page.find("<", at)) >= 0:
        name, closes, rest = "", False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else size
            other = page.find("--!>", at + 4, end)
            end = other + 4 if other >= 0 else end
        elif m := _NAME.match(page, at + 1):
            name, closes, end = m[0].lstrip("/").lower(), m[0][0] == "/", tags.end(m.end())
            end, rest = (end, page[m.end() : end - 1]) if end >= 0 else (size, "")
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at) + 1 or size
        else:
            at += 1
            continue
        to = yield at, end, name, closes, rest
        if to is not None:
            yield
        at = to or end


def xml_markup(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, said): kind is open, close, empty (said: name and attributes), cdata (its text) or other."""
    at, size, tags = 0, len(source), _Tags(source)
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4) + 3
            found = "other", ""
        elif source[at : at + 9].upper() == "<![CDATA[":
            end = source.find("]]>", at + 9) + 3
            found = "cdata", source[at + 9 : end - 3 if end > 2 else size]
        elif source.startswith("<?", at):
            end = source.find("?>", at + 2) + 2
            end += end < 2  # not found
            found = "other", ""
        elif source[at : at + 9].upper() == "<!DOCTYPE":
            m = _DOCTYPE_END.search(source, at)
            if m and m[0] == "[":
                m = _SUBSET_END.search(source, m.end())
            end = m.end() if m else 2
            found = "other", ""
        elif m := _XML_NAME.match(source, at + 1):
            end = tags.end(m.end())
            if end < 0:
                return
            said = source[at + 1 : end - 1]
            found = ("close", said[1:]) if said[0] == "/" else ("empty", said[:-1]) if said[-1] == "/" else ("open", said)
        else:
            at += 1
            continue
        end = end if end > 2 else size
        yield at, end, *found
        at = end
