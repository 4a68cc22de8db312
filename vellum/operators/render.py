"""Rendering of blocks as CommonMark with tables."""

from __future__ import annotations

import re

from ..functions import text as T
from ..plans.model import Document, RenderOptions, plain


class Renderer:
    def __init__(self, options: RenderOptions = RenderOptions(), max_bytes: int = 4 << 20, max_rows: int = 5000):
        self.options, self.max_bytes, self.max_rows = options, max_bytes, max_rows
        self.warnings: list[tuple[str, str]] = []

    # spans

    def inline(self, spans: list[dict], cell: bool = False) -> str:
        return "".join(self._span(s, cell) for s in spans)

    def _span(self, s: dict, cell: bool) -> str:
        kind = s["span"]
        if kind == "text":
            return T.escape(s["text"], cell)
        if kind == "line_break":
            return "<br>" if cell else "  \n"
        if kind == "code":
            ticks = "`" * (T.longest_ticks(s["text"]) + 1)
            pad = " " if "`" in s["text"] else ""
            body = s["text"].replace("|", "\\|") if cell else s["text"]
            return f"{ticks}{pad}{body}{pad}{ticks}"
        inner = self.inline(s.get("inline", []), cell).strip()
        if kind == "link":
            return f"[{inner or T.escape(s['href'], cell)}]({T.escape_url(s['href'])})"
        mark = "*" if kind == "emphasis" else "**"
        return f"{mark}{inner}{mark}" if inner else ""

    # blocks

    def block(self, b: dict, shift: int = 0) -> str:
        return getattr(self, "_" + b["type"])(b, shift).strip("\n")

    def blocks(self, blocks: list[dict], shift: int = 0) -> list[str]:
        return [x for x in (self.block(b, shift) for b in blocks) if x.strip()]

    def _heading(self, b, shift):
        said = self.inline(b["text"]).strip()
        return "#" * min(6, max(1, b["level"] + self.options.heading_offset + shift)) + " " + said if said else ""

    def _paragraph(self, b, shift):
        return self.inline(b["text"]).strip() if plain(b["text"]).strip() else ""

    def _list(self, b, shift):
        out = []
        for i, item in enumerate(b["items"]):
            mark = f"{i + 1}. " if b["ordered"] else "- "
            body = "\n\n".join(Renderer(self.options, self.max_bytes, self.max_rows).blocks(item))
            out.append(mark + re.sub(r"\n(?=[^\n])", "\n" + " " * len(mark), body))
        return "\n".join(out)

    def _quote(self, b, shift):
        body = "\n\n".join(Renderer(self.options, self.max_bytes, self.max_rows).blocks(b["blocks"]))
        return "\n".join(f"> {line}" if line else ">" for line in body.split("\n")) if body else ""

    def _code(self, b, shift):
        mark = T.fence(b["text"])
        return f"{mark}{b.get('language') or ''}\n{b['text'].rstrip(chr(10))}\n{mark}"

    def _raw(self, b, shift):
        return b["text"]

    def _raw_html(self, b, shift):
        if self.options.preserve_unsupported_html:
            return b["text"]
        self.warnings.append(("degraded", "unsupported HTML was dropped"))
        return ""

    def _rule(self, b, shift):
        return "---"

    def _image(self, b, shift):
        alt = b.get("alt") or b.get("caption") or ""
        if b["kind"] in ("url", "resource"):
            said = f"![{T.escape(alt)}]({T.escape_url(b['source'])})"
        else:
            said = f"*[image: {T.escape(b['source'] if b['kind'] == 'embedded' else alt)}]*"
        return f"{said}\n\n*{T.escape(b['caption'])}*" if b.get("alt") and b.get("caption") else said

    def _embedded(self, b, shift):
        return "\n\n".join([f"## {T.escape(b['name'])}", *self.blocks(b["doc"].blocks, shift + 2)])

    def _table(self, b, shift):
        width = max(map(len, [*b["rows"], b["header"] or []]), default=0)
        caption = f"**{T.escape(b['caption'])}**" if b.get("caption") and b["caption"].strip() else ""
        if not width:
            return caption
        rows, extra = b["rows"][: self.max_rows], len(b["rows"]) - self.max_rows
        full = lambda row: [*row, *[[]] * (width - len(row))]
        said = getattr(self, "_as_" + self.options.tables)(full(b["header"]) if b["header"] is not None else None, [full(r) for r in rows], width)
        if extra > 0:
            said += f"\n\n_… {extra} further rows omitted_"
            self.warnings.append(("truncated", f"table truncated to {self.max_rows} of {len(b['rows'])} rows (max_table_rows)"))
        return "\n\n".join(x for x in (caption, said) if x)

    def _as_gfm(self, header, rows, width):
        line = lambda row: "| " + " | ".join(self.inline(c, True).strip() for c in row) + " |"
        return "\n".join([line(header or [[]] * width), "| " + " | ".join(["---"] * width) + " |", *map(line, rows)])

    def _as_html(self, header, rows, width):
        cell = lambda tag, c: f"<{tag}>{T.escape_html(plain(c))}</{tag}>"
        out = ["<table>"]
        if header:
            out += ["<thead><tr>", *(cell("th", c) for c in header), "</tr></thead>"]
        out.append("<tbody>")
        for row in rows:
            out += ["<tr>", *(cell("td", c) for c in row), "</tr>"]
        return "\n".join([*out, "</tbody>", "</table>"])

    def _as_csv(self, header, rows, width):
        body = "\n".join(T.csv_row([plain(c) for c in row]) for row in ([header] if header else []) + rows)
        mark = T.fence(body)
        return f"{mark}csv\n{body}\n{mark}"

    # documents

    def front_matter(self, doc: Document) -> str:
        m = doc.metadata
        pairs = [(k, v) for k, v in [("title", doc.title), ("author", m.author), ("created", m.created), ("modified", m.modified), ("language", m.language), *m.extra] if v]
        if not pairs or self.options.front_matter == "none":
            return ""
        mark, between = ("---", ": ") if self.options.front_matter == "yaml" else ("+++", " = ")
        return "\n".join([mark, *(T.key(k) + between + T.quoted(v) for k, v in pairs), mark])

    def capped(self, pieces: list[str]) -> str:
        """Whole pieces, with a blank line between, as far as the bytes allow."""
        out, size = [], 0
        for piece in pieces:
            size += len(piece.encode("utf-8", "replace")) + 2
            if size > self.max_bytes:
                self.warnings.append(("truncated", f"output truncated at {self.max_bytes} bytes (max_output_bytes)"))
                break
            out.append(piece)
        return "\n\n".join(out)

    def document(self, doc: Document) -> str:
        front = self.front_matter(doc)
        return finished(self.capped([*[front] * bool(front), *self.blocks(doc.blocks)]))


def finished(markdown: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", markdown).rstrip() + "\n" if markdown.strip() else ""
