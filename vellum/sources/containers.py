"""Parsers of zipped formats: Word, PowerPoint, spreadsheets, EPUB and plain archives."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections import defaultdict
from dataclasses import replace

from ..functions.text import safe_name, squeeze
from ..plans.model import ConvertError, Document, Hints, heading, link, malformed, paragraph, plain, strong, emphasis, table, text
from .binary import compound_streams
from .markup import Node, closed_elements
from .workbooks import ERROR_NAMES, Grid, format_kind, number_text, xls_sheets, xlsb_sheets


def opened(data: bytes, form: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except Exception as e:
        raise malformed(form, str(e)) from e


def part(archive: zipfile.ZipFile, name: str, cx, form: str) -> str | None:
    """A member as text."""
    raw = raw_part(archive, name, cx, form)
    return None if raw is None else raw.decode("utf-8", "replace")


def raw_part(archive: zipfile.ZipFile, name: str, cx, form: str) -> bytes | None:
    """A member; what it expands to is charged, whatever size it declares."""
    try:
        info = archive.getinfo(name)
    except KeyError:
        return None
    if info.flag_bits & 1:
        raise ConvertError("encrypted", f"{form} is encrypted")
    try:
        with archive.open(info) as f:
            raw = f.read(cx.budget.left + 1)
    except (RuntimeError, NotImplementedError, zipfile.BadZipFile, OSError, EOFError) as e:
        raise malformed(form, f"{name}: {e}") from e
    cx.budget.expand(len(raw))
    return raw


def core_properties(xml: str | None, doc: Document) -> None:
    for node in closed_elements(xml) if xml else ():
        said = squeeze(node.text)
        if not said or node.children:
            continue
        if node.name == "title":
            doc.titled(said)
        elif node.name == "creator":
            doc.metadata.author = said
        elif node.name in ("created", "modified", "language"):
            setattr(doc.metadata, node.name, said)
        elif node.name in ("keywords", "subject", "category"):
            doc.metadata.put(node.name, said)


def relationships(xml: str | None) -> dict[str, str]:
    return {n.attributes["id"]: n.attributes["target"] for n in (closed_elements(xml) if xml else ()) if n.name == "relationship" and {"id", "target"} <= set(n.attributes)}


#: Paragraph styles of lists, without spaces, marks and digits at their ends.
ORDERED = {"listnumber", "listnum", "numberedlist"}
UNORDERED = {"listbullet", "listparagraph", "list", "bulletlist", "bullet"}


def _style(name: str) -> tuple[str, object]:
    plain_name = re.sub(r"[ _-]", "", name.lower())
    m = re.fullmatch(r"heading([1-6])", plain_name)
    if m or plain_name in ("title", "subtitle"):
        return "heading", int(m[1]) if m else {"title": 1, "subtitle": 2}[plain_name]
    bare = plain_name.rstrip("0123456789")
    return ("list", bare in ORDERED) if bare in ORDERED | UNORDERED else ("", None)


class _Word:
    """Blocks from the elements of a Word part, as they close."""

    def __init__(self, links: dict[str, str]):
        self.links, self.blocks = links, []
        # Of each table that is open, by depth: its rows, the row's cells, the cell's paragraphs.
        self.rows: dict[int, list[list[str]]] = defaultdict(list)
        self.row: dict[int, list[str]] = defaultdict(list)
        self.cell: dict[int, list[str]] = defaultdict(list)
        self.new_paragraph()
        self.reset_run()

    def new_paragraph(self) -> None:
        self.runs: list[tuple[str, bool, bool, str | None]] = []
        self.style, self.numbered = "", False

    def reset_run(self) -> None:
        self.bold = self.italic = False
        self.said = ""

    def visit(self, node: Node) -> None:
        name, a = node.name, node.attributes
        if name == "pstyle":
            self.style = a.get("val", "")
        elif name == "numpr":
            self.numbered = True
        elif name in ("b", "i") and node.under("rpr") and node.under("r"):
            setattr(self, "bold" if name == "b" else "italic", True)
        elif name == "t":
            self.said += node.own
        elif name in ("tab", "br") and node.under("r"):
            self.said += " " if name == "tab" else "\n"
        elif name == "r":
            if self.said:
                self.runs.append((self.said, self.bold, self.italic, "?" if node.under("hyperlink") else None))
            self.reset_run()
        elif name == "hyperlink":
            href = self.links.get(a.get("id", ""))
            k = len(self.runs)
            while k and self.runs[k - 1][3] == "?":
                k -= 1
            linked = self.runs[k:]
            self.runs[k:] = [("".join(r[0] for r in linked), False, False, href)] if href and linked else [(*r[:3], None) for r in linked]
        elif name == "p":
            self.paragraph(node)
        elif name in ("tc", "tr", "tbl"):
            depth = node.path.count("tbl")
            if name == "tc":
                self.row[depth].append("\n".join(self.cell.pop(depth, [])))
            elif name == "tr":
                self.rows[depth].append(self.row.pop(depth, []))
            elif rows := self.rows.pop(depth, []):
                if depth == 1:
                    self.blocks.append(table(rows[1:], rows[0]))
                else:
                    self.cell[depth - 1] += [" ".join(r) for r in rows]

    def paragraph(self, node: Node) -> None:
        spans: list[dict] = []
        for said, bold, italic, href in self.runs:
            if href:
                spans.append(link(said, href))
            elif bold or italic:
                spans += [strong(said) if bold else emphasis(said)] if said.strip() == said else [*text(said[: len(said) - len(said.lstrip())]), strong(said.strip()) if bold else emphasis(said.strip()), *text(said[len(said.rstrip()) :])]
            else:
                spans += text(said)
        style, numbered = self.style, self.numbered
        self.new_paragraph()
        if node.under("tbl"):
            if plain(spans).strip():
                self.cell[node.path.count("tbl")].append(plain(spans).strip())
            return
        if not plain(spans).strip():
            return
        kind, value = _style(style)
        if kind == "heading":
            self.blocks.append(heading(value, spans))
        elif kind == "list" or numbered:
            ordered = bool(value) if kind == "list" else False
            if self.blocks and self.blocks[-1]["type"] == "list" and self.blocks[-1]["ordered"] == ordered:
                self.blocks[-1]["items"].append([paragraph(spans)])
            else:
                self.blocks.append({"type": "list", "ordered": ordered, "items": [[paragraph(spans)]]})
        else:
            self.blocks.append(paragraph(spans))


def parse_docx(data: bytes, hints: Hints, cx) -> Document:
    archive = opened(data, "docx")
    body = part(archive, "word/document.xml", cx, "docx")
    if body is None:
        raise malformed("docx", "no word/document.xml")
    doc = Document()
    core_properties(part(archive, "docProps/core.xml", cx, "docx"), doc)
    walker = _Word(relationships(part(archive, "word/_rels/document.xml.rels", cx, "docx")))
    for node in closed_elements(body):
        walker.visit(node)
    doc.blocks = walker.blocks
    if re.search(r"<(?:\w+:)?(?:drawing|pict)\b", body):
        doc.warn("degraded", "images in the document were left out")
    for name, title in (("word/footnotes.xml", "Footnotes"), ("word/endnotes.xml", "Endnotes")):
        xml = part(archive, name, cx, "docx")
        notes = [paragraph(text(said)) for n in closed_elements(xml) if n.name == "p" and (said := squeeze(n.text))] if xml else []
        doc.blocks += [heading(2, text(title)), *notes] if notes else []
    return doc


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def _slide(xml: str) -> list[dict]:
    blocks, rows, row, cell, said = [], [], [], [], ""
    for n in closed_elements(xml):
        if n.name == "t":
            said += n.own
        elif n.name == "br":
            said += " "
        elif n.name == "p":
            said = squeeze(said)
            if n.under("tbl"):
                cell.append(said)
            elif said:
                blocks.append(paragraph(text(said)))
            said = ""
        elif n.name == "tc":
            row.append("\n".join(x for x in cell if x))
            cell = []
        elif n.name == "tr":
            rows.append(row)
            row = []
        elif n.name == "tbl":
            if rows:
                blocks.append(table(rows[1:], rows[0]))
            rows = []
    return blocks


def parse_pptx(data: bytes, hints: Hints, cx) -> Document:
    archive = opened(data, "pptx")
    slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
    if not slides:
        raise malformed("pptx", "no slides")
    doc = Document()
    core_properties(part(archive, "docProps/core.xml", cx, "pptx"), doc)
    for name in slides:
        cx.budget.check_time()
        n = _number(name)
        blocks = _slide(part(archive, name, cx, "pptx") or "")
        doc.titled(next((plain(b["text"]) for b in blocks if b["type"] == "paragraph"), None) if not doc.title else None)
        doc.blocks += [heading(2, text(f"Slide {n}")), *blocks]
        notes = part(archive, f"ppt/notesSlides/notesSlide{n}.xml", cx, "pptx")
        said = [b for b in _slide(notes) if b["type"] == "paragraph"] if notes else []
        if said:
            doc.blocks.append({"type": "quote", "blocks": [paragraph([strong("Speaker notes")]), *said]})
    return doc


def _xlsx_sheets(archive, cx):
    get = lambda name: part(archive, name, cx, "spreadsheet")
    book = get("xl/workbook.xml")
    if book is None:
        raise malformed("spreadsheet", "no xl/workbook.xml")
    rels = relationships(get("xl/_rels/workbook.xml.rels"))
    shared = ["".join(x) for x in _shared(get("xl/sharedStrings.xml"))]
    styles, custom, in_cells = [], {}, False
    for m in re.finditer(r"<(?:\w+:)?(numFmt|cellXfs|xf)\b([^>]*)>|</(?:\w+:)?cellXfs>", get("xl/styles.xml") or ""):
        value = lambda k: (re.search(rf'\b{k}="([^"]*)"', m[2] or "") or [None, ""])[1]  # noqa: B023, E731
        if m[1] == "numFmt":
            custom[int(value("numFmtId") or 0)] = value("formatCode")
        elif m[1] == "xf" and in_cells:
            k = int(value("numFmtId") or 0)
            styles.append(format_kind(k, custom.get(k)))
        else:
            in_cells = m[1] == "cellXfs"
    elements = list(closed_elements(book))
    since_1904 = any(n.name == "workbookpr" and n.attributes.get("date1904") in ("1", "true") for n in elements)
    for node in elements:
        if node.name == "sheet":
            path = _target(rels.get(node.attributes.get("id", ""), ""))
            yield node.attributes.get("name", ""), _xlsx_grid(get(path) or "", shared, styles, since_1904, cx.limits.max_table_rows + 1)


def _target(target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def _shared(xml: str | None):
    texts: list[str] = []
    for n in closed_elements(xml) if xml else ():
        if n.name == "t" and not n.under("rph"):
            texts.append(n.own)
        elif n.name == "si":
            yield texts
            texts = []


def _xlsx_grid(xml: str, shared: list[str], styles: list[str], since_1904: bool, most: int) -> Grid:
    grid, row, col = Grid(most), 0, -1
    value, inline = "", ""
    for n in closed_elements(xml):
        if n.name == "v":
            value = n.own
        elif n.name == "t" and n.under("is"):
            inline += n.own
        elif n.name == "c":
            kind, at = n.attributes.get("t", "n"), re.match(r"([A-Z]*)(\d*)", n.attributes.get("r", ""))
            if at[1]:
                col = 0
                for c in at[1]:
                    col = 26 * col + ord(c) - 64
                col -= 1
            else:
                col += 1
            row = int(at[2]) - 1 if at[2] else row
            said = value
            if kind == "s":
                said = shared[int(value)] if value.strip().isdigit() and int(value) < len(shared) else value
            elif kind == "inlineStr":
                said = inline
            elif kind == "b":
                said = "true" if value.strip() == "1" else "false"
            elif kind == "e":
                said = ERROR_NAMES.get(value.strip(), value)
            elif kind == "n" and value.strip():
                style = n.attributes.get("s", "")
                try:
                    said = number_text(float(value), styles[int(style)] if style.isdigit() and int(style) < len(styles) else "", since_1904)
                except (ValueError, OverflowError):
                    pass
            grid.put(row, col, said)
            value = inline = ""
        elif n.name == "row":
            row = (int(n.attributes["r"]) if n.attributes.get("r", "").isdigit() else row + 1)
            col = -1
    return grid


def _times(attributes: dict[str, str], name: str) -> int:
    said = attributes.get(name, "")
    return int(said) if said.isdigit() else 1


def _ods_sheets(archive, cx):
    xml = part(archive, "content.xml", cx, "spreadsheet") or ""
    most = cx.limits.max_table_rows + 1
    grid, row, at, column, cell = Grid(most), [], 0, 0, []
    for n in closed_elements(xml):
        a = n.attributes
        if n.name == "p" and n.under("table-cell"):
            cell.append(squeeze(n.text))
        elif n.name in ("table-cell", "covered-table-cell"):
            kind = a.get("value-type")
            said = number_text(float(a["value"])) if kind in ("float", "currency", "percentage") and "value" in a else a.get("date-value") if kind == "date" else a.get("boolean-value") if kind == "boolean" else None
            said = said or "\n".join(cell)
            times = _times(a, "number-columns-repeated")
            if said:
                row += [(column + k, said) for k in range(min(times, 1 << 14))]
            column += times
            cell = []
        elif n.name == "table-row":
            times = _times(a, "number-rows-repeated")
            if row:
                for k in [*range(min(times, most)), times - 1]:  # rows that are only counted need no cells but the last's
                    for c, said in row:
                        grid.put(at + k, c, said)
            at, row, column = at + times, [], 0
        elif n.name == "table":
            yield a.get("name", ""), grid
            grid, at = Grid(most), 0


def _workbook_sheets(data: bytes, cx):
    """Name and cells of each sheet, of whichever kind of workbook."""
    most, tick = cx.limits.max_table_rows + 1, cx.budget.check_time
    if not data.startswith(b"PK"):
        streams = dict(compound_streams(data))
        if "EncryptedPackage" in streams:
            raise ConvertError("encrypted", "spreadsheet is encrypted")
        if "Workbook" not in streams:
            raise malformed("spreadsheet", "no workbook in the compound file")
        return xls_sheets(streams["Workbook"], most, tick)
    archive = opened(data, "spreadsheet")
    names = archive.namelist()
    if "xl/workbook.bin" in names:
        rels = relationships(part(archive, "xl/_rels/workbook.bin.rels", cx, "spreadsheet"))
        return xlsb_sheets(lambda name: raw_part(archive, name, cx, "spreadsheet"), rels, _target, most, tick)
    return _ods_sheets(archive, cx) if "content.xml" in names else _xlsx_sheets(archive, cx)


def parse_spreadsheet(data: bytes, hints: Hints, cx) -> Document:
    doc = Document().titled(hints.filename)
    for name, grid in _workbook_sheets(data, cx):
        cx.budget.check_time()
        cx.budget.expand(grid.height * grid.width)
        doc.blocks.append(heading(2, text(name)))
        kept = list(grid.rows())
        while kept and not any(c.strip() for c in kept[-1]):
            kept.pop()
        if not kept:
            doc.blocks.append(paragraph(text("(empty sheet)")))
            continue
        if grid.height > cx.limits.max_table_rows:
            doc.warn("truncated", f"sheet {name}: {grid.height} rows, capped at {cx.limits.max_table_rows}")
        head = len(kept) > 1 and any(c.strip() for c in kept[0])
        doc.blocks.append(table(kept[1:] if head else kept, kept[0] if head else None))
    return doc


def parse_epub(data: bytes, hints: Hints, cx) -> Document:
    archive = opened(data, "epub")
    container = part(archive, "META-INF/container.xml", cx, "epub")
    root = next((n.attributes.get("full-path") for n in closed_elements(container) if n.name == "rootfile"), None) if container else None
    package = part(archive, root, cx, "epub") if root else None
    if package is None:
        raise malformed("epub", "no package")
    doc, items, spine, skip = Document(), {}, [], set()
    for n in closed_elements(package):
        a, said = n.attributes, squeeze(n.text)
        if n.name == "item" and "id" in a:
            items[a["id"]] = a.get("href", "")
            if "nav" in a.get("properties", "").split() or a.get("media-type") == "application/x-dtbncx+xml":
                skip.add(a["id"])
        elif n.name == "itemref":
            spine.append(a.get("idref", ""))
        elif n.under("metadata") and said:
            if n.name == "title" and not doc.title:
                doc.titled(said)
            elif n.name == "creator":
                doc.metadata.author = doc.metadata.author or said
            elif n.name == "language":
                doc.metadata.language = doc.metadata.language or said
            elif n.name == "date":
                doc.metadata.created = doc.metadata.created or said
    for ref in spine:
        cx.budget.check_time()
        if ref in skip:
            continue
        href = items.get(ref)
        path = posixpath.normpath(posixpath.join(posixpath.dirname(root), href.split("#")[0])) if href else None
        xml = part(archive, path, cx, "epub") if path else None
        if xml is None:
            doc.warn("skipped_member", f"{href or ref} is in the reading order but not in the book")
            continue
        quiet = 0
        for n in closed_elements(xml):
            said = squeeze(n.text)
            if re.fullmatch("h[1-6]", n.name) and said:
                doc.blocks.append(heading(int(n.name[1]), text(said)))
            elif n.name in ("p", "blockquote", "li") and said:
                inner = n.name != "p" and quiet
                if not inner:
                    doc.blocks.append(paragraph(text(said)))
            if n.name == "p" and (n.under("li") or n.under("blockquote")):
                quiet = 1
            elif n.name in ("li", "blockquote"):
                quiet = 0
    return doc


def parse_zip(data: bytes, hints: Hints, cx) -> Document:
    archive, doc = opened(data, "zip"), Document().titled(hints.filename)
    if cx.depth + 1 > cx.limits.max_depth:
        doc.warn("skipped_member", f"archive nested deeper than {cx.limits.max_depth} (max_depth)")
        return doc
    for info in archive.infolist():
        cx.budget.check_time()
        name = safe_name(info.filename)
        if info.is_dir():
            continue
        if info.flag_bits & 1:
            doc.warn("skipped_member", f"{name}: encrypted")
            continue
        if not cx.budget.embed():
            doc.warn("truncated", f"only {cx.limits.max_embedded_documents} members converted (max_embedded_documents)")
            break
        left = cx.budget.left
        if info.file_size > left or not left:
            doc.warn("skipped_member", f"{name}: expands beyond the budget (max_expanded_bytes)")
            continue
        try:
            with archive.open(info) as f:
                body = f.read(left + 1)
        except Exception as e:
            doc.warn("skipped_member", f"{name}: {e}")
            continue
        if len(body) > left:
            doc.warn("skipped_member", f"{name}: expands beyond the budget (max_expanded_bytes)")
            continue
        cx.budget.expand(len(body))
        try:
            inner = cx.convert(body, Hints.of(filename=name), replace(cx, depth=cx.depth + 1))
        except ConvertError as e:
            if e.code == "limit_exceeded":
                raise
            doc.warn("skipped_member", f"{name}: {e.message}")
            continue
        doc.warnings += [(k, f"{name}: {m}") for k, m in inner.warnings]
        doc.blocks.append({"type": "embedded", "name": name, "doc": inner})
    return doc
