"""Small documents of every format, built here."""

from __future__ import annotations

import io
import struct
import zipfile


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx(body: str, core: str | None = None, links: dict[str, str] | None = None, more: dict[str, str] | None = None) -> bytes:
    parts = {"[Content_Types].xml": "<Types/>", "word/document.xml": f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>'}
    if core:
        parts["docProps/core.xml"] = f'<cp:coreProperties xmlns:cp="http://x" xmlns:dc="http://d" xmlns:dcterms="http://t">{core}</cp:coreProperties>'
    if links:
        parts["word/_rels/document.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in links.items()) + "</Relationships>"
    return zipped(parts | (more or {}))


def run(text: str, *marks: str) -> str:
    props = "<w:rPr>" + "".join(f"<w:{m}/>" for m in marks) + "</w:rPr>" if marks else ""
    return f"<w:r>{props}<w:t>{text}</w:t></w:r>"


def para(*runs: str, style: str = "", numbered: bool = False) -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ('<w:numPr><w:ilvl w:val="0"/></w:numPr>' if numbered else "")
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{''.join(runs)}</w:p>"


def word_table(*rows: list[str]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(run(c))}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def slide(*lines: str) -> str:
    return "<p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:txBody>"


def pptx(slides: list[str], notes: dict[int, str] | None = None) -> bytes:
    wrap = lambda tag, body: f'<p:{tag} xmlns:p="http://p" xmlns:a="http://a">{body}</p:{tag}>'
    parts = {f"ppt/slides/slide{i}.xml": wrap("sld", s) for i, s in enumerate(slides, 1)}
    return zipped(parts | {f"ppt/notesSlides/notesSlide{n}.xml": wrap("notes", s) for n, s in (notes or {}).items()})


def epub(chapters: dict[str, tuple[str, str]], spine: list[str]) -> bytes:
    items = "".join(f'<item id="{k}" href="{k}.xhtml" media-type="application/xhtml+xml"/>' for k in chapters)
    refs = "".join(f'<itemref idref="{k}"/>' for k in spine)
    parts = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
        "OEBPS/book.opf": f'<package><metadata xmlns:dc="http://d"><dc:title>A Book</dc:title><dc:creator>Mira</dc:creator></metadata><manifest>{items}<item id="toc" href="nav.xhtml" properties="nav"/></manifest><spine>{refs}</spine></package>',
    }
    return zipped(parts | {f"OEBPS/{k}.xhtml": f"<html><body><h1>{t}</h1><p>{p}</p></body></html>" for k, (t, p) in chapters.items()})


def xlsx(sheets: dict[str, str], shared: list[str] = (), date_style: bool = True) -> bytes:
    names = list(sheets)
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>",
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    }
    return zipped(parts | {f"xl/worksheets/s{i}.xml": f"<worksheet><sheetData>{sheets[n]}</sheetData></worksheet>" for i, n in enumerate(names)})


Cell = str | float | bool


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def xls(sheets: dict[str, list[list[Cell]]], date_columns: tuple[int, ...] = ()) -> bytes:
    """An old workbook: strings shared, whole numbers short, others long; errors begin with #, formulas with =."""
    strings: list[str] = []
    text = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    bodies = []
    for rows in sheets.values():
        out = _record(0x809, bytes(16))
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                place = struct.pack("<HHH", r, c, int(c in date_columns and r > 0))
                if isinstance(v, bool):
                    out += _record(0x205, place + bytes([v, 0]))
                elif isinstance(v, int):
                    out += _record(0x27E, place + struct.pack("<i", v << 2 | 2))
                elif isinstance(v, float):
                    out += _record(0x203, place + struct.pack("<d", v))
                elif v.startswith("#"):
                    out += _record(0x205, place + bytes([0x2A, 1]))
                elif v.startswith("="):
                    out += _record(0x06, place + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + _record(0x207, text(v[1:]))
                elif v:
                    strings.append(v)
                    out += _record(0xFD, place + struct.pack("<I", len(strings) - 1))
        bodies.append(out + _record(0x0A, b""))
    shared = b"".join(text(s) for s in strings)
    middle = _record(0xE0, bytes(20)) + _record(0xE0, struct.pack("<HH", 0, 14) + bytes(16))
    middle += _record(0xFC, struct.pack("<II", len(strings), len(strings)) + shared) + _record(0x0A, b"")
    names = [struct.pack("<BB", 0, 0) + struct.pack("<BB", len(n), 1) + n.encode("utf-16-le") for n in sheets]
    at = len(_record(0x809, bytes(16))) + sum(8 + len(n) for n in names) + len(middle)
    head = _record(0x809, bytes(16))
    for n, b in zip(names, bodies):
        head += _record(0x85, struct.pack("<I", at) + n)
        at += len(b)
    return compound({"Workbook": head + middle + b"".join(bodies)})


def xlsb(sheets: dict[str, list[list[Cell]]], date_columns: tuple[int, ...] = ()) -> bytes:
    def record(kind: int, body: bytes = b"") -> bytes:
        head = bytes([kind]) if kind < 128 else bytes([kind & 127 | 128, kind >> 7])
        n = len(body)
        return head + (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])) + body

    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    strings: list[str] = []
    parts = {}
    for k, rows in enumerate(sheets.values()):
        out = b""
        for r, row in enumerate(rows):
            out += record(0, struct.pack("<I", r) + bytes(13))
            for c, v in enumerate(row):
                place = struct.pack("<II", c, int(c in date_columns and r > 0))
                if isinstance(v, bool):
                    out += record(4, place + bytes([v]))
                elif isinstance(v, int):
                    out += record(2, place + struct.pack("<i", v << 2 | 2))
                elif isinstance(v, float):
                    out += record(5, place + struct.pack("<d", v))
                elif v.startswith("#"):
                    out += record(3, place + b"\x2a")
                elif v.startswith("="):
                    out += record(8, place + wide(v[1:]))
                elif v:
                    strings.append(v)
                    out += record(7, place + struct.pack("<I", len(strings) - 1))
        parts[f"xl/worksheets/s{k}.bin"] = out
    book = b"".join(record(156, struct.pack("<II", 0, k + 1) + wide(f"r{k}") + wide(n)) for k, n in enumerate(sheets))
    xf = lambda number: record(47, struct.pack("<HH", 0, number) + bytes(12))
    return zipped({
        "xl/workbook.bin": book,
        "xl/_rels/workbook.bin.rels": "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.bin"/>' for k in range(len(sheets))) + "</Relationships>",
        "xl/sharedStrings.bin": b"".join(record(19, b"\0" + wide(s)) for s in strings),
        "xl/styles.bin": record(617) + xf(0) + xf(14) + record(618),
        **parts,
    })


def pdf(*pages: list[str], info: dict[str, str] | None = None) -> bytes:
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>"]
    for i, lines in enumerate(pages):
        content = "BT /F1 12 Tf 72 720 Td" + "".join((" 0 -18 Td" if k else "") + f" ({line}) Tj" for k, line in enumerate(lines)) + " ET" if lines else ""
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>", f"<< /Length {len(content)} >>\nstream\n{content}\nendstream"]
    about = ""
    if info:  # the first value as a literal string, others in UTF-16
        said = [f"({v})" if k == 0 else f"<FEFF{v.encode('utf-16-be').hex()}>" for k, v in enumerate(info.values())]
        objects.append("<< " + " ".join(f"/{k} {v}" for k, v in zip(info, said)) + " >>")
        about = f" /Info {len(objects)} 0 R"
    body = "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1))
    return f"%PDF-1.4\n{body}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R{about} >>\n%%EOF\n".encode()


def pdf_with_fonts(mapped: str, differing: str) -> bytes:
    """One page: a line in a font whose two-byte codes only its map tells, and one whose encoding names its glyphs."""
    codes = {c: k for k, c in enumerate(dict.fromkeys(mapped), 1)}
    units = lambda c: c.encode("utf-16-be").hex().upper()
    cmap = "begincmap\n" + f"{len(codes)} beginbfchar\n" + "\n".join(f"<{k:04X}> <{units(c)}>" for c, k in codes.items()) + "\nendbfchar\nendcmap"
    own = {c: k for k, c in enumerate(dict.fromkeys(differing), 128)}
    names = " ".join(f"/uni{ord(c):04X}" for c in own)
    content = f"BT /F1 12 Tf 72 720 Td <{''.join(f'{codes[c]:04X}' for c in mapped)}> Tj 0 -18 Td /F2 12 Tf <{''.join(f'{own[c]:02X}' for c in differing)}> Tj ET"
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>",
        "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 7 0 R >> >> >>",
        "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        f"<< /Length {len(content)} >>\nstream\n{content}\nendstream",
        "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R >>",
        f"<< /Length {len(cmap)} >>\nstream\n{cmap}\nendstream",
        f"<< /Type /Font /Subtype /Type1 /Encoding << /Type /Encoding /Differences [ 128 {names} ] >> >>",
    ]
    body = "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1))
    return f"%PDF-1.4\n{body}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\n%%EOF\n".encode()


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\1\0\0\0\1\x08\6\0\0\0\x1f\x15\xc4\x89\0\0\0\0IEND\xaeB`\x82"


def jpeg_exif(fields: dict[int, str]) -> bytes:
    at = 8 + 2 + 12 * len(fields) + 4
    entries, tail = b"", b""
    for tag, said in sorted(fields.items()):
        raw = said.encode() + b"\0"
        raw += b"\0" * max(0, 5 - len(raw))
        entries += struct.pack("<HHII", tag, 2, len(raw), at + len(tail))
        tail += raw
    tiff = b"II*\0" + struct.pack("<IH", 8, len(fields)) + entries + struct.pack("<I", 0) + tail
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def wav(samples: int) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + samples, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", samples)
    return head + b"\x80" * samples


def compound(streams: dict[str, bytes]) -> bytes:
    """An OLE file whose streams all stand in sectors of their own."""
    free, end = 0xFFFFFFFF, 0xFFFFFFFE
    bodies = [b.ljust(4096, b"\0") for b in streams.values()]
    n_dir = -(-(len(streams) + 1) // 4)
    fat = [0xFFFFFFFD, *[i + 2 if i + 1 < n_dir else end for i in range(n_dir)]]
    starts = []
    for b in bodies:
        starts.append(len(fat))
        n = len(b) // 512
        fat += [len(fat) + 1 + k if k + 1 < n else end for k in range(n)]
    assert len(fat) <= 128
    entry = lambda name, kind, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, free, free, free)).ljust(116, b"\0") + struct.pack("<IQ", start, size)
    directory = entry("Root Entry", 5, end, 0) + b"".join(entry(n, 2, s, 4096) for n, s in zip(streams, starts))
    head = (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6)).ljust(44, b"\0")
    head += struct.pack("<IIIIIIII", 1, 1, 0, 4096, end, 0, end, 0) + struct.pack("<I", 0) + struct.pack("<108I", *[free] * 108)
    return head + struct.pack("<128I", *fat, *[free] * (128 - len(fat))) + directory.ljust(512 * n_dir, b"\0") + b"".join(bodies)


def message(**fields: str) -> bytes:
    tags = {"subject": "0037", "body": "1000", "sender": "0C1A", "to": "0E04", "attachment": "3707"}
    return compound({f"__substg1.0_{tags[k]}001F": v.encode("utf-16-le") for k, v in fields.items()})
