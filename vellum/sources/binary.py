"""Parsers of PDF, images, audio and Outlook messages."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

from ..functions.text import heading_level, page_list, rejoin
from ..plans.model import ConvertError, Document, Hints, heading, malformed, paragraph, strong, table, text

# PDF

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)


class _Pdf:
    def __init__(self, data: bytes, cx):
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        self.trailer = data[data.rfind(b"trailer") :] if b"trailer" in data else data
        self.cx, self.known = cx, {}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                self._unpack(body)
        if re.search(rb"/Encrypt\b", self.trailer) or any(b"/Encrypt" in b and b"/XRef" in b for b in self.objects.values()):
            raise ConvertError("encrypted", "the PDF is encrypted")

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        raw = m[1]
        if b"FlateDecode" in body[: m.start()]:
            d = zlib.decompressobj()
            try:
                raw = d.decompress(raw, self.cx.budget.left + 1)
            except zlib.error:
                return b""
            self.cx.budget.expand(len(raw))
        return raw

    def _unpack(self, body: bytes) -> None:
        raw, n, first = self.stream(body), re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
        if not (raw and n and first):
            return
        numbers = list(map(int, raw[: int(first[1])].split()))[: 2 * int(n[1])]
        starts = [*numbers[1::2], len(raw) - int(first[1])]
        for k, number in enumerate(numbers[::2]):
            self.objects.setdefault(number, raw[int(first[1]) + starts[k] : int(first[1]) + starts[k + 1]])

    def refs(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def value(self, body: bytes, key: bytes) -> bytes:
        """What ``key`` names in a dictionary: a referenced object, an inner dictionary or array, or a name or number."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*(?:(\d+)\s+\d+\s+R|(<<|\[)|(/?[^\s/<>\[\]()]+))", body)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        if m[3]:
            return m[3]
        depth, at = 0, m.start(2)
        for x in re.finditer(rb"<<|>>|\[|\]|\((?:\\.|[^\\)])*\)", body[at:], re.S):
            depth += (x[0] in (b"<<", b"[")) - (x[0] in (b">>", b"]"))
            if not depth:
                return body[at : at + x.end()]
        return body[at:]

    def fonts(self, page: int) -> dict[bytes, "_Font"]:
        """The fonts that a page names, its own or those of the pages above it."""
        seen: set[int] = set()
        while page in self.objects and page not in seen:
            seen.add(page)
            named = self.value(self.value(self.objects[page], b"Resources"), b"Font")
            if named:
                return {m[1]: self._font(int(m[2])) for m in re.finditer(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named)}
            page = next(iter(self.refs(self.objects[page], b"Parent")), -1)
        return {}

    def _font(self, number: int) -> "_Font":
        if number not in self.known:
            body = self.objects.get(number, b"")
            unicode_map = self.refs(body, b"ToUnicode")
            self.known[number] = _Font(self.stream(self.objects.get(unicode_map[0], b"")) if unicode_map else b"", self.value(body, b"Encoding"), b"/Type0" in body)
        return self.known[number]

    def pages(self) -> list[tuple[bytes, dict[bytes, "_Font"]]]:
        """Contents and fonts of the pages in their order."""
        root = self.refs(self.trailer, b"Root") or [k for k, b in self.objects.items() if re.search(rb"/Type\s*/Catalog", b)]
        order, todo, seen = [], [], set()
        if root and root[0] in self.objects:
            todo = self.refs(self.objects[root[0]], b"Pages")
        while todo:
            k = todo.pop(0)
            if k in seen or k not in self.objects:
                continue
            seen.add(k)
            kids = self.refs(self.objects[k], b"Kids")
            if kids:
                todo = kids + todo
            else:
                order.append(k)
        order = order or sorted(k for k, b in self.objects.items() if re.search(rb"/Type\s*/Page\b", b))
        out = []
        for k in order:
            parts = []
            for c in self.refs(self.objects[k], b"Contents"):
                body = self.objects.get(c, b"")
                inner = self.refs(b"/X " + body.strip(), b"X") if body.strip().startswith(b"[") else []
                parts += [self.stream(self.objects.get(i, b"")) for i in inner] or [self.stream(body)]
            out.append((b"\n".join(parts), self.fonts(k)))
        return out

    def info(self) -> dict[str, str]:
        found = {}
        for k in self.refs(self.trailer, b"Info"):
            for m in re.finditer(rb"/(\w+)\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)", self.objects.get(k, b""), re.S):
                found[m[1].decode("latin-1")] = pdf_string(m[2])
        return found


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_bytes(literal: bytes) -> bytes:
    if literal[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", literal[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), literal[1:-1], flags=re.S)


def pdf_string(literal: bytes) -> str:
    raw = pdf_bytes(literal)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


#: Names of glyphs that are no letters, and of the accents that stand behind a letter's.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}",
    "quoteleft": "\u2018", "quoteright": "\u2019", "quotedblleft": "\u201c", "quotedblright": "\u201d", "endash": "\u2013", "emdash": "\u2014",
    "bullet": "\u2022", "ellipsis": "\u2026", "Euro": "\u20ac", "sterling": "\xa3", "section": "\xa7", "copyright": "\xa9", "degree": "\xb0",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "\xdf", "ae": "\xe6", "AE": "\xc6", "oe": "\u0153", "OE": "\u0152",
    "oslash": "\xf8", "Oslash": "\xd8", "dotlessi": "\u0131", "lslash": "\u0142", "Lslash": "\u0141",
}
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "cedilla": "\u0327", "ogonek": "\u0328"}


def glyph(name: str) -> str:
    """The text of a glyph, by its name: a letter, perhaps with an accent, a listed one, or one by its code point."""
    name = name.split(".")[0]
    if name in GLYPHS or len(name) == 1:
        return GLYPHS.get(name, name)
    m = re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name)
    if m:
        return chr(int(m[1] or m[2], 16)) if int(m[1] or m[2], 16) < 0x110000 else ""
    return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]]) if name[1:] in ACCENTS else ""


class _Font:
    """How a font's strings read: by its map to Unicode, else by the differences from the usual encoding."""

    def __init__(self, unicode_map: bytes, encoding: bytes, composite: bool):
        self.size, self.map = 2 if composite else 1, {}
        read = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
        for block in re.finditer(rb"beginbfchar(.*?)endbfchar", unicode_map, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block[1]):
                self.size = max(1, len(a) // 2)
                self.map[int(a, 16)] = read(b)
        for block in re.finditer(rb"beginbfrange(.*?)endbfrange", unicode_map, re.S):
            for a, b, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]+)>|\[(.*?)\])", block[1], re.S):
                self.size = max(1, len(a) // 2)
                low, high = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
                each = [read(x) for x in re.findall(rb"<([0-9A-Fa-f\s]+)>", many)] if many else []
                start = read(one) if one else ""
                for k in range(low, high + 1):
                    said = each[k - low] if k - low < len(each) else start[:-1] + chr(min(ord(start[-1]) + k - low, 0x10FFFF)) if start else ""
                    if said:
                        self.map[k] = said
        if not self.map and not composite:
            code = 0
            for x in re.findall(rb"/?[^\s/\[\]<>()]+", encoding[encoding.find(b"/Differences") + 12 :] if b"/Differences" in encoding else b""):
                if x[:1] == b"/":
                    if said := glyph(x[1:].decode("latin-1")):
                        self.map[code] = said
                    code += 1
                elif x.isdigit():
                    code = int(x)
        self.plain = not self.map and not composite

    def text(self, raw: bytes) -> str:
        if self.size == 1:
            return "".join(self.map.get(b) or bytes([b]).decode("cp1252", "replace") for b in raw)
        return "".join(self.map.get(int.from_bytes(raw[i : i + self.size], "big"), "") for i in range(0, len(raw), self.size))


_OPERAND = re.compile(rb"(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?[0-9]*\.?[0-9]+|/[^\s/<>\[\]()]+|[A-Za-z'\"*]+[0-9]?\*?)", re.S)


def page_lines(content: bytes, fonts: dict[bytes, _Font] | None = None) -> list[str]:
    """Text of a page's content stream, line by line, in the stream's order."""
    lines, line, operands, inside, font = [], "", [], False, None

    def shown(items) -> str:
        out = ""
        for x in items:
            if x[:1] in (b"(", b"<"):
                out += pdf_string(x) if font is None or font.plain else font.text(pdf_bytes(x))
            elif re.fullmatch(rb"[-+]?[0-9.]+", x) and float(x) < -200:
                out += " "
        return out

    for m in _OPERAND.finditer(content):
        x = m[1]
        if x == b"BT":
            inside = True
        elif x == b"ET":
            inside = False
            lines.append(line)
            line = ""
        elif x == b"Tf":
            font = (fonts or {}).get(next((o for o in operands if o[:1] == b"/"), b""))
        elif inside and x in (b"Tj", b"TJ"):
            line += shown(operands)
        elif inside and x in (b"'", b'"'):
            lines.append(line)
            line = shown(operands)
        elif inside and x in (b"Td", b"TD", b"Tm", b"T*"):
            numbers = [float(o) for o in operands if re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", o)]
            if x in (b"T*", b"Tm") or numbers and numbers[-1] != 0:
                lines.append(line)
                line = ""
            elif line and not line.endswith(" "):
                line += " "
        if x[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", x):
            operands.append(x)
        else:
            operands = []
    return [x for x in [*lines, line] if x or lines]


def page_blocks(lines: list[str]) -> list[dict]:
    """Lines that look like headings stand alone; the others run on to the next blank line or heading."""
    blocks, pending = [], []

    def flush():
        said = rejoin(pending)
        if said:
            blocks.append(paragraph(text(said)))
        pending.clear()

    for line in lines:
        level = heading_level(line)
        if level or not line.strip():
            flush()
        if level:
            blocks.append(heading(level, text(line.strip())))
        elif line.strip():
            pending.append(line)
    flush()
    return blocks


def _without_gaps(lines: list[str]) -> list[str]:
    """The empty lines that only come from the way positions are set."""
    while lines and not lines[0].strip():
        lines = lines[1:]
    while lines and not lines[-1].strip():
        lines = lines[:-1]
    return lines


def parse_pdf(data: bytes, hints: Hints, cx) -> Document:
    pdf = _Pdf(data, cx)
    pages = pdf.pages()
    if not pages:
        raise malformed("pdf", "no pages")
    info, doc, scanned = pdf.info(), Document(), []
    doc.titled(info.get("Title")).metadata.author = info.get("Author")
    doc.metadata.created, doc.metadata.modified = info.get("CreationDate"), info.get("ModDate")
    for i, (page, fonts) in enumerate(pages, 1):
        cx.budget.check_time()
        lines = _without_gaps(page_lines(page, fonts))
        if any(x.strip() for x in lines):
            doc.blocks += page_blocks(lines)
        else:
            scanned.append(i)
    if not doc.title:
        doc.titled(hints.filename)
    if doc.blocks:
        doc.warn("heuristic_applied", "headings were inferred from line shape, not from font metrics; PDF extraction here is text-only (no columns, no table reconstruction)")
    if scanned:
        doc.metadata.put("pdf_scanned_pages", ",".join(map(str, scanned)))
        doc.metadata.put("pdf_page_count", str(len(pages)))
        doc.warn("no_text_layer", f"no text on page {page_list(scanned)}")
    return doc


# images

#: EXIF tags and their names.
EXIF = {
    0x010E: "ImageDescription", 0x010F: "Manufacturer", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "DateTime",
    0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "PhotographicSensitivity",
    0x9003: "DateTimeOriginal", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA433: "LensManufacturer", 0xA434: "LensModel",
}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> list[tuple[str, str]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return []
    found, todo, seen = [], [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen or not 8 <= at <= len(data) - 2:
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
            size = _SIZES.get(kind, 0) * n
            where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            if not size or where + size > len(data):
                continue
            if tag == 0x8769 and kind == 4:
                todo.append(struct.unpack_from(order + "I", data, where)[0])
            elif tag in EXIF:
                if kind == 2:
                    said = data[where : where + n].split(b"\0")[0].decode("utf-8", "replace").strip()
                elif kind in (5, 10):
                    a, b = struct.unpack_from(order + ("II" if kind == 5 else "ii"), data, where)
                    said = f"{a / b:g}" if b else ""
                else:
                    said = str(struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], data, where)[0])
                if said:
                    found.append((EXIF[tag], said))
    return found


def exif(data: bytes) -> list[tuple[str, str]]:
    try:
        if data.startswith(b"\xff\xd8"):
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
                size = struct.unpack_from(">H", data, at + 2)[0]
                if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    return _tiff(data[at + 10 : at + 2 + size])
                at += 2 + size
        elif data.startswith(b"\x89PNG"):
            at = 8
            while at + 8 <= len(data):
                size = struct.unpack_from(">I", data, at)[0]
                if data[at + 4 : at + 8] == b"eXIf":
                    return _tiff(data[at + 8 : at + 8 + size])
                at += 12 + size
        elif data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
    except struct.error:
        pass
    return []


def parse_image(data: bytes, hints: Hints, cx) -> Document:
    doc, found = Document().titled(hints.filename), exif(data)
    for k, v in found:
        if k == "Artist":
            doc.metadata.author = v
        elif k in ("DateTimeOriginal", "DateTime"):
            doc.metadata.created = v if k == "DateTimeOriginal" else doc.metadata.created or v
        else:
            doc.metadata.put(k, v)
    described = next((v for k, v in found if k == "ImageDescription"), None)
    if described:
        doc.blocks.append(paragraph(text(described)))
    doc.blocks.append({"type": "image", "alt": hints.filename, "caption": None, "kind": "resource" if hints.url else "none", "source": hints.url})
    doc.warn("degraded", "image converted from metadata only; enable llm.enrich.images for a description of what it depicts" if found else "the image carries no EXIF metadata; without LLM enrichment there is nothing to convert but the filename")
    return doc


# audio

#: Frames of tags at the head of a file, and what they say.
ID3 = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TDRC": "year", "TYER": "year", "TCON": "genre", "TRCK": "track"}


def _id3(data: bytes) -> dict[str, str]:
    found = {}
    if not data.startswith(b"ID3") or len(data) < 10:
        return found
    seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    at, end = 10, min(len(data), 10 + seven(data[6:10]))
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = seven(data[at + 4 : at + 8]) if data[3] == 4 else struct.unpack_from(">I", data, at + 4)[0]
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size]
        if name in ID3 and body:
            found[ID3[name]] = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").strip("\0 ")
        at += 10 + size
    return found


def _vorbis(data: bytes) -> dict[str, str]:
    found, at = {}, 4 + struct.unpack_from("<I", data)[0]
    for _ in range(struct.unpack_from("<I", data, at)[0]):
        size = struct.unpack_from("<I", data, at + 4)[0]
        k, _, v = data[at + 8 : at + 8 + size].decode("utf-8", "replace").partition("=")
        found.setdefault({"tracknumber": "track", "date": "year"}.get(k.lower(), k.lower()), v)
        at += 4 + size
    return {k: v for k, v in found.items() if k in ID3.values()}


def audio_facts(data: bytes) -> dict[str, str] | None:
    """Duration, rates and tags of a known container; None of an unknown one."""
    facts: dict[str, str] = {}

    def rates(seconds: float, rate: int, bits: float) -> None:
        facts.update(duration=f"{seconds:.1f}s", sample_rate=f"{rate} Hz", bitrate=f"{round(bits / 1000)} kbps")

    try:
        if data.startswith(b"RIFF") and data[8:12] == b"WAVE":
            at, per_second, rate = 12, 0, 0
            while at + 8 <= len(data):
                name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
                if name == b"fmt ":
                    rate, per_second = struct.unpack_from("<II", data, at + 12)
                elif name == b"data" and per_second:
                    rates(min(size, len(data) - at - 8) / per_second, rate, 8 * per_second)
                at += 8 + size + size % 2
        elif data.startswith(b"fLaC"):
            at = 4
            while at + 4 <= len(data):
                kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
                body = data[at + 4 : at + 4 + size]
                if kind & 127 == 0:
                    packed = int.from_bytes(body[10:18], "big")
                    rate, total = packed >> 44, packed & (1 << 36) - 1
                    if rate and total:
                        rates(total / rate, rate, 8 * len(data) * rate / total)
                elif kind & 127 == 4:
                    facts.update(_vorbis(body))
                at += 4 + size
                if kind & 128:
                    break
        elif data.startswith((b"ID3", b"\xff\xfb", b"\xff\xf3", b"\xff\xfa")):
            facts.update(_id3(data))
            m = re.search(rb"\xff[\xfa\xfb]([\x10-\xef])", data[: 1 << 20])
            if m:
                kbps = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)[m[1][0] >> 4]
                rate = (44100, 48000, 32000, 0)[m[1][0] >> 2 & 3]
                if kbps and rate:
                    rates((len(data) - m.start()) * 8 / (kbps * 1000), rate, kbps * 1000)
        elif not (data.startswith(b"OggS") or data[4:8] == b"ftyp"):
            return None
    except struct.error:
        pass
    return facts


def parse_audio(data: bytes, hints: Hints, cx) -> Document:
    facts = audio_facts(data)
    if facts is None:
        raise malformed("audio", "unknown container")
    doc = Document().titled(facts.pop("title", None) or hints.filename)
    doc.metadata.author = facts.pop("artist", None)
    for k, v in facts.items():
        doc.metadata.put(k, v)
    doc.blocks.append(paragraph(text("[audio: no transcript]")))
    doc.warn("degraded", "audio converted from metadata only; enable llm.enrich.audio for a transcript")
    return doc


# Outlook messages

#: MAPI tags and what they say.
MAPI = {
    "0037": "subject", "1000": "body", "1013": "body_html", "1009": "body_rtf", "0C1A": "from", "0065": "from",
    "0E04": "to", "0E03": "cc", "0E06": "date", "3007": "date", "3707": "attachment", "3704": "attachment",
}
_END = 0xFFFFFFFA


def compound_streams(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of the streams of an OLE compound file."""
    try:
        shift, small_shift = struct.unpack_from("<HH", data, 30)
        n_fat, directory, _, cutoff, small_fat, n_small, difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        if not 7 <= shift <= 20 or not 2 <= small_shift <= shift:
            raise malformed("msg", "no compound file")
        size, small = 1 << shift, 1 << small_shift
        sector = lambda i: data[(i + 1) * size : (i + 2) * size]
        where = list(struct.unpack_from("<109I", data, 76))
        while difat < _END and n_difat:
            block = struct.unpack(f"<{size // 4}I", sector(difat))
            where += block[:-1]
            difat, n_difat = block[-1], n_difat - 1
        fat: list[int] = []
        for i in where[: max(n_fat, 0)]:
            if i < _END:
                fat += struct.unpack(f"<{size // 4}I", sector(i).ljust(size, b"\xff"))

        def chain(i: int, table: list[int], get, most: int) -> bytes:
            out, steps = [], 0
            while i < _END and i < len(table) and steps <= most:
                out.append(get(i))
                i, steps = table[i], steps + 1
            return b"".join(out)

        entries = chain(directory, fat, sector, len(data) // size)
        raw = chain(small_fat, fat, sector, len(data) // size)
        small_table = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
        found, mini = [], b""
        for at in range(0, len(entries) - 127, 128):
            n_name, kind = struct.unpack_from("<HB", entries, at + 64)
            start, length = struct.unpack_from("<II", entries, at + 116)
            if kind == 5:
                mini = chain(start, fat, sector, len(data) // size)
            elif kind == 2:
                name = entries[at : at + max(0, n_name - 2)].decode("utf-16-le", "replace")
                body = chain(start, fat, sector, len(data) // size) if length >= cutoff else chain(start, small_table, lambda i: mini[i * small : (i + 1) * small], len(mini) // small + 1)
                found.append((name, body[:length]))
        return found
    except struct.error as e:
        raise malformed("msg", str(e)) from e


def parse_msg(data: bytes, hints: Hints, cx) -> Document:
    said: dict[str, str] = {}
    attachments, present = [], set()
    for name, body in compound_streams(data):
        m = re.fullmatch(r"__substg1\.0_([0-9A-Fa-f]{4})([0-9A-Fa-f]{4})", name)
        field = MAPI.get(m[1].upper()) if m else None
        if not field:
            continue
        cx.budget.expand(len(body))
        if body:
            present.add(field)
        kind = m[2].upper()
        value = (body.decode("utf-16-le", "replace") if kind == "001F" else body.decode("cp1252", "replace") if kind == "001E" else "").rstrip("\0")
        if field == "attachment":
            if value.strip() and value not in attachments:
                attachments.append(value)
        elif value.strip():
            said.setdefault(field, value)
    doc = Document().titled(said.get("subject"))
    doc.metadata.author, doc.metadata.created = said.get("from"), said.get("date")
    rows = [[k.capitalize(), said[k]] for k in ("from", "to", "cc", "date", "subject") if k in said]
    if rows:
        doc.blocks.append(table(rows))
    if attachments:
        doc.blocks.append(paragraph([strong("Attachments"), *text(": " + ", ".join(attachments))]))
        doc.warn("skipped_member", f"{len(attachments)} attachment(s) named but not converted")
    body = said.get("body", "").replace("\r\n", "\n")
    parts = [" ".join(p.split()) for p in re.split(r"\n\s*\n", body) if p.strip()]
    if parts:
        doc.blocks.append({"type": "rule"})
        doc.blocks += [paragraph(text(p)) for p in parts]
    elif doc.blocks:
        if present & {"body_html", "body_rtf"}:
            doc.warn("degraded", "the message has no plain body; its HTML or RTF body was left out")
        else:
            doc.warn("no_text_layer", "the message has no body")
    if not doc.blocks:
        raise malformed("msg", "no message in the compound file")
    return doc
