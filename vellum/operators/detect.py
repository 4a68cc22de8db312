"""Format detection: magic bytes, extension, the caller's word, and whether it looks like text."""

from __future__ import annotations

import codecs
import io
import mimetypes
import re
import zipfile
from dataclasses import dataclass, replace

from ..plans.model import Hints

PROBE = 8192

#: Extensions and their types.
TYPES = {
    "txt": "text/plain", "text": "text/plain", "log": "text/plain", "md": "text/markdown", "markdown": "text/markdown",
    "csv": "text/csv", "tsv": "text/tab-separated-values", "tab": "text/tab-separated-values",
    "json": "application/json", "jsonl": "application/x-ndjson", "ndjson": "application/x-ndjson", "ipynb": "application/x-ipynb+json",
    "xml": "application/xml", "rss": "application/rss+xml", "atom": "application/atom+xml",
    "html": "text/html", "htm": "text/html", "xhtml": "text/html", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsm": "application/vnd.ms-excel.sheet.macroenabled.12", "xlsb": "application/vnd.ms-excel.sheet.binary.macroenabled.12",
    "xls": "application/vnd.ms-excel", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "epub": "application/epub+zip", "zip": "application/zip", "msg": "application/vnd.ms-outlook", "eml": "message/rfc822",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp",
    "tif": "image/tiff", "tiff": "image/tiff", "heic": "image/heif", "heif": "image/heif", "avif": "image/avif",
    "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "m4a": "audio/mp4", "aac": "audio/mp4", "ogg": "audio/ogg", "opus": "audio/ogg",
}

#: First bytes, an offset and further bytes there, and the type.
MAGIC = (
    (b"%PDF-", 0, b"", TYPES["pdf"]),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0, b"", TYPES["msg"]),
    (b"\xff\xd8\xff", 0, b"", "image/jpeg"),
    (b"\0\0\0\x0cjP  \r\n\x87\n", 0, b"", "image/jp2"),
    (b"\x89PNG", 0, b"", "image/png"),
    (b"GIF", 0, b"", "image/gif"),
    (b"RIFF", 8, b"WEBP", "image/webp"),
    (b"II*\0", 8, b"CR\2", "image/x-canon-cr2"),
    (b"MM\0*", 8, b"CR\2", "image/x-canon-cr2"),
    (b"II*\0", 0, b"", "image/tiff"),
    (b"MM\0*", 0, b"", "image/tiff"),
    (b"BM", 0, b"", "image/bmp"),
    (b"II\xbc", 0, b"", "image/vnd.ms-photo"),
    (b"8BPS", 0, b"", "image/vnd.adobe.photoshop"),
    (b"\0\0\1\0", 0, b"", "image/vnd.microsoft.icon"),
    (b"", 4, b"ftypavif", "image/avif"),
    (b"", 4, b"ftypavis", "image/avif"),
    (b"", 4, b"ftyphei", "image/heif"),
    (b"", 4, b"ftypmif1", "image/heif"),
    (b"", 4, b"ftypmsf1", "image/heif"),
    (b"\xff\x0a", 0, b"", "image/jxl"),
    (b"\0\0\0\x0cJXL \r\n\x87\n", 0, b"", "image/jxl"),
    (b"AT&TFORM", 12, b"DJV", "image/vnd.djvu"),
    (b"", 4, b"ftypM4V", "video/x-m4v"),
    (b"", 4, b"ftypM4A", "audio/m4a"),
    (b"", 4, b"ftypqt", "video/quicktime"),
    (b"", 4, b"moov", "video/quicktime"),
    (b"", 4, b"mdat", "video/quicktime"),
    (b"", 4, b"ftyp", "video/mp4"),
    (b"\x1aE\xdf\xa3\x93B\x82\x88matroska", 0, b"", "video/x-matroska"),
    (b"\x1aE\xdf\xa3", 31, b"matroska", "video/x-matroska"),
    (b"\x1aE\xdf\xa3", 0, b"", "video/webm"),
    (b"RIFF", 8, b"AVI", "video/x-msvideo"),
    (b"0&\xb2u\x8ef\xcf\x11\xa6\xd9", 0, b"", "video/x-ms-wmv"),
    *((b"\0\0\1" + bytes([k]), 0, b"", "video/mpeg") for k in range(0xB0, 0xC0)),
    (b"FLV\1", 0, b"", "video/x-flv"),
    (b"MThd", 0, b"", "audio/midi"),
    (b"ID3", 0, b"", "audio/mpeg"),
    (b"\xff\xfb", 0, b"", "audio/mpeg"),
    (b"OggS", 28, b"OpusHead", "audio/opus"),
    (b"OggS", 0, b"", "audio/ogg"),
    (b"fLaC", 0, b"", "audio/x-flac"),
    (b"RIFF", 8, b"WAVE", "audio/x-wav"),
    (b"#!AMR\n", 0, b"", "audio/amr"),
    (b"\xff\xf1", 0, b"", "audio/aac"),
    (b"\xff\xf9", 0, b"", "audio/aac"),
    (b"FORM", 8, b"AIFF", "audio/x-aiff"),
    (b"FORM", 8, b"AIFC", "audio/x-aiff"),
    (b"DSD ", 0, b"", "audio/x-dsf"),
    (b"MAC ", 0, b"", "audio/x-ape"),
)
SIGNALS = ("content", "extension", "declared", "none")


#: Of the interpreter alone, so that no machine's own lists change a result.
_OTHER_TYPES = mimetypes.MimeTypes(())


def type_of_extension(ext: str | None) -> str | None:
    return ext and (TYPES.get(ext) or _OTHER_TYPES.guess_type(f"x.{ext}")[0])


_CONTROLS = bytes(b for b in range(32) if not 9 <= b < 14)


def looks_textual(head: bytes) -> bool:
    if b"\0" in head:
        return False
    return not head or 100 * (len(head) - len(head.translate(None, _CONTROLS))) < len(head)


#: Encodings that are tried where the bytes are no UTF-8, and the characters that speak for each.
CHARSETS = (
    ("shift_jis", "\u3040-\u30ff\uff66-\uff9d"),
    ("euc-jp", "\u3040-\u30ff"),
    ("euc-kr", "\uac00-\ud7a3"),
    ("big5", "\u4e00-\u9fa5"),
    ("gb18030", "\u4e00-\u9fa5"),
    ("windows-1251", "\u0410-\u044f"),
    ("windows-1253", "\u0386-\u03ce"),
    ("windows-1255", "\u05d0-\u05ea"),
)


_SMALL = bytes(b for b in range(0xDF, 0x100) if b != 0xF7)
_LATIN_WORD = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _latin(data: bytes) -> bool:
    """Whether a third of the bytes beyond ASCII or more would be Latin letters in words with ASCII letters of their case."""
    said = data.decode("latin-1")
    found = 0
    for word in filter(lambda w: not w.isascii(), _LATIN_WORD.findall(said)):
        lower, upper = re.search("[a-z]", word), re.search("[A-Z]", word)
        found += sum(c > "\x7f" and bool(lower if c.islower() else upper or (k == 0 and lower)) for k, c in enumerate(word))
    return 3 * found >= sum(c > "\x7f" for c in said)


def _guessed_charset(data: bytes, whole: bool) -> str:
    """Of the encodings in which most characters beyond ASCII are its script's, in words of two and more and with
    few capitals, the first; else windows-1252, and that too where these are letters within Latin words. Accents alone
    can stand in a row too: so a word takes four bytes at least, and small letters of Latin are no characters of two bytes."""
    if _latin(data):
        return "windows-1252"
    high = data.translate(None, bytes(range(128)))
    small = 4 * (len(high) - len(high.translate(None, _SMALL))) >= 3 * len(high)
    for name, script in CHARSETS:
        if small and not name.startswith("windows"):
            continue
        try:
            said = codecs.getincrementaldecoder(name)("strict").decode(data, whole)
        except UnicodeDecodeError:
            continue
        beyond = [c for c in said if c > "\x7f"]
        own = re.findall(f"[{script}]", said)
        runs = re.findall(f"[{script}]{{2,}}", said)
        if name.startswith("windows") and 2 * len(own) < sum(c.isascii() and c.isalpha() for c in said):
            continue  # a text in such a script has few other letters
        if max((len(r.encode(name, "replace")) for r in runs), default=0) < 4:
            continue
        if len(own) * 10 >= 6 * len(beyond) and sum(map(len, runs)) * 10 >= 9 * len(own) and 2 * sum(c.isupper() for c in own) <= len(own):
            return name
    return "windows-1252"


def _utf8(data: bytes) -> bool:
    """Whether the probe is UTF-8, with the rest of a character that it cuts."""
    for end in range(PROBE, max(PROBE, min(len(data), PROBE + 3)) + 1):
        try:
            data[:end].decode()
            return True
        except UnicodeDecodeError:
            pass
    return False


def charset_of(data: bytes) -> str:
    """Of the probe: by a byte order mark, as UTF-8 if it decodes, else by the scripts that encodings would yield."""
    for bom, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if data.startswith(bom):
            return name
    return "utf-8" if _utf8(data) else _guessed_charset(data[:PROBE], len(data) <= PROBE)


def decoded(data: bytes, hints: Hints) -> str:
    try:
        name = codecs.lookup(hints.charset or charset_of(data)).name
    except LookupError:
        name = "utf-8"
    return data.decode(name, "replace").removeprefix("﻿")


def _zip_type(data: bytes) -> str:
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except Exception:
        return TYPES["zip"]
    for name in names:
        for start, ext in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx"), ("META-INF/container.xml", "epub"), ("OEBPS/", "epub")):
            if name.startswith(start):
                return TYPES[ext]
        if name == "mimetype":
            return TYPES["epub"]
    return TYPES["zip"]


def sniffed(data: bytes) -> str | None:
    if data.startswith(b"PK\x03\x04"):
        return _zip_type(data)
    return next((kind for start, at, more, kind in MAGIC if data.startswith(start) and data[at : at + len(more)] == more), None)


def compatible(a: str, b: str) -> bool:
    if a == b or "application/octet-stream" in (a, b):
        return True
    if a in ("application/zip", "application/x-zip-compressed") and ("officedocument" in b or "epub" in b):
        return True
    return a.startswith("text/") and b.startswith("text/")


@dataclass(frozen=True)
class Detection:
    guesses: tuple[Hints, ...]
    mismatch: str | None
    signal: str


def detect(data: bytes, hints: Hints) -> Detection:
    """Guesses in the order in which they are to be tried, each (type, extension) once."""
    found, signal, mismatch = [], None, None
    content, by_ext = sniffed(data), type_of_extension(hints.extension)
    if content:
        found.append(replace(hints, mimetype=content))
        signal = "content"
        claimed = hints.mimetype or by_ext
        if claimed and not compatible(claimed, content):
            mismatch = f"declared {claimed}, content looks like {content}"
    if by_ext:
        found.append(replace(hints, mimetype=by_ext))
        signal = signal or "extension"
    if hints.mimetype or hints.extension:
        found.append(hints)
        signal = signal or "declared"
    if not found and looks_textual(data[:PROBE]):
        found.append(replace(hints, mimetype="text/plain", charset=hints.charset or charset_of(data)))
    found = found or [hints]
    once = {(g.mimetype, g.extension): g for g in reversed(found)}
    return Detection(tuple(g for i, g in enumerate(found) if once[g.mimetype, g.extension] is g), mismatch, signal or "none")
