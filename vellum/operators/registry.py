"""Converters: what each accepts, and the order in which they are tried."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..plans.model import ConvertError, Document, Hints
from ..sources import binary, containers, markup, textual
from .detect import PROBE, looks_textual

OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
IMAGES = {"jpg", "jpeg", "png", "gif", "webp", "tif", "tiff", "heic", "heif", "avif", "bmp"}
AUDIO = {"mp3", "wav", "flac", "m4a", "aac", "ogg", "opus"}
SHEETS = {"xlsx", "xlsm", "xlsb", "xls", "ods"}


@dataclass(frozen=True)
class Converter:
    name: str
    priority: int
    accepts: Callable[[bytes, Hints], bool]
    convert: Callable[[bytes, Hints, object], Document]


def _accepts(*, ext=(), mime=(), like=(), textual_=None, magic=None, also=None):
    def accepts(head: bytes, h: Hints) -> bool:
        if textual_ is not None and looks_textual(head) != textual_:
            return False
        if magic is not None and not any(head.startswith(m) for m in magic):
            return False
        if also is not None and not also(head, h):
            return False
        return not (ext or mime or like) or h.extension in ext or h.mimetype in mime or any(x in (h.mimetype or "") for x in like)

    return accepts


def _feed_like(h: Hints) -> bool:
    return h.extension in ("rss", "atom") or h.mimetype in ("application/rss+xml", "application/atom+xml")


def _xml_like(h: Hints) -> bool:
    return h.extension == "xml" or h.mimetype in ("application/xml", "text/xml")


def _feed(head: bytes, h: Hints) -> bool:
    low = head.lower()
    return looks_textual(head) and (_feed_like(h) or _xml_like(h) and any(m in low for m in (b"<rss", b"<feed", b"<channel")))


def _xml(head: bytes, h: Hints) -> bool:
    return looks_textual(head) and not _feed_like(h) and (_xml_like(h) or h.extension is None and head.lstrip().lower().startswith(b"<?xml"))


def _html(head: bytes, h: Hints) -> bool:
    if not looks_textual(head):
        return False
    if h.mimetype in ("text/html", "application/xhtml+xml") or h.extension in ("html", "htm", "xhtml"):
        return True
    start = head[:512].lstrip().lower()
    return h.mimetype is None and h.extension is None and (start.startswith(b"<!doctype html") or start.startswith(b"<html"))


def _text(head: bytes, h: Hints) -> bool:
    m = h.mimetype
    if not looks_textual(head):
        return False
    return m in (None, "text/plain", "text/markdown", "application/octet-stream") or m.startswith("text/") and m not in ("text/html", "text/xml", "text/csv", "text/tab-separated-values")


def _image(head: bytes, h: Hints) -> bool:
    return (h.mimetype or "").startswith("image/") or h.extension in IMAGES and not looks_textual(head)


def _audio(head: bytes, h: Hints) -> bool:
    return (h.mimetype or "").startswith("audio/") or h.extension in AUDIO and not looks_textual(head)


def _pdf(head: bytes, h: Hints) -> bool:
    return head.startswith(b"%PDF-") or (h.extension == "pdf" or h.mimetype == "application/pdf") and b"%PDF-" in head


PK = (b"PK\x03\x04",)
#: Newest first within a priority.
BUILT_IN = (
    Converter("ipynb", -1, _accepts(ext=("ipynb",), mime=("application/x-ipynb+json",), textual_=True), textual.parse_notebook),
    Converter("msg", 0, _accepts(ext=("msg",), mime=("application/vnd.ms-outlook",), magic=(OLE,)), binary.parse_msg),
    Converter("audio", 0, _audio, binary.parse_audio),
    Converter("image", 0, _image, binary.parse_image),
    Converter("pdf", 0, _pdf, binary.parse_pdf),
    Converter("epub", 0, _accepts(ext=("epub",), mime=("application/epub+zip",), magic=PK), containers.parse_epub),
    Converter("spreadsheet", 0, _accepts(ext=SHEETS, like=("excel", "spreadsheet"), magic=(*PK, OLE)), containers.parse_spreadsheet),
    Converter("pptx", 0, _accepts(ext=("pptx",), like=("presentationml",), magic=PK), containers.parse_pptx),
    Converter("docx", 0, _accepts(ext=("docx",), like=("wordprocessingml",), magic=PK), containers.parse_docx),
    Converter("feed", 0, _feed, markup.parse_feed),
    Converter("json", 0, _accepts(ext=("json", "jsonl", "ndjson"), mime=("application/json", "application/x-ndjson"), textual_=True, also=lambda head, h: h.extension != "ipynb"), textual.parse_json),
    Converter("csv", 0, _accepts(ext=("csv", "tsv", "tab"), mime=("text/csv", "text/tab-separated-values"), textual_=True), textual.parse_csv),
    Converter("xml", 10, _xml, markup.parse_xml),
    Converter("html", 100, _html, markup.parse_html),
    Converter("zip", 110, _accepts(ext=("zip",), mime=("application/zip", "application/x-zip-compressed"), magic=PK), containers.parse_zip),
    Converter("text", 150, _text, textual.parse_text),
)


class Registry:
    def __init__(self, enable: tuple[str, ...] | None = None):
        self.converters = list(BUILT_IN)
        if enable is not None:
            unknown = set(enable) - {c.name for c in self.converters}
            if unknown:
                raise ConvertError("invalid_input", f"unknown format: {', '.join(sorted(unknown))}")
            self.converters = [c for c in self.converters if c.name in enable]
            if not self.converters:
                raise ConvertError("invalid_input", "no format is enabled")

    def register(self, converter: Converter) -> None:
        """Ahead of those of its priority."""
        k = next((i for i, c in enumerate(self.converters) if c.priority >= converter.priority), len(self.converters))
        self.converters.insert(k, converter)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.converters]

    def run(self, data: bytes, guesses, cx) -> tuple[Document, str]:
        """The first converter that accepts a guess and succeeds, guesses in order; else the last failure."""
        head, failure = data[:PROBE], None
        for guess in guesses:
            for c in self.converters:
                if not c.accepts(head, guess):
                    continue
                try:
                    return c.convert(data, guess, cx), c.name
                except ConvertError as e:
                    if e.code == "limit_exceeded":
                        raise
                    failure = e
                except Exception as e:  # a converter's defect costs this attempt, not the document
                    failure = ConvertError("panic", f"converter {c.name} failed: {e}")
        raise failure or ConvertError("unsupported", "unsupported format (tried: " + ", ".join(g.label for g in guesses) + ")")
