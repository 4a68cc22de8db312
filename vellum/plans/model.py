"""What a document is between parsing and rendering, its limits and its errors.

Blocks and spans are plain dictionaries, tagged by ``type`` and ``span``, so
they travel as JSON.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, fields


def text(s: str) -> list[dict]:
    return [{"span": "text", "text": s}] if s else []


def strong(s: str) -> dict:
    return {"span": "strong", "inline": text(s)}


def emphasis(s: str) -> dict:
    return {"span": "emphasis", "inline": text(s)}


def link(label: str, href: str) -> dict:
    return {"span": "link", "inline": text(label), "href": href}


def plain(spans: list[dict]) -> str:
    return "".join(" " if s["span"] == "line_break" else s["text"] if "text" in s else plain(s.get("inline", [])) for s in spans)


def heading(level: int, spans: list[dict]) -> dict:
    return {"type": "heading", "level": level, "text": spans}


def paragraph(spans: list[dict]) -> dict:
    return {"type": "paragraph", "text": spans}


def table(rows: list[list], header: list | None = None, caption: str | None = None) -> dict:
    """Cells are strings or lists of spans."""
    spans = lambda row: [text(c) if isinstance(c, str) else c for c in row]
    return {"type": "table", "caption": caption, "header": spans(header) if header is not None else None, "rows": [spans(r) for r in rows]}


def code(body: str, language: str | None = None) -> dict:
    return {"type": "code", "language": language, "text": body}


def raw(body: str) -> dict:
    return {"type": "raw", "text": body}


@dataclass
class Metadata:
    author: str | None = None
    created: str | None = None
    modified: str | None = None
    language: str | None = None
    extra: list[tuple[str, str]] = field(default_factory=list)

    def put(self, key: str, value: str | None) -> None:
        if value and value.strip():
            self.extra.append((key, value))

    def get(self, key: str) -> str | None:
        return next((v for k, v in self.extra if k == key), None)


@dataclass
class Document:
    title: str | None = None
    metadata: Metadata = field(default_factory=Metadata)
    blocks: list[dict] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)

    def titled(self, title: str | None) -> "Document":
        if title and title.strip():
            self.title = title
        return self

    def warn(self, kind: str, message: str) -> None:
        assert kind in WARNINGS
        self.warnings.append((kind, message))


def block_count(blocks: list[dict]) -> int:
    n = 0
    for b in blocks:
        n += 1
        if b["type"] == "list":
            n += sum(block_count(i) for i in b["items"])
        elif b["type"] == "quote":
            n += block_count(b["blocks"])
        elif b["type"] == "embedded":
            n += block_count(b["doc"].blocks)
    return n


WARNINGS = ("truncated", "skipped_member", "degraded", "heuristic_applied", "no_text_layer", "enrichment_failed", "type_mismatch")
ERRORS = ("unsupported", "malformed", "encrypted", "limit_exceeded", "panic", "template", "invalid_input")


class ConvertError(Exception):
    def __init__(self, code: str, message: str):
        assert code in ERRORS
        super().__init__(message)
        self.code, self.message = code, message


def malformed(form: str, why: str) -> ConvertError:
    return ConvertError("malformed", f"malformed {form}: {why}")


@dataclass(frozen=True)
class Limits:
    max_input_bytes: int = 20 << 20
    max_output_bytes: int = 4 << 20
    max_expanded_bytes: int = 200 << 20
    max_depth: int = 3
    max_embedded_documents: int = 64
    timeout_ms: int = 30_000
    max_table_rows: int = 5_000


@dataclass(frozen=True)
class RenderOptions:
    front_matter: str = "none"  # none, yaml, toml
    tables: str = "gfm"  # gfm, html, csv
    heading_offset: int = 0
    preserve_unsupported_html: bool = False


@dataclass(frozen=True)
class Templates:
    document: str | None = None
    blocks: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Options:
    limits: Limits = Limits()
    output: RenderOptions = RenderOptions()
    enable: tuple[str, ...] | None = None
    templates: Templates | None = None

    @staticmethod
    def of(values: dict) -> "Options":
        """From nested dictionaries; unknown keys are an error."""

        def make(kind, given, **parts):
            unknown = set(given) - {f.name for f in fields(kind)}
            if unknown:
                raise ConvertError("invalid_input", f"unknown option: {', '.join(sorted(unknown))}")
            return kind(**{**given, **parts})

        values = dict(values)
        parts = {}
        if "limits" in values:
            parts["limits"] = make(Limits, values["limits"])
        if "output" in values:
            parts["output"] = make(RenderOptions, values["output"])
        if values.get("templates"):
            t = dict(values["templates"])
            parts["templates"] = make(Templates, t, blocks=tuple(sorted(dict(t.get("blocks", {})).items())))
        if values.get("enable") is not None:
            parts["enable"] = tuple(values["enable"])
        return make(Options, values, **parts)


class Budget:
    """What one conversion may still use; archives within it share it."""

    def __init__(self, limits: Limits):
        self.limits, self.expanded, self.embedded, self.began = limits, 0, 0, time.monotonic()

    @staticmethod
    def over(what: str, actual: int, allowed: int) -> ConvertError:
        return ConvertError("limit_exceeded", f"{what}: {actual} exceeds {allowed}")

    def expand(self, n: int) -> None:
        self.expanded += n
        if self.expanded > self.limits.max_expanded_bytes:
            raise self.over("max_expanded_bytes", self.expanded, self.limits.max_expanded_bytes)

    @property
    def left(self) -> int:
        return max(0, self.limits.max_expanded_bytes - self.expanded)

    def embed(self) -> bool:
        self.embedded += 1
        return self.embedded <= self.limits.max_embedded_documents

    def check_time(self) -> None:
        took = int((time.monotonic() - self.began) * 1000)
        if took > self.limits.timeout_ms:
            raise self.over("timeout_ms", took, self.limits.timeout_ms)


@dataclass(frozen=True)
class Hints:
    """What the caller believes; any of it may be wrong."""

    mimetype: str | None = None
    extension: str | None = None
    charset: str | None = None
    filename: str | None = None
    url: str | None = None

    @staticmethod
    def of(mimetype=None, extension=None, charset=None, filename=None, url=None) -> "Hints":
        if not extension and filename and "." in filename:
            extension = filename.rsplit(".", 1)[1]
        clean = lambda x: x or None
        return Hints(clean((mimetype or "").split(";")[0].strip().lower()), clean((extension or "").strip().lstrip(".").lower()), clean((charset or "").strip().lower()), filename, url)

    @property
    def label(self) -> str:
        ext = f".{self.extension}" if self.extension else None
        return "/".join(x for x in (self.mimetype, ext) if x) or "unknown"
