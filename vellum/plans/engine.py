"""The engine: bytes and hints in, Markdown out, for one document or for a DataFrame of them.

A DataFrame has ``content`` (binary or string) and any of the hint columns
mimetype, extension, charset, filename, url; all its columns are carried
along. A failure is a row's ``error``, never the job's.

The steps are also to be had one by one: ``detect`` names the formats of each
row, ``to_ir`` parses it into a document, ``blocks`` gives a document's blocks
as rows, ``render`` makes Markdown of documents, changed or not.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..operators.detect import Detection, detect
from ..operators.registry import Converter, Registry
from ..operators.render import Renderer
from ..operators.template import CompiledTemplates
from .model import Budget, ConvertError, Document, Hints, Limits, Metadata, Options, block_count

HINTS = ("mimetype", "extension", "charset", "filename", "url")
_WARNINGS = "array<struct<kind:string,message:string>>"
CONVERSION = f"markdown string, converter string, detected_via string, title string, warnings {_WARNINGS}, error struct<code:string,message:string>"
ERROR = "error struct<code:string,message:string>"
DETECTED = "guesses array<struct<mimetype:string,extension:string,charset:string>>, mismatch string, signal string"
METADATA = "metadata struct<author:string,created:string,modified:string,language:string,extra:array<struct<key:string,value:string>>>"
PARSED = f"document string, converter string, detected_via string, title string, {METADATA}, block_count int, warnings {_WARNINGS}, {ERROR}"
RENDERED = f"markdown string, warnings {_WARNINGS}, {ERROR}"
BLOCKS = "block_ord int, parent_ord int, depth int, kind string, level int, text string, block string"


@dataclass(frozen=True)
class Context:
    limits: Limits
    budget: Budget
    depth: int
    convert: Callable


@dataclass(frozen=True)
class Conversion:
    markdown: str
    document: Document
    converter: str
    detected_via: str
    warnings: tuple[tuple[str, str], ...]


class DocumentEngine:
    def __init__(self, options: Options | dict | None = None):
        self.options = options if isinstance(options, Options) else Options.of(options or {})
        self.registry = Registry(self.options.enable)
        t = self.options.templates
        self.templates = CompiledTemplates(t) if t and (t.document is not None or t.blocks) else None
        self._inner: Registry | None = None

    def register(self, name: str, priority: int, accepts, convert) -> None:
        self.registry.register(Converter(name, priority, accepts, convert))

    @property
    def converter_names(self) -> list[str]:
        return self.registry.names

    # one document

    def _context(self) -> Context:
        inner = Registry()  # members of archives are not bound to the formats of the outer engine
        return Context(self.options.limits, Budget(self.options.limits), 0, lambda data, hints, cx: inner.run(data, detect(data, hints).guesses, cx)[0])

    def parse(self, data: bytes, hints: Hints = Hints(), cx: Context | None = None) -> tuple[Document, str, Detection]:
        """A document, its converter's name and how it was detected; ``cx`` takes the place of a new context."""
        cx = cx or self._context()
        if len(data) > cx.limits.max_input_bytes:
            raise Budget.over("max_input_bytes", len(data), cx.limits.max_input_bytes)
        found = detect(data, hints)
        doc, name = self.registry.run(data, found.guesses, cx)
        if found.mismatch:
            doc.warn("type_mismatch", found.mismatch)
        return doc, name, found

    def render_document(self, doc: Document, source: Hints | None = None, now: str | None = None) -> tuple[str, list[tuple[str, str]]]:
        renderer = Renderer(self.options.output, self.options.limits.max_output_bytes, self.options.limits.max_table_rows)
        markdown = self.templates.render(doc, renderer, source, now) if self.templates else renderer.document(doc)
        return markdown, renderer.warnings

    def convert_one(self, data: bytes, hints: Hints = Hints(), now: str | None = None, cx: Context | None = None) -> Conversion:
        doc, name, found = self.parse(data, hints, cx)
        markdown, more = self.render_document(doc, hints, now)
        return Conversion(markdown, doc, name, found.signal, (*doc.warnings, *more))

    # many documents

    def _rows(self, df: DataFrame, work, added: str, given_in: str = "content") -> DataFrame:
        """``work(data, hints)`` gives rows to stand beside each input row."""
        kept = [c for c in df.columns if c != given_in]
        hints = [c for c in HINTS if c in df.columns]
        types = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), added])
        columns = [f.name for f in StructType.fromDDL(added)]
        arrow = [to_arrow_type(f.dataType) for f in StructType.fromDDL(added)]
        content = F.col(given_in).cast("binary").alias(given_in)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                given = [b.column(kept.index(c)).to_pylist() for c in hints]
                for at in range(0, b.num_rows, 64):
                    index, out = [], []
                    for i, data in enumerate(b.column(len(kept)).slice(at, 64).to_pylist(), at):
                        for row in work(data or b"", Hints.of(**{c: v[i] for c, v in zip(hints, given)})):
                            index.append(i)
                            out.append(row)
                    take = pa.array(index, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(len(kept))), *(pa.array([r[k] for r in out], t) for k, t in enumerate(arrow))], names=[*kept, *columns])

        return df.select(*kept, content).mapInArrow(run, schema)

    def convert(self, df: DataFrame, now: str | None = None) -> DataFrame:
        """markdown, converter, detected_via, title, warnings and error beside the columns of ``df``; templates see
        the hints as ``source`` and ``now``."""

        def work(data: bytes, hints: Hints):
            try:
                c = self.convert_one(data, hints, now)
            except ConvertError as e:
                return [(None, None, None, None, [], _error(e))]
            return [(c.markdown, c.converter, c.detected_via, c.document.title, _pairs(c.warnings), None)]

        return self._rows(df, work, CONVERSION)

    def detect(self, df: DataFrame) -> DataFrame:
        """guesses, in the order in which they are tried, mismatch and signal beside the columns of ``df``."""

        def work(data: bytes, hints: Hints):
            found = detect(data, hints)
            return [([{"mimetype": g.mimetype, "extension": g.extension, "charset": g.charset} for g in found.guesses], found.mismatch, found.signal)]

        return self._rows(df, work, DETECTED)

    def to_ir(self, df: DataFrame) -> DataFrame:
        """document (JSON, see ``document_from_json``), converter, detected_via, title, metadata, block_count, warnings and error."""

        def work(data: bytes, hints: Hints):
            try:
                doc, name, found = self.parse(data, hints)
            except ConvertError as e:
                return [(None, None, None, None, None, None, [], _error(e))]
            m = doc.metadata
            metadata = {"author": m.author, "created": m.created, "modified": m.modified, "language": m.language, "extra": [{"key": k, "value": v} for k, v in m.extra]}
            return [(as_json(doc), name, found.signal, doc.title, metadata, block_count(doc.blocks), _pairs(doc.warnings), None)]

        return self._rows(df, work, PARSED)

    def render(self, df: DataFrame, now: str | None = None) -> DataFrame:
        """markdown, warnings (of the rendering) and error, of the documents in ``df``'s column ``document``."""

        def work(data: bytes, hints: Hints):
            try:
                markdown, warnings = self.render_document(document_from_json(data.decode()), hints, now)
            except ConvertError as e:
                return [(None, [], _error(e))]
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                return [(None, [], {"code": "invalid_input", "message": f"no document: {e}"})]
            return [(markdown, _pairs(warnings), None)]

        return self._rows(df, work, RENDERED, "document")

    def blocks(self, df: DataFrame) -> DataFrame:
        """One row for each block, in document order, with the block as JSON; documents that fail have none."""

        def work(data: bytes, hints: Hints):
            try:
                doc, _, _ = self.parse(data, hints)
            except ConvertError:
                return []
            return flattened(doc)

        return self._rows(df, work, BLOCKS)


def flattened(doc: Document) -> list[tuple]:
    from .model import plain

    out: list[tuple] = []

    def walk(blocks, parent, depth):
        for b in blocks:
            k = len(out)
            said = plain(b["text"]) if isinstance(b.get("text"), list) else b.get("text") or b.get("name")
            out.append((k, parent, depth, b["type"], b.get("level"), said, as_json(b)))
            if b["type"] == "list":
                for item in b["items"]:
                    walk(item, k, depth + 1)
            elif b["type"] == "quote":
                walk(b["blocks"], k, depth + 1)
            elif b["type"] == "embedded":
                walk(b["doc"].blocks, k, depth + 1)

    walk(doc.blocks, None, 0)
    return out


def as_json(value) -> str:
    def other(x):
        if isinstance(x, Document):
            return {"title": x.title, "metadata": x.metadata, "blocks": x.blocks, "warnings": [{"kind": k, "message": m} for k, m in x.warnings]}
        if isinstance(x, Metadata):
            return {k: v for k, v in vars(x).items() if v}
        raise TypeError(type(x))

    return json.dumps(value, default=other, ensure_ascii=False)


def document_from_json(said: str) -> Document:
    """The inverse of ``as_json`` for a document, so that a step between parsing and rendering may change it."""

    def doc(v: dict) -> Document:
        m = dict(v.get("metadata") or {})
        m["extra"] = [tuple(x) for x in m.get("extra", [])]
        return Document(v.get("title"), Metadata(**m), [block(b) for b in v.get("blocks", [])], [(w["kind"], w["message"]) for w in v.get("warnings", [])])

    def block(b: dict) -> dict:
        return {**b, "doc": doc(b["doc"])} if b["type"] == "embedded" else {**b, "items": [[block(x) for x in i] for i in b["items"]]} if b["type"] == "list" else {**b, "blocks": [block(x) for x in b["blocks"]]} if b["type"] == "quote" else b

    return doc(json.loads(said))


def _error(e: ConvertError) -> dict:
    return {"code": e.code, "message": e.message}


def _pairs(warnings) -> list[dict]:
    return [{"kind": k, "message": m} for k, m in warnings]


def available_formats() -> list[str]:
    return Registry().names
