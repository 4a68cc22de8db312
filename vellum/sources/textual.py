"""Parsers of plain text, Markdown, CSV and JSON."""

from __future__ import annotations

import csv
import io
import json
import re

from ..functions.text import NUMBER
from ..operators.detect import decoded
from ..plans.model import Document, Hints, code, malformed, paragraph, raw, table, text


def parse_text(data: bytes, hints: Hints, cx) -> Document:
    body = decoded(data, hints)
    doc = Document()
    if hints.extension in ("md", "markdown") or hints.mimetype == "text/markdown":
        if body.strip():
            doc.blocks.append(raw(body.rstrip()))
        return doc.titled(first_heading(body))
    for part in body.replace("\r\n", "\n").split("\n\n"):
        if part.strip():
            doc.blocks.append(paragraph(text(part.strip().replace("\n", " "))))
    return doc


def first_heading(body: str) -> str | None:
    m = re.search(r"(?m)^# (.*)$", body)
    return m[1].strip() or None if m else None


def delimiter(body: str, hints: Hints) -> str:
    """By name, or the mark that stands equally often on each of the first five lines, most often of all."""
    if hints.extension in ("tsv", "tab") or hints.mimetype == "text/tab-separated-values":
        return "\t"
    lines = [x for x in body.splitlines() if x.strip()][:5]
    best = max(",;\t|", key=lambda d: lines[0].count(d) if lines and len({x.count(d) for x in lines}) == 1 else 0)
    return best if lines and lines[0].count(best) and len({x.count(best) for x in lines}) == 1 else ","


def looks_like_header(rows: list[list[str]]) -> bool:
    return len(rows) == 1 or not any(NUMBER.fullmatch(c.strip()) for c in rows[0])


def parse_csv(data: bytes, hints: Hints, cx) -> Document:
    body = decoded(data, hints)
    csv.field_size_limit(1 << 30)
    rows = []
    for row in csv.reader(io.StringIO(body, newline=""), delimiter=delimiter(body, hints)):
        if len(rows) % 1024 == 0:
            cx.budget.check_time()
        if row:
            rows.append(row)
        if len(rows) >= cx.limits.max_table_rows + 2:
            break
    doc = Document()
    if rows:
        head = looks_like_header(rows)
        doc.blocks.append(table(rows[1:] if head else rows, rows[0] if head else None, hints.filename))
    return doc


class _Number(str):
    """A number as it was written."""


def _loads(body: str, where: str = ""):
    try:
        return json.loads(body, parse_float=_Number, parse_int=_Number, parse_constant=lambda c: _refuse(c))
    except (ValueError, RecursionError) as e:
        raise malformed("json", f"{where}{e}") from e


def _refuse(constant: str):
    raise ValueError(f"{constant} is no JSON")


def pretty(value, indent: int = 0) -> str:
    """Two spaces a level, keys sorted, numbers as they were written."""
    pad, inner = "  " * indent, "  " * (indent + 1)
    if isinstance(value, dict):
        if not value:
            return "{}"
        return "{\n" + ",\n".join(f"{inner}{json.dumps(k, ensure_ascii=False)}: {pretty(value[k], indent + 1)}" for k in sorted(value)) + f"\n{pad}}}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(inner + pretty(x, indent + 1) for x in value) + f"\n{pad}]" if value else "[]"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def scalar(value) -> str:
    return "" if value is None else str(value) if isinstance(value, str) else json.dumps(value)


def as_table(value, max_rows: int) -> dict | None:
    """An array of flat objects; its columns are all keys in the order in which they come, an object's sorted."""
    if not isinstance(value, list) or not value or len(value) > 2 * max_rows:
        return None
    if not all(isinstance(x, dict) and not any(isinstance(v, (dict, list)) for v in x.values()) for x in value):
        return None
    columns = list(dict.fromkeys(k for x in value for k in sorted(x)))
    return table([[scalar(x.get(c)) for c in columns] for x in value[: max_rows + 1]], columns) if columns else None


def parse_json(data: bytes, hints: Hints, cx) -> Document:
    body = decoded(data, hints)
    if hints.extension in ("jsonl", "ndjson") or hints.mimetype == "application/x-ndjson":
        value = [_loads(line, f"line {i}: ") for i, line in enumerate(body.split("\n"), 1) if line.strip()]
    else:
        value = _loads(body)
    return Document(blocks=[as_table(value, cx.limits.max_table_rows) or code(pretty(value), "json")])


def _joined(source) -> str:
    return source if isinstance(source, str) else "".join(x for x in source if isinstance(x, str)) if isinstance(source, list) else ""


def _at(value, *path):
    for k in path:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _outputs(cell: dict):
    for o in cell.get("outputs") or []:
        kind = _at(o, "output_type")
        if kind == "stream":
            said = _joined(o.get("text"))
        elif kind in ("execute_result", "display_data"):
            said = _joined(_at(o, "data", "text/plain")) or ("[image output]" if _at(o, "data", "image/png") else "")
        elif kind == "error":
            said = "\n".join(o.get("traceback") or []) or f"{o.get('ename', '')}: {o.get('evalue', '')}"
        else:
            said = ""
        if said.strip():
            yield code(said.rstrip(), "text")


def parse_notebook(data: bytes, hints: Hints, cx) -> Document:
    book = _loads(decoded(data, hints))
    cells = _at(book, "cells")
    if not isinstance(cells, list):
        raise malformed("ipynb", "no cells")
    doc = Document()
    language = _at(book, "metadata", "kernelspec", "language") or _at(book, "metadata", "language_info", "name") or "python"
    doc.metadata.language = str(language)
    for cell in cells:
        kind, source = _at(cell, "cell_type"), _joined(_at(cell, "source"))
        if kind == "markdown" and source.strip():
            doc.blocks.append(raw(source.rstrip()))
        elif kind == "code":
            if source.strip():
                doc.blocks.append(code(source.rstrip(), str(language)))
            doc.blocks += _outputs(cell)
        elif kind == "raw" and source.strip():
            doc.blocks.append(code(source.rstrip()))
    title = _at(book, "metadata", "title") or _at(book, "metadata", "kernelspec", "display_name")
    return doc.titled(str(title) if title else next((h for b in doc.blocks if b["type"] == "raw" and (h := first_heading(b["text"]))), None))
