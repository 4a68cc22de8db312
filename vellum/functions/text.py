"""String operators on Python values, for the parsers and the renderer."""

from __future__ import annotations

import html
import re

_SPECIAL = re.compile(r"[\\`*\[\]<>|]")
_NUMBERED = re.compile(r"^([0-9]+)\.")
#: What reads as a number in a table cell: also inf and nan, but neither hexadecimal nor underscores.
NUMBER = re.compile(r"(?i)[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)")


def squeeze(text: str) -> str:
    return " ".join(text.split())


def escape(text: str, cell: bool = False) -> str:
    """Markdown's special characters, so that a span of text reads as itself."""
    text = _SPECIAL.sub(r"\\\g<0>", text)
    if "_" in text:
        last = len(text) - 1
        text = "".join("\\_" if c == "_" and not (0 < i < last and text[i - 1].isalnum() and text[i + 1].isalnum()) else c for i, c in enumerate(text))
    if text[:1] in ("#", "+", "-"):
        text = "\\" + text
    return _NUMBERED.sub(r"\1\\.", text).replace("\r", "").replace("\n", "<br>" if cell else " ")


def escape_cell(text: str) -> str:
    return re.sub(r"\r\n?|\n", "<br>", text.replace("|", "\\|"))


def escape_url(url: str) -> str:
    url = url.strip()
    return "<" + re.sub("[<>]", "", url) + ">" if re.search(r"[ ()]", url) else url


def escape_html(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def longest_ticks(text: str) -> int:
    return max(map(len, re.findall("`+", text)), default=0)


def fence(text: str) -> str:
    return "`" * (max(longest_ticks(text), 2) + 1)


def quoted(text: str) -> str:
    return '"' + re.sub(r"\r\n?|\n", " ", text.replace("\\", "\\\\").replace('"', '\\"')) + '"'


def key(text: str) -> str:
    return text if re.fullmatch(r"[A-Za-z0-9_-]+", text) else quoted(text)


def csv_row(cells: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if re.search(r'[,"\n]', c) else c for c in cells)


def decode_entities(text: str) -> str:
    """The few that titles and meta values carry; ampersands last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = text.replace(entity, char)
    return text


def unescape(text: str) -> str:
    """The five entities of XML and numeric references; others stay as they are."""
    return re.sub(r"&(?:#[0-9]+|#x[0-9a-fA-F]+|lt|gt|amp|quot|apos);", lambda m: html.unescape(m[0]), text)


def safe_name(name: str) -> str:
    """An archive member's name without a way out of its folder."""
    parts = []
    for part in name.replace("\\", "/").split("/"):
        part = "".join(c for c in part.split(":")[0] if ord(c) >= 32 and not 127 <= ord(c) < 160)
        if part not in ("", ".", ".."):
            parts.append(part)
    return "/".join(parts) or "unnamed"


def heading_level(line: str) -> int | None:
    """Of a line of a page: numbered ones by their dots, short ones in capitals 2, else none."""
    line = line.strip()
    if not 3 <= len(line.encode()) <= 80 or len(line.split()) > 12 or line[-1] in ".,;:" or not any(c.isalpha() for c in line):
        return None
    m = re.match(r"([0-9.)]*[0-9][0-9.)]*) .*\S", line)
    if m:
        return min(4, m[1].count(".")) + 1
    return 2 if all(c.isupper() for c in line if c.isalpha()) else None


def rejoin(lines: list[str]) -> str:
    """Lines as one paragraph; a hyphen at a line's end goes and glues."""
    out = ""
    for line in map(str.strip, lines):
        out = out[:-1] + line if out.endswith("-") else f"{out} {line}" if out else line
    return squeeze(out)


def page_list(pages: list[int], most: int = 12) -> str:
    said = ", ".join(map(str, pages[:most]))
    return f"{said}, … and {len(pages) - most} more" if len(pages) > most else said
