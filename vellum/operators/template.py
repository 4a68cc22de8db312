"""A small template language: ``{{ expression | filter }}``, ``{% for %}``, ``{% if %}``, ``{% set %}``, ``{% raw %}``.

Expressions have arithmetic, comparisons, ``and``, ``or``, ``not``, ``in``, ``~`` (joins strings), tests (``is defined``),
``x if y else z``, lists, slices, filters and the functions ``range`` and ``gfm_table``. A minus at the edge of a tag takes
the white space beside it. Values are dictionaries, lists, strings, numbers and truth values; nothing else can be
reached, and nothing is loaded.
"""

from __future__ import annotations

import json
import re

from ..plans.model import ConvertError, Document, Hints, plain
from ..plans.model import table as make_table
from .render import Renderer, finished

KNOWN_BLOCKS = ("heading", "paragraph", "list", "table", "code", "quote", "image", "rule", "embedded")
_PART = re.compile(r"(\{%-?\s*raw\s*-?%\})(.*?)\{%-?\s*endraw\s*-?%\}|\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|([A-Za-z_]\w*)|(==|!=|<=|>=|//|\*\*|[<>.\[\]()|,~+*/%:-]))")
_LEVELS = (("==", "!=", "<", "<=", ">", ">="), ("~",), ("+", "-"), ("*", "/", "//", "%"))
_OPERATORS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "~": lambda a, b: _said(a) + _said(b), "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _times(a, b), "/": lambda a, b: a / b, "//": lambda a, b: a // b,
    "%": lambda a, b: a % b if not isinstance(a, str) else _fail("% needs numbers"), "**": lambda a, b: a**b if abs(b) < 64 and abs(a) < 1 << 32 else _fail("a power is too large"),
}
#: What a template may make of a sequence or a string by repeating it.
_MOST = 1 << 20
_FILTERS = {
    "length": lambda x: len(x or ""), "count": lambda x: len(x or ""), "upper": lambda x: _said(x).upper(), "lower": lambda x: _said(x).lower(), "title": lambda x: _said(x).title(),
    "capitalize": lambda x: _said(x).capitalize(), "trim": lambda x, c=None: _said(x).strip(c), "first": lambda x: x[0] if x else None, "last": lambda x: x[-1] if x else None,
    "join": lambda x, by="": by.join(_said(i) for i in x or []), "replace": lambda x, a, b: _said(x).replace(a, b), "reverse": lambda x: x[::-1], "list": lambda x: list(x or []),
    "items": lambda x: [[k, v] for k, v in (x or {}).items()], "sort": lambda x: sorted(x or []), "unique": lambda x: list(dict.fromkeys(x or [])), "min": lambda x: min(x, default=None),
    "max": lambda x: max(x, default=None), "sum": lambda x: sum(x or []), "int": lambda x: int(float(x or 0)), "float": lambda x: float(x or 0), "abs": abs, "round": lambda x, n=0: round(float(x), n),
    "string": lambda x: _said(x), "lines": lambda x: _said(x).splitlines(), "split": lambda x, by=None: _said(x).split(by), "bool": bool, "tojson": lambda x: json.dumps(x, ensure_ascii=False),
    "indent": lambda x, n=4, first=False: (" " * n if first else "") + _said(x).replace("\n", "\n" + " " * n), "default": lambda x, other="": other if x in (None, "") else x,
}
_FILTERS["d"] = _FILTERS["default"]
_TESTS = {
    "defined": lambda x: x is not None, "undefined": lambda x: x is None, "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "sequence": lambda x: isinstance(x, list), "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0, "true": lambda x: x is True, "false": lambda x: x is False,
}


def _fail(why: str):
    raise _bad(why)


def _times(a, b):
    if isinstance(a, (str, list)) or isinstance(b, (str, list)):
        n, m = (b, len(a)) if isinstance(a, (str, list)) else (a, len(b))
        if n * m > _MOST:
            _fail("a repeated value is too long")
    return a * b


def _bad(why: str) -> ConvertError:
    return ConvertError("template", f"template error: {why}")


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise _bad(f"cannot read {source!r}")
            at = m.end()
            kind = next(i for i in range(1, 6) if m[i] is not None)
            self.tokens.append((kind, m[kind] if kind not in (2, 3) else re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[kind])))
        self.at = 0
        self.run = self._choice()
        if self.at < len(self.tokens):
            raise _bad(f"cannot read {source!r}")

    def _take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 5 and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _word(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 4 and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _need(self, mark: str) -> None:
        if not self._take(mark):
            raise _bad(f"{mark} expected")

    def _choice(self):
        value = self._either()
        if not self._word("if"):
            return value
        test = self._either()
        other = self._choice() if self._word("else") else lambda v: None
        return lambda v: value(v) if test(v) else other(v)

    def _either(self):
        value = self._both()
        while self._word("or"):
            value = lambda v, a=value, b=self._both(): a(v) or b(v)
        return value

    def _both(self):
        value = self._not()
        while self._word("and"):
            value = lambda v, a=value, b=self._not(): a(v) and b(v)
        return value

    def _not(self):
        if self._word("not"):
            value = self._not()
            return lambda v: not value(v)
        value = self._level(0)
        while word := self._word("in", "is", "not"):
            negate = word == "not" or word == "is" and bool(self._word("not"))
            if word == "is":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
                self.at += 1
                if kind != 4 or name not in _TESTS:
                    raise _bad(f"unknown test {name}")
                value = lambda v, f=value, t=_TESTS[name], n=negate: t(f(v)) != n
            else:
                if negate and not self._word("in"):
                    raise _bad("in expected")
                value = lambda v, a=value, b=self._level(0), n=negate: (a(v) in (b(v) or [])) != n
        return value

    def _level(self, level: int):
        if level == len(_LEVELS):
            return self._signed()
        value = self._level(level + 1)
        while op := self._take(*_LEVELS[level]):
            value = lambda v, a=value, b=self._level(level + 1), f=_OPERATORS[op]: f(a(v), b(v))
        return value

    def _signed(self):
        if self._take("-"):
            value = self._signed()
            return lambda v: -value(v)
        value = self._filtered()
        if self._take("**"):
            power = self._signed()
            return lambda v: _OPERATORS["**"](value(v), power(v))
        return value

    def _arguments(self, end: str = ")") -> list:
        out = []
        if not self._take(end):
            out.append(self._choice())
            while self._take(","):
                out.append(self._choice())
            self._need(end)
        return out

    def _filtered(self):
        value = self._value()
        while self._take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
            self.at += 1
            args = self._arguments() if self._take("(") else []
            if kind != 4 or name not in _FILTERS:
                raise _bad(f"unknown filter {name}")
            value = lambda v, f=value, g=_FILTERS[name], a=args: g(f(v), *(x(v) for x in a))
        return value

    def _value(self):
        if self.at >= len(self.tokens):
            raise _bad("a value is missing")
        if self._take("("):
            value = self._choice()
            self._need(")")
        elif self._take("["):
            items = self._arguments("]")
            value = lambda v: [i(v) for i in items]
        else:
            kind, said = self.tokens[self.at]
            self.at += 1
            if kind == 1:
                value = lambda v, n=float(said) if "." in said else int(said): n
            elif kind in (2, 3):
                value = lambda v, s=said: s
            elif kind == 4 and self._take("("):
                args = self._arguments()
                if said == "range":
                    value = lambda v: _range(*(int(a(v)) for a in args))
                elif said == "gfm_table":
                    value = lambda v: gfm_table(args[0](v))
                else:
                    raise _bad(f"unknown function {said}")
            elif kind == 4:
                value = (lambda v, k=said: v.get(k)) if said.lower() not in ("true", "false", "none") else (lambda v, k=said.lower(): None if k == "none" else k == "true")
            else:
                raise _bad(f"unexpected {said}")
        while mark := self._take(".", "["):
            if mark == ".":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
                self.at += 1
                if kind not in (1, 4):
                    raise _bad("a name is missing")
                value = lambda v, f=value, k=name: _item(f(v), k)
                continue
            index = None if self._peek(":") else self._choice()
            if self._take(":"):
                end = None if self._peek("]") else self._choice()
                value = lambda v, f=value, i=index, e=end: (f(v) or [])[i(v) if i else None : e(v) if e else None]
            else:
                value = lambda v, f=value, i=index: _item(f(v), i(v))
            self._need("]")
        return value

    def _peek(self, mark: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] == (5, mark)


def _range(*bounds: int) -> list:
    found = range(*bounds)
    return list(found) if len(found) <= _MOST else _fail("a range is too long")


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, list) and str(key).lstrip("-").isdigit():
        return of[int(key)] if -len(of) <= int(key) < len(of) else None
    return None


def _said(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def compiled(source: str):
    """A function from a dictionary of values to text. Reading errors are raised here."""
    parts, at, trim = [], 0, False
    for m in _PART.finditer(source):
        between = source[at : m.start()]
        between = between.lstrip() if trim else between
        parts.append(("text", between.rstrip() if "-" in (m[3], m[6], m[9]) else between))
        trim = "-" in (m[5], m[8], m[10])
        if m[1] is not None:
            parts.append(("text", m[2]))
        elif m[4] is not None:
            parts.append(("value", _Expression(m[4]).run))
        elif m[7] is not None:
            parts.append(("tag", m[7].strip()))
        at = m.end()
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    steps = iter(parts)

    def sequence(ends: tuple[str, ...]):
        out = []
        for kind, x in steps:
            if kind != "tag":
                out.append((kind, x))
                continue
            word, _, rest = x.partition(" ")
            if word in ends:
                return out, word, rest
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise _bad(f"cannot read for {rest}")
                body, end, _ = sequence(("else", "endfor"))
                other = sequence(("endfor",))[0] if end == "else" else []
                out.append(("for", (re.split(r"\s*,\s*", m[1]), _Expression(m[2]).run, body, other)))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest.strip(), re.S)
                if not m:
                    raise _bad(f"cannot read set {rest}")
                out.append(("set", (m[1], _Expression(m[2]).run)))
            elif word == "if":
                branches, test, end = [], _Expression(rest).run, ""
                while end != "endif":
                    body, end, rest = sequence(("elif", "else", "endif"))
                    branches.append((test, body))
                    test = _Expression(rest).run if end == "elif" else lambda v: True
                out.append(("if", branches))
            else:
                raise _bad(f"unknown tag {word}")
        if ends:
            raise _bad(f"{ends[-1]} is missing")
        return out, "", ""

    tree, _, _ = sequence(())

    def run(tree, values) -> str:
        out, values = [], dict(values)
        for kind, x in tree:
            if kind == "text":
                out.append(x)
            elif kind == "value":
                out.append(_said(x(values)))
            elif kind == "for":
                items = list(x[1](values) or [])
                for i, item in enumerate(items):
                    loop = {"index": i + 1, "index0": i, "revindex": len(items) - i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                    named = {x[0][0]: item} if len(x[0]) == 1 else dict(zip(x[0], item))
                    out.append(run(x[2], {**values, **named, "loop": loop}))
                if not items:
                    out.append(run(x[3], values))
            elif kind == "set":
                values[x[0]] = x[1](values)
            else:
                out.append(next((run(body, values) for test, body in x if test(values)), ""))
        return "".join(out)

    def render(values: dict) -> str:
        try:
            return run(tree, values)
        except ConvertError:
            raise
        except Exception as e:
            raise _bad(str(e)) from e

    return render


def gfm_table(value) -> str:
    if not isinstance(value, dict):
        raise _bad("gfm_table needs a table")
    rows = [[_said(c) for c in r] for r in value.get("rows") or []]
    header = [_said(c) for c in value["header"]] if value.get("header") else None
    return Renderer(max_rows=1 << 60).block(make_table(rows, header))


def block_value(b: dict, renderer: Renderer) -> dict:
    """The strings of a block that a template sees."""
    row = lambda r: [plain(c) for c in r]
    out = {"type": b["type"], "markdown": renderer.block(b)}
    if b["type"] in ("heading", "paragraph"):
        out |= {"text": plain(b["text"]), "level": b.get("level")}
    elif b["type"] == "table":
        out |= {"caption": b.get("caption"), "header": row(b["header"]) if b["header"] is not None else [], "rows": [row(r) for r in b["rows"]]}
    elif b["type"] == "list":
        out |= {"ordered": b["ordered"], "items": ["\n\n".join(renderer.blocks(i)) for i in b["items"]]}
    elif b["type"] in ("code", "raw", "raw_html"):
        out |= {"text": b["text"], "language": b.get("language")}
    elif b["type"] == "image":
        out |= {"alt": b.get("alt"), "caption": b.get("caption"), "source": b.get("source")}
    elif b["type"] == "embedded":
        out |= {"name": b["name"], "title": b["doc"].title}
    return out


def document_value(doc: Document) -> dict:
    m = doc.metadata
    return {"title": doc.title, "author": m.author, "created": m.created, "modified": m.modified, "language": m.language, "metadata": dict(reversed(m.extra)), "warnings": [{"kind": k, "message": s} for k, s in doc.warnings]}


def source_value(hints: Hints | None) -> dict:
    h = hints or Hints()
    return {"filename": h.filename, "mimetype": h.mimetype, "extension": h.extension, "charset": h.charset, "uri": h.url, "url": h.url}


class CompiledTemplates:
    def __init__(self, templates):
        blocks = dict(templates.blocks)
        unknown = set(blocks) - set(KNOWN_BLOCKS)
        if unknown:
            raise _bad(f"no such block: {', '.join(sorted(unknown))}")
        self.document = compiled(templates.document) if templates.document is not None else None
        self.blocks = {k: compiled(v) for k, v in blocks.items()}

    def render(self, doc: Document, renderer: Renderer, hints: Hints | None = None, now: str | None = None) -> str:
        shared = {"doc": document_value(doc), "source": source_value(hints), "now": now or ""}
        pieces = []
        for b in doc.blocks:
            own = self.blocks.get(b["type"])
            piece = own({**shared, "block": block_value(b, renderer)}) if own else renderer.block(b)
            if piece.strip():
                pieces.append(piece.strip())
        if self.document is None:
            front = renderer.front_matter(doc)
            return finished(renderer.capped([*[front] * bool(front), *pieces]))
        whole = finished(self.document({**shared, "body": renderer.capped(pieces)}))
        raw = whole.encode()
        if len(raw) > renderer.max_bytes:
            cut = raw[: renderer.max_bytes].decode("utf-8", "ignore")
            whole = cut[: cut.rfind("\n") + 1] or cut
            renderer.warnings.append(("truncated", f"output truncated at {renderer.max_bytes} bytes (max_output_bytes)"))
        return whole
