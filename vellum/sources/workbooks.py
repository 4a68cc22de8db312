"""Cells of binary workbooks: the record streams of .xls (BIFF8) and .xlsb; and what cells of all workbooks share."""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Iterator

from ..plans.model import ConvertError, malformed

#: What cells with errors read as, by the error's code and by its name in text.
ERRORS = {0x00: "#Null", 0x07: "#Div0", 0x0F: "#Value", 0x17: "#Ref", 0x1D: "#Name", 0x24: "#Num", 0x2A: "#NA", 0x2B: "#GettingData"}
ERROR_NAMES = {"#NULL!": "#Null", "#DIV/0!": "#Div0", "#VALUE!": "#Value", "#REF!": "#Ref", "#NAME?": "#Name", "#NUM!": "#Num", "#N/A": "#NA"}


class Grid:
    """A sheet's cells, from the first row and column in use on; rows beyond ``most`` are only counted."""

    def __init__(self, most: int):
        self.most, self.cells, self.first, self.last, self.left, self.right = most, {}, None, -1, 1 << 30, -1

    def put(self, row: int, column: int, said: str) -> None:
        if not said:
            return
        if self.first is None or row < self.first:
            self.first = row
        self.last, self.left, self.right = max(self.last, row), min(self.left, column), max(self.right, column)
        if row - self.first < self.most:
            self.cells.setdefault(row, {})[column] = said

    @property
    def height(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1

    @property
    def width(self) -> int:
        return max(0, self.right - self.left + 1)

    def rows(self) -> Iterator[list[str]]:
        for r in range(self.first or 0, (self.first or 0) + min(self.height, self.most)):
            row = self.cells.get(r, {})
            yield [row.get(c, "") for c in range(self.left, self.right + 1)]


def format_kind(number: int, code: str | None = None) -> str:
    """Whether a number format shows a date, a duration or neither ("")."""
    if code is None:
        return "duration" if number == 46 else "date" if 14 <= number <= 22 or number in (45, 47) else ""
    bare = re.sub(r'"[^"]*"|&quot;.*?&quot;|\\.', "", code).lower()
    if re.search(r"\[(h+|m+|s+)\]", bare):
        return "duration"
    bare = re.sub(r"\[[^\]]*\]", "", bare)
    return "date" if re.search(r"[ymdhs]", bare) and "general" not in bare else ""


def serial_date(value: float, since_1904: bool = False) -> str:
    """A serial number as a date, with its time unless that is midnight."""
    at = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
    at += datetime.timedelta(seconds=round(value * 86400))
    return at.strftime("%Y-%m-%d") if at.time() == datetime.time() else at.strftime("%Y-%m-%dT%H:%M:%S")


def number_text(value: float, kind: str = "", since_1904: bool = False) -> str:
    try:
        if kind == "duration":
            return f"{value * 24:.4f} h"
        if kind == "date":
            return serial_date(value, since_1904)
    except OverflowError:
        pass
    return str(int(value)) if value == value and abs(value) < 1e15 and value == int(value) else repr(value)


def rk(raw: int) -> float:
    """A number in 30 bits: whole or the upper half of a double, perhaps in hundredths."""
    value = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


# .xls

class _Parts:
    """The bodies of a record and of those that continue it, read as one; a string that is cut begins anew with its flags."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.k < len(self.parts):
            piece = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
        if n > 0:
            raise struct.error("record ends early")
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = ""
        while n > 0:
            if self.k >= len(self.parts):
                raise struct.error("string ends early")
            room = len(self.parts[self.k]) - self.at
            m = min(n, room // 2 if wide else room)
            out += self.take(m * 2 if wide else m).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= m
            if n > 0:
                wide = bool(self.take(1)[0] & 1)
        return out

    def string(self, n: int) -> str:
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        said = self.characters(n, bool(flags & 1))
        self.take(4 * runs + extra)
        return said


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, body and continuations) of each record."""
    kind, parts = None, []
    while at + 4 <= len(data):
        k, n = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + n]
        at += 4 + n
        if k == 0x3C:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = k, [body]
    if kind is not None:
        yield kind, parts


def xls_sheets(stream: bytes, most: int, tick) -> Iterator[tuple[str, Grid]]:
    """Name and cells of each sheet of a workbook's stream. ``tick`` is called for each sheet."""
    if stream[:2] != b"\x09\x08":
        raise malformed("spreadsheet", "the workbook does not begin as one")
    try:
        sheets, shared, formats, kinds, since_1904 = [], [], {}, [], False
        for kind, parts in _records(stream):
            body = parts[0]
            if kind == 0x2F:
                raise ConvertError("encrypted", "spreadsheet is encrypted")
            if kind == 0x85:
                start, _, sort, n = struct.unpack_from("<IBBB", body)
                if sort == 0:
                    sheets.append((start, _Parts([body[7:]]).string(n)))
            elif kind == 0xFC:
                r = _Parts(parts)
                for _ in range(struct.unpack("<II", r.take(8))[1]):
                    shared.append(r.string(struct.unpack("<H", r.take(2))[0]))
            elif kind == 0x41E:
                number, n = struct.unpack_from("<HH", body)
                formats[number] = _Parts([body[4:]]).string(n)
            elif kind == 0xE0:
                kinds.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == 0x22:
                since_1904 = body[:1] == b"\1"
            elif kind == 0x0A:
                break
        styles = [format_kind(k, formats.get(k)) for k in kinds]
        for start, name in sheets:
            tick()
            yield name, _xls_sheet(stream, start, shared, styles, since_1904, most)
    except (struct.error, IndexError) as e:
        raise malformed("spreadsheet", str(e)) from e


def _xls_sheet(stream, start, shared, styles, since_1904, most) -> Grid:
    grid, waiting = Grid(most), None
    number = lambda v, xf: number_text(v, styles[xf] if xf < len(styles) else "", since_1904)
    for kind, parts in _records(stream, start):
        body = parts[0]
        if kind == 0x0A:
            break
        if kind == 0x207 and waiting:
            grid.put(*waiting, _Parts([body[2:], *parts[1:]]).string(struct.unpack_from("<H", body)[0]))
            waiting = None
        if kind not in (0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06) or len(body) < 6:
            continue
        row, column, xf = struct.unpack_from("<HHH", body)
        if kind == 0xFD:
            at = struct.unpack_from("<I", body, 6)[0]
            grid.put(row, column, shared[at] if at < len(shared) else "")
        elif kind == 0x204:
            grid.put(row, column, _Parts([body[8:], *parts[1:]]).string(struct.unpack_from("<H", body, 6)[0]))
        elif kind == 0x203:
            grid.put(row, column, number(struct.unpack_from("<d", body, 6)[0], xf))
        elif kind == 0x27E:
            grid.put(row, column, number(rk(struct.unpack_from("<I", body, 6)[0]), xf))
        elif kind == 0xBD:
            for k in range((len(body) - 6) // 6):
                style, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                grid.put(row, column + k, number(rk(raw), style))
        elif kind == 0x205:
            grid.put(row, column, ERRORS.get(body[6], "#Null") if body[7] else "true" if body[6] else "false")
        elif body[12:14] != b"\xff\xff":
            grid.put(row, column, number(struct.unpack_from("<d", body, 6)[0], xf))
        elif body[6] == 0:
            waiting = row, column
        elif body[6] in (1, 2):
            grid.put(row, column, ERRORS.get(body[8], "#Null") if body[6] == 2 else "true" if body[8] else "false")
    return grid


# .xlsb

def _packed(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, body) of each record; type and length are numbers of seven bits a byte."""
    at = 0

    def number(most: int) -> int:
        nonlocal at
        value = 0
        for k in range(most):
            b = data[at]
            at += 1
            value |= (b & 127) << 7 * k
            if b < 128:
                break
        return value

    while at < len(data):
        first = data[at]
        kind = first if first < 128 else first | data[at + 1] << 8
        at += 1 + (first >= 128)
        n = number(4)
        yield (kind & 127) | (kind >> 8 & 127) << 7 if first >= 128 else kind, data[at : at + n]
        at += n


def _wide(body: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", body, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    return body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def xlsb_sheets(get, targets: dict[str, str], path_of, most: int, tick) -> Iterator[tuple[str, Grid]]:
    """Name and cells of each sheet; ``get`` gives a part's bytes, ``targets`` the parts by relation."""
    try:
        shared = [_wide(body, 1)[0] for kind, body in _packed(get("xl/sharedStrings.bin") or b"") if kind == 19]
        formats, styles, inside = {}, [], False
        for kind, body in _packed(get("xl/styles.bin") or b""):
            if kind == 44:
                formats[struct.unpack_from("<H", body)[0]] = _wide(body, 2)[0]
            elif kind in (617, 618):
                inside = kind == 617
            elif kind == 47 and inside:
                k = struct.unpack_from("<H", body, 2)[0]
                styles.append(format_kind(k, formats.get(k)))
        since_1904 = False
        for kind, body in _packed(get("xl/workbook.bin") or b""):
            if kind == 153:
                since_1904 = bool(body[:1] and body[0] & 1)
            if kind == 156:
                tick()
                relation, at = _wide(body, 8)
                yield _wide(body, at)[0], _xlsb_sheet(get(path_of(targets.get(relation, ""))) or b"", shared, styles, since_1904, most)
    except (struct.error, IndexError) as e:
        raise malformed("spreadsheet", str(e)) from e


def _xlsb_sheet(data, shared, styles, since_1904, most) -> Grid:
    grid, row = Grid(most), 0
    for kind, body in _packed(data):
        if kind == 0:
            row = struct.unpack_from("<I", body)[0]
        elif 2 <= kind <= 11:
            column, style = struct.unpack_from("<II", body)
            style &= 0xFFFFFF
            if kind in (2, 5, 9):
                value = rk(struct.unpack_from("<I", body, 8)[0]) if kind == 2 else struct.unpack_from("<d", body, 8)[0]
                said = number_text(value, styles[style] if style < len(styles) else "", since_1904)
            elif kind in (3, 11):
                said = ERRORS.get(body[8], "#Null")
            elif kind in (4, 10):
                said = "true" if body[8] else "false"
            elif kind in (6, 8):
                said = _wide(body, 8)[0]
            else:
                at = struct.unpack_from("<I", body, 8)[0]
                said = shared[at] if at < len(shared) else ""
            grid.put(row, column, said)
    return grid
