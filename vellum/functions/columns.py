"""The string operators as column expressions: all stay in Spark's own evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.markup import STRIP

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: A cell that reads as a number.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


#: White space as Unicode has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{WHITE}]+", " "))


def escape(c: Column, cell: bool = False) -> Column:
    c = F.regexp_replace(c, r"[\\`*\[\]<>|]", r"\\$0")
    c = F.regexp_replace(c, r"_(?:(?<![\p{IsAlphabetic}\p{N}]_)|(?![\p{IsAlphabetic}\p{N}]))", r"\\_")
    c = F.regexp_replace(c, r"^[#+\-]", r"\\$0")
    c = F.regexp_replace(c, r"^([0-9]+)\.", r"$1\\.")
    return F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<br>" if cell else " "))


def escape_cell(c: Column) -> Column:
    """A cell's own Markdown, kept in its cell."""
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r\n?|\n", "<br>")


def escape_url(c: Column) -> Column:
    c = trim(c)
    return F.when(c.rlike("[ ()]"), F.concat(F.lit("<"), F.regexp_replace(c, "[<>]", ""), F.lit(">"))).otherwise(c)


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_non_prose(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def title(c: Column) -> Column:
    said = squeeze(decode_entities(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(said != "", said)


def quoted(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"')):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), F.regexp_replace(c, r"\r\n?|\n", " "), F.lit('"'))


def key(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z0-9_-]+$"), c).otherwise(quoted(c))


def fence(c: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(F.array_max(runs), F.lit(0)), F.lit(2)) + 1)


def csv_cell(c: Column) -> Column:
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_row(cells: Column) -> Column:
    return F.array_join(F.transform(cells, csv_cell), ",")


def gfm_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: escape(c, True)), " | "), F.lit(" |"))


def padded(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(cells))))


def heading(level: Column, said: Column, offset: int = 0) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), level + offset))), F.lit(" "), escape(said))


def safe_name(c: Column) -> Column:
    parts = F.transform(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: F.regexp_replace(F.substring_index(p, ":", 1), r"[\x00-\x1f\x7f-\x9f]", ""))
    said = F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")
    return F.when(said == "", "unnamed").otherwise(said)


def heading_level(c: Column) -> Column:
    c = trim(c)
    number = F.regexp_extract(c, r"^([0-9.)]*[0-9][0-9.)]*) .*\S", 1)
    fits = F.octet_length(c).between(3, 80) & ~c.rlike(r"[.,;:]$") & (F.size(F.split(c, f"[{WHITE}]+")) <= 12) & c.rlike(r"\p{IsAlphabetic}")
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(~fits, None).when(number != "", F.least(F.lit(4), dots) + 1).when(~c.rlike(r"[\p{IsAlphabetic}&&[^\p{Lu}]]"), 2)


def rejoin(lines: Column) -> Column:
    glued = F.replace(F.array_join(F.transform(lines, trim), "\n"), F.lit("-\n"), F.lit(""))
    return squeeze(F.replace(glued, F.lit("\n"), F.lit(" ")))


def _occurrences(mark: str):
    return lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))


def delimiter(text: Column) -> Column:
    lines = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, 5)
    tries = []
    for i, d in enumerate(",;\t|"):
        counts = F.transform(lines, _occurrences(d))
        n = F.when((F.size(F.array_distinct(counts)) == 1) & (F.element_at(counts, 1) > 0), F.element_at(counts, 1)).otherwise(0)
        tries.append(F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")))
    best = F.array_max(F.array(*tries))
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def looks_textual(head: Column) -> Column:
    """Of a string's first part: no NUL, and controls below one in a hundred bytes."""
    controls = F.length(F.regexp_replace(head, r"[^\x01-\x08\x0E-\x1F]", ""))
    return ~F.contains(head, F.lit("\x00")) & ((F.octet_length(head) == 0) | (controls * 100 < F.octet_length(head)))


def extension(url: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"://[^/]*/(?:.*/)?([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
