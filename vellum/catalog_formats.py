"""Queries that build a small file for every nation, run the engine over them and compare whole outputs with SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, table
from .plans.engine import DocumentEngine
from .sources import samples as S


def said(template: str | None) -> str:
    """SQL for a template with {name}, {low}, {key} of a nation."""
    if template is None:
        return "NULL::VARCHAR"
    names = {"{name}": "n_name", "{escaped}": "replace(n_name, '_', '\\_')", "{low}": "lower(n_name)", "{key}": "n_nationkey", "{day}": "strftime(DATE '2009-07-06' + n_nationkey::INT, '%Y-%m-%d')", "{hundred}": "(n_nationkey + 100)", "{seconds}": "printf('%.1f', (n_nationkey + 1) / 10.0)"}
    parts = [names.get(x, "'" + x.replace("'", "''") + "'") for x in re.split(r"(\{name\}|\{escaped\}|\{low\}|\{key\}|\{day\}|\{hundred\}|\{seconds\})", template) if x]
    return " || ".join(parts) or "''"


def built(spark: SparkSession, sf_dir: str, filename: str, build: Callable[[str, int], bytes | str], **hints: str) -> DataFrame:
    """n_nationkey, n_name, content and filename: a file for each nation; and further hints."""

    def run(batches):
        for b in batches:
            names, keys = (b.column(c).to_pylist() for c in ("n_name", "n_nationkey"))
            files = [build(n, k) for n, k in zip(names, keys)]
            files = [f.encode() if isinstance(f, str) else f for f in files]
            yield pa.RecordBatch.from_arrays([b.column("n_nationkey"), b.column("n_name"), pa.array(files, pa.binary())], names=["n_nationkey", "n_name", "content"])

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name").mapInArrow(run, "n_nationkey int, n_name string, content binary")
    named = F.concat(F.lower("n_name"), F.lit(filename)) if filename.startswith(".") else F.lit(filename)
    return rows.withColumns({"filename": named} | {k: F.lit(v) for k, v in hints.items()})


def listed(warnings: str):
    return F.array_join(F.transform(warnings, lambda w: F.concat(w["kind"], F.lit(": "), w["message"])), "\n")


def whole(engine: DocumentEngine, files: DataFrame) -> DataFrame:
    """What the engine makes of ``files``, parsed into documents first and rendered from these."""
    parsed = engine.to_ir(files).withColumnRenamed("warnings", "noted").withColumnRenamed("error", "failed")
    out = engine.render(parsed)
    extra = F.array_join(F.transform("metadata.extra", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return out.select("n_nationkey", "markdown", "title", "converter", "detected_via", "metadata.author", "metadata.created", "metadata.language", extra.alias("extra"), "block_count", listed("noted").alias("noted"), listed("warnings").alias("warnings"))


def format_query(name: str, filename: str, build, markdown: str, converter: str, via: str, title: str | None = None, author: str | None = None, created: str | None = None, language: str | None = None, extra: str = "", blocks: int = 1, noted: str = "", warnings: str = "", options: dict | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: whole(DocumentEngine(options), built(spark, sf_dir, filename, build))
    columns = {"markdown": markdown, "title": title, "converter": converter, "detected_via": via, "author": author, "created": created, "language": language, "extra": extra, "noted": noted, "warnings": warnings}
    ORACLES[name] = "SELECT n_nationkey::INT AS n_nationkey, " + ", ".join(f"{said(v)} AS {k}" for k, v in columns.items()) + f", {blocks}::INT AS block_count FROM nation"


def docx(name: str, key: int) -> bytes:
    body = S.para(S.run(f"Report {name}"), style="Heading1")
    body += S.para(S.run("Plain, "), S.run("bold", "b"), S.run(", "), S.run("italic ", "i"), S.run("and_all"), "<w:r><w:tab/><w:t>tabbed</w:t></w:r>")
    body += S.para(S.run("See "), f'<w:hyperlink r:id="r1">{S.run("nation ")}{S.run(str(key))}</w:hyperlink>', S.run("."))
    body += S.para(S.run("dash"), numbered=True) + S.para(S.run("dot"), style="List Bullet 2") + S.para(S.run("first"), style="List Number") + S.para(S.run("second"), style="ListNumber")
    inner = S.word_table(["x", "y"])
    body += f"<w:tbl><w:tr><w:tc>{S.para(S.run('key'))}</w:tc><w:tc>{S.para(S.run('value'))}</w:tc></w:tr><w:tr><w:tc>{S.para(S.run(str(key)))}{inner}</w:tc><w:tc>{S.para(S.run('a'))}{S.para(S.run('b|c'))}</w:tc></w:tr></w:tbl>"
    body += S.para("<w:r><w:drawing/></w:r>") + S.para(S.run("Sub"), style="Subtitle")
    return S.docx(body, f"<dc:title>T {name}</dc:title><dc:creator>Mira</dc:creator><cp:keywords>k1, k2</cp:keywords><dcterms:created>2024-01-02</dcterms:created>", {"r1": f"http://x.invalid/{key}"}, {"word/footnotes.xml": f"<w:footnotes {S.W}><w:footnote>{S.para(S.run(f'Note {key}.'))}</w:footnote></w:footnotes>"})


def pptx(name: str, key: int) -> bytes:
    grid = "<a:tbl><a:tr><a:tc><a:p><a:r><a:t>h</a:t></a:r></a:p></a:tc></a:tr><a:tr><a:tc><a:p><a:r><a:t>" + str(key) + "</a:t></a:r></a:p></a:tc></a:tr></a:tbl>"
    return S.pptx([S.slide(name, "Second line"), grid, *[S.slide(f"Slide no {k}") for k in range(3, 11)]], {1: S.slide("say this"), 10: S.slide("end")})


def epub(name: str, key: int) -> bytes:
    return S.epub({"a": (name, "One &amp; all"), "b": ("Next", f"Number {key}")}, ["b", "toc", "a", "gone"])


def xlsx(name: str, key: int) -> bytes:
    rows = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>ok</t></is></c></row>'
    rows += f'<row r="3"><c r="B3"><v>{key}</v></c><c r="C3" s="1"><v>{40000 + key}</v></c><c r="D3" t="b"><v>1</v></c></row><row r="4"><c r="B4"><v>2.5</v></c><c r="D4" t="e"><v>#DIV/0!</v></c></row>'
    return S.xlsx({f"S {name}": rows, "Nothing": ""}, ["key", "day"])


def sheet(name: str, key: int) -> dict:
    return {f"S {name}": [["key", "day", "ok"], [key, 40000 + key, True], [2.5, "", "#NA"], ["=sum", 40000.5, False]], "Nothing": []}


ODS = '<o:document-content xmlns:o="o" xmlns:t="t" xmlns:x="x"><t:table t:name="S">{}</t:table></o:document-content>'


def ods(name: str, key: int) -> bytes:
    cell = lambda said, more="": f"<t:table-cell {more}><x:p>{said}</x:p></t:table-cell>"
    rows = f"<t:table-row>{cell('k')}{cell('v')}{cell('w')}</t:table-row>"
    value = f'o:value-type="float" o:value="{key}"'
    twice = 't:number-columns-repeated="2"'
    day = 'o:value-type="date" o:date-value="2024-01-02"'
    rows += f"<t:table-row>{cell('x', value)}{cell(name, twice)}</t:table-row>"
    rows += f'<t:table-row t:number-rows-repeated="2">{cell("x", day)}</t:table-row><t:table-row t:number-rows-repeated="9999"><t:table-cell t:number-columns-repeated="999"/></t:table-row>'
    return S.zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": ODS.format(rows)})


def archive(name: str, key: int) -> bytes:
    return S.zipped({"../up/a.txt": f"Text of {name}", "b.csv": f"k\n{key}\n", "c.zip": S.zipped({"d.md": f"# {name}", "bad.bin": b"\0\1\2"}), "e.json": '{"a": 1}'})


def notebook(name: str, key: int) -> str:
    outputs = '[{"output_type": "stream", "text": ["out\\n"]}, {"output_type": "execute_result", "data": {"text/plain": "7"}}, {"output_type": "display_data", "data": {"image/png": "x"}}, {"output_type": "error", "ename": "E", "evalue": "v", "traceback": []}]'
    return f'{{"metadata": {{"kernelspec": {{"language": "julia"}}}}, "cells": [{{"cell_type": "markdown", "source": ["# {name}\\n", "text"]}}, {{"cell_type": "code", "source": "f({key})", "outputs": {outputs}}}, {{"cell_type": "raw", "source": "as is"}}]}}'


def rss(name: str, key: int) -> str:
    return f"<rss><channel><title>Feed of {name}</title><item><title>First &amp; {name}</title><link>http://x.invalid/{key}</link><pubDate>Mon, 1 Jan</pubDate><description>&lt;p&gt;Some &lt;b&gt;words&lt;/b&gt;&lt;/p&gt;</description></item><item><guid>only an id</guid></item></channel></rss>"


def atom(name: str, key: int) -> str:
    return f'<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>{name}</title><link href="http://x.invalid/{key}"/><updated>2024</updated><content><![CDATA[Five < six]]></content></entry></feed>'


def xml(name: str, key: int) -> str:
    return f'<?xml version="1.0"?><!DOCTYPE n [<!ENTITY e SYSTEM "file:///etc/passwd">]><o:nation xmlns:o="urn" o:key="{key}"><!-- no --><name>{name} &amp; co &#33; &e;</name><empty a="1" b=\'2\'/><data><![CDATA[<raw>]]></data></o:nation>'


def html(name: str, key: int) -> str:
    head = f'<head><title> {name} &amp;\n co</title><meta name="Author" content="A {key}"><meta property="description" content="d &lt; e"><style>x</style></head>'
    return f"<!DOCTYPE html><html>{head}<body><h1>{name}</h1><p>Some <b>bold</b>, <em>soft</em>, <code>c</code> and <a href='/{key}'>link</a><br>below</p><ul><li>one<li>two<ul><li>in</ul></ul><ol start=3><li>a<li>b</ol><table><tr><th>k</th><th>v|w</th></tr><tr><td>{key + 100}</td></tr></table><pre>  pre\n{key}</pre><blockquote><p>q</p></blockquote><img src='i.png' alt='al'><hr><script>no()</script>*end*</body></html>"


def message(name: str, key: int) -> bytes:
    return S.message(subject=f"About {name}", sender="a@x.invalid", to="b@x.invalid", body=f"Number {key}.\r\nsame line\r\n\r\nnext", attachment="x.pdf")


def picture(name: str, key: int) -> bytes:
    return S.jpeg_exif({0x013B: name, 0x0110: f"Cam {key}", 0x9003: "2024:01:02 03:04:05", 0x010E: "Seen"})


def sound(name: str, key: int) -> bytes:
    return S.wav(800 * (key + 1))


def pdf(name: str, key: int) -> bytes:
    return S.pdf([name, f"Its number is {key}, which is a word too lon-", "g for the line."], [], ["1.2 Numbered part", "Text below it."])


def fonts(name: str, key: int) -> bytes:
    return S.pdf_with_fonts(f"Größe von {key}: Ω, und mehr", "“das” ist alles.")


LAYER = "headings were inferred from line shape, not from font metrics; PDF extraction here is text-only (no columns, no table reconstruction)"
SHEET = "## S {name}\n\n| key | day | ok |\n| --- | --- | --- |\n| {key} | {day} | true |\n| 2\\.5 |  | %s |\n%s\n## Nothing\n\n(empty sheet)\n"

format_query("convert_docx", ".docx", docx, "# Report {name}\n\nPlain, **bold**, *italic* and_all tabbed\n\nSee [nation {key}](http://x.invalid/{key}).\n\n- dash\n- dot\n\n1. first\n2. second\n\n| key | value |\n| --- | --- |\n| {key}<br>x y | a<br>b\\|c |\n\n## Sub\n\n## Footnotes\n\nNote {key}.\n", "docx", "content", title="T {name}", author="Mira", created="2024-01-02", extra="keywords=k1, k2", blocks=13, noted="degraded: images in the document were left out")
format_query("convert_pptx", ".pptx", pptx, "## Slide 1\n\n{name}\n\nSecond line\n\n> **Speaker notes**\n>\n> say this\n\n## Slide 2\n\n| h |\n| --- |\n| {key} |\n\n" + "".join(f"## Slide {k}\n\nSlide no {k}\n\n" for k in range(3, 11)) + "> **Speaker notes**\n>\n> end\n", "pptx", "content", title="{name}", blocks=27)
format_query("convert_epub", ".epub", epub, "# Next\n\nNumber {key}\n\n# {name}\n\nOne & all\n", "epub", "content", title="A Book", author="Mira", blocks=4, noted="skipped_member: gone is in the reading order but not in the book")
format_query("convert_xlsx", ".xlsx", xlsx, SHEET % ("\\#Div0", ""), "spreadsheet", "content", title="{low}.xlsx", blocks=4)
format_query("convert_xls", ".xls", lambda n, k: S.xls(sheet(n, k), (1,)), SHEET % ("\\#NA", "| sum | 2009-07-06T12:00:00 | false |\n"), "spreadsheet", "content", title="{low}.xls", blocks=4, noted="type_mismatch: declared application/vnd.ms-excel, content looks like application/vnd.ms-outlook")
format_query("convert_xlsb", ".xlsb", lambda n, k: S.xlsb(sheet(n, k), (1,)), SHEET % ("\\#NA", "| sum | 2009-07-06T12:00:00 | false |\n"), "spreadsheet", "content", title="{low}.xlsb", blocks=4, noted="type_mismatch: declared application/vnd.ms-excel.sheet.binary.macroenabled.12, content looks like application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
format_query("convert_ods", ".ods", ods, "## S\n\n| k | v | w |\n| --- | --- | --- |\n| {key} | {name} | {name} |\n| 2024-01-02 |  |  |\n| 2024-01-02 |  |  |\n", "spreadsheet", "content", title="{low}.ods", blocks=2, noted="type_mismatch: declared application/vnd.oasis.opendocument.spreadsheet, content looks like application/epub+zip")
format_query("convert_zip", ".zip", archive, '## up/a.txt\n\nText of {name}\n\n## b.csv\n\n**b.csv**\n\n| k |\n| --- |\n| {key} |\n\n## c.zip\n\n## d.md\n\n# {name}\n\n## e.json\n\n```json\n{\n  "a": 1\n}\n```\n', "zip", "content", title="{low}.zip", blocks=9, noted="skipped_member: c.zip: bad.bin: unsupported format (tried: application/octet-stream/.bin, .bin)")
format_query("convert_ipynb", ".ipynb", notebook, "# {name}\ntext\n\n```julia\nf({key})\n```\n\n```text\nout\n```\n\n```text\n7\n```\n\n```text\n[image output]\n```\n\n```text\nE: v\n```\n\n```\nas is\n```\n", "ipynb", "extension", title="{name}", language="julia", blocks=7)
format_query("convert_rss", ".rss", rss, "## First & {name}\n\n[http://x.invalid/{key}](http://x.invalid/{key})\n\n*Mon, 1 Jan*\n\nSome words\n", "feed", "extension", title="Feed of {name}", blocks=4)
format_query("convert_atom", ".atom", atom, "## {name}\n\n[http://x.invalid/{key}](http://x.invalid/{key})\n\n*2024*\n\nFive \\< six\n", "feed", "extension", title="F", blocks=4)
format_query("convert_xml", ".xml", xml, "**name**: {name} & co ! &e;\n\n**empty** (a=1, b=2)\n\n**data**: \\<raw\\>\n\n**nation** (o=urn, key={key})\n", "xml", "extension", blocks=4)
format_query("convert_html", ".html", html, "# {escaped}\n\nSome **bold**, *soft*, `c` and [link](/{key})  \nbelow\n\n*   one\n*   two\n    *   in\n\n3.  a\n4.  b\n\n| k   | v\\|w |\n| --- | ---- |\n| {hundred} |      |\n\n```\n  pre\n{key}\n```\n\n> q\n\n![al](i.png)\n\n* * *\n\n\\*end\\*\n", "html", "extension", title="{name} & co", author="A {key}", extra="description=d < e", blocks=1)
format_query("convert_msg", ".msg", message, "|  |  |\n| --- | --- |\n| From | a@x.invalid |\n| To | b@x.invalid |\n| Subject | About {name} |\n\n**Attachments**: x.pdf\n\n---\n\nNumber {key}. same line\n\nnext\n", "msg", "content", title="About {name}", author="a@x.invalid", blocks=5, noted="skipped_member: 1 attachment(s) named but not converted")
format_query("convert_jpeg", ".jpg", picture, "Seen\n\n*[image: {low}.jpg]*\n", "image", "content", title="{low}.jpg", author="{name}", created="2024:01:02 03:04:05", extra="ImageDescription=Seen;Model=Cam {key}", blocks=2, noted="degraded: image converted from metadata only; enable llm.enrich.images for a description of what it depicts")
format_query("convert_png", ".png", lambda n, k: S.PNG, "*[image: {low}.png]*\n", "image", "content", title="{low}.png", noted="degraded: the image carries no EXIF metadata; without LLM enrichment there is nothing to convert but the filename")
format_query("convert_wav", ".wav", sound, "\\[audio: no transcript\\]\n", "audio", "content", title="{low}.wav", extra="duration={seconds}s;sample_rate=8000 Hz;bitrate=64 kbps", noted="degraded: audio converted from metadata only; enable llm.enrich.audio for a transcript\ntype_mismatch: declared audio/wav, content looks like audio/x-wav")
format_query("convert_pdf", ".pdf", pdf, "## {name}\n\nIts number is {key}, which is a word too long for the line.\n\n## 1\\.2 Numbered part\n\nText below it.\n", "pdf", "content", title="{low}.pdf", extra="pdf_scanned_pages=2;pdf_page_count=3", blocks=4, noted=f"heuristic_applied: {LAYER}\nno_text_layer: no text on page 2")
format_query("convert_pdf_fonts", ".pdf", fonts, "Größe von {key}: Ω, und mehr “das” ist alles.\n", "pdf", "content", title="{low}.pdf", noted=f"heuristic_applied: {LAYER}")

SCANNED = ", ".join(map(str, range(1, 13)))
format_query("convert_pdf_info", ".pdf", lambda n, k: S.pdf(["Words of a page."], info={"Title": f"About \\(no\\) {k}", "Author": f"Ä {n}", "CreationDate": "D:2024"}), "Words of a page.\n", "pdf", "content", title="About (no) {key}", author="Ä {name}", created="D:2024", noted=f"heuristic_applied: {LAYER}")
format_query("convert_scanned_pdf", ".pdf", lambda n, k: S.pdf(*[[]] * 14), "", "pdf", "content", title="{low}.pdf", extra="pdf_scanned_pages=" + ",".join(map(str, range(1, 15))) + ";pdf_page_count=14", blocks=0, noted=f"no_text_layer: no text on page {SCANNED}, … and 2 more")
