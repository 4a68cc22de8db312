"""The engine on small documents of every format, whole outputs."""

import pytest

from vellum.plans.engine import DocumentEngine, as_json, available_formats, document_from_json
from vellum.plans.model import ConvertError, Document, Hints, Options, block_count, paragraph, text
from vellum.sources import samples as S


def convert(name, data, options=None, **hints):
    data = data.encode() if isinstance(data, str) else data
    return DocumentEngine(options).convert_one(data, Hints.of(filename=name, **hints))


SALES = 'region,sum,note\nNorth,12,"a | b"\nSouth,9,\n'
CASES = {
    "paragraphs": ("a.txt", "One line\ngoes on.\n\n# no heading\n", "text", "extension", "One line goes on.\n\n\\# no heading\n"),
    "markdown": ("a.md", "# Title\n\n- x\n", "text", "extension", "# Title\n\n- x\n"),
    "csv": ("s.csv", SALES, "csv", "extension", "**s.csv**\n\n| region | sum | note |\n| --- | --- | --- |\n| North | 12 | a \\| b |\n| South | 9 |  |\n"),
    "tsv": ("s.tsv", "a\tb\n1\t2\n", "csv", "extension", "**s.tsv**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"),
    "headless csv": ("s.csv", "1;2\n3;4\n", "csv", "extension", "**s.csv**\n\n|  |  |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n"),
    "json rows": ("r.json", '[{"b":1.0,"a":null},{"c":true}]', "json", "extension", "| a | b | c |\n| --- | --- | --- |\n|  | 1\\.0 |  |\n|  |  | true |\n"),
    "json tree": ("t.json", '{"z":[1e5,{}],"a":"x"}', "json", "extension", '```json\n{\n  "a": "x",\n  "z": [\n    1e5,\n    {}\n  ]\n}\n```\n'),
    "ndjson": ("r.jsonl", '{"a":1}\n\n{"a":2}\n', "json", "extension", "| a |\n| --- |\n| 1 |\n| 2 |\n"),
    "notebook": ("n.ipynb", '{"metadata":{},"cells":[{"cell_type":"markdown","source":["# T\\n"]},{"cell_type":"code","source":"1/0","outputs":[{"output_type":"error","ename":"E","evalue":"v"}]}]}', "ipynb", "extension", "# T\n\n```python\n1/0\n```\n\n```text\nE: v\n```\n"),
    "xml": ("o.xml", '<a id="1"><b>x &amp; y</b><c k="v"/></a>', "xml", "extension", "**b**: x & y\n\n**c** (k=v)\n\n**a** (id=1)\n"),
    "atom": ("f.atom", '<feed><title>F</title><entry><title>1.5</title><link href="http://x.invalid/a b"/><updated>now</updated></entry><entry><updated>then</updated></entry></feed>', "feed", "extension", "## 1\\.5\n\n[http://x.invalid/a b](<http://x.invalid/a b>)\n\n*now*\n"),
    "html": ("p.html", "<head><title>T &amp; U</title></head><h1>A</h1><p>b <em>c</em> <a href='/x'>d</a></p><ol><li>x<li>y</ol><script>no</script>", "html", "extension", "# A\n\nb *c* [d](/x)\n\n1.  x\n2.  y\n"),
    "docx": ("d.docx", S.docx(S.para(S.run("T"), style="Title") + S.para(S.run("a "), S.run("b", "i"), S.run(" c")) + S.para(S.run("one"), style="List Number 2") + S.para(S.run("two"), style="ListNumber") + S.word_table(["h"], ["v"])), "docx", "content", "# T\n\na *b* c\n\n1. one\n2. two\n\n| h |\n| --- |\n| v |\n"),
    "pptx": ("d.pptx", S.pptx([S.slide("A"), S.slide("B")], {2: S.slide("say")}), "pptx", "content", "## Slide 1\n\nA\n\n## Slide 2\n\nB\n\n> **Speaker notes**\n>\n> say\n"),
    "epub": ("b.epub", S.epub({"x": ("X", "1."), "y": ("Y", "2.")}, ["y", "x"]), "epub", "content", "# Y\n\n2\\.\n\n# X\n\n1\\.\n"),
    "xlsx": ("w.xlsx", S.xlsx({"S": '<row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>day</t></is></c></row><row><c><v>3.0</v></c><c s="1"><v>45000.5</v></c></row>', "E": ""}, ["n"]), "spreadsheet", "content", "## S\n\n| n | day |\n| --- | --- |\n| 3 | 2023-03-15T12:00:00 |\n\n## E\n\n(empty sheet)\n"),
    "zip": ("z.zip", S.zipped({"../a.txt": "hi", "t.csv": "k\n1\n"}), "zip", "content", "## a.txt\n\nhi\n\n## t.csv\n\n**t.csv**\n\n| k |\n| --- |\n| 1 |\n"),
    "pdf": ("p.pdf", S.pdf(["FINDINGS", "We saw a lot of rain in this ye-", "ar."]), "pdf", "content", "## FINDINGS\n\nWe saw a lot of rain in this year.\n"),
    "png": ("i.png", S.PNG, "image", "content", "*[image: i.png]*\n"),
    "wav": ("a.wav", S.wav(8000), "audio", "content", "\\[audio: no transcript\\]\n"),
    "msg": ("m.msg", S.message(subject="Hi", sender="a@x.invalid", body="One\nline.\n\nTwo."), "msg", "content", "|  |  |\n| --- | --- |\n| From | a@x.invalid |\n| Subject | Hi |\n\n---\n\nOne line.\n\nTwo.\n"),
}


@pytest.mark.parametrize("case", CASES)
def test_whole_output(case):
    name, data, converter, signal, markdown = CASES[case]
    c = convert(name, data)
    assert (c.converter, c.detected_via) == (converter, signal)
    assert c.markdown == markdown


def test_every_format_has_a_case():
    assert {c[2] for c in CASES.values()} == set(available_formats())
    assert available_formats()[0] == "ipynb" and available_formats()[-1] == "text"


@pytest.mark.parametrize(
    ("name", "hints", "data", "converter"),
    [
        ("x.csv", {"mimetype": "text/plain"}, "a,b\n1,2\n", "csv"),
        ("x.json", {}, "{broken", "text"),
        (None, {}, "<!doctype html><p>x</p>", "text"),
        (None, {}, "<?xml version='1.0'?><a>b</a>", "xml"),
        (None, {}, "<?xml version='1.0'?><rss><channel><title>t</title></channel></rss>", "xml"),
        ("x.xml", {}, "<rss><channel><item><title>t</title></item></channel></rss>", "feed"),
        ("x.eml", {}, "Subject: x\n\nbody", "text"),
    ],
)
def test_routing(name, hints, data, converter):
    assert convert(name, data, **hints).converter == converter


def test_mismatch_and_errors():
    assert ("type_mismatch", "declared audio/wav, content looks like audio/x-wav") in convert("a.wav", S.wav(8)).warnings
    c = convert("a.docx", S.pdf(["Some words here."]))
    assert c.converter == "pdf" and c.warnings[-2][0] == "type_mismatch" or c.warnings[-1][0] == "type_mismatch"
    for data, hints, code in (("{broken", {"name": "x.json", "mimetype": "application/json"}, "malformed"), (b"\0\1\2\3" * 9, {"name": "x.bin"}, "unsupported"), (b"PK\5\6" + bytes(18), {"name": "x.zip"}, "unsupported")):
        with pytest.raises(ConvertError) as e:
            convert(hints.pop("name"), data, **hints)
        assert e.value.code == code


def test_options_are_strict():
    for bad in ({"nonsense": 1}, {"limits": {"max_rows": 1}}, {"enable": ["nope"]}, {"enable": []}, {"templates": {"blocks": {"raw": "x"}}}, {"templates": {"document": "{% include 'x' %}"}}):
        with pytest.raises(ConvertError):
            DocumentEngine(bad)
    assert Options.of({"limits": {"max_depth": 1}}).limits.max_depth == 1
    assert convert("s.csv", SALES, {"enable": ["text"]}).converter == "text"


def test_limits():
    with pytest.raises(ConvertError, match="max_input_bytes"):
        convert("a.txt", "x" * 64, {"limits": {"max_input_bytes": 8}})
    c = convert("w.csv", "n\n1\n2\n3\n4\n", {"limits": {"max_table_rows": 2}})
    assert c.markdown.endswith("| 2 |\n\n_… 1 further rows omitted_\n") and c.warnings[0][0] == "truncated"
    c = convert("a.txt", "\n\n".join("word" for _ in range(50)), {"limits": {"max_output_bytes": 40}})
    assert len(c.markdown) <= 40 and c.warnings[-1][0] == "truncated"
    small = {"limits": {"max_expanded_bytes": 4096}}
    c = convert("z.zip", S.zipped({"bomb.txt": b"\0" * (4 << 20), "ok.txt": "fine"}), small)
    assert c.warnings[0][0] == "skipped_member" and "fine" in c.markdown
    with pytest.raises(ConvertError, match="max_expanded_bytes"):
        convert("d.docx", S.docx(S.para(S.run("x" * 9000))), small)
    c = convert("z.zip", S.zipped({f"{i}.txt": "x" for i in range(9)}), {"limits": {"max_embedded_documents": 3}})
    assert len(c.document.blocks) == 3 and c.warnings[-1][0] == "truncated"
    deep = S.zipped({"in.zip": S.zipped({"a.txt": "hidden"})})
    c = convert("z.zip", deep, {"limits": {"max_depth": 1}})
    assert "hidden" not in c.markdown and "max_depth" in c.warnings[0][1]
    assert "hidden" in convert("z.zip", deep).markdown


def test_hostile_xml():
    c = convert("x.xml", '<!DOCTYPE a [<!ENTITY e SYSTEM "file:///etc/passwd">]><a>&e; safe</a>')
    assert "root:" not in c.markdown and "safe" in c.markdown
    laughs = '<!DOCTYPE l [<!ENTITY a "ha"><!ENTITY b "&a;&a;">]><l>&b;</l>'
    assert len(convert("x.xml", laughs).markdown) < 100
    assert "kept" in convert("x.xml", "<a><b>kept</c></a>").markdown


def test_a_failing_converter_costs_one_attempt():
    e = DocumentEngine()
    e.register("boom", 0, lambda head, h: True, lambda data, h, cx: 1 / 0)
    assert e.converter_names[1] == "boom"
    assert e.convert_one(b"hello", Hints.of(filename="a.txt")).converter == "text"


def test_output_options():
    c = convert("d.docx", S.docx(S.para(S.run("T"), style="Heading2"), "<dc:title>A: \"b\"</dc:title><dc:creator>M</dc:creator>"), {"output": {"front_matter": "yaml", "heading_offset": 3}})
    assert c.markdown == '---\ntitle: "A: \\"b\\""\nauthor: "M"\n---\n\n##### T\n'
    assert convert("s.csv", SALES, {"output": {"tables": "csv"}}).markdown == '**s.csv**\n\n```csv\nregion,sum,note\nNorth,12,a | b\nSouth,9,\n```\n'
    assert "<td>a | b</td>" in convert("s.csv", SALES, {"output": {"tables": "html"}}).markdown


def test_templates():
    options = {"templates": {"document": "{% if source.filename == 's.csv' %}{{ body }}{% else %}no{% endif %} {{ now }}", "blocks": {"table": "{% for r in block.rows %}{{ loop.index }}={{ r[0] | upper }} {% endfor %}{{ gfm_table(block) | length }} {{ doc.title | default('none') }}"}}}
    assert convert("s.csv", SALES, options).markdown == "1=NORTH 2=SOUTH 84 none\n"
    for bad in ("{% for x in y %}", "{{ x | nope }}", "{{ open('/etc/passwd') }}"):
        with pytest.raises(ConvertError):
            DocumentEngine({"templates": {"document": bad}})


def test_documents_travel_as_json():
    doc, _, _ = DocumentEngine().parse(S.zipped({"a.txt": "hi", "b.csv": "k\n1"}), Hints.of(filename="z.zip"))
    again = document_from_json(as_json(doc))
    assert DocumentEngine().render_document(again) == DocumentEngine().render_document(doc)
    assert block_count(doc.blocks) == 4
    assert DocumentEngine().render_document(Document(blocks=[paragraph(text("a_b _c_ *"))]))[0] == "a_b \\_c\\_ \\*\n"


def test_exif_and_wave_facts():
    c = convert("i.jpg", S.jpeg_exif({0x013B: "Mira", 0x0110: "Cam", 0x9003: "2024:01:02"}))
    assert (c.document.metadata.author, c.document.metadata.created, c.document.metadata.get("Model")) == ("Mira", "2024:01:02", "Cam")
    assert convert("a.wav", S.wav(8000)).document.metadata.get("duration") == "1.0s"


def test_scanned_pages_are_named():
    c = convert("p.pdf", S.pdf(["Words on the first page."], []))
    assert c.document.metadata.get("pdf_scanned_pages") == "2" and c.warnings[-1][0] == "no_text_layer"


def test_nested_tables_and_split_runs():
    inner = S.word_table(["x", "y"])
    body = f"<w:tbl><w:tr><w:tc>{S.para(S.run('a'))}{inner}</w:tc><w:tc>{S.para(S.run('b'))}</w:tc></w:tr></w:tbl>" + S.word_table(["c"], ["d"])
    assert convert("d.docx", S.docx(body)).markdown == "| a<br>x y | b |\n| --- | --- |\n\n| c |\n| --- |\n| d |\n"
    split = "<a:p><a:r><a:t>Hel</a:t></a:r><a:r><a:t>lo, all</a:t></a:r></a:p>"
    assert convert("d.pptx", S.pptx([split])).markdown == "## Slide 1\n\nHello, all\n"


def test_ods_and_sheet_details():
    ods = S.zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<o:document-content xmlns:o="o" xmlns:t="t" xmlns:x="x"><t:table t:name="S"><t:table-row><t:table-cell><x:p>k</x:p></t:table-cell><t:table-cell><x:p>v</x:p></t:table-cell></t:table-row><t:table-row><t:table-cell o:value-type="float" o:value="2"><x:p>2,00</x:p></t:table-cell><t:table-cell o:value-type="date" o:date-value="2024-01-02"/></t:table-row></t:table></o:document-content>'})
    c = convert("s.ods", ods)
    assert (c.converter, c.markdown) == ("spreadsheet", "## S\n\n| k | v |\n| --- | --- |\n| 2 | 2024-01-02 |\n")
    assert c.warnings[0][0] == "type_mismatch"
    with pytest.raises(ConvertError, match="malformed"):
        convert("old.xls", S.compound({"Workbook": b"x"}))
    with pytest.raises(ConvertError, match="no workbook"):
        convert("old.xls", S.compound({"Other": b"x"}))


SHEETS = {"One": [["name", "day", "ok"], ["Ä x", 45000, True], [2.5, 45000.5, "#N/A"], ["=sum", 7, False]], "Empty": []}
SHEETS_SAID = "## One\n\n| name | day | ok |\n| --- | --- | --- |\n| Ä x | 2023-03-15 | true |\n| 2\\.5 | 2023-03-15T12:00:00 | \\#NA |\n| sum | 1900-01-06 | false |\n\n## Empty\n\n(empty sheet)\n"


@pytest.mark.parametrize(("name", "data"), [("a.xls", S.xls(SHEETS, (1,))), ("a.xlsb", S.xlsb(SHEETS, (1,)))])
def test_binary_workbooks(name, data):
    c = convert(name, data)
    assert (c.converter, c.markdown) == ("spreadsheet", SHEETS_SAID)
    short = convert(name, data, {"limits": {"max_table_rows": 2}})
    assert short.warnings[0] == ("truncated", "sheet One: 4 rows, capped at 2") and "sum" not in short.markdown
    for cut in range(0, len(data), 97):  # damaged files fail as documents, not as jobs
        try:
            convert(name, data[:cut])
        except ConvertError:
            pass


def test_strings_that_continue_in_another_record():
    from vellum.sources.workbooks import _Parts, format_kind, number_text, rk

    assert _Parts([b"\1a\0b\0", b"\0cd"]).string(4) == "abcd"
    assert _Parts([b"\0ab", b"\1c\0d\0"]).string(4) == "abcd"
    assert [format_kind(*x) for x in ((14, None), (46, None), (0, None), (170, "[h]:mm"), (170, '"day" 0.0'), (170, "yyyy"))] == ["date", "duration", "", "duration", "", "date"]
    assert (number_text(1.5, "duration"), number_text(3.0), number_text(0.1), number_text(0, "date", True)) == ("36.0000 h", "3", "0.1", "1904-01-01")
    assert (rk(7 << 2 | 2), rk(150 << 2 | 3), rk(0x3FF00000)) == (7.0, 1.5, 1.0)


def test_sheets_begin_where_cells_do():
    rows = '<row r="3"><c r="C3"><v>1</v></c><c r="E3"><v>2</v></c></row><row r="5"><c r="D5" t="e"><v>#REF!</v></c></row>'
    assert convert("w.xlsx", S.xlsx({"S": rows})).markdown == "## S\n\n| 1 |  | 2 |\n| --- | --- | --- |\n|  |  |  |\n|  | \\#Ref |  |\n"


def test_pdf_fonts():
    from vellum.sources.binary import _Font, glyph

    assert convert("a.pdf", S.pdf_with_fonts("Größe: 10 Ω, not more", "and “that” is all.")).markdown == "Größe: 10 Ω, not more and “that” is all.\n"
    assert [glyph(x) for x in ("eacute", "A", "uni20AC", "Ccedilla", "fi", "nope", "a.sc")] == ["é", "A", "€", "Ç", "fi", "", "a"]
    assert _Font(b"1 beginbfrange <20> <22> <0041> <30> <31> [<0061> <00620063>] endbfrange", b"", False).text(b" !\x2201z") == "ABCabcz"


def test_broken_markup_takes_linear_time():
    import time

    from vellum.sources.markup import closed_elements, html_to_markdown

    began = time.time()
    assert html_to_markdown('<a "' * 30000) == ""
    assert html_to_markdown('<p class="x>text</p> more') == "text\n\nmore"
    assert html_to_markdown("<ul><li>" * 3).split() == ["*"] * 3
    assert html_to_markdown("<!-- a -->" * 20000 + "a<br>b") == "a  \nb"
    assert [n.name for n in closed_elements('<a "' * 30000 + ">")] == ["a"]
    assert [(n.name, n.text) for n in closed_elements("<!DOCTYPE a [<!ENTITY e 'x>'>]><a b='>'><c/>x<![CDATA[<y>]]></a>")] == [("c", ""), ("a", "x<y>")]
    assert time.time() - began < 5


def test_charsets():
    from vellum.operators.detect import charset_of

    for said, encoding, want in (("Привет, как дела сегодня", "cp1251", "windows-1251"), ("日本語のテキスト、これは", "shift_jis", "shift_jis"), ("日本語のテキスト、これは", "euc-jp", "euc-jp"), ("한국어 문장입니다 그리고", "euc-kr", "euc-kr"), ("café déjà vu naïve", "cp1252", "windows-1252"), ("größer", "utf-8", "utf-8")):
        assert charset_of(said.encode(encoding)) == want


def test_latin_letters_are_no_other_script():
    from vellum.operators.detect import PROBE, charset_of

    for said in ("Domi no ciónírres del.", "Esasue osll. Asie ciónñci jacimi.", "Anaieux éé èçou éç.", "DANS ÈÉÈIER", "Èréè.", "Du reçé.", "lich ü", "Ññ.", "ÑÍ DEL", "né", "é", "Entrée\nRéférences de version:", "pa ench de ouè" + " a" * 5000, "a" * (PROBE - 1) + "é la", "a" * (PROBE - 2) + "éé la"):
        assert charset_of(said.encode("latin-1")) == "windows-1252", said
    for said in ("a" * (PROBE - 1) + "é", "a" * (PROBE - 2) + "日本", "a" * (PROBE - 3) + "\U0001f600\xe9", "a" * PROBE + "é"):
        assert charset_of(said.encode()) == "utf-8"
    for said, encoding, want in (("Привет", "cp1251", "windows-1251"), ("Файл не найден: SMS", "cp1251", "windows-1251"), ("找不到檔案 file.txt", "big5", "big5"), ("系统找不到指定的文件，请检查路径是否正确 Python", "gb18030", "gb18030"), ("ファイルが file.txt", "shift_jis", "shift_jis")):
        assert charset_of(said.encode(encoding)) == want, said


def test_charset_query_on_short_latin_texts(spark, tmp_path):
    import duckdb

    from vellum import catalog, catalog_engine  # noqa: F401

    said = ["Domi no ciónírres del.", "Anaieux éé èçou éç.", "De ciónñci", "lich ü", "no accents", "", "a" * 8191 + "é la", "a" * 8192 + "é"]
    rows = spark.createDataFrame([(3 * i + k, text) for i, text in enumerate(said) for k in range(3)] + [(99, None)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["sniff_charset"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["sniff_charset"](spark, str(tmp_path)).collect())) == sorted(want)


def test_callers_context():
    engine = DocumentEngine()
    cx = engine._context()
    cx.budget.expanded = cx.limits.max_expanded_bytes
    with pytest.raises(ConvertError, match="max_expanded_bytes"):
        engine.convert_one(S.docx(S.para(S.run("x"))), Hints.of(filename="a.docx"), cx=cx)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("{{ 1 + 2 * 3 - 4 // 2 }} {{ 7 / 2 }} {{ 7 % 4 }} {{ -2 ** 2 }}", "5 3.5 3 -4"),
        ("{{ 'a' ~ 1 ~ none }} {{ 'x' if 1 > 2 else 'y' }} {{ 'b' in ['a', 'b'] }} {{ 3 not in [1] }}", "a1 y true true"),
        ("{{ nope is defined }} {{ nope is not defined }} {{ 3 is odd and not false or 0 }}", "false true true"),
        ("{% for k, v in d | items %}{{ k }}={{ v }};{% else %}none{% endfor %}{% for x in [] %}{% else %}empty{% endfor %}", "a=1;b=2;empty"),
        ("{% set n = l | length + 1 %}{{ n }} {{ l[1:] | join('/') }} {{ l[-1] }} {{ l | reverse | first }}", "4 y/z z z"),
        ("a {%- if true -%} b {%- endif -%} c {{- 'd' -}} e {#- no -#} f", "abcdef"),
        ("{% raw %}{{ x }}{% endraw %} {{ 'it\\'s' | replace('s', 'S') | title }} {{ 'a\nb' | indent(2) | lines | length }}", "{{ x }} It'S 2"),
        ("{{ [3, 1, 3] | unique | sort | tojson }} {{ '4.6' | float | round | int }} {{ [1, 2] | sum }}", "[1, 3] 5 3"),
    ],
)
def test_template_language(source, want):
    from vellum.operators.template import compiled

    assert compiled(source)({"d": {"a": 1, "b": 2}, "l": ["x", "y", "z"]}) == want


def test_templates_are_bounded():
    from vellum.operators.template import compiled

    for bad in ("{{ 'x' * 9999999999 }}", "{{ range(99999999) }}", "{{ 9 ** 99999 }}", "{{ 1 + 'a' }}", "{{ [1] * 9999999 * 9 }}"):
        with pytest.raises(ConvertError):
            compiled(bad)({})
