"""Queries over the engine: detection, routing, two-phase conversion, rendering, templates and limits, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import TWO, _spaced, query, s_escape, s_quoted, s_trim, table
from .catalog_formats import built, listed, said
from .functions import columns as C
from .operators import frames
from .plans.engine import DocumentEngine, as_json, available_formats
from .plans.model import ConvertError, Document, Metadata, code, emphasis, heading, link, paragraph, raw, strong, text
from .plans.model import table as table_block
from .sources import samples as S

PARTS = f"list_transform(list_filter(list_transform(string_split({TWO}, chr(10) || chr(10)), lambda p: {s_trim('p')}), lambda p: p != ''), lambda p: replace(p, chr(10), ' '))"
MARKDOWN = f"list_aggregate(list_transform(p, lambda p: {s_escape('p')}), 'string_agg', chr(10) || chr(10)) || chr(10)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", _spaced().alias("content"), F.lit("document.txt").alias("filename"))


# texts

@query(f"SELECT doc_id, {MARKDOWN} AS markdown, 'text' AS converter, 'extension' AS detected_via, NULL::VARCHAR AS title, '' AS warnings, NULL::VARCHAR AS code FROM (SELECT doc_id, {PARTS} AS p FROM documents)")
def engine_convert_text(spark, sf_dir):
    out = DocumentEngine().convert(_texts(spark, sf_dir))
    return out.select("doc_id", "markdown", "converter", "detected_via", "title", listed("warnings").alias("warnings"), F.col("error.code").alias("code"))


@query(f"SELECT doc_id, unnest(range(len(p)))::INT AS block_ord, NULL::INT AS parent_ord, 0::INT AS depth, 'paragraph' AS kind, unnest(p) AS text FROM (SELECT doc_id, {PARTS} AS p FROM documents)")
def engine_blocks(spark, sf_dir):
    return DocumentEngine().blocks(_texts(spark, sf_dir)).select("doc_id", "block_ord", "parent_ord", "depth", "kind", "text")


@query(f"""SELECT doc_id, '---' || chr(10) || 'title: ' || {s_quoted('lang')} || chr(10) || 'doc_id: "' || doc_id || '"' || chr(10) || '---' || chr(10) || chr(10) || {MARKDOWN} AS markdown, len(p)::INT AS block_count FROM (SELECT doc_id, coalesce(lang, 'none') AS lang, {PARTS} AS p FROM documents)""")
def engine_two_phase(spark, sf_dir):
    """Parsed into documents, which get a title and a value from columns, and then rendered."""
    engine = DocumentEngine({"output": {"front_matter": "yaml"}})
    parsed = engine.to_ir(_texts(spark, sf_dir)).drop("warnings", "error")
    named = F.concat(F.lit('{"title": "'), F.coalesce("lang", F.lit("none")), F.lit('", "metadata": {"extra": [["doc_id", "'), F.col("doc_id").cast("string"), F.lit('"]]}, '))
    changed = parsed.withColumn("document", F.concat(named, F.substring("document", F.instr("document", '"blocks": '), F.length("document"))))
    return engine.render(changed).select("doc_id", "markdown", "block_count")


@query("""SELECT doc_id, '---' || chr(10) || 'source: ' || doc_id || '.txt at noon' || chr(10) || '---' || chr(10) || chr(10) || upper(replace(list_aggregate(p, 'string_agg', chr(10) || chr(10)), 'ß', 'SS')) || chr(10) AS markdown, NULL::VARCHAR AS code FROM (SELECT doc_id, """ + PARTS + " AS p FROM documents)")
def engine_templated(spark, sf_dir):
    options = {"templates": {"document": "---\nsource: {{ source.filename }} at {{ now }}\n---\n\n{{ body }}", "blocks": {"paragraph": "{{ block.text | upper }}"}}}
    rows = _texts(spark, sf_dir).withColumn("filename", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return DocumentEngine(options).convert(rows, now="noon").select("doc_id", "markdown", F.col("error.code").alias("code"))


@query("""SELECT doc_id, extension, CASE extension WHEN 'csv' THEN 'csv' WHEN 'html' THEN 'html' ELSE 'text' END AS converter, 'extension' AS detected_via, NULL::VARCHAR AS code FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'xml' WHEN 4 THEN 'html' ELSE 'eml' END AS extension FROM documents)""")
def registry_dispatch(spark, sf_dir):
    """The same text under different names: a converter that fails leaves it to the next one."""
    k = F.col("doc_id") % 6
    ext = F.when(k == 0, "txt").when(k == 1, "csv").when(k == 2, "json").when(k == 3, "xml").when(k == 4, "html").otherwise("eml")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), ext.alias("extension"))
    return DocumentEngine().convert(rows).select("doc_id", "extension", "converter", "detected_via", F.col("error.code").alias("code"))


def _front(mark: str, between: str) -> str:
    pairs = f"'title{between}' || {s_quoted('text')} || chr(10) || 'author{between}' || {s_quoted('source')} || chr(10) || 'language{between}' || {s_quoted('lang')} || chr(10) || '\"odd key\"{between}' || {s_quoted('lang')}"
    return f"SELECT doc_id, '{mark}' || chr(10) || {pairs} || chr(10) || '{mark}' || chr(10) AS front FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL"


def _with_front(spark, sf_dir, style: str) -> DataFrame:
    """Whole texts as titles."""
    metadata = F.struct(F.col("source").alias("author"), F.col("lang").alias("language"), F.array(F.array(F.lit("odd key"), F.col("lang")), F.array(F.lit("none"), F.lit(""))).alias("extra"))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    rows = rows.select("doc_id", F.to_json(F.struct(F.col("text").alias("title"), metadata.alias("metadata"))).alias("document"))
    return DocumentEngine({"output": {"front_matter": style}}).render(rows).select("doc_id", F.col("markdown").alias("front"))


@query(_front("---", ": "))
def yaml_front_matter(spark, sf_dir):
    return _with_front(spark, sf_dir, "yaml")


@query(_front("+++", " = "))
def toml_front_matter(spark, sf_dir):
    return _with_front(spark, sf_dir, "toml")


@query(f"""SELECT d.doc_id, {s_escape('text')} || chr(10) || CASE WHEN l.quality IS NULL THEN '' ELSE chr(10) || '![](' || d.doc_id || '.png)' || chr(10) || chr(10) || '*quality ' || l.quality || '*' || chr(10) END AS markdown FROM (SELECT doc_id, {s_trim('text')} AS text FROM documents WHERE text IS NOT NULL) d LEFT JOIN labels l ON d.doc_id = l.doc_id""".replace("'![](' || d.doc_id || '.png)' || chr(10) || chr(10) || '*quality ' || l.quality || '*'", "'![seen](' || d.doc_id || '.png)' || chr(10) || chr(10) || '*quality ' || l.quality || '*'"))
def enrich_caption_join(spark, sf_dir):
    """Captions from another table, joined to documents before these are rendered."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text").join(labels, "doc_id", "left")
    spans = F.to_json(F.array(F.struct(F.lit("text").alias("span"), F.col("text"))))
    image = F.concat(F.lit(', {"type": "image", "kind": "url", "alt": "seen", "source": "'), F.col("doc_id").cast("string"), F.lit('.png", "caption": "quality '), F.col("quality").cast("string"), F.lit('"}'))
    blocks = F.concat(F.lit('{"blocks": [{"type": "paragraph", "text": '), spans, F.lit("}"), F.coalesce(image, F.lit("")), F.lit("]}"))
    return DocumentEngine().render(rows.select("doc_id", blocks.alias("document"))).select("doc_id", "markdown")


@query(f"""SELECT conv_id, string_agg(n || '. ' || role || chr(10) || chr(10) || repeat(' ', length(n || '. ')) || '> ' || {s_escape('text')}, chr(10) ORDER BY turn, role, text) || chr(10) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM (SELECT conv_id, turn, {s_escape('role')} AS role, {s_trim('text')} AS text FROM conversations)) GROUP BY conv_id""")
def list_block(spark, sf_dir):
    """A numbered list for each conversation, whose items hold a paragraph and a quote."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spans = lambda c: F.to_json(F.array(F.struct(F.lit("text").alias("span"), F.col(c).alias("text"))))
    item = F.concat(F.lit('[{"type": "paragraph", "text": '), spans("role"), F.lit('}, {"type": "quote", "blocks": [{"type": "paragraph", "text": '), spans("text"), F.lit("}]}]"))
    items = frames.joined(rows, ["conv_id"], ["turn", "role", "text"], item, ", ", "items")
    documents = items.select("conv_id", F.concat(F.lit('{"blocks": [{"type": "list", "ordered": true, "items": ['), "items", F.lit("]}]}")).alias("document"))
    return DocumentEngine().render(documents).select("conv_id", "markdown")


# JSON

@query("""SELECT event_id, 'json' AS converter, '```json' || chr(10) || '{' || chr(10) || '  "event": [' || chr(10) || '    {' || chr(10) || '      "k": ' || json_extract_string(props, '$.k') || chr(10) || '    },' || chr(10) || '    1.50,' || chr(10) || '    null' || chr(10) || '  ]' || chr(10) || '}' || chr(10) || '```' || chr(10) AS markdown FROM events""")
def json_fenced(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"event": ['), "props", F.lit(", 1.50, null]}")).alias("content"), F.lit("event.json").alias("filename"))
    return DocumentEngine().convert(rows).select("event_id", "converter", "markdown")


@query(f"""SELECT batch, CASE WHEN first THEN '| event_id | k | n | ok | t |' ELSE '| event_id | t | k | n | ok |' END || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg('| ' || event_id || CASE WHEN event_id % 2 = 0 AND first THEN ' | ' || json_extract_string(props, '$.k') || ' |  | true |  |' WHEN first THEN ' |  |  |  | ' || {s_escape('event_type', True)} || ' |' WHEN event_id % 2 = 0 THEN ' |  | ' || json_extract_string(props, '$.k') || ' |  | true |' ELSE ' | ' || {s_escape('event_type', True)} || ' |  |  |  |' END, chr(10) ORDER BY event_id) || chr(10) AS markdown FROM (SELECT *, event_id // 50 AS batch, min(event_id) OVER (PARTITION BY event_id // 50) % 2 = 0 AS first FROM events) GROUP BY batch, first""")
def json_table(spark, sf_dir):
    """Fifty events a file, as an array or as lines: objects with different keys, in one table."""
    rows = table(spark, sf_dir, "events").withColumn("batch", F.floor(F.col("event_id") / 50))
    even = F.concat(F.lit('{"ok": true, "n": null, "k": '), F.get_json_object("props", "$.k"), F.lit(', "event_id": '), F.col("event_id").cast("string"), F.lit("}"))
    odd = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "t": "'), "event_type", F.lit('"}'))
    bodies = frames.joined(rows, ["batch"], ["event_id"], F.when(F.col("event_id") % 2 == 0, even).otherwise(odd), "\n", "body")
    lines = F.col("batch") % 2 == 1
    files = bodies.select("batch", F.when(lines, F.col("body")).otherwise(F.concat(F.lit("["), F.replace("body", F.lit("\n"), F.lit(",\n")), F.lit("]"))).alias("content"), F.when(lines, "jsonl").otherwise("json").alias("extension"))
    return DocumentEngine().convert(files).select("batch", "markdown")


# detection

@query("""SELECT page_id, CASE WHEN e = 'html' THEN 'extension' ELSE 'none' END AS signal, CASE WHEN e = 'html' THEN 'text/html' ELSE 'text/plain' END AS mimetype, nullif(e, '') AS extension, CASE WHEN e = 'html' THEN NULL ELSE 'utf-8' END AS charset, CASE WHEN e = 'html' THEN 2 ELSE 1 END::INT AS guesses FROM (SELECT page_id, lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]*/(?:.*/)?([^/]*)$', 1), '\\.([^.]+)$', 1)) AS e FROM pages) WHERE e IN ('', 'html')""".replace("\\\\", "\\"))
def detect_signal(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"), C.extension(F.col("url")).alias("extension")).filter("extension IN ('', 'html')")
    out = DocumentEngine().detect(rows)
    return out.select("page_id", "signal", F.col("guesses")[0]["mimetype"].alias("mimetype"), F.col("guesses")[0]["extension"].alias("extension"), F.col("guesses")[0]["charset"].alias("charset"), F.size("guesses").alias("guesses"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'declared text/plain, content looks like application/pdf' WHEN 3 THEN 'declared application/zip, content looks like application/pdf' WHEN 4 THEN 'declared application/vnd.openxmlformats-officedocument.wordprocessingml.document, content looks like application/pdf' END AS mismatch, 'content' AS signal, 'application/pdf' AS mimetype, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 3 END::INT AS guesses FROM documents""")
def detect_mismatch(spark, sf_dir):
    k = F.col("doc_id") % 5
    declared = F.when(k == 0, "Text/Plain; charset=x").when(k == 1, "application/pdf").when(k == 2, "application/octet-stream").when(k == 3, "application/zip")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("%PDF-1.4 "), F.coalesce("text", F.lit(""))).alias("content"), declared.alias("mimetype"), F.when(k == 4, ".DOCX").alias("extension"))
    out = DocumentEngine().detect(rows)
    return out.select("doc_id", "mismatch", "signal", F.col("guesses")[0]["mimetype"].alias("mimetype"), F.size("guesses").alias("guesses"))


@query(r"""SELECT doc_id, 'text/plain' AS mimetype, CASE WHEN doc_id % 3 = 2 AND regexp_matches(left(text, 8192), '[^\x00-\x7f]') THEN 'windows-1252' ELSE 'utf-8' END AS charset, 'none' AS signal FROM documents WHERE text IS NOT NULL""")
def sniff_charset(spark, sf_dir):
    """UTF-8, UTF-8 with a byte order mark, and Latin letters in single bytes."""
    k = F.col("doc_id") % 3
    data = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "ISO-8859-1"))
    out = DocumentEngine().detect(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", data.alias("content")))
    return out.select("doc_id", F.col("guesses")[0]["mimetype"].alias("mimetype"), F.col("guesses")[0]["charset"].alias("charset"), "signal")


DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: Name, content, declared type and extension; first guess's type, signal, mismatch and number of guesses.
DETECTIONS = [
    ("pdf", b"%PDF-1.7", None, None, "application/pdf", "content", None, 1),
    ("ole", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", None, "msg", "application/vnd.ms-outlook", "content", None, 2),
    ("png", S.PNG, None, None, "image/png", "content", None, 1),
    ("jpeg as png", b"\xff\xd8\xff\xe0", "image/png", None, "image/jpeg", "content", "declared image/png, content looks like image/jpeg", 2),
    ("gif", b"GIF89a", None, "gif", "image/gif", "content", None, 2),
    ("webp", b"RIFF\0\0\0\0WEBPVP8 ", None, None, "image/webp", "content", None, 1),
    ("wave", S.wav(8), None, None, "audio/x-wav", "content", None, 1),
    ("avi", b"RIFF\0\0\0\0AVI LIST", None, None, "video/x-msvideo", "content", None, 1),
    ("tiff", b"MM\0*\0\0\0\x08", None, None, "image/tiff", "content", None, 1),
    ("icon", b"\0\0\1\0\1\0", None, None, "image/vnd.microsoft.icon", "content", None, 1),
    ("mp3", b"ID3\3", None, "mp3", "audio/mpeg", "content", None, 2),
    ("opus", b"OggS" + bytes(24) + b"OpusHead", None, None, "audio/opus", "content", None, 1),
    ("vorbis", b"OggS" + bytes(24) + b"\1vorbis", None, "ogg", "audio/ogg", "content", None, 2),
    ("flac", b"fLaC\0", None, None, "audio/x-flac", "content", None, 1),
    ("midi", b"MThd\0\0", None, None, "audio/midi", "content", None, 1),
    ("aiff", b"FORM\0\0\0\0AIFF", None, None, "audio/x-aiff", "content", None, 1),
    ("heic", b"\0\0\0\x18ftypheic", None, "heic", "image/heif", "content", None, 2),
    ("avif", b"\0\0\0\x18ftypavif", None, None, "image/avif", "content", None, 1),
    ("mp4", b"\0\0\0\x18ftypisom", None, None, "video/mp4", "content", None, 1),
    ("quicktime", b"\0\0\0\x14ftypqt  ", None, None, "video/quicktime", "content", None, 1),
    ("webm", b"\x1aE\xdf\xa3\x01\0", None, None, "video/webm", "content", None, 1),
    ("docx", S.docx(""), None, "docx", DOCX, "content", None, 2),
    ("docx as zip", S.docx(""), "application/zip", None, DOCX, "content", None, 2),
    ("zip as docx", S.zipped({"a": "b"}), None, "docx", "application/zip", "content", f"declared {DOCX}, content looks like application/zip", 3),
    ("pptx", S.pptx([""]), None, None, "application/vnd.openxmlformats-officedocument.presentationml.presentation", "content", None, 1),
    ("xlsx", S.xlsx({"s": ""}), None, None, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "content", None, 1),
    ("epub", S.epub({}, []), None, None, "application/epub+zip", "content", None, 1),
    ("text by name", b"a,b", None, "csv", "text/csv", "extension", None, 2),
    ("declared", b"a,b", "text/csv", None, "text/csv", "declared", None, 1),
    ("declared and named", b"a,b", "text/csv", "txt", "text/plain", "extension", None, 2),
    ("text/* agree", b"%PDF", "text/plain", "md", "text/markdown", "extension", None, 2),
    ("plain", b"some words", None, None, "text/plain", "none", None, 1),
    ("empty", b"", None, None, "text/plain", "none", None, 1),
    ("controls", b"\1\2\3\4 words", None, None, None, "none", None, 1),
    ("unknown name", b"words", None, "nosuch", None, "declared", None, 1),
]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


@query(_values([(d[0], *d[4:]) for d in DETECTIONS], "name, mimetype, signal, mismatch, guesses"))
def detect_cases(spark, sf_dir):
    rows = spark.createDataFrame([d[:4] for d in DETECTIONS], "name string, content binary, mimetype string, extension string")
    out = DocumentEngine().detect(rows)
    return out.select("name", F.col("guesses")[0]["mimetype"].alias("mimetype"), "signal", "mismatch", F.size("guesses").alias("guesses"))


@query(_values(list(enumerate(["ipynb", "msg", "audio", "image", "pdf", "epub", "spreadsheet", "pptx", "docx", "feed", "json", "csv", "xml", "html", "zip", "text"])), "place, name"))
def engine_formats(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(available_formats())), "place int, name string")


# routing

@query("""SELECT n_nationkey::INT AS n_nationkey, 'custom' AS converter, 'extension' AS detected_via, 'T ' || n_nationkey AS title, '## ' || length(n_name) || ' bytes' || chr(10) AS markdown FROM nation""")
def engine_registered(spark, sf_dir):
    """A converter of the caller's own, ahead of the built-in ones; one before it that breaks costs an attempt."""
    engine = DocumentEngine()
    engine.register("custom", 0, lambda head, h: h.extension == "txt", lambda data, h, cx: Document(f"T {h.charset}", blocks=[heading(2, text(f"{len(data)} bytes"))]))
    engine.register("broken", -5, lambda head, h: True, lambda data, h, cx: 1 / 0)
    files = built(spark, sf_dir, "a.txt", lambda n, k: n).withColumn("charset", F.col("n_nationkey").cast("string"))
    return engine.convert(files).select("n_nationkey", "converter", "detected_via", "title", "markdown")


@query("SELECT n_nationkey::INT AS n_nationkey, " + said("k,{name}  1,2") + " AS markdown, 'text' AS converter FROM nation".replace("  ", " "))
def engine_enabled(spark, sf_dir):
    out = DocumentEngine({"enable": ["text", "html"]}).convert(built(spark, sf_dir, "a.csv", lambda n, k: f"k,{n}\n\n1,2"))
    return out.select("n_nationkey", F.replace(F.rtrim(F.replace("markdown", F.lit("\n"), F.lit(" "))), F.lit("\x00"), F.lit("")).alias("markdown"), "converter")


CSV = [
    ("plain", "csv", "k,name\n%d,\"a | b, c\"\n,x\n", "| k | name |\n| --- | --- |\n| {key} | a \\| b, c |\n|  | x |\n"),
    ("semicolons", "csv", "k;name\n%d;a_\n", "| k | name |\n| --- | --- |\n| {key} | a\\_ |\n"),
    ("no header", "csv", "%d,2\n3,4\n", "|  |  |\n| --- | --- |\n| {key} | 2 |\n| 3 | 4 |\n"),
    ("ragged", "csv", "a,b\n%d\n1,2,3\n", "| a | b |  |\n| --- | --- | --- |\n| {key} |  |  |\n| 1 | 2 | 3 |\n"),
    ("tabs", "tsv", "a\tb\n%d\t1,5\n", "| a | b |\n| --- | --- |\n| {key} | 1,5 |\n"),
    ("one line", "csv", "1,%d\n", "| 1 | {key} |\n| --- | --- |\n"),
    ("lines in cells", "csv", "a,b\n\"x\ny\",%d\n", "| a | b |\n| --- | --- |\n| x<br>y | {key} |\n"),
]


@query(" UNION ALL ".join(f"SELECT '{c}' AS kind, n_nationkey::INT AS n_nationkey, {said(m)} AS markdown FROM nation" for c, _, _, m in CSV))
def csv_kinds(spark, sf_dir):
    out = None
    for kind, ext, body, _ in CSV:
        rows = table(spark, sf_dir, "nation").select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("int"), F.format_string(body, "n_nationkey").alias("content"), F.lit(ext).alias("extension"))
        out = rows if out is None else out.unionByName(rows)
    return DocumentEngine().convert(out).select("kind", "n_nationkey", "markdown")


@query("SELECT n_nationkey::INT AS n_nationkey, " + said("# Of {name}\n\n- {key}\n\n*kept* as | it is\n") + " AS markdown, " + said("Of {name}") + " AS title FROM nation")
def markdown_passthrough(spark, sf_dir):
    return DocumentEngine({"output": {"heading_offset": 2}}).convert(built(spark, sf_dir, "a.md", lambda n, k: f"# Of {n}\n\n- {k}\n\n*kept* as | it is\n\n")).select("n_nationkey", "markdown", "title")


# rendering

def _document(name: str, key: int) -> Document:
    """Every kind of block and span."""
    inner = Document("inner", blocks=[heading(1, text("Deep")), paragraph(text(f"in {name}"))])
    spans = [*text("a_b _c_ *"), strong("bold"), *text(" "), emphasis("soft "), {"span": "code", "text": "x`y|z"}, {"span": "line_break"}, link(f"[{key}]", "http://x.invalid/a b"), {"span": "strong", "inline": []}]
    rows = [[text("1|2"), [strong("b"), {"span": "line_break"}, {"span": "code", "text": "p|q"}]], [text(f"{key}")], [text("three"), text("x"), text("y\nz")]]
    return Document(
        f'Title "{name}"',
        Metadata(author="A\\B", created="2024", language="en", extra=[("k", str(key)), ("odd key", "v")]),
        [
            heading(1, text(f"# {name}")),
            heading(6, text("last")),
            heading(2, []),
            paragraph(spans),
            paragraph(text("  ")),
            {"type": "list", "ordered": False, "items": [[paragraph(text("one")), {"type": "list", "ordered": True, "items": [[paragraph(text("in"))], [paragraph(text("side"))]]}], [paragraph(text("two"))]]},
            {"type": "quote", "blocks": [paragraph(text("q1")), paragraph(text("q2"))]},
            table_block(rows, ["h", "g"], "Cap_"),
            table_block([], None, "no cells"),
            code("a\n```\nb\n", "sql"),
            code("plain"),
            {"type": "rule"},
            raw("**as is**"),
            {"type": "raw_html", "text": "<u>raw</u>"},
            {"type": "image", "kind": "url", "alt": "al[t]", "caption": None, "source": "http://x.invalid/i(1).png"},
            {"type": "image", "kind": "embedded", "alt": "al", "caption": "cap", "source": "i.png"},
            {"type": "image", "kind": "omitted", "alt": None, "caption": "only", "source": ""},
            {"type": "embedded", "name": f"{name}.txt", "doc": inner},
        ],
    )


def _documents(spark, sf_dir) -> DataFrame:
    def run(batches):
        for b in batches:
            names, keys = (b.column(c).to_pylist() for c in ("n_name", "n_nationkey"))
            yield pa.RecordBatch.from_arrays([b.column("n_nationkey"), pa.array([as_json(_document(n, k)) for n, k in zip(names, keys)])], names=["n_nationkey", "document"])

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name").mapInArrow(run, "n_nationkey int, document string")


SPANS = "a_b \\_c\\_ \\***bold** *soft*`` x`y|z ``  \n[\\[{key}\\]](<http://x.invalid/a b>)"
LISTS = "- one\n\n  1. in\n  2. side\n- two\n\n> q1\n>\n> q2"
CODES = "````sql\na\n```\nb\n````\n\n```\nplain\n```\n\n---\n\n**as is**"
IMAGES = "![al\\[t\\]](<http://x.invalid/i(1).png>)\n\n*[image: i.png]*\n\n*cap*\n\n*[image: only]*"
GFM = "| h | g |  |\n| --- | --- | --- |\n| 1\\|2 | **b**<br>`p\\|q` |  |\n| {key} |  |  |\n| three | x | y<br>z |"


def _rendered(front: str, one: str, six: str, grid: str, html: str, embedded: str) -> str:
    parts = [front, f"{one} \\# {{name}}", f"{six} last", SPANS, LISTS, "**Cap\\_**", grid, "**no cells**", CODES, html, IMAGES, embedded]
    return "\n\n".join(p for p in parts if p) + "\n"


def rendering(name: str, options: dict, markdown: str, warnings: str) -> None:
    def run(spark, sf_dir):
        return DocumentEngine({"output": options.get("output", {}), "limits": options.get("limits", {})}).render(_documents(spark, sf_dir)).select("n_nationkey", "markdown", listed("warnings").alias("warnings"))

    run.__name__ = name
    query(f"SELECT n_nationkey::INT AS n_nationkey, {said(markdown)} AS markdown, {said(warnings)} AS warnings FROM nation")(run)


DROPPED = "degraded: unsupported HTML was dropped"
EMBEDDED = "## {name}.txt\n\n%s Deep\n\nin {name}"
rendering("render_all", {}, _rendered("", "#", "######", GFM, "", EMBEDDED % "###"), DROPPED)
HTML = "<table>\n<thead><tr>\n<th>h</th>\n<th>g</th>\n<th></th>\n</tr></thead>\n<tbody>\n<tr>\n<td>1|2</td>\n<td>b p|q</td>\n<td></td>\n</tr>\n<tr>\n<td>{key}</td>\n<td></td>\n<td></td>\n</tr>\n<tr>\n<td>three</td>\n<td>x</td>\n<td>y\nz</td>\n</tr>\n</tbody>\n</table>"
YAML = '---\ntitle: "Title \\"{name}\\""\nauthor: "A\\\\B"\ncreated: "2024"\nlanguage: "en"\nk: "{key}"\n"odd key": "v"\n---'
rendering("render_yaml_html", {"output": {"front_matter": "yaml", "tables": "html", "heading_offset": 3, "preserve_unsupported_html": True}}, _rendered(YAML, "####", "######", HTML, "<u>raw</u>", EMBEDDED % "######"), "")
TOML = YAML.replace("---", "+++").replace(": ", " = ")
rendering("render_toml_csv", {"output": {"front_matter": "toml", "tables": "csv"}, "limits": {"max_table_rows": 2}}, _rendered(TOML, "#", "######", "```csv\nh,g,\n1|2,b p|q,\n{key},,\n```\n\n_… 1 further rows omitted_", "", EMBEDDED % "###"), "truncated: table truncated to 2 of 3 rows (max_table_rows)\n" + DROPPED)
rendering("render_capped", {"limits": {"max_output_bytes": 90}}, "# \\# {name}\n\n###### last\n", "%s\ntruncated: output truncated at 90 bytes (max_output_bytes)" % DROPPED)


@query("SELECT n_nationkey::INT AS n_nationkey, " + said("T={name} by A7 [k=7]\n\n1:one 2:two|2\n\n|h-g|OR NOT,1\n\n| h | g |\n| --- | --- |\n| 1 | x |\n\npy: a = {key}\n") + " AS markdown FROM nation")
def template_functions(spark, sf_dir):
    blocks = {
        "list": "{% for i in block.items %}{{ loop.index }}:{{ i }}{% if not loop.last %} {% endif %}{% endfor %}|{{ block.items | length }}",
        "table": "|{{ block.header | join('-') }}|{{ 'or not' | upper }},{{ block.rows[0][0] }}\n\n{{ gfm_table(block) }}",
        "code": "{{ block.language | default('none') }}: {{ block.text | trim }}",
    }
    options = {"templates": {"document": "T={{ doc.title }} by {{ doc.author }} [{% for k in doc.metadata %}{{ k }}={{ doc.metadata[k] }}{% endfor %}]\n\n{{ body }}", "blocks": blocks}}

    def run(batches):
        for b in batches:
            made = [as_json(Document(n, Metadata(author="A7", extra=[("k", "7")]), [{"type": "list", "ordered": False, "items": [[paragraph(text("one"))], [paragraph(text("two"))]]}, table_block([["1", "x"]], ["h", "g"]), code(f"a = {k}\n", "py")])) for n, k in zip(b.column("n_name").to_pylist(), b.column("n_nationkey").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("n_nationkey"), pa.array(made)], names=["n_nationkey", "document"])

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name").mapInArrow(run, "n_nationkey int, document string")
    return DocumentEngine(options).render(rows).select("n_nationkey", "markdown")


@query("SELECT n_nationkey::INT AS n_nationkey, " + said("first {key}\nsecond\n") + " AS markdown, 'truncated: output truncated at 24 bytes (max_output_bytes)' AS warnings FROM nation")
def template_capped(spark, sf_dir):
    """What a document's template makes is cut behind a whole line."""
    options = {"templates": {"document": "first {{ body | trim }}\nsecond\na third that is too long"}, "limits": {"max_output_bytes": 24}}
    out = DocumentEngine(options).convert(built(spark, sf_dir, "a.txt", lambda n, k: str(k)))
    return out.select("n_nationkey", "markdown", listed("warnings").alias("warnings"))


@query(_values([("unclosed", "template"), ("unknown filter", "template"), ("unknown block", "template"), ("include", "template"), ("unknown option", "invalid_input"), ("unknown format", "invalid_input")], "kind, code"))
def option_errors(spark, sf_dir):
    """Engines that can't be made, and why."""
    given = [("unclosed", {"templates": {"document": "{% for x in y %}"}}), ("unknown filter", {"templates": {"document": "{{ x | nope }}"}}), ("unknown block", {"templates": {"blocks": {"raw": "x"}}}), ("include", {"templates": {"document": "{% include 'x' %}"}}), ("unknown option", {"limits": {"max_rows": 1}}), ("unknown format", {"enable": ["nope"]})]
    rows = []
    for kind, options in given:
        try:
            DocumentEngine(options)
        except ConvertError as e:
            rows.append((kind, e.code))
    return spark.createDataFrame(rows, "kind string, code string")


# limits and failures

def _bomb(n: str, k: int) -> bytes:
    return S.zipped({"bomb.txt": b"\0" * 9000, "ok.txt": f"fine {k}"})


def _many(n: str, k: int) -> bytes:
    return S.zipped({f"m{i}.txt": f"{n} {i}" for i in range(5)})


def _deep(n: str, k: int) -> bytes:
    return S.zipped({"in.zip": S.zipped({"a.txt": "hidden"}), "b.txt": n})


#: Name, filename, content, limits; code, message, markdown and warnings.
FAILURES = [
    ("input", "a.txt", lambda n, k: "x" * 64, {"max_input_bytes": 8}, "limit_exceeded", "max_input_bytes: 64 exceeds 8", None, ""),
    ("expanded", "a.zip", _bomb, {"max_expanded_bytes": 4096}, None, None, "## ok.txt\n\nfine {key}\n", "skipped_member: bomb.txt: expands beyond the budget (max_expanded_bytes)"),
    ("expanded part", "a.docx", lambda n, k: S.docx(S.para(S.run("x" * 9000))), {"max_expanded_bytes": 4096}, "limit_exceeded", "max_expanded_bytes: 4097 exceeds 4096", None, ""),
    ("embedded", "a.zip", _many, {"max_embedded_documents": 2}, None, None, "## m0.txt\n\n{name} 0\n\n## m1.txt\n\n{name} 1\n", "truncated: only 2 members converted (max_embedded_documents)"),
    ("depth", "a.zip", _deep, {"max_depth": 1}, None, None, "## in.zip\n\n## b.txt\n\n{name}\n", "skipped_member: in.zip: archive nested deeper than 1 (max_depth)"),
    ("rows", "a.csv", lambda n, k: f"n\n1\n2\n{k}\n4\n5\n", {"max_table_rows": 2}, None, None, "**a.csv**\n\n| n |\n| --- |\n| 1 |\n| 2 |\n\n_… 1 further rows omitted_\n", "truncated: table truncated to 2 of 3 rows (max_table_rows)"),
    ("output", "a.txt", lambda n, k: "\n\n".join(["word"] * 9), {"max_output_bytes": 20}, None, None, "word\n\nword\n\nword\n", "truncated: output truncated at 20 bytes (max_output_bytes)"),
    ("unsupported", "a.bin", lambda n, k: b"\0\1\2", {}, "unsupported", "unsupported format (tried: application/octet-stream/.bin, .bin)", None, ""),
    ("malformed", "a.docx", lambda n, k: S.zipped({"word/x": "y"}), {}, "malformed", "malformed docx: no word/document.xml", None, ""),
    ("encrypted", "a.xls", lambda n, k: S.compound({"EncryptedPackage": b"x"}), {}, "encrypted", "spreadsheet is encrypted", None, ""),
    ("no words", "a.pdf", lambda n, k: "%PDF-1.4 nothing", {}, None, None, "%PDF-1.4 nothing\n", ""),
    ("null file", "a.txt", lambda n, k: "", {}, None, None, "", ""),
]


@query(" UNION ALL ".join(f"SELECT '{f[0]}' AS kind, n_nationkey::INT AS n_nationkey, {said(f[4])} AS code, {said(f[5])} AS message, {said(f[6])} AS markdown, {said(f[7])} AS warnings FROM nation" for f in FAILURES))
def limits_and_errors(spark, sf_dir):
    out = None
    for kind, name, build, limits, *_ in FAILURES:
        rows = DocumentEngine({"limits": limits}).convert(built(spark, sf_dir, name, build))
        rows = rows.select(F.lit(kind).alias("kind"), "n_nationkey", "error.code", "error.message", "markdown", listed("warnings").alias("warnings"))
        out = rows if out is None else out.unionByName(rows)
    return out
