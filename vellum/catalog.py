"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import frames
from .plans.engine import DocumentEngine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the string operators

WS = r"[\s\x0b ]"


def s_escape(c: str, cell: bool = False) -> str:
    c = rf"regexp_replace({c}, '[\\`*\[\]<>|]', '\\\0', 'g')"
    c = rf"regexp_replace({c}, '(^|[^\pL\pN])_', '\1\\_', 'g')"
    c = rf"regexp_replace({c}, '([^\\])_($|[^\pL\pN])', '\1\\_\2', 'g')"
    c = rf"regexp_replace({c}, '^[#+\-]', '\\\0')"
    c = rf"regexp_replace({c}, '^([0-9]+)\.', '\1\\.')"
    return f"replace(replace({c}, chr(13), ''), chr(10), '{'<br>' if cell else ' '}')"


def s_trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def s_squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def s_decode(c: str) -> str:
    for entity, char in C.ENTITIES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def s_quoted(c: str) -> str:
    return rf"""'"' || regexp_replace(replace(replace({c}, '\', '\\'), '"', '\"'), '\r\n?|\n', ' ', 'g') || '"'"""


def s_row(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(s_escape(c, True) for c in cells) + " || ' |'"


# plain text

TWO = "replace(text, chr(10), chr(10) || chr(10))"


def _spaced() -> Column:
    return F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))


@query(f"""SELECT doc_id, list_aggregate(list_transform(list_filter(list_transform(string_split({TWO}, chr(10) || chr(10)), lambda p: {s_trim('p')}), lambda p: p != ''), lambda p: {s_escape('p')}), 'string_agg', chr(10) || chr(10)) || chr(10) AS markdown FROM documents""")
def text_markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", frames.as_markdown(_spaced()).alias("markdown"))


@query(f"""SELECT doc_id, ord, paragraph FROM (SELECT doc_id, unnest(range(len(p)))::INT AS ord, replace({s_trim('unnest(p)')}, chr(10), ' ') AS paragraph FROM (SELECT doc_id, string_split({TWO}, chr(10) || chr(10)) AS p FROM documents)) WHERE paragraph != ''""")
def text_paragraphs(spark, sf_dir):
    return frames.paragraphs(table(spark, sf_dir, "documents"), _spaced(), "doc_id")


@query(f"SELECT doc_id, {s_escape('text')} AS escaped FROM documents")
def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.escape(F.col("text")).alias("escaped"))


@query(f"SELECT doc_id, {s_escape('text', True)} AS escaped FROM documents")
def escape_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.escape(F.col("text"), cell=True).alias("escaped"))


@query("SELECT doc_id, replace(replace(text, '|', '\\|'), chr(10), '<br>') AS escaped FROM documents")
def escape_table_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.escape_cell(F.col("text")).alias("escaped"))


@query(f"SELECT page_id, {s_squeeze('html')} AS squeezed FROM pages")
def squeeze(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.squeeze(F.col("html")).alias("squeezed"))


# names and types

@query("""SELECT page_id, CASE WHEN regexp_matches(u, '[ ()]') THEN '<' || regexp_replace(u, '[<>]', '', 'g') || '>' ELSE u END AS target FROM (SELECT page_id, trim(url || ' (' || page_id || ')') AS u FROM pages)""")
def escape_url(spark, sf_dir):
    u = F.concat("url", F.lit(" ("), F.col("page_id").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "pages").select("page_id", C.escape_url(u).alias("target"))


EXT_SQL = r"lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]*/(?:.*/)?([^/]*)$', 1), '\.([^.]+)$', 1))"
@query(f"SELECT page_id, {EXT_SQL} AS extension FROM pages")
def normalize_ext(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.extension(F.col("url")).alias("extension"))


@query(r"""SELECT page_id, NOT contains(h, chr(0)) AND (strlen(h) = 0 OR length(regexp_replace(h, '[^\x01-\x08\x0E-\x1F]', '', 'g')) * 100 < strlen(h)) AS textual FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN chr(1) || chr(2) || html ELSE left(html, 8192) END AS h FROM pages)""")
def looks_textual(spark, sf_dir):
    head = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("\x01\x02"), "html")).otherwise(F.substring("html", 1, 8192))
    return table(spark, sf_dir, "pages").select("page_id", C.looks_textual(head).alias("textual"))


@query(r"""SELECT page_id, CASE WHEN said = '' THEN 'unnamed' ELSE said END AS name FROM (SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(n, '\', '/'), '/'), lambda p: regexp_replace(string_split(p, ':')[1], '[\x00-\x1f\x7f]', '', 'g')), lambda p: p NOT IN ('', '.', '..')), '/') AS said FROM (SELECT page_id, '..\' || replace(url, '://', '/../') || chr(7) AS n FROM pages))""")
def sanitize_member_name(spark, sf_dir):
    name = F.concat(F.lit("..\\"), F.replace("url", F.lit("://"), F.lit("/../")), F.lit("\x07"))
    return table(spark, sf_dir, "pages").select("page_id", C.safe_name(name).alias("name"))


# pages

@query(f"""SELECT page_id, nullif({s_squeeze(s_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title FROM pages""")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, ord::INT AS ord, regexp_extract(tag, '(?is)charset\s*=\s*"([^"]*)"', 1) AS charset, regexp_extract(tag, '(?is)(?:name|property)\s*=\s*"([^"]*)"', 1) AS name FROM (SELECT page_id, unnest(t) AS tag, unnest(range(len(t))) AS ord FROM (SELECT page_id, regexp_extract_all(html, '(?is)<meta[^>]*>') AS t FROM pages))""")
def html_meta(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)(<meta[^>]*>)"), F.lit(1))).alias("ord", "tag"))
    return tags.select("page_id", "ord", F.regexp_extract("tag", r'(?is)charset\s*=\s*"([^"]*)"', 1).alias("charset"), F.regexp_extract("tag", r'(?is)(?:name|property)\s*=\s*"([^"]*)"', 1).alias("name"))


STRIP_SQL = r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<head[\s>/].*?(?:</head>|\z)|<!--.*?(?:-->|\z)"


@query(f"SELECT page_id, regexp_replace(html, '{STRIP_SQL}', '', 'g') AS prose FROM pages")
def html_strip_non_prose(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.strip_non_prose(F.col("html")).alias("prose"))


@query(f"SELECT page_id, {s_decode('html')} AS decoded FROM pages")
def html_decode_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.decode_entities(F.col("html")).alias("decoded"))


@query()
def html_to_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"), F.lit("text/html").alias("mimetype"))
    return DocumentEngine().convert(rows).select("page_id", "converter", "title", "markdown")


# JSON and CSV

DELIMITED = "array_to_string(list_transform(range(3), lambda i: n_name || d || n_nationkey || d || i), chr(10))"
D_SQL = "CASE n_nationkey % 5 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN '|' ELSE ' ' END"


def _delimited(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    d = F.when(k % 5 == 0, ",").when(k % 5 == 1, ";").when(k % 5 == 2, "\t").when(k % 5 == 3, "|").otherwise(" ")
    rows = table(spark, sf_dir, "nation").withColumn("d", d)
    return rows.withColumn("body", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat_ws("", F.col("n_name"), F.col("d"), F.col("n_nationkey").cast("string"), F.col("d"), i.cast("string"))), "\n"))


@query(f"""SELECT n_nationkey, CASE WHEN d = ' ' THEN ',' ELSE d END AS delimiter FROM (SELECT n_nationkey, {D_SQL} AS d FROM nation)""")
def csv_sniff_delimiter(spark, sf_dir):
    return _delimited(spark, sf_dir).select("n_nationkey", C.delimiter(F.col("body")).alias("delimiter"))


@query(r"""SELECT o_orderkey, NOT regexp_matches(trim(c), '(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$') AS is_header FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN ' 1e5 ' WHEN 2 THEN '.5' WHEN 3 THEN '1_0' WHEN 4 THEN 'Infinity' ELSE '0x1p3' END AS c FROM orders)""")
def csv_header_heuristic(spark, sf_dir):
    k = F.col("o_orderkey")
    cell = F.when(k % 6 == 0, F.col("o_orderpriority")).when(k % 6 == 1, " 1e5 ").when(k % 6 == 2, ".5").when(k % 6 == 3, "1_0").when(k % 6 == 4, "Infinity").otherwise("0x1p3")
    return table(spark, sf_dir, "orders").select("o_orderkey", (~F.trim(cell).rlike(C.NUMBER)).alias("is_header"))


@query("""SELECT r_regionkey, '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def csv_table(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    bodies = frames.joined(nation, ["n_regionkey"], ["n_nationkey"], C.csv_row(F.array(F.col("n_nationkey").cast("string"), "n_name")), "\n", "body")
    files = bodies.select(F.col("n_regionkey").alias("r_regionkey"), F.concat(F.lit("key,nation\n"), "body").alias("content"), F.lit("csv").alias("extension"))
    return DocumentEngine().convert(files).select("r_regionkey", "markdown")


# tables

@query(f"""SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg({s_row('n_nationkey::VARCHAR', 'n_name')}, chr(10) ORDER BY n_nationkey) AS markdown, false AS truncated FROM nation GROUP BY n_regionkey""")
def gfm_table(spark, sf_dir):
    return frames.gfm_tables(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], ["key", "name"], F.array(F.col("n_nationkey").cast("string"), "n_name"))


@query(f"""SELECT o_custkey, '| key | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg({s_row('o_orderkey::VARCHAR', 'o_orderstatus', 'o_orderpriority')}, chr(10) ORDER BY n) FILTER (n <= 3) || CASE WHEN count(*) > 3 THEN chr(10) || chr(10) || '_… ' || (count(*) - 3) || ' further rows omitted_' ELSE '' END AS markdown, count(*) > 3 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey""")
def table_row_cap(spark, sf_dir):
    cells = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return frames.gfm_tables(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["key", "status", "priority"], cells, max_rows=3)


@query("""SELECT n_regionkey, '<table>' || chr(10) || '<tbody>' || chr(10) || string_agg('<tr>' || chr(10) || '<td>' || n_nationkey || '</td>' || chr(10) || '<td>' || replace(replace(replace(n_name || ' & <co>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>' || chr(10) || '</tr>', chr(10) ORDER BY n_nationkey) || chr(10) || '</tbody>' || chr(10) || '</table>' AS html FROM nation GROUP BY n_regionkey""")
def html_table(spark, sf_dir):
    cell = lambda c: F.concat(F.lit("<td>"), C.escape_html(c), F.lit("</td>\n"))
    line = F.concat(F.lit("<tr>\n"), cell(F.col("n_nationkey").cast("string")), cell(F.concat("n_name", F.lit(" & <co>"))), F.lit("</tr>"))
    rows = frames.joined(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], line, "\n", "body")
    return rows.select("n_regionkey", F.concat(F.lit("<table>\n<tbody>\n"), "body", F.lit("\n</tbody>\n</table>")).alias("html"))


@query("""SELECT n_regionkey, '```csv' || chr(10) || string_agg('"' || n_name || ', ' || n_nationkey || '",' || n_nationkey, chr(10) ORDER BY n_nationkey) || chr(10) || '```' AS markdown FROM nation GROUP BY n_regionkey""")
def csv_table_style(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    line = C.csv_row(F.array(F.concat("n_name", F.lit(", "), key), key))
    rows = frames.joined(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], line, "\n", "body")
    mark = C.fence(F.col("body"))
    return rows.select("n_regionkey", F.concat(mark, F.lit("csv\n"), "body", F.lit("\n"), mark).alias("markdown"))


@query("""SELECT n_nationkey, array_to_string(list_concat(list_transform(range(n_nationkey % 4), lambda i: 'c' || i), list_transform(range(3 - n_nationkey % 4), lambda i: '')), ',') AS padded FROM nation""")
def table_width_pad(spark, sf_dir):
    n = F.col("n_nationkey") % 4
    cells = F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), n), lambda i: F.concat(F.lit("c"), i.cast("string")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(C.padded(cells, F.lit(3)), ",").alias("padded"))


# blocks

@query(f"""SELECT p_partkey, repeat('#', least(6, greatest(1, p_size % 9 + 2 - 1))::INT) || ' ' || {s_escape('p_name')} AS heading FROM part""")
def heading_offset_clamp(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.heading(F.col("p_size") % 9 - 1, F.col("p_name"), offset=2).alias("heading"))


@query("""SELECT doc_id, f || chr(10) || t || chr(10) || f AS block FROM (SELECT doc_id, t, repeat('`', (greatest(2, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0)) + 1)::INT) AS f FROM (SELECT doc_id, repeat('`', (doc_id % 6)::INT) || text AS t FROM documents))""")
def code_fence(spark, sf_dir):
    t = F.concat(F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), "text")
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.concat(C.fence(F.col("t")), F.lit("\n"), "t", F.lit("\n"), C.fence(F.col("t"))).alias("block"))


@query(f"""SELECT doc_id, count(*) AS blocks, sum(length(paragraph))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split({TWO}, chr(10) || chr(10))) AS paragraph FROM documents) WHERE {s_trim('paragraph')} != '' GROUP BY doc_id""")
def block_count(spark, sf_dir):
    rows = frames.paragraphs(table(spark, sf_dir, "documents"), _spaced(), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("paragraph")).alias("chars"))


# limits

@query(f"""SELECT doc_id, ord, bytes_so_far FROM (SELECT doc_id, ord, sum(strlen(p) + 2) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS bytes_so_far FROM (SELECT doc_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE bytes_so_far <= 1500""")
def output_byte_cap(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "p"))
    return frames.capped(lines, ["doc_id"], ["ord"], F.col("p"), 1500).select("doc_id", "ord", "bytes_so_far")


# lines of pages

def _lines(spark, sf_dir) -> DataFrame:
    line = F.when(F.col("ord") % 4 == 0, F.concat((F.col("ord") + 1).cast("string"), F.lit(".2 "), "raw")).when(F.col("ord") % 4 == 1, F.upper(F.replace("raw", F.lit("ß"), F.lit("s")))).when(F.col("ord") % 4 == 2, "").otherwise(F.concat("raw", F.lit("-")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "raw"))
    return rows.select("doc_id", "ord", line.alias("line"))


LINES_SQL = "lines AS (SELECT doc_id, ord, CASE ord % 4 WHEN 0 THEN (ord + 1) || '.2 ' || raw WHEN 1 THEN upper(replace(raw, 'ß', 's')) WHEN 2 THEN '' ELSE raw || '-' END AS line FROM (SELECT doc_id, unnest(range(len(l)))::INT AS ord, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
LEVEL_SQL = r"""levels AS (SELECT doc_id, ord, line, c, CASE WHEN NOT (strlen(c) BETWEEN 3 AND 80 AND NOT regexp_matches(c, '[.,;:]$') AND len(regexp_split_to_array(c, '\s+')) <= 12 AND regexp_matches(c, '\pL')) THEN NULL WHEN num != '' THEN least(4, length(num) - length(replace(num, '.', ''))) + 1 WHEN NOT regexp_matches(c, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') THEN 2 END::INT AS level FROM (SELECT *, regexp_extract(c, '^([0-9.)]*[0-9][0-9.)]*) .*\S', 1) AS num FROM (SELECT *, """ + s_trim("line") + " AS c FROM lines)))"


@query(f"WITH {LINES_SQL}, {LEVEL_SQL} SELECT doc_id, ord, level FROM levels")
def pdf_heading_shape(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "ord", C.heading_level(F.col("line")).alias("level"))


JOIN_SQL = s_squeeze("replace(replace(string_agg(c, chr(10) ORDER BY ord), '-' || chr(10), ''), chr(10), ' ')")


@query(f"""WITH {LINES_SQL}, {LEVEL_SQL}, islands AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY ord) * 2 + 1 - b AS island FROM (SELECT *, (level IS NOT NULL OR c = '')::INT AS b FROM levels))
SELECT doc_id, min(ord)::INT AS ord, max(level)::INT AS level, {JOIN_SQL} AS said FROM islands WHERE c != '' GROUP BY doc_id, island""")
def pdf_page_blocks(spark, sf_dir):
    return frames.page_blocks(_lines(spark, sf_dir), "doc_id", "ord", "line")


@query(f"WITH {LINES_SQL}, cut AS (SELECT doc_id, ord, {s_trim('line')} AS c FROM lines) SELECT doc_id, {JOIN_SQL} AS said FROM cut GROUP BY doc_id")
def pdf_rejoin(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return _lines(spark, sf_dir).groupBy("doc_id").agg(C.rejoin(F.transform(ordered, lambda x: x["line"])).alias("said"))
