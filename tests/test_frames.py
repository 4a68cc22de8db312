"""The operators on DataFrames: against DuckDB at the smallest scale, and by hand."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellum import catalog, catalog_engine, catalog_formats  # noqa: F401
from vellum.functions import columns as C
from vellum.functions import text as T
from vellum.plans.engine import DocumentEngine
from vellum.sources import samples as S
from vellum.streaming import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(mine.columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted((tuple(r[c] for c in columns) for r in mine.collect()), key=key) == sorted(cursor.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


TEXTS = ["", " ", "a_b", "_a_ b_", "*x* [y] <z> | `q` \\", "# h", "+1", "-", "1. a", "12.5", "a1. b", "x\r\ny\nz", "ä_ö", "Ünï 2.3 CAPS", "2 A", "1.2.3 Bee", "ALL CAPS HERE", "ends.", "a" * 90, "``` ``", 'say "x", y', "..\\a:b/../c", "/"]


def test_columns_agree_with_values(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    t = F.col("t")
    rows = df.select("i", C.escape(t).alias("escape"), C.escape(t, True).alias("cell"), C.squeeze(t).alias("squeeze"), C.escape_url(t).alias("url"), C.quoted(t).alias("quoted"), C.fence(t).alias("fence"), C.csv_cell(t).alias("csv"), C.safe_name(t).alias("name"), C.heading_level(t).alias("level"), C.decode_entities(t).alias("decoded")).orderBy("i").collect()
    for r, s in zip(rows, TEXTS):
        assert (r.escape, r.cell, r.squeeze, r.url) == (T.escape(s), T.escape(s, True), T.squeeze(s), T.escape_url(s)), s
        assert (r.quoted, r.fence, r.csv, r.name) == (T.quoted(s), T.fence(s), T.csv_row([s]), T.safe_name(s)), s
        assert (r.level, r.decoded) == (T.heading_level(s) if s.strip() else None, T.decode_entities(s)), s


def test_convert_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, b"a,b\n1,2\n", "x.csv"), (2, b"\x00\x01\x02", "y.bin"), (3, None, "z.txt")], "id int, content binary, filename string")
    rows = {r.id: r for r in DocumentEngine().convert(df).collect()}
    assert rows[1].converter == "csv" and rows[1].error is None
    assert rows[2].markdown is None and rows[2].error.code == "unsupported"
    assert rows[3].markdown == "" and rows[3].filename == "z.txt"
    blocks = DocumentEngine().blocks(df).collect()
    assert [(b.id, b.kind, b.depth) for b in blocks] == [(1, "table", 0)]


def test_files_and_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("hello")
    (source / "b.docx").write_bytes(S.docx(S.para(S.run("word"))))
    engine = DocumentEngine()
    batch = {r.filename: r.markdown for r in engine.convert(files.read_files(spark, str(source), max_bytes=10_000)).collect()}
    assert batch == {"a.txt": "hello\n", "b.docx": "word\n"}
    args = (spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"), engine)
    files.append(*args).awaitTermination()
    (source / "c.md").write_text("# new")
    files.append(*args).awaitTermination()
    found = [(r.filename, r.markdown) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(found) == [("a.txt", "hello\n"), ("b.docx", "word\n"), ("c.md", "# new\n")]
