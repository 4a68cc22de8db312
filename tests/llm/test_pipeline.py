from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import common, mixing, quality
from vellum.llm.common import written

from .test_packing import check
from .test_pairs import shingles


def test_stages_on_odd_rows(spark, odd, none):
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, "")
            assert after.dtypes == docs.dtypes, name
            docs = after
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        check(rows, docs.collect(), 2048)


def test_each_stage_takes_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
    first = {r.doc_id for r in quality.judged(docs).filter("kept").collect()}
    assert {r.doc_id for r in tables[1].collect()} == first
    assert tables[2].count() >= 0.98 * tables[1].count()
    sets = [shingles(r.text, 5) for r in tables[3].collect()]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            assert not a or 100 * both < 80 * (len(a) + len(b) - both)
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(tables[4]) - words(tables[3])) <= 4 * mixing.BLOCK * tables[3].select("source").distinct().count()
    check(tables[5].collect(), tables[4].collect(), 2048)
    stored = len(common._scratch)
    assert corpus_pipeline.run(spark, sf_dir).count() == tables[5].count()
    assert len(common._scratch) == stored + 1  # only the result is left


CLASHING = "_key long, _taken long, _pred string, _n int, _letter boolean, text_key long, copies int, row string, said string, p double, t string, l string, c0 int, id long, slot long, taken int, size string, words int, k int, at int, root string, node string, label string, n_words int, posterior double, key string, bucket int"


def test_any_column_may_stand_beside(spark, odd):
    """Names that the stages use inside, and one row repeated for a third of the table; n_chars is missing."""
    names = [x.split() for x in CLASHING.split(", ")]
    docs = odd.select("doc_id", "text", "lang", "source")
    one = docs.filter("doc_id = 6").limit(1)
    docs = docs.unionByName(one.crossJoin(spark.range(9)).drop("id"))
    wide = docs.select("*", *(F.lit(7).cast(kind).alias(name) for name, kind in names))
    for name, stage in corpus_pipeline.STAGES:
        plain, found = stage(spark, docs, ""), stage(spark, wide, "")
        if name == "packing":
            assert Counter(plain.select("doc_id", "piece", "length").collect()) == Counter(found.select("doc_id", "piece", "length").collect())
        else:
            assert found.dtypes == wide.dtypes, name
            assert Counter(plain.collect()) == Counter(found.select(*docs.columns).collect()), name
            seven = found.select(*(n for n, _ in names)).distinct().collect()
            assert len(seven) <= 1
