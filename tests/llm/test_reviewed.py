"""Findings of reviews, each with what was lost before."""

import numpy as np
import pyarrow.parquet as pq

from vellum.llm import extraction, grading

PAGES = "page_id long, url string, html string"


def page(i, top="", end=""):
    return f"<html><body>{top}<div id='c'><h1>Title {i}</h1><p>Body of page {i} with words of its own {i * i}</p></div>{end}</body></html>"


def texts(spark, pages, host="a.org"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], PAGES)
    return {r.page_id: r.text for r in extraction.extracted(df).collect()}


def own(i):
    return f"Title {i}\nBody of page {i} with words of its own {i * i}"


def test_classes_on_part_of_the_pages_are_template(spark):
    top, twice = "<div class='x'><p>Welcome members</p></div>", "<div class='y'><p>Read on</p><p>Read on</p></div>"
    pages = [page(i, top if i % 2 else "", twice) for i in range(14)]
    assert texts(spark, pages) == {i: own(i) for i in range(14)}


def test_runs_without_order_are_no_template(spark):
    a, b, c = ("<div class='run-%s'><p>Run %s</p></div>" % (x, x) for x in "abc")
    pages = [page(i, c + (a + b if i % 2 else b + a)) for i in range(12)]
    found = texts(spark, pages)
    for i in range(12):
        assert found[i].endswith(own(i)) and "Run c" not in found[i] and ("Run a" in found[i] or "Run b" in found[i])


def test_classes_nest():
    template = extraction.Template([[1, 2, 3, 4], [10, 11]])
    assert extraction.nested([1, 10, 7, 11, 2, 3, 4], template) == set()
    assert extraction.nested([1, 10, 2, 11, 3, 4], template) == {10, 11}
    assert extraction.nested([1, 3, 2, 10, 11, 10, 11, 4], template) == {2}


def test_pages_and_templates_meet_by_host(spark, monkeypatch):
    """Nothing is broadcast, and the pages of a host are dealt to parts."""
    top, end = "<div class='x'><p>Welcome</p></div>", "<div class='z'><p>Copyright</p></div>"
    monkeypatch.setattr(extraction, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(extraction, "HOST_PAGES", 3)
    monkeypatch.setattr(extraction, "KEPT_TEMPLATES", 1)
    assert texts(spark, [page(i, top, end) for i in range(11)]) == {i: own(i) for i in range(11)}


def test_odd_pages_leave_the_template(spark):
    top, end = "<div class='x'><p>Welcome</p></div>", "<div class='z'><p>Copyright</p></div>"
    pages = [page(i, top, end) for i in range(6)] + ["", None, "  ", "<table><tr><td>Another layout</td></tr></table>", page(9, top)]
    found = texts(spark, pages)
    assert [found[i] for i in range(6)] == [own(i) for i in range(6)]
    assert found[6] == found[7] == found[8] == "" and found[9] == "Another layout" and found[10] == own(9)


def test_pages_without_tokens_do_not_count_for_the_root(spark):
    pages = [(i, f"http://a.org/{i}", page(i) if i < 6 else None if i < 8 else "") for i in range(10)]
    root = next(r for r in extraction.classes(extraction.vectors(spark.createDataFrame(pages, PAGES))).collect() if r.is_root)
    assert root.pages == 6 and root["size"] > 2


def test_copies_keep_their_text(spark):
    top, end = "<div class='x'><p>Welcome</p></div>", "<div class='z'><p>Copyright</p></div>"
    shared = "<h1>One head</h1><p>A long paragraph that all copies of it share</p><p>and one more of them</p>"
    article = [f"<html><body><article>{shared}<p>Day {i}</p></article></body></html>" for i in range(7)]
    want = "One head\nA long paragraph that all copies of it share\nand one more of them"
    assert texts(spark, article) == {i: f"{want}\nDay {i}" for i in range(7)}
    dated = [f"<html><body>{top}<div class='d'>Day {i}</div><div id='c'>{shared}</div>{end}</body></html>" for i in range(7)]
    assert texts(spark, dated) == {i: f"Day {i}\n{want}" for i in range(7)}
    copies = f"<html><body>{top}<div class='h'><h2>The copies' head</h2></div><div id='c'>{shared}</div>{end}</body></html>"
    found = texts(spark, [copies] * 6 + [page(i, top, end) for i in range(9)])
    assert [found[i] for i in range(6)] == ["The copies' head\n" + want] * 6
    assert [found[6 + i] for i in range(9)] == [own(i) for i in range(9)]


def test_toxic_documents_are_found_on_a_small_table():
    docs, labels = (pq.read_table(f"/root/testdata/sf0.01/{t}.parquet").to_pylist() for t in ("documents", "labels"))
    text = {d["doc_id"]: d["text"] for d in docs}
    labels = [x for x in labels if x["doc_id"] in text]
    rows = grading.features([text[x["doc_id"]] for x in labels])
    y = np.array([0 if x["quality"] == 0 else 1 if x["toxic"] else 2 for x in labels])
    part, kept = np.array([x["doc_id"] % 3 for x in labels]), np.zeros(len(y), bool)
    for k in range(3):
        model = grading.fit([r for r, p in zip(rows, part) if p != k], y[part != k])
        kept[part == k] = [model.weights[r].sum() - model.thresholds[-1] >= np.log(0.6 / 0.4) for r, p in zip(rows, part) if p == k]
    assert kept[y == 1].mean() < 0.5 and kept[y == 2].mean() > 0.95


def test_all_features_of_a_long_text_are_learned(spark, monkeypatch):
    """The words that tell the grades are in the last part of the features, behind the first 4000."""
    words = [f"w{i}" for i in range(9000)]
    by = sorted((int(x[0]), w) for x, w in zip(grading.words_of(words, lower=True, bare=True), words))
    marks, rest = [w for n, w in by[-200:]], [w for n, w in by[:6000]]
    texts = [" ".join(rest + marks[100 * (i % 2) : 100 * (i % 2) + 100]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    seen = []
    fit = grading.fit
    monkeypatch.setattr(grading, "fit", lambda rows, y: seen.append(rows) or fit(rows, y))
    assert {r.doc_id: r.kept for r in grading.graded(docs, grades).collect()} == {i: i % 2 == 1 for i in range(40)}
    monkeypatch.setattr(grading, "SAMPLE_FEATURES", 20 * 6000)
    grading.graded(docs, grades)
    whole = {len(f) for f in grading.features(texts)}
    assert len(seen[0]) == 40 and 0 < len(seen[1]) < 40 and {len(r) for r in seen[0]} | {len(r) for r in seen[1]} <= whole
