import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from vellum.llm import extraction, grading, language, pfor
from vellum.llm.token_files import read_tokens, round_trip, write_tokens

from .test_packing import library

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_gradients_are_the_losses_slopes():
    r = np.random.RandomState(0)
    net = language.new_network(["a", "b", "c"], 4)
    for p in net.parameters():
        p *= 0.5
    x, y = r.randint(97, 110, (12, 5)).astype(np.uint8), r.randint(0, 3, 5)
    for p, g in zip(net.parameters(), language.gradients(net, x, y)):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for i in r.choice(len(flat), min(12, len(flat)), replace=False):
            old = flat[i]
            values = []
            for step in (1e-2, -1e-2):
                flat[i] = old + step
                values.append(language.loss(net, x, y))
            flat[i] = old
            assert abs((values[0] - values[1]) / 2e-2 - slope[i]) < 1e-3


def test_cut_texts_read_like_whole_ones():
    """A text's probabilities depend on that text alone."""
    net = language.new_network(["a", "b"], 4)
    texts = ["ab c" * 5, "", None, "xyz " * 200, "ß", "12 34"]
    p = language.probabilities(net, texts)
    assert p.shape == (6, 2) and np.allclose(p[[0, 3, 4]].sum(1), 1, atol=1e-5) and (p[[1, 2, 5]] == 0).all()
    for k in range(len(texts)):  # whatever stands beside a text
        assert np.allclose(language.probabilities(net, [texts[k]])[0], p[k], atol=1e-6)


def test_language_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.learned(docs, per_label=120)
    columns = ["doc_id", "lang"]
    rows = language.predicted(docs, net, columns).filter(language.held_out(language.F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    found = language.predicted(odd, net, odd.columns).collect()
    assert len(found) == odd.count()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language.predicted(none, net, ["doc_id"]).collect() == []
    assert language.identified(none).collect() == []
    kept = language.keep_sure(odd)
    assert kept.columns == odd.columns and all(any(c.isalpha() for c in r.text) for r in kept.collect())


def test_frames_round_trip():
    r = np.random.RandomState(0)
    for _ in range(40):
        docs = [r.randint(0, 2 ** r.randint(1, 33), r.choice([0, 1, 63, 64, 65, 127, 128, 129, 300]), dtype=np.uint64).astype(np.uint32) for _ in range(20)]
        docs += [np.array([0xFFFFFFFF] * 5 + [0], np.uint32), np.full(128, 7, np.uint32), np.minimum(r.zipf(1.3, 500), 50000).astype(np.uint32)]
        frames = pfor.encode(docs)
        for a, b, f in zip(docs, pfor.decode(frames), frames):
            assert a.tolist() == b.tolist()
            for i in range(-(-len(a) // pfor.BLOCK)):
                assert pfor.block_at(f, i).tolist() == a[i * pfor.BLOCK : (i + 1) * pfor.BLOCK].tolist()
    outliers = np.full(1280, 3, np.uint32)
    outliers[::50] = 40_000
    assert len(pfor.encode([outliers])[0]) < 1280


def test_token_files(odd, none, spark, tmp_path):
    ids_of = library(BYTES)
    rows = round_trip(odd, BYTES).collect()
    docs = odd.collect()
    want = Counter()
    for d in docs:
        ids = np.array(ids_of(d.text) + [0], "<u4")
        want[d.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    assert round_trip(none, BYTES).collect() == []
    write_tokens(odd, BYTES, str(tmp_path / "t"), shards=3)
    assert all(len(r.ids) == r.n_tokens for r in read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect())


def test_grades_held_out(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    grades = grading.rated(labels)
    rows = grading.graded(docs, grades.filter("doc_id % 3 != 0")).join(grades.withColumnRenamed("grade", "truth"), "doc_id").filter("doc_id % 3 = 0").collect()
    mean = {g: np.mean([r.expected_grade for r in rows if r.truth == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    assert np.mean([r.kept for r in rows if r.truth == 0]) < 0.05 and np.mean([r.kept for r in rows if r.truth == 2]) > 0.9
    for r in rows[:50]:
        assert 0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade <= 2
    some = spark.createDataFrame([(6, 2), (8, 0), (6, 1), (None, 1), (11, None), (999, 0)], "doc_id long, grade int")
    found = grading.graded(odd, some).collect()
    assert len(found) == odd.count()
    assert all(r.kept for r in grading.graded(odd, some.filter("doc_id = 6")).collect())
    assert grading.graded(none, some).collect() == []


def test_thresholds_are_ordered():
    r = np.random.RandomState(0)
    rows = [np.array([1000 + k % 4, *r.randint(0, 900, 3)], np.int32) for k in range(1600)]
    model = grading.fit(rows, np.array([k % 4 for k in range(1600)]))
    assert (np.diff(model.thresholds) > 0).all()
    w = model.weights[1000:1004]
    assert w[0] < w[1] < w[2] < w[3]


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>site</p></header><nav><ul><li><a href="/">Menu %(i)d</a></li></ul></nav><div class="cookie-notice">accept</div><!-- x -->
<article><header><h1>Head &amp; %(i)d</h1></header><p><b>First   line<br><p>Second&nbsp;line %(i)d</p><ul><li>one</li><li>two</li></ul>
<aside>side</aside><div class="ad">buy</div><form><input><button>go</button></form><p>Static words</p></article>
<section id="comments"><p>reader says</p></section><footer>&copy; foot</footer></body></html>"""


def test_pages(spark, none):
    pages = [(i, f"http://a.org/{i}", PAGE % {"i": i}) for i in range(6)]
    pages += [(10, "http://b.org/1", PAGE % {"i": 10}), (11, None, None), (12, "x", ""), (13, "http://c.org", "<p>a &lt; b<p>c<div>d<script>bad"), (14, "http://c.org/2", "plain &eacute; text"), (15, "http://c.org/3", "<div class='menu'><p>x</p></div><p>y</p><!-- never ends <p>z"), (0, "http://a.org/0", PAGE % {"i": 0})]
    df = spark.createDataFrame([(*p, "z", 3) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    rows = extraction.extracted(df).collect()
    assert Counter((r.page_id, r.url) for r in rows) == Counter((p[0], p[1]) for p in pages)
    text = {r.page_id: r.text for r in rows}
    body = "Head & {0}\nFirst line\nSecond line {0}\none\ntwo"
    # What stands within the article is content, on a host with like pages as well.
    assert all(text[i] == body.format(i) + "\nStatic words" for i in (*range(6), 10))
    assert text[11] == text[12] == "" and text[13] == "a < b\nc\nd" and text[14] == "plain é text" and text[15] == "y"
    assert all(r.n_chars == len(r.text) for r in rows)
    assert extraction.extracted(df.filter("false")).collect() == []


def test_classes_share_occurrence_vectors(spark):
    df = spark.createDataFrame([(i, f"http://a.org/{i}", PAGE % {"i": i}) for i in range(6)], "page_id long, url string, html string")
    pages = [extraction.occurrences(PAGE % {"i": i}) for i in range(6)]
    tokens = set().union(*pages)
    vectors = {t: tuple(p.get(t, (0,))[0] for p in pages) for t in tokens}
    want = Counter(v for v in vectors.values() if sum(x > 0 for x in v) >= extraction.FEW)
    want[(1,) * 6] += 1  # the root
    found = extraction.classes(extraction.vectors(df)).collect()
    assert sorted(r["size"] for r in found) == sorted(n for n in want.values() if n >= 2)
    root = next(r for r in found if r.is_root)
    assert set(root.text_tokens) == {t for t, v in vectors.items() if v == (1,) * 6 and any(p[t][2] for p in pages)}


def test_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = extraction.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect()
    import html
    import re

    for r in rows:
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_very_long_and_broken_pages():
    import time

    pages = ["<div>" * 20000 + "text", "<div>" * 9000 + "</x>" * 9000, '<a "' * 30000, "<!-- a -->" * 20000, "<script>" + "</script " * 30000, '<a ">" ' * 20000 + "'", "<" * 100000]
    began = time.time()
    found = [extraction.main_text(p) for p in pages]
    assert [f[:5] for f in found] == ["text", "", "", "", "", found[5][:5], "<<<<<"]
    assert time.time() - began < 10
    assert extraction.main_text('<p class="x>text</p> more') == "text\nmore"
    assert extraction.main_text("<p>a<!-- <b> --!>b</p><p title='>'>c</p><d") == "ab\nc"


def test_a_template_is_deduced_without_telling_names(spark):
    """No article, nav or class names: what all pages share around the varying text goes."""
    page = "<html><body><div><div>Site</div><div>Home</div><div>Contact</div></div><div><h2>Title %d</h2><p>Long text of page %d, with %s words of its own.</p><p>And more of it: %s</p></div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://h.org/{i}", page % (i, i, "very " * (i % 5), chr(97 + i) * 30)) for i in range(12)]
    found = extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in found:
        i = r.page_id
        want = [f"Title {i}", f"Long text of page {i}, with {'very ' * (i % 5)} words of its own.", f"And more of it: {chr(97 + i) * 30}"]
        assert r.text == "\n".join(" ".join(w.split()) for w in want)


def test_scores_against_a_plain_sum():
    r = np.random.RandomState(1)
    model = grading.Model(r.randn(1 << grading.BITS), np.array([-0.5, 0.7]))
    texts = ["some words, and some more WORDS!", "", None, "a b c d"]
    for tails, f in zip(model.tails(texts), grading.features(texts)):
        score = sum(model.weights[int(k)] for k in sorted(set(f.tolist())))
        assert np.allclose(tails, [1 / (1 + np.exp(-(score - t))) for t in model.thresholds])


def test_likelihood_is_lowered_by_the_fit():
    """The fit against a plain likelihood: better than without weights, and no single step of a weight is much better."""
    r = np.random.RandomState(2)
    rows = [np.unique(np.concatenate([r.randint(0, 60, 4), [100 + k % 3] * (r.rand() < 0.8)])).astype(np.int32) for k in range(900)]
    y = np.array([k % 3 for k in range(900)])
    model = grading.fit(rows, y)

    def likelihood(weights):
        total = 0.0
        for f, grade in zip(rows, y):
            tails = [1.0, *(1 / (1 + np.exp(-(weights[f].sum() - t))) for t in model.thresholds), 0.0]
            total += np.log(tails[grade] - tails[grade + 1])
        return total / len(rows)

    fitted = likelihood(model.weights)
    assert fitted > likelihood(np.zeros_like(model.weights)) + 0.2
    for feature in (100, 101, 102):
        for step in (-0.3, 0.3):
            moved = model.weights.copy()
            moved[feature] += step
            assert likelihood(moved) < fitted + 0.01


def plain_probabilities(net, text):
    """One byte at a time, over the whole text in both directions."""
    x = text.encode()
    size = net.hidden[0].shape[1]
    hard = lambda v: np.clip(v * 0.25 + 0.5, 0, 1)

    def run(d, data):
        h, out = np.zeros(size), []
        for b in data:
            a, rec = net.inputs[d][:, b] + net.bias[d], net.hidden[d] @ h
            z, reset = hard(a[:size] + rec[:size]), hard(a[size : 2 * size] + rec[size : 2 * size])
            c = np.tanh(a[2 * size :] + reset * rec[2 * size :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    total, n = np.zeros(len(net.labels)), 0
    for b, ahead, back in zip(x, run(0, x), run(1, x[::-1])[::-1]):
        if b >= 128 or chr(b).isalpha():
            s = net.out @ np.concatenate([ahead, back]) + net.out_bias
            total += np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            n += 1
    return total / max(n, 1)


def test_probabilities_byte_by_byte(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = language.learned(docs)
    texts = [r.text for r in docs.filter("text is not null").orderBy("doc_id").limit(60).collect()]
    short = [t[: 20 + i] for i, t in enumerate(texts)]
    found = language.probabilities(net, short + texts[:12])
    for t, p in zip(short, found):
        if len(t.encode()) <= language.SPAN:  # one span: the whole recurrence
            assert np.allclose(p, plain_probabilities(net, t), atol=1e-4)
    for t, p in zip(texts[:12], found[len(short) :]):
        whole = plain_probabilities(net, t[:3000])
        p = language.probabilities(net, [t[:3000]])[0]
        assert abs(p - whole).max() < 0.05 and p.argmax() == whole.argmax()
