import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellum.llm.packing import best_two_fit, pack_documents
from vellum.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    import random

    r = random.Random(2)
    path = public_tokenizers.path(name)
    alphabet = [*" ab's  \n\t éß1.,'ll don't Σς́\x1c\r字 #$%İ\xa0\u2003", "<|endoftext|>", "İ.", "<|startoftext|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += [None, "x" * 5000, "İ.", "x <|endoftext|> y", "a \n<|endoftext|>\n b", "<|endoftext|", " <|endoftext|><|endoftext|> ", "word.\n\nWord!  two"]
    mine, theirs = Encoder(path, memory=500), library(path)
    for k in range(0, len(texts), 100):
        for t, raw in zip(texts[k : k + 100], mine.encode(texts[k : k + 100])):
            assert np.frombuffer(raw, "<u4").tolist() == theirs(t), t


def check(rows, docs, capacity):
    ids_of = library(PATH)
    want = Counter()
    for d in docs:
        ids = np.array(ids_of(d.text) + [0], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want[d.doc_id, p, at, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_odd_rows(odd, none):
    for capacity in (2048, 50):
        rows = pack_documents(odd, PATH, capacity).collect()
        check(rows, odd.collect(), capacity)
    assert pack_documents(none, PATH).collect() == []
    row = pack_documents(odd, PATH, 50, with_ids=True).filter("length > 3").first()
    assert len(row.ids) == row.length and zlib.crc32(np.array(row.ids, "<u4").tobytes()) == row.ids_crc32


def test_whole_table_is_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack_documents(docs, PATH).collect()
    n = check(rows, docs.collect(), 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_plan_uses_every_piece_once():
    r = np.random.RandomState(0)
    for _ in range(30):
        capacity = int(r.randint(5, 60))
        counts = {int(x): int(r.randint(1, 40)) for x in r.choice(np.arange(1, capacity + 1), r.randint(1, capacity), replace=False)}
        used = Counter()
        for repeats, bin_ in best_two_fit(counts, capacity):
            assert sum(bin_) <= capacity and repeats > 0
            for x in bin_:
                used[x] += repeats
        assert used == counts


def test_two_replace_the_smallest():
    assert best_two_fit({7: 1, 2: 1, 1: 0, 5: 0}, 10) == [(1, [7, 2])]
    # 6 + 3 leaves 1; instead of 3, the two 2s fill the bin.
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def plain_two_fit(lengths, capacity):
    """Bin by bin over a list of all pieces: greedy with the longest that fit, then the last one for the best two."""
    left, bins = sorted(lengths), []
    while left:
        bin_, gap = [], capacity
        for x in reversed(list(left)):
            if x <= gap:
                left.remove(x)
                bin_.append(x)
                gap -= x
        if gap:
            room = gap + bin_[-1]
            best = max(((a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room), default=(0, 0))
            if best[0] > bin_[-1]:
                left.append(bin_.pop())
                for x in (best[1], best[0] - best[1]):
                    left.remove(x)
                    bin_.append(x)
                left.sort()
        bins.append(sum(bin_))
    return sorted(bins)


def test_plan_against_bins_one_by_one():
    r = np.random.RandomState(5)
    for _ in range(60):
        capacity = int(r.randint(8, 40))
        lengths = r.randint(1, capacity + 1, r.randint(1, 40)).tolist()
        plan = best_two_fit(Counter(lengths), capacity)
        assert sorted(sum(b) for n, b in plan for _ in range(n)) == plain_two_fit(lengths, capacity)


def test_one_row_for_a_third_of_the_table(spark):
    one = spark.range(40000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "1 AS length", "'x' AS _g", "id AS _deal", "2 AS _r")
    rows = pack_documents(one, PATH, 100)
    assert rows.count() == 40000 and rows.select("sequence_id").distinct().count() == 400
    assert rows.groupBy("sequence_id").agg({"offset": "max"}).filter("`max(offset)` != 99").count() == 0
