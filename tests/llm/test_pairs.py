import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from vellum.llm.common import mix64, shingle_hashes, words_of
from vellum.llm.components import connected_components
from vellum.llm.fingerprint import edited, fingerprints, near_counts, printed, searched, with_next
from vellum.llm import fingerprint, ngram_join
from vellum.llm.ngram_join import Frequent, links_between, ngram_groups, one_of_each_group, signatures, slack


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_groups(docs, n, percent):
    """For each row: (size of its set, least doc_id reached), rows as nodes."""
    sets = [shingles(d.text, n) for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(docs):
        if d.doc_id is not None:
            least[find(i)].append(d.doc_id)
    return [(len(s), min(least[find(i)]) if least[find(i)] and s else d.doc_id) for i, (d, s) in enumerate(zip(docs, sets))]


def same(found, docs, n, percent):
    want = Counter((d.doc_id, *x) for d, x in zip(docs, brute_groups(docs, n, percent)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want


def test_components_of_odd_rows(odd, none):
    same(ngram_groups(odd).collect(), odd.collect(), 4, 85)
    assert ngram_groups(none).collect() == []


def test_components_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for least in (1, 64):
        same(ngram_groups(docs, frequent_least=least).collect(), docs.collect(), 4, 85)


def test_components_of_a_crowd(spark):
    """One text with random edits: links near the threshold, chains, and long lists."""
    r = np.random.RandomState(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        words = list(base)
        for k in r.choice(60, r.randint(0, 4), replace=False):
            words[k] = f"x{r.randint(1000)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:40]) + " " + " ".join(f"own{i}{j}" for j in range(8)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (2, 1000):
        same(ngram_groups(docs, frequent_least=least).collect(), docs.collect(), 4, 85)


def test_blocks_and_rounds(spark, monkeypatch):
    """The same crowd with blocks of a few nodes and tokens, with many rounds of heads and with none."""
    r = np.random.RandomState(8)
    base = [f"w{i}" for i in range(50)]
    texts = []
    for i in range(60):
        words = list(base)
        for k in r.choice(50, r.randint(1, 3), replace=False):
            words[k] = f"x{r.randint(500)}"
        texts.append(" ".join(words[: 50 - r.randint(4)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    monkeypatch.setattr(ngram_join, "PLACE_NODES", 20)
    monkeypatch.setattr(ngram_join, "HEADS", 1)
    for worth, left in ((0, 0.9), (1e9, 0)):
        monkeypatch.setattr(ngram_join, "WORTH", worth)
        monkeypatch.setattr(ngram_join, "LEFT", left)
        same(ngram_groups(docs, frequent_least=4).collect(), docs.collect(), 4, 85)


def test_links_between_blocks_join_what_all_links_join():
    r = np.random.RandomState(6)
    for _ in range(50):
        n, m = r.randint(1, 8, 2)
        sets = [np.unique(r.randint(0, 12, r.randint(1, 12))) for _ in range(n + m)]
        ends = np.cumsum([len(x) for x in sets])
        flat, starts = np.concatenate(sets), ends - [len(x) for x in sets]
        part = lambda rows: (np.array(rows), np.concatenate([sets[i] for i in rows]), np.cumsum([len(sets[i]) for i in rows]) - [len(sets[i]) for i in rows], np.cumsum([len(sets[i]) for i in rows]))
        state = np.arange(n + m)
        found = links_between(part(range(n)), part(range(n, n + m)), state, 60)
        linked = {(i, j) for i in range(n) for j in range(n, n + m) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
        assert set(found) <= linked and len(found) == n + m - len(set(state.tolist()))
        assert all(state[i] == state[j] for i, j in linked)


def test_linked_sets_share_signatures():
    r = np.random.RandomState(1)
    for _ in range(300):
        n = int(r.randint(2, 120))
        a = np.unique(r.randint(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.rand(len(a)) < 0.95], r.randint(0, 2**63, r.randint(0, 4)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) < 2 or 100 * both < 85 * (len(a) + len(b) - both) or both == len(a) == len(b):
            continue
        often = np.sort(np.union1d(a, b)[r.rand(len(np.union1d(a, b))) < r.rand()])
        frequent = Frequent(often, np.zeros(1 << 22, bool))
        (sa, _, ka), (sb, _, kb) = (signatures(x, frequent, 85) for x in (a, b))
        assert len(np.intersect1d(sa, sb)) >= min(ka, kb) >= 1
    assert slack(100, 85) == 15


def test_one_of_each_group_stays(odd, none):
    docs = odd.collect()
    kept = one_of_each_group(odd)
    assert kept.columns == odd.columns
    kept = kept.collect()
    groups = brute_groups(docs, 5, 80)
    ids = {g for (n, g), d in zip(groups, docs) if n}
    assert sorted(str(k.doc_id) for k in kept if shingles(k.text, 5)) == sorted(map(str, [*ids, 3])) or len(kept) >= len(ids)
    assert sum(not shingles(k.text, 5) for k in kept) == sum(not shingles(d.text, 5) for d in docs)
    texts = [k.text for k in kept if shingles(k.text, 5)]
    assert len(set(texts)) == len(texts)
    assert one_of_each_group(none).collect() == []


def test_connected_components(spark):
    r = np.random.RandomState(0)
    edges = [(int(a), int(b)) for a, b in r.randint(0, 60, (50, 2))] + [(i, i + 1) for i in range(100, 140)]
    found = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for u, v in edges:
        if u != v:
            assert found[u] == found[v] <= min(u, v)
    assert found[140] == 100


def test_hashes_follow_words():
    a, b = words_of(["One  two\tthree", "two three one"], lower=True)
    assert a.tolist() == [b[2], b[0], b[1]]
    assert len(shingle_hashes(a, 4)) == 1 and len(shingle_hashes(a, 2)) == 2
    assert words_of([None, "", " "]) and all(len(x) == 0 for x in words_of([None, "", " "]))


def test_next_documents(odd, none):
    docs = sorted((d for d in odd.collect()), key=lambda d: (d.doc_id is None, -(d.doc_id or 0)))
    found = with_next(odd).collect()
    assert len(found) == len(docs)
    by_id = defaultdict(list)
    for d in docs:
        by_id[d.doc_id].append(d.text or "")
    order = sorted(by_id, key=lambda k: (k is None, -(k or 0)))
    for r in found:
        later = order[(order.index(r.doc_id) + 1) % len(order)]
        after = by_id[later] + by_id[r.doc_id]
        assert any(r.edited_sha256 == hashlib.sha256(edited(t, f).encode()).hexdigest() and r.n_chars == len(t) for t in by_id[r.doc_id] for f in after), r
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 32
    assert with_next(none).collect() == []
    one = odd.filter("doc_id = 9")
    assert with_next(one).first().near_next == 1.0


def test_likeness_tells_edits_from_strangers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = with_next(docs).collect()
    texts = {d.doc_id: d.text for d in docs.collect()}
    prints = defaultdict(set)
    for r in found:
        prints[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    assert np.mean([r.near_edited > r.near_next for r in found]) > 0.97


def test_radius_search_finds_all(spark, monkeypatch):
    r = np.random.RandomState(4)
    base = r.randint(0, 256, (30, 16)).astype(np.uint8)
    rows = [*base, *base[:5]]
    for b in base:
        for _ in range(6):
            bits = np.unpackbits(b)
            bits[r.choice(128, r.randint(1, 10), replace=False)] ^= 1
            rows.append(np.packbits(bits))
    prints = [bytes(x).hex() for x in rows]
    distinct = sorted(set(prints))
    raw = [np.frombuffer(bytes.fromhex(p), np.uint8) for p in distinct]
    for radius, blocks in ((6, 8), (3, 4), (0, 2)):
        want = Counter()
        for i in range(len(raw)):
            for j in range(i):
                if np.unpackbits(raw[i] ^ raw[j]).sum() <= radius:
                    want[distinct[i]] += 1
                    want[distinct[j]] += 1
        df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
        found = near_counts(df, radius, blocks).collect()
        assert {x.fingerprint: x.n_near for x in found} == want and len(found) == len(want)
        monkeypatch.setattr(fingerprint, "RUN", 3)  # long runs in parts
        assert {x.fingerprint: x.n_near for x in near_counts(df, radius, blocks).collect()} == want
        monkeypatch.undo()


def test_search_of_odd_rows(odd, none):
    rows = searched(odd).collect()
    assert len(rows) == odd.count() and searched(none).collect() == []
    prints = {r.fingerprint for r in rows}
    bits = lambda p: np.unpackbits(np.frombuffer(bytes.fromhex(p), np.uint8))
    for r in rows:
        assert r.n_near == sum((bits(r.fingerprint) != bits(p)).sum() <= 6 for p in prints) - 1


def test_bits_are_signs_of_votes():
    text = "The quick brown fox jumps over the the lazy dog"
    words = text.lower().split()
    hashes = [int(x[0]) for x in words_of(words)]
    votes = [0] * 128
    terms = [(h, max(1, len(w) - 2)) for h, w in zip(hashes, words)]
    mix = lambda x: int(mix64(np.array([x % 2**64], np.uint64))[0])
    terms += [(mix(a * 3 + b), 6) for a, b in zip(hashes, hashes[1:])]
    for h, weight in terms:
        for half, x in enumerate((h, mix(h + 0x9E3779B97F4A7C15))):
            for byte in range(8):
                for bit in range(8):
                    votes[64 * half + 8 * byte + bit] += weight if x >> (8 * byte + 7 - bit) & 1 else -weight
    assert np.unpackbits(fingerprints([text])[0]).tolist() == [int(v > 0) for v in votes]


def test_fingerprints_of_rows(odd):
    found = printed(odd).collect()
    assert len(found) == odd.count()
    assert bytes(fingerprints([None])[0]) == bytes(16)
