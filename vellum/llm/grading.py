"""Ordinal grading of documents: a cumulative-link model on hashed words.

Grades 0, 1, ..., K share one weight per hashed feature; ordered thresholds
cut the score into grades: P(grade >= k) = sigmoid(score - threshold k). The
features of a text are its distinct words (between white space and ASCII marks,
capitals lowered) and marks of its form (shares of words with symbols, of capitals, of words that repeat
the word before, in steps). The model is fitted in numpy on a bounded sample
of labelled documents; whole texts are scored.

Defined cases: null and empty texts have no feature and get the score 0;
labels that are null or have no document are not learned from; of several
labels of a document the lowest grade counts, of several texts of one id the
one with the least hash is learned from; without labels of two grades
every document gets the highest; repeated rows are graded each for itself;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, mix64, tidy, utf8, words_of, written
from .tokens import GROUP_CHARS, in_groups

BITS = 18
#: Labelled documents that the fit may see, features of all of them; a feature is used if it occurs in LEAST_DOCS of
#: them and passes the screen for some grade at the level FALSE_SHARE of false discoveries; and the fit's course.
SAMPLE, SAMPLE_FEATURES, LEAST_DOCS, FALSE_SHARE, STEPS, RATE, DECAY = 8000, 32_000_000, 5, 0.01, 200, 0.12, 2e-3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct feature numbers, below 2**BITS, of each text."""
    out = []
    for text, words in zip(texts, words_of(texts, lower=True, bare=True)):
        found = np.unique(words >> np.uint64(64 - BITS)).astype(np.int32)
        if len(words):
            raw = utf8(text)
            letters = max(1, int((~_SPACE[raw]).sum()))
            shares = (_SYMBOL[raw].sum() / len(words), 4 * ((raw >= 65) & (raw <= 90)).sum() / letters, 4 * (words[1:] == words[:-1]).sum() / len(words), 4 * (1 - len(np.unique(words)) / len(words)), min(1.0, 10 / len(words)))
            marks = np.array([k * 16 + min(15, int(8 * x)) for k, x in enumerate(shares)], np.uint64)
            found = np.union1d(found, (mix64(marks + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int32))
        out.append(found)
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """(texts, K): P(grade >= k) for k = 1..K."""
        scores = np.array([self.weights[f].sum() for f in features(texts)])
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -60, 60)))


def screened(flat: np.ndarray, row: np.ndarray, docs: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Whether each feature tells some grade from the rest: the share of its documents with that grade, in standard
    errors, by the step-up rule of Benjamini and Hochberg over all features in LEAST_DOCS documents."""
    z = np.zeros(len(docs))
    for grade in range(grades.max() + 1):
        off = (grades == grade).astype(float)
        off = (off - off.mean()) / max(1e-9, off.std())
        z = np.maximum(z, np.abs(np.bincount(flat, off[row], len(docs))) / np.sqrt(np.maximum(docs, 1)))
    enough = docs >= LEAST_DOCS
    ordered = np.sort(z[enough])[::-1]
    chance = np.array([math.erfc(x / math.sqrt(2)) for x in ordered]) * (grades.max() + 1)
    passed = np.nonzero(chance <= FALSE_SHARE * np.arange(1, len(ordered) + 1) / max(1, len(ordered)))[0]
    return enough & (z >= ordered[passed[-1]]) if len(passed) else np.zeros(len(docs), bool)


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS) -> Model:
    """Adam on the mean negative log-likelihood with weight decay, classes weighed alike in part."""
    top = int(grades.max())
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    docs = np.bincount(flat, minlength=1 << BITS)
    keep = screened(flat, row, docs, grades)[flat]
    row = row[keep]
    dims, col = np.unique(flat[keep], return_inverse=True)
    n = len(rows)
    share = np.bincount(grades, minlength=top + 1) / n
    weight = (1 / np.maximum(share, 1e-9))[grades] ** 0.5
    weight /= weight.sum()
    w, base, gaps = np.zeros(len(dims)), -2.0, np.zeros(top - 1)
    state = [np.zeros(len(dims) + top) for _ in range(2)]
    for t in range(1, steps + 1):
        theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.bincount(row, w[col], n)
        edge = np.concatenate([np.full((n, 1), 40.0), np.clip(s[:, None] - theta, -40, 40), np.full((n, 1), -40.0)], 1)
        tail = 1 / (1 + np.exp(-edge))
        slope = tail * (1 - tail)
        slope[:, [0, -1]] = 0
        at = np.arange(n)
        p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
        above, below = weight * slope[at, grades] / p, weight * slope[at, grades + 1] / p
        g_s = below - above
        g_theta = np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, above, 0), top) - np.bincount(np.minimum(grades, top - 1), np.where(grades < top, below, 0), top)
        g_w = np.bincount(col, g_s[row], len(dims)) + DECAY * w / max(1, n) * 10
        tails = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, tails[:1], tails[1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = RATE * (1 - (t - 1) / steps) * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-7)
        w -= step[: len(dims)]
        base -= step[len(dims)]
        gaps -= step[len(dims) + 1 :]
    full = np.zeros(1 << BITS)
    full[dims] = w
    return Model(full, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def graded(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, least_tail: float = 0.6) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade), grade and kept, for every document.

    A document is kept if its tail probability is ``least_tail`` or more.
    ``grades`` has doc_id and grade, whole numbers from 0. About ``sample`` of
    them, chosen by a hash, are learned from, fewer if they have more than about
    SAMPLE_FEATURES features: their ids and features are all
    that the driver gathers.
    """
    n = grades.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    part = place < F.ceil(F.lit((1 << 30) * min(1.0, sample / max(1, n))))
    chosen = grades.filter(part & F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = written(chosen.limit(2 * sample), "grades")

    def learn(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            for s in in_groups(texts, GROUP_CHARS):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(s.start, s.stop - s.start) for c in (1, 2)), pa.array(features(texts[s]), pa.list_(pa.int32()))], names=["grade", "place", "f"])

    seen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("grade").cast("int"), place.alias("place"))
    # Of several texts of one id the one with the least hash, so that no more than the chosen ids' texts are learned from.
    seen = seen.groupBy("doc_id", "grade", "place").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "grade", "place")
    seen = written(seen.mapInArrow(tidy(learn), "grade int, place long, f array<int>"), "features")
    total, last = seen.agg(F.sum(F.size("f")), F.max("place")).first()
    if total and total > SAMPLE_FEATURES:  # whole documents are left out, as many as are too much
        seen = seen.filter(F.col("place") <= int(last * SAMPLE_FEATURES / total))
    seen = seen.toArrow()
    y = seen.column("grade").to_numpy()
    if len(set(y.tolist())) < 2:
        top = int(y.max()) if len(y) else 1
        model = Model(np.zeros(1 << BITS), np.full(max(1, top), -40.0))
    else:
        model = fit([np.asarray(f.as_py(), np.int32) for f in seen.column("f")], y.astype(np.int64))

    def score(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in in_groups(texts, GROUP_CHARS):
                tails = model.tails(texts[s])
                expected = tails.sum(1)
                bounds = np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), pa.array(expected), pa.array(tails[:, -1]), pa.array((bounds[:, :-1] - bounds[:, 1:]).argmax(1).astype(np.int32)), pa.array(tails[:, -1] >= least_tail)], names=["doc_id", "expected_grade", "tail_probability", "grade", "kept"])

    return docs.select("doc_id", "text").mapInArrow(tidy(score), f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, tail_probability double, grade int, kept boolean")


def rated(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 of poor quality, 1 good but toxic, 2 good and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
