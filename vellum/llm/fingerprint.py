"""SimHash fingerprints of whole texts, and a search within a Hamming radius.

Every term (a word, and each pair of neighbouring words) has a 128-bit hash;
each bit of a text's fingerprint is the sign of the terms' weighted votes. A
word weighs by its length, as long words say more; a pair weighs ``PAIR``.

The search permutes blocks of the bits: with more blocks than the radius, two
fingerprints within it agree on some choice of (blocks - radius) whole blocks;
a table for each choice, keyed by these blocks, brings every such pair
together. Equal fingerprints are one class, so copies never meet each other. A
pair counts in the first table that brings it together, and what comes out is
each class's number of others in the radius, so no row stands for a pair. A
key with more than ``RUN`` classes, as a family of near copies has, is dealt
to parts, each of which meets each.

Defined cases: null and empty texts, and texts without a word, have the
fingerprint of no votes (all bits 0); equal texts have equal fingerprints;
repeated ids are ordered by a hash of their text; a null id comes last; a
table of one row is its own next document; a very long text votes in one piece,
in memory that follows its length; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, mix64, tidy, words_of, written
from .token_files import by_id
from .tokens import GROUP_CHARS, in_groups

BITS, PAIR, RUN = 128, 6, 1024
#: The search's radius, and the blocks of its tables.
RADIUS, BLOCKS = 6, 8
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) * 2 - 1)  # of a byte's bits


def _votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    raw = np.stack([hashes, mix64(hashes + np.uint64(0x9E3779B97F4A7C15))], 1).view(np.uint8).reshape(len(hashes), BITS // 8)
    at = raw.astype(np.int64) + np.arange(BITS // 8) * 256
    counts = np.bincount(at.reshape(-1), np.repeat(weights, BITS // 8), 256 * BITS // 8).reshape(-1, 256)
    return (counts @ _SIGNS).reshape(-1)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """(texts, 16) bytes."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    hashed = words_of(texts, lower=True)
    for k, (words, text) in enumerate(zip(hashed, texts)):
        if not len(words):
            continue
        lengths = np.array([len(w) for w in (text or "").encode("utf-8", "surrogatepass").split()], np.float64)
        pairs = mix64(words[:-1] * np.uint64(3) + words[1:])
        votes = _votes(np.concatenate([words, pairs]), np.concatenate([np.maximum(1.0, lengths - 2), np.full(len(pairs), float(PAIR))]))
        out[k] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits of two arrays of fingerprints."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(1) / BITS


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by as many of ``following``'s first."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next in descending doc_id. Documents are dealt by
    ranges of doc_id; in a range each row is followed by the next, and the last
    row of a range by the first of the next range that has rows: those first
    rows, one for each range, go to their neighbours in a second step.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    names = ["part", "role", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]
    schema = f"part int, role string, doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"

    def rows(part, ids, texts):
        """Of all ``texts`` but the last, which is only the next of the one before it."""
        changed = [edited(t, f) for t, f in zip(texts, texts[1:])]
        prints, other = fingerprints(texts), fingerprints(changed)
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        hexed = lambda x: [bytes(r).hex() for r in x]
        k = len(changed)
        return pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(["row"] * k), ids, pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(sha), pa.array(hexed(prints[:-1])), pa.array(hexed(other)), pa.array(likeness(prints[:-1], other)), pa.array(likeness(prints[:-1], prints[1:])), pa.nulls(k, pa.string())], names=names)

    def edge(part, role, id_, text):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([role]), id_, pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2, pa.array([text], pa.string())], names=names)

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            texts = b.column(1).to_pylist()
            if held is None and len(texts):
                yield edge(part, "first", b.column(0).slice(0, 1), texts[0])
            for s in in_groups(texts, GROUP_CHARS):
                mine, ids = texts[s], b.column(0).slice(s.start, s.stop - s.start)
                if held is not None:
                    mine, ids = [held[1], *mine], pa.concat_arrays([held[0], ids])
                if len(mine) > 1:
                    yield rows(part, ids.slice(0, len(ids) - 1), mine)
                held = ids.slice(len(ids) - 1, 1), mine[-1]
        if held is not None:
            yield edge(part, "last", *held)

    done = written(by_id(docs, parts, descending=True).mapInArrow(tidy(run), schema), "fingerprints")
    # Two rows for each range: the next range with rows is found by the ranges' numbers alone.
    firsts = [r["part"] for r in done.filter("role = 'first'").select("part").orderBy("part").collect()]
    following = {p: firsts[(i + 1) % len(firsts)] for i, p in enumerate(firsts)}
    if not firsts:
        return done.select(*names[2:-1])
    to = F.create_map(*(F.lit(x) for pair in following.items() for x in pair))
    last = done.filter("role = 'last'").select(to[F.col("part")].alias("to"), "part", "doc_id", "text")
    first = done.filter("role = 'first'").select(F.col("part").alias("to"), F.col("text").alias("next_text"))

    def join(batches):
        for b in batches:
            mine, after = (b.column(c).to_pylist() for c in (2, 3))
            for i in range(len(mine)):
                yield rows(b.column(0)[i].as_py(), b.column(1).slice(i, 1), [mine[i], after[i]])

    ends = last.join(first, "to").select("part", "doc_id", "text", "next_text").mapInArrow(tidy(join), schema)
    return done.filter("role = 'row'").unionByName(ends).select(*names[2:-1])


def printed(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (32 hex digits) of every text."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in in_groups(texts, GROUP_CHARS):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), pa.array([bytes(r).hex() for r in fingerprints(texts[s])])], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def first_tables(radius: int, blocks: int) -> np.ndarray:
    """The number of the first table whose blocks are all among the set bits, for each set of blocks; -1 if none is."""
    chosen = [sum(1 << j for j in c) for c in combinations(range(blocks), blocks - radius)]
    return np.array([next((t for t, c in enumerate(chosen) if agree & c == c), -1) for agree in range(1 << blocks)])


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint and n_near, the number of other fingerprints (hex) at most ``radius`` bits from it, where there are any.

    ``prints`` has a column fingerprint; its rows with equal ones are members of one class.
    """
    if not radius < blocks <= 8 or (BITS // 4) % blocks:
        raise ValueError("blocks must divide the fingerprint's hex digits, be at most 8 and exceed the radius")
    width = BITS // 4 // blocks
    classes = written(prints.select("fingerprint").distinct(), "classes")
    keys = [F.concat(*(F.substring("fingerprint", j * width + 1, width) for j in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    table = classes.select(F.unhex("fingerprint").alias("f"), F.posexplode(F.array(*(F.xxhash64(F.lit(t), k) for t, k in enumerate(keys)))).alias("t", "key"))
    crowds = few(written(table.groupBy("key").agg(F.ceil(F.count("*") / RUN).cast("int").alias("parts")).filter("parts > 1"), "crowds"))
    rows = table.join(crowds, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one, two = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.select(F.when(F.col("parts") > 1, F.xxhash64("key", one, two)).otherwise(F.col("key")).alias("place"), "t", "f", "part", (one != two).alias("across"))
    first = first_tables(radius, blocks)
    bits, each = BITS // blocks, np.uint64(2 ** (BITS // blocks) - 1)

    def counted(t, f, part, across):
        """How many partners each of the rows of one place has; f is (rows, 2) in big-endian halves."""
        n = np.zeros(len(t), np.int64)
        for i in range(len(t) - 1):
            x = f[i + 1 :] ^ f[i]
            near = (np.bitwise_count(x).sum(1) <= radius) & (t[i + 1 :] == t[i]) & (~across[i] | (part[i + 1 :] != part[i]))
            if near.any():
                agree = sum(((x[:, (k * bits) // 64] >> np.uint64(64 - bits - (k * bits) % 64)) & each == 0).astype(np.int64) << k for k in range(blocks))
                near &= first[agree] == t[i]
                n[i] += near.sum()
                n[i + 1 :] += near
        return n

    def run(batches):
        held = None
        names = ["f", "n"]

        def emit(place, t, f, part, across):
            edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
            for s, e in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1]):
                n = counted(t[s:e], f[s:e], part[s:e], across[s:e])
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([f[s + k].astype(">u8").tobytes() for k in some], pa.binary()), pa.array(n[some])], names=names)

        for b in batches:
            f = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
            mine = [b.column(0).to_numpy(), b.column(1).to_numpy(), f, b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False).astype(bool)]
            if held is not None:
                mine = [np.concatenate(x) for x in zip(held, mine)]
            if len(mine[0]):
                last = int(np.searchsorted(mine[0], mine[0][-1]))  # the last place may go on in the next batch
                yield from emit(*(x[:last] for x in mine))
                held = [x[last:] for x in mine]
        if held is not None:
            yield from emit(*held)

    met = rows.repartition("place").sortWithinPartitions("place").mapInArrow(tidy(run), "f binary, n long")
    return met.groupBy("f").agg(F.sum("n").alias("n_near")).select(F.lower(F.hex("f")).alias("fingerprint"), "n_near")


def searched(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``with_next`` and n_near: how many other fingerprints of the table are within the radius of the row's own."""
    rows = written(with_next(docs), "prints")
    near = few(written(near_counts(rows, radius, blocks), "near"))
    return rows.join(near, "fingerprint", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long"))).select(*rows.columns, "n_near")
