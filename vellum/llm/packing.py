"""Best-two-fit packing of documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so the packing is planned on
their histogram, whose size doesn't follow the corpus: a bin is filled
greedily with the longest piece that fits; then its shortest piece is replaced
by two unpacked ones where these fill the widened gap better. As long as no
length runs out, the next bin comes out the same, so a bin's pattern is
repeated while the counts last. Pieces then find their places by their rank
among the pieces of equal length.

Defined cases: null and empty texts are one piece that holds the end id alone;
repeated rows and repeated ids are packed each for itself, pieces of one length
in any order; a very long text is encoded in one piece, in memory that follows
its length; extra columns of the input are ignored (only ``doc_id`` and ``text`` are read); an empty table
gives an empty result. Only documents longer than the capacity are cut, and
sequences carry no token twice.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written
from .tokens import encoder, in_groups

#: Pieces of one length that are ranked together; a length that holds a third of all pieces is dealt to many such groups.
RANKED_TOGETHER = 20_000


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, memory: int = 150_000) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 (and ids, where asked).

    ``memory``: words whose ids a Python worker remembers, 200 bytes each; more make it faster.
    """

    def run(batches):
        enc = encoder(tokenizer_path, memory)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in in_groups(texts):
                rows: list[tuple] = []
                for k, raw in zip(range(part.start, part.stop), enc.encode(texts[part])):
                    raw += end
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[at : at + 4 * capacity]
                        rows.append((k, p, at // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
                k, p, at, n, crc, raws = zip(*rows)
                out = [ids.take(pa.array(k, pa.int64())), pa.array(p, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raws], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(repeats, lengths of the pieces of a bin) until the counts are used up."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    lengths = [int(x) for x in np.flatnonzero(left)]  # ascending; what is used up is taken out

    def longest(room: int, used: dict[int, int]) -> int:
        i = bisect_right(lengths, room)
        while i:
            i -= 1
            if left[lengths[i]] > used.get(lengths[i], 0):
                return lengths[i]
        return 0

    index = np.arange(capacity + 1)
    while lengths:
        used: dict[int, int] = {}
        bin_, gap = [], capacity
        while gap and (x := longest(gap, used)):
            bin_.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        if gap:
            least = bin_[-1]
            room = gap + least
            free = left.copy()
            for x, n in used.items():
                free[x] -= n
            first = np.flatnonzero(free[: room + 1] > 0)
            if len(first):
                below = np.maximum.accumulate(np.where(free[: room + 1] > 0, index[: room + 1], 0))
                second = below[room - first]
                alone = (second == first) & (free[first] < 2)
                second = np.where(alone, below[np.maximum(first - 1, 0)], second)
                both = np.where(second > 0, first + second, 0)
                k = int(len(both) - 1 - np.argmax(both[::-1]))
                if both[k] > least:
                    bin_[-1:] = [int(first[k]), int(second[k])]
                    used = {x: bin_.count(x) for x in bin_}
        repeats = int(min(left[x] // n for x, n in used.items()))
        for x, n in used.items():
            left[x] -= n * repeats
            if not left[x]:
                del lengths[bisect_right(lengths, x) - 1]
        plan.append((repeats, bin_))
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """By (length, first rank): where in the plan the pieces of that length go."""
    seen: dict[int, int] = {}
    rows, offsets, sequence = [], [], 0
    for repeats, bin_ in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for x in bin_:
            places.setdefault(x, []).append(at)
            at += x
        for x, where in places.items():
            rows.append((x, seen.get(x, 0), len(where), sequence, len(offsets)))
            offsets += where
            seen[x] = seen.get(x, 0) + repeats * len(where)
        sequence += repeats
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), cols)) | {"offsets": np.array(offsets, np.int64)}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (a stored table with a column ``length`` from 1 to ``capacity``) with sequence_id and offset.

    A column ``_deal``, where there is one, tells apart pieces that are alike.

    The driver holds the histogram and the plan: both are bounded by the capacity.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(best_two_fit(counts, capacity))
    groups = max(1, sum(counts.values()) // RANKED_TOGETHER)
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    deal = F.col("_deal") if "_deal" in pieces.columns else F.struct(*order)
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64(deal), F.lit(groups)))
    within = Window.partitionBy("length", "_g").orderBy(*order)
    sizes = dealt.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_g")) - F.col("_n")).drop("_n")
    ranked = dealt.withColumn("_r", F.row_number().over(within) - 1).join(before, ["length", "_g"]).withColumn("_r", F.col("_r") + F.col("_before")).drop("_g", "_before")
    columns = [c for c in ranked.columns if c != "_r"]

    def place(batches):
        keys = (slots["length"] << 44) + slots["rank"]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_r"))
            i = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            inside = rank - slots["rank"][i]
            bin_, k = inside // slots["each"][i], inside % slots["each"][i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(slots["sequence"][i] + bin_), pa.array(slots["offsets"][slots["offset"][i] + k])], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_r").schema)
    return ranked.mapInArrow(tidy(place), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, memory: int = 150_000) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    # A number of its own for each piece deals out even pieces that are alike.
    pieces = written(tokenized_pieces(docs, tokenizer_path, capacity, end_id, with_ids, memory).withColumn("_deal", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return pack(pieces, capacity).select(*columns, "sequence_id", "offset")
