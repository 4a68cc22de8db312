"""Token ids of a corpus in binary files, in ascending order of the documents' ids.

The texts are dealt by range of doc_id to shards, encoded there, and written
as frames (see ``pfor``), one row for each document, through Spark's writer:
the files can stand in any store that Spark reaches, and a task that is lost
is written again. Rows of a file are in order, files are in the order of their
shards. The sum of each shard's ids gives its place in the whole.

Defined cases: null and empty texts hold the end id alone; a null doc_id comes
first; rows of one doc_id are ordered by a hash of their text, repeated rows in
any order; a very long text is one frame, in memory that follows its length;
texts below a block's 128 ids are stored as they are packed, without an index;
other columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .common import new_path, tidy
from .tokens import encoder, in_groups


def by_id(docs: DataFrame, parts: int, descending: bool = False) -> DataFrame:
    """doc_id and text (null: empty) in ``parts`` ranges of doc_id, null last in descending and first in ascending
    order; rows of one id stand by a hash of their text, like rows are dealt by where they come from."""
    order = F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_first()
    text = F.coalesce("text", F.lit("")).alias("text")
    keyed = docs.select("doc_id", text, F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("place"))
    return keyed.repartitionByRange(parts, order, "key", "place").sortWithinPartitions(order, "key", "place").select("doc_id", "text")


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, shards: int | None = None, memory: int = 400_000) -> None:
    """Writes the files: shard, ordinal, doc_id, start (in its shard), n_tokens, frame."""
    conf = docs.sparkSession.conf
    shards = shards or int(conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        enc, end = encoder(tokenizer_path, memory), np.array([end_id], "<u4").tobytes()
        shard, ordinal, start = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in in_groups(texts):
                ids = [np.frombuffer(raw + end, "<u4") for raw in enc.encode(texts[part])]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                k = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard, np.int32)), pa.array(np.arange(ordinal, ordinal + k)), b.column(0).slice(part.start, k), pa.array(starts), pa.array(sizes), pa.array(pfor.encode(ids), pa.binary())], names=["shard", "ordinal", "doc_id", "start", "n_tokens", "frame"])
                ordinal, start = ordinal + k, start + int(sizes.sum())

    frames = by_id(docs, shards).mapInArrow(tidy(run), f"shard int, ordinal long, doc_id {kind}, start long, n_tokens long, frame binary")
    frames.write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, where asked), decoded from the files."""
    files = spark.read.parquet(path)
    kind = dict(files.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            frames = b.column(3)
            for at in range(0, len(frames), 256):
                ids = pfor.decode(frames.slice(at, 256).to_pylist())
                k = len(ids)
                out = [b.column(c).slice(at, k) for c in range(3)]
                out += [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["shard", "doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    rows = files.select("shard", "doc_id", "start", "frame").mapInArrow(tidy(run), f"shard int, doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # One row for each shard, so as many as there were shuffle partitions.
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "shard").withColumn("start", F.col("start") + F.col("before")).drop("shard", "before")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, memory: int = 400_000) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path, end_id, memory=memory)
    return read_tokens(docs.sparkSession, path)
