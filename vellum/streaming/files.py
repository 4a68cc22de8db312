"""Conversion of a stream of files: the transformation is row by row and keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import DocumentEngine

FILES = "path string, modificationTime timestamp, length long, content binary"


def with_hints(files: DataFrame) -> DataFrame:
    return files.withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("url", F.lit(None).cast("string"))


def read_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """Files with their names as hints. A limit on length is applied before any content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return with_hints(files.filter(F.col("length") <= max_bytes) if max_bytes else files)


def stream_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return with_hints(spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(path))


def convert_stream(spark: SparkSession, path: str, engine: DocumentEngine, glob: str = "*") -> DataFrame:
    return engine.convert(stream_files(spark, path, glob))


def append(spark: SparkSession, path: str, target: str, checkpoint: str, engine: DocumentEngine, glob: str = "*"):
    """Converts what is there now and appends it to ``target``, each file once."""
    return convert_stream(spark, path, engine, glob).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
