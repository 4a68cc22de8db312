"""Operators on tables of lines, blocks and cells. Order within a document is always a column's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def paragraphs(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """keys, ord, paragraph: what blank lines separate, blank ones left out."""
    parts = df.select(*keys, F.posexplode(F.split(text, "\n\n")).alias("ord", "part"))
    return parts.select(*keys, "ord", F.replace(C.trim(F.col("part")), F.lit("\n"), F.lit(" ")).alias("paragraph")).filter("paragraph != ''")


def as_markdown(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: C.trim(p)), lambda p: p != "")
    return F.concat(F.array_join(F.transform(parts, lambda p: C.escape(p)), "\n\n"), F.lit("\n"))


def joined(df: DataFrame, keys: list[str], order: list[str], line: Column, between: str, name: str) -> DataFrame:
    """The lines of each group in order, in one string. Groups are documents, bounded by the limits on input and output."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), between).alias(name))


def gfm_tables(df: DataFrame, keys: list[str], order: list[str], header: list[str], cells: Column, max_rows: int = 5000) -> DataFrame:
    """markdown of one table for each group: at most ``max_rows`` rows, and a note on the others."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = ranked.withColumn("_cells", cells)
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") <= max_rows, F.struct("_n", C.gfm_row(F.col("_cells")).alias("line")))))
    head = "| " + " | ".join(header) + " |\n| " + " | ".join(["---"] * len(header)) + " |"
    out = rows.groupBy(*keys).agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n"))
    note = F.when(F.col("n") > max_rows, F.concat(F.lit("\n\n_… "), (F.col("n") - max_rows).cast("string"), F.lit(" further rows omitted_"))).otherwise("")
    return out.select(*keys, F.concat(F.lit(head + "\n"), F.col("body"), note).alias("markdown"), (F.col("n") > max_rows).alias("truncated"))


def capped(df: DataFrame, keys: list[str], order: list[str], piece: Column, most: int) -> DataFrame:
    """The pieces of each group as far as their bytes, with two for each gap, stay within ``most``."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("bytes_so_far", F.sum(F.octet_length(piece) + 2).over(run)).filter(F.col("bytes_so_far") <= most)


def page_blocks(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Headings and paragraphs of pages: a heading or a blank line ends a paragraph."""
    level = C.heading_level(F.col(line))
    breaks = lines.withColumn("level", level).withColumn("_b", (F.col("level").isNotNull() | (C.trim(F.col(line)) == "")).cast("int"))
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = breaks.withColumn("island", F.sum("_b").over(run) * 2 + 1 - F.col("_b")).filter(C.trim(F.col(line)) != "")
    ordered = F.array_sort(F.collect_list(F.struct(order, line)))
    out = islands.groupBy(key, "island").agg(F.max("level").alias("level"), F.min(order).alias("ord"), F.transform(ordered, lambda x: x[line]).alias("_lines"))
    return out.select(key, "ord", "level", C.rejoin(F.col("_lines")).alias("said"))
