"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, in an order shuffled by a hash, form a line of words;
blocks of equal length are cut from the line, which may be walked up to
``most`` times. The schedule is a row of slots, as many as blocks make up all
targets: slot i belongs to the source on whose stretch of the cumulative
targets the i-th golden-ratio point falls. The points decide how many slots a
source gets; any stretch of the schedule has the sources near their weights,
the whole schedule within a few blocks. A slot's rank among those of its
source is the number of the block that it takes; a line that has been walked
``most`` times gives no more. What comes out are spans of documents in the
order of the slots.

Running sums over a source and ranks over the slots of a source are taken in
two levels (within buckets, over buckets), so a source with a third of all
rows is dealt to many tasks. Only DataFrame functions are used.

Defined cases: null and empty texts have size 0 and are never taken; a null
source is a source of its own, the last; rows with one id stand on the line by
their sizes, and repeated rows are mixed each for itself, in any order among
themselves; a null id stands by its text; a very long text spans as many
blocks as it needs; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, few, written

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 8_000
#: Words of a block.
BLOCK = 64
_CELLS = 4096
_CHUNK = 8192
#: Points are multiples of 1 / _POINTS; _GOLDEN is _POINTS over the golden ratio, and odd, so that a period has every point once.
_POINTS, _GOLDEN = 2**31, 1327217885


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (which shuffles), size (words)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return docs.select("doc_id", "source", key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def with_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """k (the source's place by code point, null last), source, source_size, weight, target.

    Targets share the sum of all sizes by weight; one that would exceed
    ``most`` times its source's size stops there, and the others share the
    rest: a common water level times the weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    per = per.withColumn("k", place).withColumn("weight", cycle).withColumn("cap", most * F.col("source_size").cast("double"))
    all_ = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumns({"total": F.sum("source_size").over(all_).cast("double"), "weights": F.sum("weight").over(all_), "caps_before": F.sum("cap").over(fill) - F.col("cap"), "weights_before": F.sum("weight").over(fill) - F.col("weight")})
    per = per.withColumn("full", F.col("cap") / F.col("weight") <= (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))
    capped = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(all_)
    level = F.try_divide(F.col("total") - capped("cap"), F.col("weights") - capped("weight"))
    return per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))).select("k", "source", "source_size", "weight", "target")


def on_lines(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with k, source_size, target and ``at``: the words before each document on its source's shuffled line."""
    wide = few(sources)
    rows = sizes.join(wide, sizes["source"].eqNullSafe(wide["source"])).select("doc_id", "key", "size", "k", "source_size", "target")
    buckets = max(1, sizes.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * buckets / 2**32))
    sums = rows.groupBy("k", "bucket").agg(F.sum("size").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("k").orderBy("bucket")) - F.col("s")).drop("s")
    within = Window.partitionBy("k", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("at", F.sum("size").over(within) - F.col("size")).join(before, ["k", "bucket"]).withColumn("at", F.col("at") + F.col("before")).drop("key", "bucket", "before")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """slot, k, rank: the source of each slot and the block of its line that the slot takes."""
    spark = sources.sparkSession
    total, n = sources.agg(F.sum("source_size"), F.count("*")).first()
    slots = -(-(total or 0) // block)
    cells = max(_CELLS, 1 << (4 * n).bit_length())
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = sources.withColumns({"hi": F.sum("target").over(run) / F.sum("target").over(Window.partitionBy()), "last": F.max("k").over(Window.partitionBy()) == F.col("k")})
    spans = spans.withColumn("hi", F.when(F.col("last"), F.lit(_POINTS)).otherwise(F.floor(F.col("hi") * _POINTS + 0.5).cast("long")))
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("k")), F.lit(0))).filter("lo < hi").select("k", "lo", "hi")
    wide = _POINTS // cells
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) % _POINTS * _GOLDEN % _POINTS).alias("x")).withColumn("cell", F.floor(F.col("x") / wide))
    dealt = points.join(spans, "cell").filter("x >= lo AND x < hi").select("slot", "k", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    sums = dealt.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("n")).drop("n")
    within = Window.partitionBy("k", "chunk").orderBy("slot")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(before, ["k", "chunk"])
    return ranked.select("slot", "k", (F.col("rank") + F.col("before")).alias("rank"))


def spans_in_slots(lines: DataFrame, sources: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """slot, k, rank, doc_id, at, size, turn, first, words: what each slot takes of the documents of ``lines``,
    ``words`` words of a document from its ``first`` (from 0) on, for the ``turn``-th time."""
    turns = lines.filter("size > 0").select("k", "at", "doc_id", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: e * F.col("source_size") + F.col("at"))).alias("turn", "from"))
    turns = turns.withColumn("to", F.col("from") + F.col("size"))
    parts = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    begin, end = F.greatest(F.col("from"), F.col("rank") * block), F.least(F.col("to"), (F.col("rank") + 1) * block)
    parts = parts.select("k", "rank", "at", "doc_id", "size", "turn", (begin - F.col("from")).alias("first"), (end - begin).alias("words"))
    return parts.join(schedule(sources, block), ["k", "rank"])


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null if nothing is taken): one row for each document."""
    lines, spans = _mixed(written(sized(docs), "sizes"), weights, most, block)
    taken = spans.groupBy("k", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = lines.withColumn("filled", F.col("size") > 0).join(taken.withColumn("filled", F.lit(True)), ["k", "at", "filled"], "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def _mixed(sizes: DataFrame, weights: tuple[int, ...], most: int, block: int) -> tuple[DataFrame, DataFrame]:
    sources = written(with_targets(sizes, weights, most), "sources")
    lines = written(on_lines(sizes, sources), "lines")
    return lines, spans_in_slots(lines, sources, most, block)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), ""), r"[\x20\x09-\x0D]+\z", "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = BLOCK) -> DataFrame:
    """Rows like those of ``docs``, in the order of the schedule's slots: a document once for each time that the mix
    walks over it, the last time cut after the words that are taken. Rows that are alike
    have places of their own on the line, and each of these gives its copies. n_chars follows the text. Nulls and ties:
    as above; any names may stand beside, and any column be missing but doc_id, text and source.
    """
    id_ = F.xxhash64("doc_id", "source", "text")
    sizes = written(docs.select(id_.alias("doc_id"), "source", F.md5(id_.cast("string")).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_.alias("id"))
    lines, spans = _mixed(sizes, weights, most, block)
    copies = spans.groupBy("k", "at", "turn").agg(F.first("doc_id").alias("id"), F.first("size").alias("size"), F.sum("words").alias("words"), F.min("slot").alias("slot"))
    if sizes.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        whole = whole.dropDuplicates(["id"])
    rows = copies.join(whole, "id").select("row", "slot", "size", "words")
    # Slots are numbered without gaps, so ranges of them need no sample of the rows.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = F.lit(-(-(sizes.agg(F.sum("size")).first()[0] or 0) // block) or 1)
    rows = rows.repartitionById(parts, F.least(F.floor(F.col("slot") * parts / slots), F.lit(parts - 1)).cast("int")).sortWithinPartitions("slot")
    text = F.col("row.text")
    text = F.when(F.col("words") < F.col("size"), _first_words(text, F.col("words"))).otherwise(text)
    changed = {"text": text, "n_chars": F.length(text)}
    types = dict(docs.dtypes)
    return rows.select(*((changed[c].cast(types[c]) if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


ORACLE = rf"""
WITH sizes AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, text, '')) AS key, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM per),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3.0::DOUBLE * source_size AS cap FROM ranked),
filling AS (SELECT *, sum(source_size::DOUBLE) OVER () AS total, sum(weight) OVER () AS weights, sum(cap) OVER o - cap AS caps_before, sum(weight) OVER o - weight AS weights_before
  FROM weighed WINDOW o AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
filled AS (SELECT *, cap / weight <= (total - caps_before) / (weights - weights_before) AS is_full FROM filling),
targets AS (SELECT k, source, source_size, CASE WHEN is_full THEN cap ELSE weight * (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / (weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0)) END AS target FROM filled),
ends AS (SELECT k, CASE WHEN k = max(k) OVER () THEN {_POINTS} ELSE floor(sum(target) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () * {_POINTS} + 0.5)::BIGINT END AS hi FROM targets),
spans AS (SELECT k, coalesce(lag(hi) OVER (ORDER BY k), 0) AS lo, hi FROM ends),
points AS (SELECT i AS slot, (i + 1) % {_POINTS} * {_GOLDEN} % {_POINTS} AS x FROM (SELECT unnest(range((SELECT ((coalesce(sum(source_size), 0) + {BLOCK} - 1) // {BLOCK})::BIGINT FROM targets))) AS i)),
slots AS (SELECT slot, k, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM points JOIN spans ON x >= lo AND x < hi),
stops AS (SELECT k, least(count(slot) * {BLOCK}, 3 * any_value(source_size))::BIGINT AS stop FROM targets LEFT JOIN slots USING (k) GROUP BY k),
lines AS (SELECT doc_id, t.k, size, source_size, target, stop, (sum(size) OVER (PARTITION BY t.k ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS place
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source JOIN stops USING (k))
SELECT doc_id, size, source_size, target, (greatest(0, least(size, stop - place)) + greatest(0, least(size, stop - place - source_size)) + greatest(0, least(size, stop - place - 2 * source_size)))::BIGINT AS taken, CASE WHEN size > 0 AND place < stop THEN slot END AS first_slot
FROM lines LEFT JOIN slots ON slots.k = lines.k AND slots.rank = lines.place // {BLOCK}
"""
