"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a row of slots, each of one block of words. Slot i falls at the golden-ratio point i * STEP + MODULUS / 2 modulo
MODULUS, which the cumulative targets map to a source: that whose interval it hits. The r-th slot of a source takes the
r-th block of that source's shuffled words, pass after pass, as far as two passes go; all blocks have the same number of
words. So the slots alone decide what is taken: a source gets its share of any stretch of the schedule up to a few
blocks, by the discrepancy of the points, and so of its whole. Blocks have few words, at most MOST_BLOCK and fewer in a
small corpus; slots grow with the input. What a document gives is what its words overlap taken blocks.

Only DataFrame functions run here. Prefix sums go over two levels (cells of a source, then rows of a cell), so no
window holds a whole source.

Null text has size 0, and so has a text without words; size 0 takes 0 and has no slot. A null source is a source of its
own, the last. A null doc_id is a document like any other. Rows that are alike each take their share. No documents give
no rows. Further columns, whatever their names, are left out by mix and kept by mixed_documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlens.llm.common import drop_stored, stored, unused, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Words of a block: as many as make SLOTS slots, but MOST_BLOCK at most.
SLOTS = 1 << 21
MOST_BLOCK = 256
#: Points are whole numbers below MODULUS; STEP is the odd number next to MODULUS divided by the golden ratio.
MODULUS = 1 << 31
STEP = 1327217885
#: Buckets that slots and source intervals meet in.
CELLS = 1024
#: Slots that are ranked in one window.
STRETCH = 1 << 14


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, slots: int = SLOTS, most_block: int = MOST_BLOCK) -> DataFrame:
    """One row per source: number, source_size, target, block, slots of the whole mix, low and high of its interval, and digits of its cells.

    The targets solve min(cap, level * weight) with one level for all; that is where resharing the excess ends.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    numbered = totals.withColumn("number", F.row_number().over(order) - 1)
    given = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    limited = numbered.withColumn("weight", given.cast("long")).withColumn("most", cap * F.col("source_size"))
    # windows over the table of sources, which has one row for each
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "number")
    spent = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = limited.withColumn("level", (share * F.sum("source_size").over(everything) - spent) / left)
    target = F.least("most", F.max("level").over(everything) * F.col("weight"))
    words = F.sum("words").over(everything)
    upto = F.sum("words").over(Window.orderBy("number"))
    place = lambda c: F.floor(c / F.greatest(F.lit(1), words) * float(MODULUS)).cast("long")
    return (
        levelled.withColumn("target", target)
        .withColumn("words", F.floor("target").cast("long"))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(most_block), F.ceil(words / slots))).cast("long"))
        .withColumn("slots", F.ceil(words / F.col("block")).cast("long"))
        .withColumn("low", place(upto - F.col("words")))
        .withColumn("high", place(upto))
        .withColumn("digits", F.greatest(F.lit(3), F.least(F.lit(6), F.ceil(F.log(16.0, F.greatest(F.lit(1), F.col("docs")) / 4096.0)))).cast("int"))
        .select("source", "number", "source_size", "target", "block", "slots", "low", "high", "digits")
    )


def running_before(df: DataFrame, group: str, cell: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of value over the rows of the group that come before, cells in order, then rows in order.

    The upper level sums whole cells, of which there is a fixed number; the lower one sorts a single cell.
    """
    sums = df.groupBy(group, cell).agg(F.sum(value).alias("_cell"))
    above = Window.partitionBy(group).orderBy(cell)
    starts = sums.select(group, cell, (F.sum("_cell").over(above) - F.col("_cell")).alias("_above"))
    inside = Window.partitionBy(group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_inside", F.sum(value).over(inside) - value).join(starts, [group, cell]).withColumn(name, F.col("_above") + F.col("_inside")).drop("_above", "_inside")


def schedule(targets: DataFrame) -> DataFrame:
    """slot, number (of the source it hits) and rank: which block of that source it takes."""
    spark = targets.sparkSession
    found = targets.agg(F.max("slots")).first()[0] or 0
    width = MODULUS // CELLS
    cells = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    intervals = targets.filter("low < high").select("number", "low", "high", F.explode(cells).alias("cell"))
    point = (F.col("id") % MODULUS * STEP + MODULUS // 2) % MODULUS
    points = spark.range(found).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / width))
    hit = points.join(intervals, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    taken = hit.select("slot", "number", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    return running_before(taken, "number", "stretch", [F.col("slot")], F.lit(1), "rank").select("slot", "number", "rank")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """What documents of a source are put in order by."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def _taken(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, **options: int) -> DataFrame:
    """doc_id, key, source, size, source_size, target, taken and slot of each row of docs; stored."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share, cap, **options), "mix-targets")
    rows = sizes.withColumnRenamed("source", "_s").join(targets.drop("slots", "low", "high"), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    rows = rows.withColumn("cell", F.substr("key", F.lit(1), F.col("digits")))
    placed = stored(running_before(rows, "number", "cell", [F.col("key"), F.col("size")], F.col("size"), "start").drop("cell", "digits"), "mix-placed")
    passes = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)))
    spans = placed.filter("size > 0").withColumn("pass", passes).withColumn("low", F.col("start") + F.col("pass") * F.col("source_size"))
    spans = spans.withColumn("high", F.least(F.col("low") + F.col("size"), F.floor(cap * F.col("source_size")).cast("long"))).filter("low < high")
    reach = F.sequence(F.floor(F.col("low") / F.col("block")), F.floor((F.col("high") - 1) / F.col("block")))
    parts = spans.select("number", "start", "size", "block", "low", "high", F.explode(reach).alias("rank"))
    overlap = F.least(F.col("high"), (F.col("rank") + 1) * F.col("block")) - F.greatest(F.col("low"), F.col("rank") * F.col("block"))
    given = parts.join(schedule(targets), ["number", "rank"]).groupBy("number", "start", "size").agg(F.sum(overlap).alias("taken"), F.min("slot").alias("slot"))
    columns = ["doc_id", "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot"]
    found = stored(placed.join(given, ["number", "start", "size"], "left").select(*columns), "mix-taken")
    drop_stored(sizes, targets, placed)
    return found


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, **options: int) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the first slot that takes words of it, for each row of docs."""
    return _taken(docs, weights, share, cap, **options).drop("key")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, **options: int) -> DataFrame:
    """The rows of docs as the mix holds them: each as often as its words are taken, to the nearest whole number.

    Rows of the same doc_id and text share what they take evenly.
    """
    given = _taken(docs, weights, share, cap, **options).filter("size > 0").groupBy("key").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("times")).filter("times > 0")
    key, times, copy = unused(docs, "key", "times", "copy")
    keyed = docs.withColumn(key, shuffle_key(F.col("doc_id"), F.col("text")))
    both = keyed.join(given.toDF(key, times), key)
    return both.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)


MIX_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM totals
), limited AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS most FROM numbered
), levelled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM limited
), aimed AS (
  SELECT *, least(most, max(level) OVER () * weight) AS target, floor(least(most, max(level) OVER () * weight))::BIGINT AS words FROM levelled
), summed AS (
  SELECT *, (sum(words) OVER ())::BIGINT AS every, (sum(words) OVER (ORDER BY number))::BIGINT AS upto FROM aimed
), targets AS (
  SELECT *, greatest(1, least({MOST_BLOCK}, ceil(every::DOUBLE / {SLOTS})))::BIGINT AS block,
    floor((upto - words)::DOUBLE / greatest(1, every) * {MODULUS}.0::DOUBLE)::BIGINT AS low, floor(upto::DOUBLE / greatest(1, every) * {MODULUS}.0::DOUBLE)::BIGINT AS high
  FROM summed
), slots AS (
  SELECT unnest(range(ceil(max(every)::DOUBLE / max(block))::BIGINT)) AS slot FROM targets
), points AS (
  SELECT slot, (slot % {MODULUS} * {STEP} + {MODULUS // 2}) % {MODULUS} AS point FROM slots
), schedule AS (
  SELECT slot, number, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank
  FROM points JOIN targets ON point >= low AND point < high
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.number, t.block,
    row_number() OVER () AS id, (sum(s.size) OVER (PARTITION BY t.number ORDER BY s.key, s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), spans AS (
  SELECT id, number, block, start + pass * source_size AS low, start + pass * source_size + size AS high
  FROM placed, (VALUES (0), (1)) AS p(pass) WHERE size > 0
), parts AS (
  SELECT *, unnest(range(low // block, (high - 1) // block + 1)) AS rank FROM spans
), given AS (
  SELECT id, sum(least(high, (rank + 1) * block) - greatest(low, rank * block))::BIGINT AS taken, min(slot) AS slot
  FROM parts JOIN schedule USING (number, rank) GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, slot FROM placed LEFT JOIN given USING (id)
"""
