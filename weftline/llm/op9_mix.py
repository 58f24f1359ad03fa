"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words;
no target exceeds ``most`` times its source's size and what is cut off is shared anew by weight, which is
target = min(most * size, level * weight) for the one level at which targets add up (found in one pass over
the sources by the ratio size / weight, with no iteration).

Passes: a source repeats its documents in one shuffled order (md5 of the id) until its target is met: as many
whole passes as fit, then the documents that begin before the rest of the target. A document is thus
taken at most ceil(most) times and whole.

Curriculum: over training time t in [0, 1] a source's weight is target * (1 + slope * (1 - 2t)), slopes going
from +LEAN (first source, early) to -LEAN (last, late). The integral is target * ((1 + slope) t - slope t^2),
its cumulative token demand; the word in the middle of each taken copy of a document is demanded at the time where
the inverse of that integral stands, its position. ``mixed`` range-sorts the copies by position.

The running word count of a source is taken in two levels (ranges of the shuffled order, then inside a
range), so a source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unused

WEIGHTS, SHARE, MOST, LEAN, RANGES = (5, 2, 1), 1.5, 2.0, 0.5, 4096


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space: the places where one starts. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target, slope) of (source, source_size); one row a source, however many."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("n", F.row_number().over(by_name) - 1)
    pick = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.pmod("n", F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(most))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), "n")
    every = Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest_w", F.sum("w").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(share)).withColumn("m", F.count("*").over(every))
    s = s.withColumn("at", (F.col("total") - F.col("full")) / F.col("rest_w"))
    s = s.withColumn("level", F.max(F.when(F.col("at") * F.col("w") <= F.col("cap"), F.col("at"))).over(every))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    slope = F.when(F.col("m") > 1, F.lit(LEAN) * (1 - 2 * F.col("n") / (F.col("m") - 1))).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "n", target.alias("target"), slope.alias("slope"))


def mix(docs: DataFrame, size: Column, **how) -> DataFrame:
    """docs plus size, source_size, target, slope, before, copies (times taken) and taken.

    before: words of the source ahead of the document in its shuffled order. Documents without words are
    taken as the pass meets them and count 0. Rows with one id have an order among them by their size; equal
    rows are interchangeable. A null source is a source; an empty table gives no rows.
    """
    d = docs.withColumn("size", size).withColumn("order_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("rng", F.conv(F.substring("order_key", 1, 3), 16, 10).cast("int"))
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]
    d = d.withColumns({"no_source": key[0], "source_key": key[1]})
    by_range = d.groupBy("no_source", "source_key", "rng").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("no_source", "source_key").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("range_start", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    sources = by_range.groupBy("no_source", "source_key").agg(F.sum("range_size").alias("source_size"))
    named = sources.withColumn("source", F.when(~F.col("no_source"), F.col("source_key")))
    goal = targets(named.select("source", "source_size"), **how).select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), "source_size", "n", "target", "slope")
    ranges = starts.join(goal, ["no_source", "source_key"]).select("no_source", "source_key", "rng", "range_start", "source_size", "n", "target", "slope")
    inside = Window.partitionBy("no_source", "source_key", "rng").orderBy("order_key", "doc_id", "size")
    d = d.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    d = d.join(ranges, ["no_source", "source_key", "rng"])
    d = d.withColumn("before", F.col("range_start") + F.col("inside"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    rest = F.col("target") - passes * F.col("source_size")
    copies = passes + F.when(F.col("before") + F.col("size") / 2 < rest, 1).otherwise(0)
    return d.withColumn("copies", copies.cast("long")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("inside", "range_start", "rng", "order_key", "no_source", "source_key")


def position(words: Column, target: Column, slope: Column) -> Column:
    """The training time at which a source's cumulative demand reaches so many words: the inverse of the integral."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), words / target))
    disc = F.sqrt((1 + slope) * (1 + slope) - 4 * slope * x)
    return F.when(target <= 0, F.lit(0.0)).when(F.abs(slope) < 1e-9, x).otherwise(2 * x / (1 + slope + disc))


def placed(d: DataFrame) -> DataFrame:
    """One row a taken copy with its training position."""
    d = d.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    words = F.col("copy") * F.col("source_size") + F.col("before") + F.col("size") / 2
    return d.withColumn("position", position(words, F.col("target"), F.col("slope")))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The training stream: docs' columns, whatever their names, a row every taken copy, range-sorted by position (then id and copy).

    The session's number of shuffle partitions is that of the ranges.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    p = placed(mix(rows, F.col("size"), **how))
    p = p.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")
    return p.select("row.*", F.col("position").alias(unused("position", docs.columns)), F.col("copy").alias(unused("copy", docs.columns)))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    d = mix(docs, F.col("size"))
    first = F.when(F.col("copies") > 0, position(F.col("before") + F.col("size") / 2, F.col("target"), F.col("slope")))
    d = d.withColumn("position", first).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))
    return d.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CASE WHEN text IS NULL THEN 0 ELSE CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) END AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS n, count(*) OVER () AS m, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), w AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM n
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w
), g AS (
  SELECT *, least(cap, coalesce(max(CASE WHEN lvl * w <= cap THEN lvl END) OVER () * w, cap)) AS target,
    CASE WHEN m > 1 THEN 0.5::DOUBLE * (1 - 2 * n::DOUBLE / (m - 1)) ELSE 0 END AS slope FROM l
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.slope,
    CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 1 END AS passes,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, passes + CASE WHEN before + size / 2 < target - passes * source_size THEN 1 ELSE 0 END AS copies FROM p
), x AS (
  SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (before + size / 2) / target)) AS x FROM c
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN target <= 0 THEN 0 WHEN abs(slope) < 1e-9 THEN x
    ELSE 2 * x / (1 + slope + sqrt((1 + slope) * (1 + slope) - 4 * slope * x)) END, 9) END AS position
FROM x
"""
