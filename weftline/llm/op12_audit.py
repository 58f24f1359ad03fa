"""Filter interaction audit: what each filter removes, alone and after the others, in every order, from 2^k signed sums.

Each document fails a set of the k filters, a mask. For every part, and there for all, the good and the toxic documents,
2^k parity sums S[u] = sum over documents of (-1)^|u & mask| are added up: mergeable, of one size whatever the number of
documents. The inverse Walsh-Hadamard transform, cell[m] = 2^-k * sum over u of (-1)^|u & m| S[u], gives the
number of documents of each mask exactly. Orders are read from the cells: a filter's step removes the cells that hold its bit and no
bit of the filters before it. Over all k! orders a document is removed by a given one of the f filters it fails in k! / f of them,
which is the closed form of the Shapley column.

The last filter, copies, asks for a smaller doc_id with the same text anywhere in the table. Rows are counted by id and
digest first, then by digest, part and labels, and only a group's smallest id and its rows are compared, so no group of copies meets in one task.

Defined results: null text reads as empty, a null source as ''. A null doc_id is not smaller or larger than any and has no labels. Rows that
repeat a doc_id are documents of their own; those of one text and the smallest id all pass. A doc_id of several rows of labels is good
(toxic) if any of them says so. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x20\x09-\x0D]+"


def web_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of filters A to D on a text that isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(doc_id, part, digest, mask) of docs with text, source; bit i is set if the i-th condition, on a column ``text``, fails."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bits = [F.when(failing, 1 << i).otherwise(0) for i, failing in enumerate(filters.values())]
    mask = sum(bits, F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.cast("int").alias("mask"))


def counted(rows: DataFrame, labels: DataFrame, copies: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents by mask, with bit ``copies`` where a smaller doc_id has the same digest."""
    once = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # ids that are null would all meet in one task of the join
    once = once.withColumn("salt", F.expr("IF(doc_id IS NULL, xxhash64(digest), 0L)"))
    once = once.join(known.withColumn("salt", F.expr("cast(doc_id % 1 AS bigint)")), ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"])
    group = once.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.expr("IF(doc_id IS NULL, n, 0L)")).alias("n_null"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
    )
    group = group.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    late = F.expr("n - n_null - IF(least = first, n_least, 0L)")
    both = group.withColumn("late", F.coalesce(late, F.lit(0))).selectExpr("part", "good", "toxic", f"inline(array(struct(mask | {copies} AS mask, late AS n), struct(mask, n - late AS n)))")
    return both.where("n > 0")


def parity_sums(cells: DataFrame, k: int, measures: dict[str, str]) -> DataFrame:
    """(part, an array of 2^k signed sums a measure): sum of the measure times (-1)^|u & mask| for each u."""
    sums = {name: F.array(*[F.sum(F.expr(f"IF(bit_count(mask & {u}) % 2 = 0, {value}, -({value}))")) for u in range(1 << k)]) for name, value in measures.items()}
    return cells.groupBy("part").agg(*[c.alias(name) for name, c in sums.items()])


def inverted(sums: str, k: int) -> Column:
    """The cells of an array of parity sums."""
    every = f"sequence(0, {(1 << k) - 1})"
    return F.expr(f"transform({every}, m -> aggregate({every}, 0L, (t, u) -> t + IF(bit_count(m & u) % 2 = 0, 1L, -1L) * {sums}[u]) div {1 << k})")


def orders(cells: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, ...): cells has arrays n, good, toxic, indexed by mask."""
    k = len(names)
    every = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    bit = f"shiftleft(1, instr('{names}', substr(filter_order, i, 1)) - 1)"
    # own and before are made in front of the explode, so that the sums over cells read them as columns
    prefix = f"transform(sequence(1, {k}), step -> aggregate(sequence(1, step), struct(step, 0 AS own, 0 AS before), (b, i) -> struct(b.step, {bit} AS own, b.own | b.before AS before)))"
    steps = cells.withColumn("filter_order", F.explode(every)).selectExpr("*", f"inline({prefix})")

    def total(which: str, array: str = "n", weight: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {(1 << k) - 1}), 0L, (t, m) -> IF({which}, t + {array}[m] * {weight}, t))")

    here = "m & own <> 0 AND m & before = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("m & (own | before) = 0").alias("kept"),
        total(here).alias("removed"),
        total("m & own <> 0 AND m & before <> 0").alias("redundant"),
        total("m = own").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total("m & own <> 0", "n", f"({factorial(k)} div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """One row a part, order of the filters and step, as the module says. ``filters``: one-letter names and failure conditions on ``text``
    (at most seven: orders grow as k!); ``copies`` names the last filter."""
    filters = web_filters(F.col("text")) if filters is None else filters
    names = "".join(filters) + copies
    k = len(names)
    cells = counted(masks(docs, filters), labels, 1 << (k - 1))
    sums = parity_sums(cells, k, {"sn": "n", "sg": "n * good", "st": "n * toxic"})
    return orders(sums.select("part", inverted("sn", k).alias("n"), inverted("sg", k).alias("good"), inverted("st", k).alias("toxic")), names)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), lo AS (
  SELECT t, min(doc_id) AS lo FROM d GROUP BY t
), lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT w.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
    len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 2 * length(w.t) AS c,
    regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(lo.lo < w.doc_id, false) AS e
  FROM w JOIN lo ON w.t = lo.t LEFT JOIN lab ON w.doc_id = lab.doc_id
), cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), p AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, list_transform(string_split(filter_order, ''), lambda y: ascii(y) - 64) AS o FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), x AS (
  SELECT part, filter_order, step, n, good, toxic, fails[o[step]] AS own, list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])) AS before,
    len(list_filter(fails, lambda z: z)) AS many FROM cells, s
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (NOT own AND NOT coalesce(before, false)), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (own AND NOT coalesce(before, false)), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (own AND before), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (own AND many = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (own AND NOT coalesce(before, false)), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (own AND NOT coalesce(before, false)), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(CASE WHEN own THEN n * (120 // many) END), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
"""
