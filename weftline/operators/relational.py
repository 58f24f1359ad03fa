"""Relational helpers of the curation plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order; Spark keeps one row a key and task before it shuffles (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def exclude_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known; repeated rows stay repeated."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def mark(df: DataFrame, chosen: DataFrame, key: str, name: str = "selected") -> DataFrame:
    """df plus whether its key is among the chosen."""
    flag = chosen.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(flag, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def lookup(df: DataFrame, right: DataFrame, keys: list[str], columns: dict[str, object], order: list) -> DataFrame:
    """df with columns of the first matching row of right, and defaults where there is none."""
    first = keep_first(right, keys, order).select(*keys, *columns)
    out = df.join(first, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(default)) for c, default in columns.items()})


def priority_union(frames: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """Concatenation in which the first frame that has a key wins."""
    tagged = [f.withColumn("_prio", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    return keep_first(out, keys, ["_prio", *order]).drop("_prio")


def first_nonempty(frames: list[DataFrame], group: str, order: str = "prio") -> DataFrame:
    """Per group only the rows of the first frame that has any (a fallback chain)."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn(order, F.lit(i))
        out = f if out is None else out.unionByName(f)
    best = out.groupBy(group).agg(F.min(order).alias("_best"))
    return out.join(best, group).where(F.col(order) == F.col("_best")).drop("_best")


def histogram(df: DataFrame, bucket: Column, labels: list[str]) -> DataFrame:
    """(label, n) for every label, zeros too."""
    spark = df.sparkSession
    counts = df.select(bucket.alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, ord int")
    return F.broadcast(every).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ranked(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """df with its 1-based place in a total order, without gathering all rows in one task.

    Rows are range-sorted into the session's number of shuffle partitions; each partition counts its own rows; the counts' running sum (one row a
    partition) is added to the place within the partition.
    """
    from ..storage import written

    cols = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(cols, order, strict=True)))
    placed = keyed.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id())
    placed = written(placed.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m", *cols), "ranked")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before, "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_n", "_before")


def sum_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows in front of each in a total order, 0 in front of the first.

    In two levels, as ``ranked``: sums inside the partitions of a range sort, and of the partitions before.
    """
    from ..storage import written

    kind = df.schema[value].dataType
    cols = [f"_o{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(cols, order, strict=True))).repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_p", F.shiftright("_m", 33)).drop(*cols), "summed")
    ahead = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_p").agg(F.sum(value).alias(value)).withColumn("_start", ahead(Window.orderBy("_p"))).drop(value)
    inside = placed.withColumn("_inside", ahead(Window.partitionBy("_p").orderBy("_m")))
    return inside.join(starts, "_p").withColumn(name, (F.col("_start") + F.col("_inside")).cast(kind)).drop("_m", "_p", "_start", "_inside")


def exact_split(df: DataFrame, key: str, ratio: float = 0.1, seed: int = 42, min_rows: int = 10) -> DataFrame:
    """df plus split: the ceil(ratio * n) rows smallest by a seeded hash are validation, none up to min_rows rows.

    The hash of the last of them is found by counts; the table is neither sorted nor written.
    """
    from .selecting import smallest

    n = df.count()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    take = -(-n * int(round(ratio * 1_000_000)) // 1_000_000) if n > min_rows and ratio > 0 else 0
    return smallest(df, take, order, [F.col(key)], "_in").withColumn("split", F.when(F.col("_in"), "validation").otherwise("train")).drop("_in")
