"""The k smallest rows by a key without sorting the table: counts by leading digits narrow the k-th key down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import ranked

#: Hexadecimal digits that a pass counts by: a driver sees at most 16 ** DIGITS counts.
DIGITS = 4


def kth_prefix(keys: DataFrame, k: int, few: int = 4096) -> tuple[str, int, int]:
    """(prefix, rows below it, rows in it): the group of keys (one column, hex strings of one length) that holds the k-th smallest.

    A pass counts the rows of each next DIGITS digits under the prefix found so far; the k-th key is in exactly one of them. It ends when at most
    ``few`` rows share the prefix, or nothing of the key is left.
    """
    (name,) = keys.columns
    prefix, below = "", 0
    while True:
        here = keys.where(F.col(name).startswith(prefix)) if prefix else keys
        counts = here.groupBy(F.substring(name, len(prefix) + 1, DIGITS).alias("d")).agg(F.count("*").alias("n")).collect()
        for d, n in sorted((r.d, r.n) for r in counts):
            if below + n >= k:
                break
            below += n
        prefix += d
        if n <= few or len(d) < DIGITS:
            return prefix, below, n


def smallest(df: DataFrame, k: int, key: Column, then: list[Column], mark: str = "taken", few: int = 4096) -> DataFrame:
    """df plus whether a row is among the k smallest by (key, then), exactly k of them where there are as many.

    key: a hex string, as of a digest. Rows below the prefix of the k-th key are in, those above are out, whatever their number; only the
    rows that share it are ranked. With digests those are at most ``few``, or equal keys, which are ranked by a range sort.
    """
    if k <= 0:
        return df.withColumn(mark, F.lit(False))
    prefix, below, n = kth_prefix(df.select(key.alias("key")), k, few)
    group = F.coalesce(F.substring(key, 1, len(prefix)), F.lit(""))
    if below + n <= k:
        return df.withColumn(mark, group <= prefix)
    sure = df.where(group != prefix).withColumn(mark, group < prefix)
    rest = ranked(df.where(group == prefix), [key, *then], "_place")
    return sure.unionByName(rest.withColumn(mark, F.col("_place") <= k - below).drop("_place"))
