"""Discovery as a stream into tables that a replayed batch does not change.

A batch of a stream may be given again after a failure, with the same id and the same rows. What it writes stands in a
folder of its own id, is replaced as a whole, and is computed against the folders of smaller ids only: the second time
gives the first time's rows. Updates set values that do not depend on the old ones, in buckets by key, of which only those that
a batch touches are rewritten. Counters only grow: every batch leaves its own, and the largest counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import sanitise
from ..storage import written

#: Buckets of a table whose rows are updated.
BUCKETS = 64


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where its folder is missing or holds no file yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def insert_new(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: list[str], known: DataFrame | None = None) -> None:
    """The rows of a batch whose keys are neither known nor in an earlier batch, the first of each by ``order``, into the batch's own folder.

    A null key is none. known: a static table of keys, as of an earlier session.
    """
    spark = batch.sparkSession
    fresh = batch.dropna(subset=keys).groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
    if known is not None:
        fresh = fresh.join(known.select(*keys).distinct(), keys, "left_anti")
    before = table_or_none(spark, path)
    if before is not None:
        fresh = fresh.join(before.where(F.col("batch_id") < batch_id).select(*keys), keys, "left_anti")
    # the folder read is also written: what is written is complete before the first of it is replaced
    fresh = written(fresh, "fresh").withColumn("batch_id", F.lit(batch_id).cast("long"))
    if fresh.isEmpty() and before is not None:
        fresh = before.where(F.col("batch_id") == batch_id).limit(0)
    _replace(fresh, path, ["batch_id"])


def update_rows(changes: DataFrame, path: str, keys: list[str]) -> None:
    """Set the columns of ``changes`` in the rows of a bucketed table with the same keys; only buckets with such rows are rewritten.

    Changes to keys that the table lacks are left out. Of several changes to a key the largest counts, so that the order of rows does not.
    """
    spark, values = changes.sparkSession, [c for c in changes.columns if c not in keys]
    new = changes.groupBy(*keys).agg(F.max(F.struct(*values)).alias("new")).withColumn("bucket", bucket_of(keys))
    new = written(new, "changes")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    held = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    joined = held.join(new, [*keys, "bucket"], "left")
    out = joined.select(*[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in held.columns])
    _replace(written(out, "updated"), path, ["bucket"])


def bucket_of(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def bucketed(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write df as a table that ``update_rows`` can change."""
    df.withColumn("bucket", bucket_of(keys)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def leave_counters(spark: SparkSession, batch_id: int, path: str, session_id: str, counts: dict[str, int]) -> None:
    row = spark.createDataFrame([(session_id, *map(int, counts.values()))], "session_id string, " + ", ".join(f"{c} long" for c in counts))
    _replace(row.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"])


def merged_counters(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, the largest of each counter that any batch has left)."""
    left = spark.read.parquet(path)
    return left.groupBy("session_id").agg(*[F.max(c).alias(c) for c in left.columns if c not in ("session_id", "batch_id")])


def discover_batch(root: str, session_id: str, known: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """What a batch of (ord, url) does: addresses in canonical form, new ones into ``discovered``, their number into ``checkpoints``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        clean = batch.select("ord", sanitise(F.col("url")).alias("url"))
        insert_new(clean, batch_id, f"{root}/discovered", ["url"], ["ord"], known)
        held = table_or_none(batch.sparkSession, f"{root}/discovered")
        n = 0 if held is None else held.where(F.col("batch_id") <= batch_id).count()
        leave_counters(batch.sparkSession, batch_id, f"{root}/checkpoints", session_id, {"discovered": n})

    return run


def discover_stream(stream: DataFrame, root: str, session_id: str, known: DataFrame | None = None):
    """A query that reads what is there of a stream of (ord, url), skips known addresses and ends."""
    return stream.writeStream.foreachBatch(discover_batch(root, session_id, known)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
