"""The quality pass: score, fingerprint, keep-first dedup, threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import fingerprint, sample_score
from .relational import histogram

# The buckets of the score report.
BUCKETS = ["Poor (<0.3)", "Fair (0.3–0.5)", "Good (0.5–0.8)", "Excellent (≥0.8)"]


def conversations(turns: DataFrame) -> DataFrame:
    """(id, messages) of (conv_id, turn, role, text)."""
    one = F.struct("turn", F.col("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = turns.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("m"))
    return grouped.select("id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def quality_pass(samples: DataFrame, threshold: float = 0.5, min_question: int = 5, min_answer: int = 10) -> DataFrame:
    """samples (id, messages) plus score, fp, is_dup, approved; every later sample of a fingerprint scores 0.

    First ids are aggregated by fingerprint before any shuffle, and only those of repeated fingerprints are joined back: a fingerprint of many
    samples is one row there, and a join that Spark can split.
    """
    scored = samples.withColumns({"raw": sample_score(F.col("messages"), min_question, min_answer), "fp": fingerprint(F.col("messages"))})
    first = scored.groupBy(F.col("fp").alias("_fp")).agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = scored.join(first, F.col("fp").eqNullSafe(F.col("_fp")), "left")
    out = out.withColumn("is_dup", F.coalesce(F.col("id") != F.col("_first"), F.lit(False)))
    out = out.withColumn("score", F.round(F.when(F.col("is_dup"), 0.0).otherwise(F.col("raw")), 6))
    return out.withColumn("approved", F.col("score") >= threshold).drop("raw", "_fp", "_first")


def bucket(score: Column) -> Column:
    return F.when(score < 0.3, BUCKETS[0]).when(score < 0.5, BUCKETS[1]).when(score < 0.8, BUCKETS[2]).otherwise(BUCKETS[3])


def score_histogram(scored: DataFrame) -> DataFrame:
    return histogram(scored, bucket(F.col("score")), BUCKETS)


def approval(scored: DataFrame) -> DataFrame:
    """(samples, approved, rejected, rate)."""
    n, ok = F.count("*"), F.count_if("approved")
    return scored.agg(n.alias("samples"), ok.alias("approved"), (n - ok).alias("rejected"), F.round(ok / F.greatest(n, F.lit(1)) * 100, 6).alias("rate"))
