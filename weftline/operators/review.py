"""The optional review of samples by a rater: batches of five, a running cost cap, clamped scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generated import REVIEW_PROMPT, clamp_score, normalised_score, parse_scores, review_example
from ..storage import written
from .relational import histogram, ranked, sum_before


def batches(samples: DataFrame, size: int = 5, limit: int | None = None) -> DataFrame:
    """samples plus batch and pos (from 0) in id order; only the first ``limit`` samples when given."""
    out = ranked(samples, [F.col("id")], "_rank").withColumns({"batch": F.floor((F.col("_rank") - 1) / size), "pos": ((F.col("_rank") - 1) % size).cast("int")})
    return (out.where(F.col("_rank") <= limit) if limit else out).drop("_rank")


def batch_prompts(samples: DataFrame) -> DataFrame:
    """(batch, n, prompt): what a rater is asked of each batch of (id, messages, batch, pos)."""
    one = F.struct("pos", review_example(F.col("messages"), F.col("pos") + 1).alias("text"))
    g = samples.groupBy("batch").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(one)).alias("x"))
    text = F.array_join(F.transform("x", lambda e: e["text"]), "")
    return g.select("batch", "n", F.concat(F.lit("Rate these "), F.col("n").cast("string"), F.lit(" examples:\n"), text).alias("prompt"))


def affordable(costs: DataFrame, cap: float) -> DataFrame:
    """Batches (batch, cost) that start while the cost so far is below the cap."""
    return sum_before(costs, [F.col("batch")], "cost", "spent").where(F.col("spent") < cap)


def apply_scores(samples: DataFrame, responses: DataFrame, min_score: int = 3) -> DataFrame:
    """samples (id, batch, pos, ...) with score, quality_score and approved from responses (batch, raw)."""
    sized = samples.groupBy("batch").agg(F.count("*").cast("int").alias("n"))
    scores = responses.join(sized, "batch").select("batch", F.posexplode(parse_scores(F.col("raw"), F.col("n"))).alias("pos", "score"))
    out = samples.join(scores, ["batch", "pos"], "left").withColumn("score", clamp_score(F.coalesce("score", F.lit(3))))
    return out.withColumns({"quality_score": normalised_score(F.col("score")), "approved": F.col("score") >= min_score})


def ask_in_waves(prompts: DataFrame, rater, cap: float, wave: int) -> DataFrame:
    """(batch, raw, cost) of the batches that start while what the batches before them cost is below the cap, as if asked one by one.

    prompts: (batch, prompt), batches numbered from 0. ``wave`` batches are asked at once, each in a task of its own; their costs, a number a batch
    of the wave, are then added in order. What was asked beyond the batch that reached the cap is dropped: fewer than ``wave`` calls are spent
    in vain. A rater that fails in any way leaves its batch an empty answer without a cost.
    """

    def ask(frames):
        for pdf in frames:
            said = []
            for prompt in pdf["prompt"]:
                try:
                    said.append(rater(REVIEW_PROMPT, prompt))
                except Exception:  # noqa: BLE001  a rater may fail in any way; its batch gets the default score
                    said.append(("", 0.0))
            yield pdf.assign(raw=[raw for raw, _ in said], cost=[float(cost) for _, cost in said])[["batch", "raw", "cost"]]

    schema = "batch long, raw string, cost double"
    asked, spent, first, n = prompts.sparkSession.createDataFrame([], schema), 0.0, 0, prompts.count()
    while first < n and spent < cap:
        part = prompts.where(F.col("batch").between(first, first + wave - 1)).repartition(min(wave, n - first))
        part = written(part.mapInPandas(ask, schema), "reviews")
        end = first
        for row in sorted(part.select("batch", "cost").collect()):
            if spent >= cap:
                break
            spent, end = spent + row.cost, row.batch + 1
        asked = asked.unionByName(part.where(F.col("batch") < end))
        first += wave
    return asked


def review(samples: DataFrame, rater, cap: float = 1.0, min_score: int = 3, size: int = 5, limit: int | None = None, wave: int = 64) -> DataFrame:
    """samples (id, messages, ...) plus reviewed, score, quality_score, approved and cost (of the sample's batch).

    rater: (system, user) in, (raw scores, dollars) out. A batch is asked while what the batches before it cost is below the cap
    (``ask_in_waves``); a rater that fails gives the default score. Samples beyond the cap or the limit keep the scores they had.
    """
    taken = written(batches(samples.select("id", "messages"), size, limit), "review-batches")
    asked = ask_in_waves(written(batch_prompts(taken).select("batch", "prompt"), "prompts"), rater, cap, wave)
    scored = apply_scores(taken.join(asked.select("batch"), "batch", "left_semi").select("id", "batch", "pos"), asked.select("batch", "raw"), min_score)
    scored = scored.join(asked.select("batch", "cost"), "batch").select("id", "score", "quality_score", "approved", "cost")
    out = samples.drop(*[c for c in ("score", "cost") if c in samples.columns])
    old = {c: F.col(c) if c in out.columns else F.lit(None) for c in ("quality_score", "approved")}
    joined = out.select([c for c in out.columns if c not in old] + [x.alias(f"old_{c}") for c, x in old.items()]).join(scored, "id", "left")
    return joined.withColumns({"reviewed": F.col("score").isNotNull(), **{c: F.coalesce(c, f"old_{c}") for c in old}}).drop("old_quality_score", "old_approved")


def score_report(reviewed: DataFrame) -> DataFrame:
    """(score, n, mean) for each score from 1 to 5, zeros too; mean: the scores' mean, 0 without any."""
    mean = reviewed.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"))
    counts = histogram(reviewed.where("score IS NOT NULL"), F.col("score").cast("string"), [str(i) for i in range(1, 6)])
    return counts.select(F.col("label").cast("int").alias("score"), "n").crossJoin(F.broadcast(mean))


def estimate(n_samples: int, size: int = 5) -> tuple[int, int, float]:
    """(calls, tokens, dollars) at 600 tokens a batch and $2 a million."""
    calls = -(-n_samples // size)
    return calls, calls * 600, calls * 600 / 1_000_000 * 2.0
