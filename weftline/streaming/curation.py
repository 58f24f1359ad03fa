"""Structured Streaming forms of the curation steps: the same column functions over readStream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.chunks import chunks_fast


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_arrivals(stream: DataFrame, keys: list[str], event_time: str | None = None, within: str = "1 day") -> DataFrame:
    """Keep the first arrival of each key; with an event time, state older than ``within`` is dropped."""
    if event_time:
        return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def fingerprinted(stream: DataFrame, column: str = "text") -> DataFrame:
    return stream.withColumn("fp", F.md5(F.substring(column, 1, 200).cast("binary")))


def chunked(stream: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Stateless: clean, then one row a chunk of (doc_id, text)."""
    content = text.clean(F.coalesce("text", F.lit("")))
    return stream.select("doc_id", F.posexplode(chunks_fast(content, size, overlap)).alias("chunk_index", "content"))


def counters(stream: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Running maxima a key, for update mode."""
    return stream.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


def usage(stream: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and type, with late rows accepted up to ``late``."""
    w = F.window(ts, width)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def paced(stream: DataFrame, rate: float = 2.0, burst: float | None = None) -> DataFrame:
    """(host, ts, delay) of requests (host, ts): the seconds until a token of the host's bucket is there, kept as state across batches."""
    room = burst or 2 * rate

    def spend(key, frames, state):
        tokens, then = state.get if state.exists else (room, None)
        asked = pd.concat(list(frames)).sort_values("ts", kind="stable")
        now = asked["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        delay = []
        for t in now.tolist():
            tokens = min(room, tokens + max(0.0, t - (t if then is None else then)) * rate) - 1
            then = t if then is None else max(then, t)
            delay.append(max(0.0, -tokens / rate))
        state.update((tokens, then))
        yield pd.DataFrame({"host": key[0], "ts": asked["ts"].to_numpy(), "delay": delay})

    return stream.select("host", "ts").groupBy("host").applyInPandasWithState(spend, "host string, ts timestamp, delay double", "tokens double, at double", "append", "NoTimeout")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """An exactly-once Parquet sink that ends when the input at hand is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
