"""Session tables and files as sources: scans, point lookups, id prefixes, raw pages, JSON datasets, fetches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import origin
from ..schemas import schema
from .throttle import throttled


def session_table(spark: SparkSession, root: str, name: str, session_id: str | None = None) -> DataFrame:
    """A stage's table; the filter on session_id prunes partitions."""
    df = spark.read.schema(schema(name)).parquet(f"{root}/{name}")
    return df if session_id is None else df.where(F.col("session_id") == session_id)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def by_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The row with this id, or the only one that starts with it; none or several raise."""
    found = df.where(F.col(key).startswith(prefix)).withColumn("_exact", F.col(key) == prefix)
    keys = [(r[0], r[1]) for r in found.select(key, "_exact").distinct().limit(3).collect()]
    exact = found.where("_exact")
    if any(e for _, e in keys) or (len(keys) > 2 and not exact.isEmpty()):
        return exact.drop("_exact")
    if len(keys) != 1:
        raise LookupError(f"{prefix!r} matches {'no id' if not keys else 'several ids'}")
    return found.drop("_exact")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of saved page files, and page_id where folders or write_raw_pages name it; missing files are simply absent."""
    named = lambda names: spark.read.option("pathGlobFilter", names)
    packed = bool(named("*.parquet").text(path).inputFiles())
    single = spark.read if not packed else named("*.{txt,md}")
    if packed and not single.text(path).inputFiles():
        return named("*.parquet").parquet(path).select("page_id", F.input_file_name().alias("path"), "markdown")
    found = single.text(path, wholetext=True)
    ids = [c for c in found.columns if c == "page_id"]
    found = found.select(*ids, F.input_file_name().alias("path"), F.regexp_replace("value", r"\n\z", "").alias("markdown"))
    return found.unionByName(named("*.parquet").parquet(path).select("page_id", F.input_file_name().alias("path"), "markdown"), allowMissingColumns=True) if packed else found


def json_dataset(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def backoff(attempt: int, wait: float, longest: float) -> float:
    """Seconds before the attempt of this number (from 1)."""
    return min(longest, wait * 2 ** (attempt - 1))


#: url in; (status, content type, body) out.
Fetcher = Callable[[str], tuple[int, str, str]]


def fetch(urls: DataFrame, fetcher: Fetcher, attempts: int = 3, wait: float = 2.0, longest: float = 30.0) -> DataFrame:
    """urls (url) plus status, content_type, body and error; transport errors are tried again, none fails the job.

    Between attempts it waits ``wait`` seconds, twice as long each time, ``longest`` at most.
    """

    def run(frames: Iterable[pd.DataFrame]):
        for pdf in frames:
            rows = []
            for url in pdf["url"]:
                row = (url, None, None, None, "no attempt")
                for attempt in range(attempts):
                    if attempt:
                        time.sleep(backoff(attempt, wait, longest))
                    try:
                        row = (url, *fetcher(url), None)
                        break
                    except OSError as e:
                        row = (url, None, None, None, f"{type(e).__name__}: {e}")
                    except Exception as e:  # noqa: BLE001  reported in the row, not tried again
                        row = (url, None, None, None, f"{type(e).__name__}: {e}")
                        break
                rows.append(row)
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "error"]).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, "url string, status int, content_type string, body string, error string")


def scan(urls: DataFrame, fetcher: Fetcher, rate: float | None = None, **how) -> DataFrame:
    """urls (url, ...), static or a stream, fetched a host at a time: one task has all of a host's addresses of a run or batch, so that
    ``rate`` requests a second a host hold for the whole cluster. As a stream it goes on where its checkpoint ends; a batch that
    fails is fetched again as a whole.
    """
    by_host = urls.select("url", origin(F.col("url")).alias("host")).repartition("host").select("url")
    return fetch(by_host, throttled(fetcher, rate) if rate else fetcher, **how)


def scan_stream(urls: DataFrame, fetcher: Fetcher, path: str, checkpoint: str, rate: float | None = None, **how):
    """A query that fetches what is there of a stream of (url) into a Parquet table, each address of a finished batch once, and ends."""
    rows = scan(urls, fetcher, rate, **how)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
