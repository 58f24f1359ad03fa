"""Generation: prompts to a pluggable generator, responses to samples."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import runs, text_bytes
from ..functions.generated import build_prompt, parse_items, to_messages
from ..sources.tables import backoff

#: (system, user) prompts in; the response out, or (response, prompt tokens, completion tokens, dollars). A raised error fails only its own prompt.
Generator = Callable[[str, str], str | tuple[str, int, int, float]]


def echo_generator(system: str, user: str) -> str:
    """A deterministic stand-in without a model: asks for the passage's first sentence."""
    passage = user.split("<document>\n", 1)[-1].split("\n</document>", 1)[0].strip()
    head = passage.split(". ")[0][:400]
    return json.dumps([{"question": f"What does the passage say about {' '.join(head.split()[:3])}?", "answer": head}])


def error_class(message: str) -> str:
    """credentials, connection or other, by what the message says."""
    m = message.lower()
    if any(x in m for x in ("auth", "api key", "401", "403")):
        return "credentials"
    return "connection" if any(x in m for x in ("connect", "timeout", "unreachable")) else "other"


def complete(prompts: DataFrame, generator: Generator = echo_generator, attempts: int = 3, wait: float = 2.0, longest: float = 20.0) -> DataFrame:
    """prompts (chunk_id, system, user) plus raw, error, error_class, prompt_tokens, completion_tokens and cost_usd.

    A generator returns the text, or (text, prompt tokens, completion tokens, dollars). Failures are tried again after
    ``wait`` seconds, twice as long each time; they give a null response, never a failed job.
    """

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterable[pa.RecordBatch]):
        for part in (b.slice(*r) for b in batches for r in runs(text_bytes(b.column("system"), b.column("user")))):
            rows = []
            for s, u in zip(part.column("system").to_pylist(), part.column("user").to_pylist(), strict=True):
                row = (None, "no attempt", "other", 0, 0, 0.0)
                for attempt in range(attempts):
                    if attempt:
                        time.sleep(backoff(attempt, wait, longest))
                    try:
                        said = generator(s, u)
                        row = (said, None, None, 0, 0, 0.0) if said is None or isinstance(said, str) else (said[0], None, None, *said[1:])
                        break
                    except Exception as e:  # noqa: BLE001  a generator may fail in any way; the row reports it
                        why = f"{type(e).__name__}: {e}"
                        row = (None, why, error_class(why), 0, 0, 0.0)
                rows.append(row)
            more = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "raw", "error", "error_class", "prompt_tokens", "completion_tokens", "cost_usd"])

    return prompts.select(F.col("chunk_id").cast("long").alias("chunk_id"), "system", "user").mapInArrow(run, "chunk_id long, system string, user string, raw string, error string, error_class string, prompt_tokens long, completion_tokens long, cost_usd double")


def usage(said: DataFrame) -> DataFrame:
    """(calls, prompt_tokens, completion_tokens, cost_usd, errors) of completions, one row."""
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost_usd")]
    return said.agg(F.count("*").alias("calls"), *total, F.count("error").alias("errors"))


def generate(chunks: DataFrame, kind: str = "qa", goal: str = "", n: int = 3, custom: str = "", generator: Generator = echo_generator, **how) -> DataFrame:
    """Samples (id, chunk_id, format, system_prompt, messages) of chunks (chunk_id, content); ids follow (chunk_id, item)."""
    prompts = chunks.withColumn("p", build_prompt(F.col("content"), kind, goal, n, custom)).select("chunk_id", "p.system", "p.user")
    said = complete(prompts, generator, **how)
    items = said.where("raw IS NOT NULL").select("chunk_id", F.col("system").alias("system_prompt"), F.posexplode(parse_items(F.col("raw"))).alias("item_pos", "item"))
    return items.select((F.col("chunk_id") * 1000 + F.col("item_pos")).alias("id"), "chunk_id", F.lit(kind).alias("format"), "system_prompt", to_messages(F.col("item"), kind).alias("messages"))
