"""Whole flows: streaming, sinks, generation and the end-to-end pipeline. Rows only; unit tests hold the values."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import CurationConfig
from ..operators import generate, quality
from ..sinks import local
from ..storage import shared_dir, table
from ..streaming import curation
from .catalog import query
from .pipeline import collect, judge, make, process


@query("q59_sinks_roundtrip", "SELECT conv_id AS id, count(*) AS n_messages FROM conversations GROUP BY 1")
def q59(spark, sf):
    root = f"{shared_dir(spark)}/weftline/export-{uuid.uuid4().hex}"
    df = quality.conversations(table(spark, sf, "conversations"))
    paths = local.export_all(df, root)
    back = spark.read.schema(df.schema).json(paths["jsonl"])
    return back.select("id", F.size("messages").cast("long").alias("n_messages"))


@query("q60_stream_dedup", "SELECT md5(substring(text, 1, 200)) AS fp FROM documents GROUP BY 1")
def q60(spark, sf):
    """Documents as a file stream through the streaming dedup into a Parquet sink, then read back."""
    root = f"{shared_dir(spark)}/weftline/stream-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").select("doc_id", "text")
    d.write.parquet(f"{root}/in")
    stream = curation.fingerprinted(curation.stream_table(spark, f"{root}/in", d.schema)).select("fp")
    curation.append_to(curation.first_arrivals(stream, ["fp"]), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema("fp string").parquet(f"{root}/out")


@query("q69_generate", "SELECT doc_id * 1000 AS id, doc_id AS chunk_id, CAST(2 AS INTEGER) AS n_messages FROM documents")
def q69(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return generate.generate(d, "qa", "study").select("id", "chunk_id", F.size("messages").alias("n_messages"))


@query("q70_pages_to_samples")
def q70(spark, sf):
    """Pages through collection, processing, generation and the quality pass in one plan."""
    cfg = CurationConfig(goal="study")
    p = table(spark, sf, "pages")
    records = process(collect(p.select("url"), p), cfg)
    return judge(make(records, cfg), cfg).select("id", "chunk_id", "quality_score", "is_dup", "approved")
