"""Queries over the operators that spread one host, one text, one seed or one review over many tasks."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import packing, quality, review
from ..sources import discovery
from ..storage import shared_dir, table, written
from ..streaming import curation, incremental, thinking
from .catalog import query
from .queries_text import SENTENCES_SQL, TOKENS_SQL
from .queries_urls import SANITISED, _address, _named, _site_graph, _site_links, _site_pages, crawl_sql

WS = "concat(' ', chr(9), chr(10), chr(13))"


@query(
    "q58_chunk_overlap",
    rf"""WITH RECURSIVE ls AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, {WS})), lambda l: l <> '') AS lines FROM documents
), ps AS (
  SELECT doc_id, list_transform(flatten(list_transform(lines, lambda l: CASE WHEN {TOKENS_SQL.format("l")} > 512 THEN {SENTENCES_SQL.format("l")} ELSE [l] END)), lambda s: {TOKENS_SQL.format("s")}) AS ts FROM ls
), step(doc_id, i, opened, tot, chunk, closed) AS (
  SELECT doc_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(ts[1] AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM ps WHERE len(ts) > 0
  UNION ALL
  SELECT doc_id, i + 1, f, CAST(coalesce(list_sum(ts[f:i]), 0) + ts[i + 1] AS BIGINT), chunk + CASE WHEN is_full THEN 1 ELSE 0 END, CASE WHEN is_full THEN tot END FROM (
    SELECT *, CASE WHEN is_full THEN list_min(list_filter(range(opened, i + 2), lambda g: coalesce(list_sum(ts[g:i]), 0) <= 64)) ELSE opened END AS f FROM (
      SELECT s.*, q.ts, s.tot + q.ts[s.i + 1] > 512 AS is_full FROM step s JOIN ps q USING (doc_id) WHERE s.i < len(q.ts)
    )
  )
)
SELECT doc_id, CAST(chunk - 1 AS INTEGER) AS chunk_index, CAST(closed AS BIGINT) AS tokens FROM step WHERE closed IS NOT NULL
UNION ALL SELECT s.doc_id, CAST(s.chunk AS INTEGER), CAST(s.tot AS BIGINT) FROM step s JOIN ps q USING (doc_id) WHERE s.i = len(q.ts)""",
)
def q58(spark, sf):
    """Lines packed into chunks of 512 tokens that overlap by up to 64."""
    d = table(spark, sf, "documents")
    return packing.packed(d, "doc_id", "text", 512, 64, r"\n").select("doc_id", "chunk_index", "tokens")


#: By the length of a host modulo 7: its robots body; at 5 the host has no row.
BODIES = {
    0: "User-agent: *\nDisallow: /en/\n",
    1: "User-agent: *\nAllow: /fr/\nDisallow: /",
    2: "User-agent: SomeBot\nDisallow: /\n\nUser-agent: *\nDisallow: /*.html\nCrawl-delay: 4",
    3: "User-agent: *\n\nDisallow: /",
    4: None,
    6: "User-agent: other\nUser-agent: * # all\nDisallow: /de/\nDisallow: /en/1\nAllow: /en/\nDisallow:",
}


@query(
    "q79_robots_gate",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE length(host) % 7 WHEN 0 THEN NOT starts_with(path, '/en/') WHEN 1 THEN starts_with(path, '/fr/') WHEN 2 THEN true WHEN 3 THEN true
  WHEN 6 THEN NOT starts_with(path, '/de/') AND NOT starts_with(path, '/en/1') ELSE false END AS allowed FROM p""",
)
def q79(spark, sf):
    """The robots gate over all pages; every host has a body by its length."""
    p = table(spark, sf, "pages").select("page_id", "url", urls.origin(F.col("url")).alias("host"))
    body = F.lit(None).cast("string")
    for k, text in BODIES.items():
        body = F.when(F.length("host") % 7 == k, F.lit(text)).otherwise(body)
    robots = p.select("host").distinct().where(F.length("host") % 7 != 5).withColumn("body", body)
    return discovery.allowed(p, robots).select("page_id", "allowed")


@query("q80_crawl_seeds", crawl_sql(3, 6))
def q80(spark, sf):
    """Every site of the pages crawled at once from its first page, six pages at most; the pages of a site link to one another by their places."""
    n = _site_graph(spark, sf)
    links = _site_links(n).select("src", "pos", F.concat(_address(F.col("to")), F.lit("#part")).alias("dst"))
    away = n.select(_address(F.col("k")).alias("src"), F.lit(9).alias("pos"), F.lit("https://elsewhere.example.com/0").alias("dst"))
    seeds = n.where("k = 0").select(_address(F.col("k")).alias("seed"))
    return _named(discovery.crawl_many(_site_pages(n), links.unionByName(away), seeds, max_pages=6), n)


def priced_rater(system: str, prompt: str) -> tuple[str, float]:
    """Scores 5, 4, 3 and so on for the examples of a batch, for a sixteenth an example."""
    n = int(re.match(r"Rate these (\d+)", prompt)[1])
    return json.dumps(list(range(5, 5 - n, -1))), n / 16


@query(
    "q81_review_waves",
    """WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
b AS (SELECT r // 5 AS batch, count(*) / 16.0::DOUBLE AS cost FROM r GROUP BY 1),
s AS (SELECT batch, cost, coalesce(sum(cost) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM b)
SELECT conv_id, CASE WHEN spent < 3 THEN CAST(5 - r % 5 AS INTEGER) END AS score, CASE WHEN spent < 3 THEN cost END AS cost FROM r JOIN s ON s.batch = r.r // 5""",
)
def q81(spark, sf):
    """Ten batches cost what the cap allows; waves of four ask twelve."""
    samples = quality.conversations(table(spark, sf, "conversations"))
    return review.review(samples, priced_rater, cap=3.0, wave=4).select(F.col("id").alias("conv_id"), "score", "cost")


_known = "page_id % 5 = 0"


@query("q82_stream_discovery", f"WITH {SANITISED} SELECT url FROM clean GROUP BY url HAVING NOT bool_or({_known})")
def q82(spark, sf):
    """The pages' addresses as a file stream into the discovered table, without those an earlier session knows; the last batch is given twice."""
    root = f"{shared_dir(spark)}/weftline/discovery-{uuid.uuid4().hex}"
    p = table(spark, sf, "pages").select(F.col("page_id").alias("ord"), "url", "page_id")
    known = written(p.where(_known).select(urls.sanitise(F.col("url")).alias("url")), "known")
    p.select("ord", "url").repartition(3, "ord").write.parquet(f"{root}/in")
    stream = curation.stream_table(spark, f"{root}/in", p.select("ord", "url").schema, 1)
    incremental.discover_stream(stream, root, "s", known).awaitTermination()
    found = spark.read.parquet(f"{root}/discovered")
    last = found.agg(F.max("batch_id")).first()[0]
    incremental.discover_batch(root, "s", known)(written(found.where(F.col("batch_id") == last).select("ord", "url"), "again"), last)
    return spark.read.parquet(f"{root}/discovered").select("url")


_abc = [f"replace(substring(text, {at}, 30), '<', '.') AS {name}" for at, name in ((1, "a"), (31, "b"), (61, "c"))]
_parts = ", ".join(_abc)


@query("q83_thinking_tokens", f"SELECT doc_id, a || c AS content, b || CASE WHEN doc_id % 2 = 0 THEN c ELSE '' END AS thinking FROM (SELECT doc_id, {_parts} FROM documents) WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, a, b || c FROM (SELECT doc_id, {_parts} FROM documents) WHERE doc_id % 2 = 0")
def q83(spark, sf):
    """Answers as tokens of three characters, in which tags are cut; every second answer never closes its tag."""
    d = table(spark, sf, "documents").selectExpr("doc_id", *_abc)
    said = F.concat("a", F.lit("<think>"), "b", F.when(F.col("doc_id") % 2 == 1, "</think>").otherwise(""), "c")
    n = F.greatest(F.lit(1), F.ceil(F.length("said") / 3)).cast("int")
    t = d.select("doc_id", said.alias("said")).withColumn("n", n).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tokens = t.select(F.col("doc_id").alias("stream_id"), "pos", F.substr("said", F.col("pos") * 3 + 1, F.lit(3)).alias("token"), (F.col("pos") == F.col("n") - 1).alias("last"))
    parts = thinking.split_tokens(tokens).groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("pos", "content", "thinking"))).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda e: e[c]), "").alias(c)
    return parts.select(F.col("stream_id").alias("doc_id"), joined("content"), joined("thinking"))
