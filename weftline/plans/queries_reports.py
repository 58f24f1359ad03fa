"""Queries over reviews, reports, formats and discovery order."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import generate, quality, review, selection
from ..sinks.local import json_rows
from ..sources import discovery
from ..storage import table
from .catalog import query
from .queries_urls import LARGEST, _address, _largest, _named, _placed, _site_graph, _site_links, _site_pages, _xml, crawl_sql


def rising_rater(system: str, prompt: str) -> tuple[str, float]:
    """Scores 1, 2, 3 and so on for the examples of a batch; a call costs 0.25."""
    return json.dumps(list(range(1, int(re.match(r"Rate these (\d+)", prompt)[1]) + 1))), 0.25


RANKED = "SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS r FROM (SELECT DISTINCT conv_id FROM conversations)"


@query(
    "q71_review_pass",
    f"""WITH r AS ({RANKED}), s AS (SELECT conv_id, CASE WHEN r < 20 THEN CAST(r % 5 + 1 AS INTEGER) END AS score FROM r)
SELECT conv_id, score IS NOT NULL AS reviewed, score, (score - 1) / 4.0::DOUBLE AS quality_score, score >= 3 AS approved FROM s""",
)
def q71(spark, sf):
    """Four calls of five stay below the cap of one; the rest keep no score."""
    samples = quality.conversations(table(spark, sf, "conversations"))
    return review.review(samples, rising_rater, cap=1.0).select(F.col("id").alias("conv_id"), "reviewed", "score", "quality_score", "approved")


@query(
    "q72_review_report",
    """WITH s AS (SELECT 1 + doc_id % 4 AS score FROM labels), m AS (SELECT coalesce(avg(score), 0) AS mean FROM s)
SELECT CAST(x.score AS INTEGER) AS score, count(s.score) AS n, round(any_value(m.mean), 6) AS mean FROM (VALUES (1), (2), (3), (4), (5)) x(score) CROSS JOIN m LEFT JOIN s ON s.score = x.score GROUP BY x.score""",
)
def q72(spark, sf):
    scores = table(spark, sf, "labels").select((1 + F.col("doc_id") % 4).cast("int").alias("score"))
    return review.score_report(scores).withColumn("mean", F.round("mean", 6))


@query(
    "q73_visible_selected",
    "WITH n AS (SELECT contains(url, '/en/') AS in_view, row_number() OVER (PARTITION BY contains(url, '/en/') ORDER BY page_id) AS r FROM pages) SELECT count(*) FILTER (in_view AND r NOT BETWEEN 3 AND 8) AS n FROM n",
)
def q73(spark, sf):
    s = selection.start(table(spark, sf, "pages").select(F.col("page_id").alias("ord"), "url"))
    return selection.visible_selected(selection.toggle(selection.filter_view(s, "/en/"), "3-8", False))


@query(
    "q74_formats",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day, format('{:,}', o_orderkey * 1000) AS grouped, repeat('█', CAST(o_orderkey % 100 // 5 AS INTEGER)) AS bar FROM orders""",
)
def q74(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", text.short_date(F.col("o_orderdate")).alias("day"), text.grouped(key * 1000).alias("grouped"), text.bar(key % 100).alias("bar"))


@query("q75_json_rows", "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"none\":null}' AS value FROM orders")
def q75(spark, sf):
    return json_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("none")))


@query(
    "q76_sitemap_order",
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS host FROM pages)
SELECT row_number() OVER (ORDER BY host, page_id % 2, page_id) AS place, url FROM p""",
)
def q76(spark, sf):
    """Two ways to the file of a site's even pages, of which a depth-first walk takes the longer; files also list the root again."""
    p = table(spark, sf, "pages").select("page_id", "url", urls.origin(F.col("url")).alias("host"))
    root = "https://root.example.com/i.xml"
    name = lambda n: F.concat("host", F.lit(f"/{n}.xml"))
    lists = p.withColumn("file", F.when(F.col("page_id") % 2 == 0, name("even")).otherwise(name("odd")))
    hosts = p.select("host").distinct()
    own = hosts.select(name("top").alias("file"), F.posexplode(F.array(name("inner"), name("even"))).alias("o", "x"))
    inner = hosts.select(name("inner").alias("file"), F.posexplode(F.array(name("even"), F.lit(root), name("odd"), name("gone"))).alias("o", "x"))
    tops = hosts.select(F.lit(root).alias("file"), F.col("host").alias("o"), name("top").alias("x"))
    files = _xml(lists, ["file"], F.col("page_id"), F.col("url"), "urlset", "url")
    files = files.unionByName(_xml(own.unionByName(inner), ["file"], F.col("o"), F.col("x"), "sitemapindex", "sitemap")).unionByName(_xml(tops, ["file"], F.col("o"), F.col("x"), "sitemapindex", "sitemap"))
    return _placed(discovery.sitemap_closure(files.select(F.col("file").alias("url"), F.lit(200).alias("status"), "body"), root))


@query("q77_crawl_sanitised", crawl_sql(3, 50, LARGEST))
def q77(spark, sf):
    """The same site through links in capitals, with tracking keys and fragments, beside addresses that are none."""
    n = _site_graph(spark, sf)
    host = urls.authority(F.col("origin"))
    shouted = F.concat(F.lit(" "), F.regexp_extract("origin", "^(https?://)", 1), F.upper(host), F.lit("/"), F.col("to").cast("string"), F.lit("?utm_source=x&ref=1#top"))
    links = _site_links(n).select("src", "pos", shouted.alias("dst"))
    other = n.select(_address(F.col("k")).alias("src"), F.lit(0).alias("pos"), F.concat(F.lit("mailto:me@"), host).alias("dst"))
    return _named(discovery.crawl(_site_pages(n), links.unionByName(other), f"{_largest(n)}/0"), n)


def moody(system: str, user: str):
    """Fails on prompts of an odd length; else charges a token a character and a token a call."""
    if len(user) % 2:
        raise TimeoutError("timeout")
    return user[:10], len(user), 1, 0.5


@query("q78_usage", "SELECT count(*) AS calls, CAST(coalesce(sum(CASE WHEN length(text) % 2 = 0 THEN length(text) ELSE 0 END), 0) AS BIGINT) AS prompt_tokens, count(*) FILTER (length(text) % 2 = 0) AS completion_tokens, 0.5::DOUBLE * count(*) FILTER (length(text) % 2 = 0) AS cost_usd, count(*) FILTER (length(text) % 2 = 1) AS errors FROM documents")
def q78(spark, sf):
    prompts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("s").alias("system"), F.col("text").alias("user"))
    return generate.usage(generate.complete(prompts, moody, wait=0.0))
