"""Sources of URLs: text lists, robots files, sitemaps and the link graph, all from tables of fetched bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import extract
from ..functions.urls import bare_host, is_http_url, is_page_url, matches, sanitise
from ..operators.relational import first_nonempty, keep_first
from ..storage import written
from .robots import allowed as allowed

# Where a site's sitemap is looked for, in order.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml"]


def url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """URLs of a text file or pasted list: stripped, no comments, http(s) only."""
    line = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    return lines.select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#") & is_http_url(F.col("url")))


def read_url_file(spark, path: str) -> DataFrame:
    return url_lines(spark.read.text(path))


def robots_sitemap(robots: DataFrame) -> DataFrame:
    """(host, sitemap): the first Sitemap: line of each robots body (host, body)."""
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line")).where(F.lower("line").startswith("sitemap:"))
    url = F.regexp_replace(F.regexp_replace("line", r"^[^:]*:", ""), r"(?U)^\s+|\s+$", "")
    return lines.groupBy("host").agg(F.min_by(url, "pos").alias("sitemap"))


def locate_sitemap(robots: DataFrame, fetched: DataFrame) -> DataFrame:
    """(host, sitemap) by robots first, then the well-known paths; fetched: (url, status, body), host like https://x.com."""
    said = robots_sitemap(robots)
    tries = robots.select("host", F.posexplode(F.array(*map(F.lit, SITEMAP_PATHS))).alias("pos", "path")).withColumn("url", F.concat("host", "path"))
    hits = tries.join(fetched, "url").where((F.col("status") == 200) & F.col("body").rlike("<urlset|<sitemapindex"))
    return first_nonempty([said, hits.groupBy("host").agg(F.min_by("url", "pos").alias("sitemap"))], "host").drop("prio")


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"<(?:\w+:)?sitemapindex[\s>]")


#: What of a sitemap file is read; whatever else it holds is passed over.
SITEMAP = "url array<struct<loc:array<string>>>, sitemap array<struct<loc:array<string>>>, _corrupt string"
ROOT = r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[\w.-]+:)?([A-Za-z]+)[\s/>]"
END = r"(?s)(?:</(?:[\w.-]+:)?[A-Za-z]+\s*>|/>)(?:\s|<!--.*?-->)*$"


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """(file, is_index, pos, url): the addresses of sitemap files and indexes among (url, body), each body parsed once.

    Namespaces and their prefixes count for nothing. Bad XML, other documents and null bodies give nothing; so do empty addresses.
    """
    body = F.regexp_replace("body", "^\ufeff", "")
    read = F.from_xml(body, SITEMAP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"})
    files = bodies.select(F.col("url").alias("file"), F.when(body.rlike(END), F.regexp_extract(body, ROOT, 1)).alias("root"), read.alias("x")).where(F.col("root").isin("urlset", "sitemapindex"))
    is_index = F.col("root") == "sitemapindex"
    given = F.when(F.col("x._corrupt").isNull(), F.when(is_index, F.col("x.sitemap")).otherwise(F.col("x.url")))
    found = F.flatten(F.transform(given, lambda e: F.coalesce(e["loc"], F.expr("cast(array() as array<string>)"))))
    # the outer form, as a filter on the number of addresses would parse every body twice
    rows = files.select("file", is_index.alias("is_index"), F.posexplode_outer(found).alias("pos", "url")).where("pos IS NOT NULL")
    return rows.withColumn("url", F.regexp_replace("url", r"(?U)^\s+|\s+$", "")).where("url <> ''")


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    """(sitemap, pos, url) of the <urlset> bodies among (url, body); bad XML gives nothing."""
    return sitemap_entries(bodies).where("NOT is_index").select(F.col("file").alias("sitemap"), "pos", "url")


def sitemap_children(bodies: DataFrame) -> DataFrame:
    """(parent, pos, url) of the <sitemapindex> bodies among (url, body)."""
    return sitemap_entries(bodies).where("is_index").select(F.col("file").alias("parent"), "pos", "url")


def sitemap_closure(fetched: DataFrame, seed: str) -> DataFrame:
    """(ord, url) of all pages under a sitemap or index, depth first, each file once; fetched: (url, status, body).

    A file stands where a depth-first walk meets it first: at its smallest path of positions among those that visit no file
    twice. Paths only get smaller, so rounds that hand a file's path to its children end, however deep the indexes are.
    """
    spark = fetched.sparkSession
    good = fetched.where("status = 200").select("url", "body")
    entries = written(sitemap_entries(good), "sitemap-entries")
    edges = entries.where("is_index").select(F.col("file").alias("parent"), "pos", "url")
    walks = changed = spark.createDataFrame([(seed, [0], [seed])], "url string, walk array<int>, files array<string>")
    while True:
        step = changed.withColumnsRenamed({"url": "parent"}).join(edges, "parent").where(~F.array_contains("files", F.col("url")))
        step = step.select("url", F.concat("walk", F.array("pos")).alias("walk"), F.concat("files", F.array("url")).alias("files"))
        # the least path of all rounds: a longer one may come first
        best = walks.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        best = best.groupBy("url").agg(F.min_by(F.struct("walk", "files", "old"), F.struct("walk", ~F.col("old"))).alias("b"))
        best = written(best.select("url", "b.*"), "sitemap-walks")
        walks, changed = best.drop("old"), best.where("NOT old").drop("old")
        if changed.isEmpty():
            break
    rows = entries.where("NOT is_index").join(walks.select(F.col("url").alias("file"), "walk"), "file")
    return rows.select(F.concat("walk", F.array("pos")).alias("ord"), "url")


def is_app_candidate(html: Column, url: Column, as_written: bool = False) -> Column:
    """Whether a page may draw its links by script: over 500 characters of text, under 3 links to pages of its own host.

    as_written: character references count with all their characters, runs of white space as one.
    """
    found = extract(F.replace(html, F.lit("&"), F.lit("&amp;")) if as_written else html, url)
    text = F.trim(F.regexp_replace(found["text"], r"[ \t\n\r\f]+", " ")) if as_written else found["text"]
    links = F.filter(F.transform(found["links"], sanitise), lambda x: x.isNotNull())
    own = F.filter(F.array_distinct(links), lambda x: (bare_host(x) == bare_host(url)) & is_page_url(x))
    return (F.size(own) < 3) & (F.length(text) > 500)


def crawl_many(pages: DataFrame, links: DataFrame, seeds: DataFrame, max_pages: int = 50, max_depth: int = 3, pattern: str | None = None) -> DataFrame:
    """(seed, url, depth, visit): a breadth-first crawl from every seed at once, each on its own domain and up to its own max_pages.

    pages: (url, status, content_type); only those with status 200 and html are visited. links: (src, pos, dst), sanitised first; those that
    are no web address go. seeds: (seed). A URL is visited by a seed at its first place in the seed's queue (level, place of its source in
    the level, place of the link). A level of all seeds is one join of their frontiers with the links, keyed by (seed, url).
    Places in a level come from a range sort, so a seed with a wide frontier is spread; a seed's visits of a level are cut
    at what max_pages leaves it before their links are followed, and a seed that has all its pages follows none.
    """
    good = pages.where((F.col("status") == 200) & F.contains(F.coalesce("content_type", F.lit("")), F.lit("html"))).select("url").distinct()
    links = links.withColumn("dst", sanitise(F.col("dst"))).where("dst IS NOT NULL")
    edges = links.where(matches(F.col("dst"), pattern) & is_page_url(F.col("dst"))).select("src", "pos", "dst", bare_host(F.col("dst")).alias("dst_host"))
    edges = written(edges, "crawl-links")
    frontier = seeds.select("seed", F.col("seed").alias("url"), F.lit(0).cast("long").alias("rank")).where("seed IS NOT NULL").distinct()
    queued, visited = frontier.select("seed", "url"), None
    by_place = Window.partitionBy("seed").orderBy("rank")
    for depth in range(max_depth + 1):
        # the limit is on the number of a window, so that each task keeps no more of a seed than its max_pages
        hit = frontier.join(good, "url", "left_semi").withColumn("visit", F.row_number().over(by_place)).where(F.col("visit") <= max_pages)
        if visited is not None:
            found = visited.groupBy("seed").agg(F.max("visit").alias("found"))
            hit = hit.join(found, "seed").withColumn("visit", F.col("visit") + F.col("found")).where(F.col("visit") <= max_pages).drop("found")
        hit = written(hit.select("seed", "url", F.lit(depth).alias("depth"), "rank", "visit"), "visits")
        visited = hit if visited is None else visited.unionByName(hit)
        if depth == max_depth or hit.isEmpty():
            break
        open_ = visited.groupBy("seed").agg(F.max("visit").alias("found")).where(F.col("found") < max_pages)
        nxt = hit.join(open_, "seed", "left_semi").join(edges, F.col("url") == F.col("src")).where(F.col("dst_host") == bare_host(F.col("seed")))
        nxt = nxt.groupBy("seed", F.col("dst").alias("url")).agg(F.min(F.struct("rank", "pos")).alias("place"))
        nxt = nxt.join(queued, ["seed", "url"], "left_anti").repartitionByRange("seed", "place", "url").sortWithinPartitions("seed", "place", "url")
        frontier = written(nxt.select("seed", "url", F.monotonically_increasing_id().alias("rank")), "frontier")
        queued = queued.unionByName(frontier.select("seed", "url"))
    return visited.select("seed", "url", "depth", "visit")


def crawl(pages: DataFrame, links: DataFrame, seed: str, max_pages: int = 50, max_depth: int = 3, pattern: str | None = None) -> DataFrame:
    """(url, depth, visit): the crawl of one seed."""
    seeds = pages.sparkSession.createDataFrame([(seed,)], "seed string")
    return crawl_many(pages, links, seeds, max_pages, max_depth, pattern).select("url", "depth", "visit")


def dispatch(seeds: DataFrame, sitemap: DataFrame, crawled: DataFrame) -> DataFrame:
    """The URLs of each seed by the fallback chain: sitemap on the seed's domain, whole sitemap, crawl, the seed itself.

    seeds: (seed_ord, seed); sitemap, crawled: (seed, ord, url).
    """
    s = sitemap.join(seeds, "seed").withColumn("source", F.lit("sitemap"))
    own = s.where(F.col("seed").endswith(".xml") | (bare_host(F.col("url")) == bare_host(F.col("seed"))))
    c = crawled.join(seeds, "seed").withColumn("source", F.lit("crawl"))
    self_ = seeds.select("seed", F.lit(0).alias("ord"), F.col("seed").alias("url"), "seed_ord", F.when(F.col("seed").endswith(".xml"), "sitemap").otherwise("crawl").alias("source"))
    cols = ["seed", "seed_ord", "ord", "url", "source"]
    best = first_nonempty([x.select(*cols) for x in (own, s, c, self_)], "seed")
    return keep_first(best, ["url"], ["seed_ord", "ord"]).drop("prio")
