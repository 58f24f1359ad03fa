"""The robots gate against the standard parser."""

import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from weftline.sources import discovery, robots

FIXED = [
    "User-agent: *\nDisallow: /x",
    "User-agent: *\nAllow: /x/open\nDisallow: /x\n",
    "User-agent: *\nDisallow: /x\nAllow: /x/open\n",
    "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private",
    "User-agent: SpiderBot\nUser-agent: more\nDisallow: /a\n\nUser-agent: *\nDisallow: /",
    "User-agent: *\n\nDisallow: /lost\n",
    "Disallow: /x\nUser-agent: *\nDisallow: /y # why\n# a comment\nDisallow: /z\r\nsitemap: https://e.com/s.xml\rDisallow:",
    "User-agent: *\nDisallow:\n",
    "User-agent: *\nAllow:\nDisallow: /\n",
    "User-agent: *\nDisallow: /*.pdf$\nDisallow: /a%2fb\nDisallow: /é\nDisallow: /q?x=1\nDisallow: /100%",
    "User-agent: a\nCrawl-delay: 5\nUser-agent: *\nCrawl-delay: 9\nCrawl-delay: x\nDisallow: /d",
    "user-agent:*\nDISALLOW:/Case\n\n\nUser-agent: *\nDisallow: /case",
    "no field\n:\nUser-agent\nUser-agent: *\n \nDisallow: /spaced",
    "",
    None,
]
PATHS = ["", "/", "/x", "/x/open", "/x/open/2?y#z", "/y", "/z/1", "/private/1", "/a/b", "/a%2Fb", "/é", "/%C3%A9/1", "/q?x=1&y", "/q?", "/q?#", "/*.pdf$", "/1.pdf", "/100%", "/100%25", "/d;", "/d;p", "/Case", "/case", "/spaced", "/lost", "/a+b", "/a%2Bb", "?x", "/x#"]


def decide(body, agent, url):
    parser = RobotFileParser()
    if body is not None:
        parser.parse(body.splitlines())
    return body is not None and parser.can_fetch(agent, url)


def test_gate_against_standard_parser(spark):
    rng = random.Random(4)
    lines = ["User-agent: *", "User-agent: Spider", "User-agent: x", "Disallow: /a", "Allow: /a/b", "Disallow: /", "Disallow:", "", "# c", "Crawl-delay: 3", "Allow: /b", "Disallow: /b?c", " ", "Request-rate: 1/2", "Sitemap: u"]
    bodies = FIXED + ["\n".join(rng.choices(lines, k=rng.randint(1, 9))) for _ in range(120)]
    table = spark.createDataFrame([(f"https://h{i}.com", b) for i, b in enumerate(bodies)], "host string, body string")
    paths = PATHS + ["/a", "/a/b/c", "/b?c=1", "/b"]
    urls = spark.createDataFrame([(f"https://h{i}.com", f"https://h{i}.com{p}", 1) for i in range(len(bodies) + 1) for p in paths], "host string, url string, allowed_before int")
    for agent in ("*", "SpiderBot/1.0"):
        got = {(r.host, r.url): r.allowed for r in discovery.allowed(urls, table, agent).collect()}
        want = {(f"https://h{i}.com", f"https://h{i}.com{p}"): decide(b, agent, f"https://h{i}.com{p}") for i, b in enumerate([*bodies, None]) for p in paths}
        assert {k: v for k, v in got.items() if v != want[k]} == {}
        assert len(got) == len(want)


def test_delays_and_plan(spark):
    table = spark.createDataFrame([(f"https://h{i}.com", b) for i, b in enumerate(FIXED)], "host string, body string")
    assert {r.host: r.delay for r in robots.crawl_delays(table).collect()} == {"https://h10.com": 9}
    assert {r.host: r.delay for r in robots.crawl_delays(table, "a").collect()} == {"https://h10.com": 5}
    urls = spark.range(20).select(F.lit("https://h0.com").alias("host"), F.concat(F.lit("https://h0.com/x"), F.col("id").cast("string")).alias("url"))
    out = discovery.allowed(urls.union(urls), table)
    assert out.count() == 40 and not out.where("allowed").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
