"""Fixed cases of functions whose queries read the given tables."""

from pyspark.sql import functions as F

from weftline.functions import chat, generated, urls
from weftline.operators import review
from weftline.sources import discovery

#: (given, canonical) — None where a URL is rejected.
EDGES = [
    ("example.com/A/b", "https://example.com/A/b"),
    ("//x.com/p", "https://x.com/p"),
    ("HTTP://E.com", None),
    ("ftp://x.com/f", None),
    ("mailto:a@b.com", None),
    ("javascript:alert(1)", None),
    ("localhost:3000/x", None),
    ("  https://Exa mple.COM/Pa th\t", "https://example.com/Path"),
    ("https://WWW.Example.com/MiXed", "https://www.example.com/MiXed"),
    ("https://e.com/?UTM_Source=a&b=1&ref=2", "https://e.com/?b=1"),
    ("https://e.com/?a=&b", "https://e.com/?a=&b="),
    ("https://e.com/p%20q?x=a%20b+c", "https://e.com/p%20q?x=a+b+c"),
    ("https://e.com/é?q=ü~*", "https://e.com/%C3%A9?q=%C3%BC~%2A"),
    ("https://e.com:8080/x#frag", "https://e.com:8080/x"),
    ("https://e.com/a;b?c=d", "https://e.com/a;b?c=d"),
    ("https://e.com", "https://e.com"),
    ("", None),
    (None, None),
]

ROBOTS = [("https://a.com", "User-agent: *\nSITEMAP: https://a.com/s1.xml\nSitemap: https://a.com/s2.xml"), ("https://b.com", "sitemap:https://b.com/x.xml \nDisallow: /x"), ("https://c.com", "User-agent: *"), ("https://d.com", None)]

SITEMAPS = [
    ("https://a.com/i.xml", 200, '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://a.com/j.xml</loc></sitemap><sitemap><loc>https://a.com/p.xml</loc></sitemap><sitemap><loc>https://a.com/bad.xml</loc></sitemap></sitemapindex>'),
    ("https://a.com/j.xml", 200, "<sitemapindex><sitemap><loc>https://a.com/i.xml</loc></sitemap><sitemap><loc>https://a.com/q.xml</loc></sitemap></sitemapindex>"),
    ("https://a.com/p.xml", 200, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.com/1</loc></url><url><loc>https://www.a.com/2</loc></url></urlset>'),
    ("https://a.com/q.xml", 200, "<urlset><url><loc>https://a.com/3</loc></url></urlset>"),
    ("https://a.com/bad.xml", 200, "not xml <urlset>"),
    ("https://a.com/gone.xml", 404, "<urlset><url><loc>https://a.com/9</loc></url></urlset>"),
]

LINKS = [("https://s.com/", 0, "https://s.com/a"), ("https://s.com/", 1, "https://s.com/b"), ("https://s.com/", 2, "https://o.com/z"), ("https://s.com/a", 0, "https://s.com/c"), ("https://s.com/b", 0, "https://s.com/c"), ("https://s.com/b", 1, "https://www.s.com/a"), ("https://s.com/c", 0, "https://s.com/"), ("https://s.com/c", 1, "https://s.com/d"), ("https://s.com/d", 0, "https://s.com/e"), ("https://s.com/e", 0, "https://s.com/f"), ("https://s.com/a", 1, "https://s.com/x.pdf")]

REFUSALS = ["I cannot do that, sorry, it is not possible for me", "i'm UNABLE to help", "such as an aid to walking is good for all of us here", "As an AI model I say no", "a fine answer with more than ten words in it, all good", ""]

RESPONSES = [
    ('[{"question": "Q1", "answer": "A1"}, {"question": "Q2", "answer": "A2"}]', [("Q1", "A1"), ("Q2", "A2")]),
    ('{"question": "only", "answer": "one"}', [("only", "one")]),
    ('```json\n[{"question": "f", "answer": "g"}]\n```', [("f", "g")]),
    ('```\n[{"question": "h", "answer": "i"}]\n```', [("h", "i")]),
    ('Here you are: [{"question": "j", "answer": "k"}] done', [("j", "k")]),
    ("garbage", []),
    ("", []),
]

REVIEWS = [(0, 5, "[4, 3, 5, 2, 4]"), (1, 2, "[9, -1]"), (2, 3, "[1, 2]"), (3, 2, "oops"), (4, 1, "[5]")]

def _index(*children: str) -> str:
    return "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.com/{c}.xml</loc></sitemap>" for c in children) + "</sitemapindex>"


def _urls(*pages: str) -> str:
    return "<urlset>" + "".join(f"<url><loc>https://a.com/{p}</loc></url>" for p in pages) + "</urlset>"


#: Two ways to a file, the first in a depth-first walk being the longer one.
DIAMOND = [("a", _index("b", "d", "c")), ("b", _index("e")), ("e", _index("c", "a")), ("c", _urls("c1", "c2")), ("d", _index("f", "c")), ("f", _urls("f1"))]

RAW_LINKS = [("https://s.com/", 0, "https://S.com/a?utm_source=x#top"), ("https://s.com/", 1, "mailto:me@s.com"), ("https://s.com/", 2, "https://s.com/a"), ("https://s.com/a", 0, "https://s.com/b?ref=1&k=2")]


def closure(spark, files, root):
    return [r.url for r in discovery.sitemap_closure(spark.createDataFrame(files, "url string, status int, body string"), root).orderBy("ord").collect()]


def test_sanitise_edges(spark):
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(EDGES)], "ord int, raw string")
    assert {r.ord: r.url for r in d.select("ord", urls.sanitise(F.col("raw")).alias("url")).collect()} == {i: b for i, (_, b) in enumerate(EDGES)}


def test_robots_sitemaps(spark):
    got = discovery.robots_sitemap(spark.createDataFrame(ROBOTS, "host string, body string")).collect()
    assert sorted(map(tuple, got)) == [("https://a.com", "https://a.com/s1.xml"), ("https://b.com", "https://b.com/x.xml")]


def test_sitemap_files(spark):
    assert closure(spark, SITEMAPS, "https://a.com/i.xml") == ["https://a.com/3", "https://a.com/1", "https://www.a.com/2"]
    assert closure(spark, [(f"https://a.com/{n}.xml", 200, body) for n, body in DIAMOND], "https://a.com/a.xml") == ["https://a.com/c1", "https://a.com/c2", "https://a.com/f1"]


def test_crawls(spark):
    links = spark.createDataFrame(LINKS, "src string, pos int, dst string")
    every = links.select(F.col("src").alias("url")).union(links.select("dst")).distinct().withColumns({"status": F.lit(200), "content_type": F.lit("text/html")})
    got = discovery.crawl(every, links, "https://s.com/").orderBy("visit").collect()
    assert [(r.url.removeprefix("https://"), r.depth) for r in got] == [("s.com/", 0), ("s.com/a", 1), ("s.com/b", 1), ("s.com/c", 2), ("www.s.com/a", 2), ("s.com/d", 3)]
    links = spark.createDataFrame(RAW_LINKS, "src string, pos int, dst string")
    pages = spark.createDataFrame([(u, 200, "text/html") for u in ("https://s.com/", "https://s.com/a", "https://s.com/b?k=2")], "url string, status int, content_type string")
    assert [r.url for r in discovery.crawl(pages, links, "https://s.com/").orderBy("visit").collect()] == ["https://s.com/", "https://s.com/a", "https://s.com/b?k=2"]


def test_refusals(spark):
    d = spark.createDataFrame(list(enumerate(REFUSALS)), "id int, t string")
    got = {r.id: r.s for r in d.select("id", F.round(chat.message_score(F.struct(F.lit("assistant").alias("role"), F.col("t").alias("content"))), 6).alias("s")).collect()}
    bad = [0, 1, 2, 3]
    assert got == {i: round(min(1.0, len(t.split()) / 10) * (0.1 if i in bad else 1.0), 6) for i, t in enumerate(REFUSALS)}


def test_responses(spark):
    d = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RESPONSES)], "id int, raw string").select("id", F.posexplode(generated.parse_items(F.col("raw"))).alias("pos", "item"))
    m = generated.to_messages(F.col("item"), "qa")
    got = sorted(map(tuple, d.select("id", "pos", m[0]["content"], m[1]["content"]).collect()))
    assert got == [(i, j, q, a) for i, (_, items) in enumerate(RESPONSES) for j, (q, a) in enumerate(items)]


def test_review_scores(spark):
    s = spark.createDataFrame([(b, p) for b, n, _ in REVIEWS for p in range(n)], "batch int, pos int")
    got = sorted((r.batch, r.pos, r.score) for r in review.apply_scores(s, spark.createDataFrame([(b, raw) for b, _, raw in REVIEWS], "batch int, raw string")).collect())
    assert got == [(0, 0, 4), (0, 1, 3), (0, 2, 5), (0, 3, 2), (0, 4, 4), (1, 0, 5), (1, 1, 1), (2, 0, 3), (2, 1, 3), (2, 2, 3), (3, 0, 3), (3, 1, 3), (4, 0, 5)]


def test_deep_pages():
    from weftline.functions import markup

    got = markup.extract_page("<body>" + "<div>a" * 10_000 + "<ol><li>x<li>y</ol>", "https://e.com")
    assert got["word_count"] == 10_002 and got["markdown"].endswith("1. x\n2. y")


def test_sitemap_entries(spark):
    index = '<?xml version="1.0" encoding="UTF-8"?>\n<!-- <urlset> -->\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://a.com/j.xml</loc></sitemap></sitemapindex>\n'
    bodies = [
        index,
        "<ns:urlset xmlns:ns='u'><ns:url><ns:loc>\n https://a.com/3?a=1&amp;b=2 </ns:loc></ns:url></ns:urlset>",
        "not xml <urlset>",
        "<urlset><url><loc>cut</loc></url>",
        "<urlset><url><loc>a&nbsp;b</loc></url></urlset>",
        "<urlset><url><loc>x</loc></url></urlset><urlset/>junk",
        "<html><body><url><loc>q</loc></url></body></html>",
        "<urlset><url><priority>1</priority></url><url><loc><![CDATA[https://a.com/c]]></loc><loc>2</loc></url><sitemap><loc>w</loc></sitemap></urlset><!-- end -->",
        "﻿<urlset><url><loc>bom</loc></url></urlset>",
        "<urlset/>",
        "",
        None,
        "<urlset>" + "".join(f"<url><loc>https://a.com/{i}</loc></url>" for i in range(5000)) + "</urlset>",
    ]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "url string, body string")
    got = sorted((int(r.file), r.is_index, r.pos, r.url) for r in discovery.sitemap_entries(df).where("file <> '12'").collect())
    assert got == [(0, True, 0, "https://a.com/j.xml"), (1, False, 0, "https://a.com/3?a=1&b=2"), (7, False, 0, "https://a.com/c"), (7, False, 1, "2"), (8, False, 0, "bom")]
    assert discovery.sitemap_urls(df).where("sitemap = '12'").count() == 5000
    plan = discovery.sitemap_entries(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and "Python" not in plan
