"""Operators of the curation engine on inline fixtures."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.config import CurationConfig
from weftline.functions import chat, generated, markup, text, urls
from weftline.operators import chunks, generate, quality, relational, review, selection
from weftline.plans.pipeline import Pipeline, latest, sessions
from weftline.sinks import local
from weftline.sources import discovery, tables
from weftline.streaming import curation


def values(spark, rows, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select(column(F.col("x")).alias("v"), "i").orderBy("i").select("v").collect()]


PAGE = """<html><head><title>Plain</title><meta property="og:title" content=" Shown "><meta name="article:author" content="Ann"><meta name="date" content="2024-01-02">
</head><body><nav><a href="/n">n</a></nav><main><h1>Head</h1><p>One<p>Two <a href="/a?x=1">link</a> <a href="b.html">rel</a> <a href="#top">top</a> <a href="/a?x=1">again</a><ul><li>x<li>y</ul></main><footer>foot</footer></body></html>"""


def test_page_extraction():
    got = markup.extract_page(PAGE, "https://e.com/dir/page")
    assert (got["title"], got["author"], got["published_date"]) == ("Shown", "Ann", "2024-01-02")
    assert got["links"] == ["https://e.com/a?x=1", "https://e.com/b.html"]
    assert "foot" not in got["text"] and "One" in got["text"] and got["markdown"].startswith("# Head")
    assert "* x" in got["markdown"] and got["word_count"] == len(got["text"].split())
    assert markup.extract_page(None, None)["text"] == "" and markup.extract_page("<p>hi", "x")["text"] == "hi"
    assert markup.extract_page('<body><div>no</div><div class="post-body">yes</div></body>', "https://e.com")["text"] == "yes"


def test_clean(spark):
    assert values(spark, ["ﬁne  text \n\n\n\nx\t y", "a\nFollow us on X\nmore\n\nend", None, "  "], text.clean) == ["fine text\n\nx y", "a\n\nend", None, ""]
    assert values(spark, ["hello world", "", "a b\tc"], text.word_count) == [2, 0, 3]
    assert values(spark, ["hello world"], text.token_count) == [2]
    assert values(spark, ["One. Two!  Three? four"], text.sentences) == [["One.", "Two!", "Three?", "four"]]
    assert [tuple(x) for x in values(spark, ["a<think>b</think>c<think>d", "plain"], text.split_thinking)] == [("ac", "bd"), ("plain", "")]


def test_url_patterns(spark):
    rows = ["https://e.com/blog/a", "https://e.com/Blog/b", "https://e.com/products/1?q=/blog/", "https://www.e.com/x[invalid"]
    pick = lambda p: [i for i, ok in enumerate(values(spark, rows, lambda c: urls.matches(c, p))) if ok]
    assert pick("/blog/*") == [0] and pick("BLOG") == [0, 1, 2] and pick("re:products") == [2]
    assert pick("re:[invalid") == [3] and pick("") == [0, 1, 2, 3] and pick("/b?og/*") == [0]
    assert values(spark, rows, lambda c: urls.on_domain(c, "www.e.com")) == [True] * 4
    found = values(spark, ["https://e.com/en/x", "https://e.com/fr-CA/", "https://e.com/?lang=DE", "https://e.com/?locale=es", "https://e.com/abc"], urls.locale)
    assert found == ["en", "fr-ca", "de", "es", None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["alpha", "beta.", "c!", "dd dd?", "e"]), max_size=12).map(" ".join), max_size=8).map("\n\n".join), st.integers(1, 12), st.integers(0, 6))
def test_chunks_pack_as_specified(body, size, overlap):
    out, cur = [], []
    pieces = []
    for p in filter(None, (x.strip() for x in body.split("\n\n"))):
        pieces += __import__("re").split(r"(?<=[.!?])\s+", p) if chunks.count_tokens(p) > size else [p]
    for p in pieces:
        if cur and sum(map(chunks.count_tokens, cur)) + chunks.count_tokens(p) > size:
            out.append("\n\n".join(cur))
            kept = []
            for q in reversed(cur):
                if sum(map(chunks.count_tokens, kept)) + chunks.count_tokens(q) > overlap:
                    break
                kept.insert(0, q)
            cur = kept
        cur.append(p)
    want = out + (["\n\n".join(cur)] if cur else [])
    assert chunks.split_text(body, size, overlap) == want


def test_chunks_in_catalyst_are_the_same(spark):
    rng = random.Random(2)
    rows = ["\n\n".join(" ".join(rng.choice(["alpha", "beta.", "c!", "dd dd?", "e"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 7))) for _ in range(40)] + ["", None]
    for size, overlap in ((5, 0), (8, 3), (4, 10)):
        slow, fast = (values(spark, rows, lambda c, f=f: f(c, size, overlap)) for f in (chunks.chunks, chunks.chunks_fast))
        assert [x or [] for x in slow] == [x or [] for x in fast]


def test_scores_and_thresholds(spark):
    ddl = "id long, messages array<struct<role:string,content:string>>"
    say = lambda q, a: [("user", q), ("assistant", a)]
    rows = [(1, say("a b c d e", "w " * 15)), (2, say("a b c d e", "w " * 7)), (3, say("a b c d e", "w " * 15)), (4, []), (5, [("system", "x")]), (6, say("a b c d e", "I cannot " + "w " * 10))]
    got = {r.id: (r.score, r.is_dup, r.approved) for r in quality.quality_pass(spark.createDataFrame(rows, ddl), 0.8).collect()}
    assert got == {1: (1.0, False, True), 2: (0.85, False, True), 3: (0.0, True, False), 4: (0.0, False, False), 5: (0.0, False, False), 6: (0.55, False, False)}


def test_formats(spark):
    d = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a"), ("tool", None)])], "id long, messages array<struct<role:string,content:string>>")
    ((turns,),) = d.select(chat.sharegpt(F.col("messages"), "sys")).collect()
    assert [tuple(t) for t in turns] == [("system", "sys"), ("human", "q"), ("gpt", "a"), ("tool", "")]
    raw = json.dumps([{"instruction": "do", "input": "it", "output": "done"}, {"instruction": "do", "output": "x"}])
    items = values(spark, [raw], lambda c: F.transform(generated.parse_items(c), lambda i: generated.to_messages(i, "instruction")))
    assert [[tuple(m) for m in ms] for ms in items[0]] == [[("user", "do\n\nInput: it"), ("assistant", "done")], [("user", "do"), ("assistant", "x")]]
    conv = values(spark, ['{"messages": [{"role": "user", "content": "hi"}]}', "{}"], lambda c: generated.to_messages(generated.parse_items(c)[0], "conversation"))
    assert [[tuple(m) for m in ms] for ms in conv] == [[("user", "hi")], []]


def test_generation_survives_failures(spark):
    def moody(system, user):
        if "bad" in user:
            raise ValueError("no")
        return generate.echo_generator(system, user)

    d = spark.createDataFrame([(1, "A good passage. More."), (2, "bad one")], "chunk_id long, content string")
    assert [(r.id, r.chunk_id) for r in generate.generate(d, generator=moody).collect()] == [(1000, 1)]


def test_review(spark):
    d = spark.createDataFrame([(i, [("user", f"q{i}"), ("assistant", "a")]) for i in range(7)], "id long, messages array<struct<role:string,content:string>>")
    b = review.batches(d)
    assert {(r.batch, r.n) for r in review.batch_prompts(b).collect()} == {(0, 5), (1, 2)}
    assert review.batches(d, limit=3).count() == 3 and review.estimate(11) == (3, 1800, 0.0036)


def test_selection(spark):
    s = selection.start(spark.createDataFrame([(i, f"https://e.com/{'en' if i % 2 else 'fr'}/{i}") for i in range(65)], "ord long, url string"))
    assert selection.page_count(65) == 3 and selection.rows_of("x") is None
    narrowed = selection.filter_view(s, "/en/")
    assert narrowed.where("in_view").count() == 32 and narrowed.where("selected").count() == 65
    assert selection.filter_view(s, "nothing").where("in_view").count() == 65
    assert selection.toggle(s, "29-33", False).where("not selected").count() == 2
    assert selection.toggle(s, "29-33", False, page=1).where("not selected").count() == 3
    off = selection.toggle_view(narrowed, False)
    assert off.where("selected").count() == 33
    assert [r.ord for r in selection.chosen(off).limit(2).collect()] == [0, 2]
    assert selection.chosen(selection.toggle_view(s, False)).count() == 65


def test_discovery(spark):
    robots = spark.createDataFrame([("https://a.com", "User-agent: *\nDisallow: /x"), ("https://b.com", None)], "host string, body string")
    u = spark.createDataFrame([("https://a.com", "https://a.com/x/1"), ("https://a.com", "https://a.com/y"), ("https://b.com", "https://b.com/y")], "host string, url string")
    assert {r.url: r.allowed for r in discovery.allowed(u, robots).collect()} == {"https://a.com/x/1": False, "https://a.com/y": True, "https://b.com/y": False}
    fetched = spark.createDataFrame([("https://a.com/sitemap_index.xml", 200, "<sitemapindex/>"), ("https://a.com/sitemap.xml", 404, "<urlset>")], "url string, status int, body string")
    assert [tuple(r) for r in discovery.locate_sitemap(robots, fetched).collect()] == [("https://a.com", "https://a.com/sitemap_index.xml")]
    seeds = spark.createDataFrame([(0, "https://a.com"), (1, "https://b.com"), (2, "https://c.com")], "seed_ord int, seed string")
    found = spark.createDataFrame([("https://a.com", 0, "https://www.a.com/1"), ("https://a.com", 1, "https://z.com/2"), ("https://b.com", 0, "https://z.com/3")], "seed string, ord int, url string")
    got = {r.url: r.source for r in discovery.dispatch(seeds, found, found.limit(0)).collect()}
    assert got == {"https://www.a.com/1": "sitemap", "https://z.com/3": "sitemap", "https://c.com": "crawl"}
    loop = spark.createDataFrame([("https://a.com/i.xml", 200, "<sitemapindex><sitemap><loc>https://a.com/i.xml</loc></sitemap></sitemapindex>")], "url string, status int, body string")
    assert discovery.sitemap_closure(loop, "https://a.com/i.xml").collect() == []


def test_relational(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, k int")
    assert relational.exact_split(d, "id").where("split = 'validation'").count() == 10
    assert relational.exact_split(d.limit(10), "id").where("split = 'validation'").count() == 0
    assert {r.label: r.n for r in relational.histogram(d, F.when(F.col("k") == 0, "zero").otherwise("more"), ["zero", "more", "none"]).collect()} == {"zero": 34, "more": 66, "none": 0}
    assert [r.rn for r in relational.ranked(d, [-F.col("id")]).orderBy(F.desc("id")).collect()] == list(range(1, 101))


def test_prefixes_and_sessions(spark):
    s = spark.createDataFrame([("ab1", "active", 1, None), ("ab2", "paused", 2, 9), ("c", "active", 3, None)], "id string, status string, created_at int, updated_at int")
    assert tables.by_prefix(s, "id", "c").count() == 1 and tables.by_prefix(s, "id", "ab1").count() == 1
    with pytest.raises(LookupError):
        tables.by_prefix(s, "id", "ab")
    assert latest(s).first().id == "ab2" and [r.id for r in sessions(s, ["active"]).collect()] == ["c", "ab1"]


def test_fetch(spark):
    def get(url):
        if "bad" in url:
            raise OSError("down")
        return 200, "text/html", f"<p>{url}</p>"

    got = {r.url: (r.status, r.error) for r in tables.fetch(spark.createDataFrame([("https://a",), ("https://bad",)], "url string"), get).collect()}
    assert got == {"https://a": (200, None), "https://bad": (None, "OSError: down")}


def test_throttle():
    from weftline.sources.throttle import HostBuckets

    now, slept = [0.0], []
    b = HostBuckets(2.0, clock=lambda: now[0], sleep=slept.append)
    for _ in range(6):
        b.wait("https://a.com/x")
    b.wait("https://b.com/")
    assert slept == [0.5, 1.0]
    now[0] = 10.0
    assert b.reserve("a.com") == 0.0


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "qa", "s", [("user", 'é "q", x\ny')], 0.5, "x"), (2, "qa", None, [], None, "x")], "id long, format string, system string, messages array<struct<role:string,content:string>>, quality_score double, session_id string")
    paths = local.export_all(d, str(tmp_path))
    assert spark.read.schema(d.schema).json(paths["jsonl"]).orderBy("id").collect() == d.collect()
    assert local.write_csv(d, str(tmp_path / "c")) == 2 and "é" in "".join(r[0] for r in spark.read.text(paths["jsonl"]).collect())
    assert json.loads(local.publication_metadata("t", "u/d"))["licenses"] == [{"name": "CC0-1.0"}]
    local.write_split(d, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'train'").count() == 2


def test_pipeline_runs_again_and_resumes(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = pages.select(F.col("page_id").alias("ord"), "url", F.lit("sitemap").alias("source"))
    p = Pipeline(spark, str(tmp_path), CurationConfig(session_id="s1", goal="g"))
    assert p.run(found, pages) == "completed"
    counts = p.counts()
    assert counts["discovery"] == 50 and counts["generation"] == counts["processing"] > 0
    rows, more = p.view("discovery", 3)
    assert rows.count() == 3 and more == 47 and local.written_bytes(spark, str(tmp_path)) > 0
    assert p.run(found, pages, start="processing", stop="quality") == "completed" and p.counts() == counts
    paused = Pipeline(spark, str(tmp_path), CurationConfig(session_id="s2"), post_stage=lambda s, d: s != "collection")
    assert paused.run(found, pages) == "paused" and set(paused.counts()) == {"discovery", "collection"}
    paused.post_stage = None
    assert paused.resume(found, pages) == "completed" and paused.counts()["quality"] == counts["quality"]
    silent = Pipeline(spark, str(tmp_path), CurationConfig(session_id="s3"), generator=None)
    assert silent.run(found, pages) == "completed" and "generation" not in silent.counts()


def test_streams(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = curation.stream_table(spark, str(tmp_path / "in"), d.schema, 1)
    curation.append_to(curation.chunked(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = d.select("doc_id", F.posexplode(chunks.chunks_fast(text.clean(F.coalesce("text", F.lit("")))))).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch


def test_sitemaps_nested_deep(spark):
    index = "<sitemapindex><sitemap><loc>https://a.com/%d.xml</loc></sitemap></sitemapindex>"
    rows = [(f"https://a.com/{i}.xml", 200, index % (i + 1)) for i in range(34)] + [("https://a.com/34.xml", 200, "<urlset><url><loc>https://a.com/p</loc></url></urlset>")]
    fetched = spark.createDataFrame(rows, "url string, status int, body string")
    assert [r.url for r in discovery.sitemap_closure(fetched, "https://a.com/0.xml").collect()] == ["https://a.com/p"]
