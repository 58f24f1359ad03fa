"""Parts of the engine that no query covers: retries, reviews, raw pages, logs, streams, table functions."""

import re

import pytest
from pyspark.sql import functions as F

from weftline.config import CurationConfig
from weftline.functions import text
from weftline.functions.generated import thinking_budget
from weftline.operators import chunks, generate, review
from weftline.plans.pipeline import Pipeline, explore, status
from weftline.schemas import MESSAGES
from weftline.sinks import local
from weftline.sources import discovery, tables, throttle
from weftline.storage import shared_dir
from weftline.streaming import curation


def test_backoff():
    assert [tables.backoff(i, 2.0, 30.0) for i in range(1, 7)] == [2.0, 4.0, 8.0, 16.0, 30.0, 30.0]


def test_retries_and_error_classes(spark):
    def get(url):
        raise OSError("down")

    got = tables.fetch(spark.createDataFrame([("https://a",)], "url string"), get, attempts=2, wait=0.01).collect()
    assert [(r.status, r.error) for r in got] == [(None, "OSError: down")]
    said = {"key": "bad API key", "net": "cannot connect", "odd": "strange"}

    def fail(system, user):
        raise RuntimeError(said[user])

    d = spark.createDataFrame([(i, "s", u) for i, u in enumerate(said)], "chunk_id long, system string, user string")
    got = {r.user: r.error_class for r in generate.complete(d, fail, wait=0.0).collect()}
    assert got == {"key": "credentials", "net": "connection", "odd": "other"}
    total = generate.usage(generate.complete(d, lambda s, u: (u, 3, 2, 0.25))).first()
    assert tuple(total) == (3, 9, 6, 0.75, 0)


def test_review_pass(spark):
    rows = [(i, [("user", f"q{i}"), ("assistant", "a")], 0.5, False) for i in range(12)]
    d = spark.createDataFrame(rows, f"id long, messages {MESSAGES}, quality_score double, approved boolean")

    def rater(system, prompt):
        if "q5" in prompt:
            raise ValueError("no")
        return "[5, 4, 1]" if prompt.startswith("Rate these 3") else "[5, 4, 1, 1, 9]", 0.4

    got = {r.id: r for r in review.review(d, rater, cap=0.5, size=3).collect()}
    assert [got[i].score for i in range(6)] == [5, 4, 1, 3, 3, 3]  # the second call fails, at no cost
    assert [got[i].score for i in range(6, 12)] == [5, 4, 1, None, None, None] and got[11].quality_score == 0.5
    assert got[0].approved and not got[2].approved and not got[11].approved and not got[11].reviewed
    report = review.score_report(review.review(d, rater, cap=9.0, size=3)).orderBy("score").collect()
    assert [(r.score, r.n) for r in report] == [(1, 3), (2, 0), (3, 3), (4, 3), (5, 3)] and report[0].mean == pytest.approx(39 / 12)
    assert review.review(d.limit(0), rater).collect() == []


def test_raw_pages_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "# A\n\ntext\n"), (2, ""), (3, None)], "page_id long, markdown string")
    local.write_raw_pages(pages, str(tmp_path / "raw"))
    assert {r.page_id: r.markdown for r in tables.raw_pages(spark, str(tmp_path / "raw")).collect()} == {1: "# A\n\ntext\n", 2: "", 3: ""}
    local.write_jsonl(pages, str(tmp_path / "d.jsonl"))
    assert tables.json_dataset(spark, str(tmp_path / "d.jsonl"), "page_id long, markdown string").count() == 3
    (tmp_path / "urls.txt").write_text("# mine\nhttps://a.com/x\n\nno\n")
    assert [r.url for r in discovery.read_url_file(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.com/x"]
    records = spark.createDataFrame([(1, (7, 0)), (2, (7, 1)), (3, (8, 0))], "chunk_id long, metadata struct<page_id:long,chunk_index:int>")
    local.write_chunks_by_page(records, str(tmp_path / "chunks"))
    assert {p.name for p in (tmp_path / "chunks").glob("page=*")} == {"page=7", "page=8"}
    local.write_metadata(spark, str(tmp_path / "meta"), "t", "u/d")
    assert "CC0-1.0" in "".join(r[0] for r in spark.read.text(str(tmp_path / "meta")).collect())


def test_export_log_and_reports(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = pages.select(F.col("page_id").alias("ord"), "url", F.lit("sitemap").alias("source"))
    p = Pipeline(spark, str(tmp_path), CurationConfig(session_id="s1", goal="g"))
    assert p.run(found, pages) == "completed"
    log = spark.read.parquet(f"{tmp_path}/export_log").collect()
    assert {r.format for r in log} == {"jsonl", "parquet", "csv", "sharegpt"} and all(re.fullmatch(r"\d{8}_\d{6}", r.run_stamp) for r in log)
    urls = spark.createDataFrame([(1, "s1", "https://a"), (2, "s2", "https://b")], "id long, session_id string, url string")
    local.append_table(urls, str(tmp_path), "discovered_url")
    local.append_table(urls.where("id = 1").withColumn("id", F.lit(3).cast("long")), str(tmp_path), "discovered_url")
    assert {r.id for r in tables.session_table(spark, str(tmp_path), "discovered_url", "s1").collect()} == {1, 3}
    assert tables.session_table(spark, str(tmp_path), "discovered_url").count() == 3
    s = spark.createDataFrame([("a", "paused"), ("b", "active"), ("c", "paused")], "id string, status string")
    assert {(r.status, r.n, r.total, r.paused) for r in status(s).collect()} == {("paused", 2, 3, 2), ("active", 1, 3, 2)}
    fetched = spark.createDataFrame([("https://a.com/s.xml", 200, "<urlset><url><loc>https://a.com/x</loc></url><url><loc>https://a.com/y</loc></url></urlset>")], "url string, status int, body string")
    assert [r.url for r in explore(fetched, "https://a.com/s.xml", "/x").collect()] == ["https://a.com/x"]


def test_small_functions(spark):
    d = spark.createDataFrame([(500,), (5000,), (90_000,)], "n long")
    assert [r[0] for r in d.select(thinking_budget(F.col("n"))).collect()] == [1024, 4000, 8000]
    ((squeezed,),) = spark.createDataFrame([("a  b\t c",)], "t string").select(text.squeeze(F.col("t"))).collect()
    assert squeezed == "a b c"
    slept = []
    get = throttle.throttled(lambda u: (200, "text/html", u), rate=1000.0)
    slept += [get(f"https://a.com/{i}")[2] for i in range(3)]
    assert len(slept) == 3


def test_vocabulary_counts_and_table_function(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    count = chunks.vocabulary_counter(path)
    body = "\n\n".join(f"A paragraph number {i} with unusualish wordings." for i in range(12))
    df = spark.createDataFrame([(1, body)], "id long, text string")
    ((got,),) = df.select(chunks.chunks_fast(F.col("text"), 30, 0, vocabulary=path)).collect()
    assert got == chunks.split_text(body, 30, 0, count=count) and all(count(c) <= 30 for c in got)
    chunks.register_chunks(spark)
    df.createOrReplaceTempView("chunk_docs")
    rows = spark.sql("SELECT id, chunk_index, content FROM chunk_docs, LATERAL chunks(text, 20, 0)").orderBy("chunk_index").collect()
    assert [r.content for r in rows] == chunks.split_text(body, 20, 0)


def finished(query):
    query.awaitTermination()


def test_counter_and_usage_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = curation.stream_table(spark, str(tmp_path / "in"), e.schema, 1)
    finished(curation.counters(stream, "user_id", ["event_id"]).writeStream.format("memory").queryName("maxima").outputMode("complete").trigger(availableNow=True).start())
    assert spark.table("maxima").count() == e.select("user_id").distinct().count()
    finished(curation.usage(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start())
    assert spark.table("hours").agg(F.sum("n")).first()[0] == e.count()


def test_token_bucket_stream(spark, tmp_path):
    rows = [("a", i * 0.0) for i in range(6)] + [("b", 0.0), ("a", 60.0)]
    d = spark.createDataFrame(rows, "host string, s double").select("host", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = curation.stream_table(spark, str(tmp_path / "in"), d.schema, 1)
    curation.append_to(curation.paced(stream, 2.0), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r.host, r.delay) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0.0)] * 5 + [("a", 0.5), ("a", 1.0), ("b", 0.0)]


def test_shared_folder_is_asked_for():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://cluster:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
