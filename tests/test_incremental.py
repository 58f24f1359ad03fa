"""Replays of batches, updates of buckets, thinking tags cut anywhere, counted sinks, stages and progress."""

import pytest
from pyspark.sql import functions as F

from weftline.config import CurationConfig
from weftline.functions import text
from weftline.plans.pipeline import Pipeline, process
from weftline.sinks import local
from weftline.streaming import incremental, thinking


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replayed_batches_change_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    known = spark.createDataFrame([("https://k.com/old",)], "url string")
    run = incremental.discover_batch(root, "s", known)
    one = spark.createDataFrame([(2, "https://a.com/1#x"), (1, "HTTPS://no"), (3, "a.com/1"), (4, "https://k.com/old"), (5, None)], "ord int, url string")
    two = spark.createDataFrame([(6, "https://a.com/1"), (7, "https://b.com/2?utm_source=q")], "ord int, url string")
    three = spark.createDataFrame([(8, "https://b.com/2")], "ord int, url string")
    for i, b in enumerate((one, two, three)):
        run(b, i)
    want = [(2, "https://a.com/1", 0), (7, "https://b.com/2", 1)]
    held = lambda: rows(spark.read.parquet(f"{root}/discovered").select("ord", "url", "batch_id"))
    assert held() == want
    for i, b in ((1, two), (0, one), (2, three), (1, two)):
        run(b, i)
    assert held() == want
    assert rows(incremental.merged_counters(spark, f"{root}/checkpoints")) == [("s", 2)]


def test_first_batch_without_rows(spark, tmp_path):
    run = incremental.discover_batch(str(tmp_path / "t"), "s")
    run(spark.createDataFrame([], "ord int, url string"), 0)
    run(spark.createDataFrame([(1, "https://a.com/1")], "ord int, url string"), 1)
    assert rows(spark.read.parquet(str(tmp_path / "t" / "discovered")).select("url", "batch_id")) == [("https://a.com/1", 1)]


def test_stream_restarts(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("https://a.com/"), (F.col("id") % 7).cast("string")).alias("url")).repartition(4).write.parquet(src)
    read = lambda: spark.readStream.schema("ord int, url string").option("maxFilesPerTrigger", 1).parquet(src)
    incremental.discover_stream(read(), root, "s").awaitTermination()
    spark.createDataFrame([(50, "https://a.com/3"), (51, "https://a.com/new")], "ord int, url string").write.mode("append").parquet(src)
    incremental.discover_stream(read(), root, "s").awaitTermination()
    got = [r.url for r in spark.read.parquet(f"{root}/discovered").collect()]
    assert sorted(got) == sorted([f"https://a.com/{i}" for i in range(7)] + ["https://a.com/new"])
    assert incremental.merged_counters(spark, f"{root}/checkpoints").first().discovered == 8


def test_updates_touch_their_buckets(spark, tmp_path):
    path = str(tmp_path / "d")
    incremental.bucketed(spark.range(100).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit(False).alias("scraped"), F.col("id").alias("n")), path, ["url"])
    files = lambda: {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    change = spark.createDataFrame([("u3", True), ("u3", False), ("u77", True), ("none", True)], "url string, scraped boolean")
    for _ in range(2):
        incremental.update_rows(change, path, ["url"])
    got = spark.read.parquet(path)
    assert sorted(r.url for r in got.where("scraped").collect()) == ["u3", "u77"] and got.count() == 100
    assert 0 < len({f.split('/')[-2] for f in before - files()}) <= 3


TEXTS = ["a<think>b</think>c<think>d", "plain", "<think></think>", "<<think>x</thi</think>y<", "<think>a<think>b</think></think>c", "</think><thin", "<think>open</think", ""]


@pytest.mark.parametrize("body", TEXTS)
def test_tags_cut_anywhere(spark, body):
    want = spark.createDataFrame([(body,)], "x string").select(text.split_thinking(F.col("x")).alias("s")).first().s
    cuts = [[body[:i], body[i:]] for i in range(len(body) + 1)] + [list(body)] + [[body[:i], body[i:j], body[j:]] for i in range(len(body)) for j in range(i, len(body))]
    for tokens in cuts:
        inside, held, content, thought = False, "", "", ""
        for t in tokens:
            inside, held, c, d = thinking.feed(inside, held, t)
            content, thought = content + c, thought + d
        content, thought = (content, thought + held) if inside else (content + held, thought)
        assert (content, thought) == (want.content, want.thinking)


def test_token_stream_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "stream_id int, pos int, token string, last boolean"
    tokens = [(i, p, c, p == len(b) - 1) for i, b in enumerate(TEXTS) for p, c in enumerate(b)]
    static = thinking.split_tokens(spark.createDataFrame(tokens, schema))
    for k in range(3):
        spark.createDataFrame([r for r in tokens if r[1] // 6 == k or (k == 2 and r[1] >= 18)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = thinking.split_tokens(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    whole = lambda df: {r.stream_id: (r.c, r.t) for r in df.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "").alias("c"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "thinking"))), lambda x: x["thinking"]), "").alias("t")).collect()}
    s = spark.createDataFrame([(i, b) for i, b in enumerate(TEXTS) if b], "stream_id int, x string").select("stream_id", text.split_thinking(F.col("x")).alias("s")).collect()
    want = {r.stream_id: (r.s.content, r.s.thinking) for r in s}
    assert whole(static) == want
    assert whole(spark.read.parquet(out)) == want


def test_counted_sinks(spark, tmp_path):
    d = spark.range(7).select(F.col("id"), F.array(F.struct(F.lit("user").alias("role"), F.lit("a\nb").alias("content"))).alias("messages"))
    told = {}
    local.export_all(d, str(tmp_path / "x"), progress=told.__setitem__)
    assert told == {"parquet": 7, "jsonl": 7, "csv": 7, "sharegpt": 7}
    assert local.write_jsonl(d.limit(0), str(tmp_path / "none")) == 0 and local.write_parquet(d.where("id > 5"), str(tmp_path / "p")) == 1


def test_stages_are_replaceable_and_told(spark, tmp_path):
    urls = spark.createDataFrame([(1, "https://a.com/1", "crawl"), (2, "https://a.com/2", "crawl")], "ord int, url string, source string")
    html = "<html><body><main><p>" + "Many words of a page that is rich in content. " * 20 + "</p></main></body></html>"
    fetched = spark.createDataFrame([(1, "https://a.com/1", html), (2, "https://a.com/2", html)], "page_id long, url string, html string")
    told = []
    first = lambda p, given: process(p.read("collection").where("page_id = 1"), p.cfg)
    p = Pipeline(spark, str(tmp_path), CurationConfig(session_id="s", goal="g"), stages={"processing": first}, progress=lambda *x: told.append(x))
    assert p.run(urls, fetched) == "completed"
    assert {r.page for r in p.read("processing").select(F.col("metadata.page_id").alias("page")).collect()} == {1}
    assert told[:2] == [("discovery", "table", 2), ("collection", "table", 2)] and told[2][:2] == ("processing", "table")
    assert {x[1] for x in told if x[0] == "export"} == {"parquet", "jsonl", "csv", "sharegpt"}
    assert spark.read.parquet(f"{tmp_path}/export_log").count() == 4
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path), stages={"nothing": first})


def test_stage_machine_counts_by_vocabulary(spark):
    from weftline.operators.chunks import vocabulary_counter

    path = "/opt/tokenizers/word_bpe_49k.json"
    count = vocabulary_counter(path)
    body = "\n\n".join(f"Paragraph {i} says something uncommonly wordy about antidisestablishmentarianism." for i in range(40))
    pages = spark.createDataFrame([(1, "u", "t", "", "", body)], "page_id long, url string, title string, author string, date string, markdown string")
    got = process(pages, CurationConfig(chunk_size=60, chunk_overlap=0, vocabulary=path)).collect()
    assert len(got) > 5 and all(r.token_count == count(r.content) for r in got)
    assert all(sum(count(p) for p in r.content.split("\n\n")) <= 60 for r in got)


def test_selection_of_a_page(spark):
    from weftline.operators import selection

    state = selection.start(spark.createDataFrame([(i, f"https://a.com/{'en' if i % 2 else 'fr'}/{i}") for i in range(200)], "ord int, url string"))
    seen = selection.filter_view(state, "/en/")
    off = selection.toggle(seen, "29-34", False, page=0)
    assert {r.ord for r in off.where("NOT selected").collect()} == {57, 59}
    on_second = selection.toggle(seen, "29-34", False, page=1)
    assert {r.ord for r in on_second.where("NOT selected").collect()} == {61, 63, 65, 67}
    assert selection.toggle(seen, "500", False).where("NOT selected").isEmpty() and selection.toggle(seen, "x", False) is seen
    assert {(r.ord, r.row) for r in selection.numbered(seen).where("row <= 2").collect()} == {(1, 1), (3, 2)}
    assert selection.numbered(seen).where("row IS NULL").count() == 100
    assert selection.chosen(off).count() == 198 and selection.chosen(selection.toggle_view(state, False)).count() == 200
    plan = off._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_scan_goes_on_where_it_ended(spark, tmp_path):
    from weftline.sources import tables

    src, out, log = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "log"
    log.mkdir()

    def fetcher(url):
        import os
        import uuid

        if "bad" in url:
            raise OSError("down")
        (log / uuid.uuid4().hex).write_text(f"{os.getpid()} {url}")
        return 200, "text/html", url.upper()

    put = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("https://h"), (F.col("id") % 3).cast("string"), F.when(F.col("id") == 5, "bad").otherwise(""), F.lit(".com/"), F.col("id").cast("string")).alias("url")).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(src)
    put(0, 10)
    tables.scan_stream(read(), fetcher, out, str(tmp_path / "ck"), rate=1000.0, attempts=2, wait=0.0).awaitTermination()
    put(10, 16)
    tables.scan_stream(read(), fetcher, out, str(tmp_path / "ck"), rate=1000.0, attempts=2, wait=0.0).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert len(got) == len({r.url for r in got}) == 16 and [r.error for r in got if r.status is None] == ["OSError: down"]
    calls = [f.read_text().split()[1] for f in log.iterdir()]
    assert len(calls) == len(set(calls)) == 15
    # one batch's addresses of a host are in one task
    rows = tables.scan(spark.read.parquet(src), fetcher).withColumn("task", F.spark_partition_id()).withColumn("host", F.substring_index("url", "/", 3))
    assert rows.groupBy("host").agg(F.count_distinct("task").alias("n")).where("n > 1").isEmpty()
