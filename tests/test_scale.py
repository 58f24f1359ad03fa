"""Chunk pointers, radix selection, running sums, review waves and crawls of many seeds against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import chunks, packing, relational, review, selecting
from weftline.sources import discovery


@pytest.mark.parametrize("size, overlap", [(10, 0), (10, 4), (7, 7), (3, 1), (64, 16)])
def test_packed_is_split_text(spark, size, overlap):
    rng = random.Random(size * 100 + overlap)
    words = ["a", "bb", "c.", "d!", "1234567", "--", "e", "\x07", "é"]
    texts = ["", None, " \n\n ", "one", "\x07\n\n\x07\n\nword", "w " * 500, ". ".join(["s t u"] * 200)]
    texts += ["\n\n".join(" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 60))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {}
    for r in packing.packed(df, "doc", "text", size, overlap).collect():
        got.setdefault(r.doc, {})[r.chunk_index] = r.content
    for i, t in enumerate(texts):
        want = chunks.split_text(t, size, overlap)
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want
        assert sorted(got.get(i, {})) == list(range(len(want)))


def test_packed_refuses_and_stays_in_catalyst(spark):
    df = spark.createDataFrame([(1, "x")], "doc int, text string")
    with pytest.raises(ValueError):
        packing.packed(df, "doc", size=5, overlap=6)
    assert packing.packed(df.limit(0), "doc").collect() == []
    plan = packing.packed(df, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("few", [4, 4096])
def test_smallest(spark, few):
    rng = random.Random(1)
    ids = [rng.randint(0, 300) for _ in range(500)] + [7] * 90
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id int, row int")
    key = F.md5(F.col("id").cast("string").cast("binary"))
    ranks = sorted((__import__("hashlib").md5(str(i).encode()).hexdigest(), i) for i in ids)
    for k in (0, 1, 17, 295, 589, 590, 700):
        out = selecting.smallest(df, k, key, [F.col("id")], "taken", few)
        taken = sorted((__import__("hashlib").md5(str(r.id).encode()).hexdigest(), r.id) for r in out.where("taken").collect())
        assert taken == ranks[:k] and out.count() == len(ids)
    assert not selecting.smallest(df.limit(0), 0, key, []).where("taken").count()


def test_split_has_no_range_sort(spark):
    d = spark.range(1000).withColumnRenamed("id", "key")
    out = relational.exact_split(d, "key", 0.1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.where("split = 'validation'").count() == 100
    assert "rangepartitioning" not in plan.split("Union")[0] or "_place" in plan


def test_sum_before(spark):
    rows = [(i, (i * 37) % 11, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g int, v long").repartition(7)
    got = {r.id: r.s for r in relational.sum_before(df, [F.col("g"), F.col("id")], "v", "s").collect()}
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i], total = total, total + v
    assert got == want
    assert relational.sum_before(df.limit(0), [F.col("id")], "v", "s").count() == 0


@pytest.mark.parametrize("wave", [1, 3, 100])
def test_review_waves_equal_one_by_one(spark, wave):
    rows = [(i, [("user", f"q{i}"), ("assistant", "x" * (i % 9))]) for i in range(53)]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>")

    def rater(system, prompt):
        if len(prompt) % 3 == 0:
            raise RuntimeError("no")
        return "[5, 1, 2, 3]", len(prompt) / 1024

    prompts = [r.prompt for r in review.batch_prompts(review.batches(df, 4)).orderBy("batch").collect()]
    spent, want = 0.0, {}
    for b, p in enumerate(prompts):
        if spent >= 1.0:
            break
        want[b] = 0.0 if len(p) % 3 == 0 else len(p) / 1024
        spent += want[b]
    got = review.review(df, rater, cap=1.0, size=4, wave=wave).collect()
    assert {r.id // 4: r.cost for r in got if r.reviewed} == want and 1 < len(want) < len(prompts)


def plain_crawl(pages, links, seed, most, depth):
    from collections import deque

    out, seen, queue = [], set(), deque([(seed, 0)])
    host = seed.split("/")[2].removeprefix("www.")
    while queue and len(out) < most:
        u, d = queue.popleft()
        if u in seen:
            continue
        seen.add(u)
        if u not in pages:
            continue
        out.append((u, d, len(out) + 1))
        if d < depth:
            queue.extend((v, d + 1) for v in links.get(u, []) if v.split("/")[2].removeprefix("www.") == host and v not in seen)
    return out


@pytest.mark.parametrize("most, depth", [(50, 3), (4, 3), (1, 2), (9, 5), (50, 0)])
def test_crawl_of_many_seeds(spark, most, depth):
    rng = random.Random(most * 10 + depth)
    names = [f"https://{h}.com/{i}" for h in ("a", "b", "www.a") for i in range(25)]
    good = {u for u in names if rng.random() < 0.8}
    graph = {u: rng.choices(names, k=rng.randint(0, 5)) for u in names}
    pages = spark.createDataFrame([(u, 200 if u in good else 500, "text/html") for u in names], "url string, status int, content_type string")
    links = spark.createDataFrame([(u, i, v) for u, vs in graph.items() for i, v in enumerate(vs)], "src string, pos int, dst string")
    seeds = [names[0], names[1], names[30], "https://none.com/x", names[60]]
    got = discovery.crawl_many(pages, links, spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], "seed string"), most, depth).collect()
    for s in seeds:
        assert sorted((r.visit, r.url, r.depth) for r in got if r.seed == s) == [(v, u, d) for u, d, v in plain_crawl(good, graph, s, most, depth)]
    assert sorted((r.visit, r.url) for r in discovery.crawl(pages, links, seeds[0], most, depth).collect()) == [(v, u) for u, _, v in plain_crawl(good, graph, seeds[0], most, depth)]
