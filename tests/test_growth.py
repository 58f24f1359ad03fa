"""What a step holds or writes does not grow with the rows or the length of its texts."""

import pyarrow as pa

from weftline import batches
from weftline.functions import markup, text
from weftline.operators import generate
from weftline.sinks import local
from weftline.sources import tables
from weftline.streaming import thinking


def test_runs_are_bounded_by_bytes():
    texts = pa.array(["x" * 30, None, "", "é" * 200, "y"] * 50)
    got = []
    kept = batches.mapped(lambda t: got.append(t) or t, pa.string(), texts)
    assert kept.equals(texts) and len(got) == 1
    pieces = list(batches.runs(batches.text_bytes(texts), 450))
    assert sum(n for _, n in pieces) == 250 and max(batches.text_bytes(texts.slice(*p)).sum() for p in pieces) <= 450
    assert list(batches.runs(batches.text_bytes(pa.array(["z" * 9, "a", "b"])), 4)) == [(0, 1), (1, 2)]
    assert len(batches.mapped(lambda t: t, pa.string(), pa.array([], pa.string()))) == 0


def test_completions_come_out_by_bytes(spark):
    """Prompts that fill a run each."""
    d = spark.range(0, 5, 1, 1).selectExpr("cast(id AS int) AS chunk_id", "'s' AS system", f"repeat('x', {batches.MOST}) AS user")
    said = generate.complete(d, lambda s, u: (u[:3], len(u), 1, 1))
    assert {(r.chunk_id, r.raw, r.prompt_tokens) for r in said.collect()} == {(i, "xxx", batches.MOST) for i in range(5)}
    assert "MapInArrow" in said._jdf.queryExecution().executedPlan().toString()


def test_usage_of_long_prompts(spark):
    d = spark.range(0, 6, 1, 1).selectExpr("id AS chunk_id", "'s' AS system", f"repeat('é', {batches.MOST} + cast(id AS int)) AS user")
    said = generate.complete(d, lambda s, u: (u[:1], len(u), 2, 0.5))
    got = generate.usage(said).first()
    assert (got.calls, got.prompt_tokens, got.completion_tokens, got.cost_usd, got.errors) == (6, 6 * batches.MOST + 15, 12, 3.0, 0)
    assert "MapInPandas" not in said._jdf.queryExecution().executedPlan().toString()


def test_pages_share_files(spark, tmp_path):
    pages = spark.range(0, 300, 1, 2).selectExpr("id AS page_id", "concat('# ', id, '\n\n', 'x\n') AS markdown")
    path = tmp_path / "raw"
    local.write_raw_pages(pages, str(path))
    assert len([p for p in path.rglob("*") if p.is_file() and p.name[0] not in "._"]) == 2  # one of each task
    assert sorted((r.page_id, r.markdown) for r in tables.raw_pages(spark, str(path)).collect()) == [(i, f"# {i}\n\nx\n") for i in range(300)]
    (path / "own.txt").write_text("mine\n")
    assert {(r.page_id, r.markdown) for r in tables.raw_pages(spark, str(path)).collect()} >= {(None, "mine"), (7, "# 7\n\nx\n")}
    (tmp_path / "loose" / "page_id=4").mkdir(parents=True)
    (tmp_path / "loose" / "page_id=4" / "a.md").write_text("four")
    assert [(r.page_id, r.markdown) for r in tables.raw_pages(spark, str(tmp_path / "loose")).collect()] == [(4, "four")]


def test_streams_of_a_task_in_one_call(spark):
    parts = ["a<th", "ink>b", None, "</thi", "nk>c<"]
    rows = [(k, p, t, p == 4 and k != 3) for p, t in enumerate(parts) for k in (1, None, 2, 3)]
    out = thinking.split_tokens(spark.createDataFrame(rows, "stream_id int, pos int, token string, last boolean").repartition(3))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    said = {}
    for r in sorted(out.collect(), key=lambda r: r.pos):
        content, thought = said.get(r.stream_id, ("", ""))
        said[r.stream_id] = content + r.content, thought + r.thinking
    assert said == {1: ("ac<", "b"), 2: ("ac<", "b"), 3: ("ac", "b"), None: ("ac<", "b")}


def test_pages_by_bytes():
    got = markup._extract(pa.array(["<title>a</title><p>b", None]), pa.array(["https://e.com/x", None])).to_pylist()
    assert [(x["title"], x["text"], x["links"]) for x in got] == [("a", "a\nb", []), ("", "", [])]


def test_cleaning_by_bytes():
    assert text._nfkc(pa.array(["ﬁne", None, "", "ｆ①"])).to_pylist() == ["fine", None, "", "f1"]
