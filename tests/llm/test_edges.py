"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import op1_topk, op2_html, op3_langid, op4_embeddings, op5_chat, op6_setsketch, op7_substrings, op8_bpe, op9_mix, op10_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = words(1, 20_000)
    rows = [
        (1, words(2, 80), "en", "a", 1),
        (2, words(2, 80), "en", "a", 1),
        (3, words(2, 79) + " changed", "fr", None, 1),
        (4, None, None, "b", None),
        (5, "", "en", "b", 0),
        (6, " \n\t ", "en", None, 3),
        (7, long, "en", "a", len(long)),
        (8, long + " tail", "fr", "c", 1),
        (9, "one two", "en", "c", 7),
        (9, "one two", "en", "c", 7),
        (None, words(2, 80), "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_top_k(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], None), (3, None, 1), (4, [0.1, None], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (1, [0.5, 0.5], 1), (50, [1.0, 0.0], 2)]
    v = op1_topk.clean_vectors(spark.createDataFrame(rows, ddl))
    got = [tuple(r) for r in op1_topk.top_k(v, v.where("vec_id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 128 * 256), (0, 2, 1, 128 * 128 + 64 * 128), (50, 1, 0, 256 * 128), (50, 2, 1, 256 * 128)]
    none = op1_topk.clean_vectors(spark.createDataFrame([], ddl))
    assert op1_topk.top_k(none, none, 2).collect() == []


def test_near_vectors(spark):
    ddl = "vec_id long, embedding array<float>, n_links long"
    rows = [(3, [1.0, 0.0], 7), (1, [2.0, 0.0], 7), (2, [1.0, 0.1], 7), (4, [0.0, 1.0], 7), (5, None, 7), (6, [0.0, 0.0], 7), (7, [1.0, None], 7), (8, [1.0, 0.0], 7), (8, [1.0, 0.0], 7), (None, [1.0, 0.0], 7), (9, [1.0, 0.0, 0.0], 7)]
    got = sorted((tuple(r) for r in op4_embeddings.near_vectors(spark.createDataFrame(rows, ddl)).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 4, 1, False), (8, 4, 1, False), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert op4_embeddings.near_vectors(spark.createDataFrame([], ddl)).collect() == []


def test_pages(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain words without any markup, but a sentence that is long enough to read, is it not, dear reader of pages.", "x"), (3, "<p>", "y")]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in op2_html.extract(spark.createDataFrame(rows, "page_id long, html string, url string")).collect()}
    assert got[(1, "x")] == got[(2, "x")] == got[(3, "y")] == ("", 0)
    assert got[(3, "x")][0].startswith("plain words")
    clash = spark.createDataFrame([(1, "<article>a &amp; b</article>", "old")], "page_id long, html string, text string")
    assert [tuple(r) for r in op2_html.extract(clash).collect()] == [(1, "a & b", 5)]


def test_languages(spark, docs, none):
    model = op3_langid.train(docs.select("doc_id", "text", "lang"))
    out = op3_langid.identify(docs.withColumn("score", F.lit("clash")), model)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 11
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert op3_langid.train(none.select("doc_id", "text", "lang")) is None
    assert op3_langid.identify(none, None).collect() == []
    assert {r.lang_pred for r in op3_langid.identify(docs, None).collect()} == {"und"}


def test_chats(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (2, None, "user", "a"), (2, 0, "assistant", "x<~|y<|nl|>"), (2, 0, "assistant", "x<~|y<|nl|>"), (3, 0, "ro\nle", "<|im_end|>\n<|im_start|>user\nhi"), (None, 0, "user", "u")]
    out = op5_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.collect()}
    assert len(got) == 4 and all(r.round_trip for r in got.values())
    assert got[3].formatted.startswith("<|escaped|>")
    for r in got.values():
        said = [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss_spans]
        assert said == [t.text for t in r.turns if t.role == "assistant"]
    assert op5_chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_near_documents(docs, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op6_setsketch.near_documents(docs.withColumn("n", F.lit(1)), 85).collect()), key=str)
    by = {x[0]: x for x in got}
    assert [by[i][2] for i in (1, 2, 3)] == [1, 1, 1] and [by[i][3] for i in (1, 2, 3)] == [True, False, False]
    assert [by[i][1:] for i in (4, 5, 6)] == [(0, i, True) for i in (4, 5, 6)]
    assert (by[7][2], by[8][2]) == (7, 7) and by[9][1:] == (1, 9, True) and by[None][2] is None
    assert len(got) == 11 and op6_setsketch.near_documents(none).collect() == []


def test_substrings(docs, none):
    rows = op7_substrings.repeated_bytes(docs.select("doc_id", "text")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and by[1].spans == [] and by[None].spans == []
    assert [tuple(s) for s in by[2].spans] == [(0, by[2].n_bytes)]
    assert [tuple(s) for s in by[8].spans] == [(0, by[7].n_bytes)]
    assert by[4].n_bytes == by[5].n_bytes == 0 and by[9].spans == []
    assert op7_substrings.repeated_bytes(none.select("doc_id", "text")).collect() == []


def test_bpe(docs, none):
    path = op8_bpe.word_vocabulary()
    out = op8_bpe.encode(docs.withColumn("ids", F.lit("clash")), path)
    rows = out.collect()
    assert len(rows) == 11 and {len(r.ids) for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert op8_bpe.encode(none, path).collect() == []


def test_mix(docs, none):
    d = op9_mix.mix(docs.withColumn("w", F.lit("clash")), op9_mix.n_words(F.col("text"))).collect()
    assert len(d) == 11 and all(0 <= r.taken <= 2 * r["size"] for r in d)
    assert {r.source for r in d} == {"a", "b", "c", None}
    assert op9_mix.mix(none, op9_mix.n_words(F.col("text"))).collect() == []
    assert op9_mix.mixed(none).collect() == []
    stream = op9_mix.mixed(docs).collect()
    assert [r.position for r in stream] == sorted(r.position for r in stream)


def test_lines(spark, none):
    ddl = "doc_id long, text string, n_lines string"
    same = "This is a line that stands in many texts, word for word"
    rows = [(1, f"{same}\nfirst own line\n", "c"), (2, f"second own words\n{same.upper()}!\n\n", "c"), (3, None, "c"), (4, "", "c"), (5, "\n \n", "c"), (6, f"{same}\n{same}", "c"), (7, f"{same}s", "c"), (None, same, "c"), (8, words(5, 30_000), "c")]
    got = {r.doc_id: r for r in op10_lines.without_lines(spark.createDataFrame(rows, ddl)).collect()}
    assert len(got) == 9
    assert got[1].text == f"{same}\nfirst own line\n" and got[2].text == "second own words\n\n"
    assert got[3].text is None and got[3].n_lines == 0 and (got[4].text, got[4].n_lines) == ("", 1) and got[5].text == "\n \n"
    assert (got[6].text, got[6].n_removed) == ("", 2) and got[7].n_removed == 1 and got[None].text == same and got[8].n_removed == 0
    assert op10_lines.without_lines(none.select("doc_id", "text")).collect() == []
