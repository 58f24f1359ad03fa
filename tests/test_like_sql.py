"""Queries against their SQL on small tables that hold what the given ones lack."""

import duckdb

import __spark_entry__


def alike(spark, folder, name, table, rows, schema):
    """Rows of the query, which are those of its SQL."""
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    df = __spark_entry__.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = db.sql(__spark_entry__.oracle_sql()[name]).project(",".join(f'"{c}"' for c in columns)).fetchall()
    got = df.select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return got


PAGES = "page_id long, url string, html string"


def test_candidates_count_references_as_written(spark, tmp_path):
    page = "<html><body><article><p>{}</p></article></body></html>"
    texts = ["a&amp;" * 100, "a&amp;" * 80, "word " * 101, "<b>x </b> " * 200, "a" * 501]
    rows = [(i, f"https://e.com/{i}", page.format(t)) for i, t in enumerate(texts)]
    assert {r.page_id: r.candidate for r in alike(spark, tmp_path, "q29_spa_candidate", "pages", rows, PAGES)} == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_references_without_semicolon_stay(spark, tmp_path):
    page = "<html><head><title>{0}</title></head><body><article><p>{0}</p></article></body></html>"
    texts = ["this &amp; that &amp", "&ampere; &lt", "a &copy b &copy; c", "&"]
    rows = [(i, f"https://e.com/{i}", page.format(t)) for i, t in enumerate(texts)]
    got = {r.page_id: r.title for r in alike(spark, tmp_path, "q57_html_extract", "pages", rows, PAGES)}
    assert got == {0: "this & that &amp", 1: "&ampere; &lt", 2: "a &copy b © c", 3: "&"}


def test_dispatch_of_pages_that_share_an_address(spark, tmp_path):
    hosts = ["a.example.org", "ab.example.org", "abc.example.org", "abcd.example.org"]
    rows = [(4 * k + i, f"https://{h}/p/{k % 2}#1", "") for k in range(3) for i, h in enumerate(hosts)]
    assert len(alike(spark, tmp_path, "q91_dispatch", "pages", rows, PAGES)) == 10


def test_stages_of_pages_that_share_an_address(spark, tmp_path):
    rows = [(i, f"https://e.com/{i % 3}#top", "") for i in range(7)]
    got = {r.stage: r.n for r in alike(spark, tmp_path, "q99_stage_machine", "pages", rows, PAGES)}
    assert got["discovery"] == got["quality"] == 7


DOCUMENTS = "doc_id long, text string, source string"
#: Blank and null texts, white space and numbers beyond ASCII, control signs, no doc_id.
ODD_TEXTS = [
    (0, "a b. " * 200, "s"), (1, "", "s"), (2, " \n ", "t"), (3, None, "u"), (4, "x y. " * 140 + "z. w   " * 90, "s"),
    (5, "x\x01y. " * 140 + "\x0b. \x0c \x85. " * 60, "t"), (6, "½ ² Ⅷ 1234 x²y. " * 60, None), (None, "x y. " * 150, "s"), (None, "", "v"),
]


def test_chunk_counts_of_odd_texts(spark, tmp_path):
    twice = [(7, "x " * 200 + "z. " + "y " * 200, "s")] * 2
    got = {r.doc_id: r.n_chunks for r in alike(spark, tmp_path, "q12_chunk_counts_no_overlap", "documents", [*ODD_TEXTS, (3, None, "u"), *twice], DOCUMENTS)}
    assert got[7] == 2
    assert got[1] == got[2] == got[3] == got[None] == 1


def test_chunk_records_of_odd_texts(spark, tmp_path):
    got = {r.chunk_id: r.tokens for r in alike(spark, tmp_path, "q13_chunk_records", "documents", ODD_TEXTS, DOCUMENTS)}
    assert (got[10000], got[20000], got[30000]) == (0, 0, None)


def test_lineage_of_odd_texts(spark, tmp_path):
    got = {r.source: (r.docs, r.chunks) for r in alike(spark, tmp_path, "q34_lineage", "documents", [*ODD_TEXTS, (3, None, "u"), (3, None, "v"), *[(7, "x " * 200 + "z. " + "y " * 200, "w")] * 2], DOCUMENTS)}
    assert got["w"] == (1, 2)
    assert got["u"] == got["v"] == (1, 1)
