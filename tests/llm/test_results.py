"""Results against SQL, brute force, exact round trips and held-out accuracy."""

import glob
import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, op2_html, op4_embeddings, op6_setsketch, op7_substrings, op8_bpe, op10_lines, queries
from weftline.llm.common import table


def rows_of(df, columns):
    out = [tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in df.select(*columns).collect()]
    return sorted(out)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    rel = db.sql(queries.oracle_sql()[name])
    columns = sorted(rel.columns)
    want = sorted(tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in rel.project(",".join(columns)).fetchall())
    assert rows_of(queries.queries()[name](spark, sf), columns) == want


def test_languages_held_out(spark, sf):
    out = queries.queries()["op3_langid"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n and right / n > 0.95


def test_mixed_language_spans(spark, sf):
    from weftline.llm import op3_langid

    d = table(spark, sf, "documents")
    model = op3_langid.train(d.select("doc_id", "text", "lang"))
    parts = {lang: next(r.text for r in d.where(F.col("lang") == lang).orderBy("doc_id").collect() if len(r.text.split()) > 60).split()[:60] for lang in ("en", "de")}
    ((lang, score, spans),) = model.label([" ".join(parts["en"] + parts["de"][:30])])
    assert lang == "en" and 0.5 < score < 0.85
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[0]["words"] - 60) <= 2


def test_pages_against_articles(spark, sf):
    import html

    got = {r.page_id: r.text for r in queries.queries()["op2_html_text"](spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())


def test_pages_by_hand():
    page = """<html><head><title>T</title></head><body><header><a href=/>Site</a><ul class="menu"><li><a href=/a>A</a></ul></header>
<div id="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; tail</h1><p>By someone</p></header><p>First para<br>with a break.<p>Second <b>bold</b>&nbsp;one.
<aside>Related things</aside><form><label>Mail</label><button>Go</button></form><script>var x="<p>no</p>"</script><style>p{}</style><div class="ads">Buy</div>
<section class="comments"><h3>Comments</h3><p>Nice post, I liked it very much indeed.</p></section></article></main><div class=sidebar>More</div><footer>&copy; us</footer></body></html>"""
    assert op2_html.main_text(page) == "Head & tail First para with a break. Second bold one."
    plain = "<body><nav><a href=1>x</a> <a href=2>y</a></nav><div><p>%s</p><p>%s</p></div><footer>legal words</footer></body>" % (("A sentence of the text that goes on. " * 4).strip(), ("Another one that is just as long. " * 5).strip())
    assert op2_html.main_text(plain).startswith("A sentence of the text") and "legal" not in op2_html.main_text(plain)


def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        a, b = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(i, j, rng.random() * 2) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        cost = lambda s: sum(a[i] if s[i] else b[i] for i in range(n)) + sum(w for i, j, w in edges if s[i] != s[j])  # noqa: E731, B023
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(op2_html.min_cut(a, b, edges)) == pytest.approx(best, abs=1e-6)


def test_components_over_many_partitions(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)]
    want = {x: r for x, r in common.forest([e for e in edges if e[0] != e[1]]).items() if x != r}
    df = spark.createDataFrame(edges, "a long, b long")
    for per_part in (1_000_000, 40):
        assert dict(map(tuple, common.components(df, per_part).collect())) == want


def test_link_rounds_lose_nothing(spark, monkeypatch):
    """Points on a line link when near; sketches are coarse, buckets large enough for blocks, and only few pairs pass at first."""
    monkeypatch.setattr(common, "BLOCK", 16)
    monkeypatch.setattr(common, "SMALL", 6)
    monkeypatch.setattr(common, "TASK", 100)
    rng = random.Random(9)
    at = {i: rng.randint(0, 600) for i in range(300)}
    members = [(k, i) for i in at for k in range(4) if rng.random() < 0.4] + [(10 + i // 3, i) for i in at]
    sketches = spark.createDataFrame([(i, bytearray([p // 8])) for i, p in at.items()], "id long, sketch binary")
    pos = spark.createDataFrame(list(at.items()), "id long, p long")

    def likeness(x, y):
        d = np.abs(x[:, 0].astype(int) - y[:, 0].astype(int))
        return -d.astype(float), d <= 1

    def verify(pairs):
        x = pairs.join(pos.withColumnsRenamed({"id": "a", "p": "pa"}), "a").join(pos.withColumnsRenamed({"id": "b", "p": "pb"}), "b")
        return x.where("abs(pa - pb) <= 2").select("a", "b")

    keys = {k for k, _ in members}
    links = [(i, j) for k in keys for i, j in itertools.combinations([i for kk, i in members if kk == k], 2) if abs(at[i] - at[j]) <= 2]
    want = {x: r for x, r in common.forest(links).items() if x != r}
    got = common.linked_groups(spark.createDataFrame(members, "key long, id long"), sketches, likeness, verify, ((4, 1), (1, 1), (1, 2), (1, 4), (1, None)))
    assert dict(map(tuple, got.collect())) == want


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.9):
        n = 2000
        both = int(2 * n * share / (1 + share))
        x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        r = op6_setsketch.sketches([x[:n], x[n - both :], x], 2000)
        assert abs((r[0] == r[1]).mean() - share) < 0.05
        assert (op6_setsketch.merged(r[0], r[1]) == r[2]).all()


def test_collisions_reach_the_threshold():
    width, need = op4_embeddings.calibrated(0.95)
    rng = np.random.default_rng(2)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * side
    d = op4_embeddings.directions(64)
    i, j = op4_embeddings.tile_links(a, b, (a @ d).astype(np.float32), (b @ d).astype(np.float32), 0.95, width, need)
    assert (i == j).sum() == 2000


def removed_by_brute_force(texts):
    first, out = {}, {}
    for i, text in sorted(texts.items()):
        raw = text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def check_substrings(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in op7_substrings.repeated_bytes(df).collect():
        got[r.doc_id] = (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256)
    assert got == removed_by_brute_force(texts)


def test_substrings_of_the_tables(spark, sf):
    check_substrings(spark, {r.doc_id: r.text for r in table(spark, sf, "documents").collect()})


def test_substrings_of_hard_texts(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("ab é\n") for _ in range(3000))
    texts = {}
    for i in range(60):
        a = rng.randint(0, 2800)
        cut = base[a : a + rng.randint(20, 200)]
        texts[i] = "".join(rng.choice("abcxyz ") for _ in range(rng.randint(0, 90))) + cut + rng.choice(["", cut, base[:49], base[:50], "a" * rng.randint(40, 130)])
    monkeypatch.setattr(op7_substrings, "SEGMENT", 700)
    monkeypatch.setattr(op7_substrings, "SORT_BUCKET", 300)
    monkeypatch.setattr(op7_substrings, "BATCH_BYTES", 2000)
    check_substrings(spark, texts)


def test_bpe_round_trip(spark, sf):
    from tokenizers import Tokenizer

    path = op8_bpe.word_vocabulary()
    tok = Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b <|startoftext|>", "it's I'll don't 'stop !'s", "İstanbul ΣΑΣ é ñ́", "日本語 テキスト", "x" * 5000, "\x1c a\x85b\xa0c　d", "½²a_b-c", ""]
    texts = [r.text for r in table(spark, sf, "documents").collect()] + odd + [f"{chr(i)}a{chr(i)} {chr(i)}" for i in range(1, 0x250)]
    ids, decoded = op8_bpe.Coder(path).run(*common.text_buffer(pa.array(texts)))
    for text, i, d in zip(texts, ids, decoded, strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want and d.decode() == tok.decode(want, skip_special_tokens=False)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    if abs(len(a) - len(b)) > 40 or len(set(a.split()) & set(b.split())) < 2:  # farther than any threshold used here
        return 99
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fuzzy_lines(seed=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    base = [" ".join(word() for _ in range(40)) for _ in range(12)]
    out = {}
    for i in range(40):
        lines = []
        for line in rng.sample(base, 3):
            k = rng.randrange(len(line))
            lines.append(line if rng.random() < 0.5 else line[:k] + "z" + line[k + 1 :])
        out[i] = "\n".join([*lines, " ".join(word() for _ in range(40)), ""])
    return out


def lines_by_brute_force(texts, similarity=0.9):
    norm = {(i, n): " ".join(op10_lines.normal(line)) for i, t in texts.items() for n, line in enumerate(t.split("\n"))}
    some = {k: v for k, v in norm.items() if v}
    links = [(a, b) for a, b in itertools.combinations(sorted(some), 2) if edit_distance(some[a], some[b]) <= int(max(len(some[a]), len(some[b])) * (1 - similarity) + 1e-9)]
    roots = common.forest(links)
    return {i: "\n".join(line for n, line in enumerate(t.split("\n")) if roots.get((i, n), (i, n)) == (i, n)) for i, t in texts.items()}


def test_lines_against_brute_force(spark):
    texts = fuzzy_lines()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in op10_lines.without_lines(df).collect()}
    assert got == lines_by_brute_force(texts)


def within_edits(a, b, most):
    """Whether the edit distance is at most ``most``: a band of the table."""
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
        row = new
    return row.get(len(b), far) <= most


def edited_lines(n_words, seed=13):
    """Pairs of a line and a copy with a changed word, changed words near the limit of 0.9, or letters at random places up to it."""
    rng = random.Random(seed + n_words)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    out = []
    for kind in range(24):
        words = [word() for _ in range(n_words)]
        line = " ".join(words)
        left, other = int(len(line) * 0.1), list(words)
        for i in rng.sample(range(n_words), n_words) if kind % 3 else []:
            if len(words[i]) <= left and (kind % 3 == 2 or other == words):
                other[i], left = "".join(rng.choice("klmnop") for _ in words[i]), left - len(words[i])
        copy = list(" ".join(other))
        for i in rng.sample(range(len(copy)), left) if kind % 3 == 0 or other == words else []:
            copy[i] = "z"
        out.append((line, "".join(copy)))
    return out


@pytest.mark.parametrize("n_words", [4, 8, 12, 20, 40])
def test_lines_near_the_limit(spark, n_words):
    lines = [x for pair in edited_lines(n_words) for x in pair]
    norm = [" ".join(op10_lines.normal(x)) for x in lines]
    links = [(i, j) for i, j in itertools.combinations(range(len(norm)), 2) if within_edits(norm[i], norm[j], int(max(len(norm[i]), len(norm[j])) * 0.1 + 1e-9))]
    roots = common.forest(links)
    assert all(roots[i + 1] == i for i in range(0, len(lines), 2))
    got = {r.doc_id: r.text for r in op10_lines.without_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: "" if roots.get(i, i) != i else x for i, x in enumerate(lines)}


def test_no_link_fails_the_bounds():
    """Whatever is within the edit similarity passes the check before the edit distance."""
    for n_words in (4, 8, 12, 20, 40):
        pairs = [[" ".join(op10_lines.normal(x)) for x in pair] for seed in range(20) for pair in edited_lines(n_words, seed * 100)]
        x, y = (op10_lines.line_sketches([p[i] for p in pairs]) for i in (0, 1))
        assert op10_lines.near(x, y, 0.9).all()


def test_loss_is_what_the_mask_covers(spark, sf, monkeypatch):
    from weftline.llm import op5_chat

    whole = op5_chat.format_chats
    monkeypatch.setattr(op5_chat, "format_chats", lambda rows: whole(rows).withColumn("loss_spans", F.slice("loss_spans", 1, 0)))
    assert op5_chat.op5_chat_format(spark, sf).where("loss_chars <> 0").isEmpty()
