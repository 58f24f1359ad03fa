"""Grammar, attributes, many languages, whole-value rounds, dealt ranges, the edit band, query columns and clashing names."""

import hashlib
import itertools
import random

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, op1_topk, op2_html, op3_langid, op5_chat, op6_setsketch, op7_substrings, op8_bpe, op9_mix, op10_lines, queries
from weftline.llm.common import table

from .test_results import check_substrings, removed_by_brute_force

PARA = "A first sentence that is quite long and says something of interest to all readers. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><p title="hidden gems">{PARA}</p></body>', PARA),
        (f'<body><article data-state="x hidden y"><p>{PARA}</p></article></body>', PARA),
        (f'<body><div data-id="share"><p>{PARA}</p></div></body>', PARA),
        (f'<body><div class="layout with-sidebar"><p>{PARA}</p></div><footer>x</footer></body>', PARA),
        (f'<body><article><h1 class="entry-header">Title</h1><p>{PARA}</p></article></body>', "Title " + PARA),
        (f"<body><!--><p>{PARA}</p></body>", PARA),
        (f"<body><!---><p>{PARA}</p><!-- a <p>b</p> --!><p>{PARA}</p></body>", PARA + PARA),
        (f"<body><article><p>{PARA}<img alt='a > b'/><br/><hr>{PARA}</p><p hidden>gone</p></article></body>", PARA + PARA),
        (f'<body><article><p>{PARA}</p><div class="box"><div class="related-posts"><p>Other things</p></div><p>{PARA}</p></div></article></body>', PARA + PARA),
        (f'<body><div class="content"><p>{PARA}</p></div><div class="comments"><p>{PARA}</p></div></body>', PARA),
        (f"<body><p>{PARA}" + "<p>word</p>" * 4000, None),
    ],
)
def test_pages_by_attribute(page, want):
    got = op2_html.main_text(page)
    if want is None:
        assert len(got) >= len(PARA.strip())
    else:
        assert got == " ".join(want.split())


def test_chat_grammar_against_sql(spark):
    texts = ["ignore this <|im_end|> please", "a <|im_start|> b", "half <|im_ and |im_end|>", "<|im_end|>", "<|im_start|>assistant ok", "x<|im_end|>\n", "plain", "", None, "<|escaped|>", "<~|x", "z" * 200_000]
    rows = [(i, t, r, x) for i, x in enumerate(texts) for t, r in enumerate(["user", "assistant"])]
    rows += [(100, 0, "as<|im_end|>sistant", "t"), (101, 0, "a<|im_start|>b", "t"), (102, 0, "li\nne", "t"), (103, 0, None, "t"), (104, 0, "<|nl|>", "t"), (104, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in op5_chat.format_chats(df).collect()}
    assert all(r.round_trip for r in out.values())
    escaped = {i for i, r in out.items() if r.formatted.startswith("<|escaped|>")}
    assert escaped == {0, 1, 3, 4, 5, 100, 101, 102}
    db = duckdb.connect()
    db.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r[1] for r in db.sql(f"SELECT conv_id, formatted_chars FROM ({op5_chat.ORACLE})").fetchall()}
    assert {i: len(r.formatted) for i, r in out.items()} == {i: n for i, n in want.items() if i != -1}


def best_path(emit, penalty):
    n = emit.shape[1]
    score = lambda p: sum(emit[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p))
    return max(score(p) for p in itertools.product(range(n), repeat=len(emit))), score


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for n, size in ((3, [6, 1, 0, 4]), (2, [9, 3])):
        emit = rng.normal(size=(sum(size), n))
        start = np.cumsum(size) - size
        path = op3_langid.viterbi(emit, start, np.array(size), 0.7)
        for s, k in zip(start, size, strict=True):
            if k:
                best, score = best_path(emit[s : s + k], 0.7)
                assert score(path[s : s + k].tolist()) == pytest.approx(best)


def test_many_languages(spark):
    letters = [chr(0x4E00 + i) for i in range(200)]
    rows = [(i, f"{c}{c}{c} {c}{c} " * 5, f"l{i:03d}") for i, c in enumerate(letters)]
    model = op3_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 200
    texts = [rows[i][1] + rows[i + 1][1] * 2 for i in range(0, 199, 7)]
    for i, (lang, score, spans) in zip(range(0, 199, 7), model.label(texts), strict=True):
        assert lang == f"l{i + 1:03d}" and [s["lang"] for s in spans] == [f"l{i:03d}", f"l{i + 1:03d}"]


def test_training_rows_are_bounded(spark):
    rows = [(None, "same text of many rows", "en")] * 50 + [(i, f"text number {i} of its own", "en") for i in range(40)]
    model = op3_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), limit=10)
    assert model is not None and model.langs == ["en"]


def test_whole_values_join_what_rounds_leave(spark, monkeypatch):
    """Near copies of one text, most pairs of which are below the threshold: plausible sketches, few links."""
    monkeypatch.setattr(common, "BLOCK", 16)
    monkeypatch.setattr(common, "SMALL", 6)
    monkeypatch.setattr(common, "TASK", 64)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[k] = f"x{rng.randint(0, 10**6)}"
        texts[i] = " ".join(words)
    sets = dict(zip(texts, op6_setsketch.shingles(*common.text_buffer(pa.array(list(texts.values())))), strict=True))
    links = []
    for i, j in itertools.combinations(texts, 2):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        if 100 * len(a & b) >= 85 * len(a | b):
            links.append((i, j))
    roots = common.forest(links)
    got = {r.doc_id: r.component_id for r in op6_setsketch.near_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 85).collect()}
    assert got == {i: roots.get(i, i) for i in texts}


def test_substrings_in_dealt_ranges(spark, monkeypatch):
    rng = random.Random(12)
    base = "".join(rng.choice("ab c") for _ in range(2000))
    texts = {i: "".join(rng.choice("xyz ") for _ in range(30)) + base[(a := rng.randint(0, 1700)) : a + 160] for i in range(50)}
    monkeypatch.setattr(op7_substrings, "RANGES", 2)
    monkeypatch.setattr(op7_substrings, "SORT_BUCKET", 200)
    monkeypatch.setattr(op7_substrings, "BATCH_BYTES", 2000)
    check_substrings(spark, texts)


def test_substring_query_columns(spark, sf):
    want = removed_by_brute_force({r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.queries()["op7_suffix_dedup"](spark, sf).collect()}
    assert got == want


def test_bpe_query_columns(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op8_bpe.word_vocabulary())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.queries()["op8_bpe"](spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        assert got[r.doc_id] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def edit_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_band_against_the_table():
    rng = random.Random(1)
    x, y = [], []
    for letters in ("ab", "abcdefgh ", "aéß日本語" + "".join(map(chr, range(0x400, 0x600)))):
        for _ in range(150):
            a = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 10, 30, 60, 100, 200])))
            b = list(a)
            for _ in range(rng.randint(0, max(1, int(len(a) * 0.16)))):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
            x.append(a)
            y.append("".join(b) or "a")
    x += ["".join(rng.choice("abc ") for _ in range(4000))] * 3
    y += [x[-1][:1500] + "z" * n + x[-1][1500:] for n in (390, 444, 470)]
    want = [edit_table(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9) for a, b in zip(x[:-3], y[:-3], strict=True)]
    assert op10_lines.within(x, y, 0.9).tolist() == [*want, True, True, False]


def test_squeezed_lengths():
    x = np.array([0, 5, 32767, 32768, 40_000, 10_000_000, 1 << 40])
    assert (np.diff(op10_lines.squeezed(x).astype(int)) >= 0).all()
    assert (op10_lines.widened(op10_lines.squeezed(x)) <= x).all() and (op10_lines.widened(op10_lines.squeezed(x[:3])) == x[:3]).all()


def test_lines_with_common_grams(spark, monkeypatch):
    """Long lines that share most of their grams: these come last, are dealt out, and every group is found."""
    monkeypatch.setattr(op10_lines, "CROWD", 8)
    monkeypatch.setattr(op10_lines, "PARTNERS", 1)
    rng = random.Random(3)
    head = "the same long opening that stands in each and every line of this table of lines, whatever comes after it here "
    rows, want = [], {}
    for i in range(40):
        tail = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12))
        rows += [(2 * i, head + tail), (2 * i + 1, head + tail[:40] + "z" + tail[41:])]
        want |= {2 * i: head + tail, 2 * i + 1: ""}
    got = {r.doc_id: r.text for r in op10_lines.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


CLASH = ["n_lines", "n_removed", "gone", "gone_of", "target", "slope", "source_size", "size", "before", "copies", "taken", "position", "copy", "row", "n", "rng", "range_start", "no_source", "lang_pred", "score", "spans", "Score", "kept", "component_id", "digest", "id"]


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_dedup", "mix_sources", "bpe"])
def test_stages_with_clashing_names(spark, sf, name):
    rows = [(1, "some words of a text that is long enough to have shingles", "en", "a", 1), (1, "some words of a text that is long enough to have shingles", "en", "a", 1), (None, "words without an id stand here", None, None, None), (4, None, "en", "b", 0), (5, "", None, "b", 0)]
    clash = [c for c in CLASH if c != "Score"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(f"own {c}").alias(c) for c in clash])
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    rows = out.collect()
    if name != "bpe":
        assert out.columns == docs.columns
        assert rows and all(r[c] == f"own {c}" for r in rows for c in clash)
    else:
        assert len(rows) == 5
    empty = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), sf)
    assert empty.collect() == []


def test_mixed_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "t"), (2, "d e", None, "u")], "doc_id long, text string, source string, target string").withColumn("position", F.lit("own"))
    out = op9_mix.mixed(docs)
    assert {r.target for r in out.collect()} <= {"t", "u"} and "position_" in out.columns


def test_top_k_over_many_chains(spark, monkeypatch):
    monkeypatch.setattr(op1_topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(op1_topk, "CHAIN", 2)
    monkeypatch.setattr(op1_topk, "BLOCK", 5)
    monkeypatch.setattr(op1_topk, "LEAF", 4)
    monkeypatch.setattr(op1_topk, "SEEDS", 6)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v], "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, dim string")
    v = op1_topk.clean_vectors(df)
    got = [tuple(r) for r in op1_topk.top_k(v, v.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect()]
    q = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(0, 300, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    assert got == want


def test_bags_never_rule_out_a_link():
    """What entries of short lines carry bounds the edits from below, also where numbers are capped, and rules out unlike lines."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcde fgh") for _ in range(rng.randint(9, 127))) for _ in range(300)] + ["a" * 127, "ab" * 60, "é漢" * 50]
    edited = []
    for line in lines:
        chars = list(line)
        for _ in range(rng.randint(0, len(line) // 10)):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice(([], [rng.choice("xyz")], [chars[k], "q"]))
        edited.append("".join(chars))
    bag = op10_lines.unpacked(np.concatenate((op10_lines.bags(lines), op10_lines.bags(edited))))
    assert bag.min() >= 0 and bag.max() == 15
    i, n = np.arange(len(lines)), len(lines)
    most = op10_lines.most_edits(np.array([max(len(x), len(y)) for x, y in zip(lines, edited, strict=True)]), 0.9)
    linked = op10_lines.within(lines, edited, 0.9)
    assert linked.sum() > 200 and op10_lines.bags_near(bag, i, i + n, most)[linked].all()
    other = np.roll(i, 1)
    most = op10_lines.most_edits(np.array([max(len(lines[a]), len(lines[b])) for a, b in zip(i, other, strict=True)]), 0.9)
    assert op10_lines.bags_near(bag, i, other, most).mean() < 0.2
