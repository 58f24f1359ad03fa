"""License scan, filter audit and conversation repair against brute force, their SQL and edge cases."""

import functools
import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import pytest

from weftline.llm import op2_html as op2
from weftline.llm import op11_license as op11
from weftline.llm import op12_audit as op12
from weftline.llm import op13_repair as op13


def in_duckdb(sql, **tables):
    db = duckdb.connect()
    for name, (schema, rows) in tables.items():
        db.sql(f"CREATE TABLE {name} ({schema})")
        if rows:
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return db.sql(sql)


def rows_of(rel):
    return sorted((tuple(r) for r in rel.fetchall()), key=repr)


# --- op11 -----------------------------------------------------------------------------------


def base_by_brute_force(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    found = [(i, label) for label, phrase in op11.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


MIT = op11.LONG[4][1]
TEXTS = [
    "Released under the MIT License.",
    "MIT\n-- license; mit LICENSE, the Apache License and GNU General Public License",
    "mitİ license, MITK license, MKIT license",
    "general, public; license general public licenses",
    "Copyright 2001 someone. " + MIT.capitalize(),
    "public license general " * 50,
    "x " * 3000 + "apache license " + "y " * 3000,
    " ".join(w for w in MIT.split() if w != "hereby"),
    "permission is hereby granted free of charge",
    "you can redistribute it and or modify it " * 3,
    "日本 mit license 日本",
    "mit.license mit_license mit0license",
    "",
    None,
    "  \x00 ;;;",
]


@pytest.fixture(scope="module")
def licences(spark):
    rng = random.Random(5)
    words = ["mit", "Apache", "license", "general", "public", "the", "of", "software", ";", "granted", "hereby", "É"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, TEXTS[0]), (None, None), (None, TEXTS[0]), (3, TEXTS[3]), (3, TEXTS[0])]
    return rows, spark.createDataFrame([(i, t, "a", 1.0, 7) for i, t in rows], "doc_id long, text string, labels string, score double, words int")


def test_license_base_and_sql(spark, licences):
    rows, df = licences
    got = op11.scan(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(((i, *base_by_brute_force(t)) for i, t in rows), key=repr)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    want = in_duckdb(op11.ORACLE, documents=("doc_id BIGINT, text VARCHAR", rows))
    assert sorted((tuple(r[c] for c in want.columns) for r in got), key=repr) == rows_of(want)


def test_license_wordings(spark):
    texts = [MIT, "Notice.\n" + MIT.upper() + "\nend", " ".join(w for w in MIT.split() if w != "hereby"), op11.LONG[0][1], "SPDX-License-Identifier: Apache-2.0", "Licensed under CC BY-NC 4.0.", "the software is free of charge to any person " * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in op11.scan(df).collect()}
    assert [got[i].labels for i in range(7)] == ["mit", "mit", "", "apache", "apache", "cc-by,cc-by-nc", ""]
    assert got[0].n_base == got[4].n_base == 0 and got[0].score == 1.0 and got[2].score == 0.0
    assert got[3].base_labels == "apache"


def test_license_empty_and_many_places(spark):
    assert op11.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    many = spark.createDataFrame([(1, "mit license " * 50_000)] + [(2, "same mit license")] * 2500, "doc_id long, text string")
    got = op11.scan(many).collect()
    assert len(got) == 2501
    assert next(r for r in got if r.doc_id == 1)[1:5] == (100_000, 50_000, 0, 99_998)


# --- op12 -----------------------------------------------------------------------------------


def audit_by_brute_force(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, source, text in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        f = {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        f |= {"D"} if re.search("[#$%&*|]", text) else set()
        f |= {"E"} if i is not None and any((t or "") == text and j is not None and j < i for j, _, t in docs) else set()
        fails.append((source or "", i, f))
    out = []
    for part in {p for p, _, _ in fails}:
        mine = [(i, f) for p, i, f in fails if p == part]
        orders = ["".join(p) for p in itertools.permutations("ABCDE")]
        removed = {(o, s): [i for i, f in mine if o[s] in f and not f & set(o[:s])] for o in orders for s in range(5)}
        value = {x: sum(len(removed[o, o.index(x)]) for o in orders) for x in "ABCDE"}
        for o, s in removed:
            x, here = o[s], removed[o, s]
            kept = sum(not f & set(o[: s + 1]) for _, f in mine)
            failing = sum(x in f for _, f in mine)
            out.append((part, o, s + 1, kept, len(here), failing - len(here), sum(f == {x} for _, f in mine), sum(i in good for i in here), sum(i in toxic for i in here), value[x]))
    return sorted(out)


def test_audit(spark):
    rng = random.Random(3)
    texts = ["", None, "Ab " * 300, "word# " * 250, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " | X", "A", " ", " ".join(f"W{i}" for i in range(220))]
    docs = [(i if i % 11 else None, rng.choice(["s1", "s2", None, ""]), rng.choice(texts)) for i in range(120)] + [(5, "s1", texts[4]), (5, "s1", texts[4]), (5, "s2", texts[4]), (1000, "s2", texts[4])]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 130, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    df = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, source string, text string, mask int, part string")
    got = op12.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audit_by_brute_force(docs, labels)
    want = in_duckdb(op12.ORACLE, documents=("doc_id BIGINT, source VARCHAR, text VARCHAR", docs), labels=("doc_id BIGINT, quality INT, toxic INT", labels))
    assert want.columns == got.columns and rows_of(want) == sorted((tuple(r) for r in got.collect()), key=repr)


def test_audit_of_nothing_and_long_copies(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op12.audit(spark.createDataFrame([], "doc_id long, source string, text string"), labels).collect() == []
    docs = spark.createDataFrame([(i, "s", "word " * 50_000) for i in range(5)], "doc_id long, source string, text string")
    got = {(r.filter_order, r.step): r for r in op12.audit(docs, labels).collect()}
    assert len(got) == 600 and got["EABCD", 1].removed == 4 and got["BEACD", 1].removed == 5 and got["BEACD", 2].redundant == 4
    assert got["BEACD", 1].shapley == 120 * 1 + 4 * 60


# --- op13 -----------------------------------------------------------------------------------


def repair_by_brute_force(rows, depth=2):
    """rows: (turn, role, text) in order. Compares whole audits of all edit sequences."""
    seen, faults, codes = set(), [], []
    for _, role, text in rows:
        body = text.rstrip(op13.SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "sound"
        seen.add((role, text))
        faults.append(fault)
        codes.append((role[:1], fault))
    gives = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def best(i, e, inserts):
        found = [(0, "", ())] if i == len(rows) and e in "ea" else []
        nxt = "a" if e == "u" else "u"
        if inserts < depth:
            c, a, x = best(i, nxt, inserts + 1)
            found.append((5 + c, "I" + a, ({"u": "user:", "a": "assistant:"}[nxt], *x)))
        if i < len(rows):
            role, text = rows[i][1:]
            c, a, x = best(i + 1, e, 0)
            found.append((2 + c, "D" + a, x))
            if faults[i] in ("sound", "truncated"):
                own = 5 * (faults[i] == "truncated")
                kept = gives.get((e, role[:1]))
                if kept:
                    c, a, x = best(i + 1, kept, 0)
                    found.append((own + c, "K" + a, (f"{role}:{text}", *x)))
                c, a, x = best(i + 1, nxt, 0)
                found.append((own + 1 + c, "R" + a, ({"u": "user", "a": "assistant"}[nxt] + ":" + text, *x)))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "e", 0)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage_by_brute_force(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(9)
    rows = []
    for c in [None, *range(60)]:
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "User", "umpire"])
            text = rng.choice(["Hello.", "Well?", "no end", "", None, " \t", "Long! " * 20, "x\n", "É.", f"{t}."])
            rows.append((c, rng.choice([t, t, t, None, t + 3]), role, text))
    rows += [(77, 1, "user", f"only {i}.") for i in range(2)] + [(88, t, ("user", "assistant")[t % 2], f"{t % 50} yes.") for t in range(300)]
    return rows


@pytest.mark.parametrize("bits", [12, 1])
def test_repair_against_brute_force(spark, chats, monkeypatch, bits):
    monkeypatch.setattr(op13, "BLOCK_BITS", bits)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    groups = {c: [] for c, *_ in chats}
    for row in damage_by_brute_force(chats):
        groups[row[0]].append(row)
    want = {c: repair_by_brute_force([r[1:] for r in sorted(g, key=order)]) for c, g in groups.items() if c != 88}
    df = spark.createDataFrame([(*r, "x", 1) for r in chats], "conv_id long, turn long, role string, text string, audit string, place int")
    got = {r.conv_id: tuple(r)[1:] for r in op13.with_empty(op13.repair(op13.damaged(df)), df).collect()}
    assert set(got) == set(groups)
    assert {c: got[c] for c in want} == want
    if bits == 1:
        db = in_duckdb(op13.ORACLE, conversations=("conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", chats))
        assert {r[0]: r[1:] for r in db.fetchall()} == got


def test_repair_walks_agree_for_all_short_codes():
    for codes in itertools.product(range(12), repeat=3):
        codes = list(codes)
        whole = op13.front_minima(codes, op13.END)
        m = op13.matrix(codes)
        for role in range(4):
            assert whole[0][role] + op13.DELETE * len(codes) == min(m[role][b] + op13.END[b] for b in range(4))
            parts, at = "", role
            for i, code in enumerate(codes):
                behind = tuple(x + op13.DELETE * (len(codes) - i - 1) for x in whole[i + 1])
                letters, at = op13.walk([code], behind, at)
                parts += letters
            assert (parts, at) == op13.walk(codes, op13.END, role)


def test_repair_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op13.with_empty(op13.repair(empty), empty).collect() == []
    rows = [("a", 1, "user", "q" * 500_000 + "."), ("a", 2, "assistant", "A."), ("b", 1, "assistant", "cut")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in op13.repair(df).collect()}
    assert got["a"].audit == "KK" and got["a"].cost == 0 and got["a"].repaired_sha256 == hashlib.sha256(("user:" + rows[0][3] + "\nassistant:A.").encode()).hexdigest()
    assert got["b"].audit == "D" and got["b"].cost == 2 and got["b"].repaired_sha256 == hashlib.sha256().hexdigest()
    lone = spark.createDataFrame([("c", None, "user", "A.")], "conv_id string, turn int, role string, text string")
    assert op13.with_empty(op13.repair(lone.where("turn = 1")), lone).first()[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


# --- op2: names and depth -------------------------------------------------------------------

ONE = "A first sentence that is quite long and says something of interest to all readers. " * 3
TWO = "Another paragraph which has a good deal to say about many matters of the world as it is. " * 3


@pytest.mark.parametrize(
    "part, text",
    [
        ('<h2 id="related-work">Heading</h2>', "Heading"),
        ('<h2 id="navigation">Heading</h2>', "Heading"),
        (f'<section id="side-effects"><p>{TWO}</p></section>', TWO),
        (f'<p class="social-history">{TWO}</p>', TWO),
        (f'<div class="share-price">{TWO}</div>', TWO),
        (f'<div class="cookie-recipe">{TWO}</div>', TWO),
        (f'<div class="discussion"><p>{TWO}</p><p>{TWO}</p></div>', TWO + TWO),
        ('<div class="share-buttons"><a href="x">Tweet</a> <a href="y">Mail</a></div>', ""),
        ('<div class="related-posts"><p>Other things to read on</p></div>', ""),
        (f'<div id="comments"><p>{TWO}</p></div>', ""),
        ('<div class="newsletter-signup">Get our mail</div>', ""),
        ('<div class="cookie-notice">We use cookies here.</div>', ""),
        (f'<div class="ad-slot">{TWO}</div>', ""),
    ],
)
def test_whole_names_decide(part, text):
    page = f"<html><body><article><p>{ONE}</p>{part}<p>{ONE}</p></article></body></html>"
    assert op2.main_text(page) == " ".join((ONE + text + " " + ONE).split())


def test_headings_without_marks():
    for page in (f"<body><h3>Why it matters</h3><p>{ONE}</p><p>{TWO}</p></body>", f"<body><p>{ONE}</p><h3>Why it matters</h3><p>{TWO}</p></body>"):
        assert "Why it matters" in op2.main_text(page)


def test_depth_costs_no_more_than_length():
    start = time.process_time()
    assert op2.main_text("<body>" + "<div>word" * 100_000).count("word") in (0, 100_000)
    assert len(op2.main_text("<body><p>" + "<span>word " * 50_000 + "</div>" * 50_000)) == 50_000 * 5 - 1
    assert time.process_time() - start < 60
