"""MinHash near-duplicates of documents with SetSketch registers.

A document is its set of distinct five-word shingles (64-bit hashes). Register i keeps
floor(1 - log_b(x_i / A)), x_i the smallest of the exponential variates that its elements draw for it: an
exponentially spaced, truncated minimum, so the sketch of a union is the elementwise maximum, and registers
of similar sets agree with a probability near their Jaccard similarity. The elements draw by a Poisson
process over all registers, cut off where all registers are filled (and drawn further where one is not).

Documents with equal sets are one class. Bands of register values propose buckets; in a bucket ids are
compared by their sketches (linked_groups): the likelihood of the two sketches' less/equal/greater counts, given the
two set sizes, drops pairs whose best similarity leaves the threshold implausible (log ratio above DOUBT: 8e-6 of the
pairs at the threshold), and the rest, likeliest first, are confirmed on their full sets. With 32 bands of 6
registers a pair at 0.85 shares no bucket with a probability of 3e-7, one at 0.8 with 6e-5.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, linked_groups, mix64, slices, span_hashes, table, text_buffer, thinned, word_spans, written

BANDS, ROWS, BASE_B, RATE, DOUBT, SLICE = 32, 6, 1.001, 20.0, 10.0, 1_000_000
REGISTERS = BANDS * ROWS
C = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes; fewer than n words are one shingle, no words none."""
    low = LOWER[raw]
    starts, ends = word_spans(low, offsets[:-1][offsets[:-1] < len(low)])
    h = span_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets)
    rolled = np.zeros(len(h), dtype=np.uint64)
    for i in range(n):
        rolled[: max(0, len(h) - i)] += mix64(h[i:] + C[i]) * C[i]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            part = sum((int(mix64(h[a + i : a + i + 1] + C[i])[0]) * int(C[i]) for i in range(b - a)), b - a)
            out.append(mix64(np.array([part % (1 << 64)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """A row of registers a set; sets without elements have 0 in all."""
    size = np.array([len(s) for s in sets])
    low = np.full((len(sets), m), np.inf)
    todo, reach = np.flatnonzero(size > 0), np.log(m) + 5.0
    while len(todo):
        low[todo] = np.inf
        flat = low.ravel()
        h = np.concatenate([sets[i] for i in todo])
        doc = np.repeat(todo, size[todo])
        until = reach / size[doc]
        t, step = np.zeros(len(h)), 0
        while len(h):
            step += 1
            draw = mix64(h + np.uint64(step * int(C[7]) % (1 << 64)))
            t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / m
            live = t < until
            h, doc, until, t, draw = h[live], doc[live], until[live], t[live], draw[live]
            np.minimum.at(flat, doc * m + (mix64(draw + C[3]) % np.uint64(m)).astype(np.int64), t)
        todo = todo[np.isinf(low[todo]).any(axis=1)]
        reach *= 2
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low / RATE) / np.log(BASE_B))
    return np.where(np.isinf(low), 0, np.clip(k, 0, 65535)).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


GRID = np.linspace(0, 1, 33)


def log_likelihood(up: np.ndarray, down: np.ndarray, same: np.ndarray, u: np.ndarray, v: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of a similarity ``share``, given how many registers are greater, less and equal and the sets' shares u + v = 1 of their sizes."""

    def log_b(x):
        return np.clip(-np.log(np.maximum(1 - x * (BASE_B - 1) / BASE_B, 1e-12)) / np.log(BASE_B), 1e-9, 1)

    more, less = log_b(np.maximum(u - v * share, 0)), log_b(np.maximum(v - u * share, 0))
    return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1 - more - less, 1e-9))


def plausible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of at least threshold is plausible: sizes allow it and its likelihood is near the best.

    The log-likelihood is concave in the similarity: where it still rises at the threshold, its best lies beyond.
    """
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    up, down = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - up - down
    ok = top >= threshold - 1e-9
    at = np.minimum(threshold, top)
    there = log_likelihood(up, down, same, u, v, at)
    falls = np.flatnonzero(ok & (log_likelihood(up, down, same, u, v, at - 1e-4) > there))
    if len(falls):
        x = [c[falls, None] for c in (up, down, same, u, v)]
        best = log_likelihood(*x, GRID[None, :] * at[falls, None]).max(axis=1)
        ok[falls] = best - there[falls] <= DOUBT
    return ok


def sketched(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """(doc_id, n, digest, regs, keys) a row: the set's size, its digest, its registers and its band keys."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingles(*text_buffer(part.column("text")), n_words)
                regs = sketches(sets)
                digest = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                bands = regs.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
                key = mix64((bands * C[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * C[9]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(key.ravel()), BANDS).cast(pa.list_(pa.int64()))],
                    ["doc_id", "n", "digest", "regs", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, regs binary, keys array<long>")


def near_documents(docs: DataFrame, per_cent: int = 80, n_words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) a row of docs (doc_id, text), linked where 100 * |A & B| >= per_cent * |A | B|.

    Null, empty and wordless texts have no shingles and stand alone. A null doc_id takes no part and has a
    null component. Rows that repeat a doc_id each have their own text's component (the smallest
    of them decides nothing: ids are compared, not rows). An empty table gives no rows.
    """
    rows = written(sketched(docs, n_words), "sketches")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = written(classes.join(rows.select("digest", F.col("doc_id").alias("id"), "n", "regs", "keys"), ["digest", "id"]).dropDuplicates(["digest"]), "classes")
    # ids are smallest documents of classes; a document may head one class only, unless its id is repeated
    members = classes.select(F.explode("keys").alias("key"), "id")
    sketch = classes.groupBy("id").agg(F.min(F.concat("regs", F.unhex(F.lpad(F.hex("n"), 16, "0")))).alias("sketch"))

    def likeness(x: np.ndarray, y: np.ndarray):
        ra, rb = (np.ascontiguousarray(v[:, : 2 * REGISTERS]).view(np.uint16) for v in (x, y))
        na, nb = (np.ascontiguousarray(v[:, 2 * REGISTERS :]).view(">u8").ravel().astype(np.float64) for v in (x, y))
        same = (ra == rb).sum(axis=1)
        ok = same >= REGISTERS * (per_cent / 100 - 0.25)
        ok[ok] = plausible(ra[ok], rb[ok], na[ok], nb[ok], per_cent / 100)
        return same.astype(np.float64), ok

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, words): the whole sets of the classes headed by ids; one a class where a repeated id heads several."""
        heads = classes.select("id", "digest").join(ids, "id", "left_semi")
        texts = thinned(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids).join(ids, "id", "left_semi")

        def run(batches):
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    sets = shingles(*text_buffer(part.column("text")), n_words)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "digest", "words"])

        return written(texts.mapInArrow(run, "id long, digest binary, words binary").join(heads, ["id", "digest"]).dropDuplicates(["id", "digest"]), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        full = sets_of(written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "verified-ids"))
        side = {c: full.select(F.col("id").alias(c), *[F.col("words").alias(f"words_{c}")]) for c in ("a", "b")}

        def confirm(batches):
            for pdf in batches:
                ok = np.zeros(len(pdf), dtype=bool)
                for i, (x, y) in enumerate(zip(pdf["words_a"], pdf["words_b"], strict=True)):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * both >= per_cent * (len(x) + len(y) - both)
                yield pdf.loc[ok, ["a", "b"]]

        return pairs.join(side["b"], "b").join(side["a"], "a").mapInPandas(confirm, "a long, b long").distinct()

    def linker(values):
        """Which sets of a list link with one of them: a count of its elements in all of them."""
        size = np.array([len(v) // 8 for v in values], dtype=np.int64)
        number = np.unique(np.frombuffer(b"".join(values), np.uint64), return_inverse=True)[1]
        start = np.cumsum(size) - size
        seen = np.zeros(int(number.max()) + 1, dtype=np.int32)

        def link(r: int, others: np.ndarray) -> np.ndarray:
            own = number[start[r] : start[r] + size[r]]
            seen[own] = 1
            both = np.add.reduceat(seen[number], start)[others]
            seen[own] = 0
            return 100 * both >= per_cent * (size[r] + size[others] - both)

        return link

    roots = linked_groups(members, sketch, likeness, verify, ((8, 1), (1, 2)), whole=lambda ids: sets_of(ids).withColumnRenamed("words", "sketch"), linker=linker)
    named = classes.select("digest", "id").join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    known = F.col("n_shingles") > 0
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    out = out.withColumn("component_id", F.when(known & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)
"""
