"""Embedding near-duplicates by collision counting over one-dimensional random projections.

Unit vectors are projected on M Gaussian directions. The first projection is sorted and cut into ranges of
similar size by sampled splitters (repartitionByRange); inside a pair of ranges each vector opens a window
of half-width W around its own value on every projection, and a pair that falls into enough windows is
verified by its cosine in double precision. W and the required count come from the threshold: a pair at
exactly the threshold differs by N(0, 2 * (1 - threshold)) on each projection, and the count is the largest
at which the binomial tail misses such a pair with a probability of at most MISS. Two ranges that are
farther apart than any linked pair can be on the unit direction are never compared. Links are not emitted:
a task returns its vectors' link counts and a spanning forest of its links.

Exact copies are one class before any comparison; a class counts with its size.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, parts_for, table, written

M, RANGE_ROWS, TILE, MISS, SEED, WIDE = 24, 8192, 512, 1e-7, 20240607, 2.0


def calibrated(threshold: float, m: int = M, wide: float = WIDE, miss: float = MISS) -> tuple[float, int]:
    """(half-width of a window, collisions asked for)."""
    delta = sqrt(2 * (1 - threshold))
    p = erf(wide / sqrt(2))
    tail, need = 0.0, 0
    while need <= m:
        tail += comb(m, need) * p**need * (1 - p) ** (m - need)
        if tail > miss:
            break
        need += 1
    return wide * delta, need


@lru_cache(maxsize=64)
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, M))


def usable(c):
    x = c.cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return c.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def _unit(raw: pd.Series, dim: int) -> np.ndarray:
    x = np.array(raw.tolist(), dtype=np.float64).reshape(len(raw), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def tile_links(u: np.ndarray, w: np.ndarray, pu: np.ndarray, pw: np.ndarray, threshold: float, width: float, need: int):
    """Row pairs of two tiles with need collisions and a cosine of at least threshold."""
    step = np.float32(width / 12)  # a window is 25 or 26 steps of one byte; wrap-around only adds candidates
    a = (np.floor(pu / step).astype(np.int64) + 13).astype(np.uint8)
    b = np.floor(pw / step).astype(np.int64).astype(np.uint8)
    hits = np.zeros((len(u), len(w)), dtype=np.uint8)
    for k in range(a.shape[1]):
        hits += (a[:, k][:, None] - b[:, k][None, :]) <= 26
    i, j = np.nonzero(hits >= need)
    if len(i) > hits.size // 8:
        cos = u @ w.T
        ok = cos[i, j] >= threshold - 1e-9
        i, j = i[ok], j[ok]
    keep = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), 100_000):
        keep[s : s + 100_000] = np.einsum("nd,nd->n", u[i[s : s + 100_000]], w[j[s : s + 100_000]]) >= threshold
    return i[keep], j[keep]


def near_vectors(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) a row of df, links at cosine >= threshold.

    Null, zero or non-finite vectors link with nothing and stand alone; vectors of different lengths do not
    link. A null vec_id has a null component and takes no part. Repeated rows of one vec_id count as vectors.
    """
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), (usable(F.col("embedding")) & F.col("vec_id").isNotNull()).alias("ok"))
    classes = rows.where(F.coalesce("ok", F.lit(False))).groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("e"))

    @F.pandas_udf("double")
    def first_projection(e: pd.Series) -> pd.Series:
        size, out = np.array([len(x) for x in e], dtype=np.int64), np.zeros(len(e))
        for dim in np.unique(size):
            rows, first = np.flatnonzero(size == dim), directions(int(dim))[:, 0]
            out[rows] = _unit(e.iloc[rows], int(dim)) @ (first / np.linalg.norm(first))
        return pd.Series(out)

    classes = written(classes.withColumn("p", first_projection("e")), "vectors")
    count = classes.count()
    ranges = parts_for(count, RANGE_ROWS)
    width, need = calibrated(threshold)
    cut = classes.stat.approxQuantile("p", [i / ranges for i in range(1, ranges)], 0.01 / ranges) if ranges > 1 else []
    block = sum((F.when(F.col("p") > c, 1).otherwise(0) for c in cut), F.lit(0)) if len(cut) < 64 else F.size(F.filter(F.array(*map(F.lit, cut)), lambda c: c < F.col("p")))
    classes = classes.withColumn("block", block.cast("int"))
    edges = classes.groupBy("dim", "block").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    delta = sqrt(2 * (1 - threshold)) + 1e-9
    other = edges.select("dim", F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = edges.join(other, "dim").where((F.col("block") <= F.col("other")) & (F.col("lo2") - F.col("hi") <= delta) & (F.col("lo") - F.col("hi2") <= delta)).select("dim", "block", "other")

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["p"].to_numpy())
        u = _unit(pdf["e"], int(key[0]))[order]
        return pd.DataFrame({"dim": [int(key[0])], "block": [int(key[1])], "ids": [pdf["id"].to_numpy(np.int64)[order].tobytes()], "ns": [pdf["n"].to_numpy(np.int64)[order].tobytes()], "u": [u.tobytes()]})

    packed = written(classes.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, ns binary, u binary"), "ranges")
    right = packed.select("dim", F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("ns").alias("ns2"), F.col("u").alias("u2"))
    pairs = near.join(packed, ["dim", "block"]).join(right, ["dim", "other"]).repartition(parts_for(ranges * (ranges + 1) // 2, 1), "dim", "block", "other")

    def compare(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                dim = int(r.dim)
                ids, ids2 = np.frombuffer(r.ids, np.int64), np.frombuffer(r.ids2, np.int64)
                ns, ns2 = np.frombuffer(r.ns, np.int64), np.frombuffer(r.ns2, np.int64)
                u, w = np.frombuffer(r.u).reshape(-1, dim), np.frombuffer(r.u2).reshape(-1, dim)
                d = directions(dim)
                pu, pw = (u @ d).astype(np.float32), (w @ d).astype(np.float32)
                same = r.block == r.other
                links, links2, edges = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64), {}
                for s in range(0, len(ids), TILE):
                    for t in range(s if same else 0, len(ids2), TILE):
                        i, j = tile_links(u[s : s + TILE], w[t : t + TILE], pu[s : s + TILE], pw[t : t + TILE], threshold, width, need)
                        i, j = i + s, j + t
                        if same:
                            i, j = i[i < j], j[i < j]
                        np.add.at(links, i, ns2[j])
                        np.add.at(links if same else links2, j, ns[i])
                        if len(i):
                            edges = forest([*edges.items(), *zip(ids[i].tolist(), ids2[j].tolist(), strict=True)])
                out = [pd.DataFrame({"id": ids, "links": links, "root": ids})]
                if not same:
                    out.append(pd.DataFrame({"id": ids2, "links": links2, "root": ids2}))
                out.append(pd.DataFrame({"id": [x for x, y in edges.items() if x != y], "links": 0, "root": [y for x, y in edges.items() if x != y]}))
                out = pd.concat(out)
                yield out[(out["links"] > 0) | (out["id"] != out["root"])].astype("int64")

    found = written(pairs.mapInPandas(compare, "id long, links long, root long"), "links")
    roots = components(found.where("id <> root").select("id", "root"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("e", "id", "n").join(links, "id", "left").join(roots, "id", "left")
    known = known.select("e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    good, rest = rows.where(F.coalesce("ok", F.lit(False))), rows.where(~F.coalesce("ok", F.lit(False)))
    out = good.join(known, "e").select("vec_id", "n_links", "component_id").unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
