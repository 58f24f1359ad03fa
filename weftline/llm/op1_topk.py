"""Exact top-k search by inner product: ball trees, one a shard, searched by branch and bound.

Every shard's vectors stand in a ball tree, built once and stored with them. A block of queries walks a chain of shards; in each it bounds
all nodes by <q, centre> + radius * |q|, visits leaves in order of the block's largest bound, and scores
only the queries whose bound reaches their current k-th score. That score starts from a bounded common
sample, is carried from leaf to leaf and from shard to shard, and what the first chain ends with is every other chain's
first bound: all chains share it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, table, written

LEAF, SHARD_ROWS, CHAIN, BLOCK, SEEDS = 128, 8192, 8, 2048, 1024
NONE = -(2**63) + 1  # the score of an empty place


def clean_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x); null ids and vectors with null or non-finite components go.

    Of rows with one vec_id the smallest vector stays, so repeated rows count once. Vectors of another
    length than the query's are not compared with it.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    one = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))
    return one.groupBy("vec_id").agg(F.min("v").alias("v"))


def ball_tree(x: np.ndarray, leaf: int = LEAF):
    """Row order and nodes (start, end, centre, radius, left, right); left is -1 at a leaf. Splits at the median of the widest axis."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        rows = x[order[lo:hi]]
        centre = rows.mean(axis=0)
        radius = np.sqrt(((rows - centre) ** 2).sum(axis=1).max()) * (1 + 1e-9) + 1e-9
        me = len(nodes)
        nodes.append([lo, hi, centre, radius, -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = me
        if hi - lo > leaf and radius > 1e-6:
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            mid = (lo + hi) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(rows[:, axis], mid - lo)]
            todo += [(mid, hi, me, 1), (lo, mid, me, 0)]
    return order, nodes


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 2**53 by Python's integers, held within a long."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * max(1, x.shape[1]) < 2**52:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(a) for a in r] for r in q], dtype=object) @ np.array([[int(a) for a in r] for r in x], dtype=object).T
    return np.clip(big, NONE + 1, 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, smallest id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor
        self.score = np.full((len(ids), k), NONE)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, vecs: np.ndarray, scores: np.ndarray) -> None:
        """Candidates below a row's current k-th score are left out before the merge."""
        hit = scores >= self.kth()[rows][:, None]
        hit &= vecs[None, :] != self.ids[rows][:, None]
        for i in np.flatnonzero(hit.any(axis=1)):
            r = rows[i]
            s = np.concatenate((self.score[r], scores[i][hit[i]]))
            v = np.concatenate((self.vec[r], vecs[hit[i]]))
            keep = np.lexsort((v, -s))[: self.k]
            self.score[r], self.vec[r] = s[keep], v[keep]


class Tree:
    """A shard: its vectors and ids in the order of the leaves, and its nodes as arrays."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, spans: np.ndarray, centres: np.ndarray, radii: np.ndarray):
        self.x, self.ids, self.spans, self.centres, self.radii = x, ids, spans, centres, radii

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray) -> Tree:
        order, nodes = ball_tree(x)
        spans = np.array([[n[0], n[1], n[4], n[5]] for n in nodes], dtype=np.int64)
        return cls(x[order], ids[order], spans, np.stack([n[2] for n in nodes]), np.array([n[3] for n in nodes]))


def search(best: Best, q: np.ndarray, tree: Tree) -> None:
    norm = np.sqrt((q**2).sum(axis=1))
    bound = q @ tree.centres.T + norm[:, None] * tree.radii[None, :]
    bound = bound * (1 + 1e-12) + 1e-6
    heap, leaves, kth = [0], [], best.kth()
    while heap:  # branches that no query can need are cut whole
        i = heap.pop()
        if (bound[:, i] >= kth).any():
            left, right = tree.spans[i, 2:].tolist()
            if left < 0:
                leaves.append(i)
            else:
                heap += [left, right]
    for i in sorted(leaves, key=lambda i: -bound[:, i].max()):
        rows = np.flatnonzero(bound[:, i] >= best.kth())
        if len(rows):
            lo, hi = tree.spans[i, :2].tolist()
            best.add(rows, tree.ids[lo:hi], exact_scores(q[rows], tree.x[lo:hi]))


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(col, dtype=np.float64).reshape(-1, dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best vectors but its own; ties to the smaller vec_id.

    vectors, queries: (vec_id long, v array<double>) of whole numbers. Empty input gives no rows; with fewer
    candidates all are returned.
    """
    vectors = written(vectors.withColumn("dim", F.size("v")), "vectors")
    queries = queries.withColumn("dim", F.size("v"))
    n, n_q = vectors.count(), queries.count()
    shards, blocks = parts_for(n, SHARD_ROWS), parts_for(n_q, BLOCK)
    chains = parts_for(shards, CHAIN)
    seeds = vectors.orderBy(F.xxhash64("vec_id")).limit(SEEDS).toPandas()

    def part_of(name: str, parts: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(parts)).cast("int").alias(name)

    def values(pdf: pd.DataFrame, dim: int) -> np.ndarray:
        return np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), dim)

    def plant(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t = Tree.build(values(pdf, int(key[1])), pdf["vec_id"].to_numpy(np.int64))
        row = {"s": int(key[0]), "dim": int(key[1])} | {k: getattr(t, k).tobytes() for k in ("ids", "x", "spans", "centres", "radii")}
        return pd.DataFrame([row])

    def block_up(key, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[1])
        x, ids, floor = values(pdf, dim), pdf["vec_id"].to_numpy(np.int64), pdf["floor"].to_numpy(np.int64)
        same = seeds[seeds["dim"] == dim]
        if len(same) > k:
            seed = exact_scores(x, values(same, dim))
            seed[ids[:, None] == same["vec_id"].to_numpy(np.int64)[None, :]] = NONE
            floor = np.maximum(floor, np.sort(seed, axis=1)[:, -k])
        return pd.DataFrame({"q": [int(key[0])], "dim": [dim], "q_ids": [ids.tobytes()], "q_x": [x.tobytes()], "q_floor": [floor.tobytes()]})

    trees = vectors.select("vec_id", "v", "dim", part_of("s", shards)).groupBy("s", "dim").applyInPandas(plant, "s int, dim int, ids binary, x binary, spans binary, centres binary, radii binary")
    trees = written(trees.withColumn("chain", F.pmod("s", F.lit(chains))), "shards")

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, first = int(key[2]), pdf.iloc[0]
        ids = np.frombuffer(first["q_ids"], dtype=np.int64)
        block = _matrix(first["q_x"], dim) if dim else np.zeros((len(ids), 0))
        best = Best(ids, k, np.frombuffer(first["q_floor"], dtype=np.int64))
        for r in pdf.itertuples(index=False):
            vec, radii = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.radii)
            x, centres = (_matrix(c, dim) if dim else np.zeros((n, 0)) for c, n in ((r.x, len(vec)), (r.centres, len(radii))))
            search(best, block, Tree(x, vec, np.frombuffer(r.spans, dtype=np.int64).reshape(-1, 4), centres, radii))
        hit = best.vec != np.iinfo(np.int64).max
        row, _ = np.nonzero(hit)
        return pd.DataFrame({"query_id": ids[row], "vec_id": best.vec[hit], "score": best.score[hit]})

    def walked(bounded: DataFrame, some) -> DataFrame:
        """What the queries (with a floor each) find in some of the chains."""
        q = bounded.select("vec_id", "v", "dim", "floor", part_of("q", blocks)).groupBy("q", "dim").applyInPandas(block_up, "q int, dim int, q_ids binary, q_x binary, q_floor binary")
        q = q.withColumn("chain", F.explode(F.array(*map(F.lit, some))) if len(some) < 64 else F.explode(F.sequence(F.lit(some[0]), F.lit(some[-1]))))
        return q.join(trees, ["chain", "dim"]).groupBy("q", "chain", "dim").applyInPandas(walk, "query_id long, vec_id long, score long")

    found = walked(queries.withColumn("floor", F.lit(NONE)), range(1))
    if chains > 1:
        found = written(found, "first-chain")
        reached = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        bounded = queries.join(reached, "vec_id", "left").withColumn("floor", F.coalesce("least", F.lit(NONE)))
        found = found.unionByName(walked(bounded, range(1, chains)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(clean_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(v, v.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
