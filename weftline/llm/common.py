"""Shared pieces: tables that cut lineage, connected components, link rounds, byte kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, table, written

__all__ = ["dropped", "table", "written"]


def parts_for(n_rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(n_rows / per_part))


# --- byte kernels ---------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
BASE_INV = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of a buffer; equal bytes give equal hashes wherever they stand."""
    n = len(codes)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[codes] * powers(BASE, n), out=prefix[1:])
    inv = powers(BASE_INV, n + 1)
    return mix64((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_spans(codes: np.ndarray, doc_starts: np.ndarray, inside: np.ndarray = ~IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``inside`` lets in (all but white space); runs end with their document."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = inside[codes]
    first = np.zeros(len(codes) + 1, dtype=bool)
    first[doc_starts] = True
    first = first[:-1]
    before = np.concatenate(([False], word[:-1])) & ~first
    after = np.concatenate((word[1:] & ~first[1:], [False]))
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null reads as empty."""
    col = pa.chunked_array([col]) if isinstance(col, pa.Array) else col
    col = col.cast(pa.large_string()).fill_null("").combine_chunks()
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most_bytes: int = 4_000_000):
    """Cut a batch into runs of whole rows of about ``most_bytes`` of text; one longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


# --- connected components -------------------------------------------------------------------


def forest(pairs) -> dict:
    """Union-find over pairs: each node's smallest reachable node."""
    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: find(x) for x in list(parent)}


def _contract(kind):
    def run(batches):
        def pairs():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        stars = [(x, r) for x, r in forest(pairs()).items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], kind), pa.array([r for _, r in stars], kind)], ["id", "root"])

    return run


def components(edges: DataFrame, per_part: int = 1_000_000) -> DataFrame:
    """(id, root): each linked id with the smallest id reachable, for the ids that are not their own root.

    edges: two columns of one type. Partitions of at most ``per_part`` edges are contracted by a local
    union-find; beyond one partition, large-star and small-star rounds follow until only stars are left.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    kind = pa.string() if edges.dtypes[0][1] == "string" else pa.int64()
    schema = f"id {edges.dtypes[0][1]}, root {edges.dtypes[0][1]}"
    e = written(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("id"), F.col(b).alias("root")).distinct(), "edges")
    while True:
        n = e.count()
        if n <= per_part:
            return e.coalesce(1).mapInArrow(_contract(kind), schema)
        spark.sparkContext.setJobDescription(f"components of {n} edges")
        e = e.repartition(parts_for(n, per_part), "root").mapInArrow(_contract(kind), schema)
        both = e.unionByName(e.select(F.col("root").alias("id"), F.col("id").alias("root")))
        least = both.groupBy("id").agg(F.min("root").alias("low")).select(F.col("id").alias("root"), F.least("id", "low").alias("low"))
        large = e.join(least, "root").select("id", F.col("low").alias("root")).unionByName(e).where("id <> root").distinct()
        low = large.groupBy("id").agg(F.min("root").alias("low"))
        small = large.join(low, "id").select(F.when(F.col("root") == F.col("low"), F.col("id")).otherwise(F.col("root")).alias("id"), F.col("low").alias("root"))
        e = written(small.where("id <> root").distinct(), "edges")
        stars = e.agg(F.countDistinct("id").alias("ids"), F.count("*").alias("n")).first()
        if stars.ids == stars.n and e.join(e.select(F.col("root").alias("id")).distinct(), "id", "left_semi").isEmpty():
            return e


#: Rows of a block of a large bucket; rows of a bucket compared by offsets; slots of a task; pairs weighed at once.
BLOCK, SMALL, TASK, AT_ONCE = 2048, 48, 16_384, 4096
#: Bytes of whole values in a task, two blocks' worth at most in one slot.
TASK_BYTES = 64_000_000
LEFT, RIGHT = 2, 1


def _slots(pdf: pd.DataFrame):
    """The rows in the order of their slots: (first row and size of each slot, key, id, root, side, sketch)."""
    order = np.lexsort((pdf["j"], pdf["i"], pdf["key"]))
    key, i, j, side = (pdf[c].to_numpy(np.int64)[order] for c in ("key", "i", "j", "side"))
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    size = np.diff(np.concatenate((new, [len(key)])))
    return new, size, key, pdf["id"].to_numpy()[order], pd.factorize(pdf["root"])[0][order], side, pdf["sketch"].to_numpy()[order]


def best_pairs(pdf: pd.DataFrame, likeness, top: int | None) -> pd.DataFrame:
    """(a, b, cut): plausible pairs of different roots, a left and a right row of one slot, the likeliest ``top`` of an id or so;
    and a row with the key alone, as cut, of each bucket of which some were left out."""
    new, size, key, ids, root, side, sketch = _slots(pdf)
    sketch = np.frombuffer(b"".join(sketch), dtype=np.uint8).reshape(len(pdf), -1)
    group = np.repeat(np.arange(len(new)), size)
    left = (side & LEFT) > 0
    found, cut = [], []

    def weigh(p, q):
        """The plausible ones of the pairs (p, q) with their scores."""
        out = []
        for s in range(0, len(p), AT_ONCE):
            x, y = p[s : s + AT_ONCE], q[s : s + AT_ONCE]
            apart = (root[x] != root[y]) & (left[x] | left[y])
            x, y = x[apart], y[apart]
            if len(x):
                score, ok = likeness(sketch[x], sketch[y])
                out.append((x[ok], y[ok], score[ok]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]

    single = side == LEFT + RIGHT
    whole = np.minimum.reduceat((single | (side == RIGHT)).astype(np.int8), new) > 0  # the bucket is in one slot
    small = np.flatnonzero((size <= SMALL)[group] & whole[group])
    for d in range(1, SMALL):
        p = small[small + d < len(key)]
        p = p[group[p] == group[p + d]]
        if not len(p):
            break
        found.append(weigh(p, p + d))
    for g in np.flatnonzero((size > SMALL) | ~whole):
        rows = np.arange(new[g], new[g] + size[g])
        right = rows[(side[rows] & RIGHT) > 0]
        best, of = np.full(size[g], -np.inf), np.zeros(size[g], dtype=np.int64)
        for r in rows[left[rows]]:
            other = right[(~single[right]) | (~left[right]) | (right > r)]
            x, y, score = weigh(np.full(len(other), r), other)
            if top is not None and len(y) > top:
                better = score > best[y - new[g]]  # what is cut here may be the likeliest partner of the other end
                best[y[better] - new[g]], of[y[better] - new[g]] = score[better], r
                few = np.argpartition(-score, top - 1)[:top]
                x, y, score = x[few], y[few], score[few]
                cut.append(new[g])
            found.append((x, y, score))
        y = np.flatnonzero(best > -np.inf)
        found.append((of[y], y + new[g], best[y]))
    x, y, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    keep = np.ones(len(x), dtype=bool)
    if top is not None and len(x):
        one, two = pd.factorize(ids)[0][x], pd.factorize(ids)[0][y]
        pair = np.minimum(one, two) * len(ids) + np.maximum(one, two)
        once = np.unique(pair, return_index=True)[1]
        good = np.zeros(len(once), dtype=bool)
        for end in (one[once], two[once]):
            by = np.lexsort((-score[once], end))
            first = np.flatnonzero(np.concatenate(([True], end[by][1:] != end[by][:-1])))
            rank = np.arange(len(by)) - np.repeat(first, np.diff(np.concatenate((first, [len(by)]))))
            good[by[rank < top]] = True
        keep = np.isin(pair, pair[once[good]])
    cut = np.unique(key[np.concatenate([np.array(cut, dtype=np.int64), x[~keep]])])
    x, y = ids[x[keep]], ids[y[keep]]
    swap = x > y
    pairs = pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)}).drop_duplicates().assign(cut=None)
    return pd.concat([pairs.astype({"cut": "Int64"}), pd.DataFrame({"a": None, "b": None, "cut": pd.array(cut, "Int64")})]).astype({"a": "Int64", "b": "Int64"})


def forest_links(pdf: pd.DataFrame, linker) -> pd.DataFrame:
    """(a, b): of the links between left and right rows of the slots, given whole values, as many as connect what they connect."""
    new, size, _, ids, root, side, value = _slots(pdf)
    out = []
    for start, n in zip(new.tolist(), size.tolist(), strict=True):
        rows = np.arange(start, start + n)
        link, name = linker(value[start : start + n]), root[start : start + n].copy()
        right = np.flatnonzero((side[rows] & RIGHT) > 0)
        for r in np.flatnonzero((side[rows] & LEFT) > 0):
            others = right[name[right] != name[r]]
            for y in others[link(int(r), others)] if len(others) else ():
                if name[y] != name[r]:
                    out.append((ids[start + r], ids[start + y]))
                    name[name == name[y]] = name[r]
    return pd.DataFrame([(min(x), max(x)) for x in out], columns=["a", "b"], dtype="int64")


def _comparison(likeness, top: int | None):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return best_pairs(pdf, likeness, top)

    return compare


def _linking(linker):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return forest_links(pdf, linker)

    return link


def slots(block: int) -> str:
    """The slots of a row: the whole bucket in one; else rare rows stand left in all blocks and every row stands right beside all blocks of rare rows."""
    return f"""CASE WHEN size <= {block} THEN array(struct(0L AS i, 0L AS j, IF(rare, {LEFT + RIGHT}, {RIGHT}) AS side))
  WHEN is_first THEN array(struct(pmod(xxhash64(id, key), ceil(size / {block})) AS i, 0L AS j, {LEFT + RIGHT} AS side))
  ELSE concat(
    transform(sequence(0L, ceil(n_rare / {block}) - 1), x -> struct(x AS i, pmod(xxhash64(id), ceil(size / {block})) AS j, {RIGHT} AS side)),
    IF(rare, transform(sequence(0L, ceil(size / {block}) - 1), x -> struct(pmod(xxhash64(id, 0), ceil(n_rare / {block})) AS i, x AS j, {LEFT} AS side)), array()))
  END"""


def linked_groups(members: DataFrame, sketches: DataFrame, likeness, verify, rounds=((8, 1), (1, 2), (1, 16), (1, 256), (1, None)), links: DataFrame | None = None, whole=None, linker=None) -> DataFrame:
    """(id, root) of the graph of verified links between ids of the same bucket, for ids that are not their own root.

    members: (key, id), both long; all ids of a key are candidates of one another. sketches: (id, sketch), joined only to the
    ids of open buckets. ``likeness`` takes two arrays of sketches (rows of bytes) and returns a score and whether a link is plausible; ``verify`` takes pairs
    (a, b), a < b, and returns those that link. links: pairs known to link. A round compares the sketches of ids that are not yet connected, inside
    tasks of bounded size, and sends only the likeliest partners of each id to ``verify``. rounds: (one bucket in so many,
    partners of an id). The first looks at a few buckets, and at large ones block by block, to connect most copies cheaply; those from one in
    one on look at all pairs of ids of different components of a bucket, the last without a bound on partners. In a large bucket only ids beyond its commonest
    component are compared with all others, in blocks, a task for each pair of blocks. Once a
    group of copies is connected, none of its pairs is looked at again. A bucket is done when all its ids are connected or all its plausible pairs were
    verified: no link between components is missed. With ``whole`` and ``linker`` buckets that the rounds leave open are compared by whole values:
    whole(ids) gives (id, sketch) with the value as sketch, linker(values) a function of a row and rows that says which link; tasks return no more pairs than connect their ids.
    """
    kind = members.dtypes[members.columns.index("id")][1]
    members = members.select("key", "id").distinct()
    sized = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    m = written(members.join(sized, "key"), "members")
    roots = None if links is None else written(components(links), "roots")
    tested = None
    for one_in, top in (*rounds, (1, "whole")) if whole else rounds:
        first, last = one_in > 1, top == "whole"
        named = m.where(F.pmod(F.xxhash64("key", F.lit("first")), F.lit(one_in)) == 0) if first else m
        if roots is None:
            named = named.withColumn("root", F.col("id"))
        else:
            named = named.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
            live = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
            named = named.join(live, "key", "left_semi")
        if first or roots is None:
            named = named.selectExpr("*", "true AS rare", "size AS n_rare")
        else:
            named = written(named, "live")
            common = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.max("n").alias("most"))
            named = named.join(common, "key").selectExpr("key", "id", "size", "root", "root <> common AS rare", "size - most AS n_rare")
        block, task = (BLOCK, TASK if top else BLOCK)
        if last:
            # whole values have any size: blocks are cut so that two of them fit in a task, whatever the longest value
            values = written(whole(written(named.select("id").distinct(), "open-ids")).select("id", "sketch"), "open-values")
            longest = values.agg(F.max(F.length("sketch"))).first()[0] or 1
            block = max(1, min(BLOCK // 4, TASK_BYTES // (2 * longest)))
            task = min(TASK // 4, 2 * block)
        named = written(named.selectExpr("*", f"{first} AS is_first").selectExpr("key", "id", "size", "root", f"{slots(block)} AS slots"), "open")
        n = named.agg(F.sum(F.size("slots"))).first()[0]
        if not n:
            if first:
                continue
            break
        slot = named.join((values if last else sketches).select("id", "sketch"), "id").selectExpr("key", "id", "root", "sketch", "inline(slots)")
        slot = slot.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts_for(n, task))))
        if last:
            found = slot.groupBy("task").applyInPandas(_linking(linker), f"a {kind}, b {kind}")
            links = written(found if links is None else links.unionByName(found), "links")
            return written(components(links), "roots")
        pairs = slot.groupBy("task").applyInPandas(_comparison(likeness, top), f"a {kind}, b {kind}, cut long")
        pairs = written(pairs.distinct(), "pairs")
        fresh = pairs.where("cut IS NULL").select("a", "b")
        if tested is not None:
            fresh = fresh.join(tested, ["a", "b"], "left_anti")
        if not fresh.isEmpty():
            found = written(verify(fresh).select("a", "b"), "links")
            links = found if links is None else links.unionByName(found)
            tested = fresh if tested is None else tested.unionByName(pairs.where("cut IS NULL").select("a", "b"))
            roots = written(components(links), "roots")
        if not first:
            m = named.select("key", "id", "size").join(pairs.where("cut IS NOT NULL").select(F.col("cut").alias("key")).distinct(), "key", "left_semi")
    return members.sparkSession.createDataFrame([], f"id {kind}, root {kind}") if roots is None else roots


# --- joins ----------------------------------------------------------------------------------

BITS = 1 << 24


def thinned(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose ``column`` is not in ids (one column); none that is in ids is lost.

    A bitmap of at most BITS bits (262,144 rows of 12 bytes, at any size of the data) goes to all tasks, so that
    a join with ids after it moves few other rows. Where ids fill the bitmap, the join alone does the work.
    """

    def place(c: str) -> str:
        return f"pmod(xxhash64({c}), {BITS}L)"

    bits = ids.toDF("id").selectExpr(f"{place('id')} AS h").groupBy(F.expr("cast(h div 64 AS int)").alias("thin_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 AS int))")).alias("thin_bits"))
    on = F.expr(f"cast({place(f'`{column}`')} div 64 AS int)")
    kept = df.join(F.broadcast(bits), on == F.col("thin_word")).where(F.expr(f"shiftright(thin_bits, cast({place(f'`{column}`')} % 64 AS int)) & 1L = 1L"))
    return kept.drop("thin_word", "thin_bits")


def unused(name: str, columns: list[str]) -> str:
    """``name``, or with underscores until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
