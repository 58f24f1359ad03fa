"""Chunk packing over rows: prefix sums of tokens, a next-chunk pointer for every part, pointers doubled until all chunks are found.

``split_text`` walks the parts of one text in order. Here every part j knows, without walking, where the chunk that it
begins would end: the chunk opens at g(j), the first part from which the tokens in front of j sum to at most the overlap, and ends
in front of the first part beyond j whose tokens pass the size. Both are range searches in prefix sums (window frames over
sorted sums). g never falls as j grows, so a chunk that begins at j is the same whatever came before it, and the chunks of a text are the
chain of pointers from its first part. Doubling finds chains in as many rounds as the longest has binary
digits; a round keeps only pointers that have not left their text, so short texts drop out first. Overlap must not exceed the size.

Parts are rows: a long text's packing needs no single value that holds it, and nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .chunks import parts


def part_rows(df: DataFrame, key: str, text: str = "text", size: int = 512, breaks: str = r"\n{2,}") -> DataFrame:
    """(key, i, part, tokens): the parts of each text in order. ``key`` names a row; null and blank texts have none."""
    # the outer form, as a filter on the number of parts would make them twice
    rows = df.select(key, F.posexplode_outer(parts(F.col(text), size, breaks)).alias("i", "p"))
    return rows.where("i IS NOT NULL").select(key, "i", "p.part", F.col("p.tokens").cast("long").alias("tokens"))


def pointers(rows: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """(key, j, opens, ends, n) of (key, i, tokens): where a chunk that begins at part j opens and ends, and the parts of the text."""
    by_place = Window.partitionBy(key).orderBy("i")
    p = rows.select(key, "i", "tokens", (F.sum("tokens").over(by_place) - F.col("tokens")).alias("before"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    near = Window.partitionBy(key).orderBy("before").rangeBetween(-overlap, 0)
    p = p.withColumns({"opens": F.min("i").over(near), "from": F.min("before").over(near)})
    # a part's end and a chunk's bound on one line: the last end up to the bound is the last part that fits
    line = p.selectExpr(
        f"`{key}`",
        "inline(array(struct(before + tokens AS at, 0 AS kind, i AS ended, cast(null AS int) AS j, cast(null AS int) AS opens, n), "
        f"struct(`from` + {size} AS at, 1 AS kind, cast(null AS int) AS ended, i AS j, opens, n)))",
    )
    fits = F.max("ended").over(Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.withColumn("fits", fits).where("kind = 1")
    return line.select(key, "j", "opens", F.least(F.greatest(F.col("j") + 1, F.coalesce(F.col("fits"), F.lit(-1)) + 1), "n").cast("int").alias("ends"), F.col("n").cast("int").alias("n"))


def chains(jumps: DataFrame, key: str) -> DataFrame:
    """(key, j): the parts reached from part 0 of each key over jumps (key, j, to); to beyond j, no row where the chain ends."""
    starts = jumps.select(key).distinct().withColumn("j", F.lit(0))
    reached, jump = starts, written(jumps, "jumps")
    while True:
        more = reached.join(jump, [key, "j"]).select(key, F.col("to").alias("j"))
        reached = written(reached.unionByName(more), "reached")
        onward = jump.select(key, F.col("j").alias("from"), F.col("to").alias("j")).join(jump, [key, "j"]).select(key, F.col("from").alias("j"), "to")
        jump = written(onward, "jumps")
        if jump.isEmpty():
            return reached


def chunk_bounds(rows: DataFrame, key: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, chunk_index, first, last): the parts of each chunk of (key, i, tokens); chunks overlap by whole parts."""
    if overlap > size:
        raise ValueError("an overlap beyond the size has no chunks of its own")
    p = written(pointers(rows, key, size, overlap), "pointers")
    links = p.where("ends < n").select(key, "j", F.col("ends").alias("to"))
    found = chains(links, key).unionByName(p.where("j = 0 AND ends = n").select(key, "j"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("j")) - 1
    return p.join(found, [key, "j"]).select(key, at.alias("chunk_index"), F.col("opens").alias("first"), (F.col("ends") - 1).alias("last"))


def packed(df: DataFrame, key: str, text: str = "text", size: int = 512, overlap: int = 64, breaks: str = r"\n{2,}") -> DataFrame:
    """(key, chunk_index, content, tokens): the chunks that ``split_text`` makes of each text."""
    rows = written(part_rows(df, key, text, size, breaks), "parts")
    bounds = chunk_bounds(rows.select(key, "i", "tokens"), key, size, overlap)
    places = bounds.select(key, "chunk_index", F.explode(F.sequence("first", "last")).alias("i"))
    one = F.sort_array(F.collect_list(F.struct("i", "part")))
    out = places.join(rows, [key, "i"]).groupBy(key, "chunk_index").agg(one.alias("p"), F.sum("tokens").alias("tokens"))
    return out.select(key, "chunk_index", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("content"), "tokens")
