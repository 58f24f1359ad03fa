"""Token-aware chunks with overlap, as a fold in Catalyst and as an Arrow-batched function with the same results."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.text import paragraphs, sentences, token_count

PART = "array<struct<part:string,tokens:int>>"
TOKEN = re.compile(r"[^\W\d_]+|\d{1,3}|(?:[^\w\s]|_)+")


def parts(text: Column, size: int, breaks: str = r"\n{2,}") -> Column:
    """Paragraphs in order, those above the size as their sentences, each with its token count."""
    counted = lambda p: F.struct(p.alias("part"), token_count(p).alias("tokens"))
    return F.flatten(F.transform(paragraphs(text, breaks), lambda p: F.when(token_count(p) > size, F.transform(sentences(p), counted)).otherwise(F.array(counted(p)))))


def _suffix(current: Column, overlap: int) -> Column:
    """The longest run of last parts whose tokens sum to at most the overlap."""
    start = F.struct(F.expr(f"cast(array() as {PART})").alias("kept"), F.lit(0).alias("sum"), F.lit(False).alias("stop"))

    def step(s, p):
        stop = s["stop"] | (s["sum"] + p["tokens"] > overlap)
        return F.struct(F.when(stop, s["kept"]).otherwise(F.concat(F.array(p), s["kept"])).alias("kept"), F.when(stop, s["sum"]).otherwise(s["sum"] + p["tokens"]).alias("sum"), stop.alias("stop"))

    return F.aggregate(F.reverse(current), start, step)


def chunks(text: Column, size: int = 512, overlap: int = 64, breaks: str = r"\n{2,}") -> Column:
    """array<string>: parts packed greedily up to the size; a full chunk hands its last parts, up to the overlap, to the next."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.expr(f"cast(array() as {PART})").alias("cur"), F.lit(0).alias("tot"))
    join = lambda cur: F.array_join(F.transform(cur, lambda p: p["part"]), "\n\n")

    def step(s, p):
        full = (s["tot"] + p["tokens"] > size) & (F.size(s["cur"]) > 0)
        kept = _suffix(s["cur"], overlap)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(join(s["cur"])))).otherwise(s["done"]).alias("done"),
            F.concat(F.when(full, kept["kept"]).otherwise(s["cur"]), F.array(p)).alias("cur"),
            (F.when(full, kept["sum"]).otherwise(s["tot"]) + p["tokens"]).alias("tot"),
        )

    out = F.aggregate(parts(text, size, breaks), start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(join(s["cur"])))).otherwise(s["done"]))
    return F.filter(out, lambda c: c.rlike(r"(?U)\S"))


def packed_sums(tokens: Column, size: int = 512) -> Column:
    """array<bigint>: the tokens of each chunk of parts with so many tokens each, packed greedily without overlap; a first part opens a chunk even if it has none."""
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("done"), F.lit(None).cast("long").alias("tot"), F.lit(False).alias("open"))

    def step(s, n):
        full = s["open"] & (s["tot"] + n > size)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["tot"]))).otherwise(s["done"]).alias("done"),
            F.when(full | ~s["open"], n.cast("long")).otherwise(s["tot"] + n).alias("tot"),
            F.lit(True).alias("open"),
        )

    return F.aggregate(tokens, start, step, lambda s: F.when(s["open"], F.concat(s["done"], F.array(s["tot"]))).otherwise(s["done"]))


def count_tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def split_text(text: str | None, size: int = 512, overlap: int = 64, breaks: str = r"\n{2,}", count=count_tokens) -> list[str]:
    """The same packing for one text, linear in its length; ``count`` may be any tokenizer's."""
    if text is None:
        return []
    pieces: list[tuple[str, int]] = []
    for paragraph in filter(None, (p.strip() for p in re.split(breaks, text))):
        n = count(paragraph)
        if n > size:
            pieces += [(s, count(s)) for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", paragraph)) if s]
        else:
            pieces.append((paragraph, n))
    out: list[str] = []
    opened, total = 0, 0  # the open chunk is pieces[opened:i]
    for i, (_, n) in enumerate(pieces):
        if total + n > size and opened < i:
            out.append("\n\n".join([p for p, _ in pieces[opened:i]]))
            first, total = i, 0
            while first > opened and total + pieces[first - 1][1] <= overlap:
                first -= 1
                total += pieces[first][1]
            opened = first
        total += n
    if opened < len(pieces):
        out.append("\n\n".join([p for p, _ in pieces[opened:]]))
    return [c for c in out if c.strip()]


@lru_cache(maxsize=4)
def vocabulary_counter(path: str):
    """A token counter by a byte-pair vocabulary file of the tokenizers library; special tokens are not added."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def chunks_fast(text: Column, size: int = 512, overlap: int = 64, breaks: str = r"\n{2,}", vocabulary: str | None = None) -> Column:
    """The same chunks by an Arrow-batched function, for long texts, where a fold copies its state at each step.

    With the path of a vocabulary file, tokens are those of that vocabulary.
    """

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        count, kind = vocabulary_counter(vocabulary) if vocabulary else count_tokens, pa.list_(pa.string())
        return mapped(lambda some: pa.array([split_text(t, size, overlap, breaks, count) for t in some.to_pylist()], kind), kind, texts)

    return split(text)


def vocabulary_tokens(text: Column, path: str) -> Column:
    """The number of tokens of a vocabulary file; null for null."""

    @F.arrow_udf("int")
    def tokens(texts: pa.Array) -> pa.Array:
        count = vocabulary_counter(path)
        return mapped(lambda some: pa.array([None if t is None else count(t) for t in some.to_pylist()], pa.int32()), pa.int32(), texts)

    return tokens(text)


@F.udtf(returnType="chunk_index int, content string")
class ChunkRows:
    """A table function of (text, size, overlap): a row a chunk."""

    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(split_text(text, size, overlap))


def register_chunks(spark, name: str = "chunks") -> None:
    """Make ``SELECT ... FROM docs, LATERAL chunks(text, 512, 64)`` possible in SQL."""
    spark.udtf.register(name, ChunkRows)


def records(pages: DataFrame, chunked: Column, session_id: str = "local", vocabulary: str | None = None) -> DataFrame:
    """One row a chunk of (page_id, url, title, author, date, ...): chunk_id is page_id * 10000 + index; tokens by the vocabulary, if one is named."""
    x = pages.select("page_id", "url", "title", "author", "date", F.posexplode(chunked).alias("chunk_index", "content"))
    meta = F.struct(F.col("page_id"), F.col("chunk_index"), F.col("author"), F.col("date"), F.lit(session_id).alias("session_id"))
    return x.select(
        (F.col("page_id") * 10000 + F.col("chunk_index")).alias("chunk_id"),
        F.col("url").alias("source_url"),
        "title",
        "content",
        (vocabulary_tokens(F.col("content"), vocabulary) if vocabulary else token_count(F.col("content"))).alias("token_count"),
        meta.alias("metadata"),
    )
