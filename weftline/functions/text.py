"""Text functions as column expressions; only NFKC, which Spark lacks, is a vectorised UDF."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..batches import mapped

# The boilerplate phrases with what ends each (a blank line, a line, or the text), in this order.
BOILERPLATE = [
    r"Subscribe to our newsletter.*?(?=\n\n|\z)",
    r"Follow us on.*?(?=\n\n|\z)",
    r"Share this (?:article|post|page).*?(?=\n\n|\z)",
    r"(?:All rights reserved|Copyright © \d{4}).*?(?=\n|\z)",
    r"Cookie (?:policy|settings|preferences).*?(?=\n\n|\z)",
    r"Accept cookies.*?(?=\n\n|\z)",
]
# What marks a refusal, anywhere in a text.
REFUSALS = r"(?i)(I cannot|I'm unable|As an AI)"
SPACE = r"(?U)\s+"
#: Stands in for a byte-pair vocabulary: letters, up to three digits, or other signs in a row.
PRE_TOKEN = r"(?U)\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def _nfkc(texts: pa.Array) -> pa.Array:
    return mapped(lambda some: pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in some.to_pylist()], pa.string()), pa.string(), texts)


def nfkc(text: Column) -> Column:
    return F.arrow_udf(_nfkc, "string")(text)


def trim_all(text: Column) -> Column:
    """Strip any Unicode white space from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """At most one blank line and one space in a row, ends stripped."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return trim_all(F.regexp_replace(text, r"[ \t]+", " "))


def strip_boilerplate(text: Column) -> Column:
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, f"(?isu){pattern}", "")
    return text


def clean_spaces(text: Column) -> Column:
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return trim_all(F.regexp_replace(text, r" \n", "\n"))


def clean(text: Column, normalise: bool = True) -> Column:
    """NFKC, boilerplate, white space, in this order."""
    return clean_spaces(strip_boilerplate(nfkc(text) if normalise else text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("int")


def is_content_rich(text: Column, min_words: int = 50) -> Column:
    return word_count(text) >= min_words


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PRE_TOKEN)).cast("int")


def paragraphs(text: Column, breaks: str = r"\n{2,}") -> Column:
    return F.filter(F.transform(F.split(text, breaks), trim_all), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), trim_all), lambda s: s != "")


def is_refusal(text: Column) -> Column:
    return text.rlike(REFUSALS)


def preview(text: Column, width: int = 80) -> Column:
    """The first characters on one line, with an ellipsis only when there is more."""
    head = F.translate(F.substring(text, 1, width), "\n", " ")
    return F.when(F.length(text) > width, F.concat(head, F.lit("…"))).otherwise(head)


def split_thinking(text: Column) -> Column:
    """struct(content, thinking): what stands outside and inside <think> tags; an open tag reaches to the end."""
    inside = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)(?:</think>|\z)"), F.lit(1)), "")
    return F.struct(F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|\z)", "").alias("content"), inside.alias("thinking"))


def short_date(at: Column) -> Column:
    """Year to minute, as reports print a moment."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def grouped(n: Column, places: int = 0) -> Column:
    """A number with commas between thousands and a fixed number of places."""
    return F.format_number(n, places)


def bar(per_cent: Column, step: int = 5) -> Column:
    """A block for every full ``step`` per cent."""
    return F.repeat(F.lit("\u2588"), F.floor(per_cent / step).cast("int"))
