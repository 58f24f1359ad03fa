"""Message arrays: scores, fingerprints, formats. A message is struct<role,content>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_refusal, word_count

# The roles of the ShareGPT format.
SHAREGPT_ROLES = {"user": "human", "assistant": "gpt", "system": "system"}


def message_score(message: Column, min_question: int = 5, min_answer: int = 10) -> Column:
    """Users by length, assistants by length and a tenth on refusal; null for other roles."""
    words = F.coalesce(word_count(message["content"]), F.lit(0)).cast("double")
    answer = F.least(F.lit(1.0), words / min_answer) * F.when(F.coalesce(is_refusal(message["content"]), F.lit(False)), 0.1).otherwise(1.0)
    return F.when(message["role"] == "user", F.least(F.lit(1.0), words / min_question)).when(message["role"] == "assistant", answer)


def sample_score(messages: Column, min_question: int = 5, min_answer: int = 10) -> Column:
    """The mean over scored messages, 0 without any."""
    scores = F.filter(F.transform(messages, lambda m: message_score(m, min_question, min_answer)), lambda s: s.isNotNull())
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    return F.coalesce(total / F.greatest(F.size(scores), F.lit(1)), F.lit(0.0))


def fingerprint(messages: Column, width: int = 200) -> Column:
    """MD5 of the first characters of all contents in a row."""
    joined = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    return F.md5(F.substring(joined, 1, width).cast("binary"))


def sharegpt(messages: Column, system: str = "") -> Column:
    roles = F.create_map(*[F.lit(x) for pair in SHAREGPT_ROLES.items() for x in pair])
    turns = F.transform(messages, lambda m: F.struct(F.coalesce(roles[m["role"]], m["role"]).alias("from"), F.coalesce(m["content"], F.lit("")).alias("value")))
    if system:
        turns = F.concat(F.array(F.struct(F.lit("system").alias("from"), F.lit(system).alias("value"))), turns)
    return turns


def first_of(messages: Column, role: str) -> Column:
    """The first content of a role, '' without one."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"], F.lit(""))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))
