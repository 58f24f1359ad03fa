"""Thinking tags in a stream of tokens: tags may be cut between any two tokens, rows or batches.

An automaton reads one token at a time. It is outside or inside a tag's text and holds back the last characters while they
may be the beginning of the tag that would change that; all else goes out at once. What goes out in all is what
``split_thinking`` gives for the whole text.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, CLOSE = "<think>", "</think>"


def feed(inside: bool, held: str, token: str) -> tuple[bool, str, str, str]:
    """(inside, held, content, thinking) after a token."""
    text, out = held + token, ["", ""]
    while True:
        tag = CLOSE if inside else OPEN
        at = text.find(tag)
        if at < 0:
            break
        out[inside] += text[:at]
        text, inside = text[at + len(tag) :], not inside
    keep = next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)
    out[inside] += text[: len(text) - keep]
    return inside, text[len(text) - keep :], out[0], out[1]


def step(inside: bool, held: str, token: str | None, last: bool) -> tuple[bool, str, str, str]:
    """feed(), and after a stream's last token what was held back and the state of a new stream."""
    inside, held, content, thinking = feed(inside, held, token or "")
    if not last:
        return inside, held, content, thinking
    return False, "", content + ("" if inside else held), thinking + (held if inside else "")


def split_tokens(stream: DataFrame) -> DataFrame:
    """(stream_id, pos, content, thinking) of tokens (stream_id, pos, token, last), in the order of pos; a stream's later batches hold later tokens.

    The last token of a stream (last) gives out what was held back and ends its state. Null tokens are empty. A static table is one batch.
    """
    columns = ["stream_id", "pos", "content", "thinking"]

    def advance(tokens: pd.DataFrame, inside: bool, held: str):
        rows = []
        for stream_id, pos, token, last in tokens.sort_values("pos", kind="stable")[["stream_id", "pos", "token", "last"]].itertuples(index=False):
            inside, held, content, thinking = step(inside, held, "" if token != token else token, last)
            rows.append((stream_id, pos, content, thinking))
        return pd.DataFrame(rows, columns=columns), inside, held

    schema = f"stream_id {stream.schema['stream_id'].dataType.simpleString()}, pos long, content string, thinking string"
    tokens = stream.selectExpr("stream_id", "cast(pos AS long) AS pos", "token", "coalesce(last, false) AS last")
    if not stream.isStreaming:

        def whole(batches):
            now, inside, held = object(), False, ""
            for batch in batches:
                content, thinking = [], []
                for stream_id, token, last in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "token", "last")), strict=True):
                    if stream_id != now:
                        now, inside, held = stream_id, False, ""
                    inside, held, said, thought = step(inside, held, token, last)
                    content.append(said)
                    thinking.append(thought)
                yield pa.RecordBatch.from_arrays([batch.column("stream_id"), batch.column("pos"), pa.array(content, pa.string()), pa.array(thinking, pa.string())], columns)

        # a task reads its streams one after the other: no call a stream
        return tokens.repartition("stream_id").sortWithinPartitions("stream_id", "pos").mapInArrow(whole, schema)

    def on_batch(key, frames, state):
        inside, held = state.get if state.exists else (False, "")
        pdf = pd.concat(list(frames))
        out, inside, held = advance(pdf, inside, held)
        if pdf["last"].any():
            state.remove()
        else:
            state.update((inside, held))
        yield out

    return tokens.groupBy("stream_id").applyInPandasWithState(on_batch, schema, "inside boolean, held string", "append", "NoTimeout")
