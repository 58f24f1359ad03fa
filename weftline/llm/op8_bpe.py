"""BPE encoding and decoding by content-defined chunks that documents share.

A rolling hash over the last WINDOW bytes cuts texts where its low bits are zero, so the same passage is cut
at the same places in every document. A cut inside a word (no ASCII white space beside it) would change the
merges there; such a join is repaired: the word around it leaves both chunks and is encoded whole, and joins
that meet become one, until every piece begins and ends at white space. The tokenizer drops white space and
never merges or normalises across it, so the pieces' tokens are the whole text's tokens, one after the other.
A piece is encoded once and its tokens are used again wherever it recurs, and so are the words inside new
pieces: a worker keeps at most KEPT_WORDS words and KEPT_BYTES of pieces, and what it does not keep it
encodes again (results do not depend on it).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, BYTE_CODES, IS_SPACE, mix64, powers, slices, table, text_buffer

WINDOW, MASK, KEPT_WORDS, KEPT_BYTES, SLICE, TOGETHER = 16, 0xFF, 200_000, 32_000_000, 1_500_000, 5000

# The vocabulary's pattern for pre-tokens, for the characters that PLAIN lets through.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\sa-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f0-9\u00b2\u00b3\u00b9\u00bc-\u00be]+")
PLAIN = re.compile(r"[\t-\r -~\u00a1-\u012f\u0131-\u017e]*")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(raw: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Bounds of the repaired pieces of a buffer of documents; each document's start is one."""
    n = len(raw)
    if not n:
        return np.zeros(1, np.int64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[raw] * powers(BASE, n), out=prefix[1:])
    inv = powers(BASE_INV, n + 1)
    at = np.arange(WINDOW, n + 1)
    rolling = mix64((prefix[at] - prefix[at - WINDOW]) * inv[at - WINDOW])
    cuts = at[(rolling & np.uint64(MASK)) == 0]
    space = IS_SPACE[raw]
    # a word's start: a document's start or the byte after white space; its end: white space or a document's end
    edge = np.zeros(n + 1, dtype=bool)
    edge[doc_starts] = edge[n] = True
    starts = edge.copy()
    starts[1:] |= space
    ends = edge.copy()
    ends[:-1] |= space
    before, after = np.flatnonzero(starts | edge), np.flatnonzero(ends)
    low = before[np.searchsorted(before, cuts, side="right") - 1]
    high = after[np.searchsorted(after, cuts)]
    safe = (low == cuts) | (high == cuts)
    return np.unique(np.concatenate((doc_starts, [n], cuts[safe], low[~safe], high[~safe])))


class Coder:
    """The tokenizer of one vocabulary file with the words and pieces a worker keeps.

    Pieces of plain letters and signs (one code point each way under NFC and lower case, no special token) are split
    by the tokenizer's own pattern into pre-tokens; new ones are encoded many in a text, one space between
    them, and told apart by the word-end mark. Other pieces are encoded word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict = {}
        self.pieces: dict[bytes, tuple[bytes, bytes]] = {}
        self.size = 0

    def one(self, text: str) -> tuple[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) and decoded text."""
        e = self.tok.encode(text, add_special_tokens=False)
        return np.array(e.ids, dtype="<u4").tobytes(), " ".join(e.tokens).encode()

    def code(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Pre-tokens, many in one text."""
        found = {}
        for s in range(0, len(words), TOGETHER):
            part = words[s : s + TOGETHER]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids, tokens = np.array(e.ids, dtype="<u4"), e.tokens
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) != len(part) or cut[-1] != len(ids):
                found.update((w, self.one(w)) for w in part)
                continue
            for w, x, y in zip(part, [0, *cut[:-1]], cut, strict=True):
                found[w] = ids[x:y].tobytes(), " ".join(tokens[x:y]).encode()
        return found

    def encode(self, new: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        texts = [p.decode() for p in new]
        plain = [bool(PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        lists = [PRE_TOKENS.findall(t.lower()) if ok else [w.decode() for w in p.split()] for p, t, ok in zip(new, texts, plain, strict=True)]
        known = self.words
        if len(known) > KEPT_WORDS:
            known = self.words = {}
        known.update(self.code(list({w for ws, ok in zip(lists, plain, strict=True) if ok for w in ws if w not in known})))
        out = {}
        for p, ws, ok in zip(new, lists, plain, strict=True):
            got = [known[w] for w in ws] if ok else [g for w in ws if (g := self.one(w))[0]]
            out[p] = b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])
        return out

    def run(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        bounds = pieces(raw, offsets[:-1][offsets[:-1] < len(raw)])
        data = raw.tobytes()
        cut = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        new = list({p for p in cut if p not in self.pieces})
        self.pieces.update(self.encode(new))
        self.size += sum(len(p) * 4 for p in new)
        first = np.searchsorted(bounds, offsets).tolist()
        ids, texts = [], []
        for a, b in zip(first[:-1], first[1:], strict=True):
            got = [self.pieces[p] for p in cut[a:b]]
            ids.append(b"".join([g[0] for g in got]))
            texts.append(b" ".join([g[1] for g in got if g[0]]))
        if self.size > KEPT_BYTES:
            self.pieces, self.size = {}, 0
        return ids, texts


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """df's columns but text, plus ids (binary: little-endian unsigned 32-bit) and decoded (string).

    Null and empty texts have no ids and decode to ''. Works on whole texts of any length, row by row, so
    repeated rows, ties and further columns pass through; columns named ids or decoded are replaced.
    """
    keep = [f for f in df.schema.fields if f.name not in (text, "ids", "decoded")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["ids binary", "decoded string"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, texts = coder(vocabulary).run(*text_buffer(part.column(text)))
                cols = [part.column(f.name) for f in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], [f.name for f in keep] + ["ids", "decoded"])

    return df.select(*[f"`{f.name}`" for f in keep], F.col(text)).mapInArrow(run, schema)


def digests(coded: DataFrame, *keep: str) -> DataFrame:
    return coded.select(
        *keep,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, word_vocabulary()), "doc_id")
