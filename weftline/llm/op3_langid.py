"""Language identification of mixed text: script ranges, word scores, Viterbi with a switching penalty.

The model holds, per language, smoothed character-trigram probabilities of words and the share of each script
range. A word's script narrows its candidates to the languages that were seen with that script (all, if none
was); candidates get the trigram log-probability, others are out of reach. Viterbi over a text's words with
a penalty for each switch labels spans; words without letters score nothing and take their neighbours' label.
The language with the most letters is the prediction and its share of the letters is the score.

Training reads at most TRAIN_DOCS labelled documents (the smallest by a hash of id and text), whole texts. Their
trigrams and scripts are counted where they stand; only those counts come to the driver.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

TRAIN_DOCS, SWITCH, ALPHA, SHARE, KEPT_WORDS, SLICE, UNKNOWN = 3000, 12.0, 0.05, 0.001, 100_000, 3_000_000, "und"
OUT_OF_REACH = -1e6

# Ranges of code points, from the Unicode blocks.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]


def script(ch: str) -> str:
    c = ord(ch)
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def letters(word: str) -> str:
    return word if word.isalpha() else "".join([c for c in word if c.isalpha()])


def features(words: Counter) -> Counter:
    """Trigrams of the words' letters, and their scripts by (SCRIPT, name)."""
    out: Counter = Counter()
    for word, k in words.items():
        w = letters(word)
        if w:
            out[SCRIPT, script(w[0])] += k
            padded = f"^^{w}$"
            for j in range(len(w) + 1):
                out[TRIGRAM, padded[j : j + 3]] += k
    return out


SCRIPT, TRIGRAM = "script", "trigram"


class Model:
    """Counts of (language, kind, feature) made into trigram probabilities and script shares."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        self.langs = sorted({row[0] for row in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        n = len(self.langs)
        tri: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        con: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        scr: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        chars = set()
        for lang, kind, x, k in counts:
            i = at[lang]
            if kind == SCRIPT:
                scr[x][i] += k
            else:
                tri[x][i] += k
                con[x[:2]][i] += k
                chars.add(x[2])
        chars.discard("$")
        size = len(chars) + 2
        total = sum(scr.values(), np.zeros(n))
        self.allowed = {s: v / np.maximum(total, 1) >= SHARE for s, v in scr.items()}
        # rows of log-probabilities: the trigrams seen, then what a new trigram gets after each pair seen, then after a new pair
        self.seen = {g: i for i, g in enumerate(tri)}
        self.after = {g: len(tri) + i for i, g in enumerate(con)}
        table = [(v + ALPHA) / (con[g[:2]] + ALPHA * size) for g, v in tri.items()]
        table += [ALPHA / (v + ALPHA * size) for v in con.values()] + [np.full(n, 1 / size)]
        self.logs = np.log(np.array(table).reshape(len(table), n))
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs) + 1))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probabilities by language, then the number of letters, a row a word."""
        n, none = len(self.langs), len(self.logs) - 1
        out = np.zeros((len(words), n + 1))
        seen, after, grams, size, at, kinds = self.seen.get, self.after.get, [], [], [], []
        for i, word in enumerate(words):
            w = letters(word)
            if w:
                s = f"^^{w}$"
                grams += [seen(s[k : k + 3]) if s[k : k + 3] in self.seen else after(s[k : k + 2], none) for k in range(len(w) + 1)]
                size.append(len(w))
                at.append(i)
                kinds.append(script(w[0]) if w[0] > "\u024f" else "latin")
        if at:
            step = np.array(size) + 1
            got = np.add.reduceat(self.logs[grams], np.cumsum(step) - step, axis=0)
            for kind in set(kinds):
                ok = self.allowed.get(kind)
                if ok is not None and ok.any() and not ok.all():
                    got[np.ix_(np.array([k == kind for k in kinds]), ~ok)] = OUT_OF_REACH
            out[at, :n], out[at, n] = got, size
        return out

    def ids(self, words: list[str]) -> list[int]:
        cache = self.cache
        new = list({w for w in words if w not in cache})
        need = len(cache) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))))
        if new:
            self.rows[len(cache) : need] = self.scores(new)
            cache.update(zip(new, range(len(cache), need), strict=True))
        return [cache[w] for w in words]

    def label(self, texts: list[str | None]):
        """(language, score, spans [(language, words)]) of each text."""
        if len(self.cache) > KEPT_WORDS:
            self.forget()
        lists = [(t or "").lower().split() for t in texts]
        flat = np.array(self.ids([w for ws in lists for w in ws]), dtype=np.int64)
        size = np.array([len(ws) for ws in lists])
        start = np.cumsum(size) - size
        emit, n = self.rows[flat], len(self.langs)
        path = viterbi(emit[:, :n], start, size, SWITCH)
        out = []
        for s, k in zip(start.tolist(), size.tolist(), strict=True):
            weight = emit[s : s + k, n]
            if not weight.sum():
                out.append((UNKNOWN, 0.0, []))
                continue
            lab = path[s : s + k]
            share = np.bincount(lab, weights=weight, minlength=n)
            best = int(share.argmax())
            turn = np.concatenate(([0], np.flatnonzero(np.diff(lab)) + 1, [k]))
            spans = [{"lang": self.langs[lab[a]], "words": int(b - a)} for a, b in zip(turn[:-1], turn[1:], strict=True)]
            out.append((self.langs[best], float(share[best] / share.sum()), spans))
        return out


def viterbi(emit: np.ndarray, start: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of every text at once, one step a word place; the longest texts come first so that those still running are a prefix."""
    order = np.argsort(-size, kind="stable")
    s, k = start[order], size[order]
    n, most = emit.shape[1], int(k[0]) if len(k) else 0
    value, back = np.zeros((len(k), n)), []
    kind = np.int8 if n <= 127 else np.int32
    own = np.arange(n, dtype=kind)[None, :]
    live = np.searchsorted(-k, -np.arange(most), side="left") if most else []
    for t in range(most):
        a = int(live[t])
        v = value[:a]
        if t:
            top = v.argmax(axis=1)
            move = v[np.arange(a), top] - penalty
            stay = v >= move[:, None]
            back.append(np.where(stay, own, top[:, None].astype(kind)))
            v = np.where(stay, v, move[:, None])
        else:
            back.append(None)
        value[:a] = v + emit[s[:a] + t]
    path = np.zeros(len(emit), dtype=np.int64)
    now = value.argmax(axis=1) if len(k) else np.zeros(0, np.int64)
    for t in range(most - 1, -1, -1):
        a = int(live[t])
        path[s[:a] + t] = now[:a]
        if t:
            now[:a] = back[t][np.arange(a), now[:a]]
    return path


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> Model | None:
    """Fit on (doc_id, text, lang) rows that are labelled, equal rows once; None if there is none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("place", F.xxhash64("doc_id", "text"))
    last = known.select("place").orderBy("place").limit(limit).agg(F.max("place")).first()[0]
    if last is None:
        return None
    # hashes alone are sorted; texts stay where they are, but for the few of the sample
    sample = known.where(F.col("place") <= last).dropDuplicates(["place"])

    def count(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words[lang].update(text.lower().split())
        rows = [(lang, kind, x, n) for lang, w in words.items() for (kind, x), n in features(w).items()]
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "kind", "x", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, kind string, x string, n long").groupBy("lang", "kind", "x").agg(F.sum("n").alias("n"))
    counts = [tuple(r) for r in counted.collect()]
    return Model(sorted(counts)) if counts else None


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df plus lang_pred, score and spans (runs of words of one language).

    A text that is null, empty or without letters is ``und`` with score 0, and so is every text where nothing
    was learned. Whole texts; columns named like the results are replaced, others and repeated rows pass.
    """
    names = ("lang_pred", "score", "spans")
    keep = [f for f in df.schema.fields if f.name not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["lang_pred string", "score double", "spans array<struct<lang:string,words:int>>"])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, parts_of(model)))

    def run(batches):
        m = model_of(*shared.value)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                texts = part.column(text).to_pylist()
                found = m.label(texts) if m else [(UNKNOWN, 0.0, [])] * len(texts)
                more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], kind)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + more, [f.name for f in keep] + list(names))

    return df.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, schema)


_LOADED: dict = {}


def parts_of(model: Model | None):
    """What a worker needs; its size is bounded by the trigrams of TRAIN_DOCS documents."""
    return None if model is None else {k: getattr(model, k) for k in ("langs", "seen", "after", "logs", "allowed")}


def model_of(name: str, parts) -> Model | None:
    """The model of a broadcast; a worker builds it once."""
    if parts is None:
        return None
    if name not in _LOADED:
        m = Model([])
        m.__dict__.update(parts)
        m.forget()
        _LOADED.clear()
        _LOADED[name] = m
    return _LOADED[name]


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").where(F.coalesce(~held_out(), F.lit(True))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
